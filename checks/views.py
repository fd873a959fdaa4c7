"""Telemetry views derived from the given tables: in Spark, and as SQL text for the comparison.

``events`` become spans, logs and metric points; ``orders`` become order requests and workflow spans.
The Spark views are plain projections of SQL expressions, so they also work on a stream of the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
ORDERS = (
    "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table as a stream of files."""
    schema = {"events": EVENTS, "orders": ORDERS}[name]
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    return reader.parquet(sf_dir)


_BAD = "(has_error OR event_id % 41 = 5)"


def spans(events: DataFrame) -> DataFrame:
    raw = events.selectExpr(
        "*",
        """CASE event_type WHEN 'signup' THEN 'activity.validate_order' WHEN 'view' THEN 'activity.check_fraud'
           WHEN 'click' THEN 'activity.process_payment' WHEN 'purchase' THEN 'activity.schedule_shipping'
           ELSE 'activity.reserve_inventory' END AS name""",
        """CASE event_type
           WHEN 'signup' THEN 35.0D
           WHEN 'view' THEN value * CASE user_id % 4 WHEN 0 THEN 3 WHEN 2 THEN 25 ELSE 10 END
           WHEN 'click' THEN least(value, 130.0D)
           WHEN 'purchase' THEN cast(get_json_object(props, '$.k') AS double) + 1.0D
           ELSE least(value, 90.0D) END AS millis""",
        "event_id % CASE user_id % 4 WHEN 0 THEN 1250 WHEN 1 THEN 260 ELSE 70 END = 7 AS has_error",
        """CASE WHEN event_type = 'error' OR user_id % 4 = 3 THEN NULL WHEN user_id % 4 = 0 THEN 'enterprise'
           WHEN user_id % 4 = 1 THEN 'pro' ELSE 'free' END AS customer_tier""",
        "if(user_id % 25 = 24, 'temporal-starter', 'temporal-worker') AS serviceName",
    )
    raw = raw.selectExpr(
        "*",
        "concat('cust-', user_id) AS customer_id",
        """CASE event_type WHEN 'signup' THEN 'validation.failure_reason' WHEN 'click' THEN 'payment.failure_reason'
           WHEN 'error' THEN 'inventory.failure' END AS reason_key""",
        f"""CASE WHEN NOT {_BAD} THEN NULL WHEN event_type = 'signup' THEN 'invalid_address'
            WHEN event_type = 'click' THEN if(event_id % 3 = 0, 'card_declined', 'insufficient_funds')
            WHEN event_type = 'error' THEN 'out_of_stock' END AS reason""",
    )
    strings = """CASE
        WHEN reason IS NULL AND customer_tier IS NULL THEN map('customer.id', customer_id)
        WHEN reason IS NULL THEN map('customer.id', customer_id, 'customer.tier', customer_tier)
        WHEN customer_tier IS NULL THEN map('customer.id', customer_id, reason_key, reason)
        ELSE map('customer.id', customer_id, 'customer.tier', customer_tier, reason_key, reason) END AS attributes_string"""
    numbers = """CASE
        WHEN event_type = 'view' THEN map('order.amount', value, 'fraud.score', (event_id % 86) / 100.0D)
        WHEN event_type IN ('signup', 'click') THEN map('order.amount', value)
        ELSE cast(map() AS map<string,double>) END AS attributes_number"""
    flags = """if(event_type = 'signup' AND reason IS NULL, map('validation.passed', true),
        cast(map() AS map<string,boolean>)) AS attributes_bool"""
    resource = """if(user_id % 2 = 1, map('service.name', serviceName, 'deployment.environment', 'staging'),
        map('service.name', serviceName)) AS resource"""
    return raw.selectExpr(
        "ts AS timestamp",
        "unix_seconds(cast(ts AS timestamp)) DIV 1800 * 1800 AS ts_bucket_start",
        "concat('t', event_id DIV 5) AS trace_id",
        "concat('s', event_id) AS span_id",
        """CASE WHEN event_id % 5 > 0
           THEN concat('s', event_id - event_id % 5 + (event_id % 5 - 1) DIV 2) END AS parent_span_id""",
        "name",
        "'Internal' AS kind",
        "serviceName",
        "cast(round(millis * 1000000) AS bigint) + event_id % 997 + 1 AS duration_nano",
        "has_error",
        strings,
        numbers,
        flags,
        resource,
        "customer_tier",
    )


SPANS_SQL = """
spans_raw AS (
  SELECT event_id, user_id, event_type, value, ts AS timestamp,
    CAST(floor(epoch(ts) / 1800) * 1800 AS BIGINT) AS ts_bucket_start,
    't' || (event_id // 5) AS trace_id,
    's' || event_id AS span_id,
    CASE WHEN event_id % 5 > 0 THEN 's' || (event_id - event_id % 5 + (event_id % 5 - 1) // 2) END AS parent_span_id,
    CASE event_type WHEN 'signup' THEN 'activity.validate_order' WHEN 'view' THEN 'activity.check_fraud'
      WHEN 'click' THEN 'activity.process_payment' WHEN 'purchase' THEN 'activity.schedule_shipping'
      ELSE 'activity.reserve_inventory' END AS name,
    CASE WHEN user_id % 25 = 24 THEN 'temporal-starter' ELSE 'temporal-worker' END AS serviceName,
    CAST(round(CASE event_type
        WHEN 'signup' THEN 35.0
        WHEN 'view' THEN value * CASE user_id % 4 WHEN 0 THEN 3 WHEN 2 THEN 25 ELSE 10 END
        WHEN 'click' THEN least(value, 130.0)
        WHEN 'purchase' THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) + 1.0
        ELSE least(value, 90.0) END * 1000000) AS BIGINT) + event_id % 997 + 1 AS duration_nano,
    event_id % CASE user_id % 4 WHEN 0 THEN 1250 WHEN 1 THEN 260 ELSE 70 END = 7 AS has_error,
    CASE WHEN event_type = 'error' OR user_id % 4 = 3 THEN NULL
      WHEN user_id % 4 = 0 THEN 'enterprise' WHEN user_id % 4 = 1 THEN 'pro' ELSE 'free' END AS tier
  FROM events
),
spans AS (
  SELECT *, 'cust-' || user_id AS customer_id,
    CASE WHEN event_type IN ('signup', 'view', 'click') THEN value END AS amount,
    CASE WHEN event_type = 'view' THEN (event_id % 86) / CAST(100 AS DOUBLE) END AS fraud_score,
    CASE WHEN NOT (has_error OR event_id % 41 = 5) THEN NULL
      WHEN event_type = 'signup' THEN 'invalid_address'
      WHEN event_type = 'click' AND event_id % 3 = 0 THEN 'card_declined'
      WHEN event_type = 'click' THEN 'insufficient_funds'
      WHEN event_type = 'error' THEN 'out_of_stock' END AS reason
  FROM spans_raw
)"""


def logs(events: DataFrame) -> DataFrame:
    """Log lines of the activities that log; some failures have none, some logs name no span."""
    numbered = spans(events).where("name <> 'activity.schedule_shipping'").selectExpr(
        "timestamp", "trace_id", "span_id", "name", "serviceName", "has_error", "customer_tier", "resource",
        "cast(substring(span_id, 2) AS bigint) AS event_id",
    )
    marked = numbered.selectExpr("*", "(has_error AND event_id % 4 <> 3) OR event_id % 53 = 3 AS bad")
    kept = marked.where("bad OR (NOT has_error AND name <> 'activity.reserve_inventory')")
    named = kept.selectExpr(
        "*",
        """CASE WHEN NOT bad THEN 'INFO' WHEN name = 'activity.reserve_inventory' THEN 'WARN'
           ELSE 'ERROR' END AS severity_text""",
    )
    return named.selectExpr(
        "timestamp + INTERVAL 1 SECOND AS timestamp",
        "trace_id",
        "if(event_id % 159 <> 3, span_id, NULL) AS span_id",
        "severity_text",
        "CASE severity_text WHEN 'INFO' THEN 9 WHEN 'WARN' THEN 13 ELSE 17 END AS severity_number",
        """CASE name
           WHEN 'activity.validate_order' THEN if(bad, 'order validation failed', 'order validated')
           WHEN 'activity.check_fraud' THEN if(bad, 'fraud check timeout', 'fraud check completed')
           WHEN 'activity.process_payment' THEN
             concat(if(bad, 'payment failed', 'payment processed'), ' order=', event_id)
           ELSE 'inventory reservation failed' END AS body""",
        "serviceName",
        "if(customer_tier IS NULL, cast(map() AS map<string,string>), map('customer_tier', customer_tier)) AS attributes_string",
        "resource",
    )


LOGS_SQL = """
logs_raw AS (
  SELECT *, (has_error AND event_id % 4 <> 3) OR event_id % 53 = 3 AS bad FROM spans
  WHERE name <> 'activity.schedule_shipping'
),
logs AS (
  SELECT timestamp + INTERVAL 1 SECOND AS timestamp, trace_id,
    CASE WHEN event_id % 159 <> 3 THEN span_id END AS span_id,
    CASE WHEN NOT bad THEN 'INFO' WHEN name = 'activity.reserve_inventory' THEN 'WARN' ELSE 'ERROR' END AS severity_text,
    CASE name
      WHEN 'activity.validate_order' THEN CASE WHEN bad THEN 'order validation failed' ELSE 'order validated' END
      WHEN 'activity.check_fraud' THEN CASE WHEN bad THEN 'fraud check timeout' ELSE 'fraud check completed' END
      WHEN 'activity.process_payment' THEN
        CASE WHEN bad THEN 'payment failed' ELSE 'payment processed' END || ' order=' || event_id
      ELSE 'inventory reservation failed' END AS body,
    serviceName, tier AS customer_tier
  FROM logs_raw
  WHERE bad OR (NOT has_error AND name <> 'activity.reserve_inventory')
)"""


def orders_in(orders: DataFrame) -> DataFrame:
    return orders.selectExpr(
        "cast(o_orderkey AS string) AS order_id",
        "concat('cust-', o_custkey) AS customer_id",
        "CASE o_custkey % 3 WHEN 0 THEN 'enterprise' WHEN 1 THEN 'pro' ELSE 'free' END AS customer_tier",
        "o_totalprice / 100 AS amount",
        "cast(o_orderkey % 5 + 1 AS int) AS items",
        """CASE o_orderkey % 5 WHEN 0 THEN 'credit_card' WHEN 1 THEN 'debit_card' WHEN 2 THEN 'paypal'
           WHEN 3 THEN 'crypto' ELSE 'bank_transfer' END AS payment_method""",
    )


ORDERS_IN_SQL = """
orders_in AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS order_id, 'cust-' || o_custkey AS customer_id,
    CASE o_custkey % 3 WHEN 0 THEN 'enterprise' WHEN 1 THEN 'pro' ELSE 'free' END AS customer_tier,
    o_totalprice / 100 AS amount, CAST(o_orderkey % 5 + 1 AS INTEGER) AS items,
    CASE o_orderkey % 5 WHEN 0 THEN 'credit_card' WHEN 1 THEN 'debit_card' WHEN 2 THEN 'paypal'
      WHEN 3 THEN 'crypto' ELSE 'bank_transfer' END AS payment_method,
    o_orderdate AS received
  FROM orders
)"""


def workflow_spans(orders: DataFrame) -> DataFrame:
    """One workflow per order: steps in order, cut short by failures, repeated by retries, refunded or not."""
    flags = orders.selectExpr(
        "o_orderkey AS k",
        "o_orderdate",
        "concat('cust-', o_custkey) AS customer_id",
        "o_totalprice / 100 AS amount",
        "(o_orderkey % 86) / 100.0D AS score",
        "CASE o_custkey % 3 WHEN 0 THEN 'enterprise' WHEN 1 THEN 'pro' ELSE 'free' END AS t",
        "CASE o_custkey % 3 WHEN 0 THEN 5 WHEN 1 THEN 3 ELSE 2 END AS most",
        "CASE o_custkey % 3 WHEN 0 THEN 24 WHEN 1 THEN 48 ELSE 120 END AS eta_hours",
        "o_orderkey % 50 = 7 AS vf",
        "o_orderkey % 33 = 5 AS ff",
        "o_orderkey % 17 = 4 AS pf",
        "o_orderkey % 25 = 9 AS inf_",
        "o_orderkey % 61 = 11 AS sf",
    )
    reach = flags.selectExpr("*", "NOT vf AS rf", "NOT vf AND NOT ff AND NOT score > 0.8D AS rp")
    reach = reach.selectExpr("*", "rp AND NOT pf AND k % 40 <> 21 AS ri")

    def step(place: int, name: str, reached: str, failing: str, tries: str, millis: str) -> str:
        return (
            f"named_struct('place', {place}, 'name', 'activity.{name}', 'reached', {reached}, 'failing', {failing}, "
            f"'tries', if({failing}, most, {tries}), 'millis', cast({millis} AS bigint))"
        )

    steps = ", ".join(
        [
            step(1, "validate_order", "true", "vf", "if(k % 20 = 3, 2, 1)", "35"),
            step(2, "check_fraud", "rf", "ff", "1", "if(ff, 25200, 120)"),
            step(3, "process_payment", "rp", "pf", "if(k % 13 = 2, 2, 1)", "90"),
            step(4, "reserve_inventory", "ri", "inf_", "1", "55"),
            step(5, "schedule_shipping", "ri AND NOT inf_", "sf", "1", "40"),
            step(6, "refund_payment", "(ri AND inf_ AND k % 100 <> 9) OR (ri AND NOT inf_ AND k % 500 = 250)", "false", "1", "70"),
        ]
    )
    taken = reach.selectExpr("*", f"explode(array({steps})) AS s").where("s.reached")
    tried = taken.selectExpr("*", "explode(sequence(1, s.tries)) AS attempt").selectExpr(
        "*",
        "s.place AS place",
        "s.failing OR attempt < s.tries AS failed",
        "CASE WHEN s.place NOT IN (4, 6) THEN t END AS customer_tier",
        "o_orderdate + make_dt_interval(0, 0, s.place, attempt * 10) AS timestamp",
    )
    strings = """CASE
        WHEN place = 1 AND failed THEN map('customer.id', customer_id, 'customer.tier', t, 'validation.failure_reason', 'invalid_address')
        WHEN place = 3 AND failed THEN map('customer.id', customer_id, 'customer.tier', t, 'payment.failure_reason',
          if(k % 3 = 0, 'card_declined', 'insufficient_funds'))
        WHEN place = 4 AND failed THEN map('customer.id', customer_id, 'inventory.failure', 'out_of_stock')
        WHEN place = 5 AND NOT failed THEN map('customer.id', customer_id, 'customer.tier', t, 'shipping.eta',
          date_format(timestamp + make_dt_interval(0, eta_hours), 'yyyy-MM-dd'))
        WHEN place IN (4, 6) THEN map('customer.id', customer_id)
        ELSE map('customer.id', customer_id, 'customer.tier', t) END AS attributes_string"""
    numbers = """CASE
        WHEN place = 2 AND NOT failed THEN map('order.amount', amount, 'fraud.score', score)
        WHEN place = 3 AND NOT failed THEN map('order.amount', amount, 'payment.charged', amount * 1.08D)
        WHEN place IN (1, 2, 3, 6) THEN map('order.amount', amount)
        ELSE cast(map() AS map<string,double>) END AS attributes_number"""
    return tried.selectExpr(
        "timestamp",
        "concat('w', k) AS trace_id",
        "concat_ws('-', k, place, attempt) AS span_id",
        "s.name AS name",
        "'temporal-worker' AS serviceName",
        "s.millis * 1000000 + (k * 7 + place * 13 + attempt) % 9973 * 1000 + 1 AS duration_nano",
        "failed AS has_error",
        strings,
        numbers,
        "customer_tier",
    )


WORKFLOW_SQL = """
wf_orders AS (
  SELECT o_orderkey AS k, o_orderdate, o_totalprice / 100 AS amount, (o_orderkey % 86) / CAST(100 AS DOUBLE) AS score,
    CASE o_custkey % 3 WHEN 0 THEN 'enterprise' WHEN 1 THEN 'pro' ELSE 'free' END AS t,
    CASE o_custkey % 3 WHEN 0 THEN 5 WHEN 1 THEN 3 ELSE 2 END AS most,
    o_orderkey % 50 = 7 AS vf, o_orderkey % 33 = 5 AS ff, o_orderkey % 17 = 4 AS pf,
    o_orderkey % 25 = 9 AS inf_, o_orderkey % 61 = 11 AS sf
  FROM orders
),
wf_reach AS (
  SELECT *, NOT vf AS rf, NOT vf AND NOT ff AND NOT score > 0.8 AS rp,
    NOT vf AND NOT ff AND NOT score > 0.8 AND NOT pf AND k % 40 <> 21 AS ri
  FROM wf_orders
),
wf_steps AS (
  SELECT *, 1 AS place, 'activity.validate_order' AS name, vf AS failing, CASE WHEN k % 20 = 3 THEN 2 ELSE 1 END AS tries, 35 AS millis FROM wf_reach
  UNION ALL SELECT *, 2, 'activity.check_fraud', ff, 1, CASE WHEN ff THEN 25200 ELSE 120 END FROM wf_reach WHERE rf
  UNION ALL SELECT *, 3, 'activity.process_payment', pf, CASE WHEN k % 13 = 2 THEN 2 ELSE 1 END, 90 FROM wf_reach WHERE rp
  UNION ALL SELECT *, 4, 'activity.reserve_inventory', inf_, 1, 55 FROM wf_reach WHERE ri
  UNION ALL SELECT *, 5, 'activity.schedule_shipping', sf, 1, 40 FROM wf_reach WHERE ri AND NOT inf_
  UNION ALL SELECT *, 6, 'activity.refund_payment', false, 1, 70 FROM wf_reach
    WHERE (ri AND inf_ AND k % 100 <> 9) OR (ri AND NOT inf_ AND k % 500 = 250)
),
wf_tries AS (
  SELECT *, CASE WHEN failing THEN most ELSE tries END AS total FROM wf_steps
),
wf_attempts AS (
  SELECT *, unnest(generate_series(1, total)) AS attempt FROM wf_tries
),
spans AS (
  SELECT o_orderdate + to_minutes(place) + to_seconds(CAST(attempt * 10 AS DOUBLE)) AS timestamp,
    'w' || k AS trace_id, k || '-' || place || '-' || attempt AS span_id, k, place, attempt, name, t,
    'temporal-worker' AS serviceName,
    CAST(CAST(millis AS BIGINT) * 1000000 + (k * 7 + place * 13 + attempt) % 9973 * 1000 + 1 AS BIGINT) AS duration_nano,
    failing OR attempt < total AS has_error,
    CASE WHEN place NOT IN (4, 6) THEN t END AS tier,
    amount, score,
    CASE WHEN NOT (failing OR attempt < total) THEN NULL WHEN place = 1 THEN 'invalid_address'
      WHEN place = 3 AND k % 3 = 0 THEN 'card_declined' WHEN place = 3 THEN 'insufficient_funds'
      WHEN place = 4 THEN 'out_of_stock' END AS reason
  FROM wf_attempts
)"""


BOUNDS = (50, 100, 250, 500, 1000)


def metric_points(events: DataFrame) -> DataFrame:
    """A counter that starts again from time to time, a gauge and a latency histogram, one point per event."""
    edges = ", ".join(f"{b}.0D" for b in BOUNDS)
    lows, highs = (None, *BOUNDS), (*BOUNDS, None)
    inside = [
        " AND ".join([f"value * 3 > {a}" for a in (low,) if a] + [f"value * 3 <= {b}" for b in (high,) if b])
        for low, high in zip(lows, highs)
    ]
    counts = ", ".join(f"cast({test} AS bigint)" for test in inside)

    def points(metric: str, kind: str, value: str, histogram: tuple[str, str, str, str], temporality: str) -> DataFrame:
        bounds, buckets, count, total = histogram
        return events.selectExpr(
            "ts AS timestamp",
            f"'{metric}' AS metric_name",
            f"'{kind}' AS metric_type",
            "if(user_id % 25 = 24, 'temporal-starter', 'temporal-worker') AS serviceName",
            "map('event.type', event_type) AS attributes",
            f"cast({value} AS double) AS value",
            f"cast({bounds} AS array<double>) AS bucket_bounds",
            f"cast({buckets} AS array<bigint>) AS bucket_counts",
            f"cast({count} AS bigint) AS count",
            f"cast({total} AS double) AS sum",
            f"cast({temporality} AS string) AS temporality",
        )

    none = ("NULL",) * 4
    minutes = "unix_seconds(cast(ts AS timestamp)) DIV 60 % 20000"
    counter = points("orders.processed", "sum", minutes, none, "'cumulative'")
    gauge = points("queue.depth", "gauge", "value", none, "NULL")
    histogram = points("request.latency", "histogram", "NULL", (f"array({edges})", f"array({counts})", "1", "value * 3"), "'delta'")
    return counter.unionByName(gauge).unionByName(histogram)


METRICS_SQL = """
metric_points AS (
  SELECT ts AS timestamp, event_type,
    CASE WHEN user_id % 25 = 24 THEN 'temporal-starter' ELSE 'temporal-worker' END AS serviceName,
    CAST(CAST(floor(floor(epoch(ts)) / 60) AS BIGINT) % 20000 AS DOUBLE) AS counter, value AS gauge, value * 3 AS latency
  FROM events
)"""
