"""OTLP JSON export files to spans, logs and metric points.

One line of a file is one export request; requests nest resource, scope and record. 64-bit numbers
arrive as text in this format, so they are declared as strings and cast; text that is no number gives NULL.

Values may also be lists, maps and bytes, and log bodies any value. They are read as VARIANT: with ``nested`` all attributes come as
one VARIANT object, and a log's body as VARIANT too; without, lists and maps stand among the string attributes as JSON text.
Lines that are no request are no records; ``split_otlp`` returns them, and records without a time, with the reason.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spanops import schema as S
from spanops.functions.scalars import resource_upsert
from spanops.sources.tables import with_bucket_start

_VALUE = (
    "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean,bytesValue:string,"
    "arrayValue:variant,kvlistValue:variant>"
)
# Values nested deeper than this stay as they were written.
MAX_DEPTH = 4
_ATTRIBUTES = f"array<struct<key:string,value:{_VALUE}>>"
_RESOURCE = f"struct<attributes:{_ATTRIBUTES}>"

_SPAN = (
    "struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:string,startTimeUnixNano:string,"
    f"endTimeUnixNano:string,attributes:{_ATTRIBUTES},status:struct<code:string>>"
)
_LOG = (
    f"struct<timeUnixNano:string,severityNumber:int,severityText:string,body:{_VALUE},"
    f"attributes:{_ATTRIBUTES},traceId:string,spanId:string>"
)
_NUMBER_POINT = f"struct<attributes:{_ATTRIBUTES},timeUnixNano:string,asDouble:double,asInt:string>"
_HISTOGRAM_POINT = (
    f"struct<attributes:{_ATTRIBUTES},timeUnixNano:string,count:string,sum:double,"
    "bucketCounts:array<string>,explicitBounds:array<double>>"
)
_METRIC = (
    f"struct<name:string,gauge:struct<dataPoints:array<{_NUMBER_POINT}>>,"
    f"sum:struct<dataPoints:array<{_NUMBER_POINT}>,aggregationTemporality:string>,"
    f"histogram:struct<dataPoints:array<{_HISTOGRAM_POINT}>,aggregationTemporality:string>>"
)


def _request(top: str, scope: str, records: str, record: str) -> str:
    return f"{top} array<struct<resource:{_RESOURCE},{scope}:array<struct<{records}:array<{record}>>>>>"


TRACES = _request("resourceSpans", "scopeSpans", "spans", _SPAN)
LOGS = _request("resourceLogs", "scopeLogs", "logRecords", _LOG)
METRICS = _request("resourceMetrics", "scopeMetrics", "metrics", _METRIC)

# Span kinds and temporalities by number and by name.
_KINDS = {
    "0": "Unspecified", "SPAN_KIND_UNSPECIFIED": "Unspecified",
    "1": "Internal", "SPAN_KIND_INTERNAL": "Internal",
    "2": "Server", "SPAN_KIND_SERVER": "Server",
    "3": "Client", "SPAN_KIND_CLIENT": "Client",
    "4": "Producer", "SPAN_KIND_PRODUCER": "Producer",
    "5": "Consumer", "SPAN_KIND_CONSUMER": "Consumer",
}
_TEMPORALITIES = {
    "1": "delta", "AGGREGATION_TEMPORALITY_DELTA": "delta",
    "2": "cumulative", "AGGREGATION_TEMPORALITY_CUMULATIVE": "cumulative",
}


def _named(value: Column, names: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(part) for pair in names.items() for part in pair])
    return F.coalesce(F.try_element_at(table, value), value)


def _time(nanos: Column) -> Column:
    # Whole-number division: nanoseconds since the epoch exceed what a double holds.
    return F.timestamp_micros(F.call_function("div", nanos.try_cast("long"), F.lit(1000)))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def _attribute_map(attributes: Column, pick: Callable[[Column], Column]) -> Column:
    """Map of the attributes that have a value of one type; the last of equal keys wins."""
    picked = F.transform(attributes, lambda a: F.struct(a["key"].alias("key"), pick(a["value"]).alias("value")))
    pairs = F.filter(picked, lambda a: a["key"].isNotNull() & a["value"].isNotNull())
    # Repeated keys are rare; only then is every entry compared with the ones behind it.
    return _let(pairs, lambda p: F.map_from_entries(F.when(F.size(F.array_distinct(p["key"])) == F.size(p), p).otherwise(_last_of_key(p))))


def _last_of_key(pairs: Column) -> Column:
    return F.filter(pairs, lambda a, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs) + 1), lambda b: b["key"] == a["key"]))


def _get(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def _object(entries: Column) -> Column:
    """VARIANT object of (key, value) entries; the last of equal keys wins."""
    return F.to_variant_object(_attribute_map(entries, lambda v: v))


def _list_value(values: Column, depth: int) -> Column:
    return F.to_variant_object(F.transform(values.cast("array<variant>"), lambda v: _plain(v, depth)))


def _map_value(values: Column, depth: int) -> Column:
    entry = lambda e: F.struct(_get(e, "$.key", "string").alias("key"), _plain(_get(e, "$.value", "variant"), depth).alias("value"))
    return _object(F.filter(F.transform(values.cast("array<variant>"), entry), lambda e: e["key"].isNotNull()))


def _plain(value: Column, depth: int) -> Column:
    """A value that says its kind, as the bare value; lists and maps to the given depth."""
    out = [
        _get(value, "$.stringValue", "string").cast("variant"),
        _get(value, "$.intValue", "string").try_cast("long").cast("variant"),
        _get(value, "$.doubleValue", "double").cast("variant"),
        _get(value, "$.boolValue", "boolean").cast("variant"),
        _get(value, "$.bytesValue", "string").cast("variant"),
    ]
    if depth > 0:
        out.append(_list_value(_get(value, "$.arrayValue.values", "variant"), depth - 1))
        out.append(_map_value(_get(value, "$.kvlistValue.values", "variant"), depth - 1))
    return F.coalesce(*out, value)


def _nested(value: Column) -> Column:
    """The list or map of a value as VARIANT; NULL for other kinds."""
    return F.coalesce(
        _list_value(_get(value["arrayValue"], "$.values", "variant"), MAX_DEPTH),
        _map_value(_get(value["kvlistValue"], "$.values", "variant"), MAX_DEPTH),
    )


def _any(value: Column) -> Column:
    """A value of any kind as VARIANT."""
    return F.coalesce(
        value["stringValue"].cast("variant"),
        value["intValue"].try_cast("long").cast("variant"),
        value["doubleValue"].cast("variant"),
        value["boolValue"].cast("variant"),
        value["bytesValue"].cast("variant"),
        _nested(value),
    )


def _text(value: Column) -> Column:
    """Text, or bytes as they were written, or a list or map as JSON text."""
    return F.coalesce(value["stringValue"], value["bytesValue"], F.to_json(_nested(value)))


def _strings(attributes: Column) -> Column:
    return _attribute_map(attributes, _text)


def _numbers(attributes: Column) -> Column:
    return _attribute_map(attributes, lambda v: F.coalesce(v["doubleValue"], v["intValue"].try_cast("double")))


def _booleans(attributes: Column) -> Column:
    return _attribute_map(attributes, lambda v: v["boolValue"])


def _texts(attributes: Column) -> Column:
    """Any attribute as text, for metric labels."""
    scalar = lambda v: F.coalesce(v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"))
    return _attribute_map(attributes, lambda v: F.coalesce(v["stringValue"], scalar(v), _text(v)))


def _records(requests: DataFrame, top: str, scope: str, records: str, environment: str | None) -> DataFrame:
    """One row per record with the map of its resource, which is built once per resource; empty levels yield none."""
    resources = requests.select(F.explode(top).alias("r"))
    attributes = F.coalesce(F.col("r.resource.attributes"), F.array().cast(_ATTRIBUTES))
    scopes = resources.select(_upserted(attributes, environment).alias("resource"), F.col("r")[scope].alias("s"))
    return scopes.select("resource", F.explode("s").alias("s")).select("resource", F.explode(F.col("s")[records]).alias("x"))


def _list(column: str) -> Column:
    return F.coalesce(F.col(column), F.array().cast(_ATTRIBUTES))


def _upserted(attributes: Column, environment: str | None) -> Column:
    resource = _strings(attributes)
    return resource if environment is None else resource_upsert(resource, value=environment)


def _all_attributes(nested: bool) -> list[Column]:
    entries = F.transform(_list("x.attributes"), lambda a: F.struct(a["key"].alias("key"), _any(a["value"]).alias("value")))
    return [_object(entries).alias("attributes")] if nested else []


def flatten_traces(requests: DataFrame, environment: str | None = "production", nested: bool = False) -> DataFrame:
    x = _records(requests, "resourceSpans", "scopeSpans", "spans", environment)
    start, end = F.col("x.startTimeUnixNano").try_cast("long"), F.col("x.endTimeUnixNano").try_cast("long")
    spans = x.select(
        _time(F.col("x.startTimeUnixNano")).alias("timestamp"),
        F.col("x.traceId").alias("trace_id"),
        F.col("x.spanId").alias("span_id"),
        F.nullif(F.col("x.parentSpanId"), F.lit("")).alias("parent_span_id"),
        F.col("x.name").alias("name"),
        _named(F.col("x.kind"), _KINDS).alias("kind"),
        (end - start).alias("duration_nano"),
        F.coalesce(F.col("x.status.code").isin("2", "STATUS_CODE_ERROR"), F.lit(False)).alias("has_error"),
        _strings(_list("x.attributes")).alias("attributes_string"),
        _numbers(_list("x.attributes")).alias("attributes_number"),
        _booleans(_list("x.attributes")).alias("attributes_bool"),
        "resource",
        *_all_attributes(nested),
    )
    named = spans.withColumn("serviceName", F.col("resource")["service.name"])
    return with_bucket_start(named).select(*S.SPANS.names, *(["attributes"] if nested else []))


def flatten_logs(requests: DataFrame, environment: str | None = "production", nested: bool = False) -> DataFrame:
    """A body that is no text stands in ``body`` as text, with ``nested`` in ``body_value`` as VARIANT."""
    x = _records(requests, "resourceLogs", "scopeLogs", "logRecords", environment)
    body = F.col("x.body")
    scalar = F.coalesce(body["intValue"], body["doubleValue"].cast("string"), body["boolValue"].cast("string"))
    logs = x.select(
        _time(F.col("x.timeUnixNano")).alias("timestamp"),
        F.col("x.traceId").alias("trace_id"),
        F.col("x.spanId").alias("span_id"),
        F.col("x.severityText").alias("severity_text"),
        F.col("x.severityNumber").alias("severity_number"),
        F.coalesce(body["stringValue"], scalar, _text(body)).alias("body"),
        _strings(_list("x.attributes")).alias("attributes_string"),
        _numbers(_list("x.attributes")).alias("attributes_number"),
        _booleans(_list("x.attributes")).alias("attributes_bool"),
        "resource",
        *_all_attributes(nested),
        *([_any(body).alias("body_value")] if nested else []),
    )
    # A log without a trace context of its own may still carry the id as an attribute.
    own = F.coalesce(F.nullif(F.col("trace_id"), F.lit("")), F.col("attributes_string")["trace_id"])
    named = logs.withColumn("trace_id", own).withColumn("serviceName", F.col("resource")["service.name"])
    return named.select(*S.LOGS.names, *(["attributes", "body_value"] if nested else []))


def flatten_metrics(requests: DataFrame, environment: str | None = "production", nested: bool = False) -> DataFrame:
    """Labels of metric points are text, whatever ``nested`` says."""
    metrics = _records(requests, "resourceMetrics", "scopeMetrics", "metrics", environment).select(
        F.col("resource")["service.name"].alias("serviceName"), "x"
    )
    none = F.lit(None)

    # All three kinds of points become one list, so that the files are read once.
    def numbers(points: str, kind: str, temporality: Column) -> Column:
        return F.transform(
            F.col(points),
            lambda p: F.struct(
                p["timeUnixNano"].alias("at"),
                F.lit(kind).alias("metric_type"),
                p["attributes"].alias("attributes"),
                F.coalesce(p["asDouble"], p["asInt"].try_cast("double")).alias("value"),
                none.cast("array<double>").alias("bucket_bounds"),
                none.cast("array<bigint>").alias("bucket_counts"),
                none.cast("bigint").alias("count"),
                none.cast("double").alias("sum"),
                temporality.alias("temporality"),
            ),
        )

    histograms = F.transform(
        F.col("x.histogram.dataPoints"),
        lambda p: F.struct(
            p["timeUnixNano"].alias("at"),
            F.lit("histogram").alias("metric_type"),
            p["attributes"].alias("attributes"),
            none.cast("double").alias("value"),
            p["explicitBounds"].alias("bucket_bounds"),
            F.transform(p["bucketCounts"], lambda c: c.try_cast("bigint")).alias("bucket_counts"),
            p["count"].try_cast("bigint").alias("count"),
            p["sum"].alias("sum"),
            _named(F.col("x.histogram.aggregationTemporality"), _TEMPORALITIES).alias("temporality"),
        ),
    )
    gauges = numbers("x.gauge.dataPoints", "gauge", none.cast("string"))
    sums = numbers("x.sum.dataPoints", "sum", _named(F.col("x.sum.aggregationTemporality"), _TEMPORALITIES))
    lists = F.filter(F.array(gauges, sums, histograms), lambda points: points.isNotNull())
    points = metrics.select("serviceName", F.col("x.name").alias("metric_name"), F.explode(F.flatten(lists)).alias("p"))
    return points.select(
        _time(F.col("p.at")).alias("timestamp"),
        "metric_name",
        "p.metric_type",
        "serviceName",
        _texts(_list("p.attributes")).alias("attributes"),
        "p.value",
        "p.bucket_bounds",
        "p.bucket_counts",
        "p.count",
        "p.sum",
        "p.temporality",
    )


_SIGNALS = {
    "traces": (TRACES, flatten_traces),
    "logs": (LOGS, flatten_logs),
    "metrics": (METRICS, flatten_metrics),
}
_CORRUPT = "_corrupt_record"


def _requests(lines: DataFrame, signal: str, column: str) -> DataFrame:
    """The parsed request of each line next to the line itself; ``reason`` says why a line is none."""
    schema, _ = _SIGNALS[signal]
    top = schema.split(" ", 1)[0]
    parsed = lines.select(
        F.col(column).alias("line"), F.from_json(column, f"{schema}, {_CORRUPT} string", {"columnNameOfCorruptRecord": _CORRUPT}).alias("_j")
    )
    reason = F.when(F.col("_j").isNull() | F.col(f"_j.{_CORRUPT}").isNotNull(), F.lit("malformed")).when(
        F.col(f"_j.{top}").isNull(), F.lit(f"no {top}")
    )
    return parsed.where(F.trim("line") != "").select("line", reason.alias("reason"), "_j.*")


def parse_otlp(
    lines: DataFrame, signal: str, column: str = "value", environment: str | None = "production", nested: bool = False
) -> DataFrame:
    """Records from lines of export JSON held in a text column, batch or stream; lines that are no request are left out."""
    _, flatten = _SIGNALS[signal]
    return flatten(_requests(lines, signal, column).where("reason IS NULL"), environment, nested)


def otlp_rejects(lines: DataFrame, signal: str, column: str = "value") -> DataFrame:
    """``line, reason`` of the lines that are no request of this signal: malformed, or another one. Blank lines are none."""
    return _requests(lines, signal, column).where("reason IS NOT NULL").select("line", "reason")


def split_otlp(
    lines: DataFrame, signal: str, column: str = "value", environment: str | None = "production", nested: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Records with a time, and what could not be taken: ``line, reason``, records without a time as JSON of their fields."""
    records = parse_otlp(lines, signal, column, environment, nested)
    untimed = records.where(F.col("timestamp").isNull())
    as_line = F.to_json(F.struct(*[c for c in records.columns if c not in ("attributes", "body_value")]))
    rejects = otlp_rejects(lines, signal, column).unionByName(untimed.select(as_line.alias("line"), F.lit("no time").alias("reason")))
    return records.where(F.col("timestamp").isNotNull()), rejects


def ingest_otlp_json(
    spark: SparkSession, path: str, signal: str, environment: str | None = "production", nested: bool = False
) -> DataFrame:
    """Records of one signal (traces, logs or metrics) from export files."""
    return parse_otlp(spark.read.text(path), signal, environment=environment, nested=nested)


def read_otlp(
    spark: SparkSession, path: str, signal: str, environment: str | None = "production", nested: bool = False
) -> tuple[DataFrame, DataFrame]:
    """``split_otlp`` over export files."""
    return split_otlp(spark.read.text(path), signal, environment=environment, nested=nested)
