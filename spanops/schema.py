"""Declared schemas of the tables and the fixed values of the order workload."""

from __future__ import annotations

from pyspark.sql import types as T

_STRING_MAP = T.MapType(T.StringType(), T.StringType())
_NUMBER_MAP = T.MapType(T.StringType(), T.DoubleType())
_BOOL_MAP = T.MapType(T.StringType(), T.BooleanType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


SPANS = _struct(
    timestamp=T.TimestampType(),
    ts_bucket_start=T.LongType(),
    trace_id=T.StringType(),
    span_id=T.StringType(),
    parent_span_id=T.StringType(),
    name=T.StringType(),
    kind=T.StringType(),
    serviceName=T.StringType(),
    duration_nano=T.LongType(),
    has_error=T.BooleanType(),
    attributes_string=_STRING_MAP,
    attributes_number=_NUMBER_MAP,
    attributes_bool=_BOOL_MAP,
    resource=_STRING_MAP,
)

LOGS = _struct(
    timestamp=T.TimestampType(),
    trace_id=T.StringType(),
    span_id=T.StringType(),
    severity_text=T.StringType(),
    severity_number=T.IntegerType(),
    body=T.StringType(),
    serviceName=T.StringType(),
    attributes_string=_STRING_MAP,
    attributes_number=_NUMBER_MAP,
    attributes_bool=_BOOL_MAP,
    resource=_STRING_MAP,
)

METRIC_POINTS = _struct(
    timestamp=T.TimestampType(),
    metric_name=T.StringType(),
    metric_type=T.StringType(),
    serviceName=T.StringType(),
    attributes=_STRING_MAP,
    value=T.DoubleType(),
    bucket_bounds=T.ArrayType(T.DoubleType()),
    bucket_counts=T.ArrayType(T.LongType()),
    count=T.LongType(),
    sum=T.DoubleType(),
    temporality=T.StringType(),
)

ORDERS_IN = _struct(
    order_id=T.StringType(),
    customer_id=T.StringType(),
    customer_tier=T.StringType(),
    amount=T.DoubleType(),
    items=T.IntegerType(),
    payment_method=T.StringType(),
)

# Width of one ts_bucket_start bucket, in seconds.
BUCKET_SECONDS = 1800

# The service and span names of the order workload, in pipeline order.
WORKER_SERVICE = "temporal-worker"
ACTIVITY_PREFIX = "activity."
VALIDATE_ORDER = "activity.validate_order"
CHECK_FRAUD = "activity.check_fraud"
PROCESS_PAYMENT = "activity.process_payment"
RESERVE_INVENTORY = "activity.reserve_inventory"
SCHEDULE_SHIPPING = "activity.schedule_shipping"
REFUND_PAYMENT = "activity.refund_payment"
PIPELINE = (VALIDATE_ORDER, CHECK_FRAUD, PROCESS_PAYMENT, RESERVE_INVENTORY, SCHEDULE_SHIPPING)

# Attribute keys.
TIER_KEY = "customer.tier"
FAILURE_KEYS = ("validation.failure_reason", "payment.failure_reason", "inventory.failure")

# Service level target per tier; any other tier has the default.
SLO_TARGETS = {"enterprise": 0.999, "pro": 0.995}
DEFAULT_SLO_TARGET = 0.990

# Fixed values per tier: first retry wait in ms, backoff factor, attempts, shipping time in hours.
TIER_POLICY = {
    "enterprise": (500, 1.5, 5, 24),
    "pro": (1000, 2.0, 3, 48),
}
DEFAULT_TIER_POLICY = (2000, 2.0, 2, 120)

# Attributes stored as columns of their own, so that filters on them reach the scan.
PROMOTED = {TIER_KEY: "customer_tier"}
