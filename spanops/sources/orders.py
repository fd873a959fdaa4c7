"""Order requests from JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from spanops import schema as S
from spanops.functions.scalars import workflow_key

_CORRUPT = "_corrupt"
_WITH_CORRUPT = T.StructType(S.ORDERS_IN.fields + [T.StructField(_CORRUPT, T.StringType())])


def _parsed(lines: DataFrame, column: str) -> DataFrame:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    return lines.withColumn("_order", F.from_json(column, _WITH_CORRUPT, options))


def parse_orders(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(orders, rejects): decoded orders with their workflow id, and the lines that are not valid JSON."""
    parsed = _parsed(lines, column)
    bad = F.col("_order").isNull() | F.col(f"_order.{_CORRUPT}").isNotNull()
    orders = parsed.where(~bad).select("_order.*").drop(_CORRUPT)
    orders = orders.withColumn("workflow_id", workflow_key(F.col("order_id")))
    return orders, parsed.where(bad).select(F.col(column).alias("line"))
