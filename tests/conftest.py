import os
import sys
from datetime import datetime, timedelta

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from spanops import schema as S  # noqa: E402
from spanops.session import configure  # noqa: E402

START = datetime(2024, 3, 1, 12, 0, 0)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("spanops-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


_SPAN_COLUMNS = (
    "timestamp timestamp_ntz, trace_id string, span_id string, parent_span_id string, name string, serviceName string, "
    "duration_nano bigint, has_error boolean, attributes_string map<string,string>, attributes_number map<string,double>"
)
_LOG_COLUMNS = (
    "timestamp timestamp_ntz, trace_id string, span_id string, severity_text string, body string, serviceName string, "
    "attributes_string map<string,string>"
)


@pytest.fixture(scope="session")
def make_spans(spark):
    """Span frame from short dicts; tier, time offset in seconds and duration in ms are given plainly."""

    def make(rows):
        out = []
        for i, row in enumerate(rows):
            strings = dict(row.get("strings", {}))
            if row.get("tier") is not None:
                strings[S.TIER_KEY] = row["tier"]
            out.append(
                (
                    row["at"] if "at" in row else START + timedelta(seconds=row.get("sec", 0)),
                    row.get("trace", f"t{i}"),
                    row.get("span", f"s{i}"),
                    row.get("parent"),
                    row.get("name", S.CHECK_FRAUD),
                    row.get("service", S.WORKER_SERVICE),
                    row["ns"] if "ns" in row else int(row.get("ms", 100) * 1_000_000),
                    row.get("error", False),
                    strings,
                    row.get("numbers", {}),
                )
            )
        return spark.createDataFrame(out, _SPAN_COLUMNS)

    return make


@pytest.fixture(scope="session")
def make_logs(spark):
    def make(rows):
        out = [
            (
                START + timedelta(seconds=row.get("sec", 0)), row["trace"], row.get("span"), row.get("severity", "ERROR"),
                row.get("body", "payment failed"), S.WORKER_SERVICE, {},
            )
            for row in rows
        ]
        return spark.createDataFrame(out, _LOG_COLUMNS)

    return make
