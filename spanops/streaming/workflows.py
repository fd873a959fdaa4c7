"""Workflow outcomes closed as soon as the last step ends, with state and timers of our own."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spanops import schema as S
from spanops.functions.scalars import attr, charged_amount, field
from spanops.operators.workflow import _failed, _is, _order, outcome_columns
from spanops.streaming.aggregates import WATERMARK, watermarked

# State store that timers and values of a stateful processor need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Workflows are dealt to this many groups, each with one state and one timer; a running stream must keep the number.
BUCKETS = 4096

# Placed spans count time in microseconds, a hash and the failed flag as one number (see ``_order``); this one stands for none.
NONE = np.iinfo(np.int64).min
# Added to the place of a span whose amount is NaN, which pandas does not tell from NULL.
_NAN = 16

_STEPS = [f"step{place}" for place in range(len(S.PIPELINE))]
# Start of every number of a workflow; its texts start as None, its flags as False.
_LONGS = dict.fromkeys([*_STEPS, "fraud_at", "paid_at", "last_ms", "shipped_ms"], NONE) | {"due_ms": 0, "revision": 0, "spans": 0}
_AMOUNTS = {"fraud_score": ("fraud_at", S.CHECK_FRAUD), "total_charged": ("paid_at", S.PROCESS_PAYMENT)}
_TEXTS = ("tier", "shipping_eta")
_FACTS = pa.schema(
    [("trace_id", pa.string())]
    + [(c, pa.int64()) for c in _LONGS]
    + [(c, pa.float64()) for c in _AMOUNTS]
    + [(c, pa.string()) for c in _TEXTS]
    + [(c, pa.bool_()) for c in ("shown", *[f"{c}_nan" for c in _AMOUNTS])]
)
_FLAGS = [f"flag{place}" for place in range(len(S.PIPELINE))]
_OUT = (
    "trace_id string, closed_ms long, revision long, spans long, "
    + ", ".join(f"{c} long" for c in _FLAGS)
    + ", tier string, shipping_eta string, "
    + ", ".join(f"{c} double, {c}_nan boolean" for c in _AMOUNTS)
)

Facts = dict[str, np.ndarray]


def _empty(rows: int) -> Facts:
    """Facts of workflows without spans, ``trace_id`` left out."""
    out = {c: np.full(rows, start, dtype=np.int64) for c, start in _LONGS.items()}
    out |= {c: np.full(rows, np.nan) for c in _AMOUNTS} | {c: np.full(rows, None, dtype=object) for c in _TEXTS}
    return out | {field.name: np.zeros(rows, dtype=bool) for field in _FACTS if field.type == pa.bool_()}


def _pack(facts: Facts) -> bytes:
    table = pa.table([pa.array(facts[field.name], field.type, from_pandas=False) for field in _FACTS], schema=_FACTS)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _FACTS, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(packed: bytes) -> Facts:
    table = pa.ipc.open_stream(packed).read_all()
    return {name: table.column(name).to_numpy().copy() for name in _FACTS.names}


def _greatest_text(known: np.ndarray, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The greatest text of every workflow; None counts as none."""
    codes, names = pd.factorize(np.concatenate([known, values]), sort=True)
    best = codes[: len(known)].copy()
    np.maximum.at(best, at, codes[len(known) :])
    return np.append(np.asarray(names, dtype=object), [None])[best]


def _fold(known: Facts, rows: pd.DataFrame) -> tuple[Facts, np.ndarray]:
    """Adds spans to the facts of their workflows; also says which workflows had any."""
    before = len(known["trace_id"])
    codes, names = pd.factorize(np.concatenate([known["trace_id"], rows["trace_id"].to_numpy(dtype=object)]))
    at, fresh = codes[before:], _empty(len(names) - before)
    facts = {c: np.concatenate([known[c], fresh[c]]) for c in fresh} | {"trace_id": np.asarray(names, dtype=object)}
    placed, kind = rows["placed"].to_numpy(), rows["place"].to_numpy()
    place, amount = kind % _NAN, rows["amount"].to_numpy()
    timed, fine = placed != NONE, placed % 2 == 0
    ms = np.where(timed, (placed >> 10) // 1000, NONE)

    facts["spans"] += np.bincount(at, minlength=len(names))
    np.maximum.at(facts["last_ms"], at, ms)
    for number, step in enumerate(_STEPS):
        own = place == number
        np.maximum.at(facts[step], at[own], placed[own])
    shipped = timed & fine & (place == S.PIPELINE.index(S.SCHEDULE_SHIPPING))
    np.maximum.at(facts["shipped_ms"], at[shipped], ms[shipped])
    for value, (when, name) in _AMOUNTS.items():
        own = np.flatnonzero(timed & fine & (place == S.PIPELINE.index(name)))
        newest = facts[when].copy()
        np.maximum.at(newest, at[own], placed[own])
        # The first of equal ones stays: in reverse order it is written last.
        won = own[(placed[own] == newest[at[own]]) & (newest[at[own]] > facts[when][at[own]])][::-1]
        facts[value][at[won]], facts[f"{value}_nan"][at[won]] = amount[won], kind[won] >= _NAN
        facts[when] = newest
    for text in _TEXTS:
        facts[text] = _greatest_text(facts[text], at, rows[text].to_numpy(dtype=object))
    touched = np.zeros(len(names), dtype=bool)
    touched[at] = True
    return facts, touched


class WorkflowCloser(StatefulProcessor):
    """Folds the spans of each workflow into one row of facts, and emits it when its time has come.

    Open: that is ``grace_ms`` after the end of shipping, or ``gap_ms`` after the last span. Shown: the facts stay until the
    workflow has been quiet for ``gap_ms``; spans that still come are added, and a further revision follows.

    A call takes a whole group of workflows, as a call, a state and a timer for each of millions would cost far more than the spans.
    The group's timer stands at the earliest time due. A workflow all of whose spans lack a time waits for one that has it.
    """

    def __init__(self, grace_ms: int, gap_ms: int):
        self.grace_ms, self.gap_ms = grace_ms, gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("workflows", "facts binary, timer_ms long")

    def _load(self) -> tuple[Facts, int | None]:
        known = self.open.get()
        if known is None:
            return _empty(0) | {"trace_id": np.empty(0, dtype=object)}, None
        return _unpack(known[0]), known[1]

    def _store(self, facts: Facts, before: int | None, fired: int | None = None) -> None:
        """Keeps the facts and moves the timer; the one that has just fired is deleted by Spark after the call."""
        due = facts["due_ms"][facts["last_ms"] != NONE]
        timer = int(due.min()) if len(due) else None
        if timer is not None and timer == fired:
            timer -= 1
        if before is not None and before not in (timer, fired):
            self.handle.deleteTimer(before)
        if timer is not None and timer != before:
            self.handle.registerTimer(timer)
        if len(facts["spans"]):
            self.open.update((_pack(facts), timer))
        else:
            self.open.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        facts, before = self._load()
        touched = np.zeros(len(facts["spans"]), dtype=bool)
        for part in rows:
            facts, also = _fold(facts, part)
            also[: len(touched)] |= touched
            touched = also
        last, done = facts["last_ms"], (facts[_STEPS[-1]] != NONE) & (facts[_STEPS[-1]] % 2 == 0)
        quiet = last + self.gap_ms
        early = np.maximum(facts["shipped_ms"], np.where(facts["shown"], last, 0)) + self.grace_ms
        due = np.where(done, np.minimum(early, quiet), quiet)
        facts["due_ms"] = np.where(touched, due, facts["due_ms"])
        facts["shown"] &= ~touched
        self._store(facts, before)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        facts, before = self._load()
        now = (facts["due_ms"] <= timerValues.getCurrentWatermarkInMs()) & (facts["last_ms"] != NONE)
        emitted = now & ~facts["shown"]
        facts["revision"] += emitted
        if emitted.any():
            out = {c: facts[c][emitted] for c in ("trace_id", "revision", "spans", *_TEXTS)} | {"closed_ms": facts["due_ms"][emitted]}
            for flag, step in zip(_FLAGS, _STEPS):
                out[flag] = np.where(facts[step][emitted] == NONE, -1, np.fmod(facts[step][emitted], 2) == 1)
            for value in _AMOUNTS:
                out |= {c: facts[c][emitted] for c in (value, f"{value}_nan")}
            yield pd.DataFrame(out)
        end = facts["last_ms"] + self.gap_ms
        gone = now & (facts["shown"] | (facts["due_ms"] >= end))
        facts["due_ms"] = np.where(now, end, facts["due_ms"])
        facts["shown"] |= now
        self._store({c: values[~gone] for c, values in facts.items()}, before, expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def _milliseconds(spark: SparkSession, duration: str) -> int:
    return spark.sql(f"SELECT INTERVAL {duration}").first()[0] // timedelta(milliseconds=1)


def st_workflow_close(
    spans: DataFrame, *, grace: str = "30 seconds", gap: str = "10 minutes", dim: str = S.TIER_KEY, delay: str = WATERMARK,
    error: Column | None = None, buckets: int = BUCKETS,
) -> DataFrame:
    """Outcome of each workflow ``grace`` after shipping ended, else once it has been quiet for ``gap``; append mode.

    Retries that come within ``grace`` count. Later ones, up to ``gap`` after the last span, give the workflow's row once more with
    the next ``revision``; the last revision equals the batch report. A workflow that goes on after that starts again. State is the
    open workflows, those of a bucket together. It must be started with the state store ``STATE_STORE`` (``state_store``).
    """
    rows = watermarked(spans, delay).where("trace_id != ''")
    place = F.lit(None).cast("int")
    for number, name in enumerate(S.PIPELINE):
        place = F.when(_is(name), F.lit(number)).otherwise(place)
    failed, order = _failed(error), _order()
    scored, paid = _is(S.CHECK_FRAUD) & ~failed, _is(S.PROCESS_PAYMENT) & ~failed
    charged = F.coalesce(attr("payment.charged", "number"), charged_amount(attr("order.amount", "number")))
    amount = F.when(scored, attr("fraud.score", "number")).when(paid, charged)
    narrow = rows.select(
        F.pmod(F.xxhash64("trace_id"), F.lit(buckets)).alias("bucket"),
        "trace_id",
        "timestamp",
        (F.coalesce(place, F.lit(len(S.PIPELINE))) + F.when(F.isnan(amount), F.lit(_NAN)).otherwise(F.lit(0))).alias("place"),
        F.coalesce(order * 2 + failed.cast("long"), F.lit(int(NONE))).alias("placed"),
        field(spans, dim).alias("tier"),
        amount.alias("amount"),
        F.when(_is(S.SCHEDULE_SHIPPING), attr("shipping.eta")).alias("shipping_eta"),
    )
    spark = spans.sparkSession
    closer = WorkflowCloser(_milliseconds(spark, grace), _milliseconds(spark, gap))
    closed = narrow.groupBy("bucket").transformWithStateInPandas(closer, _OUT, "Append", "EventTime")
    flags = [F.when(F.col(flag) >= 0, F.col(flag) == 1).alias(f"_failed{number}") for number, flag in enumerate(_FLAGS)]
    amounts = [F.when(F.col(f"{c}_nan"), F.lit(float("nan"))).otherwise(F.col(c)).alias(c) for c in _AMOUNTS]
    facts = closed.select("trace_id", "closed_ms", F.col("revision").cast("int").alias("revision"), "spans", "tier", "shipping_eta", *flags, *amounts)
    return facts.select(F.timestamp_millis("closed_ms").alias("closed_at"), "revision", *outcome_columns())


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep state where values with timers can live; the session's own setting comes back after."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STATE_STORE)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
