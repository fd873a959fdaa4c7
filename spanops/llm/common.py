"""Shared pieces of the text operators: sessions, row keys, Arrow access and word hashes.

A *row key* is ``(k_id, k_hash)``: the document's id (a null id counts as the smallest one) and a 64-bit hash of
its text. Rows that agree in both are the same document read twice and get the same result.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spanops.session import configure, scratch_path

# Bounds of a batch handed to Python, whichever comes first; very long texts or sets make short batches.
BATCH_ROWS = 2000
BATCH_BYTES = 8 << 20
NULL_ID = -(2**63)
# Word separators of all word based operators: space, tab, LF, VT, FF, CR. bytes.split() cuts at exactly these.
SPACES = " \t\n\x0b\x0c\r"


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of this package; runtime settings only."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def small_batches(spark: SparkSession) -> None:
    """An eighth of the usual batch, for operators that run after others in one session, when the executors' heaps are full already."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS // 8))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES // 8))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``k_id, k_hash, text`` only: other columns cannot clash with what an operator adds. A null text is empty."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)).alias("k_id"),
        F.xxhash64(text).alias("k_hash"),
        text.alias("text"),
    )


def shown_id(k_id: Column | str = "k_id") -> Column:
    """The document id of a row key, null again where it was null."""
    column = F.col(k_id) if isinstance(k_id, str) else k_id
    return F.when(column != F.lit(NULL_ID), column)


def map_arrow(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``work`` to every non-empty Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := work(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Texts of a batch; null is the empty text."""
    return [t or "" for t in batch.column(name).to_pylist()]


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a batch's texts one after the other, and the offset of each text (one more at the end)."""
    column = pc.fill_null(batch.column(name), "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), ends - ends[0]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


class WordHashes:
    """64-bit hashes of words (bytes). Nothing is remembered: a hash is made sooner than found among very many, and takes no memory."""

    def words(self, words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64)

    def of(self, text: str) -> np.ndarray:
        """Hashes of the words of ``text`` with A-Z in lower case."""
        return self.words(text.encode("utf-8", "surrogatepass").lower().split())


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection), so that sums of them are good hashes."""
    h = h.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(33)
    return h


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values).cast(kind))


class Scratch:
    """Tables that one job writes to the shared folder and deletes as soon as it is done with them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[tuple[DataFrame, str]] = []

    def write(self, df: DataFrame, kind: str) -> DataFrame:
        """Write and read back: the lineage ends on storage that outlives executors, and the planner knows the size."""
        path = scratch_path(self.spark, kind)
        df.write.parquet(path)
        found = self.spark.read.schema(df.schema).parquet(path)
        self.paths.append((found, path))
        return found

    def drop(self, *frames: DataFrame) -> None:
        """Delete the tables of these frames; frames made from others' columns have none and are passed over."""
        for frame in frames:
            for at, (known, path) in enumerate(self.paths):
                if known is frame:
                    name = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                    name.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(name, True)
                    del self.paths[at]
                    break

    def drop_kind(self, kind: str) -> None:
        """Delete all tables written under this name."""
        self.drop(*[frame for frame, path in self.paths if path.rpartition("/")[2].startswith(f"{kind}-")])

    def forget(self) -> None:
        """Let Spark delete the shuffle files of finished jobs now, not when the driver happens to collect garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.java.lang.System.gc()


# Bits of a bitmap that goes to all tasks (16 MB); it saves shuffling and decides nothing.
BITMAP_BITS = 1 << 27


def bitmap(rows: DataFrame, column: str) -> np.ndarray:
    """A bitmap by the low bits of a column of hashes, combined in the tasks; the driver gets a fixed size."""
    low = F.col(column).bitwiseAND(F.lit(BITMAP_BITS - 1))
    made = F.bitmap_construct_agg(low.bitwiseAND(F.lit(32767))).alias("bits")
    parts = rows.groupBy(F.shiftright(low, 15).alias("b")).agg(made).toArrow()
    out = np.zeros((BITMAP_BITS >> 15, 4096), np.uint8)
    for b, bits in zip(parts.column("b").to_pylist(), parts.column("bits").to_pylist(), strict=True):
        out[b] = np.frombuffer(bits, np.uint8)
    return out.ravel()


def in_bitmap(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether hashes may be among those of a bitmap; false for certain where they are not."""
    at = values.view(np.int64) & (BITMAP_BITS - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
