"""Token counts of flat, unindexed token files by a separator scan.

A file is a plain run of 16-bit little-endian ids, documents closed by an end-of-document id; nothing says where they start.
Files are cut into blocks of fixed size, read by position, so one large file is read by many tasks. Each block is searched
for the end id at once and gives the places of its separators. Documents that cross blocks are stitched by a prefix scan:
the last separator before a block (a running maximum) tells where its first document began, the separators before it (a
running sum) tell its number. The scan has two levels, groups of ``GROUP`` blocks and then the groups, so no task sees
all blocks.

Defined results: an empty file has no documents; two separators in a row close an empty document (0 tokens); ids after the last
separator are one more document that is not closed; files are separate streams. For tables: a null or empty text is an
empty document; a null id stays null; rows read twice are both counted; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from spanops.llm import bytebpe, common
from spanops.session import materialize, scratch_path

END_ID = 50256
BLOCK_IDS = 1 << 21
FILE_IDS = 1 << 23
GROUP = 1024


def scan(spark: SparkSession, folder: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS, group: int = GROUP) -> DataFrame:
    """``path, number, start, n_tokens, closed`` of every document of the ``*.bin`` files of ``folder``."""
    common.prepare(spark)
    # Only names and lengths are read here, not contents.
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select("path", (F.col("length") / 2).cast("long").alias("ids"))
    blocks = files.where("ids > 0").select("path", "ids", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("ids") - 1) / block_ids))).alias("block"))
    blocks = blocks.repartition(F.xxhash64("path", "block"))

    def search(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for path, ids, block in zip(*(batch.column(c).to_pylist() for c in ("path", "ids", "block")), strict=True):
            start = block * block_ids
            data = bytebpe.read_range(path, 2 * start, 2 * min(block_ids, ids - start))
            found.append(np.flatnonzero(np.frombuffer(data, "<u2") == end_id) + start)
        ends = np.concatenate([[0], np.cumsum([len(f) for f in found])])
        places = common.lists(np.concatenate(found).astype(np.int64), ends, pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("path"), batch.column("ids"), batch.column("block"), places], ["path", "ids", "block", "places"])

    found = materialize(common.map_arrow(blocks, search, "path string, ids long, block long, places array<long>"), "separators")
    counted = found.select(
        "*", F.floor(F.col("block") / group).alias("g"), F.size("places").cast("long").alias("n"), F.array_max("places").alias("last")
    )
    before = Window.partitionBy("path", "g").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    groups = counted.groupBy("path", "g").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    earlier = Window.partitionBy("path").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("path", "g", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("g_n"), F.max("last").over(earlier).alias("g_last"))
    placed = counted.withColumn("own_n", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("own_last", F.max("last").over(before))
    placed = placed.join(groups, ["path", "g"]).select(
        "path", "places", (F.col("g_n") + F.col("own_n")).alias("base"), F.coalesce("own_last", "g_last", F.lit(-1)).alias("carry"), "last", "ids", "block"
    )
    each = placed.select("path", "base", "carry", "places", F.posexplode("places").alias("k", "place"))
    start = F.when(F.col("k") == 0, F.col("carry")).otherwise(F.get("places", F.col("k") - 1)) + 1
    closed = each.select("path", (F.col("base") + F.col("k")).alias("number"), start.alias("start"), (F.col("place") - start).alias("n_tokens"), F.lit(True).alias("closed"))
    # What follows the last separator of a file.
    final = placed.where(F.col("block") == F.floor((F.col("ids") - 1) / block_ids))
    after = F.coalesce("last", "carry") + 1
    rest = final.where(after < F.col("ids")).select(
        "path", (F.col("base") + F.size("places")).alias("number"), after.alias("start"), (F.col("ids") - after).alias("n_tokens"), F.lit(False).alias("closed")
    )
    return closed.unionByName(rest)


def write(docs: DataFrame, folder: str, tokenizer_file: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the documents' ids as flat files, no index; the rows tell the order: ``file, number, doc_id``."""
    common.prepare(docs.sparkSession)
    file, place = tokenizer_file or bytebpe.default_file(), bytebpe.as_uri(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, number = bytebpe.coder(file, True), TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            name = f"{part:06d}-{number:06d}.bin"
            bytebpe.write_whole(f"{place}/{name}", np.concatenate(held).astype("<u2").tobytes())
            n = len(doc_ids)
            return pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(range(n), pa.int64()), pa.array(doc_ids, pa.int64())], ["file", "number", "doc_id"])

        for batch in batches:
            keys, texts = batch.column("doc_id").to_pylist(), common.texts(batch)
            for a in range(0, len(texts), 200):
                for key, ids in zip(keys[a : a + 200], coder.encode_all(texts[a : a + 200]), strict=True):
                    doc_ids.append(key)
                    held.append(np.append(ids, np.uint32(end_id)))
                    size += len(held[-1])
                if size >= FILE_IDS:
                    yield flush()
                    doc_ids, held, size, number = [], [], 0, number + 1
        if held:
            yield flush()

    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return materialize(source.mapInArrow(run, "file string, number long, doc_id long"), "order")


def token_counts(docs: DataFrame, folder: str | None = None, tokenizer_file: str | None = None) -> DataFrame:
    """Write flat files of all documents and scan them: ``doc_id, file, number, start, n_tokens``."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "flat")
    order = write(docs, folder, tokenizer_file)
    if not order.limit(1).count():
        return spark.createDataFrame([], "doc_id long, file string, number long, start long, n_tokens long")
    found = scan(spark, folder).withColumn("file", F.regexp_extract("path", r"([^/]+)$", 1))
    return order.join(found, ["file", "number"]).select("doc_id", "file", "number", "start", "n_tokens")
