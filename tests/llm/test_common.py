import pyarrow as pa
import xxhash

from spanops.llm import common


def test_batches_are_bounded_by_bytes(spark):
    """Rows of half a megabyte come in batches of few rows, and none is lost."""
    common.prepare(spark)
    df = spark.range(200).selectExpr("id", "repeat('abcdefgh', 65536) as text").repartition(1)

    def sizes(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([batch.nbytes], pa.int64())], ["rows", "bytes"])

    got = common.map_arrow(df, sizes, "rows long, bytes long").collect()
    assert sum(r.rows for r in got) == 200
    assert max(r.bytes for r in got) <= 2 * common.BATCH_BYTES


def test_word_hashes_remember_nothing():
    """Words of all texts ever seen would fill a task's memory; hashes are those of xxhash."""
    h = common.WordHashes()
    got = h.of("Ab cd\x0bé AB")
    assert got.tolist() == [xxhash.xxh64_intdigest(w) for w in (b"ab", b"cd", "é".encode(), b"ab")]
    assert h.of(" \t").tolist() == [] and not vars(h) and not isinstance(h, dict)
