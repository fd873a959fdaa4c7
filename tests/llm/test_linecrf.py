import itertools
import re
from collections import Counter

import numpy as np
import pytest

from spanops.llm import linecrf
from tests.llm import frames

SF_DIR = "/root/testdata/sf0.1"


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    hit = set()
    for k in range(len(words) - 7):
        if grams[tuple(words[k : k + 8])] > 1:
            hit.update(range(k, k + 8))
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(hit), failed


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_counts_against_brute_force(spark):
    rows = frames.mixed(3, 60) + [(700, "a b c d e f g h i j " * 4), (701, "x\x1cy z q " * 12), (702, "# $ é\r\n" * 30), (703, "퟿ w" * 25)]
    got = linecrf.quality(frames.docs(spark, rows).repartition(3), labels(spark, []))
    want = [(i, *base(t)) for i, t in rows]
    order = lambda r: tuple((x is not None, x) for x in r)
    found = got.collect()
    assert sorted([tuple(r)[:7] for r in found], key=order) == sorted(want, key=order)
    assert all(r.kept == (not r.base_failed) for r in found)  # no labels: the base rule alone


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    for n in range(1, 8):
        crf = linecrf.LineCRF(rng.normal(size=(4, 2)), rng.normal(size=(2, 2)))
        x = rng.normal(size=(n, 4))
        s = x @ crf.emit
        best = max(
            itertools.product((0, 1), repeat=n),
            key=lambda y: sum(s[k, v] for k, v in enumerate(y)) + sum(crf.move[a, b] for a, b in zip(y, y[1:], strict=False)),
        )
        assert crf.viterbi(x).astype(int).tolist() == list(best)


def test_fit_learns_the_chain():
    """Lines that say nothing themselves take the label of their neighbours."""
    clear, vague = np.array([1.0, 1, 0]), np.array([1.0, 0, 0])
    dirty = np.array([1.0, 0, 1])
    good, bad = np.array([clear, vague, clear, vague]), np.array([dirty, vague, dirty, vague])
    crf = linecrf.LineCRF.fit([good, bad] * 20, [np.ones(4, int), np.zeros(4, int)] * 20)
    assert crf.viterbi(good).all() and not crf.viterbi(bad).any()


@pytest.mark.skipif(not __import__("os").path.isdir(SF_DIR), reason="test tables are not there")
def test_held_out_accuracy(spark):
    """Labelled documents that were not in the sample: bad ones go, good ones stay."""
    docs, known = spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/labels.parquet")
    held = known.where("doc_id % 4 = 1")
    out = linecrf.quality(docs, known.where("doc_id % 4 != 1")).join(held, "doc_id").where("n_words >= 20")
    got = {(r.quality, r.kept): r["count"] for r in out.groupBy("quality", "kept").count().collect()}
    good, bad = got.get((1, True), 0) / (got.get((1, True), 0) + got.get((1, False), 0)), got.get((0, False), 0)
    assert good > 0.97
    assert bad / (bad + got.get((0, True), 0)) > 0.9


def test_filter_keeps_rows_and_columns(spark):
    rows = frames.mixed()
    df = frames.docs(spark, rows).selectExpr("*", "1 as kept", "2 as n_words")
    known = labels(spark, [(0, 1, 0), (None, 0, 1), (3, 0, None), (6, None, 1), (0, 1, 0)])
    kept = linecrf.keep_good(df, known)
    assert kept.columns == df.columns
    assert 0 < kept.count() < len(rows)
    assert linecrf.keep_good(df.limit(0), known).count() == 0
    assert linecrf.quality(df.limit(0), known).count() == 0


def test_every_part_of_a_text_can_be_in_the_fit(spark):
    """Pieces come from the whole text, its end included, and hold each line's features as bits."""
    lines = [f"line number {k} has some words in it." if k % 3 else "| menu | #" for k in range(2000)]
    sample = frames.docs(spark, [(k, "\n".join(lines)) for k in range(30)]).selectExpr("doc_id as k_id", "1 as good", "text")
    rows = linecrf.common.map_arrow(sample, linecrf._pieces, "k_id long, good int, bits array<int>").collect()
    assert len(rows) == 30 * linecrf.SAMPLE_PIECES
    whole = (linecrf.line_features(lines) @ (1 << np.arange(17))).astype(int).tolist()
    starts = [k for k in range(0, 2000, linecrf.SAMPLE_LINES)]
    found = {tuple(whole[k : k + linecrf.SAMPLE_LINES]) for k in starts}
    assert {tuple(r.bits) for r in rows} <= found and any(tuple(r.bits) == tuple(whole[k : k + 40]) for r in rows for k in starts[-15:])


def test_composed_pages():
    good, bad = np.ones((20, 2)), np.zeros((9, 2))
    pages, labels_ = linecrf.composed([(good, 1), (bad, 0)])
    assert sum(map(len, pages)) == 29 and all(len(p) == len(t) for p, t in zip(pages, labels_, strict=True))
    assert all((p[:, 0] == t).all() for p, t in zip(pages, labels_, strict=True))
    assert labels_[0].tolist() == [1] * 8 + [0] * 8 + [1] * 8 + [0] and labels_[1].tolist() == [1] * 4


@pytest.mark.skipif(not __import__("os").path.isdir(SF_DIR), reason="test tables are not there")
def test_bad_lines_in_good_pages_are_marked(spark):
    """Lines are labelled, not pages: three lines of a bad document under, and between the lines of, a good one."""
    docs, known = spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/labels.parquet")
    crf = linecrf.train(docs, known.where("doc_id % 4 != 1"))
    held = docs.join(known.where("doc_id % 4 = 1"), "doc_id").where("length(text) < 5000").orderBy("doc_id").collect()
    lines = {q: [x for r in held if r.quality == q and (x := linecrf._lines(r.text))] for q in (0, 1)}
    marked = kept = total = 0
    for good, bad in zip(lines[1], lines[0], strict=False):
        bad, half = bad[:3], len(good) // 2
        for page, at in ((good + bad, len(good)), (good[:half] + bad + good[half:], half)):
            content = crf.viterbi(linecrf.line_features(page))
            marked += int((~content[at : at + len(bad)]).sum())
            kept += int(content[:at].sum() + content[at + len(bad) :].sum())
            total += len(bad)
    pages = min(len(lines[0]), len(lines[1]))
    assert pages > 50 and marked > 0.75 * total
    assert kept > 0.97 * 2 * sum(map(len, lines[1][:pages]))
