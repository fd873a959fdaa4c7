import random
import zlib
from itertools import product

import numpy as np
import pytest

from spanops.llm import common, registered, toxicity
from tests.llm.frames import DOCS, docs

WORDS = "the of and nasty vermin garden river stone music window people morning letter idea moment".split()


def text(rng, n=30, extra=()):
    words = [rng.choice([w for w in WORDS if w not in ("nasty", "vermin")]) for _ in range(n)]
    for w in extra:
        words.insert(rng.randrange(len(words)), w)
    return " ".join(words)


@pytest.fixture(scope="module")
def costs(spark):
    rng = random.Random(1)
    rows = [(k, text(rng, 40, rng.choice([(), ("nasty", "vermin")]))) for k in range(200)]
    return toxicity.letter_costs(toxicity.letter_counts(docs(spark, rows)))


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_letter_counts(spark):
    rows = [(1, "Ab c"), (2, "é!"), (3, None), (4, "Ab c")]
    got = toxicity.letter_counts(docs(spark, rows))
    want = np.zeros_like(got)
    code = lambda c: 0 if c == " " else ord(c) - 96 if "a" <= c <= "z" else toxicity.OTHER
    for t in ("ab c", "e!", "ab c"):
        signs = [0, 0, 0, *map(code, t), 0]
        for k in range(len(signs) - 3):
            want[tuple(signs[k : k + 4])] += 1
    got[0, 0, 0, 0] = got[..., 0, 0, 0] = got[..., 0, 0] = 0  # gaps between texts depend on how texts meet in a batch
    want[0, 0, 0, 0] = want[..., 0, 0, 0] = want[..., 0, 0] = 0
    assert (got == want).all()


def test_costs_are_probabilities(costs):
    assert np.allclose(np.exp(-costs[..., : toxicity.OTHER].astype(float)).sum(-1), 1)


def test_best_path_against_all_paths(costs):
    """Viterbi finds the cheapest of all readings of a lattice."""
    def cost(reading, extra):
        state, total = (0, 0, 0), extra
        for sign in reading + " ":
            d = toxicity._code(sign)
            total += float(costs[(*state, d)])
            state = (*state[1:], d)
        return total

    for written in ("n4sty", "v3rm1n", "n.a.s.t.y", "n a s t y", "vvverm1nnn", "a1 b2", "@@@@", "x*y*z", "$t0n3"):
        folded = toxicity.fold(written)
        paths = [("".join(r for r, _ in way), sum(c for _, c in way)) for way in product(*toxicity.lattice(folded))]
        best = min(cost(r, c) for r, c in paths)
        got = toxicity.restore(folded, costs)
        assert min(cost(r, c) for r, c in paths if r.strip() == got) == pytest.approx(best)


@pytest.mark.parametrize("written", ["n4sty", "n a s t y", "n.a.s.t.y", "naaaaasty", "NA$TY", "n-a-s-t-y", "n@5ty", "nästy", "ｎａｓｔｙ", "N.4.$.t.y!"])
def test_disguises_are_undone(costs, written):
    if written.isascii():  # accents stay in the text, features have plain letters
        assert toxicity.restored(f"the river {written} garden", costs).strip("!").split() == ["the", "river", "nasty", "garden"]
    assert set(toxicity.Words(costs).buckets("nasty")) <= set(toxicity.Words(costs).of(written).tolist())


def test_plain_text_stays(costs):
    rng = random.Random(4)
    plain = text(rng, 50) + ". 2024 (idea), letter!"
    assert toxicity.restored(plain, costs) == plain


def test_very_long_stretches(costs):
    assert len(toxicity.restore("a1" * 50_000, costs)) >= 50_000
    assert toxicity.restore("a" * 200_000, costs) in ("a", "aa")


def labelled(spark, n=400):
    rng = random.Random(9)
    rows = [(k, text(rng, 30, ("vermin", "nasty") if k % 3 == 0 else ())) for k in range(n)]
    labels = [(k, 1, int(k % 3 == 0)) for k in range(n)]
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_disguise(spark):
    rows, labels = labelled(spark)
    rng = random.Random(10)
    hidden = [(1000 + k, text(rng, 30, ("v3rm1n", "n a s t y"))) for k in range(40)]
    clean = [(2000 + k, text(rng, 30)) for k in range(40)]
    out = {r.doc_id: r for r in toxicity.scores(docs(spark, rows + hidden + clean), labels).collect()}
    kept_back = [k for k, _ in rows if held(k)]
    assert all(out[k].held_out == held(k) for k in out)
    assert all(out[k].predicted == int(k % 3 == 0) for k in kept_back)
    assert all(out[k].predicted == 1 for k, _ in hidden)
    assert all(out[k].predicted == 0 for k, _ in clean)


def test_held_out_labels_and_other_columns_play_no_part(spark):
    rows, labels = labelled(spark)
    frame = docs(spark, rows)
    flipped = labels.selectExpr("doc_id", "1 - quality as quality", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - toxic, toxic) as toxic")
    other = frame.selectExpr("doc_id", "text", "source as lang", "'z' as source", "-n_chars as n_chars", "1 as score", "2 as predicted")
    want = {r.doc_id: r.score for r in toxicity.scores(frame, labels).collect()}
    assert {r.doc_id: r.score for r in toxicity.scores(other, flipped).collect()} == want


def test_defined_cases(spark):
    rows, labels = labelled(spark, 200)
    extra = [(None, "vermin nasty"), (5000, None), (5001, ""), (5001, ""), (5002, "vermin " * 50_000), (5003, "?!" * 10)]
    got = toxicity.scores(docs(spark, rows + extra), labels).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.score, r.predicted))
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    assert len(got) == len(rows) + len(extra)
    assert by[5000] == by[5001][:1] == by[5001][1:] == by[5003]
    assert by[None][0][1] == by[5002][0][1] == 1
    one = labels.selectExpr("doc_id", "quality", "1 as toxic")
    assert {r.score for r in toxicity.scores(docs(spark, rows), one).collect()} == {1.0}
    assert {r.score for r in toxicity.scores(docs(spark, rows), labels.limit(0)).collect()} == {0.0}
    assert toxicity.scores(spark.createDataFrame([], DOCS), labels).collect() == []
    torn = labels.selectExpr("cast(null as long) as doc_id", "quality", "toxic").union(labels.selectExpr("doc_id", "quality", "cast(null as int)"))
    assert {r.score for r in toxicity.scores(docs(spark, rows), torn).collect()} == {0.0}


def test_given_table(spark):
    sf = "/root/testdata/sf0.01"
    common.prepare(spark)
    labels = {r.doc_id: r.toxic for r in common.table(spark, sf, "labels").collect()}
    out = registered.op11_noisy_channel(spark, sf).collect()
    assert len(out) == common.table(spark, sf, "documents").count()
    told = [(r.predicted, labels[r.doc_id]) for r in out if r.held_out and r.doc_id in labels]
    assert sum(p == t for p, t in told) >= 0.93 * len(told)
    assert sum(p for p, t in told if t == 0) <= 0.02 * len(told)
