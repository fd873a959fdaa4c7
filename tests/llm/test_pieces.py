import math
import random

import pytest

from spanops.llm import pieces
from tests.llm import frames


@pytest.fixture(scope="module")
def coder():
    return pieces.codec(pieces.default_model())


def best_score(p, text):
    """Score of the best segmentation by the plain search over the whole text."""
    best = [0.0] + [-math.inf] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - p.longest), end):
            if text[start:end] in p.scores:
                best[end] = max(best[end], best[start] + p.scores[text[start:end]][0])
        if text[end - 1] not in p.scores:
            best[end] = max(best[end], best[end - 1] + pieces.BYTE_SCORE * len(text[end - 1].encode()))
    return best[-1]


def score(p, ids):
    is_byte = set(p.byte_ids)
    by_id = {k: s for s, k in p.scores.values()}
    return sum(pieces.BYTE_SCORE if k in is_byte else by_id[k] for k in ids)


TEXTS = ["hello world", " lead", "two  spaces   three ", "a\nb\n\n c\t", "▁ literal▁mark ▁", "日本語と🙂 emoji", "x" * 500, "=" * 70 + " end", "\x00\x01", "éèà ñ", "a" * 7 + " " * 40 + "b"]


@pytest.mark.parametrize("text", TEXTS)
def test_round_trip(coder, text):
    assert coder.decode(coder.encode(text)) == text


def test_stream_is_the_best_segmentation(coder):
    rng = random.Random(1)
    p = coder.pieces
    letters = "abcdeinorst" + pieces.SPACE + "=é語"
    for _ in range(60):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 260)))
        runs = list(p.stream(text))
        ids = [k for r in runs for k in r]
        assert score(p, ids) == pytest.approx(best_score(p, text))
        assert b"".join(p.bytes_of[k] for k in ids).decode() == text.replace(pieces.SPACE, " ")


def test_runs_are_committed_early(coder):
    """A long text leaves in many runs: the window is bounded by the longest piece, not by the text."""
    rng = random.Random(2)
    text = "".join(rng.choice("aeinst") for _ in range(20_000))
    runs = list(coder.pieces.stream(text))
    assert len(runs) > 200 and max(map(len, runs)) < 100
    assert sum(map(len, coder.pieces.stream("a" * 50_000))) > 0  # paths that never meet stay linear in time


def test_cut_segments_give_the_best_whole(coder):
    p = coder.pieces
    text = "The anea of erntre\nthe  list a=b c"
    whole = pieces.SPACE + text.replace(" ", pieces.SPACE)
    assert score(p, coder.encode(text)) == pytest.approx(best_score(p, whole))


def test_columns(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(90, None), (91, ""), (None, "x"), (0, TEXTS[0]), (92, "word " * 200_000)] + frames.mixed()
    df = frames.docs(spark, rows).selectExpr("*", "1 as ids", "2 as n_tokens")
    out = pieces.encode(df.coalesce(1))
    got = out.collect()
    assert [r.doc_id for r in got] == [i for i, _ in rows]
    assert all(r.decoded_equal and len(r.ids) == r.n_tokens for r in got)
    assert [r.text for r in pieces.decode(out).collect()] == [t or "" for _, t in rows]
    assert pieces.encode(df.limit(0)).count() == 0


def test_short_segments_take_the_paths_of_the_stream(coder):
    """Ties and bytes included; a text of new, known and long segments stays the same when encoded again."""
    rng, p = random.Random(5), coder.pieces
    for _ in range(500):
        text = "".join(rng.choice("abcdeinorst" + pieces.SPACE + "=é語\n") for _ in range(rng.randrange(1, 40)))
        assert p.short(text) == [k for run in p.stream(text) for k in run]
    fresh = pieces.Codec(p)
    text = "new words new words " + "y" * 60 + " words"
    assert fresh.encode(text) == fresh.encode(text) == coder.encode(text)
