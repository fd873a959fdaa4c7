"""Frames shared by the tests of the text operators."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """Documents from (id, text) pairs."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def mixed(seed=1, n=40):
    """Texts with copies, near copies, shared passages, repeats inside a text, odd characters and edge lengths."""
    rng = random.Random(seed)
    texts = [words(rng, rng.randrange(5, 160)) for _ in range(n)]
    shared = words(rng, 40)
    rows = []
    for k, t in enumerate(texts):
        kind = k % 8
        if kind == 1:
            t = t + " " + shared
        elif kind == 2:
            t = shared[:90] + t + "\n" + shared
        elif kind == 3:
            t = texts[k - 3]
        elif kind == 4:
            parts = texts[k - 4].split(" ")
            parts[len(parts) // 2] = "changed"
            t = " ".join(parts)
        elif kind == 5:
            t = t + "é" * 130 + t
        elif kind == 6:
            t = "a" * rng.randrange(90, 330)
        rows.append((k * 3 % 101, t))
    return rows + [(500, None), (501, ""), (502, " \t\n"), (None, shared), (None, None), (503, rows[0][1]), (503, rows[0][1]), (504, "x" * 99)]
