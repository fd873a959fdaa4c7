import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from spanops.llm import bytebpe, rangecoder, separators
from tests.llm import frames

ODD = ["", " ", "  ", "a  b", "a \n b", "\n\nx", "tab\t tab", " lead", "trail ", "it's we'll 123abc", "é　ü  x", "日本 語", "a\x1cb \x1cc", "x" * 300, "<|endoftext|> y", "🙂 🙂\r\n z", "end   z"]


def sizes(rng, n):
    return rng.zipf(1.3, n).clip(0, 50256).astype(np.uint32)


@pytest.mark.parametrize("n", [1, 2, 63, 64, 130, 5000, 140_001])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = sizes(rng, n)
    data = rangecoder.encode_block(ids)
    back, end = rangecoder.decode_block(data, 0)
    assert end == len(data) and (back == ids).all()


@pytest.mark.parametrize("ids", [np.zeros(9999), np.arange(20_000), np.full(777, 50256), np.tile([5, 50256, 7], 4000), np.array([2**18])])
def test_extreme_blocks(ids):
    ids = ids.astype(np.uint32)
    assert (rangecoder.decode_block(rangecoder.encode_block(ids), 0)[0] == ids).all()


def test_contexts_shorten_the_code():
    rng = np.random.default_rng(0)
    phrase = rng.integers(0, 50_000, 50)
    again = np.tile(phrase, 4000).astype(np.uint32)
    noise = rng.integers(0, 50_000, 200_000).astype(np.uint32)
    assert len(rangecoder.encode_block(again)) < 0.1 * len(rangecoder.encode_block(noise))
    assert len(rangecoder.encode_block(noise)) < 2.3 * len(noise)


def test_damage_is_found():
    data = bytearray(rangecoder.encode_block(np.arange(3000, dtype=np.uint32)))
    data[-900] ^= 255
    with pytest.raises((ValueError, IndexError)):
        rangecoder.decode_block(bytes(data), 0)


def test_segments_give_the_library_s_ids():
    rows = frames.mixed()
    texts = ODD + [t or "" for _, t in rows]
    whole = Tokenizer.from_file(bytebpe.default_file())
    coder = bytebpe.ByteBPE(bytebpe.default_file())
    for _ in range(2):
        for text, ids in zip(texts, coder.encode_all(texts), strict=True):
            assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids


def test_new_words_go_to_the_library_together():
    """Thousands of new words are a few texts to the library; those with inner white space of any kind go by themselves."""

    class Spy:
        def __init__(self, inner):
            self.inner, self.texts = inner, 0

        def encode_batch(self, texts, **more):
            self.texts += len(texts)
            return self.inner.encode_batch(texts, **more)

        def encode_batch_fast(self, texts, **more):
            self.texts += len(texts)
            return self.inner.encode_batch_fast(texts, **more)

    coder, whole = bytebpe.ByteBPE(bytebpe.default_file()), Tokenizer.from_file(bytebpe.default_file())
    coder.tokenizer = spy = Spy(coder.tokenizer)
    odd = [f"q{c}r {c}s t{c} {c}{c} u" for c in "\x00\x1c\x1f\x85\xa0\u1680\u180e\u200b\u2028\u3000\ufeff\r\n"] + ["a <|endoftext|> b<|endoftext|>c", "\n", " \n x"]
    texts = [" ".join(f"word{k}x{j}" for k in range(500)) for j in range(8)]
    for text, ids in zip(texts, coder.encode_all(texts), strict=True):
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids
    assert spy.texts <= 8
    coder.LIMIT = 50  # what is known goes between calls
    for text, ids in zip(odd + texts, coder.encode_all(odd + texts), strict=True):
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids


def brute(rows):
    t = Tokenizer.from_file(bytebpe.default_file())
    coded = [(i, t.encode(x or "", add_special_tokens=False).ids + [0]) for i, x in rows]
    coded.sort(key=lambda r: -(2**63) if r[0] is None else r[0])
    out, start = [], 0
    for i, ids in coded:
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_give_all_documents_back(spark, monkeypatch):
    rows = [(k * 7 % 1000, t) for k, t in enumerate(ODD)] + [(2000 + i, t) for i, t in frames.mixed() if i not in (None, 503)] + [(None, "null id"), (9000, "twice"), (9000, "twice"), (9001, None)]
    df = frames.docs(spark, rows).selectExpr("*", "1 as start", "2 as part", "3 as k_id").repartition(5)
    got = sorted((tuple(r) for r in rangecoder.stored(df).collect()), key=lambda r: r[1])
    assert got == brute(rows)
    assert rangecoder.stored(df.limit(0)).count() == 0


def test_many_files_and_blocks_for_one_document():
    ids = np.random.default_rng(4).integers(0, 999, 700_000).astype(np.uint32)
    lengths = [5, 600_000, 1, 99_994]
    data = rangecoder.encode_file([1, 2, 3, 4], lengths, ids)
    ends = np.cumsum(lengths)
    want = [(k + 1, int(e - n), n, zlib.crc32(ids[e - n : e].tobytes())) for k, (e, n) in enumerate(zip(ends, lengths, strict=True))]
    assert list(rangecoder.decode_file(data)) == want


def plain_scan(ids, end):
    out, start = [], 0
    for k, x in enumerate(ids):
        if x == end:
            out.append((len(out), start, k - start, True))
            start = k + 1
    if start < len(ids):
        out.append((len(out), start, len(ids) - start, False))
    return out


@pytest.mark.parametrize("block,group", [(1, 2), (7, 3), (64, 1024), (10_000, 1)])
def test_scan_against_a_plain_loop(spark, tmp_path, block, group):
    rng = np.random.default_rng(block)
    streams = {
        "a.bin": rng.integers(0, 6, 500), "b.bin": np.zeros(90, int), "c.bin": np.full(40, 5), "d.bin": np.array([], int),
        "e.bin": np.concatenate([np.zeros(300, int), [5], np.ones(200, int)]), "f.bin": np.array([5]),
    }
    for name, ids in streams.items():
        (tmp_path / name).write_bytes(ids.astype("<u2").tobytes())
    got = separators.scan(spark, str(tmp_path), end_id=5, block_ids=block, group=group).collect()
    for name, ids in streams.items():
        assert sorted((r.number, r.start, r.n_tokens, r.closed) for r in got if r.path.endswith(name)) == plain_scan(ids.tolist(), 5)


def test_counts_of_documents(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(50, None), (None, "no id"), (0, ODD[0]), (51, "word " * 100_000)]
    df = frames.docs(spark, rows).selectExpr("*", "1 as number", "'x' as file").repartition(3)
    t = Tokenizer.from_file(bytebpe.default_file())
    t.encode_special_tokens = True
    want = [(i, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in rows]
    order = lambda r: (r[0] is not None, r[0], r[1])
    assert sorted([(r.doc_id, r.n_tokens) for r in separators.token_counts(df).collect()], key=order) == sorted(want, key=order)
    assert separators.token_counts(df.limit(0)).count() == 0
