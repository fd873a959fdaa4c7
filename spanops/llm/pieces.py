"""SentencePiece encoding and decoding by streaming Viterbi over the pieces of a model file.

The best segmentation maximises the sum of piece scores. Only the last ``longest piece`` boundaries can start another piece,
so only their scores are kept; as soon as the paths of all of them lead back to one boundary, everything before it is
committed and forgotten. What is remembered reaches back to the last such boundary; in prose that is a few characters, only in
runs of one repeated character, whose paths never meet, it grows with the run (one backpointer for each character). The model files at hand are byte-pair models whose scores are merge ranks,
not probabilities; ``rank_scores`` turns a rank r into ln(1 / (r + 2)) (Zipf's law), so that the segmentation is the most
likely one under independent pieces. Characters without a piece fall back to their UTF-8 bytes. A literal U+2581, which
the model uses for the space, is written as bytes too, so decoding gives back every text exactly.

Defined results: a null or empty text has no ids and decodes to the empty text; a null id stays null; equal rows get equal
results; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spanops.llm import common

SPACE = "▁"
# A byte costs more than any piece, so bytes are used only where no piece covers a character.
BYTE_SCORE = -40.0
CACHE_WORDS = 600_000
CACHE_LENGTH = 48


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The pieces of a SentencePiece model with the scores the search maximises."""

    def __init__(self, model_file: str, rank_scores: bool = True):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.text = [model.id_to_piece(k) for k in range(model.vocab_size())]
        self.byte_ids = [0] * 256
        self.scores: dict[str, tuple[float, int]] = {}
        self.bytes_of: list[bytes] = []
        for k, piece in enumerate(self.text):
            if model.is_byte(k):
                self.byte_ids[int(piece[3:5], 16)] = k
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
                continue
            self.bytes_of.append(b"" if model.is_control(k) or model.is_unknown(k) else piece.replace(SPACE, " ").encode())
            if not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
                score = model.get_score(k)
                # Pieces of spaces alone carry no rank in the file; they count as the most frequent ones.
                rank = 0.0 if score < -1e8 else -score
                self.scores[piece] = (-float(np.log(rank + 2.0)) if rank_scores else score, k)
        self.longest = max(map(len, self.scores), default=1)
        # Every beginning of a piece: (score, ids) where it is one itself, else False; a search ends where there is none.
        self.table: dict[str, tuple[float, tuple[int, ...]] | bool] = {p[:k]: False for p in self.scores for k in range(1, len(p))}
        self.table |= {p: (score, (k,)) for p, (score, k) in self.scores.items()}
        # The same as a tree by characters: {character: (further characters, score, ids or ())}.
        self.tree: dict[str, tuple] = {}
        for piece, (score, k) in sorted(self.scores.items()):  # a beginning comes before what it begins
            inner = self.tree
            for character in piece[:-1]:
                inner = inner.setdefault(character, ({}, 0.0, ()))[0]
            inner[piece[-1]] = ({}, score, (k,))
        # No piece goes past a space mark that follows another character, nor past a character in no piece.
        self.marks_lead = not any(SPACE in p.lstrip(SPACE) for p in self.scores)
        self.line_alone = not any("\n" in p for p in self.scores)

    def stream(self, text: str) -> Iterator[list[int]]:
        """Ids of ``text`` in runs, each given out when all surviving paths agree on its end."""
        find, scores, longest = self.table.get, self.scores, self.longest
        n = len(text)
        best = {0: 0.0}  # boundary not passed yet: score of the best path to it
        back: dict[int, tuple[int, tuple[int, ...]]] = {}  # boundary: the one before it, ids between
        done, check = 0, 2 * longest  # boundary committed, boundary at which paths are looked at next
        for start in range(n):
            score = best.pop(start)
            for end in range(start + 1, min(n, start + longest) + 1):
                piece = find(text[start:end])
                if piece is None:
                    break
                if piece:
                    value = score + piece[0]
                    old = best.get(end)
                    if old is None or value > old:
                        best[end] = value
                        back[end] = (start, piece[1])
            end = start + 1
            if text[start] not in scores:
                raw = text[start].encode("utf-8", "surrogatepass")
                value = score + BYTE_SCORE * len(raw)
                if value > best.get(end, -float("inf")):
                    best[end], back[end] = value, (start, tuple(self.byte_ids[c] for c in raw))
            if end >= check or end == n:
                meet = self._meeting(back, best)
                if meet > done:
                    run: list[tuple[int, ...]] = []
                    at = meet
                    while at > done:
                        at, ids = back[at]
                        run.append(ids)
                    yield [k for ids in reversed(run) for k in ids]
                    for old in range(done, meet + 1):
                        back.pop(old, None)
                    done = meet
                # Paths that do not meet are looked at ever more rarely, so that the search stays linear.
                check = end + max(2 * longest, end - done)

    def short(self, text: str) -> list[int]:
        """The ids that ``stream`` gives, with the whole text's boundaries kept: less work for each character of a short one."""
        tree, scores, n = self.tree, self.scores, len(text)
        best = [-float("inf")] * (n + 1)
        back: list[tuple[int, tuple[int, ...]]] = [(0, ())] * (n + 1)
        best[0] = 0.0
        for start in range(n):
            score, inner, end = best[start], tree, start
            for character in text[start:]:
                found = inner.get(character)
                if found is None:
                    break
                end += 1
                inner, value, ids = found
                if ids:
                    value += score
                    if value > best[end]:
                        best[end], back[end] = value, (start, ids)
            if text[start] not in scores:
                raw = text[start].encode("utf-8", "surrogatepass")
                value = score + BYTE_SCORE * len(raw)
                if value > best[start + 1]:
                    best[start + 1], back[start + 1] = value, (start, tuple(self.byte_ids[c] for c in raw))
        run: list[tuple[int, ...]] = []
        while n:
            n, ids = back[n]
            run.append(ids)
        return [k for ids in reversed(run) for k in ids]

    @staticmethod
    def _meeting(back: dict[int, tuple[int, tuple[int, ...]]], live: dict[int, float]) -> int:
        """The latest boundary on the best paths to all of ``live``."""
        paths = set(live)
        while len(paths) > 1:
            last = max(paths)
            paths.discard(last)
            paths.add(back[last][0])
        return paths.pop()


class Codec:
    """Encoder that remembers short segments between boundaries that no piece crosses."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.known: dict[str, list[int]] = {}
        mark = SPACE if pieces.marks_lead else None
        line = r"|\n" if pieces.line_alone else ""
        self.cut = re.compile(rf"{mark}*[^{mark}\n]+|{mark}+{line}") if mark and line else None

    def _segment(self, segment: str) -> list[int]:
        ids = self.known.get(segment)
        if ids is not None:
            return ids
        if len(segment) > CACHE_LENGTH:
            ids = [k for run in self.pieces.stream(segment) for k in run]
        else:
            ids = self.pieces.short(segment)
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            self.known[segment] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        literal = [self.pieces.byte_ids[b] for b in SPACE.encode()]
        for k, part in enumerate((" " + text).split(SPACE)):
            if k:
                out += literal
            part = part.replace(" ", SPACE)
            segments = self.cut.findall(part) if self.cut else [part] if part else []
            found = list(map(self.known.get, segments))
            out += chain.from_iterable(
                found if None not in found else [self._segment(s) if ids is None else ids for s, ids in zip(segments, found)]
            )
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``; the space put before every text is taken off."""
        of = self.pieces.bytes_of
        return b"".join([of[k] for k in ids])[1:].decode("utf-8", "surrogatepass")


@lru_cache(maxsize=2)
def codec(model_file: str) -> Codec:
    """One codec for each Python worker; its memory of segments is bounded."""
    return Codec(Pieces(model_file))


_SCHEMA = "doc_id long, n_tokens long, ids array<int>, ids_crc32 long, decoded_equal boolean"


def encode(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """Ids of every whole text, their checksum, and whether decoding them gives the text back."""
    common.prepare(docs.sparkSession)
    path = model_file or default_model()
    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = codec(path)
        arrays, equal = [], []
        for text in common.texts(batch):
            ids = coder.encode(text)
            equal.append(coder.decode(ids) == text)
            arrays.append(np.array(ids, np.int32))
        lengths = np.array([len(a) for a in arrays], np.int64)
        flat = np.concatenate(arrays)
        columns = [
            batch.column("doc_id"), pa.array(lengths), common.lists(flat, np.concatenate([[0], np.cumsum(lengths)]), pa.int32()),
            pa.array([zlib.crc32(a.astype("<u4").tobytes()) for a in arrays], pa.int64()), pa.array(equal, pa.bool_()),
        ]
        return pa.RecordBatch.from_arrays(columns, [part.strip().split()[0] for part in _SCHEMA.split(",")])

    return common.map_arrow(source, work, _SCHEMA)


def decode(encoded: DataFrame, model_file: str | None = None, ids_col: str = "ids") -> DataFrame:
    """``doc_id`` and the text of its ids; null ids decode to null."""
    common.prepare(encoded.sparkSession)
    path = model_file or default_model()
    source = encoded.select(encoded["doc_id"].cast("long").alias("doc_id"), encoded[ids_col].alias("ids"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = codec(path)
        out = [None if ids is None else coder.decode(ids) for ids in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return common.map_arrow(source, work, "doc_id long, text string")
