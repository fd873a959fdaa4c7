"""Byte-level BPE ids of a public tokenizer file, with a bounded memory of short segments, and atomic file writes."""

from __future__ import annotations

import os
import re
import uuid
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_PLAIN = re.compile(r" ?\S+")


class ByteBPE:
    """The tokenizers library's ids, without special tokens.

    The file's pattern never joins a space that precedes other characters to what stands before it, so a text is cut before
    such spaces and each segment keeps its ids; only segments not seen before go to the library.
    """

    LIMIT = 1_000_000
    LONGEST = 64
    LINES = 1000

    def __init__(self, file: str, plain_specials: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        if plain_specials:
            self.tokenizer.encode_special_tokens = True
        self.known: dict[str, bytes] = {}  # ids as 32-bit numbers, which are joined faster than lists
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids

    @staticmethod
    def segments(text: str) -> list[str]:
        parts = text.split(" ")
        if "" not in parts and not any(p[0].isspace() for p in parts):
            return [parts[0], *[" " + p for p in parts[1:]]]
        out = [parts[0]]
        for part in parts[1:]:
            if part and not part[0].isspace():
                out.append(" " + part)
            else:
                out[-1] += " " + part
        return out if out[0] else out[1:]

    def _learn(self, fresh: list[str]) -> None:
        """Ids of new segments. Those without inner white space go to the library as lines of one text: the pattern makes a line feed
        between two of them a piece of its own, so its id, which no other byte gives, tells where each ends."""
        lines = [s for s in fresh if _PLAIN.fullmatch(s)] if len(self.line) == 1 else []
        for a in range(0, len(lines), self.LINES):
            part = lines[a : a + self.LINES]
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            ends = (4 * np.append(np.flatnonzero(ids == self.line[0]), len(ids))).tolist()
            if len(ends) == len(part):
                raw = ids.tobytes()
                self.known.update(zip(part, (raw[x + 4 : y] for x, y in zip([-4, *ends], ends)), strict=True))
        rest = [s for s in fresh if s not in self.known]
        for a in range(0, len(rest), 10_000):
            part = rest[a : a + 10_000]
            for segment, coded in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.known[segment] = np.array(coded.ids, np.uint32).tobytes()

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.segments(t) if t else [] for t in texts]
        known, flat = self.known, list(chain.from_iterable(cut))
        found = list(map(known.get, flat))
        fresh = list({s for s, ids in zip(flat, found, strict=True) if ids is None})
        if len(known) + len(fresh) > self.LIMIT:
            known.clear()
        self._learn(fresh)
        found = [known[s] if ids is None else ids for s, ids in zip(flat, found, strict=True)]
        for segment in fresh:
            if len(segment) > self.LONGEST:
                known.pop(segment, None)
        ends = np.cumsum([0, *map(len, cut)]).tolist()
        return [np.frombuffer(b"".join(found[a:b]), np.uint32) for a, b in pairwise(ends)]


@lru_cache(maxsize=2)
def coder(file: str, plain_specials: bool = False) -> ByteBPE:
    return ByteBPE(file, plain_specials)


def write_whole(uri: str, data: bytes) -> None:
    """Put a file in place at once: a task that is run twice leaves one whole file."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(draft) as out:
        out.write(data)
    system.move(draft, path)


def read_range(uri: str, start: int, length: int) -> bytes:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_file(path) as source:
        return source.read_at(length, start)


def as_uri(folder: str) -> str:
    """A folder name as a URI; plain paths are local ones."""
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
