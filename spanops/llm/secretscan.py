"""Secret scans: assignment-aware lexing of whole texts.

Three base patterns are searched as plain matches. On top of them the text is lexed into name-literal pairs as
configuration files and source code write them (``name = "x"``, ``name: x``, ``"name": "x"``, ``name := x``, ``name => x``,
``export NAME=x``, ``--name=x``, ``c["name"] = "x"``, ``name: type = "x"``). Constants are propagated: a right side that names an earlier constant, or joins literals and constants
with ``+``, stands for their value. A literal is scored by how sensitive its target name is and how random it looks; a
score of at least ``MIN_SCORE`` adds a span of kind ``lex``, unless a base span already covers the literal. Where the right side
names constants, the literals that were assigned to them get spans too: it is they that hold the secret.

Defined results: a null or empty text has no spans; a null id stays null; equal rows get equal results; an empty table gives
an empty result; other columns play no part. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from spanops.llm import common

MIN_SCORE = 1.0
REDACTED = "[secret]"

KINDS = ("assign", "access", "hex", "lex")
_NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")
_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
# A maximal run that is too short fails as a whole, so asking for the length at once finds the same matches.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

# A name runs to its end at once, so that long ones cost no more than their length.
_TYPE = r"[&*]?(?:'\w+[ \t]+)?(?:mut[ \t]+)?[A-Za-z_][\w.]*+(?:\[[^\n=]{0,80}\]|<[^\n=]{0,80}>)?[?!]?"
_PAIR = re.compile(
    r"(?<![\w.-])-*+[\"']?([A-Za-z_][\w.-]*+)[\"']?(?:[ \t]*\])?"
    rf"(?:[ \t]*:[ \t]*({_TYPE}(?:[ \t]*\|[ \t]*{_TYPE})*)(?=[ \t]*=(?![=>])))?"
    r"[ \t]*(?::=|=>|=(?!=)|:(?!//|:))[ \t]*"
    r"((?:\"[^\"\n]*\"|'[^'\n]*'|`[^`\n]*`|[A-Za-z_]\w*|[A-Za-z0-9+/_.=-]+)"
    r"(?:[ \t]*\+[ \t]*(?:\"[^\"\n]*\"|'[^'\n]*'|[A-Za-z_]\w*))*)"
)
_TERM = re.compile(r"\"([^\"\n]*)\"|'([^'\n]*)'|`([^`\n]*)`|([A-Za-z0-9/_.=-][A-Za-z0-9+/_.=-]*)")
_PLAIN = re.compile(r"[A-Za-z_]\w*")
# How strongly a target name says that its value is secret.
_SENSITIVE = (
    (re.compile(r"passw|passwd|pwd|secret|private[_.-]?key|credential", re.I), 1.0),
    (re.compile(r"api[_.-]?key|access[_.-]?key|auth[_.-]?key|signing[_.-]?key|token|bearer", re.I), 0.9),
    (re.compile(r"auth|salt|cert|session[_.-]?id|conn(ection)?[_.-]?str", re.I), 0.5),
)
_PLACEHOLDER = re.compile(r"^(?:<.*>|\$\{?.*\}?|x+|\*+|your.*|example.*|changeme|none|null|true|false|test)$", re.I)


def sensitivity(name: str) -> float:
    return next((weight for pattern, weight in _SENSITIVE if pattern.search(name)), 0.0)


class Value:
    """Text put together from literals and other values, without writing it out.

    Kept are the length, how often each character occurs, the first ``HEAD`` characters and the last one: all that scores look at.
    A value that is used twice is one object, so values of any length take no more memory than the text that states them. Lengths
    beyond 2^64 are scaled down together with the counts.
    """

    HEAD = 64
    __slots__ = ("length", "counts", "head", "last", "parts", "literal")

    def __init__(self, text: str = "", literal: tuple[int, int] | None = None):
        self.length, self.counts = len(text), Counter(text)
        self.head, self.last = text[: self.HEAD], text[-1:]
        self.parts: tuple[Value, ...] | str = text
        self.literal = literal

    @classmethod
    def joined(cls, parts: list[Value]) -> Value:
        if len(parts) == 1:
            return parts[0]
        out = cls()
        out.parts = tuple(parts)
        for part in parts:
            out.length += part.length
            for c, n in part.counts.items():
                out.counts[c] += n
            if len(out.head) < cls.HEAD:
                out.head = (out.head + part.head)[: cls.HEAD]
            out.last = part.last or out.last
        if out.length >> 64:
            out.length >>= 32
            out.counts = Counter({c: max(1, n >> 32) for c, n in out.counts.items()})
        return out

    def __str__(self) -> str:
        return self.parts if isinstance(self.parts, str) else "".join(map(str, self.parts))

    def sample(self) -> str:
        """A short text that is a placeholder if and only if the whole is."""
        if self.length <= len(self.head):
            return self.head
        return self.head + next((c for c in self.counts if c not in self.head), "") + self.last


def randomness(value: str | Value) -> float:
    """Bits of Shannon entropy per character, scaled so that random letters and digits come near 1."""
    value = Value(value) if isinstance(value, str) else value
    n = value.length
    if n < 6:
        return 0.0
    bits = -sum(c / n * math.log2(c / n) for c in value.counts.values())
    return min(1.0, bits / 3.5) * (min(n, 12) / 12)


def score(name: str, value: str | Value) -> float:
    """Sensitivity of the name plus randomness of the value; 0 where the name says nothing or the value is a placeholder."""
    weight = sensitivity(name)
    if not weight:
        return 0.0
    value = Value(value) if isinstance(value, str) else value
    if value.length < 6 or " " in value.counts or _PLACEHOLDER.match(value.sample()):
        return 0.0
    mixed = any(c.isdigit() for c in value.counts) and any(c.isalpha() for c in value.counts)
    return weight * (0.6 + 0.4 * mixed) + 0.5 * randomness(value)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three base patterns."""
    low = text.lower()
    out = []
    if any(name in low for name in _NAMES):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return out


def pairs(text: str) -> list[tuple[str, Value, int, int, list[Value]]]:
    """(name, value, start, end of the right side, constants in it) of every assignment, constants already put in."""
    known: dict[str, Value] = {}
    out = []

    def assign(name: str, start: int, end: int) -> None:
        parts, constants = [], []
        for term in _TERM.finditer(text, start, end):
            group = term.lastindex
            constant = known.get(term[4]) if group == 4 else None
            if constant is not None:
                constants.append(constant)
            parts.append(constant or Value(term[group], term.span(group)))
        value = Value.joined(parts)
        known[name] = value
        out.append((name, value, start, end, constants))

    for m in _PAIR.finditer(text):
        if m[2]:
            # ``a: b = c`` may declare a of type b, or be a key over an assignment to b: all its readings count.
            plain = _PLAIN.match(text, m.start(2), m.end(2))
            if plain:
                assign(m[1], *plain.span())
            assign(m[2], m.start(3), m.end(3))
        assign(m[1], m.start(3), m.end(3))
    return out


def _cover(base: list[tuple[int, int, int]]) -> Callable[[int, int], bool]:
    """Whether a span lies inside one of the base spans, by bisection."""
    base = sorted(base)
    starts, furthest, end = [s for s, _, _ in base], [], 0
    for _, _, e in base:
        furthest.append(end := max(end, e))

    def covered(start: int, end: int) -> bool:
        at = bisect_right(starts, start)
        return at > 0 and furthest[at - 1] >= end

    return covered


def _lexed(text: str, min_score: float, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of kind ``lex``: right sides of sensitive names and the literals of their constants, unless a base span covers them.

    Each value's parts are followed once, however many names receive it.
    """
    found: dict[tuple[int, int], None] = {}
    if ":" in text or "=" in text:
        covered = _cover(base)
        followed: set[int] = set()
        for name, value, start, end, constants in pairs(text):
            if score(name, value) < min_score:
                continue
            if not covered(start, end):
                if text[start] in "\"'`" and text.find(text[start], start + 1) == end - 1:
                    start, end = start + 1, end - 1
                if not covered(start, end):
                    found[start, end] = None
            todo = constants
            while todo:
                part = todo.pop()
                if id(part) in followed:
                    continue
                followed.add(id(part))
                if isinstance(part.parts, tuple):
                    todo.extend(part.parts)
                elif part.literal and part.literal[0] < part.literal[1] and not covered(*part.literal):
                    found[part.literal] = None
    return [(start, 3, end) for start, end in found]


def secret_spans(text: str, min_score: float = MIN_SCORE) -> list[tuple[int, int, int]]:
    """The spans of base patterns, of right sides and of the literals that sensitive names receive through constants, as
    (start, kind, end) in order; what is reported and masked.
    """
    base = base_spans(text)
    return sorted(base + _lexed(text, min_score, base))


def written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in found)


def redact(text: str, found: list[tuple[int, int, int]]) -> str:
    """``text`` with every span, overlapping ones joined, replaced by a mark."""
    out, at = [], 0
    for start, _, end in found:
        if start >= at:
            out += [text[at:start], REDACTED]
        at = max(at, end)
    return "".join([*out, text[at:]])


_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_lex long, base_sha256 string, spans string"


def scan(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Counts by kind, the digest of the base spans and all spans of every document."""
    common.prepare(docs.sparkSession)
    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in common.texts(batch):
            found = secret_spans(text, min_score)
            count = Counter(kind for _, kind, _ in found)
            base = written([x for x in found if x[1] < 3])
            rows.append((*(count[k] for k in range(4)), hashlib.sha256(base.encode()).hexdigest(), written(found)))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        names = [part.strip().split()[0] for part in _SCHEMA.split(",")]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)

    return common.map_arrow(source, work, _SCHEMA)


def redact_secrets(docs: DataFrame) -> DataFrame:
    """All rows and columns; secrets in ``text`` are masked and ``n_chars``, where there is one, counts the new text."""
    common.prepare(docs.sparkSession)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        old = batch.column("text").to_pylist()
        new = [t if t is None else redact(t, secret_spans(t)) for t in old]
        names = batch.schema.names
        columns = list(batch.columns)
        columns[names.index("text")] = pa.array(new, batch.schema.field("text").type)
        if "n_chars" in names:
            at = names.index("n_chars")
            counts = [c if a == b else len(b) for a, b, c in zip(old, new, columns[at].to_pylist(), strict=True)]
            columns[at] = pa.array(counts, batch.schema.field("n_chars").type)
        return pa.RecordBatch.from_arrays(columns, names)

    return common.map_arrow(docs, work, docs.schema)
