"""Secret scans: fixed patterns, and Shannon entropy in a window sliding over candidate strings."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base patterns by kind, in the order in which kinds are listed.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24


@dataclass(frozen=True)
class CharacterClass:
    """Candidates of one alphabet: runs of ``pattern`` in which every one of ``needs`` occurs.

    A window of ``width`` characters is suspicious from ``bits`` of entropy a character on.
    """

    kind: str
    pattern: str
    needs: tuple[str, ...]
    width: int
    bits: float


#: The classes that the operator looks at unless told otherwise.
CLASSES = (
    CharacterClass("entropy_hex", r"[0-9A-Fa-f]{20,}", ("[0-9]", "[A-Fa-f]"), 20, 3.0),
    CharacterClass("entropy_base64", r"[A-Za-z0-9+/_-]{24,}={0,2}", ("[0-9]", "[a-z]", "[A-Z]"), 24, 3.8),
)


def _run(signs: str, least: int) -> str:
    """A pattern for the first ``least`` of ``signs`` or more of them, in order."""
    more = ""
    for sign in reversed(signs[least:]):
        more = f"(?:{sign}{more})?"
    return signs[:least] + more


#: Parts of candidates that are never secrets: UUIDs, 12 characters and more of a repeated unit, runs of the alphabet or of digits.
ALLOWED = (
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    *[rf"(.{{{n}}})\1{{{max(2, math.ceil(12 / n) - 1)},}}" for n in range(1, 9)],
    f"(?i:{_run('abcdefghijklmnopqrstuvwxyz', 10)})",
    f"(?i:{_run('0123456789abcdef', 10)})",
)


def suspicious(text: str, width: int, bits: float) -> Iterator[tuple[int, int]]:
    """Maximal spans covered by windows of ``width`` characters with at least ``bits`` of entropy each.

    With counts ``c`` in a window of ``w`` characters the entropy is ``log2 w - sum(c log2 c) / w``; a step of the
    window changes two counts. A text shorter than the window is one window of its own length.
    """
    width = min(width, len(text))
    if not width:
        return
    cost = [0.0] + [c * math.log2(c) for c in range(1, width + 2)]
    most = (math.log2(width) - bits) * width + 1e-9
    counts: dict[str, int] = {}
    total, span = 0.0, None
    for at, c in enumerate(text):
        n = counts.get(c, 0)
        total += cost[n + 1] - cost[n]
        counts[c] = n + 1
        if at >= width:
            old = text[at - width]
            n = counts[old]
            total += cost[n - 1] - cost[n]
            counts[old] = n - 1
        if at >= width - 1 and total <= most:
            start = at + 1 - width
            if span and start <= span[1]:
                span = (span[0], at + 1)
            else:
                if span:
                    yield span
                span = (start, at + 1)
    if span:
        yield span


class Scanner:
    """The compiled patterns of a scan."""

    def __init__(self, classes: Iterable[CharacterClass] = CLASSES, allowed: Iterable[str] = ALLOWED):
        self.assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII).finditer
        self.access = re.compile(ACCESS).finditer
        # the longest runs from the leftmost on, so that the least length can be asked for at once
        self.hex = re.compile(HEX.replace("+", f"{{{HEX_LEAST},}}")).finditer
        self.classes = [(c, re.compile(c.pattern).finditer, [re.compile(n).search for n in c.needs]) for c in classes]
        self.allowed = [re.compile(a, re.DOTALL).finditer for a in allowed]

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """``(start, end, kind)`` of the base patterns, kinds 0 to 2 as listed."""
        found = []
        low = text.lower() if "=" in text or ":" in text else ""
        if any(w in low for w in ("password", "passwd", "secret", "token", "apikey", "api_key")):
            found += [(*m.span(), 0) for m in self.assign(text) if len(m[2]) >= ASSIGN_LEAST]
        if "AKIA" in text:
            found += [(*m.span(), 1) for m in self.access(text) if len(m[0]) >= ACCESS_LEAST]
        found += [(*m.span(), 2) for m in self.hex(text)]
        return sorted(found, key=lambda s: (s[0], s[2], s[1]))

    def pieces(self, start: int, candidate: str) -> Iterator[tuple[int, str]]:
        """What the allow-list leaves of a candidate: the pieces between allowed parts, with their places."""
        at = 0
        for s, e in sorted(m.span() for a in self.allowed for m in a(candidate)):
            if s > at:
                yield start + at, candidate[at:s]
            at = max(at, e)
        if at < len(candidate):
            yield start + at, candidate[at:]

    def added(self, text: str) -> Iterator[tuple[int, int, int]]:
        """``(start, end, kind)`` of the suspicious spans, class by class."""
        for k, (c, candidates, needs) in enumerate(self.classes):
            for m in candidates(text):
                for start, piece in self.pieces(m.start(), m[0]):
                    if len(piece) >= c.width and all(n(piece) for n in needs):
                        for s, e in suspicious(piece, c.width, c.bits):
                            yield start + s, start + e, 3 + k

    def scan(self, text: str) -> list[tuple[str, int, int]]:
        """``(kind, start, end)`` by start, then kind: base spans, and entropy spans that no base span holds.

        Both are in order of their starts; a span is held if one of the base spans that start before it ends behind it.
        """
        names = ["assign", "access", "hex", *(c.kind for c, _, _ in self.classes)]
        base = self.base(text)
        kept, k, reach = [], 0, -1
        for x in sorted(self.added(text)):
            while k < len(base) and base[k][0] <= x[0]:
                reach, k = max(reach, base[k][1]), k + 1
            if x[1] > reach:
                kept.append(x)
        return [(names[k], s, e) for s, e, k in sorted(base + kept, key=lambda x: (x[0], x[2], x[1]))]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: Iterable[CharacterClass] = CLASSES, allowed: Iterable[str] = ALLOWED) -> DataFrame:
    """``(id, spans array<struct<kind, start, end>>)`` for every row of ``docs``; positions in code points, end exclusive.

    Base kinds are the leftmost non-overlapping matches that are long enough. Entropy kinds are added where a window
    of a candidate string is suspicious; parts of it on the allow-list are left out, and so are spans in a base span. Work is
    linear in the length of a text. Null
    and empty texts have no spans. Repeated rows and null ids keep their rows; other columns are not read.
    """
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    classes, allowed = tuple(classes), tuple(allowed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(classes, allowed)
        for batch in batches:
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in scanner.scan(t.as_py() or "")] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, spans)], names=["id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, spans array<struct<kind: string, start: long, end: long>>")
