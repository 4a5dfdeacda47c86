"""Runs of repeated words in texts, by a suffix automaton whose root paths remember their last occurrence.

The suffix links of the automaton of a word sequence form a tree: the path from a prefix to the root holds all
its suffixes. Appending a word is an access of that path, as in link-cut trees: the path falls into segments that were
last reached by the same earlier prefix, and all of it takes the new colour. A segment whose longest suffix has ``reach`` words and was
last seen ending ``d`` words ago says that the last ``reach + d`` words have the period ``d``: with ``reach >= d`` a square, and a
run if it grows no further. Segments lie on stacks, one for each heavy path of the finished tree, so that an access
only looks at the segments that it changes.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestry.llm.bytelevel import FEW, Recent

#: A run has at least so many words, and so many times its period.
LEAST, TIMES = 24, 3
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SCHEMA = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RUNS = "array<struct<start:long,length:long,period:long>>"


class Automaton:
    """The suffix automaton of a sequence of small numbers: ``length`` and ``link`` by state, and ``prefix``, the state of each prefix.

    Most states have one transition, which lies in two arrays; only states with more have a dictionary.
    """

    def __init__(self, words: list[int]):
        self.length, self.link = array("i", [0]), array("i", [-1])
        self.word, self.target, self.more = array("i", [-1]), array("i", [-1]), {}
        self.prefix = array("i", [0])
        for w in words:
            self.prefix.append(self._append(w, self.prefix[-1]))

    def _state(self, length: int, link: int, word: int = -1, target: int = -1) -> int:
        self.length.append(length)
        self.link.append(link)
        self.word.append(word)
        self.target.append(target)
        return len(self.length) - 1

    def _append(self, w: int, last: int) -> int:
        length, link, word, target, more = self.length, self.link, self.word, self.target, self.more
        new, p, q = self._state(length[last] + 1, 0), last, -1
        while p >= 0:
            if word[p] == w:
                q = target[p]
            elif p in more:
                q = more[p].get(w, -1)
            if q >= 0:
                break
            if word[p] < 0:
                word[p], target[p] = w, new
            else:
                more.setdefault(p, {})[w] = new
            p = link[p]
        if q < 0:
            return new
        if length[q] == length[p] + 1:
            link[new] = q
            return new
        copy = self._state(length[p] + 1, link[q], word[q], target[q])
        if q in more:
            more[copy] = dict(more[q])
        while p >= 0:
            if word[p] == w and target[p] == q:
                target[p] = copy
            elif p in more and more[p].get(w) == q:
                more[p][w] = copy
            else:
                break
            p = link[p]
        link[q] = link[new] = copy
        return new


def _heads(length: array, link: array) -> array:
    """The top state of each state's heavy path in the tree of suffix links."""
    order = np.argsort(np.frombuffer(length, np.int32), kind="stable").tolist()
    size, heavy, head = [1] * len(length), [0] * len(length), array("i", range(len(length)))
    for v in reversed(order[1:]):
        up = link[v]
        size[up] += size[v]
        if not heavy[up] or size[v] > size[heavy[up]]:
            heavy[up] = v
    for v in order[1:]:
        if heavy[link[v]] == v:
            head[v] = head[link[v]]
    return head


def runs_of(words: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs of at least ``least`` words and ``times`` (two or more) periods, by start and period.

    Periods are the smallest ones. The last end at which a suffix was seen is the nearest, and a smaller period of a
    square would have been seen nearer.
    """
    made = Automaton(words)
    length, link = made.length, made.link
    head, stacks, found = _heads(length, link), {}, {}
    for end in range(1, len(words) + 1):
        v, below = made.prefix[end], 0  # a segment that goes on below is as long as it is there
        while v > 0:
            top, path = length[v], head[v]
            segments = stacks.get(path)
            if segments is None:
                segments = stacks[path] = []
            nearest, reach = segments[-1][1] if segments else 0, 0
            while segments and reach < top:
                reach, seen = segments[-1]
                apart = end - seen
                common = reach if reach < top else top
                if common >= (times - 1) * apart and common + apart >= least and seen != below:
                    found[end - common - apart, apart] = end
                if reach > top:
                    break
                segments.pop()
            segments.append((top, end))
            v, below = link[path], nearest
    return sorted((start, end - start, period) for (start, period), end in found.items())


def repeated_stretches(hashes: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """Stretches ``(from, to)`` of a sequence that hold all its runs whole; most texts have none.

    With ``n = max(least, times * q)`` words, a run of period ``q`` has more than ``2 * q`` by a few, at least by ``grams - 1`` words, so that each
    of its grams of so many words occurs a second time. Only words in grams that recur are in a stretch.
    """
    turn = least // times
    grams = min(max(least, times * q) - 2 * q for q in (turn, turn + 1)) + 1
    if len(hashes) < least:
        return []
    rolled = np.zeros(len(hashes) - grams + 1, np.uint64)
    for k in range(grams):
        rolled = rolled * _BASE + hashes[k : k + len(rolled)]
    ordered = np.sort(rolled)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return []
    at = np.searchsorted(again, rolled)
    hit = again[np.minimum(at, len(again) - 1)] == rolled
    step = np.zeros(len(hashes) + 1, np.int32)
    step[: len(hit)] += hit
    step[grams : grams + len(hit)] -= hit
    inside = np.diff((np.cumsum(step) > 0).astype(np.int8), prepend=0)
    return [(a, b) for a, b in zip(np.flatnonzero(inside > 0).tolist(), np.flatnonzero(inside < 0).tolist()) if b - a >= least]


def find_runs(words: list[bytes], hashes: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """The runs of a sequence of words, whose ``hashes`` only choose the stretches that are looked at."""
    found = []
    for a, b in repeated_stretches(hashes, least, times):
        numbers: dict[bytes, int] = {}
        part = [numbers.setdefault(w, len(numbers)) for w in words[a:b]]
        found += [(a + start, length, period) for start, length, period in runs_of(part, least, times)]
    return found


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(step)[:-1] == 0).tolist()]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``(id, runs, collapsed)`` for every row of ``docs``: its runs of words, and its words without their repetitions.

    Words are what stands between ASCII white space, numbered from 0; null texts are empty and have no runs. A run is a longest stretch of words
    with a smallest period, of at least ``least`` words and ``times`` periods; ``runs`` is ordered by start, then period. ``collapsed`` is joined
    by single blanks and leaves out each word that a run holds after its first period. Rows keep their number; ids may be null or repeated; other columns
    are not read. A text is one task's work, in memory that grows with that text alone.
    """
    if times < 2:
        raise ValueError("a run has at least two periods")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Recent(lambda w: xxhash.xxh64_intdigest(w), FEW)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part, runs, left = batch.slice(at, 64), [], []
                for text in part.column(1):
                    words = (text.as_py() or "").encode().split()
                    own = find_runs(words, np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), least, times)
                    runs.append([{"start": a, "length": n, "period": p} for a, n, p in own])
                    left.append(b" ".join(collapse(words, own)).decode())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(runs, pa.list_(_SCHEMA)), pa.array(left, pa.string())], names=["id", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id long, runs {_RUNS}, collapsed string")


def most_repeated(runs: Column) -> Column:
    """The run with the greatest exact quotient of length and period, of equal ones the first; null of none."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    return F.reduce(runs, none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def repeat_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text)`` of ``docs``, where a tenth of the texts, by a hash of the id, repeats itself from some word on: texts whose runs are known.

    With ``h`` the CRC-32 of the id in decimal, ``g = floor(h / 10)`` and ``n > 0`` words, texts with ``h % 10 = 0`` have each word ``i >= a``
    replaced by word ``a + (i - a) % p``, where ``a = g % n`` and ``p = 1 + floor((n - a) / (3 + g % 8))``.
    """
    h = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), h.alias("h"), F.floor(h / 10).alias("g"))
    words = F.when(F.col("h") % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    rows = rows.withColumn("w", words).withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", F.floor((F.col("n") - F.col("a")) / (F.col("g") % 8 + 3)) + 1)
    word = F.transform("w", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return rows.select("id", F.when(F.col("n") > 0, F.array_join(word, " ")).otherwise(F.col("text")).alias("text"))
