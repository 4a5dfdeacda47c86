"""Benchmark decontamination by greedy string tiling.

Runs of ``least`` words that a text shares with a benchmark item are seeds, found by Karp-Rabin hashes that texts and items
send to a join. From the seeds of a text and an item the longest run of equal words that is not yet covered on either
side is marked, again and again; the share of the item's words that gets covered tells a leak, in whatever order its
parts stand.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from harvestry.llm import bloom
from harvestry.llm.bytelevel import FEW, Recent
from harvestry.plans.skew import join_facts
from harvestry.sources.shared import materialize

LEAST, COVERAGE = 5, 0.8
#: Items that share a seed, from which on it counts as common.
COMMON = 100
#: Pairs of places that are held at a time.
PAIRS = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)

_words = re.compile(r"\w+").findall


def words_of(text: str | None) -> list[str]:
    """The lower-case words of a text."""
    return _words((text or "").lower())


class Words:
    """Texts as arrays of 64-bit hashes of their words; holds the words that a task has met."""

    def __init__(self):
        self.known = Recent(lambda w: xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")), FEW)

    def __call__(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))


def rolling(ids: np.ndarray, width: int) -> np.ndarray:
    """A Karp-Rabin hash of every run of ``width`` numbers, modulo 2^64."""
    n = max(0, len(ids) - width + 1)
    hashes = np.zeros(n, np.uint64)
    for k in range(width):
        hashes = hashes * _BASE + ids[k : k + n]
    return hashes


def matches(item: np.ndarray, text: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``(i, j, n)``: the longest runs in which ``n`` seeds of an item and a text are equal, from places ``i`` and ``j`` on.

    Pairs of places are looked at for some places of the item at a time, so that what repeats itself takes little memory.
    """
    order = np.argsort(text, kind="stable")
    first, last = (np.searchsorted(text[order], item, side) for side in ("left", "right"))
    counts = last - first
    starts, at, parts = np.cumsum(counts), 0, []
    while at < len(item):
        end = max(at + 1, int(np.searchsorted(starts, PAIRS + (starts[at - 1] if at else 0), "right")))
        n = counts[at:end]
        left = np.repeat(np.arange(at, min(end, len(item))), n)
        right = order[np.arange(n.sum()) + np.repeat(first[at:end] - np.cumsum(n) + n, n)]
        parts.append(_joined(left, right, np.ones(len(left), np.int64)))
        at = end
    i, j, n = _joined(*(np.concatenate([p[k] for p in parts]) for k in range(3))) if parts else ([], [], [])
    yield from zip(map(int, i), map(int, j), map(int, n))


def _joined(i: np.ndarray, j: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs with those that follow each other on a diagonal made one."""
    order = np.lexsort((i, j - i))
    i, j, n = i[order], j[order], n[order]
    fresh = np.ones(len(i), bool)
    fresh[1:] = (i[1:] != i[:-1] + n[:-1]) | (j[1:] != j[:-1] + n[:-1])
    starts = np.flatnonzero(fresh)
    return i[starts], j[starts], np.add.reduceat(n, starts) if len(starts) else n


def tile(item: np.ndarray, text: np.ndarray, least: int) -> int:
    """The words of ``item`` that greedy tiling covers by runs of ``text`` of at least ``least`` words.

    Matches are marked from the longest on, ties by place; one that meets marked words is cut down to its free
    parts, which wait for their turn.
    """
    heap = []
    for i, j, n in matches(rolling(item, least), rolling(text, least)):
        n += least - 1
        heap += _runs(item[i : i + n] == text[j : j + n], i, j, least)  # hashes may agree by chance
    heapq.heapify(heap)
    free_item, free_text = np.ones(len(item), bool), np.ones(len(text), bool)
    while heap:
        n, i, j = heapq.heappop(heap)
        free = free_item[i : i - n] & free_text[j : j - n]
        if free.all():
            free_item[i : i - n] = free_text[j : j - n] = False
            if not _runs(free_item, 0, 0, least):
                break
        else:
            for part in _runs(free, i, j, least):
                heapq.heappush(heap, part)
    return int((~free_item).sum())


def _runs(good: np.ndarray, i: int, j: int, least: int) -> list[tuple[int, int, int]]:
    """``(-length, i, j)`` of the runs of true values that are long enough."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], good, [False]]).astype(np.int8)))
    return [(int(s - e), i + int(s), j + int(s)) for s, e in zip(edges[::2], edges[1::2]) if e - s >= least]


def item_seeds(items: DataFrame, least: int, coverage: float) -> DataFrame:
    """``(seed, item, places, spare, need)``: the seeds that lead to an item, from ``(item, text)``.

    A leak covers ``c`` words in runs of ``least`` or more, and so needs ``c / least`` seed places. Of the seeds that many
    items share, the commonest are left out, as long as they have fewer places than that: every leak still holds
    another seed. ``spare`` is how many places were left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for item, text in zip(batch.column(0), batch.column(1)):
                ids = words(text.as_py())
                seeds, places = np.unique(rolling(ids, least).view(np.int64), return_counts=True)
                need = -(-int(np.ceil(coverage * len(ids) - 1e-9)) // least)
                columns = [pa.array([item.as_py()] * len(seeds), pa.int64()), pa.array(seeds), pa.array(places, pa.int64()), pa.array([need] * len(seeds), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["item", "seed", "places", "need"])

    rows = materialize(items.select("item", "text").mapInArrow(run, "item long, seed long, places long, need long"), "item-seeds")
    common = rows.groupBy("seed").agg(F.count("*").alias("n")).filter(F.col("n") > COMMON)
    rows = rows.join(common, "seed", "left")
    before = F.sum(F.when(F.col("n").isNotNull(), F.col("places"))).over(Window.partitionBy("item").orderBy(F.desc_nulls_last("n"), "seed"))
    rows = rows.withColumn("out", F.coalesce(F.col("n").isNotNull() & (before < F.col("need")), F.lit(False)))
    spare = F.sum(F.when(F.col("out"), F.col("places")).otherwise(0)).over(Window.partitionBy("item"))
    return materialize(rows.withColumn("spare", spare).filter("not out").select("seed", "item", "places", "spare", "need"), "item-seeds")


def text_key(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col).cast("string"))


def leaking_texts(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """``(k, leaks array<struct<item_id, covered, words>>)`` of the texts, by their XXH64, that leak an item.

    Seeds of texts that pass the filter meet the seeds of items in a shuffle; texts and items that share enough of them meet as
    whole texts, and are tiled. Copies of a text are one text all the way.
    """
    named = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    named = materialize(named.select("item_id", F.xxhash64("text").alias("item"), "text"), "items")
    items = named.select("item", "text").dropDuplicates(["item"])
    seeds = item_seeds(items, least, coverage)
    bits = docs.sparkSession.sparkContext.broadcast(bloom.build(seeds, "seed"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            keys, hits = [], []
            for k, text in zip(batch.column(0), batch.column(1)):
                own = rolling(words(text.as_py()), least)
                own = np.unique(own[bloom.passes(own, bits.value)])
                if len(own):
                    keys.append(k.as_py())
                    hits.append(own.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(hits, pa.list_(pa.int64()))], names=["k", "seeds"])

    texts = docs.select(text_key(text_col).alias("k"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    hit = texts.mapInArrow(found, "k long, seeds array<long>").select("k", F.explode("seeds").alias("seed")).distinct()
    met = hit.join(seeds, "seed").groupBy("k", "item").agg(F.sum("places").alias("places"), F.first("spare").alias("spare"), F.first("need").alias("need"))
    pairs = materialize(met.filter(F.col("places") + F.col("spare") >= F.col("need")).select("k", "item"), "candidates")
    own = texts.join(pairs.select("k").distinct(), "k", "left_semi").dropDuplicates(["k"])
    both = pairs.join(items.withColumnRenamed("text", "said"), "item").join(own, "k")

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        last, text = None, None
        for batch in batches:
            out = []
            for k, item, said, whole in zip(*(batch.column(c) for c in ("k", "item", "said", "text"))):
                if last != k.as_py():
                    last, text = k.as_py(), words(whole.as_py())
                wanted = words(said.as_py())
                covered = tile(wanted, text, least)
                if covered >= coverage * len(wanted) - 1e-9:
                    out.append((last, item.as_py(), covered, len(wanted)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 4)], names=["k", "item", "covered", "words"])

    leaks = materialize(both.select("k", "item", "said", "text").mapInArrow(tiled, "k long, item long, covered long, words long"), "leaks")
    ids = named.groupBy("item").agg(F.collect_list("item_id").alias("ids"), F.count_if(F.col("item_id").isNull()).alias("unnamed"))
    ids = ids.select("item", F.concat("ids", F.array_repeat(F.lit(None).cast("long"), F.col("unnamed").cast("int"))).alias("ids"))
    counts = leaks.groupBy("item").agg(F.count("*").alias("n"))
    named_leaks = join_facts(leaks, ids.join(counts, "item"), "item", leaks.count(), F.xxhash64("k"))
    answers = named_leaks.select("k", F.explode("ids").alias("item_id"), "covered", "words")
    return answers.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("item_id", "covered", "words"))).alias("leaks"))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", least: int = LEAST,
    coverage: float = COVERAGE
) -> DataFrame:
    """``(id, item_id, covered, words, coverage)``: the documents that cover at least ``coverage`` of an item's words.

    Words are lower-cased runs of letters, digits and underscores; tiles have at least ``least`` words, the least match of the method, so
    that an item of fewer words has no tile, and null or empty texts never match. Rows of ``docs`` answer one by one, so
    repeated rows repeat their answers; equal items each answer; null ids stay null. Without items or documents there are no rows.
    """
    leaks = materialize(leaking_texts(docs, benchmark, text_col, item_col, least, coverage), "leaking")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_key(text_col).alias("k")).join(leaks.select("k"), "k", "left_semi")
    rows = materialize(rows, "leaking-rows")
    counts = rows.groupBy("k").agg(F.count("*").alias("n"))
    found = join_facts(rows, leaks.join(counts, "k"), "k", rows.count(), F.xxhash64("id"))
    found = found.select("id", F.explode("leaks").alias("x")).select("id", "x.item_id", "x.covered", "x.words")
    return found.withColumn("coverage", F.col("covered") / F.col("words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` whose ``text`` leaks no item of ``benchmark``, unchanged; rows without a text stay."""
    leaks = materialize(leaking_texts(docs, benchmark, least=least, coverage=coverage).select(F.col("k").alias("_leaking")), "leaking")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.when(F.col("text").isNotNull(), text_key("text")).alias("k"))
    return rows.join(leaks, F.col("k") == F.col("_leaking"), "left_anti").select("row.*")
