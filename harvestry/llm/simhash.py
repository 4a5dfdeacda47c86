"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every text becomes one or more bands of up to 64 bits. Two band values within ``radius`` bits of each other have a
common variant within half the radius of both, so each distinct value emits its ball of variants, variants
meet in one shuffle, and what collides is linked. A variant can only be hit by the values of its own ball, which
bounds every group by the size of that ball (65 at radius 2), however many copies a text has.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from harvestry.llm import bloom
from harvestry.llm.bytelevel import FEW, Recent
from harvestry.plans.components import connected_components, joined_components
from harvestry.plans.skew import HOT_ROWS, join_facts
from harvestry.sources.shared import materialize, release

SEED = 42
#: Hashes that are turned into bits at a time, so that a text of any length takes little memory.
CHUNK = 1 << 15
#: Texts, about, that are counted to order shingles by rarity, and frequent shingles that are told apart, at most.
ORDER_TEXTS, ORDER_SHINGLES = 20_000, 1 << 18
#: Members up to which a bucket is small.
SMALL = 32
#: Buckets of a set, the first ones, by which it is told where it meets another set first.
FIRST = 16
#: Shingles that leave a task at a time.
FLUSH = 1 << 19
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def shingles(words: list[bytes], width: int) -> Iterable[bytes]:
    """Runs of ``width`` words, repeats included; the whole sequence if it is shorter; none of no words."""
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    return map(b" ".join, zip(*(words[k:] for k in range(width))))


def majority(parts: Iterable[np.ndarray]) -> int:
    """64 bits, as a signed number: a bit is 1 if it is set in over half the hashes, given in parts; 0 of none."""
    counts, n = np.zeros(64, np.int64), 0
    for part in parts:
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.int64)[0])


def simhash(features: Iterable[bytes], seed: int = SEED) -> int:
    """The fingerprint of features by their XXH64 hashes."""
    hashes = map(xxhash.xxh64_intdigest, features, repeat(seed))
    return majority(_parts(hashes))


def _parts(hashes: Iterator[int]) -> Iterator[np.ndarray]:
    while len(part := np.fromiter(islice(hashes, CHUNK), np.uint64)):
        yield part


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int = 3, bits: int = 64, bands: int = 1, features: Callable = shingles) -> DataFrame:
    """``(id, bands array<long>)`` for every row of ``docs``.

    A-Z are lower-cased, words are runs of bytes other than ASCII white space. Null and empty texts have the
    fingerprint 0. Rows keep their multiplicity; ids may be null or repeated; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = np.int64(-1) if bits == 64 else np.int64((1 << bits) - 1)
        for batch in batches:
            out = []
            for text in batch.column(1):
                words = (text.as_py() or "").encode().lower().split()
                own = features(words, width)
                own = own if bands == 1 else list(own)
                out.append([int(np.int64(simhash(own, SEED + k)) & keep) for k in range(bands)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], names=["id", "bands"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, bands array<long>")


def _masks(bits: int, half: int) -> list[int]:
    """The exclusive-or masks of a ball, as signed numbers, the empty one first."""
    found = [sum(1 << b for b in flips) for k in range(half + 1) for flips in combinations(range(bits), k)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def ball_links(values: DataFrame, radius: int = 2, bits: int = 64) -> DataFrame:
    """``(a, b)`` with ``a < b``: links between the distinct longs of column ``v`` at most ``radius`` bits apart.

    All values that meet in a variant are linked as a star on the least of them, so everything within the radius
    is connected and the number of links stays linear. ``radius`` must be even, as each side walks half of it.
    With half a radius of 1, a variant's group is held as the bit set of flipped positions, which merges map-side.
    """
    if radius % 2 or radius < 0:
        raise ValueError("the radius must be even: each side walks half of it")
    half = radius // 2
    masks = _masks(bits, half)
    ball = F.array(*[F.lit(m).cast("long") for m in masks])
    # values are few bytes, but each becomes a ball: dealt by number, they are not gathered into few tasks before that
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = values.select(F.col("v").cast("long").alias("v")).filter("v is not null").repartition(parts, "v").dropDuplicates(["v"])
    emitted = distinct.select("v", F.explode(ball).alias("m")).select(F.expr("v ^ m").alias("variant"), "v", "m")
    if half == 1:
        met = emitted.groupBy("variant").agg(F.bit_or("m").alias("flips"), F.max(F.expr("m = 0")).alias("self"))
        met = met.filter(F.expr("bit_count(flips) + int(self) > 1"))
        met = met.select(F.filter(ball, lambda m: ((m == 0) & F.col("self")) | (m.bitwiseAND(F.col("flips")) != 0)).alias("hit"), "variant")
        met = met.select(F.transform("hit", lambda m: m.bitwiseXOR(F.col("variant"))).alias("group"))
    else:
        met = emitted.groupBy("variant").agg(F.collect_set("v").alias("group")).filter("size(group) > 1")
    links = met.select(F.array_min("group").alias("a"), F.explode("group").alias("b")).filter("a <> b").distinct()
    return links.filter(F.bit_count(F.expr("a ^ b")) <= radius)


def hex16(col: str | Column) -> Column:
    """A signed long as its 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(col), 16, "0"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """One row per row of ``docs``: ``(id, fingerprint, component_id)``, fingerprints linked within ``radius`` bits.

    ``component_id`` is the least id reachable over links, the row's own included. Rows with equal fingerprints are
    one node, so copies cost one row each. Texts without words share the fingerprint 0 and are linked like others.
    Null ids keep their rows and never name a component unless all its ids are null.
    """
    sig = materialize(fingerprints(docs, id_col, text_col, width).select("id", F.col("bands")[0].alias("v")), "simhash")
    total = sig.count()
    reps = materialize(sig.groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("n")), "simhash-reps")
    labels = connected_components(ball_links(reps, radius), "a", "b").select(F.col("node").alias("v"), "component")
    linked = materialize(labels.join(reps.select("v", "least"), "v"), "simhash-linked")
    tops = linked.groupBy("component").agg(F.min("least").alias("top"), F.count("*").alias("n"))
    linked = join_facts(linked, tops, "component", total, F.xxhash64("v")).select("v", "top")
    nodes = reps.join(linked, "v", "left").select("v", F.coalesce("top", "least").alias("component_id"), "n")
    # a fingerprint may be that of a third of all rows
    done = join_facts(sig, materialize(nodes, "simhash-nodes"), "v", total, F.xxhash64("id"))
    return done.select("id", F.col("v").alias("fingerprint"), "component_id")


def _prefix_length(n: int, similarity: float) -> int:
    """A set of ``n`` shares one of so many first items with every set at least ``similarity`` alike, in any common order."""
    return n - math.ceil(n * similarity - 1e-9) + 1


class Shingler:
    """Shingle sets of texts as 64-bit hashes, rolled over the hashes of words; holds the words that a task has met."""

    def __init__(self, width: int):
        self.width = width
        self.words = Recent(lambda w: xxhash.xxh64_intdigest(w, SEED), FEW)

    def __call__(self, text: str | None) -> np.ndarray:
        """The distinct shingles of a text, sorted; of fewer words than a shingle has, that of the whole sequence."""
        words = (text or "").encode().lower().split()
        ids = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        width = min(self.width, len(ids))
        if not width:
            return np.zeros(0, np.int64)
        rolled = np.full(len(ids) - width + 1, width, np.uint64)
        for k in range(width):
            rolled = rolled * _BASE + ids[k : k + len(rolled)]
        rolled ^= rolled >> np.uint64(31)
        rolled *= _MIX
        rolled ^= rolled >> np.uint64(29)
        return np.unique(rolled.view(np.int64))


def batches_of(rows: Iterable[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows that end with an array, in batches of a bounded number of its items."""
    out, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    for row in rows:
        out.append(row)
        size += len(row[-1]) + 1
        if size >= FLUSH:
            yield batch()
            out, size = [], 0
    if out:
        yield batch()


def _frequent_shingles(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles, sorted, and their counts, from a part of the texts. They only choose an order, so neither bound loses a pair."""
    every = max(1, texts.count() // ORDER_TEXTS)
    part = texts.filter(F.pmod("key", F.lit(every)) == 0).dropDuplicates(["key"]).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Shingler(width)
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(own(text.as_py()))], names=["s"])

    counts = part.mapInArrow(run, "s long").groupBy("s").agg(F.count("*").alias("n")).filter("n > 3")
    top = counts.orderBy(F.desc("n"), "s").limit(ORDER_SHINGLES).toArrow()
    s, n = top.column("s").to_numpy(), top.column("n").to_numpy()
    order = np.argsort(s)
    return s[order], n[order]


def sketched(texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """``(key, v, n, w, k, s)`` of every text: fingerprint, number of shingles, and the first of them, ``k`` that are not known as frequent before the others.

    ``w`` grows with the place of the last of ``s`` in the order.
    """
    known, counts = _frequent_shingles(texts, width)

    def told(shingled: Shingler, text: str | None) -> tuple:
        own = shingled(text)
        v = majority(own[k : k + CHUNK].view(np.uint64) for k in range(0, len(own), CHUNK))
        if not len(own):
            return v, 0, 0, 0, own
        often = np.zeros(len(own), np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            often = np.where(known[at] == own, counts[at], 0)
        order = np.argsort(often, kind="stable")[: _prefix_length(len(own), similarity)]
        last = (int(often[order[-1]]) << 44) | ((int(own[order[-1]]) + (1 << 63)) >> 20)
        return v, len(own), last, int((often[order] == 0).sum()), own[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingled = Shingler(width)
        for batch in batches:
            rows = ((k.as_py(), *told(shingled, t.as_py())) for k, t in zip(batch.column(0), batch.column(1)))
            yield from batches_of(rows, ["key", "v", "n", "w", "k", "s"], [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64())])

    return texts.mapInArrow(run, "key long, v long, n int, w long, k int, s array<long>")


def shared_shingles(firsts: DataFrame) -> DataFrame:
    """``(key, n, w, s, rem, own)``: the first shingles that another text has among its first ones too.

    ``rem`` counts the shingles of the text in this table from ``s`` on, in an order that all texts share: those not known as frequent by how many texts have
    them among their first ones, then the others as they come. Whatever texts share of their first shingles from one on is no more than either's ``rem``.
    ``own`` counts a text's other shingles: of a family of copies the original has the least, as edits make shingles of their own. Frequent
    shingles need no search for another text, and others are told by a filter, so that those of one text only stay where they are.
    """
    rare = firsts.select("key", F.explode(F.slice("s", F.lit(1), F.col("k"))).alias("s"))
    shared = rare.groupBy("s").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("n")).filter("lo <> hi")
    shared = materialize(shared.select("s", "n", F.col("n").alias("texts")), "shared-shingles")
    bits = firsts.sparkSession.sparkContext.broadcast(bloom.build(shared, "s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, (key, n, w, k) = batch.column("s"), (batch.column(c).to_numpy() for c in ("key", "n", "w", "k"))
            length = lists.value_lengths().to_numpy().astype(np.int64)
            row, s = np.repeat(np.arange(len(length)), length), lists.flatten().to_numpy()
            rem = length[row] - (np.arange(len(s)) - (np.cumsum(length) - length)[row])
            frequent = length - k
            rem = np.where(rem <= frequent[row], rem, 0)
            on = np.flatnonzero((rem > 0) | bloom.passes(s.view(np.uint64), bits.value))
            columns = [key[row[on]], n[row[on]], w[row[on]], frequent[row[on]].astype(np.int32), s[on], rem[on].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "n", "w", "frequent", "s", "rem"])

    flat = firsts.filter("n > 0").select("key", "n", "w", "k", "s").mapInArrow(run, "key long, n int, w long, frequent int, s long, rem int")
    flat = flat.dropDuplicates(["key", "s"])
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    found = join_facts(flat.filter("rem = 0"), shared, "s", total, F.xxhash64("key")).unionByName(flat.filter("rem > 0").withColumn("texts", F.lit(0).cast("long")))
    order = Window.partitionBy("key", F.col("rem") > 0).orderBy(F.desc("texts"), F.desc("s"))
    rem = F.when(F.col("rem") > 0, F.col("rem")).otherwise(F.col("frequent") + F.row_number().over(order))
    return found.select("key", "n", "w", "s", rem.alias("rem"), (F.col("n") - F.count("*").over(Window.partitionBy("key"))).alias("own"))


def needed(a: Column, b: Column, similarity: float) -> Column:
    """How many of their first items two sets ``similarity`` alike share at least: structs with ``n`` and ``w``.

    Of two sets take the one whose first items end earlier in the common order, which has the lesser ``w``: those that
    the other has are among that one's first items too. So they have no more in common than the first items they share, and what comes
    after the first items of that set. Sets with equal ``w`` are judged by the larger one.
    """
    after = [F.ceil(c["n"] * similarity - 1e-9) - 1 for c in (a, b)]
    rest = F.when(a["w"] < b["w"], after[0]).when(b["w"] < a["w"], after[1]).otherwise(F.greatest(*after))
    return overlap(a, b, similarity) - rest


def overlap(a: Column, b: Column, similarity: float) -> Column:
    """The least number of common items of two sets ``similarity`` alike, and a little less."""
    return similarity / (1 + similarity) * (a["n"] + b["n"]) - 1e-6


def shared_enough(met: DataFrame, similarity: float) -> DataFrame:
    """``(x, y)`` of the pairs in ``met``, a row ``(a, b)`` of structs with ``key``, ``n`` and ``w`` for each first item they share, that can be ``similarity`` alike."""
    rows = met.filter(F.least("a.n", "b.n") >= similarity * F.greatest("a.n", "b.n") - 1e-9)
    rows = rows.select(F.least("a.key", "b.key").alias("x"), F.greatest("a.key", "b.key").alias("y"), needed(F.col("a"), F.col("b"), similarity).alias("need"))
    return rows.groupBy("x", "y").agg(F.count("*").alias("shared"), F.max("need").alias("need")).filter("shared >= need").select("x", "y")


def with_hubs(members: DataFrame, total: int) -> DataFrame:
    """``(a, b)`` of the ``members`` ``(s, a)`` of each bucket ``s`` but its hub, the least of them: with the hub as ``b``."""
    hubs = members.groupBy("s").agg(F.min("a").alias("b"), F.count("*").alias("n"))
    return join_facts(members, hubs, "s", total, F.xxhash64("a.key")).filter("a.key <> b.key").select("a", "b")


def first_buckets(members: DataFrame, total: int) -> DataFrame:
    """``(s, a, size)``: the ``members`` ``(s, a)`` of those buckets that can bring two sets together for the first time.

    Of buckets that hold the same members only the first in the common order stays, as each member has more items from there on than from any
    other of them. ``a`` has in ``top`` the first ``FIRST`` buckets that its set still has, in order.
    """
    key = F.col("a.key")
    marks = F.bit_xor(F.xxhash64(key)).alias("p"), F.bit_xor(F.xxhash64(key, F.lit(1))).alias("q")
    buckets = members.groupBy("s").agg(F.count("*").alias("n"), F.sum("a.rem").alias("rem"), *marks).filter("n > 1")
    firsts = buckets.groupBy("n", "p", "q").agg(F.max(F.struct("rem", "s")).alias("first")).select("first.s", "n", F.col("n").alias("size"))
    order = Window.partitionBy(key).orderBy(F.desc("a.rem"), F.desc("s")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    top = F.slice(F.collect_list("s").over(order), 1, FIRST)
    held = join_facts(members, firsts, "s", total, F.xxhash64(key)).withColumn("top", top)
    return held.select("s", F.struct("a.key", "a.n", "a.w", "a.rem", "top").alias("a"), "size")


def across(members: DataFrame, components: DataFrame, total: int, least: Callable, similarity: float) -> DataFrame:
    """``(x, y)``: the members ``(s, a)`` of a bucket that are in different ``(key, component)``, and can be ``similarity`` alike.

    Members hold as ``rem`` how many items they have from ``s`` on in the common order. The first item that two sets share is followed by no more
    common ones than that, so that pairs come out of a bucket only if both have the ``least(a, b)`` number of items from there on. Texts
    of a family whose edits are all their own have none, as their own items come first. Two sets leave only the first bucket that they share, as far as both ``top`` tell it.
    """
    keyed = members.withColumn("node", F.col("a.key")).join(components, "node", "left")
    now = materialize(keyed.select("s", "a", F.coalesce("component", "node").alias("c")), "coloured")
    mixed = now.groupBy("s").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n")).filter("lo <> hi").select("s", "n")
    now = materialize(join_facts(now, mixed.withColumn("_mixed", F.lit(True)), "s", total, F.xxhash64("a.key")).select("s", "a", "c"), "unsettled")
    others = now.select(F.col("s").alias("t"), F.col("a").alias("b"), F.col("c").alias("d"))
    a, b = F.col("a"), F.col("b")
    can = (a["key"] < b["key"]) & (F.col("c") != F.col("d")) & (F.least(a["n"], b["n"]) >= similarity * F.greatest(a["n"], b["n"]) - 1e-9)
    can = can & (F.least(a["rem"], b["rem"]) >= least(a, b, similarity))
    # a bucket that both have among their first ones has all that they share before it there, too
    first = F.coalesce(F.get(F.array_intersect(a["top"], b["top"]), F.lit(0)), F.col("s")) == F.col("s")
    both = now.join(others, (F.col("s") == F.col("t")) & can & first)
    return both.select(a["key"].alias("x"), b["key"].alias("y")).distinct()


def settled(members: DataFrame, groups: DataFrame, done: DataFrame, least: Callable, similarity: float, verified: Callable) -> DataFrame:
    """``groups``, ``(node, component)``, with all links among ``members`` that pairs of ``done`` have not shown; ``verified`` gives the links of pairs.

    Whoever is close to a text shares its rarer items, too: small buckets come first, whose pairs are no more than ``SMALL`` for each row, and then the others,
    with what is still in different components. A small bucket has nothing left by then, as all its pairs have been looked at.
    """
    members = materialize(first_buckets(members, members.count()), "buckets")
    for small in (True, False):
        part = members.filter((F.col("size") <= SMALL) == F.lit(small))
        more = across(part, groups, part.count(), least, similarity).join(done, ["x", "y"], "left_anti")
        more = materialize(more, "candidates")
        if not more.isEmpty():
            groups = joined_components(groups, verified(more), "x", "y")
            done = done.select("x", "y").unionByName(more)
    return groups


def _ball_pairs(sketched: DataFrame, radius: int) -> DataFrame:
    """``(x, y)``: texts whose fingerprints collide, each fingerprint's texts as a star on the least, and colliding ones by those."""
    values = sketched.filter("n > 0").groupBy("v").agg(F.min("key").alias("x"), F.max("key").alias("last"), F.count("*").alias("n"))
    values = materialize(values, "fingerprints")
    shared = sketched.select("v", "key").join(values.filter("x <> last").select("v", "x"), "v").filter("key <> x")
    links = ball_links(values, radius)
    firsts = values.select("v", "x")
    across = links.join(firsts.withColumnsRenamed({"v": "a", "x": "p"}), "a").join(firsts.withColumnsRenamed({"v": "b", "x": "q"}), "b")
    return shared.select("x", F.col("key").alias("y")).unionByName(across.select(F.col("p").alias("x"), F.col("q").alias("y")))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, radius: int = 2) -> DataFrame:
    """``(text_key, component)`` of the texts that have a near-duplicate: shingle sets with a Jaccard of ``similarity``.

    Candidates are the pairs whose SimHash fingerprints collide in ball hashing, and, as fingerprints within ``radius`` bits
    miss pairs, those of a second way that misses none: two sets so alike share one of their first shingles in a common
    order (prefix filter), and meet in its bucket. First a bucket's members are compared with one of them only, which joins most large
    groups; then pairs of a bucket in different components are, as a text that is unlike its hub may be like others.
    All candidates are verified on the exact sets of ``width``-word shingles. ``text_key`` is the XXH64 of
    the text (nulls count as empty); equal texts are one node, and texts of no words are only equal to each other.
    """
    spark = docs.sparkSession
    release(spark)
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).select(F.xxhash64("text").alias("key"), "text")
    firsts = materialize(sketched(texts, width, similarity), "sketched")
    met = materialize(shared_shingles(firsts), "met")
    members = met.select("s", F.struct((F.col("own").cast("double") / F.col("n")).alias("deal"), "key", "n", "w", "rem").alias("a"))
    hubs = shared_enough(with_hubs(members, met.count()), similarity)
    ball = _ball_pairs(firsts, radius).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    pairs = materialize(hubs.unionByName(ball).distinct(), "candidates")
    release(spark)

    def verified(asked: DataFrame) -> DataFrame:
        return materialize(alike(asked, _sets(texts, asked, width), similarity), "links")

    groups = materialize(connected_components(verified(pairs), "x", "y"), "components")
    release(spark)
    groups = settled(members, groups, pairs, needed, similarity, verified)
    release(spark)
    return groups.select(F.col("node").alias("text_key"), "component")


def _sets(texts: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """``(key, set)`` of the texts in pairs ``(x, y)``. A filter of their keys spares most others, and lets few pass."""
    wanted = pairs.select(F.explode(F.array("x", "y")).alias("key")).distinct()
    bits = texts.sparkSession.sparkContext.broadcast(bloom.build(wanted, "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingled = Shingler(width)
        for batch in batches:
            asked = np.flatnonzero(bloom.passes(batch.column(0).to_numpy().view(np.uint64), bits.value)).tolist()
            rows = ((batch.column(0)[k].as_py(), shingled(batch.column(1)[k].as_py())) for k in asked)
            yield from batches_of(rows, ["key", "set"], [pa.int64(), pa.list_(pa.int64())])

    return materialize(texts.mapInArrow(run, "key long, set array<long>").dropDuplicates(["key"]), "sets")


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The written pairs ``(x, y)`` whose ``sets`` have a Jaccard of ``similarity``. Only the sets in pairs are dealt out.

    A set that is in many pairs, as a hub is, goes to several tasks, each with ``HOT_ROWS`` of its pairs or so.
    """
    total, part = pairs.count(), round(similarity * 1_000_000)
    dealt, copies = pairs, {}
    for c, other in (("x", "y"), ("y", "x")):
        counts = pairs.groupBy(F.col(c).alias("key")).agg(F.count("*").alias("n")).withColumn("copies", F.ceil(F.col("n") / HOT_ROWS))
        copies[c] = materialize(counts, "pairs-of-sets")
        dealt = join_facts(dealt.withColumn("key", F.col(c)), copies[c], "key", total, F.xxhash64(other)).drop("key")
        dealt = dealt.withColumn(f"{c}_copy", F.pmod(F.xxhash64(other), F.col("copies"))).drop("copies")

    def side(c: str, name: str) -> DataFrame:
        numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
        return sets.join(copies[c], "key").select(F.col("key").alias(c), F.col("set").alias(name), numbers.alias(f"{c}_copy"))

    both = dealt.join(side("y", "t"), ["y", "y_copy"]).join(side("x", "s"), ["x", "x_copy"])
    common = F.size(F.array_intersect("s", "t")).cast("long")
    return both.filter(common * 1_000_000 >= part * (F.size("s") + F.size("t") - common)).select("x", "y")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each group of equal or near-equal texts is kept.

    The least ``doc_id`` of a group stays, null ids last, with its columns as they were; a repeated row stays once.
    """
    groups = similar_groups(docs, **options)
    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("k")
    rows = docs.select(F.col("doc_id").alias("d"), key)
    tops = rows.groupBy("k").agg(F.min("d").alias("least")).join(groups.withColumnRenamed("text_key", "k"), "k", "left")
    tops = tops.select("k", "least", F.coalesce("component", "k").alias("g"))
    # of each group the text that holds the least id, and of texts with the same id the one with the least key
    best = tops.groupBy("g").agg(F.min(F.struct(F.col("least").isNull().alias("no"), "least", "k")).alias("b")).select(F.col("b.least").alias("least"), F.col("b.k").alias("k"))
    names = docs.columns
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("r"), F.col("doc_id").alias("d"), key)
    kept = left.join(best.withColumnRenamed("k", "bk"), (F.col("k") == F.col("bk")) & F.col("d").eqNullSafe(F.col("least")), "left_semi")
    return kept.dropDuplicates(["k"]).select("r.*")
