"""Near-duplicates by SuperMinHash signatures, banding, verification on whole sets, and union-find grouping.

Every element of a set gets one random permutation of the places of a signature, and rank ``r`` goes to the place that
the permutation has at ``r``: the ranks of an element are correlated, which gives a lower variance than independent ones, and an element stops
early, as soon as its next rank can't be less than any that the signature has. Two sets agree in a place with the
probability of their Jaccard likeness. Places are cut into bands, and sets that agree in a whole band are candidates.

With 32 bands of 4 places, sets of likeness 0.85 agree in no band with a probability of 6e-11. Candidates are first those of
a bucket with its hub, the set that meets most others. Buckets that this leaves with several components are not taken pair by pair, which of a family of
texts just below the likeness would be all pairs: their sets meet again by their first shingles in a common order, rare ones first, which
misses no pair and keeps apart what differs in shingles of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestry.llm import bloom
from harvestry.llm.simhash import Shingler, alike, batches_of, needed, settled, shared_shingles, sketched
from harvestry.plans.components import connected_components
from harvestry.plans.skew import join_facts
from harvestry.sources.shared import materialize

#: Bands of a signature and places of a band.
BANDS, ROWS = 32, 4
#: Elements of sets that are ranked at a time.
ELEMENTS = 1 << 14
_GOLDEN, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_NEVER = np.uint64(2**64 - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _rank(elements: np.ndarray, sets: np.ndarray, signatures: np.ndarray) -> None:
    """Take ``elements`` of ``sets`` into the signatures, which lie in rows."""
    size = signatures.shape[1]
    flat, last = signatures.reshape(-1), signatures.max(axis=1)
    places = np.broadcast_to(np.arange(size, dtype=np.uint8), (len(elements), size)).copy()
    at = np.arange(len(elements))
    for rank in range(size):
        going = (last[sets[at]] >> np.uint64(48)) >= np.uint64(rank)  # others have only smaller ranks
        if not going.all():
            at = at[going]
            if not len(at):
                return
        drawn = _mixed(elements[at] + np.uint64(int(_GOLDEN) * (rank + 1) % 2**64))
        other = rank + ((drawn & np.uint64(0xFFFF)) * np.uint64(size - rank) >> np.uint64(16)).astype(np.int64)
        place = places[at, other]
        places[at, other] = places[at, rank]
        np.minimum.at(flat, sets[at] * size + place, (drawn >> np.uint64(16)) | np.uint64(rank << 48))
        open_ = np.unique(sets[at])
        last[open_] = signatures[open_].max(axis=1)


def signatures_of(sets: list[np.ndarray], size: int = BANDS * ROWS) -> np.ndarray:
    """The SuperMinHash signatures of sets of 64-bit hashes, one row for each; an empty set has the largest values everywhere.

    A value is the rank and, below it, 48 random bits. ``size`` is 256 at most.
    """
    found = np.full((len(sets), size), _NEVER)
    held, number, room = [], [], ELEMENTS

    def rank() -> None:
        if held:
            _rank(np.concatenate(held), np.concatenate(number), found)
            held.clear()
            number.clear()

    for k, own in enumerate(sets):
        own = own.view(np.uint64)
        for start in range(0, len(own), ELEMENTS):
            part = own[start : start + ELEMENTS]
            if len(part) > room:
                rank()
                room = ELEMENTS
            held.append(part)
            number.append(np.full(len(part), k))
            room -= len(part)
    rank()
    return found


def band_hashes(signatures: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One hash for each band of each signature; those of different bands are unlike."""
    cut = signatures.reshape(len(signatures), bands, -1)
    found = np.broadcast_to(_mixed(np.arange(1, bands + 1, dtype=np.uint64)), cut.shape[:2]).copy()
    for k in range(cut.shape[2]):
        found = _mixed(found * _GOLDEN + cut[:, :, k])
    return found.view(np.int64)


def signed(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``(id, row_key, set_key, n, bands)`` of every row: its shingle set by 128 bits, its number of shingles and its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingled = Shingler(width)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                held, room, start = [], 1 << 20, 0
                for k, text in enumerate(part.column(2)):
                    held.append(shingled(text.as_py()))
                    room -= len(held[-1])
                    if room < 0 or k + 1 == part.num_rows:
                        yield told(part.slice(start, len(held)), held)
                        held, room, start = [], 1 << 20, k + 1

    def told(part: pa.RecordBatch, sets: list[np.ndarray]) -> pa.RecordBatch:
        keys = [xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets]
        bands = band_hashes(signatures_of(sets))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS), pa.int32()), pa.array(bands.ravel()))
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(keys), pa.array([len(s) for s in sets], pa.int64()), lists], names=["id", "row_key", "set_key", "n", "bands"])

    return rows_of(docs, id_col, text_col).mapInArrow(run, "id long, row_key long, set_key string, n long, bands array<long>")


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col).cast("long"), text).alias("row_key"), text.alias("text"))


def _sets(rows: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``(key, set)`` of the sets in ``wanted``, ``(key, row_key, set_key)``; a filter of the keys of their rows spares the texts of most others."""
    bits = rows.sparkSession.sparkContext.broadcast(bloom.build(wanted, "row_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingled = Shingler(width)
        for batch in batches:
            asked = np.flatnonzero(bloom.passes(batch.column(0).to_numpy().view(np.uint64), bits.value)).tolist()
            own = (shingled(batch.column(1)[k].as_py()) for k in asked)
            yield from batches_of(((xxhash.xxh3_128_hexdigest(s.tobytes()), s) for s in own), ["set_key", "set"], [pa.string(), pa.list_(pa.int64())])

    made = rows.select("row_key", "text").mapInArrow(run, "set_key string, set array<long>")
    return materialize(made.join(wanted.select("set_key", "key"), "set_key").dropDuplicates(["key"]).select("key", "set"), "sets")


def _links(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame:
    asked = pairs.select(F.explode(F.array("x", "y")).alias("key")).distinct()
    wanted = materialize(nodes.select("key", "row_key", "set_key").join(asked, "key"), "wanted")
    return materialize(alike(pairs, _sets(rows, wanted, width), percent / 100), "links")


def _hub_pairs(met: DataFrame) -> DataFrame:
    """``(x, y)``: the members ``(band, key, many)`` of each bucket with its hub, which has the highest score of how many others it meets."""
    scores = met.groupBy("key").agg(F.sum(F.log2("many")).alias("score"))
    scored = materialize(met.join(scores, "key"), "scored")
    hubs = scored.groupBy("band").agg(F.max(F.struct("score", "key")).alias("top"), F.count("*").alias("n")).select("band", F.col("top.key").alias("hub"), "n")
    both = join_facts(scored, hubs, "band", scored.count(), F.xxhash64("key")).filter("key <> hub")
    return both.select(F.least("key", "hub").alias("x"), F.greatest("key", "hub").alias("y")).distinct()


def _unsettled(met: DataFrame, components: DataFrame, total: int) -> DataFrame:
    """``(key)``: the members of buckets that hold more than one component."""
    now = materialize(met.join(components, "key", "left").select("band", "key", F.coalesce("c", "key").alias("c")), "coloured")
    mixed = now.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n")).filter("lo <> hi")
    return join_facts(now, mixed.select("band", "n"), "band", total, F.xxhash64("key")).select("key").distinct()


def _texts_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(key, text)`` of the rows whose key is in ``wanted``, by a filter that lets few others pass."""
    bits = rows.sparkSession.sparkContext.broadcast(bloom.build(wanted, "row_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bloom.passes(batch.column(0).to_numpy().view(np.uint64), bits.value)))

    return materialize(rows.select(F.col("row_key").alias("key"), "text").mapInArrow(run, "key long, text string"), "texts")


def _members(rows: DataFrame, unsettled: DataFrame, width: int, percent: int) -> DataFrame:
    """``(s, a)``: the first shingles that the sets ``(key, row_key)`` share with others of them, for :func:`settled`."""
    met = shared_shingles(materialize(sketched(_texts_of(rows, unsettled), width, percent / 100), "sketched"))
    named = met.withColumnRenamed("key", "row_key").join(unsettled.select("row_key", "key"), "row_key")
    return materialize(named.select("s", F.struct("key", "n", "w", "rem").alias("a")), "members")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 85) -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` for every row of ``docs``; rows are linked if their shingle sets have a Jaccard of ``percent`` / 100.

    A-Z are lower-cased, words are what stands between ASCII white space, and a set holds the distinct runs of ``width`` words, or of fewer words
    the whole sequence. Null texts and texts without words have empty sets and are linked with nothing. ``component_id`` is the least id reachable
    over links, the row's own included; ``kept`` says whether that is the row's id. All links are confirmed on whole sets, of which equal ones
    are one node, however many rows have them. Null ids keep their rows and name no component unless all its ids are null. See above for how
    sure it is that a link is found.
    """
    rows = rows_of(docs, id_col, text_col)
    marks = materialize(signed(docs, id_col, text_col, width), "signed")
    nodes = marks.filter("n > 0").groupBy("set_key").agg(
        F.min("id").alias("least"), F.min(F.struct("id", "row_key")).alias("row"), F.first("bands").alias("bands"), F.count("*").alias("rows")
    )
    # once the table is written, the numbers stay
    nodes = materialize(nodes.select(F.monotonically_increasing_id().alias("key"), "set_key", "least", "row.row_key", "bands", "rows"), "sets-with-copies")
    flat = nodes.select("key", F.explode("bands").alias("band"))
    shared = flat.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band", "n", F.col("n").alias("many"))
    met = materialize(join_facts(flat, shared, "band", nodes.count() * BANDS, F.xxhash64("key")), "met")
    total = met.count()
    first = materialize(_hub_pairs(met), "candidates")
    links = _links(first, nodes, rows, width, percent)
    groups = materialize(connected_components(links, "x", "y"), "components")
    components = groups.select(F.col("node").alias("key"), F.col("component").alias("c"))
    rest = materialize(_unsettled(met.select("band", "key"), components, total).join(nodes.select("key", "row_key"), "key"), "unsettled")
    groups = settled(_members(rows, rest, width, percent), groups, first, needed, percent / 100, lambda more: _links(more, nodes, rows, width, percent))
    components = groups.select(F.col("node").alias("key"), "component")
    named = nodes.select("key", "set_key", "least", "rows").join(components, "key", "left")
    named = materialize(named.select("set_key", "least", "rows", F.coalesce("component", "key").alias("c")), "named")
    tops = named.groupBy("c").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    named = join_facts(named, tops, "c", named.count(), F.xxhash64("set_key"), count="size").select("set_key", "component_id", F.col("rows").alias("n"))
    marks = marks.select("id", "set_key", F.col("n").alias("n_shingles"))
    done = join_facts(marks, materialize(named, "classes"), "set_key", marks.count(), F.xxhash64("id").cast("string"), "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    return done.select("id", "n_shingles", own.alias("component_id"), F.col("id").eqNullSafe(own).alias("kept"))
