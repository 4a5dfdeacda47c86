"""Sharding by balanced label propagation, with DataFrame functions only.

Documents that share a link key are neighbours. Starting from hashed shards, every round tallies each key's members by
shard, lets each linked document ask for the shard where most of its neighbours are, and grants moves within
capacity quotas. Documents without links fill the room that is left, so that shard counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from harvestry.plans.skew import join_facts
from harvestry.sources.shared import materialize

SHARDS, ROUNDS = 16, 12
#: Part of its capacity from which on a shard is full: only rows that it holds may ask for it.
FULL = 0.98


def ranked(df: DataFrame, group: list[str], coarse: Column, fine: Column, order: list, name: str) -> DataFrame:
    """``df`` with the 0-based place of each row in its group, in the order of ``coarse``, ``fine``, then ``order``.

    Rows are sorted within fine cells only. Cells are counted, and running sums of the counts, first of the fine cells in
    each coarse one, then of the coarse ones, give each cell its start: no task sorts more than the cells of one kind.
    """
    df = df.withColumn("_coarse", coarse).withColumn("_fine", fine)
    outer, keys = [*group, "_coarse"], [*group, "_coarse", "_fine"]

    def before(part: list[str], by: str) -> Column:
        return F.coalesce(F.sum("_n").over(Window.partitionBy(*part).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    first = counts.groupBy(*outer).agg(F.sum("_n").alias("_n")).select(*outer, before(group, "_coarse").alias("_first"))
    starts = counts.select(*keys, before(outer, "_fine").alias("_before")).join(first, outer)
    within = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.join(starts, keys).withColumn(name, F.col("_first") + F.col("_before") + within - 1).drop("_coarse", "_fine", "_first", "_before")


def quotas(wanted: list[list[int]], load: list[int], cap: list[int]) -> list[list[float]]:
    """The part of the moves from shard ``s`` to ``t`` that may be granted so that no shard grows over its capacity.

    A shard that is already over it only must not grow. Starts from all moves and cuts the inflow of shards that
    would be too full, which keeps rows in others, until all fit.
    """
    n = len(load)
    given = [[float(x) if s != t else 0.0 for t, x in enumerate(row)] for s, row in enumerate(wanted)]
    for _ in range(1000):
        fits = True
        for t in range(n):
            inflow, outflow = sum(given[s][t] for s in range(n)), sum(given[t])
            room = max(cap[t] - load[t], 0) + outflow
            if inflow > room + 1e-6:
                fits = False
                for s in range(n):
                    given[s][t] *= room / inflow
        if fits:
            break
    return [[given[s][t] / wanted[s][t] if wanted[s][t] else 0.0 for t in range(n)] for s in range(n)]


def propagate(links: DataFrame, cap: list[int], rounds: int = ROUNDS) -> DataFrame:
    """``(rid, shard)`` of linked rows after label propagation. ``links`` has a row ``(rid, key)`` per row and key.

    ``cap`` is the most linked rows that each shard may take; neighbours of a full one gather in the next best. All that reaches the driver are tables of
    shards by shards. Ties go to shards with room, and else are broken alike for all rows of a key.
    """
    n = len(cap)
    shards = range(n)
    state = links.select("rid", "key", F.pmod(F.xxhash64("rid"), F.lit(n)).cast("int").alias("shard"))
    state = materialize(state, "labels")
    total = state.count()
    for at in range(rounds):
        tally = state.groupBy("key").agg(*[F.count_if(F.col("shard") == k).alias(f"c{k}") for k in shards], F.count("*").alias("n"))
        seen = join_facts(state, tally, "key", total, F.xxhash64("rid")).groupBy("rid").agg(
            F.min("shard").alias("shard"), F.min("key").alias("salt"), *[F.sum(f"c{k}").alias(f"c{k}") for k in shards]
        )
        held = {r.shard: r.n for r in state.groupBy("shard").agg(F.count_distinct("rid").alias("n")).collect()}
        open_ = [F.lit(held.get(k, 0) < FULL * cap[k]) for k in shards]
        choices = [
            F.struct(
                F.when(open_[k] | (F.col("shard") == k), F.col(f"c{k}")).otherwise(-1).alias("n"), open_[k].alias("open"),
                (-F.pmod(F.lit(k) - F.xxhash64("salt"), F.lit(n))).alias("tie"), F.lit(k).alias("k")
            ) for k in shards
        ]
        wish = materialize(seen.select("rid", "shard", F.array_max(F.array(*choices))["k"].alias("to")), "wishes")
        flows = wish.groupBy("shard", "to").agg(F.count("*").alias("n")).collect()
        wanted = [[0] * n for _ in shards]
        for r in flows:
            wanted[r.shard][r.to] = r.n
        load = [sum(row) for row in wanted]
        if not sum(x for s, row in enumerate(wanted) for t, x in enumerate(row) if s != t):
            break
        part = F.array(*[F.lit(float(x)) for row in quotas(wanted, load, cap) for x in row])
        dice = F.pmod(F.xxhash64("rid", F.lit(at)), F.lit(1 << 20)) / float(1 << 20)
        granted = (F.col("to") != F.col("shard")) & (dice < F.get(part, F.col("shard") * n + F.col("to")))
        moved = wish.select("rid", F.when(granted, F.col("to")).otherwise(F.col("shard")).alias("shard"))
        state = materialize(state.select("rid", "key").join(moved, "rid").select("rid", "key", "shard"), "labels")
    return state.groupBy("rid").agg(F.min("shard").alias("shard"), F.min("key").alias("key"))


def balanced_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``(id, size, text_crc32, shard, slot)`` for every row: equal texts are linked, counts differ by one at most.

    ``size`` is the UTF-8 length and 1, the checksum is that of the UTF-8 text; null texts count as empty and
    are equal to empty ones. ``slot`` numbers the rows of a shard from 0. A group of equal texts stays together unless it, or what
    has gathered with it, exceeds a shard; what is over goes on as one stretch to where there is room. Repeated rows
    each have a slot; null ids are placed like others.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.xxhash64(text).alias("key")
    )
    rows = materialize(rows.withColumn("rid", F.monotonically_increasing_id()), "rows")
    total = rows.count()
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key", "n", F.lit(True).alias("linked"))
    rows = materialize(join_facts(rows, shared, "key", total, F.xxhash64("rid"), "left").withColumn("linked", F.coalesce("linked", F.lit(False))), "rows")
    quota = [total // shards + (k < total % shards) for k in range(shards)]
    side = max(1, round(total ** (1 / 3)))
    # cells keep the rows of a group near each other, and part even the largest group
    coarse, fine = F.pmod(F.xxhash64("key"), F.lit(side)), F.pmod(F.xxhash64("rid"), F.lit(side))
    limit = F.get(F.array(*[F.lit(q) for q in quota]), F.col("shard"))
    labels = propagate(rows.filter("linked").select("rid", "key"), quota, rounds)
    placed = materialize(ranked(labels, ["shard"], coarse, fine, ["key", "rid"], "place").withColumn("fits", F.col("place") < limit), "placed")
    stay = placed.filter("fits").select("rid", "shard")
    taken = {r.shard: r.n for r in stay.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    spare = placed.filter("not fits").select("rid", "key", F.lit(0).alias("later"))
    spare = spare.unionByName(rows.filter("not linked").select("rid", "key", F.lit(1).alias("later")))
    spare = ranked(spare, [], F.col("later") * side + coarse, fine, ["key", "rid"], "place")
    ends, end = [], 0
    for k in range(shards):
        end += quota[k] - taken.get(k, 0)
        ends.append(end)
    filled = spare.select("rid", F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= F.col("place"))).alias("shard"))
    whole = materialize(rows.join(stay.unionByName(filled), "rid").select("rid", "key", "id", "size", "text_crc32", F.col("shard").cast("int").alias("shard")), "shards")
    return ranked(whole, ["shard"], coarse, fine, ["key", "rid"], "slot").select("id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))
