"""Entity resolution: blocking joins find what may merge, components part it, and an ordered assignment decides.

Records can only merge if they share an email, a phone or a host, or have nearly the same name. Those links are
laid as stars on each key's first record, so a hot key costs one link per record. What a record has to say in a decision is
worked out in columns; the records of a component then stream by in order, and each joins the first cluster that takes it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from harvestry.functions import urls as U
from harvestry.functions.helpers import name_ratio
from harvestry.functions.scoring import present
from harvestry.plans.components import connected_components
from harvestry.plans.skew import join_facts, ranked_within
from harvestry.sources.shared import materialize

SAME_HOST, SAME_NAME, BUMP = 0.72, 0.94, 0.05
#: Characters of the pieces by which names are matched.
GRAM = 3
#: Names from which on a piece is common.
COMMON = 20
#: Rows that leave a task at a time.
FLUSH = 5000
ARRAYS = ("emails", "phone_numbers", "addresses", "socials")
RECORD = (
    "company_name string, business_name string, listing_name string, container_path string, email string, emails array<string>, "
    "phone string, phone_numbers array<string>, address string, addresses array<string>, website string, socials array<string>, "
    "source_url string, extraction_scope string, confidence double"
)
NAMES = tuple(c.split()[0] for c in RECORD.split(", "))
#: What a cluster takes over from a record where it has nothing yet.
FILLED = tuple(c for c in NAMES if c not in ARRAYS and c not in ("container_path", "extraction_scope", "confidence"))


def key_links(records: DataFrame) -> DataFrame:
    """``(a, b)``: every record with an email, a phone or a host to the first of its scope with the same one."""
    keys = [F.when(present(F.col(c)), F.xxhash64("scope", F.lit(c), F.col(c))) for c in ("email", "phone")]
    keys.append(F.when(F.col("host").isNotNull(), F.xxhash64("scope", F.lit("host"), "host")))
    flat = records.select(F.explode(F.array(*keys)).alias("k"), F.col("eid").alias("b")).filter("k is not null")
    first = flat.groupBy("k").agg(F.min("b").alias("a"), F.count("*").alias("n")).filter("n > 1")
    return join_facts(flat, first, "k", 3 * records.count(), F.col("b")).filter("a <> b").select("a", "b")


def _slack(length: Column, least: float) -> Column:
    """How many characters of a name may have no partner in one that is ``least`` alike, whatever the length of that."""
    return F.floor(length * ((1 - least) * (1 + (2 - least) / least)) + 1e-9).cast("int")


def named(records: DataFrame) -> DataFrame:
    """``(eid, scope, name, k)``: records with a name, in lower case, and a key of scope and name."""
    rows = records.select("eid", "scope", F.lower("company_name").alias("name")).filter("name <> ''")
    return rows.withColumn("k", F.xxhash64("scope", "name"))


def equal_names(records: DataFrame) -> DataFrame:
    """``(a, b)``: every named record to the first of its scope with the same name, ``a`` and ``b`` being one for that record itself."""
    rows = named(records)
    first = rows.groupBy("k").agg(F.min("eid").alias("a"), F.count("*").alias("n"))
    return join_facts(rows, first, "k", records.count(), F.col("eid")).select("a", F.col("eid").alias("b"))


def _apart(sizes: tuple[Column, Column], least: float) -> tuple[Column, Column]:
    """How many characters without a partner two names of these sizes may have in all, and by how many they differ at least."""
    return F.floor((1 - least) * (sizes[0] + sizes[1]) + 1e-9).cast("int"), F.abs(sizes[0] - sizes[1])


def _one_off(sizes: tuple[Column, Column], least: float) -> Column:
    """Whether names of these sizes can be alike, and only if no more than one character of either has no partner."""
    most, differ = _apart(sizes, least)
    return (differ <= most) & (most + differ < 4)


def _far_off(sizes: tuple[Column, Column], least: float) -> Column:
    """Whether names of these sizes can be alike with two characters or more of the longer without a partner."""
    most, differ = _apart(sizes, least)
    return (differ <= most) & (most + differ >= 4)


def _without(name: Column, at: Column) -> Column:
    """What is left of a name without its character at a place from 1; all of it at 0."""
    return F.concat(F.substring(name, F.lit(1), at - 1), F.substring(name, at + 1, F.length(name)))


def _places(name: Column) -> Column:
    """0 and the places of a name that leave different rests: of equal characters in a row, the first."""
    return F.filter(F.sequence(F.lit(0), F.length(name)), lambda i: (i < 2) | (F.substring(name, i, F.lit(1)) != F.substring(name, i - 1, F.lit(1))))


def _met_shortened(names: DataFrame, least: float) -> DataFrame:
    """``(a, b, p, q)`` of the names ``(scope, eid, name)`` of a scope that are alike but for one character of either: they meet in what is left.

    Names that meet in the same rest are alike themselves, so that what all of a scope's names begin with makes no pairs. Two names have at most two
    rests in common, and two only if what differs alternates in both, as in ``xy`` and ``yx``; of these the pair leaves the one in which the earlier lacks the first place.
    """
    size = F.length("name")
    short = names.filter(_one_off((size, size), least) | _one_off((size, size + 1), least))
    keys = short.select("scope", "eid", "name", F.explode(_places(F.col("name"))).alias("at"))
    keys = keys.withColumn("g", F.xxhash64("scope", _without(F.col("name"), F.col("at"))))
    left, right = (keys.select("g", *[F.col(c).alias(f"{c}_{s}") for c in ("scope", "eid", "name", "at")]) for s in "ab")
    p, q, i, j = F.col("name_a"), F.col("name_b"), F.col("at_a"), F.col("at_b")
    same = (left["g"] == right["g"]) & (F.col("scope_a") == F.col("scope_b")) & (_without(p, i) == _without(q, j))
    # sizes as the planner guesses them know nothing of the keys of a name, so that it would send all keys to all tasks
    met = left.hint("merge").join(right, (F.col("eid_a") < F.col("eid_b")) & same & _one_off((F.length(p), F.length(q)), least))
    rests = F.transform(_places(p), lambda k: _without(p, k)), F.transform(_places(q), lambda k: _without(q, k))
    once = (i <= j) | (F.substring(p, i, F.lit(1)) != F.substring(q, i - 1, F.lit(1))) | (F.size(F.array_intersect(*rests)) == 1)
    return met.filter(once).select(F.col("eid_a").alias("a"), F.col("eid_b").alias("b"), p.alias("p"), q.alias("q"))


def _met_pieces(rare: DataFrame, least: float) -> DataFrame:
    """``(a, b)`` of the names that meet in their rarest pieces ``(eid, d, size, place, g, df, at)``, of which each has ``GRAM * d + 2`` if it is long enough.

    Two long names share two of those. A piece of more than ``COMMON`` names is so no place to meet for them, but any two such pieces are; names of
    fewer pieces, that may share one only, meet in it alone. What is shared stands at most as far apart as there are characters without a partner,
    and lengths differ by no more than the ratio allows. Lengths of which :func:`_met_shortened` has all pairs are left to that.
    """
    short = F.col("size") - GRAM + 1 < GRAM * F.col("d") + 2
    fit = rare.filter(F.col("df") > 1)
    single = fit.filter((F.col("df") <= COMMON) | short).select("g", "eid", "d", "size", "place")
    common = fit.filter(F.col("df") > COMMON).groupBy("eid").agg(F.array_sort(F.collect_list("g")).alias("gs"), F.first("d").alias("d"), F.first("size").alias("size"))
    pairs = common.select("eid", "d", "size", F.posexplode("gs").alias("k", "one"), "gs")
    pairs = pairs.select("eid", "d", "size", "one", F.explode(F.slice("gs", F.col("k") + 2, F.size("gs"))).alias("two"))
    double = pairs.select(F.xxhash64("one", "two").alias("g"), "eid", "d", "size", F.lit(None).cast("int").alias("place"))
    both = single.unionByName(double)
    left, right = (both.select("g", *[F.col(c).alias(f"{c}_{s}") for c in ("eid", "d", "size", "place")]) for s in "ab")
    near = F.coalesce(F.abs(F.col("place_a") - F.col("place_b")) <= F.greatest("d_a", "d_b"), F.lit(True))
    met = left.join(right, (left["g"] == right["g"]) & (F.col("eid_a") < F.col("eid_b")) & near & _far_off((F.col("size_a"), F.col("size_b")), least))
    return met.select(F.col("eid_a").alias("a"), F.col("eid_b").alias("b")).distinct()


def _far_names(names: DataFrame, least: float) -> DataFrame:
    """The names ``(scope, eid, name)`` whose scope has one of a length that :func:`_met_shortened` can't bring them together with."""
    size, scope = F.length("name"), F.xxhash64("scope")
    lengths = names.groupBy(scope.alias("k")).agg(F.collect_set(size).alias("sizes"), F.count("*").alias("n"))
    told = join_facts(names.withColumn("k", scope), lengths, "k", names.count(), F.col("eid"))
    return told.filter(F.exists("sizes", lambda other: _far_off((size, other), least))).select(*names.columns)


def _met_far(names: DataFrame, least: float) -> DataFrame:
    """``(a, b, p, q)`` of the names ``(scope, eid, name)`` of a scope that meet in their rarest pieces, where lengths allow more than one character of either without a partner."""
    size = F.length("name")
    long = materialize(_far_names(names, least).withColumn("d", _slack(size, least)), "far-names")
    places = F.sequence(F.lit(1), F.greatest(F.length("name") - GRAM + 1, F.lit(1)))
    flat = long.select("scope", "eid", "d", size.alias("size"), F.posexplode(F.transform(places, lambda i: F.substring("name", i, F.lit(GRAM)))).alias("place", "piece"))
    # the second occurrence of a piece is another piece; only of a piece that a name has once the place is told
    flat = flat.groupBy("scope", "eid", "piece").agg(F.count("*").alias("times"), F.first("d").alias("d"), F.first("size").alias("size"), F.min("place").alias("place"))
    once = F.when(F.col("times") == 1, F.col("place"))
    flat = materialize(flat.select("scope", "eid", "d", "size", once.alias("place"), F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("time"), "piece"), "pieces")
    known = F.xxhash64("scope", "piece", "time").alias("g")
    facts = flat.groupBy("scope", "piece", "time").agg(F.count("*").alias("n")).select(known, "n", F.col("n").alias("df"))
    rare = join_facts(flat.select("eid", "d", "size", "place", known), facts, "g", flat.count(), F.xxhash64("eid"))
    rare = rare.withColumn("at", F.row_number().over(Window.partitionBy("eid").orderBy("df", "g")))
    met = _met_pieces(rare.filter(F.col("at") <= GRAM * F.col("d") + 2), least)
    names = long.select("eid", "scope", "name")
    both = met.join(names.withColumnsRenamed({"eid": "a", "scope": "s", "name": "p"}), "a").join(names.withColumnsRenamed({"eid": "b", "scope": "t", "name": "q"}), "b")
    apart = f"cast(floor({1 - least} * (length(p) + length(q)) + 1e-9) as int)"
    return both.filter("s = t").filter(f"levenshtein(p, q, {apart}) >= 0").select("a", "b", "p", "q")


def _candidates(records: DataFrame, least: float) -> DataFrame:
    """``(a, b, p, q)``: pairs of different names of a scope, as their first records, the earlier first, of which all with a ratio of ``least`` or more are among them.

    Names that can only be alike if no more than one character of either has no partner meet in what is left of them without one. For the others:
    a name has a piece of ``GRAM`` characters at each place. ``d`` characters without a partner spoil ``GRAM * d`` pieces at most, so that of
    the ``GRAM * d + 1`` rarest pieces of two names they have one in common, and of one more two: names meet in those, and are cut down by their edit distance.
    """
    classes = materialize(named(records).groupBy("scope", "name").agg(F.min("eid").alias("eid")), "names")
    names = classes.filter(_slack(F.length("name"), least) > 0).select("scope", "eid", "name")
    return _met_shortened(names, least).unionByName(_met_far(names, least))


def similar_names(records: DataFrame, least: float = SAME_NAME) -> DataFrame:
    """``(a, b)`` of different names of a scope with a ratio of ``least`` or more in either order, as their first records, the earlier first."""
    return _candidates(records, least).filter(F.greatest(name_ratio("p", "q"), name_ratio("q", "p")) >= least).select("a", "b")


def name_ratios(records: DataFrame, least: float = SAME_NAME) -> DataFrame:
    """``(a, b, ratio)`` of a scope's records whose names have a ratio of ``least`` or more, the earlier to the later; equal names are a star, and their first stands for them."""
    near = _candidates(records, least).select("a", "b", name_ratio("p", "q").alias("ratio")).filter(F.col("ratio") >= least)
    return near.unionByName(equal_names(records).filter("a <> b").withColumn("ratio", F.lit(1.0)))


def name_links(records: DataFrame, least: float = SAME_NAME) -> DataFrame:
    """``(a, b)`` of a scope's records whose names are nearly the same; equal names are a star, and their first stands for them."""
    return similar_names(records, least).unionByName(equal_names(records).filter("a <> b"))


class Assignment:
    """Clusters of one component, made from its records in order.

    ``found`` tells which clusters hold an email, phone, host or name, so that a record is only weighed against those that it has
    something in common with, the oldest first.
    """

    def __init__(self):
        self.clusters: list[dict] = []
        self.found: dict[tuple, list[int]] = defaultdict(list)
        self.ratios: dict[tuple, float] = {}

    def ratio(self, a: str, b: str) -> float:
        if (a, b) not in self.ratios:
            self.ratios[a, b] = SequenceMatcher(None, a, b).ratio()
        return self.ratios[a, b]

    @staticmethod
    def keys(r: dict) -> list[tuple]:
        return [(k, r[k]) for k in ("email", "phone", "host") if r[k] or (k == "host" and r[k] is not None)]

    def takes(self, c: dict, r: dict) -> bool:
        """Whether cluster ``c`` takes record ``r``. Keys and fields that either lacks say nothing."""
        if c["listing"] and r["listing"] and c["source_url"] == r["source_url"] and c["listing"] != r["listing"]:
            return False  # two blocks of a page are two listings
        same = {k: c[k] == r[k] for k in ("email", "phone", "address") if c[k] and r[k]}
        if same.get("email") or same.get("phone"):
            return True
        foreign = c["socials"] and r["socials"] and set(c["socials"]).isdisjoint(r["socials"])
        if foreign or not all(same.get(k, True) for k in ("phone", "address")):
            return False
        bars = [SAME_HOST] if c["host"] is not None and c["host"] == r["host"] else []
        if any(sum(bool(x[k]) for k in ("email", "phone", "address", "website")) < 2 for x in (c, r)):
            bars.append(SAME_NAME)
        return bool(bars and c["low"] and r["low"]) and self.ratio(c["low"], r["low"]) >= min(bars)

    def add(self, r: dict, times: int) -> None:
        """Give the record, listed so many times, to the first cluster that takes it, or to a new one."""
        near = {k for clue in [*self.keys(r), *(("name", n) for n in r["kin"])] for k in self.found.get(clue, ())}
        at = next((k for k in sorted(near) if self.takes(self.clusters[k], r)), len(self.clusters))
        if at == len(self.clusters):
            self.clusters.append(r | {k: [] for k in ARRAYS} | {"n_merged": 0, "seen": {k: set() for k in ARRAYS}})
            times -= 1
        c = self.clusters[at]
        if not c["low"]:
            c["low"], c["class"] = r["low"], r["class"]
        for k in FILLED:
            c[k] = c[k] or r[k]
        c["host"] = r["host"] if c["host"] is None else c["host"]
        for k in ARRAYS:
            for x in r[k]:
                if (low := x.strip().lower()) and low not in c["seen"][k]:
                    c["seen"][k].add(low)
                    c[k].append(x)
        c["n_merged"] += 1
        for _ in range(times):
            c["confidence"] = round(min(1.0, max(c["confidence"], r["confidence"]) + BUMP), 3)
        for clue in [*self.keys(c), ("name", c["class"])]:
            if at not in self.found[clue][-1:]:
                self.found[clue].append(at)


def assigned(rows: DataFrame, count_hits: bool) -> DataFrame:
    """The clusters of each component of ``rows``: ``(scope, eid, <record>, n_merged)``.

    Rows stream by in the order of their component; a task holds the clusters of one component, never its records.
    """
    out = ["scope", "eid", *NAMES, "n_merged"]
    wanted = ["component", "scope", "eid", *NAMES, "host", "low", "listing", "class", "kin", "n_hits"]
    rows = rows.select(*wanted)
    schema = ", ".join([f"scope {rows.schema['scope'].dataType.simpleString()}", "eid long", RECORD, "n_merged long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, done = None, Assignment(), []

        def full() -> pa.RecordBatch:
            kinds = [batch.schema.field(c).type if c != "n_merged" else pa.int64() for c in out]
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in done], t) for c, t in zip(out, kinds)], names=out)

        batch = None
        for batch in batches:
            for r in batch.to_pylist():
                if r["component"] != now:
                    done += own.clusters
                    now, own = r["component"], Assignment()
                    if len(done) >= FLUSH:
                        yield full()
                        done = []
                r |= {k: [x for x in r[k] if x is not None] for k in ARRAYS}
                own.add(r, max(1, r["n_hits"]) if count_hits else 1)
        done += own.clusters
        if batch is not None:
            yield full()

    return rows.repartition("component").sortWithinPartitions("component", "eid").mapInArrow(run, schema)


def resolve(records: DataFrame, scope: str, count_hits: bool = True) -> DataFrame:
    """Merge the records of each ``scope``: ``(scope, eid, <record>, n_merged, place)``, best first.

    ``records`` has the record columns and ``pos``; ``n_hits``, how often a record was listed, counts as so many equal copies.
    Order is by confidence, then source URL, ``pos`` and name. Components of any size are merged. Null or empty keys link nothing; null
    arrays, and nulls in them, count as empty.
    """
    hits = F.coalesce("n_hits", F.lit(1)) if "n_hits" in records.columns else F.lit(1)
    lists = [F.coalesce(c, F.array().cast("array<string>")).alias(c) if c in ARRAYS else F.col(c) for c in NAMES]
    rows = records.select(F.col(scope).alias("scope"), *lists, "pos", hits.cast("long").alias("n_hits"))
    rows = rows.withColumn("host", F.when(F.col("website") != "", U.domain(F.col("website"))))
    # numbers that follow the order; a sort by ranges deals them out, so that no scope is gathered in one task
    rows = rows.orderBy(F.desc("confidence"), "source_url", "pos", "company_name")
    rows = materialize(rows.withColumn("eid", F.monotonically_increasing_id()), "records")
    pairs, equal = materialize(similar_names(rows), "similar-names"), materialize(equal_names(rows), "equal-names")
    links = key_links(rows).unionByName(pairs).unionByName(equal.filter("a <> b"))
    parts = connected_components(links, "a", "b").select(F.col("node").alias("eid"), "component")
    rows = rows.join(parts, "eid", "left")
    # of each record the first one with its name, and those of names like it
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    kin = both.groupBy("a").agg(F.collect_set("b").alias("kin"))
    kin = equal.groupBy("a").agg(F.count("*").alias("n")).join(kin, "a", "left")
    kin = join_facts(equal, kin, "a", rows.count(), F.col("b")).select(F.col("b").alias("eid"), F.col("a").alias("class"), "kin")
    bump = F.lit(BUMP) * (F.greatest(F.col("n_hits"), F.lit(1)) - 1) if count_hits else F.lit(0.0)
    single = rows.filter("component is null").withColumn("confidence", F.round(F.least(F.lit(1.0), F.col("confidence") + bump), 3))
    single = single.withColumn("n_merged", F.lit(1).cast("long")).select("scope", "eid", *NAMES, "n_merged")
    block = (F.col("extraction_scope") == "dom_block") & present(F.trim("container_path"))
    more = rows.filter("component is not null").join(kin, "eid", "left")
    more = more.withColumns({"low": F.coalesce(F.lower("company_name"), F.lit("")), "listing": F.when(block, F.trim("container_path")), "class": F.coalesce("class", "eid")})
    more = more.withColumn("kin", F.array_append(F.coalesce("kin", F.array().cast("array<long>")), F.col("class")))
    return ranked_within(single.unionByName(assigned(more, count_hits)), "scope", [F.desc("confidence"), F.col("eid")], "place")
