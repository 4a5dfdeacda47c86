"""SpotSigs fingerprints, with DataFrame functions only.

A signature is a common word (the anchor) and the two content words that follow it; a text's fingerprint is the set of
its signatures. Sets are compared by their Jaccard likeness; a join first parts them by length, as sets of
very different lengths can't be alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from harvestry.llm.simhash import alike, overlap, settled, shared_enough, with_hubs
from harvestry.plans.components import connected_components
from harvestry.plans.skew import join_facts
from harvestry.sources.shared import materialize

#: Common words of four languages, the anchors.
ANCHORS = (
    "the a an and of to in is was that it for with this on by are as at be or from but not have has "
    "der die das und ist ein eine von zu mit den dem des nicht sich auf für im "
    "le la les de et un une est que qui dans en du pour par sur pas au "
    "el los las y del se una es por con para su al lo"
).split()
#: Rows of a bucket, cells found by quantiles, and buckets of a cell at most, in which neighbours by id are looked up.
BUCKET_ROWS, QUANTILES, FINE = 2000, 1000, 100


def _anchor() -> str:
    return "(?:" + "|".join(sorted(set(ANCHORS))) + ")"


def normalized(text: Column) -> Column:
    """Lower-case words between single blanks, with one at either end."""
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def with_signatures(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """``df`` with the set of signatures of a text, as a sorted array of 32-bit hashes.

    A signature ends before a text does. A text without any has one for each three words in a row,
    and one of still fewer words a single one of all its words; a text of no words has none.
    """
    # every anchor is tied to what follows it, so that a part between blanks is some anchors and one content word
    tied = F.regexp_replace("_words", f"(?<= )({_anchor()}) ", "$1~")
    df = df.withColumn("_words", normalized(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    df = df.withColumn("_parts", F.filter(F.split(tied, " "), lambda p: p != ""))

    def content(part: Column) -> Column:
        return F.substring_index(part, "~", -1)

    def chains(pair: Column) -> Column:
        tail = F.concat(F.lit(" "), content(pair["p"]), F.lit(" "), content(pair["q"]))
        split = F.split(pair["p"], "~")
        return F.transform(F.array_distinct(F.slice(split, F.lit(1), F.size(split) - 1)), lambda a: F.concat(a, tail))

    pairs = F.arrays_zip(F.col("_parts").alias("p"), F.slice("_parts", F.lit(2), F.greatest(F.size("_parts"), F.lit(1))).alias("q"))
    full = F.filter(pairs, lambda z: z["p"].contains("~") & (content(F.coalesce(z["q"], F.lit(""))) != ""))
    df = df.withColumn("_spots", F.flatten(F.transform(full, chains)))
    words = F.filter(F.split("_words", " "), lambda w: w != "")
    threes = F.arrays_zip(
        words.alias("a"), F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))).alias("b"),
        F.slice(words, F.lit(3), F.greatest(F.size(words), F.lit(1))).alias("c")
    )
    threes = F.transform(F.filter(threes, lambda z: z["c"].isNotNull()), lambda z: F.concat_ws(" ", z["a"], z["b"], z["c"]))
    rest = F.when(F.length("_words") > 2, F.array("_words")).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("_spots", F.when(F.size("_spots") > 0, F.col("_spots")).otherwise(threes))
    df = df.withColumn("_spots", F.when(F.size("_spots") > 0, F.col("_spots")).otherwise(rest))
    return df.withColumn(name, F.array_sort(F.array_distinct(F.transform("_spots", lambda s: F.hash(s))))).drop("_words", "_parts", "_spots")


def as_string(signatures: Column) -> Column:
    """Eight lowercase hex digits for each signature."""
    return F.array_join(F.transform(signatures, lambda s: F.lower(F.lpad(F.hex(s.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """The Jaccard likeness of two sets; 1 for two empty ones."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, 1.0).otherwise(common / union)


def with_next(docs: DataFrame, id_col: str, columns: list[str], tie: str) -> DataFrame:
    """``docs`` with ``next_<column>`` of the next row by descending id; the last row is followed by the first.

    No task sees the whole order: ids are dealt to buckets that follow each other, by quantiles and evenly between
    them, and the first row of each bucket is copied to the end of the one before. There are ``QUANTILES * FINE`` buckets at most, so
    that what is known of them is small; a bucket is sorted on disk if it has to be. Null ids come last, equal ids in the
    order of ``tie``, descending.
    """
    ids = docs.agg(F.count("*").alias("n"), F.min(id_col).alias("least"), F.max(id_col).alias("most")).first()
    cells = max(1, min(QUANTILES, ids.n // BUCKET_ROWS))
    fine = max(1, min(FINE, ids.n // (cells * BUCKET_ROWS)))
    bounds = docs.agg(F.percentile_approx(id_col, [k / cells for k in range(1, cells)], 10 * QUANTILES)).first()[0] if cells > 1 and ids.least is not None else []
    edges = sorted({*(bounds or []), ids.most}) if ids.least is not None else []
    key = F.col(id_col)
    if edges:
        at = F.size(F.filter(F.array(*[F.lit(int(e)).cast("long") for e in edges[:-1]]), lambda e: e < key))
        low = F.get(F.array(*[F.lit(int(e)).cast("long") for e in [ids.least, *edges[:-1]]]), at)
        high = F.get(F.array(*[F.lit(int(e)).cast("long") for e in edges]), at)
        inner = F.floor((key - low).cast("double") / F.greatest(high - low, F.lit(1)).cast("double") * (fine - 1e-9)).cast("long")
        bucket = F.coalesce(-(at * fine + F.greatest(inner, F.lit(0))), F.lit(1)).cast("long")
    else:
        bucket = F.lit(1).cast("long")
    spread = docs.withColumn("_b", bucket)
    heads = docs.select(bucket.alias("_b"), F.col(id_col).alias("_i")).groupBy("_b").agg(F.max("_i").alias("_head"))
    order = Window.partitionBy(F.lit(0)).orderBy("_b")  # one row for each bucket, QUANTILES * FINE of them at most
    last = F.max("_b").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = materialize(heads.select("_b", "_head", F.coalesce(F.lag("_b").over(order), last).alias("_before")), "heads")
    spread = spread.join(F.broadcast(heads), "_b")
    copies = F.when(
        key.eqNullSafe(F.col("_head")), F.array(F.struct("_b", F.lit(0).alias("g")), F.struct(F.col("_before").alias("_b"), F.lit(1).alias("g")))
    ).otherwise(F.array(F.struct("_b", F.lit(0).alias("g"))))
    spread = spread.withColumn("_to", F.explode(copies)).select(*docs.columns, F.col("_to._b").alias("_bucket"), F.col("_to.g").alias("_copy"))
    near = Window.partitionBy("_bucket").orderBy("_copy", F.col(id_col).desc_nulls_last(), F.col(tie).desc())
    spread = spread.withColumns({f"next_{c}": F.lead(c).over(near) for c in columns})  # one window, and one shuffle
    return spread.filter("_copy = 0").drop("_bucket", "_copy")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, with likenesses: one row per row of ``docs``.

    ``(id, n_chars, edited, signatures, edited_signatures, near_edited, near_next)``. The edited text has its last
    ``floor(n_chars / 2)`` code points replaced by as many first ones of the next document by descending id, or all of
    that if it is shorter. Null texts are empty; equal texts have equal signatures.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = with_signatures(rows, "text", "signatures").withColumn("tie", F.xxhash64("text"))
    rows = with_next(rows, "id", ["text", "signatures"], "tie")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    rows = rows.select("id", n.cast("long").alias("n_chars"), "edited", "signatures", "next_signatures")
    rows = with_signatures(rows, "edited", "edited_signatures")
    near_edited, near_next = likeness(F.col("signatures"), F.col("edited_signatures")), likeness(F.col("signatures"), F.col("next_signatures"))
    return rows.select("id", "n_chars", "edited", "signatures", "edited_signatures", near_edited.alias("near_edited"), near_next.alias("near_next"))


def signature_sets(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``(members, sets)``: ``(id, set_id)`` of all rows, and ``(set_id, s)`` of the distinct sets that are not empty."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = materialize(with_signatures(rows, "text", "s").select("id", F.xxhash64("s").alias("set_id"), "s"), "signatures")
    return rows.select("id", "set_id"), materialize(rows.select("set_id", "s").filter("size(s) > 0").dropDuplicates(["set_id"]), "sets")


def rare_prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """``(key, n, pos, s, band)``: the first signatures of each set by rarity, those that no other set has left out.

    Two sets that are alike share one of their first ``n - ceil(similarity * n) + 1`` signatures, and their lengths differ by the factor
    ``similarity`` at most: sets are parted by length into geometric bands, and only meet in their own and the next band.
    ``s`` stands for a signature and a band in which the set looks for others; ``band`` is its own.
    """
    flat = materialize(sets.select(F.col("set_id").alias("key"), F.size("s").alias("n"), F.explode("s").alias("g")), "flat")
    rarity = flat.groupBy("g").agg(F.count("*").alias("count")).withColumn("df", F.col("count"))
    placed = join_facts(flat, rarity, "g", flat.count(), F.col("key"), count="count")
    placed = placed.withColumn("pos", F.row_number().over(Window.partitionBy("key").orderBy("df", "g")) - 1)
    prefix = placed.filter("df > 1").filter(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * similarity - 1e-9))
    band = F.floor(F.log("n") / F.log(F.lit(1 / similarity)) + 1e-9).cast("int")
    prefix = prefix.select("key", "n", "pos", "g", band.alias("band")).withColumn("at", F.explode(F.array("band", F.col("band") + 1)))
    return prefix.select("key", "n", "pos", F.xxhash64("g", "at").alias("s"), "band")


def similar_classes(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, set_id, class_id)`` for every row of ``docs``: sets reachable over links of ``similarity`` share the least ``id`` of their rows.

    In each bucket of a prefix signature and a band, sets are compared with one of them, that with the fewest signatures of its own;
    sets that this leaves in different classes are then compared among themselves, so that no link is lost, but a family of copies costs
    one comparison for each. Texts without signatures are one class; null ids keep their rows and name no class unless all its ids are null.
    """
    members, sets = signature_sets(docs, id_col, text_col)
    total = members.count()
    prefix = materialize(rare_prefixes(sets, similarity), "prefixes")
    rows = prefix.count()
    own = F.col("n") - F.count("*").over(Window.partitionBy("key")) / 2
    inside = prefix.select("s", F.struct((own / F.col("n")).alias("deal"), "key", "n", F.lit(0).alias("w"), (F.col("n") - F.col("pos")).alias("rem")).alias("a"))
    inside = materialize(inside, "buckets")
    pairs = materialize(shared_enough(with_hubs(inside, rows), similarity), "candidates")
    own_sets = sets.select(F.col("set_id").alias("key"), F.col("s").alias("set"))
    links = materialize(alike(pairs, own_sets, similarity), "links")
    found = materialize(connected_components(links, "x", "y"), "components")
    found = settled(inside, found, pairs, overlap, similarity, lambda more: materialize(alike(more, own_sets, similarity), "links"))
    found = found.withColumnRenamed("node", "set_id")
    reps = members.groupBy("set_id").agg(F.min("id").alias("least"), F.count("*").alias("n")).join(found, "set_id", "left")
    reps = materialize(reps.withColumn("component", F.coalesce("component", "set_id")), "representatives")
    tops = reps.groupBy("component").agg(F.min("least").alias("class_id"), F.count("*").alias("size"))
    named = join_facts(reps, tops, "component", total, F.col("set_id"), count="size").select("set_id", "class_id", "n")
    return join_facts(members, materialize(named, "classes"), "set_id", total, F.xxhash64("id"))
