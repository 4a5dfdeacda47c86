"""Line dedup by distinct-site spread, with DataFrame functions only.

A line that stands on many sites, and in as many different texts, is boilerplate: a text that was copied from site to
site is one text, and no reason to take its lines away. HyperLogLog sketches of sites and texts per line hash, merged
by aggregation, settle most lines; those whose estimate is near the threshold get exact distinct counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestry.plans.skew import join_facts
from harvestry.sources.shared import materialize

#: Distinct sites, and distinct texts, from which on a line is boilerplate.
MIN_SITES = 5
LG_K = 12
#: Relative distance to the threshold in which the sketch does not decide: six times its standard error.
BAND = 0.1


def _text(docs: DataFrame, text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def line_key(line: Column) -> Column:
    """A line without blanks, tabs and carriage returns at its ends."""
    return F.btrim(line, F.lit(" \t\r"))


def lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """``(id, k, pos, h, site)`` for every line that is not blank; ``k`` is the hash of the whole text."""
    text = _text(docs, text_col)
    cut = docs.select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("k"), F.col(site_col).cast("string").alias("site"),
        F.posexplode(F.split(text, "\n")).alias("pos", "line")
    )
    return cut.select("id", "k", "pos", line_key(F.col("line")).alias("key"), "site").filter("key <> ''").select("id", "k", "pos", F.xxhash64("key").alias("h"), "site")


def boilerplate(found: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """``(h, n)``: the line hashes of :func:`lines` on at least ``min_sites`` distinct sites and in as many distinct texts.

    ``n`` is how often the line occurs. Null sites count as none.
    """
    low, high = min_sites * (1 - BAND) - 1, min_sites * (1 + BAND) + 1
    sketches = [F.hll_sketch_estimate(F.hll_sketch_agg(c, lg_k)).alias(name) for c, name in (("site", "sites"), ("k", "texts"))]
    least = F.least("sites", "texts")
    spread = materialize(found.groupBy("h").agg(*sketches, F.count("*").alias("n")).withColumn("least", least).filter(least >= low), "spread")
    # a line on few sites may still be one of very many texts
    near = join_facts(found.select("h", "site", "k"), spread.filter(F.col("least") <= high).select("h", "n"), "h", found.count(), F.xxhash64("site", "k"))
    exact = near.groupBy("h").agg(F.count_distinct("site").alias("sites"), F.count_distinct("k").alias("texts"), F.count("*").alias("n"))
    return spread.filter(F.col("least") > high).select("h", "n").unionByName(exact.filter(least >= min_sites).select("h", "n"))


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``(row, clean, n_lines, n_removed)`` for every row of ``docs``; ``row`` holds its columns.

    ``clean`` is the text without the lines that stand on ``min_sites`` sites or more and in as many different texts, in order, joined
    by line feeds; however much of the text that is. Blank lines are never boilerplate. Null texts are empty (one blank line)
    and come out empty. Rows keep their number; rows with the same id are told apart by their texts, null ids are ids like others.
    """
    found = materialize(lines(docs, id_col, text_col, site_col), "lines")
    bad = materialize(boilerplate(found, min_sites), "boilerplate")
    # a boilerplate line is a hot key by its nature
    hit = join_facts(found.select("id", "k", "pos", "h"), bad, "h", found.count(), F.xxhash64("id", "k", "pos"))
    hit = hit.groupBy("id", "k").agg(F.collect_set("pos").alias("gone"))
    hit = hit.select(F.col("id").alias("hit_id"), F.col("k").alias("hit_k"), "gone")
    text = _text(docs, text_col)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("k"))
    both = rows.join(hit, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("k") == F.col("hit_k")), "left")
    both = both.select("row", "text", "gone", F.split("text", "\n").alias("parts"))
    left = F.array_join(F.filter("parts", lambda x, at: ~F.array_contains("gone", at)), "\n")
    clean = F.when(F.col("gone").isNull(), F.col("text")).otherwise(left)
    return both.select("row", clean.alias("clean"), F.size("parts").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))


def clean_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with boilerplate lines taken out of ``text``; other columns, null texts and the number of rows stay."""
    done = remove_boilerplate(docs, **options)
    columns = [F.when(F.col("row.text").isNull(), None).otherwise(F.col("clean")).alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns]
    return done.select(*columns)
