"""Links: extraction, ranking, page priority, and the crawl frontier."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from harvestry.functions import urls as U
from harvestry.functions.text import parsed_text
from harvestry.plans.skew import join_facts
from harvestry.sources.html import RESOLVED, parse_pages
from harvestry.sources.shared import materialize, shared_dir

MAX_LINKS, MAX_DEPTH, MAX_PAGES = 150, 3, 150


def anchors(pages: DataFrame, *keep: str) -> DataFrame:
    """``(keep..., page_url, pos, href, url, anchor_text)`` for every ``a`` with an ``href`` of pages, parsed or not.

    ``url`` is the href on its page's URL; references that can't be resolved are left out.
    """
    parsed = pages if "nodes" in pages.columns else parse_pages(pages, *keep)
    found = F.filter("nodes", lambda n: (n["tag"] == "a") & F.map_contains_key(n["attrs"], F.lit(RESOLVED)))
    rows = parsed.select(*keep, F.col("url").alias("page_url"), "tokens", F.posexplode(found).alias("pos", "a"))
    text = F.array_join(F.slice("tokens", F.col("a.tok_start") + 1, F.col("a.tok_len")), " ")
    attrs = F.col("a.attrs")
    return rows.select(*keep, "page_url", "pos", attrs["href"].alias("href"), attrs[RESOLVED].alias("url"), parsed_text(text).alias("anchor_text"))


def internal_links(links: DataFrame, http_only: bool = False, all_internal: bool = True) -> DataFrame:
    """Links of :func:`anchors` to the page's own host, assets and skipped URLs left out, with their ``score``.

    Links without a host (``mailto:`` and the like) pass unless ``http_only``; without ``all_internal`` only scored ones do.
    """
    host = U.host_of_absolute(F.col("url"))
    own = (host == "") | (host == U.host_of_absolute(F.col("page_url")))
    kept = links.filter((F.col("url") != "") & ~U.looks_like_asset(F.col("url")) & ~U.should_skip(F.col("url")) & own)
    if http_only:
        kept = kept.filter(F.col("url").rlike("(?i)^https?:"))
    kept = kept.withColumn("score", U.link_score(F.col("anchor_text"), F.col("url")))
    return kept if all_internal else kept.filter("score > 0")


def top_links(links: DataFrame, by: str = "page_url", limit: int = MAX_LINKS) -> DataFrame:
    """The best ``limit`` distinct URLs of each page: by score, then position; ``rank`` from 1. Case is ignored."""
    first = links.groupBy(by, F.lower("url").alias("key")).agg(F.max_by(F.struct("url", "score", "pos"), F.struct("score", -F.col("pos"))).alias("b"))
    order = Window.partitionBy(by).orderBy(F.desc("b.score"), "b.pos")
    return first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select(by, "b.url", "b.score", "b.pos", "rank")


def discovery_list(seeds: DataFrame, ranked: DataFrame, limit: int = MAX_LINKS) -> DataFrame:
    """``(seed_url, url, rank)``: the seed itself at rank 0, then its ranked links that differ from it, cut at ``limit`` in all.

    Pages of the same URL are one seed, whose links with the same rank follow by URL.
    """
    own = seeds.select("seed_url", F.col("seed_url").alias("url"), F.lit(0).alias("rank"))
    more = ranked.select(F.col("page_url").alias("seed_url"), "url", "rank").filter(F.lower("url") != F.lower("seed_url"))
    order = Window.partitionBy("seed_url").orderBy("rank", "url")
    both = own.unionByName(more).withColumn("rank", F.row_number().over(order) - 1)
    return both.filter(F.col("rank") < limit)


def crawl_order(links: DataFrame, by: str = "page_url", model_score: Column | None = None) -> DataFrame:
    """``place`` from 1 by the larger of page score and model score, then by ``rank``."""
    best = F.greatest(U.page_score(F.col("url")), F.coalesce(model_score, F.lit(0.0)) if model_score is not None else F.lit(0.0))
    scored = links.withColumn("page_score", best)
    return scored.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("page_score"), "rank")))


def unseen(links: DataFrame, visited: DataFrame, keys: tuple[str, ...] = ("seed_url", "url")) -> DataFrame:
    """The links whose keys are not among the visited ones."""
    return links.join(visited.select(*keys).distinct(), list(keys), "left_anti")


def frontier(start: DataFrame, links: DataFrame, depth: int = MAX_DEPTH, pages: int = MAX_PAGES) -> DataFrame:
    """``(seed_url, url, depth, parent_url, rank)``: what a crawl of each seed visits, level by level.

    ``start`` is ``(seed_url, url, rank)`` at depth 0, ``links`` is ``(page_url, url, rank)``. A URL is visited once
    per seed, from the parent that comes first, and a seed ends at ``pages`` URLs. Levels are partitions of one table in the shared folder, to which
    each adds its own rows only. Seeds that are full are left out before their pages are looked up. Pages that many seeds reach, hubs, have their
    lists of links sent to where those seeds are.
    """
    spark = start.sparkSession
    path = f"{shared_dir(spark)}/frontier-{uuid.uuid4().hex}"
    schema = "seed_url string, url string, parent_url string, rank int, last int"

    def written(level: int, rows: DataFrame) -> DataFrame:
        rows.write.parquet(f"{path}/depth={level}")
        return spark.read.schema(schema).parquet(f"{path}/depth={level}")

    first = start.groupBy("seed_url", "url").agg(F.min("rank").alias("order"))
    order = Window.partitionBy("seed_url").orderBy("order", "url")
    first = first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= pages)
    size = F.max("rank").over(Window.partitionBy("seed_url"))
    level = written(0, first.select("seed_url", "url", F.lit(None).cast("string").alias("parent_url"), "rank", size.alias("last")))
    seen = level
    # of a page's links as many as a seed can have, and as many again that it may have seen: no others can be reached from there
    best = links.groupBy("page_url", "url").agg(F.min("rank").alias("rank"))
    best = best.withColumn("n", F.row_number().over(Window.partitionBy("page_url").orderBy("rank", "url"))).filter(F.col("n") <= 2 * pages)
    targets = F.array_sort(F.collect_list(F.struct(F.col("rank").alias("link_rank"), "url")))
    lists = materialize(best.groupBy(F.col("page_url").alias("parent_url")).agg(targets.alias("links")), "links")
    for at in range(1, depth + 1):
        # ``last`` is how many pages a seed has so far
        open_ = level.filter(F.col("last") < pages).select("seed_url", F.col("url").alias("parent_url"), F.col("rank").alias("parent_rank"), "last")
        hubs = open_.groupBy("parent_url").agg(F.count("*").alias("n")).join(lists, "parent_url")
        found = join_facts(open_, hubs, "parent_url", open_.count(), F.col("seed_url"))
        found = found.select("seed_url", "parent_url", "parent_rank", "last", F.explode("links").alias("l"))
        found = found.groupBy("seed_url", F.col("l.url").alias("url")).agg(F.min(F.struct("parent_rank", "l.link_rank", "parent_url")).alias("b"), F.first("last").alias("before"))
        found = found.join(seen.select("seed_url", "url"), ["seed_url", "url"], "left_anti")
        place = F.row_number().over(Window.partitionBy("seed_url").orderBy("b.parent_rank", "b.link_rank", "url"))
        found = found.withColumn("rank", (F.col("before") + place).cast("int")).filter(F.col("rank") <= pages)
        level = written(at, found.select("seed_url", "url", "b.parent_url", "rank", F.max("rank").over(Window.partitionBy("seed_url")).alias("last")))
        seen = seen.unionByName(level)
    return spark.read.schema(schema + ", depth int").option("basePath", path).parquet(path).select("seed_url", "url", "depth", "parent_url", "rank")
