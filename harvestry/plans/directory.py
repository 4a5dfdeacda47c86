"""From a page corpus to companies, quotes and seed results: the jobs that the operators make up."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestry.functions import urls as U
from harvestry.functions import vocabulary as V
from harvestry.operators import blocks as B
from harvestry.operators import quotes as Q
from harvestry.operators.resolve import resolve
from harvestry.plans import rollup
from harvestry.sources.html import parse_pages
from harvestry.sources.shared import materialize


@dataclass
class Extraction:
    """Page-level tables: ``companies`` and ``quotes`` by page, and ``pages`` with their status."""

    companies: DataFrame
    quotes: DataFrame
    pages: DataFrame


def with_seed(pages: DataFrame) -> DataFrame:
    """``pages`` with ``seed_url``: the host of the page, unless the corpus names a seed."""
    return pages if "seed_url" in pages.columns else pages.withColumn("seed_url", U.host_of_absolute(F.col("url")))


def extract(
    pages: DataFrame, region: str = "NG", noise=V.NOISE_EMAIL_PARTS, cap: int | None = B.MAX_BLOCKS, section_cap: int | None = B.MAX_SECTIONS,
    quote_cap: int | None = Q.MAX_CONTAINERS
) -> Extraction:
    """Companies and quotes of every page of ``(page_id, url, html)``. Each page is parsed once, and the node table written once.

    A column ``region`` says by whose rule a page's phones are read, where it is not null. A column ``fetch_error`` says why a page could not be had; such pages, and those that can't be parsed, are errors of their seed. The caps
    are those of a page's blocks, sections and price containers; None lifts them.
    """
    pages = with_seed(pages)
    failed = F.col("fetch_error") if "fetch_error" in pages.columns else F.lit(None).cast("string")
    pages = pages.withColumn("failed", failed)
    own = [c for c in ("region",) if c in pages.columns]
    parsed = materialize(B.with_index(parse_pages(pages, "page_id", "seed_url", "failed", *own)), "parsed")
    found = materialize(B.detect_blocks(parsed, "page_id", "seed_url", region=region, noise=noise, cap=cap, section_cap=section_cap), "blocks")
    records = B.entities(found, "page_id", "seed_url").unionByName(B.structured_entities(parsed, "page_id", "seed_url", region=region))
    companies = resolve(records, "page_id").withColumnRenamed("scope", "page_id")
    companies = materialize(companies.join(pages.select("page_id", "seed_url"), "page_id"), "companies")
    roots = found.select("page_id", F.col("b.node_id").alias("root_id"))
    in_blocks = Q.quotes(Q.containers(parsed, "page_id", "seed_url", roots=roots, cap=quote_cap), "page_id", "seed_url", scope="dom_block")
    in_pages = Q.quotes(Q.containers(parsed, "page_id", "seed_url", cap=quote_cap), "page_id", "seed_url")
    both = materialize(Q.all_quotes(Q.distinct_in_page(in_blocks, "page_id"), Q.distinct_in_page(in_pages, "page_id")), "quotes")
    quotes = materialize(Q.attach_companies(both, companies.select("page_id", "company_name", "place"), "page_id"), "quotes")
    error = F.coalesce("failed", "error")
    status = parsed.select(
        "page_id", "seed_url", F.col("url").alias("source_url"), F.when(error.isNull(), "success").otherwise("error").alias("status"),
        error.alias("error"), F.col("page_id").alias("place")
    )
    return Extraction(companies, quotes, status)


def seeds(found: Extraction) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(companies, quotes, seed_results)``: merged and distinct within each seed, and nested by seed."""
    records = found.companies.drop("eid", "n_merged").withColumnRenamed("place", "pos")
    companies = resolve(records, "seed_url").withColumnRenamed("scope", "seed_url")
    companies = materialize(companies, "companies")
    quotes = materialize(Q.distinct_in_seed(found.quotes, "seed_url").drop("page_id", "root", "pos", "source_rank"), "quotes")
    return companies, quotes, rollup.seed_results(found.pages, companies, quotes)
