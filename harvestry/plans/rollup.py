"""Results by seed: nested rows, status, contact rollup, exports, and the analyst's table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestry.functions import urls as U
from harvestry.operators.quotes import quotes_for_company
from harvestry.plans.skew import ranked_within
from harvestry.sources.shared import materialize

CSV_COLUMNS = (
    "source_url", "company_name", "business_name", "listing_name", "email", "phone", "address", "website", "socials", "confidence", "quote_title",
    "quote_price", "quote_currency", "quote_confidence"
)
#: Items of an array of a part of the nested export, and folders that its files are dealt to.
PART, FILES = 1000, 64
ROW_COLUMNS = ("source_url", "company_name", "business_name", "listing_name", "email", "phone", "address", "website", "socials", "confidence", "status")
TABLE_COLUMNS = ("Source URL", "Listing / Business Name", "Email", "Phone", "Address", "Website", "Socials", "Quotes", "Confidence", "Status")


def _listed(df: DataFrame, order: str, *columns: str) -> DataFrame:
    return df.groupBy("seed_url").agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("rows"))


def seed_status(pages: DataFrame, companies: DataFrame, quotes: DataFrame) -> DataFrame:
    """``(seed_url, n_pages, n_companies, n_quotes, n_errors, status)``: partial with errors and data, error with errors only, else success."""
    tagged = pages.select("seed_url", F.lit(1).alias("p"), F.lit(0).alias("c"), F.lit(0).alias("q"), (F.col("status") == "error").cast("int").alias("e"))
    for df, flags in ((companies, (0, 1, 0, 0)), (quotes, (0, 0, 1, 0))):
        tagged = tagged.unionByName(df.select("seed_url", *[F.lit(x).alias(n) for x, n in zip(flags, "pcqe")]))
    sums = tagged.groupBy("seed_url").agg(*[F.sum(x).alias(n) for x, n in zip("pcqe", ("n_pages", "n_companies", "n_quotes", "n_errors"))])
    status = F.when((F.col("n_errors") > 0) & (F.col("n_companies") + F.col("n_quotes") > 0), "partial").when(F.col("n_errors") > 0, "error").otherwise("success")
    return sums.withColumn("status", status)


def contact_rollup(companies: DataFrame) -> DataFrame:
    """``(seed_url, company_name, emails, phone_numbers, addresses)``: the first company's name, and distinct contacts in order, case ignored.

    Each contact is reduced to its first place before anything is listed, so that shared contacts cost one row.
    """
    top = companies.groupBy("seed_url").agg(F.min_by("company_name", "place").alias("company_name"))
    for c in ("emails", "phone_numbers", "addresses"):
        flat = companies.select("seed_url", "place", F.posexplode(c).alias("i", "v")).filter(F.trim("v") != "")
        first = flat.groupBy("seed_url", F.lower(F.trim("v")).alias("k")).agg(F.min(F.struct("place", "i", "v")).alias("f"))
        lists = first.groupBy("seed_url").agg(F.transform(F.array_sort(F.collect_list("f")), lambda x: x["v"]).alias(c))
        top = top.join(lists, "seed_url", "left").withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    return top


def seed_results(pages: DataFrame, companies: DataFrame, quotes: DataFrame, discovered: DataFrame | None = None) -> DataFrame:
    """One nested row per seed, as an export view of the page-level tables.

    ``pages`` is ``(seed_url, source_url, status, error, place)``, ``companies`` and ``quotes`` have ``seed_url`` and ``place``. A seed's arrays are as long as its
    pages and records are; the flat tables stay the main output.
    """
    done = seed_status(pages, companies, quotes)
    crawled = pages.filter("source_url is not null").groupBy("seed_url").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "source_url"))), lambda x: x["source_url"]).alias("crawled_urls")
    )
    errors = pages.filter("status = 'error'").groupBy("seed_url").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("place", "source_url", "error"))),
            lambda x: F.struct(x["source_url"].alias("source_url"), x["error"].alias("error"))
        ).alias("errors")
    )
    company_columns = [c for c in companies.columns if c not in ("seed_url", "place", "eid", "scope")]
    quote_columns = [c for c in quotes.columns if c not in ("seed_url", "place")]
    tables = [
        crawled, errors, _listed(companies, "place", *company_columns).withColumnRenamed("rows", "companies"),
        _listed(quotes, "place", *quote_columns).withColumnRenamed("rows", "quotes"), contact_rollup(companies)
    ]
    if discovered is not None:
        tables.append(discovered.groupBy("seed_url").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "url"))), lambda x: x["url"]).alias("discovered_urls")))
    for t in tables:
        done = done.join(t, "seed_url", "left")
        done = done.withColumns({c: F.coalesce(c, F.array().cast(kind)) for c, kind in t.dtypes if kind.startswith("array")})
    return done.withColumn("source_url", F.col("seed_url"))


def run_metrics(seeds: DataFrame) -> DataFrame:
    """Rows of the analyst's table, quotes, and pages (or seeds if no page was crawled), over all seeds of :func:`seed_results`."""
    sums = seeds.agg(
        F.sum(F.greatest(F.col("n_companies"), F.lit(1))).alias("listings"), F.sum("n_quotes").alias("quotes"),
        F.sum(F.size("crawled_urls")).alias("crawled"), F.count("*").alias("seeds")
    )
    return sums.select(
        F.coalesce("listings", F.lit(0)).alias("listings"), F.coalesce("quotes", F.lit(0)).alias("quotes"),
        F.coalesce(F.nullif("crawled", F.lit(0)), F.col("seeds")).alias("pages")
    )


def csv_rows(companies: DataFrame, quotes: DataFrame) -> DataFrame:
    """The 14 columns of the flat export: companies, then quotes; what a kind lacks is null. ``order`` sorts a seed's rows."""
    url = F.coalesce(F.nullif("source_url", F.lit("")), F.col("seed_url")).alias("source_url")
    left = companies.select(
        "seed_url", F.lit(0).alias("kind"), "place", url, "company_name", "business_name", "listing_name", "email", "phone", "address", "website",
        F.array_join("socials", "; ").alias("socials"), F.col("confidence").cast("string").alias("confidence")
    )
    right = quotes.select(
        "seed_url", F.lit(1).alias("kind"), "place", url, F.col("company").alias("company_name"), F.col("title").alias("quote_title"),
        F.col("price").alias("quote_price"), F.col("currency").alias("quote_currency"), F.col("confidence").cast("string").alias("quote_confidence")
    )
    return left.unionByName(right, allowMissingColumns=True).select("seed_url", "kind", "place", *CSV_COLUMNS)


def csv_line(columns: tuple = ROW_COLUMNS) -> Column:
    """The columns as one line of CSV: quotes only where needed, doubled inside; nulls are empty."""

    def cell(c: str) -> Column:
        text = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
        return F.when(text.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    return F.concat_ws(",", *[cell(c) for c in columns])


def status_rows(rows: DataFrame) -> DataFrame:
    """The 11 columns of the row export, ``source_url`` or else ``url``, socials joined, and their ``line``."""
    url = F.coalesce(F.nullif("source_url", F.lit("")), F.col("url")) if "url" in rows.columns else F.col("source_url")
    done = rows.withColumn("source_url", url).withColumn("socials", F.array_join(F.coalesce("socials", F.array().cast("array<string>")), "; "))
    return done.select(*ROW_COLUMNS).withColumn("line", csv_line())


def analyst_table(companies: DataFrame, quotes: DataFrame, seeds: DataFrame) -> DataFrame:
    """Ten text columns: one row per company, or one for a seed without companies; quotes of the company; ``N/A`` where nothing is known."""
    counts = seeds.select("seed_url", "status", "n_companies")
    own = companies.join(counts, "seed_url").withColumn("row_id", F.col("place"))
    name = F.coalesce(F.nullif("listing_name", F.lit("")), F.nullif("business_name", F.lit("")), F.col("company_name"), F.lit(""))

    def first(one: str, many: str) -> Column:
        return F.coalesce(F.nullif(one, F.lit("")), F.get(many, F.lit(0)), F.lit(""))

    rows = own.select(
        "seed_url", "row_id", "n_companies", "status", F.coalesce(F.nullif("source_url", F.lit("")), F.col("seed_url")).alias("source_url"),
        name.alias("listing_name"), first("email", "emails").alias("email"), first("phone", "phone_numbers").alias("phone"),
        first("address", "addresses").alias("address"), F.coalesce("website", F.lit("")).alias("website"),
        F.array_join("socials", "; ").alias("socials"), "confidence"
    )
    # a seed without companies is one listing without a name, and so the owner of all its quotes
    bare = counts.filter("n_companies = 0").select(
        "seed_url", F.lit(0).alias("row_id"), F.lit(1).cast("long").alias("n_companies"), "status", F.col("seed_url").alias("source_url"),
        *[F.lit("").alias(c) for c in ("listing_name", "email", "phone", "address", "website", "socials")],
        F.lit(None).cast("double").alias("confidence")
    )
    rows = quotes_for_company(quotes, rows.unionByName(bare), "seed_url")
    said = F.array_join(
        F.filter(
            F.transform(
                F.coalesce("quotes", F.array().cast("array<struct<place:int,title:string,price:string,currency:string>>")),
                lambda q: F.concat_ws(" ", F.nullif(q["title"], F.lit("")), F.nullif(q["price"], F.lit("")), F.nullif(q["currency"], F.lit("")))
            ),
            lambda t: t != ""
        ),
        "; "
    )
    percent = F.when(F.col("confidence").isNotNull(), F.concat(F.floor(F.col("confidence") * 100 + 0.5).cast("string"), F.lit("%"))).otherwise("N/A")
    cells = [
        F.col("source_url"),
        *[F.coalesce(F.nullif(c, F.lit("")), F.lit("N/A")) for c in ("listing_name", "email", "phone", "address", "website", "socials")],
        F.coalesce(F.nullif(said, F.lit("")), F.lit("N/A")), percent, F.coalesce("status", F.lit("N/A"))
    ]
    return rows.select("seed_url", "row_id", *[c.alias(n) for c, n in zip(cells, TABLE_COLUMNS)])


def _in_parts(df: DataFrame, order: list[Column], item: Column, name: str, size: int) -> DataFrame:
    """``(seed_url, part, <name>)``: a seed's items in order, ``size`` of them in an array."""
    ranked = ranked_within(df.select("seed_url", item.alias("item"), *[o.alias(f"o{k}") for k, o in enumerate(order)]), "seed_url", [F.col(f"o{k}").asc_nulls_first() for k in range(len(order))], "n")
    part = F.floor((F.col("n") - 1) / size).cast("int").alias("part")
    lists = ranked.groupBy("seed_url", part).agg(F.array_sort(F.collect_list(F.struct("n", "item"))).alias("x"))
    return lists.select("seed_url", "part", F.transform("x", lambda x: x["item"]).alias(name))


def seed_parts(pages: DataFrame, companies: DataFrame, quotes: DataFrame, size: int = PART) -> DataFrame:
    """The nested export in numbered parts: ``(seed_url, part, n_parts, ...)``, each array with ``size`` items at most.

    All parts have the seed's counts, status and first company's name; together in order they hold what :func:`seed_results` has in one row:
    ``crawled_urls, errors, companies, quotes, emails, phone_numbers, addresses``. No task gathers a whole seed.
    """
    skipped = ("seed_url", "place", "eid", "scope")
    nested = {n: F.struct("place", *[F.col(c) for c in df.columns if c not in skipped]) for n, df in (("companies", companies), ("quotes", quotes))}
    failed = pages.filter("status = 'error'")
    lists = [
        _in_parts(pages.filter("source_url is not null"), [F.col("place"), F.col("source_url")], F.col("source_url"), "crawled_urls", size),
        _in_parts(failed, [F.col("place"), F.col("source_url"), F.col("error")], F.struct("source_url", "error"), "errors", size),
        _in_parts(companies, [F.col("place")], nested["companies"], "companies", size),
        _in_parts(quotes, [F.col("place")], nested["quotes"], "quotes", size)
    ]
    for c in ("emails", "phone_numbers", "addresses"):
        flat = companies.select("seed_url", "place", F.posexplode(c).alias("i", "v")).filter(F.trim("v") != "")
        first = flat.groupBy("seed_url", F.lower(F.trim("v")).alias("k")).agg(F.min(F.struct("place", "i", "v")).alias("f"))
        lists.append(_in_parts(first, [F.col("f.place"), F.col("f.i")], F.col("f.v"), c, size))
    head = seed_status(pages, companies, quotes).join(companies.groupBy("seed_url").agg(F.min_by("company_name", "place").alias("company_name")), "seed_url", "left")
    done = head.select("seed_url", F.lit(0).alias("part"))
    for t in lists:
        done = done.join(t, ["seed_url", "part"], "full")
    done = done.withColumns({c: F.coalesce(c, F.array().cast(kind)) for c, kind in done.dtypes if kind.startswith("array")})
    done = materialize(done, "parts")
    count = done.groupBy("seed_url").agg((F.max("part") + 1).alias("n_parts"))
    return done.join(head.join(count, "seed_url"), "seed_url").withColumn("source_url", F.col("seed_url"))


def write_exports(parts: DataFrame, rows: DataFrame, path: str, files: int = FILES) -> DataFrame:
    """JSON lines of :func:`seed_parts` and CSV ``rows`` under ``path``, dealt to ``files`` folders by a hash of their key, and the manifest of both.

    The manifest, also written, is ``(key, seed_url, bucket, n_parts)``: where a seed's lines are and how many. Keys of seeds may clash, so the
    seed itself stays in every line. However many seeds there are, and however large one is, files are about as large as each other: lines of a seed may be in
    several files of its folder.
    """
    key = U.output_key(F.col("seed_url"))
    bucket = F.pmod(F.xxhash64(key), F.lit(files)).cast("int")
    for df, kind in ((parts, "json"), (rows, "csv")):
        spread = df.withColumns({"key": key, "bucket": bucket}).repartition("bucket", F.pmod(F.xxhash64(*df.columns[:2]), F.lit(8)))
        writer = spread.write.partitionBy("bucket").mode("overwrite")
        writer.json(f"{path}/json") if kind == "json" else writer.option("header", True).option("escape", '"').csv(f"{path}/csv")
    manifest = parts.filter("part = 0").select(key.alias("key"), "seed_url", bucket.alias("bucket"), "n_parts")
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")
    return parts.sparkSession.read.schema(manifest.schema).parquet(f"{path}/manifest")
