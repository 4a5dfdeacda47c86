"""The registered queries of the library and their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from harvestry.functions import scoring as S
from harvestry.functions import text as T
from harvestry.functions import urls as U
from harvestry.functions import vocabulary as V
from harvestry.operators import blocks as B
from harvestry.operators import links as L
from harvestry.operators import quotes as Q
from harvestry.operators import requests as R
from harvestry.operators.resolve import name_ratios, resolve
from harvestry.plans import corpora, directory, rollup
from harvestry.sources.html import node_table, parse_pages
from harvestry.sources.shared import materialize, shared_dir, table
from harvestry.streaming import incremental

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of the session and the folder of tables, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _any(words) -> str:
    """A pattern for any of the words in SQL text."""
    special = ".?+()[]{}|^$*\\"
    return "(" + "|".join("".join("\\" + c if c in special else c for c in w) for w in words).replace("'", "''") + ")"


def _word(words: str) -> str:
    """A pattern for any of the words between bounds, in SQL text whose bounds know ASCII only. A dot that may follow a word is a bound itself."""
    edge = r"[^\p{L}\p{N}_]"
    return f"(^|{edge})({words.replace(chr(92) + '.?', '')})($|{edge})"


EMAIL_FOUND, EMAIL_SHAPE = V.EMAIL_FOUND.replace("'", "''"), V.EMAIL_SHAPE.replace("'", "''")


@query(f"""
    WITH found AS (SELECT doc_id, unnest(regexp_extract_all(text, '{EMAIL_FOUND}')) AS email FROM documents WHERE text LIKE '%@%')
    SELECT doc_id, lower(email) AS email,
           length(email) <= 254 AND regexp_matches(lower(email), '{EMAIL_SHAPE}') AND NOT regexp_matches(lower(email), '{_any(V.IMAGE_SUFFIXES)}$')
             AND NOT regexp_matches(lower(email), '{_any(V.NOISE_EMAIL_PARTS)}') AS valid,
           length(email) <= 254 AND regexp_matches(lower(email), '{EMAIL_SHAPE}') AND NOT regexp_matches(lower(email), '{_any(V.IMAGE_SUFFIXES)}$') AS valid_any_host
    FROM found""")
def email_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emails in documents, and whether they pass with and without the noise list (B1)."""
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.find_emails(F.col("text"))).alias("e"))
    low = F.lower("e")
    return found.select("doc_id", low.alias("email"), T.is_valid_email(low).alias("valid"), T.is_valid_email(low, ()).alias("valid_any_host"))


_URL = """
    SELECT page_id, url, rtrim(regexp_replace(url, '#.*$', ''), '/') AS norm,
           regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\\.', '') AS domain,
           regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
           regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS query
    FROM pages"""


@query(f"""
    WITH u AS ({_URL}), p AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM u)
    SELECT page_id, norm, domain,
           regexp_matches(lower(path), '{_any(V.ASSET_SUFFIXES)}$') AS is_asset,
           regexp_matches(lower(path || '?' || query), '{_any(V.SKIPPED_IN_URLS)}') AS skipped,
           len(parts) >= 2 AND (regexp_matches(parts[-1], '[0-9]') OR (parts[-1] LIKE '%-%' AND length(parts[-1]) >= 8)) AS is_listing,
           least(CASE WHEN regexp_matches(lower(path || ' ' || query), '{_any(V.PRIORITY_PATHS)}') THEN 75 ELSE 0 END
               + CASE WHEN regexp_matches(lower(path || ' ' || query), '{_any(V.BUSINESS_WORDS)}') THEN 20 ELSE 0 END, 100) / 100.0::DOUBLE AS page_score,
           regexp_replace(path || '|' || query, '[^A-Za-z0-9]', '_', 'g')[1:120] AS key
    FROM p""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal form, host, predicates and score of page URLs."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        U.normalize_url(url).alias("norm"),
        U.domain(url).alias("domain"),
        U.looks_like_asset(url).alias("is_asset"),
        U.should_skip(url).alias("skipped"),
        U.is_listing_path(U.part(url, 3)).alias("is_listing"),
        U.page_score(url).alias("page_score"),
        U.output_key(F.concat_ws("|", U.part(url, 3), U.part(url, 4))).alias("key"),
    )


_ANCHORS = f"""
    WITH a AS (SELECT page_id, url AS page_url, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\\.', '') AS host,
                      regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS base,
                      regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 1) AS hrefs,
                      regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 2) AS texts FROM pages),
    l AS (SELECT page_id, page_url, base, unnest(hrefs) AS href, unnest(texts) AS text, generate_subscripts(hrefs, 1) - 1 AS pos FROM a),
    r AS (SELECT page_id, page_url, pos, href, trim(text, ' :|-') AS anchor_text, rtrim(base || href, '/') AS url, href AS path FROM l),
    s AS (SELECT *, lower(anchor_text || ' ' || path || ' ') AS said, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM r
          WHERE NOT regexp_matches(lower(path || '?'), '{_any(V.SKIPPED_IN_URLS)}') AND NOT regexp_matches(lower(path), '{_any(V.ASSET_SUFFIXES)}$')),
    t AS (SELECT *, (CASE WHEN regexp_matches(said, '{_any(V.DISCOVERY_WORDS)}') THEN 20 ELSE 0 END + CASE WHEN regexp_matches(said, '{_any(V.PAGINATION)}') THEN 18 ELSE 0 END
          + CASE WHEN len(parts) >= 2 AND (regexp_matches(parts[-1], '[0-9]') OR (parts[-1] LIKE '%-%' AND length(parts[-1]) >= 8)) THEN 12 ELSE 0 END
          + CASE WHEN anchor_text <> '' THEN 3 ELSE 0 END)::INT AS score FROM s),
    d AS (SELECT *, row_number() OVER (PARTITION BY page_id, lower(url) ORDER BY score DESC, pos) AS n FROM t),
    w AS (SELECT page_id, page_url, url, score, pos, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) AS rank FROM d WHERE n = 1)"""


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = L.internal_links(L.anchors(table(spark, sf_dir, "pages"), "page_id"))
    return L.top_links(links, "page_id")


@query(_ANCHORS + " SELECT page_id, url, score, rank FROM w WHERE rank <= 150")
def top_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best internal links of every page."""
    return _ranked(spark, sf_dir).select("page_id", "url", "score", "rank")


@query(_ANCHORS + """, k AS (SELECT * FROM w WHERE rank <= 150),
    f AS (SELECT page_url AS seed_url, url, rank FROM k WHERE lower(url) <> lower(page_url) UNION ALL SELECT url, url, 0 FROM pages),
    g AS (SELECT seed_url, url, rank, row_number() OVER (PARTITION BY seed_url ORDER BY rank, url) - 1 AS place FROM f)
    SELECT seed_url, url, place AS rank FROM g WHERE place < 150""")
def discovery_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a seed, followed by its links."""
    pages = table(spark, sf_dir, "pages")
    ranked = _ranked(spark, sf_dir).join(pages.select("page_id", F.col("url").alias("page_url")), "page_id")
    return L.discovery_list(pages.select(F.col("url").alias("seed_url")), ranked)


@query(_ANCHORS + f""", k AS (SELECT *, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) || ' ' AS said FROM w WHERE rank <= 150),
    m AS (SELECT *, least(CASE WHEN regexp_matches(lower(said), '{_any(V.PRIORITY_PATHS)}') THEN 75 ELSE 0 END + CASE WHEN regexp_matches(lower(said), '{_any(V.BUSINESS_WORDS)}') THEN 20 ELSE 0 END, 100) / 100.0::DOUBLE AS page_score FROM k)
    SELECT page_id, url, page_score, row_number() OVER (PARTITION BY page_id ORDER BY page_score DESC, rank) AS place FROM m""")
def crawl_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links by page priority."""
    return L.crawl_order(_ranked(spark, sf_dir), "page_id").select("page_id", "url", "page_score", "place")


@query(_ANCHORS + """ SELECT DISTINCT page_url AS seed_url, url FROM w WHERE rank <= 150 AND url NOT IN (SELECT url FROM w WHERE rank <= 2)""")
def unseen_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that are nowhere among the first two of a page."""
    ranked = _ranked(spark, sf_dir).join(table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("seed_url")), "page_id")
    return L.unseen(ranked, ranked.filter("rank <= 2"), ("url",)).select("seed_url", "url").distinct()


def _crawl_level(k: int) -> str:
    """One level of a crawl in SQL: what level ``k - 1`` links to and nobody has seen, by its first parent, up to 150 pages."""
    return f"""
    f{k} AS (SELECT v.seed_url, l.url, v.url AS parent_url, v.rank AS pr, l.rank AS lr, row_number() OVER (PARTITION BY v.seed_url, l.url ORDER BY v.rank, l.rank, v.url) AS n
        FROM v{k - 1} v JOIN l ON l.page_url = v.url WHERE v.depth = {k - 1} AND NOT EXISTS (SELECT 1 FROM v{k - 1} w WHERE w.seed_url = v.seed_url AND w.url = l.url)),
    g{k} AS (SELECT f.seed_url, f.url, {k} AS depth, f.parent_url, (c.n + row_number() OVER (PARTITION BY f.seed_url ORDER BY pr, lr, f.url))::INT AS rank
        FROM f{k} f JOIN (SELECT seed_url, count(*) AS n FROM v{k - 1} GROUP BY seed_url) c ON c.seed_url = f.seed_url WHERE f.n = 1),
    v{k} AS (SELECT * FROM v{k - 1} UNION ALL SELECT * FROM g{k} WHERE rank <= 150)"""


@query(f"""
    WITH e AS (SELECT 'customer/' || o_custkey AS page_url, 'order/' || o_orderkey AS url FROM orders
        UNION SELECT 'order/' || l_orderkey, 'supplier/' || l_suppkey FROM lineitem
        UNION SELECT 'supplier/' || s_suppkey, 'nation/' || s_nationkey FROM supplier),
    l AS (SELECT page_url, url, row_number() OVER (PARTITION BY page_url ORDER BY url) AS rank FROM e),
    v0 AS (SELECT 'customer/' || c_custkey AS seed_url, 'customer/' || c_custkey AS url, 0 AS depth, NULL::VARCHAR AS parent_url, 1 AS rank FROM customer),
    {", ".join(_crawl_level(k) for k in (1, 2, 3))}
    SELECT seed_url, url, depth, parent_url, rank FROM v3""")
def crawl_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a crawl from every customer visits over orders and suppliers to nations, each linked to the next."""

    def page(kind: str, key: str) -> Column:
        return F.concat(F.lit(f"{kind}/"), F.col(key))

    links = table(spark, sf_dir, "orders").select(page("customer", "o_custkey").alias("page_url"), page("order", "o_orderkey").alias("url"))
    links = links.union(table(spark, sf_dir, "lineitem").select(page("order", "l_orderkey"), page("supplier", "l_suppkey")))
    links = links.union(table(spark, sf_dir, "supplier").select(page("supplier", "s_suppkey"), page("nation", "s_nationkey"))).distinct()
    links = links.withColumn("rank", F.row_number().over(Window.partitionBy("page_url").orderBy("url")))
    url = page("customer", "c_custkey")
    start = table(spark, sf_dir, "customer").select(url.alias("seed_url"), url.alias("url"), F.lit(0).alias("rank"))
    return L.frontier(start, materialize(links, "links"))


@query(f"""
    WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '{V.PHONE_FOUND}')) AS found FROM documents),
    d AS (SELECT doc_id, trim(regexp_replace(found, '\\s+', ' ', 'g'), ' :|-') AS v, regexp_replace(found, '[^0-9]', '', 'g') AS digits FROM c)
    SELECT doc_id, v AS found, CASE WHEN length(digits) NOT BETWEEN 7 AND 15 THEN '' WHEN v LIKE '+%' THEN '+' || digits
           WHEN digits LIKE '0%' AND length(digits) = 11 THEN '+234' || digits[2:] WHEN length(digits) > 10 THEN '+' || digits ELSE digits END AS phone FROM d""")
def phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything in documents with the look of a phone, normalised."""
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.find_phones(F.col("text"))).alias("f"))
    return found.select("doc_id", T.clean_text(F.col("f")).alias("found"), T.normalize_phone(F.col("f")).alias("phone"))


_PRICE = V.PRICE.removeprefix("(?i)")


@query(f"""
    WITH p AS (SELECT doc_id, regexp_extract(text, '{_PRICE}', 1, 'i') AS token, regexp_extract(text, '{_PRICE}', 2, 'i') AS amt, text FROM documents WHERE regexp_matches(text, '{_PRICE}', 'i'))
    SELECT doc_id, token || amt AS price, CASE upper(token) WHEN '₦' THEN 'NGN' WHEN '$' THEN 'USD' WHEN '£' THEN 'GBP' WHEN '€' THEN 'EUR' WHEN 'N' THEN 'NGN' ELSE upper(token) END AS currency,
           try_cast(replace(amt, ',', '') AS DECIMAL(18,2)) AS amount, regexp_matches(text, '\\b(starting from|starts at|from|as low as|packages? from|fees?)\\b', 'i') AS starting FROM p""")
def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first price of every document, and the cue of a lower bound."""
    found = table(spark, sf_dir, "documents").withColumn("p", S.parse_price(F.col("text"))).filter("p is not null")
    return found.select("doc_id", "p.price", "p.currency", "p.amount", S.starts_from(F.col("text")).alias("starting"))


@query("""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
    c AS (SELECT doc_id, pos, trim(regexp_replace(line, '[\\s\\p{Z}]+', ' ', 'g'), ' :|-') AS cleaned FROM l)
    SELECT doc_id, pos, cleaned, rtrim(cleaned[1:40]) AS cut FROM c""")
def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of every document, cleaned and cut."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.select("doc_id", "pos", T.clean_text(F.col("line")).alias("cleaned"), T.clean_text(F.col("line"), 40).alias("cut"))


_AT = [(f"\\s*\\[\\s*{w}\\s*\\]\\s*", f"\\s*\\(\\s*{w}\\s*\\)\\s*", f"\\s+\\b{w}\\b\\s+", sign) for w, sign in (("at", "@"), ("dot", "."))]


def _deobfuscated(sql: str) -> str:
    for *patterns, sign in _AT:
        for p in patterns:
            sql = f"regexp_replace({sql}, '{p}', '{sign}', 'gi')"
    return sql


@query(f"SELECT doc_id, md5({_deobfuscated('text')}) AS digest, len(regexp_extract_all({_deobfuscated('text')}, '{EMAIL_FOUND}')) AS n_emails FROM documents")
def deobfuscated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with spelled-out signs put back, and how many emails that makes."""
    rows = table(spark, sf_dir, "documents").withColumn("t", T.deobfuscate(F.col("text")))
    return rows.select("doc_id", F.md5("t").alias("digest"), F.size(T.find_emails(F.col("t"))).cast("long").alias("n_emails"))


@query(_ANCHORS + f""", n AS (SELECT *, trim(regexp_replace(anchor_text, '(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(V.TRAILING_NAV)})$', '', 'i'), ' :|-') AS cut FROM r)
    SELECT page_id, pos, CASE WHEN length(cut) < 2 THEN '' ELSE cut END AS name,
      length(anchor_text) >= 2 AND lower(anchor_text) NOT IN ({', '.join(f"'{n}'" for n in V.NOISE_NAMES)}) AS real_name,
      length(anchor_text) BETWEEN 2 AND 90 AND NOT regexp_matches(anchor_text, '[0-9]{{5,}}') AND anchor_text NOT LIKE '%@%' AND NOT regexp_matches(anchor_text, '\\b({'|'.join(V.NOT_A_NAME)})\\b', 'i') AS name_line
    FROM n""")
def anchor_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchor texts as company names."""
    rows = L.anchors(table(spark, sf_dir, "pages"), "page_id")
    a = F.col("anchor_text")
    return rows.select("page_id", "pos", T.clean_company_name(a).alias("name"), T.has_real_name(a).alias("real_name"), T.looks_like_name(a).alias("name_line"))


@query(f"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
    c AS (SELECT doc_id, pos, rtrim(trim(regexp_replace(raw, '[\\s\\p{{Z}}]+', ' ', 'g'), ' :|-')[1:240]) AS line FROM l)
    SELECT doc_id, pos, length(line) AS n FROM c WHERE length(line) BETWEEN 12 AND 240 AND line NOT LIKE '%@%'
      AND (regexp_matches(line, '{_word(V.ADDRESS_HINTS)}', 'i') OR (line LIKE '%,%' AND regexp_matches(line, '{_word(V.STATES)}', 'i')))""")
def address_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents with the look of an address."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw")).withColumn("line", T.clean_text(F.col("raw"), 240))
    return rows.filter(T.looks_like_address(F.col("line"))).select("doc_id", "pos", F.length("line").alias("n"))


@query("""
    WITH r AS (SELECT page_id // 12 * 2 + CASE WHEN page_id % 12 >= 9 AND page_id // 12 % 2 = 1 THEN 1 ELSE 0 END AS request_id, page_id AS pos, CASE page_id % 5 WHEN 0 THEN regexp_replace(url, '^https?://', '') WHEN 1 THEN 'not-a-url' WHEN 2 THEN '' ELSE url END AS u FROM pages),
    v AS (SELECT *, u <> '' AND u <> 'not-a-url' AS ok FROM r),
    g AS (SELECT request_id, count(*) AS n, count(*) FILTER (WHERE ok) AS good, count(*) FILTER (WHERE u = 'not-a-url') AS bad,
          string_agg(CASE WHEN u LIKE 'http%' THEN u ELSE 'https://' || u END, ' ' ORDER BY pos) FILTER (WHERE ok) AS urls FROM v GROUP BY request_id)
    SELECT request_id, n <= 10 AND good > 0 AS valid, CASE WHEN n > 10 THEN 'Maximum 10 URLs allowed per request' WHEN good = 0 THEN 'No valid URLs found'
           WHEN bad > 0 THEN 'Validated ' || good || ' URLs. ' || bad || ' invalid.' ELSE 'All URLs are valid' END AS message,
           CASE WHEN n <= 10 AND good > 0 THEN urls ELSE '' END AS urls, CASE WHEN n <= 10 AND good > 0 THEN good ELSE 0 END::INT AS count FROM g""")
def url_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All page URLs, some without scheme, blank or wrong, as batches of three, nine or twelve."""
    p = table(spark, sf_dir, "pages")
    request = F.expr("floor(page_id / 12) * 2 + if(page_id % 12 >= 9 and floor(page_id / 12) % 2 = 1, 1, 0)")
    way = F.col("page_id") % 5
    url = F.when(way == 0, F.regexp_replace("url", "^https?://", "")).when(way == 1, "not-a-url").when(way == 2, "").otherwise(F.col("url"))
    done = R.validate_batches(p.select(request.alias("request_id"), F.col("page_id").alias("pos"), url.alias("url")))
    return done.select("request_id", "valid", "message", F.array_join("valid_urls", " ").alias("urls"), "count")


@query("""
    SELECT page_id, len(regexp_extract_all(html, '<li[ >]')) AS n_li, len(regexp_extract_all(html, '<a ')) AS n_a, len(regexp_extract_all(html, '<p>')) AS n_p,
           len(regexp_extract_all(html, '<article')) AS n_article FROM pages""")
def node_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node table of every page, counted by tag."""
    nodes = node_table(parse_pages(table(spark, sf_dir, "pages"), "page_id"), "page_id")
    return nodes.groupBy("page_id").agg(*[F.count_if(F.col("tag") == t).alias(f"n_{t}") for t in ("li", "a", "p", "article")])


@query(_ANCHORS + """ SELECT page_id, pos, anchor_text AS text, 'body > nav > ul > li > a' AS path FROM r""")
def anchor_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and path of every link node."""
    nodes = node_table(parse_pages(table(spark, sf_dir, "pages"), "page_id"), "page_id").filter("tag = 'a'")
    rows = nodes.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "text", "path"))).alias("x"))
    return rows.select("page_id", F.posexplode("x").alias("pos", "a")).select(
        "page_id", F.col("pos").cast("long").alias("pos"), T.clean_text(F.col("a.text")).alias("text"), "a.path"
    )


_FACTS = f"""
    WITH f AS (SELECT s_suppkey AS key, 'Vendor House ' || s_suppkey AS name, 'sales' || s_suppkey || '@house' || s_suppkey || '.co' AS email, '+1202' || lpad(s_suppkey::VARCHAR, 7, '5') AS phone,
               s_suppkey || ' Market Street, ' || upper(n_name[1:1]) || lower(n_name[2:]) AS address, 'https://facebook.com/house' || s_suppkey AS social, s_suppkey // {corpora.CARDS} AS page
               FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
_DIRECTORY = """
    SELECT page AS page_id, name AS company_name, CASE WHEN key % 5 <> 0 THEN email END AS email, phone, address, CASE WHEN key % 3 = 2 THEN 'https://wa.me/' || phone END AS website,
           CASE WHEN key % 7 <> 0 THEN social END AS social,
           least(100, 71 + CASE WHEN key % 5 <> 0 THEN 18 ELSE 0 END + CASE WHEN key % 3 = 2 THEN 12 ELSE 0 END + CASE WHEN key % 7 <> 0 THEN 7 ELSE 0 END) / 100.0::DOUBLE AS confidence FROM f"""


@query(_FACTS + _DIRECTORY)
def directory_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory rendered from suppliers in many shapes, read back as companies."""
    return flagship(spark, sf_dir)


def _companies(parsed: DataFrame, **options) -> DataFrame:
    return B.entities(B.detect_blocks(materialize(parsed, "parsed"), "page_id", **options), "page_id")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies of every page of the rendered directory."""
    found = _companies(parse_pages(corpora.directory_pages(spark, sf_dir), "page_id"))
    return found.select("page_id", "company_name", "email", "phone", "address", "website", F.get("socials", F.lit(0)).alias("social"), "confidence")


@query(_FACTS + """, t AS (SELECT key // 100 AS page, name, row_number() OVER (PARTITION BY key // 100 ORDER BY
      length(name) + length(address) + CASE key % 4 WHEN 1 THEN 16 WHEN 2 THEN 12 WHEN 3 THEN 8 ELSE 0 END + CASE WHEN key % 5 <> 0 THEN 8 ELSE 0 END
      + CASE key % 3 WHEN 0 THEN 8 WHEN 1 THEN 10 + length(phone) ELSE 5 END + CASE WHEN key % 3 = 2 THEN 9 ELSE 0 END + CASE WHEN key % 7 <> 0 THEN 5 ELSE 0 END, key) AS n FROM f)
    SELECT page AS page_id, name AS company_name FROM t WHERE n <= 80""")
def capped_directory_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a hundred cards, of which the cap lets the eighty shortest pass."""
    return _companies(parse_pages(corpora.directory_pages(spark, sf_dir, 100), "page_id")).select("page_id", "company_name")


@query(_FACTS + """ SELECT page AS page_id, name AS company_name, email, address,
      CASE key % 4 WHEN 0 THEN 'article.company-card' WHEN 1 THEN 'section.listing' WHEN 2 THEN 'section.listing > article.company-card'
           ELSE 'section.listing > div.vendor-card > article.company-card' END AS block FROM f""")
def nested_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings that stand in other candidates: the innermost are kept, and of those as long as each other the outermost."""
    found = _companies(parse_pages(corpora.nested_pages(spark, sf_dir), "page_id"), cap=None)
    return found.select("page_id", "company_name", "email", "address", F.regexp_extract("container_path", "main > (.*)$", 1).alias("block"))


@query(_FACTS + """, r AS (SELECT *, key // 4 % 6 AS turn, lpad(key::VARCHAR, 6, '5') AS k FROM f)
    SELECT name AS company_name, CASE turn WHEN 0 THEN '+2348032' || k WHEN 1 THEN '+442079' || k WHEN 2 THEN '+233302' || k WHEN 3 THEN '+33142' || k ELSE '0212' || k END AS phone FROM r""")
def regional_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phones of pages of five regions and none in one job, each read by the rule of its own page."""
    pages = corpora.regional_pages(spark, sf_dir)
    return _companies(parse_pages(pages, "page_id", "region"), cap=None, region="").select("company_name", "phone")


@query("""
    WITH r AS (SELECT s_suppkey AS key, s_suppkey % 8 AS way FROM supplier)
    SELECT key, CASE way WHEN 0 THEN 'Café & Co' WHEN 1 THEN '<b> ≥ 5' WHEN 2 THEN 'Ωmega ' || key WHEN 3 THEN 'AB€' WHEN 4 THEN '&unknown; ¬it; notme'
           WHEN 5 THEN 'x� y' WHEN 6 THEN '¼ cup' ELSE '&amp; & 😀' END AS cleaned FROM r""")
def entity_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with named, bare, decimal, hexadecimal, wrong and unknown character references, rendered from suppliers and cleaned."""
    shapes = (
        "Caf&eacute; &amp; Co", "&lt;b&gt; &ge;&nbsp;5", "&Omega;mega @", "&#65;&#x42;&#128;", "&unknown; &notit; notme", "x&#0;&#1; y",
        " &frac14 cup&nbsp;", "&amp;amp; & &#x1F600;"
    )
    shape = F.get(F.array(*[F.lit(x) for x in shapes]), F.pmod("s_suppkey", F.lit(len(shapes))).cast("int"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), T.clean_text(F.replace(shape, F.lit("@"), F.col("s_suppkey").cast("string"))).alias("cleaned"))


@query(_FACTS + " SELECT page AS page_id, name AS company_name, email FROM f")
def disguised_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emails that are spelled out, protected by a key, or in base64, on pages of more hits than the usual cap."""
    return _companies(parse_pages(corpora.disguised_pages(spark, sf_dir), "page_id"), cap=None).select("page_id", "company_name", "email")


@query(_FACTS + " SELECT key AS page_id, name AS company_name, email, 'https://section.house/' || key AS source_url FROM f")
def section_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without any listing, of which a section tells the company."""
    return _companies(parse_pages(corpora.section_pages(spark, sf_dir), "page_id")).select("page_id", "company_name", "email", "source_url")


@query(_FACTS + """ SELECT page AS page_id, 'Café House ' || key AS company_name,
      CASE key % 3 WHEN 0 THEN 'https://sites.house/go/' || key WHEN 1 THEN 'https://shop' || key || '.co/a?x=1&y=2' ELSE 'https://shop' || key || '.co/./b/../c' END AS website,
      'https://instagram.com/house' || key AS social FROM f""")
def company_websites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Websites by relative, unquoted and dotted links, and names with entities."""
    found = _companies(parse_pages(corpora.website_pages(spark, sf_dir), "page_id"), cap=None)
    return found.select("page_id", "company_name", "website", F.get("socials", F.lit(0)).alias("social"))


_STRUCTURED = """
    SELECT key AS page_id, name || ' & Sóns' AS company_name, CASE WHEN key % 5 <> 4 THEN email END AS email, CASE WHEN key % 5 <> 4 THEN phone END AS phone,
           CASE WHEN key % 5 <> 4 THEN address || CASE WHEN key % 2 = 0 THEN ', US' ELSE '' END END AS address, CASE WHEN key % 5 = 4 THEN 'https://structured.house/about?x=1' END AS website,
           CASE WHEN key % 5 = 4 THEN 0.44 ELSE 0.79 END::DOUBLE AS confidence, key % 5 = 4 AS low_confidence FROM f"""


@query(_FACTS + _STRUCTURED)
def structured_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies in JSON-LD objects, lists and graphs, and whether their confidence is low."""
    found = B.structured_entities(parse_pages(corpora.structured_pages(spark, sf_dir), "page_id"), "page_id")
    return B.with_low_confidence(found).select("page_id", "company_name", "email", "phone", "address", "website", "confidence", "low_confidence")


@query("""
    SELECT p_name || ' no ' || p_partkey AS title, '$' || p_retailprice::DECIMAL(18,2)::VARCHAR AS price, p_retailprice::DECIMAL(18,2) AS amount, 'USD' AS currency, 'from' AS description, 1.0::DOUBLE AS confidence FROM part""")
def package_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price boxes rendered from parts, read back as quotes."""
    parsed = materialize(parse_pages(corpora.pricing_pages(spark, sf_dir), "page_id"), "parsed")
    found = Q.distinct_in_page(Q.quotes(Q.containers(parsed, "page_id"), "page_id"), "page_id")
    return found.select("title", "price", "amount", "currency", "description", "confidence")


@query("""
    WITH p AS (SELECT *, p_retailprice::DECIMAL(18,2) AS amount FROM part)
    SELECT p_partkey // 15 AS page_id, p_name || ' no ' || p_partkey AS title, CASE p_partkey % 3 WHEN 0 THEN '$' WHEN 1 THEN 'EUR' ELSE 'NGN' END || amount::VARCHAR AS price, amount,
           CASE p_partkey % 3 WHEN 0 THEN 'USD' ELSE 'NGN' END AS currency FROM p WHERE p_partkey % 3 <> 1""")
def repeated_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price boxes inside others, and each said twice: the outermost are read, and one quote of each is kept (D11, G4). A currency that is not known is no price."""
    parsed = materialize(parse_pages(corpora.repeated_pricing_pages(spark, sf_dir), "page_id"), "parsed")
    found = Q.distinct_in_page(Q.quotes(Q.containers(parsed, "page_id", cap=None), "page_id"), "page_id")
    return found.select("page_id", "title", "price", "amount", "currency")


@query("""
    WITH c AS (SELECT c_custkey // 50 AS seed, c_custkey AS k, c_custkey % 4 AS way FROM customer)
    SELECT seed, k AS c_custkey, CASE WHEN way = 3 THEN 2 ELSE 1 END AS n_companies, CASE WHEN way = 3 THEN 0.6 ELSE 0.65 END::DOUBLE AS confidence FROM c""")
def resolved_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sightings of every customer, merged by email, phone or host, or kept apart."""
    done = resolve(corpora.customer_records(spark, sf_dir), "seed")
    key = F.regexp_extract("container_path", r"#c(\d+)", 1).cast("long")
    return done.groupBy(F.col("scope").alias("seed"), key.alias("c_custkey")).agg(F.count("*").alias("n_companies"), F.max("confidence").alias("confidence"))


@query("""
    WITH c AS (SELECT c_custkey // 50 AS seed, c_custkey AS k, c_custkey % 4 AS way, unnest([0, 1]) AS side FROM customer),
    m AS (SELECT seed, k, side, CASE WHEN way = 3 THEN 0.6 ELSE 0.65 END::DOUBLE AS confidence FROM c WHERE side = 0 OR way = 3)
    SELECT seed, k AS c_custkey, side, row_number() OVER (PARTITION BY seed ORDER BY confidence DESC, 'https://pages.house/' || side || '/' || k)::INT AS place FROM m""")
def ranked_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged customers of each seed, best first."""
    done = resolve(corpora.customer_records(spark, sf_dir), "seed")
    part = [F.regexp_extract("source_url", r"house/(\d)/(\d+)", k) for k in (1, 2)]
    return done.select(F.col("scope").alias("seed"), part[1].cast("long").alias("c_custkey"), part[0].cast("int").alias("side"), "place")


@query()
def similar_customer_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer names that are nearly the same, the earlier against the later, by nation."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("scope"), F.col("c_custkey").alias("eid"), F.col("c_name").alias("company_name"))
    return name_ratios(rows)


def _seed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directory cards with a price each, two pages a seed; every third seed has a page that could not be had, and each nation a seed with nothing else."""
    f = corpora.supplier_facts(spark, sf_dir)
    card = F.concat(
        F.lit("<div><h3>"), "name", F.lit('</h3><a href="mailto:'), "email", F.lit('">Mail</a><address>'), "address", F.lit("</address><p>from $"),
        F.col("key") + 100, F.lit("</p></div>")
    )
    pages = corpora._pages(f.select("page", F.col("key").alias("at"), card.alias("card")), "priced.house", '<main class="directory-results">', "</main>")
    seed = F.floor(F.col("page_id") / 2)
    pages = pages.withColumns({"seed_url": F.concat(F.lit("seed"), seed), "fetch_error": F.lit(None).cast("string")})
    nothing = F.lit(None).cast("string")
    late = pages.filter((F.col("page_id") % 6) == 0).select(
        (F.col("page_id") + 1_000_000_000).alias("page_id"), F.concat("url", F.lit("/late")).alias("url"), nothing.alias("html"), "seed_url",
        F.lit("timeout").alias("fetch_error")
    )
    key = F.col("n_nationkey").cast("long")
    lost = table(spark, sf_dir, "nation").select(
        (key + 2_000_000_000).alias("page_id"), F.concat(F.lit("https://lost.house/"), key).alias("url"), nothing.alias("html"),
        F.concat(F.lit("lost"), key).alias("seed_url"), F.lit("refused").alias("fetch_error")
    )
    return pages.unionByName(late).unionByName(lost)


def _extracted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Pages with their status, and companies, quotes and results by seed."""
    found = directory.extract(_seed_pages(spark, sf_dir), cap=None)
    return found.pages, *directory.seeds(found)


def _seeds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return _extracted(spark, sf_dir)[1:]


_SEEDS = _FACTS + """, s AS (SELECT *, 'seed' || (page // 2) AS seed_url FROM f),
    late AS (SELECT DISTINCT seed_url FROM s WHERE page % 6 = 0)"""
_RESULTS = _SEEDS + """, r AS (
    SELECT s.seed_url, count(DISTINCT page) + count(DISTINCT late.seed_url) AS n_pages, count(*) AS n_companies, count(*) AS n_quotes, count(DISTINCT late.seed_url) AS n_errors,
           CASE WHEN count(late.seed_url) > 0 THEN 'partial' ELSE 'success' END AS status, string_agg(email, ' ' ORDER BY email) AS emails
    FROM s LEFT JOIN late ON late.seed_url = s.seed_url GROUP BY s.seed_url
    UNION ALL SELECT 'lost' || n_nationkey, 1, 0, 0, 1, 'error', '' FROM nation)"""


@query(_RESULTS + " SELECT * FROM r")
def seed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies, quotes, pages, errors and contacts by seed."""
    _, _, done = _seeds(spark, sf_dir)
    return done.select("seed_url", "n_pages", "n_companies", "n_quotes", "n_errors", "status", F.array_join(F.array_sort("emails"), " ").alias("emails"))


@query(_RESULTS + """ SELECT r.seed_url, r.status, s.name AS company_name, s.email, CASE WHEN r.status = 'success' THEN NULL WHEN r.status = 'error' THEN 'refused' ELSE 'timeout' END AS first_error
    FROM r LEFT JOIN s ON s.seed_url = r.seed_url""")
def exported_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested export in parts of thirty companies, written as JSON lines by a hash of the seed, and read back whole."""
    path, _ = _exported(spark, sf_dir)
    back = spark.read.schema(
        "seed_url string, part int, n_parts int, status string, companies array<struct<company_name: string, email: string>>, errors array<struct<error: string>>"
    ).json(f"{path}/json")
    heads = back.filter("part = 0").select("seed_url", "status", F.get("errors", F.lit(0))["error"].alias("first_error"))
    found = back.filter("part < n_parts").select("seed_url", F.explode("companies").alias("c")).select("seed_url", "c.company_name", "c.email")
    return heads.join(found, "seed_url", "left").select("seed_url", "status", "company_name", "email", "first_error")


def _exported(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    pages, companies, quotes, _ = _extracted(spark, sf_dir)
    path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    return path, rollup.write_exports(rollup.seed_parts(pages, companies, quotes, 30), rollup.csv_rows(companies, quotes).drop("kind", "place"), path, 8)


@query(_SEEDS + """
    , w AS (SELECT seed_url, 'https://priced.house/list/' || page AS source_url, name AS company_name, email, address, NULL AS quote_price, 1 AS n_parts FROM s
            UNION ALL SELECT seed_url, 'https://priced.house/list/' || page, name, NULL, NULL, '$' || (key + 100), 1 FROM s),
    n AS (SELECT seed_url, (count(*) + 29) // 30 AS n_parts FROM s GROUP BY seed_url)
    SELECT w.seed_url, source_url, company_name, email, address, quote_price, n.n_parts::INT AS n_parts FROM w JOIN n ON n.seed_url = w.seed_url""")
def exported_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat export, written as CSV files by a hash of the seed, and read back whole by the manifest."""
    path, manifest = _exported(spark, sf_dir)
    back = spark.read.option("header", True).option("escape", '"').csv(f"{path}/csv").withColumn("bucket", F.col("bucket").cast("int"))
    known = manifest.select("seed_url", "bucket", "n_parts")
    return back.join(known, ["seed_url", "bucket"]).select("seed_url", "source_url", "company_name", "email", "address", "quote_price", "n_parts")


@query(_SEEDS + """
    SELECT seed_url, 'https://priced.house/list/' || page AS source_url, name AS company_name, name AS business_name, name AS listing_name, email, NULL AS phone, address, NULL AS website, '' AS socials, '0.73' AS confidence,
           NULL AS quote_title, NULL AS quote_price, NULL AS quote_currency, NULL AS quote_confidence FROM s
    UNION ALL SELECT seed_url, 'https://priced.house/list/' || page, name, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, name, '$' || (key + 100), 'USD', '1.0' FROM s""")
def csv_export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat export of 14 columns: companies, then quotes with their owners."""
    companies, quotes, _ = _seeds(spark, sf_dir)
    return rollup.csv_rows(companies, quotes).drop("kind", "place")


@query(_RESULTS + """
    SELECT s.seed_url, name AS "listing", s.email, 'N/A' AS phone, name || ' $' || (key + 100) || ' USD' AS own_quote, '73%' AS confidence, r.status FROM s JOIN r ON r.seed_url = s.seed_url
    UNION ALL SELECT seed_url, 'N/A', 'N/A', 'N/A', NULL, 'N/A', status FROM r WHERE n_companies = 0""")
def analyst_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analyst's table, with each company's own quote among its quotes, and a row for each seed without companies (A5, F8)."""
    t = rollup.analyst_table(*_seeds(spark, sf_dir))
    name = F.col("`Listing / Business Name`")
    own = F.get(F.filter(F.split("Quotes", "; "), lambda q: q.startswith(F.concat(name, F.lit(" $")))), F.lit(0))
    return t.select(
        "seed_url", name.alias("listing"), F.col("Email").alias("email"), F.col("Phone").alias("phone"), own.alias("own_quote"),
        F.col("Confidence").alias("confidence"), F.col("Status").alias("status")
    )


@query(_RESULTS + " SELECT sum(greatest(n_companies, 1))::BIGINT AS listings, sum(n_quotes)::BIGINT AS quotes, sum(n_pages)::BIGINT AS pages FROM r")
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over all seeds."""
    return rollup.run_metrics(_seeds(spark, sf_dir)[2])


@query("""
    SELECT c_custkey, '"pages, house",Shop ' || c_custkey || ',,"Say ""hi""' || '",,+44' || c_custkey || ',,,a; b,0.5,ok' AS line FROM customer""")
def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row export with quoted cells (A4)."""
    c, none = table(spark, sf_dir, "customer"), F.lit(None).cast("string")
    name = F.concat(F.lit("Shop "), F.col("c_custkey"))
    rows = c.select(
        "c_custkey", F.lit("").alias("source_url"), F.lit("pages, house").alias("url"), name.alias("company_name"), none.alias("business_name"),
        F.lit('Say "hi"').alias("listing_name"), none.alias("email"), F.concat(F.lit("+44"), F.col("c_custkey")).alias("phone"),
        none.alias("address"), none.alias("website"), F.array(F.lit("a"), F.lit("b")).alias("socials"), F.lit("0.5").alias("confidence"),
        F.lit("ok").alias("status")
    )
    done = rollup.status_rows(rows)
    return done.select(F.regexp_extract("company_name", r"(\d+)", 1).cast("long").alias("c_custkey"), "line")


@query(
    _FACTS + """ SELECT key, 'Model House ' || key AS company_name, email, '+1202' || lpad(key::VARCHAR, 7, '5') AS phone, CASE WHEN key % 2 = 0 THEN 0.9 ELSE 1.0 END::DOUBLE AS ai_confidence, 1 AS n_quotes FROM f"""
)
def model_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests made from records, answers joined by hash, normalised and applied."""
    f = corpora.supplier_facts(spark, sf_dir)
    none = F.array().cast("array<string>")
    rows = f.select(
        "key", F.lit("https://model.house/").alias("source_url"), F.lit("body > div").alias("container_path"), F.lit("").alias("heading"),
        F.concat_ws(" ", "name", "address").alias("text"), F.array(F.struct(F.lit("x").alias("text"), F.col("social").alias("href"))).alias("links"),
        F.struct("name").alias("traditional"), F.struct(F.lit(1).alias("signal_count")).alias("dom_signals"), F.lit("").alias("company_name"),
        F.lit("").alias("business_name"), F.lit("").alias("listing_name"), none.alias("emails"), none.alias("phone_numbers"), none.alias("addresses"),
        none.alias("socials"), *[F.lit(None).cast("string").alias(c) for c in ("email", "phone", "address", "website")],
        F.lit(0.2).alias("confidence")
    )
    asked = materialize(R.model_requests(rows), "requests")
    number = F.regexp_extract("request", r"Vendor House (\d+)", 1)
    # numbers as numbers or text, lists as lists or single values, a quote without a price
    answer = F.concat(
        F.lit('{"company_name":"Model House '), number, F.lit(' ","emails":"sales'), number, F.lit("@house"), number, F.lit('.co","phones":["+1202'),
        F.lpad(number, 7, "5"), F.lit('"],"confidence":'), F.when(number.cast("long") % 2 == 0, "0.9").otherwise('"7"'),
        F.lit(',"quotes":[{"title":"a","price":"$5","currency":"usd"},{"title":"b","price":""}]}')
    )
    known = asked.select("request_hash", answer.alias("response"))
    hashed = rows.join(asked.select("request_hash", number.cast("long").alias("key")), "key")
    said = materialize(R.normalize_responses(R.cached(asked, known)), "responses")
    done = R.apply_responses(hashed, said)
    n = R.model_quotes(done, said).groupBy("company").agg(F.count("*").cast("int").alias("n_quotes"))
    return done.join(n, done.company_name == n.company).select("key", "company_name", "email", "phone", "ai_confidence", "n_quotes")


@query(
    _FACTS + """ SELECT key, CASE key % 3 WHEN 0 THEN 'https://model.house/about' WHEN 1 THEN 'https://shop' || key || '.co/x' ELSE 'https://model.house/list/shop' || key || '.co' END AS website,
      'https://model.house/fb' || key || ' https://facebook.com/house' || key AS socials, '+' || rpad(key::VARCHAR, 31, '0') AS phone, 'usd of ' || key % 10 || ' at' AS currency, 'a, b' AS pages FROM f"""
)
def model_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with relative links, long phones, currencies as written and repeated entries, resolved on the page that they were asked about."""
    f = corpora.supplier_facts(spark, sf_dir)
    k = F.col("key").cast("string")
    site = F.when(F.col("key") % 3 == 0, "/about").when(F.col("key") % 3 == 1, F.concat(F.lit("//shop"), k, F.lit(".co/x#top"))).otherwise(F.concat(F.lit("shop"), k, F.lit(".co")))
    answer = F.to_json(
        F.struct(
            F.lit("Model House").alias("company_name"), F.concat(F.lit("+"), F.rpad(k, 50, "0")).alias("phones"), site.alias("website"),
            F.array(F.concat(F.lit("../fb"), k), F.concat(F.lit("//facebook.com/house"), k, F.lit("/")), F.concat(F.lit("/fb"), k, F.lit("#x"))).alias("social_links"),
            F.array(
                F.struct(F.lit("a").alias("title"), F.lit("$5").alias("price"), F.concat(F.lit("usd of "), F.col("key") % 10, F.lit(" at home")).alias("currency")),
                F.struct(F.lit("b").alias("title"), F.lit("6").alias("price"), F.lit("").alias("currency"))
            ).alias("quotes")
        )
    )
    asked = f.select(k.alias("request_hash"), F.lit("https://model.house/list/").alias("source_url"), answer.alias("response"))
    said = R.normalize_responses(asked)
    return said.select(
        F.col("request_hash").cast("long").alias("key"), "website", F.array_join("social_links", " ").alias("socials"), F.get("phones", F.lit(0)).alias("phone"),
        F.get("quotes", F.lit(0))["currency"].alias("currency"), F.array_join(F.transform("quotes", lambda q: q["title"]), ", ").alias("pages")
    )


@query(_ANCHORS + """, k AS (SELECT page_id, url, min(rank) AS rank FROM w WHERE rank <= 150 GROUP BY page_id, url), n AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY rank) AS i FROM k)
    SELECT page_id, url, least(1.0, (length(url) % 13) / 10.0)::DOUBLE AS model_score FROM n WHERE i <= 40 AND length(url) % 13 <> 5""")
def model_page_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a page's first links as a model answers them; what is no number is dropped."""
    asked = R.page_score_requests(_ranked(spark, sf_dir), "page_id")
    said = F.map_from_entries(F.transform("urls", lambda u: F.struct(u, F.when(F.length(u) % 13 == 5, "none").otherwise((F.length(u) % 13 / 10.0).cast("string")))))
    return R.page_scores(asked.select("page_id", F.to_json(said).alias("response")), "page_id")


def _page_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "pages").schema
    reader = spark.readStream.schema(schema)
    whole = table(spark, sf_dir, "pages").inputFiles()[0].endswith("/pages.parquet")  # one file, beside others
    source = reader.option("pathGlobFilter", "pages.parquet").parquet(sf_dir) if whole else reader.parquet(f"{sf_dir}/pages.parquet")
    return directory.with_seed(source)


@query("SELECT DISTINCT regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\\.', '') AS seed_url, url FROM pages")
def streamed_new_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that arrive as a stream, each seed and URL once (K1)."""
    stream = _page_stream(spark, sf_dir)
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    new = incremental.new_pages(stream.select("seed_url", "url"))
    new.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").select("seed_url", "url")


@query("""
    WITH p AS (SELECT DISTINCT regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\\.', '') AS seed_url, url FROM pages)
    SELECT seed_url, count(*) AS n_pages, min(url) AS first_url FROM p GROUP BY seed_url""")
def streamed_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of the seeds that arriving pages touch (K2)."""
    path = f"{shared_dir(spark)}/snapshots-{uuid.uuid4().hex}"
    run = incremental.snapshots(
        incremental.new_pages(_page_stream(spark, sf_dir)),
        f"{path}/out",
        f"{path}/state",
        lambda batch: batch.select("seed_url", "url"),
        lambda records: records.groupBy("seed_url").agg(F.count("*").alias("n_pages"), F.min("url").alias("first_url")),
    )
    run.awaitTermination()
    return incremental.latest(spark, f"{path}/out").select("seed_url", "n_pages", "first_url")


@query(_SEEDS + """ SELECT seed_url, name AS company_name, email, address FROM s""")
def streamed_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of companies that arrive in two batches, extracted, and merged for the seeds that they touch (K1, K2)."""
    path = f"{shared_dir(spark)}/companies-{uuid.uuid4().hex}"
    pages = _seed_pages(spark, sf_dir).filter("html is not null").select("page_id", "url", "html", "seed_url")
    pages.repartition(2, "page_id").write.parquet(f"{path}/in")
    stream = incremental.page_stream(spark, f"{path}/in", pages.schema, 1)

    def merged(records: DataFrame) -> DataFrame:
        return resolve(records, "seed_url").withColumnRenamed("scope", "seed_url")

    def found(batch: DataFrame) -> DataFrame:
        return directory.extract(batch, cap=None).companies.withColumnRenamed("place", "pos")

    incremental.snapshots(incremental.new_pages(stream), f"{path}/out", f"{path}/state", found, merged).awaitTermination()
    return incremental.latest(spark, f"{path}/out").select("seed_url", "company_name", "email", "address")


@query("""
    SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'info@s' || s_suppkey || '.co' END AS email, CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE '+1 (202) ' || lpad(s_suppkey::VARCHAR, 7, '0') END AS phone,
           CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_suppkey || ' Mill Road' END AS address, 'Big Shop' || s_suppkey || 'A' AS host_name FROM supplier""")
def sanitized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single contacts cleaned or dropped, and names from hosts."""
    k = F.col("s_suppkey")
    email = F.when(k % 3 == 0, F.concat(F.lit("name@s"), k)).otherwise(F.concat(F.lit(" Info@S"), k, F.lit(".co :")))
    phone = F.when(k % 2 == 0, "tel 12-34").otherwise(F.concat(F.lit("tel+1 (202) "), F.lpad(k, 7, "0"), F.lit("x")))
    address = F.when(k % 5 == 0, " - 1 ").otherwise(F.concat(k, F.lit("\n Mill  Road |")))
    host = U.name_from_url(F.concat(F.lit("https://www.big-shop"), k, F.lit("a.co:80/x")))
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", T.sanitize_email(email).alias("email"), T.sanitize_phone(phone).alias("phone"), T.sanitize_address(address).alias("address"),
        host.alias("host_name")
    )


@query("""
    WITH w AS (SELECT page_id, string_split(regexp_replace(html, '<[^>]*>', ' ', 'g'), ' ') AS a FROM pages), u AS (SELECT page_id, unnest(a) AS v, generate_subscripts(a, 1) AS i FROM w),
    f AS (SELECT page_id, lower(trim(v)) AS k, min(i) AS i, arg_min(v, i) AS v FROM u WHERE trim(v) <> '' GROUP BY ALL)
    SELECT page_id, string_agg(v, ' ' ORDER BY i) AS kept FROM f GROUP BY page_id""")
def distinct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of each page's text, each kept once in order without regard to case."""
    pieces = F.split(F.regexp_replace("html", "<[^>]*>", " "), " ")
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(T.unique_keep_order(pieces), " ").alias("kept")).filter("kept <> ''")
