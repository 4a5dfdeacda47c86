"""Batches of seed URLs, and the tables that stand for a model's requests and responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from harvestry.functions import scoring as S
from harvestry.functions import text as T
from harvestry.functions import urls as U
from harvestry.functions.helpers import joined_urls

MAX_URLS, MAX_SCORED = 10, 40
RESPONSE = "company_name string, emails variant, phones variant, address string, website string, social_links variant, quotes variant, page_type string, confidence variant"


def validate_batches(requests: DataFrame, limit: int = MAX_URLS) -> DataFrame:
    """``(request_id, valid, message, valid_urls, invalid_urls, count)`` of batches ``(request_id, pos, url)``.

    Blank URLs are ignored, but count towards the limit; a scheme is added where there is none. A request whose only row has a null URL and
    position is an empty batch.
    """
    value = F.trim("url")
    rows = requests.select("request_id", "pos", value.alias("v"), U.is_valid_url(value).alias("ok"))
    rows = rows.withColumn("v", F.when(F.col("ok"), U.with_scheme(F.col("v"))).otherwise(F.col("v")))
    blank = F.coalesce(F.col("v") == "", F.lit(True))
    item = F.struct("pos", "v")
    done = rows.groupBy("request_id").agg(
        F.count("pos").alias("n"), F.collect_list(F.when(F.col("ok"), item)).alias("good"),
        F.collect_list(F.when(~F.col("ok") & ~blank, item)).alias("bad")
    )

    def urls(col: str) -> Column:
        return F.transform(F.array_sort(col), lambda x: x["v"])

    good, bad = F.size("good"), F.size("bad")
    some = (F.col("n") > 0) & (F.col("n") <= limit) & (good > 0)
    message = F.when(F.col("n") == 0, "No URLs provided").when(F.col("n") > limit, f"Maximum {limit} URLs allowed per request").when(good == 0, "No valid URLs found").when(
        bad > 0, F.format_string("Validated %d URLs. %d invalid.", good, bad)
    ).otherwise("All URLs are valid")
    none = F.array().cast("array<string>")
    return done.select(
        "request_id", some.alias("valid"), message.alias("message"), F.when(some, urls("good")).otherwise(none).alias("valid_urls"),
        F.when(some, urls("bad")).otherwise(none).alias("invalid_urls"), F.when(some, good).otherwise(0).alias("count")
    )


def model_requests(records: DataFrame, cut: int = 2200, max_links: int = 20) -> DataFrame:
    """``(request_hash, request)``: distinct payloads ``(source_url, container_path, heading, text, links, traditional, dom_signals)``; those without text and heading are left out."""
    payload = F.struct(
        "source_url", "container_path", F.coalesce("heading", F.lit("")).alias("heading"), T.clean_text(F.col("text"), cut).alias("text"),
        F.slice("links", 1, max_links).alias("links"), "traditional", "dom_signals"
    )
    rows = records.select(F.to_json(payload).alias("request"), payload.alias("p")).filter((F.col("p.text") != "") | (F.col("p.heading") != ""))
    return rows.select(F.sha2("request", 256).alias("request_hash"), "request").dropDuplicates(["request_hash"])


def pending(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """The requests that have no response yet."""
    return requests.join(responses.select("request_hash"), "request_hash", "left_anti")


def cached(requests: DataFrame, responses: DataFrame) -> DataFrame:
    return requests.join(responses, "request_hash")


def as_list(name: str) -> Column:
    """A field that may be a list or a single value, as an array of strings."""
    many, one = F.expr(f"try_variant_get({name}, '$', 'array<string>')"), F.expr(f"try_variant_get({name}, '$', 'string')")
    return F.filter(F.coalesce(many, F.array(one)), lambda x: x.isNotNull() & (F.trim(x) != ""))


def normalize_responses(responses: DataFrame) -> DataFrame:
    """Clean columns of ``(request_hash, response)``: cut texts, distinct lists, valid emails, scores between 0 and 1, quotes with a price.

    Website and social links are references on the ``source_url`` of the answer, or of its ``request``.
    """
    page = F.col("source_url") if "source_url" in responses.columns else F.get_json_object("request", "$.source_url") if "request" in responses.columns else F.lit(None).cast("string")
    rows = responses.select("request_hash", page.alias("page"), F.from_json("response", RESPONSE).alias("r")).select("request_hash", "page", "r.*")
    name = T.clean_company_name(F.col("company_name"))
    score = F.coalesce(F.expr("try_variant_get(confidence, '$', 'double')"), F.lit(0.0))
    quote = "array<struct<title: string, price: string, currency: string, description: string, confidence: double>>"
    quotes = F.coalesce(F.expr(f"try_variant_get(quotes, '$', '{quote}')"), F.expr(f"cast(array() as {quote})"))
    quotes = F.transform(
        F.filter(quotes, lambda q: S.present(T.clean_text(q["price"]))),
        lambda q: F.struct(
            T.clean_text(q["title"], 120).alias("title"), T.clean_text(q["price"], 80).alias("price"),
            T.clean_text(q["currency"], 12).alias("currency"), T.clean_text(q["description"], 300).alias("description"),
            S.clamp(F.coalesce(q["confidence"], F.lit(0.0))).alias("confidence")
        )
    )
    return rows.select(
        "request_hash",
        F.when(T.has_real_name(name), name).otherwise("").alias("company_name"),
        T.unique_keep_order(F.filter(F.transform(as_list("emails"), lambda e: F.lower(T.clean_text(e))), lambda e: T.is_valid_email(e))).alias("emails"),
        T.unique_keep_order(F.transform(as_list("phones"), lambda p: T.clean_text(p, 32))).alias("phones"),
        T.clean_text(F.col("address"), 240).alias("address"),
        F.coalesce(F.get(joined_urls("page", F.array("website")), F.lit(0)), F.lit("")).alias("website"),
        T.unique_keep_order(joined_urls("page", as_list("social_links"))).alias("social_links"),
        quotes.alias("quotes"),
        T.clean_text(F.col("page_type"), 80).alias("page_type"),
        S.clamp(score).alias("confidence"),
    )


def apply_responses(records: DataFrame, normalized: DataFrame, region: str = "NG") -> DataFrame:
    """Company records (with ``request_hash`` and ``heading``) after what a model said of their blocks.

    A name of confidence 0.35 and more, or where there was none, replaces; contacts are united in order; a website replaces; the score is
    worked out anew, blended with the model's, and the larger counts.
    """
    said = normalized.select(
        "request_hash",
        *[F.col(c).alias(f"m_{c}") for c in ("company_name", "emails", "phones", "address", "website", "social_links", "page_type", "confidence")]
    )
    rows = records.join(said, "request_hash", "left")
    told = F.col("m_confidence").isNotNull()
    ai = F.coalesce("m_confidence", F.lit(0.0))
    none = F.array().cast("array<string>")

    def united(own: str, more: Column) -> Column:
        return F.when(told, T.unique_keep_order(F.concat(F.coalesce(own, none), more))).otherwise(F.coalesce(own, none))

    rename = told & S.present(F.col("m_company_name")) & ((ai >= 0.35) | ~S.present(F.col("company_name")))
    rows = rows.withColumn("company_name", F.when(rename, F.col("m_company_name")).otherwise(F.col("company_name")))
    rows = rows.withColumns({
        "emails": united("emails", F.coalesce("m_emails", none)),
        "phone_numbers": united("phone_numbers", F.transform(F.coalesce("m_phones", none), lambda p: T.normalize_phone(p, region))),
        "addresses": united("addresses", F.array(F.coalesce("m_address", F.lit("")))),
        "socials": united("socials", F.coalesce("m_social_links", none)),
        "website": F.when(told & S.present(F.col("m_website")), F.col("m_website")).otherwise(F.col("website")),
    })
    rows = rows.withColumns({one: F.coalesce(F.get(many, F.lit(0)), one) for one, many in (("email", "emails"), ("phone", "phone_numbers"), ("address", "addresses"))})
    rows = rows.withColumns({c: F.when(rename, F.col("company_name")).otherwise(F.col(c)) for c in ("business_name", "listing_name")})
    fresh = S.entity_confidence(
        F.col("company_name"), F.col("email"), F.col("phone"), F.col("address"), F.col("website"), F.col("socials"), same_block=True,
        header=S.present(F.col("heading")), semantic=ai >= 0.6, ai=ai
    )
    rows = rows.withColumn("_new", fresh)
    blended = F.greatest("_new", F.round(F.col("_new") * 0.65 + ai * 0.35, 3))
    rows = rows.withColumn("confidence", F.when(told, blended).otherwise(F.col("confidence")))
    return rows.withColumn("ai_confidence", F.col("m_confidence")).withColumn("page_type", F.col("m_page_type")).drop("_new", *[c for c in said.columns if c != "request_hash"])


def model_quotes(records: DataFrame, normalized: DataFrame) -> DataFrame:
    """The quotes that a model found, named by its company or the record's."""
    rows = records.select("request_hash", "source_url", F.col("company_name").alias("own")).join(
        normalized.select("request_hash", F.col("company_name").alias("said"), "quotes"), "request_hash"
    )
    rows = rows.select("source_url", F.coalesce(F.nullif("said", F.lit("")), F.col("own"), F.lit("")).alias("company"), F.posexplode("quotes").alias("pos", "q"))
    return rows.select("source_url", "pos", "company", "q.title", "q.price", "q.currency", "q.description", F.lit("ai_container").alias("extraction_scope"), "q.confidence")


def page_score_requests(links: DataFrame, key: str = "page_url", limit: int = MAX_SCORED) -> DataFrame:
    """The first ``limit`` distinct URLs of each page, as one request: ``(key, urls)``."""
    first = links.groupBy(key, "url").agg(F.min("rank").alias("rank"))
    first = first.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("rank", "url"))).filter(F.col("n") <= limit)
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "url"))), lambda x: x["url"]).alias("urls"))


def page_scores(responses: DataFrame, key: str = "page_url") -> DataFrame:
    """``(key, url, model_score)`` of JSON answers ``{url: score}``; what is no number is dropped, scores are clamped."""
    rows = responses.select(key, F.explode(F.from_json("response", "map<string, string>")).alias("url", "said"))
    return rows.select(key, "url", S.clamp(F.col("said").try_cast("double")).alias("model_score")).filter("model_score is not null")
