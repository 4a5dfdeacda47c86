"""Blocks of a page that each hold one listing, and their records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from harvestry.functions import scoring as S
from harvestry.functions import text as T
from harvestry.functions import urls as U
from harvestry.functions import vocabulary as V
from harvestry.functions.helpers import html_unescape, url_join
from harvestry.operators.contacts import attr_has, both, class_has, has_attr, is_class, signals, tag_is, with_contacts, with_index
from harvestry.sources.shared import materialize

MAX_BLOCKS, MAX_SECTIONS = 80, 40
PAGE_SHARE, SECTION_SHARE = 0.75, 0.65

#: What may be the block of a company.
BLOCK_PLACES = (
    *[both(has_attr("itemscope"), attr_has("itemtype", w)) for w in ("Organization", "LocalBusiness")],
    *[has_attr(a) for a in ("data-company", "data-business", "data-listing")],
    *[attr_has("data-testid", w) for w in ("company", "business", "listing")],
    *[is_class(c) for c in ("company-card", "company", "profile-card", "business-card", "vendor-card", "listing", "directory-item")],
    *[class_has(w) for w in ("company-card", "business-card", "vendor-card", "profile-card", "listing-card", "directory-item", "search-result", "result-card")],
    *[tag_is(t) for t in ("article", "li", "section")],
)
CONTAINERS = ("main", "body", "section", "article", "ul", "ol", "table")
CONTAINER_CLASSES = ("list", "grid", "results", "directory")
LISTING_TAGS = ("div", "li", "article", "section", "tr")
SECTION_PLACES = (
    *[class_has(w) for w in ("contact", "about", "profile", "company", "business", "pricing", "package")],
    *[attr_has("id", w) for w in ("contact", "about", "profile", "pricing")],
    *[tag_is(t) for t in ("address", "article", "section")],
)


def hits(places: tuple[str, ...]) -> str:
    """How many of the places a node ``n`` stands at, in SQL text."""
    return "(" + " + ".join(f"int(coalesce({p}, false))" for p in places) + ")"


def _under(test: str) -> str:
    """Whether the parent ``u`` of a node ``n`` passes a test."""
    return f"coalesce(exists(slice(nodes, n.parent_id + 1, 1), u -> {test}), false)"


def candidates() -> Column:
    """The nodes that a rule may take for a block, with how many places name each as one, as a listing, and as a section."""
    container = " or ".join([tag_is(*CONTAINERS, node="u"), *[class_has(c, node="u") for c in CONTAINER_CLASSES]])
    listed = f"int(n.parent_id >= 0 and {tag_is(*LISTING_TAGS)} and if(n.parent_id >= 0, {_under(container)}, false))"
    main = f"int(n.parent_id >= 0 and n.tag = 'div' and if(n.parent_id >= 0, {_under(tag_is('main', node='u'))}, false))"
    judged = f"transform(nodes, n -> struct(n as b, {hits(BLOCK_PLACES)} as direct, {listed} as listed, {hits(SECTION_PLACES)} + {main} as section))"
    return F.expr(f"filter({judged}, w -> w.direct + w.listed + w.section > 0 and w.b.tok_len > 0)")


def indexed(parsed: DataFrame) -> DataFrame:
    """Parsed pages with the index of their places, written."""
    return parsed if "hits" in parsed.columns else materialize(with_index(parsed), "indexed")


def blocks_of(parsed: DataFrame, wanted: Column, *keep: str) -> DataFrame:
    """Rows for the nodes ``b`` in the array ``wanted`` of structs ``(b, direct, listed, section)``, each with its text and its part of the index.

    No row carries nodes of its page: the parts of the index are cut before the nodes become rows.
    """
    page_len = F.length(T.parsed_text(F.array_join("tokens", " ")))
    cut = F.transform(
        wanted, lambda w: F.struct(
            w.alias("w"), F.filter("hits", lambda h: (h["id"] > w["b"]["node_id"]) & (h["id"] < w["b"]["end_id"])).alias("hits"),
            F.filter("labelled", lambda h: (h["id"] > w["b"]["node_id"]) & (h["id"] < w["b"]["end_id"])).alias("labelled"),
            F.slice("tokens", w["b"]["tok_start"] + 1, w["b"]["tok_len"]).alias("own"), F.substring("html", w["b"]["html_start"] + 1, w["b"]["html_len"]).alias("markup")
        )
    )
    rows = indexed(parsed).select(*keep, "url", page_len.alias("page_len"), F.explode(cut).alias("c"))
    return rows.select(
        *keep, "url", "page_len", "c.w.b", "c.w.direct", "c.w.listed", "c.w.section", "c.hits", "c.labelled",
        T.parsed_text(F.array_join("c.own", " ")).alias("text"), F.array_join("c.own", "\n").alias("lines"), "c.markup"
    )


def detect_blocks(parsed: DataFrame, *keep: str, region: str = "NG", noise=V.NOISE_EMAIL_PARTS, cap: int | None = MAX_BLOCKS, section_cap: int | None = MAX_SECTIONS, **caps) -> DataFrame:
    """The listing blocks of each page with their contacts: company blocks, repeated siblings, else sections.

    ``keep`` must hold the page's key as its first column. A node that several places name is one row with ``n_hits``. Of nested
    candidates the innermost stay, and of equally long ones the first. The innermost ``cap`` hits stay, shortest first, or
    ``section_cap`` of a page that only has sections; without a cap all do. ``caps`` are those of a block's addresses and social links.
    Contacts are extracted once for every node that any rule looks at; one shuffle brings a page's candidates together.
    A page that names its own ``region`` in ``parsed`` has its phones read by the rule of that one.
    """
    key, own_region = keep[0], "region" in parsed.columns
    if own_region:
        keep = tuple(dict.fromkeys((*keep, "region")))
    n = F.length("text")
    rows = blocks_of(parsed, candidates(), *keep).filter(n >= 20)
    rows = rows.filter(
        ((F.col("direct") > 0) & (n <= PAGE_SHARE * F.col("page_len"))) | ((F.col("listed") > 0) & (n <= 1200)) | (
            (F.col("section") > 0) & (n <= SECTION_SHARE * F.col("page_len"))
        )
    )
    rows = with_contacts(rows, F.coalesce("region", F.lit(region)) if own_region else region, noise, **caps).drop("hits", "labelled", "markup", "lines")
    # what follows looks at all candidates of a page, and is planned above the windows: contacts are not worked out again
    rows = rows.withColumn("n_candidates", F.count("*").over(Window.partitionBy(key))).withColumn("signals", signals())
    contacts = F.size("emails") + F.size("phones") + F.size("addresses")
    viable = (F.col("listed") > 0) & (n <= 1200) & (F.col("name") != "") & ((F.col("signals") >= 2) | (contacts >= 1))
    siblings = F.sum(viable.cast("int")).over(Window.partitionBy(key, F.col("b.parent_id")))
    own = (F.col("direct") > 0) & (n <= PAGE_SHARE * F.col("page_len")) & ((F.col("signals") >= 2) | ((F.col("signals") >= 1) & (F.col("name") != "")))
    rows = rows.withColumn("n_hits", F.when(own, F.col("direct")).otherwise(0) + F.when(viable & (siblings >= 2), 1).otherwise(0))
    rows = rows.withColumn("any", F.max("n_hits").over(Window.partitionBy(key)))
    fallback = (F.col("any") == 0) & (F.col("section") > 0) & (n <= SECTION_SHARE * F.col("page_len")) & (F.col("signals") >= 1)
    rows = rows.withColumn("n_hits", F.when(fallback, F.col("section")).otherwise(F.col("n_hits"))).filter("n_hits > 0")
    most = F.when(F.col("any") == 0, F.lit(section_cap).cast("long")).otherwise(F.lit(cap).cast("long"))
    return _innermost(rows, key, most).drop("any", "direct", "listed", "section", "n_candidates")


def innermost(found: DataFrame, key: str) -> DataFrame:
    """The candidates ``(b, text)`` of each page that hold no shorter one and stand in none as long.

    Nodes are nested or apart, so that in document order a candidate holds the one after it, or none. Texts of nodes that are apart add up: of a
    node's candidates the first is as long as the node only if it holds all others. So candidates as long as each other follow each other, each in the one before, and what
    the last of them holds is shorter. One pass over a page decides.
    """
    start, end, n = F.col("b.node_id"), F.col("b.end_id"), F.length("text")
    order = Window.partitionBy(key).orderBy(start)
    goes_on = F.coalesce((F.lag(end).over(order) >= end) & (F.lag(n).over(order) == n), F.lit(False))
    holds = F.coalesce((F.lead(start).over(order) < end) & (F.lead(n).over(order) < n), F.lit(False))
    rows = found.withColumns({"_goes_on": goes_on, "_holds": holds})
    rows = rows.withColumn("_chain", F.sum((~F.col("_goes_on")).cast("int")).over(order))
    rows = rows.withColumn("_held", F.max("_holds").over(Window.partitionBy(key, "_chain")))
    return rows.filter("not _goes_on and not _held").drop("_goes_on", "_holds", "_chain", "_held")


def _innermost(found: DataFrame, key: str, cap: Column) -> DataFrame:
    """The first ``cap`` hits of the innermost candidates, shortest first."""
    found = innermost(found, key)
    order = Window.partitionBy(key).orderBy(F.length("text"), F.col("b.node_id"))
    before = F.coalesce(F.sum("n_hits").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return found.withColumn("before", before).filter(F.coalesce(F.col("before") < cap, F.lit(True))).withColumn("pos", F.row_number().over(order) - 1).drop("before")


def entities(blocks: DataFrame, *keep: str) -> DataFrame:
    """One company record per block of :func:`detect_blocks`, records without a real name or any contact left out."""
    host_name = U.name_from_url(F.coalesce(F.nullif("website", F.lit("")), F.col("url")))
    name = T.parsed_name(F.coalesce(F.nullif("name", F.lit("")), host_name))
    rows = blocks.select(
        *keep, F.col("url").alias("source_url"), "pos", "n_hits", name.alias("company_name"), F.col("b.path").alias("container_path"), "emails",
        F.col("phones").alias("phone_numbers"), "addresses", F.nullif("website", F.lit("")).alias("website"), "socials",
        F.lit("dom_block").alias("extraction_scope")
    )
    rows = rows.withColumns(
        {
            "email": F.get("emails", F.lit(0)), "phone": F.get("phone_numbers", F.lit(0)), "address": F.get("addresses", F.lit(0)),
            "business_name": F.col("company_name"), "listing_name": F.col("company_name")
        }
    )
    rows = rows.withColumn(
        "confidence",
        S.entity_confidence(F.col("company_name"), F.col("email"), F.col("phone"), F.col("address"), F.col("website"), F.col("socials"), same_block=True)
    )
    return useful(rows)


def useful(rows: DataFrame) -> DataFrame:
    some = S.present(F.col("email")) | S.present(F.col("phone")) | S.present(F.col("address")) | S.present(F.col("website")) | (F.size("socials") > 0)
    return rows.filter(T.has_real_name(F.col("company_name")) & some)


def with_low_confidence(rows: DataFrame, threshold: float = 0.45) -> DataFrame:
    """Rows are kept, and flagged."""
    return rows.withColumn("low_confidence", F.col("confidence") < threshold)


def structured_entities(parsed: DataFrame, *keep: str, region: str = "NG", validate: bool = False) -> DataFrame:
    """Company records of the JSON-LD scripts of each parsed page: objects, lists and graphs; bad JSON is skipped."""
    rows = parsed.select(*keep, "url", F.posexplode("scripts").alias("script", "body"))
    rows = rows.select(*keep, "url", "script", F.try_parse_json("body").alias("v")).filter("v is not null")
    return _structured(rows, keep, region, validate)


def _structured(rows: DataFrame, keep: tuple, region: str, validate: bool) -> DataFrame:
    # a single object is a list of one, and so is an object without a graph
    as_list = F.expr("coalesce(try_variant_get(v, '$', 'array<variant>'), array(v))")
    rows = rows.select(*keep, "url", "script", F.posexplode(as_list).alias("i", "item"))
    graph = F.expr("coalesce(try_variant_get(item, \"$['@graph']\", 'array<variant>'), array(item))")
    rows = rows.select(*keep, "url", "script", "i", F.posexplode(graph).alias("j", "o"))

    def text(path: str) -> Column:
        return F.expr(f"try_variant_get(o, \"{path}\", 'string')")

    kinds = F.lower(F.coalesce(F.array_join(F.expr("try_variant_get(o, \"$['@type']\", 'array<string>')"), " "), text("$['@type']"), F.lit("")))
    is_object = F.expr("schema_of_variant(try_variant_get(o, '$.address', 'variant')) like 'OBJECT%'")
    parts = ("streetAddress", "addressLocality", "addressRegion", "addressCountry")
    said = {"name": text("$.name"), "mail": text("$.email"), "call": text("$.telephone"), "site": text("$.url"), "place": F.when(~is_object, text("$.address"))}
    said |= {f"part{k}": text(f"$.address.{p}") for k, p in enumerate(parts)}
    # strings of JSON may hold entities of any kind; few rows get here
    where = F.row_number().over(Window.partitionBy(*keep, "url").orderBy("script", "i", "j")) - 1
    rows = rows.filter(kinds.rlike("organization|localbusiness|corporation")).withColumn("pos", where)
    rows = rows.select(*keep, "url", "pos", *[html_unescape(c).alias(n) for n, c in said.items()])
    told = F.filter(F.array(*[T.parsed_text(F.col(f"part{k}")) for k in range(len(parts))]), lambda x: x != "")
    address = T.parsed_text(F.coalesce("place", F.array_join(told, ", ")), 240)
    email, phone = F.lower(T.parsed_text(F.col("mail"))), T.normalize_phone(F.col("call"), region, parsed=True)
    site = F.when(F.coalesce(F.trim("site"), F.lit("")) == "", "").otherwise(url_join("url", "site"))
    name = T.parsed_name(F.col("name"))
    if validate:
        email = F.when(T.is_valid_email(email), email).otherwise("")
    none = F.array().cast("array<string>")

    def one(x: Column) -> Column:
        return F.when(S.present(x), F.array(x)).otherwise(none)

    done = rows.select(
        *keep, F.col("url").alias("source_url"), "pos", name.alias("company_name"), email.alias("email"), phone.alias("phone"),
        address.alias("address"), site.alias("website"), F.col("call").isNotNull().alias("called")
    )
    done = done.withColumns(
        {"emails": one(F.col("email")), "phone_numbers": F.when(F.col("called"), F.array("phone")).otherwise(none), "addresses": one(F.col("address")), "socials": none}
    )
    done = done.withColumns({c: F.nullif(c, F.lit("")) for c in ("email", "phone", "address", "website")})
    done = done.withColumns(
        {
            "n_hits": F.lit(1), "container_path": F.lit(None).cast("string"), "extraction_scope": F.lit("structured_data"),
            "business_name": F.col("company_name"), "listing_name": F.col("company_name")
        }
    ).drop("called")
    score = S.entity_confidence(F.col("company_name"), F.col("email"), F.col("phone"), F.col("address"), F.col("website"), F.col("socials"), structured=True)
    return useful(done.withColumn("confidence", score))
