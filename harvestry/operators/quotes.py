"""Price quotes: containers, one quote each, distinct quotes, and their owners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from harvestry.functions import scoring as S
from harvestry.functions import text as T
from harvestry.functions.helpers import name_ratio
from harvestry.operators.contacts import attr_is, class_has, firsts, is_class, node_text, tag_is
from harvestry.plans.skew import ranked_within

MAX_CONTAINERS, SHARE, ATTACH = 80, 0.75, 0.35

CONTAINER_PLACES = (
    *[is_class(c) for c in ("pricing", "price", "plan", "package", "fee", "quote")],
    *[class_has(w) for w in ("pricing", "package", "price")],
    *[tag_is(t) for t in ("table", "article", "section", "li")],
)
TITLE_PLACES = (*[tag_is(t) for t in ("h1", "h2", "h3", "h4")], *[is_class(c) for c in ("title", "plan-name", "package-name")])
HINT_PLACES = (
    attr_is("itemprop", "name"),
    *[is_class(c) for c in ("company-name", "business-name", "profile-name")],
    *[tag_is(t) for t in ("h1", "h2", "h3", "h4", "strong")],
)


def _first(array: str, places, keep) -> Column:
    """The first text over the places that ``keep`` accepts; empty if none."""
    texts = F.transform(firsts(array, places), lambda n: F.when(n["node_id"].isNotNull(), T.parsed_text(node_text(n), 120)))
    return F.coalesce(F.get(F.filter(texts, lambda t: t.isNotNull() & keep(t)), F.lit(0)), F.lit(""))


def containers(parsed: DataFrame, *keep: str, roots: DataFrame | None = None, strict: bool = False, cap: int | None = MAX_CONTAINERS) -> DataFrame:
    """The outermost price containers of each page, or of each root block (``keep[0]``, ``root_id``), with their subtree.

    A container has 8 characters and a price, and at most three quarters of the text of its scope. The outermost stay, ``cap`` hits
    in order of their places, or all without a cap. With ``roots`` a block without containers that shows a price is its own container.
    """
    key = keep[0]
    pages = parsed.select(*keep, "url", "nodes", "tokens")
    if roots is None:
        rows = pages.withColumn("root", F.lit(None).cast("int")).withColumn("inner", F.col("nodes"))
        scope_text = F.array_join("tokens", " ")
    else:
        rows = pages.join(roots.select(key, F.col("root_id").alias("root")).distinct(), key)
        at = F.get("nodes", F.col("root"))
        rows = rows.withColumn("inner", F.slice("nodes", F.col("root") + 2, at["end_id"] - F.col("root") - 1))
        scope_text = node_text(F.get("nodes", F.col("root")))
    places = f"array({', '.join(f'coalesce({p}, false)' for p in CONTAINER_PLACES)})"
    judged = f"transform(inner, n -> transform(array({places}), o -> struct(n as b, array_position(o, true) as first, size(filter(o, x -> x)) as n_hits))[0])"
    wanted = f"filter({judged}, w -> w.n_hits > 0 and w.b.tok_len > 0)"
    # texts are cut before nodes become rows, which carry no others
    told = F.transform(F.expr(wanted), lambda w: F.struct(w["b"]["node_id"].alias("s"), w["b"]["end_id"].alias("e"), w["first"], w["n_hits"], T.parsed_text(node_text(w["b"])).alias("text")))
    found = rows.select(*keep, "url", "root", F.length(T.parsed_text(scope_text)).alias("scope_len"), F.explode(told).alias("w")).select(*keep, "url", "root", "scope_len", "w.*")
    n = F.length("text")
    found = outermost(found.filter((n >= 8) & S.has_price(F.col("text"), strict) & (n <= SHARE * F.col("scope_len"))), key, "root")
    order = Window.partitionBy(key, "root").orderBy("first", "s")
    before = F.coalesce(F.sum("n_hits").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = found.withColumn("before", before).filter(F.coalesce(F.col("before") < F.lit(cap).cast("long"), F.lit(True))).withColumn("pos", F.row_number().over(order) - 1)
    inner = F.slice("nodes", F.col("s") + 2, F.col("e") - F.col("s") - 1).alias("sub")
    found = found.select(key, "root", "pos", "text", "s", "e").join(pages, key).select(*keep, "url", "root", "tokens", "pos", "text", inner, "nodes")
    if roots is not None:
        own = rows.join(found.select(key, "root").distinct(), [key, "root"], "left_anti")
        own = own.withColumn("text", T.parsed_text(scope_text)).filter(S.has_price(F.col("text"), strict))
        found = found.unionByName(own.select(*keep, "url", "root", "tokens", F.lit(0).alias("pos"), "text", F.col("inner").alias("sub"), "nodes"))
    return found


def outermost(found: DataFrame, *scope: str) -> DataFrame:
    """The nodes ``(s, e)`` of each scope that stand in no other one: in document order, those that end behind all before them."""
    order = Window.partitionBy(*scope).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("_reach", F.max("e").over(order)).filter(F.coalesce(F.col("_reach") < F.col("e"), F.lit(True))).drop("_reach")


def quotes(found: DataFrame, *keep: str, scope: str = "pricing_container", strict: bool = False) -> DataFrame:
    """One quote per container: the first price in its first 600 characters. In blocks ``company`` is the block's hint."""
    rows = found.withColumn("cut", F.rtrim(F.substring("text", 1, 600))).withColumn("p", S.parse_price(F.col("cut"), strict)).filter("p is not null")
    root = F.get("nodes", F.col("root"))
    rows = rows.withColumn("inner", F.when(F.col("root").isNotNull(), F.slice("nodes", F.col("root") + 2, root["end_id"] - F.col("root") - 1)))
    hint = F.when(F.col("root").isNotNull(), _first("inner", HINT_PLACES, lambda t: (t != "") & ~S.has_price(t, strict))).otherwise("")
    rows = rows.withColumn("heading", _first("sub", TITLE_PLACES, lambda t: t != "")).withColumn("company", hint).withColumn("title", S.quote_title(F.col("heading"), F.col("cut")))
    rows = rows.withColumn("description", S.quote_description(F.col("cut"), F.col("title"), F.col("p.price")))
    score = S.quote_confidence(F.col("p.price"), F.col("p.currency"), F.col("title"), F.col("description"), F.lit(""), F.lit(True), S.starts_from(F.col("cut")))
    return rows.select(
        *keep, F.col("url").alias("source_url"), "root", "pos", "company", "title", "p.price", "p.amount", "p.currency", "description",
        F.lit(scope).alias("extraction_scope"), score.alias("confidence")
    )


def distinct_in_page(found: DataFrame, key: str) -> DataFrame:
    """The first of a page's quotes with the same title, price and description, case ignored."""
    same = [F.lower(F.trim(c)) for c in ("title", "price", "description")]
    order = Window.partitionBy(key, *same).orderBy(F.col("root").asc_nulls_first(), "pos")
    return found.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


def distinct_in_seed(found: DataFrame, seed: str) -> DataFrame:
    """The most confident of a seed's quotes with the same company, title, price and page, case ignored; ``place`` by confidence."""
    same = [F.lower(F.coalesce(c, F.lit(""))) for c in ("company", "title", "price", "source_url")]
    order = [F.desc("confidence"), F.col("source_url"), F.col("source_rank"), F.col("pos")]
    best = found.withColumn("n", F.row_number().over(Window.partitionBy(seed, *same).orderBy(*order))).filter("n = 1").drop("n")
    return ranked_within(best, seed, [*order, *[F.col(c).asc_nulls_first() for c in ("company", "title", "price")]], "place")


def all_quotes(in_blocks: DataFrame, in_pages: DataFrame, from_model: DataFrame | None = None) -> DataFrame:
    """The union in fixed order, with ``source_rank``."""
    both = in_blocks.withColumn("source_rank", F.lit(0)).unionByName(in_pages.withColumn("source_rank", F.lit(1)))
    return both if from_model is None else both.unionByName(from_model.withColumn("source_rank", F.lit(2)), allowMissingColumns=True)


def attach_companies(found: DataFrame, companies: DataFrame, key: str, least: float = ATTACH) -> DataFrame:
    """``found`` with ``company`` filled: by a page's only company, or by the best match of name and quote text.

    ``companies`` is ``(key, company_name, place)``. The match is the name ratio to title and description, and 0.5 more if the name is in it;
    of equal ones the first company; under ``least`` there is none. Only quotes without a company meet several companies, and only those pairs
    are compared that can get there by their lengths and characters.
    """
    counts = companies.groupBy(key).agg(F.count("*").alias("n_companies"), F.min_by("company_name", "place").alias("only"))
    rows = found.join(counts, key, "left").withColumn("open", (F.coalesce("company", F.lit("")) == "") & (F.col("n_companies") > 1))
    rest = rows.filter(~F.coalesce("open", F.lit(False))).withColumn(
        "company",
        F.when((F.coalesce("company", F.lit("")) == "") & (F.col("n_companies") == 1), F.coalesce("only", F.lit(""))).otherwise(F.coalesce("company", F.lit("")))
    )
    names = [c for c in found.columns if c != "company"]
    open_ = rows.filter("open").withColumn("said", F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")))))
    own = companies.select(F.col(key).alias("c_key"), F.coalesce("company_name", F.lit("")).alias("name"), F.col("place").alias("c_place"))
    # a ratio is at most what the lengths, and then the characters, of two texts allow: few pairs are worth the comparison itself
    inside = F.col("said").contains(F.lower("name"))
    most = F.when(F.col("name") == "", 0.0).otherwise(2 * F.least(F.length("name"), F.length("said")) / (F.length("name") + F.length("said")))
    met = open_.select(*names, "said").join(own, (F.col(key) == F.col("c_key")) & (inside | (most >= least - 1e-9))).drop("c_key")
    met = met.withColumn("inside", inside).filter(F.col("inside") | (common_characters("name", "said") >= least - 1e-9))
    met = met.withColumn("score", name_ratio("name", "said") + F.when(F.col("inside"), 0.5).otherwise(0.0)).drop("inside")
    ident = [key, "source_rank", "root", "pos"] if "source_rank" in names else [key, "root", "pos"]
    best = met.groupBy(*ident).agg(F.max_by(F.struct("name", "score"), F.struct("score", -F.col("c_place"))).alias("best"), *[F.first(c).alias(c) for c in names if c not in ident])
    best = best.withColumn("company", F.when(F.col("best.score") >= least, F.col("best.name")).otherwise(""))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ident]
    none = open_.join(best.select(*[F.col(c).alias(f"_{c}") for c in ident]), same, "left_anti").withColumn("company", F.lit(""))
    return rest.select(*found.columns).unionByName(best.select(*found.columns)).unionByName(none.select(*found.columns))


def common_characters(a: str, b: str) -> Column:
    """What the characters of two strings, as bags, leave of their ratio at most: counted for each character of the shorter one."""
    one, two = F.lower(a), F.lower(b)

    def count(text: Column, c: Column) -> Column:
        return F.length(text) - F.length(F.replace(text, c, F.lit("")))

    letters = F.array_distinct(F.split(one, ""))
    shared = F.reduce(letters, F.lit(0), lambda n, c: n + F.when(c == "", 0).otherwise(F.least(count(one, c), count(two, c))))
    return F.when((one == "") | (two == ""), 0.0).otherwise(2 * shared / (F.length(one) + F.length(two)))


def contained(needles: DataFrame, hays: DataFrame) -> DataFrame:
    """``(seed, needle, hay)`` of a seed's strings ``needle`` that stand in its strings ``hay``; empty ones stand nowhere.

    What stands in a string has all its pieces of three characters (or itself, if it is shorter) in it: needles ask by
    the piece that the fewest strings have.
    """
    hays = hays.select("seed", "hay").filter("hay <> ''").distinct()
    places = F.sequence(F.lit(1), F.length("hay"))
    pieces = F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(*[F.substring("hay", i, F.lit(n)) for n in (1, 2, 3)]))))
    flat = hays.select("seed", "hay", F.explode(pieces).alias("piece"))
    known = flat.groupBy("seed", "piece").agg(F.count("*").alias("n"))
    needles = needles.select("seed", "needle").filter("needle <> ''").distinct()
    own = F.transform(F.sequence(F.lit(1), F.greatest(F.length("needle") - 2, F.lit(1))), lambda i: F.substring("needle", i, F.lit(3)))
    asked = needles.select("seed", "needle", F.explode(own).alias("piece")).join(known, ["seed", "piece"], "left")
    asked = asked.groupBy("seed", "needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("m")).select("seed", "needle", F.col("m.piece").alias("piece"))
    return asked.join(flat, ["seed", "piece"]).filter(F.col("hay").contains(F.col("needle"))).select("seed", "needle", "hay")


def quotes_for_company(found: DataFrame, rows: DataFrame, seed: str) -> DataFrame:
    """``rows`` with ``quotes``: all of the seed's if it has one company, else those whose company holds the listing name or is in it.

    ``rows`` has ``seed, row_id, listing_name, n_companies``. An empty listing name matches every named quote. Names meet by their pieces, never
    all with all.
    """
    quote = found.select(F.col(seed).alias("seed"), F.struct("place", "title", "price", "currency").alias("q"), F.lower(F.coalesce("company", F.lit(""))).alias("owner"))
    asked = rows.select(F.col(seed).alias("seed"), "row_id", F.lower(F.coalesce("listing_name", F.lit(""))).alias("name"), "n_companies")
    single, many = asked.filter("n_companies = 1"), asked.filter("n_companies <> 1")
    owners, names = quote.select("seed", "owner").distinct(), many.select("seed", "name").distinct()
    inside = contained(
        names.withColumnRenamed("name", "needle"), owners.withColumnRenamed("owner", "hay")
    ).select("seed", F.col("needle").alias("name"), F.col("hay").alias("owner"))
    around = contained(
        owners.withColumnRenamed("owner", "needle"), names.withColumnRenamed("name", "hay")
    ).select("seed", F.col("hay").alias("name"), F.col("needle").alias("owner"))
    met = many.join(inside.unionByName(around).distinct(), ["seed", "name"]).join(quote, ["seed", "owner"]).select("seed", "row_id", "q")
    met = met.unionByName(many.filter("name = ''").join(quote.filter("owner <> ''"), "seed").select("seed", "row_id", "q"))
    met = met.unionByName(single.join(quote, "seed").select("seed", "row_id", "q"))
    lists = met.groupBy(F.col("seed").alias(seed), "row_id").agg(F.array_sort(F.collect_list("q")).alias("quotes"))
    return rows.join(lists, [seed, "row_id"], "left")
