"""What a block of a page says: names, emails, phones, addresses, websites and social links.

A page is looked through once: its index lists, for every place where something may stand, the nodes that stand there with what they say. What is inside
a block is the part of the index between its first and last node, so that "the first in a subtree by priority" is a lookup in a few entries, and no
block carries nodes. Nothing is joined or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestry.functions import text as T
from harvestry.functions import urls as U
from harvestry.functions import vocabulary as V
from harvestry.sources.html import RESOLVED

MAX_ADDRESSES, MAX_SOCIALS = 5, 8


def _none() -> Column:
    return F.array().cast("array<string>")


def attr(name: str, node: str = "n") -> str:
    """An attribute of a node, in SQL text like all that follows: a node is looked at in so many places that Columns would take long to plan."""
    return f"try_element_at({node}.attrs, '{name}')"


def has_attr(name: str) -> str:
    return f"map_contains_key(n.attrs, '{name}')"


def class_has(*parts: str, node: str = "n") -> str:
    """``[class*=part]`` for all parts."""
    return "(" + " and ".join(f"contains(coalesce({attr('class', node)}, ''), '{p}')" for p in parts) + ")"


def is_class(name: str) -> str:
    return f"array_contains(n.classes, '{name}')"


def tag_is(*tags: str, node: str = "n") -> str:
    return f"{node}.tag in ({', '.join(map(repr, tags))})"


def attr_has(name: str, part: str) -> str:
    return f"coalesce(contains({attr(name)}, '{part}'), false)"


def attr_is(name: str, value: str) -> str:
    return f"coalesce({attr(name)} = '{value}', false)"


def both(*tests: str) -> str:
    return " and ".join(f"({t})" for t in tests)


def firsts(array: str, places: tuple[str, ...]) -> Column:
    """The first node at each of the places, null where there is none."""
    return F.expr(f"array({', '.join(f'get(filter({array}, n -> {p}), 0)' for p in places)})")


def value_of(node: Column, name: str) -> Column:
    return F.try_element_at(node["attrs"], F.lit(name))


def node_text(node: Column, tokens: str | Column = "tokens", glue: str = " ") -> Column:
    return F.array_join(F.slice(tokens, node["tok_start"] + 1, node["tok_len"]), glue)


#: Where a name may stand, in order of priority.
NAME_PLACES = (
    attr_is("itemprop", "name"),
    *[is_class(c) for c in ("company-name", "business-name", "profile-name", "title")],
    *[tag_is(t) for t in ("h1", "h2", "h3", "h4")],
    *[both(tag_is("a"), attr_has("href", w)) for w in ("company", "profile", "business", "listing")],
    *[class_has(w, "name") for w in ("company", "business", "listing", "vendor", "profile")],
    *[class_has(w) for w in ("title", "heading", "card-title", "result-title")],
    *[tag_is(t) for t in ("strong", "b")],
    both(tag_is("meta"), attr_is("property", "og:site_name")),
    tag_is("title"),
)

ADDRESS_PLACES = (
    tag_is("address"),
    *[is_class(c) for c in ("address", "contact-address", "business-address", "location", "venue", "office")],
    *[has_attr(a) for a in ("data-address", "data-location", "data-venue")],
    *[attr_has("data-testid", w) for w in ("address", "location")],
    *[class_has(w) for w in ("address", "location", "venue", "office")],
    attr_has("itemprop", "address"),
)


#: The places of the index by number: name and address places from these on, and single ones.
NAMES_AT, ADDRESSES_AT, PARTS_AT, IMAGES_AT = 0, 100, 200, 300
MAILS_AT, SHIELDED_AT, SHIELDED_LINKS_AT, DIALLED_AT, CHATS_AT, LINKS_AT = 310, 311, 312, 320, 321, 330
_LABEL = "(?i)" + V.ADDRESS_LABELS


def _places() -> dict[int, str]:
    href = attr("href")
    return {
        **{NAMES_AT + k: p for k, p in enumerate(NAME_PLACES)},
        **{ADDRESSES_AT + k: p for k, p in enumerate(ADDRESS_PLACES)},
        PARTS_AT: f"{attr('itemprop')} in ('streetAddress', 'addressLocality', 'addressRegion')",
        IMAGES_AT: both(tag_is("img"), has_attr("alt")),
        MAILS_AT: f"n.tag = 'a' and startswith({href}, 'mailto:')",
        SHIELDED_AT: has_attr("data-cfemail"),
        SHIELDED_LINKS_AT: f"n.tag = 'a' and contains({href}, '/cdn-cgi/l/email-protection#')",
        DIALLED_AT: f"n.tag = 'a' and startswith({href}, 'tel:')",
        CHATS_AT: f"n.tag = 'a' and (contains({href}, 'wa.me/') or contains({href}, 'whatsapp.com/send'))",
        LINKS_AT: both(tag_is("a"), has_attr(RESOLVED)),
    }


def with_index(parsed: DataFrame) -> DataFrame:
    """Parsed pages with ``hits``, the places ``at`` which nodes ``id`` stand with their ``text``, ``attr`` and ``url``, and ``labelled`` addresses.

    ``labelled`` are the innermost nodes of texts with an address label: what they say themselves, and what their next sibling says.
    Both are to be written with the page, so that they are worked out once for it.
    """
    found = ", ".join(f"if({p}, {k}, null)" for k, p in _places().items())
    here = f"transform(nodes, n -> transform(filter(array({found}), k -> k is not null), k -> struct(k as at, n.node_id as id)))"
    words = "array_join(slice(tokens, nodes[h.id].tok_start + 1, nodes[h.id].tok_len), ' ')"
    other = {IMAGES_AT: "alt", SHIELDED_AT: "data-cfemail"}
    said = " ".join(f"when h.at = {k} then {attr(v, 'nodes[h.id]')}" for k, v in other.items())
    meta = f"h.at < {ADDRESSES_AT} and nodes[h.id].tag = 'meta'"
    told = f"""transform(flatten({here}), h -> struct(h.at, h.id,
        case when {meta} then {attr("content", "nodes[h.id]")} when h.at < {IMAGES_AT} or h.at = {LINKS_AT} then {words} end as text,
        case {said} when h.at > {IMAGES_AT} then {attr("href", "nodes[h.id]")} end as attr,
        if(h.at = {LINKS_AT}, {attr(RESOLVED, "nodes[h.id]")}, null) as url))"""
    # tokens with a label are few; a node holds one of them by its numbers
    spots = f"filter(sequence(0, size(tokens)), t -> rlike(coalesce(get(tokens, t), ''), {sql_text(_LABEL)}))"
    rows = parsed.withColumns({"hits": F.expr(told), "spots": F.expr(spots)})

    def holds(n: str) -> str:
        return f"exists(spots, t -> t >= {n}.tok_start and t < {n}.tok_start + {n}.tok_len)"

    inner = f"filter(nodes, n -> {holds('n')} and not exists(slice(nodes, n.node_id + 2, n.end_id - n.node_id - 1), o -> {holds('o')}))"
    inner = F.when(F.size("spots") > 0, F.expr(inner)).otherwise(F.slice("nodes", 1, 0))

    def labelled(n: Column) -> Column:
        after = F.get("nodes", n["end_id"])
        follow = F.when((after["parent_id"] == n["parent_id"]), T.parsed_text(node_text(after), 240))
        return F.struct(n["node_id"].alias("id"), F.btrim(F.regexp_replace(T.parsed_text(node_text(n), 240), _LABEL, ""), F.lit(" :-")).alias("own"), follow.alias("follow"))

    return rows.withColumn("labelled", F.transform(inner, labelled)).drop("spots")


def _at(low: int, high: int | None = None) -> Column:
    """The entries of a block at the places from ``low`` to ``high``, by place and then in document order."""
    return F.array_sort(F.expr(f"filter(hits, h -> h.at between {low} and {high or low})"))


def extract_name() -> Column:
    """The first real name at the name places, in the label of the block, in an image's text, or the text itself.

    Of the nodes at a place only the first counts.
    """
    at = _at(NAMES_AT, ADDRESSES_AT - 1)
    first = F.filter(at, lambda h, k: (k == 0) | (F.get(at, k - 1)["at"] != h["at"]))
    label, image = value_of(F.col("b"), "aria-label"), F.get(_at(IMAGES_AT), F.lit(0))["attr"]
    told = F.filter(F.concat(F.transform(first, lambda h: h["text"]), F.array(label, image)), lambda x: x.isNotNull())
    whole = F.filter(F.array(T.parsed_name(F.col("text"))), lambda t: T.looks_like_name(t))
    found = F.filter(F.concat(F.transform(told, lambda x: T.parsed_name(x)), whole), lambda x: T.has_real_name(x))
    return F.coalesce(F.get(found, F.lit(0)), F.lit(""))


def extract_emails(noise=V.NOISE_EMAIL_PARTS) -> Column:
    """Mail links, protected addresses, patterns in plain or disguised markup and text, and base64, in that order."""
    markup, text = F.col("markup"), F.col("text")
    mail = F.transform(_at(MAILS_AT), lambda h: F.substring_index(F.substring(h["attr"], 8, 1 << 30), "?", 1))
    shielded = F.transform(_at(SHIELDED_AT), lambda h: T.decode_protected_email(h["attr"]))
    linked = F.transform(_at(SHIELDED_LINKS_AT), lambda h: T.decode_protected_email(F.substring_index(h["attr"], "#", -1)))
    likely = markup.contains("@") | markup.rlike(r"(?i)\bat\b")
    in_markup = F.when(likely, T.find_emails(T.deobfuscate(T.basic_unescape(markup)))).otherwise(_none())
    in_text = F.when(text.contains("@") | text.rlike(r"(?i)\bat\b"), T.find_emails(T.deobfuscate(text))).otherwise(_none())
    coded = T.find_emails(F.array_join(T.decode_base64_emails(markup), " "))
    found = F.transform(F.concat(mail, shielded, linked, in_markup, in_text, coded), lambda e: F.lower(T.parsed_text(e)))
    return F.filter(F.array_distinct(found), lambda e: T.is_valid_email(e, noise))


def extract_phones(region: str | Column = "NG") -> Column:
    """Phone links, chat links, and patterns in the text, normalised."""
    dialled = F.transform(_at(DIALLED_AT), lambda h: F.substring(h["attr"], 5, 1 << 30))
    chats = F.transform(_at(CHATS_AT), lambda h: h["attr"])
    asked = r"(?:^|&)phone=([^&]*)"
    chats = F.transform(
        chats,
        lambda h: F.array(F.when(U.part(h, 2).contains("wa.me"), F.btrim(U.part(h, 3), F.lit("/"))), F.try_url_decode(F.regexp_extract(U.part(h, 4), asked, 1)))
    )
    found = F.concat(dialled, F.filter(F.flatten(chats), lambda c: c != ""), T.find_phones(F.col("text")))
    return F.filter(F.array_distinct(F.transform(found, lambda p: T.normalize_phone(p, region, parsed=True))), lambda p: p != "")


def extract_addresses(cap: int | None = MAX_ADDRESSES) -> Column:
    """Address places, item parts, labelled text and its next sibling, and lines with the look of an address."""

    def texts(at: Column, cut: int = 240) -> Column:
        return F.filter(F.transform(at, lambda h: T.parsed_text(h["text"], cut)), lambda t: t != "")

    placed, parts = texts(_at(ADDRESSES_AT, PARTS_AT - 1)), texts(_at(PARTS_AT), 160)
    told = F.when(F.col("text").rlike(_LABEL), F.col("labelled")).otherwise(F.slice("labelled", 1, 0))
    said = F.filter(F.flatten(F.transform(told, lambda h: F.array(h["own"], h["follow"]))), lambda t: t != "")
    lines = F.filter(F.transform(F.split(F.col("lines"), "\n"), lambda x: T.parsed_text(x, 240)), lambda x: T.looks_like_address(x))
    found = T.unique_keep_order(F.concat(placed, parts, said, lines))
    found = F.filter(found, lambda a: F.length(a) >= 10)
    return found if cap is None else F.slice(found, 1, cap)


def sql_text(value: str) -> str:
    """A text as a literal in SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _links() -> Column:
    """The links of the block with their URLs, as the parser resolved them on the page's."""
    return F.transform(_at(LINKS_AT), lambda h: F.struct(h["attr"].alias("href"), h["url"], F.lower(T.parsed_text(h["text"])).alias("anchor")))


def extract_website(strict_social: bool = False) -> Column:
    """The first link off the page's host that is no social site; on the host only if the anchor says website."""
    own = U.host_of_absolute(F.col("url"))

    def fits(x: Column) -> Column:
        host = U.host_of_absolute(x["url"])
        outside = F.coalesce((host != "") & ~U.is_social(host, strict_social), F.lit(False))
        return ~x["href"].rlike("^(?:mailto:|tel:|javascript:|#)") & outside & ((own == "") | (host != own) | x["anchor"].isin("website", "visit website", "site"))

    return F.coalesce(F.get(F.filter("links", fits), F.lit(0))["url"], F.lit(""))


def extract_socials(strict_social: bool = False, cap: int | None = MAX_SOCIALS) -> Column:
    hits = F.filter("links", lambda x: F.coalesce(U.is_social(F.lower(U.part(x["url"], 2)), strict_social), F.lit(False)))
    found = T.unique_keep_order(F.transform(hits, lambda x: x["url"]))
    return found if cap is None else F.slice(found, 1, cap)


def with_contacts(
    blocks: DataFrame, region: str | Column = "NG", noise=V.NOISE_EMAIL_PARTS, strict_social: bool = False, addresses: int | None = MAX_ADDRESSES,
    socials: int | None = MAX_SOCIALS
) -> DataFrame:
    """``blocks`` with ``name, emails, phones, addresses, website, socials``; at most so many addresses and social links, all of them with None."""
    done = blocks.withColumn("links", _links())
    return done.withColumns(
        {
            "name": extract_name(), "emails": extract_emails(noise), "phones": extract_phones(region), "addresses": extract_addresses(addresses),
            "website": extract_website(strict_social), "socials": extract_socials(strict_social, socials)
        }
    ).drop("links")


def signals() -> Column:
    """How many of name, email, phone, address and website a block has."""
    hits = [F.col("name") != "", F.size("emails") > 0, F.size("phones") > 0, F.size("addresses") > 0, F.col("website") != ""]
    return sum((h.cast("int") for h in hits), F.lit(0))
