"""URL predicates, parts, normal forms and scores, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harvestry.functions import vocabulary as V
from harvestry.functions.text import basic_unescape, clean_company_name, contains_any, literal, title_case

_PARTS = r"^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: Column, which: int) -> Column:
    """Scheme (1), authority (2), path (3), query (4) or fragment (5); empty if absent."""
    return F.regexp_extract(url, _PARTS, which)


def is_valid_url(url: Column) -> Column:
    return F.coalesce(F.trim(url).rlike(V.URL_SHAPE), F.lit(False))


def with_scheme(url: Column) -> Column:
    """``https://`` in front of what does not begin with a lower-case http scheme."""
    return F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("https://"), url))


def finish(url: Column) -> Column:
    """Without fragment and trailing slashes."""
    return F.rtrim(F.regexp_replace(url, "#.*$", ""), F.lit("/"))


def is_simple(href: Column) -> Column:
    """Absolute, host-relative or root-relative without dot segments: what needs no general resolution."""
    return (href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:") | href.startswith("/")) & ~href.rlike(r"^/(?!/).*(?:/\.{1,2}(?:/|$|\?|#)|^/\.)")


def normalize_url(url: Column, base: Column | None = None) -> Column:
    """The URL with entities resolved, on its base, without fragment and trailing slash; null if it isn't simple.

    Without a base a missing scheme becomes https. References that are not :func:`is_simple` are for the helper.
    """
    u = basic_unescape(F.trim(F.coalesce(url, F.lit(""))))
    absolute = u.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:(?!\d)")
    if base is None:
        done = F.when(u == "", "").when(absolute, u).when(u.startswith("//"), F.concat(F.lit("https:"), u)).otherwise(F.concat(F.lit("https://"), u))
        return finish(done)
    scheme, host = part(base, 1), part(base, 2)
    done = F.when(u == "", "").when(absolute, u).when(u.startswith("//"), F.concat(scheme, F.lit(":"), u)).when(is_simple(u), F.concat(scheme, F.lit("://"), host, u))
    return finish(done)


def domain(url: Column) -> Column:
    """The lower-case authority of a URL without ``www.``; ports stay."""
    return F.regexp_replace(F.lower(part(normalize_url(url), 2)), r"^www\.", "")


def host_of_absolute(url: Column) -> Column:
    return F.regexp_replace(F.lower(part(url, 2)), r"^www\.", "")


def looks_like_asset(url: Column) -> Column:
    return F.lower(part(url, 3)).rlike(literal(V.ASSET_SUFFIXES) + "$")


def should_skip(url: Column) -> Column:
    return contains_any(F.lower(F.concat(part(url, 3), F.lit("?"), part(url, 4))), V.SKIPPED_IN_URLS)


def is_listing_path(path: Column) -> Column:
    """At least two segments, the last with a digit, or with a dash and 8 characters."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    last = F.element_at(parts, -1)
    return F.when(F.size(parts) >= 2, last.rlike(r"\d") | (last.contains("-") & (F.length(last) >= 8))).otherwise(False)


def link_score(anchor: Column, url: Column) -> Column:
    """20 for a discovery word, 18 for a page token, 12 for a listing path, 3 for an anchor text."""
    text = F.lower(F.concat_ws(" ", anchor, part(url, 3), part(url, 4)))

    def points(test: Column, n: int) -> Column:
        return F.when(test, n).otherwise(0)

    return points(contains_any(text, V.DISCOVERY_WORDS), 20) + points(contains_any(text, V.PAGINATION), 18) + points(is_listing_path(part(url, 3)), 12) + points(anchor != "", 3)


def page_score(url: Column) -> Column:
    """0.75 for a priority path and 0.2 for a business word, at most 1."""
    text = F.lower(F.concat_ws(" ", part(url, 3), part(url, 4)))
    score = F.when(contains_any(text, V.PRIORITY_PATHS), 75).otherwise(0) + F.when(contains_any(text, V.BUSINESS_WORDS), 20).otherwise(0)
    return F.least(score, F.lit(100)) / 100.0


def name_from_url(url: Column) -> Column:
    """The first label of the host, dashes as blanks, in title case."""
    label = F.split_part(domain(url), F.lit("."), F.lit(1))
    return clean_company_name(title_case(F.replace(label, F.lit("-"), F.lit(" "))))


def is_social(host: Column, strict: bool = False) -> Column:
    """Whether a host holds the name of a social site; ``strict`` asks for the host itself or a subdomain."""
    if strict:
        return host.rlike(r"(?:^|\.)" + literal(V.SOCIAL_HOSTS) + "$")
    return contains_any(host, V.SOCIAL_HOSTS)


def output_key(seed: Column) -> Column:
    """What is not a letter or digit becomes an underscore; 120 characters at most."""
    return F.substring(F.regexp_replace(seed, r"(?U)[^\p{IsAlphabetic}\p{IsDigit}]", "_"), 1, 120)
