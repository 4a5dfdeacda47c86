"""Cleaning and validation of text, names, emails, phones and addresses, as Column expressions."""

from __future__ import annotations

import html
from collections.abc import Iterable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from harvestry.functions import vocabulary as V

#: Left and right trim of cleaned text.
EDGES = " \t\r\n:|-"
#: The entities that parsed texts may still hold; :func:`unescape` resolves all.
BASIC_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))
#: Names may also stand without their semicolon, and before other letters; these are the longest.
_BARE = max(len(n) for n in html5 if n[-1] != ";")
#: Numbers up to here that do not stand for their own character.
_LOW = {n: c for n in range(256) if (c := html.unescape(f"&#{n};")) != chr(n)}


def literal(words: Iterable[str]) -> str:
    """A pattern for any of the words, taken literally."""
    return "(?:" + "|".join(rf"\Q{w}\E" for w in words) + ")"


def contains_any(col: Column, words: Iterable[str]) -> Column:
    return col.rlike(literal(words))


def collapse(col: Column) -> Column:
    """White space, of any script, becomes single blanks; cut at the edges."""
    return F.btrim(F.regexp_replace(col, r"(?U)\s+", " "), F.lit(EDGES))


def basic_unescape(col: Column) -> Column:
    for entity, char in BASIC_ENTITIES:
        col = F.replace(col, F.lit(entity), F.lit(char))
    return col


def _map(values: dict) -> Column:
    """Strings by strings, as one literal: a map of thousands of literals would take long to plan."""
    return F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in values.items())), F.lit("\x01"), F.lit("\x02"))


def code_point(number: Column) -> Column:
    """The character of a number, which must be one."""
    return F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")


def _reference(after: Column) -> Column:
    """What follows an ampersand, with the reference that it starts with resolved, if it starts with one."""
    number = F.regexp_extract(after, "^#([0-9]+|[xX][0-9a-fA-F]+);?", 1)
    size = F.length(F.regexp_extract(after, "^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", 0))
    bare = F.ltrim(F.regexp_replace(number, "^[xX]", ""), F.lit("0"))
    told = F.when(F.length(bare) > 12, F.lit(1 << 32)).when(number.rlike("^[xX]"), F.conv(F.concat(F.lit("0"), bare), 16, 10).cast("long")).otherwise(F.concat(F.lit("0"), bare).cast("long"))
    empty = told.between(0xFDD0, 0xFDEF) | (told.bitwiseAND(0xFFFE) == 0xFFFE)
    low = F.try_element_at(_map({n: c for n, c in _LOW.items() if c}), told.cast("string"))
    by_number = F.when(told.isin([n for n, c in _LOW.items() if not c]), "").otherwise(F.coalesce(
        low, F.when(told.between(0xD800, 0xDFFF) | (told > 0x10FFFF), "\ufffd").when(empty, "").otherwise(code_point(told))
    ))
    names, bare_names = _map(html5), _map({n: c for n, c in html5.items() if n[-1] != ";"})
    name = F.regexp_extract(after, "^[^\\t\\n\\f <&#;]{1,32};?", 0)
    whole = F.concat(F.try_element_at(names, name), F.substring(after, F.length(name) + 1, F.lit(1 << 30)))
    # the longest name without its semicolon that the word starts with
    cut = [F.when(F.length(name) > k, F.concat(F.try_element_at(bare_names, F.substring(name, 1, k)), F.substring(after, k + 1, 1 << 30))) for k in range(_BARE, 1, -1)]
    return F.when(number != "", F.concat(by_number, F.substring(after, size + 1, F.lit(1 << 30)))).otherwise(F.coalesce(whole, *cut, F.concat(F.lit("&"), after)))


def unescape(col: Column) -> Column:
    """All named and numeric character references resolved, once, as browsers do: with or without a semicolon."""
    parts = F.transform(F.split(col, "&"), lambda x, k: F.when((k == 0) | (x == ""), F.when(k == 0, x).otherwise("&")).otherwise(_reference(x)))
    return F.when(col.contains("&"), F.array_join(parts, "")).otherwise(col)


def clean_text(col: Column, max_length: int | None = None, parsed: bool = False) -> Column:
    """Entities resolved, white space collapsed, edges cut; null becomes empty. Cut to ``max_length`` if given.

    In ``parsed`` texts the parser has resolved entities already.
    """
    some = F.coalesce(col, F.lit(""))
    done = collapse(basic_unescape(some) if parsed else unescape(some))
    return F.rtrim(F.substring(done, 1, max_length)) if max_length else done


def parsed_text(col: Column, max_length: int | None = None) -> Column:
    """:func:`clean_text` of a text of a parsed page."""
    return clean_text(col, max_length, parsed=True)


def parsed_name(col: Column) -> Column:
    """:func:`clean_company_name` of a text of a parsed page."""
    return clean_company_name(col, parsed=True)


def clean_company_name(col: Column, parsed: bool = False) -> Column:
    """A name of 120 characters at most, without a trailing navigation word; empty if under 2 characters."""
    name = clean_text(col, 120, parsed)
    name = F.regexp_replace(name, rf"(?i)\b(?:{'|'.join(V.TRAILING_NAV)})\b$", "")
    name = F.btrim(name, F.lit(EDGES))
    return F.when(F.length(name) < 2, "").otherwise(name)


def is_valid_email(col: Column, noise: Iterable[str] = V.NOISE_EMAIL_PARTS) -> Column:
    """254 characters at most, none of the noise parts, no image suffix, and the shape of an address."""
    low = F.lower(F.trim(col))
    ok = (F.length(low) <= 254) & ~low.rlike(literal(V.IMAGE_SUFFIXES) + "$") & low.rlike(V.EMAIL_SHAPE)
    noise = tuple(noise)
    return F.coalesce(ok & ~contains_any(low, noise) if noise else ok, F.lit(False))


def has_real_name(col: Column) -> Column:
    """At least two characters, no navigation word, and no ranking headline such as ``best ... vendors``."""
    low = F.lower(F.trim(col))
    ranking = low.rlike("^" + literal(V.RANKING_STARTS)) & contains_any(low, V.RANKING_TERMS)
    return F.coalesce((F.length(low) >= 2) & ~low.isin(*V.NOISE_NAMES) & ~ranking, F.lit(False))


def looks_like_name(col: Column) -> Column:
    """2 to 90 characters without an at sign, five digits in a row, or a word of addresses and contacts."""
    return F.length(col).between(2, 90) & ~col.contains("@") & ~col.rlike(r"\d{5,}") & ~col.rlike(rf"(?i)\b(?:{'|'.join(V.NOT_A_NAME)})\b")


def looks_like_address(col: Column, hints: str = V.ADDRESS_HINTS, states: str = V.STATES) -> Column:
    """12 to 240 characters, no at sign, and a hint word, or a comma and a state."""
    told = col.rlike(rf"(?i)\b(?:{hints})\b") | (col.contains(",") & col.rlike(rf"(?i)\b(?:{states})\b"))
    return F.length(col).between(12, 240) & ~col.contains("@") & told


def unique_keep_order(values: Column) -> Column:
    """The distinct strings of an array without regard to case and edge blanks, first spelling kept, blanks dropped; by sorting, in any length."""
    keyed = F.array_sort(F.transform(values, lambda x, i: F.struct(F.lower(F.trim(x)).alias("k"), i.alias("i"), x.alias("x"))))

    def firsts(all_: Column) -> Column:
        return F.filter(all_, lambda e, j: (e["k"] != "") & ((j == 0) | ~F.get(all_, j - 1)["k"].eqNullSafe(e["k"])))

    kept = F.get(F.transform(F.array(keyed), firsts), F.lit(0))  # bound once, and looked up for each
    return F.transform(F.array_sort(F.transform(kept, lambda e: F.struct(e["i"], e["x"]))), lambda e: e["x"])


def sanitize_email(col: Column) -> Column:
    low = F.lower(clean_text(col))
    return F.when(is_valid_email(low), low)


def sanitize_phone(col: Column) -> Column:
    """Digits, plus, minus, brackets and blanks of a text with 7 digits or more, else null."""
    kept = F.regexp_replace(clean_text(col), r"[^\d+\-() ]", "")
    return F.when(F.length(F.regexp_replace(kept, r"\D", "")) >= 7, kept)


def sanitize_address(col: Column) -> Column:
    done = clean_text(col)
    return F.when(F.length(done) >= 5, done)


def deobfuscate(col: Column) -> Column:
    """``[at]``, ``(at)`` and `` at `` become ``@``; the same with dots."""
    for word, sign in (("at", "@"), ("dot", ".")):
        for pattern in (rf"\s*\[\s*{word}\s*\]\s*", rf"\s*\(\s*{word}\s*\)\s*", rf"\s+\b{word}\b\s+"):
            col = F.regexp_replace(col, "(?i)" + pattern, sign)
    return col


def decode_protected_email(col: Column) -> Column:
    """Hex digits of which the first two are the key that the others are exclusive-ored with; empty if not hex."""
    good = col.rlike("^[0-9a-fA-F]{3,}$")
    text = F.when(good, col).otherwise("00")

    def byte(at: Column) -> Column:
        return F.conv(F.substring(text, at, F.lit(2)), 16, 10).cast("int")

    starts = F.filter(F.sequence(F.lit(3), F.greatest(F.length(text), F.lit(3)), F.lit(2)), lambda at: at <= F.length(text))
    return F.when(good, F.array_join(F.transform(starts, lambda at: F.char(byte(at).bitwiseXOR(byte(F.lit(1))))), "")).otherwise("")


def decode_base64_emails(col: Column) -> Column:
    """The texts with an at sign in base64 tokens of 12 characters and more."""
    tokens = F.regexp_extract_all(col, F.lit(r"\b[A-Za-z0-9+/]{12,}={0,2}\b"), F.lit(0))
    whole = F.filter(tokens, lambda t: F.length(t) % 4 == 0)
    texts = F.transform(whole, lambda t: F.try_to_binary(t, F.lit("base64")).cast("string"))
    return F.filter(texts, lambda t: F.coalesce(t.contains("@"), F.lit(False)))


def phone_rules(rules: dict = V.TRUNKS) -> Column:
    """The table of regions as a map to their trunk prefix, the digits of a number with it, and country code."""
    return F.create_map(*[x for k, (trunk, size, country) in rules.items() for x in (F.lit(k), F.struct(F.lit(trunk).alias("trunk"), F.lit(size).alias("size"), F.lit(country).alias("country")))])


def normalize_phone(col: Column, region: str | Column = "NG", rules: dict = V.TRUNKS, parsed: bool = False) -> Column:
    """7 to 15 digits, with a plus if there was one, if the region's trunk prefix tells, or if there are over 10; else empty.

    ``region`` may be a column: each row then goes by the rule of its own region; a region without a rule, or null, has no trunk prefix.
    """
    value = F.trim(F.regexp_replace(clean_text(col, parsed=parsed), r"(?i)\b(?:ext|extension|x)\.?\s*\d+$", ""))
    digits = F.regexp_replace(value, r"\D", "")
    done = F.when(~F.length(digits).between(7, 15), "").when(value.startswith("+"), F.concat(F.lit("+"), digits))
    if isinstance(region, str):
        rules = {k: v for k, v in rules.items() if k == region}
        region = F.lit(region)
    if rules:
        rule = F.try_element_at(phone_rules(rules), region)
        local = F.coalesce(digits.startswith(rule["trunk"]) & (F.length(digits) == rule["size"]), F.lit(False))
        done = done.when(local, F.concat(F.lit("+"), rule["country"], F.substring(digits, F.length(rule["trunk"]) + 1, F.lit(15))))
    return done.when(F.length(digits) > 10, F.concat(F.lit("+"), digits)).otherwise(digits)


def find_emails(col: Column) -> Column:
    """Everything in a text that has the look of an email; texts without an at sign cost no pattern."""
    return F.when(col.contains("@"), F.regexp_extract_all(col, F.lit(V.EMAIL_FOUND), F.lit(0))).otherwise(F.array().cast("array<string>"))


def find_phones(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit(V.PHONE_FOUND), F.lit(0))


def title_case(col: Column) -> Column:
    """Capital letters at the start of each run of letters."""
    runs = F.regexp_extract_all(F.lower(col), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substring(r, 2, 1 << 30))), "")
