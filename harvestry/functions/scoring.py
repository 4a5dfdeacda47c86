"""Prices and confidence scores, as Column expressions. Scores add up in whole hundredths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harvestry.functions import vocabulary as V
from harvestry.functions.text import clean_text


def present(col: Column) -> Column:
    return F.coalesce(col != "", F.lit(False))


def _sum(parts: list[tuple[Column, int]]) -> Column:
    total = F.lit(0)
    for test, points in parts:
        total = total + F.when(test, points).otherwise(0)
    return total


def clamp(score: Column) -> Column:
    """Between 0 and 1, three decimals; null stays null."""
    return F.when(score.isNotNull(), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 3))


def entity_confidence(name, email, phone, address, website, socials, same_block=False, header=False, semantic=False, ai=None, structured=False, fallback=False) -> Column:
    """The confidence of a company record; flags are booleans or Columns, ``ai`` a Column between 0 and 1."""

    def flag(x) -> Column:
        return F.coalesce(x, F.lit(False)) if isinstance(x, Column) else F.lit(bool(x))

    parts = [(present(name), 24), (present(email), 18), (present(phone), 16), (present(address), 13), (present(website), 12), (F.size(socials) > 0, 7)]
    parts += [(flag(same_block), 18), (flag(header), 4), (flag(semantic), 6), (flag(structured), 8), (flag(fallback), -12)]
    score = _sum(parts) / 100.0
    if ai is not None:
        score = score + F.least(F.lit(0.16), F.coalesce(ai, F.lit(0.0)) * 0.16)
    return clamp(score)


def quote_confidence(price, currency, title, description, company, container: Column, starting: Column) -> Column:
    parts = [(present(price), 32), (present(currency), 18), (present(title), 16), (present(description), 11), (present(company), 10), (container, 18), (starting, 5)]
    return clamp(_sum(parts) / 100.0)


def has_price(text: Column, strict: bool = False) -> Column:
    return text.rlike(price_pattern(strict))


def price_pattern(strict: bool = False) -> str:
    """``strict`` asks for a word boundary before letters of a currency, so that ``edition 5`` is no price."""
    return V.PRICE.replace("(NGN|USD|GBP|N|", r"(\bNGN|\bUSD|\bGBP|\bN|") if strict else V.PRICE


def parse_price(text: Column, strict: bool = False) -> Column:
    """``struct(token, amount_text, price, currency, amount)`` of the first price; null if there is none."""
    pattern = price_pattern(strict)
    token, amount = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    table = F.create_map(*[F.lit(x) for pair in V.CURRENCIES.items() for x in pair])
    currency = F.coalesce(F.try_element_at(table, F.upper(token)), F.upper(token))
    number = F.replace(amount, F.lit(","), F.lit("")).try_cast("decimal(18,2)")
    found = F.struct(token.alias("token"), amount.alias("amount_text"), F.concat(token, amount).alias("price"), currency.alias("currency"), number.alias("amount"))
    return F.when(text.rlike(pattern), found)


def starts_from(text: Column) -> Column:
    return text.rlike(V.STARTING)


def before_price(text: Column) -> Column:
    return F.split(text, V.PRICE, 2)[0]


def quote_title(heading: Column, text: Column) -> Column:
    """The heading, else what stands before the price (80 characters), else ``Pricing``."""
    before = clean_text(before_price(text), 80)
    return F.coalesce(F.nullif(heading, F.lit("")), F.nullif(before, F.lit("")), F.lit("Pricing"))


def _without_first(text: Column, part: Column) -> Column:
    at = F.position(part, text)
    return F.when((at > 0) & (part != ""), F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(part), F.length(text)))).otherwise(text)


def quote_description(text: Column, title: Column, price: Column) -> Column:
    """The text without the first occurrences of title and price, 300 characters at most."""
    return clean_text(_without_first(_without_first(text, title), price), 300)
