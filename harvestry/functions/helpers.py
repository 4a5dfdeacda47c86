"""The few helpers that built-in functions can't express, over Arrow batches."""

from __future__ import annotations

import html
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from harvestry.sources.html import resolved


@F.pandas_udf(StringType())
def html_unescape(texts: pd.Series) -> pd.Series:
    """All named and numeric entities resolved. Use it on rows that hold an ampersand."""
    return texts.map(lambda t: None if t is None else html.unescape(t))


@F.pandas_udf(StringType())
def url_join(base: pd.Series, href: pd.Series) -> pd.Series:
    """A reference resolved on its base, without fragment and trailing slash; null if it can't be."""

    return pd.Series([resolved(b, None if h is None else html.unescape(h)) for b, h in zip(base, href)], dtype=object)


@F.pandas_udf(ArrayType(StringType()))
def joined_urls(base: pd.Series, hrefs: pd.Series) -> pd.Series:
    """References resolved on a base, without fragment and trailing slash; without a base, or a host, ``https`` is put in front. Null ones become empty."""

    def one(page: str | None, href: str | None) -> str | None:
        url = html.unescape((href or "").strip())
        if not url:
            return ""
        if not page and "://" not in url and not url.startswith("//"):
            url = "https://" + url
        done = resolved(page or "https:", url)
        return done

    return pd.Series([[one(b, h) for h in (hs if hs is not None else [])] for b, hs in zip(base, hrefs)], dtype=object)


@F.pandas_udf(DoubleType())
def name_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """The Ratcliff-Obershelp ratio of two lower-cased strings, in argument order; 0 if either is empty or null."""

    def ratio(a: str | None, b: str | None) -> float:
        return SequenceMatcher(None, a.lower(), b.lower()).ratio() if a and b else 0.0

    return pd.Series([ratio(a, b) for a, b in zip(left, right)], dtype="float64")
