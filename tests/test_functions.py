import base64
import html
from html.entities import html5

from pyspark.sql import functions as F

from harvestry.functions import helpers
from harvestry.functions import scoring as S
from harvestry.functions import text as T
from harvestry.functions import urls as U


def values(spark, rows, make, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}")
    return [r.x for r in df.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_text(spark):
    rows = [" \xa0A &amp; B |", None, "", "::x--", "a" * 130]
    assert values(spark, rows, T.clean_text) == ["A & B", "", "", "x", "a" * 130]
    assert values(spark, ["Acme | Home", "x", "Best services", None, "b" * 125], T.clean_company_name) == ["Acme", "", "Best", "", "b" * 120]
    emails = ["A@b.co", "a@example.com", "a@b.png", "nope", None, "a@b", "name@x.org", "x" * 250 + "@b.co"]
    assert values(spark, emails, T.is_valid_email) == [True, False, False, False, False, False, False, False]
    assert values(spark, emails[:2], lambda c: T.is_valid_email(c, ())) == [True, True]
    names = ["Acme", "home", "Best vendors in town", "x", None, "top shelf"]
    assert values(spark, names, T.has_real_name) == [True, False, False, False, False, True]
    assert values(spark, ["Acme", "a@b", "call 12345", "Mill Road", "x"], T.looks_like_name) == [True, False, False, False, False]
    assert values(spark, ["12 Mill Road", "somewhere, Lagos", "short st", "x@y.co Mill Road", "nothing to see here"], T.looks_like_address) == [True, True, False, False, False]


def test_contacts(spark):
    phones = ["+1 (202) 555-0100", "08012345678", "12345", "555-0100", "1234567890123456", "020 7946 0000 ext. 5", None, "12345678901"]
    assert values(spark, phones, T.normalize_phone) == ["+12025550100", "+2348012345678", "", "5550100", "", "+2342079460000", "", "+12345678901"]
    assert values(spark, ["08012345678"], lambda c: T.normalize_phone(c, "ZZ")) == ["+08012345678"]  # a region without a rule
    assert values(spark, ["020 7946 0000", "0033 1 2345"], lambda c: T.normalize_phone(c, "GB")) == ["+442079460000", "003312345"]
    coded = "2a" + "".join(f"{ord(c) ^ 42:02x}" for c in "me@x.co")
    assert values(spark, [coded, "zz", "", None, "2a", "2a1"], T.decode_protected_email) == ["me@x.co", "", "", "", "", chr(42 ^ 1)]
    good, none = base64.b64encode(b"   hi@deep.co   ").decode().rstrip("="), base64.b64encode(b"nothing here").decode()
    assert values(spark, [f"a {base64.b64encode(b'  hi@deep.co').decode()} b", f"{none} {good}x"], T.decode_base64_emails)[0] == ["  hi@deep.co"]
    assert values(spark, ["me [at] x (dot) co", "look at this"], T.deobfuscate) == ["me@x.co", "look@this"]
    assert values(spark, [["B", "a", " b ", "", "A", "c"], []], T.unique_keep_order, "array<string>") == [["B", "a", "c"], []]


def test_urls(spark):
    base = F.lit("https://www.Site.co:8080/a/b?x=1#f")
    hrefs = ["/p/", "https://o.co/x#y", "//cdn.co/z", "mailto:a@b.co", "", None, "rel/page", "/a/../b", "#top"]
    assert values(spark, hrefs, lambda c: U.normalize_url(c, base)) == ["https://www.Site.co:8080/p", "https://o.co/x", "https://cdn.co/z", "mailto:a@b.co", "", "", None, None, None]
    assert values(spark, ["www.Shop.co:80/x", "https://a.b/?q#f", "", None], U.domain) == ["shop.co:80", "a.b", "", ""]
    joined = spark.createDataFrame([("https://s.co/a/b", "../c?d#e"), ("https://s.co/a/b", ""), ("https://s.co/a/b", None), ("http://[bad", "x")], "b string, h string")
    assert [r.x for r in joined.select(helpers.url_join("b", "h").alias("x")).collect()][:3] == ["https://s.co/c?d", "", ""]
    urls = ["a.co", "https://a.co/x", "word", "", None, "HTTP://A.CO"]
    assert values(spark, urls, U.is_valid_url) == [True, True, False, False, False, True]
    assert values(spark, ["/a/b1", "/a/long-name", "/a", "/a/x-y", "/"], U.is_listing_path) == [True, True, False, False, False]
    assert values(spark, ["netflix.com", "x.com", "my.x.com"], lambda c: U.is_social(c, True)) == [False, True, True]
    assert values(spark, ["netflix.com"], U.is_social) == [True]
    assert values(spark, ["https://a.co/x?utm_source=feed", "https://a.co/cart", "https://a.co/x"], U.should_skip) == [True, True, False]


def test_prices_and_scores(spark):
    texts = ["Plan from $ 1,200.50 a month", "edition 5", "no price", None, "€20"]
    got = values(spark, texts, S.parse_price)
    assert [g and (g.price, g.currency) for g in got] == [("$1,200.50", "USD"), ("n5", "NGN"), None, None, ("€20", "EUR")]
    assert values(spark, texts[1:2], lambda c: S.parse_price(c, True)) == [None]
    assert values(spark, ["a $5 b $5 c"], lambda c: S.quote_description(c, F.lit("a"), F.lit("$5"))) == ["b $5 c"]
    assert values(spark, ["x $5", "$5"], lambda c: S.quote_title(F.lit(""), c)) == ["x", "Pricing"]
    assert values(spark, [2.0, -1.0, 0.12345, None], S.clamp, "double") == [1.0, 0.0, 0.123, None]


def test_helpers(spark):
    assert values(spark, ["&eacute;&#x41;", None], helpers.html_unescape) == ["\xe9A", None]
    assert values(spark, ["Acme", "", None], lambda c: helpers.name_ratio(c, F.lit("acme"))) == [1.0, 0.0, 0.0]


def test_all_character_references(spark):
    """Every named entity, with what may follow it, and numbers of all kinds, as the standard library resolves them."""
    texts = [f"a&{n}{rest}" for n in html5 for rest in ("", "x", ";", " &amp")]
    texts += [f"&#{n};&#x{n:x}{rest}" for n in (*range(0, 300), 0xD7FF, 0xD800, 0xDFFF, 0xFDD0, 0xFFFE, 0xFFFF, 0x10000, 0x1FFFE, 0x10FFFF, 0x110000, 10**30) for rest in ("", ";")]
    texts += ["", "&", "&&", "&;", "&#;", "&#x;", "&#xg", "a & b", "&" + "x" * 40 + ";", "&amp;lt;", "&#00065;", "&#X41", "&notin;&notit;&no", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.unescape(F.col("t")).alias("u")).collect()
    wrong = [(r.t, r.u) for r in got if r.u != (None if r.t is None else html.unescape(r.t))]
    assert not wrong, wrong[:5]


def test_phones_by_rows_of_regions(spark):
    rows = [("NG", "08031234567", "+2348031234567"), ("GB", "02079 460000", "+442079460000"), ("US", "02079460000", "+02079460000"), (None, "0302123456", "0302123456"), ("GH", "0302123456", "+233302123456")]
    df = spark.createDataFrame(rows, "region string, phone string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", T.normalize_phone(F.col("phone"), F.col("region"))).collect())
    other = {"XX": ("8", 9, "7")}
    assert df.select(T.normalize_phone(F.lit("812345678"), F.lit("XX"), other).alias("p")).first().p == "+712345678"
