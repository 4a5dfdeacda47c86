"""Page corpora rendered from the business tables, to carry them through the extraction jobs and compare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from harvestry.sources.shared import table

#: Cards of a page: several, so that none is over three quarters of a page. At three hits each they exceed the usual cap of 80.
CARDS = 40


def supplier_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(key, name, email, phone, address, social, page)`` of every supplier."""
    suppliers, nations = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    rows = suppliers.join(nations, suppliers.s_nationkey == nations.n_nationkey)
    key = F.col("s_suppkey").cast("string")
    return rows.select(
        F.col("s_suppkey").alias("key"),
        F.concat(F.lit("Vendor House "), key).alias("name"),
        F.concat(F.lit("sales"), key, F.lit("@house"), key, F.lit(".co")).alias("email"),
        F.concat(F.lit("+1202"), F.lpad(key, 7, "5")).alias("phone"),
        F.concat(key, F.lit(" Market Street, "), F.initcap("n_name")).alias("address"),
        F.concat(F.lit("https://facebook.com/house"), key).alias("social"),
        F.floor(F.col("s_suppkey") / CARDS).cast("long").alias("page"),
    )


def _pages(cards: DataFrame, host: str, head: str, tail: str) -> DataFrame:
    """Cards ``(page, at, card)`` as pages ``(page_id, url, html)``; every page ends with some text of its own."""
    # pages are costly for their size: they are dealt to all tasks, and stay there
    tasks = int(cards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cards.repartition(tasks, "page").groupBy("page").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "card"))), lambda x: x["card"]), "").alias("body")
    )
    filler = "<p>" + "This page lists some partners of the house and says little else. " * 2 + "</p>"
    return rows.select(
        F.col("page").alias("page_id"), F.concat(F.lit(f"https://{host}/list/"), F.col("page")).alias("url"),
        F.concat(F.lit("<html><body><h1>Our partners</h1>" + head), F.col("body"), F.lit(tail + filler + "</body></html>")).alias("html")
    )


def directory_pages(spark: SparkSession, sf_dir: str, cards: int = CARDS) -> DataFrame:
    """One plain ``div`` card per supplier, in many shapes by its key: where name and address stand, how the phone is told, what is missing.

    Every fifth has no email, every seventh no social link.
    """
    f = supplier_facts(spark, sf_dir)

    def by(n: int, *shapes: Column) -> Column:
        return F.get(F.array(*shapes), F.pmod("key", F.lit(n)).cast("int"))

    def said(before: str, value: str, after: str) -> Column:
        return F.concat(F.lit(before), F.col(value), F.lit(after))

    name = by(
        4, said("<h3>", "name", "</h3>"), said("<p>Member since 99</p><strong>", "name", "</strong>"),
        said('<h4>Our partner</h4><span class="company-name">', "name", "</span>"), said('<h2>Welcome</h2><i itemprop="name">', "name", "</i>")
    )
    mail = F.when(F.pmod("key", F.lit(5)) == 0, "").otherwise(said('<a href="mailto:', "email", '?subject=hi">Mail us</a> '))
    phone = by(3, said('<a href="tel:', "phone", '">Call us</a>'), said("<p>Ring ", "phone", " now</p>"), said('<a href="https://wa.me/', "phone", '">Chat</a>'))
    address = by(3, said("<address>", "address", "</address>"), said('<b class="venue">', "address", "</b>"), said('<p>Address: ', "address", "</p>"))
    social = F.when(F.pmod("key", F.lit(7)) == 0, "").otherwise(said('<a href="', "social", '">Page</a>'))
    card = F.concat(F.lit("<div>"), name, mail, phone, address, social, F.lit("</div>"))
    page = F.floor(F.col("key") / cards).cast("long").alias("page")
    return _pages(f.select(page, F.col("key").alias("at"), card.alias("card")), "directory.house", '<main class="directory-results">', "</main>")


def nested_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates in candidates, by the key: a plain card; cards as long as each other in each other; a card in a longer one; a card in two longer ones."""
    f = supplier_facts(spark, sf_dir)
    inner = F.concat(F.lit("<h3>"), "name", F.lit('</h3><a href="mailto:'), "email", F.lit('">Mail us</a> <address>'), "address", F.lit("</address>"))
    card = F.concat(F.lit('<article class="company-card">'), inner, F.lit("</article>"))
    more = F.lit("<p>Listed with a few kind words of the house</p>")
    way = F.pmod("key", F.lit(4))
    shape = F.when(way == 0, card).when(way == 1, F.concat(F.lit('<section class="listing"><div class="vendor-card">'), card, F.lit("</div></section>")))
    shape = shape.when(way == 2, F.concat(F.lit('<section class="listing">'), card, more, F.lit("</section>")))
    shape = shape.otherwise(F.concat(F.lit('<section class="listing">'), more, F.lit('<div class="vendor-card">'), card, more, F.lit("</div></section>")))
    return _pages(f.select("page", F.col("key").alias("at"), shape.alias("card")), "nested.house", "<main>", "</main>")


def regional_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four cards a page, whose phones are told as at home; each page names its region, one of five, or none."""
    f = supplier_facts(spark, sf_dir).withColumn("page", F.floor(F.col("key") / 4).cast("long"))
    turn = F.pmod("page", F.lit(6)).cast("int")
    local = F.concat(F.get(F.array(*[F.lit(x) for x in ("08032", "02079", "0302", "0142", "0212", "0212")]), turn), F.lpad(F.col("key").cast("string"), 6, "5"))
    card = F.concat(F.lit("<div><h3>"), "name", F.lit('</h3><a href="tel:'), local, F.lit('">Call us</a><address>'), "address", F.lit("</address></div>"))
    pages = _pages(f.select("page", F.col("key").alias("at"), card.alias("card")), "regions.house", '<main class="directory-results">', "</main>")
    regions = F.array(*[F.lit(r) for r in ("NG", "GB", "GH", "FR", "US")], F.lit(None).cast("string"))
    return pages.withColumn("region", F.get(regions, F.pmod("page_id", F.lit(6)).cast("int")))


def section_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per supplier without any listing: only a section of contacts, beside other text."""
    f = supplier_facts(spark, sf_dir)
    body = F.concat(F.lit('<div class="contact-panel"><h2>'), "name", F.lit("</h2><p>Write to "), "email", F.lit("</p></div>"))
    rest = "<p>" + "This page says a lot of other things that matter little to anyone. " * 4 + "</p>"
    return f.select(
        F.col("key").alias("page_id"), F.concat(F.lit("https://section.house/"), "key").alias("url"),
        F.concat(F.lit("<html><body><h1>Hello</h1>"), body, F.lit(rest + "</body></html>")).alias("html")
    )


def website_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List items with odd entities, unquoted and relative links, and a website that is told in three ways."""
    f = supplier_facts(spark, sf_dir)
    way = F.pmod("key", F.lit(3))
    name = F.concat(F.when(way == 0, "Caf&eacute;").when(way == 1, "Caf&#233;").otherwise("Caf&amp;eacute;"), F.lit(" House "), "key")
    link = F.when(way == 0, F.concat(F.lit("<a href=../go/"), "key", F.lit(">Website</a>"))).when(
        way == 1, F.concat(F.lit("<a href='//shop"), "key", F.lit(".co/a?x=1&amp;y=2#top'>more</a>"))
    )
    link = link.otherwise(F.concat(F.lit('<a title="a>b" HREF = "https://shop'), "key", F.lit('.co/./b/../c/">more</a>')))
    social = F.concat(F.lit("<a href=//instagram.com/house"), "key", F.lit(">pictures</a>"))
    card = F.concat(F.lit("<li><h3>"), name, F.lit("</h3><a href=/inside>inside</a> "), social, link, F.lit(" Market Street and more"))
    return _pages(f.select("page", F.col("key").alias("at"), card.alias("card")), "sites.house", "<ul>", "</ul>")


def disguised_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ``.company-card`` per supplier, whose email is spelled out, protected by a key, or in base64, by turns."""
    f = supplier_facts(spark, sf_dir)
    spelled = F.concat(F.lit("<p>"), F.replace(F.replace("email", F.lit("@"), F.lit(" [at] ")), F.lit("."), F.lit(" (dot) ")), F.lit("</p>"))
    key = 42
    codes = F.transform(F.split("email", ""), lambda c: F.lower(F.lpad(F.hex(F.ascii(c).bitwiseXOR(F.lit(key)).cast("long")), 2, "0")))
    protected = F.concat(F.lit(f'<span data-cfemail="{key:02x}'), F.array_join(codes, ""), F.lit('">[protected]</span>'))
    # blanks in front fill the last group, so that no padding is needed
    padded = F.lpad("email", F.length("email") + F.pmod(-F.length("email"), F.lit(3)), " ")
    coded = F.concat(F.lit('<p data-x="1">code '), F.base64(F.encode(padded, "utf-8")), F.lit(" end</p>"))
    way = F.pmod("key", F.lit(3))
    card = F.concat(
        F.lit('<div class="company-card"><h3>'), "name", F.lit("</h3>"), F.when(way == 0, spelled).when(way == 1, protected).otherwise(coded),
        F.lit("<address>"), "address", F.lit("</address></div>")
    )
    return _pages(f.select("page", F.col("key").alias("at"), card.alias("card")), "disguised.house", "<main>", "</main>")


def structured_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per supplier with JSON-LD: an object, a list or a graph, the address as an object or a string, by turns; every fifth has a URL only."""
    f = supplier_facts(spark, sf_dir)
    way, bare = F.pmod("key", F.lit(3)), F.pmod("key", F.lit(5)) == 4
    address = F.when(
        F.pmod("key", F.lit(2)) == 0, F.concat(F.lit('{"@type":"PostalAddress","streetAddress":"'), "address", F.lit('","addressCountry":"US"}'))
    ).otherwise(F.concat(F.lit('"'), "address", F.lit('"')))
    contact = F.concat(F.lit('"email":"'), "email", F.lit('","telephone":"'), "phone", F.lit('","address":'), address)
    one = F.concat(F.lit('{"@type":"Organization","name":"'), "name", F.lit(' &amp; S&oacute;ns",'), F.when(bare, '"url":"about?x=1"').otherwise(contact), F.lit("}"))
    body = F.when(way == 0, one).when(way == 1, F.concat(F.lit("["), one, F.lit("]"))).otherwise(F.concat(F.lit('{"@graph":['), one, F.lit(',{"@type":"Person","name":"x"}]}')))
    kind = F.when(F.pmod("key", F.lit(2)) == 0, '"application/ld+json"').otherwise("application/ld+json id=q")
    html = F.concat(F.lit("<html><head><script type="), kind, F.lit(">"), body, F.lit('</script><script type="application/ld+json">{bad</script></head><body>-</body></html>'))
    return f.select(F.col("key").alias("page_id"), F.concat(F.lit("https://structured.house/"), "key").alias("url"), html.alias("html"))


def pricing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ``.package`` box per part: its name as heading, and a dollar price."""
    parts = table(spark, sf_dir, "part").withColumn("at", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1)
    page = (F.pmod(F.xxhash64("p_brand"), F.lit(1 << 40)) * 100_000 + F.floor(F.col("at") / 25)).cast("long")
    card = F.concat(F.lit('<div class="package"><h3>'), F.col("p_name"), F.lit(" no "), F.col("p_partkey"), F.lit("</h3><span>from $"), price_text(), F.lit("</span></div>"))
    return _pages(parts.select(page.alias("page"), "at", card.alias("card")), "prices.house", "<main>", "</main>")


def repeated_pricing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes of parts, each twice, the second time in capitals and inside a longer price box; two parts of three say a currency in letters."""
    parts = table(spark, sf_dir, "part")
    way = F.pmod("p_partkey", F.lit(3))
    sign = F.when(way == 0, "$").when(way == 1, "EUR ").otherwise("NGN ")
    told = F.concat(F.col("p_name"), F.lit(" no "), F.col("p_partkey"))

    def box(title: Column, start: str) -> Column:
        return F.concat(F.lit('<div class="package"><h3>'), title, F.lit(f"</h3><span>{start} "), sign, price_text(), F.lit("</span></div>"))

    twice = F.concat(F.lit('<div class="pricing"><b class="price">'), box(told, "from"), F.lit("</b></div>"), F.lit('<div class="plan">'), box(F.upper(told), "FROM"), F.lit("</div>"))
    page = F.floor(F.col("p_partkey") / 15).cast("long")
    return _pages(parts.select(page.alias("page"), F.col("p_partkey").alias("at"), twice.alias("card")), "repeated.house", "<main>", "</main>")


def price_text() -> Column:
    """The retail price with two decimals."""
    return F.col("p_retailprice").cast("decimal(18,2)").cast("string")


def customer_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sightings of every customer on different pages: sharing an email, a phone, a host, or nothing, by turns."""
    c = table(spark, sf_dir, "customer").withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    key, way, second = F.col("c_custkey").cast("string"), F.pmod("c_custkey", F.lit(4)), F.col("side") == 1
    none = F.array().cast("array<string>")
    email = F.when(way == 0, F.concat(F.lit("info@shop"), key, F.lit(".co")))
    phone = F.when(way == 1, F.concat(F.lit("+4420"), F.lpad(key, 8, "7"))).when(way == 3, F.concat(F.lit("+4"), F.col("side"), F.lit("20"), F.lpad(key, 8, "7")))
    site = F.when(way == 2, F.concat(F.when(second, "https://www.shop").otherwise("https://shop"), key, F.when(second, ".co/about").otherwise(".co")))
    name = F.concat(F.lit("Shop "), F.substring(F.md5(key), 1, 16), F.when(second & (way < 2), " renamed entirely elsewhere").otherwise(""))
    return c.select(
        F.floor(F.col("c_custkey") / 50).cast("long").alias("seed"), F.concat(
            F.lit("https://pages.house/"), F.col("side"), F.lit("/"), key
        ).alias("source_url"), F.lit(0).alias("pos"), F.lit(1).alias("n_hits"),
        name.alias("company_name"), name.alias("business_name"), name.alias("listing_name"), F.concat(F.lit("body > div#c"), key).alias("container_path"), email.alias("email"), F.when(
            email.isNotNull(), F.array(email)
        ).otherwise(none).alias("emails"),
        phone.alias("phone"), F.when(
            phone.isNotNull(), F.array(phone)
        ).otherwise(none).alias("phone_numbers"), F.lit(None).cast("string").alias("address"), none.alias("addresses"), site.alias("website"), none.alias("socials"), F.lit("dom_block").alias("extraction_scope"), F.lit(0.6).alias("confidence"),
    )
