import random
from difflib import SequenceMatcher

import pandas as pd
import pytest
from pyspark.sql import functions as F

from harvestry.operators import blocks as B
from harvestry.operators import links as L
from harvestry.operators import quotes as Q
from harvestry.operators import requests as R
from harvestry.operators.resolve import ARRAYS, RECORD, name_links, name_ratios, resolve, similar_names
from harvestry.plans import directory, rollup
from harvestry.sources.html import _parsed, parse_pages
from harvestry.streaming import incremental

PAGE = """<html><body><ul id="mills">
<li><strong>North Mill</strong> grinds rye. <a href="tel:+2348030000001">ring</a> <span class="venue">3 River Road, Kano</span> <a href="mailto:flour@north-mill.org">write</a> <a href="https://youtube.com/northmill">films</a>
<li><strong>South Mill</strong> grinds oats. <a href="tel:+2348030000002">ring</a> <span class="venue">9 Canal Close, Oyo</span> <a href="mailto:flour@south-mill.org">write</a> <a href="https://tiktok.com/southmill">films</a>
</ul></body></html>"""


def test_two_listings_stay_two_companies(spark):
    pages = spark.createDataFrame([(1, "https://list.org/x", PAGE), (2, "https://list.org/y", None), (3, "https://list.org/z", "<p>just words, nothing to find</p>")], "page_id long, url string, html string")
    found = B.entities(B.detect_blocks(parse_pages(pages, "page_id"), "page_id"), "page_id").collect()
    assert sorted((r.company_name, r.emails, r.phone_numbers, r.addresses, r.socials) for r in found) == [
        ("North Mill", ["flour@north-mill.org"], ["+2348030000001"], ["3 River Road, Kano"], ["https://youtube.com/northmill"]),
        ("South Mill", ["flour@south-mill.org"], ["+2348030000002"], ["9 Canal Close, Oyo"], ["https://tiktok.com/southmill"]),
    ]


def record(**given):
    arrays = {k: [] for k in ("emails", "phone_numbers", "addresses", "socials")}
    return {c.split()[0]: None for c in RECORD.split(", ")} | arrays | {"confidence": 0.8} | given


def resolved(spark, rows, **options):
    schema = f"scope long, pos int, n_hits int, {RECORD}"
    df = spark.createDataFrame(pd.DataFrame([{"scope": 1, "pos": k, "n_hits": 1} | r for k, r in enumerate(rows)])[[c.split()[0] for c in schema.split(", ")]].astype(object).where(lambda x: x.notna(), None), schema)
    return resolve(df, "scope", **options).orderBy("scope", "place").collect()


def test_branches_of_one_name_stay_apart(spark):
    kiosks = [record(company_name="Corner Kiosk", phone=p, phone_numbers=[p], address=a, addresses=[a]) for p, a in (("+1", "1 Mill Road"), ("+2", "2 Mill Road"))]
    assert len(resolved(spark, kiosks)) == 2


def similarity(a, b):
    return SequenceMatcher(None, a.lower(), b.lower()).ratio() if a and b else 0.0


def plain_merge(records):
    """All records of a scope in order, each weighed against all clusters: the rules one by one, without any blocking."""
    clusters = []
    for r in records:
        for c in clusters:
            other_block = c["extraction_scope"] == r["extraction_scope"] == "dom_block" and c["source_url"] == r["source_url"] and c["container_path"] and r["container_path"] and c["container_path"] != r["container_path"]
            sure = (c["email"] and c["email"] == r["email"]) or (c["phone"] and c["phone"] == r["phone"])
            against = [c["phone"] and r["phone"] and c["phone"] != r["phone"], c["address"] and r["address"] and c["address"] != r["address"], c["socials"] and r["socials"] and not set(c["socials"]) & set(r["socials"])]
            bare = min(sum(x is not None for x in (y["email"], y["phone"], y["address"], y["website"])) for y in (c, r)) <= 1
            likeness = similarity(c["company_name"], r["company_name"])
            likely = (c["host"] and c["host"] == r["host"] and likeness >= 0.72) or (bare and likeness >= 0.94)
            if not other_block and (sure or (likely and not any(against))):
                for k in ("email", "phone", "address", "website", "host"):
                    c[k] = r[k] if c[k] is None else c[k]
                for k in ARRAYS:
                    c[k] = c[k] + [x for x in r[k] if x not in c[k]]
                c["confidence"], c["n"] = round(min(1.0, c["confidence"] + 0.05), 3), c["n"] + 1
                break
        else:
            clusters.append(r | {"n": 1})
    return clusters


def test_components_give_what_one_global_pass_gives(spark):
    dice, rows = random.Random(7), []
    for scope in range(30):
        for k in range(40):
            n = dice.randrange(12)
            pick = lambda make: make(dice.randrange(12)) if dice.random() < 0.4 else None
            email, phone, site, place = pick(lambda x: f"a{x}@b.co"), pick(lambda x: f"+{x}"), pick(lambda x: f"https://h{x % 4}.co"), pick(lambda x: f"{x % 3} Mill Road")
            rows.append(record(scope=scope, pos=k, company_name=f"Company Number {n} of the Valley" + " x" * dice.randrange(2), email=email, emails=[email] if email else [], phone=phone, phone_numbers=[phone] if phone else [], address=place, addresses=[place] if place else [], website=site, socials=dice.sample("uvw", dice.randrange(2)), confidence=round(dice.random(), 2), source_url=f"u{dice.randrange(3)}", container_path=dice.choice([None, "p1", "p2"]), extraction_scope=dice.choice(["dom_block", "dom_block", "structured_data"])))

    def seen(r, n):
        return tuple(map(repr, (r["scope"], r["company_name"], r["email"], r["phone"], r["address"], r["website"], r["emails"], r["socials"], r["confidence"], n)))

    want = []
    for scope in range(30):
        order = sorted((r for r in rows if r["scope"] == scope), key=lambda r: (-r["confidence"], r["source_url"], r["pos"]))
        want += [seen(r, r["n"]) for r in plain_merge([r | {"host": r["website"] and r["website"][8:]} for r in order])]
    got = [r.asDict() for r in resolved(spark, rows)]
    assert sorted(seen(r, r["n_merged"]) for r in got) == sorted(want) and len(want) < 1000
    for scope in range(30):
        own = [r for r in got if r["scope"] == scope]
        assert [r["place"] for r in own] == list(range(1, len(own) + 1))
        assert [r["confidence"] for r in own] == sorted((r["confidence"] for r in own), reverse=True)


def test_copies_of_a_listing_raise_its_score(spark):
    rows = [record(company_name="One", email="a@b.co", emails=["a@b.co"], confidence=0.5, n_hits=3), record(company_name="Two", email="a@b.co", emails=["a@b.co"], confidence=0.4)]
    assert [(r.company_name, r.confidence, r.n_merged) for r in resolved(spark, rows)] == [("One", 0.65, 2)]


def test_a_component_of_any_size_is_merged(spark):
    """30,000 records that the phone of a platform makes one component; those without it only share emails with others."""
    same = F.when(F.col("id") % 2 == 0, "+44207").otherwise(F.concat(F.lit("+1"), F.col("id").cast("string")))
    none = F.array().cast("array<string>")
    rows = spark.range(30_000).select(F.lit(1).alias("scope"), F.col("id").cast("int").alias("pos"), *[F.lit(None).cast(k).alias(c) for c, k in (x.split() for x in RECORD.split(", ")) if c not in ("company_name", "phone", "email", "confidence", *ARRAYS)], *[none.alias(c) for c in ARRAYS], F.concat(F.lit("Name "), F.col("id").cast("string")).alias("company_name"), same.alias("phone"), F.concat(F.floor(F.col("id") / 2).cast("string"), F.lit("@b.co")).alias("email"), F.lit(0.5).alias("confidence"))
    got = resolve(rows, "scope").select("n_merged").collect()
    assert len(got) == 15_000 and max(r.n_merged for r in got) == 15_001  # all with the phone, and the one that has the first one's email


def test_name_links_lose_no_pair(spark):
    dice = random.Random(3)
    names = []
    for _ in range(30):
        base = "".join(dice.choices("abcdef ", k=dice.randrange(5, 60))).strip() or "ab"
        names += [base, base[:3] + dice.choice("xyz") + base[3:], base[:-1]]
    rows = spark.createDataFrame([(1, k, n) for k, n in enumerate(names)], "scope long, eid long, company_name string")
    got = {(r.a, r.b) for r in name_links(rows).collect()}
    first = {}
    for k, n in enumerate(names):
        first.setdefault(n, k)
    want = {(a, b) for a in first.values() for b in first.values() if a < b and max(similarity(names[a], names[b]), similarity(names[b], names[a])) >= 0.94}
    want |= {(first[n], k) for k, n in enumerate(names) if first[n] != k}
    assert got == want


@pytest.mark.parametrize(
    ("markup", "tags"),
    [
        ("<ul><li>a<li>b</ul>", ["html", "body", "ul", "li", "li"]),
        ("<p>a<p>b<br>c", ["html", "body", "p", "p", "br"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["html", "body", "table", "tr", "td", "td", "tr", "td"]),
        ("<title>t</title><b>x", ["html", "head", "title", "body", "b"]),
        ("", []),
    ],
)
def test_markup(markup, tags):
    nodes, tokens, _, error = _parsed(markup)
    assert [n["tag"] for n in nodes] == tags and error is None
    assert all(n["node_id"] < n["end_id"] <= len(nodes) for n in nodes)


def test_scripts_hold_no_text_and_offsets_cut_the_markup():
    markup = '<div id="q" class="a b c"><script>var x = "</p>"</script>text &amp; more</div>'
    nodes, tokens, _, _ = _parsed(markup)
    div = next(n for n in nodes if n["tag"] == "div")
    assert tokens == ["text & more"] and div["path"] == "body > div#q"
    assert markup[div["html_start"] : div["html_start"] + div["html_len"]] == markup


def test_frontier(spark):
    links = spark.createDataFrame([("a", "b", 1), ("a", "c", 2), ("b", "d", 1), ("c", "d", 1), ("d", "e", 1), ("e", "f", 1), ("f", "g", 1)], "page_url string, url string, rank int")
    start = spark.createDataFrame([("s", "a", 0), ("t", "c", 0)], "seed_url string, url string, rank int")
    got = [(r.seed_url, r.url, r.depth, r.parent_url) for r in L.frontier(start, links, 3, 5).orderBy("seed_url", "rank").collect()]
    assert got == [("s", "a", 0, None), ("s", "b", 1, "a"), ("s", "c", 1, "a"), ("s", "d", 2, "b"), ("s", "e", 3, "d"), ("t", "c", 0, None), ("t", "d", 1, "c"), ("t", "e", 2, "d"), ("t", "f", 3, "e")]


def test_batches(spark):
    rows = [(1, 0, "shop.com"), (2, 0, "not-a-url"), *[(3, k, f"https://a{k}.co") for k in range(11)], (4, None, None), (5, 0, " a.co "), (5, 1, "bad"), (5, 2, " ")]
    got = {r.request_id: r for r in R.validate_batches(spark.createDataFrame(rows, "request_id long, pos int, url string")).collect()}
    assert got[1].valid and got[1].valid_urls == ["https://shop.com"]
    assert [got[k].message for k in (2, 3, 4, 5)] == ["No valid URLs found", "Maximum 10 URLs allowed per request", "No URLs provided", "Validated 1 URLs. 1 invalid."]
    assert got[5].invalid_urls == ["bad"]


def test_stream_snapshots(spark, tmp_path):
    pages = spark.createDataFrame([("s", "u1"), ("s", "u1"), ("t", "u2")], "seed_url string, url string")
    pages.coalesce(1).write.parquet(f"{tmp_path}/in")
    for more in ([], [("s", "u3"), ("s", "u1")]):
        if more:
            spark.createDataFrame(more, "seed_url string, url string").write.mode("append").parquet(f"{tmp_path}/in")
        stream = incremental.page_stream(spark, f"{tmp_path}/in", "seed_url string, url string")
        run = incremental.snapshots(incremental.new_pages(stream), f"{tmp_path}/out", f"{tmp_path}/state", lambda b: b, lambda r: r.groupBy("seed_url").agg(F.count("*").alias("n")))
        run.awaitTermination()
        got = {r.seed_url: r.n for r in spark.read.parquet(f"{tmp_path}/out/seeds").collect()}
        assert got == ({"s": 2, "t": 1} if more else {"s": 1, "t": 1})


def test_seed_rollup(spark):
    pages = spark.createDataFrame([(1, "https://list.org/x", PAGE), (2, "https://list.org/y", PAGE.replace("South Mill", "South Mill Ltd"))], "page_id long, url string, html string")
    companies, quotes, done = directory.seeds(directory.extract(pages))
    row = done.first()
    assert (row.n_companies, row.n_quotes, row.status, len(row.companies)) == (2, 0, "success", 2)
    assert sorted(row.emails) == ["flour@north-mill.org", "flour@south-mill.org"] and len(row.crawled_urls) == 2


def trees(dice, n):
    """Random nested nodes ``(start, end, text)`` in document order."""
    out = []

    def grow(depth):
        k = len(out)
        out.append(None)
        words = ["w" * dice.randrange(8, 30)] * dice.choice([0, 0, 1, 2])
        while depth < 9 and len(out) < n and dice.random() < 0.75:
            words.append(grow(depth + 1))
        text = " ".join(w for w in words if w) or "x" * 21
        out[k] = (k, len(out), text)
        return text

    while len(out) < n:
        grow(0)
    return [x for x in out if len(x[2]) >= 20 and dice.random() < 0.8]


def test_nesting_is_decided_by_one_pass(spark):
    """The innermost and the outermost of nested nodes against all pairs, and of a page of many thousand."""
    dice = random.Random(4)
    pages = {p: trees(dice, dice.choice([3, 20, 120])) for p in range(40)}
    kept = {(p, s) for p, own in pages.items() for s, e, t in own if not any(
        (s < a and b <= e and len(u) < len(t)) or (a < s and e <= b and len(u) == len(t)) for a, b, u in own)}
    top = {(p, s) for p, own in pages.items() for s, e, _ in own if not any(a < s and e <= b for a, b, _ in own)}
    df = spark.createDataFrame([(p, (s, e), t, s, e) for p, own in pages.items() for s, e, t in own], "page_id long, b struct<node_id: int, end_id: int>, text string, s int, e int")
    assert {(r.page_id, r.b.node_id) for r in B.innermost(df, "page_id").collect()} == kept and len(kept) > 100
    assert {(r.page_id, r.s) for r in Q.outermost(df, "page_id").collect()} == top and len(top) < len(kept)
    deep = spark.range(20_000).select(F.lit(1).alias("page_id"), F.struct(F.col("id").cast("int").alias("node_id"), (40_000 - F.col("id")).cast("int").alias("end_id")).alias("b"))
    deep = deep.withColumn("text", F.repeat(F.lit("x"), (20 + F.floor((20_000 - F.col("b.node_id")) / 1000)).cast("int")))
    assert [r.b.node_id for r in B.innermost(deep, "page_id").collect()] == [19_001]


def test_owners_of_many_quotes(spark):
    """Quotes and companies of one page, each pair compared by the rules one by one."""
    dice = random.Random(6)
    words = "Ash Birch Cedar Dale Elm Fir Grove Hill Ivy Juniper Knoll Larch Mill North Oak Pine".split()
    companies = [(1, " ".join(dice.choices(words, k=dice.choice([1, 2, 3]))), k) for k in range(60)] + [(2, "Only One", 0), (3, None, 0), (3, "", 1)]
    found = [(1, None, k, None if k % 7 else "Own Name", " ".join(dice.choices(words, k=2)), " ".join(dice.choices([*words, "pack"], k=dice.choice([0, 1, 6])))) for k in range(150)]
    found += [(2, None, 0, "", "a", "b"), (3, None, 0, None, "c", "d"), (4, None, 0, None, "e", None)]
    got = Q.attach_companies(
        spark.createDataFrame(found, "page_id long, root int, pos int, company string, title string, description string"),
        spark.createDataFrame(companies, "page_id long, company_name string, place int"), "page_id").collect()
    assert len(got) == len(found)
    for r in got:
        _, _, _, company, title, text = next(x for x in found if (x[0], x[2]) == (r.page_id, r.pos))
        own, said = [n or "" for p, n, _ in companies if p == r.page_id], f"{title} {text or ''}".lower() if text is not None else title.lower()
        best, top = "", 0.0
        for n in own:
            score = (similarity(n, said) if n else 0.0) + (0.5 if n.lower() in said else 0.0)
            if score > top:
                best, top = n, score
        want = company or (own[0] if len(own) == 1 else best if top >= 0.35 else "")
        assert r.company == want, (r, want, top)


def test_names_that_begin_alike_meet_in_few_places(spark):
    """Numbered names: all close pairs are found, and rows before any comparison grow with the names."""
    made = {}
    for n in (150, 600):
        names = [f"Customer#{k * 37 % 100_003:09d}" for k in range(n)]
        rows = spark.createDataFrame([(1, k, x) for k, x in enumerate(names)], "scope int, eid long, company_name string")
        got = {(r.a, r.b) for r in similar_names(rows).collect()}
        if n == 150:
            assert got == {(a, b) for a in range(n) for b in range(a + 1, n) if max(similarity(names[a], names[b]), similarity(names[b], names[a])) >= 0.94} and got
        made[n] = len(got)
    assert made[600] > made[150]


def test_links_of_pages_with_one_url_follow_by_url(spark):
    """Of a URL that was fetched more than once, links with the same rank are in the order of their URLs, as they would be in SQL."""
    seeds = spark.createDataFrame([("https://a.b/s",)] * 2, "seed_url string")
    urls = [[f"https://a.b/{(k * 7 + page) % 10}{page}" for k in range(10)] for page in (2, 1)]
    ranked = spark.createDataFrame([("https://a.b/s", u, k + 1) for own in urls for k, u in enumerate(own)], "page_url string, url string, rank int")
    want = ["https://a.b/s"] * 2 + [u for pair in zip(*urls) for u in sorted(pair)]
    for limit in (150, 9):
        assert [(r.url, r.rank) for r in L.discovery_list(seeds, ranked, limit).orderBy("rank").collect()] == [(u, k) for k, u in enumerate(want)][:limit]


def rows_of_joins(plan):
    """The rows that each join of a plan has made."""
    kind = plan.nodeName()
    inner = [plan.executedPlan()] if kind == "AdaptiveSparkPlan" else [plan.plan()] if kind.endswith("QueryStage") else [plan.children().apply(k) for k in range(plan.children().size())]
    own = [plan.metrics().apply("numOutputRows").value()] if kind.endswith("Join") else []
    return own + [n for x in inner for n in rows_of_joins(x)]


def test_joins_of_names_that_begin_alike_make_few_rows(spark):
    names = [f"Customer#{k * 37 % 100_003:09d}" for k in range(1200)]
    rows = spark.createDataFrame([(1, k, x) for k, x in enumerate(names)], "scope int, eid long, company_name string")
    found = similar_names(rows)
    n = len(found.collect())
    assert n and max(rows_of_joins(found._jdf.queryExecution().executedPlan())) < 2 * n + len(names)


def test_names_of_few_letters_meet_once(spark):
    """Names in which letters alternate and repeat, of lengths that allow one or more characters without a partner: each pair of a scope once."""
    dice = random.Random(8)
    names = []
    for _ in range(60):
        base = "".join(dice.choices("xyz", k=dice.randrange(8, 40)))
        at = dice.randrange(len(base) - 2)
        names += [base, base[:at] + base[at + 1] + base[at] + base[at + 2 :], base[:at] + base[at + 1 :], base[1:] + base[0], base[:at] + "w" + base[at + 1 :], base + base[-1]]
    scopes = [dice.randrange(2) for _ in names]
    rows = spark.createDataFrame([(s, k, n) for k, (s, n) in enumerate(zip(scopes, names))], "scope int, eid long, company_name string")
    first = {}
    for k, key in enumerate(zip(scopes, names)):
        first.setdefault(key, k)
    want = sorted((a, b) for (s, p), a in first.items() for (t, q), b in first.items() if a < b and s == t and max(similarity(p, q), similarity(q, p)) >= 0.94)
    assert sorted((r.a, r.b) for r in similar_names(rows).collect()) == want and len(want) > 50
    ratios = {(a, b, similarity(names[a], names[b])) for a, b in want} | {(first[key], k, 1.0) for k, key in enumerate(zip(scopes, names)) if first[key] != k}
    assert {tuple(r) for r in name_ratios(rows).collect()} == {x for x in ratios if x[2] >= 0.94}


def test_frontier_is_appended(spark, tmp_path):
    """Random links with hubs, against a plain walk; each level is written once."""
    dice = random.Random(9)
    links = [(f"p{a}", f"p{b}", r) for a in range(60) for r, b in enumerate(dice.sample(range(60), dice.choice([0, 1, 3, 40])))]
    start = [(f"s{k}", f"p{dice.randrange(60)}", j) for k in range(8) for j in range(2)]
    for pages in (5, 25, 150):
        want = set()
        for seed in {s for s, _, _ in start}:
            order, ranks = [], {}
            for _, u, r in sorted((x for x in start if x[0] == seed), key=lambda x: (x[2], x[1])):
                if u not in ranks and len(order) < pages:
                    order.append(u)
                    ranks[u] = (0, None)
            last = list(order)
            for depth in (1, 2, 3):
                fresh = []
                for u in last:
                    for _, v, _ in sorted((x for x in links if x[0] == u), key=lambda x: (x[2], x[1])):
                        if v not in ranks and len(order) < pages:
                            ranks[v] = (depth, u)
                            order.append(v)
                            fresh.append(v)
                last = fresh
            want |= {(seed, u, *ranks[u], k + 1) for k, u in enumerate(order)}
        got = L.frontier(spark.createDataFrame(start, "seed_url string, url string, rank int"), spark.createDataFrame(links, "page_url string, url string, rank int"), pages=pages)
        assert {tuple(r) for r in got.collect()} == want


def test_exports_in_bounded_parts(spark, tmp_path):
    """A seed of many companies, one with errors only, and two whose keys clash: all parts together are the nested row."""
    n = 230
    pages = [("big", f"https://big.org/{k:03d}", "success" if k % 50 else "error", None if k % 50 else "timeout", k) for k in range(n)]
    pages += [("lost", "https://lost.org", "error", "refused", 1), ("a/b", "https://a", "success", None, 1), ("a-b", "https://b", "success", None, 1)]
    companies = [("big", k + 1, f"Shop {k}", [f"s{k % 70}@x.co", f"S{k}@y.co"], [], [""]) for k in range(n)] + [("a/b", 1, "One", [], ["+1"], []), ("a-b", 1, "Two", [], ["+2"], [])]
    quotes = [("big", k + 1, f"title {k}") for k in range(75)]
    pages = spark.createDataFrame(pages, "seed_url string, source_url string, status string, error string, place long")
    companies = spark.createDataFrame(companies, "seed_url string, place int, company_name string, emails array<string>, phone_numbers array<string>, addresses array<string>")
    quotes = spark.createDataFrame(quotes, "seed_url string, place int, title string")
    parts = rollup.seed_parts(pages, companies, quotes, 20)
    whole = {r.seed_url: r.asDict(True) for r in rollup.seed_results(pages, companies, quotes).collect()}
    made = {}
    for r in parts.orderBy("seed_url", "part").collect():
        made.setdefault(r.seed_url, []).append(r.asDict(True))
    assert made.keys() == whole.keys()
    for seed, own in made.items():
        assert [r["part"] for r in own] == list(range(own[0]["n_parts"])) and all(r["status"] == whole[seed]["status"] and r["n_companies"] == whole[seed]["n_companies"] for r in own)
        for c in ("crawled_urls", "errors", "companies", "quotes", "emails", "phone_numbers", "addresses"):
            assert all(len(r[c]) <= 20 for r in own) and [x for r in own for x in r[c]] == whole[seed][c], (seed, c)
    manifest = rollup.write_exports(parts, companies.select("seed_url", "company_name"), str(tmp_path), 4)
    assert {(r.seed_url, r.key) for r in manifest.collect()} == {("big", "big"), ("lost", "lost"), ("a/b", "a_b"), ("a-b", "a_b")}
    back = spark.read.schema("seed_url string, part int, companies array<struct<company_name: string>>, bucket int").json(f"{tmp_path}/json")
    assert back.join(manifest, ["seed_url", "bucket"]).filter("part < n_parts").select(F.explode("companies.company_name")).count() == n + 2
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == n + 2


def test_view_reads_what_a_batch_touches(spark, tmp_path):
    """Ten batches of as many seeds each: the view is that of all pages, and no batch reads more than the first ones, as buckets are split."""
    all_, read = {}, []
    for n in range(10):
        rows = [(f"seed{(n * 5 + k * 13) % 60}", f"u{n}-{k}") for k in range(8)]
        for s, _ in rows:
            all_[s] = all_.get(s, 0) + 1
        spark.createDataFrame(rows, "seed_url string, url string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = incremental.page_stream(spark, f"{tmp_path}/in", "seed_url string, url string")
        incremental.snapshots(
            stream, f"{tmp_path}/out", f"{tmp_path}/state", lambda b: b, lambda r: r.groupBy("seed_url").agg(F.count("*").alias("n")), bucket_records=2
        ).awaitTermination()
        read.append(incremental.last_step(spark, f"{tmp_path}/out"))
    assert {r.seed_url: r.n for r in incremental.latest(spark, f"{tmp_path}/out").collect()} == all_
    assert read[-1].records == 80 and read[-1].bits == 6 and [r.batch for r in read] == list(range(10))
    assert max(r.read for r in read) < 40 and all(r.touched <= 8 for r in read)  # of 80 records
