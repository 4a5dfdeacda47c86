import math
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from harvestry.llm import queries, simhash


def brute(text, width=3):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(ids, prints):
    found = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if bin(prints[i] ^ prints[j]).count("1") <= 2 and found[i] > found[j]:
                    found[i], changed = found[j], True
    return found


def test_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.lit("x").alias("fingerprint"), F.lit(1).alias("v"))
    odd = spark.createDataFrame([(900, None), (901, ""), (902, "Ab"), (903, "aB\tcd"), (904, " \n "), (905, "É x y z"), (905, "É x y z")], "doc_id long, text string")
    docs = docs.unionByName(odd, allowMissingColumns=True)
    got = {r.id: r for r in simhash.near_duplicates(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    prints = {i: brute(t) for i, t in texts.items()}
    assert {i: r.fingerprint % 2**64 for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == classes(sorted(texts), prints)


def test_long_text_in_chunks():
    text = " ".join(f"w{i % 977} x{i % 13}" for i in range(40_000))
    assert simhash.simhash(simhash.shingles(text.encode().split(), 3)) % 2**64 == brute(text)
    assert [len(x) for x in simhash._parts(iter([1] * (2 * simhash.CHUNK + 3)))] == [simhash.CHUNK, simhash.CHUNK, 3]


@pytest.mark.parametrize("radius", [0, 2, 4])
def test_ball_links_connect_everything_in_the_radius(spark, radius):
    base = [0, 1, 3, 7, -1, -2, 1 << 40, (1 << 40) | 6, -(1 << 63), 12345, 12345 ^ 0b1111, 12345 ^ (1 << 62)]
    values = spark.createDataFrame([(v,) for v in base + [None, 0]], "v long")
    links = {(r.a, r.b) for r in simhash.ball_links(values, radius).collect()}
    assert all(bin((a ^ b) % 2**64).count("1") <= radius and a < b for a, b in links)
    reach = {v: v for v in base}
    for _ in base:
        for a, b in links:
            reach[a] = reach[b] = min(reach[a], reach[b])
    for a in base:
        for b in base:
            if bin((a ^ b) % 2**64).count("1") <= radius:
                assert reach[a] == reach[b]


def test_empty_table_and_null_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.keep_one(none).count() == 0
    rows = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (None, None)], "doc_id long, text string")
    got = sorted((r.id is None, r.component_id or -1) for r in simhash.near_duplicates(rows).collect())
    assert got == [(False, 5), (True, -1), (True, 5)]


def test_keep_one_of_near_copies(spark):
    words = [f"word{i}" for i in range(200)]
    near = words[:100] + ["changed"] + words[101:]
    far = [f"other{i}" for i in range(200)]
    half = words[:100] + far[:100]
    rows = [(4, words, "a"), (2, near, "b"), (9, words, "c"), (1, far, "d"), (7, half, "e"), (7, half, "e")]
    rows = [(i, " ".join(w), x) for i, w, x in rows] + [(20, "", "f"), (21, None, "g"), (22, "hm", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k string")
    got = sorted((r.doc_id, r.k) for r in simhash.keep_one(docs).collect())
    assert got == [(1, "d"), (2, "b"), (7, "e"), (20, "f"), (22, "h")]


def families(kind):
    """Texts with a passage added, cut or replaced; or a family of copies that are unlike each other and like their original."""
    rng, texts = random.Random(7), []

    def words(n):
        return [f"{rng.choice('abcdefgh')}{rng.randrange(9000)}" for _ in range(n)]

    if kind == "passages":
        for n in (60, 200, 500):
            for share in (0.05, 0.1, 0.15, 0.19):
                for _ in range(6):
                    base, k = words(n), int(n * share)
                    texts += [base, base + words(k)], [base, base[k:]], [base, base[: n // 2] + words(k) + base[n // 2 :]]
    else:
        base = words(600)
        texts.append([base])
        for _ in range(60):
            copy = list(base)
            for at in rng.sample(range(600), 12):
                copy[at] = words(1)[0]
            texts[0].append(copy)
    return [" ".join(w) for family in texts for w in family]


@pytest.mark.parametrize("kind", ["passages", "copies unlike each other"])
def test_groups_are_those_of_all_pairs(spark, kind):
    texts = families(kind)
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    want, by_shingle = list(range(len(texts))), {}
    for i, own in enumerate(sets):
        for s in own:
            by_shingle.setdefault(s, []).append(i)
    for i, own in enumerate(sets):
        for j in {j for s in own for j in by_shingle[s] if j > i}:
            if len(own & sets[j]) >= 0.8 * len(own | sets[j]) and want[i] != want[j]:
                low, high = sorted((want[i], want[j]))
                want = [low if w == high else w for w in want]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == set(want)


def test_no_pair_of_documents_is_missed(spark, sf):
    """Groups of sf0.1 against a plain prefix filter on the sets themselves, by exact counts of all shingles."""
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.1')}/documents.parquet")
    first, counts, index = {}, Counter(), {}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        first.setdefault(r.text, r.doc_id)
    words = {i: t.encode().lower().split() for t, i in first.items()}
    sets = {i: {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items() if w}
    for own in sets.values():
        counts.update(own)
    near = []
    for i, own in sorted(sets.items(), key=lambda x: len(x[1])):
        prefix = sorted(own, key=lambda s: (counts[s], s))[: len(own) - math.ceil(0.8 * len(own) - 1e-9) + 1]
        met = {j for s in prefix for j in index.get(s, ()) if len(sets[j]) >= 0.8 * len(own) - 1e-9}
        near += [(i, j) for j in met if len(own & sets[j]) >= 0.8 * len(own | sets[j])]
        for s in prefix:
            if counts[s] > 1:
                index.setdefault(s, []).append(i)
    assert len(near) > 20
    groups = {r.text_key: r.component for r in simhash.similar_groups(docs).collect()}
    keys = {r.doc_id: r.k for r in docs.select("doc_id", F.xxhash64("text").alias("k")).collect()}
    assert all(groups.get(keys[i], i) == groups.get(keys[j], j) for i, j in near)
    assert {k for k in groups} == {keys[i] for pair in near for i in pair}
    assert simhash.keep_one(docs).count() == len(first) - len(groups) + len(set(groups.values()))


def test_query(spark, sf):
    got = queries.op2_simhash_near_dedup(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {i: brute(t) for i, t in texts.items()}
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r.doc_id: r.component_id for r in got} == classes(sorted(texts), prints)


def test_two_sets_leave_one_bucket_of_all_that_they_share(spark, monkeypatch):
    """Texts 1 and 2 share 40 shingles, the last 21 of them with text 3."""
    rows = [(s, (key, 100, 0, 41 - s)) for s in range(1, 41) for key in ((1, 2) if s < 20 else (1, 2, 3))]
    members = spark.createDataFrame(rows, "s long, a struct<key: long, n: int, w: long, rem: int>")
    asked = []

    def verified(pairs):
        asked.extend((r.x, r.y) for r in pairs.collect())
        return pairs.filter("y = 2")

    monkeypatch.setattr(type(members), "distinct", lambda self: self if self.columns == ["x", "y"] else self.dropDuplicates())
    none, pairs = spark.createDataFrame([], "node long, component long"), spark.createDataFrame([], "x long, y long")
    groups = simhash.settled(members, none, pairs, lambda a, b, _: F.lit(1), 0.8, verified)
    assert sorted(asked) == [(1, 2), (1, 3), (2, 3)]
    assert {(r.node, r.component) for r in groups.collect()} == {(1, 1), (2, 1)}
    held = simhash.first_buckets(members, len(rows)).collect()
    assert sorted((r.s, r.a.key, r.size) for r in held) == [(1, 1, 2), (1, 2, 2), (20, 1, 3), (20, 2, 3), (20, 3, 3)]
    assert {r.a.key: r.a.top for r in held} == {1: [1, 20], 2: [1, 20], 3: [20]}
