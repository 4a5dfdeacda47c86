import random
import re

import numpy as np
from pyspark.sql import functions as F

from harvestry.llm import minhash, queries


def shingle_set(text, width=3):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def classes(texts, percent=85):
    """The least id of each component over all pairs that share a shingle."""
    sets, by = {i: shingle_set(t) for i, t in texts.items()}, {}
    for i, own in sets.items():
        for s in own:
            by.setdefault(s, []).append(i)
    top = {i: i for i in texts}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    links = 0
    for i, own in sets.items():
        for j in {j for s in own for j in by[s]}:
            if j < i and 100 * len(own & sets[j]) >= percent * len(own | sets[j]):
                links += 1
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return {i: find(i) for i in texts}, sets, links


def check(got, texts):
    want, sets, links = classes(texts)
    assert {r.id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in texts}
    return links


def test_query_against_brute_force(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert check(queries.op13_minhash_near_dedup(spark, sf).withColumnRenamed("doc_id", "id").collect(), texts) > 30


def test_signatures():
    """Each element ranks all places once; agreement is the likeness; sets of any size, alone or together, give the same."""
    deal = np.random.default_rng(2)
    one = minhash.signatures_of([np.array([12345], np.int64)])[0] >> np.uint64(48)
    assert sorted(one.tolist()) == list(range(128))
    sets = [np.unique(deal.integers(-(2**62), 2**62, n)) for n in (0, 1, 2, 5, 30, 128, 400, 3000, 60_000)]
    together = minhash.signatures_of(sets)
    assert all((minhash.signatures_of([s])[0] == t).all() for s, t in zip(sets, together))
    assert (together[0] == 2**64 - 1).all() and (together[1:] < 2**64 - 1).all()
    for n, shared in ((10, 9), (100, 85), (1000, 930), (1000, 300)):
        found = []
        for _ in range(60):
            all_ = deal.integers(-(2**62), 2**62, 2 * n - shared)
            found.append((np.equal(*minhash.signatures_of([all_[:n], all_[n - shared :]]))).mean())
        likeness = shared / (2 * n - shared)
        # the mean of 60 estimates, of which each has a smaller variance than independent ranks would give
        assert abs(np.mean(found) - likeness) < 4.5 * np.sqrt(likeness * (1 - likeness) / 128 / 60)
        assert np.var(found) < 1.6 * likeness * (1 - likeness) / 128


def family(dice, size, words, edits, prefix):
    base = [f"{prefix}{k}" for k in range(words)]
    out = []
    for _ in range(size):
        copy = list(base)
        for k in dice.sample(range(words), edits):
            copy[k] = f"x{dice.randrange(10**9)}"
        out.append(" ".join(copy))
    return out


def test_families(spark):
    """Members unlike each other whose original is missing; members that only a few others are like; large groups of copies."""
    dice = random.Random(8)
    made = family(dice, 60, 600, 14, "a") + family(dice, 60, 300, 8, "b") + family(dice, 40, 90, 2, "c") + family(dice, 40, 40, 1, "d")
    made += [made[0]] * 50 + [made[0].upper()] * 5 + [f"one two {dice.randrange(9)}" for _ in range(40)] + [f"w{k}" for k in range(20)] * 2
    dice.shuffle(made)
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(3)
    assert check(minhash.near_duplicates(docs).collect(), dict(enumerate(made))) > 500


def test_odd_rows(spark):
    rows = [(None, "a b c"), (None, "q r s t"), (1, None), (2, ""), (2, " "), (3, "A b\tc"), (3, "A b\tc"), (4, "a"), (5, "A"), (6, "w x " * 40_000), (7, "w x " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("k").alias("key"), F.lit(1).alias("n"), F.lit(2).alias("set_key"), F.lit(3).alias("band"))
    got = sorted(((r.id is not None, r.id or 0, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()), key=str)
    want = [
        (False, 0, 1, 3, False), (False, 0, 2, None, True), (True, 1, 0, 1, True), (True, 2, 0, 2, True), (True, 2, 0, 2, True), (True, 3, 1, 3, True), (True, 3, 1, 3, True),
        (True, 4, 1, 4, True), (True, 5, 1, 4, False), (True, 6, 2, 6, True), (True, 7, 2, 6, False),
    ]
    assert got == sorted(want, key=str)
    assert minhash.near_duplicates(docs.limit(0)).collect() == []
