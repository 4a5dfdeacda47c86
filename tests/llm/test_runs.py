import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from harvestry.llm import queries, runs


def brute(words, least=24, times=3):
    """Maximal repetitions, period by period, with the smallest period of each stretch."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if (i, j + q) not in found and j + q - i >= max(least, times * q):
                found[i, j + q] = q
            i = j
    return sorted((a, b - a, q) for (a, b), q in found.items())


def edited(doc_id, text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [*w[:a], *(w[a + (i - a) % p] for i in range(a, n))]
    return w


def left(words, found):
    gone = {k for a, n, p in found for k in range(a + p, a + n)}
    return [w for k, w in enumerate(words) if k not in gone]


def test_runs_of_random_sequences():
    deal = random.Random(5)
    for turn in range(600):
        words = []
        while len(words) < deal.choice([10, 40, 120, 300]):
            part = [deal.randrange(deal.choice([1, 2, 3, 9])) for _ in range(deal.randrange(1, 15))]
            words += part * deal.choice([1, 1, 2, 3, 4, 7]) + part[: deal.randrange(len(part))]
        least, times = deal.choice([(24, 3), (24, 3), (6, 2), (1, 2), (10, 4)])
        want = brute(words, least, times)
        assert runs.runs_of(words, least, times) == want, (words, least, times)
        named = [b"%d" % w for w in words]
        hashes = np.array([hash(("w", w)) % 2**63 for w in words], np.uint64)
        assert runs.find_runs(named, hashes, least, times) == want
        assert runs.collapse(named, want) == left(named, want)


def test_query_against_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, sf).collect()}
    assert got.keys() == texts.keys()
    some = 0
    for i, text in texts.items():
        words = edited(i, text)
        found = brute(words)
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        r, some = got[i], some + len(found)
        assert r.n_runs == len(found)
        assert (r.start, r.length, r.period) == (best or (None, None, None))
        assert r.exponent_milli == (best and 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % x for x in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(left(words, found)).encode()).hexdigest()
    assert some > 10


def test_odd_rows(spark):
    rows = [(None, "a " * 30), (None, None), (1, ""), (1, " \n\t"), (2, "x y " * 40_000), (3, "É É É " * 30), (4, "a b c " * 8), (4, "a b c " * 8), (5, "a b c " * 7 + "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("w").alias("words"), F.lit(1).alias("runs"), F.lit(2).alias("id"), F.lit(3).alias("h"))
    got = sorted((r.id is not None, r.id or 0, len(r.collapsed), [tuple(x) for x in r.runs]) for r in runs.periodic_runs(docs).collect())
    assert got == [
        (False, 0, 0, []), (False, 0, 1, [(0, 30, 1)]), (True, 1, 0, []), (True, 1, 0, []), (True, 2, 3, [(0, 80_000, 2)]),
        (True, 3, 5, [(0, 60, 2)]), (True, 4, 5, [(0, 24, 3)]), (True, 4, 5, [(0, 24, 3)]), (True, 5, 45, []),
    ]
    assert runs.periodic_runs(docs.limit(0)).collect() == []
    assert {r.id for r in runs.repeat_tails(docs).collect()} == {None, 1, 2, 3, 4, 5}
