import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from harvestry.llm import queries, tiling


def brute(item, text, least):
    """Plain greedy tiling: all longest free matches first, by place."""
    a, b = [True] * len(item), [True] * len(text)
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and a[i + n] and b[j + n] and item[i + n] == text[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return sum(not x for x in a)
        for k in range(n):
            a[i + k] = b[j + k] = False


def numbers(words):
    return np.array([ord(w) for w in words], np.uint64)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=14), st.lists(st.sampled_from("abcx"), max_size=24), st.integers(2, 4), st.integers(1, 40))
def test_covered_words(item, text, least, pairs):
    with pytest.MonkeyPatch.context() as m:
        m.setattr(tiling, "PAIRS", pairs)  # runs are cut at any place, and joined again
        assert tiling.tile(numbers(item), numbers(text), least) == brute(item, text, least)


def test_what_repeats_itself_is_tiled_in_little_memory():
    assert tiling.tile(numbers("ab" * 20), numbers("ab" * 100_000), 5) == 40


def test_common_seeds_are_left_out_but_no_leak_is_lost(spark):
    dice = random.Random(3)
    head = "which of the following words is the most fitting one here"  # seven seeds that all items share
    items = [f"{head} {' '.join(f'w{dice.randrange(10_000)}' for _ in range(30))}" for _ in range(150)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    seeds = tiling.item_seeds(bench.select(F.col("item_id").alias("item"), "text"), 5, 0.8).collect()
    assert sum(n > tiling.COMMON for n in Counter(r.seed for r in seeds).values()) == 1 and {r.spare for r in seeds} == {6}  # 7 places are needed
    docs = spark.createDataFrame([(k, items[k] if k % 2 else items[k][len(head) :] + " or so") for k in range(150)] + [(900, head)], "doc_id long, text string")
    got = {(r.id, r.item_id) for r in tiling.contaminated(docs, bench, coverage=0.7).collect()}
    assert got == {(k, k) for k in range(150)}


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = set()
    cut = {i: tiling.words_of(t) for i, t in items.items()}
    for d, t in docs.items():
        words = tiling.words_of(t)
        runs = {tuple(words[k : k + 5]) for k in range(len(words))}
        for i, item in cut.items():
            if sum(tuple(item[k : k + 5]) in runs for k in range(len(item) - 4)) * 5 >= 0.8 * len(item) and (n := brute(item, words, 5)) >= 0.8 * len(item):
                want.add((d, i, n, len(item)))
    got = queries.op10_benchmark_decontamination(spark, sf).collect()
    assert {(r.doc_id, r.item_id, r.covered, r.words) for r in got} == want and want and len(got) == len(want)


def test_reordered_passages_and_odd_rows(spark):
    dice = random.Random(4)
    items = [[f"w{dice.randrange(500)}" for _ in range(40)] for _ in range(30)]
    bench = spark.createDataFrame([*((i, " ".join(w)) for i, w in enumerate(items)), (90, None), (91, ""), (92, "too few words")], "item_id long, text string")
    item = items[3]
    parts = [item[20:40], item[0:12], item[12:20]]
    mixed = " filler text. ".join(" ".join(p).upper() for p in parts)
    most, half = " ".join(item[:33]), " ".join(item[:30])
    long = "some other words here " * 100_000 + " ".join(items[5]) * 300
    rows = [(1, mixed), (2, most), (3, half), (4, None), (5, ""), (None, most), (6, long), (6, long)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, item_id string")
    got = sorted((r.id or 0, r.item_id) for r in tiling.contaminated(docs, bench).collect())
    assert got == [(0, 3), (1, 3), (2, 3), (6, 5), (6, 5)]
    kept = tiling.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5]
    twice = bench.unionByName(spark.createDataFrame([(77, bench.filter("item_id = 3").first().text), (None, bench.filter("item_id = 3").first().text)], bench.schema))
    assert sorted((r.item_id or 0) for r in tiling.contaminated(docs.filter("doc_id = 1"), twice).collect()) == [0, 3, 77]
    assert tiling.contaminated(docs, bench.limit(0)).count() == 0 == tiling.contaminated(docs.limit(0), bench).count()


def test_rolling():
    ids = np.arange(1, 11).astype(np.uint64)
    assert len(set(tiling.rolling(ids, 5).tolist())) == 6 and not len(tiling.rolling(ids[:3], 5))
    assert tiling.rolling(np.tile(ids, 2), 3)[1] == tiling.rolling(np.tile(ids, 2), 3)[11]
