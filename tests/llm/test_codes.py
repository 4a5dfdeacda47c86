import hashlib
import random
from math import floor, inf, nan

import numpy as np
import pytest
from pyspark.sql import functions as F

from harvestry.llm import codes, queries
from tests.llm.oracle import same


def brute(vectors, parts=4, size=256, rounds=4):
    """``vectors``: integer vectors in the order of their ids."""
    width = len(vectors[0]) // parts
    cut = np.array(vectors, object).reshape(len(vectors), parts, width)
    books = [[list(v) for v in cut[:size, p]] for p in range(parts)]

    def nearest(p):
        far = ((np.array(cut[:, p].tolist())[:, None, :] - np.array(books[p])[None]) ** 2).sum(axis=2)
        return far.argmin(axis=1), far.min(axis=1)

    for _ in range(rounds):
        for p in range(parts):
            own, _ = nearest(p)
            for e in range(len(books[p])):
                mine = [cut[k, p] for k in np.flatnonzero(own == e)]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    found = [nearest(p) for p in range(parts)]
    told = ",".join(str(c) for p in books for e in p for c in e)
    return [["%02x" % found[p][0][k] for p in range(parts)] for k in range(len(vectors))], sum(f[1] for f in found).tolist(), hashlib.sha256(told.encode()).hexdigest()


def check(rows, got):
    """``rows``: (id, integer vector, label) by id, ids unlike."""
    want, errors, digest = brute([v for _, v, _ in rows])
    by_label = {}
    for (_, _, label), e in zip(rows, errors):
        by_label[label] = by_label.get(label, 0) + e
    assert {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in got} == {
        i: ("".join(c), e, by_label[label], digest) for (i, _, label), c, e in zip(rows, want, errors)
    }


def test_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    df = queries.op12_vector_code_compression(spark, sf)
    check([(r.vec_id, [floor(1024 * x) for x in r.embedding], r.label) for r in rows], df.collect())
    assert same(df, queries.ORACLES["op12_vector_code_compression"], sf) == len(rows)


@pytest.mark.parametrize("scale, label", [(0.004, "int"), (0.3, "string"), (900.0, "long")])
def test_ties_repeats_and_large_values(spark, scale, label):
    """Few distinct values, so that many entries are equally near; repeated vectors; entries that are never used."""
    deal = random.Random(3)
    vectors = [[round(deal.gauss(0, 2)) * scale for _ in range(8)] for _ in range(400)]
    vectors += [deal.choice(vectors) for _ in range(500)]
    rows = [(k * 3 - 50, [float(np.float32(x)) for x in v], None if k % 7 == 0 else k % 3) for k, v in enumerate(vectors)]
    deal.shuffle(rows)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("label", F.col("label").cast(label)).repartition(5)
    coded, books = codes.compress(table)
    got = codes.with_label_errors(coded).select(F.col("id").alias("vec_id"), codes.hex_code(F.col("code")).alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
    check([(i, [floor(1024 * x) for x in v], y) for i, v, y in sorted(rows)], got.collect())


def test_bounds_agree_with_measuring_all():
    """Over many moves of the entries, of all sizes, and with fewer and fewer bounds."""
    deal = np.random.default_rng(1)
    for bounds in (0, 1, 3, 12):
        x = deal.integers(-40, 40, (500, 3))
        books, state, looked = codes.Codebooks(x[None, :30].copy()), None, 0
        for turn in range(12):
            state, need = codes.assign_part(x, books.entries[0], None if state is None else books.moved[0], state, min(bounds, 12 - turn))
            far = ((x[:, None, :] - books.entries[0][None]) ** 2).sum(axis=2)
            assert (state[0] == far.argmin(axis=1)).all()
            assert (state[1] * (1 + 1e-9) >= np.sqrt(far.min(axis=1))).all()
            for row, near, lower, outer in zip(np.sqrt(far), state[2], state[3], state[4]):
                assert (row[near] >= lower - 1e-6).all() and (np.diff(lower) >= 0).all()
            looked += (need > 0).mean() if turn else 0
            step = deal.integers(-1, 2, (1, 30, 3)) * (deal.random((1, 30, 1)) < 0.1 * (turn % 4))
            new = books.entries + step
            books = codes.Codebooks(new, np.sqrt((step**2).sum(axis=2)).astype(float))
        assert looked < 11


def test_odd_rows(spark):
    rows = [
        (1, None, 1), (2, [1.0, None, 0.0, 0.0], 1), (3, [nan, 0.0, 0.0, 0.0], 1), (4, [inf, 0.0, 0.0, 0.0], 1), (5, [], 1), (6, [1e30, 0.0, 0.0, 0.0], 1),
        (None, [0.5, 0.5, 0.5, 0.5], None), (7, [0.5, 0.25, 0.5, 0.5], 2), (7, [0.5, 0.25, 0.5, 0.5], 2), (8, [0.5] * 8, 2), (9, [-0.0001, 0.0, 0.0, 0.0], None),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").select("*", F.lit(1).alias("x"), F.lit(2).alias("code"), F.lit("i").alias("id"))
    coded, books = codes.compress(table)
    got = sorted((r.id is None, r.id or 0, list(r.code), r.error, r.label_error) for r in codes.with_label_errors(coded).collect())
    assert got == [(False, 7, [0, 0, 0, 0], 0, 0)] * 2 + [(False, 9, [2, 2, 2, 2], 0, 0), (True, 0, [0, 3, 0, 0], 0, 0)]
    assert books.entries[0].ravel().tolist() == [512, 512, -1, 512] and len(books.digest()) == 64
    none, empty = codes.compress(table.limit(0))
    assert codes.with_label_errors(none).collect() == [] and empty.entries.size == 0
    # a length that the parts do not divide is filled up
    short, _ = codes.compress(spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1)], "vec_id long, embedding array<float>, label int"))
    assert [(list(r.code), r.error) for r in short.collect()] == [([0, 0, 0, 0], 0)]
