from difflib import SequenceMatcher
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from harvestry.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(sql, sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{Path(sf) / t}.parquet'")
    want = con.execute(sql)
    return [d[0] for d in want.description], want.fetchall()


@pytest.fixture(scope="module", autouse=True)
def extracted_once():
    """The queries by seed read the same extraction, whose tables are written once."""
    plain, known = catalog._extracted, {}
    catalog._extracted = lambda spark, sf_dir: known[sf_dir] if sf_dir in known else known.setdefault(sf_dir, plain(spark, sf_dir))
    yield
    catalog._extracted = plain


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    got = df.collect()
    assert got
    if name in catalog.ORACLES:
        names, want = rows_of(catalog.ORACLES[name], sf)
        assert sorted(names) == sorted(df.columns)
        left, right = sorted(repr(tuple(r[n] for n in names)) for r in got), sorted(map(repr, want))
        assert len(left) == len(right), (left[:3], right[:3])
        for a, b in zip(left, right):
            assert a == b


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalog.ORACLES) <= set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_similar_names_against_all_pairs(spark, sf):
    """Of the queries without SQL: every pair of a nation's customers by the ratio itself."""
    by_nation = {}
    for r in spark.read.parquet(f"{sf}/customer.parquet").orderBy("c_custkey").collect():
        by_nation.setdefault(r.c_nationkey, []).append((r.c_custkey, r.c_name.lower()))
    want = {(a, b, SequenceMatcher(None, p, q).ratio()) for own in by_nation.values() for k, (a, p) in enumerate(own) for b, q in own[k + 1 :]}
    got = catalog.similar_customer_names(spark, sf).collect()
    assert {tuple(r) for r in got} == {x for x in want if x[2] >= 0.94} and len(got) > 5
