"""Compares a query with its DuckDB SQL."""

from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(df, sql, sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{Path(sf) / t}.parquet'")
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    rows = sorted(map(repr, want.fetchall()))
    got = sorted(repr(tuple(r[n] for n in names)) for r in df.collect())
    assert len(got) == len(rows)
    for g, w in zip(got, rows):
        assert g == w
    return len(rows)
