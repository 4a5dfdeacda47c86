from pyspark.sql import functions as F

from harvestry.llm import linedup, queries
from tests.llm.oracle import same


def test_query_against_sql(spark, sf):
    for at in (sf, sf.replace("sf0.001", "sf0.01")):
        df = queries.op6_line_dedup(spark, at)
        assert same(df, queries.ORACLES["op6_line_dedup"], at)
    assert df.agg(F.sum("n_removed")).first()[0] > 100


def test_spread_near_and_far_from_the_threshold(spark):
    rows = [(h, f"s{k}", k) for h, n in ((1, 1), (2, 49), (3, 50), (4, 51), (5, 200), (6, 44), (7, 60)) for k in range(n) for _ in range(3)]
    rows += [(8, None, k) for k in range(90)]
    # many sites but few texts, and many texts but few sites
    rows += [(9, f"s{k}", k % 49) for k in range(300)] + [(10, f"s{k % 49}", k) for k in range(300)] + [(11, f"s{k % 50}", k) for k in range(300)]
    found = spark.createDataFrame(rows, "h long, site string, k long")
    got = {r.h: r.n for r in linedup.boilerplate(found, 50).collect()}
    assert got == {3: 150, 4: 153, 5: 600, 7: 180, 11: 300}


def test_odd_rows(spark):
    bar = "all rights reserved"
    docs = [(i, f"own text number {i} of some length\n {bar}\t\r\n\nend of {i}", f"s{i % 6}") for i in range(12)]
    docs += [(20, bar, "s1"), (21, f"{bar}\n{bar}\nlonger own text follows here, of more characters than that", "s2"), (22, None, "s3"), (23, "", None), (None, f"x of its own, with length\n{bar}", "s9"), (5, docs[5][1], "s5")]
    df = spark.createDataFrame([(*d, 1, "h") for d in docs], "doc_id long, text string, source string, pos int, k string")
    out = linedup.clean_documents(df)
    assert out.columns == df.columns and out.count() == len(docs)
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[0] == "own text number 0 of some length\n\nend of 0"
    assert got[20] == "" and got[21].startswith("longer") and got[22] is None and got[23] == ""
    assert got[None] == "x of its own, with length"
    assert linedup.clean_documents(df.limit(0)).count() == 0
    copies = spark.createDataFrame([(k, "a line of a text\nthat was copied", f"s{k}") for k in range(30)], "doc_id long, text string, source string")
    assert {r.text for r in linedup.clean_documents(copies).collect()} == {"a line of a text\nthat was copied"}
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
