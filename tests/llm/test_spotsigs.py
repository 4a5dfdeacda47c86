import hashlib
import random
import re

import pytest

from harvestry.llm import queries, spotsigs


def spots(text):
    """Plain reading of the signatures of an ASCII text."""
    words = re.findall("[^\\W_]+", text.lower())
    anchors, found = set(spotsigs.ANCHORS), set()
    for k, w in enumerate(words):
        after = [x for x in words[k + 1 :] if x not in anchors][:2]
        if w in anchors and len(after) == 2:
            found.add((w, *after))
    found = found or {tuple(words[k : k + 3]) for k in range(len(words) - 2)}
    return found or ({tuple(words)} if words else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op5_document_fingerprints(spark, sf).collect()}
    assert len(got) == len(docs)
    order = sorted(docs, reverse=True)
    for k, d in enumerate(order):
        text, follow = docs[d], docs[order[(k + 1) % len(order)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + follow[:half]
        assert got[d].n_chars == len(text) and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[d].near_edited == pytest.approx(jaccard(spots(text), spots(edited)), abs=1e-9)
        assert got[d].near_next == pytest.approx(jaccard(spots(text), spots(follow)), abs=1e-9)
        assert len(got[d].fingerprint) == 8 * len(spots(text))
    by_text = {}
    assert all(by_text.setdefault(docs[d], r.fingerprint) == r.fingerprint for d, r in got.items())


def test_neighbours_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "BUCKET_ROWS", 3)
    for cells in (4, 1000):
        monkeypatch.setattr(spotsigs, "QUANTILES", cells)
        ids = [i * i for i in range(60)] + [-5, 10**17, 10**17 + 1]
        docs = spark.createDataFrame([(i, f"t{i}", i) for i in ids], "id long, text string, tie long")
        got = {r.id: r.next_text for r in spotsigs.with_next(docs, "id", ["text"], "tie").collect()}
        order = sorted(ids, reverse=True)
        assert got == {i: f"t{order[(k + 1) % len(order)]}" for k, i in enumerate(order)}


def test_odd_rows(spark):
    rows = [(5, "no anchor words whatsoever"), (5, "no anchor words whatsoever"), (4, None), (3, ""), (None, "Hi"), (2, "the " * 50_000 + "x y " * 30_000), (1, "été")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, tie int, next_text int")
    got = spotsigs.fingerprint_edits(docs).collect()
    assert len(got) == len(rows)
    by = {r.id: r for r in got if r.id != 5}
    assert by[4].signatures == [] and by[4].near_edited == 1.0 and by[4].near_next == 1.0 and by[3].near_next == 0.0
    assert by[None].edited == "Hn" and by[1].n_chars == 3
    assert [r.near_next for r in got if r.id == 5] in ([1.0, 0.0], [0.0, 1.0])
    assert spotsigs.fingerprint_edits(docs.limit(0)).count() == 0
    one = spotsigs.fingerprint_edits(docs.filter("doc_id = 1")).first()
    assert one.edited == "été"[:2] + "é" and one.near_next == 1.0
    plan = spotsigs.fingerprint_edits(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_classes_are_those_of_all_pairs(spark, sf):
    """The query's classes against all pairs; and a family of copies that are unlike each other, but like their original."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert_classes({r.doc_id: r.class_id for r in queries.document_classes(spark, sf).collect()}, docs, 0.8)
    dice = random.Random(5)
    base = [w for k in range(150) for w in ("the", f"a{k}", f"b{k}")]
    made = [base]
    for _ in range(30):
        copy = list(base)
        for k in dice.sample(range(150), 15):
            copy[3 * k + 1] = f"c{dice.randrange(10**6)}"
        made.append(copy)
    rows = [(k, " ".join(w)) for k, w in enumerate(made)] + [(90, None), (91, ""), (92, "hm"), (93, "hm"), (None, "hm")]
    found = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, set_id string")
    got = {r.id: r.class_id for r in spotsigs.similar_classes(found).collect()}
    assert got.pop(None) == 92
    assert_classes(got, {i: t or "" for i, t in rows if i is not None}, 0.8)
    assert spotsigs.similar_classes(found.limit(0)).count() == 0
    plan = spotsigs.similar_classes(found)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def assert_classes(got, texts, similarity):
    sets = {i: spots(t) for i, t in texts.items()}
    want = {i: i for i in texts}
    for i in sorted(texts):
        for j in texts:
            if j > i and want[i] != want[j] and jaccard(sets[i], sets[j]) >= similarity and bool(sets[i]) == bool(sets[j]):
                low, high = sorted((want[i], want[j]))
                want = {k: low if v == high else v for k, v in want.items()}
    assert got == want and len(set(want.values())) < len(want)


def test_classes_at_a_lower_likeness(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet").filter("lang = 'en'")
    got = {r.id: r.class_id for r in spotsigs.similar_classes(docs, 0.6).collect()}
    assert_classes(got, {r.doc_id: r.text for r in docs.collect()}, 0.6)
