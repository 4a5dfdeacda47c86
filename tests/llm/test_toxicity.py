import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from harvestry.llm import queries, toxicity

NEUTRAL = "the a of road tree house walks reads likes garden river music train window paper".split()


def corpus(dice, n=1200):
    """Insults make a text toxic; one group's name is mostly found in toxic texts, though it is no insult."""
    rows = []
    for i in range(n):
        y = int(dice.random() < 0.3)
        words = dice.choices(NEUTRAL, k=12)
        if y:
            words += dice.choices(["vilefool", "dumbfool", "grumblix", "grumblot"], k=1) * (dice.random() < 0.8)
        if dice.random() < (0.6 if y else 0.03):
            words.append("muslim")
        elif dice.random() < 0.3:
            words.append("christian")
        dice.shuffle(words)
        rows.append((i, " ".join(words), y))
    return rows


def fitted(spark, rows, **settings):
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return toxicity.fit(docs.drop("toxic"), docs.select("doc_id", "toxic"), F.lit(True), toxicity.Settings(**settings))


def odds(model, text):
    return model.value(toxicity.text_words(text), toxicity.Recent(model.features_of))


def test_counterfactual_penalty_spares_neutral_mentions(spark):
    rows = corpus(random.Random(1))
    plain, fair = fitted(spark, rows, counterfactual=0.0), fitted(spark, rows, counterfactual=20.0)
    neutral, other = "the muslim reads a paper", "the christian reads a paper"
    assert odds(plain, neutral) - odds(plain, other) > 1.5
    assert abs(odds(fair, neutral) - odds(fair, other)) < 0.3
    assert odds(fair, neutral) < odds(plain, neutral)
    # unseen words that begin like toxic ones count as well
    assert odds(fair, "the grumblax walks") > odds(fair, "the tree walks") + 1


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("sf0.001", "sf0.1")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op4_toxicity(spark, sf).collect()
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    found = sum(p and y for p, y in held)
    assert found >= 0.85 * sum(y for _, y in held)
    assert found >= 0.94 * sum(p for p, _ in held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


def test_labels_of_held_out_rows_do_not_matter(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("toxic", F.when(toxicity.fold() == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (toxicity.fit(docs, x, toxicity.fold() != 1, toxicity.Settings(support=2, gain=2.0)) for x in (labels, flipped))
    assert one == two and one.weights


def test_gradient_settles():
    w, b = toxicity._descend(Counter({((0,), 1.0): 2, ((1,), 0.0): 2}), Counter(), 2, toxicity.Settings(sparsity=0.0))
    assert w[0] + b > 2 > -2 > w[1] + b
    with pytest.warns(UserWarning, match="did not settle"):
        toxicity._descend(Counter({((0,), 1.0): 2, ((1,), 0.0): 2}), Counter(), 2, toxicity.Settings(sparsity=0.0, rounds=3))


def test_descent_reaches_the_least_of_the_penalised_loss():
    """Plain numeric descent on the whole objective, from its definition."""
    dice = np.random.default_rng(3)
    x, y = dice.random((60, 5)) < 0.4, (dice.random(60) < 0.4).astype(float)
    a, b = dice.random((8, 5)) < 0.3, dice.random((8, 5)) < 0.3
    settings = toxicity.Settings(counterfactual=0.7, sparsity=0.0, ridge=0.05)
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))

    def loss(w):
        z = x @ w[:5] + w[5]
        return (balance * (np.logaddexp(0, z) - y * z)).mean() + 0.7 * (((a.astype(float) - b) @ w[:5]) ** 2).mean() + 0.025 * (w[:5] @ w[:5])

    def rows(m):
        return [tuple(np.flatnonzero(r).tolist()) for r in m]

    got = np.append(*toxicity._descend(Counter(zip(rows(x), y.tolist())), Counter(zip(rows(a & ~b), rows(b & ~a))), 5, settings))
    for k in range(6):
        for step in (-1e-3, 1e-3):
            assert loss(got) <= loss(got + step * np.eye(6)[k]) + 1e-9


def test_fit_of_the_query_settles_and_weighs_twins(spark, sf, monkeypatch):
    """On the given tables: pairs reach the fit, more rounds change nothing, and a neutral mention scores as its twin does."""
    sf = sf.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels, toxicity.fold() != 1)
    more = toxicity.fit(docs, labels, toxicity.fold() != 1, toxicity.Settings(rounds=500_000, settled=1e-9))
    assert model.pairs > 20 and model.weights.keys() == more.weights.keys()
    assert max(abs(model.weights[f] - more.weights[f]) for f in model.weights) < 0.01
    known = {f for g in toxicity.IDENTITY_GROUPS for w in g for f in toxicity.word_features(w)}
    assert known & model.weights.keys()
    made = toxicity.Recent(model.features_of)
    pairs = [p for r in docs.collect() for p in toxicity.twins(r.text, toxicity.swaps())]
    apart = [abs(1 / (1 + np.exp(-model.value(toxicity.text_words(a), made))) - 1 / (1 + np.exp(-model.value(toxicity.text_words(b), made)))) for a, b in pairs]
    assert len(pairs) > 100 and max(apart) < 0.05


def test_sentences_are_swapped_in_place():
    into = toxicity.swaps((("he", "she"), ("muslim", "jewish", "hindu")))
    assert toxicity.swapped("He saw SHE and a Muslim, not the theme; hindu?", into) == "She saw HE and a Jewish, not the theme; muslim?"
    text = "He walks. No group here! SHE\nand he; x"
    assert list(toxicity.twins(text, into)) == [("He walks", "She walks"), (" SHE", " HE"), ("and he; x", "and she; x")]
    assert list(toxicity.twins(None, into)) == [] == list(toxicity.twins(" \n.", into))


def test_labelled_texts_have_twins(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    ids = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.doc_id in ids]
    pairs = [p for t in texts for p in toxicity.twins(t, toxicity.swaps())]
    assert len(pairs) > 50 and all(len(toxicity._words(a)) == len(toxicity._words(b)) for a, b in pairs)


def test_feature_counts_against_plain_ones(spark, sf):
    rows = [(r.text, r.doc_id % 2) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()] + [(None, 1), ("", 0)]
    want = Counter((f, y) for t, y in rows for f in {f for w in toxicity.text_words(t) for f in toxicity.word_features(w)})
    got = toxicity.feature_counts(spark.createDataFrame(rows, "text string, y int")).collect()
    assert {(r.feature, y): n for r in got for y, n in ((1, r.pos), (0, r.neg)) if n} == dict(want)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 5.0), (2, "", 5.0), (None, "vilefool", 5.0), (3, "x " * 300_000, 5.0), (3, "y", 5.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None), (None, 1), (3, 0), (3, 0)], "doc_id long, toxic int")
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 5
    assert toxicity.drop_toxic(docs.limit(0), labels.limit(0)).count() == 0
    model = toxicity.Model({"vilefool": 9.0}, -4.0)
    got = toxicity.score(docs, model).select("row.doc_id", "score").collect()
    assert [r.doc_id for r in got if r.score >= 0.7] == [None]
