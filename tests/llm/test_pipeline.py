import re

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from harvestry.llm import linedup, tiling, toxicity
from harvestry.llm.queries import vocabulary_path
from harvestry.sources.shared import materialize


def shingle_set(text, width=5):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))}


def test_stages_one_by_one(spark, sf):
    """Each stage against a plain reading of what it may keep, on its own input."""
    sf = sf.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = materialize(stage(spark, docs, sf), "stage")
        assert after.columns == names and after.dtypes == docs.dtypes
        seen.append((name, {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in after.collect()}))
        assert seen[-1][2].keys() <= seen[-1][1].keys()
        docs = after
    (_, a, b), (_, _, c), (_, _, d), (_, _, e) = seen
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    gone = a.keys() - b.keys()
    assert gone and sum(labels.get(i, 0) for i in gone) >= 0.9 * sum(i in labels for i in gone)
    lines = {}
    for r in b.values():
        for line in r.text.split("\n"):
            if key := line.strip(" \t\r"):
                sites, texts = lines.setdefault(key, (set(), set()))
                sites.add(r.source)
                texts.add(r.text)
    bad = {key for key, (sites, texts) in lines.items() if min(len(sites), len(texts)) >= linedup.MIN_SITES}
    for i, r in b.items():
        assert c[i].text == "\n".join(p for p in r.text.split("\n") if p.strip(" \t\r") not in bad) and c[i].n_chars == len(c[i].text)
    sets = {i: shingle_set(r.text) for i, r in c.items()}
    first = {}
    for i in sorted(c):
        first.setdefault(c[i].text, i)
    assert d.keys() <= set(first.values())  # of equal texts one at most
    kept = list(d)
    by_shingle = {}
    for i in kept:
        for s in sets[i]:
            by_shingle.setdefault(s, []).append(i)

    def alike(i, others):
        return any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in others if j != i)

    dropped = c.keys() - d.keys()
    assert all(c[i].text in {c[j].text for j in kept} or alike(i, sets) for i in dropped)
    # no near copy of a text that stayed is left: looked up by all shingles of the whole sets
    left = [(i, j) for i in kept for j in {j for s in sets[i] for j in by_shingle[s]} if j > i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert not [(i, j) for i, j in left if any(sets[i])]
    items = [tiling.words_of(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for i, r in d.items():
        runs = shingle_set(" ".join(tiling.words_of(r.text)))
        leak = any(sum(tuple(x[k : k + 5]) in runs for k in range(len(x) - 4)) >= 0.9 * (len(x) - 4) for x in items)
        assert not leak or i not in e
        share = max(sum(tuple(x[k : k + 5]) in runs for k in range(len(x) - 4)) / len(x) for x in items)
        assert i in e or share > 0.16
    assert len(d) > len(e)


def test_run(spark, sf):
    library = Tokenizer.from_file(vocabulary_path())
    got = corpus_pipeline.run(spark, sf).collect()
    assert 0 < len(got) < 200 and len({r.doc_id for r in got}) == len(got)
    for r in got:
        ids = library.encode(r.text, add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)


def test_odd_rows(spark, sf, tmp_path):
    rows = [(None, None, "en", None, 0), (1, "", "en", "s1", 0), (1, "", "en", "s1", 0), (2, "word " * 50_000, None, "s2", 5)]
    clash = "row int, score double, clean string, k long, key long, n int, least long, r string, gone string"
    odd = spark.createDataFrame([(*r, 1, 0.5, "c", 2, 3, 4, 5, "r", "g") for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {clash}")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    for docs, n in ((odd, 2), (odd.limit(0), 0)):
        names = docs.columns
        for at, (_, stage) in enumerate(corpus_pipeline.STAGES, 1):
            docs = materialize(stage(spark, docs, str(tmp_path)), "stage")
            assert at == len(corpus_pipeline.STAGES) or docs.columns == names
        assert docs.count() == n
