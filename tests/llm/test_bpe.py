import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from harvestry.llm import bpe, queries, tokencount
from harvestry.llm.bytelevel import Recent, Vocabulary, chunks

PATH = queries.vocabulary_path()
PIECES = [*"ab cdehst  \n\n\t\r\x0b\x0c\x1c\x85\xa0　'’sStTrev0123٣\xb2Ⅷ一é中\U0001f389_-.,!?<|>", "'s", "'ll", "<|endoftext|>", "the", " and", "  ", "   x", "aaaa", "᠎", "​"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def source():
    with open(PATH, encoding="utf-8") as f:
        return f.read()


@pytest.fixture(scope="module")
def texts():
    dice = random.Random(5)
    made = ["".join(dice.choices(PIECES, k=dice.randrange(60))) for _ in range(4000)]
    return [*made, "", "a" * 5000, " " * 3000 + "x", "ab" * 3000, "\xe9" * 1000, "word, " * 3000]


def test_encoder_equals_library(library, source, texts):
    own = bpe.Encoder(source)
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want.ids
        assert own.decode(ids) == library.decode(want.ids, skip_special_tokens=False)


def test_counter_equals_library(library, source, texts):
    want = [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]
    own = tokencount.Counter(source)
    assert own.count(texts) == want
    assert own.count(texts[:50]) == want[:50]
    assert own.count([]) == []


def test_every_path_is_what_merging_gives(source):
    """Arcs between random tokens against plain merging of their bytes."""
    vocabulary = Vocabulary(source)
    own = bpe.Automaton(vocabulary)
    ranks = {(u, v): (k, w) for k, (u, v, w) in enumerate(vocabulary.merges)}

    def merged(word):
        ids = [vocabulary.ids[bytes([b])] for b in word]
        while True:
            best = min((ranks.get(p, (1e9, 0)) + (k,) for k, p in enumerate(zip(ids, ids[1:]))), default=(1e9,))
            if best[0] == 1e9:
                return ids
            ids[best[2] : best[2] + 2] = [best[1]]

    dice = random.Random(2)
    tokens = [t for t in vocabulary.ids.values() if len(vocabulary.labels[t]) < 9]
    for _ in range(3000):
        a, b = dice.choice(tokens), dice.choice(tokens)
        assert own.arc(a, b) == (merged(vocabulary.labels[a] + vocabulary.labels[b]) == [a, b])


def test_words_that_begin_alike_are_read_on_from_there(source):
    own, read = bpe.Automaton(Vocabulary(source)), []

    class Steps(dict):
        def get(self, key):
            read.append(key & 255)
            return dict.get(self, key)

    words = [b" qzjkwxv" + end for end in (b"ab", b"tionment", b"", "\xe9\xe8".encode(), b"tio")]
    want = [own.encode(w) for w in words]
    own.step = Steps(own.step)
    assert [own.encode(w) for w in words] == want
    assert [b"".join(own.labels[t] for t in ids) for ids in want] == words
    at_most = sum(len(w) - 6 for w in words)
    assert len(bytes(b for b, before in zip(read, [None, *read]) if b != before)) <= at_most


def test_windows_of_a_long_text(library, source):
    text = "some words  and\nlines, " * 100_000
    assert sum(1 for _ in chunks(text)) > 1
    want = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(bpe.Encoder(source).encode(text), "<u4").tolist() == want
    assert tokencount.Counter(source).count([text]) == [len(want)]


def test_recent_keeps_two_rounds():
    made = []
    words = Recent(lambda w: made.append(w) or len(w), 2)
    assert [words[w] for w in ("a", "bb", "ccc", "a", "bb")] == [1, 2, 3, 1, 2]
    assert made == ["a", "bb", "ccc"]


def test_jobs(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(None, None, 1), (900, "", 2), (900, "", 2), (901, "<|endoftext|>hi  there", 3)], "doc_id long, text string, ids int")
    docs = docs.unionByName(odd, allowMissingColumns=True)
    texts = sorted((r.doc_id or -1, r.text or "") for r in docs.collect())
    want = sorted((i, library.encode(t, add_special_tokens=False).ids) for i, t in texts)
    encoded = bpe.encode(docs, PATH)
    assert sorted((r.id or -1, np.frombuffer(r.ids, "<u4").tolist()) for r in encoded.collect()) == want
    assert sorted((r.id or -1, r.text) for r in bpe.decode(encoded, PATH).collect()) == texts
    counted = sorted((r.id or -1, r.n_bytes, r.n_tokens) for r in tokencount.count_tokens(docs, PATH).collect())
    assert counted == sorted((i, len(t.encode()), len(ids)) for (i, t), (_, ids) in zip(texts, want))
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0


def test_query_digests(spark, sf, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op7_bpe_encoding_and_decoding(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_token_count_query(spark, sf, library):
    at = sf.replace("sf0.001", "sf0.01")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{at}/documents.parquet").collect()}
    got = queries.op8_token_counts(spark, at).collect()
    counts = {i: len(x.ids) for i, x in zip(texts, library.encode_batch(list(texts.values()), add_special_tokens=False))}
    assert {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got} == {(i, len(t.encode()), counts[i], counts[i] > 1024) for i, t in texts.items()}
    assert len(got) == len(texts) and {r.over_limit for r in got} == {True, False}
