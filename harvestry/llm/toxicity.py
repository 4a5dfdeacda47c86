"""Toxicity by a counterfactual-regularised classifier.

A sparse logistic model over the words of a text and their prefixes. For every sentence of a labelled text that names
an identity group, a twin with the identity terms swapped in their places is made, and differences between the scores
of the two are penalised, so that a group's mention alone does not make a text toxic.
"""

from __future__ import annotations

import re
import warnings
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestry.llm.bytelevel import FEW, Recent
from harvestry.sources.shared import materialize

#: Terms that can stand for each other without making a sentence more or less toxic. A swap takes the next of a group.
IDENTITY_GROUPS = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"),
    ("man", "woman"),
    ("men", "women"),
    ("male", "female"),
    ("boy", "girl"),
    ("he", "she"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("mexican", "chinese", "french", "german", "indian", "russian", "american", "turkish"),
    ("immigrant", "refugee", "foreigner", "native", "local"),
    ("immigrants", "refugees", "foreigners", "natives", "locals"),
    ("blind", "deaf", "disabled", "autistic"),
    ("old", "young"),
)
PREFIXES = (4, 5, 6)
#: Labels up to which they are sent to the texts (some 75 MB); more of them meet the texts in a shuffle.
SENT_LABELS = 2_000_000
THRESHOLD = 0.7

_words, _word = re.compile(r"\w+").findall, re.compile(r"\w+")
_ends = re.compile(r"[.!?\u2026\n\r]+")


@dataclass(frozen=True)
class Settings:
    """``sample``: labelled rows that the weights are fitted on, at most; ``features``: weights, at most.

    Feature statistics are counted over all labelled rows; ``support`` is the least number of labelled texts that a
    feature must occur in, and ``gain`` the least likelihood ratio by which it tells the classes apart.
    ``counterfactual``, ``sparsity`` and ``ridge`` weigh the penalties. The fit ends when no slope is over ``settled``, or with a warning after ``rounds``.
    """

    sample: int = 20_000
    features: int = 4_000
    support: int = 8
    gain: float = 6.0
    counterfactual: float = 1.0
    sparsity: float = 1e-4
    ridge: float = 3e-4
    rounds: int = 50_000
    settled: float = 1e-7
    groups: tuple = IDENTITY_GROUPS


def word_features(word: str) -> list[str]:
    """A word, and its proper prefixes marked by a star."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def text_words(text: str | None) -> set[str]:
    """The distinct lower-case words of a text."""
    return set(_words((text or "").lower()))


def sentences(text: str | None) -> list[str]:
    """The sentences of a text; line ends end them too."""
    return [x for x in _ends.split(text or "") if x.strip()]


def swaps(groups: tuple = IDENTITY_GROUPS) -> dict[str, str]:
    """Each identity term, and the next one of its group."""
    return {g[k]: g[(k + 1) % len(g)] for g in groups for k in range(len(g))}


def swapped(sentence: str, into: dict[str, str]) -> str:
    """The sentence with every identity term exchanged where it stands, all at once; capitals stay as they were."""

    def other(m: re.Match) -> str:
        new = into.get(m[0].lower())
        if new is None:
            return m[0]
        return new.upper() if len(m[0]) > 1 and m[0].isupper() else new.capitalize() if m[0][0].isupper() else new

    return _word.sub(other, sentence)


def twins(text: str | None, into: dict[str, str]) -> Iterator[tuple[str, str]]:
    """The sentences of a text that name an identity group, each with its twin."""
    for sentence in sentences(text):
        if (other := swapped(sentence, into)) != sentence:
            yield sentence, other


def labelled(docs: DataFrame, labels: DataFrame, rows: Column, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """``(id, text, y)`` of the rows in ``rows`` that have a label; of several labels of an id the largest."""
    known = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    texts = docs.filter(rows).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    known = materialize(known, "labels")
    return texts.join(F.broadcast(known) if known.count() <= SENT_LABELS else known, "id")


def feature_counts(train: DataFrame) -> DataFrame:
    """``(feature, pos, neg)``: labelled texts of each class with the feature, over all rows; features of any class 1 text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Recent(word_features, FEW)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                counts = {0: Counter(), 1: Counter()}
                for text, y in zip(part.column(0), part.column(1)):
                    counts[int(y.as_py() > 0)].update({f for w in text_words(text.as_py()) for f in made[w]})
                for y in (0, 1):
                    names = list(counts[y])
                    n = pa.array([counts[y][f] for f in names], pa.int64())
                    zero = pa.array([0] * len(names), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *((n, zero) if y else (zero, n))], names=["feature", "pos", "neg"])

    return train.select("text", "y").mapInArrow(run, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def select_features(counts: DataFrame, n_pos: int, n_neg: int, settings: Settings) -> list[str]:
    """The features that tell the classes apart best, by the likelihood ratio statistic, at most ``settings.features``; and those of identity terms.

    The features of identity terms are some hundred, and stay whatever they tell: else a swap would change nothing that the model sees.
    """
    p, n = F.col("pos").cast("double"), F.col("neg").cast("double")
    total, share = n_pos + n_neg, (F.col("pos") + F.col("neg")).cast("double") / (n_pos + n_neg)

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    gain = part(p, share * n_pos) + part(n, share * n_neg) + part(n_pos - p, (1 - share) * n_pos) + part(n_neg - n, (1 - share) * n_neg)
    best = counts.filter((p + n >= settings.support) & (p + n < total)).select("feature", gain.alias("gain")).filter(F.col("gain") > settings.gain)
    named = sorted({f for g in settings.groups for w in g for f in word_features(w)})
    named = counts.filter(F.col("feature").isin(named)).select("feature").collect() if named else []
    return sorted({r.feature for r in [*best.orderBy(F.desc("gain"), "feature").limit(settings.features).collect(), *named]})


@dataclass(frozen=True)
class Model:
    """Weights by feature, and the bias. The sizes are bounded by ``Settings.features``. ``pairs``: unlike sentences and twins that the fit has weighed."""

    weights: dict
    bias: float
    pairs: int = 0

    def value(self, words: set[str], made: Recent) -> float:
        """The log-odds of a set of words: each weighted feature counts once."""
        found = set().union(*map(made.__getitem__, words)) if words else ()
        return self.bias + sum(self.weights[f] for f in sorted(found))

    def features_of(self, word: str) -> tuple:
        return tuple(f for f in word_features(word) if f in self.weights)


def fit(docs: DataFrame, labels: DataFrame, rows: Column, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from the labelled rows of ``docs`` that satisfy ``rows``.

    Statistics that select features cover all of those rows. The weights are fitted on the ``settings.sample`` rows
    with the least id hash, of those the least text hash and label, of which only the selected features reach the
    driver. Without rows of both classes the model has no weights and the odds of the classes as its bias.
    """
    train = materialize(labelled(docs, labels, rows, id_col, text_col, label_col), "labelled")
    sizes = train.agg(F.count_if(F.col("y") > 0).alias("p"), F.count_if(F.col("y") <= 0).alias("n")).first()
    prior = Model({}, float(np.log((sizes.p + 0.5) / (sizes.n + 0.5))))
    if not sizes.p or not sizes.n:
        return prior
    names = select_features(feature_counts(train), sizes.p, sizes.n, settings)
    if not names:
        return prior
    index = {f: k for k, f in enumerate(names)}
    into = swaps(settings.groups)
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32())), pa.list_(pa.list_(pa.int32()))]

    def told(made: Recent, text: str | None) -> tuple:
        def features(part: str | None) -> set[int]:
            return {k for w in text_words(part) for k in made[w]}

        pairs = {(tuple(sorted(x - y)), tuple(sorted(y - x))) for x, y in ((features(a), features(b)) for a, b in twins(text, into))}
        pairs = sorted(pairs - {((), ())})
        return sorted(features(text)), [x for x, _ in pairs], [y for _, y in pairs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Recent(lambda w: tuple(index[f] for f in word_features(w) if f in index), FEW)
        for batch in batches:
            rows = [(h.as_py(), k.as_py(), y.as_py(), *told(made, t.as_py())) for h, k, y, t in zip(*batch.columns)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=["h", "k", "y", "own", "lost", "won"])

    place = F.xxhash64("id")
    bound = train.select(place.alias("h")).orderBy("h").limit(settings.sample).agg(F.max("h")).first()[0]
    sample = train.filter(place <= bound).select(place.alias("h"), F.xxhash64("text").alias("k"), "y", "text")
    sample = sample.mapInArrow(run, "h long, k long, y int, own array<int>, lost array<array<int>>, won array<array<int>>")
    table = sample.orderBy("h", "k", "y").limit(settings.sample).toArrow()
    # texts with the same features are one row with a weight, and so are pairs
    texts = Counter((tuple(x), float(y > 0)) for x, y in zip(table.column("own").to_pylist(), table.column("y").to_pylist()))
    pairs = Counter((tuple(x), tuple(y)) for a, b in zip(table.column("lost").to_pylist(), table.column("won").to_pylist()) for x, y in zip(a, b))
    weights, bias = _descend(texts, pairs, len(names), settings)
    # a sparse fit chooses the features, and a second one without the pull towards zero weighs them; identity terms stay
    always = {f for g in settings.groups for w in g for f in word_features(w)}
    chosen = [k for k, f in enumerate(names) if abs(weights[k]) > 1e-3 or f in always]
    place = {k: n for n, k in enumerate(chosen)}

    def left(features: tuple) -> tuple:
        return tuple(place[k] for k in features if k in place)

    fewer, twin = Counter(), Counter()
    for (x, y), n in texts.items():
        fewer[left(x), y] += n
    for (x, y), n in pairs.items():
        twin[left(x), left(y)] += n
    names = [names[k] for k in chosen]
    weights, bias = _descend(fewer, twin, len(names), replace(settings, sparsity=0.0))
    return Model({f: float(w) for f, w in zip(names, weights) if w}, float(bias), sum(pairs.values()))


def _ragged(lists: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """The entries of all rows end to end, and the row of each."""
    return np.array([k for x in lists for k in x], np.int64), np.repeat(np.arange(len(lists)), [len(x) for x in lists])


def _descend(texts: Counter, pairs: Counter, size: int, settings: Settings) -> tuple[np.ndarray, float]:
    """Accelerated proximal descent on log loss + ridge + counterfactual penalty, with soft thresholds for sparsity.

    ``texts`` counts ``(features, y)``; classes weigh the same. The counterfactual penalty is the mean squared difference of the log-odds of a sentence and
    its twin, over the ``pairs`` in which they differ: in the features ``(lost, won)`` by the swap. The step is bounded by the curvature of what
    there is, so that the descent ends at the least, by its slopes, and says so if it has not.
    """
    own, y = _ragged([x for x, _ in texts]), np.array([y for _, y in texts])
    times, often = np.array(list(texts.values()), float), np.array(list(pairs.values()), float)
    lost, won = (_ragged([pair[k] for pair in pairs]) for k in (0, 1))
    n, m, share = len(texts), len(pairs), (times * y).sum() / times.sum()
    balance = times / times.sum() * np.where(y > 0, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
    often *= 2 * settings.counterfactual / max(often.sum(), 1)

    def score(at: tuple, w: np.ndarray, rows: int) -> np.ndarray:
        return np.bincount(at[1], w[at[0]], minlength=rows)

    def back(at: tuple, r: np.ndarray) -> np.ndarray:
        return np.bincount(at[0], r[at[1]], minlength=size)

    # the mean of the squared lengths of rows bounds the curvature
    held = np.bincount(own[1], minlength=n) + 1
    swapped_ = np.bincount(lost[1], minlength=m) + np.bincount(won[1], minlength=m)
    rate = 1 / (0.25 * (balance * held).sum() + (often * swapped_).sum() + settings.ridge)
    w = v = np.zeros(size)
    b = c = 0.0
    t = 1.0
    for _ in range(settings.rounds):
        r = balance * (1 / (1 + np.exp(-(score(own, v, n) + c))) - y)
        gap = often * (score(lost, v, m) - score(won, v, m))
        step = v - rate * (back(own, r) + settings.ridge * v + back(lost, gap) - back(won, gap))
        new, bias = np.sign(step) * np.maximum(abs(step) - rate * settings.sparsity, 0), c - rate * r.sum()
        if max(abs(v - new).max(initial=0), abs(c - bias)) <= settings.settled * rate:
            return new, bias
        if (v - new) @ (new - w) + (c - bias) * (bias - b) > 0:
            t = 1.0  # the momentum leads uphill
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / after * (new - w), bias + (t - 1) / after * (bias - b)
        w, b, t = new, bias, after
    warnings.warn(f"the fit did not settle in {settings.rounds} rounds", stacklevel=2)
    return w, b


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` in a struct ``row``, and ``score``: the probability that the whole text is toxic.

    Null and empty texts get the score of the bias alone; equal texts get equal scores. Rows keep their number.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most Settings.features weights

    @F.pandas_udf("double")
    def probability(texts):
        own = shared.value
        made = Recent(own.features_of, FEW)
        odds = np.array([own.value(text_words(t), made) for t in texts], float)
        return texts.__class__(1 / (1 + np.exp(-odds)), dtype="float64")

    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), probability(F.col(text_col).cast("string")).alias("score"))


def fold(id_col: str = "doc_id") -> Column:
    """The remainder of the id's CRC-32, as text, by 3; rows with remainder 1 are held out of learning."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(3))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, unchanged; a model is learnt from their labels first."""
    model = fit(docs, labels, fold() != 1, settings)
    return score(docs, model).filter(F.col("score") < threshold).select("row.*")
