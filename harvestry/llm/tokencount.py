"""Token counts by rank-synchronous merging of ragged arrays.

The pre-tokens of a batch lie end to end in one array of symbols. In every round each sequence finds its
lowest-ranked pair and applies it at all places at once; sequences without a pair leave the batch with the
number of symbols that survived.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestry.llm.bytelevel import LONGEST, Recent, Vocabulary, chunks, pretokens, read_source

NEVER = np.int32(2**31 - 1)
#: Code points of the texts, and bytes of the new words, that are held as arrays at a time.
BATCH, MERGED = 2 << 20, 1 << 20


class Merges:
    """The merge table of a vocabulary, as arrays."""

    def __init__(self, vocabulary: Vocabulary):
        self.size = len(vocabulary.labels)
        self.byte = np.array([vocabulary.ids[bytes([b])] for b in range(256)], np.int32)
        table = np.array(vocabulary.merges, np.int64).reshape(-1, 3)
        keys, first = np.unique(table[:, 0] * self.size + table[:, 1], return_index=True)
        self.keys, self.ranks, self.results = np.append(keys, np.int64(2**62)), np.append(first, NEVER).astype(np.int32), table[:, 2].astype(np.int32)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        wanted = a.astype(np.int64) * self.size + b
        at = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[at] == wanted, self.ranks[at], NEVER)

    def surviving(self, words: list[bytes]) -> np.ndarray:
        """The number of symbols that each word is merged to."""
        counts = np.zeros(len(words), np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        own = np.flatnonzero(lengths)
        lengths = lengths[own]
        symbols = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        if not len(symbols):
            return counts
        ranks = np.full(len(symbols), NEVER, np.int32)  # of a symbol and the next one of its sequence
        ranks[:-1] = self.rank(symbols[:-1], symbols[1:])
        ranks[np.cumsum(lengths) - 1] = NEVER
        while len(own):
            starts = np.cumsum(lengths) - lengths
            best = np.minimum.reduceat(ranks, starts)
            open_ = best < NEVER
            counts[own[~open_]] = lengths[~open_]
            if not open_.all():
                kept = np.repeat(open_, lengths)
                symbols, ranks, own, lengths, best = symbols[kept], ranks[kept], own[open_], lengths[open_], best[open_]
                if not len(own):
                    break
            hit = ranks == np.repeat(best, lengths)
            # of overlapping hits every other one acts, from the left
            places = np.flatnonzero(hit)
            fresh = np.flatnonzero(np.diff(places, prepend=-2) > 1)
            places = places[(np.arange(len(places)) - np.repeat(fresh, np.diff(fresh, append=len(places)))) % 2 == 0]
            sequence = np.repeat(np.arange(len(own)), lengths)
            symbols[places] = self.results[ranks[places]]
            last = ranks[places + 1]  # NEVER where the merged pair ends its sequence, as is every last one
            ends = np.cumsum(lengths) - 1
            at_end = ends[sequence[places]] == places + 1
            kept = np.ones(len(symbols), bool)
            kept[places + 1] = False
            moved = np.cumsum(kept) - 1
            lengths = lengths - np.bincount(sequence[places], minlength=len(own))
            ranks[places] = np.where(at_end, NEVER, last)
            symbols, ranks, spots = symbols[kept], ranks[kept], moved[places]
            ends, starts = np.cumsum(lengths) - 1, np.cumsum(lengths) - lengths
            sequence = sequence[kept]
            before = spots[spots > starts[sequence[spots]]] - 1
            after = spots[spots < ends[sequence[spots]]]
            for part in (before, after):
                ranks[part] = self.rank(symbols[part], symbols[part + 1])
        return counts


class Counter:
    """Counts tokens of whole texts; holds the merge table of a task and the words that it has met."""

    def __init__(self, source: str):
        self.vocabulary = Vocabulary(source)
        self.merges = Merges(self.vocabulary)
        self.words = Recent()

    def _counted(self, wanted: list[str]) -> np.ndarray:
        """The tokens of each chunk, blanks included, by arrays of a bounded number of bytes."""
        totals = np.zeros(len(wanted), np.int64)
        words, owners, size = [], [], 0
        for k, chunk in enumerate(wanted):
            for word in [chunk] if chunk[1:].isalpha() and chunk[0] == " " else pretokens(chunk):
                words.append(word.encode())
                owners.append(k)
                size += len(words[-1])
            if size >= MERGED or k == len(wanted) - 1:
                np.add.at(totals, np.array(owners, np.int64), self.merges.surviving(words))
                words, owners, size = [], [], 0
        return totals

    def count(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text; a special string in it is one token."""
        totals, firsts, owners, rest = [0] * len(texts), [], [], []
        for k, text in enumerate(texts):
            for part, special in self.vocabulary.parts(text):
                if special is not None:
                    totals[k] += 1
                    continue
                for n, cut in enumerate(chunks(part)):
                    if not n:
                        firsts.append(cut[0])
                        owners.append(k)
                    rest.append((k, cut[1:] if not n else cut))
        for k, n in zip(owners, self._counted(firsts).tolist()):
            totals[k] += n
        known, table, new = self.words, {}, []
        for word in {w for _, cut in rest for w in cut}:
            n = known.get(word) or known.old.get(word)
            if n is None:
                new.append(word)
            else:
                table[word] = n
        table |= zip(new, self._counted([" " + w for w in new]).tolist())
        for word, n in table.items():
            if word not in known and len(word) <= LONGEST:
                known.put(word, n)
        for k, cut in rest:
            totals[k] += sum(map(table.__getitem__, cut))
        return totals


_counters: dict[int, Counter] = {}


def counter(source: str) -> Counter:
    """The counter of a worker process, built once."""
    if hash(source) not in _counters:
        _counters.clear()
        _counters[hash(source)] = Counter(source)
    return _counters[hash(source)]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, n_tokens)`` for every row: UTF-8 bytes and tokens of the whole text.

    Null and empty texts have 0 of both. Repeated rows and null ids keep their rows; other columns are not read.
    ``path`` names the vocabulary file on the driver.
    """
    source = docs.sparkSession.sparkContext.broadcast(read_source(docs.sparkSession, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(source.value)
        for batch in batches:
            out, held, size = [], [], 0
            for text in batch.column(2):
                held.append(text.as_py())
                size += len(held[-1])
                if size >= BATCH:
                    out += own.count(held)
                    held, size = [], 0
            out += own.count(held)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(run, "id long, n_bytes long, n_tokens long")
