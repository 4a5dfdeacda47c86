"""BPE encoding and decoding with a tokenization automaton.

The merges are compiled in order, one gadget each, into a deterministic automaton whose states are the last token read
and whose arcs are labelled by tokens. Merge ``m = (u, v) -> w`` takes the arc ``v`` away from state ``u``, and adds an arc ``w``
that enters wherever ``u`` does and leaves wherever ``v`` does. Of any text exactly one path remains, the one that merging
would give. The table is sparse: a state's row holds the arcs that were taken away, and as all labels that began with
``v`` before ``m`` acted on them stand side by side in one order of the labels, a gadget takes away one interval of it.
Encoding reads a word byte by byte, and finds the one arc that ends at each place: of the labels that end there (a second table
steps from byte to byte to the longest of them, and on to shorter ones) the one for which the state at its start has an
arc. Words that begin alike are read on from the end of their common beginning. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestry.llm.bytelevel import FEW, Recent, Vocabulary, chunks, pretokens, read_source

#: Bytes of text that one batch of results covers.
FLUSH = 4 << 20
#: Bytes of the beginnings of words whose states are remembered.
HEAD = 6


class Automaton:
    """The compiled merges of a vocabulary.

    ``place`` is where a label stands in the order of labels, and ``table`` from ``start[s]`` to ``start[s + 1]`` the bounds of the
    intervals of labels for which state ``s`` has no arc.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.labels = vocabulary.labels
        n = len(self.labels)
        merged, children, rank = set(), [[] for _ in range(n)], [0] * n
        for at, (u, _, w) in enumerate(vocabulary.merges):
            if w not in merged:
                merged.add(w)
                rank[w] = at
                children[u].append(w)
        self.place, last = self._order(children, merged)
        # tokens that their own bytes are merged to
        self.alone = bytearray(n)
        for b in range(256):
            self.alone[vocabulary.ids[bytes([b])]] = 1
        rows = [array("i") for _ in range(n)]
        for at, (u, v, w) in enumerate(vocabulary.merges):
            if rank[w] == at:
                self._add_gadget(rows, children[v], rank, last, at, u, v, w)
        # lists are looked up faster than arrays; equal numbers are one object, so that they take little more room
        numbers = list(range(n + 1))
        self.table, self.start, self.place = [], [0], list(self.place)
        for row in rows:
            self.table.extend(map(numbers.__getitem__, row))
            self.start.append(len(self.table))
        self.whole = {word: t for word, t in vocabulary.ids.items() if self.alone[t]}
        self._add_steps()

    @staticmethod
    def _order(children: list[list[int]], merged: set[int]) -> tuple[array, array]:
        """The labels in an order in which all that start with a label follow it, by the time of their merge; and where each of these stretches ends."""
        place, last, k = array("i", [0]) * len(children), array("i", [0]) * len(children), 0
        for root in range(len(children)):
            open_ = [] if root in merged else [(root, 0)]
            while open_:
                t, at = open_.pop()
                if not at:
                    place[t] = k
                    k += 1
                if at < len(children[t]):
                    open_ += [(t, at + 1), (children[t][at], 0)]
                else:
                    last[t] = k
        return place, last

    def _add_gadget(self, rows: list[array], begun: list[int], rank: list[int], last: array, at: int, u: int, v: int, w: int) -> None:
        """Merge ``at``: state ``w`` leaves as ``v`` does, and ``u`` loses its arcs for ``v`` and for what will be made from a ``v`` in front later.

        An arc ``w`` enters wherever ``u`` does, as ``w`` stands in the stretch of ``u``. Of equal merges the leftmost acts first, so that what merge ``at``
        itself makes of a ``v`` in front is among what is lost.
        """
        self.alone[w] = self.alone[u] and self.alone[v] and not bisect_right(rows[u], self.place[v]) % 2
        rows[w] = rows[v][:]
        self._take(rows[u], self.place[v], self.place[v] + 1)
        later = bisect_left(begun, at, key=rank.__getitem__)
        if later < len(begun):
            self._take(rows[u], self.place[begun[later]], last[v])

    @staticmethod
    def _take(row: array, low: int, high: int) -> None:
        """Add the interval from ``low`` to before ``high`` to a row; what touches becomes one."""
        i, j = bisect_left(row, low), bisect_right(row, high)
        row[i:j] = array("i", [low] * (i % 2 == 0) + [high] * (j % 2 == 0))

    def _add_steps(self) -> None:
        """``step`` leads from the longest beginning of a label that ends at a place, and a byte, to the next one's.

        ``back`` is the next shorter beginning that ends there too, ``ends`` the longest label that does, and ``shorter`` the one
        after that, as nodes; ``label`` and ``size`` are the label of a node and its length.
        """
        self.step: dict[int, int] = {}
        self.label, levels = [-1], [[]]
        for word, t in self.whole.items():
            node = 0
            for depth, b in enumerate(word, 1):
                key = node << 8 | b
                if (at := self.step.get(key)) is None:
                    at = self.step[key] = len(self.label)
                    self.label.append(-1)
                    if depth == len(levels):
                        levels.append([])
                    levels[depth].append((at, key))
                node = at
            self.label[node] = t
        n = len(self.label)
        self.back, self.ends, self.shorter = [0] * n, [0] * n, [0] * n
        for level in levels[1:]:
            for node, key in level:
                parent, b = key >> 8, key & 255
                if parent:
                    up = self.back[parent]
                    while (at := self.step.get(up << 8 | b)) is None:
                        up = self.back[up]
                    self.back[node] = at
                self.shorter[node] = self.ends[self.back[node]]
                self.ends[node] = node if self.label[node] >= 0 else self.shorter[node]
        self.size = [len(self.labels[t]) if t >= 0 else 0 for t in self.label]
        self.spot = [self.place[t] if t >= 0 else -1 for t in self.label]
        self.length = list(map(len, self.labels))
        self.heads = Recent(lambda head: self._walk(head, 0, [-1]), FEW)

    def arc(self, state: int, t: int) -> bool:
        """Whether the automaton has an arc ``t`` from ``state``."""
        low = self.start[state]
        return not (bisect_right(self.table, self.place[t], low, self.start[state + 1]) - low) % 2

    def encode(self, word: bytes) -> list[int]:
        """The ids on the one path that spells ``word``.

        To every place leads exactly one path, so that a place has one state: the label of the arc that ends there. No
        step is ever taken back.
        """
        if (whole := self.whole.get(word)) is not None:
            return [whole]
        if len(word) > HEAD:
            node, states = self.heads[word[:HEAD]]
            _, states = self._walk(word[HEAD:], node, states[:])
        else:
            _, states = self._walk(word, 0, [-1])
        at, length = len(word), self.length
        ids = []
        while at:
            t = states[at]
            ids.append(t)
            at -= length[t]
        ids.reverse()
        return ids

    def _walk(self, part: bytes, node: int, states: list[int]) -> tuple[int, list[int]]:
        """The node and the states of all places after ``part``, which goes on from ``node`` and adds to ``states``.

        A place's state follows from what is before it only, so that words that begin alike have the same states there.
        """
        step, back, ends, shorter = self.step.get, self.back, self.ends, self.shorter
        label, size, table, start, spot = self.label, self.size, self.table, self.start, self.spot
        at = len(states) - 1
        for b in part:
            at += 1
            while (to := step(node << 8 | b)) is None:
                node = back[node]
            node = to
            end = ends[node]
            while (begin := at - size[end]) > 0:
                state = states[begin]
                low = start[state]
                if not (bisect_right(table, spot[end], low, start[state + 1]) - low) & 1:
                    break
                end = shorter[end]
            states.append(label[end])
        return node, states

    def decode(self, ids: memoryview | list[int]) -> bytes:
        """The labels of the arcs ``ids``, joined."""
        return b"".join(map(self.labels.__getitem__, ids))


class Encoder:
    """Encodes whole texts; holds the automaton of a task and the words that it has met."""

    def __init__(self, source: str):
        self.vocabulary = Vocabulary(source)
        self.automaton = Automaton(self.vocabulary)
        self.words = Recent(self._inner)
        self.pieces = Recent(self._piece, FEW)

    def _inner(self, chunk: str) -> bytes:
        return self._plain(" " + chunk)

    def _piece(self, pretoken: str) -> bytes:
        return array("I", self.automaton.encode(pretoken.encode())).tobytes()

    def _plain(self, chunk: str) -> bytes:
        if chunk[:1] == " " and chunk[1:].isalpha():
            return self._piece(chunk)
        # a word before a mark is remembered as the chunk that it is elsewhere
        return b"".join([self.words[w[1:]] if w[0] == " " and w[1:].isalpha() else self.pieces[w] for w in pretokens(chunk)])

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as unsigned 32-bit numbers; special strings in it are their own ids."""
        out = []
        for part, special in self.vocabulary.parts(text):
            if special is not None:
                out.append(array("I", [special]).tobytes())
                continue
            first = True
            for words in chunks(part):
                if first:
                    out.append(self._plain(words[0]))
                    out.extend(map(self.words.__getitem__, words[1:]))
                    first = False
                else:
                    out.extend(map(self.words.__getitem__, words))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are not UTF-8 become replacement characters."""
        return self.automaton.decode(memoryview(ids).cast("I")).decode("utf-8", "replace")


_encoders: dict[int, Encoder] = {}


def encoder(source: str) -> Encoder:
    """The encoder of a worker process, built once."""
    if hash(source) not in _encoders:
        _encoders.clear()
        _encoders[hash(source)] = Encoder(source)
    return _encoders[hash(source)]


def _mapped(df: DataFrame, path: str, schema: str, work) -> DataFrame:
    """``work(encoder, value)`` for the second column of ``df``; results leave in batches of bounded size."""
    source = df.sparkSession.sparkContext.broadcast(read_source(df.sparkSession, path))
    names = [f.split()[0] for f in schema.split(", ")]
    types = {"binary": pa.binary(), "string": pa.string()}
    kinds = [types[f.split()[1]] for f in schema.split(", ")[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(source.value)
        for batch in batches:
            out, start, size = [], 0, 0
            for k, value in enumerate(batch.column(1)):
                out.append(work(own, value.as_py()))
                size += len(out[-1][0] or "")
                if size >= FLUSH or k == batch.num_rows - 1:
                    columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, k + 1 - start), *columns], names=names)
                    out, start, size = [], k + 1, 0

    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids)`` for every row: the token ids of the whole text as little-endian unsigned 32-bit numbers.

    Null and empty texts have no ids. Repeated rows and null ids keep their rows; other columns are not read.
    ``path`` names the vocabulary file on the driver.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return _mapped(rows.select(F.col("id").cast("long"), "text"), path, "id long, ids binary", lambda e, text: (e.encode(text),))


def decode(encoded: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """``(id, text)`` of rows of ids as :func:`encode` gives them; null ids give an empty text."""
    rows = encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids"))
    return _mapped(rows, path, "id long, text string", lambda e, ids: (e.decode(ids or b""),))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids, text)``: :func:`encode` and then :func:`decode` of what it gave, in one pass over the texts."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def both(e: Encoder, text: str) -> tuple[bytes, str]:
        ids = e.encode(text)
        return ids, e.decode(ids)

    return _mapped(rows, path, "id long, ids binary, text string", both)
