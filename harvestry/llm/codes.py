"""Vector codes by product quantisation in integers, with Drake-Hamerly adaptive bounds.

Vectors are cut into parts, and each part position has a codebook that is refined by rounds of assigning and averaging.
For each part of a vector a table keeps the ``b`` entries that were closest after the assigned one, with lower bounds of their
distances in ascending order, and one outer bound for all other entries. When entries move, bounds move by as much; a part is
measured again only against the entries whose bounds are not above the upper bound of its own distance, and against
the whole codebook only if the outer bound is not either. What is measured is measured in integers, so codes are those of comparing
everything, ties included. ``b`` falls to what the rounds are seen to need.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestry.plans.skew import join_facts
from harvestry.sources.shared import materialize

#: Units of a component; components of more units are as good as infinite, as their squares leave 64 bits.
SCALE, MOST_UNITS = 1024, 1 << 26
#: Entries with a bound of their own that a part starts with, and keeps at least.
START_BOUNDS, LEAST_BOUNDS = 16, 2
#: Share of the parts that have to be settled within the bounds that are kept.
SETTLED = 0.98
#: A bound is an upper or lower one only if it is clear of rounding; what is not is measured in integers.
_SLACK = 1e-6
_STATE = "own array<short>, upper array<double>, near array<short>, lower array<float>, outer array<double>"


@dataclass
class Codebooks:
    """The entries of all parts, ``(part, entry, position)``, and how far each has moved since the bounds were set."""

    entries: np.ndarray
    moved: np.ndarray = field(default=None)

    def after(self, sums: np.ndarray, counts: np.ndarray) -> Codebooks:
        """Each entry replaced by the floor of the mean of its parts; unused entries stay."""
        new = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], self.entries)
        apart = (new - self.entries).astype(float)
        return Codebooks(new, np.sqrt((apart * apart).sum(axis=2)) * (1 + _SLACK))

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows to all entries, exactly. Floats hold them where no sum of products can pass 2**53."""
    top = max(int(abs(x).max(initial=0)), int(abs(entries).max(initial=0)))
    kind = float if 4 * top * top * max(x.shape[1], 1) < 1 << 53 else np.int64
    x, entries = x.astype(kind), entries.astype(kind)
    return ((x * x).sum(axis=1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(axis=1)[None, :]).astype(np.int64)


def _measured(x: np.ndarray, entries: np.ndarray, bounds: int) -> tuple:
    """Own entry, its distance, the next ``bounds`` entries with their distances in order, and that of the one after them, of every row."""
    squares = _squares(x, entries)
    keep = min(bounds + 2, len(entries))
    # by distance and, of equal ones, by number
    order = np.argsort(squares, axis=1, kind="stable")[:, :keep]
    far = np.sqrt(np.take_along_axis(squares, order, axis=1).astype(float))
    outer = far[:, bounds + 1] if keep > bounds + 1 else np.full(len(x), np.inf)
    return order[:, 0], far[:, 0], order[:, 1 : bounds + 1], far[:, 1 : bounds + 1], outer * (1 - _SLACK)


def assign_part(x: np.ndarray, entries: np.ndarray, moved: np.ndarray | None, state: tuple | None, bounds: int) -> tuple[tuple, np.ndarray]:
    """The new state ``(own, upper, near, lower, outer)`` of one part of many vectors, and how many bounded entries each had to look at.

    ``state`` is that of the round before, or None; ``moved`` says how far entries have gone since. A row that had to look at
    the whole codebook counts one more than it has bounds.
    """
    if state is None:
        return _measured(x, entries, bounds), np.zeros(len(x), int)
    own, upper, near, lower, outer = (a.copy() for a in state)
    have = near.shape[1]
    if bounds < have:  # entries that lose their own bound are covered by the outer one
        outer = np.minimum(outer, lower[:, bounds])
        near, lower, have = near[:, :bounds], lower[:, :bounds].copy(), bounds
    upper = (upper + moved[own]) * (1 + _SLACK)
    outer = outer - moved.max() if len(moved) else outer
    lower = lower - moved[near]
    for k in reversed(range(have)):  # ascending order again: a bound may be lowered
        lower[:, k] = np.minimum(lower[:, k], lower[:, k + 1] if k + 1 < have else outer)
    ordered = np.column_stack([lower, outer])
    clear = ordered > upper[:, None]
    need = np.where(clear.any(axis=1), clear.argmax(axis=1), have + 1)
    for z in np.unique(need).tolist():
        rows = np.flatnonzero(need == z)
        if z == 0:
            continue
        if z > have:
            found = _measured(x[rows], entries, have)
            for whole, part in zip((own, upper, near, lower, outer), found):
                whole[rows] = part
            continue
        some = np.column_stack([own[rows], near[rows, :z]])
        apart = x[rows][:, None, :] - entries[some]
        squares = (apart * apart).sum(axis=2)
        order = np.lexsort((some, squares), axis=1)
        some, far = np.take_along_axis(some, order, axis=1), np.sqrt(np.take_along_axis(squares, order, axis=1).astype(float))
        own[rows], upper[rows], near[rows, :z] = some[:, 0], far[:, 0], some[:, 1:]
        # a measured distance is its own bound, but the order goes by bounds: none may pass the one after it
        rest = (lower[rows, z] if z < have else outer[rows])[:, None]
        lower[rows, :z] = np.minimum(far[:, 1:] * (1 - _SLACK), rest)
    return (own, upper, near, lower, outer), need


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    width = values.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) * width + 1, max(width, 1))[: len(values) + 1] if width else np.zeros(len(values) + 1, int), pa.int32()), pa.array(values.ravel(), kind))


def _assigned(state: DataFrame, books: Codebooks, bounds: int, first: bool) -> DataFrame:
    """The table with a new state of every vector; ``need`` says how many bounded entries each part had to look at."""
    shared = state.sparkSession.sparkContext.broadcast(books)  # at most 256 entries of a vector's length
    parts = len(books.entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = np.split(_matrix(batch.column("x"), n), parts, axis=1)
            before = None if first else [np.split(_matrix(batch.column(c), n), parts, axis=1) for c in ("own", "upper", "near", "lower", "outer")]
            made, needs = [], []
            for p in range(parts):
                had = None if first else (before[0][p][:, 0].astype(int), before[1][p][:, 0], before[2][p].astype(int), before[3][p].astype(float), before[4][p][:, 0])
                now, need = assign_part(x[p], own.entries[p], None if first else own.moved[p], had, bounds)
                made.append(now)
                needs.append(need)
            columns = [np.column_stack([m[k] for m in made]) for k in range(5)]
            lower = np.nextafter(columns[3].astype(np.float32), np.float32(-np.inf))  # rounded down
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("id", "label", "x")), _lists(columns[0], pa.int16()), _lists(columns[1], pa.float64()),
                    _lists(columns[2], pa.int16()), _lists(lower, pa.float32()), _lists(columns[4], pa.float64()), _lists(np.column_stack(needs), pa.int16()),
                ],
                names=["id", "label", "x", "own", "upper", "near", "lower", "outer", "need"],
            )

    kind = dict(state.dtypes)["label"]
    return materialize(state.mapInArrow(run, f"id long, label {kind}, x array<long>, {_STATE}, need array<short>"), "codes")


def _averages(state: DataFrame, parts: int, size: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums and counts of the parts of each entry, and how many parts needed how many bounds, added up in tasks and then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, needs = np.zeros((parts, size, width), np.int64), np.zeros((parts, size), np.int64), np.zeros(START_BOUNDS + 2, np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x, own = _matrix(batch.column(0), n).reshape(n, parts, width), _matrix(batch.column(1), n)
            for p in range(parts):
                np.add.at(sums[p], own[:, p], x[:, p])
                counts[p] += np.bincount(own[:, p], minlength=size)
            needs += np.bincount(batch.column(2).flatten().to_numpy(), minlength=len(needs))
        flat = np.concatenate([sums.ravel(), counts.ravel(), needs])
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(flat[at])], names=["at", "n"])

    added = state.select("x", "own", "need").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    whole = np.zeros(parts * size * (width + 1) + START_BOUNDS + 2, np.int64)
    whole[added.column("at").to_numpy()] = added.column("n").to_numpy()
    sums, counts, needs = np.split(whole, [parts * size * width, parts * size * (width + 1)])
    return sums.reshape(parts, size, width), counts.reshape(parts, size), needs


def fewer_bounds(needs: np.ndarray, bounds: int) -> int:
    """The least number of bounds within which the ``SETTLED`` share of the parts would have been settled, but not more than there are."""
    within = np.cumsum(needs[: bounds + 1])
    enough = np.flatnonzero(within >= SETTLED * max(needs.sum(), 1))
    return max(min(bounds, int(enough[0]) if len(enough) else bounds), min(LEAST_BOUNDS, bounds))


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int = SCALE, parts: int = 4) -> DataFrame:
    """``(id, label, x)``: components in units of ``1 / scale``, rounded down, filled with zeros to a length that ``parts`` divides.

    Rows are left out whose vector is null or empty, or holds a component that is null, not finite, or over ``MOST_UNITS`` units.
    """
    x, limit = F.col(vector_col).cast("array<double>"), MOST_UNITS / scale
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), x.alias("x"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | ~F.coalesce(F.abs(c) <= limit, F.lit(False)))
    whole = F.transform("x", lambda c: F.floor(c * scale))
    fill = F.array_repeat(F.lit(0).cast("long"), F.pmod(-F.size("x"), F.lit(parts)))
    return rows.filter(F.col("x").isNotNull() & (F.size("x") > 0) & ~F.coalesce(bad, F.lit(False))).select("id", "label", F.concat(whole, fill).alias("x"))


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = 4, size: int = 256, rounds: int = 4, scale: int = SCALE, bounds: int = START_BOUNDS,
) -> tuple[DataFrame, Codebooks]:
    """``(id, label, code array<short>, error)`` of every vector that can be measured, and the final codebooks.

    See :func:`integer_vectors` for what is left out; vectors of another length than that with the least id are too. Codebooks start as the parts
    of the ``size`` vectors with the least ids (null ids last, equal ids by their components), fewer if there are fewer. ``rounds`` times every part is
    assigned to the nearest entry, of equally near ones to the first, and every entry becomes the floor of its parts' mean; then parts are assigned once
    more. ``error`` is the squared distance to the entries, summed over parts. Rows keep their number; ids may be null or repeated. Without vectors the
    result is empty and so are the codebooks.
    """
    bounds = max(0, min(bounds, START_BOUNDS))
    rows = integer_vectors(vectors, id_col, vector_col, label_col, scale, parts)
    kind = dict(rows.dtypes)["label"]
    first = rows.orderBy(F.col("id").asc_nulls_last(), "x").select("x")
    head = first.limit(1).collect()
    if not head:
        return rows.sparkSession.createDataFrame([], f"id long, label {kind}, code array<short>, error long"), Codebooks(np.zeros((parts, 0, 0), np.int64))
    length = len(head[0].x)
    rows = rows.filter(F.size("x") == length)
    start = np.array([r.x for r in rows.orderBy(F.col("id").asc_nulls_last(), "x").select("x").limit(size).collect()], np.int64)
    books = Codebooks(np.ascontiguousarray(start.reshape(len(start), parts, length // parts).transpose(1, 0, 2)))
    bounds, state = min(bounds, len(start) - 1), rows
    for turn in range(rounds):
        state = _assigned(state, books, bounds, turn == 0)
        sums, counts, needs = _averages(state, parts, len(start), length // parts)
        books = books.after(sums, counts)
        bounds = bounds if turn == 0 else fewer_bounds(needs, bounds)
    return _with_errors(_assigned(state, books, bounds, rounds == 0), books), books


def _with_errors(state: DataFrame, books: Codebooks) -> DataFrame:
    shared, parts = state.sparkSession.sparkContext.broadcast(books), len(books.entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, own = batch.num_rows, _matrix(batch.column("own"), batch.num_rows)
            x, error = np.split(_matrix(batch.column("x"), n), parts, axis=1) if n else [], np.zeros(n, np.int64)
            for p, part in enumerate(x):
                apart = part - shared.value.entries[p][own[:, p]]
                error += (apart * apart).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "label", "own")), pa.array(error)], names=["id", "label", "code", "error"])

    kind = dict(state.dtypes)["label"]
    return state.select("id", "label", "x", "own").mapInArrow(run, f"id long, label {kind}, code array<short>, error long")


def hex_code(code: Column) -> Column:
    """Two lowercase hex digits for each part."""
    return F.lower(F.array_join(F.transform(code, lambda c: F.lpad(F.hex(c.cast("long")), 2, "0")), ""))


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the error summed over all rows with an equal label, null labels together. A label may be that of most rows."""
    coded = materialize(coded.withColumn("_label", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("-"))), "coded")
    sums = coded.groupBy("_label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    return join_facts(coded, sums, "_label", coded.count(), F.xxhash64("id").cast("string")).drop("_label")
