"""A Bloom filter over 64-bit keys: made by aggregation, sent to all tasks, asked by arrays.

It grows with the keys from ``LEAST`` to ``MOST`` bits (64 MB). Up to 33 million keys two in a hundred of the others pass; beyond that more and more do,
which costs work but no results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter, at least and at most, and for each key in between.
LEAST, MOST, EACH = 1 << 20, 1 << 29, 16
#: Bits of one of Spark's bitmaps.
BITMAP = 1 << 15


def _positions(key: Column, bits: int) -> list[Column]:
    return [F.pmod(key, F.lit(bits)), F.pmod(F.shiftrightunsigned(key, 32), F.lit(bits))]


def build(keys: DataFrame, key: str) -> np.ndarray:
    """The filter of a column of hashes, in bytes: bitmaps of its parts are made and merged by aggregation."""
    bits = min(MOST, max(LEAST, 1 << (EACH * max(keys.count(), 1) - 1).bit_length()))
    at = keys.select(F.explode(F.array(*_positions(F.col(key), bits))).alias("at"))
    maps = at.groupBy(F.floor(F.col("at") / BITMAP).alias("part")).agg(F.bitmap_construct_agg(F.pmod("at", F.lit(BITMAP))).alias("bits"))
    whole = np.zeros(bits // 8, np.uint8)
    for r in maps.collect():  # as large as the filter
        whole[r.part * BITMAP // 8 : (r.part + 1) * BITMAP // 8] = np.frombuffer(r.bits, np.uint8)
    return whole


def passes(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether each of the keys, as unsigned numbers, may be among those of the filter; those that are always pass."""
    found, last = np.ones(len(keys), bool), np.uint64(8 * len(bits) - 1)
    for shift in (0, 32):
        at = (keys >> np.uint64(shift)) & last
        found &= (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0
    return found
