"""Joins and ranks of many rows, where one key may hold a large part of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from harvestry.sources.shared import materialize

#: Rows from which on a key may be hot, and keys that can be hot, at most.
HOT_ROWS, HOT_KEYS = 500, 1000


def hot_bound(total: int) -> int:
    """A key of more rows than this is hot. Of ``total`` rows fewer than ``HOT_KEYS`` keys can have so many."""
    return max(HOT_ROWS, total // HOT_KEYS)


def join_facts(rows: DataFrame, facts: DataFrame, key: str, total: int, deal: Column, how: str = "inner", count: str = "n") -> DataFrame:
    """``rows`` with the columns of ``facts``, which has one row for each ``key``, and the number of rows with it in ``count``.

    Hot keys are fewer than ``HOT_KEYS``, whatever the data are, so that their facts are sent to all rows; the rows that find
    theirs so are then dealt by ``deal``, not by their key, and all others meet their facts in a shuffle of keys that are not hot.
    ``total`` is the number of rows. ``how`` is ``inner`` or ``left``; keys are not null.
    """
    names = [c for c in facts.columns if c not in (key, count)]
    told = facts.select(F.col(key).alias("_key"), (F.col(count) > hot_bound(total)).alias("_hot"), F.struct(F.lit(1).alias("_"), *names).alias("_facts"))
    hot = told.filter("_hot").select(F.col("_key").alias("_hot_key"), F.col("_facts").alias("_hot_facts"))
    cold = told.filter("not _hot").select(F.col("_key").alias("_cold_key"), F.col("_facts").alias("_cold_facts"))
    some = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    some = some.withColumn("_dealt", F.when(F.col("_hot_key").isNotNull(), deal).otherwise(F.col(key)))
    both = some.join(cold, F.col("_dealt") == F.col("_cold_key"), "left").withColumn("_own", F.coalesce("_hot_facts", "_cold_facts"))
    if how == "inner":
        both = both.filter("_own is not null")
    return both.select(*[F.col(f"`{c}`") for c in rows.columns], *[F.col(f"_own.`{c}`").alias(c) for c in names])


def ranked_within(df: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """``df`` with the place of each row in its group, from 1, in the given order, which leaves no ties.

    Rows are dealt by ranges of group and order, so that a large group is sorted by many tasks; only the sizes of the pieces are
    added up by group.
    """
    by = [F.col(group).asc(), *order]
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by)
    dealt = materialize(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), "ranked")
    pieces = dealt.groupBy(F.col(group).alias("_group"), F.col("_part").alias("_piece")).agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("_group").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.select("_group", "_piece", (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    both = dealt.join(pieces, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_piece")))
    return both.select(*df.columns, (F.col("_row") + F.col("_shift")).cast("int").alias(name))
