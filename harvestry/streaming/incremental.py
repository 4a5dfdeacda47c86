"""Incremental jobs: which pages are new, and snapshots of the seeds that they touch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from harvestry.sources.shared import materialize

KEYS = ("seed_url", "url")
#: Buckets at the start and at most, as powers of two, and records of a bucket from which on all are split.
START_BITS, MOST_BITS, BUCKET_RECORDS = 4, 20, 20_000
LOG = "records long, touched long, read long, bits int, batch long"


def new_pages(stream: DataFrame, keys: tuple[str, ...] = KEYS, time_col: str | None = None, delay: str = "1 day") -> DataFrame:
    """The first arrival of each seed and URL. With a time column, keys are forgotten ``delay`` after their watermark, which bounds the state."""
    if time_col:
        return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(list(keys))
    return stream.dropDuplicates(list(keys))


def last_step(spark: SparkSession, path: str, before: int | None = None) -> Row:
    """``(batch, bits, records, touched, read)`` of the last batch, or of the last one before ``before``; of none, an empty view."""
    try:
        log = spark.read.schema(LOG).parquet(f"{path}/log")
    except AnalysisException:
        return Row(batch=-1, bits=START_BITS, records=0, touched=0, read=0)
    log = log if before is None else log.filter(F.col("batch") < before)
    return log.orderBy(F.desc("batch")).first() or Row(batch=-1, bits=START_BITS, records=0, touched=0, read=0)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The seeds as the last batch has left them."""
    bits = last_step(spark, path).bits
    return spark.read.parquet(f"{path}/seeds/bits={bits}").drop("bucket")


def snapshots(
    stream: DataFrame, path: str, checkpoint: str, extract: Callable[[DataFrame], DataFrame], rebuild: Callable[[DataFrame], DataFrame],
    bucket_records: int = BUCKET_RECORDS, **trigger
) -> StreamingQuery:
    """An incremental view: run ``extract`` on new pages, and ``rebuild`` for the seeds that they touch.

    Rows of ``extract`` (with ``seed_url``) lie in ``<path>/records``, what ``rebuild`` makes of all rows of a seed in ``<path>/seeds``, both in buckets of seeds
    by a hash. A batch reads the buckets that its seeds are in, and replaces those. Buckets are split, all at once, when they hold more than ``bucket_records`` records
    each on average, so that a batch of so many seeds reads and writes about as much however large the view has grown; a record is moved
    so often as the view doubles. A batch that is repeated first takes its own earlier records out. ``<path>/log`` has a row for each batch; what it does not name is
    not there yet, and :func:`latest` reads what it names.
    """

    def bucket(bits: int) -> Column:
        return F.pmod(F.xxhash64("seed_url"), F.lit(1 << bits)).cast("int")

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = last_step(spark, path, number)
        bits = last.bits
        fresh = materialize(extract(batch).withColumns({"batch": F.lit(number).cast("long"), "bucket": bucket(bits)}), "fresh")
        told = {"bits": bits, "records": last.records, "touched": 0, "read": 0}
        touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # buckets of one batch, by number
        if touched:
            both = fresh
            if last.batch >= 0:
                old = spark.read.parquet(f"{path}/records/bits={bits}") if last.records else fresh.limit(0)
                both = old.filter(F.col("bucket").isin(touched) & (F.col("batch") <= last.batch)).select(*fresh.columns).unionByName(fresh)
            both = materialize(both, "touched")
            put(both, f"{path}/records/bits={bits}", bits)
            put(rebuild(both.drop("batch", "bucket")), f"{path}/seeds/bits={bits}", bits)
            told |= {"records": last.records + fresh.count(), "touched": len(touched), "read": both.count()}
        wanted = bits
        while told["records"] > bucket_records << wanted and wanted < MOST_BITS:
            wanted += 1
        if wanted > bits:
            for kind in ("records", "seeds"):
                put(spark.read.parquet(f"{path}/{kind}/bits={bits}").drop("bucket"), f"{path}/{kind}/bits={wanted}", wanted, "static")
        row = spark.range(1).select(*[F.lit(told[c]).cast("long").alias(c) for c in ("records", "touched", "read")], F.lit(wanted).alias("bits"))
        row.write.mode("overwrite").parquet(f"{path}/log/batch={number}")
        if wanted > bits:  # the log names the new buckets; the old ones are emptied
            for kind in ("records", "seeds"):
                put(spark.read.parquet(f"{path}/{kind}/bits={wanted}").drop("bucket").limit(0), f"{path}/{kind}/bits={bits}", bits, "static")

    def put(rows: DataFrame, where: str, bits: int, how: str = "dynamic") -> None:
        rows = rows.withColumn("bucket", bucket(bits)).repartition("bucket")
        rows.write.mode("overwrite").option("partitionOverwriteMode", how).partitionBy("bucket").parquet(where)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def page_stream(spark: SparkSession, path: str, schema: str | StructType, files: int = 100) -> DataFrame:
    """Pages as their Parquet files arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
