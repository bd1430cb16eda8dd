"""Helpers shared by the text operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubframe.session import checkpoint_root

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HEAVY = 512
FILTER_BITS = 1 << 25
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps survive lost executors and do not recompute it.

    Nothing reads the shuffles of the write again, so Spark is told to remove them when it ends.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def maybe_in(df: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``_maybe``: false only for rows whose keys are not among ``wanted``.

    The hashes of the wanted keys set bits of a map of fixed size (at most 1024 rows of 4 kB), which is broadcast; so rows
    without a partner need not move for a join. It never decides alone: an exact join follows.
    """
    def place(frame: DataFrame) -> Column:
        return F.pmod(F.xxhash64(*[frame[k] for k in keys]), F.lit(FILTER_BITS))

    marks = wanted.select(place(wanted).alias("_h")).groupBy(F.bitmap_bucket_number("_h").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_h")).alias("_bits"))
    at = df.withColumn("_h", place(df)).withColumn("_bucket", F.bitmap_bucket_number("_h")).withColumn("_at", F.bitmap_bit_position("_h"))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.floor(F.col("_at") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.expr("shiftright(_byte, cast(_at % 8 as int)) & 1") == 1
    found = at.join(F.broadcast(stored(marks, "marks")), "_bucket", "left").withColumn("_byte", byte)
    return found.withColumn("_maybe", F.coalesce(hit, F.lit(False))).drop("_h", "_bucket", "_at", "_bits", "_byte")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does the same where every character is ASCII, and much faster."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def join_counted(left: DataFrame, right: DataFrame, key: str, count: str) -> DataFrame:
    """Left join of rows with a table that has one row and a row count per key, whatever a single key holds.

    Fewer than ``HEAVY`` keys can hold more than one part in ``HEAVY`` of all counted rows, so those are broadcast and
    their rows do not move; all others are joined by a shuffle whose largest group is bounded.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    heavy = right.where(F.col(count) * HEAVY > total)
    rest = right.where(F.col(count) * HEAVY <= total)
    found = heavy.count()
    if not found:
        return left.join(rest, key, "left")
    keys = heavy.select(key).withColumn("_heavy", F.lit(True))
    marked = left.join(F.broadcast(keys), key, "left")
    hot = marked.where("_heavy").drop("_heavy").join(F.broadcast(heavy), key, "left")
    return hot.unionByName(marked.where("_heavy is null").drop("_heavy").join(rest, key, "left"))
