"""Session settings and the few runtime helpers shared by the operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(app: str = "scrubframe", master: str | None = None, **conf: str) -> SparkSession:
    """Build a session; keyword settings use ``__`` for the dots of a Spark property name."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {**DEFAULT_CONF, **{k.replace("__", "."): v for k, v in conf.items()}}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for reliable checkpoints.

    The cluster names it in ``spark.checkpoint.dir``. A local session without that setting
    (the tests) gets a fresh temporary folder; a cluster session without it is an error,
    because a machine-local folder would be lost with its executor.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        current = tempfile.mkdtemp(prefix="scrubframe-checkpoint-")
        sc.setCheckpointDir(current)
    return current


def reliable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder so that several readers see the same rows in the same place."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """Hint a broadcast only after counting that the side is small; otherwise leave the choice to Spark.

    The count reads at most ``max_rows + 1`` rows. Callers join by equality keys, so the
    shuffled join remains available beyond the bound.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def only_wanted(df: DataFrame, wanted: DataFrame, key: str, max_rows: int = 200_000) -> DataFrame:
    """Drop rows without a partner early when the list of partners is short; otherwise change nothing."""
    keys = wanted.select(key)
    if keys.limit(max_rows + 1).count() > max_rows:
        return df
    return df.join(F.broadcast(keys), key, "left_semi")


def split_hot_groups(df: DataFrame, keys: list[str], limit: int, max_broadcast: int = 200_000,
                     counted: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Split rows into those of groups with at most ``limit`` rows and those of larger groups.

    The counts are combined before their shuffle, so a group holding a third of all rows costs
    one small record per task. They are taken before planning: usually no group is large, the
    second part is None and the rows need no join at all. A short list of large groups is
    broadcast, a long one joined by its keys. ``counted`` may name a table with at least the
    rows of ``df`` that is cheaper to count.
    """
    counts = (counted if counted is not None else df).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    large = counts.where(F.col("_n") > limit).select(*keys)
    found = large.limit(max_broadcast + 1).count()
    if found == 0:
        return df, None
    if found <= max_broadcast:
        large = F.broadcast(large)
    return df.join(large, keys, "left_anti"), df.join(large, keys, "left_semi")


def sorted_by(df: DataFrame, *order: str) -> DataFrame:
    """Global sort that also spreads rows with equal sort values, even exact copies, over tasks."""
    tie = F.xxhash64(*df.columns)
    placed = df.withColumn("_tie", tie).withColumn("_source", F.spark_partition_id())
    return placed.orderBy(*order, "_tie", "_source").drop("_tie", "_source")
