"""Row positions, splits and batches over lists of any length.

A window without partitioning, or one over a group holding a third of all rows, sorts that
data in a single task. Positions here come from a range shuffle instead: each task numbers
its own sorted slice and adds the number of rows in the slices before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrubframe.session import reliable


def with_position(df: DataFrame, order: list[str], name: str = "pos", total: str | None = None) -> DataFrame:
    """Add the 1-based position of every row in ``order``, and optionally the row count.

    The range-sorted rows are checkpointed so that the counts and the rows they number come
    from the same slices. Only one record per slice is gathered for the running sum.
    """
    # Rows with equal sort values, even exact copies, are split by the task they come from.
    keys = [*order, "_source"]
    ordered = (df.withColumn("_source", F.spark_partition_id())
               .repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_source")
               .withColumn("_id", F.monotonically_increasing_id()))
    slices = reliable(ordered).withColumn("_slice", F.shiftright("_id", 33))
    counts = slices.groupBy("_slice").agg(F.count(F.lit(1)).alias("_rows"))
    # One record per slice (the number of shuffle partitions), whatever the data size.
    every = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_slice", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"),
                           F.sum("_rows").over(every).alias("_total"))
    inside = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    out = slices.join(F.broadcast(starts), "_slice").withColumn(name, F.col("_start") + inside + 1)
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_id", "_slice", "_start", "_total")


def with_group_position(df: DataFrame, group: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """Position of every row inside its group, without gathering a group in one task."""
    numbered = with_position(df, [*group, *order], "_global")
    first = numbered.groupBy(*group).agg(F.min("_global").alias("_first"))
    return (numbered.join(first, group).withColumn(name, F.col("_global") - F.col("_first") + 1)
            .drop("_global", "_first"))


def split_halves(df: DataFrame, order: list[str]) -> DataFrame:
    """Contiguous halves 1 and 2 of the ordered list; the first is the smaller one for an odd count."""
    rows = with_position(df, order, "_pos", "_n")
    half = F.floor(F.col("_n") / 2)
    return rows.withColumn("half", F.when(F.col("_pos") <= half, 1).otherwise(2)).drop("_pos", "_n")


def batches_of_n(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """Zero-based batch number, ``n`` rows per batch."""
    rows = with_position(df, order, "_pos")
    return rows.withColumn("batch", F.floor((F.col("_pos") - 1) / n).cast("bigint")).drop("_pos")


def divvy_blocks(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """Deal the list round-robin to ``n`` review blocks with empty label columns."""
    rows = with_position(df, order, "_pos")
    return rows.select(*df.columns, ((F.col("_pos") - 1) % n + 1).alias("block"),
                       F.lit(None).cast("string").alias("Label"),
                       F.lit(None).cast("string").alias("Label_datetime"))


def split_80_20_ordered(df: DataFrame, order: list[str]) -> DataFrame:
    """First 80 % of the ordered list for training, the rest for validation."""
    rows = with_position(df, order, "_pos", "_n")
    cut = F.floor(F.col("_n") * 8 / 10)
    part = F.when(F.col("_pos") <= cut, "training").otherwise("validation")
    return rows.withColumn("part", part).drop("_pos", "_n")


def bind_blocks(*blocks: DataFrame) -> DataFrame:
    """Concatenate reviewed blocks, keeping the key and the label columns."""
    keep = ["PK", "Label", "Label_datetime"]
    out = blocks[0].select(*[c for c in blocks[0].columns if c in keep])
    for block in blocks[1:]:
        out = out.unionByName(block.select(*[c for c in block.columns if c in keep]), allowMissingColumns=True)
    return out


def label_union(negative: DataFrame, positive: DataFrame) -> DataFrame:
    """Training table: the first list as class 0, the second as class 1."""
    return (negative.withColumn("class", F.lit(0))
            .unionByName(positive.withColumn("class", F.lit(1)), allowMissingColumns=True))
