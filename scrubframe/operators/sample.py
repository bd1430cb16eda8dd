"""Seeded samples: the same seed draws the same rows on every run and every partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded_hash(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def combination(cols: list[str]) -> Column:
    """Name of a combination of values: every value followed by a comma."""
    return F.concat(*(part for c in cols for part in (F.col(c).cast("string"), F.lit(","))))


def combo_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows per combination."""
    counts = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("total"))
    return counts.select(combination(cols).alias("combination"), *cols, "total")


def combo_filter(df: DataFrame, text: str, col: str = "combination") -> DataFrame:
    return df.where(F.col(col).contains(text))


def group_head_n(df: DataFrame, group: list[str], n: int, order: list[str]) -> DataFrame:
    """First ``n`` rows of each group. Each task keeps only its own first ``n`` before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("draw_no", F.row_number().over(w)).where(F.col("draw_no") <= n)


def _draws(df: DataFrame, group: list[str], n: int, key: str, seed: int) -> list[Column]:
    """``n`` independent picks per group: the row with the least hash for each draw number.

    One digest serves four draws, eight hexadecimal digits each. Every draw is a combinable
    minimum, so a group of any size contributes one record per task.
    """
    picks = []
    for i in range(n):
        digest = F.md5(F.concat(F.lit(f"{seed}|{i // 4}|"), F.col(key).cast("string")))
        rank = F.substring(digest, 1 + 8 * (i % 4), 8)
        picks.append(F.min(F.concat(rank, F.lit("|"), F.col(key).cast("string"))))
    return picks


def group_sample_n(df: DataFrame, group: list[str], n: int, key: str, seed: int = 0,
                   replace: bool = False) -> DataFrame:
    """``n`` random rows per group as (group, draw_no, key).

    Without replacement the rows with the ``n`` least hashes are taken. With replacement each
    draw picks again from the whole group, so a row can come up more than once.
    """
    if not replace:
        w = Window.partitionBy(*group).orderBy(seeded_hash(key, seed), key)
        ranked = df.select(*group, key).withColumn("draw_no", F.row_number().over(w))
        return ranked.where(F.col("draw_no") <= n).select(*group, "draw_no", key)
    picks = df.groupBy(*group).agg(*(p.alias(f"_d{i}") for i, p in enumerate(_draws(df, group, n, key, seed))))
    draws = F.array(*(F.col(f"_d{i}") for i in range(n)))
    long = picks.select(*group, F.posexplode(draws).alias("_i", "_pick"))
    return long.select(*group, (F.col("_i") + 1).alias("draw_no"),
                       F.expr("substring(_pick, 10)").alias(key))


def combo_sample_n(df: DataFrame, cols: list[str], key: str, k: int = 20, seed: int = 0,
                   replace: bool = False) -> DataFrame:
    """One row per combination: its total and ``k`` drawn keys in columns ``d0`` .. (null when it has fewer rows)."""
    if replace:
        picks = df.groupBy(*cols).agg(
            F.count(F.lit(1)).alias("total"),
            *(p.alias(f"_d{i}") for i, p in enumerate(_draws(df, cols, k, key, seed))))
        return picks.select(combination(cols).alias("combination"), "total",
                            *(F.expr(f"substring(_d{i}, 10)").alias(f"d{i}") for i in range(k)))
    # At most k rows per combination reach the pivot; the totals are combined before their shuffle.
    drawn = group_sample_n(df, cols, k, key, seed)
    wide = drawn.groupBy(*cols).agg(*(
        F.max(F.when(F.col("draw_no") == i + 1, F.col(key))).alias(f"d{i}") for i in range(k)))
    totals = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("total"))
    same = [totals[c].eqNullSafe(wide[c]) for c in cols]
    joined = totals.join(wide, same, "inner").select(*(totals[c] for c in cols), "total",
                                                     *(f"d{i}" for i in range(k)))
    return joined.select(combination(cols).alias("combination"), "total", *(f"d{i}" for i in range(k)))


def combo_sample_files(df: DataFrame, cols: list[str], key: str, k: int = 20, seed: int = 0,
                       replace: bool = False) -> DataFrame:
    """The same draws in long form: (combination, draw_no, key)."""
    drawn = group_sample_n(df, cols, k, key, seed, replace)
    return drawn.select(combination(cols).alias("combination"), "draw_no", key)


def combo_unique_n(samples: DataFrame, key: str, n: int | None = None, prefix: str | None = None) -> DataFrame:
    """Distinct picks, at most ``n`` per combination, with an optional root in front of the path."""
    first = samples.groupBy("combination", key).agg(F.min("draw_no").alias("draw_no"))
    if n is not None:
        w = Window.partitionBy("combination").orderBy("draw_no", key)
        first = first.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n)
    path = F.concat(F.lit(prefix.rstrip("/") + "/"), F.col(key)) if prefix else F.col(key)
    return first.select("combination", path.alias(key))


def fetch_sampled_rows(samples: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """Full rows of the sampled keys, one per pick."""
    return samples.join(df, key)


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """``n`` rows chosen uniformly; each task keeps its own best ``n`` before they are merged."""
    return df.orderBy(seeded_hash(key, seed), key).limit(n)


def one_per_series(keys: DataFrame, seed: int = 0) -> DataFrame:
    """One object per study and series."""
    pick = F.min(F.struct(F.md5(F.concat(F.lit(f"{seed}|"), F.col("sop"))).alias("h"), F.col("sop")))
    return keys.groupBy("study", "series").agg(pick.alias("_p")).select(
        "study", "series", F.col("_p.sop").alias("sop"))


def shuffle_order(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Rows in a seeded random order, with the sort value kept as ``shuffle_key``."""
    return df.withColumn("shuffle_key", seeded_hash(key, seed)).orderBy("shuffle_key", key)


def split_80_20_random(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Disjoint random split by a hash threshold; no shuffle."""
    bucket = F.conv(F.substring(seeded_hash(key, seed), 1, 8), 16, 10).cast("bigint") % 100
    return df.withColumn("part", F.when(bucket < 80, "training").otherwise("validation"))
