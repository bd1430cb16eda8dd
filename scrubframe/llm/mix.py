"""Mixing sources to target weights by Pareto order sampling, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrubframe.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
MOST = 3


def words(text: Column) -> Column:
    """Number of words; every word ends before white space or at the end, so the gaps are counted after a trim."""
    blank = "\x20\x09\x0a\x0b\x0c\x0d"
    core = F.btrim(F.coalesce(text, F.lit("")), F.lit(blank))
    return F.when(F.length(core) == 0, 0).otherwise(F.regexp_count(core, F.lit(r"[\x20\x09-\x0D]+")) + 1).cast("bigint")


def targets(sizes: DataFrame, most: int = MOST, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Target per source from a table (source, source_size) with a row per source.

    Sources in order of their names (null last) take ``weights`` in turn and share the sum of all sizes. A target stops at
    ``most`` times the source's size and what is over is shared again by weight. That ends at one level per unit of
    weight, found directly: a source is capped if its cap per weight is at most the level that those before it leave.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    rows = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), turn + 1).cast("double"))
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("total", F.sum("source_size").over(everything))
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    rows = rows.withColumn("level", level).withColumn("capped", F.col("cap") <= F.col("weight") * F.col("level"))
    rest = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * rest)
    return rows.select("source", "source_size", target.alias("target"))


def random_number(doc_id: Column, text: Column, seed: int) -> Column:
    """A number between 0 and 1 from a hash of doc_id and text."""
    key = F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(16 ** 13))


def inclusion_odds(part: Column, size: Column, mean: Column) -> Column:
    """Odds of one more copy of a document: those of the source's part, times the root of the document's size over the mean.

    Longer documents are thus more likely to be repeated, by less than in proportion; without words the factor is 1.
    """
    return (part / (F.lit(1.0) - part)) * F.when(size > 0, F.sqrt(size.cast("double") / mean)).otherwise(F.lit(1.0))


def pareto_rank(u: Column, odds: Column) -> Column:
    """Random odds divided by the odds of inclusion, brought between 0 and 1 in the same order."""
    ratio = (u / (F.lit(1.0) - u)) / odds
    return ratio / (F.lit(1.0) + ratio)


def cutoffs(rows: DataFrame, plan: DataFrame, slices: int) -> DataFrame:
    """Per source the Pareto rank up to which documents are sampled.

    ``rows`` (source, size, rank) are first summed per source and slice of the rank, which combines before any shuffle.
    Only the rows of the slice in which a source's rest is used up are then ordered.
    """
    wanted = plan.where("part > 0 and source_size > 0").select(F.col("source").alias("_source"), (F.col("part") * F.col("source_size")).alias("rest"))
    rows = rows.withColumn("slice", F.floor(F.col("rank") * slices))
    sums = rows.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    up_to = Window.partitionBy("source").orderBy("slice")
    sums = sums.withColumn("upto", F.sum("words").over(up_to)).withColumn("before", F.col("upto") - F.col("words"))
    edge = sums.join(wanted, F.col("source").eqNullSafe(F.col("_source"))).where("upto >= rest").groupBy("source").agg(
        F.min(F.struct("slice", "before", "rest")).alias("edge"))
    edge = edge.select(F.col("source").alias("_source"), "edge.*").withColumnRenamed("slice", "_slice")
    last = rows.join(edge, F.col("source").eqNullSafe(F.col("_source")) & (F.col("slice") == F.col("_slice")))
    run = F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("rank"))
    inside = last.select("source", F.abs(run - F.col("rest")).alias("off"), "rank")
    start = edge.select(F.col("_source").alias("source"), F.abs(F.col("before") - F.col("rest")).alias("off"),
                        (F.col("_slice") / F.lit(float(slices))).alias("rank"))
    best = start.unionByName(inside).groupBy("source").agg(F.min(F.struct("off", "rank")).alias("best"))
    return best.select(F.col("source").alias("_source"), F.col("best.rank").alias("cutoff"))


def mixed(docs: DataFrame, most: int = MOST, weights: tuple[int, ...] = (1, 2, 3), seed: int = 7, slices: int = 65_536) -> DataFrame:
    """Add size, source_size, target and copies to every document; ``copies`` times the document is in the mix.

    Every document of a source gets floor(target / source_size) certain copies. The rest of the target is a Pareto order
    sample with unequal probabilities: documents rank by random odds over ``inclusion_odds``, which grow with the root of
    their size, and the head of the ranking whose words come nearest to the rest gets one copy more (the size of the
    sample is fixed in words). No document exceeds ``most`` copies.

    A source may hold any share of the rows: sums are combined before they move, and the sample is applied as one cutoff
    per source, so texts never move. Reruns agree: the random number is a hash of doc_id and text, and rows equal in both
    are taken together. Null text has size 0; a null source is a source of its own; documents of size 0 follow the same
    ranking and add no words. An empty table gives no rows. Columns with the four added names are replaced.
    """
    added = ("size", "source_size", "target", "copies")
    rows = docs.select(*[c for c in docs.columns if c not in added]).withColumn("size", words(F.col("text")))
    rows = rows.withColumn("_mix_u", random_number(F.col("doc_id"), F.col("text"), seed))
    sums = stored(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("_n")), "mix-sums")
    plan = targets(sums.drop("_n"), most, weights)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.withColumn("whole", F.least(F.floor(ratio + F.lit(1e-12)), F.lit(most)).cast("int"))
    plan = plan.withColumn("part", F.greatest(ratio - F.col("whole"), F.lit(0.0)))
    counts = sums.select(F.col("source").alias("_source"), "_n")
    plan = plan.join(counts, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    plan = stored(plan.withColumn("mean", F.when(F.col("_n") > 0, F.col("source_size").cast("double") / F.col("_n"))).drop("_n"), "mix-plan")
    def rank(part: str, mean: str) -> Column:
        return F.when(F.col(part) > 0, pareto_rank(F.col("_mix_u"), inclusion_odds(F.col(part), F.col("size"), F.col(mean))))

    shared = plan.where("part > 0 and source_size > 0").select(F.col("source").alias("_mix_name"), "part", "mean")
    ranked = rows.select("source", "size", "_mix_u").join(shared, F.col("source").eqNullSafe(F.col("_mix_name")))
    cut = cutoffs(ranked.select("source", "size", rank("part", "mean").alias("rank")), plan, slices)
    plan = plan.join(cut, F.col("source").eqNullSafe(F.col("_source")), "left").select(
        F.col("source").alias("_mix_name"), "source_size", "target", *(F.col(c).alias(f"_mix_{c}") for c in ("whole", "part", "mean", "cutoff")))
    plan = stored(plan, "mix-cutoffs")
    taken = rows.join(plan, F.col("source").eqNullSafe(F.col("_mix_name")))
    extra = F.coalesce(rank("_mix_part", "_mix_mean") <= F.col("_mix_cutoff"), F.lit(False)).cast("int")
    return taken.withColumn("copies", F.col("_mix_whole") + extra).drop("_mix_u", *(c for c in plan.columns if c.startswith("_mix_")))
