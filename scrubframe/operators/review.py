"""Review state of files: an append-only log of actions and the views derived from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubframe.session import sorted_by


# Sequence numbers per stretch of an action log.
_STRETCH = 65_536


def review_rows(review: DataFrame) -> DataFrame:
    return review


def review_files(review: DataFrame) -> DataFrame:
    return review.select("filename").distinct()


def known_files(rects: DataFrame, review: DataFrame) -> DataFrame:
    """Files having boxes or a review row."""
    return rects.select("filename").union(review.select("filename")).distinct()


def review_state(files: DataFrame, review: DataFrame) -> DataFrame:
    """Add ``state`` (tagged, done or new), ``mark`` and ``comment``."""
    rows = files.join(review.select("filename", "mark", "comment"), "filename", "left")
    state = F.when(F.col("mark"), "tagged").when(F.col("mark").isNotNull(), "done").otherwise("new")
    return rows.withColumn("state", state).withColumn("mark", F.coalesce("mark", F.lit(False)))


def worklist(files: DataFrame, review: DataFrame, tagged_only: bool = False) -> DataFrame:
    """Files still to be reviewed: all that are not done, or the tagged ones only."""
    if tagged_only:
        return files.join(review.where("mark").select("filename"), "filename", "left_semi")
    return files.join(review.where(~F.col("mark")).select("filename"), "filename", "left_anti")


def upsert_review(events: DataFrame) -> DataFrame:
    """Latest mark per file with the latest comment given, from events (filename, seq, mark, comment).

    Both are combinable maxima, so no file's log is gathered or sorted as a whole.
    """
    last = F.max(F.struct("seq", "mark", "last_modified"))
    said = F.max(F.when(F.coalesce("comment", F.lit("")) != "", F.struct("seq", "comment")))
    rows = events.groupBy("filename").agg(last.alias("_last"), said.alias("_said"))
    return rows.select("filename", F.col("_last.mark").alias("mark"), F.col("_said.comment").alias("comment"),
                       F.col("_last.last_modified").alias("last_modified"))


def toggle_mark(events: DataFrame) -> DataFrame:
    """Mark of each file after its events (filename, seq, action in set, clear, toggle).

    The last explicit action gives the mark; the toggles behind it flip it. A file starts
    unmarked.
    """
    explicit = events.where(F.col("action").isin("set", "clear")).groupBy("filename").agg(
        F.max(F.struct("seq", "action")).alias("_set"))
    # Toggles are counted per stretch of sequence numbers before they meet the last explicit
    # action; only the stretch it falls into is compared row by row. The log of one file is
    # thus spread over tasks however long it is.
    stretch = F.floor(F.col("seq") / _STRETCH)
    toggles = events.where(F.col("action") == "toggle").select("filename", "seq", stretch.alias("_stretch"))
    coarse = toggles.groupBy("filename", "_stretch").agg(F.count(F.lit(1)).alias("_n")).join(
        explicit, "filename", "left")
    later = coarse.where(F.col("_set").isNull() | (F.col("_stretch") > F.floor(F.col("_set.seq") / _STRETCH)))
    border = explicit.select("filename", F.floor(F.col("_set.seq") / _STRETCH).alias("_stretch"),
                             F.col("_set.seq").alias("_at"))
    same = toggles.join(border, ["filename", "_stretch"]).where("seq > _at").groupBy("filename").agg(
        F.count(F.lit(1)).alias("_n"))
    flips = (later.select("filename", "_n").unionByName(same)
             .groupBy("filename").agg(F.sum("_n").alias("_flips")))
    files = events.where(F.col("action").isin("set", "clear", "toggle")).select("filename").distinct()
    rows = files.join(explicit, "filename", "left").join(flips, "filename", "left")
    start = F.coalesce(F.col("_set.action") == "set", F.lit(False))
    odd = F.coalesce(F.col("_flips") % 2 == 1, F.lit(False))
    return rows.select("filename", (start != odd).alias("mark"))


def mark_done(files: DataFrame, review: DataFrame) -> DataFrame:
    """Review rows to append: one unmarked row for each file that has none yet."""
    new = files.select("filename").distinct().join(review.select("filename"), "filename", "left_anti")
    return new.select("filename", F.lit(False).alias("mark"), F.lit(None).cast("string").alias("comment"))


def remove_file(rects: DataFrame, review: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the given files."""
    gone = files.select("filename").distinct()
    return rects.join(gone, "filename", "left_anti"), review.join(gone, "filename", "left_anti")


def relabel(events: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Current label per key from events (PK, seq, Label, checked_at); an empty correction keeps the old label.

    ``labels`` restricts the result to keys whose first label is one of these.
    """
    given = F.coalesce("Label", F.lit("")) != ""
    rows = events.groupBy("PK").agg(
        F.min(F.when(given, F.struct("seq", "Label"))).alias("_first"),
        F.max(F.when(given, F.struct("seq", "Label"))).alias("_last"),
        F.max(F.struct("seq", "checked_at")).alias("_check"))
    if labels:
        rows = rows.where(F.col("_first.Label").isin(*labels))
    return rows.select("PK", F.col("_last.Label").alias("Label"), F.col("_check.checked_at").alias("Check_datetime"))


def order_by_last_modified(df: DataFrame) -> DataFrame:
    return sorted_by(df, "last_modified")


def limit_manifest(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first ``n`` rows of a download list in a given order; each task keeps only its own first ``n``."""
    return df.orderBy(*order, *[c for c in df.columns if c not in order]).limit(n)


def label_frequency(labels: DataFrame, label: str = "Label") -> DataFrame:
    """Rows per label with the overall progress in percent; unlabelled rows are the null label.

    The labels are counted first, so the total is taken over a handful of counts.
    """
    counts = labels.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    done = F.sum(F.when(F.col(label).isNotNull(), F.col("n")).otherwise(0))
    percent = counts.select(F.round(done / F.sum("n") * 100).cast("int")).scalar()
    return counts.select(label, "n", percent.alias("progress"))
