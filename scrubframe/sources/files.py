"""File lists, manifests, object listings and rule files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrubframe.operators.rules import Rule
from scrubframe.session import broadcast_if_small

# Fixed value: names that are never images.
NOT_IMAGES = r"(README|\.txt|\.md|\.csv)[^/]*$"


def list_files(spark: SparkSession, roots: list[str], skip: str = NOT_IMAGES) -> DataFrame:
    """Recursive listing without reading any content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots)
    return files.select("path", "length", "modificationTime").where(~F.col("path").rlike(skip))


def resolve_manifest(manifest: DataFrame, listing: DataFrame, prefixes: list[str]) -> DataFrame:
    """Existing paths named by a manifest; relative names are tried under every prefix.

    Object URLs are kept as they are: they are not part of a file listing.
    """
    names = [F.col(c) for c in ("filename", "DicomFilePath") if c in manifest.columns]
    name = F.coalesce(*names)
    remote = manifest.where(name.contains("s3://")).select(name.alias("path"))
    under = F.array(*(F.concat(F.lit(p.rstrip("/") + "/"), name) for p in prefixes))
    paths = manifest.where(~name.contains("s3://")).select(F.explode(F.when(name.startswith("/"), F.array(name)).otherwise(under)).alias("path"))
    return paths.join(listing.select("path"), "path", "left_semi").unionByName(remote)


def find_path(tags: DataFrame, name: str, order: tuple[str, ...] = ("DX", "CR")) -> DataFrame:
    """First path containing ``name``, modalities tried in the given order; no row when there is none."""
    rank = F.array_position(F.array(*(F.lit(m) for m in order)), F.col("modality"))
    rows = tags.where(F.col("path").contains(name) & (rank > 0))
    return rows.agg(F.min(F.struct(rank.alias("_r"), F.col("path"))).alias("_m")).where("_m is not null").select(F.col("_m.path").alias("path"))


def series_manifest(csv: DataFrame | None, studies: list[str] | None = None, series: list[str] | None = None,
                    cap: int | None = None, spark: SparkSession | None = None) -> DataFrame:
    """Study/series prefixes to load; with ``cap`` (the size limit of one manual load) the first so many in order.

    Equally many studies and series are paired; studies or series alone are looked up in the
    table; without either the whole table is used.
    """
    prefix = F.concat(F.col("study"), F.lit("/"), F.col("series"), F.lit("/"))
    if studies and series and len(studies) == len(series):
        session = spark or csv.sparkSession
        pairs = session.createDataFrame(list(zip(studies, series)), "study string, series string")
        found = pairs.select(F.concat("study", F.lit("/"), "series").alias("prefix"))
    elif csv is None:
        found = spark.createDataFrame([(f"{s}/",) for s in studies or []], "prefix string")
    else:
        rows = csv
        if series:
            rows = series_lookup(csv, series)
        elif studies:
            rows = csv.where(F.col("study").isin(*studies))
        found = rows.select(prefix.alias("prefix"))
    return found.distinct() if cap is None else found.distinct().orderBy("prefix").limit(cap)


def series_lookup(csv: DataFrame, series: list[str] | DataFrame) -> DataFrame:
    """Rows of the given series, from a list or from a table."""
    if isinstance(series, DataFrame):
        return csv.join(broadcast_if_small(series.select("series").distinct()), "series", "left_semi")
    return csv.where(F.col("series").isin(*series))


def list_series_objects(keys: DataFrame, key: str = "key") -> DataFrame:
    """Objects by study/series, one row each; keys in the root are ignored.

    Rows stay separate, so a series of any size is never gathered into one value.
    """
    parts = F.split(F.col(key), "/")
    return keys.where(F.size(parts) >= 3).select(
        F.concat(F.get(parts, F.lit(0)), F.lit("/"), F.get(parts, F.lit(1))).alias("study_series"),
        F.get(parts, F.lit(2)).alias("sop"))


def list_objects_capped(keys: DataFrame, n: int, key: str = "key") -> DataFrame:
    """First ``n`` keys in order; each task keeps only its own first ``n``."""
    return keys.select(key).orderBy(key).limit(n)


def src_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of recipe files: (file, rule_no, label, predicates, boxes); ``rule_no`` rises in the order of the text.

    Read rule by rule, never as whole files. What stands before the first rule of a file goes on with the last rule of an
    earlier file, as ``snk_rules`` writes it; remarks and unknown lines there have no effect.
    """
    records = spark.read.option("lineSep", "\nLABEL ").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"), "value")
    place = F.struct("file", "_at", "_id")
    first = F.col("value").rlike(r"^\s*LABEL[ \t]+")
    records = records.withColumn("_begins", F.min(place).over(Window.partitionBy("file")) == place).withColumn("_place", place)
    blocks = records.withColumn("_tail", F.col("_begins") & ~first).withColumn("_b", F.regexp_replace("value", r"^\s*LABEL[ \t]+", ""))
    # One row per file: its last rule, and what it begins with.
    per_file = blocks.groupBy("file").agg(F.max(F.when(~F.col("_tail"), F.col("_place"))).alias("_last"), F.max(F.when(F.col("_tail"), F.col("_b"))).alias("_more"))
    before = F.last("_last", True).over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    tails = per_file.withColumn("_place", before).where("_more is not null and _place is not null")
    tails = tails.groupBy("_place").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", "_more"))), lambda s: s["_more"]), "\n").alias("_more"))
    rules = blocks.where("not _tail").join(tails, "_place", "left")
    whole = rules.select("file", F.col("_id").alias("rule_no"), F.concat_ws("\n", "_b", "_more").alias("_b"))
    lines = F.filter(F.transform(F.split("_b", "\n"), lambda s: F.trim(F.regexp_replace(s, r"#.*$", ""))),
                     lambda s: s != "")
    rows = whole.withColumn("_l", lines)
    bare = F.transform(F.slice("_l", 2, F.greatest(F.size("_l"), F.lit(1))), lambda s: F.regexp_replace(s, r"^\+\s*", ""))

    def word(s: Column, i: int) -> Column:
        return F.regexp_extract(s, r"^(\S+)\s*(\S*)\s*(.*)$", i)

    predicates = F.transform(F.filter(bare, lambda s: word(s, 1).isin("present", "contains", "equals")),
                             lambda s: F.struct(word(s, 1).alias("op"), word(s, 2).alias("tag"), word(s, 3).alias("value")))
    boxes = F.transform(F.filter(bare, lambda s: word(s, 1).isin("coordinates", "keepcoordinates")),
                        lambda s: F.struct(F.when(word(s, 1) == "coordinates", "redact").otherwise("keep").alias("kind"),
                                           word(s, 2).alias("coords")))
    return rows.select("file", "rule_no", F.get("_l", F.lit(0)).alias("label"),
                       predicates.alias("predicates"), boxes.alias("boxes"))


def src_rule_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line of rule files as it stands, with the line that begins its rule: (label, line).

    A rule may go on in later files, so a line without a label before it in its part of a file belongs to the last rule of an
    earlier part. Only one label per part is compared across parts.
    """
    part = ["file", "_at"]
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"),
                                        F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    rows = rows.withColumn("_label", F.when(F.col("line").rlike(r"^LABEL[ \t]"), F.col("line")))
    last = rows.groupBy(*part).agg(F.max(F.when(F.col("_label").isNotNull(), F.struct("_id", "_label"))).alias("_last"))
    before = F.last("_last", True).over(Window.orderBy(*part).rowsBetween(Window.unboundedPreceding, -1))
    last = last.select(*part, before["_label"].alias("_before"))
    own = F.last("_label", True).over(Window.partitionBy(*part).orderBy("_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("_own", own).join(last, part).select(F.coalesce("_own", "_before").alias("label"), "line")


def collect_rules(rules: DataFrame) -> list[Rule]:
    """Rules of recipe files for ``match_rules``. Recipes are hand-written configuration."""
    rows = rules.orderBy("file", "rule_no").collect()
    return [Rule(r.label, tuple((p.op, p.tag, p.value) for p in r.predicates),
                 tuple((b.kind, b.coords) for b in r.boxes)) for r in rows]
