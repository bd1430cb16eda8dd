"""Exact deduplication as a chain of two incremental streams with disk-backed keyed state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubframe.llm.common import ascii_lower, join_counted, maybe_in, shared_folder, stored

#: State on disk, changes rather than whole copies in the shared folder, and no space set aside in advance per partition.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
BATCH_BYTES = 256 << 30


def normal(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def located(docs: DataFrame) -> DataFrame:
    """doc_id, locator (file and row) and normalised text of rows read from Parquet."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return docs.select("doc_id", place.alias("locator"), normal(F.col("text")).alias("text"))


def _read_stream(spark: SparkSession, path: str, batch: int) -> DataFrame:
    """A stream over the files at ``path``, a folder or one file.

    The file source takes one file only as a pattern. A folder is read by its plain path: for a pattern the source would
    take every file in it, also those that a stream's sink did not commit.
    """
    schema = spark.read.parquet(path).schema
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    single = store.exists(at) and store.getFileStatus(at).isFile()
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", str(batch)).parquet(f"{path[:-1]}[{path[-1]}]" if single else path)


def _finish(writer) -> None:
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


def digest_log(spark: SparkSession, path: str, root: str, digest: Callable[[Column], Column] = sha256, batch: int = BATCH_BYTES) -> str:
    """Stream new files of documents into a log of (doc_id, locator, digest); returns the log's folder.

    The locator is the file and the row in it, so the bytes of a document can be found again.
    """
    log = located(_read_stream(spark, path, batch)).select("doc_id", "locator", digest(F.col("text")).alias("digest"))
    _finish(log.writeStream.format("parquet").option("path", f"{root}/log").option("checkpointLocation", f"{root}/log-progress"))
    return f"{root}/log"


def digest_state(spark: SparkSession, log: str, root: str, batch: int = BATCH_BYTES) -> DataFrame:
    """Stream the log into keyed state without expiry: per digest the number of rows, the largest doc_id and its locator.

    The state lives in RocksDB on the executors' disks, with its changes in the shared folder; it is read back from there.
    """
    kept = {k: spark.conf.get(k, None) for k in STATE}
    try:
        for k, v in STATE.items():
            spark.conf.set(k, v)
        state = _read_stream(spark, log, batch).groupBy("digest").agg(
            F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "locator")).alias("stays"))
        _finish(state.writeStream.format("noop").outputMode("update").option("checkpointLocation", f"{root}/state"))
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    found = spark.read.format("statestore").load(f"{root}/state")
    value = found.schema["value"].dataType.fieldNames()
    return found.select(F.col("key")[found.schema["key"].dataType.fieldNames()[0]].alias("digest"),
                        F.col("value")[value[0]].alias("n"), F.col("value")[value[1]].alias("stays"))


def check_bytes(docs: DataFrame, state: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Compare the full bytes of all rows whose digest was hit more than once.

    Returns digest, text, n and stays for the digests that cover several texts: normally none. Rows of one digest and one
    text are combined in each task before they move, so a group of copies of any size costs a row per task. A bit map of
    fixed size keeps rows of other digests from moving.
    """
    repeated = state.where("n > 1").select("digest", "n")
    rows = maybe_in(located(docs).withColumn("digest", digest(F.col("text"))), repeated, ["digest"]).where("_maybe").drop("_maybe")
    hits = rows.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "locator")).alias("stays"))
    texts = hits.join(repeated.select("digest"), "digest", "left_semi")
    several = texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest")
    return texts.join(several, "digest", "left_semi")


def exact_dedup(spark: SparkSession, path: str, root: str | None = None, digest: Callable[[Column], Column] = sha256,
                batch: int = BATCH_BYTES) -> DataFrame:
    """For every row of the documents at ``path``: which row of equal text stays.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. The largest doc_id stays; null
    sorts below every number and, among rows with that same doc_id, the one with the largest file and row stays, so of a
    row repeated in full exactly one is kept. Other columns are not read. Calling again with the same ``root`` takes in
    only files that are new. Columns: doc_id, locator, keep_id, group_size, kept, digest (of the normalised text).
    An empty folder with a schema gives no rows.
    """
    root = root or shared_folder(spark, "exact")
    log = digest_log(spark, path, root, digest, batch)
    state = digest_state(spark, log, root, batch)
    docs = spark.read.parquet(path)
    clashes = stored(check_bytes(docs, state, digest), "clashes")
    done = join_counted(spark.read.parquet(log), state, "digest", "n").select("doc_id", "locator", "n", "stays", "digest")
    if not clashes.isEmpty():
        bad = clashes.select("digest").distinct()
        texts = located(docs).withColumn("digest", digest(F.col("text")))
        again = texts.join(bad, "digest", "left_semi").join(clashes, ["digest", "text"]).select(*done.columns)
        done = done.join(bad, "digest", "left_anti").select(*done.columns).unionByName(again)
    return done.select("doc_id", "locator", F.col("stays.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
                       (F.col("locator") == F.col("stays.locator")).alias("kept"), "digest")
