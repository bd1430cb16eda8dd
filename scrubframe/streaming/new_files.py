"""New text boxes appended as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructType

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
RUN = T.StructField("_run", T.LongType())


def read_landing(spark: SparkSession, schema: StructType, path: str, max_files: int = 1000) -> DataFrame:
    """Stream of parquet files; ``max_files`` bounds one micro-batch, not the whole run."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def _first_runs(spark: SparkSession, out: str, checkpoint: str) -> None:
    """Bring the state up to date: per filename the first run that brought it.

    The state is an aggregation in RocksDB, combined before its shuffle, so a file with very many rows costs one small record
    per task and the history is never read again. A batch that is repeated replaces its own folder.
    """
    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("first").parquet(f"{out}/names/batch_id={batch_id}")

    before = {k: spark.conf.get(k, None) for k in STATE}
    try:
        for k, v in STATE.items():
            spark.conf.set(k, v)
        arrived = spark.readStream.schema(T.StructType([T.StructField("filename", T.StringType()), RUN])).parquet(f"{out}/arrived")
        names = arrived.groupBy("filename").agg(F.min("_run").alias("first"))
        (names.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{checkpoint}/names")
         .trigger(availableNow=True).start().awaitTermination())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stream_new_files(stream: DataFrame, out: str, checkpoint: str, run: int) -> DataFrame:
    """Take in all that has landed and store the rows of files that no earlier run brought; returns the rows of this run.

    ``run`` numbers the runs upwards; a run that was broken off is repeated under its number. Rows of one file may come in any
    number of batches of a run. Three steps, each of which may be repeated: rows are appended with the number of their run
    (exactly once, by the sink's log), the state learns the first run of each filename, and the rows whose filename began
    with this run are stored. A null filename counts as a name.
    """
    spark = stream.sparkSession
    (stream.withColumn("_run", F.lit(run).cast("bigint")).writeStream.format("parquet").partitionBy("_run").option("path", f"{out}/arrived")
     .option("checkpointLocation", f"{checkpoint}/arrived").trigger(availableNow=True).start().awaitTermination())
    _first_runs(spark, out, checkpoint)
    schema = T.StructType([*stream.schema.fields, RUN])
    rows = spark.read.schema(schema).parquet(f"{out}/arrived").where(F.col("_run") == run).drop("_run")
    names = spark.read.schema("filename string, batch_id bigint, first bigint").parquet(f"{out}/names").where(F.col("first") == run)
    names = names.select(F.col("filename").alias("_name")).distinct()
    fresh = rows.join(names, rows["filename"].eqNullSafe(names["_name"]), "left_semi")
    fresh.write.mode("overwrite").parquet(f"{out}/rows/run={run}")
    return spark.read.schema(stream.schema).parquet(f"{out}/rows/run={run}")


def read_stored(spark: SparkSession, out: str) -> DataFrame:
    """Everything stored so far."""
    return spark.read.parquet(f"{out}/rows").drop("run")
