"""New documents as a stream of files, and jobs' stages as they run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def new_documents(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Rows of new Parquet files with source_hash and the time of their arrival."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("source_hash", F.sha2(F.coalesce("text", F.lit("")), 256)).withColumn("arrived", F.current_timestamp())


def ingest(docs: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append each text once, ever: a batch is reduced to its own first rows and to hashes that the target doesn't have.

    Rows lie in the target under the number of their batch, and a batch that is run again overwrites its own, so nothing
    is appended twice after a failure. No hash is forgotten and the stream holds no state.
    """

    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates(["source_hash"])
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            before = spark.read.option("basePath", target).parquet(target).filter(F.col("batch") != number).select("source_hash")
            rows = rows.join(before, "source_hash", "left_anti")
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return docs.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stage_windows(events: DataFrame, time: str, stage: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """begin, stage, n: events by window; on a stream, rows later than `late` behind the newest are left out."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, width).alias("w"), stage).agg(F.count("*").alias("n")).select(F.col("w.start").alias("begin"), stage, "n")


def live_jobs(events: DataFrame, job: str, time: str, state: str, target: str, checkpoint: str) -> StreamingQuery:
    """Keep target at the latest state of every job: each batch is merged with the version before and written as the next one."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = batch.select(job, time, state)
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        done = sorted(int(s.getPath().getName()[2:]) for s in fs.listStatus(path) if s.getPath().getName().startswith("v=")) if fs.exists(path) else []
        done = [v for v in done if v < number]
        if done:
            now = now.unionByName(spark.read.parquet(f"{target}/v={done[-1]}"))
        latest = now.groupBy(job).agg(F.max(F.struct(time, state)).alias("s")).select(job, f"s.{time}", f"s.{state}")
        latest.write.mode("overwrite").parquet(f"{target}/v={number}")

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
