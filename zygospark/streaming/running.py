"""Running results of streams: zygosity counts per kit, event counts per window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from zygospark.operators.summary import zygosity_tallies
from zygospark.schema import CALLS


def call_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Calls that land as Parquet files in a folder."""
    return spark.readStream.schema(CALLS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def running_zygosity(calls: DataFrame) -> DataFrame:
    """Zygosity counts per kit of all calls so far; the state is one row for each kit."""
    return calls.groupBy("kit").agg(*zygosity_tallies())


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) per time window; state of windows older than `late` is dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return timed.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def keep_latest(updates: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write the changed rows of every batch; a batch that runs again replaces its own rows."""

    def run(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = updates.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(run)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest(spark: SparkSession, out: str, *key: str) -> DataFrame:
    """The newest row of each key among what keep_latest wrote."""
    rows = spark.read.parquet(out)
    values = [c for c in rows.columns if c not in (*key, "batch")]
    newest = rows.groupBy(*key).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return newest.select(*key, "v.*")
