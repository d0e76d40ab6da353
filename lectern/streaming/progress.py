"""Progress as a stream: event-time windows with a watermark, and the latest state of each run and stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the event files in a folder, their time as TIMESTAMP, which watermarks need."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(start, stage, events, total) of each window; rows later than the watermark are left out."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), F.col("event_type").alias("stage"))
    return grouped.agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "stage", "events", "total")


def latest(events: DataFrame) -> DataFrame:
    """The last event of each run and stage, kept as streaming aggregation state."""
    state = events.groupBy(F.col("user_id").alias("run"), F.col("event_type").alias("stage"))
    return state.agg(F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("e")).select("run", "stage", F.col("e.event_id").alias("seq"), F.col("e.value").alias("value"))


def drained(frame: DataFrame, folder: str, mode: str) -> DataFrame:
    """All that is there, run to its end into a Parquet table under `folder`: in complete mode each batch replaces the
    table, else it adds to it. Nothing is gathered on the driver, and a batch that is run again writes the same."""
    spark, out = frame.sparkSession, f"{folder}/table"
    spark.createDataFrame([], frame.schema).write.parquet(out)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    query = frame.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(frame.schema).parquet(out).select(*frame.columns)
