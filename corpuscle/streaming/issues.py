"""Issue streams: windowed counts over an unbounded table of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.util import fresh_path, table


def source(spark: SparkSession, sf_dir: str, name: str = "events", files_per_batch: int = 100) -> DataFrame:
    """A table of the driver as a stream of its files."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{sf_dir}/{name}.parquet*")


def daily(events: DataFrame, late: str = "2 days") -> DataFrame:
    """(start, detector, n, total): counts and sums by day and type; state goes once the watermark passes a day."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), F.col("event_type").alias("detector"))
    return w.agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total")).select(F.col("w.start").alias("start"), "detector", "n", "total")


def run(result: DataFrame, spark: SparkSession, mode: str = "complete") -> DataFrame:
    """All that a stream has now, processed to the end; every batch's result goes to the shared folder, the last stands."""
    base = fresh_path(spark, "stream")

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/{n}" if mode != "complete" else f"{base}/out")

    q = result.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{base}/out" if mode == "complete" else f"{base}/out/*")
