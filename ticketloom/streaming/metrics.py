"""Windowed metrics over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import BUCKETS


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, event_type, n, total over tumbling windows; events: ts, event_type, value. Rows later than the watermark are dropped, so
    that the state stays bounded."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what there is and stop."""
    df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def bucket_counts(events: DataFrame, value: str, by: list[str], bounds: tuple[float, ...] = BUCKETS, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """start, by, le_0, le_1, ..., n, total of each window so far: the state is one row of cumulative counts for each open window and group.
    events: ts, value and by. Rows later than the watermark are dropped, so that the state stays bounded."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), *by)
    counts = [F.count(F.when(F.col(value) <= b, 1)).alias(f"le_{i}") for i, b in enumerate(bounds)]
    return w.agg(*counts, F.count(value).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *by, *(f"le_{i}" for i in range(len(bounds))), "n", "total")


def keep_updates(df: DataFrame, path: str, checkpoint: str) -> None:
    """Processes what there is of bucket_counts and stops. A batch's changed rows are written as path/batch=N, over what an earlier try of the
    batch has left, so that a restart adds nothing twice."""
    save = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")
    df.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def histogram_so_far(spark: SparkSession, path: str, by: list[str], bounds: tuple[float, ...] = BUCKETS) -> DataFrame:
    """by, le, n over all windows, from the last row of each: what metrics.histogram gives for the same events."""
    rows = spark.read.parquet(path)
    counts = [f"le_{i}" for i in range(len(bounds))] + ["n"]
    last = rows.groupBy("start", *by).agg(F.max_by(F.struct(*counts), "batch").alias("c")).select(*by, "c.*")
    per = last.groupBy(*by).agg(*(F.sum(c).alias(c) for c in counts))
    shown = [F.struct(F.lit(f"{b:g}").alias("le"), F.col(c).alias("n")) for b, c in zip(bounds, counts, strict=False)] + [F.struct(F.lit("+Inf").alias("le"), F.col("n"))]
    return per.select(*by, F.inline(F.array(*shown)))
