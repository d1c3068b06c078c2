"""Counters, latency histograms and percentiles over request and parse events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Upper bounds of the latency buckets, seconds.
BUCKETS = (0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 3.0, 5.0, 10.0)


def counters(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, value: str, by: list[str] = (), bounds: tuple[float, ...] = BUCKETS) -> DataFrame:
    """by, le, n: cumulative counts, one aggregation for all buckets; null values are left out."""
    counts = [F.count(F.when(F.col(value) <= b, 1)).alias(f"_{i}") for i, b in enumerate(bounds)] + [F.count(value).alias("_all")]
    rows = F.array(*(F.struct(F.lit(f"{b:g}").alias("le"), F.col(f"_{i}").alias("n")) for i, b in enumerate(bounds)), F.struct(F.lit("+Inf").alias("le"), F.col("_all").alias("n")))
    return df.groupBy(*by).agg(*counts).select(*by, F.inline(rows))


def totals(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """by, n, total: what a histogram's buckets don't say; null values are left out."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.coalesce(F.sum(value), F.lit(0.0)).alias("total"))


def summary(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """by, n, min, p50, p95, max, of groups with two values at least (the exclusive definition has no percentile of one)."""
    ends = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.min(value).alias("min"), F.max(value).alias("max"))
    p50, p95 = (exclusive_percentile(df, value, p, by).withColumnRenamed("value", f"p{p * 100:g}") for p in (0.5, 0.95))
    on = lambda a, b: [a[c].eqNullSafe(b[c]) for c in by]
    both = p50.join(p95, on(p50, p95)).select(*(p50[c] for c in by), p50["n"], "p50", "p95")
    return both.join(ends, on(both, ends)).select(*(both[c] for c in by), "n", "min", "p50", "p95", "max")


def exclusive_percentile(df: DataFrame, value: str, p: float, by: list[str]) -> DataFrame:
    """by, n, value at rank p * (n + 1), interpolated between neighbours (the exclusive definition, which Spark's percentile isn't);
    null for fewer than two values."""
    rows = df.select((F.struct(*by) if by else F.lit(0)).alias("_g"), F.col(value).cast("double").alias("_v")).where("_v is not null")
    k = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(rows.approxQuantile("_v", [i / k for i in range(1, k)], 1 / (4 * k)))) if k > 1 else []
    # Equal values are one row, and a range of values is one task: no task ranks a whole group.
    bucket = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: F.col("_v") > b)) if bounds else F.lit(0)
    counts = rows.groupBy("_g", "_v").agg(F.count("*").alias("_c")).withColumn("_b", bucket)
    w = Window.partitionBy("_g")
    sums = counts.groupBy("_g", "_b").agg(F.sum("_c").alias("_s"))
    sums = sums.select("_g", "_b", "_s", (F.sum("_s").over(w.orderBy("_b")) - F.col("_s")).alias("_base"), F.sum("_s").over(w).alias("n")).where("n > 1")
    pos = F.lit(p) * (F.col("n") + 1)
    low: Column = F.least(F.greatest(F.floor(pos), F.lit(1)), F.col("n") - 1)
    held = sums.withColumns({"_low": low, "_pos": pos}).where("_base <= _low and _base + _s >= _low")  # those with either rank
    ranked = counts.join(held, ["_g", "_b"]).withColumn("_to", F.col("_base") + F.sum("_c").over(Window.partitionBy("_g", "_b").orderBy("_v")))
    pick = lambda at: F.max(F.when((F.col("_to") - F.col("_c") < at) & (F.col("_to") >= at), F.col("_v")))
    out = ranked.groupBy("_g", "n", "_low", "_pos").agg(pick(F.col("_low")).alias("_a"), pick(F.col("_low") + 1).alias("_z"))
    return out.select(*(F.col("_g")[c].alias(c) for c in by), "n", (F.col("_a") + (F.col("_pos") - F.col("_low")) * (F.col("_z") - F.col("_a"))).alias("value"))
