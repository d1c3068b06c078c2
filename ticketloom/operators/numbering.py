"""Dense numbers over a total order, without one task that sees every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: monotonically_increasing_id() holds the row's place in its partition in the low bits and the partition above them.
PLACE_BITS = 33


def numbered(df: DataFrame, by: list[Column], name: str = "seq", first: int = 1) -> DataFrame:
    """df with first, first + 1, ... in the order of `by` in the column `name`.

    Rows are dealt out by ranges of `by` and sorted within each range; the ranges' sizes (one row for each partition) give each range
    its offset by a prefix sum. Rows that are equal in all of `by` get numbers next to each other, in an order that is fixed once by
    the checkpoint."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = cut(df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_place", F.monotonically_increasing_id()))
    part, offset = F.shiftrightunsigned("_place", PLACE_BITS), first
    offsets = []
    for r in sorted_.groupBy(part.alias("part")).count().orderBy("part").collect():  # a row for each partition
        offsets.append((r["part"], offset))
        offset += r["count"]
    starts = spark.createDataFrame(offsets, "_part long, _start long")
    inside = F.col("_place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return sorted_.join(F.broadcast(starts), part == F.col("_part")).withColumn(name, F.col("_start") + inside).drop("_place", "_part", "_start")
