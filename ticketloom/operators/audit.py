"""Append-only log with a hash chain: linking, verification, search, masking, export.

A chain is sequential by nature. One chain for each key (an actor, a day) keeps the work parallel; each record's hash covers
its own content and the hash before it, so verification needs no fold: the hash before is a lag over the stored hashes.

A record's hash is SHA-256 of the canonical JSON of all its columns but the hash itself, the hash before among them in its place by name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

from ..functions.canonical import joined, json_text, members
from ..functions.text import formula_safe, mask_pan

GENESIS = "0" * 64
# The columns of a record, in export order.
COLUMNS = (
    "seq occurred_at action outcome error actor_type actor_id actor_name entity_type entity_id details request_id ip_address user_agent event_id "
    "prev_hash row_hash"
).split()
MASKED = ("actor_name", "error", "details")


def scrub(df: DataFrame) -> DataFrame:
    """Personal account numbers masked where free text stands, user agents cut to 512 characters."""
    new = {c: mask_pan(c) for c in MASKED if c in df.columns}
    if "user_agent" in df.columns:
        new["user_agent"] = F.substring("user_agent", 1, 512)
    return df.withColumns(new)


def around(df: DataFrame, columns: list[str]) -> tuple[Column, Column]:
    """Canonical JSON of a record's columns, as the text before and behind the hash of the record before."""
    fields = [(c, F.col(c), df.schema[c].dataType) for c in columns]
    before, behind = ([f for f in fields if (f[0] < "prev_hash") == first] for first in (True, False))
    comma = lambda f: F.lit("," if f else "")
    return F.concat(F.lit("{"), joined(members(before)), comma(before), F.lit('"prev_hash":"')), F.concat(F.lit('"'), comma(behind), joined(members(behind)), F.lit("}"))


def link(df: DataFrame, key: str, columns: list[str], heads: DataFrame | None = None) -> DataFrame:
    """df with prev_hash and row_hash: a chain for each key by seq. heads (the key, head): hashes that chains go on from. A key's records
    are sorted in one task, which spills, and streamed with only the last hash held."""
    at, width = df.columns.index(key), len(df.columns)
    before, behind = around(df, columns)
    shaped = df.withColumns({"_a": before, "_z": behind})
    if heads is None:
        shaped = shaped.withColumn("_head", F.lit(GENESIS))
    else:
        known = heads.select(F.col(key).alias("_key"), F.col("head").alias("_known"))
        shaped = shaped.join(known, F.col(key).eqNullSafe(F.col("_key")), "left").withColumn("_head", F.coalesce("_known", F.lit(GENESIS))).drop("_key", "_known")
    shaped = shaped.repartition(key).sortWithinPartitions(key, "seq", "_a", "_z")
    schema = StructType([*df.schema.fields, StructField("prev_hash", StringType()), StructField("row_hash", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, last = object(), GENESIS
        for b in batches:
            prev, own = [], []
            for k, a, z, head in zip(b.column(at).to_pylist(), *(b.column(width + i).to_pylist() for i in range(3)), strict=True):
                if k != of:
                    of, last = k, head
                prev.append(last)
                last = hashlib.sha256((a + last + z).encode()).hexdigest()
                own.append(last)
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(prev, pa.string()), pa.array(own, pa.string())], names=[*b.schema.names[:width], "prev_hash", "row_hash"])

    return shaped.mapInArrow(run, schema)


def verify(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, checked, first_bad_seq, reason, last_hash: the link is checked before the hash, and checking stops at the first fault."""
    w = Window.partitionBy(key).orderBy("seq")
    seen = df.withColumn("_before", F.lag("row_hash", 1, GENESIS).over(w))
    before, behind = around(df, columns)
    fault = F.when(F.col("prev_hash") != F.col("_before"), "prev_hash_mismatch").when(F.sha2(F.concat(before, F.col("prev_hash"), behind), 256) != F.col("row_hash"), "row_hash_mismatch")
    first = F.min(F.when(F.col("_fault").isNotNull(), F.struct("seq", "_fault"))).over(Window.partitionBy(key))
    marked = seen.withColumn("_fault", fault).withColumn("_first", first)
    good = F.col("_first").isNull() | (F.col("seq") < F.col("_first.seq"))
    return marked.groupBy(key).agg(
        (F.count(F.when(good, 1)) + F.max(F.when(F.col("_first").isNotNull(), 1).otherwise(0))).alias("checked"), F.first("_first")["seq"].alias("first_bad_seq"),
        F.first("_first")["_fault"].alias("reason"), F.max_by("row_hash", F.when(good, F.col("seq"))).alias("last_hash"),
    )


def beyond(prefix: str) -> str:
    """The least text that is greater than every text with this prefix."""
    step = 2049 if prefix[-1] == chr(0xD7FF) else 1  # over the surrogates
    return prefix[:-1] + chr(ord(prefix[-1]) + step)


def search(df: DataFrame, *, after: str | None = None, before: str | None = None, **equal: str) -> DataFrame:
    """Records by equality and by ISO prefixes of occurred_at (a day or an hour stands for all of it). A prefix is a half-open range on
    the column as it is stored, so that scans get it pushed down and skip row groups."""
    for c, v in equal.items():
        if v is not None:
            df = df.where(F.col(c) == v)
    if after:
        df = df.where(F.col("occurred_at") >= after)
    if before:
        df = df.where(F.col("occurred_at") < beyond(before))
    return df


def check_page(limit: int, offset: int) -> None:
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must be 1 to 500 and offset not negative")


def page(df: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest first."""
    check_page(limit, offset)
    return df.orderBy(F.col("seq").desc()).offset(offset).limit(limit)


def page_with_total(df: DataFrame, limit: int = 50, offset: int = 0) -> tuple[list[Row], int]:
    """The page's rows, newest first, and how many records there are in all: one pass, the count is observed while the best rows are kept."""
    check_page(limit, offset)
    seen = Observation()
    rows = page(df.observe(seen, F.count(F.lit(1)).alias("n")), limit, offset).collect()  # 500 at most
    return rows, seen.get["n"]


def export_rows(df: DataFrame) -> DataFrame:
    """The fixed columns, oldest first, text safe for spreadsheets; maps and structs as JSON with sorted keys."""

    def cell(c: str) -> Column:
        t = df.schema[c].dataType
        if isinstance(t, StringType):
            return formula_safe(c).alias(c)
        return (F.when(F.col(c).isNotNull(), json_text(F.col(c), t, " ")) if isinstance(t, (StructType, MapType, ArrayType)) else F.col(c)).alias(c)

    return df.select(*(cell(c) for c in COLUMNS if c in df.columns)).orderBy("seq")


def write_csv(df: DataFrame, path: str) -> None:
    """Export as CSV part files with headers, each with a byte order mark so that spreadsheets read UTF-8."""
    out = export_rows(df)
    first = out.columns[0]
    shown = out.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in out.columns)).withColumnRenamed(first, "\ufeff" + first)
    shown.write.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)
