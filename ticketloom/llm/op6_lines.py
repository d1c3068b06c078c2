"""Line dedup with DataFrame functions only.

Each line that counts becomes a row of 36 bytes (document, position, 128-bit key); these rows are written once, and everything up
to the last join works on them. They are dealt by range of the key and sorted by document and position inside each range; a
window then streams over each key and carries the first document along. The result is a run-length compressed keep bitmap for
each document that loses lines: ``keep_runs`` holds (start, length) of each maximal run of kept lines. Text moves only in the
last join.

A key that holds much more than a partition's share of all lines is hot: its first document comes from a partially aggregated pass,
and its rows are salted by document over the ranges. Which keys are hot is told from the lines of every 16th document (by
hash): that changes how rows are dealt and not what is found. There are at most ``4 * partitions`` hot keys whatever the input,
so they are broadcast.

Defined results: null text is one empty line; a null doc_id never loses lines and never owns one; rows with the same
doc_id are the same document, so they don't make each other's lines repeated, and the owner keeps all its lines. Columns of docs
other than doc_id and text aren't read, or with deduplicated() pass through, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_and_text, partitions, table, written

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS = 10
#: One in so many documents tells hot keys.
SHARE = 16


def line_key(line: Column) -> Column:
    """Stripped of ASCII white space at both ends, A-Z lower-cased; lower() is the faster way to that on ASCII."""
    s = F.btrim(line, F.lit(SPACE))
    return F.when(F.octet_length(s) == F.length(s), F.lower(s)).otherwise(F.translate(s, UPPER, LOWER))


def exploded(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, tkey (tells rows of one doc_id apart), n_lines, pos, h1, h2: a 128-bit key of each line that counts."""
    split = id_and_text(docs).where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("tkey"), F.split("text", "\n", -1).alias("lines"))
    lines = split.select("doc_id", "tkey", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
    keyed = lines.where(F.octet_length("line") >= min_chars).select("doc_id", "tkey", "n_lines", "pos", line_key(F.col("line")).alias("k"))
    return keyed.where(F.length("k") >= min_chars).select(
        "doc_id", "tkey", "n_lines", "pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(7), F.col("k"), F.lit(1)).alias("h2")
    )


def hot_keys(lines: DataFrame) -> DataFrame | None:
    """h1, h2, hot_first (the smallest document) of hot keys: 4 * partitions at most."""
    n = partitions(lines.sparkSession)
    some = lines.where(F.pmod(F.xxhash64("doc_id"), F.lit(SHARE)) == 0)
    counted = some.groupBy("h1", "h2").count().where(F.col("count") > max(some.count() // (4 * n), 1000 // SHARE)).select("h1", "h2")
    hot = [(r["h1"], r["h2"]) for r in counted.collect()]
    if not hot:
        return None
    named = F.broadcast(lines.sparkSession.createDataFrame(hot, "h1 long, h2 long"))
    return lines.join(named, ["h1", "h2"]).groupBy("h1", "h2").agg(F.min("doc_id").alias("hot_first"))


def line_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, tkey, n_dropped, keep_runs array<struct<start,length>>, for documents that lose lines."""
    n = partitions(docs.sparkSession)
    lines = written(exploded(docs, min_chars), "lines")
    hot = hot_keys(lines)
    hot_first = F.lit(None).cast("long") if hot is None else F.col("hot_first")
    known = lines if hot is None else lines.join(F.broadcast(hot), ["h1", "h2"], "left")
    salted = known.withColumn("hot_first", hot_first).withColumn("salt", F.when(F.col("hot_first").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")))
    by = Window.partitionBy("h1", "h2", "salt").orderBy("doc_id", "tkey", "pos")
    first = F.first("doc_id").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    dealt = salted.repartitionByRange(n, "h1", "h2", "salt").select("doc_id", "tkey", "n_lines", "pos", F.coalesce("hot_first", first).alias("first"))
    # a document's positions are gathered as they are and compressed before they meet its text
    lost = dealt.where(F.col("first") != F.col("doc_id")).groupBy("doc_id", "tkey", "n_lines").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))
    return lost.select("doc_id", "tkey", F.size("dropped").alias("n_dropped"), runs(F.col("dropped"), F.col("n_lines")).alias("keep_runs"))


def runs(dropped: Column, n_lines: Column) -> Column:
    """The kept runs between the dropped lines, as array<struct<start,length>>; linear in the dropped lines."""
    ends = F.filter(dropped, lambda x, i: (i == F.size(dropped) - 1) | (F.get(dropped, i + 1) != x + 1))
    starts = F.filter(dropped, lambda x, i: (i == 0) | (F.get(dropped, i - 1) != x - 1))
    begin = F.concat(F.array(F.lit(0)), F.transform(ends, lambda x: x + 1))
    stop = F.concat(starts, F.array(n_lines))
    return F.filter(F.zip_with(begin, stop, lambda b, e: F.struct(b.alias("start"), (e - b).alias("length"))), lambda r: r["length"] > 0)


def with_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, carry: bool = False) -> DataFrame:
    """doc_id, text (null stays null), n_lines, n_dropped, keep_runs (null where no line goes), and with carry the whole input row
    as `row`: one row for each row of docs."""
    own = docs.select(F.struct(*docs.columns).alias("row")) if carry else docs
    keyed = own.select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").cast("string").alias("text")) if carry else id_and_text(own)
    joined = keyed.withColumn("tkey", F.xxhash64("text")).join(line_bitmaps(docs, min_chars), ["doc_id", "tkey"], "left")
    n_lines = F.octet_length("text") - F.octet_length(F.translate("text", "\n", "")) + 1
    return joined.select("doc_id", "text", F.coalesce(n_lines, F.lit(1)).alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"), "keep_runs", *["row"] * carry)


def kept_text() -> Column:
    """The kept lines joined by newline; texts that lose nothing are passed on as they are."""
    lines = F.split("text", "\n", -1)
    kept = F.flatten(F.transform("keep_runs", lambda r: F.slice(lines, r["start"] + 1, r["length"])))
    return F.when(F.col("keep_runs").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept, "\n"))


def deduplicated(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with the repeated lines gone: text (null stays null) and, if there, n_chars are new, all other columns as they are."""
    text = F.when(F.col("text").isNotNull(), kept_text())
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return with_bitmaps(docs, min_chars, carry=True).select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """keep_runs here: start+length of each run of kept lines, parted by commas."""
    whole = F.concat(F.lit("0+"), F.col("n_lines").cast("string"))
    runs_text = F.array_join(F.transform("keep_runs", lambda r: F.concat(r["start"].cast("string"), F.lit("+"), r["length"].cast("string"))), ",")
    return with_bitmaps(table(spark, sf_dir, "documents")).select(
        "doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"),
        F.sha2(kept_text(), 256).alias("kept_sha256"), F.coalesce(runs_text, whole).alias("keep_runs"),
    )


OP6_SQL = r"""
WITH l AS (
  SELECT doc_id, line, pos, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents)
), f AS (SELECT k, min(doc_id) AS first_doc FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT l.doc_id, l.pos, l.line, coalesce(f.first_doc <> l.doc_id, false) AS gone FROM l LEFT JOIN f ON l.k = f.k),
g AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM m WHERE NOT gone),
r AS (SELECT doc_id, min(pos) AS a, count(*) AS n FROM g GROUP BY doc_id, run),
k AS (SELECT doc_id, string_agg(a || '+' || n, ',' ORDER BY a) AS keep_runs FROM r GROUP BY doc_id)
SELECT m.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256, coalesce(any_value(k.keep_runs), '') AS keep_runs
FROM m LEFT JOIN k ON k.doc_id = m.doc_id GROUP BY m.doc_id
"""
