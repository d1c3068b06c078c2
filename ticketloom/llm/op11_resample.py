"""Importance resampling towards a target distribution, with exact selection by radix digits.

A text's features are its runs of 1 to 3 words, hashed to buckets. A bucket's gain is the log ratio of its share in the target texts and
its share in all documents; a document's weight is the sum of its features' gains. Seeded Gumbel noise is added, and the documents
with the highest scores are drawn: sampling without replacement with odds of exp(weight).

Two passes read the texts: one counts buckets (each task sends one count for each bucket), one adds up gains. No n-gram is ever a
string: the CRC of "a b" follows from those of "a", of " b" and the length of " b", by a linear map of the register that is looked up in tables.

The draw is exact and sorts nothing but what it draws. The key of a row is (score, doc_id, row number), as 64-bit words of 16-bit
digits. Counts of one digit among the rows that share the digits fixed so far (65,536 counts at most) tell the next digit of the
k-th key, until the rows that share the digits are all drawn. Only drawn rows are then dealt by ranges, sorted and numbered.

Defined results: only A-Z are lower-cased; null or empty texts, or texts without words, have no features and weight 0. Rows are drawn
each on their own: a repeated doc_id can be drawn twice, and of rows that are equal in score and doc_id any may come first. A null
doc_id enters the noise as no characters, and comes last among equal scores. Very long texts are cut into words a part at a time. Extra
columns are not read. With an empty target all gains follow from the documents alone; with no documents the result is empty.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .common import batch, id_and_text, map_texts, slices, small_batches, table, to_arrow, written

#: A word: digits, letters and all bytes of characters beyond ASCII, in lower-cased UTF-8.
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BREAK = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
BUCKETS, RUN = 10_000, 3
MIN_WORDS, PERCENT, SEED = 20, 5, 42
#: Bytes of a text that are cut into words at a time; bits of a digit; lengths with a table of their own.
PART, DIGIT, LENGTHS = 1 << 20, 16, 64


def shift_tables() -> np.ndarray:
    """[length, place, byte]: what a byte at a place of the CRC register becomes after so many zero bytes."""
    step = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    now = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    out = [now]
    for _ in range(LENGTHS):
        now = step[now & 255] ^ (now >> np.uint32(8))
        out.append(now)
    return np.stack(out)


SHIFTS = shift_tables().reshape(-1)


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The CRC's share in that of a longer string, `length` bytes further on."""
    while len(length) and (far := length > LENGTHS).any():
        crc, length = crc.copy(), length.copy()
        crc[far] = shifted(crc[far], np.full(int(far.sum()), LENGTHS))
        length[far] -= LENGTHS
    at = length << 10
    return SHIFTS[at | (crc & 255)] ^ SHIFTS[at | 256 | (crc >> 8 & 255)] ^ SHIFTS[at | 512 | (crc >> 16 & 255)] ^ SHIFTS[at | 768 | (crc >> 24)]


def parts(text: bytes) -> Iterator[bytes]:
    """The text in parts that end between words."""
    i = 0
    while i < len(text):
        end = BREAK.search(text, i + PART)
        j = end.end() if end else len(text)
        yield text[i:j]
        i = j


def words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """CRC and length of each word."""
    crc, length = [], []
    for p in parts(text):
        w = TERM.findall(p.lower())
        crc.append(np.fromiter(map(zlib.crc32, w), np.int64, len(w)))
        length.append(np.fromiter(map(len, w), np.int64, len(w)))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *crc]), np.concatenate([none, *length])


def buckets(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bucket of each run of 1 to RUN words."""
    found, now = [crc], crc
    spaced = shifted(np.full(len(crc), zlib.crc32(b" ")), length) ^ crc  # of " " + word
    for n in range(1, min(RUN, len(crc))):
        now = shifted(now[:-1], length[n:] + 1) ^ spaced[n:]
        found.append(now)
    return np.concatenate(found) % BUCKETS


def counted(texts: DataFrame) -> np.ndarray:
    """Features in each bucket, over all texts."""
    schema = "bucket int, n long"
    out = to_arrow(texts.sparkSession, schema)

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for b in slices(batches):
            for t in b.column(0).cast(pa.binary()).to_pylist():
                if t:
                    total += np.bincount(buckets(*words(t)), minlength=BUCKETS)
        own = np.flatnonzero(total)
        yield batch({"bucket": own, "n": total[own]}, out)

    with small_batches(texts.sparkSession):
        rows = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, schema).groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(BUCKETS, np.int64)
    for r in rows:  # a row for each bucket
        total[r.bucket] = r.n
    return total


def gains(target: np.ndarray, all_: np.ndarray) -> np.ndarray:
    t, s = int(target.sum()), int(all_.sum())
    return np.array([math.floor(1000 * math.log((int(a) + 1) * (s + BUCKETS) / ((int(b) + 1) * (t + BUCKETS)))) for a, b in zip(target, all_, strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight."""

    def rows(ids, texts):
        n_words, n_features, weight = [], [], []
        for t in texts:
            found = buckets(*(w := words(t)))
            n_words.append(len(w[0]))
            n_features.append(len(found))
            weight.append(int(gain[found].sum()))
        return {"doc_id": ids, "n_words": n_words, "n_features": n_features, "weight": weight}

    return map_texts(docs, "doc_id long, n_words long, n_features long, weight long", rows)


def noise(seed: int) -> Column:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def digit(word: Column, shift: int) -> Column:
    return F.shiftrightunsigned(word, shift).bitwiseAND(F.lit((1 << DIGIT) - 1))


def drawn_first(rows: DataFrame, words_: list[Column], k: int) -> Column:
    """True for the k rows with the smallest keys. The key's words are unsigned 64-bit numbers and together differ in every row."""
    if k <= 0:
        return F.lit(False)
    named = rows.select(*(w.alias(f"w{i}") for i, w in enumerate(words_)))
    ends = named.agg(*(f(F.col(f"w{i}")).alias(f"{f.__name__}{i}") for i in range(len(words_)) for f in (F.bit_and, F.bit_or))).first()
    equal, below, need, left = F.lit(True), F.lit(False), k, rows
    for i, word in enumerate(words_):
        differ = (ends[f"bit_and{i}"] ^ ends[f"bit_or{i}"]) & ((1 << 64) - 1)
        for shift in range(64 - DIGIT, -1, -DIGIT):
            if not (differ >> shift) & ((1 << DIGIT) - 1):
                continue  # the same digit in all rows
            d = digit(word, shift)
            found = sorted((r[0], r[1]) for r in left.groupBy(d.alias("digit")).count().collect())  # 65,536 counts at most
            for value, n in found:
                if n >= need:
                    break
                need -= n
            below, equal = below | (equal & (d < value)), equal & (d == value)
            left = rows.where(equal)
            if n == need:
                return below | equal
    return below | equal


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank: one row for each row of docs; rank is null where a row isn't drawn."""
    gain = gains(counted(target), counted(docs))
    scored = weighed(docs, gain).withColumn("score", F.col("weight") + noise(seed)).withColumn("row", F.monotonically_increasing_id())
    scored = written(scored, "scored")
    able = scored.where(F.col("n_words") >= min_words)
    top = F.lit(-(1 << 63))
    key = [F.bitwise_not("score").bitwiseXOR(top), F.col("doc_id").isNull().cast("long"), F.coalesce(F.col("doc_id").bitwiseXOR(top), F.lit(0)), F.col("row")]
    drawn = drawn_first(able, key, percent * able.count() // 100) & (F.col("n_words") >= min_words)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()]
    ranked = numbered(scored.where(drawn), order, "rank")
    rest = scored.where(~drawn).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


def sample(docs: DataFrame, target: DataFrame, **how: int) -> DataFrame:
    """The drawn rows of docs, all columns as they are, with rank; doc_id must be unique here."""
    picked = resampled(docs, target, **how).where("rank is not null").select(F.col("doc_id").alias("_id"), "rank")
    return docs.join(picked, docs["doc_id"].cast("long").eqNullSafe(F.col("_id"))).drop("_id")


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(id_and_text(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
