"""Benchmark decontamination: MinHash containment search, partitioned by the items' size, verified exactly.

A document contains an item if it has at least 80 % of the item's distinct 5-word shingles. The MinHash sketch of an item is
the shingles with its least hashes. Items are partitioned by size (powers of two), and a partition sets how many sketch
shingles a document must have: with m required, the sketch takes q - ceil(0.8 q) + m of the item's q shingles, so that a
document that lacks at most q - ceil(0.8 q) of all has m of the sketch. The search therefore misses nothing, and larger items,
with their larger m, make fewer false candidates. Candidates are verified on the shingles' words, not on hashes.

Documents are read where they lie: no shuffle. Items are held by every task, in blocks of at most BLOCK shingles; with
more items there are more passes over the documents, and memory stays bounded.

Defined results: words are lower-cased (A-Z) runs without ASCII white space. An item of fewer than five words is one shingle of
all its words; an item without words, or with a null id, is in no document. One row for each document row and item;
null texts contain nothing. Rows with the same item_id are items of their own that may give equal rows.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MIN_SIMILARITY, SHINGLE_WORDS, WORD_BYTES, batch, id_and_text, keep_texts, release, slices, table, to_arrow

#: Shingles of the items that a task holds at a time.
BLOCK = 2_000_000
#: Words whose hashes a task remembers.
REMEMBERED = 150_000
FILTER_BITS = 20
MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHash(dict):
    def __missing__(self, w: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(w)
        return h


def words_of(text: bytes) -> list[bytes]:
    return WORD_BYTES.findall(text.lower())


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of `size` word hashes."""
    n = len(h) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    x = np.zeros(n, np.uint64)
    for j in range(size):
        x = (x ^ h[j : j + n]) * MIX
        x ^= x >> np.uint64(31)
    return x


def required(q: int) -> int:
    """Sketch shingles that a document must have, by the size partition of an item of q shingles."""
    return max(1, (1 << (q.bit_length() - 1)) // 8)


class Items:
    """Sketches of a block of items; search(words) gives (item index, shared shingles) of those contained."""

    def __init__(self, items: list[tuple[int, bytes]], least: float = MIN_SIMILARITY, size: int = SHINGLE_WORDS):
        self.least, self.hash = least, WordHash()
        self.ids, self.shingles, self.size, self.need = [], [], [], []
        where = defaultdict(list)
        for i, text in items:
            w = words_of(text)
            if not w or i is None:
                continue
            n = min(size, len(w))
            own = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
            hashes = sorted({int(x) for x in window_hashes(np.array([self.hash[x] for x in w], np.uint64), n)})
            q = len(hashes)
            m = min(required(q), math.ceil(least * q))
            for x in hashes[: q - math.ceil(least * q - 1e-9) + m]:
                where[x].append(len(self.ids))
            self.ids.append(i)
            self.shingles.append(own)
            self.size.append(n)
            self.need.append(m)
        self.where = dict(where)
        self.sorted = np.array(sorted(where), np.uint64)
        self.windows = sorted(set(self.size))
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[self.sorted & np.uint64((1 << FILTER_BITS) - 1)] = True

    def search(self, text: bytes) -> list[tuple[int, int]]:
        w = words_of(text)
        if not w or not self.ids:
            return []
        h = np.fromiter(map(self.hash.__getitem__, w), np.uint64, len(w))
        seen: dict[int, int] = defaultdict(int)
        for n in self.windows:
            x = window_hashes(h, n)
            x = np.unique(x[self.maybe[x & np.uint64((1 << FILTER_BITS) - 1)]])
            at = np.searchsorted(self.sorted, x)
            at[at == len(self.sorted)] = 0
            for y in x[self.sorted[at] == x].tolist():
                for k in self.where[y]:
                    seen[k] += self.size[k] == n
        out, sets = [], {}
        for k in sorted(k for k, c in seen.items() if c >= self.need[k]):
            n = self.size[k]
            if n not in sets:
                sets[n] = set(zip(*(w[j:] for j in range(n)), strict=False))
            shared = len(self.shingles[k] & sets[n])
            if shared >= self.least * len(self.shingles[k]) - 1e-9:
                out.append((k, shared))
        return out


def blocks(items: DataFrame, size: int = BLOCK) -> list[list[tuple[int, bytes]]]:
    """The items in blocks of about `size` shingles at most, each collected apart."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    total = rows.agg(F.sum(F.size(F.split("text", "\\s+")))).first()[0] or 0
    n = total // size + 1
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b)
        yield [(r["item_id"], r["text"].encode()) for r in part.collect()]


def contained(docs: DataFrame, items: DataFrame, least: float = MIN_SIMILARITY) -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared, containment: the items that documents contain."""
    schema = "doc_id long, item_id long, n_shingles long, n_shared long, containment double"
    arrow = to_arrow(docs.sparkSession, schema)
    out = None
    for block in blocks(items):

        def run(batches, block=block):
            release()
            held = Items(block, least)
            for b in slices(batches):
                rows = {"doc_id": [], "item_id": [], "n_shingles": [], "n_shared": [], "containment": []}
                for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    for k, shared in held.search(t or b""):
                        q = len(held.shingles[k])
                        for c, v in zip(rows, (i, held.ids[k], q, shared, shared / q), strict=True):
                            rows[c].append(v)
                yield batch(rows, arrow)

        found = id_and_text(docs).mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, items: DataFrame, least: float = MIN_SIMILARITY) -> DataFrame:
    """The rows of docs, all columns as they are, whose text contains no item. One pass for each block of items."""
    for block in blocks(items):
        held: list[Items] = []  # made once in each task

        def keep(texts, block=block, held=held):
            if not held:
                release()
                held.append(Items(block, least))
            return [not held[0].search(t) for t in texts]

        docs = keep_texts(docs, keep)
    return docs


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP1_SQL = r"""
WITH i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
s AS (SELECT DISTINCT item_id, least(5, len(w)) AS n, unnest(list_transform(range(1, greatest(len(w) - 5, 0) + 2), lambda k: array_to_string(w[k:k + least(5, len(w)) - 1], ' '))) AS g
      FROM i WHERE len(w) > 0),
d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT DISTINCT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' '))) AS g
      FROM d, (SELECT DISTINCT n FROM s) WHERE len(w) >= n),
q AS (SELECT item_id, count(*) AS n_shingles FROM s GROUP BY item_id)
SELECT t.doc_id, s.item_id, any_value(q.n_shingles) AS n_shingles, count(*) AS n_shared, count(*) / any_value(q.n_shingles) AS containment
FROM s JOIN t ON s.g = t.g AND s.n = t.n JOIN q ON q.item_id = s.item_id
GROUP BY t.doc_id, s.item_id HAVING count(*) >= 0.8 * any_value(q.n_shingles) - 1e-9
"""
