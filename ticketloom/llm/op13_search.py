"""Ranked lexical search over document shards of compressed sparse rows.

Index: each shard holds some documents (SHARD tokens) as postings sorted by term: where a term's postings start, the documents' places,
and the postings' impacts, integers that are computed when the index is built and that only a term's weight multiplies. An index is a
table with one row for each shard, so that it is built, read and lost shard by shard: a task holds one shard at a time, in a row group and an
Arrow batch of its own, however many shards its part of the table has.

Search: items come in blocks of bounded size. One pass over the shards' vocabularies counts in how many documents each term of a block
lies, which gives the terms' weights; a second pass adds up, term at a time, weight times impact in a dense array of the shard's
documents. The k-th score is found by partitioning; all documents that reach it are kept, so that ties are cut by doc_id and not by
chance. A task carries the best k of each item from shard to shard and sends those on; a window merges the tasks' lists.

Defined results: only A-Z are lower-cased; a document or item that is null, empty or without terms matches nothing. Each row of
documents and of items counts on its own: repeated documents are ranked one after another, a repeated item gives its rows again. Null
doc_ids come last among equal scores; items with a null id are searched like others. Very long texts are cut into terms a part
at a time and may make a shard of their own. Extra columns are not read. An empty table on either side gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LARGE_ROWS, batch, id_and_text, slices, small_batches, table, to_arrow, written

#: A term: digits, letters and all bytes of characters beyond ASCII, in lower-cased UTF-8.
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
BREAK = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
TOP = 50
#: Tokens of a shard and bytes of its vocabulary, from which it is closed; bytes of a text cut at a time; terms of a block of items.
SHARD, VOCABULARY, PART, BLOCK = 1_000_000, 32 << 20, 1 << 20, 200_000
_bytes = np.arange(256)
IS_TERM = np.array([bool(TERM.fullmatch(bytes([b]))) for b in _bytes])

INDEX = "doc_ids array<long>, hashes binary, vocabulary binary, ends binary, starts binary, places binary, impacts binary"


def n_terms(text: bytes) -> int:
    """Terms with repeats."""
    inside = IS_TERM[np.frombuffer(text, np.uint8)]
    return int(inside[:1].sum()) + int(np.count_nonzero(inside[1:] & ~inside[:-1]))


def terms(text: bytes) -> Iterator[list[bytes]]:
    i = 0
    while i < len(text):
        end = BREAK.search(text, i + PART)
        j = end.end() if end else len(text)
        yield TERM.findall(text[i:j].lower())
        i = j


def lengths(docs: DataFrame) -> tuple[int, int]:
    """How many documents have a term, and how many terms there are with repeats."""
    out = to_arrow(docs.sparkSession, "documents long, terms long")

    def run(batches):
        n = total = 0
        for b in slices(batches):
            for t in b.column(0).cast(pa.binary()).to_pylist():
                if t and (m := n_terms(t)):
                    n, total = n + 1, total + m
        yield batch({"documents": [n], "terms": [total]}, out)

    with small_batches(docs.sparkSession):
        r = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    return r[0] or 0, r[1] or 0


class Numbers(dict):
    """A number for each term, in the order of their coming."""

    def __missing__(self, term: bytes) -> int:
        self.size += len(term)
        n = self[term] = len(self)
        return n

    size = 0


class Shard:
    def __init__(self):
        self.numbers, self.ids, self.parts, self.tokens = Numbers(), [], [], 0

    def add(self, doc_id: int | None, text: bytes, n_docs: int, all_terms: int) -> None:
        own = [np.fromiter(map(self.numbers.__getitem__, w), np.int32, len(w)) for w in terms(text)]
        own = np.concatenate(own) if own else np.zeros(0, np.int32)
        if not len(own):
            return
        term, tf = np.unique(own, return_counts=True)
        m = 50 + 50 * len(own) * n_docs // all_terms
        self.parts.append((term, np.full(len(term), len(self.ids), np.int32), (1_000_000_000 * tf // (1000 * tf + 20 * m)).astype(np.int32)))
        self.ids.append(doc_id)
        self.tokens += len(own)

    def full(self, tokens: int) -> bool:
        return self.tokens >= tokens or self.numbers.size >= VOCABULARY

    def row(self) -> dict:
        term, place, impact = (np.concatenate([p[i] for p in self.parts]) for i in range(3))
        vocabulary = list(self.numbers)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, vocabulary), np.uint64, len(vocabulary))
        order = np.argsort(hashes, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        term = rank[term]
        by_term = np.argsort(term, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(order)))])
        sorted_terms = [vocabulary[i] for i in order.tolist()]
        cells = {"hashes": hashes[order], "ends": np.cumsum([len(t) for t in sorted_terms]), "starts": starts, "places": place[by_term], "impacts": impact[by_term]}
        return {k: [v.tobytes()] for k, v in cells.items()} | {"doc_ids": [self.ids], "vocabulary": [b"".join(sorted_terms)]}


def index(docs: DataFrame, tokens: int = SHARD) -> tuple[DataFrame, int]:
    """The shards of all docs, as a table in the shared folder, and how many documents have a term."""
    n_docs, all_terms = lengths(docs)
    out = to_arrow(docs.sparkSession, INDEX)

    def run(batches):
        shard = Shard()
        for b in slices(batches):
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                shard.add(i, t or b"", n_docs, all_terms)
                if shard.full(tokens):
                    yield batch(shard.row(), out)
                    shard = Shard()
        if shard.ids:
            yield batch(shard.row(), out)

    return written(id_and_text(docs).mapInArrow(run, INDEX), "shards", **LARGE_ROWS), n_docs


def found(b: pa.RecordBatch, row: int, wanted: list[bytes], hashes: np.ndarray) -> np.ndarray:
    """The place of each wanted term in a shard's vocabulary, or -1."""
    held, ends = np.frombuffer(b.column("hashes")[row].as_buffer(), np.uint64), np.frombuffer(b.column("ends")[row].as_buffer(), np.int64)
    vocabulary = memoryview(b.column("vocabulary")[row].as_buffer()).cast("B")  # signed bytes else
    at, places = np.searchsorted(held, hashes), np.full(len(wanted), -1)
    for k in np.flatnonzero(held[np.minimum(at, len(held) - 1)] == hashes).tolist():
        i = int(at[k])
        while i < len(held) and held[i] == hashes[k]:  # terms of one hash lie side by side
            if vocabulary[ends[i - 1] if i else 0 : ends[i]] == wanted[k]:
                places[k] = i
                break
            i += 1
    return places


def document_counts(shards: DataFrame, wanted: list[bytes], hashes: np.ndarray) -> np.ndarray:
    """In how many documents each wanted term lies."""
    schema = "term int, n long"
    out = to_arrow(shards.sparkSession, schema)

    def run(batches):
        total = np.zeros(len(wanted), np.int64)
        for b in slices(batches, 1):
            places, starts = found(b, 0, wanted, hashes), np.frombuffer(b.column("starts")[0].as_buffer(), np.int64)
            there = np.flatnonzero(places >= 0)
            total[there] += starts[places[there] + 1] - starts[places[there]]
        there = np.flatnonzero(total)
        yield batch({"term": there, "n": total[there]}, out)

    df = np.zeros(len(wanted), np.int64)
    with small_batches(shards.sparkSession, 1):
        counts = shards.select("hashes", "vocabulary", "ends", "starts").mapInArrow(run, schema).groupBy("term").agg(F.sum("n").alias("n")).collect()
    for r in counts:
        df[r.term] = r.n  # a row for each term of the block
    return df


def best(scores: np.ndarray, none: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0; equal scores by ascending id, null ids last."""
    at = np.flatnonzero(scores > 0)
    if len(at) > k:
        least = scores[at][np.argpartition(scores[at], len(at) - k)[len(at) - k]]
        at = at[scores[at] >= least]  # with all ties of the k-th
    return at[np.lexsort((ids[at], none[at], -scores[at]))[:k]]


def block_hits(shards: DataFrame, n_docs: int, items: list[tuple[int, list[bytes]]], k: int) -> DataFrame:
    """item (row number), doc_id, score: the best k of each task."""
    wanted = sorted({t for _, own in items for t in own})
    number = {t: i for i, t in enumerate(wanted)}
    hashes = np.array([xxhash.xxh64_intdigest(t) for t in wanted], np.uint64)
    df = document_counts(shards, wanted, hashes)
    weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(n) + 1))) for n in df]
    asked = [(i, [number[t] for t in own]) for i, own in items]
    schema = "item long, doc_id long, score long"
    out = to_arrow(shards.sparkSession, schema)

    def run(batches):
        kept = {i: (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)) for i, _ in asked}
        for b in slices(batches, 1):
            places = found(b, 0, wanted, hashes).tolist()
            starts, docs, impacts = (np.frombuffer(b.column(c)[0].as_buffer(), t) for c, t in (("starts", np.int64), ("places", np.int32), ("impacts", np.int32)))
            ids = b.column("doc_ids")[0].values
            none, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            scores = np.zeros(len(ids), np.int64)
            for i, own in asked:
                scores[:] = 0
                for t in own:
                    if (p := places[t]) >= 0:
                        s, e = starts[p], starts[p + 1]
                        scores[docs[s:e]] += weight[t] * impacts[s:e].astype(np.int64)
                at = best(scores, none, ids, k)
                if len(at):
                    s, n, d = (np.concatenate(x) for x in zip(kept[i], (scores[at], none[at], ids[at]), strict=True))
                    at = best(s, n, d, k)
                    kept[i] = s[at], n[at], d[at]
        for i, (s, n, d) in kept.items():
            if len(s):
                yield batch({"item": np.full(len(s), i), "doc_id": pa.array(d, mask=n), "score": s}, out)

    return shards.mapInArrow(run, schema)


def blocks(items: DataFrame) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Row number and distinct terms of the items, BLOCK terms at a time; the driver holds one block."""
    block, size = [], 0
    for r in items.select("item", "text").toLocalIterator():
        own = sorted({t for part in terms((r.text or "").encode()) for t in part})
        if own:
            block.append((r.item, own))
            size += len(own)
        if size >= BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


def search(shards: DataFrame, n_docs: int, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score."""
    items = written(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).withColumn("item", F.monotonically_increasing_id()), "items")
    hits = items.sparkSession.createDataFrame([], "item long, doc_id long, score long")
    for block in blocks(items):
        with small_batches(shards.sparkSession, 1):
            hits = hits.union(written(block_hits(shards, n_docs, block, k), "hits"))
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards, n_docs = index(table(spark, sf_dir, "documents"))
    return search(shards, n_docs, table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
with lowered as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents),
sized as (select row_number() over () as d, doc_id, terms, len(terms) as n from lowered),
whole as (select count(*) filter (where n > 0) as n_docs, cast(sum(n) as bigint) as all_terms from sized),
postings as (select d, term, count(*) as tf from (select d, unnest(terms) as term from sized) group by d, term),
asked as (
  select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark),
weights as (
  select term, cast(floor(1000 * ln(cast(2 * any_value(n_docs) + 2 as double) / (2 * count(*) + 1))) as bigint) as w
  from postings, whole where term in (select term from asked) group by term),
scores as (
  select item_id, d, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // all_terms)))) as bigint) as score
  from asked join weights using (term) join postings using (term) join sized using (d), whole group by item_id, d),
ranked as (
  select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score
  from scores join sized using (d) where score > 0)
select * from ranked where rank <= 50
"""
