"""SimHash near-dedup by a trie self-join.

A fingerprint is a path of 64 bits in a binary trie. The join walks pairs of trie nodes together, counts the bits in which
their paths differ, and drops a pair of nodes as soon as the count passes the budget.

To deal the walk out, the 64 bits are cut into ``budget + 1`` blocks: two fingerprints within the budget agree in a block.
For each block the trie is rotated so that the block comes first; the walk then starts at the nodes below that block with
no difference spent, and each such subtree is a unit of work. Equal fingerprints are merged first, so a hot group of
copies is one leaf. Near copies of one text fill at most a Hamming ball, and their subtrees are walked with budget 1, 2, 3
in turn, each time leaving out node pairs whose leaves are already in one component; no list of all pairs is made.
A unit gives a spanning forest, not pairs. Components are then joined by large-star and small-star rounds, checkpointed.

Defined results: null or empty text has fingerprint zero and is linked like any other; a null doc_id gets the smallest
non-null doc_id of its component (null if there is none).
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_BYTES, cut, map_texts, narrowed, partitions, table

BITS, BUDGET = 64, 3
#: Shingles hashed at a time, so that a very long text needs no more memory than a long one.
STRIDE = 1 << 16
#: Node pairs walked at a time.
FRONTIER = 1 << 17


def fingerprint(text: bytes, words: int = 3) -> int:
    """The 64 majority bits of XXH64 (seed 42) over the text's word shingles."""
    w = WORD_BYTES.findall(text.lower())  # bytes.lower() changes A-Z only
    if not w:
        return 0
    n = max(len(w) - words + 1, 1)

    def hashes():
        for i in range(0, n, STRIDE):
            part = w[i : min(i + STRIDE, n) + words - 1]
            shingles = map(b" ".join, zip(*(part[j:] for j in range(words)), strict=False)) if len(w) >= words else iter([b" ".join(w)])
            yield np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64)

    return majority(hashes(), n)


def majority(hashes: Iterable[np.ndarray], n: int) -> int:
    """The bits that are set in over half of n hashes."""
    ones = np.zeros(BITS, np.int64)
    for h in hashes:
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):  # sums of 255 bits fit a byte
            ones += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return int(sum(1 << int(b) for b in np.flatnonzero(2 * ones > n)))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""
    return map_texts(docs, "doc_id long, fp long", lambda ids, texts: {"doc_id": ids, "fp": [signed(fingerprint(t, words)) for t in texts]})


def roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest node of each node's component."""
    lab = np.arange(n)
    while len(u):
        a, b = lab[u], lab[v]
        np.minimum.at(lab, a, b)
        np.minimum.at(lab, b, a)
        while (lab[lab] != lab).any():
            lab = lab[lab]
        rest = lab[u] != lab[v]
        u, v = u[rest], v[rest]
    return lab


def walk(keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, top: int, budget: int, lab: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within the budget between keys of one subtree; subtrees are [start, end) of the sorted keys, and their paths
    are equal above bit `top`. Links inside a component of `lab` may be left out."""
    change = np.concatenate([[0], np.cumsum(lab[1:] != lab[:-1])]) if len(lab) else lab
    zeros: dict[int, np.ndarray] = {}
    us, vs = [], []
    stack = [(top, starts, ends, starts, ends, np.zeros(len(starts), np.int8))]
    while stack:
        bit, a, A, b, B, err = stack.pop()
        if len(a) > FRONTIER:
            half = len(a) // 2
            stack += [(bit, *(x[:half] for x in (a, A, b, B, err))), (bit, *(x[half:] for x in (a, A, b, B, err)))]
            continue
        single = (A - a == 1) & (B - b == 1)
        if single.any():
            x, y = a[single], b[single]
            near = (np.bitwise_count(keys[x] ^ keys[y]) <= budget) & (x != y)
            us.append(x[near])
            vs.append(y[near])
        live = ~single & (A > a) & (B > b) & (err <= budget)
        live &= ~((change[A - 1] == change[a]) & (change[B - 1] == change[b]) & (lab[a] == lab[b])) if len(a) else live
        a, A, b, B, err = (x[live] for x in (a, A, b, B, err))
        if not len(a):
            continue
        whole = err + bit <= budget  # all leaves below are within the budget: a star links them
        if whole.any():
            for lo, hi, c in ((a[whole], A[whole], a[whole]), (b[whole], B[whole], a[whole])):
                size = hi - lo
                us.append(np.repeat(c, size))
                vs.append(np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()))
            a, A, b, B, err = (x[~whole] for x in (a, A, b, B, err))
        if not len(a):
            continue
        bit -= 1
        if bit not in zeros:
            zeros[bit] = np.concatenate([[0], np.cumsum((keys >> np.uint64(bit)) & np.uint64(1) == 0)])
        z = zeros[bit]
        am, bm = a + z[A] - z[a], b + z[B] - z[b]
        same = (a == b) & (A == B)
        other = ~same
        nxt = [(a, am, b, bm, err), (am, A, bm, B, err), (a, am, bm, B, err + 1), (am[other], A[other], b[other], bm[other], err[other] + 1)]
        parts = []
        for p in nxt:
            ok = (p[1] > p[0]) & (p[3] > p[2]) & (p[4] <= budget)
            parts.append(tuple(x[ok] for x in p))
        stack.append((bit, *(np.concatenate([p[i] for p in parts]) for i in range(5))))
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return cat(us), cat(vs)


def forest(keys: np.ndarray, top: int, budget: int) -> np.ndarray:
    """Index of a representative for each of the sorted keys, linked where two differ in up to budget of the bits below
    `top` and agree above."""
    head = keys >> np.uint64(top)
    starts = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
    ends = np.append(starts[1:], len(keys))
    lab = np.arange(len(keys))
    few = ends - starts > 1
    starts, ends = starts[few], ends[few]
    us, vs = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for b in range(1, budget + 1):
        u, v = walk(keys, starts, ends, top, b, lab)
        us, vs = np.concatenate([us, u]), np.concatenate([vs, v])
        lab = roots(len(keys), us, vs)
        us = np.flatnonzero(lab != np.arange(len(keys)))
        vs = lab[us]
    return lab


def rotate(x: np.ndarray, by: int) -> np.ndarray:
    return x if not by else (x << np.uint64(by)) | (x >> np.uint64(BITS - by))


def trie_links(fps: DataFrame, budget: int = BUDGET) -> DataFrame:
    """u, v: links (a spanning forest for each subtree) between the distinct values of fps.fp."""
    spark = fps.sparkSession
    width = BITS // (budget + 1)
    shift = lambda i: F.shiftrightunsigned("fp", BITS - width * (i + 1)).bitwiseAND(F.lit((1 << width) - 1))
    dealt = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("block"), shift(i).alias("head")) for i in range(budget + 1)))).alias("r")).select("fp", "r.*")

    def run(batches):
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not got:
            return
        fp, block = (np.concatenate([g[i] for g in got]) for i in (0, 1))
        for i in range(budget + 1):
            keys = np.sort(rotate(fp[block == i].view(np.uint64), width * i))
            lab = forest(keys, BITS - width, budget)
            own = np.flatnonzero(lab != np.arange(len(keys)))
            u, v = (rotate(keys[x], (BITS - width * i) % BITS).view(np.int64) for x in (own, lab[own]))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return dealt.repartition(partitions(spark), "block", "head").select("fp", "block").mapInArrow(run, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of the nodes that have links, by large-star and small-star rounds."""
    edges = cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    rows = edges.count()  # they don't become more
    few = lambda df: narrowed(df, 2 * rows)
    state, edges = None, few(edges)
    while True:
        both = edges.union(edges.select("v", "u"))
        least = few(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = few(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = few(large.groupBy("u").agg(F.min("v").alias("m")))
        small = few(large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).union(least.select("u", F.col("m").alias("v")))
        edges = cut(few(small.distinct()))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def near_duplicates(docs: DataFrame, words: int = 3, budget: int = BUDGET) -> DataFrame:
    """doc_id, fp, component_id: one row for each row of docs."""
    docs_fp = cut(fingerprints(docs, words))
    fps = docs_fp.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots_of = components(trie_links(fps.select("fp"), budget)).withColumnRenamed("node", "fp")
    rooted = fps.join(roots_of, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    return docs_fp.join(named, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, words: int = 3, budget: int = BUDGET) -> DataFrame:
    """The rows of docs, all columns as they are, that have the least (doc_id, text hash) of their component; rows of one doc_id and
    one text all stay or go, and rows without doc_id stay."""

    def named(ids: list, texts: list[bytes]) -> dict[str, list]:
        return {"_id": ids, "_tkey": [signed(xxhash.xxh64_intdigest(t, 42)) for t in texts], "fp": [signed(fingerprint(t, words)) for t in texts]}

    rows = cut(map_texts(docs, "_id long, _tkey long, fp long", named).where("_id is not null"))
    roots_of = components(trie_links(rows.select("fp").distinct(), budget)).withColumnRenamed("node", "fp")
    me = F.struct("_id", "_tkey")
    rooted = rows.groupBy("fp").agg(F.min(me).alias("first")).join(roots_of, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.select("fp", "root").join(rooted.groupBy("root").agg(F.min("first").alias("least")), "root").select("fp", "least")
    go = rows.join(least, "fp").where(me != F.col("least")).select("_id", "_tkey").distinct()
    tkey = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(go, (docs["doc_id"].cast("long") == F.col("_id")) & (tkey == F.col("_tkey")), "left_anti")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
