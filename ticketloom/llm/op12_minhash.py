"""MinHash near-dedup with tensored banding.

Two texts are linked if their sets of distinct 5-word shingles have at least a given Jaccard similarity. Equal sets are merged first,
so a hot group of copies is one node.

Keys: plain banding needs HALF * 2 values for each table. Here a node has two collections of `m` short keys, each made of HALF
minima, and a table's key is a pair, one of each collection: m * m tables from 2 * m * HALF minima. Two sets of similarity s share a
table unless they differ in a whole collection: with HALF = 3 and m = 9 a pair at 0.85 is missed with 2 * (1 - 0.85^3)^9 = 0.04 %, with
HALF = 2 and m = 8 one at 0.8 with 0.06 %, and more similar ones more rarely.

Tables with the same members are one list. Each node is then compared with the least of its lists' first nodes, linear in the lists; nodes
that are still apart from their list's first or last node are compared with these. What is left are pairs whose components differ: the
nodes outside a list's largest component with all of it, so no pair is left unseen that could join two components. These pairs are found
under the keys of one collection, so that a pair meets a few times and not once for each table, and a large list is a grid of blocks,
dealt out block by block. Joins compare sizes and parity sketches, which rule out but never in, so pairs that can't be similar are never rows.

Verification: only nodes that are met are read again, as sorted 64-bit shingle hashes (two sets of 10,000 shingles hold a chance of 5e-12
of a wrong count). Hashes are sorted by the pair's first node; a task holds that node's set and streams the others by.

Defined results: words are lower-cased (A-Z) runs without ASCII white space; a text of fewer than five words is one shingle of all
its words; texts without words have an empty set, and are linked with nothing (or, by parameter, are copies of each other). Each row
counts on its own, a repeated doc_id too. A row without doc_id is linked like any other, but never gives its component's id;
component_id is null where all ids of a component are. Very long texts are hashed in strides. Extra columns are not read. Equal sets are
told by a 128-bit hash.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SHINGLE_WORDS, batch, cut, narrowed, partitions, release, slices, table, to_arrow, written
from .op1_decontaminate import WordHash, window_hashes, words_of
from .op3_simhash import components

#: Least similarity in percent; minima of a short key and short keys of a collection; shingles hashed at a time.
PERCENT, HALF, KEYS, STRIDE = 85, 3, 9, 1 << 12
#: 64-bit words of a parity sketch; slots of a filter on the rows that are read again; pairs of a first node, and nodes of a list's
#: block (outside the largest component, and all), that are dealt out together.
SKETCH, SLOTS, PAIRS, OUTSIDE, ALL = 8, 1 << 20, 128, 1024, 4096
#: Sets with their shingle hashes that a task of a verification takes.
SETS = 2000


def text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def shingle_hashes(text: bytes, hashes: dict) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    w = words_of(text)
    return np.unique(window_hashes(np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w)), min(SHINGLE_WORDS, len(w)))) if w else np.zeros(0, np.uint64)


@cache
def family(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    return tuple(rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def short_keys(x: np.ndarray, half: int, m: int) -> np.ndarray:
    """[2, m]: the short keys of both collections of a set."""
    factors, terms = family(2 * m * half)
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(x), STRIDE):
        np.minimum(least, (x[i : i + STRIDE, None] * factors + terms).min(axis=0), out=least)
    key = np.arange(1, 2 * m + 1, dtype=np.uint64)
    for column in least.reshape(2 * m, half).T:
        key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64).reshape(2, m)


def sketch(x: np.ndarray) -> np.ndarray:
    """A bit for each value of nine bits of the hash: whether an odd number of shingles has it. A shingle that one of two sets has and
    the other lacks turns one bit, so their sketches differ in no more bits than the sets do in shingles."""
    n = 64 * SKETCH
    odd = np.bincount((x >> np.uint64(40) & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("tkey"), F.col("text").cast("string").alias("text"))


def signatures(docs: DataFrame, half: int, m: int, print_of: Callable[[np.ndarray], int] | None = None) -> DataFrame:
    """doc_id, tkey, set1 and set2 (the set's hash), q (its size), odd (its sketch), fp (its fingerprint, if one is asked for), one and
    other (its short keys)."""
    schema = "doc_id long, tkey long, set1 long, set2 long, q int, odd array<long>, fp long, one array<long>, other array<long>"
    out = to_arrow(docs.sparkSession, schema)

    def run(batches):
        release()
        hashes = WordHash()
        for b in slices(batches):
            rows = []
            for t in b.column(2).cast(pa.binary()).to_pylist():
                x = shingle_hashes(t or b"", hashes)
                one, other = short_keys(x, half, m) if len(x) else ([], [])
                rows.append((*np.frombuffer(xxhash.xxh3_128_digest(x.tobytes()), np.int64).tolist(), len(x), sketch(x), print_of(x) if print_of else None, one, other))
            yield batch({"doc_id": b.column(0), "tkey": b.column(1)} | {f.name: [r[i] for r in rows] for i, f in enumerate(list(out)[2:])}, out)

    return texts_of(docs).mapInArrow(run, schema)


def met_again(docs: DataFrame, met: DataFrame) -> DataFrame:
    """node, x (its sorted shingle hashes) of the nodes in met (node, _id, _tkey). A filter of SLOTS slots, at most so many broadcast
    rows, keeps most other rows out of the shuffle."""
    slot = lambda i, k: F.pmod(F.xxhash64(i, k), F.lit(SLOTS))
    slots = met.select(slot("_id", "_tkey").alias("slot")).distinct()
    rows = texts_of(docs)
    rows = rows.join(F.broadcast(slots), slot("doc_id", "tkey") == F.col("slot"), "left_semi")
    found = rows.join(met, rows["doc_id"].eqNullSafe(met["_id"]) & (rows["tkey"] == met["_tkey"])).select("node", "text")
    schema = "node long, x binary"
    out = to_arrow(docs.sparkSession, schema)

    def run(batches):
        release()
        hashes = WordHash()
        for b in slices(batches):
            yield batch({"node": b.column(0), "x": [shingle_hashes(t or b"", hashes).tobytes() for t in b.column(1).cast(pa.binary()).to_pylist()]}, out)

    return found.mapInArrow(run, schema).dropDuplicates(["node"])


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    shared = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) else 0
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs u, v whose sets are similar."""
    pairs = cut(pairs)
    rows = pairs.count()
    few, sets_few = (lambda df: narrowed(df, 2 * rows)), (lambda df: narrowed(df, 2 * rows, SETS))
    pairs = few(pairs)
    ends = few(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    # nodes and docs are large, what is met of them may be small: narrowed when it is read again
    met = few(cut(nodes.join(ends, "node").select("node", F.col("any.doc_id").alias("_id"), F.col("any.tkey").alias("_tkey"))))
    sets = sets_few(cut(met_again(docs, met)))
    many = few(pairs.groupBy("u").agg(F.ceil(F.count("*") / PAIRS).alias("parts")))
    dealt = few(pairs.join(many, "u").select("u", F.pmod(F.xxhash64("v"), "parts").alias("part"), "v"))
    first = sets_few(few(dealt.select("u", "part").distinct()).join(sets, F.col("u") == F.col("node")).select("u", "part", F.lit(None).cast("long").alias("v"), "x"))
    rest = sets_few(dealt.join(sets, F.col("v") == F.col("node")).select("u", "part", "v", "x"))

    def run(batches):
        held = None
        for b in slices(batches):
            us, vs = [], []
            for u, v, x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                x = np.frombuffer(x.as_buffer(), np.uint64)
                if v is None:
                    held = x.copy()
                elif similar(held, x, percent):
                    us.append(u)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    met_rows = sets_few(first.union(rest).repartition(partitions(docs.sparkSession), "u", "part"))
    return few(met_rows.sortWithinPartitions("u", "part", F.col("v").asc_nulls_first()).mapInArrow(run, "u long, v long"))


def fit(a: str, b: str, percent: int) -> Column:
    """Sizes and sketches that allow the similarity; a and b are what stands before and after the columns' names."""
    q, r, odd, other = (F.col(name) for name in (a.format("q"), b.format("q"), a.format("odd"), b.format("odd")))
    turned = sum(F.bit_count(odd[i].bitwiseXOR(other[i])) for i in range(SKETCH))
    return (100 * F.least(q, r) >= percent * F.greatest(q, r)) & ((100 + percent) * turned <= (100 - percent) * (q + r))


def placed(lists: DataFrame, root: DataFrame, few: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """lists with the root of each node's component, of the lists that hold several components."""
    rooted = few(lists.join(root, "node", "left").withColumn("root", F.coalesce("root", "node")))
    several = few(rooted.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key"))
    return few(rooted.join(several, "key"))


def of_lists(nodes: DataFrame, m: int) -> DataFrame:
    """key, node, q, odd: the tables' lists of several nodes, one of those with the same members."""
    at = F.explode(F.sequence(F.lit(0), F.lit(m * m - 1))).alias("t")
    postings = nodes.where("q > 0").select("node", "one", "other", at)
    key = F.xxhash64("t", F.col("one")[F.floor(F.col("t") / m).cast("int")], F.col("other")[F.col("t") % m])
    postings = postings.select(key.alias("key"), "node")
    members = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"x{i}") for i in (1, 2)]
    several = postings.groupBy("key").agg(F.count("*").alias("n"), *members).where("n > 1").groupBy("n", "x1", "x2").agg(F.min("key").alias("key")).select("key")
    return cut(postings.join(several, "key").join(nodes.select("node", "q", "odd"), "node").select("key", "node", "q", "odd"))


def apart(nodes: DataFrame, lists: DataFrame, root: DataFrame, m: int, percent: int, few: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs u, v of the lists whose components differ and that may be similar, in blocks."""
    open_ = few(placed(lists, root, few).select("node", "root").distinct())
    keys = F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("t")
    now = open_.join(nodes, "node").select("node", "root", "q", "odd", "one", "other", keys)
    now = few(cut(now.select(F.xxhash64("t", F.col("one")[F.col("t")]).alias("key"), "node", "root", "q", "odd", "other")))
    by_root = few(now.groupBy("key", "root").agg(F.count("*").alias("n")))
    size = by_root.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots"), F.sum("n").alias("all"), (F.sum("n") - F.max("n")).alias("outside"))
    size = size.where("roots > 1").select("key", "main", F.ceil(F.col("outside") / OUTSIDE).cast("int").alias("rows"), F.ceil(F.col("all") / ALL).cast("int").alias("columns"))
    now = cut(few(now.join(few(size), "key")))
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = now.where("root <> main").select("key", block("rows").alias("i"), each("columns").alias("j"), *(F.col(c).alias(f"{c}_a") for c in ("node", "root", "q", "odd", "other")))
    b = now.select("key", each("rows").alias("i"), block("columns").alias("j"), *(F.col(c).alias(f"{c}_b") for c in ("node", "root", "q", "odd", "other")))
    table_shared = F.lit(False)
    for i in range(m):
        table_shared = table_shared | (F.col("other_a")[i] == F.col("other_b")[i])
    pairs = a.join(b, ["key", "i", "j"]).where(F.col("root_a") != F.col("root_b")).where(fit("{}_a", "{}_b", percent)).where(table_shared)
    return pairs.select(F.least("node_a", "node_b").alias("u"), F.greatest("node_a", "node_b").alias("v")).distinct()


def groups(
    docs: DataFrame, percent: int = PERCENT, half: int = HALF, m: int = KEYS, empty_linked: bool = False, print_of: Callable[[np.ndarray], int] | None = None, met_by: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """doc_id, tkey (hash of the text), q (size of the set), first_id, first_tkey (the first row, by id and tkey, of the row's component):
    one row for each row of docs. Another search may come first: met_by(nodes) gives pairs u, v of nodes by their fp, which is
    print_of(shingle hashes); those that are similar are linked, and the tables are searched only for what they leave apart."""
    rows = written(signatures(docs, half, m, print_of), "sets")
    me = F.struct("doc_id", "tkey")
    own = [F.min(c).alias(c) for c in ("q", "odd", "fp", "one", "other")]
    found = rows.groupBy("set1", "set2").agg(*own, F.min(F.when(F.col("doc_id").isNotNull(), me)).alias("first"), F.min(me).alias("any"))
    nodes = cut(found.withColumn("node", F.monotonically_increasing_id()))
    lists = of_lists(nodes, m)
    rows_of_lists = lists.count()
    few = lambda df: narrowed(df, rows_of_lists)
    lists = few(lists)

    before = cut(verified(met_by(nodes.where("q > 0").select("node", "fp", "q", "odd")), nodes, docs, percent)) if met_by else None
    open_ = cut(placed(lists, components(before), few)) if met_by else lists.withColumn("root", F.col("node"))
    ends = few(open_.groupBy("key").agg(F.min(F.struct("node", "q", "odd", "root")).alias("lo")))
    now = few(open_.join(ends, "key"))
    nearest = few(now.where(F.col("root") != F.col("lo.root")).where(fit("{}", "lo.{}", percent)).groupBy("node").agg(F.min("lo.node").alias("u")))
    links = verified(nearest.select("u", F.col("node").alias("v")), nodes, docs, percent)
    links = cut(links.union(before) if met_by else links)

    now = cut(placed(lists, components(links), few))
    me_too = F.struct("node", "q", "odd", "root")
    now = cut(few(now.join(few(now.groupBy("key").agg(F.min(me_too).alias("lo"), F.max(me_too).alias("hi"))), "key")))
    far = [now.where(F.col("root") != F.col(f"{e}.root")).where(fit("{}", e + ".{}", percent)).select(F.least("node", f"{e}.node").alias("u"), F.greatest("node", f"{e}.node").alias("v")) for e in ("lo", "hi")]
    links = cut(links.union(verified(few(far[0].union(far[1]).distinct()), nodes, docs, percent)))

    root = components(links)
    more = cut(verified(apart(nodes, lists, root, m, percent, few), nodes, docs, percent))
    if not more.isEmpty():
        root = components(links.union(more))

    rooted = nodes.join(root, "node", "left").select("set1", "set2", "first", F.coalesce("root", "node").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("least")), "root").select("set1", "set2", "least")
    joined = rows.select("doc_id", "tkey", "set1", "set2", "q").join(named, ["set1", "set2"])
    alone = F.lit(not empty_linked) & (F.col("q") == 0)
    return joined.select("doc_id", "tkey", "q", F.when(alone, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("first_id"), F.when(alone, F.col("tkey")).otherwise(F.col("least.tkey")).alias("first_tkey"))


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("q").cast("long").alias("n_shingles"), F.col("first_id").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("first_id")).alias("kept"))


OP12_SQL = r"""
with recursive lowered as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
shingles as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from lowered),
sized as (select doc_id, count(s) as n from lowered left join shingles using (doc_id) group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as n from shingles a join shingles b using (s) where a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from shared join sized x on x.doc_id = a join sized y on y.doc_id = b where 100 * shared.n >= 85 * (x.n + y.n - shared.n)),
reached as (select doc_id as a, doc_id as b from documents union select reached.a, links.b from reached join links on links.a = reached.b)
select doc_id, n as n_shingles, least_id as component_id, doc_id = least_id as kept
from sized join (select a as doc_id, min(b) as least_id from reached group by a) using (doc_id)
"""
