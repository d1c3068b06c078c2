"""Long repeated substrings, found with run-length BWT indexes.

A byte goes if a string of LENGTH bytes covers it that also starts earlier in the corpus (smaller doc_id, or the same
document and an earlier start). Each such string is a window; the work is dealt out so that equal windows meet:

1. The anchor of a window is the leftmost of its GRAM-byte substrings with the least hash. Equal windows have equal anchors
   at equal offsets. Windows of a text that share an anchor follow each other, so an anchor stands for a run of windows.
2. Anchors are dealt by hash and counted; those that occur once are dropped. The others are listed by document (a checkpointed
   table of 8 bytes an anchor) and joined to the text. The text's own shuffle is written once and used by both joins.
3. That gives contexts, the bytes under an anchor's run of windows. First only their hashes are dealt by anchor hash and sorted: a
   context equal to an earlier one of its anchor is matched as a whole, and an anchor with one distinct context is done. Here,
   and only here, equality is that of two 64-bit hashes (anchor and context).
4. The first ones of the others are fetched and dealt with their bytes, in whole anchor groups, up to CHUNK bytes at a time.
   Contexts that share neither side of the anchor with another can't share a window and are left out. Of each chunk a
   run-length index is built: the Burrows-Wheeler transform as runs, with text positions sampled at the ends of runs, and the
   heads of the row intervals whose suffixes share LENGTH bytes. The contexts are streamed backwards through it, all side by
   side, one LF step a byte, which gives their matching statistics against each other, cut at LENGTH as only that counts. From
   the last row of an interval the other occurrences are found by the sampled run ends, and all but the earliest are marked.
5. The matched spans are gathered by document and joined to the text.

So groups of copies cost little. An anchor with over HOT contexts would be too much for a task. Its contexts are merged by their bytes
with partial aggregation first, and the windows of the distinct ones in the same way: exact, and without any large group. Only
the count of step 2 sees a hot anchor's rows, of 24 bytes each, in one task: a window that spills.

Defined results: null text is empty. Rows with a null doc_id lose nothing and are nobody's source. Rows with the same doc_id and
the same text are one document; with different texts they are ordered by the text's hash.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch, cut, id_and_text, partitions, slices, table, to_arrow, written

LENGTH, GRAM = 100, 32
#: Bytes of contexts that are indexed at a time.
CHUNK = 2 << 20
#: Contexts of one anchor that a task takes.
HOT = 100_000
#: Windows looked at at a time.
STRIP = 8 << 20
POSITION_BITS = 28
#: Windows whose bytes are compared at a time.
STEP = 1 << 16


def gram_hashes(text: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all substrings of `size` bytes, a power of two, by doubling."""
    h = text.astype(np.uint64) + np.uint64(1)
    k, base = 1, np.uint64(0x9E3779B97F4A7C15)
    while k < size:
        if len(h) <= k:
            return np.zeros(0, np.uint64)
        h = h[:-k] * base + h[k:]
        h ^= h >> np.uint64(32)
        base = np.uint64((int(base) * 0xBF58476D1CE4E5B9 + 2) & ((1 << 64) - 1))
        k *= 2
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def sliding_least(x: np.ndarray, size: int) -> np.ndarray:
    n, k = len(x) - size + 1, 1
    while 2 * k <= size:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[:n], x[size - k : size - k + n])


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text number, anchor hash, first window, windows, anchor's offset) of each run of windows with one anchor. Texts are put together, and
    windows that would cross from one to the next are left out."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    data = np.frombuffer(b"".join(texts), np.uint8)
    found = []
    for at in range(0, max(len(data) - length + 1, 0), STRIP):
        part = data[at : at + STRIP + length - 1]
        h = gram_hashes(part, gram)
        low = np.uint64((1 << POSITION_BITS) - 1)
        key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        a = (sliding_least(key, length - gram + 1) & low).astype(np.int64)
        doc = np.searchsorted(ends, at + np.arange(len(a)), side="right")
        s = np.flatnonzero(at + np.arange(len(a)) + length <= ends[doc])
        if not len(s):
            continue
        a, doc = a[s], doc[s]
        head = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])]))
        found.append((doc[head], h[a[head]].view(np.int64), at + s[head] - starts[doc[head]], np.diff(np.append(head, len(s))), a[head] - s[head]))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate([f[i] for f in found]) for i in range(5))


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of texts that each end in a mark of their own.

    Row intervals whose suffixes share `length` bytes are kept by their heads. stream() takes every text backwards through the
    index; before() goes from a row's text position to that of the row above, by the text positions sampled at run ends."""

    def __init__(self, texts: list[bytes], length: int = LENGTH):
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.ends = np.cumsum(sizes) - 1  # positions of the marks
        self.starts = self.ends - sizes + 1
        self.n = n = int(sizes.sum())
        raw = np.frombuffer(b"\0".join([*texts, b""]), np.uint8)
        sa = self.suffixes(raw)
        # rows that share `length` bytes with the row before: by hash, then by the bytes
        left = np.repeat(self.ends, sizes) - np.arange(n)
        code = np.zeros(n, np.uint64)
        code[: n - length + 1] = window_hashes(raw, length)
        x, y = sa[:-1], sa[1:]
        maybe = np.flatnonzero((code[x] == code[y]) & (left[x] >= length) & (left[y] >= length))
        windows = np.lib.stride_tricks.sliding_window_view(raw, length)
        same = np.zeros(n - 1, bool)
        for i in range(0, len(maybe), STEP):
            part = maybe[i : i + STEP]
            same[part] = (windows[x[part]] == windows[y[part]]).all(axis=1)
        self.heads = np.flatnonzero(np.concatenate([[True], ~same]))
        symbol = raw.astype(np.int64) + len(texts)
        symbol[self.ends] = np.arange(len(texts))  # marks are smaller than bytes and differ
        bwt = symbol[sa - 1]
        edge = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
        self.run_start, self.run_char = edge, bwt[edge]
        size = np.diff(np.append(edge, n))
        by_char = np.argsort(self.run_char, kind="stable")
        self.run_to = np.empty(len(edge), np.int64)
        self.run_to[by_char] = np.cumsum(size[by_char]) - size[by_char]  # rows of smaller characters, and of this one in earlier runs
        # Two rows of one run stay neighbours one byte further left. So the position above another is a constant number of bytes off
        # until a run starts; there it is one byte before the sampled end of the last run with the same or the next smaller character.
        end_sample = sa[edge + size - 1]
        key, above = (sa[edge[by_char]] - 1) % n, np.append(0, (end_sample[by_char[:-1]] - 1) % n)
        order = np.argsort(key)
        self.sampled, self.above = key[order], above[order]

    def suffixes(self, raw: np.ndarray) -> np.ndarray:
        """The suffixes in order: by seven bytes, then by ranks over doubled lengths, of those that are still equal to others."""
        n, k = self.n, 7
        up = raw.astype(np.int64) + 1
        up[self.ends] = 0
        number = np.repeat(np.arange(len(self.ends)), self.ends - self.starts + 1)
        left = self.ends[number] - np.arange(n)
        key = np.zeros(n, np.int64)
        for j in range(k):
            key <<= 9
            m = max(n - j, 0)
            key[:m] |= np.where(left[:m] >= j, up[j:], 0)  # nothing counts beyond the mark
        sa = np.argsort(key)
        key = key[sa]
        head = np.concatenate([[True], key[1:] != key[:-1]])
        rank = np.empty(n, np.int64)
        while True:
            first = np.flatnonzero(head)
            rank[sa] = np.repeat(first, np.diff(np.append(first, n)))
            open_ = np.flatnonzero(~(head & np.append(head[1:], True)))
            if not len(open_):
                return sa
            part = sa[open_]
            # suffixes that are equal up to their marks come in the order of their texts
            key = rank[part] * (n + 1) + np.where(left[part] >= k, rank[np.minimum(part + k, n - 1)], number[part])
            order = np.argsort(key)
            sa[open_], key = part[order], key[order]
            head[open_] = np.concatenate([[True], key[1:] != key[:-1]])
            k *= 2

    def back(self, row: np.ndarray) -> np.ndarray:
        """Row of the suffix that is one byte longer."""
        r = np.searchsorted(self.run_start, row, side="right") - 1
        return self.run_to[r] + row - self.run_start[r]

    def stream(self):
        """Yields (texts, offsets, rows), one LF step at a time, for all texts side by side. The mark of text j is row j."""
        j, left = np.arange(len(self.ends)), self.ends - self.starts
        row = j.copy()
        while True:
            go = left > 0
            if not go.any():
                return
            j, row, left = j[go], self.back(row[go]), left[go] - 1
            yield j, left, row

    def before(self, position: np.ndarray) -> np.ndarray:
        """The text positions of the rows above those of the given positions (but the first row)."""
        k = np.searchsorted(self.sampled, position)
        return self.above[k] - (self.sampled[k] - position)


def window_hashes(raw: np.ndarray, length: int) -> np.ndarray:
    """A hash of each `length` bytes, put together from those of powers of two."""
    h, done = np.zeros(len(raw) - length + 1, np.uint64), 0
    for p in (1 << i for i in range(length.bit_length()) if length >> i & 1):
        h = (h ^ gram_hashes(raw, p)[done : done + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        done += p
    return h


def matched(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(text, offset) of all windows that also start earlier in these texts, in the order of texts and offsets."""
    if max(map(len, texts), default=0) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    index = RunLengthIndex(texts, length)
    last = np.append(index.heads[1:], index.n) - 1
    size = last - index.heads + 1
    ends = np.zeros(index.n, bool)
    ends[last[size > 1]] = True
    found = [(row[ok], index.starts[j[ok]] + off[ok]) for j, off, row in index.stream() if (ok := ends[row]).any()]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row, place = (np.concatenate([f[i] for f in found]) for i in range(2))
    more = size[np.searchsorted(index.heads, row, side="right") - 1] - 1
    interval, first, places = np.arange(len(row)), place.copy(), [(np.arange(len(row)), place)]
    while True:  # the other occurrences, one row up at a time, of all intervals side by side
        go = more > 0
        if not go.any():
            break
        interval, place, more = interval[go], index.before(place[go]), more[go] - 1
        first[interval] = np.minimum(first[interval], place)
        places.append((interval, place))
    interval, place = (np.concatenate([x[i] for x in places]) for i in range(2))
    late = np.sort(place[first[interval] < place])
    j = np.searchsorted(index.starts, late, side="right") - 1
    return j, late - index.starts[j]


def spans(j: np.ndarray, off: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(text, start, end) of the bytes under runs of consecutive windows."""
    if not len(j):
        return []
    order = np.lexsort((off, j))
    j, off = j[order], off[order]
    head = np.flatnonzero(np.concatenate([[True], (j[1:] != j[:-1]) | (off[1:] != off[:-1] + 1)]))
    last = np.append(head[1:], len(j)) - 1
    return list(zip(j[head].tolist(), off[head].tolist(), (off[last] + length).tolist(), strict=True))


def sharing(group: list[tuple], length: int = LENGTH, gram: int = GRAM) -> list[tuple]:
    """The contexts that share at least one side of the anchor with another: of a window's bytes beside the anchor, half or more lie
    on one side, so contexts that share a window share that many there. A context is (doc_id, tkey, start, anchor, bytes)."""
    half = (length - gram + 1) // 2
    sides = [(c[max(a - half, 0) : a + gram] if a >= half else None, c[a : a + gram + half] if a + gram + half <= len(c) else None) for *_, a, c in group]
    left, right = Counter(x for x, _ in sides if x), Counter(y for _, y in sides if y)
    return [g for g, (x, y) in zip(group, sides, strict=True) if x and left[x] > 1 or y and right[y] > 1]


def marks_of(groups: list[list[tuple]], length: int = LENGTH) -> list[tuple]:
    """(doc_id, tkey, start, end) of the matched spans of whole anchor groups; a context is (doc_id, tkey, start, anchor, bytes),
    in the order of the corpus."""
    owner = [c for group in groups for c in sharing(group, length)]
    if not owner:
        return []
    return [(*owner[j][:2], owner[j][2] + a, owner[j][2] + b) for j, a, b in spans(*matched([c[4] for c in owner], length), length)]


#: Stands for a null doc_id inside this module: keys that can't be null keep the two joins' shuffles of the text alike.
NO_ID = -(1 << 63)


def keyed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """(doc_id, text, tkey; the columns that tell documents apart): tkey only tells rows of one doc_id apart, and is zero where
    there are none such."""
    own = id_and_text(docs)
    again = not own.groupBy("doc_id").count().where("count > 1 and doc_id is not null").isEmpty()
    tkey = F.xxhash64(F.coalesce("text", F.lit(""))) if again else F.lit(0).cast("long")
    return own.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text", tkey.alias("tkey")), ["doc_id", "tkey"] if again else ["doc_id"]


ANCHORS = "ahash long, doc_id long, tkey long, place long"
MARKS = "doc_id long, tkey long, a int, b int"
CONTEXTS = "ahash long, doc_id long, tkey long, start int, anchor int, ctx binary"
HASHES = "ahash long, chash long, doc_id long, tkey long, place long"
FIRSTS = "doc_id long, tkey long, place long, matched boolean"


def unpack(place: int) -> tuple[int, int, int]:
    """(start, bytes of the context, start of the anchor)."""
    return place >> 14, (place >> 7 & 127) + LENGTH - 1, (place >> 14) + (place & 127)


def anchor_lists(docs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, cold, hot: the anchors that occur twice or more, packed as start << 14 | windows << 7 | anchor's offset; hot ones
    have over HOT occurrences."""
    spark = docs.sparkSession
    arrow = to_arrow(spark, ANCHORS)

    def run(batches):
        for b in slices(batches):
            ids, keys = b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            d, h, s, n, off = anchors([t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()])
            if len(d):
                yield batch({"ahash": h, "doc_id": ids[d], "tkey": keys[d], "place": s << 14 | n << 7 | off}, arrow)

    rows = docs.where((F.col("doc_id") != NO_ID) & (F.octet_length("text") >= LENGTH)).mapInArrow(run, ANCHORS)
    counted = rows.repartition(partitions(spark), "ahash").withColumn("n", F.count("*").over(Window.partitionBy("ahash"))).where("n > 1")
    hot = F.col("n") > HOT
    return counted.groupBy(*keys).agg(F.collect_set(F.when(~hot, F.col("place"))).alias("cold"), F.collect_set(F.when(hot, F.col("place"))).alias("hot"))


def context_rows(docs: DataFrame, lists: DataFrame, keys: list[str], hashes: bool = False) -> DataFrame:
    """The contexts of the anchors in lists (keys, places): their bytes, or only their hashes."""
    schema = HASHES if hashes else CONTEXTS
    arrow = to_arrow(docs.sparkSession, schema)

    def run(batches):
        h64 = lambda x: xxhash.xxh64_intdigest(x) - (1 << 63)
        for b in slices(batches):
            out = {f.name: [] for f in arrow}
            for i, t, k, places in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                at = list(map(unpack, places))
                ctx = [t[s : s + n] for s, n, _ in at]
                out["ahash"] += [h64(t[g : g + GRAM]) for _, _, g in at]
                out["doc_id"] += [i] * len(places)
                out["tkey"] += [k] * len(places)
                if hashes:
                    out["chash"] += map(h64, ctx)
                    out["place"] += places
                else:
                    out["start"] += [s for s, _, _ in at]
                    out["anchor"] += [g - s for s, _, g in at]
                    out["ctx"] += ctx
            yield batch(out, arrow)

    return docs.join(lists, keys).select("doc_id", "text", "tkey", "places").mapInArrow(run, schema)


def firsts(hashes: DataFrame) -> DataFrame:
    """doc_id, tkey, place, matched: contexts equal to an earlier one of their anchor (matched), and the first ones of anchors that
    have several. Streams over sorted rows and holds one."""
    spark = hashes.sparkSession
    arrow = to_arrow(spark, FIRSTS)

    def run(batches):
        anchor = context = last = None
        held: tuple | None = None
        for b in slices(batches):
            out: list[tuple] = []
            for a, c, doc, key, place in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if (doc, key, place) == last:  # repeated rows of one document count once
                    continue
                last = (doc, key, place)
                if a != anchor:
                    anchor, context, held = a, c, (doc, key, place, False)
                elif c == context:
                    out.append((doc, key, place, True))
                else:
                    if held:
                        out.append(held)
                        held = None
                    context = c
                    out.append((doc, key, place, False))
            yield batch(dict(zip(("doc_id", "tkey", "place", "matched"), zip(*out, strict=True) if out else ((),) * 4, strict=True)), arrow)

    dealt = hashes.repartition(partitions(spark), "ahash").sortWithinPartitions("ahash", "chash", "doc_id", "tkey", "place")
    return dealt.mapInArrow(run, FIRSTS)


def index_marks(contexts: DataFrame) -> DataFrame:
    """The matched spans of contexts, by run-length indexes over whole anchor groups."""
    spark = contexts.sparkSession
    arrow = to_arrow(spark, MARKS)

    def run(batches):
        groups, group, last, held = [], [], None, 0

        def marks():
            got = marks_of(groups)
            return batch(dict(zip(("doc_id", "tkey", "a", "b"), zip(*got, strict=True) if got else ((), (), (), ()), strict=True)), arrow)

        for b in slices(batches):
            for h, *ctx in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if h != last:
                    if len(group) > 1:
                        groups.append(group)
                        held += sum(len(c[4]) for c in group)
                    group, last = [], h
                    if held >= CHUNK:
                        yield marks()
                        groups, held = [], 0
                if not group or tuple(ctx[:3]) != group[-1][:3]:  # repeated rows of one document count once
                    group.append(tuple(ctx))
        if len(group) > 1:
            groups.append(group)
        if groups:
            yield marks()

    dealt = contexts.repartition(partitions(spark), "ahash").sortWithinPartitions("ahash", "doc_id", "tkey", "start")
    return dealt.mapInArrow(run, MARKS)


def hot_marks(contexts: DataFrame) -> DataFrame:
    """The matched spans of contexts of hot anchors: equal contexts, and then equal windows of the distinct ones, are merged by their
    bytes with partial aggregation."""
    place = F.struct("doc_id", "tkey", "start")
    contexts = written(contexts, "contexts")
    distinct = cut(contexts.groupBy("ctx").agg(F.min(place).alias("first")))
    late = contexts.join(distinct, "ctx").where(place > F.col("first")).select("doc_id", "tkey", F.col("start").alias("a"), (F.col("start") + F.octet_length("ctx")).alias("b"))
    offsets = F.explode(F.sequence(F.lit(0), F.octet_length("ctx") - LENGTH)).alias("o")
    windows = distinct.select("first.*", "ctx", offsets).select("doc_id", "tkey", (F.col("start") + F.col("o")).alias("start"), F.expr(f"substring(ctx, o + 1, {LENGTH})").alias("w"))
    single = windows.join(windows.groupBy("w").agg(F.min(place).alias("first")), "w").where(place > F.col("first"))
    return late.unionByName(single.select("doc_id", "tkey", F.col("start").alias("a"), (F.col("start") + LENGTH).alias("b")))


def repeated_spans(docs: DataFrame, keys: list[str]) -> DataFrame:
    """doc_id, tkey, a, b: spans (they may overlap) of bytes to remove; docs and keys are of keyed()."""
    lists = cut(anchor_lists(docs, keys))
    some = lambda c: lists.where(F.size(c) > 0).select(*keys, F.col(c).alias("places"))
    first = firsts(context_rows(docs, some("cold"), keys, hashes=True))
    start, size = F.shiftright("place", 14), F.shiftright("place", 7).bitwiseAND(F.lit(127)) + (LENGTH - 1)
    whole = first.where("matched").select("doc_id", "tkey", start.cast("int").alias("a"), (start + size).cast("int").alias("b"))
    rest = first.where("not matched").groupBy(*keys).agg(F.collect_set("place").alias("places"))
    marks = whole.unionByName(index_marks(context_rows(docs, rest, keys)))
    if lists.where(F.size("hot") > 0).isEmpty():
        return marks
    return marks.unionByName(hot_marks(context_rows(docs, some("hot"), keys)))


def without(text: bytes, marks: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal removed runs)."""
    runs: list[list[int]] = []
    for a, b in sorted(marks):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(b, runs[-1][1])
        else:
            runs.append([a, b])
    kept, at = [], 0
    for a, b in runs:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return b"".join(kept), sum(b - a for a, b in runs), len(runs)


def deduplicated(docs: DataFrame, full: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with full also kept (the bytes left, which needn't be UTF-8):
    one row for each row of docs."""
    spark = docs.sparkSession
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * full
    arrow = to_arrow(spark, schema)
    own, keys = keyed(docs)
    marks = repeated_spans(own, keys).groupBy(*keys).agg(F.collect_list(F.struct("a", "b")).alias("m"))

    def run(batches):
        for b in slices(batches):
            out = {f.name: [] for f in arrow}
            for i, t, m in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                kept, removed, n = without(t or b"", [(x["a"], x["b"]) for x in m or ()])
                for name, v in zip(out, (i, len(t or b""), removed, n, hashlib.sha256(kept).hexdigest(), kept), strict=False):
                    out[name].append(v)
            yield batch(out, arrow)

    return own.join(marks, keys, "left").select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "text", "m").mapInArrow(run, schema)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))
