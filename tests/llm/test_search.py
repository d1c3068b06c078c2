"""op13 against a plain version: nulls, ties at the k-th score, repeated rows, several shards and blocks, long texts, clashing names."""

import collections
import math
import random
import re

import numpy as np
import pyarrow.parquet as pq

from ticketloom.llm import common
from ticketloom.llm import op13_search as op13

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, score int, item_id int, rank string, term string"


def terms(t):
    return TERM.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))


def plain(docs, items, k):
    tf = [collections.Counter(terms(t)) for _, t in docs]
    n = [sum(c.values()) for c in tf]
    n_docs, total, df = sum(x > 0 for x in n), sum(n), collections.Counter(t for c in tf for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item, text in items:
        found = []
        for (i, _), c, m in zip(docs, tf, n, strict=True):
            score = sum(weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * (50 + 50 * m * n_docs // total))) for t in set(terms(text)) if t in c)
            found += [(-score, i is None, i or 0, i)] if score > 0 else []
        out += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k])]
    return out


def corpus():
    rng = random.Random(13)
    words = ["".join(rng.choices("etaoinSHR9é日", k=rng.randint(1, 5))) for _ in range(150)]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([1, 4, 30, 200])))) for i in range(200)]
    docs += [(500 - i, "the very same text") for i in range(120)] + [(None, "the very same text")] * 3 + [(7, "same")] * 2
    docs += [(None, None), (600, ""), (601, "-- ."), (602, words[0] * 3000 + " " + " ".join(words * 20)), (603, None)]
    items = [(i, " ".join(rng.choices(words, k=8))) for i in range(12)] + [(20, "same"), (20, "same text"), (21, None), (22, ""), (23, "nowhere-to-be-found"), (None, "VERY É"), (24, "the the the same")]
    return docs, items


def test_search(spark, monkeypatch):
    docs, items = corpus()
    table = spark.createDataFrame([(i, t, 1, 2, "r", "x") for i, t in docs], DOCS)
    bench = spark.createDataFrame([(i, t, "y", 3) for i, t in items], "item_id long, text string, term string, item int")
    for parts, tokens, block in ((1, 10**9, 10**6), (4, 300, 10)):
        monkeypatch.setattr(op13, "BLOCK", block)
        shards, n = op13.index(table.repartition(parts), tokens)
        assert shards.count() == 1 if parts == 1 else shards.count() > 8
        for k in (50, 7):
            got = op13.search(shards, n, bench.repartition(2), k)
            assert got.columns == ["item_id", "rank", "doc_id", "score"]
            assert collections.Counter(map(tuple, got.collect())) == collections.Counter(plain(docs, items, k))
    none = spark.createDataFrame([], DOCS)
    assert op13.search(*op13.index(none), bench).count() == 0 and op13.search(shards, n, bench.limit(0)).count() == 0


def test_ties_are_cut_by_id():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, k = int(rng.integers(1, 40)), int(rng.integers(1, 12))
        scores, ids, none = rng.integers(-1, 4, n), rng.permutation(n), rng.random(n) < 0.2
        want = sorted((i for i in range(n) if scores[i] > 0), key=lambda i: (-scores[i], none[i], ids[i]))[:k]
        assert op13.best(scores, none, ids, k).tolist() == want


def test_counts_of_terms(monkeypatch):
    monkeypatch.setattr(op13, "PART", 5)
    for t in ("", "a", " a", "a b", "é日-x9 Z.", "one two  three", "@[`{"):
        assert op13.n_terms(t.encode()) == len(terms(t)) and [x.decode() for p in op13.terms(t.encode()) for x in p] == terms(t)


def test_a_task_holds_one_shard(spark, monkeypatch):
    """Of a file with many shards a reader has one row group, and an Arrow batch, for each."""
    monkeypatch.setitem(common.LARGE_ROWS, "parquet.block.size", 1)
    docs, items = corpus()
    shards, n = op13.index(spark.createDataFrame([(i, t, 1, 2, "r", "x") for i, t in docs], DOCS).repartition(1), 300)
    groups = [pq.ParquetFile(f.removeprefix("file:")).metadata.num_row_groups for f in shards.inputFiles()]
    assert len(groups) == 1 and groups[0] == shards.count() > 8
    rows, kept = [], op13.written
    monkeypatch.setattr(op13, "written", lambda df, name, **options: (rows.append((name, spark.conf.get(common.ARROW_KEY))), kept(df, name, **options))[1])
    own = spark.conf.get(common.ARROW_KEY)
    op13.search(shards, n, spark.createDataFrame(items, "item_id long, text string"))
    assert ("hits", "1") in rows and spark.conf.get(common.ARROW_KEY) == own
