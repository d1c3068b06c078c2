"""op12 against all pairs: planted copies around a similarity of 0.85, hot groups, chains, shared passages, repeated and null ids."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketloom.llm import op12_minhash as op12

from test_near_copies import planted, shingles

SCHEMA = "doc_id long, text string, node int, key string, u int, tkey string"


def plain(rows):
    sets = [shingles(t) for _, t in rows]
    links = collections.defaultdict(list)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                links[i].append(j)
                links[j].append(i)
    out = []
    for i, (d, _) in enumerate(rows):
        seen, open_ = {i}, [i]
        while open_:
            for j in links[open_.pop()]:
                if j not in seen:
                    seen.add(j)
                    open_.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((d, len(sets[i]), least, d == least))
    return out


@pytest.fixture(scope="module")
def rows():
    found = planted()
    hot = [" ".join(f"w{k}" for k in range(120))] * 150
    return found + [(5000 - i, t) for i, t in enumerate(hot)] + [(3, found[0][1]), (None, "quite alone it is and without an id"), (None, None)]


def columns(found):
    return found.select("doc_id", "q", "first_id", F.col("doc_id").eqNullSafe(F.col("first_id")))


def test_minhash(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, "k", 2, "t") for i, t in rows], SCHEMA).repartition(5)
    assert collections.Counter(map(tuple, columns(op12.groups(docs)).collect())) == collections.Counter(plain(rows))
    assert op12.groups(docs.limit(0)).count() == 0


def test_blocks_of_a_list(spark, rows, monkeypatch):
    """Blocks of a few nodes and pairs find the same."""
    for name, n in (("OUTSIDE", 3), ("ALL", 7), ("PAIRS", 2)):
        monkeypatch.setattr(op12, name, n)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert collections.Counter(map(tuple, columns(op12.groups(docs)).collect())) == collections.Counter(plain(rows))


def test_short_keys_agree_by_similarity():
    rng = np.random.default_rng(3)
    met = [0, 0]
    for _ in range(300):
        x = rng.integers(0, 1 << 63, 1000, np.uint64) * np.uint64(2)
        y = np.concatenate([x[:919], rng.integers(0, 1 << 63, 81, np.uint64)])  # similarity 919 / 1081 = 0.85
        same = op12.short_keys(x, op12.HALF, op12.KEYS) == op12.short_keys(y, op12.HALF, op12.KEYS)
        met[0] += same.any(axis=1).all()
        met[1] += same.sum()
    assert met[0] >= 297 and abs(met[1] / 300 / 18 - 0.85**3) < 0.03


def test_sketches_and_sizes_never_rule_out_links(spark):
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(300):
        n, apart = int(rng.integers(1, 3000)), rng.random() * 0.3
        x = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2)
        y = np.concatenate([x[int(apart * n / 2) :], rng.integers(0, 1 << 63, int(apart * n / 2), np.uint64)])
        rows.append((len(x), op12.sketch(x).tolist(), len(y), op12.sketch(y).tolist(), op12.similar(np.sort(x), np.sort(y), 85)))
    found = spark.createDataFrame(rows, "q_a int, odd_a array<long>, q_b int, odd_b array<long>, linked boolean")
    out = found.select("linked", op12.fit("{}_a", "{}_b", 85).alias("fit")).groupBy("linked", "fit").count().collect()
    assert {(r.linked, r.fit) for r in out} >= {(True, True), (False, False)} and (True, False) not in {(r.linked, r.fit) for r in out}
