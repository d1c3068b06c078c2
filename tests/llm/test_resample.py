"""op11 against a plain version: nulls, empty and long texts, repeated rows, ties, no target, clashing names."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketloom.llm import op11_resample as op11

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, rank string, score int, row string, n_words int"


def features(t):
    w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    return len(w), [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain(docs, target):
    """(doc_id, n_features, weight, score) of all, and of the drawn in order."""
    count = lambda ts: collections.Counter(zlib.crc32(f.encode()) % 10000 for t in ts for f in features(t)[1])
    s, t = count(x for _, x in docs), count(target)
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + 10000) / ((s[b] + 1) * (total_t + 10000)))) for b in range(10000)]
    rows, able = [], []
    for i, x in docs:
        n, f = features(x)
        weight = sum(gain[zlib.crc32(y.encode()) % 10000] for y in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
        able += [rows[-1]] if n >= 20 else []
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    return rows, able[: 5 * len(able) // 100]


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("etaoinSHR é日", k=rng.randint(1, 7)))
    rows = [(i - 50, " ".join(word() for _ in range(rng.choice([3, 25, 60, 300])))) for i in range(300)]
    rows += [(None, rows[5][1]), (None, None), (7, ""), (8, "..."), (9, None), (10, "x" * 70_000 + " y " * 30), (1 << 62, rows[3][1]), (-(1 << 62), rows[3][1])]
    return rows + [rows[4]] * 60 + [rows[9]] * 3


def test_resample(spark):
    rows, target = corpus(), ["nation shorten é日 SHORE", None, "", corpus()[20][1]]
    docs = spark.createDataFrame([(i, t, "a", 1, "b", 2) for i, t in rows], SCHEMA).repartition(5)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    all_, drawn = plain(rows, target)
    got = op11.resampled(docs, bench).collect()
    assert collections.Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == collections.Counter(all_)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1)) and [(r.doc_id, r.score) for r in ranked] == [(r[0], r[3]) for r in drawn] and drawn
    none = spark.createDataFrame([], SCHEMA)
    assert op11.resampled(none, bench).count() == 0
    no_target = op11.resampled(docs, bench.limit(0)).where("rank is not null").orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in no_target] == [(r[0], r[3]) for r in plain(rows, [])[1]]
    unique = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).drop("rank")
    assert set(op11.sample(unique, bench, percent=50).columns) == {*unique.columns, "rank"} and op11.sample(unique, bench, percent=50).count() > 20


@pytest.mark.parametrize("k", [0, 1, 9, 500, 999, 1000])
def test_exact_selection(spark, k):
    rows = spark.range(1000).select((F.col("id") % 7).alias("a"), (-F.col("id") * 123456789123).bitwiseXOR(F.lit(-(1 << 63))).alias("b"), "id")
    kept = rows.where(op11.drawn_first(rows, [F.col("a"), F.col("b")], k)).collect()
    want = sorted(range(1000), key=lambda i: (i % 7, -i))[:k]
    assert sorted(r.id for r in kept) == sorted(want)


def test_buckets_are_crcs():
    rng = random.Random(2)
    for _ in range(200):
        text = " ".join("".join(rng.choices("aé日z09", k=rng.choice([1, 3, 20, 64, 65, 200]))) for _ in range(rng.randint(0, 6)))
        assert sorted(op11.buckets(*op11.words(text.encode())).tolist()) == sorted(zlib.crc32(f.encode()) % 10000 for f in features(text)[1])


def test_parts(monkeypatch):
    text = ("one two-three é日 " * 50).encode()
    whole = [x.tolist() for x in op11.words(text)]
    monkeypatch.setattr(op11, "PART", 7)
    assert [x.tolist() for x in op11.words(text)] == whole and b"".join(op11.parts(text)) == text
    assert np.array_equal(op11.buckets(*op11.words(b"")), np.zeros(0))
