"""Near copies against a plain version: planted copies at a five-word similarity of 0.8 to 0.95, hot groups, chains, repeated ids."""

import random
import re

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ticketloom.llm import near_copies, op3_simhash, op12_minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t):
    w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def plain(rows):
    """The rows that stay, in order."""
    sets, lab = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= 0.8 - 1e-9 and lab[i] != lab[j]:
                a, b = lab[i], lab[j]
                lab = [a if x == b else x for x in lab]
    out = []
    for i, (d, t) in enumerate(rows):
        ids = [(e, x or "") for k, (e, x) in enumerate(rows) if lab[k] == lab[i] and e is not None]
        out += [(d, t)] if d is None or d == min(e for e, _ in ids) else []
    return out


def planted():
    rng, rows, seen = random.Random(3), [], []
    word = lambda: "".join(rng.choices("etaoinshr", k=rng.randint(3, 8)))
    passage = " ".join(word() for _ in range(60))
    for _ in range(40):
        w = [word() for _ in range(rng.choice([4, 8, 60, 150, 400]))]
        rows.append(" ".join(w))
        for edits in (1, 1, 2, 3, 4, 6, 9):
            x = list(w)
            for _ in range(edits):
                x[rng.randrange(len(x))] = word()
            rows.append(" ".join(x))
            seen.append(similarity(shingles(rows[-1]), shingles(" ".join(w))))
    rows += [passage + " " + " ".join(word() for _ in range(40)) for _ in range(40)]
    hot = [word() for _ in range(200)]
    for _ in range(60):
        x = list(hot)
        for _ in range(4):
            x[rng.randrange(len(x))] = word()
        rows.append(" ".join(x))
    chain = [word() for _ in range(300)]
    rows += [" ".join(chain[k : k + 150]) for k in range(0, 120, 12)]
    rows += ["", None, " \n", "one two", "One two", "two one", rows[5], rows[9].upper()]
    order = list(range(len(rows)))
    rng.shuffle(order)
    assert sum(0.8 <= s < 0.95 for s in seen) > 20
    return list(zip(order, rows, strict=True)) + [(None, rows[0]), (None, rows[0])]


def test_near_copies(spark):
    rows = planted()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, tkey string, node int").repartition(3)
    got = near_copies.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == sorted((str(i), str(t)) for i, t in plain(rows))
    assert near_copies.one_of_each(docs.limit(0)).count() == 0


def test_repeated_ids(spark):
    a, b = "one two three four five six seven", "a text that is quite another one, and longer"
    docs = spark.createDataFrame([(4, a), (9, a), (2, b), (4, b)], "doc_id long, text string")
    assert sorted(map(tuple, near_copies.one_of_each(docs).collect())) == [(2, b), (4, a)]


def test_fingerprints_meet_first(spark, monkeypatch):
    """The trie self-join of op3 gives the first pairs; they are linked if their sets are similar, and the tables find the rest."""
    rng, found = np.random.default_rng(6), []
    for n in (1, 2, 9, 1000):
        x = np.unique(rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + rng.integers(0, 2, n, np.uint64))
        ones = [sum(int(h) >> b & 1 for h in x) for b in range(64)]
        assert near_copies.print_of(x) == op3_simhash.signed(sum(1 << b for b, k in enumerate(ones) if 2 * k > len(x)))

    own = op12_minhash.verified

    def verified(pairs, nodes, docs, percent):
        out = own(pairs, nodes, docs, percent)
        found.append((pairs.count(), out.count()))
        return out

    monkeypatch.setattr(op12_minhash, "verified", verified)
    rows = planted() + [(900 + i, " ".join(f"w{k}" for k in range(400) if k != 7 * i)) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = lambda: sorted((str(r.doc_id), str(r.text)) for r in near_copies.one_of_each(docs).collect())
    want = sorted((str(i), str(t)) for i, t in plain(rows))
    assert kept() == want and found[0][1] >= 3  # the six, all within a few bits
    # pairs that aren't similar and pairs that the trie doesn't find change nothing
    pairs = spark.createDataFrame([(0, 0)], "u long, v long")
    for links in (lambda fps: fps.select(F.col("fp").alias("u"), F.min("fp").over(Window.partitionBy()).alias("v")), lambda fps: pairs.limit(0)):
        monkeypatch.setattr(near_copies, "trie_links", links)
        assert kept() == want
