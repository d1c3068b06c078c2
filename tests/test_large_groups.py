"""Operators over one large group: links, limits and ranks don't gather it in a row, a pandas group or one task's window."""

import contextlib
import hashlib
import io
import json
import random

from pyspark.sql import functions as F

from ticketloom.operators import audit, metrics
from ticketloom.streaming import limiter


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_link_streams(spark):
    log = spark.range(30_000).select(F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, "one").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("actor_id"), F.lit("x").alias("action")).repartition(5)
    chained = audit.link(log, "actor_id", log.columns)
    assert "collect_list" not in plan(chained)
    rows = {r.seq: r for r in chained.where("actor_id = 'one'").collect()}
    assert len(rows) == 10_000 and chained.count() == 30_000
    last = audit.GENESIS
    for seq in sorted(rows):
        assert rows[seq].prev_hash == last
        last = hashlib.sha256(json.dumps({"action": "x", "actor_id": "one", "prev_hash": last, "seq": seq}, separators=(",", ":")).encode()).hexdigest()
        assert rows[seq].row_hash == last


def test_limit_streams(spark):
    rng = random.Random(2)
    seen = [(rng.choice(["hot", "hot", "a", None]), t, rng.random() < 0.3) for t in range(0, 300_000, 20)]
    events = spark.createDataFrame(seen, "key string, t long, ok boolean").select("key", F.timestamp_seconds("t").alias("ts"), "ok").repartition(5)
    got = limiter.limit(events, 3, 60, 100)
    assert "Pandas" not in plan(got)
    want = []
    for key in ("hot", "a", None):
        state = ([], 0.0)
        for k, t, ok in seen:
            if k == key:
                state, blocked = limiter.step(state, t, ok, 3, 60, 100)
                want.append((str(k), t, blocked, len(state[0])))
    assert sorted((str(r.key), r.t, r.blocked, r.failures) for r in got.withColumn("t", F.unix_seconds("ts")).collect()) == sorted(want)


def test_percentile_ranks_by_range(spark):
    rng = random.Random(4)
    rows = [(g, None if rng.random() < 0.1 else rng.choice([1.0, 2.5, -3.0, rng.gauss(0, 9)])) for g in ["a"] * 700 + ["b"] * 90 + [None] * 9] + [("one", 4.0), ("two", 1.0), ("two", 2.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    for p in (0.01, 0.5, 0.95, 0.999):
        want = {}
        for g in {g for g, _ in rows}:
            v = sorted(x for h, x in rows if h == g and x is not None)
            if len(v) > 1:
                low = min(max(int(p * (len(v) + 1)), 1), len(v) - 1)
                want[g] = (len(v), round(v[low - 1] + (p * (len(v) + 1) - low) * (v[low] - v[low - 1]), 6))
        got = metrics.exclusive_percentile(df, "v", p, ["g"])
        assert "row_number" not in plan(got)
        assert {r.g: (r.n, round(r.value, 6)) for r in got.collect()} == want
