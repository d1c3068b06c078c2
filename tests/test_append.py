"""The numbered log: parts against the whole, replays, a writer lost half-way, a stream; totals and ranges of the search."""

import contextlib
import hashlib
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from ticketloom.operators import append, audit, numbering

SCHEMA = "t int, actor_id string, details map<string,string>"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def events(n=900):
    rng = random.Random(1)
    return [(t, rng.choice(["hot"] * 3 + ["a", "b", None, 'q"é']), {"z": str(t), "a": "x\n"}) for t in range(n)]


def plain(rows):
    out, heads = [], {}
    for seq, (t, actor, details) in enumerate(rows, 1):
        body = {"actor_id": actor, "details": details, "prev_hash": heads.get(actor, audit.GENESIS), "seq": seq, "t": t}
        own = hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
        out.append((seq, t, actor, body["prev_hash"], own))
        heads[actor] = own
    return out


def got(spark, path):
    return sorted((r.seq, r.t, r.actor_id, r.prev_hash, r.row_hash) for r in append.read(spark, path).collect())


def test_parts_are_the_whole(spark, tmp_path):
    rows = events()
    log = spark.createDataFrame(rows, SCHEMA)
    whole, parts = str(tmp_path / "whole"), str(tmp_path / "parts")
    assert append.append(log.repartition(5), whole, 0, [F.col("t")], "actor_id")
    for batch, (a, b) in enumerate([(0, 300), (300, 310), (310, 310), (310, 900)]):
        part = log.where(f"t >= {a} and t < {b}").repartition(3)
        assert append.append(part, parts, batch, [F.col("t")], "actor_id")
        assert not append.append(part, parts, batch, [F.col("t")], "actor_id")
    assert got(spark, whole) == got(spark, parts) == plain(rows)
    assert audit.verify(append.read(spark, parts), "actor_id", ["actor_id", "details", "seq", "t"]).where("reason is not null").count() == 0


def test_lost_writer(spark, tmp_path):
    rows, path = events(200), str(tmp_path / "log")
    log = spark.createDataFrame(rows, SCHEMA)
    append.append(log.where("t < 100"), path, 0, [F.col("t")], "actor_id")
    half = log.where("t >= 100 and t < 120").withColumns({"seq": F.lit(7).cast("long"), "prev_hash": F.lit("x"), "row_hash": F.lit("y")})
    half.write.parquet(f"{path}/data/batch=1")  # no commit
    assert append.read(spark, path).count() == 100
    append.append(log.where("t >= 100"), path, 1, [F.col("t")], "actor_id")
    assert got(spark, path) == plain(rows)


def test_stream(spark, tmp_path):
    rows, path = events(300), str(tmp_path / "log")
    for i in range(3):
        spark.createDataFrame(rows[100 * i : 100 * i + 100], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(append.sink(path, [F.col("t")], "actor_id")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert got(spark, path) == plain(rows) and append.commits(spark, path).count() == 3


def test_dense_numbers_of_a_hot_key(spark):
    df = spark.range(20_000).select((F.col("id") % 3 * 0).alias("same"), "id").repartition(7)
    seq = {r.id: r.n for r in numbering.numbered(df, [F.col("same"), F.col("id").desc()], "n", 5).collect()}
    assert seq == {i: 5 + 19_999 - i for i in range(20_000)}
    assert sorted(r.n for r in numbering.numbered(df.limit(50), [F.col("same")], "n").collect()) == list(range(1, 51))
    assert numbering.numbered(df.limit(0), [F.col("same")], "n").count() == 0


@pytest.mark.parametrize(("after", "before"), [("2024-01-02", None), (None, "2024-01-02T05"), ("2024-01-01T2", "2024-01-03"), ("2024", "2024"), ("2025", None), ("2024-01-02T03:00:00Z!", None)])
def test_prefix_ranges(spark, tmp_path, after, before):
    stamps = [f"2024-01-0{d}T{h:02d}:00:00Z" for d in range(1, 5) for h in range(24)] + ["2023-12-31", "2024", "2024-01-02é"]
    path = str(tmp_path / "log")
    spark.createDataFrame(list(enumerate(stamps)), "seq long, occurred_at string").write.parquet(path)
    found = audit.search(spark.read.parquet(path), after=after, before=before)
    want = [s for s in stamps if (not after or s[: len(after)] >= after) and (not before or s[: len(before)] <= before)]
    assert sorted(r.occurred_at for r in found.collect()) == sorted(want)
    pushed = plan(found).split("PushedFilters: ")[1].split("\n")[0]
    assert ("GreaterThanOrEqual(occurred_at" in pushed) == bool(after) and ("LessThan(occurred_at" in pushed) == bool(before)


def test_total_in_one_pass(spark):
    df = spark.range(1000).select(F.col("id").alias("seq"), (F.col("id") % 2).alias("x")).repartition(4).where("x = 0")
    rows, total = audit.page_with_total(df, 20, 30)
    assert total == 500 and [r.seq for r in rows] == [998 - 2 * (30 + i) for i in range(20)]
    assert audit.page_with_total(df.where("false"), 5) == ([], 0)
    with pytest.raises(ValueError, match="limit"):
        audit.page_with_total(df, 501)
