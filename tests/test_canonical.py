"""Canonical JSON against json.dumps, on nested and odd values."""

import datetime
import decimal
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketloom.functions import canonical

SCHEMA = "z int, a struct<y:double,`b c`:string,m:map<string,array<double>>>, l array<struct<q:boolean,p:bigint>>, d date, n decimal(20,4), t timestamp, k map<string,map<string,string>>, f float"


def rows():
    rng = random.Random(6)
    text = lambda: "".join(rng.choices('ab"\\/\n\t\r\b\f\x00\x1f\x7fé日😀 <&>', k=rng.randint(0, 8)))
    maybe = lambda f: None if rng.random() < 0.15 else f()
    number = lambda: rng.choice([0.0, -0.0, 1.0, 100.0, 1e15, 1e16, 123456789012345680.0, 1e-4, 1e-5, -2.5e-7, 1e22, 1.5e300, float("inf"), float("-inf"), round(rng.uniform(-1e6, 1e6), 3), rng.randint(-9, 9) / 8])
    out = []
    for _ in range(300):
        a = maybe(lambda: (maybe(number), maybe(text), maybe(lambda: {text(): maybe(lambda: [maybe(number) for _ in range(2)]) for _ in range(3)})))
        out.append((
            maybe(lambda: rng.randint(-5, 5)), a, maybe(lambda: [maybe(lambda: (maybe(lambda: rng.random() < 0.5), maybe(lambda: rng.randint(-(10**15), 10**15)))) for _ in range(rng.randint(0, 3))]),
            maybe(lambda: datetime.date(2020, 1, rng.randint(1, 31))), maybe(lambda: decimal.Decimal(rng.randint(-(10**9), 10**9)).scaleb(-4)),
            maybe(lambda: datetime.datetime(2020, 5, 1, 2, 3, 4, rng.choice([0, 5, 120000]))), maybe(lambda: {text(): maybe(lambda: {text(): maybe(text)}) for _ in range(2)}), maybe(lambda: rng.choice([0.5, -3.0, 1e10])),
        ))
    return out


def plain(x):
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    if isinstance(x, T.Row):
        return {k: plain(v) for k, v in x.asDict().items()}
    return [plain(v) for v in x] if isinstance(x, list) else x


def test_as_json_dumps(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    whole = F.struct(*(F.col(c) for c in df.columns))
    got = df.select(*df.columns, canonical.json_text(whole, df.schema).alias("text"), canonical.json_text(whole, df.schema, " ").alias("wide")).collect()
    assert len(got) == 300
    for r in got:
        value = {k: v for k, v in plain(r).items() if k not in ("text", "wide")}
        assert r.wide == json.dumps(value, sort_keys=True, ensure_ascii=False, default=str)
        assert r.text == json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)


def test_doubles(spark):
    rng = random.Random(8)
    values = [s * m * 10.0**e for e in range(-30, 31) for m in (1, 1.5, 9.99, 1.23456789) for s in (1, -1)] + [rng.uniform(-1, 1) * 10.0 ** rng.randint(-6, 18) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", canonical.float_text(F.col("v")).alias("text")).collect()
    assert [r.text for r in got] == [repr(r.v) for r in got]


def test_no_text_of_binary(spark):
    with pytest.raises(TypeError):
        canonical.json_text(F.col("x"), T.BinaryType())
    assert spark.range(1).select(canonical.json_text(F.lit(None), T.NullType())).first()[0] == "null"
