"""Value and label functions, and operators that SQL has no equal of."""

from datetime import date, datetime, timedelta
from decimal import Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ticketloom import model, rules
from ticketloom.functions import text as X
from ticketloom.functions import values as V
from ticketloom.operators import audit, export, templates
from ticketloom.streaming import limiter, metrics


def column(spark, values, of, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"c {kind}").coalesce(1).select(of(F.col("c"))).collect()]


def test_rule_tables_have_the_right_sizes():
    assert len(model.FIELDS) == 70 and len(model.top_level()) == 45 and len(model.of_group("repo.")) == 15
    assert len(set(rules.label_keys())) == 251 and len(rules.LABELS) == 50 and len(rules.dictionary()) == 251 + 168 and len(rules.ABBREVIATIONS) == 19


def test_dates(spark):
    cases = [("15-Jan-1997", date(1997, 1, 15)), ("Friday, December 24, 2021", date(2021, 12, 24)), ("03/04/2021", date(2021, 4, 3)), ("04/13/2021", date(2021, 4, 13)), ("27.07.69", date(2069, 7, 27)), ("27.07.70", date(1970, 7, 27)), ("08012026", date(2026, 1, 8)), ("20260108", date(2026, 1, 8)), ("1st August 2024 10:30:00", date(2024, 8, 1)), ("31-Feb-2026", None), ("nope", None), ("", None), (None, None)]
    assert column(spark, [a for a, _ in cases], lambda c: V.parse_date(c, "DMY")["value"]) == [b for _, b in cases]
    assert column(spark, ["03/04/2021", "31-Feb-2026"], lambda c: V.parse_date(c)["error"]) == ["DATE_AMBIGUOUS", "DATE_INVALID"]


def test_date_round_trip(spark):
    found = []

    @settings(max_examples=60, deadline=None)
    @given(st.dates(date(1971, 1, 1), date(2069, 12, 31)))
    def collect(d):
        found.append(d)

    collect()
    for pattern in ("%d-%b-%Y", "%Y-%m-%d", "%d/%m/%Y", "%d %B %Y", "%d%m%Y"):
        assert column(spark, [d.strftime(pattern) for d in found if pattern != "%d%m%Y" or d.day < 19], lambda c: V.parse_date(c, "DMY")["value"]) == [d for d in found if pattern != "%d%m%Y" or d.day < 19]


def test_amounts(spark):
    units = V.map_of(rules.PROFILES["IN"]["units"])
    cases = [("5,00,00,000.00", "50000000"), ("50,000,000.00", "50000000"), ("5.00 Cr", "50000000"), ("INR 50 Lakh", "5000000"), ("(1,234.50)", "-1234.5"), ("Rs. 100/-", "100"), ("1,23,4", None), ("5 foo", None), ("", None)]
    assert column(spark, [a for a, _ in cases], lambda c: V.parse_amount(c, None, units)["value"]) == [None if b is None else Decimal(b) for _, b in cases]
    assert column(spark, ["5"], lambda c: V.parse_amount(c, F.lit("Nominal (Cr)"), units)["value"]) == [Decimal(50000000)]


def test_identifiers(spark):
    assert column(spark, ["INE917S07032", "US0378331006", "US0378331005\n", None], V.isin_ok) == [True, False, False, False]
    assert column(spark, ["IN00 2024 0A75", "x US0378331006 US0378331005", "US0378331006", "none"], lambda c: V.normalize_isin(c)["value"]) == ["IN0020240A75", "US0378331005", "US0378331006", None]
    assert column(spark, ["pan abcpd1234e.", "x"], lambda c: V.normalize_pan(c)["value"]) == ["ABCPD1234E", None]
    assert column(spark, ["ACME / INE999A07087", "X (ISIN - INE999M07033)", "INE999A07087"], V.clean_security_name) == ["ACME", "X", None]


def test_labels(spark):
    assert column(spark, ["Total Consideration (INR)", "(INR)"], X.short_key) == ["total consideration", "inr"]
    assert column(spark, ["No. of Bonds", "12345", "", "x" * 61, "A1"], X.label_like) == [True, False, False, False, False]
    assert column(spark, ["____", " a   b ", None], X.clean_cell) == ["", "a b", ""]
    assert column(spark, ["stl dt"], X.expand_abbreviations) == ["settlement date"]


def test_limiter_is_a_fold(spark):
    t0, seen = datetime(2024, 1, 1), []
    for i, (sec, ok) in enumerate([(0, 0), (10, 0), (20, 0), (30, 0), (40, 1), (200, 0), (210, 1), (220, 0), (230, 0), (240, 0)]):
        seen.append(("a", t0 + timedelta(seconds=sec), bool(ok)))
    got = sorted(map(tuple, limiter.limit(spark.createDataFrame(seen, "key string, ts timestamp, ok boolean"), 3, 60, 100).collect()), key=lambda r: r[1])
    assert [r[2] for r in got] == [False, False, False, True, True, False, False, False, False, False] and got[-1][3] == 0


def test_streams(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")
    metrics.run_available(metrics.windowed(s, "1 day"), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = spark.read.schema("start timestamp, event_type string, n long, total double").parquet(f"{tmp_path}/out")
    want = e.groupBy(F.date_trunc("day", "ts").alias("start"), "event_type").agg(F.count("*").alias("n"))
    assert got.count() > 0 and got.select("start", "event_type", "n").exceptAll(want).count() == 0  # the last windows stay open
    q = limiter.limit_stream(s.select(F.col("user_id").cast("string").alias("key"), "ts", (F.col("event_type") != "error").alias("ok")), 3, 1e6, 1e6)
    metrics.run_available(q, f"{tmp_path}/lim", f"{tmp_path}/cp2")
    batch = limiter.limit(e.select(F.col("user_id").cast("string").alias("key"), "ts", (F.col("event_type") != "error").alias("ok")), 3, 1e6, 1e6)
    assert spark.read.parquet(f"{tmp_path}/lim").exceptAll(batch).count() == 0


def test_chain_and_search(spark):
    rows = [(i, f"2024-01-0{1 + i // 3}T00:00:0{i}Z", "k", f"pan ABCPD1234E {i}") for i in range(9)]
    log = audit.scrub(spark.createDataFrame(rows, "seq long, occurred_at string, actor_id string, details string"))
    chained = audit.link(log, "actor_id", log.columns)
    ok = audit.verify(chained, "actor_id", log.columns).first()
    assert (ok.checked, ok.first_bad_seq, ok.reason) == (9, None, None) and "ABCPD****E" in chained.first().details
    cut = chained.where("seq <> 4")
    bad = audit.verify(cut, "actor_id", log.columns).first()
    assert (bad.checked, bad.first_bad_seq, bad.reason) == (5, 5, "prev_hash_mismatch")
    assert [r.seq for r in audit.page(audit.search(log, after="2024-01-02", before="2024-01-02"), 2).collect()] == [5, 4]


def element(name, value):
    """XML as a plain walk over the value."""
    t = export.tag(name)
    if value is None:
        return f'<{t} null="true"/>'
    if isinstance(value, dict):
        return f"<{t}>{''.join(element(k, v) for k, v in value.items())}</{t}>"
    if isinstance(value, list):
        return f"<{t}>{''.join(element('item', v) for v in value)}</{t}>"
    text = str(value).lower() if isinstance(value, bool) else str(value)
    return f"<{t}>{text.replace('&', '&amp;').replace('<', '&lt;').replace('>', '&gt;')}</{t}>"


def test_xml(spark):
    assert element("deal", {"a b": None, "1x": [1, True], "t": "<&"}) == '<deal><a_b null="true"/><_1x><item>1</item><item>true</item></_1x><t>&lt;&amp;</t></deal>'
    schema = "s string, `1 x` array<struct<a:int,`é b`:boolean>>, m map<string,double>, d date, n decimal(10,2), e struct<p:string,q:array<string>>"
    import datetime
    import decimal

    rows = [
        ("a<b>&\"é", [(1, True), None, (None, False)], {"x y": 1.5, "9": None}, datetime.date(2024, 1, 2), decimal.Decimal("1.50"), (None, [])), (None, None, None, None, None, None), ("", [], {}, None, None, ("", [None, "z"])),
    ]
    df = spark.createDataFrame(rows, schema)
    got = export.to_xml(df.select(F.struct("*").alias("r")), "r").collect()
    plain = lambda x: {k: plain(v) for k, v in (x.asDict() if hasattr(x, "asDict") else x).items()} if hasattr(x, "items") or hasattr(x, "asDict") else [plain(v) for v in x] if isinstance(x, list) else x
    for r in got:
        inner = "".join(element(k, v) for k, v in plain(r.r).items())
        assert r.xml == f'<?xml version="1.0" encoding="UTF-8"?><parse_result schema_version="1">{inner}</parse_result>'


def test_audit_export(spark, tmp_path):
    log = spark.createDataFrame([(2, "=x", {"b": "1", "a": "é"}, None), (1, "ok,\"q", None, "e")], "seq long, action string, details map<string,string>, error string")
    rows = audit.export_rows(log).collect()
    assert rows[0].asDict() == {"seq": 1, "action": 'ok,"q', "error": "e", "details": None} and (rows[1].action, rows[1].details) == ("'=x", '{"a": "é", "b": "1"}')
    audit.write_csv(log.coalesce(1), str(tmp_path / "x"))
    text = next((tmp_path / "x").glob("*.csv")).read_bytes().decode()
    assert text == '\ufeffseq,action,error,details\n1,"ok,""q",e,\n2,\'=x,,"{""a"": ""é"", ""b"": ""1""}"\n'


def test_exports():
    import xml.etree.ElementTree as E

    assert len(list(E.fromstring(export.xsd(model.deal_schema())).iter("{http://www.w3.org/2001/XMLSchema}element"))) == 45 + 1 + 2 + 4 + 15


def test_template_rules():
    bad = {"label_map": {"x": "nope"}, "region_rules": [{"field": "isin", "bbox": [5, 1, 2, 3]}], "regex_rules": [{"field": "isin", "pattern": "(", "group": 1}, {"field": "price", "pattern": "a", "group": 1}], "constants": {"market": "IN"}}
    assert len(templates.problems(bad)) == 5 and templates.problems({"label_map": {"x": "_ignore", "y": "price"}}) == []
