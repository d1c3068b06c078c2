"""Readers of files, templates and logs; template match with keywords; patterns with Unicode classes."""

import hashlib
import json

from pyspark.sql import functions as F

from ticketloom.functions import text as X
from ticketloom.operators import audit, export, templates
from ticketloom.sources import files


def test_uploads_and_decoding(spark, tmp_path):
    for name, content in (("a.pdf", b"%PDF-1.4 one"), ("b.pdf", b" \n%PDF-1.7 two"), ("c.txt", b"hello"), ("d.pdf", b"%PDF-" + b"x" * 200), ("e.pdf", b"%PDF-bad")):
        (tmp_path / name).write_bytes(content)
    found = files.uploads(spark, str(tmp_path), max_bytes=100)
    rows = {r.file.rpartition("/")[2]: r for r in found.collect()}
    assert {k: r.error for k, r in rows.items()} == {"a.pdf": None, "b.pdf": None, "c.txt": "UNSUPPORTED_FILE", "d.pdf": "FILE_TOO_LARGE", "e.pdf": None}
    assert rows["a.pdf"].sha256 == hashlib.sha256(b"%PDF-1.4 one").hexdigest() and rows["c.txt"].content is None

    def decode(content):
        if b"bad" in content:
            raise ValueError("INVALID_PDF")
        return [{"text": content.decode().strip(), "words": [("one", 1.0, 2.0, 3.0, 4.0)]}, {"text": "", "words": []}]

    pages = {(r.slip_id, r.page): r for r in files.decoded(found, decode).collect()}
    a = rows["a.pdf"].sha256
    assert pages[(a, 1)].text == "%PDF-1.4 one" and pages[(a, 1)].words[0].text == "one" and pages[(a, 2)].error is None
    assert sorted(r.error for r in pages.values() if r.error) == ["FILE_TOO_LARGE", "INVALID_PDF", "UNSUPPORTED_FILE"]


def test_templates_and_logs(spark, tmp_path):
    versions = [{"template_id": "a", "version": v, "market": m, "fingerprint_labels": ["x"], "label_map": {"k": "isin"}} for v, m in ((1, "IN"), (3, "US"), (2, "GB"))] + [{"template_id": "b", "version": 1}]
    (tmp_path / "t.json").write_text("\n".join(map(json.dumps, versions)))
    assert sorted((r.template_id, r.version, r.market) for r in files.read_templates(spark, str(tmp_path / "t.json")).collect()) == [("a", 3, "US"), ("b", 1, None)]
    log = [{"seq": i, "actor_id": "k", "action": "x", "occurred_at": f"2024-01-0{i}"} for i in (1, 2)]
    (tmp_path / "log.json").write_text("\n\n".join(map(json.dumps, log)) + "\n")
    read = files.read_log(spark, str(tmp_path / "log.json"))
    assert [(r.seq, r.action, r.details) for r in read.orderBy("seq").collect()] == [(1, "x", None), (2, "x", None)]
    assert audit.search(read, after="2024-01-02").count() == 1


def test_keywords_gate_the_match(spark):
    slips = spark.createDataFrame([(1, "Treasury BILL slip", ["a", "b"]), (2, "nothing", ["a", "b"]), (3, None, ["a"])], "slip_id int, text string, labels array<string>")
    t = spark.createDataFrame([("k", ["a", "b"], ["treasury", "Bill"], 0.0), ("n", ["a", "c"], [], 0.3), ("z", ["b"], None, 0.0)], "template_id string, fingerprint_labels array<string>, keywords array<string>, match_threshold double")
    got = {r.slip_id: (r.template_id, r.score) for r in templates.match(slips, t, 0.8).collect()}
    assert got == {1: ("k", 1.0), 2: ("n", 0.3333), 3: ("n", 0.5)}


def test_rows_of_issues(spark):
    df = spark.createDataFrame([(1, [("A", "ERROR", ["x", "y"], None, None)], ["isin"]), (2, [], [])], "slip_id int, issues array<struct<code:string,severity:string,fields:array<string>,expected:string,actual:string>>, missing array<string>")
    assert sorted(map(tuple, export.issue_rows(df).collect())) == [(1, "A", "ERROR", "x,y"), (1, "MISSING_REQUIRED", "ERROR", "isin")]


def test_patterns_see_unicode_words(spark):
    df = spark.createDataFrame([("ésale",), ("sale",), ("SALE",), ("pre sale",)], "t string")
    got = [r[0] for r in df.select(X.first_pattern(F.col("t"), [(r"\bsale\b", "S"), (r"pre\s", "P")])).collect()]
    assert got == [None, "S", "S", "S"]
