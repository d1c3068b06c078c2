"""Labels are looked up once for each, and checkpoints run as code that the JVM can compile."""

from ticketloom import session
from ticketloom.operators import mapping


def test_labels_are_read_once_for_each(spark):
    """Keys take Python, so a pair must get them by a join; a template's hits stand in for the dictionary's."""
    pairs = spark.createDataFrame([(s, i, k, "v", src) for s in ("a", "b") for i, (k, src) in enumerate([("Price", "table"), ("Zoll (x)", "table"), ("Void", "table"), ("Buyer/Seller", "prose"), (None, "table")])], "slip_id string, pair_idx int, key string, value string, source string")
    labels = mapping.known_labels(pairs)
    on = spark.createDataFrame([("a", "t")], "slip_id string, template_id string")
    own = spark.createDataFrame([("t", "zoll", "yield"), ("t", "zoll x", "isin"), ("t", "void", "_ignore"), ("u", "price", "isin")], "template_id string, key string, path string")
    known = mapping.mapped(pairs, labels, on, own)
    assert "ArrowEvalPython" not in known._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.slip_id, r.pair_idx, r.path or "", r.method) for r in known.collect()) == [
        ("a", 0, "price", "synonym"), ("a", 1, "isin", "template"), ("a", 2, "", "template"), ("a", 3, "counterparty", "text"), ("b", 0, "price", "synonym"), ("b", 3, "counterparty", "text"),
    ]


def test_checkpoints_are_compiled_in_small_methods(spark, monkeypatch):
    seen, df = [], spark.range(3)
    own, kept = spark.conf.get(session.HUGE_METHOD), type(df).checkpoint
    monkeypatch.setattr(type(df), "checkpoint", lambda self, eager=True: (seen.append(spark.conf.get(session.HUGE_METHOD)), kept(self, eager))[1])
    assert session.cut(df).count() == 3 and seen == ["8000"] and spark.conf.get(session.HUGE_METHOD) == own
