"""Spatial joins, line folding and the similarity join against plain loops."""

import difflib
import random

import pytest

from ticketloom.operators import extract, mapping, similar, tiles
from ticketloom.plans import queries

BOX = "struct<x0:double,top:double,x1:double,bottom:double>"
WORDS = f"slip_id string, page int, ord int, text string, bbox {BOX}"


def some_words(rng, n=400):
    out = []
    for i in range(n):
        x, y = rng.choice([rng.uniform(-20, 620), rng.uniform(0, 300), rng.uniform(-1e6, 1e6)]), rng.choice([rng.uniform(0, 800), rng.uniform(-1e5, 1e5), rng.randint(0, 40) * 12.0])
        out.append((rng.choice("ab"), rng.randint(1, 2), i, rng.choice(["|", "x", "Label:", "v12", "Total"]), (x, y, x + rng.uniform(0, 60), y + 8) if rng.random() < 0.97 else None))
    return out


def test_regions_and_tables(spark):
    rng = random.Random(3)
    words, boxes = some_words(rng), []
    for i in range(60):
        x, y = rng.uniform(-10, 500), rng.uniform(-10, 700)
        boxes.append((rng.choice("abc"), rng.randint(1, 3), i, (x, y, x + rng.choice([-5, 30, 90, 300, 1e4, 1e7]), y + rng.choice([10, 50, 500, 1e7]))))
    w, b = spark.createDataFrame(words, WORDS), spark.createDataFrame([*boxes, ("a", 1, 99, None)], f"slip_id string, page int, rule int, bbox {BOX}")
    holds = lambda o, i, m: o[0] >= i[0] - m and o[2] <= i[2] + m and o[1] >= i[1] - m and o[3] <= i[3] + m
    want = {r: " ".join(t for s2, p2, _, t, o in words if o and (s2, p2) == (s, p) and holds(o, i, 1.0)) for s, p, r, i in boxes} | {99: ""}
    assert {r.rule: r.value for r in tiles.region_texts(w, b).collect()} == want and sum(map(bool, want.values())) > 5
    centre = lambda o, i: i[0] <= (o[0] + o[2]) / 2 <= i[2] and i[1] <= (o[1] + o[3]) / 2 <= i[3]
    out = {n for s, p, n, _, o in words if not o or not any((s, p) == (s2, p2) and centre(o, i) for s2, p2, _, i in boxes)}
    few = b.where("rule % 7 = 0")
    got = {r.ord for r in tiles.outside(w, few).collect()}
    assert got == {n for s, p, n, _, o in words if not o or not any((s, p) == (s2, p2) and centre(o, i) for s2, p2, r, i in boxes if r % 7 == 0)} and out <= got
    # each word meets a box once, whatever the number of tiles
    assert tiles.inside(w, b).groupBy("ord", "box_rule").count().where("count > 1").count() == 0


def plain_segments(words):
    out = {}
    for page in {(w[0], w[1]) for w in words}:
        lines = []
        for w in sorted((w for w in words if (w[0], w[1]) == page and w[4]), key=lambda w: (round(w[4][1]), w[4][0])):
            if lines and abs(lines[-1][0][4][1] - w[4][1]) <= 3:
                lines[-1].append(w)
            else:
                lines.append([w])
        for k, line in enumerate(lines):
            segs = []
            for w in sorted(line, key=lambda w: w[4][0]):
                if w[3] == "|":
                    segs.append([])
                elif segs and segs[-1] and w[4][0] - segs[-1][-1][4][2] <= 10:
                    segs[-1].append(w)
                else:
                    segs.append([w])
            for i, seg in enumerate(s for s in segs if s):
                out[(*page, k, i)] = " ".join(w[3] for w in seg)
    return out


def test_lines_and_segments(spark):
    rng = random.Random(5)
    words = some_words(rng)
    for i in range(600):  # a page whose tops drift, so that a line ends by its first word and not by a gap
        x, y = rng.uniform(0, 500), rng.choice([i / 9, rng.uniform(0, 60), 7.5, 8.5])
        words.append(("hot", 1, i, rng.choice(["|", "Px:", "9.5", "Name"]), (x, y, x + 25, y + 8)))
    df = spark.createDataFrame(words, WORDS).repartition(4)
    assert {(r.slip_id, r.page, r.row_no, r.i): r.text for r in extract.segments(df).collect()} == plain_segments(words)
    assert extract.segments(df.limit(0)).count() == 0


def test_lines_over_batches(spark):
    """Lines and pages that end anywhere in an Arrow batch, a line of several batches, words without a text or a left side."""
    rng = random.Random(8)
    words = [(p, 1, i, rng.choice(["|", "a", "Px:", "9"]), (x := float(rng.randint(0, 400)), rng.choice([rng.uniform(0, 30), i / 7]), x + 9, 40.0)) for p in "abcd" for i in range(60)]
    words += [("one", 1, i, "|" if i % 9 == 4 else f"w{i}", (i * 12.0, 5.0, i * 12.0 + 11, 9.0)) for i in range(50)]
    df = spark.createDataFrame(words, WORDS).repartition(3)
    own = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("1", "7", "1000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert {(r.slip_id, r.page, r.row_no, r.i): r.text for r in extract.segments(df).collect()} == plain_segments(words)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", own)
    odd = [("s", 1, 0, None, (0.0, 1.0, 5.0, 9.0)), ("s", 1, 1, "a", (6.0, 1.0, 9.0, 9.0)), ("s", 1, 2, "b", (12.0, 1.0, 15.0, None)), ("s", 1, 3, "c", (None, 1.0, 2.0, 9.0))]
    got = {r.i: (r.text, tuple(r.bbox)) for r in extract.segments(spark.createDataFrame(odd, WORDS)).collect()}
    assert got == {0: ("c", (None, 1.0, 2.0, 9.0)), 1: ("a b", (6.0, 1.0, 15.0, 9.0))}


def test_words_of_lines_are_dealt_once(spark):
    """Line items are dealt out by order; their words, which are several times as many, are not dealt again and not gathered in lists."""
    plan = plan_of(queries.text_lines(spark, "/root/testdata/sf0.001"))
    assert plan.count("Exchange hashpartitioning") == 1 and "collect_list" not in plan


def test_pairs_of_lines(spark):
    rows = [("Deal", 10, 40), ("No:", 45, 60), ("77", 62, 70), ("|", 75, 76), ("Side:", 80, 100), ("Buy", 104, 130)]
    words = [("s", 1, i, t, (float(a), 10.0 + i / 3, float(b), 18.0)) for i, (t, a, b) in enumerate(rows)]
    words += [("s", 1, 20, "Price", (10.0, 30.0, 40.0, 38.0)), ("s", 1, 21, "99.5", (100.0, 30.0, 130.0, 38.0)), ("s", 1, 30, "Only", (10.0, 50.0, 40.0, 58.0)), ("s", 1, 40, "In:", (300.0, 70.0, 310.0, 78.0)), ("s", 1, 41, "table", (312.0, 70.0, 330.0, 78.0))]
    df = spark.createDataFrame(words, WORDS)
    boxes = spark.createDataFrame([("s", 1, (290.0, 60.0, 400.0, 90.0))], f"slip_id string, page int, bbox {BOX}")
    got = [(r.row_no, r.i, r.key, r.value) for r in extract.text_pairs(df, boxes).orderBy("row_no", "i").collect()]
    assert got == [(0, 0, "Deal No", "77"), (0, 1, "Side", "Buy"), (1, 0, "Price", "99.5")]
    assert extract.text_pairs(df).where("key = 'In'").count() == 1


@pytest.mark.parametrize("cutoff", [0.6, 0.85])
def test_best_matches(spark, cutoff):
    rng = random.Random(7)
    known = ["".join(rng.choices("abcde é", k=rng.randint(1, 14))) for _ in range(80)] + ["settlement date", "settlement amount", "aaaa", "aaab"]
    texts = ["".join(c for c in rng.choice(known) if rng.random() > 0.1) + rng.choice(["", "x"]) for _ in range(200)] + ["", None, "settlment date", "aaa"]
    others = spark.createDataFrame([(k,) for k in [*known, None, ""]], "text string")
    got = {r.text: (r.match, r.score, r.forward) for r in similar.best_matches(spark.createDataFrame([(t,) for t in texts], "text string"), others, cutoff).collect()}
    want = {}
    for t in texts:
        if t and (near := difflib.get_close_matches(t, known, 1, cutoff)):
            m = difflib.SequenceMatcher()
            m.set_seq2(t)
            m.set_seq1(near[0])
            want[t] = (near[0], m.ratio(), difflib.SequenceMatcher(None, t, near[0]).ratio())
    assert got == want and len(want) > 50
    pairs = similar.possible(others, others, cutoff)
    assert pairs.count() == pairs.distinct().count()


def test_similar_names(spark):
    rows = queries.label_similar(spark, "/root/testdata/sf0.001").collect()
    names = sorted({r.p_name for r in spark.read.parquet("/root/testdata/sf0.001/part.parquet").select("p_name").collect()})
    best = {}
    for r in rows:
        if r.label not in best:
            best[r.label] = (difflib.get_close_matches(r.label, names, 1, 0.85) or [None])[0]
        assert r.match == best[r.label]
    assert len(rows) == 200 and any(best.values())


def test_few_pairs_reach_python(spark):
    """Of all label keys against misspelt ones only a small part can reach the cutoff."""
    from ticketloom import rules

    keys = rules.label_keys()
    labels = spark.createDataFrame([(k[:3] + k[4:],) for k in keys if len(k) > 5], "text string")
    n = similar.possible(labels, spark.createDataFrame([(k,) for k in keys], "text string"), 0.85).count()
    assert n < 0.05 * len(keys) ** 2
    hit = mapping.label_hits(spark.createDataFrame([("Settlment Date",), ("Deal Refrence No",), ("zzz",)], "label string")).collect()
    assert {(r.label, r.path, r.method) for r in hit} == {("Settlment Date", "settlement_date", "fuzzy"), ("Deal Refrence No", "deal_id", "fuzzy")}


@pytest.mark.parametrize("few", [0, 4])
def test_pages_with_many_boxes(spark, monkeypatch, few):
    """Pages that have more boxes than are compared one by one give the same."""
    monkeypatch.setattr(tiles, "FEW", few)
    test_regions_and_tables(spark)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_boxes_are_broadcast(spark):
    """The tiles or boxes of all slips never go through the driver, however small Spark takes them to be."""
    assert "Broadcast" not in plan_of(queries.region_words(spark, "/root/testdata/sf0.001"))
