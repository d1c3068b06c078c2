"""Queries over the driver's star schema that exercise the operators, each with its DuckDB equivalent.

Slip inputs are made from orders, customers and line items: values are printed the way slips print them, and the engine reads them
back, so the SQL beside a query never sees the printed strings.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import model, rules
from ..functions import canonical
from ..functions import text as X
from ..functions import values as V
from ..operators import append, audit, drafts, export, extract, mapping, market, metrics, similar, store, templates, tiles, validate
from ..session import dealt, shared_dir
from ..streaming import metrics as stream
from ..streaming.limiter import limit
from .parse import parse, parse_mapped

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grouped(n: Column, indian: bool) -> Column:
    """An integer with thousands separators."""
    s = n.cast("string")
    if not indian:
        return F.format_number(n, 0)
    head = F.reverse(F.regexp_replace(F.reverse(F.substring(s, F.lit(1), F.length(s) - 3)), r"(\d{2})(?=\d)", "$1,"))
    return F.when(F.length(s) > 3, F.concat(head, F.lit(","), F.substring(s, -3, 3))).otherwise(s)


def cents(c: Column) -> Column:
    return F.round(c.cast("decimal(20,4)"), 2).cast("decimal(18,2)")


def amount_text(c: Column, indian: bool) -> Column:
    x = cents(c)
    return F.concat(grouped(F.floor(x).cast("bigint"), indian), F.lit("."), F.substring(x.cast("string"), -2, 2))


def order_slips(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(texts, pairs) of a slip for each order."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").cast("string").alias("slip_id"), "o_orderdate", "o_totalprice", "c_name", "o_orderkey")
    line = lambda i, k, v: F.struct(F.lit(i).alias("pair_idx"), F.lit(k).alias("key"), v.alias("value"))
    rows = [
        line(0, "Deal Reference No.", F.concat(F.lit("D/"), F.col("o_orderkey"))), line(1, "Deal Type", F.when(F.col("o_orderkey") % 2 == 0, "OUTRIGHT PURCHASE").otherwise("Outright Sale")),
        line(2, "Deal Date", F.date_format("o_orderdate", "dd-MMM-yyyy")), line(3, "Value Date", F.date_format(F.date_add(F.to_date("o_orderdate"), 1), "dd/MM/yyyy")),
        line(4, "Total Consideration (INR)", amount_text(F.col("o_totalprice"), True)), line(5, "Cpty", F.col("c_name")), line(6, "Trade Time", F.lit("11:42:17")),
    ]
    box = "struct<x0:double,top:double,x1:double,bottom:double>"
    pairs = j.select("slip_id", F.inline(F.array(*rows))).withColumns({"source": F.lit("table"), "page": F.lit(1), "key_bbox": F.lit(None).cast(box), "value_bbox": F.lit(None).cast(box)})
    return j.select("slip_id", F.concat(F.lit("Deal slip in INR, settled by CCIL, order "), F.col("slip_id")).alias("text")), pairs


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS slip_id, 'D/' || o_orderkey AS deal_id, 'OUTRIGHT' AS deal_type, CASE WHEN o_orderkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS buy_sell,
  CAST(o_orderdate AS DATE) AS trade_date, CAST(o_orderdate AS DATE) + 1 AS settlement_date, CAST(CAST(round(CAST(o_totalprice AS DECIMAL(20,4)), 2) AS DECIMAL(18,2)) AS DOUBLE) AS consideration,
  c_name AS counterparty, 'INR' AS currency, 'IN' AS market, 'NEW_TEMPLATE' AS status, 4 AS n_missing
FROM orders JOIN customer ON o_custkey = c_custkey
""")
def parse_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, pairs = order_slips(spark, sf_dir)
    return parse(texts, pairs).select(
        "slip_id", "deal_id", "deal_type", "buy_sell", "trade_date", "settlement_date", F.col("consideration").cast("double").alias("consideration"),
        "counterparty", "currency", "market", "status", F.size("missing").alias("n_missing"),
    )


def layout_slips(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, pairs, words) of a slip for each order, laid out by its priority: two labels that only a template knows, one to be ignored,
    one that nobody knows, the price in the text, the face value as a word on the page."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    line = lambda i, label, v: F.struct(F.lit(i).alias("pair_idx"), (label if isinstance(label, Column) else F.lit(label)).alias("key"), v.alias("value"))
    by_layout = lambda name: F.concat(F.lit(name + " "), F.col("o_orderpriority"))
    rows = [
        line(0, "Deal Type", F.lit("OUTRIGHT PURCHASE")), line(1, "Trade Date", F.date_format("o_orderdate", "dd-MMM-yyyy")), line(2, "Value Date", F.date_format(F.date_add(F.to_date("o_orderdate"), 1), "dd/MM/yyyy")),
        line(3, by_layout("Kennung"), F.lit("IN0020240A75")), line(4, by_layout("Gesamt"), amount_text(F.col("o_totalprice"), True)), line(5, by_layout("Vermerk"), F.lit("void")), line(6, "Zzz", F.col("o_orderstatus")),
    ]
    box = "struct<x0:double,top:double,x1:double,bottom:double>"
    slip = k.cast("string").alias("slip_id")
    pairs = o.select(slip, F.inline(F.array(*rows))).withColumns({"source": F.lit("table"), "page": F.lit(1), "key_bbox": F.lit(None).cast(box), "value_bbox": F.lit(None).cast(box)})
    texts = o.select(slip, F.concat(F.lit("Deal slip in INR, settled by CCIL, clean px "), 95 + k % 10, F.lit(".2500 per 100, order "), k).alias("text"))
    at = lambda x0, top: F.struct(F.lit(float(x0)).alias("x0"), F.lit(float(top)).alias("top"), F.lit(x0 + 50.0).alias("x1"), F.lit(top + 8.0).alias("bottom")).alias("bbox")
    shown = F.array(F.struct(F.lit(0).alias("ord"), F.lit("Nominal").alias("text"), at(20, 200)), F.struct(F.lit(1).alias("ord"), grouped((k + 1) * 1000, True).alias("text"), at(100, 200)))
    return texts, pairs, o.select(slip, F.lit(1).alias("page"), F.inline(shown))


def approved_layouts(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    """A reviewer's mapping for the first order of each priority, sent for approval; one lacks the rule for the price."""
    texts, pairs, words = layout_slips(spark, sf_dir)
    first = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("request_id")).agg(F.min("o_orderkey").cast("string").alias("slip_id"))
    null = lambda t: F.lit(None).cast(t)
    edit = lambda name, target: F.struct(F.concat(F.lit(name + " "), F.col("request_id")).alias("label"), F.lit(target).alias("target"))
    region = F.array(F.struct(F.lit("face_value").alias("field"), F.lit(1).alias("page"), F.array(*map(F.lit, (95.0, 195.0, 200.0, 212.0))).alias("bbox")))
    regex = F.array(F.struct(F.lit("price").alias("field"), F.lit(r"px ([\d.]+) per 100").alias("pattern"), F.lit(1).alias("group")))
    requests = first.select(
        "request_id", "slip_id", null("string").alias("template_id"), F.col("request_id").alias("name"), F.array(edit("Kennung", "isin"), edit("Gesamt", "consideration"), edit("Vermerk", "_ignore")).alias("label_map"),
        F.array().cast("array<string>").alias("keywords"), region.alias("region_rules"), F.when(F.col("request_id") != "5-LOW", regex).alias("regex_rules"), F.create_map(F.lit("security_name"), F.lit("7.10% GS 2034")).alias("constants"),
        null("string").alias("date_order"), F.lit(True).alias("accept_issues"), F.lit("reviewer").alias("created_by"),
    )
    return drafts.approve(requests, texts, pairs, words, path)


@query("""
SELECT DISTINCT o_orderpriority AS request_id, regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '_', 'g') AS template_id, CASE WHEN o_orderpriority <> '5-LOW' THEN 1 END AS version,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'missing:price' ELSE '' END AS blocked FROM orders
""")
def template_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = approved_layouts(spark, sf_dir, f"{shared_dir(spark)}/templates-{uuid.uuid4().hex}")
    return out.withColumn("blocked", F.array_join("blocked", ","))


@query("""
WITH o AS (SELECT *, o_orderpriority = '5-LOW' AS new, CAST(o_orderdate AS DATE) + 1 AS settle FROM orders)
SELECT CAST(o_orderkey AS VARCHAR) AS slip_id, CASE WHEN NOT new THEN regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '_', 'g') END AS template_id,
  CASE WHEN new THEN 'NEW_TEMPLATE' WHEN isodow(settle) > 5 THEN 'NEEDS_REVIEW' ELSE 'PARSED' END AS status, CASE WHEN NOT new THEN 'IN0020240A75' END AS isin, CASE WHEN NOT new THEN 95.25 + o_orderkey % 10 END::DOUBLE AS price,
  CASE WHEN NOT new THEN (o_orderkey + 1) * 1000 END::DOUBLE AS face_value, CASE WHEN NOT new THEN CAST(CAST(round(CAST(o_totalprice AS DECIMAL(20,4)), 2) AS DECIMAL(18,2)) AS DOUBLE) END AS consideration, settle AS settlement_date,
  CASE WHEN new THEN 4 ELSE 1 END AS n_unmapped, CASE WHEN NOT new THEN 95.0 END::DOUBLE AS face_value_x FROM o
""")
def template_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders' slips through the templates that were approved for four of five layouts, as whole results: label maps, region, regex and
    constant rules, provenance and unmapped pairs."""
    path = f"{shared_dir(spark)}/templates-{uuid.uuid4().hex}"
    approved_layouts(spark, sf_dir, path)
    texts, pairs, words = layout_slips(spark, sf_dir)
    parsed, mapped = parse_mapped(texts, pairs, store.current(spark, path, is_active=True), words)
    r = F.col("result")
    amount = lambda c: r["deal"][c].cast("double").alias(c)
    return export.envelope(parsed, pairs, mapped).select(
        "slip_id", r["template"]["template_id"].alias("template_id"), r["status"].alias("status"), r["deal"]["isin"].alias("isin"), amount("price"), amount("face_value"), amount("consideration"),
        r["deal"]["settlement_date"].cast("date").alias("settlement_date"), F.size(r["unmapped"]).alias("n_unmapped"), F.try_element_at(r["fields"], F.lit("face_value"))["bbox"]["x0"].alias("face_value_x"),
    )


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders")
def parse_date_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 6
    f = lambda p: F.date_format("o_orderdate", p)
    shown = F.when(k == 0, f("dd-MMM-yyyy")).when(k == 1, f("yyyy-MM-dd")).when(k == 2, f("dd/MM/yyyy")).when(k == 3, f("EEEE, MMMM d, yyyy")).when(k == 4, f("ddMMyyyy")).otherwise(f("d MMMM yy (HH:mm)"))
    return o.select("o_orderkey", V.parse_date(shown, "DMY")["value"].alias("d"))


@query("""
SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 5 = 4 THEN -v WHEN o_orderkey % 5 IN (2, 3) THEN CAST(round(v, 0) AS DECIMAL(18,2)) ELSE v END AS DOUBLE) AS amount
FROM (SELECT o_orderkey, CAST(round(CAST(o_totalprice AS DECIMAL(20,4)), 2) AS DECIMAL(18,2)) AS v FROM orders)
""")
def parse_amount_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k, x = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 5, F.col("o_totalprice")
    whole = F.round(cents(x), 0).cast("bigint")
    lakh = F.concat((whole.cast("decimal(18,5)") / F.lit(100000).cast("decimal(6,0)")).cast("decimal(18,5)").cast("string"), F.lit(" Lakh"))
    crore = F.concat(F.lit("INR "), (whole.cast("decimal(18,7)") / F.lit(10000000).cast("decimal(8,0)")).cast("decimal(18,7)").cast("string"), F.lit(" Cr"))
    shown = F.when(k == 0, amount_text(x, True)).when(k == 1, amount_text(x, False)).when(k == 2, lakh).when(k == 3, crore).otherwise(F.concat(F.lit("("), amount_text(x, False), F.lit(")")))
    return o.select("o_orderkey", V.parse_amount(shown, None, V.map_of(rules.PROFILES["IN"]["units"]))["value"].cast("double").alias("amount"))


@query("SELECT l_orderkey, l_linenumber, CAST(round(l_discount * 100) AS BIGINT) AS pct, CAST(l_quantity AS BIGINT) AS days FROM lineitem")
def parse_rates_and_ints(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.concat(F.round(F.col("l_discount") * 100).cast("bigint"), F.lit(".00% p.a. (Semi-Annual)"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", V.parse_rate(shown)["value"].cast("bigint").alias("pct"), V.parse_int(F.concat(F.col("l_quantity").cast("bigint"), F.lit(" (30/360)")))["value"].alias("days")
    )


@query("""
SELECT p_partkey, CAST(p_size AS VARCHAR) AS nominal, p_size || '.50' AS cash, p_size || '.5000' AS price, p_size || '.12345' AS yield_text, p_size || '.5' AS fx FROM part
""")
def scale_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size").cast(model.MONEY)
    of = lambda x, places, kind: V.scaled(n + F.lit(x).cast("decimal(10,5)"), F.lit(places), kind)[1]
    return table(spark, sf_dir, "part").select("p_partkey", of("0", 2, "nominal").alias("nominal"), of("0.5", 1, "cash").alias("cash"), of("0.5", 2, "price").alias("price"), of("0.12345", 5, "yield").alias("yield_text"), of("0.5", 1, "fx").alias("fx"))


LABEL_CASES = [
    ("Deal Date / Time", "trade_date", "synonym"), ("Total Consideration (INR)", "consideration", "synonym"), ("Stl Dt", "settlement_date", "abbreviation"), ("First Leg Settlement Amount", "repo.leg1_amount", "synonym"),
    ("SECURITY NAME/ISIN NUMBER", "security_name", "synonym"), ("SECURITY NAME/ISIN NUMBER", "isin", "synonym"), ("Rate (per 100)", "price", "synonym"), ("No. of Bonds", "quantity", "synonym"),
]


LABEL_CASES.append(("Settlment Date", "settlement_date", "fuzzy"))
LABELS_SHOWN = [*dict.fromkeys(a for a, *_ in LABEL_CASES), "GST No"]


def part_label(i: int) -> str:
    """SQL of the i-th label as a part shows it, with a note in parentheses; one label has its own parentheses."""
    return f"'{LABELS_SHOWN[i]}'" if LABELS_SHOWN[i].startswith("Rate") else f"'{LABELS_SHOWN[i]} (' || p_partkey || ')'"


@query("SELECT DISTINCT label, path, method FROM (" + " UNION ALL ".join(
    f"SELECT {part_label(LABELS_SHOWN.index(a))} AS label, '{b}' AS path, '{c}' AS method FROM part WHERE p_partkey % {len(LABELS_SHOWN)} = {LABELS_SHOWN.index(a)}" for a, b, c in LABEL_CASES
) + ")")
def label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label for each part, most of them with a note that no other part has."""
    shown = F.coalesce(*(F.when(F.col("p_partkey") % len(LABELS_SHOWN) == i, F.expr(part_label(i))) for i in range(len(LABELS_SHOWN))))
    return mapping.label_hits(table(spark, sf_dir, "part").select(shown.alias("label"))).select("label", "path", "method")


@query()
def label_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's name with a letter left out, and the name that is most like it; SQL has no such ratio, so it is tested against difflib."""
    p = table(spark, sf_dir, "part")
    at = (F.col("p_partkey") % F.length("p_name") + 1).cast("int")
    labels = p.select("p_partkey", F.concat(F.substring(F.col("p_name"), F.lit(1), at - 1), F.substring(F.col("p_name"), at + 1, F.length("p_name"))).alias("label"))
    best = similar.best_matches(labels.select(F.col("label").alias("text")), p.select(F.col("p_name").alias("text")), 0.85)
    return labels.join(best, F.col("label") == F.col("text"), "left").select("p_partkey", "label", "match", "score")


NUMBERED_LINES = "SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) AS rn FROM lineitem"


def line_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a page for each order, a text line for each line item; a line's words stand up to a point apart in height."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate")
    li = table(spark, sf_dir, "lineitem").withColumn("rn", F.row_number().over(order))

    def word(i, text, x0, x1, jitter=0.0):
        top = F.col("rn") * 12.0 + jitter
        return F.struct((F.col("rn") * 10 + i).alias("ord"), text.alias("text"), F.struct(F.lit(float(x0)).alias("x0"), top.alias("top"), F.lit(float(x1)).alias("x1"), (top + 8).alias("bottom")).alias("bbox"))

    whole = lambda c: F.round(c).cast("bigint").cast("string")
    shown = F.array(
        word(0, F.lit("Qty:"), 10, 40), word(1, whole(F.col("l_quantity")), 45, 60, 0.9), word(2, F.lit("|"), 65, 68), word(3, F.lit("Ship"), 80, 100, -0.8), word(4, F.lit("Date:"), 104, 130),
        word(5, F.date_format("l_shipdate", "yyyy-MM-dd"), 136, 190, 0.4),
    )
    gap = F.array(word(0, F.lit("Discount"), 10, 60), word(1, whole(F.col("l_discount") * 100), 120, 150, -0.6))
    return li.select(F.col("l_orderkey").alias("slip_id"), F.lit(1).alias("page"), F.inline(F.when(F.col("l_partkey") % 4 == 3, gap).otherwise(shown)))


@query(f"""
WITH l AS ({NUMBERED_LINES})
SELECT l_orderkey AS slip_id, rn - 1 AS row_no, 0 AS i, CASE WHEN l_partkey % 4 = 3 THEN 'Discount' ELSE 'Qty' END AS key, CAST(CAST(round(CASE WHEN l_partkey % 4 = 3 THEN l_discount * 100 ELSE l_quantity END) AS BIGINT) AS VARCHAR) AS value FROM l
UNION ALL SELECT l_orderkey, rn - 1, 1, 'Ship Date', strftime(l_shipdate, '%Y-%m-%d') FROM l WHERE l_partkey % 4 <> 3
""")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words to lines, segments and pairs."""
    return extract.text_pairs(line_words(spark, sf_dir)).select("slip_id", "row_no", "i", "key", "value")


@query(f"""
WITH l AS ({NUMBERED_LINES}),
q AS (SELECT l_orderkey, string_agg(CAST(CAST(round(l_quantity) AS BIGINT) AS VARCHAR), ' ' ORDER BY rn) AS v FROM l WHERE rn <= 2 AND l_partkey % 4 <> 3 GROUP BY 1),
w AS (SELECT l_orderkey, sum(CASE WHEN l_partkey % 4 = 3 THEN 1 ELSE 3 END)::BIGINT AS n FROM l GROUP BY 1)
SELECT o_orderkey AS slip_id, r AS rule, CASE r WHEN 0 THEN coalesce(v, '') ELSE '' END AS value, coalesce(n, 0) AS n_outside
FROM orders CROSS JOIN (VALUES (0), (1)) x(r) LEFT JOIN q ON q.l_orderkey = o_orderkey LEFT JOIN w ON w.l_orderkey = o_orderkey
""")
def region_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words in two regions of each order's page, one of which is empty, and how many words lie outside a table's box."""
    words = line_words(spark, sf_dir)
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("slip_id"), F.lit(1).alias("page"))
    box = lambda *c: F.struct(*(F.lit(float(v)).alias(n) for n, v in zip(("x0", "top", "x1", "bottom"), c, strict=True)))
    regions = o.select("*", F.inline(F.array(F.struct(F.lit(0).alias("rule"), box(44.5, 0, 59.5, 34).alias("bbox")), F.struct(F.lit(1).alias("rule"), box(500, 0, 9000, 9000).alias("bbox")))))
    rest = tiles.outside(words, o.select("*", box(0, 0, 70, 1e6).alias("bbox"))).groupBy("slip_id").agg(F.count("*").alias("n"))
    return tiles.region_texts(words, regions).join(dealt(rest), "slip_id", "left").select("slip_id", "rule", "value", F.coalesce("n", F.lit(0)).alias("n_outside"))


def line_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    methods = F.array(*map(F.lit, ["synonym", "template", "text", "synonym"]))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"), F.min("l_suppkey").alias("s")).select(
        F.col("l_orderkey").alias("slip_id"), F.lit("quantity").alias("path"), F.col("l_linenumber").alias("cand_idx"), F.element_at(methods, (F.col("s") % 4 + 1).cast("int")).alias("method"),
        F.lit(0.95).alias("confidence"), F.lit("table").alias("source"), F.lit(1).alias("page"), F.lit(0.0).alias("y"), F.lit(0.0).alias("x"),
        F.when(F.col("q") % 7 != 0, F.col("q").cast("bigint").cast("string")).alias("v"), F.when(F.col("q") % 7 == 0, "VALUE_UNPARSEABLE").alias("error"),
    )


@query("""
WITH c AS (SELECT l_orderkey AS slip_id, l_linenumber AS i, CASE min(l_suppkey) % 4 WHEN 1 THEN 3 WHEN 2 THEN 8 ELSE 5 END AS r,
       CASE WHEN min(l_quantity) % 7 <> 0 THEN CAST(CAST(min(l_quantity) AS BIGINT) AS VARCHAR) END AS v FROM lineitem GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY slip_id ORDER BY v IS NULL, r, i) AS p FROM c),
w AS (SELECT slip_id, r AS wr, v AS wv, i AS wi FROM k WHERE p = 1)
SELECT w.slip_id, wi AS cand_idx, wv AS v, bool_or(coalesce(p > 1 AND r = wr AND v <> wv, false)) AS conflict,
  CASE WHEN bool_or(coalesce(p > 1 AND r = wr AND v <> wv, false)) THEN 0.85 ELSE 0.95 END::DOUBLE AS confidence, CASE WHEN wv IS NULL THEN 'VALUE_UNPARSEABLE' END AS first_error
FROM w JOIN k USING (slip_id) GROUP BY w.slip_id, wi, wv
""")
def resolve_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.resolve(line_candidates(spark, sf_dir)).select("slip_id", "cand_idx", "v", "conflict", "confidence", "first_error")


@query("""
WITH s AS (SELECT o_orderkey AS slip_id, unnest(CASE o_orderkey % 4 WHEN 0 THEN [{'m': 'IN', 'w': 2}, {'m': 'IN', 'w': 2}] WHEN 1 THEN [{'m': 'US', 'w': 2}, {'m': 'US', 'w': 2}, {'m': 'GB', 'w': 2}]
  WHEN 2 THEN [{'m': 'IN', 'w': 2}, {'m': 'GB', 'w': 1}] ELSE [] END) AS x FROM orders),
t AS (SELECT slip_id, x.m AS m, sum(x.w) AS w FROM s GROUP BY ALL)
SELECT o_orderkey AS slip_id, coalesce(CASE WHEN round(max(w) / sum(w), 2) >= 0.7 THEN arg_max(m, w) ELSE 'UNKNOWN' END, 'UNKNOWN') AS market, coalesce(round(max(w) / sum(w), 2), 0)::DOUBLE AS market_confidence
FROM orders LEFT JOIN t ON t.slip_id = o_orderkey GROUP BY o_orderkey
""")
def market_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, "Paid in INR through CCIL").when(k == 1, "USD via DTC, CREST").when(k == 2, "Rs. 500 for one Gilt").otherwise("nothing to see")
    return market.detect(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("slip_id"), text.alias("text"))).select("slip_id", "market", "market_confidence")


@query("SELECT p_partkey, p_partkey % 3 <> 0 AS ok, CASE WHEN p_partkey % 3 = 1 THEN 'US0378331005' WHEN p_partkey % 3 = 2 THEN 'IN0020240A75' ELSE 'US0378331006' END AS isin FROM part")
def isin_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    raw = F.when(k == 1, "Apple us0378331005 x").when(k == 2, "IN00 2024 0A75").otherwise("US0378331006")
    found = V.normalize_isin(raw)["value"]
    return table(spark, sf_dir, "part").select("p_partkey", V.isin_ok(found).alias("ok"), found.alias("isin"))


TEMPLATE_ROWS = [(f"t{i}", [f"l{j}" for j in range(i, i + 6)], []) for i in range(8)]


@query("""
WITH s AS (SELECT l_orderkey AS slip_id, list(DISTINCT 'l' || (l_suppkey % 14)) AS labels FROM lineitem GROUP BY l_orderkey),
t AS (SELECT 't' || i AS template_id, list_transform(range(i, i + 6), lambda j: 'l' || j) AS tl FROM range(8) r(i)),
c AS (SELECT slip_id, template_id, round(len(list_intersect(labels, tl)) / (len(labels) + len(tl) - len(list_intersect(labels, tl))), 4) AS score FROM s, t),
k AS (SELECT *, row_number() OVER (PARTITION BY slip_id ORDER BY score >= 0.5 DESC, score DESC, template_id) AS r FROM c)
SELECT slip_id, CASE WHEN score >= 0.5 THEN template_id END AS template_id, score::DOUBLE AS score FROM k WHERE r = 1
""")
def template_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    slips = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("slip_id")).agg(F.collect_set(F.concat(F.lit("l"), F.col("l_suppkey") % 14)).alias("labels")).withColumn("text", F.lit(""))
    t = spark.createDataFrame(TEMPLATE_ROWS, "template_id string, fingerprint_labels array<string>, keywords array<string>").withColumn("match_threshold", F.lit(0.0))
    return templates.match(slips, t, 0.5).select("slip_id", "template_id", "score")


def line_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deals made of line items, one in seven with a wrong principal, one in five settled before the trade."""
    li = table(spark, sf_dir, "lineitem")
    fv, price = (F.col("l_quantity").cast("bigint") * 1000).cast(model.MONEY), (F.col("l_tax") * 100 + 95).cast("decimal(10,4)")
    principal = F.round(fv.cast("decimal(20,2)") * price / 100, 2)
    wrong = F.when(F.col("l_partkey") % 7 == 0, 5).otherwise(0)
    d = F.to_date("l_shipdate")
    return validate.wide(li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.lit("OUTRIGHT").alias("deal_type"), F.lit("SELL").alias("buy_sell"), fv.alias("face_value"), price.cast(model.MONEY).alias("price"),
        (principal + wrong).cast(model.MONEY).alias("principal_amount"), (principal + wrong).cast(model.MONEY).alias("consideration"), d.alias("trade_date"),
        F.when(F.col("l_partkey") % 5 == 0, F.date_sub(d, 1)).otherwise(F.date_add(d, 1)).alias("settlement_date"), F.lit("IN0020240A75").alias("isin"), F.lit(4).alias("price_places"),
    ))


@query("""
WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS t, CASE WHEN l_partkey % 5 = 0 THEN CAST(l_shipdate AS DATE) - 1 ELSE CAST(l_shipdate AS DATE) + 1 END AS s FROM lineitem)
SELECT code, count(*) AS n FROM (
  SELECT 'PRINCIPAL_MISMATCH' AS code FROM d WHERE l_partkey % 7 = 0 UNION ALL SELECT 'SETTLEMENT_BEFORE_TRADE' FROM d WHERE s < t UNION ALL SELECT 'WEEKEND_SETTLEMENT' FROM d WHERE isodow(s) > 5) GROUP BY code
""")
def validate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    # an inner explode would have the checks run again, in a filter on the array's size
    return validate.validate(line_deals(spark, sf_dir)).select(F.explode_outer("issues").alias("i")).where("i is not null").groupBy(F.col("i.code").alias("code")).agg(F.count("*").alias("n"))


@query("""
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + (o_orderkey % 400)::INT AS b,
  (year(b) - year(a)) * 360 + (month(b) - month(a)) * 30 + (CASE WHEN least(day(a), 30) = 30 AND day(b) = 31 THEN 30 ELSE day(b) END) - least(day(a), 30) AS d30, b - a AS actual, isodow(b) > 5 AS weekend FROM orders
""")
def day_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.to_date("o_orderdate")
    b = F.date_add(a, (F.col("o_orderkey") % 400).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", a.alias("a"), b.alias("b"), V.days_30_360(a, b).cast("bigint").alias("d30"), F.date_diff(b, a).cast("bigint").alias("actual"), V.is_weekend(b).alias("weekend"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'UNREADABLE' WHEN o_orderkey % 7 = 0 THEN 'NEW_TEMPLATE' WHEN o_orderkey % 5 = 0 OR o_orderkey % 3 = 0 THEN 'NEEDS_REVIEW' ELSE 'PARSED' END AS status FROM orders
""")
def status_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    flag = lambda n: F.when(k % n == 0, 1).otherwise(0)
    return table(spark, sf_dir, "orders").select("o_orderkey", validate.status(k % 11 != 0, k % 7 != 0, flag(5), F.lit(0), F.lit(False), F.when(k % 3 == 0, "UNKNOWN").otherwise("IN")).alias("status"))


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'REVERSE_REPO' WHEN 1 THEN 'OUTRIGHT' WHEN 2 THEN 'PRIMARY_AUCTION' END AS deal_type, CASE WHEN p_partkey % 2 = 0 THEN 'ACT/365' ELSE '30/360' END AS day_count,
  CASE WHEN p_partkey % 3 = 0 THEN 'TBILL' ELSE 'GSEC' END AS instrument, CASE WHEN p_partkey % 2 = 0 THEN 'OTC / NSE RFQ' ELSE 'NDS-OM' END AS platform, CASE WHEN p_partkey % 2 = 0 THEN 'DVP-III' ELSE 'DVP-I' END AS mode FROM part
""")
def enum_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, m = F.col("p_partkey"), F.lit("IN")
    deal = F.when(k % 4 == 0, "Reverse  Repo").when(k % 4 == 1, "our purchase").when(k % 4 == 2, "Auction of bonds").otherwise("other")
    return table(spark, sf_dir, "part").select(
        "p_partkey", V.enum_value("deal_type", deal, m).alias("deal_type"), V.enum_value("day_count", F.when(k % 2 == 0, "Actual/365").otherwise("30 / 360"), m).alias("day_count"),
        V.instrument_type(F.when(k % 3 == 0, "182 DTB 15012027").otherwise("7.10% GS 2034"), m).alias("instrument"), V.platform(F.when(k % 2 == 0, "OTC - nse rfq").otherwise("NDS-OM (anonymous)"), m).alias("platform"),
        V.settlement_mode(F.when(k % 2 == 0, "dvp 3").otherwise("DVP-I via CCIL")).alias("mode"),
    )


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("occurred_at"), F.col("user_id").cast("string").alias("actor_id"), F.col("event_type").alias("action"))


@query("""
WITH l AS (SELECT event_id AS seq, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS occurred_at, CAST(user_id AS VARCHAR) AS actor_id, event_type AS action FROM events)
SELECT * FROM l WHERE action = 'click' AND substr(occurred_at, 1, 10) >= (SELECT substr(min(occurred_at), 1, 10) FROM l) ORDER BY seq DESC LIMIT 100 OFFSET 20
""")
def audit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = log_events(spark, sf_dir)
    first = log.agg(F.min("occurred_at")).first()[0]
    return audit.page(audit.search(log, after=first[:10], action="click"), 100, 20)


@query("""
SELECT CAST(user_id AS VARCHAR) AS actor_id, CASE WHEN user_id % 10 = 0 THEN 1 ELSE count(*) END AS checked, CASE WHEN user_id % 10 = 0 THEN min(event_id) END AS first_bad_seq,
  CASE WHEN user_id % 10 = 0 THEN 'row_hash_mismatch' END AS reason FROM events GROUP BY user_id
""")
def audit_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["seq", "occurred_at", "actor_id", "action"]
    chained = audit.link(log_events(spark, sf_dir), "actor_id", columns)
    tampered = chained.withColumn("action", F.when((F.col("actor_id").cast("bigint") % 10 == 0) & (F.col("prev_hash") == audit.GENESIS), "forged").otherwise(F.col("action")))
    return audit.verify(tampered, "actor_id", columns).select("actor_id", "checked", "first_bad_seq", "reason")


@query("""
SELECT row_number() OVER (ORDER BY ts, event_id) AS seq, event_id, CAST(user_id AS VARCHAR) AS actor_id, true AS chained FROM events
""")
def audit_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events in three appends by time, the second sent twice."""
    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    log = log_events(spark, sf_dir).withColumnRenamed("seq", "event_id").join(table(spark, sf_dir, "events").select("event_id", "ts"), "event_id")
    low, high = log.agg(F.min(F.unix_seconds(F.col("ts").cast("timestamp"))), F.max(F.unix_seconds(F.col("ts").cast("timestamp")))).first()
    third = F.floor(F.lit(3) * (F.unix_seconds(F.col("ts").cast("timestamp")) - low) / (high - low + 1))
    columns = ["event_id", "occurred_at", "actor_id", "action"]
    for batch in (0, 1, 1, 2):
        append.append(log.where(third == batch), path, batch, [F.col("ts"), F.col("event_id")], "actor_id", columns)
    kept = append.read(spark, path)
    bad = audit.verify(kept, "actor_id", [*columns, "seq"]).where("reason is not null").select("actor_id", "first_bad_seq")
    return kept.join(bad, "actor_id", "left").select("seq", "event_id", "actor_id", F.col("first_bad_seq").isNull().alias("chained"))


@query("""
SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS actor_id, (SELECT count(*) FROM events WHERE event_type = 'click') AS total FROM events WHERE event_type = 'click' ORDER BY seq DESC LIMIT 100 OFFSET 20
""")
def audit_page_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the log and the count of all that match, from one scan."""
    rows, total = audit.page_with_total(audit.search(log_events(spark, sf_dir), action="click").select("seq", "actor_id"), 100, 20)
    return spark.createDataFrame(rows, "seq long, actor_id string").withColumn("total", F.lit(total).cast("long"))


@query("""
SELECT o_orderkey, '{"customer":{"balance":' || c_acctbal || ',"name":"' || c_name || '"},"date":"' || CAST(o_orderdate AS DATE) || '","tags":{"clerk":null,"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"},"total":[' || o_totalprice || ',null]}' AS details
FROM orders JOIN customer ON o_custkey = c_custkey
""")
def canonical_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested details with maps as canonical JSON."""
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    tags = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"), F.lit("clerk"), F.lit(None).cast("string"))
    shaped = j.select("o_orderkey", F.struct(
        tags.alias("tags"), F.array("o_totalprice", F.lit(None).cast("double")).alias("total"), F.to_date("o_orderdate").alias("date"), F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")).alias("customer"),
    ).alias("details"))
    return shaped.select("o_orderkey", canonical.json_text(F.col("details"), shaped.schema["details"].dataType).alias("details"))


@query("SELECT c_custkey, 'pan ABCPD****E of ' || c_name AS details, '''=' || c_name AS cell, 'AB_' || c_custkey AS file FROM customer")
def audit_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("details", F.concat(F.lit("pan ABCPD"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"), F.lit("E of "), F.col("c_name")))
    return audit.scrub(c).select("c_custkey", "details", X.formula_safe(F.concat(F.lit("="), F.col("c_name"))).alias("cell"), X.file_stem(F.concat(F.lit("AB/"), F.col("c_custkey")), F.lit("x.pdf")).alias("file"))


@query("SELECT event_type, user_id % 10 AS bucket, count(*) AS n FROM events GROUP BY ALL")
def metrics_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.counters(table(spark, sf_dir, "events").withColumn("bucket", F.col("user_id") % 10), "event_type", "bucket")


@query("""
SELECT event_type, b.le, count(*) FILTER (WHERE value <= b.x) AS n FROM events, (VALUES ('1', 1.0), ('10', 10.0), ('50', 50.0), ('+Inf', 'inf'::DOUBLE)) b(le, x) GROUP BY ALL
""")
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram(table(spark, sf_dir, "events"), "value", ["event_type"], (1.0, 10.0, 50.0))


@query("""
SELECT event_type, b.le, count(*) FILTER (WHERE value <= b.x) AS n FROM events, (VALUES ('1', 1.0), ('10', 10.0), ('50', 50.0), ('+Inf', 'inf'::DOUBLE)) b(le, x) GROUP BY ALL
""")
def stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same histogram from a stream of the events in three files by time, stopped after two and restarted from its checkpoint."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    low, high = e.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    third = F.floor(3.0 * (F.unix_micros("ts") - low) / (high - low + 1))
    for i in range(3):
        e.where(third == i).write.mode("append").parquet(f"{base}/in")
        if i:
            counts = stream.bucket_counts(spark.readStream.schema(e.schema).parquet(f"{base}/in"), "value", ["event_type"], (1.0, 10.0, 50.0))
            stream.keep_updates(counts, f"{base}/out", f"{base}/state")
    return stream.histogram_so_far(spark, f"{base}/out", ["event_type"], (1.0, 10.0, 50.0))


@query("""
WITH r AS (SELECT user_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY value) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL),
g AS (SELECT user_id, n, min(v) AS lo, max(v) AS hi FROM r GROUP BY ALL HAVING n > 1),
p AS (SELECT g.*, q, q * (n + 1) AS pos, least(greatest(floor(q * (n + 1)), 1), n - 1)::BIGINT AS k FROM g, (VALUES (0.5), (0.95)) x(q)),
v AS (SELECT p.user_id, p.n, p.lo, p.hi, p.q, round(a.v + (p.pos - p.k) * (b.v - a.v), 6) AS value FROM p JOIN r a ON a.user_id = p.user_id AND a.i = p.k JOIN r b ON b.user_id = p.user_id AND b.i = p.k + 1)
SELECT user_id, n, lo AS min, max(value) FILTER (WHERE q = 0.5) AS p50, max(value) FILTER (WHERE q = 0.95) AS p95, hi AS max FROM v GROUP BY user_id, n, lo, hi
""")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summary(table(spark, sf_dir, "events"), "value", ["user_id"]).withColumns({c: F.round(c, 6) for c in ("p50", "p95")})


@query("""
WITH r AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
p AS (SELECT DISTINCT event_type, n, 0.95 * (n + 1) AS pos, least(greatest(floor(0.95 * (n + 1)), 1), n - 1)::BIGINT AS lo FROM r WHERE n > 1)
SELECT p.event_type, p.n, round(a.v + (p.pos - p.lo) * (b.v - a.v), 6) AS value FROM p JOIN r a ON a.event_type = p.event_type AND a.i = p.lo JOIN r b ON b.event_type = p.event_type AND b.i = p.lo + 1
""")
def p95_exclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.exclusive_percentile(table(spark, sf_dir, "events"), "value", 0.95, ["event_type"]).withColumn("value", F.round("value", 6))


@query("""
WITH v AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version, o_orderpriority AS p, o_orderstatus AS s FROM orders)
SELECT 'c' || o_custkey AS template_id, version, CASE WHEN b IS NULL THEN 2 ELSE (b <> p)::INT END AS n_added, CASE WHEN b IS NULL THEN 0 ELSE (b <> p)::INT END AS n_removed, coalesce((bs <> s)::INT, 0) AS n_changed
FROM (SELECT *, lag(p) OVER w AS b, lag(s) OVER w AS bs FROM v WINDOW w AS (PARTITION BY o_custkey ORDER BY version))
""")
def history_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    v = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey")).alias("template_id"), version.alias("version"), F.create_map(F.col("o_orderpriority"), F.lit("x"), F.lit("status"), F.col("o_orderstatus")).alias("label_map"))
    return templates.history(v).select("template_id", F.col("version"), F.size("added").alias("n_added"), F.size("removed").alias("n_removed"), F.size("changed").alias("n_changed"))


@query("""
WITH r AS (SELECT o_orderkey AS request_id, 'c' || o_custkey AS template_id, o_orderkey % 3 AS part, CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 1 + o_orderkey % 2 END AS expected FROM orders),
w0 AS (SELECT template_id, min(request_id) AS id FROM r WHERE part = 0 GROUP BY 1),
w1 AS (SELECT template_id, min(request_id) AS id FROM r SEMI JOIN w0 USING (template_id) WHERE part = 1 GROUP BY 1),
c AS (SELECT r.*, CASE part WHEN 0 THEN 0 WHEN 1 THEN (w0.id IS NOT NULL)::INT ELSE (w0.id IS NOT NULL)::INT + (w1.id IS NOT NULL)::INT END AS current
  FROM r LEFT JOIN w0 USING (template_id) LEFT JOIN w1 USING (template_id)),
f AS (SELECT template_id, part, min(request_id) AS id FROM c WHERE expected = current GROUP BY ALL)
SELECT request_id, c.template_id, expected, current, CASE WHEN expected <> current THEN 'stale' WHEN request_id <> f.id THEN 'taken' END AS reason,
  CASE WHEN expected = current AND request_id = f.id THEN expected + 1 END AS version, CASE WHEN expected = current AND request_id = f.id THEN request_id END AS stored
FROM c LEFT JOIN f USING (template_id, part)
""")
def template_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as version requests for their customer's template, in three commits; what was stored is read back."""
    path, key = f"{shared_dir(spark)}/templates-{uuid.uuid4().hex}", F.col("o_orderkey")
    asked = table(spark, sf_dir, "orders").select(
        key.alias("request_id"), F.concat(F.lit("c"), F.col("o_custkey")).alias("template_id"), F.when(key % 3 == 0, 0).when(key % 3 == 1, 1).otherwise(1 + key % 2).cast("int").alias("expected"),
        F.col("o_clerk").alias("created_by") if "o_clerk" in table(spark, sf_dir, "orders").columns else F.lit("x").alias("created_by"), F.create_map(F.lit("order"), key.cast("string")).alias("label_map"),
    )
    done = [store.commit(asked.where(F.col("request_id") % 3 == part), path) for part in range(3)]
    held = store.versions(spark, path).select("template_id", "version", F.col("label_map")["order"].cast("long").alias("stored"))
    every = done[0].unionByName(done[1]).unionByName(done[2])
    return every.join(held, ["template_id", "version"], "left").select("request_id", "template_id", "expected", "current", "reason", "version", "stored")


@query("""
WITH e AS (SELECT l_orderkey AS template_id, 'l ' || (l_suppkey % 5) AS label, CASE l_partkey % 4 WHEN 0 THEN '_ignore' WHEN 1 THEN 'price' WHEN 2 THEN 'isin' ELSE 'quantity' END AS path,
  row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 5 ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS r FROM lineitem),
last AS (SELECT * FROM e WHERE r = 1),
base AS (SELECT o_orderkey AS template_id, unnest(['l 0', 'l 7', 'l 1']) AS label, unnest(['yield', 'price', '_ignore']) AS path FROM orders)
SELECT template_id, label, path FROM last UNION ALL SELECT template_id, label, path FROM base ANTI JOIN last USING (template_id, label)
""")
def draft_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a reviewer's edits of their order's template."""
    base = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("template_id"), F.create_map(*map(F.lit, ["l 0", "yield", "l 7", "price"])).alias("label_map"), F.array(F.lit("l 1")).alias("ignore"))
    k = F.col("l_partkey") % 4
    edits = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("template_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("pos"), F.concat(F.lit("L/"), F.col("l_suppkey") % 5).alias("label"),
        F.when(k == 0, "_ignore").when(k == 1, "price").when(k == 2, "isin").otherwise("quantity").alias("target"),
    )
    out = drafts.merged(base, edits)
    rows = F.concat(F.transform(F.map_entries("label_map"), lambda e: F.struct(e["key"].alias("label"), e["value"].alias("path"))), F.transform("ignore", lambda i: F.struct(i.alias("label"), F.lit("_ignore").alias("path"))))
    return out.select("template_id", F.inline(rows))


@query("""
SELECT slip_id, field, value FROM (SELECT CAST(o_orderkey AS VARCHAR) AS slip_id, 'D-' || o_orderkey AS deal_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS trade_date,
  CAST(CAST(round(CAST(o_totalprice AS DECIMAL(20,4)), 2) AS DECIMAL(18,2)) AS VARCHAR) AS consideration FROM orders) UNPIVOT (value FOR field IN (deal_id, trade_date, consideration))
""")
def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    deals = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("slip_id"), F.concat(F.lit("D-"), F.col("o_orderkey")).alias("deal_id"), F.to_date("o_orderdate").alias("trade_date"), cents(F.col("o_totalprice")).cast(model.MONEY).alias("consideration"))
    return export.field_rows(validate.wide(deals))


@query("""
SELECT o_orderkey, '<?xml version="1.0" encoding="UTF-8"?><parse_result schema_version="1"><status>PARSED</status><deal><deal_id>D&amp;' || o_orderkey || '</deal_id><trade_date>' || CAST(o_orderdate AS DATE) || '</trade_date><price null="true"/><amount>' || o_totalprice
  || '</amount><linked>' || (CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END) || '</linked></deal><fields><a_b>' || o_orderstatus || '</a_b><_1st null="true"/></fields><missing_required><item>' || o_orderpriority || '</item><item null="true"/></missing_required></parse_result>' AS xml FROM orders
""")
def export_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of all orders as XML, compiled from their type."""
    k, null = F.col("o_orderkey"), F.lit(None).cast("string")
    deal = F.struct(F.concat(F.lit("D&"), k).alias("deal_id"), F.to_date("o_orderdate").alias("trade_date"), null.alias("price"), F.col("o_totalprice").alias("amount"), (k % 2 == 0).alias("linked"))
    result = F.struct(F.lit("PARSED").alias("status"), deal.alias("deal"), F.create_map(F.lit("a b"), F.col("o_orderstatus"), F.lit("1st"), null).alias("fields"), F.array(F.col("o_orderpriority"), null).alias("missing_required"))
    return export.to_xml(table(spark, sf_dir, "orders").select("o_orderkey", result.alias("r")), "r").select("o_orderkey", "xml")


@query()
def limiter_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold over each user's events in time order; SQL has none, so it is tested against a plain loop."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), "ts", (F.col("event_type") != "error").alias("ok"))
    return limit(e, 3, 86400.0 * 7, 86400.0 * 2)
