"""Patterns that are looked for by their fixed parts first."""

import random

from pyspark.sql import functions as F

from ticketloom import rules
from ticketloom.functions import text as X

TABLES = (rules.DEAL_TYPES, rules.DAY_COUNTS, rules.BUY_SELL, rules.BID_TYPES, rules.PROFILES["IN"]["platforms"], rules.PROFILES["IN"]["instruments"])


def test_fixed_parts():
    assert X.needles(r"\bUSD\b|US\$") == ("us$", "usd") and X.needles(r"E-?Kuber|₹") == ("kuber",) and X.needles("₹") == ()
    assert X.needles(r"vrrr?") == ("vrr",) and X.needles(r"(ab)?\d+") is None and X.needles(r"(ab)+x") == ("ab",) and X.needles(r"(?<n>a)") is None


def test_same_as_the_pattern_itself(spark):
    """ASCII or not, any case: what sought() finds is what the pattern with Unicode classes finds."""
    patterns = [(p, "" if s == "number_format" else "i") for s, p, _, _ in rules.SIGNALS] + [(p, "i") for t in TABLES for p, _ in t]
    rng = random.Random(4)
    parts = ["INR", "usd", "uſd", "US$", "Rs.", "rS 5", "₹", "cсil", "CCİL", "NSE  RFQ", "E-Kuber", "eKuber", "7.1% GS 2034", "12,34,567.00", "1.234,56", "Bünd", "Bund", "t-bill", "repo", "reverse repo", "borrow", "TREPS", "30 / 360", "Act/365", "b", "S", "\t", "ſold", "non competitive", "é", "x1", "-", "\n"]
    texts = parts + [rng.choice(["", " ", "\n"]).join(rng.choices(parts, k=rng.randint(2, 7))) for _ in range(300)] + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = lambda of: F.array(*(of(p, f) for p, f in patterns))
    fast = X.let(X.searched("t"), lambda x: got(lambda p, f: F.coalesce(X.sought(x, p, lambda t, q: F.nullif(F.regexp_substr(t, F.lit(q)), F.lit("")), f), F.lit("-"))))
    plain = got(lambda p, f: F.coalesce(F.nullif(F.regexp_substr("t", F.lit(f"(?{f}U){p}")), F.lit("")), F.lit("-")))
    rows = df.select("t", fast.alias("a"), plain.alias("b")).collect()
    assert [(r.t, p) for r in rows for p, x, y in zip(patterns, r.a, r.b, strict=True) if x != y] == []
    assert sum(x != "-" for r in rows for x in r.a) > 500
