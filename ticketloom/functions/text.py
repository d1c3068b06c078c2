"""String and label functions as columns."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import rules

LABEL_CHARS, DIGIT_SHARE = 60, 0.30


def text_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(x) with x bound to the value: evaluated once, and one copy in the plan however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def squeeze(c: Column | str) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text_of(c), r"(?U)\s+", " "))


def clean_cell(c: Column | str) -> Column:
    """Squeezed text of a cell; null and cells that only draw a rule (``____``, ``-.-``) are empty."""
    return let(squeeze(F.coalesce(text_of(c), F.lit(""))), lambda s: F.when(s.rlike(r"(?U)^[_\-.\s]*$"), "").otherwise(s))


def label_like(c: Column | str) -> Column:
    """Short, has a letter, and fewer than three in ten of its visible characters are digits."""

    def check(s):
        few = let(F.regexp_replace(s, r"(?U)\s", ""), lambda x: F.length(x) - F.length(F.regexp_replace(x, r"(?U)\d", "")) < DIGIT_SHARE * F.length(x))
        return (F.length(s) <= LABEL_CHARS) & s.rlike(r"\p{L}") & few

    return F.coalesce(let(F.regexp_replace(text_of(c), r"(?U)^\s+|\s+$", ""), check), F.lit(False))


def words_only(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


@F.pandas_udf(T.StringType())
def compatible(s: pd.Series) -> pd.Series:
    """NFKC, which Spark has no function for."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def full_key(c: Column | str) -> Column:
    """Lookup key of a label (NFKC text): lower-case words and numbers."""
    return words_only(text_of(c))


def short_key(c: Column | str) -> Column:
    """The key without what stands in parentheses; the full key if nothing else is left."""
    return F.coalesce(F.nullif(words_only(F.regexp_replace(F.lower(text_of(c)), r"\([^)]*\)", " ")), F.lit("")), full_key(c))


def expand_abbreviations(key: Column | str) -> Column:
    table = F.create_map(*(F.lit(x) for kv in rules.ABBREVIATIONS.items() for x in kv))
    return F.array_join(F.transform(F.split(text_of(key), " "), lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")


def mask_pan(c: Column | str) -> Column:
    """Personal account numbers keep their letters only."""
    return F.regexp_replace(text_of(c), r"\b([A-Z]{5})\d{4}([A-Z])\b", "$1****$2")


def formula_safe(c: Column | str) -> Column:
    """Text that a spreadsheet would run as a formula gets an apostrophe."""
    c = text_of(c)
    return F.when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def actor_name(c: Column | str) -> Column:
    return F.substring(F.regexp_replace(text_of(c), r"[\x00-\x1f\x7f]", ""), 1, 200)


def file_stem(deal_id: Column | str, file: Column | str) -> Column:
    """Download name: the deal id, else the file's stem, with anything unusual as an underscore."""
    stem = F.regexp_replace(text_of(file), r"\.[^.]*$", "")
    return F.regexp_replace(F.coalesce(text_of(deal_id), stem), "[^A-Za-z0-9._-]", "_")


@lru_cache(maxsize=None)
def needles(pattern: str) -> tuple[str, ...] | None:
    """Lower-case texts of which every ASCII text that the pattern is found in holds one, whatever its case; None if the pattern has no such texts."""

    def of(items) -> set[str] | None:
        found, run = [], ""
        for op, arg in items:
            name, own = str(op), None
            if name == "LITERAL" and (arg < 128 or chr(arg).isalpha()):
                run += chr(arg).lower() if arg < 128 else ""
                if arg < 128:
                    continue
            elif name == "LITERAL":
                own = set()  # no ASCII text has it
            elif name == "SUBPATTERN":
                own = of(arg[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0]:
                own = of(arg[2])
            elif name == "BRANCH":
                parts = [of(p) for p in arg[1]]
                own = None if None in parts else set().union(*parts)
            elif name in ("AT", "ASSERT", "ASSERT_NOT"):  # takes no character
                continue
            found += [{run}] if run else []
            found += [own] if own is not None else []
            run = ""
        found += [{run}] if run else []
        return max(found, key=lambda s: (min(map(len, s), default=99), -len(s)), default=None)

    try:
        out = of(re._parser.parse(pattern, re.IGNORECASE))
    except (AttributeError, re.error):
        return None
    return None if out is None else tuple(sorted(out))


def searched(c: Column | str) -> Column:
    """struct(t, low, plain) of a text that many patterns are searched in, for sought()."""
    c = text_of(c)
    return F.struct(c.alias("t"), F.lower(c).alias("low"), (F.octet_length(c) == F.length(c)).alias("plain"))


def sought(x: Column, pattern: str, search, flags: str = "i") -> Column:
    """search(text, pattern with its flags) of a text of searched(), null if the pattern can't be in it. An ASCII text is asked for the pattern's fixed
    parts first, which is much cheaper, and needs no Unicode classes; in other texts case is another matter."""
    own = search(x["t"], f"(?{flags}){pattern}" if flags else pattern)
    fixed = needles(pattern)
    if fixed is not None:
        may = F.lit(False)
        for n in fixed:
            may = may | x["low"].contains(n)
        own = F.when(may, own)
    return F.when(x["plain"], own).otherwise(search(x["t"], f"(?{flags}U){pattern}"))


def first_pattern(c: Column | str, table: list[tuple[str, str]]) -> Column:
    """Code of the first pattern found in the text, case ignored; null if none is."""
    return let(searched(c), lambda x: F.coalesce(*(F.when(sought(x, p, lambda t, q: t.rlike(q)), code) for p, code in table), F.lit(None).cast("string")))


def extract(c: Column | str, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null if there is none or it is empty."""
    return F.nullif(F.regexp_extract(text_of(c), pattern, group), F.lit(""))
