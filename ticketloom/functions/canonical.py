"""Canonical JSON text of a column, compiled from its type: keys sorted at every depth, nulls kept, no white space, characters as they are.

The text is that of ``json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)`` for the value that the
column holds, so that a hash over it is the same wherever it is computed. It is built from string functions only.

Defined results: a null struct, map, array or value is ``null``; a map's keys are strings or become strings, and are sorted by code point.
Doubles are printed with the fewest digits that read back as the same number. Decimals, dates and
times are strings: decimals without exponent, times without zone. Binary isn't supported and raises when the column is compiled.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import let

# JSON's two-character escapes.
SHORT = {"\\": "\\\\", '"': '\\"', "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def quoted(c: Column) -> Column:
    """A string as JSON text."""

    def escape(s: Column, pairs) -> Column:
        for a, b in pairs:
            s = F.replace(s, F.lit(a), F.lit(b))
        return s

    rare = [(chr(i), SHORT.get(chr(i), f"\\u{i:04x}")) for i in range(32)]
    plain = escape(c, [(k, SHORT[k]) for k in ("\\", '"')])
    return F.concat(F.lit('"'), let(plain, lambda s: F.when(s.rlike(r"[\x00-\x1f]"), escape(s, rare)).otherwise(s)), F.lit('"'))


def float_text(c: Column) -> Column:
    """The fewest digits that read back as the same double, set out with a point or, beyond 16 places, with an exponent."""

    def shown(s: Column) -> Column:
        part = lambda i: F.regexp_extract(s, r"^-?(\d+)\.(\d+)(?:[eE]\+?(-?\d+))?$", i)
        raw = F.concat(part(1), part(2))
        digits = F.regexp_replace(raw, "^0+|0+$", "")
        lead = F.length(raw) - F.length(F.regexp_replace(raw, "^0+", ""))
        point = F.length(part(1)) + F.coalesce(F.nullif(part(3), F.lit("")).cast("int"), F.lit(0)) - lead
        return let(F.struct(digits.alias("d"), point.alias("p"), F.when(s.startswith("-"), "-").otherwise("").alias("sign")), placed)

    def placed(x: Column) -> Column:
        d, p, n = x["d"], x["p"], F.length(x["d"])
        fixed = (
            F.when(p <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -p), d))
            .when(p >= n, F.concat(d, F.repeat(F.lit("0"), p - n), F.lit(".0")))
            .otherwise(F.concat(F.substring(d, F.lit(1), p), F.lit("."), F.substring(d, p + 1, n)))
        )
        e = p - 1
        power = F.concat(F.lit("e"), F.when(e < 0, "-").otherwise("+"), F.when(F.abs(e) < 10, "0").otherwise(""), F.abs(e).cast("string"))
        far = F.concat(F.substring(d, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(d, F.lit(2), n))).otherwise(""), power)
        return F.concat(x["sign"], F.when(n == 0, "0.0").when((p <= -4) | (p > 16), far).otherwise(fixed))

    def shortest(x: Column) -> Column:
        all_ = x.cast("string")  # in Java before 19 not always the shortest
        text = F.when(all_.isin("NaN", "Infinity", "-Infinity"), all_)
        for digits in (15, 16, 17):
            fewer = F.format_string(f"%.{digits - 1}e", x)
            text = text.when(fewer.cast("double") == x, fewer)
        text = text.otherwise(all_)
        return let(text, lambda s: F.when(s.isin("NaN", "Infinity", "-Infinity"), s).otherwise(shown(s)))

    return let(c.cast("double"), shortest)


def members(fields: list[tuple[str, Column, T.DataType]], gap: str = "") -> list[Column]:
    """``"name":value`` of each field, in the order of the names."""
    return [F.concat(quoted(F.lit(name)), F.lit(f":{gap}"), json_text(c, t, gap)) for name, c, t in sorted(fields, key=lambda f: f[0])]


def joined(items: list[Column], gap: str = "") -> Column:
    """The items with commas between."""
    return F.concat(*(x for i, c in enumerate(items) for x in ((F.lit(f",{gap}"), c) if i else (c,)))) if items else F.lit("")


def json_text(c: Column, t: T.DataType, gap: str = "") -> Column:
    """The text of a column of a type; gap stands behind commas and colons (a space, as json.dumps has it by itself)."""
    if isinstance(t, T.StructType):
        text = F.concat(F.lit("{"), joined(members([(f.name, c[f.name], f.dataType) for f in t], gap), gap), F.lit("}"))
    elif isinstance(t, T.MapType):
        entries = F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(e["key"].cast("string").alias("key"), e["value"].alias("value"))), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
        text = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(f":{gap}"), json_text(e["value"], t.valueType, gap))), f",{gap}"), F.lit("}"))
    elif isinstance(t, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(c, lambda e: json_text(e, t.elementType, gap)), f",{gap}"), F.lit("]"))
    elif isinstance(t, T.BooleanType) or isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        text = c.cast("string")
    elif isinstance(t, (T.FloatType, T.DoubleType)):
        text = float_text(c)
    elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        seconds, micros = F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.date_format(c, "SSSSSS")
        text = quoted(F.concat(seconds, F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise("")))
    elif isinstance(t, (T.StringType, T.DecimalType, T.DateType)):
        text = quoted(c.cast("string"))
    elif isinstance(t, T.NullType):
        return F.lit("null")
    else:
        raise TypeError(f"no JSON text for {t.simpleString()}")
    return F.when(c.isNull(), "null").otherwise(text)
