"""Canonical JSON: sorted keys at every depth, no blanks, nulls kept, numbers as Python's ``json`` writes them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _quoted(x: Column) -> Column:
    text = F.to_json(F.array(x.cast("string")))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def _number(x: Column) -> Column:
    """The shortest decimal form, plain from 1e-4 up to 1e16, else with an exponent of two digits at least."""
    s = x.cast("double").cast("string")
    sign = F.when(s.startswith("-"), "-").otherwise("")
    body = F.regexp_replace(s, "^-", "")
    mantissa, power = F.regexp_extract(body, r"^([0-9.]+)E", 1), F.regexp_extract(body, r"E(-?[0-9]+)$", 1).cast("int")
    digits = F.regexp_replace(F.regexp_replace(mantissa, r"\.0$", ""), r"\.", "")
    padded = F.rpad(digits, F.greatest(F.length(digits), power + 1), "0")
    tail = F.substring(padded, power + 2, F.length(padded))
    plain = F.concat(F.substring(padded, F.lit(1), power + 1), F.lit("."), F.when(tail == "", "0").otherwise(tail))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    exponent = F.concat(F.regexp_replace(mantissa, r"\.0$", ""), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), "0"))
    wide = F.when(power.between(0, 15), plain).when(power.between(-4, -1), small).otherwise(exponent)
    return F.when(F.isnan(x), "NaN").when(body == "Infinity", F.concat(sign, F.lit("Infinity"))).when(body.contains("E"), F.concat(sign, wide)).otherwise(s)


def _text(x: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = [F.concat(_quoted(F.lit(f.name)), F.lit(":"), _text(x.getField(f.name), f.dataType)) for f in fields]
        made = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif isinstance(kind, T.MapType):
        entries = F.array_sort(F.map_entries(x), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
        made = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(_quoted(e["key"]), F.lit(":"), _text(e["value"], kind.valueType))), ","), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        made = F.concat(F.lit("["), F.array_join(F.transform(x, lambda v: _text(v, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        made = _number(x)
    elif isinstance(kind, (T.BooleanType, T.IntegralType)):
        made = x.cast("string")
    else:
        made = _quoted(x)
    return F.coalesce(F.when(x.isNotNull(), made), F.lit("null"))


def canonical_json(x: Column, kind: T.DataType) -> Column:
    """The canonical text of a value of the type ``kind``; null gives ``null``.

    Fields of structs and keys of maps (read as text) are in code-point order; letters beyond ASCII stay as they are; dates, times and decimals are
    quoted texts.
    """
    return _text(x, kind)
