"""Cell-level rules: text of a value, finite numbers, blanks, casts and regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(name: str) -> Column:
    """A column by its literal name; dots and back-ticks are part of the name."""
    return F.col("`" + name.replace("`", "``") + "`")


def finite(c: Column) -> Column:
    """Null for NaN and the infinities, which no table holds."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(c)


def _float_text(c: Column) -> Column:
    """Shortest decimal text: positional from 1e-4 to below 1e16, with an exponent outside."""
    s = c.cast("string")
    sign = F.when(s.startswith("-"), "-").otherwise("")
    body = F.regexp_replace(s, "^-", "")
    e = F.regexp_extract(body, r"E(-?\d+)$", 1).try_cast("int")
    mantissa = F.regexp_replace(body, r"E.*$", "")
    digits = F.regexp_replace(F.regexp_replace(mantissa, r"\.0$", ""), r"\.", "")
    whole = F.rpad(digits, 17, "0")
    high = F.concat(F.substring(whole, F.lit(1), e + 1), F.lit("."), F.when(F.length(digits) > e + 1, F.substring(digits, e + 2, F.lit(40))).otherwise("0"))
    low = F.concat(F.lit("0.000"), digits)
    exponent = F.concat(F.regexp_replace(mantissa, r"\.0$", ""), F.when(e < 0, "e-").otherwise("e+"), F.when(F.abs(e) < 10, "0").otherwise(""), F.abs(e).cast("string"))
    infinite = F.abs(c) == float("inf")
    # most numbers have no exponent: for these nothing else is worked out
    return (
        F.when(F.isnan(c), "nan")
        .when(infinite, F.concat(sign, F.lit("inf")))
        .when(~F.contains(s, F.lit("E")), s)
        .when((e >= 0) & (e < 16), F.concat(sign, high))
        .when(e == -4, F.concat(sign, low))
        .otherwise(F.concat(sign, exponent))
    )


def text_of(c: Column, kind: T.DataType, null: str | None = "None") -> Column:
    """The text of a value as the pipelines' users know it: True/False, 1e+16, None."""
    if isinstance(kind, T.BooleanType):
        s = F.initcap(c.cast("string"))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        s = _float_text(c.cast("double"))
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        s = F.to_json(c, {"ignoreNullFields": "false"})
    elif isinstance(kind, T.VariantType):
        s = F.coalesce(F.try_variant_get(c, "$", "string"), F.to_json(c))
    else:
        s = c.cast("string")
    return s if null is None else F.coalesce(s, F.lit(null))


def not_blank(c: Column) -> Column:
    """Has a character that isn't white space, as Python knows it: Unicode's, and the four separators of ASCII."""
    return c.rlike(r"(?U)[^\s\x1c-\x1f]")


def java_regex(pattern: str) -> str:
    """A pattern in the Python dialect, for the JVM: named groups and Unicode classes."""
    p = re.sub(r"\(\?P<(\w+)>", r"(?<\1>", pattern)
    p = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", p)
    return "(?U)" + p.replace(r"\Z", r"\z")


_CASTS = {"str": "string", "int": "bigint", "float": "double"}


def strict_cast(c: Column, kind: T.DataType, to: str) -> Column:
    """str, int or float; a null or a bad value fails the query."""
    if to not in _CASTS:
        raise ValueError(f"cast to {to!r}: it must be one of {', '.join(_CASTS)}")
    if to == "str":
        return text_of(c, kind)
    checked = F.when(c.isNull(), F.raise_error(F.lit(f"cast to {to}: a value is missing"))).otherwise(c)
    if isinstance(kind, T.StringType):
        plain = F.regexp_replace(F.trim(checked), r"(?<=\d)_(?=\d)", "")
        if to == "int":
            return F.when(plain.rlike(r"^[+-]?\d+$"), plain.cast("bigint")).otherwise(F.raise_error(F.concat(F.lit("cast to int: "), plain)).cast("bigint"))
        return _only_finite(plain.cast("double"))
    return checked.cast("bigint") if to == "int" else _only_finite(checked.cast("double"))


def _only_finite(c: Column) -> Column:
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.raise_error(F.lit("cast to float: the value isn't finite")).cast("double")).otherwise(c)
