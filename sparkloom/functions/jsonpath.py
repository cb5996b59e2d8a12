"""Dotted paths into JSON text, on VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .values import col


def _is_index(seg: str) -> bool:
    return seg.removeprefix("-").isdigit() and seg.isascii()


def _items(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def path_value(json: Column, path: str) -> Column:
    """The VARIANT at a path such as ``data.items.-1.name``; null where it leads nowhere.

    A segment of digits is a place in a list (from the end if negative) or a
    key, whichever is there.
    """
    v = F.try_parse_json(json)
    for seg in (s for s in path.split(".") if s):
        if "'" in seg or "\\" in seg:
            raise ValueError(f"a path segment can't hold quotes or backslashes: {seg!r}")
        key = F.try_variant_get(v, f"$['{seg}']", "variant")
        if _is_index(seg):
            n = int(seg)
            items = _items(v)
            v = F.coalesce(F.try_element_at(items, F.lit(n + 1 if n >= 0 else n)), key)
        else:
            v = key
    return v


def path_text(json: Column, path: str) -> Column:
    """The value at a path as text: strings bare, others as JSON; null where there is none."""
    v = path_value(json, path)
    kind = F.schema_of_variant(v)
    return F.when(v.isNull() | (kind == "VOID"), F.lit(None)).when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.to_json(v)).otherwise(F.try_variant_get(v, "$", "string"))


def extract(df: DataFrame, json: str, fields: dict[str, str]) -> DataFrame:
    """A column for each path; null or missing values become empty texts."""
    return df.withColumns({name: F.coalesce(path_text(col(json), p), F.lit("")) for name, p in fields.items()})


def is_array(json: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(path_value(json, path)).startswith("ARRAY"), F.lit(False))


def explode_records(df: DataFrame, json: str, path: str, fields: dict[str, str] | None = None, number: str = "_record") -> DataFrame:
    """One row for each element of the array at a path, other columns repeated.

    An empty array gives no row; a value that isn't an array fails the query.
    fields names the columns taken from an element; without it the element's
    JSON text stays in ``record``.
    """
    items = _items(path_value(col(json), path))
    items = F.when(is_array(col(json), path), items).otherwise(F.raise_error(F.lit(f"{path} isn't an array")).cast("array<variant>"))
    out = df.select("*", F.posexplode(items).alias(number, "_element")).withColumn("record", F.to_json("_element")).drop("_element")
    if fields is None:
        return out
    return extract(out, "record", fields).drop("record")
