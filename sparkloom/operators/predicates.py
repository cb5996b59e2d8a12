"""Predicate trees: nested conditions as data, compiled to filters that reach the scan.

A condition is {"column", "op", "value"}; {"all": [...]}, {"any": [...]} and
{"not": ...} combine conditions.  Truth has two values: a comparison with a null
is false, and its negation true.  Negations are moved down to the comparisons,
where "not less" becomes "not less or null" in terms that the scan knows, so no
filter hides behind a function of its result; what all of several conditions
ask for becomes filters of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.values import col

from .table import PREDICATES, predicate

_COMPARE: dict[str, Callable[[Column, object], Column]] = {
    "eq": lambda c, v: c == F.lit(v),
    "ne": lambda c, v: c != F.lit(v),
    "lt": lambda c, v: c < F.lit(v),
    "le": lambda c, v: c <= F.lit(v),
    "gt": lambda c, v: c > F.lit(v),
    "ge": lambda c, v: c >= F.lit(v),
}
_OPPOSITE = {"eq": "ne", "ne": "eq", "lt": "ge", "le": "gt", "gt": "le", "ge": "lt"}


class PredicateError(ValueError):
    pass


def _leaf(df: DataFrame, node: dict, holds: bool) -> Column:
    name, op, value = node.get("column"), node.get("op"), node.get("value")
    if name not in df.columns:
        raise PredicateError(f"there is no column {name}")
    c = col(name)
    if op in ("is_null", "not_null"):
        return c.isNull() if (op == "is_null") == holds else c.isNotNull()
    if op == "between":
        if not isinstance(value, (list, tuple)) or len(value) != 2:
            raise PredicateError("between takes two values")
        low, high = value
        return (c >= F.lit(low)) & (c <= F.lit(high)) if holds else (c < F.lit(low)) | (c > F.lit(high)) | c.isNull()
    if op in ("in", "not_in"):
        if not isinstance(value, (list, tuple)):
            raise PredicateError(f"{op} takes a list")
        some, null = [v for v in value if v is not None], any(v is None for v in value)
        inside = holds == (op == "in")
        if inside:
            found = c.isin(some) if some else F.lit(False)
            return found | c.isNull() if null else found
        missing = ~c.isin(some) if some else c.isNotNull()
        return missing if null else missing | c.isNull()
    if op in _COMPARE:
        if value is None:
            # eq null asks for nulls; an order among nulls there isn't
            if op not in ("eq", "ne"):
                return F.lit(not holds)
            return c.isNull() if (op == "eq") == holds else c.isNotNull()
        if isinstance(df.schema[name].dataType, T.NumericType) and isinstance(value, str):
            raise PredicateError(f"{name} holds numbers, not {value!r}")
        if holds:
            # a null differs from every value
            return _COMPARE[op](c, value) | c.isNull() if op == "ne" else _COMPARE[op](c, value)
        return _COMPARE["eq"](c, value) if op == "ne" else _COMPARE[_OPPOSITE[op]](c, value) | c.isNull()
    if op in PREDICATES:
        got = predicate(df, name, op, value)
        return got if holds else ~F.coalesce(got, F.lit(False))
    raise PredicateError(f"op {op!r} is unknown")


def _conjuncts(df: DataFrame, node: dict, holds: bool) -> list[Column]:
    if not isinstance(node, dict) or not node:
        raise PredicateError(f"{node!r} is no condition")
    if "not" in node:
        return _conjuncts(df, node["not"], not holds)
    for word, other in (("all", "any"), ("any", "all")):
        if word in node:
            parts = node[word]
            if not isinstance(parts, list):
                raise PredicateError(f"{word} takes a list of conditions")
            if (word == "all") == holds:
                return [c for p in parts for c in _conjuncts(df, p, holds)]
            out = F.lit(False)
            for p in parts:
                one = F.lit(True)
                for c in _conjuncts(df, p, holds):
                    one = one & c
                out = out | one
            return [out]
    return [_leaf(df, node, holds)]


def conjuncts(df: DataFrame, tree: dict) -> list[Column]:
    """The conditions that all must hold; none for an empty ``all``."""
    return _conjuncts(df, tree, True)


def where_tree(df: DataFrame, tree: dict) -> DataFrame:
    """The rows for which a tree holds."""
    for c in conjuncts(df, tree):
        df = df.where(c)
    return df
