"""Positional merge: rows of several branches, joined by their number in order."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.values import col

from .order import HIDDEN, POS, dense, require, user_columns


class MergeError(ValueError):
    pass


def check_anchor(columns: Sequence[Sequence[str]]) -> list[str]:
    """The columns that all branches share; without one, rows can't be known to belong together."""
    shared = [c for c in columns[0] if all(c in x for x in columns[1:])]
    if not shared:
        raise MergeError("the branches share no column")
    return shared


def merge(branches: Sequence[DataFrame], aligned: bool = False) -> DataFrame:
    """Row i of every branch as one row; hidden columns come from the first.

    Branches must be of equal length, share a column, and agree in each column
    that more than one has, type included; a difference fails the query whatever
    columns are used later.  aligned says that all descend row by row from one
    ancestor, and so can join on ``_pos`` without being counted or numbered.
    """
    if len(branches) == 1:
        return branches[0]
    if aligned:
        filled = bool(branches[0].limit(1).count())
    else:
        counts = [b.count() for b in branches]
        if len(set(counts)) > 1:
            raise MergeError(f"the branches have different numbers of rows: {', '.join(map(str, counts))}")
        filled = counts[0] > 0
    if filled:
        check_anchor([user_columns(b) for b in branches])
    kinds: dict[str, set[str]] = {}
    for b in branches:
        for f in b.schema.fields:
            if f.name not in HIDDEN:
                kinds.setdefault(f.name, set()).add(f.dataType.simpleString())
    clash = sorted(c for c, k in kinds.items() if len(k) > 1)
    if clash and filled:
        raise MergeError(f"the branches have different types in {', '.join(clash)}")
    key = POS if aligned else "_n"
    numbered = [b if aligned else dense(b) for b in branches]
    packed = [b.select(F.col(key).alias("_key"), F.struct(*(col(c) for c in b.columns if c != "_n")).alias(f"_b{i}")) for i, b in enumerate(numbered)]
    joined = reduce(lambda a, b: a.join(b, "_key"), packed)
    owners: dict[str, list[int]] = {}
    for i, b in enumerate(branches):
        for c in user_columns(b):
            owners.setdefault(c, []).append(i)

    def part(i: int, c: str):
        return F.col(f"_b{i}").getField(c)

    differs = [F.when(~part(own[0], c).eqNullSafe(part(i, c)), F.raise_error(F.lit(f"the branches differ in {c}")).cast("string")) for c, own in owners.items() for i in own[1:]]
    if differs:
        joined = require(joined, F.coalesce(*differs, F.lit("")))
    out = [part(own[0], c).alias(c) for c, own in owners.items()]
    return joined.select(*out, *(part(0, h).alias(h) for h in HIDDEN if h in branches[0].columns))


def conflicts(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Which shared columns differ, by key, as rows (key..., column)."""
    shared = [c for c in user_columns(left) if c in user_columns(right) and c not in on]
    a, b = left.alias("a"), right.alias("b")
    both = a.join(b, list(on))
    named = [F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in shared]
    return both.select(*on, F.explode(F.array_compact(F.array(*named))).alias("column"))
