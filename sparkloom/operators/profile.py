"""Column profiles and previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.values import col, not_blank, text_of

from .order import user_columns, visible

#: Distinct values up to which a profile lists each with its count.
LISTED = 15
#: The names of types in a profile.
KINDS = ("bool", "dict", "float", "int", "list", "str")


def _kind(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.VariantType):
        s = F.schema_of_variant(c)
        return F.when(s == "BIGINT", "int").when(s == "BOOLEAN", "bool").when(s == "STRING", "str").when(s.startswith("OBJECT"), "dict").when(s.startswith("ARRAY"), "list").otherwise("float")
    for types, name in (
        ((T.BooleanType,), "bool"), ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), "int"),
        ((T.FloatType, T.DoubleType, T.DecimalType), "float"), ((T.ArrayType,), "list"), ((T.StructType, T.MapType), "dict")
    ):
        if isinstance(kind, types):
            return F.lit(name)
    return F.lit("str")


def describe(df: DataFrame, column: str) -> DataFrame:
    """One row: rows, share missing (null or blank, whole percent), types of values, distinct values.

    All rows count.  value_counts lists values as ``value=count`` where there are
    at most LISTED; else it is null and distinct_estimate stands for it.
    """
    kind = df.schema[column].dataType
    text = text_of(col(column), kind, None)
    rows = df.select(text.alias("v"), _kind(col(column), kind).alias("k"))
    there = F.coalesce(not_blank(F.col("v")), F.lit(False))
    # one row a value and task leaves the map side; both results below reuse that one shuffle
    values = rows.groupBy(F.when(there, F.col("v")).alias("v"), "k").agg(F.count(F.lit(1)).alias("n"))
    real = F.col("v").isNotNull()
    by_kind = [F.sum(F.when(real & (F.col("k") == k), F.col("n"))).alias(f"k_{k}") for k in KINDS]
    total = values.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(~real, F.col("n"))), F.lit(0)).alias("missing"),
        F.count("v").alias("distinct"),
        *by_kind,
    )
    few = values.orderBy(real.desc(), F.desc("n"), "v").limit(LISTED + 1)
    listed = few.agg(F.collect_list(F.when(real, F.struct((-F.col("n")).alias("o"), F.concat("v", F.lit("="), F.col("n").cast("string")).alias("s")))).alias("l"))
    dtypes = F.array_join(F.array_compact(F.array(*(F.concat(F.lit(f"{k}="), F.col(f"k_{k}").cast("string")) for k in KINDS))), ",")
    return total.crossJoin(listed).select(  # each side is one row
        F.lit(column).alias("column"),
        F.col("rows").cast("bigint").alias("rows"),
        F.coalesce(F.bround(F.try_divide(F.col("missing") * 100, F.col("rows")), 0).cast("bigint"), F.lit(0)).alias("missing_pct"),
        dtypes.alias("dtypes"),
        F.when(F.col("distinct") <= LISTED, F.array_join(F.transform(F.array_sort("l"), lambda x: x["s"]), ",")).alias("value_counts"),
        F.when(F.col("distinct") > LISTED, F.col("distinct")).alias("distinct_estimate"),
    )


def preview(df: DataFrame, rows: int = 20, cell: int = 500, chars: int = 16_000) -> list[dict]:
    """The first rows as texts of at most cell characters; fewer rows, then shorter cells, to fit chars."""
    shown = visible(df).limit(rows)
    texts = [text_of(col(c), df.schema[c].dataType, None).alias(c) for c in user_columns(df)]
    got = [
        r.asDict() for r in shown.select(
            *(F.when(F.length(t) > cell, F.concat(F.substring(t, 1, cell), F.lit("…"))).otherwise(t).alias(c) for t, c in zip(texts, user_columns(df), strict=True))
        ).collect()
    ]

    def size() -> int:
        return sum(len(str(v)) for r in got for v in r.values())

    while len(got) > 1 and size() > chars:
        got.pop()
    while size() > chars and cell > 1:
        cell //= 2
        got = [{k: v if v is None or len(v) <= cell else v[:cell] + "…" for k, v in r.items()} for r in got]
    return got
