"""Joins where one key may hold a third of the rows.

Keys with many rows are few: of ``rows`` rows at most ``rows / most`` keys have
more than ``most``.  Only these go to every task, with ``most`` chosen so that
they number at most ``HOT_KEYS``; their rows stay where they are in the join's
terms, for they are dealt out by another column.  All other rows meet by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bound of the keys that are broadcast.
HOT_KEYS = 100_000


def task_rows(weights: DataFrame, weight: str, hot_keys: int = HOT_KEYS) -> int:
    """The rows of a key beyond which it is hot; weights has each key once, with its rows."""
    total = weights.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    return max(total // hot_keys, total // (8 * int(weights.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 1)


def join_dealt(left: DataFrame, right: DataFrame, keys: list[str], deal: Column, weights: DataFrame, weight: str = "n", hot_keys: int = HOT_KEYS) -> DataFrame:
    """left and right joined on keys that right may have several times.

    weights has each key once, with its rows in left, and is read three times:
    hand over a written table.  A hot key's rows of left are dealt to as many
    parts as its weight asks for, and its rows of right go to each part.
    """
    most = task_rows(weights, weight, hot_keys)
    hot = F.broadcast(weights.where(F.col(weight) > most).select(*keys, F.ceil(F.col(weight) / most).cast("long").alias("_parts")))
    one = left.join(hot, keys, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(deal), F.col("_parts")), F.lit(0).cast("long"))).drop("_parts")
    two = right.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1).cast("long")) - 1))).drop("_parts")
    return one.join(two, [*keys, "_part"]).drop("_part")


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], deal: Column, weight: str = "n", how: str = "inner", hot_keys: int = HOT_KEYS) -> DataFrame:
    """left with right's columns; right has each key once, with the left rows of that key in ``weight``.

    A key is hot where it has more rows than a task should get, and more than
    one in ``hot_keys`` of all rows, so at most ``hot_keys`` keys are hot.
    ``deal`` spreads the left rows of hot keys; it must not be one value for
    all of them.  Right is read three times: hand over a written table.  Rows
    whose key is null match nothing; with how="left" they are kept.
    """
    most = task_rows(right, weight, hot_keys)
    values = [c for c in right.columns if c not in (*keys, weight)]
    hot = F.broadcast(right.where(F.col(weight) > most).select(*(F.col(k).alias(f"_hot_{k}") for k in keys), F.struct(F.lit(True).alias("_found"), *values).alias("_hot")))
    # always 0, but not a literal: Spark would take that out of the join's keys
    rest = right.where(F.col(weight) <= most).select(
        *(F.col(k).alias(f"_key_{k}") for k in keys), F.struct(F.lit(True).alias("_found"), *values).alias("_rest"),
        F.pmod(F.col(weight).cast("long"), F.lit(1).cast("long")).alias("_none")
    )
    marked = left.join(hot, [F.col(k) == F.col(f"_hot_{k}") for k in keys], "left")
    # rows of hot keys get a dealing value that no key of the rest has
    marked = marked.withColumn("_deal", F.when(F.col("_hot").isNull(), F.lit(0).cast("long")).otherwise(F.coalesce(F.xxhash64(deal).bitwiseOR(F.lit(1)), F.lit(1).cast("long"))))
    both = marked.join(rest, [*(F.col(k) == F.col(f"_key_{k}") for k in keys), F.col("_deal") == F.col("_none")], "left")
    got = F.coalesce("_hot", "_rest")
    if how == "inner":
        both = both.where("_hot IS NOT NULL OR _rest IS NOT NULL")
    return both.select(*left.columns, *(got.getField(c).alias(c) for c in values))
