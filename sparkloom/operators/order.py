"""Row order.  Frames are unordered in Spark; the hidden column ``_pos`` carries it.

``_pos`` is an array of whole numbers that orders like a path: a source row has
[source, row], and a row exploded from it gets its child's number appended, so
no renumbering is needed on the way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.session import settled

POS = "_pos"
TRACE, PARENT = "_trace_id", "_parent_trace_id"
HIDDEN = (POS, TRACE, PARENT)


def user_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in HIDDEN]


def visible(df: DataFrame) -> DataFrame:
    """Without the engine's own columns; a user's column such as _qc_score stays."""
    return df.drop(*HIDDEN)


def with_positions(df: DataFrame, *keys: str | Column, source: int = 0) -> DataFrame:
    """Orders df by whole-number keys."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return df.withColumn(POS, F.array(F.lit(source).cast("bigint"), *(c.cast("bigint") for c in cols)))


def require(df: DataFrame, check: Column) -> DataFrame:
    """df, with check evaluated for every row that is read, whatever columns are used later.

    A check raises an error or not; its value doesn't matter.  As the filter
    isn't deterministic, neither it nor what it needs is pruned or folded, and
    later filters stay behind it.
    """
    return df.where(F.xxhash64(check).cast("double") + F.rand() < float("inf"))


def child(pos: Column, number: Column) -> Column:
    return F.concat(pos, F.array(number.cast("bigint")))


def dense(df: DataFrame, name: str = "_n") -> DataFrame:
    """Numbers rows 0, 1, ... in order, without bringing them into one task.

    Ranges of ``_pos`` are sorted apart; each range starts where the counts of
    the ranges before it end.
    """
    parts = df.repartitionByRange(POS).sortWithinPartitions(POS).withColumn("_m", F.monotonically_increasing_id())
    parts = settled(parts)
    # one row a partition
    counts = parts.groupBy(F.shiftright("_m", 33).alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_s"))
    numbered = parts.join(starts, F.shiftright("_m", 33) == F.col("_p"))
    return numbered.withColumn(name, F.col("_s") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m", "_p", "_s")
