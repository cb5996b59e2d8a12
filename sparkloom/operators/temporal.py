"""Joins by time and by range: the last row before another, overlapping intervals, and sessions.

Keys with many rows are split by time.  They are few: only keys with more rows
than a task should get are, so their number is bounded by the rows over that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.values import col

#: Parts of a task's share beyond which a key counts as hot.
SHARE = 4
_SIDE, _TIME, _PART, _RIGHT = "_side", "_time", "_part", "_right"


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _number(c: str, kind: T.DataType) -> Column:
    """A time as a number that keeps its order, to the second for dates and local times."""
    if isinstance(kind, (T.TimestampNTZType, T.DateType)):
        days = F.datediff(col(c), F.to_date(F.lit("1970-01-01"))).cast("double") * 86400
        clock = F.hour(col(c)) * 3600 + F.minute(col(c)) * 60 + F.second(col(c)) if isinstance(kind, T.TimestampNTZType) else F.lit(0)
        return days + clock
    return col(c).cast("double")


def _hot(rows: DataFrame, by: Sequence[str], parts: int) -> DataFrame:
    """(by with _hot behind the names, _hot): the keys with more rows than a quarter of a task's share; at most SHARE * parts of them."""
    counts = rows.groupBy(*(col(c) for c in by)).agg(F.count(F.lit(1)).alias("_n"))
    total = rows.agg(F.count(F.lit(1)).alias("_total"))
    return counts.crossJoin(F.broadcast(total)).where(F.col("_n") * SHARE * parts > F.greatest(F.col("_total"), F.lit(SHARE * parts))).select(*(col(c).alias(f"{c}_hot") for c in by), F.lit(True).alias("_hot"))


def asof_join(
    left: DataFrame, right: DataFrame, time: str, right_time: str | None = None, by: Sequence[str] = (), columns: Sequence[str] | None = None,
    tolerance: Column | None = None, ties: Sequence[str] = (), exact: bool = True, suffix: str = "_right"
) -> DataFrame:
    """left with the columns of the last row of right whose time isn't after its own, among equal keys.

    tolerance bounds the age (an interval, or a number where times are numbers);
    exact=False leaves out rows of the same time.  Of rows of right with the same
    time the one greatest by ``ties`` counts.  Rows of left without a match, a
    time or a key have nulls.  Columns whose names left has get the suffix.

    Both sides are shuffled once, by key and, for hot keys, by a range of time
    as well.  Each part finds its matches in one ordered pass; what a part has
    last is handed to those behind it, a row for each part.
    """
    by, right_time = list(by), right_time or time
    parts = _partitions(left)
    wanted = [c for c in (columns if columns is not None else right.columns) if c not in by]
    before = F.lit(0 if exact else 1)  # at equal times rows of right stand before those of left, or behind
    lefts = left.select(*(col(c).alias(f"_by{i}") for i, c in enumerate(by)), col(time).alias(_TIME), (1 - before).alias(_SIDE), F.struct(*(col(c) for c in left.columns)).alias("_left"))
    carried = F.struct(col(right_time).alias("t"), F.struct(*(col(c) for c in ties), F.lit(0)).alias("o"), F.struct(*(col(c) for c in wanted)).alias("r"))
    rights = right.where(col(right_time).isNotNull()).select(*(col(c).alias(f"_by{i}") for i, c in enumerate(by)), col(right_time).alias(_TIME), before.alias(_SIDE), carried.alias(_RIGHT))
    both = lefts.unionByName(rights, allowMissingColumns=True)
    keys = [f"_by{i}" for i in range(len(by))]
    hot = _hot(both.select(*keys, _TIME), keys, parts)
    # bounds of about equal numbers of rows; the driver sees no more than there are partitions
    seconds = _number(_TIME, both.schema[_TIME].dataType)
    cuts = both.agg(F.percentile_approx(seconds, [i / parts for i in range(1, parts)] or [0.5], F.lit(max(10_000, 20 * parts)))).first()[0] or []
    bounds = F.array(*(F.lit(float(c)) for c in sorted(set(cuts)))) if cuts else F.array().cast("array<double>")
    is_hot, marks = [F.col(k).eqNullSafe(F.col(f"{k}_hot")) for k in keys], [f"{k}_hot" for k in keys]
    both = both.join(F.broadcast(hot), is_hot, "left").drop(*marks) if keys else both.withColumn("_hot", F.lit(True))
    both = both.withColumn(_PART, F.when(F.col("_hot"), F.size(F.filter(bounds, lambda c: c <= seconds))).otherwise(0))
    ordered = Window.partitionBy(*keys, _PART).orderBy(_TIME, _SIDE, f"{_RIGHT}.o")
    own = both.withColumn("_own", F.last(_RIGHT, ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # what earlier parts of a hot key have last: a row a part
    lasts = rights.join(F.broadcast(hot), is_hot).drop(*marks, "_hot") if keys else rights
    lasts = lasts.groupBy(*keys, F.size(F.filter(bounds, lambda c: c <= seconds)).alias(_PART)).agg(F.max(F.struct(F.col(f"{_RIGHT}.t"), F.col(f"{_RIGHT}.o"), F.col(_RIGHT))).alias("_last"))
    reach = lasts.select(*(F.col(k).alias(f"{k}_") for k in keys), F.col(_PART).alias("_from"), F.col(f"_last.{_RIGHT}").alias("_carry"))
    every = reach.withColumn("_to", F.coalesce(F.lead("_from").over(Window.partitionBy(*(f"{k}_" for k in keys)).orderBy("_from")), F.lit(parts)))
    spread = every.select("*", F.explode(F.sequence(F.col("_from") + 1, F.col("_to"))).alias("_p")).drop("_from", "_to")
    mine = own.where("_left IS NOT NULL")
    # on the columns by which rows already are together
    joined = mine.join(spread, [*(F.col(k) == F.col(f"{k}_") for k in keys), F.col(_PART) == F.col("_p")], "left")
    found = F.coalesce("_own", "_carry")
    known = F.col(_TIME).isNotNull()
    for k in keys:
        known &= F.col(k).isNotNull()
    if tolerance is not None:
        known &= F.col("_found.t") >= F.col(_TIME) - tolerance
    out = joined.withColumn("_found", found).withColumn("_found", F.when(known, F.col("_found")))
    return out.select("_left.*", *(F.col("_found.r").getField(c).alias(f"{c}{suffix}" if c in left.columns else c) for c in wanted))


def interval_join(
    left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], by: Sequence[str] = (), suffix: str = "_right"
) -> DataFrame:
    """Pairs of rows whose closed intervals of whole numbers overlap, among equal keys.

    An interval lives on the level of its length: bins of the least power of two
    that isn't less, of which it meets two at most.  A pair meets on the higher
    of its two levels, in the bin that holds the later of the two beginnings, so
    it is found once and a long interval isn't copied into many small bins.  Rows
    are copied for each level of the other side that is above their own: at most
    64, as many as there are; the driver sees these levels alone.  Rows with a
    null, or that end before they begin, have no pairs.
    """
    sides = []
    for df, (a, b) in ((left, left_span), (right, right_span)):
        rows = df.where(col(a) <= col(b)).select(F.struct(*(col(c) for c in df.columns)).alias("row"), col(a).cast("long").alias("a"), col(b).cast("long").alias("b"), *(col(c).alias(f"k{i}") for i, c in enumerate(by)))
        # the bits of its length
        sides.append(rows.withColumn("level", F.length(F.bin(F.col("b") - F.col("a")))))
    levels = [sorted(r.level for r in s.select("level").distinct().collect()) for s in sides]
    placed = []
    for s, others, name in zip(sides, reversed(levels), "lr", strict=True):
        # on its own level a row meets all of the other side that live there or below, above it only those that live there
        at = F.array_distinct(F.concat(F.array("level"), F.filter(F.array(*(F.lit(x) for x in others)).cast("array<int>"), lambda x: x > F.col("level"))))
        rows = s.withColumn("at", F.explode(at))
        first, last = (F.expr(f"shiftright({x}, at)") for x in "ab")
        rows = rows.withColumn("bin", F.explode(F.sequence(first, last)))
        placed.append(rows.select(*(F.col(c).alias(f"{name}_{c}") for c in rows.columns)))
    one, two = placed
    same = [F.col("l_at") == F.col("r_at"), F.col("l_bin") == F.col("r_bin"), *(F.col(f"l_k{i}") == F.col(f"r_k{i}") for i in range(len(by)))]
    meets = F.greatest("l_level", "r_level") == F.col("l_at")
    begins = F.expr("shiftright(greatest(l_a, r_a), l_at)") == F.col("l_bin")
    overlap = (F.col("l_a") <= F.col("r_b")) & (F.col("r_a") <= F.col("l_b"))
    pairs = one.join(two, same).where(meets & begins & overlap)
    return pairs.select("l_row.*", *(F.col("r_row").getField(c).alias(f"{c}{suffix}" if c in left.columns else c) for c in right.columns if c not in by))


def sessions(df: DataFrame, time: str, gap: str, by: Sequence[str], late: str | None = None, **aggregates: Column) -> DataFrame:
    """Runs of rows of a key that lie no further apart than gap, with their first and last time; streams need a watermark (late)."""
    rows = df.withWatermark(time, late) if late else df
    made = rows.groupBy(*(col(c) for c in by), F.session_window(time, gap).alias("w")).agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count(F.lit(1)).alias("n"), *(v.alias(k) for k, v in aggregates.items()))
    return made.drop("w")


def windows(df: DataFrame, time: str, size: str, slide: str | None, by: Sequence[str] = (), late: str | None = None, **aggregates: Column) -> DataFrame:
    """Rows by tumbling or sliding window and key; on streams, rows later than the watermark are left out."""
    rows = df.withWatermark(time, late) if late else df
    made = rows.groupBy(F.window(time, size, slide), *(col(c) for c in by)).agg(F.count(F.lit(1)).alias("n"), *(v.alias(k) for k, v in aggregates.items()))
    return made.select(F.col("window.start").alias("begin"), F.col("window.end").alias("end"), *by, "n", *aggregates)
