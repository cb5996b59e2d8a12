"""Profiles of all columns in one scan, as sketches that are stored and merged.

Of each column: rows, missing ones, distinct values (HyperLogLog, about 1.6 %
with LG_K = 12), quantiles of numbers and of lengths of texts (KLL, rank error
about 1.3 % with K = 200), the least and greatest value, and the kinds of
values.  A task sends one row, whatever the data; a value as such is never
shuffled.  Profiles of parts of a dataset, or of versions, merge into the
profile of all without the data being read again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.values import col, finite, not_blank, text_of

from .order import user_columns
from .profile import _kind

LG_K, K = 12, 200
QUANTILES = (0.0, 0.25, 0.5, 0.75, 1.0)
FIELDS = "column string, kind string, rows long, missing long, distinct binary, numbers binary, lengths binary, least string, greatest string"


def _of(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    text = text_of(col(name), kind, None)
    there = F.coalesce(not_blank(text), F.lit(False))
    number = finite(col(name).cast("double")) if isinstance(kind, T.NumericType) else F.lit(None).cast("double")
    # of equal texts only one counts for the distinct values, so blank ones are null here
    shown = F.when(there, text)
    ordered = F.when(there, col(name)) if isinstance(kind, T.AtomicType) else shown
    return F.struct(
        F.lit(name).alias("column"),
        F.coalesce(F.min(F.when(there, _kind(col(name), kind))), F.lit("")).alias("kind"),
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~there).alias("missing"),
        F.hll_sketch_agg(shown, F.lit(LG_K)).alias("distinct"),
        F.kll_sketch_agg_double(number, F.lit(K)).alias("numbers"),
        F.kll_sketch_agg_bigint(F.length(shown).cast("long"), F.lit(K)).alias("lengths"),
        text_of(F.min(ordered), kind if ordered is not shown else T.StringType(), None).alias("least"),
        text_of(F.max(ordered), kind if ordered is not shown else T.StringType(), None).alias("greatest"),
    )


def sketch(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A row of sketches for each column, from one scan."""
    names = [c for c in (columns or user_columns(df)) if c in df.columns]
    if not names:
        return df.sparkSession.createDataFrame([], FIELDS)
    made = df.agg(F.array(*(_of(df, n) for n in names)).alias("all"))
    return made.select(F.inline("all"))


def merged(sketches: DataFrame) -> DataFrame:
    """Sketches of parts as those of the whole; least and greatest are compared as numbers where both are."""
    number = lambda c: F.col(c).try_cast("double")
    smallest = F.min_by("least", F.struct(number("least").isNull(), number("least"), F.col("least")))
    largest = F.max_by("greatest", F.struct(number("greatest").isNull(), number("greatest"), F.col("greatest")))
    return sketches.groupBy("column").agg(
        F.max("kind").alias("kind"), F.sum("rows").alias("rows"), F.sum("missing").alias("missing"), F.hll_union_agg("distinct").alias("distinct"),
        F.kll_merge_agg_double("numbers").alias("numbers"), F.kll_merge_agg_bigint("lengths").alias("lengths"), smallest.alias("least"), largest.alias("greatest")
    )


def report(sketches: DataFrame, quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """What sketches say: estimated distinct values, and quantiles of numbers and lengths (null where there are none)."""
    at = F.array(*(F.lit(float(q)) for q in quantiles))
    numbers = F.when(F.kll_sketch_get_n_double("numbers") > 0, F.kll_sketch_get_quantile_double("numbers", at))
    lengths = F.when(F.kll_sketch_get_n_bigint("lengths") > 0, F.kll_sketch_get_quantile_bigint("lengths", at))
    return sketches.select(
        "column", "kind", "rows", "missing", F.hll_sketch_estimate("distinct").alias("distinct"), numbers.alias("quantiles"), lengths.alias("lengths"), "least", "greatest"
    )
