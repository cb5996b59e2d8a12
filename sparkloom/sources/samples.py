"""Two small datasets to try graphs on, made by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.order import with_positions

ROWS = 20


def samples(spark: SparkSession) -> dict[str, DataFrame]:
    """``sums``: questions with their answers; ``orders``: lines of an order book.  Twenty rows each, in order."""
    n = spark.range(ROWS)
    sums = n.select("id", F.format_string("What is %d plus %d?", "id", F.col("id") * 7 % 10).alias("question"), (F.col("id") + F.col("id") * 7 % 10).cast("string").alias("answer"))
    orders = n.select(
        "id", F.format_string("A-%03d", "id").alias("order"),
        F.element_at(F.array(*map(F.lit, ("bolt", "nut", "washer"))), (F.col("id") % 3 + 1).cast("int")).alias("item"),
        (F.col("id") * 3 % 11 + 1).alias("pieces")
    )
    return {name: with_positions(df, "id").drop("id") for name, df in (("sums", sums), ("orders", orders))}
