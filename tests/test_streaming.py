"""Streams in several micro-batches against their batch counterparts."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import temporal
from sparkloom.streaming import pipelines


def source(spark, folder, batches, schema):
    """A stream that reads each batch's file in a micro-batch of its own."""
    seen = set()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        new = set(Path(f"{folder}/in").glob("*.parquet")) - seen
        for f in new:  # files are read in the order of their times
            os.utime(f, (1_700_000_000 + 10 * i,) * 2)
        seen |= new
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def finished(query):
    assert query.awaitTermination(120)


def test_first_rows_across_batches(spark, tmp_path):
    batches = [[(0, "a"), (1, "b"), (2, "a")], [(3, "b"), (4, None), (5, "c")], [(6, None), (7, "d"), (8, "a")]]
    s = source(spark, tmp_path, batches, "i bigint, k string")
    finished(pipelines.run_stream(s, [{"op": "dedup", "columns": ["k"]}, {"op": "rename", "mapping": {"k": "key"}}], f"{tmp_path}/out", f"{tmp_path}/c", order="i"))
    out = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r.i, r.key, r.batch) for r in out.collect()) == [(0, "a", 0), (1, "b", 0), (4, None, 1), (5, "c", 1), (7, "d", 2)]


def test_keys_are_forgotten(spark, tmp_path):
    hour = 3600
    batches = [[(0, "a", 0)], [(1, "a", 60)], [(2, "z", 10 * hour)], [(3, "z", 10 * hour + 1)], [(4, "a", 10 * hour + 2)]]
    s = source(spark, tmp_path, batches, "i bigint, k string, t bigint").withColumn("ts", F.timestamp_seconds(F.col("t") + 10**9)).withWatermark("ts", "1 minute")
    stream = pipelines.with_positions(s, "i")
    finished(pipelines.append_batches(pipelines.keep_first(stream, ["k"], keep_ms=hour * 1000), f"{tmp_path}/out", f"{tmp_path}/c"))
    assert sorted(r.i for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [0, 2, 4]


@pytest.mark.parametrize("op", ["sample", "shuffle", "code"])
def test_what_needs_all_rows_is_refused(spark, op):
    s = spark.readStream.format("rate").load()
    with pytest.raises(ValueError, match="all rows"):
        pipelines.over_stream(s, [{"op": op}])
    with pytest.raises(ValueError, match="order"):
        pipelines.over_stream(s, [{"op": "dedup"}])


def test_sessions_without_late_rows(spark, tmp_path):
    minute = 60
    batches = [[(1, 0), (1, 5 * minute), (2, 0)], [(1, 9 * minute), (1, 60 * minute)], [(3, 300 * minute)], [(3, 301 * minute)], [(1, 2 * minute), (2, 300 * minute)], [(-1, 9000 * minute)]]
    s = source(spark, tmp_path, batches, "u bigint, t bigint").withColumn("ts", F.timestamp_seconds(F.col("t") + 10**9))
    made = temporal.sessions(s, "ts", "10 minutes", ["u"], late="1 hour")
    finished(pipelines.append_batches(made, f"{tmp_path}/out", f"{tmp_path}/c"))
    got = {(r.u, (r.last - r.first).total_seconds() / 60, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    # the row at minute 2 that comes behind those of minute 300 is late and counts nowhere
    assert got == {(1, 9.0, 3), (1, 0.0, 1), (2, 0.0, 1), (3, 1.0, 2)}
    assert len([1 for r in spark.read.parquet(f"{tmp_path}/out").collect() if r.u == 2]) == 2
