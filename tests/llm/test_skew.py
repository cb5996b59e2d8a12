"""Joins with hot keys kept apart, against plain ones, and the clearing of intermediate tables."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkloom.llm.scratch import stored, temporary
from sparkloom.llm.skew import join_dealt, join_unique


def tables(spark):
    rows = [(i, "hot" if i % 3 == 0 else None if i % 7 == 0 else f"k{i % 40}") for i in range(600)]
    left = spark.createDataFrame(rows, "i bigint, k string").repartition(5)
    count = Counter(k for _, k in rows if k is not None)
    right = [(k, count[k], f"of {k}") for k in ("hot", *(f"k{j}" for j in range(0, 50, 2)))]
    return rows, left, spark.createDataFrame(right, "k string, n bigint, v string"), {k: v for k, _, v in right}


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("hot_keys", [1, 100_000])
def test_join_unique(spark, how, hot_keys):
    rows, left, right, value = tables(spark)
    got = join_unique(left, right, ["k"], F.col("i"), how=how, hot_keys=hot_keys)
    assert got.columns == ["i", "k", "v"]
    want = [(i, k, value.get(k)) for i, k in rows if how == "left" or k in value]
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_join_unique_deals_hot_rows(spark):
    _, left, right, _ = tables(spark)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = join_unique(left, right, ["k"], F.col("i")).where("k = 'hot'").groupBy(F.spark_partition_id().alias("p")).count()
        assert got.count() == 4  # all shuffle partitions of the test session have some
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("hot_keys", [1, 100_000])
def test_join_dealt(spark, hot_keys):
    rows, left, weights, value = tables(spark)
    many = [(k, j) for k in value for j in range(3)]
    right = spark.createDataFrame(many, "k string, j bigint")
    got = join_dealt(left, right, ["k"], F.col("i"), weights, hot_keys=hot_keys).select("i", "k", "j")
    assert Counter(map(tuple, got.collect())) == Counter((i, k, j) for i, k in rows if k in value for j in range(3))


def test_empty_joins(spark):
    _, left, right, _ = tables(spark)
    assert join_unique(left, right.limit(0), ["k"], F.col("i")).count() == 0
    assert join_unique(left, right.limit(0), ["k"], F.col("i"), how="left").count() == 600
    assert join_dealt(left.limit(0), right.select("k", "v"), ["k"], F.col("i"), right.limit(0)).count() == 0


def test_intermediate_tables_go(spark):
    import os

    with temporary(spark) as outer:
        with temporary(spark) as inner:
            gone = stored(spark.range(5), "gone")
            kept = inner.keep(gone.where("id > 2"), "kept")
        assert kept.count() == 2
        place = os.path.dirname(kept.inputFiles()[0]).removeprefix("file:").replace("///", "/")
        assert os.path.exists(place)
        final = outer.keep(kept, "final")
    assert not os.path.exists(place) and sorted(r.id for r in final.collect()) == [3, 4]
    with pytest.raises(ZeroDivisionError), temporary(spark):
        left = stored(spark.range(1), "left")
        raise ZeroDivisionError
    assert left.count() == 1


@pytest.mark.parametrize("first_to_end", [0, 1])
def test_operators_in_two_threads(spark, first_to_end):
    """Each keeps its own tables, whichever ends first."""
    import threading

    begun, ended, got, wrong = threading.Barrier(2), threading.Event(), {}, []

    def work(k):
        try:
            with temporary(spark) as made:
                begun.wait(60)
                own = stored(spark.range(10 + k), f"thread{k}")
                begun.wait(60)
                if k != first_to_end:
                    ended.wait(60)
                got[k] = made.keep(own.where("id >= 5"), f"kept{k}")
            ended.set()
        except Exception as e:
            wrong.append(e)
            ended.set()

    threads = [threading.Thread(target=work, args=(k,)) for k in (0, 1)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert not wrong and {k: d.count() for k, d in got.items()} == {0: 5, 1: 6}
