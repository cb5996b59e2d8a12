"""As-of and interval joins against plain loops."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import temporal


def sides(seed, n=150):
    rng = random.Random(seed)
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", None])
    left = [(i, key(), rng.choice([None, *range(60)])) for i in range(n)]
    right = [(k, rng.choice([None, *range(60)]), i) for i, k in enumerate(key() for _ in range(n))]
    return left, right


@pytest.mark.parametrize("exact, tolerance", [(True, None), (False, None), (True, 3)])
def test_asof(spark, exact, tolerance):
    left, right = sides(1)
    got = temporal.asof_join(
        spark.createDataFrame(left, "i long, k string, t long").repartition(3), spark.createDataFrame(right, "k string, t long, v long").repartition(3), "t", by=["k"], ties=["v"], exact=exact,
        tolerance=None if tolerance is None else F.lit(tolerance)
    )
    want = []
    for i, k, t in left:
        fits = [(rt, v) for rk, rt, v in right if None not in (k, t, rt) and rk == k and (rt < t or exact and rt == t) and (tolerance is None or rt >= t - tolerance)]
        want.append((i, k, t, *max(fits, default=(None, None))))
    assert got.columns == ["i", "k", "t", "t_right", "v"] and Counter(map(tuple, got.collect())) == Counter(want)


def test_asof_without_keys_and_of_nothing(spark):
    a = spark.createDataFrame([(i, float(i)) for i in range(40)], "i long, t double")
    b = spark.createDataFrame([(float(x), x) for x in (5, 17, 33)], "t double, v long")
    got = {r.i: r.v for r in temporal.asof_join(a, b, "t").collect()}
    assert got == {i: max((x for x in (5, 17, 33) if x <= i), default=None) for i in range(40)}
    assert {r.v for r in temporal.asof_join(a, b.limit(0), "t").collect()} == {None} and temporal.asof_join(a.limit(0), b, "t").count() == 0


def test_intervals(spark):
    rng = random.Random(2)

    def spans(n):
        out = []
        for i in range(n):
            a = rng.randrange(-500, 500)
            out.append((i, rng.choice(["x", "y", None]), rng.choice([a, a, a, None]), a + rng.choice([0, 1, 3, 8, 40, 900, -1])))
        return out

    one, two = spans(120), spans(120)
    df = [spark.createDataFrame(s, "i long, k string, a long, b long").repartition(3) for s in (one, two)]
    got = temporal.interval_join(*df, ("a", "b"), ("a", "b"), by=["k"])
    want = [(i, j) for i, k, a, b in one for j, m, c, d in two if None not in (k, a, c) and k == m and a <= b and c <= d and a <= d and c <= b]
    assert Counter((r.i, r.i_right) for r in got.collect()) == Counter(want) and len(want) > 100
    assert temporal.interval_join(df[0].limit(0), df[1], ("a", "b"), ("a", "b")).count() == 0


def test_long_intervals_don_t_multiply(spark):
    long = spark.createDataFrame([(0, 0, 10**9)], "i long, a long, b long")
    points = spark.range(500).select(F.col("id").alias("i"), (F.col("id") * 1_000_003).alias("a"), (F.col("id") * 1_000_003).alias("b"))
    got = temporal.interval_join(points, long, ("a", "b"), ("a", "b"))
    assert got.count() == 500
