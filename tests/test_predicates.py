"""Predicate trees against plain Python, and the filters that reach the scan; sketches against exact figures."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import sketches
from sparkloom.operators.predicates import PredicateError, where_tree

OPS = {
    "eq": lambda a, v: a == v, "ne": lambda a, v: a != v, "lt": lambda a, v: a is not None and a < v, "le": lambda a, v: a is not None and a <= v,
    "gt": lambda a, v: a is not None and a > v, "ge": lambda a, v: a is not None and a >= v, "between": lambda a, v: a is not None and v[0] <= a <= v[1],
    "in": lambda a, v: a in v, "not_in": lambda a, v: a not in v, "is_null": lambda a, v: a is None, "not_null": lambda a, v: a is not None,
}


def holds(row, tree):
    if "not" in tree:
        return not holds(row, tree["not"])
    if "all" in tree:
        return all(holds(row, t) for t in tree["all"])
    if "any" in tree:
        return any(holds(row, t) for t in tree["any"])
    return OPS[tree["op"]](row[tree["column"]], tree.get("value"))


def random_tree(rng, depth=0):
    kind = rng.randrange(5 if depth < 3 else 2)
    if kind == 2:
        return {"not": random_tree(rng, depth + 1)}
    if kind > 2:
        return {("all", "any")[kind % 2]: [random_tree(rng, depth + 1) for _ in range(rng.randrange(4))]}
    column, op = rng.choice("ns"), rng.choice(list(OPS))
    one = lambda: rng.randrange(6) if column == "n" else rng.choice("abc")
    value = sorted([one(), one()]) if op == "between" else [rng.choice([one(), one(), None]) for _ in range(rng.randrange(3))] if op.endswith("in") else one()
    return {"column": column, "op": op, "value": value}


def test_trees(spark):
    rng = random.Random(6)
    rows = [{"i": i, "n": rng.choice([None, *range(6)]), "s": rng.choice([None, *"abc"])} for i in range(60)]
    df = spark.createDataFrame(rows, "i int, n int, s string")
    trees = [random_tree(rng) for _ in range(40)]
    for tree in trees:
        assert sorted(r.i for r in where_tree(df, tree).select("i").collect()) == [r["i"] for r in rows if holds(r, tree)], tree


def test_filters_reach_the_scan(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet")
    tree = {"all": [{"column": "o_totalprice", "op": "gt", "value": 1000}, {"not": {"any": [{"column": "o_orderstatus", "op": "eq", "value": "F"}, {"not": {"column": "o_orderkey", "op": "in", "value": [1, 2, 3]}}]}}]}
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = where_tree(df, tree)._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("ReadSchema")[0]
    assert "GreaterThan(o_totalprice" in pushed and "In(o_orderkey" in pushed and "Or(Not(EqualTo(o_orderstatus,F)),IsNull(o_orderstatus))" in pushed


@pytest.mark.parametrize("tree", [{}, {"column": "zz", "op": "eq", "value": 1}, {"column": "n", "op": "odd"}, {"all": 1}, {"column": "n", "op": "between", "value": [1]}, {"column": "n", "op": "gt", "value": "x"}])
def test_bad_trees(spark, tree):
    with pytest.raises(PredicateError):
        where_tree(spark.range(1).withColumn("n", F.lit(1)), tree)


def test_text_modes_in_trees(spark):
    df = spark.createDataFrame([("abc",), ("",), (None,)], "s string")
    assert [r.s for r in where_tree(df, {"not": {"column": "s", "op": "contains", "value": "b"}}).collect()] == ["", None]


def test_sketches(spark):
    n = 20_000
    df = spark.range(n).select((F.col("id") % 5000).alias("k"), F.when(F.col("id") % 4 != 0, F.concat(F.lit("v"), F.col("id") % 300)).otherwise(" ").alias("s"), (F.col("id") / 7).alias("x"), F.lit(None).cast("string").alias("none"))
    parts = [sketches.sketch(df.where(f"k % 3 = {i}")) for i in range(3)]
    whole = {r["column"]: r for r in sketches.report(sketches.sketch(df)).collect()}
    both = {r["column"]: r for r in sketches.report(sketches.merged(parts[0].union(parts[1]).union(parts[2]))).collect()}
    for got in (whole, both):
        assert {c: (r.rows, r.missing) for c, r in got.items()} == {"k": (n, 0), "s": (n, n // 4), "x": (n, 0), "none": (n, n)}
        for c, distinct in (("k", 5000), ("s", 225), ("x", n), ("none", 0)):
            assert abs(got[c].distinct - distinct) <= 0.05 * distinct
        for q, x in zip(sketches.QUANTILES, got["x"].quantiles, strict=True):
            assert abs(x * 7 / n - q) < 0.03
        assert got["s"].quantiles is None and got["s"].lengths[0] == 2 and got["s"].lengths[-1] == 4 and got["none"].lengths is None
        assert (got["k"].least, got["k"].greatest, got["none"].least) == ("0", "4999", None)
    assert whole["s"].least == "v1" and whole["x"].kind == "float" and whole["k"].kind == "int"
