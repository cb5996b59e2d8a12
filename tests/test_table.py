import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sparkloom.functions.template import render, variables
from sparkloom.functions.values import java_regex, text_of
from sparkloom.operators import merge, table
from sparkloom.operators.order import POS, dense, visible, with_positions


def rows(spark, data, schema):
    names = [c.split()[0] for c in schema.split(", ")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], f"_i bigint, {schema}")
    return with_positions(df, "_i").select(*names, POS)


def got(df):
    return [tuple(r) for r in visible(df.orderBy(POS)).collect()]


def basic(spark):
    return rows(spark, [("你好", "1"), ("你好", "2"), ("world", "3")], "q string, n string")


def test_dedup_keeps_the_first(spark):
    assert got(table.dedup(basic(spark), ["q"])) == [("你好", "1"), ("world", "3")]
    assert got(table.dedup(rows(spark, [(1,), (1,), (2,)], "a bigint"))) == [(1,), (2,)]
    df = rows(spark, [("s1", "a"), ("s1", "b"), (None, "c"), (None, "d"), ("None", "e")], "s string, q string")
    assert got(table.dedup(df, ["s"])) == [("s1", "a"), (None, "c"), ("None", "e")]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 3)), max_size=12))
def test_dedup_is_idempotent(spark, data):
    df = rows(spark, data, "k string, v bigint")
    once = table.dedup(df, ["k"])
    assert got(table.dedup(once, ["k"])) == got(once) == [(k, v) for i, (k, v) in enumerate(data) if k not in [x for x, _ in data[:i]]]


@pytest.mark.parametrize(
    "mode, value, kept",
    [
        ("min_len", 3, ["world"]), ("max_len", 2, ["你好", "你好"]), ("contains", "or", ["world"]), ("not_contains", "or", ["你好", "你好"]),
        ("regex", r"^w\w+$", ["world"]), ("equals", "world", ["world"]), ("not_empty", None, ["你好", "你好", "world"])
    ],
)
def test_predicates(spark, mode, value, kept):
    assert [r[0] for r in got(table.filter_rows(basic(spark), "q", mode, value))] == kept


def test_predicates_see_nulls_as_none_and_unknown_columns_as_empty(spark):
    df = rows(spark, [(None,), ("　 ",), ("x",)], "q string")
    assert len(got(table.filter_rows(df, "q", "equals", "None"))) == 1
    assert len(got(table.filter_rows(df, "q", "not_empty"))) == 2
    assert got(table.filter_rows(df, "zzz", "min_len", 1)) == []
    with pytest.raises(ValueError):
        table.filter_rows(df, "q", "like", "x")


def test_rename(spark):
    df = rows(spark, [("1", "2", "3")], "a string, b string, c string")
    assert table.rename(df, {"a": "b", "b": "a", "zz": "y"}).columns[:2] == ["b", "a"]
    with pytest.raises(ValueError, match="x"):
        table.rename(df, {"a": "x", "b": "x"})


def test_concat_reads_like_text(spark):
    df = rows(spark, [("x", None, True, 1.0, 1e16)], "a string, b string, c boolean, d double, e double")
    assert got(table.concat(df, "out", ["a", "b", "c", "d", "e", "zz"], "|"))[0][-1] == "x|None|True|1.0|1e+16|"
    assert table.concat(df, "a", ["a", "c"]).columns[0] == "a"


@pytest.mark.parametrize("v", [0.1, 1e7, 123456789.25, 1e15, 1e16, 1.5e300, 1e-4, 0.00012, 1.2e-5, -2.5e-7, -1e22, 0.0, -123456789012.5, 9999999.0])
def test_float_text_is_pythons(spark, v):
    df = spark.createDataFrame([(v,)], "x double")
    assert df.select(text_of(F.col("x"), df.schema["x"].dataType)).first()[0] == repr(v)


def test_casts(spark):
    assert got(table.cast(rows(spark, [("3",), (" 4 ",), ("1_000",)], "x string"), "x", "int")) == [(3,), (4,), (1000,)]
    assert got(table.cast(rows(spark, [(3.7,), (-3.7,)], "x double"), "x", "int")) == [(3,), (-3,)]
    for bad in ("abc", "3.7", None):
        with pytest.raises(PySparkException):
            table.cast(rows(spark, [(bad,)], "x string"), "x", "int").collect()
    with pytest.raises(PySparkException):
        table.cast(rows(spark, [("inf",)], "x string"), "x", "float").collect()
    # the value isn't used later: the cast fails all the same
    bad = table.cast(rows(spark, [("1", 1), ("abc", 2)], "x string, y bigint"), "x", "int")
    for later in (bad.drop("x"), bad.select("y"), bad.where("y = 1"), bad.groupBy().count()):
        with pytest.raises(PySparkException):
            later.collect()
    with pytest.raises(PySparkException):
        bad.count()
    with pytest.raises(ValueError):
        table.cast(basic(spark), "q", "date")
    assert got(table.try_cast(rows(spark, [("3",), ("x",)], "x string"), "x", "int")) == [(3,), (None,)]


def test_sampling(spark, monkeypatch):
    df = rows(spark, [(i,) for i in range(10)], "i bigint")
    first = got(table.sample(df, 5, 42, exact=True))
    assert first == [(i,) for i in random.Random(42).sample(range(10), 5)] == got(table.sample(df, 5, 42, exact=True))
    assert got(table.sample(df, 99, 42, exact=True)) == got(df) == got(table.sample(df, 10, 42))
    assert sorted(got(table.shuffle(df, 42, exact=True))) == got(df)
    assert len(set(got(table.sample(df, 4, 1)))) == 4
    monkeypatch.setattr(table, "EXACT_ROWS", 6)
    assert got(table.sample(df, 5, 42, exact=True)) == first
    for draw in (lambda: table.sample(df, 7, 42, exact=True), lambda: table.shuffle(df, 42, exact=True)):
        with pytest.raises(ValueError, match="exact=False"):
            draw()
    assert sorted(got(table.shuffle(df, 3))) == got(df)


def test_stack_orders_and_unifies(spark):
    a, b = rows(spark, [("x", 1)], "k string, v bigint"), rows(spark, [("y", "two", True)], "k string, v string, w boolean")
    assert got(table.stack([a, b])) == [("x", "1", None), ("y", "two", True)]


def test_code(spark):
    df = rows(spark, [("x",), ("x",), ("y",)], "a string")

    def process(rs):
        return [{"a": r["a"], "b": r["a"].upper()} for r in {r["a"]: r for r in rs}.values()]

    assert got(table.code(df, process, "a string, b string")) == [("x", "X"), ("y", "Y")]
    with pytest.raises(PySparkException, match="list of dicts"):
        table.code(df, lambda rs: 3, "a string").collect()


def test_apply_operations(spark):
    ops = [
        {"op": "dedup", "columns": ["q"]}, {"op": "rename", "mapping": {"q": "question"}},
        {"op": "concat", "target": "t", "columns": ["question", "n"], "sep": "-"}, {"op": "drop", "columns": ["n"]}
    ]
    assert got(table.apply_operations(basic(spark), ops)) == [("你好", "你好-1"), ("world", "world-3")]
    with pytest.raises(ValueError):
        table.apply_operations(basic(spark), [{"op": "explode"}])


def test_dense_numbers_without_gaps(spark):
    df = with_positions(spark.range(1000).where("id % 7 <> 0").withColumn("k", -F.col("id")), "k")
    got_ = dense(df).orderBy("_n").collect()
    assert [r["_n"] for r in got_] == list(range(len(got_)))
    assert [r["id"] for r in got_] == sorted((r["id"] for r in got_), reverse=True)


def test_merge(spark):
    base = rows(spark, [("q1",), ("q2",)], "q string")
    a, b = base.withColumn("a", F.upper("q")), base.withColumn("b", F.length("q"))
    assert got(merge.merge([a, b])) == [("q1", "Q1", 2), ("q2", "Q2", 2)] == got(merge.merge([a, b], aligned=True))
    with pytest.raises(merge.MergeError, match="numbers of rows"):
        merge.merge([a, b.where("q = 'q1'")])
    with pytest.raises(merge.MergeError, match="share no column"):
        merge.merge([a.drop("q"), b.drop("q")])
    assert got(merge.merge([a.drop("q").limit(0), b.drop("q").limit(0)])) == []
    with pytest.raises(merge.MergeError, match="types in b"):
        merge.merge([b, b.withColumn("b", F.col("b") == 2)])
    with pytest.raises(PySparkException, match="differ in b"):
        merge.merge([b, b.withColumn("b", F.col("b") + 1)]).collect()
    for aligned in (False, True):
        apart = merge.merge([b, b.withColumn("b", F.when(F.col("q") == "q2", None).otherwise(F.col("b")))], aligned)
        for later in (apart.select("q"), apart.groupBy().count(), apart.where("q = 'q1'")):
            with pytest.raises(PySparkException, match="differ in b"):
                later.collect()
        with pytest.raises(PySparkException, match="differ in b"):
            apart.count()


def test_templates(spark):
    df = spark.createDataFrame([("A", "🙂", "x {{a.1}} y", None)], "`a.1` string, `🚀` string, weird string, n bigint")
    text = "[{{ a.1 }}|{{🚀}}|{{weird}}|{{n}}|{{missing}}]"
    assert df.select(render(text, df.schema)).first()[0] == "[A|🙂|x {{a.1}} y||]"
    assert variables(text) == sorted(["a.1", "🚀", "weird", "n", "missing"])
    assert df.select(render("plain", df.schema)).first()[0] == "plain"


def test_regex_dialect(spark):
    df = spark.createDataFrame([("aa",), ("ab",)], "x string")
    assert [r.x for r in df.where(F.col("x").rlike(java_regex(r"(?P<c>\w)(?P=c)"))).collect()] == ["aa"]


def test_wide_and_long_names(spark):
    long = "c" * 4000
    df = spark.range(1).select(F.array("id").alias(POS), F.lit("v").alias(long), *(F.lit(i).alias(f"c{i}") for i in range(300)), F.lit("s").alias("_qc_score"))
    assert visible(table.dedup(df)).columns[0] == long and "_qc_score" in visible(df).columns


def test_separators_of_ascii_are_blank(spark):
    df = spark.createDataFrame([("\x1c",), ("\x1f \x1d",), ("\u3000\x85",), ("a\x1c",), ("",), (None,)], "s string")
    assert [r.s for r in table.filter_rows(df, "s", "not_empty").collect()] == ["a\x1c", None]


def test_settled_rows_are_read_by_column(spark):
    from pyspark.sql import functions as F

    from sparkloom.functions.session import settled

    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def asked(x):
        seen.add(1)
        return x

    df = spark.range(20, numPartitions=4).select("id", asked.asNondeterministic()("id").alias("a b.c"), F.array(F.struct(F.lit(None).cast("string").alias("n"))).alias("nested"))
    got = settled(df)
    assert got.schema.simpleString() == df.schema.simpleString()
    assert sorted(r["a b.c"] for r in got.collect()) == sorted(r.id for r in got.select("id").collect()) == list(range(20))
    assert seen.value == 20
    plan = got.where("id > 3").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,3)" in plan and "ReadSchema: struct<id:bigint>" in plan


def test_settled_rows_that_parquet_cannot_hold(spark):
    from pyspark.sql import functions as F

    from sparkloom.functions.session import settled

    rows = spark.range(3)
    for df in (rows.withColumn("v", F.lit(None)), rows.withColumn("v", F.array(F.lit(None))), rows.toDF("id").selectExpr("id", "id AS ID"), rows.select()):
        assert settled(df).count() == 3
    assert settled(rows.where("id < 0").select("id", F.lit("x").alias("t"))).count() == 0
    assert [r.v for r in settled(rows.limit(1).select(F.parse_json(F.lit('{"a": 1}')).alias("v"))).selectExpr("variant_get(v, '$.a', 'int') AS v").collect()] == [1]
