import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sparkloom.functions.jsonpath import explode_records, extract, path_text
from sparkloom.functions.values import col
from sparkloom.operators import generate, judge, runs
from sparkloom.operators.enrich import UNIT, EchoModel, Reply, Response, failed, fetch_units, path_get, synth_units, unit_rows, usage
from sparkloom.operators.order import PARENT, POS, TRACE, visible, with_positions
from sparkloom.plans.graph import Graph
from sparkloom.plans.runner import Resources, Runner, UnitStore


def questions(spark, n=3):
    return with_positions(spark.range(n).select("id", F.concat(F.lit("item "), F.col("id").cast("string")).alias("q")), "id").drop("id")


class Picky:
    def complete(self, system, user, params):
        if "1" in user:
            raise ValueError("no")
        return Reply(user.upper(), 3, 4)


class Json:
    def complete(self, system, user, params):
        return Reply('{"a": 1, "b": NaN}' if "0" in user else "[1]")


def test_column_mode_and_usage(spark):
    units = synth_units(questions(spark), EchoModel(), "{{q}}", settle=False)
    assert [r.output for r in unit_rows(units, "llm").orderBy(POS).collect()] == [f"echo<item {i}>" for i in range(3)]
    assert tuple(usage(units).first()) == (3, 0, 3, 6)


def test_failures_stay_with_their_row(spark):
    units = synth_units(questions(spark), Picky(), "{{q}}", retries=1, wait=0)
    assert [r.output for r in unit_rows(units, "llm").orderBy(POS).collect()] == ["ITEM 0", "ITEM 2"]
    assert failed(units).select(f"{UNIT}.error").first()[0] == "ValueError: no"


def test_json_mode(spark):
    units = synth_units(questions(spark, 2), Json(), "{{q}}", json_mode=True, retries=0, settle=False)
    rows = unit_rows(units, "llm", fields={"a": "bigint", "b": "double"}).collect()
    assert [(r.a, r.b) for r in rows] == [(1, None)]
    assert failed(units).count() == 1


def test_fanout_has_child_traces(spark):
    df = runs.root_trace(questions(spark, 1), "9", "in")
    rows = unit_rows(synth_units(df, EchoModel(), "{{q}}", fanout=2, settle=False), "llm").orderBy(POS).collect()
    assert [r[TRACE] for r in rows] == ["run9:in:0|llm:0.0:0", "run9:in:0|llm:0.0:1"] and {r[PARENT] for r in rows} == {"run9:in:0"}
    one = unit_rows(synth_units(df, EchoModel(), "{{q}}", settle=False), "llm").first()
    assert one[TRACE] == "run9:in:0" and one[PARENT] is None
    with pytest.raises(ValueError):
        synth_units(df, EchoModel(), "", fanout=True)


@pytest.mark.parametrize(
    "path, want",
    [("a.b", "1"), ("l.0", "x"), ("l.-1", "z"), ("l.7", None), ("l.-9", None), ("d.0", "zero"), ("a.x.y", None), ("o", '{"k":[1,2]}'), ("n", None), ("t", "true"), ("l.--1", None)]
)
def test_json_paths(spark, path, want):
    doc = json.dumps({"a": {"b": 1}, "l": ["x", "y", "z"], "d": {"0": "zero"}, "o": {"k": [1, 2]}, "n": None, "t": True})
    df = spark.createDataFrame([(doc,)], "j string")
    assert df.select(path_text(col("j"), path)).first()[0] == want


def test_extract_fills_in_empty_texts(spark):
    df = spark.createDataFrame([('{"x": null, "y": 2}',), ("not json",)], "j string")
    assert [tuple(r)[1:] for r in extract(df, "j", {"x": "x", "y": "y"}).collect()] == [("", "2"), ("", "")]


def test_explode(spark):
    df = spark.createDataFrame([("s1", '{"items":[{"name":"A","age":1},{"name":"B"}]}'), ("s2", '{"items":[]}')], "src string, j string")
    assert [(r.src, r.name, r.age) for r in explode_records(df, "j", "items", {"name": "name", "age": "age"}).collect()] == [("s1", "A", "1"), ("s1", "B", "")]
    bad = spark.createDataFrame([('{"items":{"a":1}}',)], "j string")
    with pytest.raises(PySparkException, match="isn't an array"):
        explode_records(bad, "j", "items").collect()


class Web:
    def __init__(self):
        self.seen = 0

    def fetch(self, request):
        self.seen += 1
        if "bad" in request["url"]:
            return Response(500, "secret")
        if "slow" in request["url"]:
            return Response(200, "not json" if self.seen < 3 else '{"s": "ok"}')
        return Response(200, json.dumps(request))


def test_fetch(spark):
    df = with_positions(spark.createDataFrame([(0, "a"), (1, "bad")], "i bigint, q string"), "i")
    units = fetch_units(df, Web(), "http://x/{{q}}", "POST", {"p": "{{q}}"}, {"H": "1"}, '{"q":"{{q}}"}', retries=0, settle=False)
    sent = json.loads(unit_rows(units, "web", "body").first().body)
    assert sent["url"] == "http://x/a" and sent["params"] == {"p": "a"} and sent["headers"] == {"H": "1", "Content-Type": "application/json"}
    error = failed(units).select(f"{UNIT}.error").first()[0]
    assert "500" in error and "secret" not in error
    slow = with_positions(spark.createDataFrame([(0, "slow")], "i bigint, q string"), "i")
    assert unit_rows(fetch_units(slow, Web(), "http://x/{{q}}", poll_path="s", poll_until="ok", poll_interval=0, settle=False), "w", "b").first().b == '{"s": "ok"}'
    late = fetch_units(slow, Web(), "http://x/{{q}}", poll_path="s", poll_until="never", poll_interval=0, poll_most=2, settle=False)
    assert failed(late).count() == 1
    assert path_get({"a": [1, {"b": 2}]}, "a.-1.b") == 2 and path_get([1], "x") is None


def rules(**which):
    return lambda d: judge.by_rules({n: (e, f"{n} fails") for n, e in which.items()})


def test_k_of_n(spark):
    v = judge.review(questions(spark), rules(a=F.lit(True), b=F.lit(False)), 2, 2, settle=False)
    assert v.passed.count() == 0 and v.failures.count() == 3
    assert tuple(v.metric.first()) == (3, 0)
    assert judge.failures_wide(v.failures, 2).first()["_qc_model_2_reason"] == "b fails"
    assert judge.review(questions(spark), rules(a=F.lit(True), b=F.lit(False)), 2, 1, settle=False).passed.select("qc_status", "qc_feedback").first() == ("pass", "")
    assert [judge.clamp_k(k, 3) for k in (0, "2", 9)] == [1, 2, 3]


def test_blank_rows_fail_without_a_call(spark):
    df = with_positions(spark.createDataFrame([(0, " "), (1, "x")], "i bigint, q string"), "i").drop("i")

    class Yes:
        def complete(self, system, user, params):
            assert user.strip()
            return Reply('{"status": " PASS ", "reason": ""}')

    out = judge.judged(df, lambda d: judge.by_models(d, {"m": Yes()}, "{{q}}"), 1)
    assert sorted((r.q, r._ok) for r in out.collect()) == [(" ", False), ("x", True)]


def test_judges_that_err_fail(spark):
    class No:
        def complete(self, system, user, params):
            raise RuntimeError("down")

    out = judge.judged(questions(spark, 1), lambda d: judge.by_models(d, {"m": No()}, "{{q}}", retries=0, wait=0), 1)
    assert out.first()._ok is False and "down" in out.first()._votes[0].reason


def test_column_collisions(spark):
    df = questions(spark).withColumn("qc_status", F.lit("mine"))
    with pytest.raises(ValueError, match="qc_status"):
        judge.review(df, rules(a=F.lit(True)), 1)
    assert judge.review(df, rules(a=F.lit(True)), 1, own=["qc_status"], settle=False).passed.count() == 3


def test_rescan_rounds(spark):
    df = with_positions(spark.range(6).select(F.col("id").alias("n")), "n")
    again = lambda d: d.withColumn("n", F.col("n") + 1).withColumn(POS, F.concat(POS, F.array(F.lit(0).cast("bigint"))))
    v = judge.review(df, rules(five=F.col("n") % 5 == 0), 1, 1, again, 3)
    assert [(r[POS][0], r.n) for r in v.passed.orderBy(POS).collect()] == [(0, 0), (0, 5), (1, 5), (2, 5), (3, 5)]
    assert [r.n for r in v.failures.collect()] == [4]
    assert tuple(v.metric.first()) == (6, 2)


def test_rows_lost_in_regeneration_stay_failed(spark):
    v = judge.review(questions(spark, 2), rules(a=F.lit(False)), 1, 1, lambda d: d.where("q = 'item 0'").withColumn(POS, F.concat(POS, F.array(F.lit(0).cast("bigint")))), 1)
    assert sorted(r.q for r in v.failures.collect()) == ["item 0", "item 1"]


@pytest.mark.parametrize("fanout, spent, missing, want", [(1, [], 10, 10), (2, [], 10, 5), (1, [(9, 4)], 4, 8), (1, [(9, 0)], 4, 40), (10, [], 1, 1), (3, [(5, 15)], 6, 2)])
def test_seeds_needed(fanout, spent, missing, want):
    y = generate.Yield(fanout)
    for seeds, rows in spent:
        y.spend(seeds, rows)
    assert y.needed(missing) == want


def test_generation(spark):
    def synth(s, _):
        return unit_rows(synth_units(s.withColumn("i", F.element_at(POS, -1)), EchoModel(), "{{i}}"), "llm")

    out = visible(generate.generate(spark, 5, synth, lambda d, _: d.where("i % 2 = 0"))).collect()
    assert [r.i for r in out] == [0, 2, 4, 6, 8]
    assert generate.generate(spark, 7, synth, batch_seeds=2).count() == 7
    for bounds in ({"idle_batches": 2}, {"max_batches": 1}):
        with pytest.raises(generate.Shortfall, match="0 of 5"):
            generate.generate(spark, 5, synth, lambda d, _: d.where("false"), **bounds)


def pipeline(**llm):
    return {
        "nodes": [
            {"id": "in", "type": "input", "config": {"dataset_ids": ["d"]}},
            {"id": "llm", "type": "llm_synth", "config": {"model_config_id": "m", "user_prompt": "{{q}}", "retries": 0, "retry_wait": 0} | llm},
            {"id": "out", "type": "output", "config": {}}
        ],
        "edges": [{"source": "in", "target": "llm"}, {"source": "llm", "target": "out"}],
    }


def test_runner_diamond_and_rescan(spark):
    g = {
        "nodes": [
            {"id": "in", "type": "input", "config": {"dataset_ids": ["d"]}},
            {"id": "a", "type": "llm_synth", "config": {"model_config_id": "m", "user_prompt": "a{{q}}", "output_column": "a"}},
            {"id": "b", "type": "auto_process", "config": {"operations": [{"op": "concat", "target": "b", "columns": ["q", "q"]}]}},
            {"id": "qc", "type": "qc", "config": {"judge_model_ids": ["ok"], "max_rounds": 1}},
            {"id": "out", "type": "output", "config": {"count": 2}},
        ],
        "edges": [
            {"source": "in", "target": "a"}, {"source": "in", "target": "b"}, {"source": "a", "target": "qc"}, {"source": "b", "target": "qc"},
            {"source": "qc", "target": "out"}, {"source": "qc", "target": "a", "kind": "rescan"}
        ],
    }
    res = Resources({"d": questions(spark)}, {"m": EchoModel()}, rules={"ok": lambda d: F.col("a").contains("rejected") | (F.col("q") == "item 0")})
    got = Runner(spark, res).run(g)
    assert [(r.q, r.b) for r in got.output(Graph.parse(g)).collect()] == [("item 0", "item 0item 0"), ("item 1", "item 1item 1")]
    assert got.verdicts["qc"].passed.count() == 3


def test_resume_and_rerun(spark, tmp_path):
    store = UnitStore(spark, f"file://{tmp_path}/units")

    class Flaky:
        ok = False

        def complete(self, system, user, params):
            if "1" in user and not self.ok:
                raise ValueError("down")
            return Reply("fine")

    g = Graph.parse(pipeline())
    first = Runner(spark, Resources({"d": questions(spark)}, {"m": Flaky()}), store=store).run(g)
    assert first.frames["out"].count() == 2
    fixed = Flaky()
    fixed.ok = True
    res = Resources({"d": questions(spark)}, {"m": fixed})
    assert Runner(spark, res, store=store).run(g).frames["out"].count() == 2  # done and failed units aren't worked on again
    store.reopen(g)
    assert Runner(spark, res, store=store).run(g).frames["out"].count() == 3


class Counting:
    """Counts its calls in a file a call, as they are made in Spark's workers."""

    def __init__(self, folder, bad=""):
        self.folder, self.bad = str(folder), bad

    def complete(self, system, user, params):
        import os
        import uuid

        os.makedirs(self.folder, exist_ok=True)
        open(f"{self.folder}/{uuid.uuid4().hex}", "w").close()
        if self.bad and self.bad in user:
            os._exit(1)
        return Reply('{"status": "pass", "reason": ""}', 1, 1)

    @property
    def calls(self):
        import os

        return len(os.listdir(self.folder)) if os.path.exists(self.folder) else 0


def test_judges_are_asked_once(spark, tmp_path):
    g = pipeline()
    g["nodes"].insert(2, {"id": "qc", "type": "qc", "config": {"judge_model_ids": ["j"], "user_prompt": "{{output}}"}})
    g["edges"] = [{"source": a, "target": b} for a, b in (("in", "llm"), ("llm", "qc"), ("qc", "out"))]
    g = Graph.parse(g)
    store, m, j = UnitStore(spark, f"file://{tmp_path}/units"), Counting(tmp_path / "m"), Counting(tmp_path / "j")
    for _ in range(2):
        got = Runner(spark, Resources({"d": questions(spark)}, {"m": m, "j": j}), store=store).run(g)
        assert got.frames["out"].count() == 3 and got.verdicts["qc"].metric.first().total == 3
        assert (m.calls, j.calls) == (3, 3)
    store.forget_verdicts("qc")
    Runner(spark, Resources({"d": questions(spark)}, {"m": m, "j": j}), store=store).run(g)
    assert (m.calls, j.calls) == (3, 6)


def test_batches_that_are_done_stay(spark, tmp_path):
    """A job that fails midway keeps the units of the batches before it."""
    rows = questions(spark, 12)
    store = UnitStore(spark, f"file://{tmp_path}/units", batch_rows=4)
    model = Counting(tmp_path / "calls")

    def work(d):
        if d.where("q = 'item 5'").count():
            raise RuntimeError("the machine is gone")
        return synth_units(d, model, "{{q}}")

    with pytest.raises(RuntimeError):
        store.fill("n", rows, work)
    kept = store.read("n").count() if store.exists("n") else 0
    assert model.calls == kept < 12
    assert store.fill("n", rows, lambda d: synth_units(d, model, "{{q}}")).count() == 12 == model.calls


def test_generation_resumes(spark, tmp_path):
    g = {
        "nodes": [
            {"id": "llm", "type": "llm_synth", "config": {"model_config_id": "m", "user_prompt": "go"}},
            {"id": "qc", "type": "qc", "config": {"judge_model_ids": ["j"], "user_prompt": "{{output}}"}},
            {"id": "out", "type": "output", "config": {"count": 4}}
        ],
        "edges": [{"source": "llm", "target": "qc"}, {"source": "qc", "target": "out"}]
    }
    store, m, j = UnitStore(spark, f"file://{tmp_path}/units"), Counting(tmp_path / "m"), Counting(tmp_path / "j")
    for _ in range(2):
        got = Runner(spark, Resources(models={"m": m, "j": j}), store=store).run(g)
        assert got.frames["out"].count() == 4 and (m.calls, j.calls) == (4, 4)


def test_output_is_saved_as_a_dataset(spark, tmp_path):
    from sparkloom.sources.datasets import Catalog

    g = pipeline()
    g["nodes"][2]["config"] = {"save_as_dataset": True, "dataset_name": "kept", "count": 2}
    catalog = Catalog(spark, f"file://{tmp_path}/catalog")
    for _ in range(2):
        Runner(spark, Resources({"d": questions(spark)}, {"m": EchoModel()}, catalog=catalog)).run(g)
        assert len(catalog.versions("kept")) == 1
        assert [(r._file_row, r.output) for r in catalog.read("kept").orderBy("_file_row").collect()] == [(2, "echo<item 0>"), (3, "echo<item 1>")]
    with pytest.raises(ValueError, match="catalog"):
        Runner(spark, Resources({"d": questions(spark)}, {"m": EchoModel()})).run(g)


def test_runner_refuses_what_is_missing(spark):
    with pytest.raises(ValueError, match="dataset d"):
        Runner(spark, Resources({}, {"m": EchoModel()})).run(pipeline())


def test_http_without_parents(spark):
    g = {
        "nodes": [{"id": "web", "type": "http_fetch", "config": {"endpoint": "http://x/list", "records_path": "items", "extract": {"n": "n"}}}, {"id": "out", "type": "output", "config": {}}],
        "edges": [{"source": "web", "target": "out"}]
    }

    class Items:
        def fetch(self, request):
            return Response(200, '{"items": [{"n": 1}, {"n": 2}]}')

    got = Runner(spark, Resources(fetcher=Items())).run(g)
    assert [r.n for r in got.frames["out"].orderBy(POS).collect()] == ["1", "2"]


def test_a_bad_reply_fails_its_row_alone(spark):
    g = {
        "nodes": [
            {"id": "in", "type": "input", "config": {"dataset_ids": ["d"]}},
            {"id": "web", "type": "http_fetch", "config": {"endpoint": "{{q}}", "records_path": "items", "extract": {"n": "n"}, "retries": 0}},
            {"id": "out", "type": "output", "config": {}}
        ],
        "edges": [{"source": "in", "target": "web"}, {"source": "web", "target": "out"}]
    }

    class Odd:
        def fetch(self, request):
            return Response(200, {"item 0": '{"items": [{"n": 1}, {"n": 2}]}', "item 1": '{"items": {"n": 3}}', "item 2": "<html>"}[request["url"]])

    got = Runner(spark, Resources({"d": questions(spark)}, fetcher=Odd())).run(g)
    assert [(r.q, r.n) for r in got.frames["out"].orderBy(POS).collect()] == [("item 0", "1"), ("item 0", "2")]
    errors = sorted(r[0] for r in failed(got.units["web"]).select(f"{UNIT}.error").collect())
    assert len(errors) == 2 and "isn't JSON" in errors[1] and "isn't an array" in errors[0]


def test_goals():
    assert runs.threshold("90%") == 0.9 and runs.threshold(" 0.85 ") == 0.85
    assert runs.threshold("raise the first-round pass rate to 90% or more") == 0.9 and runs.threshold("to 12.5 % at least") == 0.125
    assert runs.threshold("reach 0.85") == 0.85 and runs.threshold("clean the data") is None and runs.threshold("in version 3.5") is None
    assert runs.goal_reached([0.5, 0.9], 0.9, 2) == "reached"
    assert runs.goal_reached([0.5, 0.4, 0.5], 0.9, 2) == "stalled"
    assert runs.goal_reached([0.5, 0.6], 0.9, 2) is None
    assert runs.goal_reached([None, None], 0.9, 2) == "stalled" and runs.goal_reached([0.5, None, 0.6], 0.9, 2) is None
    assert runs.goal_reached([0.99, 0.1, 0.1], None, 2) is None


def test_rates_of_runs_and_nodes(spark):
    metric = spark.createDataFrame([("a", 10, 6), ("b", 10, 8), ("c", 0, 0)], "node string, total long, first_round_pass long")
    assert judge.first_round_rate(metric).first()[0] == pytest.approx(0.7)
    assert judge.first_round_rate(metric.where("node = 'c'")).first()[0] is None and judge.first_round_rate(metric.limit(0)).first()[0] is None
    assert {r.node: r.first_round_rate for r in judge.node_rates(metric, "node").collect()} == {"a": 0.6, "b": 0.8, "c": 0.0}


class CountingModel:
    """Notes how many calls are in flight, over all tasks, when one begins."""

    def __init__(self, folder):
        self.folder = str(folder)

    def complete(self, system, user, params):
        import os
        import time
        import uuid

        own = f"{self.folder}/now-{uuid.uuid4().hex}"
        with open(own, "w"):
            pass
        now = sum(x.startswith("now-") for x in os.listdir(self.folder))
        with open(f"{self.folder}/saw-{now}", "w"):
            pass
        time.sleep(0.03)
        os.remove(own)
        return Reply('{"status": "pass"}', 1, 1)

    def most(self):
        import os

        return max(int(x[4:]) for x in os.listdir(self.folder) if x.startswith("saw-"))


@pytest.mark.parametrize("concurrency, fanout", [(1, 3), (3, 1), (6, 4)])
def test_calls_in_flight_are_bounded_for_the_node(spark, tmp_path, concurrency, fanout):
    m = CountingModel(tmp_path)
    df = questions(spark, 40).repartition(8)
    units = synth_units(df, m, "{{q}}", fanout=fanout, concurrency=concurrency)
    assert units.count() == 40 and m.most() <= concurrency
    assert {len(r[0]) for r in units.select(f"{UNIT}.outs").collect()} == {fanout}
    if concurrency > 1:
        assert m.most() > 1


def test_one_row_s_calls_run_side_by_side(spark, tmp_path):
    m = CountingModel(tmp_path)
    assert synth_units(questions(spark, 1), m, "{{q}}", fanout=16, concurrency=16).count() == 1
    assert m.most() > 1


def test_judges_are_bounded_as_well(spark, tmp_path):
    m = CountingModel(tmp_path)
    out = judge.judged(questions(spark, 30).repartition(8), lambda d: judge.by_models(d, {"m": m}, "{{q}}", concurrency=1), 1, concurrency=2)
    assert out.where("_ok").count() == 30 and m.most() <= 2


def test_calls_keep_their_pace(spark):
    import time

    began = time.monotonic()
    synth_units(questions(spark, 6), EchoModel(), "{{q}}", concurrency=1, per_minute=300).count()
    assert time.monotonic() - began > 0.9


def test_progress_behind_each_batch(spark, tmp_path):
    said = []
    store = UnitStore(spark, f"file://{tmp_path}/units", batch_rows=10)
    run = Runner(spark, Resources({"d": questions(spark, 35)}, {"m": EchoModel()}), store=store, progress=lambda *x: said.append(x))
    assert run.run(pipeline()).frames["out"].count() == 35
    assert len(said) == 4 and said[-1] == ("llm", 35, 0, 35) and all(a[1] < b[1] for a, b in zip(said, said[1:]))
    assert not store._exists(f"{store.path}/_waiting/llm")


def test_queue_of_runs(spark):
    import threading
    import time

    from sparkloom.plans.queue import RunQueue

    q, order, together = RunQueue(spark), [], threading.Barrier(2)

    def job(name, wait=0.0):
        def run():
            time.sleep(wait)
            order.append((name, spark.range(10).count()))

        return run

    assert q.submit("a", job("a1", 0.3)) == {"queued": False, "position": 0}
    assert q.submit("a", job("a2")) == {"queued": True, "position": 1}
    assert q.submit("b", job("b1")) == {"queued": False, "position": 0}
    assert q.wait("a", 60) and q.wait("b", 60) and q.wait("unknown", 0)
    assert [x for x in order if x[0][0] == "a"] == [("a1", 10), ("a2", 10)] and order[0] == ("b1", 10)

    # two runs are at work at once, else neither gets past the barrier
    for name in "cd":
        q.submit(name, lambda: together.wait(30))
    assert q.wait("c", 60) and q.wait("d", 60) and not q.errors

    stopped = threading.Event()
    q.submit("e", lambda: stopped.wait(30), stopped.set)
    q.submit("e", job("e2"))
    q.cancel("e")
    assert q.wait("e", 60) and ("e2", 10) not in order
    q.submit("f", lambda: 1 / 0)
    q.submit("f", job("f2"))
    assert q.wait("f", 60) and isinstance(q.errors["f"][0], ZeroDivisionError) and ("f2", 10) in order


def test_slots_are_shared_by_runs():
    import threading
    import time

    from sparkloom.plans.queue import CallSlots

    slots, seen, now, lock = CallSlots(5), [], [0], threading.Lock()

    def work():
        with slots.taken(4) as n:
            with slots.taken(3) as inner:
                assert inner <= n
            with lock:
                now[0] += n
                seen.append(now[0])
            time.sleep(0.02)
            with lock:
                now[0] -= n

    threads = [threading.Thread(target=work) for _ in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(30)
    assert len(seen) == 8 and max(seen) <= 5 and slots.used == 0
