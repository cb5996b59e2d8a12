"""Compiles a graph to DataFrames.

Nodes that Spark can express stay lazy, so Catalyst optimises across them; only
nodes that call out are settled.  A store, if given, keeps each calling node's
units as Parquet, batch by batch, and each judge's verdict: a run that is resumed
works on rows without a unit and asks no judge twice, and one that is asked to
rerun failures drops those units first.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.jsonpath import explode_records, extract
from sparkloom.functions.session import settled
from sparkloom.operators import judge
from sparkloom.operators.enrich import UNIT, Fetcher, Model, fetch_units, synth_units, unit_rows, usage
from sparkloom.operators.generate import generate
from sparkloom.operators.merge import merge
from sparkloom.operators.order import POS, visible, with_positions
from sparkloom.operators.runs import root_trace
from sparkloom.operators.table import apply_operations, drop, limit, stack
from sparkloom.sources.datasets import Catalog

from .graph import Graph, GraphError
from .queue import CallSlots
from .rewrites import bind_prompts, generation_chain, input_caps


@dataclass
class Resources:
    """What a graph's names stand for."""

    datasets: dict[str, DataFrame] = field(default_factory=dict)
    models: dict[str, Model] = field(default_factory=dict)
    fetcher: Fetcher | None = None
    processes: dict[str, Callable] = field(default_factory=dict)
    rules: dict[str, Callable[[DataFrame], F.Column]] = field(default_factory=dict)
    prompts: dict[str, str] = field(default_factory=dict)
    catalog: Catalog | None = None


#: Rows whose units are worked on and stored together, and such batches of a node at most.
STORE_ROWS, STORE_BATCHES = 2_000, 256
#: Table operations that keep each row and its position.
ROW_KEEPING = frozenset({"rename", "drop", "concat", "cast"})


@dataclass
class UnitStore:
    """Units of calling nodes and verdicts of judges: a Parquet folder a node, in versions of which the last counts.

    A version is visible once its first write is whole; batches are appended to
    it, each as a whole.
    """

    spark: SparkSession
    path: str
    batch_rows: int = STORE_ROWS

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self, node: str) -> list[int]:
        p, fs = self._fs(f"{self.path}/{node}")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(self._fs(f"{self.path}/{node}/{n}/_SUCCESS")[0]))

    def _folder(self, node: str) -> str:
        return f"{self.path}/{node}/v{max(self._versions(node), default=1)}"

    def exists(self, node: str) -> bool:
        return bool(self._versions(node))

    def read(self, node: str) -> DataFrame:
        return self.spark.read.parquet(self._folder(node))

    def fill(self, node: str, rows: DataFrame, work: Callable[[DataFrame], DataFrame], seen: Callable[[int, int, int], None] | None = None) -> DataFrame:
        """Works on the rows that have no unit yet, batch by batch; each batch that is done stays, whatever fails later.

        Where there are several batches, the rows are written by batch once, so
        that each batch reads its own.  ``seen`` gets the units done and failed so
        far, of how many, behind each batch: counts that its write gives.
        """
        todo = settled(self.remaining(node, rows))
        total = todo.count()
        batches = max(1, min(STORE_BATCHES, -(-total // self.batch_rows)))
        parts = [todo]
        if batches > 1:
            waiting = f"{self.path}/_waiting/{node}"
            todo.withColumn("_batch", F.pmod(F.xxhash64(POS), F.lit(batches)).cast("int")).repartition(batches, "_batch").write.mode("overwrite").partitionBy("_batch").parquet(waiting)
            parts = [self.spark.read.schema(todo.schema).parquet(waiting + f"/_batch={i}") if self._exists(f"{waiting}/_batch={i}") else todo.limit(0) for i in range(batches)]
        done = failed = 0
        for part in parts:
            count = Observation()
            ok = F.col(f"{UNIT}.status") == "done"
            work(part).observe(count, F.count_if(ok).alias("done"), F.count_if(~ok).alias("failed")).write.mode("append").parquet(self._folder(node))
            done, failed = done + count.get["done"], failed + count.get["failed"]
            if seen:
                seen(done, failed, total)
        if batches > 1:
            self.forget(f"_waiting/{node}")
        return self.read(node)

    def _exists(self, path: str) -> bool:
        p, fs = self._fs(path)
        return fs.exists(p)

    def remaining(self, node: str, rows: DataFrame) -> DataFrame:
        return rows.join(self.read(node).select(POS), POS, "left_anti") if self.exists(node) else rows

    def replace(self, node: str, units: DataFrame) -> None:
        """units, which may be read from the node's folder, as its next version; older ones go once it is whole."""
        old = self._versions(node)
        units.write.mode("overwrite").parquet(f"{self.path}/{node}/v{max(old, default=0) + 1}")
        for v in old:
            p, fs = self._fs(f"{self.path}/{node}/v{v}")
            fs.delete(p, True)

    def forget(self, node: str) -> None:
        p, fs = self._fs(f"{self.path}/{node}")
        fs.delete(p, True)

    def verdict(self, node: str, judge_rows: Callable[[], judge.Verdict]) -> judge.Verdict:
        """A judge's verdict, asked for once: a run that is resumed reads it."""
        parts = ("failures", "metric", "passed")  # the last one is whole after the others
        if not self.exists(f"{node}@passed"):
            v = judge_rows()
            for part in parts:
                self.replace(f"{node}@{part}", getattr(v, part))
        return judge.Verdict(**{part: self.read(f"{node}@{part}") for part in parts})

    def forget_verdicts(self, node: str) -> None:
        """Those of all batches as well; the one that says that a verdict is there goes first."""
        p, fs = self._fs(self.path)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        for n in sorted(names, key=lambda n: not n.endswith("@passed")):
            if n.rpartition("@")[0].partition("~")[0] == node:
                self.forget(n)

    def purge(self) -> None:
        """Forgets all units and the plan."""
        p, fs = self._fs(self.path)
        fs.delete(p, True)

    def save_plan(self, graph: Graph) -> None:
        """Keeps the graph that a run works by, so that it can be restored later."""
        self.spark.createDataFrame([(json.dumps(graph.dump(), ensure_ascii=False),)], "plan string").coalesce(1).write.mode("overwrite").text(f"{self.path}/_plan")

    def plan(self) -> Graph:
        return Graph.parse(json.loads(self.spark.read.text(f"{self.path}/_plan", wholetext=True).first().value))

    def reopen(self, graph: Graph, node: str | None = None) -> None:
        """Forgets failed units, and all units and verdicts of the nodes after them."""
        for n in graph.nodes:
            inside = node is None or n.id == node
            if inside and self.exists(n.id):
                units = self.read(n.id)
                bad = units.where(F.col(f"{UNIT}.status") != "done")
                if bad.limit(1).count():
                    self.replace(n.id, units.where(F.col(f"{UNIT}.status") == "done"))
                    for d in graph.descendants(n.id):
                        self.forget_verdicts(d)
                        if self.exists(d):
                            self.replace(d, self.read(d).limit(0))


@dataclass
class Result:
    frames: dict[str, DataFrame]
    units: dict[str, DataFrame] = field(default_factory=dict)
    verdicts: dict[str, judge.Verdict] = field(default_factory=dict)

    def output(self, graph: Graph, node: str | None = None) -> DataFrame:
        """The rows of an output node, the first one by default, in order."""
        name = node or next(n.id for n in graph.nodes if n.type == "output")
        return self.frames[name].orderBy(POS)

    def usage(self) -> dict[str, DataFrame]:
        return {n: usage(u) for n, u in self.units.items()}


class Runner:
    """progress gets (node, done, failed, total) behind each stored batch; calls bounds those of all runs that share it."""

    def __init__(
        self, spark: SparkSession, resources: Resources, run: str = "1", store: UnitStore | None = None,
        progress: Callable[[str, int, int, int], None] | None = None, calls: CallSlots | None = None
    ):
        self.spark, self.res, self.run_id, self.store, self.progress = spark, resources, run, store, progress
        self.calls = calls or CallSlots()

    def run(self, data: dict | Graph) -> Result:
        graph = (data if isinstance(data, Graph) else Graph.parse(data)).validate()
        graph = bind_prompts(graph, self.res.prompts)
        if self.store:
            self.store.save_plan(graph)
        self.spark.addTag(self.tag)
        try:
            return self._run(graph)
        finally:
            self.spark.removeTag(self.tag)

    @property
    def tag(self) -> str:
        return f"sparkloom-run-{self.run_id}"

    def cancel(self) -> None:
        """Stops this run's jobs; units that are stored stay, so that it can be resumed."""
        self.spark.interruptTag(self.tag)

    def _run(self, graph: Graph) -> Result:
        chain = generation_chain(graph)
        if chain:
            return self._generate(graph, chain)
        caps = input_caps(graph)
        result = Result({})
        # the node whose rows, in their positions, a node still has
        source: dict[str, str] = {}
        for name in graph.order():
            parents, node = graph.parents(name), graph.node(name)
            came = merge([result.frames[p] for p in parents], aligned=len({source[p] for p in parents}) == 1) if parents else None
            keeps = node.type == "auto_process" and all(op.get("op") in ROW_KEEPING for op in node.config.get("operations", []))
            source[name] = next(iter({source[p] for p in parents})) if keeps and len({source[p] for p in parents}) == 1 else name
            result.frames[name] = self._node(graph, name, came, caps.get(name), result)
        return result

    def _node(self, graph: Graph, name: str, came: DataFrame | None, cap: int | None, result: Result, batch: int | None = None) -> DataFrame:
        node, c = graph.node(name), graph.node(name).config
        if node.type == "input":
            missing = [d for d in c.get("dataset_ids", []) if d not in self.res.datasets]
            if missing or not c.get("dataset_ids"):
                raise GraphError(f"node {name}: there is no dataset {', '.join(missing) or 'listed'}")
            out = root_trace(stack([self.res.datasets[d] for d in c["dataset_ids"]]), self.run_id, name, F.element_at(POS, -1))
        elif came is None and node.type != "http_fetch":
            raise GraphError(f"node {name} has no input")
        elif node.type == "auto_process":
            out = apply_operations(came, c.get("operations", []), c.get("seed"), self.res.processes)
        elif node.type == "llm_synth":
            rows = limit(came, cap) if cap is not None else came
            out = self._synth_rows(name, c, self._units(name, rows, lambda d: self._synth(c, d), result))
        elif node.type == "http_fetch":
            seed = with_positions(self.spark.range(1).select(), F.lit(0)) if came is None else came
            units = self._units(name, seed, lambda d: self._fetch(c, d), result)
            out = unit_rows(units, name, "_body")
            if c.get("records_path"):
                out = explode_records(out, "_body", c["records_path"], c.get("extract"), "_j").withColumn(POS, F.concat(POS, F.array(F.col("_j").cast("bigint")))).drop("_j")
            else:
                out = extract(out, "_body", c.get("extract", {}))
            out = out.drop("_body")
        elif node.type == "qc":
            out = self._review(graph, name, c, came, result, batch)
        else:
            return self._save(name, c, drop(limit(came, c["count"]) if c.get("count") else came, c.get("drop_columns", [])))
        return drop(out, c.get("drop_columns", []))

    def _save(self, name: str, c: dict, rows: DataFrame) -> DataFrame:
        """The output's rows, kept as a dataset as well if the node says so; a run that runs again replaces it."""
        if c.get("save_as_dataset"):
            if self.res.catalog is None:
                raise GraphError(f"node {name}: there is no catalog to save to")
            self.res.catalog.replace(c.get("dataset_name") or f"run{self.run_id}-{name}", rows)
        return rows

    def _units(self, name: str, rows: DataFrame, work: Callable[[DataFrame], DataFrame], result: Result) -> DataFrame:
        seen = (lambda *n: self.progress(name, *n)) if self.progress else None
        units = self.store.fill(name, rows, work, seen) if self.store else work(rows)
        result.units[name] = units
        return units

    def _synth(self, c: dict, rows: DataFrame, fanout: int | None = None) -> DataFrame:
        with self.calls.taken(c.get("concurrency", 4)) as most:
            return synth_units(
                rows, self.res.models[str(c["model_config_id"])], c.get("user_prompt", ""), c.get("system_prompt", ""), fanout or c.get("fanout_n", 1),
                c.get("output_mode") == "json", c.get("params"), c.get("retries", 3), most, c.get("retry_wait", 1.0), per_minute=c.get("calls_per_minute")
            )

    def _synth_rows(self, name: str, c: dict, units: DataFrame) -> DataFrame:
        fields = {f: "string" for f in c.get("output_columns", [])} if c.get("output_mode") == "json" else None
        return unit_rows(units, name, c.get("output_column", "output"), fields)

    def _fetch(self, c: dict, rows: DataFrame) -> DataFrame:
        with self.calls.taken(c.get("concurrency", 4)) as most:
            return fetch_units(
                rows, self.res.fetcher, c.get("endpoint") or c.get("url"), c.get("method", "GET"), c.get("params"), c.get("headers"), c.get("body", ""),
                c.get("body_format", "json"), c.get("timeout", 30), c.get("retries", 2), c.get("poll_status_path"), c.get("poll_until", ""),
                c.get("poll_interval", 2), c.get("poll_max_attempts", 30), most, c.get("retry_wait", 1.0),
                records_path=c.get("records_path"), per_minute=c.get("calls_per_minute")
            )

    def _review(self, graph: Graph, name: str, c: dict, came: DataFrame, result: Result, batch: int | None = None) -> DataFrame:
        judges = [str(j) for j in c.get("judge_model_ids") or [c["model_config_id"]]]
        if all(j in self.res.rules for j in judges):
            votes = lambda d: judge.by_rules({j: (self.res.rules[j](d), f"{j} rejects it") for j in judges})
        else:
            models = {j: self.res.models[j] for j in judges}
            votes = lambda d: judge.by_models(
                d, models, c.get("user_prompt", ""), c.get("system_prompt", ""), c.get("params"), c.get("retries", 3), 1, c.get("retry_wait", 1.0)
            )
        target, again = graph.rescan_target(name), None
        if target is not None:
            t = graph.node(target).config

            def again(rows: DataFrame) -> DataFrame:
                base = rows.drop(*(t.get("output_columns", []) if t.get("output_mode") == "json" else [t.get("output_column", "output")]))
                # one reply a row, whatever the node's fan-out
                return drop(self._synth_rows(target, t, self._synth(t, base, 1)), t.get("drop_columns", []))

        own = [
            x for p in graph.ancestors(name) if graph.node(p).type == "qc" for x in (graph.node(p).config.get("status_column", "qc_status"), graph.node(p).config.get("feedback_column", "qc_feedback"))
        ]
        called = not all(j in self.res.rules for j in judges)

        def ask() -> judge.Verdict:
            with self.calls.taken(c.get("concurrency", 4)) as most:
                return judge.review(
                    came, votes, len(judges), c.get("pass_k", 1), again, c.get("max_rounds", 3), c.get("status_column", "qc_status"),
                    c.get("feedback_column", "qc_feedback"), own, concurrency=most if called else None
                )

        v = self.store.verdict(name if batch is None else f"{name}~{batch}", ask) if self.store else ask()
        result.verdicts[name] = v
        return v.passed

    def _generate(self, graph: Graph, chain: list[str]) -> Result:
        result = Result({})
        first, last = graph.node(chain[0]), graph.node(chain[-1])

        def middle(rows: DataFrame, batch: int) -> DataFrame:
            for n in chain[1:-1]:
                rows = self._node(graph, n, rows, None, result, batch)
            return rows

        def synth(s: DataFrame, batch: int) -> DataFrame:
            # seeds have the same positions in a run that is resumed, so their units are found again
            rows = root_trace(s, self.run_id, first.id)
            units = self._units(first.id, rows, lambda d: self._synth(first.config, d), result)
            mine = units.join(s.select(POS), POS, "left_semi") if self.store else units
            return drop(self._synth_rows(first.id, first.config, mine), first.config.get("drop_columns", []))

        rows = generate(self.spark, last.config["count"], synth, middle, first.config.get("fanout_n", 1), max_batches=last.config.get("max_batches"))
        result.frames[last.id] = self._save(last.id, last.config, drop(rows, last.config.get("drop_columns", [])))
        return result


__all__ = ["Resources", "Result", "Runner", "UnitStore", "visible"]
