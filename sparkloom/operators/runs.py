"""Run metadata: provenance, resume, counts, log retention and goals."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import PARENT, POS, TRACE

#: Fixed value: successes of a node and source that a pruned log keeps.
LOG_SUCCESSES = 20


def root_trace(df: DataFrame, run: str, node: str, number: Column | None = None) -> DataFrame:
    """Provenance of source rows: run, node and row number."""
    at = F.element_at(POS, -1) if number is None else number
    return df.withColumns({TRACE: F.concat(F.lit(f"run{run}:{node}:"), at.cast("string")), PARENT: F.lit(None).cast("string")})


def remaining(rows: DataFrame, units: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that have no finished unit yet (done or failed): what a resumed run works on."""
    over = units.where(F.col("status").isin("done", "failed")).select(*keys).distinct()
    return rows.join(over, list(keys), "left_anti")


def reopened(units: DataFrame, descendants: Sequence[str], node: str | None = None) -> DataFrame:
    """Units after failed ones are asked for again: failed ones pending, later nodes' units gone."""
    scope = F.lit(True) if node is None else F.col("node_id").isin(node, *descendants)
    kept = units.where(~F.col("node_id").isin(*descendants) | ~scope) if descendants else units
    again = (F.col("status") == "failed") & scope
    return kept.withColumn("status", F.when(again, "pending").otherwise(F.col("status")))


def counts(units: DataFrame, *by: str) -> DataFrame:
    return units.groupBy(*by, "status").agg(F.count(F.lit(1)).alias("n"))


def flattened(units: DataFrame, outs: str = "outs") -> DataFrame:
    """Logical rows: a unit's output rows, counted."""
    return units.agg(F.coalesce(F.sum(F.size(outs)), F.lit(0)).cast("bigint").alias("rows"))


def latest(versions: DataFrame, key: str, version: str, *columns: str) -> DataFrame:
    """The columns of each key's highest version."""
    return versions.groupBy(key).agg(F.max(version).alias(version), *(F.max_by(c, version).alias(c) for c in columns))


def top_logs(failures: DataFrame, logs: DataFrame, on: str, order: str, n: int = 3, clip: dict[str, int] | None = None) -> DataFrame:
    """Each failure with its first n log rows, if any; clip cuts long columns of the log (column -> characters)."""
    logs = logs.withColumns({c: F.substring(c, 1, k) for c, k in (clip or {}).items()})
    first = Window.partitionBy(on).orderBy(order)
    few = logs.withColumn("log_no", F.row_number().over(first).cast("bigint")).where(F.col("log_no") <= n)
    return failures.join(few, on, "left")


def retained(logs: DataFrame, group: Sequence[str], order: str, success: Column, protected: DataFrame | None = None, on: str | None = None, keep: int = LOG_SUCCESSES) -> DataFrame:
    """A pruned log: all failures, the first successes of each group, and all of protected traces.

    order is unique.  Only a few successes of each group and partition are
    shuffled, to find the group's last one that stays; the log itself isn't.
    """
    first = Window.partitionBy(*group).orderBy(order)
    few = logs.where(success).select(*group, order).withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= keep)
    last = few.groupBy(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(group))).agg(F.max(order).alias("_last"))
    kept = logs.join(last, [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group)], "left")
    stays = ~success | F.coalesce(F.col(order) <= F.col("_last"), F.lit(False))
    if protected is not None:
        safe = protected.select(F.col(on).alias("_on")).distinct()
        kept = kept.join(safe, F.col(on) == F.col("_on"), "left")
        stays = stays | F.col("_on").isNotNull()
    return kept.where(stays).select(*logs.columns)


def trace_events(units: DataFrame, failures: DataFrame, logs: DataFrame, trace: str) -> DataFrame:
    """All that is known of one row: units, rejections and calls of its trace or that of its parent, by node.

    units has (node_id, row_idx, status, trace_id, parent_trace_id); failures
    and logs have (node_id, trace_id) and their own columns.
    """
    family = units.where((F.col("trace_id") == trace) | (F.col("parent_trace_id") == trace)).select("trace_id").union(
        units.where(F.col("trace_id") == trace).where("parent_trace_id IS NOT NULL").select(F.col("parent_trace_id").alias("trace_id"))
    ).distinct()
    tagged = [
        f.join(family, "trace_id", "left_semi").select("node_id", "trace_id", F.lit(k).alias("kind"), F.to_json(F.struct(*[c for c in f.columns if not c.startswith("_")])).alias("detail")) for k,
        f in (("unit", units), ("rejection", failures), ("call", logs))
    ]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


def listing(runs: DataFrame, workflows: DataFrame, users: DataFrame, metrics: DataFrame) -> DataFrame:
    """Runs with the names of their workflows and users, and what their judges passed at once.

    runs has (id, workflow_id, user_id) and columns of its own, workflows and
    users (id, name), metrics (run_id, total, first_round_pass), a row a judge.
    A run whose workflow is gone isn't listed; one that judged nothing has totals
    of 0 and no rate.
    """
    judged = metrics.groupBy(F.col("run_id").alias("id")).agg(F.sum("total").alias("_t"), F.sum("first_round_pass").alias("_p"))
    named = runs.join(workflows.select(F.col("id").alias("workflow_id"), F.col("name").alias("workflow_name")), "workflow_id")
    named = named.join(users.select(F.col("id").alias("user_id"), F.col("name").alias("user_name")), "user_id", "left").join(judged, "id", "left")
    return named.select(
        *runs.columns, "workflow_name", "user_name", F.coalesce("_t", F.lit(0)).alias("total"), F.coalesce("_p", F.lit(0)).alias("first_round_pass"),
        F.try_divide("_p", "_t").alias("first_round_rate")
    )


def threshold(text: str) -> float | None:
    """The share that a goal in words asks for: its first percentage, else its first decimal fraction; None if it names none."""
    percent = re.search(r"(\d+(?:\.\d+)?)\s*%", text)
    if percent:
        return float(percent[1]) / 100
    fraction = re.search(r"(?<![\w.])(?:0?\.\d+|1\.0)(?!\w)", text)
    return float(fraction[0]) if fraction else None


def goal_reached(history: Sequence[float | None], goal: float | None, patience: int) -> str | None:
    """Why a loop towards a goal ends: 'reached', 'stalled', or None if it goes on.

    A round without a metric counts as one without a gain; without a goal no
    metric ends the loop.
    """
    best, idle = 0.0, 0
    for metric in history:
        if goal is not None and metric is not None and metric >= goal:
            return "reached"
        best, idle = (metric, 0) if metric is not None and metric > best else (best, idle + 1)
        if goal is not None and idle >= patience:
            return "stalled"
    return None
