"""K-of-N judging, regeneration of what fails, and the figures of both."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.session import settled
from sparkloom.functions.template import render
from sparkloom.functions.values import col, not_blank, text_of

from .enrich import FEEDBACK, Model, attempt, sample_columns, slots
from .order import POS

VOTES = "_votes"
_VOTE = "array<struct<model:string,status:string,reason:string>>"
#: How reasons are joined, and how verdicts read.
REASON_SEPARATOR = "；"
PASS, FAILED = "pass", "failed"


def clamp_k(pass_k: object, n: int) -> int:
    """How many of n votes must pass: at least one, at most all."""
    return max(1, min(int(pass_k), n))


def check_columns(df: DataFrame, status: str, feedback: str, own: Sequence[str] = ()) -> None:
    """The judge's columns may replace an earlier judge's (own), never a user's."""
    taken = [c for c in (status, feedback) if c in df.columns and c not in own]
    if taken or status == feedback:
        raise ValueError(f"the judge's columns collide: {', '.join(taken) or status}")


def by_rules(rules: dict[str, tuple[Column, str]]) -> Column:
    """Votes from expressions: judge -> (passes, reason if not).  No Python runs."""
    return F.array(
        *(
            F.struct(
                F.lit(n).alias("model"), F.when(F.coalesce(ok, F.lit(False)), PASS).otherwise("fail").alias("status"),
                F.when(F.coalesce(ok, F.lit(False)), "").otherwise(why).alias("reason")
            ) for n,
            (ok, why) in rules.items()
        )
    )


def by_models(df: DataFrame, models: dict[str, Model], user_prompt: str, system_prompt: str = "", params: dict | None = None, retries: int = 3, concurrency: int = 4, wait: float = 1.0) -> Column:
    """Votes of models that answer {"status", "reason"}; an error is a failing vote."""
    named = dict(models)
    asked = {"temperature": 0, "response_format": {"type": "json_object"}} | (params or {})

    @F.pandas_udf(_VOTE)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        def one(args):
            user, system = args
            votes = []
            for name, m in named.items():
                try:
                    got = json.loads(attempt(lambda m=m: m.complete(system, user, asked), retries, wait).text)
                    votes.append({"model": name, "status": str(got.get("status", "")), "reason": str(got.get("reason", ""))})
                except Exception as e:
                    votes.append({"model": name, "status": "fail", "reason": f"{type(e).__name__}: {e}"[:500]})
            return votes

        with ThreadPoolExecutor(max(1, concurrency)) as pool:
            for user, system in batches:
                yield pd.Series(list(pool.map(one, zip(user, system, strict=True))))

    return run.asNondeterministic()(render(user_prompt, df.schema), render(system_prompt, df.schema))


def passes(votes: Column, k: int) -> Column:
    return F.size(F.filter(votes, lambda v: F.lower(F.trim(v["status"])) == PASS)) >= k


def reasons(votes: Column) -> Column:
    """The reasons of the votes that failed, joined."""
    bad = F.filter(votes, lambda v: (F.lower(F.trim(v["status"])) != PASS) & (v["reason"] != ""))
    return F.array_join(F.transform(bad, lambda v: v["reason"]), REASON_SEPARATOR)


Votes = Callable[[DataFrame], Column]


def judged(df: DataFrame, votes: Votes, n: int, pass_k: object = 1, settle: bool = True, concurrency: int | None = None) -> DataFrame:
    """df with _votes and _ok.  A row without any text fails without a vote being asked for.

    settle is for votes that call out; votes by expressions need no settling.
    With concurrency, rows are asked in as many parts as may be at work at once:
    votes then have a thread each.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    full = reduce(lambda a, b: a | b, (not_blank(text_of(col(c), kinds[c], "")) for c in sample_columns(df)), F.lit(False))
    blank = F.array(F.struct(F.lit("").alias("model"), F.lit("fail").alias("status"), F.lit("the sample is empty").alias("reason"))).cast(_VOTE)
    if settle:
        # votes come from outside: the two kinds of rows part before the call, so that blank ones never reach it
        marked = df.withColumn("_full", full)
        asked = marked.where("_full")
        asked = slots(asked, concurrency)[0] if concurrency else asked
        out = asked.withColumn(VOTES, votes(asked).cast(_VOTE)).unionByName(marked.where("NOT _full").withColumn(VOTES, blank)).drop("_full")
    else:
        out = df.withColumn(VOTES, F.when(full, votes(df).cast(_VOTE)).otherwise(blank))
    out = out.withColumn("_ok", passes(F.col(VOTES), clamp_k(pass_k, n)))
    return settled(out) if settle else out


@dataclass
class Verdict:
    """passed: rows with status and feedback; failures: final rejects with their votes; metric: one row."""

    passed: DataFrame
    failures: DataFrame
    metric: DataFrame


def review(
    df: DataFrame, votes: Votes, n: int, pass_k: object = 1, regenerate: Callable[[DataFrame], DataFrame] | None = None, max_rounds: int = 3,
    status: str = "qc_status", feedback: str = "qc_feedback", own: Sequence[str] = (), settle: bool = True, concurrency: int | None = None
) -> Verdict:
    """Judges df; rows that fail are regenerated and judged again, up to max_rounds times.

    regenerate gets the failed rows with the judges' reasons in ``_qc_reason``
    and returns (units that are done as rows): a row that it loses stays failed
    as it was.  The number of rounds is fixed by the caller, each one a bounded
    set of jobs whose result is settled.
    """
    check_columns(df, status, feedback, own)
    now = judged(df.drop(*own), votes, n, pass_k, settle, concurrency)
    metric = now.agg(F.count(F.lit(1)).alias("total"), F.count_if("_ok").alias("first_round_pass"))

    def passed_of(frame: DataFrame, k: int) -> DataFrame:
        kept = frame.where("_ok").drop("_ok", VOTES, FEEDBACK).withColumns({status: F.lit(PASS), feedback: F.lit("")})
        return kept.withColumn(POS, F.concat(F.array(F.lit(k).cast("bigint")), POS)) if POS in kept.columns else kept

    good, bad, rounds = [passed_of(now, 0)], now.where("NOT _ok"), 0
    lost = []
    if regenerate is not None:
        for rounds in range(1, max_rounds + 1):
            if not bad.limit(1).count():
                break
            again = bad.withColumn(FEEDBACK, reasons(F.col(VOTES))).withColumn("_old", F.col(VOTES)).drop("_ok", VOTES)
            new = regenerate(again)
            if POS in again.columns:
                gone = again.join(new.select(F.slice(POS, 1, F.size(POS) - 1).alias(POS)), POS, "left_anti")
                lost.append(gone.withColumn(VOTES, F.col("_old")).withColumn("_round", F.lit(rounds)).drop("_old", FEEDBACK))
            now = judged(new.drop("_old", FEEDBACK), votes, n, pass_k, settle, concurrency)
            good.append(passed_of(now, rounds))
            bad = now.where("NOT _ok")
    failures = bad.drop("_ok").withColumn("_round", F.lit(rounds))
    for x in lost:
        failures = failures.unionByName(x, allowMissingColumns=True)
    failures = failures.withColumns({status: F.lit(FAILED), feedback: reasons(F.col(VOTES))})
    return Verdict(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), good), failures, metric)


def first_round_rate(metric: DataFrame) -> DataFrame:
    """The share of a run's rows that passed at once; null where nothing was judged."""
    return metric.agg(F.try_divide(F.sum("first_round_pass"), F.sum("total")).alias("first_round_rate"))


def node_rates(metric: DataFrame, *by: str) -> DataFrame:
    """The same for each node; 0 where a node judged nothing."""
    return metric.groupBy(*by).agg(F.coalesce(F.try_divide(F.sum("first_round_pass"), F.sum("total")), F.lit(0.0)).alias("first_round_rate"))


def failures_wide(failures: DataFrame, judges: int) -> DataFrame:
    """A failure's votes as columns _qc_model_i and _qc_model_i_reason."""
    wide = {}
    for i in range(1, judges + 1):
        v = F.try_element_at(VOTES, F.lit(i))
        wide |= {f"_qc_model_{i}": v["model"], f"_qc_model_{i}_reason": v["reason"]}
    return failures.withColumns(wide).drop(VOTES)
