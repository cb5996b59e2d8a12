"""Row-wise enrichment through models and HTTP.

A unit is one input row with its outcome: status, error, the output rows as JSON
texts, and token counts.  A call that fails fails its unit alone.  Only rendered
prompts or requests travel to Python; other columns stay in the JVM.  Outcomes
are settled at once, so a retried task or a second use never calls again.
"""

from __future__ import annotations

import json
import threading
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol, TypeVar

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.session import settled
from sparkloom.functions.template import render
from sparkloom.functions.values import col

from .order import HIDDEN, PARENT, POS, TRACE, child, user_columns

OUTCOME = "struct<status:string,error:string,outs:array<string>,prompt_tokens:bigint,completion_tokens:bigint>"
UNIT = "_unit"
FEEDBACK = "_qc_reason"
Outcome = TypeVar("Outcome")


@dataclass
class Reply:
    text: str
    prompt_tokens: int = 0
    completion_tokens: int = 0


class Model(Protocol):
    def complete(self, system: str, user: str, params: dict) -> Reply: ...


class EchoModel:
    """A deterministic model for tests and dry runs: it gives the prompt back, marked as an echo."""

    def complete(self, system: str, user: str, params: dict) -> Reply:
        return Reply(f"echo<{user}>", 1, 2)


@dataclass
class ChatModel:
    """A chat endpoint with the common JSON interface."""

    endpoint: str
    name: str
    key: str = field(default="", repr=False)
    timeout: float = 60
    defaults: dict = field(default_factory=dict)

    def complete(self, system: str, user: str, params: dict) -> Reply:
        said = [{"role": r, "content": t} for r, t in (("system", system), ("user", user)) if t]
        body = json.dumps({"model": self.name, "messages": said} | self.defaults | params).encode()
        req = urllib.request.Request(self.endpoint, body, {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        with urllib.request.urlopen(req, timeout=self.timeout) as r:
            got = json.load(r)
        text = got["choices"][0]["message"]["content"]
        if not text:
            raise ValueError("the reply is empty")
        use = got.get("usage") or {}
        return Reply(text, use.get("prompt_tokens", 0), use.get("completion_tokens", 0))


def attempt(call: Callable[[], Outcome], retries: int, wait: float = 1.0) -> Outcome:
    """Tries again up to retries times, waiting twice as long each time."""
    for k in range(retries + 1):
        try:
            return call()
        except Exception:
            if k == retries:
                raise
            time.sleep(wait * 2**k)
    raise AssertionError


def _finite(value):
    """NaN and infinities as null, at any depth."""
    if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
        return None
    if isinstance(value, dict):
        return {k: _finite(v) for k, v in value.items()}
    return [_finite(v) for v in value] if isinstance(value, list) else value


def slots(df: DataFrame, concurrency: int) -> tuple[DataFrame, int]:
    """df in parts that make calls side by side, and the calls that each part may have in flight.

    All parts together never have more than ``concurrency``, however many tasks
    the session runs at once.
    """
    parts = max(1, min(int(concurrency), df.sparkSession.sparkContext.defaultParallelism))
    return df.repartition(parts, F.xxhash64(POS)) if POS in df.columns else df.repartition(parts), max(1, int(concurrency)) // parts


class Pace:
    """Lets calls of one task begin no sooner than ``gap`` seconds after each other."""

    def __init__(self, gap: float):
        self.gap, self.lock, self.next = gap, threading.Lock(), 0.0

    def wait(self) -> None:
        if self.gap <= 0:
            return
        with self.lock:
            now = time.monotonic()
            begin = max(now, self.next)
            self.next = begin + self.gap
        time.sleep(begin - now)


def _outcomes(calls: Callable[[tuple, Pace], list[Callable[[], object]]], finish: Callable[[list], dict], threads: int, gap: float):
    """A pandas UDF: the calls of each row run side by side with those of others, ``threads`` at a time; the first that fails fails its row."""

    @F.pandas_udf(OUTCOME)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        pace = Pace(gap)

        def ended(args, running) -> dict:
            try:
                return {"status": "done", "error": None} | finish([r.result() for r in running])
            except Exception as e:
                for r in running:
                    r.cancel()
                return {"status": "failed", "error": f"{type(e).__name__}: {e}"[:500], "outs": [], "prompt_tokens": 0, "completion_tokens": 0}

        with ThreadPoolExecutor(threads) as pool:
            for cols in batches:
                rows = [(args, [pool.submit(c) for c in calls(args, pace)]) for args in zip(*cols, strict=True)]
                yield pd.DataFrame([ended(*r) for r in rows], columns=["status", "error", "outs", "prompt_tokens", "completion_tokens"])

    return run.asNondeterministic()


def _gap(df: DataFrame, per_minute: float | None) -> float:
    return 60 * df.rdd.getNumPartitions() / per_minute if per_minute else 0.0


def synth_units(
    df: DataFrame, model: Model, user_prompt: str, system_prompt: str = "", fanout: int = 1, json_mode: bool = False, params: dict | None = None,
    retries: int = 3, concurrency: int = 4, wait: float = 1.0, settle: bool = True, per_minute: float | None = None
) -> DataFrame:
    """df with a unit of fanout model replies for each row; a failing reply fails the unit.

    At most ``concurrency`` calls are in flight, those of one row's fan-out side
    by side among them, and at most ``per_minute`` begin in a minute.  Where a
    row carries the feedback of a judge, the prompt ends with it.
    """
    if isinstance(fanout, bool) or not isinstance(fanout, int) or fanout < 1:
        raise ValueError("fanout must be a whole number from 1 on")

    df, threads = slots(df, concurrency)

    def calls(args: tuple, pace: Pace) -> list[Callable[[], Reply]]:
        user, system = args

        def ask() -> Reply:
            pace.wait()
            return model.complete(system, user, params or {})

        return [lambda: attempt(ask, retries, wait)] * fanout

    def finish(replies: list[Reply]) -> dict:
        outs = []
        for r in replies:
            if json_mode:
                got = json.loads(r.text)
                if not isinstance(got, dict):
                    raise ValueError("the reply isn't a JSON object")
                outs.append(json.dumps(_finite(got), ensure_ascii=False))
            else:
                outs.append(r.text)
        return {"outs": outs, "prompt_tokens": sum(r.prompt_tokens for r in replies), "completion_tokens": sum(r.completion_tokens for r in replies)}

    user = render(user_prompt, df.schema)
    if FEEDBACK in df.columns:
        user = F.concat(user, F.when(F.coalesce(col(FEEDBACK), F.lit("")) != "", F.concat(F.lit("\n\nAn earlier answer was rejected: "), col(FEEDBACK))).otherwise(""))
    out = df.withColumn(UNIT, _outcomes(calls, finish, threads, _gap(df, per_minute))(user, render(system_prompt, df.schema)))
    return settled(out) if settle else out


def done(units: DataFrame) -> DataFrame:
    return units.where(F.col(f"{UNIT}.status") == "done")


def failed(units: DataFrame) -> DataFrame:
    return units.where(F.col(f"{UNIT}.status") != "done")


def unit_rows(units: DataFrame, node: str, output_column: str | None = "output", fields: dict[str, str] | None = None) -> DataFrame:
    """The output rows of units that are done, in order, with provenance.

    With output_column each reply is a text; with fields (column -> type) it is
    a JSON object whose fields join the row, replacing columns of that name.
    """
    many = F.size(f"{UNIT}.outs") > 1
    rows = done(units).select("*", F.posexplode(f"{UNIT}.outs").alias("_i", "_out"), many.alias("_many")).drop(UNIT)
    if TRACE in rows.columns:
        own = F.concat(col(TRACE), F.lit(f"|{node}:"), F.array_join(F.transform(POS, lambda x: x.cast("string")), "."), F.lit(":"), F.col("_i").cast("string"))
        rows = rows.withColumns(
            {PARENT: F.when(F.col("_many"), col(TRACE)).otherwise(col(PARENT) if PARENT in rows.columns else F.lit(None).cast("string")), TRACE: F.when(F.col("_many"), own).otherwise(col(TRACE))}
        )
    rows = rows.withColumn(POS, child(F.col(POS), F.col("_i"))) if POS in rows.columns else rows
    if fields is None:
        return rows.withColumn(output_column, F.col("_out")).drop("_i", "_out", "_many")
    kind = T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in fields.items()])
    got = F.from_json("_out", kind)
    return rows.withColumns({n: got.getField(n) for n in fields}).drop("_i", "_out", "_many")


@dataclass
class Response:
    status: int
    body: str


class Fetcher(Protocol):
    def fetch(self, request: dict) -> Response: ...


class UrlFetcher:
    def fetch(self, request: dict) -> Response:
        url = request["url"]
        if request["params"]:
            parts = urllib.parse.urlsplit(url)
            query = urllib.parse.parse_qsl(parts.query, keep_blank_values=True) + list(request["params"].items())
            url = urllib.parse.urlunsplit(parts._replace(query=urllib.parse.urlencode(query)))
        body = request["body"].encode() if request["body"] else None
        req = urllib.request.Request(url, body, request["headers"], method=request["method"])
        with urllib.request.urlopen(req, timeout=request["timeout"]) as r:
            return Response(r.status, r.read().decode("utf-8", "replace"))


#: Content types by body format.
CONTENT_TYPES = {"json": "application/json", "form": "application/x-www-form-urlencoded", "raw": "text/plain"}


def path_get(value, path: str):
    """A dotted path in parsed JSON; None where it leads nowhere."""
    for seg in (s for s in path.split(".") if s):
        if isinstance(value, list) and seg.removeprefix("-").isdigit():
            n = int(seg)
            value = value[n] if -len(value) <= n < len(value) else None
        else:
            value = value.get(seg) if isinstance(value, dict) else None
    return value


def fetch_units(
    df: DataFrame, fetcher: Fetcher, endpoint: str, method: str = "GET", params: dict[str, str] | None = None, headers: dict[str, str] | None = None,
    body: str = "", body_format: str = "json", timeout: float = 30, retries: int = 2, poll_path: str | None = None, poll_until: str = "",
    poll_interval: float = 2, poll_most: int = 30, concurrency: int = 4, wait: float = 1.0, settle: bool = True, records_path: str | None = None,
    per_minute: float | None = None
) -> DataFrame:
    """df with a unit for each row that holds the response's body, which must be JSON.

    Endpoint, parameters, headers and body are templates.  With poll_path the
    request is sent again until the value there reads poll_until; a body that
    isn't JSON counts as not ready.  With records_path there must be an array.
    What isn't so fails the row's unit alone.  Error texts name the status and no
    secrets.
    """
    if body_format not in CONTENT_TYPES:
        raise ValueError(f"body_format {body_format!r} is unknown")
    parts = {"url": endpoint, "body": body} | {f"p:{k}": v for k, v in (params or {}).items()} | {f"h:{k}": v for k, v in (headers or {}).items()}
    names = list(parts)
    df, threads = slots(df, concurrency)

    def work(args: tuple, pace: Pace) -> str:
        filled = dict(zip(names, args, strict=True))
        head = {k[2:]: v for k, v in filled.items() if k.startswith("h:")}
        if filled["body"] and not any(h.lower() == "content-type" for h in head):
            head["Content-Type"] = CONTENT_TYPES[body_format]
        request = {"url": filled["url"], "method": method, "params": {k[2:]: v for k, v in filled.items() if k.startswith("p:")}, "headers": head, "body": filled["body"], "timeout": timeout}

        def call() -> Response:
            pace.wait()
            try:
                r = fetcher.fetch(request)
            except Exception as e:
                raise RuntimeError(f"the request failed ({type(e).__name__})") from None
            if r.status >= 400:
                raise RuntimeError(f"the response has status {r.status}")
            return r

        for k in range(poll_most if poll_path else 1):
            got = attempt(call, retries, wait)
            try:
                value = json.loads(got.body)
            except ValueError:
                if not poll_path:
                    raise ValueError(f"the response isn't JSON (status {got.status})") from None
            else:
                if not poll_path or str(path_get(value, poll_path)) == poll_until:
                    break
            if k + 1 == poll_most:
                raise TimeoutError(f"not ready after {poll_most} requests")
            time.sleep(poll_interval)
        if records_path and not isinstance(path_get(value, records_path), list):
            raise ValueError(f"{records_path} isn't an array in the response")
        return got.body

    calls = lambda args, pace: [lambda: work(args, pace)]
    finish = lambda bodies: {"outs": bodies, "prompt_tokens": 0, "completion_tokens": 0}
    out = df.withColumn(UNIT, _outcomes(calls, finish, threads, _gap(df, per_minute))(*(render(t, df.schema) for t in parts.values())))
    return settled(out) if settle else out


def seeds(spark, n: int, start: int = 0) -> DataFrame:
    """n empty rows with positions, for generation without an input."""
    return spark.range(start, start + n).select(F.array("id").alias(POS))


def usage(units: DataFrame, *by: str) -> DataFrame:
    """Token sums and counts by status."""
    u = lambda c: F.col(f"{UNIT}.{c}")
    ok = u("status") == "done"
    return units.groupBy(*by).agg(
        F.count_if(ok).alias("done"), F.count_if(~ok).alias("failed"),
        F.coalesce(F.sum(F.when(ok, u("prompt_tokens"))), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum(F.when(ok, u("completion_tokens"))), F.lit(0)).alias("completion_tokens")
    )


def sample_columns(df: DataFrame) -> list[str]:
    """User columns that aren't a judge's own."""
    return [c for c in user_columns(df) if c not in (FEEDBACK, UNIT)]


__all__ = [
    "HIDDEN", "ChatModel", "Column", "EchoModel", "Fetcher", "Model", "Reply", "Response", "UrlFetcher", "done", "failed", "fetch_units", "path_get",
    "seeds", "synth_units", "unit_rows", "usage"
]
