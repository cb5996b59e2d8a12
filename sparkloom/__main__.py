"""Command line: run a graph, show its columns, or describe a file.

    python -m sparkloom run graph.json --data docs=in.parquet --out out.csv --format csv
    python -m sparkloom columns graph.json --data docs=in.parquet
    python -m sparkloom describe in.csv column
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.session import prepare
from sparkloom.operators.enrich import ChatModel, EchoModel, UrlFetcher
from sparkloom.operators.order import POS, user_columns, with_positions
from sparkloom.operators.profile import describe
from sparkloom.plans.graph import Graph
from sparkloom.plans.lineage import propagate
from sparkloom.plans.runner import Resources, Runner, UnitStore
from sparkloom.sources import sinks
from sparkloom.sources.readers import read_any


def _data(spark: SparkSession, pairs: list[str]) -> dict:
    out = {}
    for p in pairs:
        name, _, path = p.partition("=")
        df = next(iter(read_any(spark, path).values()))
        # file order: rows of a file follow one another, files by name
        out[name] = df if POS in df.columns else with_positions(df, F.monotonically_increasing_id())
    return out


def _models(path: str | None) -> dict:
    models = {"echo": EchoModel()}
    if path:
        with open(path) as f:
            models |= {k: ChatModel(**v) for k, v in json.load(f).items()}
    return models


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sparkloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run")
    columns = sub.add_parser("columns")
    for c in (run, columns):
        c.add_argument("graph")
        c.add_argument("--data", action="append", default=[], metavar="NAME=PATH")
    run.add_argument("--out", required=True)
    run.add_argument("--format", choices=("csv", "jsonl", "parquet", "xlsx"), default="jsonl")
    run.add_argument("--models", help="JSON file: name -> endpoint, name, key")
    run.add_argument("--store", help="folder of units, for resuming")
    run.add_argument("--run-id", default="1")
    run.add_argument("--rerun-failed", action="store_true")
    about = sub.add_parser("describe")
    about.add_argument("path")
    about.add_argument("column")
    a = p.parse_args(argv)

    spark = prepare(SparkSession.builder.appName("sparkloom").config("spark.sql.caseSensitive", "true").getOrCreate())
    if a.command == "describe":
        print(json.dumps(describe(next(iter(read_any(spark, a.path).values())), a.column).first().asDict(), ensure_ascii=False))
        return 0
    with open(a.graph) as f:
        graph = Graph.parse(json.load(f)).validate()
    data = _data(spark, a.data)
    if a.command == "columns":
        print(json.dumps(propagate(graph, {n: user_columns(d) for n, d in data.items()}), ensure_ascii=False))
        return 0
    store = UnitStore(spark, a.store) if a.store else None
    if store and a.rerun_failed:
        store.reopen(graph)
    rows = Runner(spark, Resources(data, _models(a.models), UrlFetcher()), a.run_id, store).run(graph).output(graph)
    {"csv": sinks.write_csv, "jsonl": sinks.write_jsonl, "parquet": sinks.write_shards, "xlsx": sinks.write_xlsx}[a.format](rows, a.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
