import importlib
import os
import subprocess
import sys

import corpus_pipeline
from conftest import ROOT

from .helpers import corpus, frame, prose, shingles, words


def test_stages_do_what_they_say(spark, tmp_path):
    rng = __import__("random").Random(11)
    item = " ".join(prose(rng, 30, 10**6))
    passage = " ".join(prose(rng, 60, 10**6))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sides = [" ".join(prose(rng, 25, 10**6)) for _ in range(4)]
    docs = corpus() + [(5000, "x1y " + item), (5001, f"{sides[0]} {passage} {sides[1]}"), (5002, f"{sides[2]} {passage} {sides[3]}"), (5003, "1 2 3 4")]
    df = frame(spark, docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = df
        df = stage(spark, df, str(tmp_path))
        assert df.columns == before.columns, name
        ids = {r.doc_id for r in df.collect()}
        if name == "language_id":
            assert not ids & {1000, 1001, 1002, 5003} and 1003 in ids
        if name == "near_dedup":
            sets = [shingles(r.text) for r in df.collect() if r.doc_id is not None]
            assert all(100 * len(a & b) < 85 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
        if name == "substring_dedup":
            texts = {r.doc_id: r.text for r in df.collect()}
            assert texts[5001] == f"{sides[0]} {sides[1]}" and texts[5002] == f"{sides[2]} {sides[3]}"
            assert all(words(t) for t in texts.values())
        if name == "decontamination":
            assert 5000 not in ids and 5001 in ids
    last = corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path)).collect()
    assert {r.doc_id for r in last} == ids


def test_near_dedup_links_from_080(spark, tmp_path):
    rng = __import__("random").Random(31)
    docs = []
    for i in range(20):
        base = prose(rng, 140, 10**6)
        for k, places in enumerate(((), (30, 70, 110), (20, 50, 80, 120))):
            docs.append((10 * i + k, " ".join(f"e{k}p{p}" if p in places else x for p, x in enumerate(base))))
    a, b, c = (shingles(t) for _, t in docs[:3])
    assert 0.8 <= len(a & b) / len(a | b) < 0.85 and len(a & c) / len(a | c) < 0.8 > len(b & c) / len(b | c)
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, frame(spark, docs), str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, _ in docs if i % 10 != 1]


def test_run_is_the_stages_in_order(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "decontamination", "best_fit_packing"]
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() > 0


def test_stages_take_empty_tables(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, sf)
        assert df.count() == 0


def test_the_library_works_without_the_subpackage(tmp_path):
    for name in os.listdir(ROOT):
        if name not in ("corpus_pipeline.py", ".git"):
            if name == "sparkloom":
                os.mkdir(tmp_path / name)
                for x in os.listdir(os.path.join(ROOT, name)):
                    if x != "llm":
                        os.symlink(os.path.join(ROOT, name, x), tmp_path / name / x)
            else:
                os.symlink(os.path.join(ROOT, name), tmp_path / name)
    said = subprocess.run(
        [sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), sorted(k for k in e.queries() if k[2:3].isdigit() or k == 'pipeline'))"],
        cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    )
    assert said.returncode == 0 and said.stdout.strip().endswith("[]"), said.stderr
    assert importlib.import_module("__spark_entry__").queries().keys() >= {"pipeline", "op1_substring_dedup", "op10_language_id"}


def test_queries_with_sql(spark, sf):
    import duckdb

    from sparkloom.llm.queries import QUERIES, SQL

    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    for name, sql in SQL.items():
        got = con.execute(sql)
        cols = [c[0] for c in got.description]
        assert sorted(map(str, got.fetchall())) == sorted(str(tuple(r[c] for c in cols)) for r in QUERIES[name](spark, sf).collect())
