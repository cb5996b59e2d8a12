import json
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sparkloom.functions.htmltext import bytes_to_text, clean_spaces, file_text, html_to_text
from sparkloom.operators import profile
from sparkloom.operators.order import POS, with_positions
from sparkloom.sources import datasets, packages, readers, sinks


def put(tmp_path, name, data):
    p = tmp_path / name
    p.write_bytes(data if isinstance(data, bytes) else data.encode())
    return f"file://{p}"


def cells(df):
    return [tuple(r) for r in df.collect()]


def test_csv_cells_are_texts(spark, tmp_path):
    df = readers.read_csv(spark, put(tmp_path, "a.csv", '﻿a,a,b.c\n007,NA,"x\ny"\nnull,,"say ""hi"""\nshort\n1,2,3,4\n'))
    assert df.columns == ["a", "a.1", "b.c"]
    assert cells(df) == [("007", "NA", "x\ny"), ("null", "", 'say "hi"'), ("short", "", ""), ("1", "2", "3")]


def test_csv_nul_and_gbk(spark, tmp_path):
    assert cells(readers.read_csv(spark, put(tmp_path, "n.csv", "a,b\n1\x002,3\n"))) == [("12", "3")]
    assert cells(readers.read_csv(spark, put(tmp_path, "g.csv", "名,值\n你,1\n".encode("gbk")))) == [("你", "1")]
    assert readers.encoding_of(("x" + "é" * 40000).encode()[: readers.PROBE_BYTES]) == "UTF-8"
    assert readers.distinct_names(["a", "a", "a.1", "a"]) == ["a", "a.1", "a.1.1", "a.2"]


def test_jsonl(spark, tmp_path):
    path = put(tmp_path, "a.jsonl", '﻿{"a": 1, "b": NaN, "c": "NaN"}\n\n{"a": 2, "d": [1]}\n')
    df = readers.read_jsonl(spark, path)
    assert [(r.a, r.b, r.c) for r in df.collect()] == [(1, None, "NaN"), (2, None, None)]
    with pytest.raises(PySparkException, match="not a JSON object"):
        readers.read_jsonl(spark, put(tmp_path, "b.jsonl", "[1]\n"), "a int").collect()


def test_json(spark, tmp_path):
    assert readers.read_json(spark, put(tmp_path, "a.json", '[{"x": 1}, {"x": 2}]')).count() == 2
    assert readers.read_json(spark, put(tmp_path, "b.json", '{"x": 1}')).count() == 1


def test_csv_files_are_split_unless_cells_hold_newlines(spark, tmp_path):
    assert not readers.has_open_lines(spark, put(tmp_path, "a.csv", 'a,b\n"say ""hi""",2\n'))
    assert readers.has_open_lines(spark, put(tmp_path, "b.csv", 'a,b\n"x ""\ny",2\n'))
    assert cells(readers.read_csv(spark, put(tmp_path, "c.csv", 'a,b\n"say ""hi""",2\n'))) == [('say "hi"', "2")]


def test_xlsx_dates_and_mixed_columns(tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "d.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {main}/>")
        z.writestr(
            "xl/styles.xml",
            f'<styleSheet {main}><numFmts><numFmt numFmtId="164" formatCode="yyyy&quot;d&quot;"/><numFmt numFmtId="165" formatCode="0.0&quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>'
        )
        z.writestr(
            "s.xml",
            f'<worksheet {main}><sheetData><row><c s="1"><v>45292</v></c><c s="2"><v>45292.5</v></c><c s="3"><v>3.5</v></c><c s="1"><v>0.25</v></c><c t="e"><v>#N/A</v></c></row></sheetData></worksheet>'
        )
    with zipfile.ZipFile(tmp_path / "d.xlsx") as z:
        assert list(readers.xlsx_rows(z, "s.xml")) == [["2024-01-01 00:00:00", "2024-01-01 12:00:00", 3.5, "06:00:00", "#N/A"]]
    rows = [[1, True, 2, "x", None, 2**70], [2, None, 2.5, 7, None, 1]]
    assert [f.dataType.simpleString() for f in readers.column_types(iter(rows), list("abcdef")).fields] == ["bigint", "boolean", "double", "string", "string", "string"]


def test_xlsx_round_trip(spark, tmp_path):
    df = with_positions(spark.createDataFrame([(0, "007", True, None), (1, "a\x01<b>", False, 2.5)], "i bigint, t string, f boolean, x double"), "i")
    path = str(tmp_path / "book.xlsx")
    sinks.write_xlsx(df, path, sheet_rows=1)
    sheets = readers.read_xlsx(spark, path)
    assert list(sheets) == ["Sheet1", "Sheet2"]
    assert cells(sheets["Sheet1"]) == [(0, "007", True, "")] and cells(sheets["Sheet2"]) == [(1, "a<b>", False, 2.5)]
    with pytest.raises(ValueError, match="characters"):
        sinks.write_xlsx(spark.range(1).select(F.repeat(F.lit("x"), 40_000).alias("t")), str(tmp_path / "long.xlsx"))
    assert list(readers.read_any(spark, path)) == ["book-Sheet1", "book-Sheet2"]
    with pytest.raises(ValueError):
        readers.read_xlsx(spark, "old.xls")


def test_exports(spark, tmp_path):
    df = with_positions(spark.createDataFrame([(1, "é", float("nan"), [1, 2]), (0, None, 1.5, None)], "i bigint, s string, x double, l array<int>"), "i")
    assert [json.loads(r.value) for r in sinks.json_lines(df).collect()] == [{"i": 0, "s": None, "x": 1.5, "l": None}, {"i": 1, "s": "é", "x": None, "l": [1, 2]}]
    assert cells(sinks.csv_cells(df)) == [("0", "", "1.5", ""), ("1", "é", "", "[1,2]")]
    sinks.write_csv(df, f"{tmp_path}/csv")
    assert cells(readers.read_csv(spark, f"{tmp_path}/csv")) == [("0", "", "1.5", ""), ("1", "é", "", "[1,2]")]
    assert [sinks.export_format("original", s) for s in ("json", "xls", "odd", "csv")] == ["jsonl", "xlsx", "jsonl", "csv"]


def people(spark):
    df = spark.createDataFrame([(0, "Ada", "36"), (1, "Linus", "55"), (2, "Grace", "37")], "i bigint, name string, age string")
    return datasets.numbered(with_positions(df, "i").drop("i"))


def test_range_reads(spark):
    df = people(spark)
    rows, cut = datasets.read_range(df, 2, 99, ["name", "nothing"], max_rows=2)
    assert cells(rows) == [(2, "Ada"), (3, "Linus")] and cut
    rows, cut = datasets.read_range(df, 3, 4, max_chars=1)
    assert [r.name for r in rows.collect()] == ["Linus"] and cut
    assert [r.name for r in datasets.page(df, 2, 2).collect()] == ["Grace"]


def edited(spark, edit):
    df = people(spark)
    plan = datasets.EditPlan(["name", "age"], 3)
    edit(plan)
    out = plan.apply(df).orderBy("_file_row")
    return out.drop("_file_row").columns, [tuple(r)[:-1] if out.columns[-1] == "_file_row" else tuple(r) for r in out.collect()]


def test_edits(spark):
    assert edited(spark, lambda p: p.delete_rows(2, 3))[1] == [("Grace", "37")]
    assert edited(spark, lambda p: p.replace_rows(3, [{"name": "X", "age": 1}, {"name": "Y"}]))[1] == [("Ada", "36"), ("X", "1"), ("Y", ""), ("Grace", "37")]
    assert edited(spark, lambda p: p.insert_rows(2, [{"name": "0"}]).insert_rows(5, [{"name": "9"}]))[1] == [("0", ""), ("Ada", "36"), ("Linus", "55"), ("Grace", "37"), ("9", "")]
    cols, rows = edited(spark, lambda p: p.rename_column("name", "who").drop_columns("age").add_constant_column("k", "v").insert_rows(2, [{"who": "new"}]))
    assert cols == ["who", "k"] and rows[0] == ("new", "v") and rows[1] == ("Ada", "v")


@pytest.mark.parametrize(
    "edit",
    [
        lambda p: p.delete_rows(1),
        lambda p: p.delete_rows(2, 9),
        lambda p: p.delete_rows(2, 3).replace_rows(3, []),
        lambda p: p.delete_rows(2, 4).insert_rows(3, [{}]),
        lambda p: p.insert_rows(6, [{}]),
        lambda p: p.rename_column("zz", "y"),
        lambda p: p.rename_column("name", "age"),
        lambda p: p.drop_columns("zz"),
        lambda p: p.add_constant_column("age"),
    ],
)
def test_bad_edits(edit):
    with pytest.raises(datasets.EditError):
        edit(datasets.EditPlan(["name", "age"], 3))


def test_catalog(spark, tmp_path):
    c = datasets.Catalog(spark, f"file://{tmp_path}/catalog")
    assert c.write("people", people(spark)) == 1
    assert c.edit("people", c.plan("people").delete_rows(2)) == 2
    assert c.versions("people") == [1, 2] and c.read("people").count() == 2 and c.read("people", 1).count() == 3
    with pytest.raises(KeyError):
        c.read("nobody")


def plain_edit(rows, gone, added):
    """rows with numbers from 2 on; added are (before, row)."""
    out = []
    for n in range(2, len(rows) + 3):
        out += [r for at, r in added if at == n]
        if n < len(rows) + 2 and not any(a <= n <= b for a, b in gone):
            out.append(rows[n - 2])
    return out


def test_versions_share_files(spark, tmp_path):
    """Random chains of edits against a list; no edit writes more than its own rows."""
    import random

    rng = random.Random(4)
    c = datasets.Catalog(spark, f"file://{tmp_path}/catalog")
    rows = [f"r{i}" for i in range(300)]
    c.write("d", with_positions(spark.range(300).select(F.concat(F.lit("r"), "id").alias("name"), "id").repartition(3), "id").drop("id"))
    for step in range(6):
        plan = c.plan("d")
        a = rng.randrange(2, len(rows) - 10)
        new = [f"n{step}{k}" for k in range(rng.randrange(3))]
        at = rng.choice([2, len(rows) + 2, a])
        if step % 2:
            plan.delete_rows(a, a + 4)
            gone, added = [(a, a + 4)], []
        else:
            plan.replace_rows(a + 5, [{"name": x} for x in new]).insert_rows(at, [{"name": "i"}])
            gone, added = [(a + 5, a + 5)], [*((a + 5, x) for x in new), (at, "i")]
        before = sum(1 for _ in (tmp_path / "catalog/d/data").rglob("*.parquet"))
        c.edit("d", plan)
        assert sum(1 for _ in (tmp_path / "catalog/d/data").rglob("*.parquet")) - before == (not step % 2)
        rows = plain_edit(rows, gone, added)
        assert [r["name"] for r in c.rows("d", 2, 10**6)] == rows
    assert [(r["_file_row"], r["name"]) for r in c.page("d", 2, 50)] == list(enumerate(rows, 2))[50:100]
    assert [(r._file_row, r.name) for r in c.read("d").orderBy("_file_row").collect()] == list(enumerate(rows, 2))
    assert sorted(r.name for r in c.read("d", first=5, last=9).collect()) == sorted(rows[3:8])
    assert c.read("d", 1).count() == 300 and c.read("d", first=10**6, last=10**6).count() == 0
    c.replace("d", spark.createDataFrame([("only",)], "name string"))
    assert c.versions("d") == [8] and len(list((tmp_path / "catalog/d/data").iterdir())) == 1 and c.rows("d", 2, 9) == [{"_file_row": 2, "name": "only"}]


def test_versions_of_columns(spark, tmp_path):
    c = datasets.Catalog(spark, f"file://{tmp_path}/catalog")
    c.write("d", with_positions(spark.createDataFrame([(1, "x", 1.5), (2, None, None)], "i long, s string, f double"), "i"))
    c.edit("d", c.plan("d").add_constant_column("k", "v").rename_column("s", "t"))
    c.edit("d", c.plan("d").insert_rows(2, [{"i": "7", "t": "new"}]).drop_columns("f"))
    c.edit("d", c.plan("d").rename_column("k", "s"))
    want = [{"_file_row": 2, "i": 7, "t": "new", "s": ""}, {"_file_row": 3, "i": 1, "t": "x", "s": "v"}, {"_file_row": 4, "i": 2, "t": None, "s": "v"}]
    assert c.rows("d", 2, 9) == want and c.columns("d") == ["i", "t", "s"]
    assert [r.asDict() for r in c.read("d").select("_file_row", "i", "t", "s").orderBy("_file_row").collect()] == want
    with pytest.raises(datasets.VersionConflict):
        c._commit("d", 2, c.manifest("d"))


def test_packages(spark, tmp_path):
    graph = {"nodes": [{"id": "w", "type": "http_fetch", "config": {"url": "https://u:p@h.org/a?token=abc&x=1", "headers": {"Authorization": "Bearer x", "X-Api-Key": "{{key}}"}}}], "edges": []}
    path = str(tmp_path / "p.zip")
    packages.export_package(path, graph, {"d": spark.createDataFrame([(1, "x")], "a bigint, b string")}, {"1": "hi"})
    g, data, prompts = packages.import_package(spark, path, str(tmp_path / "in"))
    c = g["nodes"][0]["config"]
    assert c["headers"] == {"Authorization": "***", "X-Api-Key": "{{key}}"} and c["url"] == "https://***@h.org/a?token=***&x=1"
    assert cells(data["d"].select("a", "b")) == [(1, "x")] and prompts == {"1": "hi"}
    with zipfile.ZipFile(tmp_path / "bomb.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("manifest.json", "0" * 30_000_000)
    with pytest.raises(ValueError, match="unpacks"):
        packages.import_package(spark, str(tmp_path / "bomb.zip"), str(tmp_path / "x"))


def test_profiles(spark):
    df = spark.createDataFrame([("A", 1, "q1"), ("B", 2, "q2"), ("A", None, " "), ("A", 4, "q4")], "cat string, score bigint, q string")
    cat = profile.describe(df, "cat").first()
    assert (cat.rows, cat.missing_pct, cat.dtypes, cat.value_counts) == (4, 0, "str=4", "A=3,B=1")
    assert profile.describe(df, "score").first().missing_pct == 25 and profile.describe(df, "score").first().dtypes == "int=3"
    assert profile.describe(df, "q").first().missing_pct == 25
    many = spark.range(20).select(F.concat(F.lit("v"), "id").alias("v"))
    assert profile.describe(many, "v").first().distinct_estimate == 20 and profile.describe(many, "v").first().value_counts is None
    assert profile.describe(df.limit(0), "q").first().rows == 0
    shown = profile.preview(spark.createDataFrame([("x" * 900,)] * 30, "t string"), chars=2000)
    assert len(shown) == 3 and len(shown[0]["t"]) == 501


def test_html(spark, tmp_path):
    assert html_to_text("<p>a<script>x()</script>b</p><div>c &amp; d</div>") == "a\nb\nc & d"
    assert html_to_text(None) is None and clean_spaces("a \t b \n\n\n\n c") == "a b\nc"
    for name in ("a.zip", "b", "c.pdf"):
        with pytest.raises(ValueError):
            bytes_to_text(name, b"%PDF-1.7")
    put(tmp_path, "a.html", "<b>x</b>")
    put(tmp_path, "b.txt", "y   z")
    df = spark.read.format("binaryFile").load(f"file://{tmp_path}")
    assert sorted(r[0] for r in df.select(file_text(F.col("path"), F.col("content"))).collect()) == ["x", "y z"]


def test_streams(spark, tmp_path):
    from sparkloom.streaming.pipelines import deduplicated, run_stream, windowed_counts

    spark.createDataFrame([(i, "ab"[i % 2]) for i in range(6)], "i bigint, k string").write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("i bigint, k string").parquet(f"{tmp_path}/in")
    run_stream(source, [{"op": "filter", "column": "k", "mode": "equals", "value": "a"}], f"{tmp_path}/out", f"{tmp_path}/c", order="i").awaitTermination(60)
    assert sorted(r.i for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [0, 2, 4]
    timed = source.withColumn("ts", F.timestamp_seconds("i"))
    assert windowed_counts(timed, "ts", "10 seconds", "1 minute", "k").isStreaming and deduplicated(timed, "ts", "1 minute", ["k"]).isStreaming
    assert POS not in source.columns


def test_structure_of_files(spark, tmp_path):
    put(tmp_path, "d.csv", "q,q,a\n1,2,3\n")
    put(tmp_path, "d.jsonl", '{"a":1}\n')
    put(tmp_path, "d.json", '[{"a":1}]')
    (unit,) = readers.structure(spark, f"file://{tmp_path}/d.csv")
    assert unit == readers.Unit("d", ["q", "q.1", "a"], 1, 2, "csv", "csv")
    assert readers.structure(spark, f"file://{tmp_path}/d.jsonl") == [readers.Unit("d", [], None, 1, "jsonl", "jsonl")]
    assert readers.structure(spark, f"file://{tmp_path}/d.json") == [readers.Unit("d", [], None, 1, "jsonl", "json")]
    sinks.write_xlsx(spark.createDataFrame([(1, "x")], "n long, s string"), f"{tmp_path}/b.xlsx")
    assert readers.structure(spark, f"{tmp_path}/b.xlsx") == [readers.Unit("b", ["n", "s"], 1, 2, "xlsx", "xlsx", "Sheet1")]
    with pytest.raises(ValueError):
        readers.structure(spark, "d.txt")


def test_the_package_as_a_zip(tmp_path):
    import subprocess
    import sys

    from sparkloom.functions.session import package_zip

    path = package_zip(str(tmp_path))
    code = f"import sys; sys.path[:] = [{path!r}, *[p for p in sys.path if 'repo' not in p]]; import sparkloom.operators.table as t; print(t.__file__)"
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path, env={k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"}, check=False)
    assert "sparkloom.zip" in said.stdout, said.stderr
