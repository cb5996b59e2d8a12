"""CSV and JSON read by byte ranges of every size, against csv.reader and json.loads."""

import csv
import io
import json
import random
from collections import Counter

import pytest

from sparkloom.sources import readers, splits


@pytest.fixture
def cut(spark):
    """Sets the size of byte ranges."""

    def to(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))

    yield to
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def plain_csv(text, width):
    rows = [r for r in csv.reader(io.StringIO(text, newline="")) if r][1:]
    return [tuple((r + [""] * width)[:width]) for r in rows]


def random_csv(rng, letters="aé,\n\r\" 中"):
    """Cells quoted as they should be, and now and then anything at all."""
    lines = ["x,y,z"]
    for _ in range(rng.randrange(3, 25)):
        cells = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 3, 9, 40]))) for _ in range(rng.choice([1, 3, 3, 3, 4]))]
        if rng.random() < 0.3:
            lines.append("".join(c for c in ",".join(cells) if c not in "\r\n"))
        else:
            lines.append(",".join('"' + c.replace('"', '""') + '"' if set(c) & set(',\n\r"') or rng.random() < 0.2 else c for c in cells))
    return rng.choice(["\n", "\r\n"]).join(lines) + rng.choice(["", "\n", "\r\n"])


@pytest.mark.parametrize("size", [23, 150, 10_000])
@pytest.mark.parametrize("charset", ["utf-8", "gbk"])
def test_csv_cut_anywhere(spark, tmp_path, cut, size, charset):
    rng = random.Random(f"{charset}{size}")
    want = Counter()
    for i in range(4):
        text = random_csv(rng, 'aé,\n\r" 中' if charset == "utf-8" else 'a,\n\r" 中文')
        (tmp_path / f"{i}.csv").write_bytes(text.encode(charset))
        want.update(plain_csv(text, 3))
    cut(size)
    got = splits.read_csv_ranges(spark, str(tmp_path), ["x", "y", "z"], charset)
    assert Counter(map(tuple, got.collect())) == want


def test_one_odd_quote_and_open_cells_are_read_by_many_tasks(spark, tmp_path, cut):
    rows = [f'{i},"two\nlines, {i}"' for i in range(400)] + ['7,5" disk', "8,plain"]
    (tmp_path / "a.csv").write_text("﻿n,note\n" + "\n".join(rows))
    cut(500)
    got = readers.read_csv(spark, str(tmp_path / "a.csv"))
    assert got.columns == ["n", "note"]
    assert Counter(map(tuple, got.collect())) == Counter(plain_csv("n,note\n" + "\n".join(rows), 2))
    assert got.rdd.getNumPartitions() > 10


def random_json(rng, depth=0):
    kind = rng.randrange(6 if depth < 3 else 4)
    if kind == 4:
        return {rng.choice("abc{}\"\\"): random_json(rng, depth + 1) for _ in range(rng.randrange(4))}
    if kind == 5:
        return [random_json(rng, depth + 1) for _ in range(rng.randrange(4))]
    return rng.choice(["", 'q"uo}te', "{[", "back\\slash\\", "é中\n", 12, -1.5, True, None, "}" * 5])


@pytest.mark.parametrize("size", [19, 120, 100_000])
@pytest.mark.parametrize("indent", [None, 2])
def test_json_arrays_cut_anywhere(spark, tmp_path, cut, size, indent):
    rng = random.Random(f"{size}{indent}")
    want = Counter()
    for i in range(3):
        items = [{"id": k} | {f"k{j}": random_json(rng) for j in range(rng.randrange(3))} for k in range(rng.choice([0, 1, 20]))]
        (tmp_path / f"{i}.json").write_text(rng.choice(["", "﻿", " \n"]) + json.dumps(items, indent=indent, ensure_ascii=False) + rng.choice(["", "\n"]), encoding="utf-8")
        want.update(json.dumps(x, sort_keys=True) for x in items)
    cut(size)
    got = splits.json_array_items(spark, str(tmp_path))
    assert Counter(json.dumps(json.loads(r.value), sort_keys=True) for r in got.collect()) == want


def test_json_array_columns(spark, tmp_path, cut):
    big = 12345678901234567890123
    items = [{"n": i, "s": f"}} {i}", "d": i / 2, "big": big + i, "o": {"a": [i]}} for i in range(50)]
    (tmp_path / "a.json").write_text(json.dumps(items))
    cut(200)
    got = readers.read_json(spark, str(tmp_path / "a.json"))
    assert got.rdd.getNumPartitions() > 5
    assert sorted((r.n, r.s, r.d, int(r.big), r.o.a) for r in got.collect()) == [(x["n"], x["s"], x["d"], x["big"], x["o"]["a"]) for x in items]


@pytest.mark.parametrize("text", ['[1, {"a": 2}]', '[{"a": 1}, "x"]', "[[1], {}]"])
def test_items_that_aren_t_objects_are_errors(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match="not a JSON object"):
        readers.read_json(spark, str(tmp_path / "a.json")).collect()


def test_integers_over_64_bits_keep_their_digits(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"n": 12345678901234567890123}\n{"n": 1}\n')
    assert sorted(int(r.n) for r in readers.read_jsonl(spark, str(tmp_path / "a.jsonl")).collect()) == [1, 12345678901234567890123]
