"""CSV files whose cells hold newlines, and JSON arrays, read by many tasks each.

Spark's text source deals out byte ranges of files and gives each range the
parts between separators that begin in it: lines for CSV, and what ends in "}"
for JSON.  Whether a range begins inside a quoted cell, a string or a record
isn't known to its task, so files are read in steps:

1. Each range is scanned for either state that it may begin in, which gives a
   function from the state before it to the state behind it.
2. The functions of a file's ranges are composed in order: a row for each range,
   a group for each file.  The driver gets the ranges that begin inside
   something, at most one entry for a range of ``spark.sql.files.maxPartitionBytes``.
3. Each range parses the records that begin and end in it.
4. Where records cross ranges, the parts that were left over are put together in
   order, by file and by the record that they belong to, and parsed as well.

Rules for CSV are those of Python's ``csv.reader``: a quote opens a cell only at
its beginning, and may stand anywhere else in a cell that it doesn't open.  All
bytes are decoded in Python, so any charset will do whose characters never hold
a byte for a newline, a comma or a quote, as UTF-8 and GBK don't.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain, groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

Key = tuple[str, int]
_PARTS = "file string, start long, tail int, first boolean, raw string"


def _ranges(spark: SparkSession, path: str | list[str], separator: str) -> DataFrame:
    """The parts between separators, with the file and range that each begins in; in order within a range."""
    parts = spark.read.option("lineSep", separator).text(path)
    at = F.col("_metadata")
    return parts.select(F.col("value").cast("binary").alias("value"), at["file_path"].alias("file"), at["file_block_start"].alias("start"), at["file_size"].alias("size"))


def _by_range(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int, int], Iterator[bytes]]]:
    rows = chain.from_iterable(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(0).to_pylist(), strict=True) for b in batches)
    for key, group in groupby(rows, key=lambda r: r[:3]):
        yield key, (r[3] for r in group)


def _batches(rows: Iterable[tuple], schema: T.StructType, most: int = 5000) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds, held = to_arrow_schema(schema), []

    def made() -> pa.RecordBatch:
        columns = zip(*held, strict=True) if held else [[] for _ in kinds]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    for r in rows:
        held.append(r)
        if len(held) >= most:
            yield made()
            held.clear()
    yield made()


def _mapped(df: DataFrame, work: Callable[[tuple[str, int, int], Iterator[bytes]], Iterator[tuple]], schema: str) -> DataFrame:
    """work on each range of df; it gives rows of schema."""
    kind = T._parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches((r for key, parts in _by_range(batches) for r in work(key, parts)), kind)

    return df.mapInArrow(run, kind)


def _put_together(fragments: DataFrame, glue: str) -> DataFrame:
    """(file, first, raw): the parts of each record that crosses ranges, joined; a tail begins a record."""
    order = Window.partitionBy("file").orderBy("start", "tail")  # at most two rows a range
    numbered = fragments.withColumn("g", F.sum("tail").over(order))
    parts = F.array_sort(F.collect_list(F.struct("start", "tail", "raw")))
    return numbered.groupBy("file", "g").agg(F.bool_or("first").alias("first"), F.array_join(F.transform(parts, lambda p: p["raw"]), glue).alias("raw")).drop("g")


# CSV

#: A line that the parser sees behind others: a row of its own, unless a cell is open.
_END = "end of range"


def _rows(text: str) -> list[list[str]]:
    csv.field_size_limit(2**31 - 1)
    return list(csv.reader(io.StringIO(text, newline="")))


def cell_open_after(line: str, opened: bool) -> bool:
    """Whether a quoted cell is open behind a line, given whether one was before it."""
    if '"' not in line:
        return opened
    return _rows(('"' if opened else "") + line + "\n" + _END)[-1] != [_END]


def _decoded(parts: Iterable[bytes], start: int, charset: str) -> Iterator[str]:
    for i, p in enumerate(parts):
        if i == start == 0:
            p = p.removeprefix(b"\xef\xbb\xbf")
        yield p.decode(charset, "replace").replace("\x00", "")


def read_csv_ranges(spark: SparkSession, path: str, names: Sequence[str], charset: str = "utf-8") -> DataFrame:
    """All columns as text; every file begins with a header; blank lines are skipped.

    Short rows are filled with empty texts, further cells are dropped.
    """
    width = len(names)

    def scan(key: tuple[str, int, int], parts: Iterator[bytes]) -> Iterator[tuple]:
        after, size = [False, True], 0
        for p in parts:
            size += len(p) + 1
            if b'"' in p:
                line = p.decode(charset, "replace")
                line = line.removeprefix("\ufeff") if key[1] == 0 and size == len(p) + 1 else line
                after = [cell_open_after(line, x) for x in after] if after[0] != after[1] else [cell_open_after(line, after[0])] * 2
        yield (*key, *after, size)

    lines = _ranges(spark, path, "\n")
    functions = _mapped(lines, scan, "file string, start long, size long, f0 boolean, f1 boolean, bytes long")

    def compose(ranges: pd.DataFrame) -> pd.DataFrame:
        out, opened = [], False
        for r in ranges.sort_values("start").itertuples():
            if opened:
                out.append((r.file, r.start))
            opened = bool(r.f1 if opened else r.f0)
        if opened:  # behind the last line, which may end in a newline
            out.append((ranges["file"].iloc[0], -1 if ranges["bytes"].sum() == ranges["size"].iloc[0] else -2))
        return pd.DataFrame(out, columns=["file", "start"])

    found = functions.groupBy("file").applyInPandas(compose, "file string, start long").collect()  # at most a row a range
    opened: set[Key] = {(r.file, r.start) for r in found if r.start >= 0}
    ended_by_newline = {r.file for r in found if r.start == -1}

    def cells(rows: Iterable[list[str]]) -> Iterator[tuple]:
        for r in rows:
            if r:
                yield tuple(c for c in (r + [""] * (width - len(r)))[:width])

    def walk(key: tuple[str, int, int], parts: Iterator[bytes]) -> Iterator[tuple[bool, list[str]]]:
        """(whether the record lies within the range, its lines)"""
        state, held, whole = key[:2] in opened, [], key[:2] not in opened
        for line in _decoded(parts, key[1], charset):
            held.append(line)
            state = cell_open_after(line, state)
            if not state:
                yield whole, held
                held, whole = [], True
        if held:
            yield False, held

    def inner(key: tuple[str, int, int], parts: Iterator[bytes]) -> Iterator[tuple]:
        skip, ready = key[1] == 0, []
        for whole, held in walk(key, parts):
            if whole and not skip:
                ready += held
                if len(ready) >= 2000:
                    yield from cells(_rows("\n".join(ready) + "\n"))
                    ready = []
            elif whole:
                # the header; a record of the same line may follow behind a lone carriage return
                yield from cells(_rows("\n".join(held) + "\n")[1:])
            skip = False
        yield from cells(_rows("\n".join(ready) + "\n") if ready else [])

    def outer(key: tuple[str, int, int], parts: Iterator[bytes]) -> Iterator[tuple]:
        before = key[:2] in opened
        for i, (whole, held) in enumerate(walk(key, parts)):
            if not whole:
                yield key[0], key[1], 0 if before and i == 0 else 1, key[1] == 0 and i == 0, "\n".join(held)

    columns = ", ".join(f"c{i} string" for i in range(width))
    out = _mapped(lines, inner, columns)
    if found:
        fragments, kind = _mapped(lines, outer, _PARTS), T._parse_datatype_string(columns)

        def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = chain.from_iterable(zip(*(b.column(i).to_pylist() for i in range(3)), strict=True) for b in batches)
            parsed = (_rows(raw + ("\n" if file in ended_by_newline and cell_open_after(raw, False) else ""))[1 if first else 0 :] for file, first, raw in rows)
            yield from _batches((c for p in parsed for c in cells(p)), kind)

        out = out.unionByName(_put_together(fragments, "\n").select("file", "first", "raw").mapInArrow(parse, columns))
    return out.toDF(*names)


# JSON

_STRING_END = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"', re.S)
_STRUCTURE = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*("?)|[{}\[\]]', re.S)


def structure(text: str, in_string: bool) -> Iterator[tuple[int, int]]:
    """(place, 1 or -1) of brackets outside of strings; last (-1, 1 if a string is open behind the text)."""
    at = 0
    if in_string:
        m = _STRING_END.match(text)
        if m is None:
            yield -1, 1
            return
        at = m.end()
    for m in _STRUCTURE.finditer(text, at):
        c = text[m.start()]
        if c != '"':
            yield m.start(), 1 if c in "{[" else -1
        elif not m[1]:
            yield -1, 1
            return
    yield -1, 0


def json_array_items(spark: SparkSession, path: str) -> DataFrame:
    """(value): the text of each item of files that hold an array of objects or arrays each; other items are an error."""
    parts = _ranges(spark, path, "}")

    def texts(raw: Iterable[bytes], start: int) -> Iterator[str]:
        for i, p in enumerate(raw):
            yield (p.removeprefix(b"\xef\xbb\xbf") if i == start == 0 else p).decode("utf-8", "replace") + "}"

    def scan(key: tuple[str, int, int], raw: Iterator[bytes]) -> Iterator[tuple]:
        inside, depth = [False, True], [0, 0]
        for text in texts(raw, key[1]):
            same = inside[0] == inside[1]
            for k in (0,) if same else (0, 1):
                before = depth[k]
                for place, step in structure(text, inside[k]):
                    if place < 0:
                        inside[k] = bool(step)
                    else:
                        depth[k] += step
            if same:
                inside[1], depth[1] = inside[0], depth[1] + depth[0] - before
        yield (*key, *inside, *depth)

    def compose(ranges: pd.DataFrame) -> pd.DataFrame:
        out, inside, depth = [], False, 0
        for r in ranges.sort_values("start").itertuples():
            if r.start and (inside or depth != 1):
                out.append((r.file, r.start, inside, depth))
            inside, depth = (bool(r.f1), depth + r.d1) if inside else (bool(r.f0), depth + r.d0)
        return pd.DataFrame(out, columns=["file", "start", "inside", "depth"])

    functions = _mapped(parts, scan, "file string, start long, size long, f0 boolean, f1 boolean, d0 long, d1 long")
    found = functions.groupBy("file").applyInPandas(compose, "file string, start long, inside boolean, depth long").collect()  # at most a row a range
    opened: dict[Key, tuple[bool, int]] = {(r.file, r.start): (r.inside, r.depth) for r in found}

    def walk(key: tuple[str, int, int], raw: Iterator[bytes]) -> Iterator[tuple[bool, str]]:
        """(whether the item lies within the range, its text)"""
        inside, depth = (False, 0) if key[1] == 0 else opened.get(key[:2], (False, 1))
        held, whole = [], depth < 2
        for text in texts(raw, key[1]):
            # begin: where the item goes on or begins in this part; gap: where what stands between items begins
            begin, gap, ended = (0 if depth > 1 else None), 0, depth < 1 and key[1] > 0
            for place, step in structure(text, inside):
                if place < 0:
                    inside = bool(step)
                    continue
                depth += step
                if step > 0 and depth == 2:
                    _between(text[gap:place])
                    begin = place
                elif step < 0 and depth == 1:
                    held.append(text[begin : place + 1])
                    yield whole, "".join(held)
                    held, whole, begin, gap = [], True, None, place + 1
                elif depth == 1:  # the array begins
                    if text[gap:place].strip() or text[place] != "[":
                        raise ValueError(f"{key[0]} isn't a JSON array")
                    gap = place + 1
                elif depth < 1:  # the array has ended: the rest is no item
                    if not ended:
                        _between(text[gap:place])
                    ended = True
                    break
            if begin is not None:
                held.append(text[begin:])
            elif depth == 1 and not ended:
                _between(text[gap:].removesuffix("}"))
            if ended:
                break
        if held:
            yield False, "".join(held)

    def outer(key: tuple[str, int, int], raw: Iterator[bytes]) -> Iterator[tuple]:
        before = opened.get(key[:2], (False, 0))[1] > 1
        for i, (whole, text) in enumerate(walk(key, raw)):
            if not whole:
                yield key[0], key[1], 0 if before and i == 0 else 1, False, text

    out = _mapped(parts, lambda key, raw: ((text,) for whole, text in walk(key, raw) if whole), "value string")
    if opened:
        out = out.unionByName(_put_together(_mapped(parts, outer, _PARTS), "").select(F.col("raw").alias("value")))
    return out


def _between(text: str) -> None:
    if text.strip(" \t\r\n,"):
        raise ValueError(f"not a JSON object: {text.strip()[:80]}")
