"""Versioned datasets: positional edits, range reads and a catalog of versions that share their Parquet files."""

from __future__ import annotations

import json
import re
import urllib.parse
import uuid
from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from itertools import accumulate

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.session import file_system
from sparkloom.functions.values import col
from sparkloom.operators.order import POS, dense, visible

from .readers import FILE_ROW

#: The first data row of a file, and the rows of a page at most.
FIRST_ROW, PAGE_ROWS = 2, 5000


class EditError(ValueError):
    pass


def numbered(df: DataFrame) -> DataFrame:
    """Data rows with their numbers in the file, from 2 on, in order of ``_pos``."""
    return visible(dense(df).withColumn(FILE_ROW, F.col("_n") + FIRST_ROW).drop("_n"))


def read_range(df: DataFrame, first: int, last: int, columns: Sequence[str] | None = None, max_rows: int | None = None, max_chars: int | None = None) -> tuple[DataFrame, bool]:
    """(rows first..last by file row, whether some were left out for max_rows or max_chars).

    The predicate on the row number reaches the scan, which skips the row groups
    outside.  The first row is returned whatever its size; unknown columns are
    left out.
    """
    names = [c for c in (columns or df.columns) if c in df.columns and c != FILE_ROW]
    rows = df.where(F.col(FILE_ROW).between(first, last)).select(FILE_ROW, *(col(c) for c in names))
    total = None
    if max_chars is not None:
        # a page is read: a range of rows that the caller bounds
        so_far = Window.orderBy(FILE_ROW).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        size = F.length(F.to_json(F.struct(*(col(c) for c in names))))
        total = rows.count()
        rows = rows.withColumn("_s", F.sum(size).over(so_far)).withColumn("_r", F.row_number().over(Window.orderBy(FILE_ROW))).where((F.col("_s") <= max_chars) | (F.col("_r") == 1)).drop("_s", "_r")
    if max_rows is not None:
        total = rows.count() if total is None else total
        rows = rows.orderBy(FILE_ROW).limit(max_rows)
    return rows.orderBy(FILE_ROW), total is not None and rows.count() < total


def page(df: DataFrame, number: int, size: int) -> DataFrame:
    size = max(1, min(size, PAGE_ROWS))
    first = FIRST_ROW + (number - 1) * size
    return df.where(F.col(FILE_ROW).between(first, first + size - 1)).orderBy(FILE_ROW)


def after(df: DataFrame, key: str, last: object, size: int = 500) -> DataFrame:
    """The next rows behind a key: paging whose cost doesn't grow with the page's number."""
    rows = df if last is None else df.where(col(key) > F.lit(last))
    return rows.orderBy(key).limit(size)


@dataclass
class EditPlan:
    """Edits of one version, checked against its rows and columns before anything runs."""

    columns: list[str]
    total_rows: int
    renames: dict[str, str] = field(default_factory=dict)
    constants: dict[str, str] = field(default_factory=dict)
    gone: list[tuple[int, int]] = field(default_factory=list)
    added: list[tuple[int, int, dict]] = field(default_factory=list)

    @property
    def last_row(self) -> int:
        return self.total_rows + FIRST_ROW - 1

    def _range(self, start: int, end: int) -> None:
        if start < FIRST_ROW:
            raise EditError("the header row can't be edited")
        if end < start or end > self.last_row:
            raise EditError(f"rows {start} to {end} aren't in the dataset")
        if any(start <= b and end >= a for a, b in self.gone):
            raise EditError(f"rows {start} to {end} overlap another edit")
        if any(start < at <= end for at, k, _ in self.added if k >= 0):
            raise EditError(f"rows are inserted inside {start} to {end}")
        self.gone.append((start, end))

    def delete_rows(self, start: int, end: int | None = None) -> EditPlan:
        self._range(start, end or start)
        return self

    def replace_rows(self, start: int, rows: Sequence[dict], end: int | None = None) -> EditPlan:
        self._range(start, end or start)
        self.added += [(start, -1 - len(self.added), dict(r)) for r in rows]
        return self

    def insert_rows(self, before: int, rows: Sequence[dict]) -> EditPlan:
        if not FIRST_ROW <= before <= self.last_row + 1:
            raise EditError(f"rows can't be inserted before row {before}")
        if any(a < before <= b for a, b in self.gone):
            raise EditError(f"row {before} is inside of another edit")
        self.added += [(before, len(self.added), dict(r)) for r in rows]
        return self

    def _known(self, name: str) -> None:
        if name not in self.columns:
            raise EditError(f"there is no column {name}")

    def rename_column(self, old: str, new: str) -> EditPlan:
        self._known(old)
        if new in self.columns:
            raise EditError(f"there is a column {new}")
        self.columns[self.columns.index(old)] = new
        source = next((k for k, v in self.renames.items() if v == old), old)
        if old in self.constants:
            self.constants[new] = self.constants.pop(old)
        else:
            self.renames[source] = new
        return self

    def drop_columns(self, *names: str) -> EditPlan:
        for n in names:
            self._known(n)
            self.columns.remove(n)
            self.constants.pop(n, None)
        return self

    def add_constant_column(self, name: str, value: str = "") -> EditPlan:
        if name in self.columns:
            raise EditError(f"there is a column {name}")
        self.columns.append(name)
        self.constants[name] = value
        return self

    def in_order(self) -> list[tuple[int, int, dict]]:
        """The added rows as they stand in the new version."""
        return sorted(self.added, key=lambda x: x[0])

    def apply(self, df: DataFrame) -> DataFrame:
        """The new version, with new row numbers: one pass over the old rows, one union.

        Old rows have the order key [row, 1, 0]; added ones stand before the row
        that they name, [row, 0, i].
        """
        spark = df.sparkSession
        kept = df
        for a, b in self.gone:
            kept = kept.where(~F.col(FILE_ROW).between(a, b))

        def shaped(rows: DataFrame) -> DataFrame:
            back = {v: k for k, v in self.renames.items()}
            out = []
            for c in self.columns:
                old = back.get(c, c)
                value = F.lit(self.constants[c]) if c in self.constants else col(old) if old in rows.columns else F.lit("")
                kind = df.schema[old].dataType if old in df.columns and c not in self.constants else None
                out.append((value.cast(kind) if kind else value).alias(c))
            return rows.select(*out, POS)

        base = kept.withColumn(POS, F.array(F.col(FILE_ROW).cast("bigint"), F.lit(1).cast("bigint"), F.lit(0).cast("bigint")))
        result = shaped(base)
        if self.added:
            names = [c for c in df.columns if c != FILE_ROW]
            listed = [(json.dumps({k: ("" if v is None else str(v)) for k, v in r.items()}), [at, 0, i]) for i, (at, _, r) in enumerate(self.added)]
            new = spark.createDataFrame(listed, f"_j string, {POS} array<bigint>").withColumn("_m", F.from_json("_j", "map<string,string>"))
            # a row's keys may already be the new names
            ahead = {v: k for k, v in self.renames.items()}
            new = new.select(*(F.coalesce(F.try_element_at("_m", F.lit(c)), *( [F.try_element_at("_m", F.lit(self.renames[c]))] if c in self.renames else []), F.lit("")).alias(c) for c in names), POS)
            result = result.unionByName(shaped(new)) if ahead is not None else result
        return numbered(result)


@dataclass(frozen=True)
class Segment:
    """Rows first..end-1 of a file, by their places in it."""

    file: str
    first: int
    end: int

    @property
    def rows(self) -> int:
        return self.end - self.first


@dataclass(frozen=True)
class Stored:
    """A column: files hold it under its key, whatever it is named since; files that lack it read ``value``."""

    key: str
    name: str
    kind: str
    value: str | None = None


@dataclass(frozen=True)
class Manifest:
    """What a version is: its columns, and the segments whose rows it has, in order.

    A row's number is the sum of the rows of the segments before its own and its
    place in that; nothing is numbered in the files.
    """

    columns: list[Stored]
    segments: list[Segment]

    @property
    def rows(self) -> int:
        return sum(s.rows for s in self.segments)

    @property
    def folders(self) -> set[str]:
        return {s.file.rpartition("/")[0] for s in self.segments}

    def dump(self) -> str:
        return json.dumps({"columns": [vars(c) for c in self.columns], "segments": [[s.file, s.first, s.end] for s in self.segments]}, ensure_ascii=False)

    @classmethod
    def parse(cls, text: str) -> Manifest:
        got = json.loads(text)
        return cls([Stored(**c) for c in got["columns"]], [Segment(*s) for s in got["segments"]])

    def within(self, first: int, last: int) -> list[tuple[int, Segment]]:
        """(number of its first row, segment) of what rows first..last take, cut to these."""
        starts = list(accumulate((s.rows for s in self.segments), initial=FIRST_ROW))
        out = []
        for i in range(max(0, bisect_right(starts, first) - 1), len(self.segments)):
            at, s = starts[i], self.segments[i]
            if at > last:
                break
            a, b = max(first, at), min(last + 1, at + s.rows)
            if a < b:
                out.append((a, Segment(s.file, s.first + a - at, s.first + b - at)))
        return out

    def edited(self, plan: EditPlan, columns: list[Stored], added: str | None) -> Manifest:
        """Without what the plan deletes, and with the rows of the file ``added`` before the rows that they name."""
        cuts = sorted({FIRST_ROW, self.rows + FIRST_ROW, *(x for a, b in plan.gone for x in (a, b + 1)), *(at for at, _, _ in plan.added)})
        new: dict[int, list[int]] = {}
        for i, (at, _, _) in enumerate(plan.in_order()):
            new.setdefault(at, []).append(i)
        segments: list[Segment] = []

        def put(s: Segment) -> None:
            last = segments[-1] if segments else None
            if last and last.file == s.file and last.end == s.first:
                segments[-1] = Segment(s.file, last.first, s.end)
            else:
                segments.append(s)

        for a, b in zip(cuts, [*cuts[1:], None], strict=True):
            if a in new:
                put(Segment(added, new[a][0], new[a][-1] + 1))
            if b is not None and not any(x <= a <= y for x, y in plan.gone):
                for _, s in self.within(a, b - 1):
                    put(s)
        return Manifest(columns, segments)


class VersionConflict(RuntimeError):
    """Another writer made the same version first."""


#: Segments up to which a version's manifest is broadcast; beyond, Spark joins it by file.
BROADCAST_SEGMENTS = 100_000


class Catalog:
    """Datasets whose versions share their files.

    A dataset is a folder with ``data`` and a folder for each version, which
    holds its manifest and is visible once that is whole.  An edit writes the
    rows that it adds, in one small file, and a manifest; deletes, renamed,
    dropped and constant columns write no rows at all.  A page opens the files
    that hold its rows.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._read: dict[str, Manifest] = {}

    def versions(self, name: str) -> list[int]:
        root = self._path(f"{self.path}/{name}")
        if not self._fs.exists(root):
            return []
        found = [s.getPath().getName() for s in self._fs.listStatus(root)]
        return sorted(int(v[1:]) for v in found if v[:1] == "v" and v[1:].isdigit() and self._fs.exists(self._path(f"{self.path}/{name}/{v}/manifest.json")))

    def manifest(self, name: str, version: int | None = None) -> Manifest:
        have = self.versions(name) if version is None or f"{name}/v{version}" not in self._read else [version]
        if not have or (version is not None and version not in have):
            raise KeyError(f"there is no dataset {name}" + (f" version {version}" if version else ""))
        key = f"{name}/v{version or have[-1]}"
        if key not in self._read:  # versions never change
            stream = self._fs.open(self._path(f"{self.path}/{key}/manifest.json"))
            try:
                self._read[key] = Manifest.parse(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
        return self._read[key]

    def columns(self, name: str) -> list[str]:
        """The columns of a dataset's last version, from its manifest."""
        return [c.name for c in self.manifest(name).columns]

    def _commit(self, name: str, version: int, manifest: Manifest) -> int:
        try:
            stream = self._fs.create(self._path(f"{self.path}/{name}/v{version}/manifest.json"), False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                raise VersionConflict(f"{name} has a version {version} already") from None
            raise
        try:
            stream.write(bytearray(manifest.dump().encode()))
        finally:
            stream.close()
        return version

    def _files(self, rows: DataFrame, name: str) -> list[Segment]:
        """Writes rows as they are ordered, and returns the files with the rows in each."""
        folder = f"{self.path}/{name}/data/{uuid.uuid4().hex}"
        rows.write.option("maxRecordsPerFile", 100_000).parquet(folder)
        at = F.col("_metadata.file_path").alias("file")
        counts = self.spark.read.schema(rows.schema).parquet(folder).groupBy(at).agg(F.count(F.lit(1)).alias("n")).collect()  # a row a file

        def place(file: str) -> list[int]:
            part = re.search(r"part-(\d+)-.*?(?:-c(\d+))?[.\w]*$", file)
            return [int(x or 0) for x in part.groups()]

        # paths come as URIs
        listed = sorted(((urllib.parse.unquote(r.file), r.n) for r in counts), key=lambda x: place(x[0]))
        return [Segment(f, 0, n) for f, n in listed]

    def write(self, name: str, rows: DataFrame) -> int:
        """A new version with all rows, in the order of their row numbers or, without these, of ``_pos``."""
        order = FILE_ROW if FILE_ROW in rows.columns else POS if POS in rows.columns else None
        data = visible(rows).drop(FILE_ROW)
        columns = [Stored(f"c{i}-{uuid.uuid4().hex[:6]}", f.name, f.dataType.simpleString()) for i, f in enumerate(data.schema.fields)]
        out = (rows.repartitionByRange(order).sortWithinPartitions(order) if order else rows).select(*(col(c.name).alias(c.key) for c in columns))
        version = max(self.versions(name), default=0) + 1
        return self._commit(name, version, Manifest(columns, self._files(out, name)))

    def replace(self, name: str, rows: DataFrame) -> None:
        """The rows as the dataset's only version, with the next number, whatever it held: what a node that runs again saves."""
        # the new version is whole before the old ones go, so a reader always finds one
        kept = self.write(name, rows)
        for v in self.versions(name):
            if v != kept:
                self._fs.delete(self._path(f"{self.path}/{name}/v{v}"), True)
                self._read.pop(f"{name}/v{v}", None)
        self.vacuum(name)

    def vacuum(self, name: str) -> None:
        """Deletes files that no version has; writers must not be at work meanwhile."""
        used = {f.rpartition("/")[2] for v in self.versions(name) for f in self.manifest(name, v).folders}
        root = self._path(f"{self.path}/{name}/data")
        for s in self._fs.listStatus(root) if self._fs.exists(root) else []:
            if s.getPath().getName() not in used:
                self._fs.delete(s.getPath(), True)

    def read(self, name: str, version: int | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
        """A version's rows with their numbers; with first and last, only files that hold these rows are opened."""
        m = self.manifest(name, version)
        parts = m.within(FIRST_ROW if first is None else first, m.rows + FIRST_ROW if last is None else last)
        kinds = T.StructType([T.StructField(c.key, T._parse_datatype_string(c.kind)) for c in m.columns])
        if not parts:
            empty = T.StructType([*(T.StructField(c.name, kinds[c.key].dataType) for c in m.columns), T.StructField(FILE_ROW, T.LongType())])
            return self.spark.createDataFrame([], empty)
        files = self.spark.read.schema(kinds).parquet(*dict.fromkeys(s.file for _, s in parts))
        at = F.col("_metadata")
        rows = files.select("*", F.regexp_extract(at["file_path"], "[^/]+/[^/]+$", 0).alias("_file"), at["row_index"].alias("_row"))
        listed = [("/".join(s.file.split("/")[-2:]), s.first, s.end, n - s.first) for n, s in parts]
        places = self.spark.createDataFrame(listed, "_file string, _first long, _end long, _shift long")
        if len(parts) <= BROADCAST_SEGMENTS:
            places = F.broadcast(places)
        rows = rows.join(places, "_file").where("_row >= _first AND _row < _end")
        named = (col(c.key) if c.value is None else F.coalesce(col(c.key), F.lit(c.value).cast(c.kind)) for c in m.columns)
        return rows.select(*(v.alias(c.name) for v, c in zip(named, m.columns, strict=True)), (F.col("_row") + F.col("_shift")).alias(FILE_ROW))

    def rows(self, name: str, first: int, last: int, version: int | None = None, columns: Sequence[str] | None = None) -> list[dict]:
        """Rows first..last by number, read on the driver from the row groups that hold them; the caller bounds their number."""
        m = self.manifest(name, version)
        wanted = [c for c in m.columns if columns is None or c.name in columns]
        parts = m.within(first, last)
        try:
            tables = [_slice(s, [c.key for c in wanted]) for _, s in parts]
        except (OSError, ValueError):  # a store that only Spark reads
            got = self.read(name, version, first, last).orderBy(FILE_ROW)
            return [r.asDict(recursive=True) for r in got.select(FILE_ROW, *(col(c.name) for c in wanted)).collect()]
        out = []
        for (n, s), t in zip(parts, tables, strict=True):
            have = {c.name: t[c.key].to_pylist() if c.key in t else [None] * s.rows for c in wanted}
            filled = {c.name: [c.value if v is None else v for v in have[c.name]] if c.value is not None else have[c.name] for c in wanted}
            out += [{FILE_ROW: n + i} | {k: v[i] for k, v in filled.items()} for i in range(s.rows)]
        return out

    def page(self, name: str, number: int, size: int, version: int | None = None) -> list[dict]:
        """A page of rows, with their numbers."""
        size = max(1, min(size, PAGE_ROWS))
        first = FIRST_ROW + (number - 1) * size
        return self.rows(name, first, first + size - 1, version)

    def plan(self, name: str) -> EditPlan:
        m = self.manifest(name)
        return EditPlan([c.name for c in m.columns], m.rows)

    def edit(self, name: str, plan: EditPlan) -> int:
        """A new version: what the plan adds is written, the rest is named anew."""
        version = self.versions(name)[-1]
        m = self.manifest(name, version)
        old, back = {c.name: c for c in m.columns}, {v: k for k, v in plan.renames.items()}
        columns = [
            Stored(f"k-{uuid.uuid4().hex[:8]}", c, "string", plan.constants[c]) if c in plan.constants else replace(old[back.get(c, c)], name=c)
            for c in plan.columns
        ]
        added = None
        if plan.added:
            listed = []
            for i, (_, _, r) in enumerate(plan.in_order()):
                # a row's keys may be old or new names; constants hold for added rows as well
                values = [c.value if c.name in plan.constants else r.get(back.get(c.name, c.name), r.get(c.name)) for c in columns]
                listed.append((i, json.dumps({c.key: "" if v is None else str(v) for c, v in zip(columns, values, strict=True)})))
            new = self.spark.createDataFrame(listed, "i long, j string").coalesce(1).sortWithinPartitions("i").withColumn("m", F.from_json("j", "map<string,string>"))

            def value(c: Stored) -> F.Column:
                text = F.try_element_at("m", F.lit(c.key))
                return text if c.kind == "string" else F.when(text != "", text).cast(c.kind)

            added = self._files(new.select(*(value(c).alias(c.key) for c in columns)), name)[0].file
        return self._commit(name, version + 1, m.edited(plan, columns, added))

    def drop(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.path}/{name}"), True)
        self._read = {k: m for k, m in self._read.items() if not k.startswith(f"{name}/")}


def _slice(s: Segment, keys: list[str]):
    """A segment's rows of the columns that its file has, from the row groups that hold them."""
    import pyarrow.parquet as pq

    fs, path = file_system(s.file)
    with fs.open_input_file(path) as f:
        file = pq.ParquetFile(f)
        groups, before, at = [], None, 0
        for g in range(file.num_row_groups):
            n = file.metadata.row_group(g).num_rows
            if at < s.end and at + n > s.first:
                groups.append(g)
                before = at if before is None else before
            at += n
        have = [k for k in keys if k in file.schema_arrow.names]
        t = file.read_row_groups(groups, have).slice(s.first - before, s.rows)
        return {k: t.column(k) for k in have}
