"""CSV, JSON lines, JSON and XLSX as DataFrames, with the rules of uploaded datasets."""

from __future__ import annotations

import csv
import datetime as dt
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sparkloom.functions.session import file_system, prepare
from sparkloom.functions.values import col

from .splits import json_array_items, read_csv_ranges

#: Bytes that decide the encoding, and that hold the header.
PROBE_BYTES = 64 * 1024
#: The column of data rows' numbers in their file; the header is row 1.
FILE_ROW = "_file_row"


def probe(spark: SparkSession, path: str) -> bytes:
    """The first bytes of a file, or of a folder's first file, from any store that Spark reads."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(at).isDirectory():
        files = sorted(str(s.getPath()) for s in fs.listStatus(at) if s.getPath().getName()[0] not in "._" and s.getLen())
        if not files:
            return b""
        at = jvm.org.apache.hadoop.fs.Path(files[0])
    stream = fs.open(at)
    try:
        head = jvm.org.apache.commons.io.input.BoundedInputStream(stream, PROBE_BYTES)
        return jvm.org.apache.commons.io.IOUtils.toString(head, "ISO-8859-1").encode("latin-1")
    finally:
        stream.close()


def encoding_of(head: bytes) -> str:
    """UTF-8 if the bytes are, but for a character cut at the end; else GBK."""
    for cut in range(4):
        try:
            head[: len(head) - cut].decode("utf-8")
            return "UTF-8"
        except UnicodeDecodeError:
            if len(head) < PROBE_BYTES:
                break
    return "GBK"


def distinct_names(header: Sequence[str]) -> list[str]:
    """A name that came before gets .1, .2, ... behind it."""
    out: list[str] = []
    for name in header:
        n, k = name, 0
        while n in out:
            k += 1
            n = f"{name}.{k}"
        out.append(n)
    return out


def csv_header(head: bytes, encoding: str) -> list[str]:
    text = head.decode("utf-8-sig" if encoding == "UTF-8" else "gbk", "ignore").replace("\x00", "")
    return distinct_names(next(csv.reader(io.StringIO(text, newline="")), []))


def has_open_lines(spark: SparkSession, path: str) -> bool:
    """Whether a cell of a CSV file holds a newline: then some line has an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return bool(spark.read.text(path).where(quotes % 2 == 1).limit(1).count())


def read_csv(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """All columns as text; short rows are filled with empty texts, further cells are dropped.

    Files are split among tasks.  Cells with newlines, and charsets that Spark's
    reader lacks, are read by ranges that find out about each other (``splits``).
    Without multi_line, a pass over the lines finds out which it is.
    """
    head = probe(spark, path)
    kind = encoding_of(head)
    names = csv_header(head, kind)
    if not names:
        raise ValueError(f"{path} has no header")
    if kind != "UTF-8" or (has_open_lines(spark, path) if multi_line is None else multi_line):
        return read_csv_ranges(prepare(spark), path, names, kind.lower())
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = spark.read.schema(schema).options(header=True, escape='"', mode="PERMISSIVE", enforceSchema=True, maxCharsPerColumn=-1).csv(path)
    return df.select(*(F.translate(F.coalesce(col(n), F.lit("")), "\x00", "").alias(n) for n in names))


def _without_nan(c: F.Column) -> F.Column:
    """NaN and the infinities, where they stand outside of strings, as null."""
    parts = F.regexp_extract_all(c, F.lit(r'"(?:[^"\\]++|\\.)*+"|[^"]++'), F.lit(0))
    clean = F.transform(parts, lambda p: F.when(p.startswith('"'), p).otherwise(F.regexp_replace(p, r"-?\b(?:NaN|Infinity)\b", "null")))
    return F.when(c.rlike("NaN|Infinity"), F.array_join(clean, "")).otherwise(c)


def _json_schema(lines: DataFrame) -> str:
    """The merged schema of JSON objects: schema_of_variant_agg sees each once, with sums on the map side."""
    got = lines.agg(F.schema_of_variant_agg(F.try_parse_json("value"))).first()[0]
    fields = re.sub(r"^OBJECT<|>$", "", got or "")
    # a column that is null throughout is text, and so are mixed ones
    kind = f"STRUCT<{fields}>".replace("OBJECT<", "STRUCT<").replace("VOID", "STRING").replace("VARIANT", "STRING")
    # whole numbers over 64 bits keep their digits; other decimals are doubles
    return re.sub(r"DECIMAL\((\d+),(\d+)\)", lambda m: m[0] if m[2] == "0" else "DOUBLE", kind)


def _objects(texts: DataFrame, schema: str | None) -> DataFrame:
    """Columns of JSON objects (value); a text that isn't an object fails the query."""
    good = texts.select(_without_nan(F.col("value")).alias("value"))
    checked = good.select(
        F.when(
            F.ltrim("value").startswith("{") & F.try_parse_json("value").isNotNull(), F.col("value")
        ).otherwise(F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring("value", 1, 80)))).alias("value")
    )
    kind = T._parse_datatype_string(schema or _json_schema(checked))
    if not kind.fields:
        return texts.sparkSession.createDataFrame([], "value string").drop("value")
    return checked.select(F.from_json("value", kind, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One object a line; blank lines are skipped; a line that isn't an object fails the query.

    Columns are inferred from all lines; name a schema to read a large file once.
    """
    lines = spark.read.text(path).select(F.regexp_replace("value", "^\ufeff", "").alias("value"))
    return _objects(lines.where(r"value RLIKE '\\S'"), schema)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A single object, or an array of objects, which many tasks read."""
    head = probe(spark, path).removeprefix(b"\xef\xbb\xbf").lstrip()
    if not head.startswith(b"["):
        return spark.read.option("multiLine", True).option("encoding", "UTF-8").json(path)
    return _objects(json_array_items(prepare(spark), path), schema)


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column_number(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def xlsx_sheets(book: zipfile.ZipFile) -> dict[str, str]:
    """Sheet names and the parts that hold them."""
    rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out = {}
    for s in ET.fromstring(book.read("xl/workbook.xml")).iter(f"{_NS}sheet"):
        target = rels[s.get(_REL)]
        out[s.get("name")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return out


#: The numbers of built-in formats that show a date, a time or both.
DATE_FORMATS = frozenset({*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)})


def _shows_dates(code: str) -> bool:
    """Whether a number format has a date's or a time's letters outside of quotes and brackets."""
    bare = re.sub(r'"[^"]*"|\\.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', "", code, flags=re.I)
    return bool(re.search(r"[ymdhs]", bare, re.I)) and bare.lower() != "general"


def date_styles(book: zipfile.ZipFile) -> tuple[frozenset[int], dt.datetime]:
    """(styles of cells that show dates, the day that counts as 0)."""
    new = ET.fromstring(book.read("xl/workbook.xml")).find(f"{_NS}workbookPr")
    zero = dt.datetime(1904, 1, 1) if new is not None and new.get("date1904") in ("1", "true") else dt.datetime(1899, 12, 30)
    if "xl/styles.xml" not in book.namelist():
        return frozenset(), zero
    root = ET.fromstring(book.read("xl/styles.xml"))
    own = {int(n.get("numFmtId")) for n in root.iter(f"{_NS}numFmt") if _shows_dates(n.get("formatCode", ""))}
    cells = root.find(f"{_NS}cellXfs")
    return frozenset(i for i, x in enumerate(cells if cells is not None else ()) if int(x.get("numFmtId", 0)) in DATE_FORMATS | own), zero


def _number(text: str) -> int | float:
    return int(text) if re.fullmatch(r"-?\d+", text) else float(text)


def xlsx_rows(book: zipfile.ZipFile, part: str) -> Iterator[list[object]]:
    """The cells of each row that has any: texts, numbers, truth values, dates as texts, None where there is nothing."""
    shared: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ET.fromstring(book.read("xl/sharedStrings.xml"))]
    dates, zero = date_styles(book)
    with book.open(part) as f:
        for _, el in ET.iterparse(f):
            if el.tag != f"{_NS}row":
                continue
            row: list[object] = []
            for c in el.iter(f"{_NS}c"):
                at = _column_number(c.get("r")) if c.get("r") else len(row)
                kind, v = c.get("t"), c.find(f"{_NS}v")
                value: object = None
                if kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
                elif v is not None and v.text is not None:
                    if kind == "s":
                        value = shared[int(v.text)]
                    elif kind == "b":
                        value = v.text == "1"
                    elif kind in ("str", "e", "d"):
                        value = v.text
                    else:
                        value = _number(v.text)
                        if int(c.get("s", 0)) in dates:
                            at_time = zero + dt.timedelta(seconds=round(value * 86400))
                            value = str(at_time.time() if 0 <= value < 1 else at_time)
                row += [None] * (at - len(row)) + [value]
            el.clear()
            if any(x not in (None, "") for x in row):
                yield row


def column_types(rows: Iterator[list[object]], names: list[str]) -> T.StructType:
    """The narrowest type of each column: truth values, whole numbers, numbers, else texts."""
    seen: list[set[type]] = [set() for _ in names]
    for r in rows:
        for kinds, v in zip(seen, r, strict=False):
            if v is not None:
                # numbers beyond 64 bits stay texts
                kinds.add(str if isinstance(v, int) and not -(2**63) <= v < 2**63 else type(v))

    def kind(kinds: set[type]) -> T.DataType:
        if kinds == {bool}:
            return T.BooleanType()
        if kinds == {int}:
            return T.LongType()
        return T.DoubleType() if kinds in ({float}, {int, float}) else T.StringType()

    return T.StructType([T.StructField(n, kind(k)) for n, k in zip(names, seen, strict=True)])


def _as(value: object, kind: T.DataType) -> object:
    if isinstance(kind, T.StringType):
        return "" if value is None else str(value)
    return float(value) if isinstance(kind, T.DoubleType) and value is not None else value


class _XlsxReader(DataSourceReader):
    def __init__(self, path: str, sheet: str, schema: T.StructType):
        self.path, self.sheet, self.schema = path, sheet, schema

    def partitions(self):
        return [InputPartition(self.sheet)]

    def read(self, partition):
        kinds = [f.dataType for f in self.schema.fields]
        fs, path = file_system(self.path)
        with fs.open_input_file(path) as f, zipfile.ZipFile(f) as book:
            rows = xlsx_rows(book, xlsx_sheets(book)[partition.value])
            next(rows, None)
            for r in rows:
                yield tuple(_as(v, k) for v, k in zip((r + [None] * len(kinds))[: len(kinds)], kinds, strict=True))


class XlsxSource(DataSource):
    """``spark.read.format("xlsx_table").option("path", path).option("sheet", name)``: a sheet with its cells' types.

    Types are found by reading the sheet once, at most 1,048,576 rows, a row at a time.
    """

    @classmethod
    def name(cls) -> str:
        return "xlsx_table"

    def schema(self) -> T.StructType:
        fs, path = file_system(self.options["path"])
        with fs.open_input_file(path) as f, zipfile.ZipFile(f) as book:
            rows = xlsx_rows(book, xlsx_sheets(book)[self.options["sheet"]])
            return column_types(rows, distinct_names(["" if n is None else str(n) for n in next(rows, [])]))

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _XlsxReader(self.options["path"], self.options["sheet"], schema)


def read_xlsx(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A table for each sheet that has a header and at least one row."""
    if path.lower().endswith(".xls"):
        raise ValueError("the old .xls format isn't supported")
    spark.dataSource.register(XlsxSource)
    fs, local = file_system(path)
    with fs.open_input_file(local) as f, zipfile.ZipFile(f) as book:
        full = [name for name, part in xlsx_sheets(book).items() if sum(1 for _, _ in zip(range(2), xlsx_rows(book, part))) == 2]
    return {s: spark.read.format("xlsx_table").option("path", path).option("sheet", s).load() for s in full}


@dataclass(frozen=True)
class Unit:
    """What one dataset of a file will be, as far as its beginning tells."""

    name: str
    columns: list[str]
    header_row: int | None
    first_row: int
    #: in what the dataset is exported, and by what it is read
    format: str
    reader: str
    sheet: str | None = None


def structure(spark: SparkSession, path: str) -> list[Unit]:
    """The datasets of a file, from its first bytes; JSON names its columns only when it is read whole."""
    stem, _, suffix = path.rsplit("/", 1)[-1].rpartition(".")
    suffix = suffix.lower()
    if suffix == "csv":
        head = probe(spark, path)
        return [Unit(stem, csv_header(head, encoding_of(head)), 1, 2, "csv", "csv")]
    if suffix in ("jsonl", "json"):
        return [Unit(stem, [], None, 1, "jsonl", suffix)]
    if suffix != "xlsx":
        raise ValueError(f"files of type {suffix!r} aren't supported")
    fs, local = file_system(path)
    with fs.open_input_file(local) as f, zipfile.ZipFile(f) as book:
        tops = {name: [r for r, _ in zip(xlsx_rows(book, part), range(2))] for name, part in xlsx_sheets(book).items()}
    full = {name: distinct_names(["" if c is None else str(c) for c in top[0]]) for name, top in tops.items() if len(top) == 2}
    return [Unit(stem if len(full) == 1 else f"{stem}-{name}", columns, 1, 2, "xlsx", "xlsx", name) for name, columns in full.items()]


def read_any(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Datasets of a file, by name; a workbook's further sheets get the sheet's name behind the file's."""
    stem, _, suffix = path.rsplit("/", 1)[-1].rpartition(".")
    suffix = suffix.lower()
    if suffix in ("csv", "jsonl", "json"):
        return {stem: {"csv": read_csv, "jsonl": read_jsonl, "json": read_json}[suffix](spark, path)}
    if suffix in ("xlsx", "xls"):
        sheets = read_xlsx(spark, path)
        return {stem if len(sheets) == 1 else f"{stem}-{s}": d for s, d in sheets.items()}
    if suffix == "parquet":
        return {stem: spark.read.parquet(path)}
    raise ValueError(f"files of type {suffix!r} aren't supported")
