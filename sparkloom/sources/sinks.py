"""Exports: JSON lines, CSV, XLSX and Parquet shards."""

from __future__ import annotations

import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.session import file_system
from sparkloom.functions.values import col, finite, text_of
from sparkloom.operators.order import POS, user_columns, visible

SHARD_ROWS = 100_000
#: Fixed value: rows of a sheet below its header.
SHEET_ROWS = 1_048_575
#: Fixed value: characters of a workbook's cell.
CELL_CHARS = 32_767


def _in_order(df: DataFrame) -> DataFrame:
    return df.orderBy(POS) if POS in df.columns else df


def clean_numbers(df: DataFrame) -> DataFrame:
    """NaN and infinities as null."""
    return df.withColumns({c: finite(col(c)) for c in user_columns(df) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))})


def json_lines(df: DataFrame) -> DataFrame:
    """One compact object a row, nulls included."""
    df = clean_numbers(_in_order(df))
    return df.select(F.to_json(F.struct(*(col(c) for c in user_columns(df))), {"ignoreNullFields": "false"}).alias("value"))


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    json_lines(df).write.mode(mode).text(path)


def csv_cells(df: DataFrame) -> DataFrame:
    """Cells as texts: nested values as JSON, nulls empty."""
    df = clean_numbers(_in_order(df))
    return df.select(*(F.coalesce(text_of(col(c), df.schema[c].dataType, None), F.lit("")).alias(c) for c in user_columns(df)))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    csv_cells(df).write.mode(mode).options(header=True, emptyValue="", escape='"').csv(path)


def write_shards(df: DataFrame, path: str, mode: str = "errorifexists", rows: int = SHARD_ROWS) -> None:
    clean_numbers(_in_order(df)).write.mode(mode).option("maxRecordsPerFile", rows).parquet(path)


def _cell(v: object) -> str:
    if v is None:
        return "<c/>"
    if isinstance(v, bool):
        return f'<c t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)) and abs(v) < 1e15:
        return f"<c><v>{v!r}</v></c>"
    text = "".join(ch for ch in str(v) if ch in "\t\n\r" or ord(ch) >= 32)
    if len(text) > CELL_CHARS:
        raise ValueError(f"a workbook's cell has at most {CELL_CHARS} characters, this one has {len(text)}")
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def _created(path: str):
    """A new file at a local path or a URI."""
    fs, at = file_system(path)
    return fs.open_output_stream(at, compression=None)


def write_xlsx(df: DataFrame, path: str, sheet_rows: int = SHEET_ROWS) -> None:
    """A workbook at a local path or a URI, row by row; a new sheet when one is full.

    A workbook is one file, so rows stream through the driver, a partition at a
    time; use Parquet or CSV for large tables.
    """
    df = visible(clean_numbers(_in_order(df)))
    names = df.columns
    flat = df.select(*(col(c) if isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType, T.StringType)) else text_of(col(c), df.schema[c].dataType, None).alias(c) for c in names))
    sheets, out, left = 0, None, 0
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'

    def begin(z):
        nonlocal sheets
        sheets += 1
        f = z.open(f"xl/worksheets/sheet{sheets}.xml", "w")
        f.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet {main}><sheetData><row>{"".join(map(_cell, names))}</row>'.encode())
        return f

    def end(f):
        f.write(b"</sheetData></worksheet>")
        f.close()

    with _created(path) as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
        for row in flat.toLocalIterator(prefetchPartitions=True):
            if not left:
                if out:
                    end(out)
                out, left = begin(z), sheet_rows
            try:
                out.write(f"<row>{''.join(map(_cell, row))}</row>".encode())
            except ValueError:
                out.close()  # else the error would be lost behind that of closing the book
                raise
            left -= 1
        end(out or begin(z))
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        listed = "".join(f'<sheet name="Sheet{i}" sheetId="{i}" r:id="rId{i}"/>' for i in range(1, sheets + 1))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook {main} xmlns:r="{rel}"><sheets>{listed}</sheets></workbook>')
        package = "http://schemas.openxmlformats.org/package/2006"
        links = "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, sheets + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{package}/relationships">{links}</Relationships>')
        z.writestr(
            "_rels/.rels",
            f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>'
        )
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, sheets + 1))
        z.writestr(
            "[Content_Types].xml",
            f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>'
        )


def export_format(wanted: str, original: str) -> str:
    """The format of an export; ``original`` follows the uploaded file's."""
    if wanted != "original":
        return wanted
    return {"json": "jsonl", "jsonl": "jsonl", "csv": "csv", "xls": "xlsx", "xlsx": "xlsx"}.get(original.lower(), "jsonl")
