"""WARC archives: a writer with revisit records and a splittable reader.

The writer turns rows into records, one gzip member each, in files of the
shared folder.  Of records with equal payloads of at least ``min_bytes``, that
with the largest id is a response; the others are revisits that name it and
carry no payload.

The reader cuts each file into byte ranges, as Spark does for text.  A task
looks for gzip magic in its range, takes a place as the start of a member only
if decoding there yields a WARC version line and a whole header block, and owns
the records that start inside its range; the last of them may end beyond it.
False magic inside compressed data fails that validation.

Defined cases: a null payload is empty.  Rows with a null id write records
without an id and are revisits only of a record with one; equal payloads whose
ids are all null are all responses.  Rows that repeat the largest id are all
responses.  No rows give archives without records and an empty result.  A very
long payload is one record, held whole by its task.  Extra columns aren't
archived, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import new_folder, stored
from .skew import join_unique

#: Fixed values of the format.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SPLIT_BYTES = 16 << 20
CHUNK = 1 << 20
LEVEL = 4
MIN_BYTES = 0

RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def with_roles(df: DataFrame, id_col: str, url: str, html: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """id, url, payload and first: the id of the response that holds an equal payload."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload")))
    if min_bytes:
        rows = rows.withColumn("sha", F.when(F.length("payload") >= min_bytes, F.col("sha")))
    # the winners need no payloads: map-side sums keep a hot payload small
    top = rows.where("sha IS NOT NULL").groupBy("sha").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # payloads with many copies stay dealt out by their ids
    return join_unique(rows, stored(top, "roles"), ["sha"], F.xxhash64("id", "url"), how="left").select("id", "url", "payload", "first")


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    """A record as one gzip member."""
    revisit = first is not None and page_id != first
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    body = b"" if revisit else payload
    head = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        "WARC-Record-ID: <urn:page:" + ("none" if page_id is None else str(page_id)) + ">",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/octet-stream",
        f"Content-Length: {len(body)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~-._"))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{first}>"]
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + z.flush()


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Writes an archive for each partition of rows (id, url, payload, first); returns (path, size).

    A task writes under the name of its attempt and returns that name, so a task
    that runs twice leaves a file that nobody reads, and never half of one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        fs.create_dir(root, recursive=True)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        size = 0
        with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
            for b in batches:
                for page_id, url, payload, first in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                    z = record(page_id, url, payload, first)
                    size += len(z)
                    out.write(z)
        yield pa.RecordBatch.from_pydict({"name": [name], "size": pa.array([size], pa.int64())})

    return rows.select("id", "url", "payload", "first").mapInArrow(run, "name string, size long")


class _Window:
    """Bytes of a file from some place on, read in chunks as far as they are asked for."""

    def __init__(self, f, at: int, size: int):
        self.f, self.base, self.size, self.data = f, at, size, b""

    def upto(self, end: int) -> None:
        have = self.base + len(self.data)
        if end > have and have < self.size:
            self.f.seek(have)
            self.data += self.f.read(min(max(end - have, CHUNK), self.size - have))

    def forget(self, at: int) -> None:
        if at - self.base > CHUNK:
            self.data = self.data[at - self.base :]
            self.base = at

    def find(self, at: int, end: int) -> int:
        """The first magic that begins in at..end-1, or -1."""
        while at < end:
            self.upto(min(at + CHUNK, end) + len(MAGIC))
            i = self.data.find(MAGIC, at - self.base, min(end + len(MAGIC) - 1 - self.base, len(self.data)))
            if i >= 0:
                return self.base + i
            at = max(at + 1, self.base + len(self.data) - len(MAGIC) + 1)
            self.forget(at)
        return -1


def member(win: _Window, at: int) -> tuple[bytes, int] | None:
    """(content, end) of the gzip member at a place, or None if no WARC record is there."""
    z, out, pos, checked = zlib.decompressobj(31), bytearray(), at, False
    try:
        while not z.eof:
            win.upto(pos + 65536)
            piece = win.data[pos - win.base : pos - win.base + 65536]
            if not piece:
                return None
            out += z.decompress(piece)
            pos += len(piece)
            if not checked and len(out) >= 8:
                if not out.startswith(b"WARC/"):
                    return None
                checked = True
    except zlib.error:
        return None
    if not checked or b"\r\n\r\n" not in out:
        return None
    return bytes(out), pos - len(z.unused_data)


def parse(content: bytes) -> dict[str, object]:
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])

    def page(value: str | None) -> int | None:
        n = (value or "").removeprefix("<urn:page:").removesuffix(">")
        return int(n) if n.lstrip("-").isdigit() else None

    payload, kind = rest[: int(fields["Content-Length"])], fields["WARC-Type"]
    size, digest = int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (size, digest) != (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} isn't the one that was written")
    return {
        "page_id": page(fields.get("WARC-Record-ID")),
        "url": fields.get("WARC-Target-URI"),
        "record_type": kind,
        "refers_to": page(fields.get("WARC-Refers-To")),
        "payload_bytes": size,
        "payload_digest": digest,
        "payload": payload,
    }


def read_archives(spark: SparkSession, folder: str, files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of archives: files has (name, size); one row a record."""
    splits = files.where("size > 0").select("name", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    # each split is a few bytes of description, dealt out evenly
    splits = splits.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        schema = pa.schema(
            [
                ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
                ("payload_digest", pa.string()), ("payload", pa.binary())
            ]
        )
        for b in batches:
            for name, size, start in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                with fs.open_input_file(f"{root}/{name}") as f:
                    win, at, end = _Window(f, start, size), start, min(start + split_bytes, size)
                    found, held = [], 0
                    while (at := win.find(at, end)) >= 0:
                        got = member(win, at)
                        if got is None:
                            at += 1
                            continue
                        found.append(parse(got[0]))
                        held += len(got[0])
                        at = got[1]
                        win.forget(at)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(found, schema)
                            found, held = [], 0
                    if found:
                        yield pa.RecordBatch.from_pylist(found, schema)

    return splits.mapInArrow(run, RECORD)


def round_trip(df: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes df as archives and reads them back, payloads included."""
    spark = df.sparkSession
    folder = new_folder(spark, "warc")
    # the list of files is written with the archives: a lost executor can't change it later
    listing = f"{folder}-files"
    write_archives(with_roles(df, id_col, url, html, min_bytes), folder).write.parquet(listing)
    return read_archives(spark, folder, spark.read.schema("name string, size long").parquet(listing))


def archive_report(df: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """For each page, what the archive says of it; response payloads are checked against their digests."""
    got = round_trip(df, min_bytes=min_bytes)
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
