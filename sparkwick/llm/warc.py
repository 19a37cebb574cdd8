"""WARC archives of web pages: writing, normalising monolithic gzip files, reading by offset.

``write_archives`` lets Spark write one gzip stream per file, records one after another. Such a
file can only be read from its start. ``normalise`` inflates every stream once, in chunks, writes
each record again as a gzip member of its own and a sidecar index of member offsets; from then on
``read_archives`` fetches any record with one ranged read.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwick.llm.common import with_row_id

#: Payloads of fewer bytes are stored in full even if another page has the same.
REVISIT_BYTES = 1000
#: Records of a file at most.
FILE_RECORDS = 20_000
#: Bytes inflated at once.
CHUNK = 1 << 20

# Names that the WARC format defines.
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(name: str, value) -> F.Column:
    """A header line, or nothing for a null value."""
    clean = F.regexp_replace(value.cast("string"), "[\\r\\n]+", " ")
    return F.coalesce(F.concat(F.lit(f"\r\n{name}: "), clean), F.lit(""))


def write_archives(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write a record per row of ``pages`` (page_id, url, html) into gzip files in ``folder``.

    The payload is ``html`` in UTF-8 (null: empty). Of records with equal payloads of at least
    ``REVISIT_BYTES`` bytes the one with the largest page_id is a response, the others are
    revisits that refer to it; rows that repeat that page_id are responses too. A row without
    page_id can only be a revisit, or a response if no equal payload has an id. Pages carry no
    time, so all records get ``date``.
    """
    html = F.coalesce("html", F.lit(""))
    rows = with_row_id(pages.select("page_id", "url", html.alias("html")))
    light = rows.select(
        "rid", "page_id", F.sha2(F.col("html").cast("binary"), 256).alias("hash"),
        F.octet_length("html").alias("n"),
    ).where(F.col("n") >= REVISIT_BYTES)
    groups = light.groupBy("hash", "n").agg(
        F.max("page_id").alias("refers_to"), F.count("*").alias("same")
    )
    groups = groups.where("same > 1 and refers_to is not null").select("hash", "n", "refers_to")
    again = light.join(groups, ["hash", "n"]).where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    rows = rows.join(again.select("rid", "refers_to"), "rid", "left")

    size = F.octet_length("html")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        size.cast("string"),
        F.lit(END),
    )
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        _line("WARC-Record-ID", F.concat(
            F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")),
            F.lit(":"), F.col("rid").cast("string"), F.lit(">"))),
        F.lit(f"\r\nWARC-Date: {date}"),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1(F.col("html").cast("binary")))),
        _line("WARC-Page-ID", F.col("page_id")),
        F.when(revisit, F.lit(f"\r\nWARC-Profile: {PROFILE}")).otherwise(""),
        _line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(END),
    )
    # the separator that the writer puts after each line is the end of a record
    records = rows.select(F.concat(head, block).alias("value"))
    writer = records.write.option("compression", "gzip").option("lineSep", END)
    writer.option("maxRecordsPerFile", FILE_RECORDS).text(folder)


def _stream(content: bytes) -> Iterator[bytes]:
    view, stream = memoryview(content), zlib.decompressobj(31)
    for at in range(0, len(view), CHUNK):
        piece = view[at : at + CHUNK]
        while len(piece):
            if stream.eof:  # the next member
                stream = zlib.decompressobj(31)
            yield stream.decompress(piece, CHUNK)
            piece = stream.unused_data if stream.eof else stream.unconsumed_tail
    yield stream.flush()
    if not stream.eof and len(view):
        raise ValueError("the gzip stream ends early")


def inflate(content: bytes) -> Iterator[bytes]:
    """The records of a gzip file (of one or several members), inflated chunk by chunk."""
    data = bytearray()
    for piece in _stream(content):
        data += piece
        start = 0
        while (end := _record_end(data, start)) is not None:
            yield bytes(data[start:end])
            start = end
        del data[:start]
    if data:
        raise ValueError("the archive ends within a record")


def _record_end(data: bytearray, start: int) -> int | None:
    head = data.find(b"\r\n\r\n", start)
    if head < 0:
        return None
    length = int(headers(bytes(data[start:head]))["content-length"])
    end = head + 4 + length + 4
    return end if end <= len(data) else None


def headers(head: bytes) -> dict[str, str]:
    """Header fields of a record by lower-case name."""
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Rewrite the gzip archives in ``source`` member by member into ``target``.

    Every archive gets a sidecar ``.jsonl`` with offset and length of each member. Returns a row
    per archive: its name, records and bytes. A task writes to a name of its own and renames at
    the end, so a repeated or lost attempt leaves no partial archive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name = posixpath.basename(path)
                files, folder = fs.FileSystem.from_uri(target)
                files.create_dir(folder, recursive=True)
                temporary = f"{folder}/_{uuid.uuid4().hex}"
                index, at = [], 0
                with files.open_output_stream(temporary, compression=None) as out:
                    for record in inflate(content):
                        member = gzip.compress(record, 5, mtime=0)
                        out.write(member)
                        index.append({"archive": name, "offset": at, "length": len(member)})
                        at += len(member)
                with files.open_output_stream(f"{temporary}.jsonl", compression=None) as out:
                    out.write("".join(json.dumps(x) + "\n" for x in index).encode())
                files.move(temporary, f"{folder}/{name}")
                files.move(f"{temporary}.jsonl", f"{folder}/{name}.jsonl")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([len(index)]), pa.array([at])],
                    names=["archive", "records", "bytes"],
                )

    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source)
    return archives.select("path", "content").mapInArrow(
        run, "archive string, records long, bytes long"
    )


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Records of normalised archives, each fetched at its offset in the sidecar index.

    Columns: page_id, url, record_type, refers_to, payload_bytes, payload_digest (SHA-1 in lower-case
    hex, of the full payload), payload (null for a revisit). The digest of a stored payload is
    computed anew; one that differs from its header raises an error.
    """
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    schema = (
        "page_id long, url string, record_type string, refers_to long, payload_bytes long, "
        "payload_digest string, payload binary"
    )

    def parse(record: bytes) -> tuple:
        head, _, rest = record.partition(b"\r\n\r\n")
        h = headers(head)
        http, _, payload = rest[: int(h["content-length"])].partition(b"\r\n\r\n")
        digest = h["warc-payload-digest"].removeprefix("sha1:")
        page = int(h["warc-page-id"]) if "warc-page-id" in h else None
        if h["warc-type"] == "revisit":
            first = int(h["warc-refers-to"].strip("<>").rpartition(":")[2])
            size = int(headers(http)["content-length"])
            return page, h.get("warc-target-uri"), "revisit", first, size, digest, None
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"the payload of page {page} differs from its digest")
        return page, h.get("warc-target-uri"), "response", None, len(payload), digest, payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            rows, size = [], 0
            for archive, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive != name:
                    files, base = fs.FileSystem.from_uri(folder)
                    name, source = archive, files.open_input_file(f"{base}/{archive}")
                rows.append(parse(gzip.decompress(source.read_at(length, offset))))
                size += rows[-1][4]
                if size > 16 * CHUNK:
                    yield _table(rows, kinds, schema)
                    rows, size = [], 0
            if rows:
                yield _table(rows, kinds, schema)

    index = spark.read.schema("archive string, offset long, length long").json(
        folder, pathGlobFilter="*.jsonl"
    )
    return index.select("archive", "offset", "length").mapInArrow(run, schema)


def _table(rows: list[tuple], kinds: list, schema: str) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
        names=[f.split()[0] for f in schema.split(", ")],
    )
