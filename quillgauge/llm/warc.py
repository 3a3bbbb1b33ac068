"""Web archives: pages out to WARC 1.1 files, and back as one nested row per capture.

A page gives a transaction of three records: a request, a response (or a revisit, where an equal
payload is archived already) and a metadata record. Request and metadata name the response in
``WARC-Concurrent-To``. Files are written and read by Spark alone, so any store that Spark reaches
will do; they are gzipped, and each holds at most ``records_per_file`` records and is parsed record by
record.

Reading joins the three kinds of records through the concurrent-to identifiers. A revisit names the
record it refers to, which the metadata records resolve to its page.

Edge cases: a null or empty html is an empty payload, which takes part in the search for equal
payloads if ``least_bytes`` is 0; a null url is an empty target; a null page id is later than any
other; pages that repeat whole are captures of their own, in equal records but for their ids; pages
that repeat the smallest id of a payload are all responses; an empty table gives no files and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgauge.session import scratch_path

VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CRLF = "\r\n"
_END = "\r\n\r\n"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5('|'.join(parts).encode(), usedforsecurity=False).digest())}>"


def _record(fields: list[tuple[str, str]], block: str) -> str:
    head = [VERSION, *(f"{name}: {value}" for name, value in fields), f"Content-Length: {len(block.encode())}"]
    return _CRLF.join(head) + _END + block


def _line(text: str) -> str:
    """A header value: no line may end inside it."""
    return text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def transaction(page_id: int | None, url: str, html: str, capture: str, original: str | None) -> list[str]:
    """The request, the response or revisit, and the metadata record of a page.

    ``capture`` names the transaction; ``original`` is the capture that a revisit refers to.
    """
    target = _line(url)
    payload = html.encode()
    own = _id("response", capture)
    about = [("WARC-Date", DATE), ("WARC-Target-URI", target)]
    host, _, path = target.partition("://")[2].partition("/")
    request = _record(
        [("WARC-Type", "request"), ("WARC-Record-ID", _id("request", capture)), ("WARC-Concurrent-To", own), *about,
         ("Content-Type", "application/http; msgtype=request")],
        f"GET /{path} HTTP/1.1{_CRLF}Host: {host}{_END}",
    )
    kind = [("WARC-Type", "response")]
    if original is not None:
        kind = [("WARC-Type", "revisit"), ("WARC-Profile", PROFILE), ("WARC-Refers-To", _id("response", original))]
    digest = base32(hashlib.sha1(payload, usedforsecurity=False).digest())
    head = f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: {len(payload)}{_END}"
    response = _record(
        [*kind, ("WARC-Record-ID", own), *about, ("WARC-Payload-Digest", f"sha1:{digest}"),
         ("Content-Type", "application/http; msgtype=response")],
        head if original is not None else head + html,
    )
    metadata = _record(
        [("WARC-Type", "metadata"), ("WARC-Record-ID", _id("metadata", capture)), ("WARC-Concurrent-To", own), *about,
         ("Content-Type", "application/warc-fields")],
        "" if page_id is None else f"page-id: {page_id}{_CRLF}",
    )
    return [request, response, metadata]


def _capture(page_id: Column, digest: Column) -> Column:
    return F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("-")), digest)


def write(
    pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html",
    least_bytes: int = 0, records_per_file: int = 6000,
) -> None:
    """Write the archives of (page_id, url, html) to the folder ``path``."""
    base = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.coalesce(url, F.lit("")).alias("url"),
        F.coalesce(html, F.lit("")).alias("html"),
    ).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    captures = base.select("page_id", "digest", _capture(F.col("page_id"), F.col("digest")).alias("capture"), F.octet_length("html").alias("n"))
    # Equal payloads and the first page of each; min() passes over null ids.
    first = captures.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("n").alias("n"), F.count("*").alias("c"))
    again = first.filter((F.col("c") > 1) & (F.col("n") >= least_bytes))
    later = captures.select("page_id", "digest", "capture").distinct().join(again, "digest")
    later = later.filter(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
    later = later.select("capture", F.concat(_capture(F.col("first"), F.col("digest")), F.lit("|1")).alias("original"))
    same = Window.partitionBy("capture").orderBy("url")
    wide = base.withColumn("capture", _capture(F.col("page_id"), F.col("digest"))).drop("digest")
    wide = wide.withColumn("copy", F.row_number().over(same)).join(later, "capture", "left")

    def records(stream) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "html", "capture", "copy", "original")]
            for at in range(0, batch.num_rows, 256):
                lists = [c.slice(at, 256).to_pylist() for c in columns]
                out = [r for p, u, h, c, n, o in zip(*lists, strict=True) for r in transaction(p, u, h, f"{c}|{n}", o)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    # The writer ends every record with two line breaks, as the format asks.
    wide.mapInArrow(records, "value string").write.option("lineSep", _END).option("maxRecordsPerFile", records_per_file).option("compression", "gzip").text(path)


def parse(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """The fields (names in lower case) and the block of every record, one record at a time."""
    while first := stream.readline():
        if first.rstrip().decode() != VERSION:
            raise ValueError(f"no record begins with {first[:40]!r}")
        fields = {}
        while line := stream.readline().rstrip(b"\r\n"):
            name, _, value = line.decode().partition(":")
            fields[name.lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {fields.get('warc-record-id')} does not end where its length says")
        yield fields, block


def http_parts(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = block.partition(b"\r\n\r\n")
    lines = head.decode().split(_CRLF)[1:]
    return {n.lower(): v.strip() for n, _, v in (line.partition(":") for line in lines)}, body


def _unline(text: str) -> str:
    return text.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


_KINDS = {
    "response": (
        "record_id string, record_type string, url string, refers_to_id string, payload_digest string, payload_bytes long, payload binary",
        ("response", "revisit"),
    ),
    "request": ("record_id string, concurrent_to string, head string", ("request",)),
    "metadata": ("record_id string, concurrent_to string, page_id long", ("metadata",)),
}


def _row(kind: str, fields: dict[str, str], block: bytes) -> tuple:
    if kind == "request":
        return fields["warc-record-id"], fields["warc-concurrent-to"], block.decode()
    if kind == "metadata":
        found = dict(line.split(": ", 1) for line in block.decode().split(_CRLF) if line)
        return fields["warc-record-id"], fields["warc-concurrent-to"], int(found["page-id"]) if "page-id" in found else None
    head, body = http_parts(block)
    whole = fields["warc-type"] == "response"
    if whole and base32(hashlib.sha1(body, usedforsecurity=False).digest()) != fields["warc-payload-digest"][5:]:
        raise ValueError(f"payload of {fields['warc-record-id']} does not have its digest")
    return (
        fields["warc-record-id"], fields["warc-type"], _unline(fields["warc-target-uri"]), fields.get("warc-refers-to"),
        fields["warc-payload-digest"][5:], int(head["content-length"]), body if whole else None,
    )


def records(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The records of one kind (response, request or metadata) of the archives under ``path``."""
    schema, types = _KINDS[kind]
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[part.split()[1]] for part in schema.split(", ")]

    def run(stream) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for content in batch.column(0):
                rows: list[tuple] = []
                packed = io.BytesIO(content.as_py())
                for fields, block in parse(io.BufferedReader(gzip.GzipFile(fileobj=packed), 1 << 16)):
                    if fields["warc-type"] in types:
                        rows.append(_row(kind, fields, block))
                    if len(rows) == 512:
                        yield batch_of(rows)
                        rows = []
                yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, schema)


def captures(spark: SparkSession, path: str) -> DataFrame:
    """(response, request, metadata): a nested row per capture, joined through concurrent-to."""
    answers = records(spark, path, "response").select(F.struct("*").alias("response"))
    asked = records(spark, path, "request").select(F.struct("*").alias("request"))
    about = records(spark, path, "metadata").select(F.struct("*").alias("metadata"))
    joined = answers.join(asked, F.col("response.record_id") == F.col("request.concurrent_to"), "left")
    return joined.join(about, F.col("response.record_id") == F.col("metadata.concurrent_to"), "left")


def referred_pages(spark: SparkSession, path: str) -> DataFrame:
    """(refers_to_id, refers_to): the page of every record that a revisit can refer to."""
    about = records(spark, path, "metadata")
    return about.select(F.col("concurrent_to").alias("refers_to_id"), F.col("page_id").alias("refers_to"))


def archive(pages: DataFrame, path: str | None = None, **how) -> str:
    """Write ``pages`` and return the folder, by default a new one in the shared scratch folder."""
    path = path or scratch_path(pages.sparkSession, "warc")
    write(pages, path, **how)
    return path
