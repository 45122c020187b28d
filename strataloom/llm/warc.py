"""WARC archives with an index first: writing, indexing, and coalesced range reads.

Each task streams its pages into archives of its own in a shared folder, one gzip member a
record, and gives an index row a record: file, offset, length, URL, digest.  The staged index is the
manifest: a file that a lost or repeated task left behind is in no index row,
so nothing reads it.  Reads sort the selected index rows by file and offset
and fetch neighbouring ranges in one request.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import fresh_path, staged
from .arrow import bound_batches

#: Revisits: a table of at most so many rows is broadcast, a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000
#: Bytes after which a task begins a new archive; ranges closer than GAP are read at once, up to READ bytes.
FILE_BYTES, GAP, READ = 1 << 30, 64 << 10, 8 << 20
INDEX = "file string, offset bigint, length bigint, page_id bigint, url string, payload_digest string, record_type string, refers_to bigint, payload_bytes bigint"
RECORD = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, payload binary"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    """The store and path of a URI; file:/x and file:///x are the same."""
    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if uri.startswith("s3a://") else uri)


def base32_sha1(body: Column) -> Column:
    """The bare upper-case base32 of the SHA-1, 32 characters."""
    digest, out = F.sha1(body), []
    for i in range(8):
        five = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(_BASE32), F.shiftright(five, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def mark_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Add payload_bytes, payload_digest, record_type and refers_to.

    Among equal payloads of at least ``least_bytes`` bytes the largest page_id is
    the response and the others revisit it; shorter ones are all responses.  Rows that share
    the largest page_id are all responses; a null page_id revisits if another row has an id,
    and is a response otherwise.  A null html is an empty payload.
    """
    body = F.coalesce("html", F.lit("")).cast("binary")
    full = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", body.alias("payload"))
    full = full.withColumns({"payload_bytes": F.octet_length("payload").cast("bigint"), "payload_digest": base32_sha1(F.col("payload"))})
    same = full.where(F.col("payload_bytes") >= least_bytes).groupBy(F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("n"))
    copies = staged(same.agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("c")).where("c > 1 and response is not null").select("d", "n", "response"), "copies")
    small = copies.count() <= BROADCAST_ROWS
    joined = full.join(F.broadcast(copies) if small else copies, (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes") == F.col("n")), "left")
    revisits = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    return joined.withColumns({
        "record_type": F.when(revisits, "revisit").otherwise("response"), "refers_to": F.when(revisits, F.col("response")), "payload": F.when(~revisits, F.col("payload")),
    }).drop("d", "n", "response")


def _record(page: dict, date: str) -> bytes:
    uri = quote(page["url"] or "", safe=":/?#[]@!$&'()*+,;=%~") or "urn:x-page:none"
    name = lambda k: f"<urn:x-page:{'none' if k is None else k}:{page['payload_digest']}>"
    head = [
        "WARC/1.1", f"WARC-Type: {page['record_type']}", f"WARC-Target-URI: {uri}", f"WARC-Date: {date}", f"WARC-Record-ID: {name(page['page_id'])}",
        f"WARC-Payload-Digest: sha1:{page['payload_digest']}", f"X-Payload-Length: {page['payload_bytes']}",
    ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % page["payload_bytes"]
    if page["record_type"] == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(page['refers_to'])}"]
        block = http
    else:
        block = http + page["payload"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _parsed(record: bytes) -> dict:
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if not version.startswith("WARC/") or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    number = lambda urn: None if (k := urn.strip("<>").split(":")[2]) == "none" else int(k)
    response = fields["WARC-Type"] == "response"
    return {
        "page_id": number(fields["WARC-Record-ID"]), "payload_bytes": int(fields["X-Payload-Length"]), "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "record_type": fields["WARC-Type"], "refers_to": None if response else number(fields["WARC-Refers-To"]), "url": fields["WARC-Target-URI"],
        "payload": block.partition(b"\r\n\r\n")[2] if response else None,
    }


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _types(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    return pa.schema([(a, kinds[b]) for a, b in (x.split() for x in schema.split(", "))])


def write_warc(pages: DataFrame, where: str | None = None, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as gzipped WARC records; returns the index.

    ``where`` is a folder that all executors share (by default a fresh one beside the
    checkpoints).  Every row becomes a record, repeated rows too; an empty table gives an
    empty index.  For nulls see ``mark_revisits``; a null url is ``urn:x-page:none``.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    folder = where or fresh_path(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _open(folder)
        store.create_dir(path, recursive=True)
        out, name, at, number = None, "", 0, 0
        run = f"{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:12]}"
        try:
            for batch in batches:
                rows = []
                for page in batch.to_pylist():
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, at, number = f"{folder}/{run}-{number:04d}.warc.gz", 0, number + 1
                        out = store.open_output_stream(_open(name)[1], compression=None)
                    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = squeeze.compress(_record(page, date)) + squeeze.flush()
                    out.write(member)
                    rows.append({"file": name, "offset": at, "length": len(member)} | {k: page[k] for k in _names(INDEX)[3:]})
                    at += len(member)
                yield pa.RecordBatch.from_pylist(rows, schema=_types(INDEX))
        finally:
            if out is not None:
                out.close()

    marked = mark_revisits(pages, least_bytes).select("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return staged(marked.mapInArrow(write, INDEX), "warc-index")


def read_warc(index: DataFrame) -> DataFrame:
    """The records that ``index`` (file, offset, length) selects, parsed; nothing else is fetched.

    Index rows are dealt out in ranges of (file, offset), so a task reads forward through
    few files.  A response's payload is checked against its digest.
    """
    bound_batches(index.sparkSession)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, int, int]]]:
        run: list[tuple[str, int, int]] = []
        for batch in batches:
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if run and (file != run[-1][0] or offset > run[-1][1] + run[-1][2] + GAP or offset + length - run[0][1] > READ):
                    yield run
                    run = []
                run.append((file, offset, length))
        if run:
            yield run

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64
        import hashlib

        name, source = None, None
        for run in runs(batches):
            if run[0][0] != name:
                if source is not None:
                    source.close()
                name = run[0][0]
                store, path = _open(name)
                source = store.open_input_file(path)
            base = run[0][1]
            data = source.read_at(run[-1][1] + run[-1][2] - base, base)
            rows = []
            for _, offset, length in run:
                page = _parsed(zlib.decompress(data[offset - base : offset - base + length], 31))
                if page["payload"] is not None and base64.b32encode(hashlib.sha1(page["payload"]).digest()).decode() != page["payload_digest"]:
                    raise ValueError(f"record at {offset} of {name} doesn't match its digest")
                rows.append(page)
            yield pa.RecordBatch.from_pylist(rows, schema=_types(RECORD))
        if source is not None:
            source.close()

    ordered = index.select("file", "offset", "length").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(read, RECORD)
