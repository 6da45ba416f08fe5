"""WARC archives by way of a chunked record table.

A payload travels as rows (record, chunk number, bytes) instead of one value. Each
chunk row carries the SHA-1 and the length of the payload up to its end, so that
the last chunk of a record holds its digest and no task ever joins a payload
together. Writing streams the chunks of records into archives in the shared folder,
each record a gzip member of its own as the standard recommends; reading streams
archives back into chunk rows.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasontide.llm.common import scratch, stored

CHUNK = 256 << 10
VERSION = b"WARC/1.1\r\n"
CHUNK_SCHEMA = (
    "page_id long, record_type string, refers_to long, url string, chunk int, data binary,"
    " bytes_so_far long, digest_so_far binary, last boolean, declared_digest string"
)
_ARROW = pa.schema(
    [
        ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ("url", pa.string()), ("chunk", pa.int32()), ("data", pa.binary()), ("bytes_so_far", pa.int64()),
        ("digest_so_far", pa.binary()), ("last", pa.bool_()), ("declared_digest", pa.string()),
    ]
)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_types(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Rows (page_id, url, payload, digest, size, record_type, refers_to).

    Of the records with equal payloads of ``least_bytes`` or more, that with the
    largest page_id is the response and the others revisit it. A null html is an
    empty payload. Rows that repeat a page_id with one payload are alike:
    each has its record; a null page_id comes before all others. Only page ids and
    digests are grouped; one maximum per payload is combined before the shuffle.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns(
        {"digest": F.unhex(F.sha1("payload")), "size": F.octet_length("payload").cast("long")}
    )
    keys = rows.select("page_id", "digest", "size").where(F.col("size") >= least_bytes)
    tops = keys.groupBy(F.col("digest").alias("d")).agg(F.max("page_id").alias("top"))
    typed = rows.join(tops, F.col("digest") == F.col("d"), "left").drop("d")
    revisit = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    return typed.select(
        "page_id", "url", "payload", "digest", "size",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("top")).alias("refers_to"),
    )


def _filesystem(path: str):
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _uri(path: str) -> str:
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def _clean(value: str) -> str:
    """A header value: line ends would end the header."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unclean(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def _member(out, pieces) -> None:
    """Write one gzip member, piece by piece."""
    packer = zlib.compressobj(wbits=31)
    for piece in pieces:
        out.write(packer.compress(piece))
    out.write(packer.flush())


def _slices(value: pa.Scalar, size: int):
    """A payload in chunks of the column's own memory: it isn't copied whole."""
    payload = value.as_buffer() if size else b""
    for begin in range(0, size, CHUNK):
        yield payload.slice(begin, min(CHUNK, size - begin))


def write(records: DataFrame, folder: str) -> DataFrame:
    """Write archives, one per task, and return their table (path, records, bytes).

    ``records`` are rows of ``record_types``. A revisit has headers only, and the
    digest of its payload, as the standard asks. Each attempt of a task writes a file
    of its own name, and only the files in the returned table count; the table is
    stored, so that files of lost or repeated attempts are never read.
    """
    folder = _uri(folder)

    def run(batches):
        store, base = _filesystem(folder)
        store.create_dir(base)
        name, count, out = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in batches:
            for at in range(batch.num_rows):
                if out is None:
                    out = store.open_output_stream(name, compression=None)
                page_id, url, kind, refers, size, digest = (batch.column(i)[at].as_py() for i in range(6))
                head = [
                    f"WARC-Type: {kind}",
                    f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest.hex()}')}>",
                    f"X-Page-ID: {'' if page_id is None else page_id}",
                    f"WARC-Payload-Digest: sha1:{base32(digest)}",
                    f"X-Payload-Length: {size}",
                ]
                if url is not None:
                    head.append(f"WARC-Target-URI: {_clean(url)}")
                if refers is not None:
                    head.append(f"X-Refers-To-Page: {refers}")
                body = 0 if kind == "revisit" else size
                head.append(f"Content-Length: {body}")
                begin = VERSION + "\r\n".join(head).encode() + b"\r\n\r\n"
                _member(out, itertools.chain((begin,), _slices(batch.column(6)[at], body), (b"\r\n\r\n",)))
                count += 1
        if out is not None:
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{name}"]), pa.array([count], pa.int64()), pa.array([size], pa.int64())], ["path", "records", "bytes"])

    columns = records.select("page_id", "url", "record_type", "refers_to", "size", "digest", "payload")
    return stored(columns.mapInArrow(run, "path string, records long, bytes long"), "archives")


def _header(stream) -> dict[str, str] | None:
    line = stream.readline()
    if not line:
        return None
    if line != VERSION:
        raise ValueError(f"no record begins here: {line[:40]!r}")
    found = {}
    while (line := stream.readline()) != b"\r\n":
        if not line:
            raise ValueError("a header is cut off")
        name, _, value = line[:-2].decode().partition(": ")
        found[name] = value
    return found


def read_chunks(archives: DataFrame, folder: str) -> DataFrame:
    """The chunk table of archives: one row per chunk, at least one per record.

    Chunks of a record come in order from one task; bytes_so_far and digest_so_far
    cover the payload up to the chunk's end. A revisit has one chunk without data,
    whose length and digest are those that its header declares.
    """
    folder = _uri(folder)

    def run(batches):
        store, _ = _filesystem(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(path, compression="gzip") as raw:
                    stream = _Lines(raw)
                    while (head := _header(stream)) is not None:
                        left, chunk, so_far = int(head["Content-Length"]), 0, 0
                        revisit = head["WARC-Type"] == "revisit"
                        own = hashlib.sha1()
                        base = (
                            int(head["X-Page-ID"]) if head["X-Page-ID"] else None, head["WARC-Type"],
                            int(head["X-Refers-To-Page"]) if "X-Refers-To-Page" in head else None,
                            _unclean(head["WARC-Target-URI"]) if "WARC-Target-URI" in head else None,
                        )
                        declared = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        while True:
                            data = stream.read(min(CHUNK, left))
                            left -= len(data)
                            so_far += len(data)
                            own.update(data)
                            last = left == 0
                            total = int(head["X-Payload-Length"]) if revisit else so_far
                            digest = base64.b32decode(declared) if revisit else own.copy().digest()
                            rows.append((*base, chunk, data, total, digest, last, declared))
                            held += len(data) + 500
                            if held > CHUNK * 16:
                                yield _batch(rows)
                                rows, held = [], 0
                            chunk += 1
                            if last:
                                break
                        if stream.read(4) != b"\r\n\r\n":
                            raise ValueError(f"a record of {path} doesn't end where its length says")
                if rows:
                    yield _batch(rows)

    spread = archives.select("path").repartition("path")
    return spread.mapInArrow(run, CHUNK_SCHEMA)


class _Lines:
    """Buffered lines and bytes of a stream."""

    def __init__(self, raw):
        self.raw, self.data, self.at = raw, b"", 0

    def _more(self, size: int) -> bool:
        new = self.raw.read(max(size, 1 << 16))
        self.data, self.at = self.data[self.at :] + new, 0
        return bool(new)

    def readline(self) -> bytes:
        while (end := self.data.find(b"\n", self.at)) < 0:
            if not self._more(0):
                break
        end = end + 1 if end >= 0 else len(self.data)
        line, self.at = self.data[self.at : end], end
        return line

    def read(self, size: int) -> bytes:
        while len(self.data) - self.at < size:
            if not self._more(size - (len(self.data) - self.at)):
                raise ValueError("an archive is cut off")
        found, self.at = self.data[self.at : self.at + size], self.at + size
        return found


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


def records(chunks: DataFrame) -> DataFrame:
    """One row per record from its last chunk, which has the length and digest of all; nothing is grouped."""
    return chunks.where("last").select(
        "page_id",
        F.col("bytes_so_far").alias("payload_bytes"),
        _base32_column(F.col("digest_so_far")).alias("payload_digest"),
        "record_type",
        "refers_to",
        "url",
        (_base32_column(F.col("digest_so_far")) == F.col("declared_digest")).alias("digest_holds"),
    )


def _base32_column(digest: Column) -> Column:
    """Base32 of 20 bytes: four groups of five bytes, each eight letters."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    out = []
    for group in range(4):
        number = F.conv(F.hex(F.substring(digest, group * 5 + 1, 5)), 16, 10).cast("long")
        for place in range(7, -1, -1):
            at = F.shiftright(number, 5 * place).bitwiseAND(F.lit(31).cast("long"))
            out.append(F.substring(F.lit(letters), at.cast("int") + 1, F.lit(1)))
    return F.concat(*out)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html), and read the archives back.

    An empty table gives no archives and no rows; other columns are left out.
    """
    folder = folder or scratch(pages.sparkSession, "warc")
    return records(read_chunks(write(record_types(pages), folder), folder))


ORACLE = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
t AS (SELECT html, max(page_id) AS top FROM p GROUP BY html)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, url, true AS digest_holds,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to,
  (WITH b AS (SELECT sha1(html) AS h) SELECT string_agg(
     substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
       ((('0x' || substr(h, g * 10 + 1, 10))::BIGINT >> (35 - 5 * k)) & 31)::INT + 1, 1), '' ORDER BY g, k)
   FROM b, range(4) AS x(g), range(8) AS y(k)) AS payload_digest
FROM p JOIN t USING (html)
"""
