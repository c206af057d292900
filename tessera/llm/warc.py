"""WARC archives as chunked record tables.

A record is a gzip member cut into rows (record_id, chunk, chunks, data, sha1): chunk by chunk the payload is sliced, hashed and
compressed, so no task holds a second copy of a record, however large. sha1 is the digest of the payload up to and
with that chunk; the last one is the payload's. The rows of an archive in the order (record_id, chunk), their data end
to end, are a valid .warc.gz file. Reading streams the rows through a decompressor and a header parser.

Payloads are written where they are read. Only digests and ids are grouped to find equal payloads; a filter of fixed size has their
digests, and what it lets through, copies and a few others, is joined with the page they refer to. Records of one chunk are read where they lie;
only the chunks of larger ones are brought together.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.filters import bit_filter, passes
from tessera.llm.shared import written

CHUNK, LEAST, ROWS = 1 << 18, 1000, 256
TABLE = "record_id string, chunk long, chunks long, data binary, sha1 string"
_READ = "record_id string, page_id string, uri string, record_type string, refers_to string, payload_bytes long, payload_digest string, intact boolean"


def copies_of(src: DataFrame, least: int) -> DataFrame:
    """digest, kept: of payloads of at least `least` bytes that occur twice or more, the largest page_id; from page_id, digest, size."""
    return src.where(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n")


def payloads(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    """page_id, url, html (bytes; null is the empty payload), digest, size."""
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    return pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), body.alias("html"), F.sha1(body).alias("digest"), F.length(body).cast("long").alias("size"))


def classified(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST) -> DataFrame:
    """page_id, url, html, digest, size, refers_to: of equal payloads of at least `least` bytes the largest page_id is kept, others refer to it.

    Null html is the empty payload. Smaller payloads, and all rows with the kept page_id, refer to none. A null page_id is never kept beside others.
    """
    src = payloads(pages, page_id, url, html)
    names = src.columns
    copies = written(copies_of(src, least), "copies")
    bits = F.conv(F.substring("digest", 1, 15), 16, 10).cast("long")
    shared = pages.sparkSession.sparkContext.broadcast(bit_filter(copies.select(bits.alias("bits")), "bits"))

    def chosen(wanted: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bits = np.array([int(d[:15], 16) for d in batch.column(3).to_pylist()], np.int64)
                big = batch.column(4).to_numpy() >= least
                yield batch.filter(pa.array((big & passes(shared.value, bits)) == wanted))

        return src.mapInArrow(run, src.schema)

    other = ~F.col("page_id").eqNullSafe(F.col("kept")) & F.col("kept").isNotNull()
    joined = chosen(True).join(copies, "digest", "left").select(*names, F.when(other, F.col("kept")).alias("refers_to"))
    return chosen(False).withColumn("refers_to", F.lit(None).cast(src.schema["page_id"].dataType)).union(joined)


def _header(kind: str, record_id: str, page_id: str | None, url: str | None, digest: str, size: int, refers_to: str | None, block: int) -> bytes:
    b32 = base64.b32encode(bytes.fromhex(digest)).decode()
    clean = lambda s: s.replace("\r", "%0D").replace("\n", "%0A")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{record_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{b32}"), ("WARC-Payload-Length", str(size)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(block))]
    fields += [(k, clean(v)) for k, v in (("WARC-Target-URI", url), ("WARC-Page-ID", page_id), ("WARC-Refers-To-Page-ID", refers_to)) if v is not None]
    if kind == "revisit":
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def record_chunks(record_id: str, page_id: str | None, url: str | None, payload: memoryview, digest: str, refers_to: str | None, chunk: int = CHUNK) -> Iterator[tuple[int, int, bytes, str]]:
    """(chunk number, how many there are, bytes of the gzip member, digest so far); a revisit has headers only."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    stored = payload if refers_to is None else payload[:0]
    pack, sha = zlib.compressobj(1, zlib.DEFLATED, 31), hashlib.sha1()
    head = pack.compress(_header(kind, record_id, page_id, url, digest, len(payload), refers_to, len(http) + len(stored)) + http)
    last = max(0, -(-len(stored) // chunk) - 1)
    for k in range(last + 1):
        part = stored[k * chunk : (k + 1) * chunk]
        sha.update(part)
        data = head + pack.compress(part) if k == 0 else pack.compress(part)
        if k == last:
            data += pack.compress(b"\r\n\r\n") + pack.flush()
        yield k, last + 1, data, sha.hexdigest() if refers_to is None else digest


def write(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", chunk: int = CHUNK) -> DataFrame:
    """The chunk rows of an archive with a record for each page."""
    src = classified(pages, page_id, url, html).select(F.col("page_id").cast("string"), "url", "html", "digest", F.col("refers_to").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, rows, held = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                pid, link, digest, ref = (batch.column(k)[i].as_py() for k in (0, 1, 3, 4))
                record_id = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{part}/{n}/{pid}/{digest}"))
                n += 1
                for k, of, data, sha in record_chunks(record_id, pid, link, memoryview(batch.column(2)[i].as_buffer()), digest, ref, chunk):
                    rows.append((record_id, k, of, data, sha))
                    held += len(data)
                    if len(rows) >= ROWS or held > 4 * chunk:
                        yield _rows(rows, _CHUNKS)
                        rows, held = [], 0
        if rows:
            yield _rows(rows, _CHUNKS)

    return src.mapInArrow(run, TABLE)


_CHUNKS = pa.schema([("record_id", pa.string()), ("chunk", pa.int64()), ("chunks", pa.int64()), ("data", pa.binary()), ("sha1", pa.string())])
_RECORDS = pa.schema([(c, pa.string()) for c in ("record_id", "page_id", "uri", "record_type", "refers_to")] + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("intact", pa.bool_())])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class Reader:
    """Takes the chunks of one record in order; keeps headers and a running digest, never the payload."""

    def __init__(self, record_id: str):
        self.record_id, self.unpack, self.sha, self.head, self.size, self.stage, self.fields = record_id, zlib.decompressobj(31), hashlib.sha1(), b"", 0, 0, {}

    def feed(self, data: bytes) -> None:
        data = self.unpack.decompress(data)
        while self.stage < 2:
            self.head += data
            cut = self.head.find(b"\r\n\r\n")
            if cut < 0:
                return
            if self.stage == 0:
                lines = self.head[:cut].decode().split("\r\n")
                if not lines[0].startswith("WARC/1."):
                    raise ValueError("no WARC record starts here")
                name = ""
                for x in lines[1:]:
                    if x[:1] in (" ", "\t"):  # a header goes on
                        self.fields[name] += " " + x.strip()
                    else:
                        name, _, value = x.partition(":")
                        name = name.strip().lower()
                        self.fields[name] = value.strip()
            else:
                self.left = int(self.fields["content-length"]) - cut - 4
            data, self.head, self.stage = self.head[cut + 4 :], b"", self.stage + 1
        body = data[: self.left]
        self.left -= len(body)
        self.size += len(body)
        self.sha.update(body)

    def row(self) -> tuple:
        f = self.fields
        said = f.get("warc-payload-digest", "").removeprefix("sha1:")
        said = base64.b32decode(said).hex() if len(said) == 32 else said.lower()  # written in base 32 or in hex
        kind = f["warc-type"]
        size, digest = (self.size, self.sha.hexdigest()) if kind == "response" else (int(f.get("warc-payload-length", 0)), said)
        return self.record_id, f.get("warc-page-id"), f.get("warc-target-uri"), kind, f.get("warc-refers-to-page-id"), size, digest, self.unpack.eof and (not said or digest == said) and self.left == 0


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, rows = None, []
    for batch in batches:
        for record_id, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if now is None or now.record_id != record_id:
                if now is not None:
                    rows.append(now.row())
                now = Reader(record_id)
            now.feed(data.as_py())
        if rows:
            yield _rows(rows, _RECORDS)
            rows = []
    if now is not None:
        yield _rows([*rows, now.row()], _RECORDS)


def read(table: DataFrame) -> DataFrame:
    """A row for each record of a chunk table: its headers, the payload's bytes and digest as read, and whether both are intact."""
    alone = table.where("chunks = 1").select("record_id", "data")
    cut = table.where("chunks > 1").select("record_id", "chunk", "data").repartition("record_id").sortWithinPartitions("record_id", "chunk").select("record_id", "data")
    return alone.mapInArrow(_records, _READ).union(cut.mapInArrow(_records, _READ))


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes the archive to the shared folder, reads it back, and returns page_id, payload_bytes, payload_digest, record_type, refers_to, intact."""
    kind = pages.schema[page_id].dataType
    return read(written(write(pages, page_id, url, html), "archive")).select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "intact")
