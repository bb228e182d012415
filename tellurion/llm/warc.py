"""WARC archives through a chunked record table.

Writing: each payload is cut into chunk rows (record, chunk number, bytes) by
the engine, so no Python worker ever holds a whole payload. A worker writes the
records of its partition to one archive, chunk after chunk, with a running
SHA-1 that must come out as the header says. Archives get a name of their own for
each attempt; the manifest lists only those of attempts that were committed.

Reading: archives are parsed as streams. Each record gives chunk rows again, and each
row carries the size and digest of the payload so far; the last row's are the payload's.

Of records with equal payloads, that with the largest page_id is the response;
the others are revisits, which refer to it and carry no payload.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellurion.llm.common import BROADCAST_ROWS, bounded, land, run_dir, table, text_of

#: Bytes of a chunk; a batch of rows holds a thousand chunks at most.
CHUNK = 64 * 1024
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = "page_id long, record_type string, refers_to long, chunk int, data binary, last boolean, payload_bytes long, payload_digest string"


def record_uri(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(uri: str) -> int | None:
    own = uri.strip("<>").rsplit(":", 1)[-1]
    return None if own == "null" else int(own)


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def roles(pages: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """Rows (page_id, key, refers_to) of the revisits only; payloads are compared by SHA-256."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.sha2(text_of(payload_col).cast("binary"), 256).alias("key"))
    groups = rows.groupBy("key").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rows.join(groups.select("key", "refers_to"), "key").filter("page_id != refers_to").select("page_id", "key", "refers_to")


def chunk_rows(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, chunk: int = CHUNK, revisits: DataFrame | None = None) -> DataFrame:
    """The chunked record table of what is to be written, a record's chunks in order and together."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), text_of(payload_col).cast("binary").alias("payload"))
    if revisits is None:
        rows = rows.withColumn("refers_to", F.lit(None).cast("long"))
    else:
        rows = rows.withColumn("key", F.sha2("payload", 256)).join(revisits, ["page_id", "key"], "left")
    rows = rows.withColumn("n_bytes", F.octet_length("payload").cast("long")).withColumn("sha1", F.sha1("payload"))
    rows = rows.withColumn("refers_to", F.when(F.col("n_bytes") >= least_bytes, F.col("refers_to")))
    rows = rows.withColumn("n_chunks", F.when(F.col("refers_to").isNotNull(), 1).otherwise(F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / chunk))).cast("int"))
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
    data = F.when(F.col("refers_to").isNull(), F.substring("payload", F.col("chunk") * chunk + 1, F.lit(chunk)))
    return rows.select("page_id", "url", "refers_to", "n_bytes", "sha1", "n_chunks", "chunk", data.alias("data"))


def _open(uri: str, mode: str):
    """A file of the shared folder, wherever pyarrow's file systems reach."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        uri = f"file://{uri}"
    system, path = fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)
    if mode == "w":
        system.create_dir(path.rpartition("/")[0], recursive=True)
        return system.open_output_stream(path, compression=None)
    return system.open_input_stream(path, compression=None, buffer_size=CHUNK)


def _heads(page_id, url, refers_to, n_bytes, sha1) -> tuple[bytes, bytes]:
    """The WARC header and the HTTP header that stands before the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_uri(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {' '.join(url.split())}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{base32(sha1)}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_uri(refers_to)}"]
    lines.append(f"Content-Length: {len(http) + (n_bytes if refers_to is None else 0)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n", http


def write(chunks: DataFrame, folder: str) -> DataFrame:
    """Write chunk rows to archives under ``folder``; returns the manifest (archive, records), landed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, zipped, records, sha = f"{folder}/archives/{uuid.uuid4().hex}.warc.gz", None, None, 0, None
        for b in batches:
            cols = [b.column(i) for i in range(b.num_columns)]
            for k in range(b.num_rows):
                page_id, url, refers_to, n_bytes, sha1, n_chunks, chunk = (c[k].as_py() for c in cols[:7])
                if chunk == 0:
                    out = out or _open(name, "w")
                    zipped, sha = gzip.GzipFile(fileobj=out, mode="wb", compresslevel=1, mtime=0), hashlib.sha1()
                    for head in _heads(page_id, url, refers_to, n_bytes, sha1):
                        zipped.write(head)
                if refers_to is None:
                    data = cols[7][k].as_buffer()
                    zipped.write(data)
                    sha.update(data)
                if chunk == n_chunks - 1:
                    if refers_to is None and sha.hexdigest() != sha1:
                        raise ValueError(f"page {page_id}: chunks don't make up the payload")
                    zipped.write(b"\r\n\r\n")
                    zipped.close()
                    records += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64())], ["archive", "records"])

    return land(chunks.mapInArrow(bounded(run), "archive string, records long"), f"{folder}/manifest")



def parse(f, chunk: int = CHUNK) -> Iterator[tuple]:
    """Chunk rows of an archive, read as a stream; see ``CHUNKS`` for the columns."""
    while version := f.readline():
        if not version.strip():
            continue
        if not version.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        head = {}
        while (line := f.readline().strip()):
            k, _, v = line.decode().partition(":")
            head[k.lower()] = v.strip()
        left, inner = int(head["content-length"]), None
        while (line := f.readline()):
            left -= len(line)
            if not line.strip():
                break
            if line.lower().startswith(b"content-length:"):
                inner = int(line.split(b":", 1)[1])
        kind, page = head["warc-type"], page_of(head["warc-record-id"])
        refers = page_of(head["warc-refers-to"]) if "warc-refers-to" in head else None
        sha, size, k = hashlib.sha1(), 0, 0
        while left > 0:
            data = f.read(min(chunk, left))
            if not data:
                raise ValueError(f"page {page}: the archive ends in the record")
            left -= len(data)
            size += len(data)
            sha.update(data)
            if left:
                yield page, kind, refers, k, data, False, size, base64.b32encode(sha.digest()).decode()
                k += 1
            else:
                last = data
        if kind == "revisit":
            yield page, kind, refers, 0, b"", True, inner, head["warc-payload-digest"].removeprefix("sha1:")
        else:
            digest = base64.b32encode(sha.digest()).decode()
            if digest != head["warc-payload-digest"].removeprefix("sha1:"):
                raise ValueError(f"page {page}: the payload doesn't have its digest")
            yield page, kind, refers, k, last if size else b"", True, size, digest


def read(manifest: DataFrame, data: bool = True, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table of the archives in ``manifest``; without ``data``, the rows carry no bytes."""
    schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk", pa.int32()), ("data", pa.binary()), ("last", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                with _open(name, "r") as raw, gzip.GzipFile(fileobj=raw, mode="rb") as f:
                    rows: list[tuple] = []
                    size = 0
                    for row in parse(f, chunk):
                        rows.append(row if data else (*row[:4], None, *row[5:]))
                        size += len(row[4]) if data else 64
                        if size >= 8 * chunk:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    n = max(1, manifest.count())
    return manifest.select("archive").repartition(n, "archive").mapInArrow(bounded(run), CHUNKS)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Write all pages, read the archives back; per page: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null payloads are empty ones and null urls empty urls. Pages with a null
    page_id are responses, and none refers to them. Rows that repeat a page_id
    and payload share their type. An empty table gives an empty result; other
    columns play no part.
    """
    spark = pages.sparkSession
    folder = run_dir(spark, "warc")
    revisits = land(roles(pages, id_col, payload_col).distinct(), f"{folder}/revisits")
    if revisits.count() <= BROADCAST_ROWS:
        revisits = F.broadcast(revisits)
    manifest = write(chunk_rows(pages, id_col, url_col, payload_col, least_bytes, chunk, revisits), folder)
    return read(manifest, data=False, chunk=chunk).filter("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_warc(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


# SHA-1 in base32: the digest's bits in fives, each by its place in the alphabet.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
n AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, max(page_id) OVER (PARTITION BY html) AS top,
  array_to_string(list_transform(range(32), lambda i:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((('0x' || hex[1 + (i // 4) * 5 : 5 + (i // 4) * 5])::BIGINT >> (15 - 5 * (i % 4))) & 31)]), '') AS payload_digest FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to FROM n
"""
