"""WARC archives: a writer with one gzip member per record, and a sequential reader.

The writer's tasks each write one archive into the shared folder and report it
as a row; only archives of tasks that ended well are in the manifest, so a
task that is run again leaves no double records. The reader streams an archive
through incremental zlib, frames records by Content-Length and verifies block
and payload digests; memory is bounded by one record. An archive that reaches
ROLL_BYTES is closed and the task begins another. Every record has a unique
WARC-Record-ID and a WARC-Date, the time of the write; a page's id stands in a
header of its own, and a revisit names its response's URL, date and page.

Edge cases: a null payload is an empty one; a null id or url leaves its header
out, and null ids rank after all others; repeated rows with the same id are
each written (all of them responses when theirs is the smallest id of the
payload); an empty table gives no archives and no records; further columns
are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import file_system, new_path, small_batches, stored, table

#: Payloads below this many bytes are never revisits.
MIN_REVISIT_BYTES = 100
#: Bytes after which a task goes on in a new archive; a reader's task takes one archive.
ROLL_BYTES = 1 << 30
#: Rows of the list of revisits, and bytes of their URLs and digests, up to which it is broadcast; beyond either, the pages are shuffled to it.
BROADCAST, BROADCAST_BYTES = 100_000, 32 << 20
_READ = 1 << 16
#: Headers of our own for a page's id and for the id of the page whose response a revisit repeats.
_PAGE, _REFERS = "X-Page-ID", "X-Refers-To-Page-ID"
_MANIFEST = "path string, records long"
_RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload string, archive string, offset long"


def _member(kind: str, date: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    sha = base64.b32encode(hashlib.sha1(block).digest()).decode()
    own = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}"]
    lines = ["WARC/1.1", *own, *(f"{k}: {v}" for k, v in headers), f"WARC-Block-Digest: sha1:{sha}", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def _uri(url: str) -> str:
    return quote(url, safe="!#$&'()*+,/:;=?@[]~")


def _write_part(folder: str, date: str, roll: int):
    def run(batches: Iterator) -> Iterator:
        import pandas as pd
        from pyspark import TaskContext

        t = TaskContext.get()
        out, done, n, size = None, [], 0, 0
        has = lambda x: x is not None and x == x

        def close():
            nonlocal out, n, size
            out.close()
            done.append((path, n))
            out, n, size = None, 0, 0

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if out is None:
                    path = f"{folder}/part-{t.partitionId():05d}-{t.taskAttemptId()}-{len(done):05d}.warc.gz"
                    fs, at = file_system(path)
                    fs.create_dir(os.path.dirname(at), recursive=True)
                    out = fs.open_output_stream(at, compression=None)
                    out.write(_member("warcinfo", date, [("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                body = (r.payload or "").encode() if isinstance(r.payload, str) else b""
                h = []
                if has(r.page_id):
                    h.append((_PAGE, str(int(r.page_id))))
                if isinstance(r.url, str):
                    h.append(("WARC-Target-URI", _uri(r.url)))
                h += [("WARC-Payload-Digest", f"sha256:{r.digest}"), ("Content-Type", "application/http; msgtype=response")]
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                if has(r.refers_to):
                    h += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), (_REFERS, str(int(r.refers_to))), ("WARC-Refers-To-Date", date)]
                    if isinstance(r.refers_url, str):
                        h.append(("WARC-Refers-To-Target-URI", _uri(r.refers_url)))
                    size += out.write(_member("revisit", date, h, http))
                else:
                    size += out.write(_member("response", date, h, http + body))
                n += 1
                if size >= roll:
                    close()
        if out is not None:
            close()
        if done:
            yield pd.DataFrame(done, columns=["path", "records"])

    return run


def write_archives(pages: DataFrame, folder: str | None = None, roll: int = ROLL_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) as archives; returns the manifest (path, records).

    (digest, id) alone are shuffled to find each payload's smallest id, with
    partial aggregation. The list of revisits is broadcast up to BROADCAST rows
    and BROADCAST_BYTES; beyond, the pages are shuffled by id, so a payload that a third of all pages
    share meets in no task.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").alias("payload"), F.sha2(body.cast("binary"), 256).alias("digest"))
    big = rows.where(F.octet_length(F.coalesce("payload", F.lit(""))) >= MIN_REVISIT_BYTES).select("page_id", "url", "digest")
    least = big.groupBy("digest").agg(F.min("page_id").alias("first"), F.min_by("url", "page_id").alias("refers_url"), F.count("*").alias("n")).where("n > 1 and first is not null")
    again = big.join(least, "digest").where("page_id is null or page_id != first").select(F.coalesce("page_id", F.lit(-1)).alias("k"), F.col("page_id").isNull().alias("k0"), "digest", F.col("first").alias("refers_to"), "refers_url")
    again = stored(again.groupBy("k", "k0", "digest").agg(F.first("refers_to").alias("refers_to"), F.first("refers_url").alias("refers_url")), "warc-revisits")
    listed = again.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("digest") + F.octet_length(F.coalesce("refers_url", F.lit("")))), F.lit(0)).alias("bytes")).first()
    if listed.rows <= BROADCAST and listed.bytes <= BROADCAST_BYTES:
        again = F.broadcast(again)
    keyed = rows.withColumn("k", F.coalesce("page_id", F.lit(-1))).withColumn("k0", F.col("page_id").isNull())
    small_batches(spark)
    told = keyed.join(again, ["k", "k0", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to", "refers_url")
    return stored(told.mapInPandas(_write_part(folder, date, roll), _MANIFEST), "warc-manifest")


def read_members(raw) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of each gzip member of a stream, inflated piece by piece."""
    z, at, pos, out = zlib.decompressobj(31), 0, 0, []
    buf = b""
    while True:
        if not buf:
            buf = raw.read(_READ)
            if not buf:
                if out:
                    raise ValueError(f"the member at {at} is cut off")
                return
        out.append(z.decompress(buf))
        used = len(buf) - len(z.unused_data)
        pos += used
        buf = z.unused_data if z.eof else b""
        if z.eof:
            yield at, b"".join(out)
            z, at, out = zlib.decompressobj(31), pos, []


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record; its length and block digest are verified."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(headers["content-length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError("Content-Length does not frame the block")
    want = headers.get("warc-block-digest")
    if want and want != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
        raise ValueError("the block digest differs")
    return headers, block


def _read_part(with_payload: bool):
    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        names = [c.split()[0] for c in _RECORD.split(", ")]

        def frame(rows):
            return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

        whole = lambda x: None if x is None else int(x)
        for pdf in batches:
            for path in pdf["path"]:
                fs, at = file_system(path)
                rows, held = [], 0
                with fs.open_input_stream(at, compression=None, buffer_size=1 << 20) as raw:
                    for offset, data in read_members(raw):
                        h, block = parse_record(data)
                        if h["warc-type"] not in ("response", "revisit"):
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
                        digest = h["warc-payload-digest"].removeprefix("sha256:")
                        if h["warc-type"] == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"the payload at {offset} of {path} differs from its length or digest")
                        url = h.get("warc-target-uri")
                        rows.append((whole(h.get(_PAGE.lower())), unquote(url) if url else None, h["warc-type"], whole(h.get(_REFERS.lower())), length, digest, payload.decode() if with_payload and h["warc-type"] == "response" else None, path, offset))
                        held += len(payload)
                        if len(rows) >= 4096 or held >= 1 << 24 and with_payload:
                            yield frame(rows)
                            rows, held = [], 0
                if rows:
                    yield frame(rows)

    return run


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per response or revisit record of the archives named in manifest.path; a revisit's payload is null."""
    return manifest.select("path").repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4, "path").mapInPandas(_read_part(with_payload), _RECORD)


def op2_warc(spark, sf_dir: str) -> DataFrame:
    back = read_archives(write_archives(table(spark, sf_dir, "pages")), with_payload=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op2_warc": op2_warc}
ORACLES = {
    "op2_warc": """
WITH p AS (
  SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages
), f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
  CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first_id IS NULL OR first_id = page_id THEN NULL ELSE first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
"""
}
