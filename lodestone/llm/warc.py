"""WARC archives: an index of every record first, then coalesced reads of the byte ranges of chosen records.

Method: each task writes one archive of gzip members (a record each) into a shared folder, under a name
of its own, and returns (page, file, offset, length, url, digest) for each record; that index is a table. A file
that a failed task left is in no index and so never read. Reading takes index rows, deals them by
file and block of offsets, sorts them, joins ranges that lie close into one read of bounded size, and parses and
verifies the records.

Equal payloads of at least `least` bytes are stored once: the row with the largest page_id is a response, the
others are revisit records that refer to it and hold the HTTP header only. Payload and digest of a revisit are
those of the full payload. Null html is an empty payload; a null url has no target URI; line breaks in a
url are percent-encoded in the archive and kept in the index; a null page_id is never the one referred to unless all are; repeated rows of the winner are
responses each. Ids are whole numbers, as in record names; other types are refused. An empty table gives no records. Other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F, types as T

from ._store import MANY, new_path, written

GAP, READ_BYTES, BLOCK_BYTES = 1 << 16, 1 << 23, 1 << 26
DATE = "2024-01-01T00:00:00Z"
PAGE_URN = "urn:page:"
INDEX = "id long, url string, file string, at long, length long, payload_digest string"
RECORDS = "id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{PAGE_URN}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{PAGE_URN}{'' if refers_to is None else refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def _urn_id(x: str) -> int | None:
    x = x.strip("<>").removeprefix(PAGE_URN)
    return int(x) if x else None


def _measured(batches):
    for b in batches:
        html = [x.as_py() or b"" for x in b.column("html")]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), b.column("html"), pa.array([len(x) for x in html], pa.int64()), pa.array([payload_digest(x) for x in html], pa.string())], ["id", "url", "html", "bytes", "digest"])


def _writer(folder: str):
    def run(batches):
        out, at, path = None, 0, ""
        try:
            for b in batches:
                if out is None and b.num_rows:
                    system, base = fs.FileSystem.from_uri(folder)
                    system.create_dir(base, recursive=True)
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    path, out = f"{folder}/{name}", system.open_output_stream(f"{base}/{name}", compression=None)
                rows = []
                for i in range(b.num_rows):
                    page, url, html, digest, winner, revisit = (b.column(x)[i].as_py() for x in ("id", "url", "html", "digest", "winner", "revisit"))
                    raw = gzip.compress(record(page, url, html or b"", digest, winner, revisit), 3, mtime=0)
                    out.write(raw)
                    rows.append((page, url, path, at, len(raw), digest))
                    at += len(raw)
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
                columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
                done = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "url", "file", "at", "length", "payload_digest"])
                yield done
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(pages: DataFrame, folder: str, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record for each row into archives under folder and returns their index, a written table."""
    if not isinstance(pages.schema[id_col].dataType, (T.IntegralType, T.NullType)):
        raise TypeError(f"{id_col} is no column of whole numbers")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("binary").alias("html"))
    rows = rows.mapInArrow(_measured, "id long, url string, html binary, bytes long, digest string")
    winners = written(rows.where(f"bytes >= {least}").groupBy("digest").agg(F.max("id").alias("winner"), F.count(F.lit(1)).alias("pages")), "winners")
    # payloads of many pages are few and meet their pages by broadcast; the key of those pages in the other join is one of their own
    often = winners.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0] // MANY + 1
    many = F.broadcast(winners.where(F.col("pages") >= often).select("digest", F.col("winner").alias("first"), F.lit(True).alias("hot")))
    few = winners.where(F.col("pages") < often).select(F.col("digest").alias("key"), "winner")
    known = rows.join(many, "digest", "left").withColumn("key", F.when(F.col("hot"), F.concat(F.lit("#"), F.monotonically_increasing_id())).otherwise(F.col("digest")))
    known = known.join(few, "key", "left").withColumn("winner", F.when(F.col("hot"), F.col("first")).otherwise(F.col("winner")))
    known = known.select("id", "url", "html", "digest", "winner", (F.lit(True) & (F.col("bytes") >= least) & ~F.col("id").eqNullSafe(F.col("winner"))).alias("revisit"))
    return written(known.mapInArrow(_writer(folder), INDEX), "warc-index")


def _reader(batches):
    system, streams = None, {}

    def records(name, base, wanted):
        lo, hi = wanted[0][1], max(x[1] + x[2] for x in wanted)
        streams[name].seek(lo)
        raw = streams[name].read(hi - lo)
        for page, at, length, url in wanted:
            fields, http, payload = parsed(zlib.decompress(raw[at - lo : at - lo + length], 31))
            digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
            if kind == "response" and payload_digest(payload) != digest:
                raise ValueError(f"{base}: the record at {at} doesn't have its digest")
            yield page, url, int(http["Content-Length"]) if kind == "revisit" else len(payload), digest, kind, _urn_id(fields["WARC-Refers-To"]) if kind == "revisit" else None

    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = ["id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    for b in batches:
        wanted, name, rows = [], None, []
        page, file, at, length, url = (b.column(x).to_pylist() for x in ("id", "file", "at", "length", "url"))
        for i in range(b.num_rows):
            if wanted and (file[i] != name or at[i] > wanted[-1][1] + wanted[-1][2] + GAP or at[i] + length[i] - wanted[0][1] > READ_BYTES):
                rows += records(name, name, wanted)
                wanted = []
            if file[i] != name:
                for x in streams.values():
                    x.close()
                name = file[i]
                system, base = fs.FileSystem.from_uri(name)
                streams = {name: system.open_input_file(base)}
            wanted.append((page[i], at[i], length[i], url[i]))
        if wanted:
            rows += records(name, name, wanted)
        columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
    for x in streams.values():
        x.close()


def read_records(index: DataFrame) -> DataFrame:
    """(id, url, payload_bytes, payload_digest, record_type, refers_to) of the records of index rows, read from the archives."""
    block = F.expr(f"at div {BLOCK_BYTES}")
    dealt = index.select("id", "url", "file", "at", "length").repartition(F.col("file"), block).sortWithinPartitions("file", "at")
    return dealt.mapInArrow(_reader, RECORDS)


def archived(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Writes pages to archives and reads every record back."""
    return read_records(write_archives(pages, folder or new_path(pages.sparkSession, "warc"), least)).withColumnRenamed("id", "page_id")
