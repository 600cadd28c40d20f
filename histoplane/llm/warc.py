"""WARC archives, index first.

Writing: each task writes one gzip-compressed WARC file, a member a record, and returns the index: file,
offset, length, url and payload digest of each record. Only the index of tasks that ended well is kept, so a
retried or lost task leaves at most a file that no index names. Reading: index entries are dealt by file and
stretch of offsets, sorted, and neighbouring ranges are read together. Files go through pyarrow's file
systems, so the folder can be any shared store that it knows.

Of records with equal payloads of at least ``min_revisit`` bytes the smallest id is a ``response`` and the
others are ``revisit`` records (identical-payload-digest) without the payload. Rows that repeat the smallest
id are responses each. A row without an id revisits the smallest id of its payload, and is a response if no row
of it has an id. A null payload is empty; a null url gives no target URI; control characters and blanks in a
url are percent-encoded in the header only. Other columns are ignored; an empty table gives no records.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, partitions_for, read_table, scratch_path

#: Bytes of an archive that one reading task takes, bytes read at once, and gap that a read bridges.
STRETCH = 64 << 20
READ = 4 << 20
GAP = 64 << 10
DATE = "2024-01-01T00:00:00Z"
INDEX = "page_id long, url string, record_type string, refers_to long, payload_digest string, file string, offset long, length long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _uri(page_id) -> str:
    return f"urn:x-page:{'' if page_id is None else page_id}"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record; ``refers_to`` None makes a response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_uri(page_id)}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_uri(refers_to)}>"]
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Header fields of a record and its block; the payload's length is the HTTP header's, which revisits keep."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    http_fields = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
    return fields | {"payload": payload, "payload_length": int(http_fields["Content-Length"])}


def _id(field: str | None):
    digits = field.rpartition(":")[2].rstrip(">") if field else ""
    return int(digits) if digits else None


def _write(folder: str, level: int):
    def run(batches):
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        name = f"{path}/{uuid.uuid4().hex}.warc.gz"
        sink, offset = None, 0
        for batch in batches:
            rows = []
            for page_id, url, payload, digest, refers in zip(*(batch.column(i) for i in range(5))):
                page_id, url, payload, digest, refers = page_id.as_py(), url.as_py(), payload.as_py() or b"", digest.as_py(), refers.as_py()
                member = gzip.compress(record(page_id, url, payload, digest, refers), level, mtime=0)
                if sink is None:
                    sink = store.open_output_stream(name, compression=None)
                sink.write(member)
                rows.append((page_id, url, "response" if refers is None else "revisit", refers, digest, name, offset, len(member)))
                offset += len(member)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 8, [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()])], names=[x.split()[0] for x in INDEX.split(", ")])
        if sink is not None:
            sink.close()

    return run


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = 100, level: int = 3) -> DataFrame:
    """Writes the archive into ``folder`` and returns its index, kept as a table in the shared folder."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    long_enough = F.octet_length("payload") >= min_revisit
    shared = rows.where(long_enough).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first_id")).where("n > 1").select("digest", "first_id")
    shared = cut(shared, "op6-shared")
    refers = F.when(long_enough & ~F.col("first_id").eqNullSafe(F.col("page_id")), F.col("first_id"))
    ready = rows.join(shared, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))
    index = cut(ready.mapInArrow(_write(folder, level), INDEX), "op6-index")
    drop_cut(shared)
    return index


def _ranges(batches):
    """Index entries in order of file and offset -> (file, start, end, entries) of ranges to read at once."""
    now = None
    for batch in batches:
        for file, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if now and now[0] == file and offset - now[2] <= GAP and offset + length - now[1] <= READ:
                now[2] = offset + length
                now[3].append((offset, length))
            else:
                if now:
                    yield now
                now = [file, offset, offset + length, [(offset, length)]]
    if now:
        yield now


def _read(folder: str, with_payload: bool):
    def run(batches):
        store, _ = fs.FileSystem.from_uri(folder)
        name, source = None, None
        for file, start, end, entries in _ranges(batches):
            if file != name:
                name, source = file, store.open_input_file(file)
            data = source.read_at(end - start, start)
            rows = []
            for offset, length in entries:
                r = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
                digest = r["WARC-Payload-Digest"].partition(":")[2]
                if r["WARC-Type"] == "response" and hashlib.sha256(r["payload"]).hexdigest() != digest:
                    raise ValueError(f"{file} at {offset}: the payload doesn't have its digest")
                rows.append((_id(r["WARC-Record-ID"]), r.get("WARC-Target-URI"), r["WARC-Type"], _id(r.get("WARC-Refers-To")), r["payload_length"], digest, r["payload"] if with_payload and r["WARC-Type"] == "response" else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()])], names=[x.split()[0] for x in RECORDS.split(", ")])

    return run


def read_warc(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records that ``index`` (all or a selection of an archive's index) names; a revisit's payload is null."""
    size = index.agg(F.sum("length")).first()[0] or 0
    dealt = index.select("file", "offset", "length").repartition(partitions_for(index.sparkSession, size), "file", F.floor(F.col("offset") / STRETCH)).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(_read(folder, with_payload), RECORDS)


def op6_warc(spark, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "op6-archive")
    index = write_warc(read_table(spark, sf_dir, "pages"), folder)
    return read_warc(index, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first_id FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to FROM f
"""
