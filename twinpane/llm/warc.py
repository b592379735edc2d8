"""WARC archives that are indexed first and read by coalesced byte ranges (operator 7).

Writing: each task writes its pages as gzip members, one a record, into archive files of a bounded size in the shared
folder, and returns one index row per record (file, offset, length, URL, digest). The index is a table that Spark
commits; a task that is run again writes files of new names, and only the files of committed rows are ever read.

Of records with equal payloads of at least `min_bytes` bytes, the one with the smallest id is a response and the
others are revisits without the payload. The response is found from digests (one row per digest that repeats, its size
known, since it is read from a table), so no payloads are compared or collected.

Reading: the chosen index rows are dealt by file and sorted by offset; neighbouring ranges become one read of at most
`run_bytes`, and each record is unpacked and its digest verified.

Defined results: null payloads are empty; a null URL is written as an empty one and read back as null from the index;
line breaks in URLs are percent-encoded in the archive. Rows that repeat an id and payload are all responses if that id
is the smallest, else all revisits. Records without ids are responses. Empty tables give empty results.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import marked, scratch_path, stored, table

FILE_BYTES, RUN_BYTES, GAP_BYTES = 64 << 20, 8 << 20, 64 << 10
INDEX = "page_id long, url string, file string, offset long, length long, payload_digest string, record_type string, refers_to long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, verified boolean, payload binary"
_SPACE = uuid.UUID("5f0e3c52-6c0e-4a9a-9d5e-1d6a7f0c2b11")


def digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, str(page_id))}>"


def pack(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, sha: str, date: str) -> bytes:
    """One record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{sha}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: {record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(4, zlib.DEFLATED, 31)
    return squeeze.compress("".join(["WARC/1.1\r\n", *(f"{h}\r\n" for h in head), "\r\n"]).encode() + block + b"\r\n\r\n") + squeeze.flush()


def unpack(member: bytes) -> tuple[dict[str, str], int, bytes]:
    """The WARC header fields, the length of the full payload and the payload (empty for revisits)."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]):
        raise ValueError("a record is shorter than its length")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length"))
    return fields, size, payload


def write_archives(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, file_bytes: int = FILE_BYTES, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes every page as a record; the index, as a table in the shared folder."""
    spark = pages.sparkSession
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    read = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("payload"))
    marks = read.select("page_id", F.sha1("payload").alias("sha"), F.length("payload").cast("long").alias("size")).where(F.col("size") >= min_bytes)
    repeats = marks.groupBy("sha", "size").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1 and first is not null")
    repeats = stored(repeats.select("sha", "size", "first"), "warc-repeats")
    # Pages whose payload stands once go straight to the archives; only repeats are joined.
    told = marked(read.withColumn("sha", F.sha1("payload")).withColumn("size", F.length("payload").cast("long")), repeats, ["sha", "size"], "maybe")
    alone = told.where("not maybe").select("page_id", "url", F.lit(None).cast("long").alias("refers_to"), "payload")
    met = told.where("maybe").join(repeats, ["sha", "size"], "left")
    refers = F.when(F.col("first") != F.col("page_id"), F.col("first"))
    typed = alone.unionByName(met.select("page_id", "url", F.when(F.col("page_id").isNull(), None).otherwise(refers).alias("refers_to"), "payload"))
    folder = scratch_path(spark, "warc")

    def write(batches):
        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, path, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page, link, refers_to, html in zip(*(batch.column(c) for c in ("page_id", "url", "refers_to", "payload")), strict=True):
                    if out is None:
                        path, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{path}", compression=None)
                    page, link, refers_to, html = page.as_py(), link.as_py(), refers_to.as_py(), html.as_py()
                    kind, sha = "revisit" if refers_to is not None else "response", digest(html)
                    member = pack(page, link, html, kind, refers_to, sha, date)
                    out.write(member)
                    rows.append((page, link, f"{folder}/{path}", at, len(member), sha, kind, refers_to))
                    at += len(member)
                    if at >= file_bytes:
                        out.close()
                        out = None
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _INDEX_TYPES, strict=True)], _INDEX_NAMES) if rows else pa.RecordBatch.from_arrays([pa.array([], t) for t in _INDEX_TYPES], _INDEX_NAMES)
        finally:
            if out is not None:
                out.close()

    return stored(typed.mapInArrow(write, INDEX), "warc-index")


_INDEX_NAMES = [x.split()[0] for x in INDEX.split(", ")]
_INDEX_TYPES = [{"long": pa.int64(), "string": pa.string()}[x.split()[1]] for x in INDEX.split(", ")]


def runs(ranges: list[tuple[int, int]], run_bytes: int, gap_bytes: int) -> list[tuple[int, int, int, int]]:
    """Sorted (offset, length) as reads (first, last + 1, offset, length): neighbours with small gaps become one read."""
    out: list[list[int]] = []
    for i, (at, size) in enumerate(ranges):
        if out and at - (out[-1][2] + out[-1][3]) <= gap_bytes and at + size - out[-1][2] <= run_bytes:
            out[-1][1] = i + 1
            out[-1][3] = max(out[-1][3], at + size - out[-1][2])
        else:
            out.append([i, i + 1, at, size])
    return [tuple(x) for x in out]


def read_records(index: DataFrame, *, payload: bool = True, run_bytes: int = RUN_BYTES, gap_bytes: int = GAP_BYTES) -> DataFrame:
    """The records of the index rows (all or any selection), verified; payload=False leaves the payload column null."""
    parts = max(1, index.select("file").distinct().count())
    dealt = index.select("page_id", "url", "file", "offset", "length", "record_type", "refers_to").repartition(parts, "file").sortWithinPartitions("file", "offset")
    names = [x.split()[0] for x in RECORD.split(", ")]

    def read(batches):
        for batch in batches:
            rows = batch.to_pylist()
            begin = 0
            while begin < len(rows):
                end = begin
                while end < len(rows) and rows[end]["file"] == rows[begin]["file"]:
                    end += 1
                mine = rows[begin:end]
                begin = end
                store, path = pyarrow.fs.FileSystem.from_uri(mine[0]["file"])
                with store.open_input_file(path) as file:
                    for first, last, at, size in runs([(r["offset"], r["length"]) for r in mine], run_bytes, gap_bytes):
                        file.seek(at)
                        data = file.read(size)
                        out = []
                        for r in mine[first:last]:
                            fields, full, body = unpack(data[r["offset"] - at : r["offset"] - at + r["length"]])
                            said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                            kind = fields["WARC-Type"]
                            sound = kind == "revisit" or (digest(body) == said and len(body) == full)
                            out.append((r["page_id"], r["url"], kind, r["refers_to"], full, said, sound and kind == r["record_type"], body if payload else None))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary()), strict=True)], names)

    return dealt.mapInArrow(read, RECORD)


def op7_warc(spark, sf_dir: str) -> DataFrame:
    index = write_archives(table(spark, sf_dir, "pages"))
    found = read_records(index, payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.assert_true("verified", F.lit("a record differs from its digest")).isNull().alias("verified"))


#: base32 of a hexadecimal SHA-1: five hex digits are four characters.
OP7_SQL = r"""
WITH typed AS (
  SELECT page_id, coalesce(html, '') AS payload, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages
), hashed AS (
  SELECT page_id, first, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, sha1(payload) AS hex FROM typed
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform(range(4), lambda j:
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((CAST('0x' || substr(hex, CAST(5 * i + 1 AS INT), 5) AS BIGINT) >> (15 - 5 * j)::BIGINT) & 31)]), '')), '') AS payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to, true AS verified
FROM hashed
"""
