"""WARC archives with an index that is written first, and coalesced byte-range reads.

Each page becomes a WARC/1.1 record, a gzip member of its own. Of equal payloads of MIN_REVISIT bytes or more only
the page with the smallest id is stored, as a response; the others are revisit records that refer to it. Tasks
write archives of bounded size into the shared folder and hand out an archive's index rows (path, offset, length,
URL, digest) only once it is closed. A task that is run again writes new archives; the index, a Parquet table,
names those of the attempts that were committed.

Reading takes any selection of index rows, deals them out by archive and block, sorts them by offset, merges
neighbouring ranges into reads of bounded size, and parses the records.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.spark import new_path, read

MIN_REVISIT = 100
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 4 << 20
GAP_BYTES = 64 << 10

_INDEX = "page_id {id}, path string, offset long, length long, url string, digest string, payload_bytes long, record_type string, refers_to {id}"
_RECORD = "page_id {id}, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to {id}, intact boolean"


def _urn(page_id: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id!r} {digest}'.encode()).digest())}>"


def _header_text(value: object) -> str:
    """A header's value: control characters would end the line, so they are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 0x20 or c == "%" or ord(c) == 0x7F else c for c in str(value))


def _unheader(value: str) -> str:
    parts = value.split("%")
    return parts[0] + "".join(chr(int(p[:2], 16)) + p[2:] for p in parts[1:])


def record(page_id: object, url: str | None, payload: bytes, digest: str, size: int, refers_to: object, date: str) -> bytes:
    """One record's bytes; a revisit (refers_to isn't None) has headers only."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_text(url)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_urn(refers_to, digest)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
    if page_id is not None:
        lines.append(f"X-Page: {page_id}")
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers and its payload, after the HTTP headers."""
    end = data.index(b"\r\n\r\n")
    version, *lines = data[:end].decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"not a WARC record: {version[:20]}")
    headers = dict(x.split(": ", 1) for x in lines)
    block = data[end + 4 : end + 4 + int(headers["Content-Length"])]
    return headers, block[block.index(b"\r\n\r\n") + 4 :]


def _gzip(data: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per row to archives below path, and their index to ``path``/index; returns the index.

    A null payload is empty, a null URL is left out. Rows without an id are responses. Repeated rows have a record
    each; those of the smallest id are all responses. Rows of one id with different payloads have a record each, and
    each is a response or revisit by its own payload. Other columns aren't read. An empty table has an empty index.
    """
    spark = pages.sparkSession
    kind = pages.schema[id_col].dataType.simpleString()
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.sha2(payload, 256).alias("digest"), payload.alias("payload"))
    slim = base.select("page_id", "digest", F.octet_length("payload").alias("size")).where((F.col("size") >= MIN_REVISIT) & F.col("page_id").isNotNull())
    first = slim.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("digest", "first")
    # By id and digest: a repeated id may have several payloads.
    revisits = slim.join(first, "digest").where(F.col("page_id") != F.col("first")).select("page_id", "digest", "first").distinct()
    rows = base.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("size"), "first", F.when(F.col("first").isNull(), F.col("payload")).alias("payload"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(folder, recursive=True)
        names = ["page_id", "path", "offset", "length", "url", "digest", "payload_bytes", "record_type", "refers_to"]
        out, at, name, index = None, 0, "", [[] for _ in names]
        types: list[pa.DataType] = []

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(index, types, strict=True)], names)

        for batch in batches:
            types = [batch.column(0).type, pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), batch.column(0).type]
            for page, url, digest, size, refers_to, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    out, at, index = fs.open_output_stream(name, compression=None), 0, [[] for _ in names]
                data = _gzip(record(page, url, (payload or "").encode(), digest, size, refers_to, date))
                out.write(data)
                for c, v in zip(index, (page, name, at, len(data), url, digest, size, "response" if refers_to is None else "revisit", refers_to), strict=True):
                    c.append(v)
                at += len(data)
                if at >= ARCHIVE_BYTES:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    index_path = f"{path}/index"
    rows.mapInArrow(write, _INDEX.format(id=kind)).write.parquet(index_path)
    return spark.read.parquet(index_path)


def read_records(index: DataFrame, path: str, *, payloads: bool = True) -> DataFrame:
    """The records of the given index rows of archives below path, with digests of what was read.

    A response's size and digest are those of its payload as read, and ``intact`` says whether they are the header's;
    a revisit's are those that its headers state. Without ``payloads`` the payload column is null. Index rows that
    repeat are read as often; an index without rows gives none. A record without id or URL has nulls there.
    """
    spark = index.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = index.schema["page_id"].dataType
    dealt = index.select("path", "offset", "length").repartition(n, "path", F.floor(F.col("offset") / READ_BYTES)).sortWithinPartitions("path", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(path)
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        opened, name = None, None

        def parsed(group: list) -> pa.RecordBatch:
            nonlocal opened, name
            if group[0][0] != name:
                if opened is not None:
                    opened.close()
                name = group[0][0]
                opened = fs.open_input_file(name)
            begin = group[0][1]
            data = opened.read_at(max(o + n for _, o, n in group) - begin, begin)
            out: list[list] = [[] for _ in range(8)]
            for _, offset, length in group:
                headers, payload = parse(zlib.decompress(data[offset - begin : offset - begin + length], 31))
                response = headers["WARC-Type"] == "response"
                stated = headers["WARC-Payload-Digest"].removeprefix("sha256:"), int(headers["X-Payload-Length"])
                found = (hashlib.sha256(payload).hexdigest(), len(payload)) if response else stated
                url = headers.get("WARC-Target-URI")
                for c, v in zip(out, (headers.get("X-Page"), url if url is None else _unheader(url), payload if payloads and response else None, found[1], found[0], headers["WARC-Type"], headers.get("X-Refers-To-Page"), found == stated), strict=True):
                    c.append(v)
            kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"])

        group: list = []
        for r in rows:
            if group and (r[0] != group[0][0] or r[1] - (group[-1][1] + group[-1][2]) > GAP_BYTES or r[1] + r[2] - group[0][1] > READ_BYTES):
                yield parsed(group)
                group = []
            group.append(r)
        if group:
            yield parsed(group)

    out = dealt.mapInArrow(run, _RECORD.format(id="string"))
    return out.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})


def op3_warc(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    index = write_archives(read(spark, sf_dir, "pages"), path)
    return read_records(index, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "intact")


OP3_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages), f AS (
  SELECT html AS h, min(page_id) AS first FROM p WHERE octet_length(encode(html)) >= 100 GROUP BY html
)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to, url, true AS intact
FROM p LEFT JOIN f ON p.html = f.h
"""
