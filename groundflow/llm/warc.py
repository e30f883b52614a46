"""Operator 8: WARC archives with a two-level capture index.

Pages are written as WARC/1.1 records, each its own gzip member. Of records with equal payloads the one with
the smallest page_id is a `response`; the others are `revisit` records, which name it and keep the HTTP
header (with the payload's length) and digest but no payload. The capture index has one line a record, sorted
by reversed-host URL key and page_id: lines are compressed in blocks, and a sparse directory holds each block's first and
last key and its place. Whoever looks for captures has their keys searched in the directory by bisection, reads the blocks
found, searches them the same way, and then reads the records by range. Only the index files' own bounds, a row a file,
are on the driver and sent to all tasks; keys then meet the directory file by file.

Null html is an empty payload, null url an empty target. Pages without page_id are responses and nothing refers to
them. Equal page_ids with equal payloads are all responses if they are the smallest, else all revisits. Repeated rows have a
record each; an empty table writes nothing and gives no row. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, filesystem, keep, record_batch, settled, shared_dir

#: Index lines in a compressed block.
BLOCK_LINES = 3000
#: Records closer together than this are fetched by one range read, up to the second number of bytes.
READ_GAP, READ_MOST = 64 << 10, 8 << 20
#: Fixed: pages carry no capture time.
DATE = "2000-01-01T00:00:00Z"

ENTRY = "urlkey string, page_id long, file string, offset long, length long"
_ENTRY = pa.schema([("urlkey", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
DIRECTORY = "first_key string, first_page long, last_key string, last_page long, file string, offset long, length long, n long"
_DIRECTORY = pa.schema([("first_key", pa.string()), ("first_page", pa.int64()), ("last_key", pa.string()), ("last_page", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("n", pa.int64())])
PLACE = "file string, offset long, length long"
_PLACE = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
_RECORD = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])


def url_key(url: str) -> str:
    """Host labels reversed and comma-joined, then the path and query: com,example,www)/a?b."""
    try:
        at = urlsplit(url.strip())
        host, port = at.hostname or "", at.port
    except ValueError:
        return f")/{url}"
    host = re.sub(r"^www\d*\.", "", host)
    key = ",".join(reversed(host.split(".")))
    return f"{key}{f':{port}' if port else ''}){at.path or '/'}{f'?{at.query}' if at.query else ''}".lower()


def index_key(url: str | None) -> str:
    """The key as index lines hold it: without tabs and line breaks."""
    return re.sub(r"[\t\n]", " ", url_key(url or ""))


def _rank(key: str, page_id: int | None) -> tuple:
    """The order of the index: by key, then by page_id, null first."""
    return key, page_id is not None, page_id or 0


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record_bytes(page_id: int | None, url: str, payload: bytes, refers_to: int | None, is_revisit: bool) -> bytes:
    """One WARC record, not compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        *([f"WARC-Refers-To: {_name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if is_revisit else []),
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers and payload of a record; the payload's digest is verified."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda name: int(m[1]) if (m := re.search(r"urn:page:(-?\d+)", fields.get(name, ""))) else None
    found = {"page_id": number("WARC-Record-ID"), "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To"), "url": fields["WARC-Target-URI"]}
    found["payload_digest"] = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    found["payload_bytes"] = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if fields["WARC-Type"] == "response":
        if digest_of(payload) != found["payload_digest"] or len(payload) != found["payload_bytes"]:
            raise ValueError(f"the payload of page {found['page_id']} is damaged")
        found["payload"] = payload
    return found


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, refers_to: null where the page is the first with its payload."""
    payload = F.coalesce("html", F.lit(""))
    narrow = pages.select(F.col("page_id").cast("long"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n"))
    firsts = narrow.where(F.col("n") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    later = narrow.join(firsts.where("copies > 1"), "digest").where("page_id <> first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct()
    return pages.select(F.col("page_id").cast("long"), "url", "html", F.sha2(payload, 256).alias("digest")).join(later, ["page_id", "digest"], "left").drop("digest")


def write_archives(pages: DataFrame, path: str) -> DataFrame:
    """Write page_id, url, html, refers_to as archives under path; return the index entries."""

    def write(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        name = f"part-{part:06d}.warc.gz"
        fs, local = filesystem(f"{path}/{name}")
        out, at = None, 0
        for batch in found:
            rows = []
            for row in batch.to_pylist():
                url = row["url"] or ""
                data = _gzip(record_bytes(row["page_id"], url, (row["html"] or "").encode("utf-8", "surrogatepass"), row["refers_to"], row["refers_to"] is not None))
                if out is None:
                    fs.create_dir(local.rsplit("/", 1)[0], recursive=True)
                    out = fs.open_output_stream(f"{local}.{attempt}.tmp")
                out.write(data)
                rows.append((index_key(url), row["page_id"], name, at, len(data)))
                at += len(data)
            if rows:
                yield record_batch(rows, _ENTRY)
        if out is not None:
            out.close()
            fs.move(f"{local}.{attempt}.tmp", local)

    # a repeated task writes the same bytes at the same places
    return keep(pages.select("page_id", "url", "html", "refers_to").sortWithinPartitions("page_id", "url", "html").mapInArrow(write, ENTRY), "warc-entries")


def write_index(entries: DataFrame, path: str) -> DataFrame:
    """Sorted, compressed blocks under path; return the sparse directory."""

    def write(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        name = f"index-{part:06d}.gz"
        fs, local = filesystem(f"{path}/{name}")
        out, at, held, directory = None, 0, [], []

        def block() -> None:
            nonlocal out, at
            data = _gzip("\n".join(f"{e['urlkey']}\t{json.dumps([e['page_id'], e['file'], e['offset'], e['length']])}" for e in held).encode("utf-8", "surrogatepass"))
            if out is None:
                fs.create_dir(local.rsplit("/", 1)[0], recursive=True)
                out = fs.open_output_stream(f"{local}.{attempt}.tmp")
            out.write(data)
            directory.append((held[0]["urlkey"], held[0]["page_id"], held[-1]["urlkey"], held[-1]["page_id"], name, at, len(data), len(held)))
            at += len(data)

        for batch in found:
            for e in batch.to_pylist():
                held.append(e)
                if len(held) >= BLOCK_LINES:
                    block()
                    held = []
        if held:
            block()
        if out is not None:
            out.close()
            fs.move(f"{local}.{attempt}.tmp", local)
            yield record_batch(directory, _DIRECTORY)

    order = ["urlkey", "page_id", "file", "offset"]
    return keep(entries.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(write, DIRECTORY), "warc-directory")


def read_block(path: str, place: dict) -> list[tuple[str, list]]:
    """The (key, [page_id, file, offset, length]) lines of one index block."""
    fs, local = filesystem(f"{path}/{place['file']}")
    with fs.open_input_file(local) as f:
        text = zlib.decompress(f.read_at(place["length"], place["offset"]), 31).decode("utf-8", "surrogatepass")
    return [(k, json.loads(v)) for k, _, v in (line.rpartition("\t") for line in text.split("\n"))]


def find(directory: DataFrame, path: str, wanted: DataFrame) -> DataFrame:
    """file, offset, length of the records of all captures that are wanted. wanted: urlkey, page_id, whole (true: all
    captures with the key); distinct rows."""
    bounds = directory.groupBy("file").agg(F.min(F.struct("first_key", "first_page")).alias("low"), F.max(F.struct("last_key", "last_page")).alias("high"))
    tops = sorted((_rank(*r["low"]), _rank(*r["high"]), r["file"]) for r in bounds.collect())  # a row for each index file
    lows, highs, files = ([t[k] for t in tops] for k in range(3))

    def span(key: str, page_id: int | None, whole: bool) -> tuple[tuple, tuple]:
        return ((key,), (key, 2)) if whole else (_rank(key, page_id),) * 2

    def overlapping(low: tuple, high: tuple, firsts: list, lasts: list) -> range:
        """Of sorted stretches those that may hold something between low and high."""
        return range(bisect.bisect_left(lasts, low), bisect.bisect_right(firsts, high))

    def assign(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            rows = [(files[k], *row) for row in zip(*(batch.column(c).to_pylist() for c in ("urlkey", "page_id", "whole")), strict=True) for k in overlapping(*span(*row), lows, highs)]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.bool_()), strict=True)], names=["file", "first_key", "first_page", "whole"])

    def search(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, blocks, firsts, lasts = None, [], [], []
        at, lines, keys = None, [], []
        for batch in found:
            rows = []
            for row in batch.to_pylist():
                if row["file"] != file:
                    file, blocks, firsts, lasts, at = row["file"], [], [], [], None
                if row["whole"] is None:
                    blocks.append(row)
                    firsts.append(_rank(row["first_key"], row["first_page"]))
                    lasts.append(_rank(row["last_key"], row["last_page"]))
                    continue
                low, high = span(row["first_key"], row["first_page"], row["whole"])
                for b in overlapping(low, high, firsts, lasts):
                    if at != b:
                        at, lines = b, read_block(path, blocks[b])
                        keys = [_rank(k, v[0]) for k, v in lines]
                    rows += [tuple(v[1:]) for _, v in lines[bisect.bisect_left(keys, low) : bisect.bisect_right(keys, high)]]
            if rows:
                yield record_batch(rows, _PLACE)

    asked = wanted.select("urlkey", F.col("page_id").cast("long"), "whole").mapInArrow(assign, "file string, first_key string, first_page long, whole boolean")
    rows = directory.withColumn("whole", F.lit(None).cast("boolean")).unionByName(asked, allowMissingColumns=True)
    order = ["file", F.col("whole").isNotNull(), "first_key", "first_page", "offset"]
    return rows.repartition(_tasks(directory), "file").sortWithinPartitions(*order).mapInArrow(search, PLACE)


def _tasks(df: DataFrame) -> int:
    """As many tasks as shuffles have. Said outright, because small rows here stand for large reads and are not to be joined."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def read_records(places: DataFrame, path: str, payload: bool = False) -> DataFrame:
    """The records at file, offset, length, read file by file; with `payload`, that of responses too."""
    schema = _RECORD.append(pa.field("payload", pa.binary())) if payload else _RECORD

    def read(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            rows, wanted = [], list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True))
            k = 0
            while k < len(wanted):
                last = k
                while last + 1 < len(wanted) and wanted[last + 1][0] == wanted[k][0] and 0 <= wanted[last + 1][1] - sum(wanted[last][1:]) <= READ_GAP and sum(wanted[last + 1][1:]) - wanted[k][1] <= READ_MOST:
                    last += 1
                fs, local = filesystem(f"{path}/{wanted[k][0]}")
                with fs.open_input_file(local) as f:
                    data = f.read_at(sum(wanted[last][1:]) - wanted[k][1], wanted[k][1])
                for _, offset, length in wanted[k : last + 1]:
                    r = parse_record(zlib.decompress(data[offset - wanted[k][1] :][:length], 31))
                    rows.append(tuple(r.get(c) for c in schema.names))
                k = last + 1
                if payload:
                    yield record_batch(rows, schema)
                    rows = []
            if rows:
                yield record_batch(rows, schema)

    return places.repartition(_tasks(places), "file").sortWithinPartitions("file", "offset").mapInArrow(read, RECORD + (", payload binary" if payload else ""))


def captures(directory: DataFrame, path: str, urls: DataFrame) -> DataFrame:
    """All captures of the URLs in column url, with their payloads (null for revisits)."""
    return read_records(find(directory, path, _keys(urls.withColumn("page_id", F.lit(None).cast("long")), True)), path, payload=True)


def _keys(pages: DataFrame, whole: bool) -> DataFrame:
    """urlkey, page_id, whole of pages, each once."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            keys = pa.array([index_key(u) for u in batch.column("url").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([keys, batch.column("page_id")], names=["urlkey", "page_id"])

    return pages.select("url", F.col("page_id").cast("long")).mapInArrow(run, "urlkey string, page_id long").distinct().withColumn("whole", F.lit(whole))


def read_archives(pages: DataFrame, directory: DataFrame, path: str) -> DataFrame:
    """The records of pages (page_id, url), each looked up in the index."""
    return read_records(find(directory, path, _keys(pages, False)), path)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives with an index, and each looked up and read back through it."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = shared_dir(spark, "warc")

    def digest() -> DataFrame:
        directory = write_index(write_archives(with_revisits(pages), path), path)
        return read_archives(pages, directory, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

    try:
        return settled(spark, "op8", digest)
    finally:
        delete(path)  # the result is a table of its own
