"""Operator 9: token ids as length-delimited binary records with a separate offset index.

A record is: uint64 length, uint32 masked checksum of those 8 bytes, the payload, uint32 masked checksum
of the payload, all little-endian. The payload is the sequence's ids as little-endian uint16 (uint32 for
vocabularies above 65536). The checksum is CRC-32 (zlib's), rotated right by 15 bits plus a constant, so
that a checksum stored among the data does not check itself; readers that expect CRC-32C refuse the files. Beside each
data file an index file holds (has doc_id, doc_id, offset, n_tokens) as four int64 a record, so that a reader can fetch
records in any order.

Files are cut by ranges of doc_id, each written by one task in ascending order. Null doc_id comes first;
null or empty text is a record of the end id alone; equal doc_id are ordered by text. The strings of special tokens
in a text are ordinary text (`tokens`). An empty table writes no file and gives no row.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import delete, filesystem, keep, record_batch, settled, shared_dir, texts_of, write_file
from .tokens import encoder, slices

#: Fixed: the constant added to a rotated checksum.
MASK_DELTA = 0xA282EAD8

_MANIFEST = pa.schema([("part", pa.int32()), ("path", pa.string()), ("width", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked_crc(head)), payload, struct.pack("<I", masked_crc(payload))))


def unframe(data: bytes, offset: int) -> tuple[bytes, int]:
    """The payload at the offset and the offset behind the record; raises on a wrong checksum."""
    head = data[offset : offset + 8]
    (size,), (check,) = struct.unpack("<Q", head), struct.unpack_from("<I", data, offset + 8)
    payload = data[offset + 12 : offset + 12 + size]
    (check_payload,) = struct.unpack_from("<I", data, offset + 12 + size)
    if check != masked_crc(head) or check_payload != masked_crc(payload):
        raise ValueError(f"a record's checksum is wrong at byte {offset}")
    return payload, offset + 16 + size


def write_token_records(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, keeps_space: bool = True) -> DataFrame:
    """Write doc_id and text of docs under path; return the manifest: one row for each data file."""
    dealt = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def write(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = TaskContext.get().partitionId(), str(TaskContext.get().taskAttemptId())
        coder, uri = encoder(tokenizer_path, keeps_space), f"{path}/part-{part:06d}"
        rows, at, tokens = [], 0, 0
        fs, local = filesystem(f"{uri}.rec")
        out = None
        for batch in found:
            ids = batch.column("doc_id").to_pylist()
            k = 0
            for texts in slices(texts_of(batch)):
                for got in coder.encode(texts):
                    if out is None:
                        fs.create_dir(local.rsplit("/", 1)[0], recursive=True)
                        out = fs.open_output_stream(f"{local}.{attempt}.tmp")
                    framed = frame(np.append(got, coder.dtype.type(end_id)).tobytes())
                    out.write(framed)
                    rows.append((ids[k] is not None, ids[k] or 0, at, len(got) + 1))
                    at, tokens, k = at + len(framed), tokens + len(got) + 1, k + 1
        if out is not None:
            out.close()
            fs.move(f"{local}.{attempt}.tmp", local)
            write_file(f"{uri}.idx", np.array(rows, "<i8").tobytes(), attempt)
            yield record_batch([(part, uri, coder.dtype.itemsize, len(rows), tokens)], _MANIFEST)

    return keep(dealt.mapInArrow(write, "part int, path string, width int, n_docs long, n_tokens long"), "token-manifest")


def read_token_records(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record, from the files alone; checksums are verified."""

    def read(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for file in batch.to_pylist():
                fs, local = filesystem(f"{file['path']}.idx")
                with fs.open_input_stream(local) as f:
                    index = np.frombuffer(f.read(), "<i8").reshape(-1, 4)
                before, rows = file["before"], []
                with fs.open_input_file(local[:-3] + "rec") as data:
                    for known, doc_id, offset, n in index.tolist():
                        record = data.read_at(16 + n * file["width"], offset)
                        payload, _ = unframe(record, 0)
                        wide = np.frombuffer(payload, f"<u{file['width']}").astype("<u4")
                        rows.append((doc_id if known else None, before, len(wide), zlib.crc32(wide.tobytes())))
                        before += n
                        if len(rows) >= 20_000:
                            yield record_batch(rows, _READ)
                            rows = []
                if rows:
                    yield record_batch(rows, _READ)

    n = max(1, manifest.count())
    placed = manifest.withColumn("before", F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens"))  # a row a file
    return placed.repartition(n, "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch(path: str, index_rows: list[int]) -> list[np.ndarray]:
    """Ids of chosen records of one file (path without suffix), in any order, by range reads."""
    fs, local = filesystem(f"{path}.idx")
    with fs.open_input_stream(local) as f:
        index = np.frombuffer(f.read(), "<i8").reshape(-1, 4)
    size = fs.get_file_info(local[:-3] + "rec").size
    ends = np.append(index[1:, 2], size)
    with fs.open_input_file(local[:-3] + "rec") as data:
        found = []
        for k in index_rows:
            payload, _ = unframe(data.read_at(int(ends[k] - index[k, 2]), int(index[k, 2])), 0)
            found.append(np.frombuffer(payload, f"<u{len(payload) // int(index[k, 3])}"))
    return found


def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with byte_bpe_50k and end id 0, written and read back."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = shared_dir(spark, "token-records")
    try:
        return settled(spark, "op9", lambda: read_token_records(write_token_records(docs, path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)))
    finally:
        delete(path)  # the result is a table of its own
