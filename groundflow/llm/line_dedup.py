"""Operator 10: reversible line dedup with sharded cuckoo filters over exact reference counts.

The exact table is a log of postings: one row (key, doc_id, change) for each distinct line key of a row of documents,
change +1 when the row is inserted and -1 when it is deleted. Netted by key and document it gives each key's reference
count (documents that hold it) and its largest document at any time, so that a deletion undoes an insertion. The keys
that are in enough documents stand in cuckoo filters, one a shard of the key space, which hold 16-bit fingerprints in
buckets of four. A filter tells cheaply which postings can concern a repeated key: filters and postings are dealt to the
same tasks by shard (a shard with many postings to several, each with a copy of its filter), and only the postings
that pass meet the exact counts, which decide. A filter never misses a key it holds, so nothing is lost.

`build_index` makes log, counts and filters of a table; `change_index` takes documents in and out: counts are made anew
for the touched keys alone, and keys that cross the limit are inserted into or deleted from their shard's stored filter.

A line's key is a 128-bit hash of the line with white space stripped at both ends and A-Z in lower case; keys shorter
than `min_chars` code points are never dropped. A key in at least `min_docs` documents (distinct doc_ids) loses its lines
except in the largest doc_id that holds it. Rows of one doc_id are one document, and each of them keeps or loses a line
alike. Rows without doc_id count as no document and keep all their lines. Null or empty text is one empty line. An empty
table gives no row; extra columns are kept, but for n_lines and n_dropped, which the result has itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_BYTES, batches, keep, settled, texts_of

#: Fixed: white space at a line's ends.
STRIPPED = b" \t\n\x0b\x0c\r"
#: Keys that a filter is built for; the number of shards follows the number of keys.
SHARD_KEYS = 20_000
#: Postings that meet one copy of a shard's filter; it is a fifteenth of their size.
PROBE_ROWS = 20_000

POSTING = "k1 long, k2 long, doc_id long, change int"
_POSTING = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("doc_id", pa.int64()), ("change", pa.int32())])
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def line_key(line: bytes) -> bytes:
    return line.strip(STRIPPED).translate(LOWER_BYTES)


def n_code_points(data: bytes) -> int:
    return len(data) if data.isascii() else len(data.decode("utf-8", "surrogatepass"))


def key_hash(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def keys_of(text: str, min_chars: int) -> list[bytes | None]:
    """The hash of each line's key; None for one that is too short to count."""
    keys = map(line_key, text.encode("utf-8", "surrogatepass").split(b"\n"))
    return [key_hash(k) if len(k) >= min_chars and n_code_points(k) >= min_chars else None for k in keys]


def postings(docs: DataFrame, change: int = 1, min_chars: int = 20) -> DataFrame:
    """The exact table's rows for inserting (change 1) or deleting (-1) docs."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in found:
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                    for key in set(keys_of(text, min_chars)) - {None}:
                        yield int.from_bytes(key[:8], "little", signed=True), int.from_bytes(key[8:], "little", signed=True), doc_id, change

        yield from batches(rows(), _POSTING)

    return docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null").mapInArrow(run, POSTING)


def reference_counts(log: DataFrame, min_docs: int = 3) -> DataFrame:
    """Keys in at least min_docs documents, their number of documents and the largest doc_id.

    Netting deals by key and document, so that a line of very many documents is spread; what is left of it is counted
    in every task before it moves."""
    held = log.groupBy("k1", "k2", "doc_id").agg(F.sum("change").alias("change")).where("change > 0")
    counts = held.groupBy("k1", "k2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))
    return counts.where(F.col("n_docs") >= min_docs)


class CuckooFilter:
    """Partial-key cuckoo hashing: 16-bit fingerprints, four to a bucket, two buckets a key."""

    WIDTH, KICKS = 4, 500

    def __init__(self, n_keys: int, table: np.ndarray | None = None):
        size = 1 << max(1, (max(n_keys, 1) * 5 // 16).bit_length())
        self.table = np.zeros((size, self.WIDTH), np.uint16) if table is None else table
        self.mask = len(self.table) - 1

    @classmethod
    def of(cls, data: bytes) -> CuckooFilter:
        return cls(0, np.frombuffer(data, np.uint16).reshape(-1, cls.WIDTH).copy())

    @staticmethod
    def prints(k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprint (never 0) and first hash of each key."""
        mixed = (k1.view(np.uint64) ^ (k2.view(np.uint64) * _M1)) * _M2
        return ((mixed >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16), (mixed >> np.uint64(16)) & np.uint64(0xFFFFFFFF)

    def buckets(self, prints: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one = (first & np.uint64(self.mask)).astype(np.int64)
        return one, one ^ self.jump(prints)

    def jump(self, prints: np.ndarray) -> np.ndarray:
        return ((prints.astype(np.uint64) * _M1 >> np.uint64(20)) & np.uint64(self.mask)).astype(np.int64)

    def _place(self, prints: np.ndarray, bucket: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Puts the rows that find room in their bucket there, all at once; returns the others."""
        order = rows[np.argsort(bucket[rows], kind="stable")]
        at = bucket[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        free = self.table[at] == 0
        fits = rank < free.sum(axis=1)
        slot = (np.cumsum(free, axis=1) == rank[:, None] + 1).argmax(axis=1)
        self.table[at[fits], slot[fits]] = prints[order[fits]]
        return order[~fits]

    def insert(self, k1: np.ndarray, k2: np.ndarray) -> bool:
        """False if a key found no place: build a larger filter then."""
        prints, first = self.prints(k1, k2)
        one, two = self.buckets(prints, first)
        left = self._place(prints, two, self._place(prints, one, np.arange(len(prints))))
        rng = np.random.default_rng(1)
        for p, at in zip(prints[left].tolist(), one[left].tolist(), strict=True):
            for _ in range(self.KICKS):
                if not self.table[at].all():
                    self.table[at, int(np.argmin(self.table[at] != 0))] = p
                    break
                slot = int(rng.integers(self.WIDTH))
                p, self.table[at, slot] = int(self.table[at, slot]), p
                at ^= int(self.jump(np.array([p], np.uint16))[0])
            else:
                return False
        return True

    def delete(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Takes out keys that are in; others must not be given."""
        prints, first = self.prints(k1, k2)
        for p, a, b in zip(prints.tolist(), *(x.tolist() for x in self.buckets(prints, first)), strict=True):
            for x in (a, b):
                if (held := np.flatnonzero(self.table[x] == p)).size:
                    self.table[x, held[0]] = 0
                    break

    def may_hold(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        prints, first = self.prints(k1, k2)
        one, two = self.buckets(prints, first)
        return ((self.table[one] == prints[:, None]) | (self.table[two] == prints[:, None])).any(axis=1)


def build_filter(k1: np.ndarray, k2: np.ndarray) -> CuckooFilter:
    n = len(k1)
    while not (made := CuckooFilter(n)).insert(k1, k2):
        n = 2 * n + 8
    return made


def _shard(n_shards: int):
    return F.pmod("k1", F.lit(n_shards)).cast("int")


FILTER = "shard int, filter binary"
_FILTER = pa.schema([("shard", pa.int32()), ("filter", pa.binary())])
_EDIT = "shard int, filter binary, k1 long, k2 long, change int"


def _by_shard(found: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Runs of rows with equal first columns (shard, salt), cut where a batch ends."""
    for batch in found:
        if batch.num_rows:
            keys = np.stack([batch.column(c).to_numpy() for c in ("shard", "salt") if c in batch.schema.names], axis=1)
            edges = [*np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1))).tolist(), len(keys)]
            for a, b in zip(edges, edges[1:], strict=False):
                yield tuple(keys[a].tolist()), batch.slice(a, b - a)


def edited_filters(filters: DataFrame, changes: DataFrame, n_shards: int) -> DataFrame:
    """shard and filter of every shard that has keys, after changes (k1, k2, change: +1 puts a key in, -1 takes it out). A
    filter that has no room for its new keys becomes null: build it anew from the counts."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, edits = None, None, []

        def finish() -> pa.RecordBatch:
            k1, k2, change = (np.concatenate(x) for x in zip(*edits, strict=True)) if edits else (np.zeros(0, np.int64),) * 3
            new, gone = change > 0, change < 0
            if held is None:
                made = build_filter(k1[new], k2[new])
            else:
                made = CuckooFilter.of(held)
                made.delete(k1[gone], k2[gone])
                made = made if made.insert(k1[new], k2[new]) else None
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([made.table.tobytes() if made else None], pa.binary())], schema=_FILTER)

        for shard, rows in _by_shard(found):
            if shard != at:
                if at is not None:
                    yield finish()
                at, held, edits = shard, None, []
            for data in rows.column("filter").drop_null().to_pylist():
                held = data
            edit = rows.filter(pa.compute.is_valid(rows.column("k1")))
            if edit.num_rows:
                edits.append(tuple(edit.column(c).to_numpy() for c in ("k1", "k2", "change")))
        if at is not None:
            yield finish()

    rows = changes.select(_shard(n_shards).alias("shard"), F.lit(None).cast("binary").alias("filter"), "k1", "k2", F.col("change").cast("int"))
    rows = rows.unionByName(filters.select("shard", "filter"), allowMissingColumns=True)
    return rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, FILTER)


def shard_filters(counts: DataFrame, n_shards: int) -> DataFrame:
    """shard and filter of every shard that has keys; a task builds the filters of its shards."""
    none = counts.sparkSession.createDataFrame([], FILTER)
    return edited_filters(none, counts.select("k1", "k2", F.lit(1).alias("change")), n_shards)


def may_repeat(log: DataFrame, filters: DataFrame, n_shards: int) -> DataFrame:
    """The postings whose key a filter may hold."""
    dealt = log.select("k1", "k2", "doc_id", "change", _shard(n_shards).alias("shard"))
    salts = dealt.groupBy("shard").agg(F.ceil(F.count("*") / PROBE_ROWS).cast("int").alias("salts"))
    salt = F.pmod(F.xxhash64("doc_id", "k2"), F.col("salts")).cast("int")
    postings_ = dealt.join(salts, "shard").select("shard", salt.alias("salt"), F.lit(None).cast("binary").alias("filter"), "k1", "k2", "doc_id", "change")
    copies = filters.join(salts, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "filter")

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for place, rows in _by_shard(found):
            if place != at:
                at, held = place, None
            for data in rows.column("filter").drop_null().to_pylist():  # it comes first
                held = CuckooFilter.of(data)
            rows = rows.filter(pa.compute.is_valid(rows.column("k1"))).select(["k1", "k2", "doc_id", "change"])
            if held and rows.num_rows:
                yield rows.filter(pa.array(held.may_hold(rows.column("k1").to_numpy(), rows.column("k2").to_numpy())))

    rows = postings_.unionByName(copies, allowMissingColumns=True)
    order = ["shard", "salt", F.col("filter").isNull()]
    return rows.repartition("shard", "salt").sortWithinPartitions(*order).mapInArrow(run, POSTING)


@dataclass(frozen=True)
class LineIndex:
    """The exact table and what follows from it."""

    log: DataFrame
    counts: DataFrame  # of keys in enough documents
    filters: DataFrame
    n_shards: int
    min_chars: int
    min_docs: int


def build_index(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> LineIndex:
    log = keep(postings(docs, 1, min_chars), "line-postings")
    counts = keep(reference_counts(log, min_docs), "line-counts")
    n_shards = max(1, -(-counts.count() // SHARD_KEYS))
    return LineIndex(log, counts, keep(shard_filters(counts, n_shards), "line-filters"), n_shards, min_chars, min_docs)


def change_index(index: LineIndex, inserted: DataFrame | None = None, deleted: DataFrame | None = None) -> LineIndex:
    """The index after documents came in and others, which are in it, went. Work follows the touched keys."""
    new = [postings(docs, change, index.min_chars) for docs, change in ((inserted, 1), (deleted, -1)) if docs is not None]
    if not new:
        return index
    delta = keep(new[0] if len(new) == 1 else new[0].unionByName(new[1]), "line-postings")
    log, key = index.log.unionByName(delta), ["k1", "k2"]
    touched = keep(delta.select(key).distinct(), "line-keys")
    now = keep(reference_counts(log.join(touched, key, "left_semi"), index.min_docs), "line-counts")
    before = index.counts.join(touched, key, "left_semi")
    counts = keep(index.counts.join(touched, key, "left_anti").unionByName(now), "line-counts")
    up = now.join(before, key, "left_anti").select(*key, F.lit(1).alias("change"))
    down = before.join(now, key, "left_anti").select(*key, F.lit(-1).alias("change"))
    filters = keep(edited_filters(index.filters, up.unionByName(down), index.n_shards), "line-filters")
    full = filters.where("filter is null").select("shard")
    if not full.isEmpty():
        again = counts.withColumn("shard", _shard(index.n_shards)).join(full, "shard", "left_semi")
        filters = keep(filters.where("filter is not null").unionByName(shard_filters(again, index.n_shards)), "line-filters")
    return LineIndex(log, counts, filters, index.n_shards, index.min_chars, index.min_docs)


def dropped_keys(index: LineIndex) -> DataFrame:
    """doc_id and the keys that it loses, in two arrays."""
    passed = may_repeat(index.log, index.filters, index.n_shards)
    found = passed.join(index.counts.select("k1", "k2", "last_doc"), ["k1", "k2"]).where(F.col("doc_id") < F.col("last_doc"))
    held = found.groupBy("doc_id", "k1", "k2").agg(F.sum("change").alias("change")).where("change > 0")
    lost = held.groupBy("doc_id").agg(F.collect_set(F.struct("k1", "k2")).alias("lost"))
    return lost.select("doc_id", F.col("lost.k1").alias("_lost1"), F.col("lost.k2").alias("_lost2"))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, index: LineIndex | None = None) -> DataFrame:
    """docs with their kept text, n_lines (before) and n_dropped. index: that of docs, if it is there already."""
    index = index or build_index(docs, min_chars, min_docs)
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_lines", "n_dropped")]
    own = docs.select(F.col("doc_id").cast("long"), "text", *rest)
    joined = own.join(dropped_keys(index), "doc_id", "left")
    schema = own.schema.add("n_lines", "long").add("n_dropped", "long")
    least = index.min_chars

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            kept, n_lines, n_dropped = [], [], []
            for raw, text, one, two in zip(batch.column("text").to_pylist(), texts_of(batch), batch.column("_lost1").to_pylist(), batch.column("_lost2").to_pylist(), strict=True):
                lines = text.split("\n")
                stay = lines
                if one:
                    gone = set(np.array([one, two], "<i8").T.tobytes()[k : k + 16] for k in range(0, 16 * len(one), 16))
                    stay = [line for line, key in zip(lines, keys_of(text, least), strict=True) if key not in gone]
                kept.append(raw if len(stay) == len(lines) else "\n".join(stay))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
            columns = [batch.column("doc_id"), pa.array(kept, pa.string()), *(batch.column(c) for c in rest), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", *rest, "n_lines", "n_dropped"])

    return joined.mapInArrow(run, schema)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their repeated lines."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    digest = lambda: dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
    return settled(spark, "op10", digest)


OP10_SQL = r"""
WITH lines AS (
  SELECT row_no, doc_id, u.pos AS pos, u.line AS line,
         translate(trim(u.line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT row_number() OVER () AS row_no, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d,
       LATERAL (SELECT unnest(parts) AS line, generate_subscripts(parts, 1) AS pos) u),
counts AS (
  SELECT key, max(doc_id) AS last_doc FROM lines WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT l.row_no, l.doc_id, l.pos, l.line, coalesce(c.key IS NOT NULL AND l.doc_id <> c.last_doc, false) AS gone
  FROM lines l LEFT JOIN counts c ON l.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY row_no, doc_id
"""
