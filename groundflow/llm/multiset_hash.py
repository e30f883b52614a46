"""Operator 5: homomorphic multiset hash of a document's paragraphs.

Each paragraph (line) is hashed to a wide vector and a document's fingerprint is the sum of its paragraphs'
vectors, lane by lane modulo 2^32 (identity) or 2^16 (likeness). So the order of paragraphs does not matter, and inserting or deleting a
paragraph adds or subtracts its vector (`combine`) without reading the rest. A paragraph's vector has two parts:

* 32 identity lanes, the paragraph's SHAKE-128 hash; equal sums mean equal multisets of paragraphs;
* 480 likeness lanes, signed counts (+1 or -1, by hash) of the paragraph's 12-byte windows; a shorter paragraph is
  one window of its own, and only an empty one, which has no bytes to share, adds nothing. As they are
  sums too, the cosine of two documents' likeness lanes estimates how many windows they share, with a standard error
  of at most 480^-1/2 = 0.046. Lanes are first cut off at three times their usual size, so that one window
  repeated very often does not outweigh all others.

The fingerprint is the vector's 1088 bytes in base64. Null and empty text is one empty paragraph. Texts are
processed whole, in slices of bounded size. Equal doc_ids are ordered by text, null doc_id comes last; extra columns
are ignored and an empty table gives no row.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import record_batch

IDENTITY_LANES, LIKENESS_LANES, WINDOW = 32, 480, 12
#: Bytes of text that are hashed at once.
SLICE_BYTES = 2 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)

PRINT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_PRINT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def _likeness(data: bytes, lengths: np.ndarray) -> np.ndarray:
    """Signed window counts of texts that are joined by line breaks."""
    out = np.zeros((len(lengths), LIKENESS_LANES), np.int64)
    a = np.frombuffer(data, np.uint8)
    breaks = np.flatnonzero(a == 10)
    at, w = _short_lines(a, breaks)
    n = len(a) - WINDOW + 1
    if n > 0:
        broken = np.concatenate(([0], np.cumsum(a == 10, dtype=np.int32)))
        inside = np.flatnonzero(broken[WINDOW:] == broken[:n])  # no line break inside
        h = a.astype(np.uint64) + np.uint64(1)
        h2 = h[:-1] * _power(1) + h[1:]
        h4 = h2[:-2] * _power(2) + h2[2:]
        h8 = h4[:-4] * _power(4) + h4[4:]
        w = np.concatenate((w, (h8[:n] * _power(4) + h4[8 : 8 + n])[inside]))
        at = np.concatenate((at, inside))
    w ^= w >> np.uint64(29)
    w *= _MIX
    w ^= w >> np.uint64(32)
    lane = ((w & np.uint64(0xFFFFFFFF)) * np.uint64(LIKENESS_LANES) >> np.uint64(32)).astype(np.int64)
    ends = np.cumsum(lengths + 1)
    lane += np.searchsorted(ends, at, side="right") * LIKENESS_LANES
    sign = 1.0 - 2.0 * (w >> np.uint64(63)).astype(np.float64)
    return np.bincount(lane, weights=sign, minlength=out.size).astype(np.int64).reshape(out.shape)


def _short_lines(a: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each line that has bytes but fewer than a window."""
    starts = np.concatenate(([0], breaks + 1))
    size = np.append(breaks, len(a)) - starts
    short = (size > 0) & (size < WINDOW)
    starts, size = starts[short], size[short]
    w = np.zeros(len(starts), np.uint64)
    for k in range(WINDOW - 1):
        on = np.flatnonzero(size > k)
        w[on] = w[on] * _BASE + a[starts[on] + k] + np.uint64(1)
    return starts, w


def _identity(texts: list[bytes]) -> np.ndarray:
    parts = [t.split(b"\n") for t in texts]
    size = 4 * IDENTITY_LANES
    digests = np.frombuffer(b"".join(hashlib.shake_128(p).digest(size) for x in parts for p in x), "<u4").reshape(-1, IDENTITY_LANES)
    starts = np.concatenate(([0], np.cumsum([len(x) for x in parts])[:-1]))
    return np.add.reduceat(digests, starts, axis=0, dtype=np.uint32)


def vectors(texts: list[bytes]) -> np.ndarray:
    """One vector of uint32 lanes for each text."""
    found, k = [np.zeros((0, IDENTITY_LANES + LIKENESS_LANES), np.uint32)], 0
    while k < len(texts):
        last, size = k, 0
        while last < len(texts) and (last == k or size + len(texts[last]) <= SLICE_BYTES):
            size += len(texts[last])
            last += 1
        part = texts[k:last]
        like = _likeness(b"\n".join(part), np.array([len(t) for t in part], np.int64))
        found.append(np.concatenate((_identity(part), like.astype(np.uint32)), axis=1))
        k = last
    return np.concatenate(found)


def encode(vector: np.ndarray) -> str:
    return base64.b64encode(vector[:IDENTITY_LANES].astype("<u4").tobytes() + vector[IDENTITY_LANES:].astype("<u2").tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    data = base64.b64decode(fingerprint)
    own = np.frombuffer(data, "<u4", IDENTITY_LANES)
    like = np.frombuffer(data, "<i2", LIKENESS_LANES, 4 * IDENTITY_LANES)
    return np.concatenate((own.astype(np.uint32), like.astype(np.int32).view(np.uint32)))


def combine(fingerprint: str, inserted: list[str] = (), deleted: list[str] = ()) -> str:
    """The fingerprint after paragraphs are inserted or deleted."""
    total = decode(fingerprint).copy()
    for paragraphs, change in ((inserted, np.add), (deleted, np.subtract)):
        for p in paragraphs:
            total = change(total, vectors([p.encode("utf-8", "surrogatepass")])[0])
    return encode(total)


def _levelled(vectors_: np.ndarray) -> np.ndarray:
    """Likeness lanes as signed numbers, cut off at three times what a lane usually has."""
    lanes = np.ascontiguousarray(vectors_[:, IDENTITY_LANES:]).astype(np.uint16).view(np.int16).astype(np.float32)
    usual = np.median(np.abs(lanes), axis=1, keepdims=True) / 0.6745
    most = np.maximum(3 * usual, 1)
    return np.clip(lanes, -most, most)


def nearness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1 for each pair of rows; 1 for equal fingerprints."""
    x, y = _levelled(a), _levelled(b)
    size = np.sqrt((x * x).sum(axis=1, dtype=np.float64) * (y * y).sum(axis=1, dtype=np.float64))
    cosine = np.divide((x * y).sum(axis=1, dtype=np.float64), size, out=np.zeros(len(x)), where=size > 0)
    return np.where((a == b).all(axis=1), 1.0, np.clip(cosine, 0.0, 1.0))


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every document."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([encode(v) for v in vectors(texts)], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as many first code points of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_order(docs: DataFrame, n_parts: int) -> DataFrame:
    """part, ends, doc_id, text: ranges of descending doc_id, each with a copy of the next range's first row.

    Rows of a part stand together and in order; the copy is last and has ends = 1."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    shares = [k / n_parts for k in range(n_parts - 1, 0, -1)]
    bounds = docs.agg(F.percentile_approx("doc_id", shares, 10_000).alias("at")).first()["at"] if shares else []
    bounds = np.array(sorted(set(bounds or ())), np.int64)

    @F.pandas_udf("int")
    def part_of(doc_id: pd.Series) -> pd.Series:
        """How many bounds lie at or above a doc_id, by bisection."""
        return pd.Series((len(bounds) - np.searchsorted(bounds, doc_id.to_numpy())).astype(np.int32))

    # nulls would turn ids into floats on the way, so they are kept out; they come behind all others
    dealt = docs.withColumn("part", F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(part_of(F.coalesce("doc_id", F.lit(0)))))
    tops = dealt.groupBy("part").agg(F.max("doc_id").alias("top")).orderBy("part").collect()  # a row a part
    firsts = [(r["part"], r["top"], tops[k - 1]["part"]) for k, r in enumerate(tops)]
    if not firsts:
        return dealt.select("part", F.lit(0).alias("ends"), "doc_id", "text")
    heads = docs.sparkSession.createDataFrame(firsts, "part int, top long, before int")
    copies = dealt.join(F.broadcast(heads), (dealt["part"] == heads["part"]) & dealt["doc_id"].eqNullSafe(heads["top"])).groupBy("before", "doc_id").agg(F.max("text").alias("text"))
    both = dealt.select("part", F.lit(0).alias("ends"), "doc_id", "text").unionByName(copies.select(F.col("before").alias("part"), F.lit(1).alias("ends"), "doc_id", "text"))
    return both.repartition(n_parts, "part").sortWithinPartitions("part", "ends", F.col("doc_id").desc_nulls_last(), F.col("text").desc())


def edit_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness."""
    n_parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def finish(rows: list[tuple]) -> pa.RecordBatch | None:
            """All rows that have their next one in rows too."""
            own = [k for k in range(len(rows) - 1) if not rows[k][1] and rows[k][0] == rows[k + 1][0]]
            if not own:
                return None
            raw = [r[3].encode("utf-8", "surrogatepass") for r in rows]
            changed = [edited(rows[k][3], rows[k + 1][3]).encode("utf-8", "surrogatepass") for k in own]
            plain, new = vectors(raw), vectors(changed)
            mine, after = plain[own], plain[[k + 1 for k in own]]
            return record_batch(
                list(zip([rows[k][2] for k in own], [len(rows[k][3]) for k in own], [hashlib.sha256(c).hexdigest() for c in changed], map(encode, mine), map(encode, new), nearness(mine, new).tolist(), nearness(mine, after).tolist(), strict=True)),
                _PRINT,
            )

        size = 0
        for batch in found:
            for row in zip(*(batch.column(c).to_pylist() for c in ("part", "ends", "doc_id", "text")), strict=True):
                held.append(row)
                size += len(row[3])
                if size >= 2 * SLICE_BYTES:
                    if (out := finish(held)) is not None:
                        yield out
                    held, size = held[-1:], 0
        if (out := finish(held)) is not None:
            yield out

    return in_order(docs, n_parts).mapInArrow(run, PRINT)


def op5_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against their edited texts and their next documents."""
    return edit_likeness(spark.read.parquet(f"{sf_dir}/documents.parquet"))
