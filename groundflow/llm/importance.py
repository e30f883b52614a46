"""Operator 13: resampling documents towards a target distribution by importance of hashed n-grams.

Features are runs of 1 to `most` consecutive words; each is counted in the bucket of its CRC-32. A bucket's gain is the
logarithm of how much more often it occurs in the target texts than in the documents, smoothed by one and floored in
thousandths; a document's weight is the floored mean of its features' gains. To the weight a Gumbel number is
added that a hash of doc_id gives, and the documents with the highest sums are drawn: a draw without replacement in
proportion to the weights' exponentials.

Within each partition DuckDB cuts a slice of the texts into words, numbers them, makes n-grams by windows and
counts buckets with zlib's CRC-32 as a registered function. A document's counts, and each task's totals, are spilled to Parquet in the
shared folder (a text that is longer than a slice piece by piece); Spark's own writer does that, so that a lost task leaves nothing behind. Spark adds the totals up (a row a
bucket comes to the driver, `buckets` at most), scores the spilled counts and ranks: rows are sorted by ranges of score, and
a row's rank is its place in its range behind the ranges before. DuckDB has one thread and bounded memory in a task and
spills to the task's own temporary folder, which it deletes.

Null, empty and wordless texts have no feature, weight 0 and never reach `min_words`. Repeated rows are documents of their own. A row
without doc_id hashes as the empty id; ties are drawn by smaller doc_id, those without last, then by the other results, so that only rows that
are alike in all of them are in any order. Without documents there is no row, without a target all gains are the smoothed ones. Extra columns of the
documents come back; `text` doesn't, and columns named as the result's own give way.
"""

from __future__ import annotations

import re
import shutil
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import keep, settled, table, words_of

#: Bytes of text that DuckDB takes at once, and the memory that it may take.
SLICE_BYTES, DUCKDB_MEMORY = 1 << 19, "96MB"
OWN = ["n_words", "n_features", "weight", "score", "rank"]
#: Working columns: a document's words, buckets and their counts, packed (see packed); or a task's totals by bucket.
SPILL = "_n_words long, _buckets binary, _counts binary, _totals array<long>"
_SPILL = {"_n_words": pa.int64(), "_buckets": pa.binary(), "_counts": pa.binary(), "_totals": pa.list_(pa.int64())}

#: A character that no word holds.
BORDER = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
#: Words are the runs of digits, lower-case letters and all that is not ASCII, once A-Z are in lower case.
WORDS = """CREATE TEMP TABLE words AS
SELECT r, i, w FROM (SELECT r, unnest(found) AS w, generate_subscripts(found, 1) AS i FROM
  (SELECT r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS found FROM slice) s) t"""


def slice_sql(most: int, buckets: int) -> list[str]:
    """Every run of 1 to `most` consecutive words as the words' numbers in the slice (0: none), and each distinct run's bucket."""
    ks = [f"k{n}" for n in range(most)]
    after = ", ".join(["r", "k0", *(f"lead(k0, {n}, 0) OVER (PARTITION BY r ORDER BY i) AS k{n}" for n in range(1, most))])
    runs = " UNION ALL ".join(f"SELECT r, {', '.join(k if j <= n else f'0 AS {k}' for j, k in enumerate(ks))} FROM after WHERE k{n} > 0" for n in range(most))
    text = f"concat_ws(' ', {', '.join(f'v{n}.w' for n in range(most))})"
    spelled = " ".join(f"LEFT JOIN vocabulary v{n} ON v{n}.k = d.k{n}" for n in range(most))
    return [
        "CREATE TEMP TABLE vocabulary AS SELECT w, row_number() OVER ()::INT AS k FROM (SELECT DISTINCT w FROM words) d",
        f"CREATE TEMP TABLE grams AS WITH numbered AS (SELECT r, i, k AS k0 FROM words JOIN vocabulary USING (w)), after AS (SELECT {after} FROM numbered) {runs}",
        f"CREATE TEMP TABLE hashed AS SELECT {', '.join(f'd.{k}' for k in ks)}, (crc32({text}) % {buckets})::INT AS bucket FROM (SELECT DISTINCT {', '.join(ks)} FROM grams) d {spelled}",
        f"CREATE TEMP TABLE counts AS SELECT r, bucket, count(*) AS n FROM grams JOIN hashed USING ({', '.join(ks)}) GROUP BY r, bucket",
    ]


class Counter:
    """Bucket counts of slices of texts, by DuckDB."""

    def __init__(self, most: int, buckets: int):
        import duckdb

        self.folder, self.most, self.buckets = tempfile.mkdtemp(prefix="ngrams-"), most, buckets
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": DUCKDB_MEMORY, "temp_directory": self.folder})
        self.db.create_function("crc32", self.crc32, ["VARCHAR"], "BIGINT", type="arrow")

    @staticmethod
    def crc32(features: pa.ChunkedArray) -> pa.Array:
        """Of each feature's UTF-8 bytes, which are read where they lie."""
        found = (features.combine_chunks() if isinstance(features, pa.ChunkedArray) else features).cast(pa.large_binary())
        ends = np.frombuffer(found.buffers()[1], np.int64)[found.offset : found.offset + len(found) + 1].tolist()
        data = memoryview(found.buffers()[2] or b"")
        return pa.array([zlib.crc32(data[a:b]) for a, b in zip(ends, ends[1:], strict=False)], pa.int64())

    def count(self, texts: pa.Array) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """For each text its number of words, and its buckets with their counts."""
        db = self.db
        db.register("slice", pa.table({"r": pa.array(range(len(texts)), pa.int32()), "text": texts}))
        db.execute(WORDS)
        db.unregister("slice")
        sized = db.execute("SELECT r, count(*) AS n FROM words GROUP BY r").fetchnumpy()
        n_words = np.zeros(len(texts), np.int64)
        n_words[sized["r"]] = sized["n"]
        for sql in slice_sql(self.most, self.buckets):
            db.execute(sql)
        found = db.execute("SELECT r, bucket, n FROM counts ORDER BY r, bucket").fetchnumpy()
        for name in ("words", "vocabulary", "grams", "hashed", "counts"):
            db.execute(f"DROP TABLE {name}")
        ends = np.cumsum(np.bincount(found["r"], minlength=len(texts))) if len(texts) else np.zeros(0, int)
        return n_words, np.split(found["bucket"].astype(np.int32), ends[:-1]), np.split(found["n"].astype(np.int64), ends[:-1])

    def count_long(self, text: str, piece: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """As count, for one text of any length, piece by piece. A piece ends where a word ends, and begins with the last words of the
        one before, whose own n-grams are taken off again."""
        n_words, total, start, before = 0, np.zeros(self.buckets, np.int64), 0, ""
        while start < len(text):
            border = BORDER.search(text, start + piece)
            end = border.start() if border else len(text)
            now = f"{before} {text[start:end]}"
            n, buckets, counts = self.count(pa.array([now, before]))
            n_words += int(n[0] - n[1])
            for sign, k in ((1, 0), (-1, 1)):
                total[buckets[k]] += sign * counts[k]
            before = b" ".join(words_of(now)[-(self.most - 1) :]).decode("utf-8", "surrogatepass") if self.most > 1 else ""
            start = end
        full = np.flatnonzero(total)
        return np.array([n_words]), [full.astype(np.int32)], [total[full]]

    def close(self) -> None:
        self.db.close()
        shutil.rmtree(self.folder, ignore_errors=True)


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of bounded size; a text that is larger is a run of its own."""
    start, size = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if n > SLICE_BYTES and start < k:
            yield start, k
            start, size = k, 0
        size += n + 64
        if size >= SLICE_BYTES:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def packed(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs: 2, 4 or 8."""
    most = int(values.max(initial=0))
    return values.astype("<u2" if most < 1 << 16 else "<u4" if most < 1 << 32 else "<u8").tobytes()


def unpacked(column: pa.Array, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All rows' packed numbers, and how many each row has: told by sizes, else 2 bytes each."""
    n_bytes = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1])
    sizes = n_bytes // 2 if sizes is None else sizes
    width = n_bytes // np.maximum(sizes, 1)
    if (width <= 2).all():  # as nearly always
        start = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
        return np.frombuffer(column.buffers()[2] or b"", "<u2", int(sizes.sum()), int(start)).astype(np.int64), sizes
    rows = [np.frombuffer(x, f"<u{w}").astype(np.int64) for x, w in zip(column.to_pylist(), np.maximum(width, 2).tolist(), strict=True)]
    return np.concatenate(rows), sizes


def spilled_counts(texts: DataFrame, what: str, most: int = 2, buckets: int = 10_000, rows: bool = True) -> DataFrame:
    """texts (text, ...) without text but with their bucket counts, and a row of totals for each task, in the shared folder.

    Without `rows` only the totals."""
    if buckets > 1 << 16:
        raise ValueError("buckets are numbered in 2 bytes")
    rest = [f for f in texts.schema if f.name != "text"]
    schema = StructType([*rest, *StructType.fromDDL(SPILL)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, names, counter = np.zeros(buckets, np.int64), None, Counter(most, buckets)
        try:
            for batch in batches:
                names = batch.schema
                texts = batch.column(len(rest))
                texts = pc.fill_null(texts, "") if texts.null_count else texts
                sizes = pc.binary_length(texts).to_numpy()
                for a, b in _slices(sizes):
                    long = b == a + 1 and sizes[a] > SLICE_BYTES
                    n_words, at, n = counter.count_long(texts[a].as_py(), SLICE_BYTES) if long else counter.count(texts.slice(a, b - a))
                    np.add.at(total, np.concatenate(at), np.concatenate(n))
                    if rows:
                        own = [pa.array(n_words), pa.array(map(packed, at), pa.binary()), pa.array(map(packed, n), pa.binary()), pa.nulls(b - a, _SPILL["_totals"])]
                        yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[: len(rest)]), *own], names=[*names.names[: len(rest)], *_SPILL])
        finally:
            counter.close()
        if names is not None:
            own = [*(pa.nulls(1, _SPILL[c]) for c in ("_n_words", "_buckets", "_counts")), pa.array([total], _SPILL["_totals"])]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, names.field(k).type) for k in range(len(rest))), *own], names=[*names.names[: len(rest)], *_SPILL])

    return keep(texts.select(*[f.name for f in rest], "text").mapInArrow(run, schema), what)


def bucket_totals(spilled: DataFrame, buckets: int) -> np.ndarray:
    """Occurrences by bucket: as many rows as there are buckets come to the driver, at most."""
    each = spilled.where("_totals is not null").select(F.posexplode("_totals").alias("bucket", "n"))
    found = np.zeros(buckets, np.int64)
    for r in each.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        found[r["bucket"]] = r["n"]
    return found


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain in thousandths."""
    s, t, k = documents.astype(float), target.astype(float), float(len(documents))
    return np.floor(1000.0 * np.log((t + 1.0) * (s.sum() + k) / ((s + 1.0) * (t.sum() + k)))).astype(np.int64)


def weighted(spilled: DataFrame, gain: np.ndarray) -> DataFrame:
    """The spilled documents with n_words, n_features and weight."""
    rest = [c for c in spilled.columns if c not in _SPILL]
    schema = spilled.select(*rest, *[F.lit(0).cast("long").alias(c) for c in ("n_words", "n_features", "weight")]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, sizes = unpacked(batch.column(len(rest) + 1))
            n, _ = unpacked(batch.column(len(rest) + 2), sizes)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            features, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(features, row, n)
            np.add.at(total, row, n * gain[buckets])
            n_words = batch.column(len(rest))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], n_words, pa.array(features), pa.array(total // np.maximum(features, 1))], names=[*rest, "n_words", "n_features", "weight"])

    return spilled.where("_totals is null").select(*rest, "_n_words", "_buckets", "_counts").mapInArrow(run, schema)


def with_score(documents: DataFrame, seed: int = 7) -> DataFrame:
    """The weight plus a Gumbel number in thousandths from a hash of doc_id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    draw = F.lit(-1000.0) * F.log(-F.log((h.cast("double") + F.lit(0.5)) / F.lit(4294967296.0)))
    return documents.withColumn("score", F.col("weight") + F.floor(draw))


def with_rank(scored: DataFrame, min_words: int, percent: int) -> DataFrame:
    """rank of the drawn rows: the highest scores of the given share of those with enough words; null for the others."""
    rest = [c for c in scored.columns if c not in ("doc_id", "score")]
    enough = F.col("n_words") >= min_words
    by = [(~enough).cast("int").alias("_short"), F.desc("score"), F.asc_nulls_last("doc_id"), *[F.col(c) for c in rest if c in ("n_features", "weight", "n_words")]]
    wide = scored.withColumn("_short", (~enough).cast("int"))
    order = [F.col("_short"), *by[1:]]
    ranged = wide.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = keep(ranged, "ranked")
    part = F.shiftright("_at", 33)
    sizes = ranged.where("_short = 0").groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # a row a partition
    at, before = 0, []
    for r in sizes:
        before.append((r["part"], at))
        at += r["n"]
    spark = scored.sparkSession
    starts = F.broadcast(spark.createDataFrame(before, "_part long, _before long"))
    place = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    found = ranged.withColumn("_part", part).join(starts, "_part", "left")
    return found.withColumn("rank", F.when((F.col("_short") == 0) & (place <= percent * at // 100), place)).select(*scored.columns, "rank")


def resample(documents: DataFrame, target: DataFrame, most: int = 2, buckets: int = 10_000, min_words: int = 20, percent: int = 25, seed: int = 7) -> DataFrame:
    """documents (doc_id, text, ...) with n_words, n_features, weight, score and rank (null: not drawn), towards the texts of target.

    The result reads tables in the shared folder; call it inside `settled` or `scratch`."""
    rest = [c for c in documents.columns if c not in (*OWN, *_SPILL, "_short", "_at", "_part", "_before")]
    spilled = spilled_counts(documents.select(rest), "document-grams", most, buckets)
    wanted = spilled_counts(target.select("text"), "target-grams", most, buckets, rows=False)
    gain = gains(bucket_totals(spilled, buckets), bucket_totals(wanted, buckets))
    return with_rank(with_score(weighted(spilled, gain), seed), min_words, percent)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    def made() -> DataFrame:
        found = resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
        return found.select("doc_id", "n_features", "weight", "score", "rank")

    return settled(spark, "importance-resampling", made)


#: CRC-32 is a fold over bytes with a table that is built from its polynomial.
OP13_SQL = """WITH bytes AS MATERIALIZED (SELECT list(c ORDER BY b) AS crcs FROM (SELECT b, list_reduce(list_prepend(b::UBIGINT, range(8)::UBIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c FROM range(256) q(b)) z),
texts AS (SELECT 'd' AS side, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark),
cut AS MATERIALIZED (SELECT side, r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS ws FROM texts),
words AS MATERIALIZED (SELECT side, r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM cut),
grams AS MATERIALIZED (SELECT side, r, f, count(*) AS n FROM (SELECT side, r, w AS f FROM words UNION ALL SELECT side, r, w || ' ' || lead(w) OVER (PARTITION BY side, r ORDER BY i) FROM words) g WHERE f IS NOT NULL GROUP BY ALL),
hashed AS MATERIALIZED (SELECT f, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, octet_length(e) + 1), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::UBIGINT)), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255)::INT + 1])), 4294967295::UBIGINT) % 10000 AS bucket
  FROM (SELECT f, encode(f) AS e, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM grams) d) x, bytes),
counts AS MATERIALIZED (SELECT side, r, bucket, sum(n) AS n FROM grams JOIN hashed USING (f) GROUP BY ALL),
totals AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 'b'), 0)::DOUBLE AS t FROM counts GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT coalesce(sum(s), 0) FROM totals) + 10000) / ((s + 1) * ((SELECT coalesce(sum(t), 0) FROM totals) + 10000))))::BIGINT AS g FROM totals),
weights AS (SELECT r, sum(n)::BIGINT AS n_features, floor(sum(n * g)::DOUBLE / sum(n))::BIGINT AS weight FROM counts JOIN gain USING (bucket) WHERE side = 'd' GROUP BY r),
scored AS (SELECT doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM cut LEFT JOIN weights USING (r) WHERE side = 'd'),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight, n_words) AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * (SELECT count(*) FROM scored WHERE n_words >= 20) // 100 THEN place END AS rank FROM placed"""
