"""Operator 11: how probable a text is, over all ways to cut it into subwords.

The pieces are those of an existing public vocabulary; it is never trained. A text is its words (runs of anything but ASCII white
space, A-Z in lower case), each behind a mark, and one end. A word's probability is the sum over all ways to spell mark and word
with pieces of the product of the pieces' probabilities, worked out in log space from left to right; bytes are pieces
too, so that everything can be spelled. A text's probability is the product over its words and the end, as no piece reaches over
a mark: `score` is its base-10 logarithm.

The vocabulary's scores give the pieces' first probabilities: as logarithms if it is a unigram vocabulary, and where they are ranks
in which pieces were merged, as weights that fall with the rank. The training texts then move them: `rounds` times, every
distinct word's expected pieces over all its spellings are counted as often as the word occurs (expectation maximisation), and
the first probabilities stay in as many counts as there are pieces. Expected counts are whole numbers of 1/1024, so that
they add up alike on any cluster. Zero rounds leave the vocabulary's own weights.

Texts are cut into blocks of bounded size, written once: a row a document with its words as numbers within the block, and the block's
distinct words, packed by buckets that a hash of the word chooses. A bucket's words from all blocks meet once: they are counted, and
the blocks' lists become numbers of the bucket's distinct words. Those are spelled once each, many at a time, and their values go back to
the blocks as packed lists, where documents add them up. There are as many buckets as the texts' bytes ask for. The driver
gets a row a piece, which the vocabulary bounds, and the totals.

`base_score` is the score of single words with one added to each count. Null and empty texts have the end alone. Words as long as
a whole text are spelled like others, in time that grows with their length. Rows without doc_id are scored but not learned from, and
count as held out; repeated rows count as often as they occur. Without training texts all words are unknown. An empty table
gives no row. Extra columns come back, but for `text`; those named as the result's own give way.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import LOWER_BYTES, keep, settled, table

#: Bytes of text in a block, and what a document adds besides.
BLOCK_BYTES, DOC_BYTES = 8 << 20, 32
#: The mark before a word, which no UTF-8 text holds, and what stands for it in the vocabulary's file.
MARK, FILE_MARK = b"\xff", "▁"
#: Added to ranks, so that the first ones do not take all.
RANK_OFFSET = 100.0
#: Bytes of text for each bucket of words, and words that are spelled at once; longer ones than LONG bytes are spelled one by one.
BUCKET_BYTES, AT_ONCE, LONG = 16 << 20, 20_000, 64
#: Expected counts are kept as integers of this many parts.
UNIT = 1024
OWN = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
WORKING = "_block long, _kind int, _no int, _ids array<int>, _train boolean, _bucket int, _words array<binary>, _n array<long>"
_WORKING = {"_block": pa.int64(), "_kind": pa.int32(), "_no": pa.int32(), "_ids": pa.list_(pa.int32()), "_train": pa.bool_(), "_bucket": pa.int32(), "_words": pa.list_(pa.binary()), "_n": pa.list_(pa.int64())}


def is_training() -> Column:
    """Documents to learn from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 != 2, F.lit(False))


def words_and_end(text: str) -> list[bytes]:
    """The text's words, and the end as an empty word."""
    return [*text.encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split(), b""]


@dataclass(frozen=True)
class Pieces:
    """Pieces (the empty one is the end) with the logarithms of their probabilities."""

    names: list[bytes]
    logs: list[float]

    @classmethod
    def of(cls, names: list[bytes], weights: np.ndarray) -> Pieces:
        return cls(names, np.log(weights / weights.sum()).tolist())

    def lattice(self) -> Lattice:
        return Lattice(self)

    def lattices(self) -> Lattices:
        return Lattices(self)


def existing_pieces(path: str) -> Pieces:
    """A sentencepiece vocabulary's pieces, with the bytes and the end, weighted by its scores."""
    from sentencepiece import SentencePieceProcessor

    file = SentencePieceProcessor(model_file=path)
    scores: dict[bytes, float] = {}
    for k in range(file.get_piece_size()):
        name = file.id_to_piece(k)
        if file.is_byte(k) or file.is_control(k) or file.is_unknown(k) or file.is_unused(k) or FILE_MARK in name[1:]:
            continue
        scores[(MARK if name[0] == FILE_MARK else b"") + name.lstrip(FILE_MARK).encode()] = file.get_score(k)
    least = min(scores.values(), default=0.0) - 1.0
    for b in (bytes([b]) for b in range(256)):
        scores.setdefault(b, least)
    scores.setdefault(MARK, least)
    value = np.array(list(scores.values()))
    weights = 1.0 / (RANK_OFFSET - value) if (value == np.floor(value)).all() else np.exp(value)
    return Pieces.of([*scores, b""], np.append(weights, weights.mean()))


class Lattice:
    """All spellings of a word."""

    def __init__(self, pieces: Pieces):
        self.end = pieces.logs[pieces.names.index(b"")]
        self.number: dict[bytes, int] = {}
        for k, name in enumerate(pieces.names):  # -1: only the beginning of pieces
            for n in range(1, len(name)):
                self.number.setdefault(name[:n], -1)
            if name:
                self.number[name] = k
        self.logs = pieces.logs

    def edges(self, word: bytes) -> list[list[tuple[int, int]]]:
        """For each place the pieces that start there: where they end, and their numbers."""
        text, number, found = MARK + word, self.number.get, []
        n = len(text)
        for i in range(n):
            here = []
            for j in range(i + 1, n + 1):
                k = number(text[i:j])
                if k is None:
                    break
                if k >= 0:
                    here.append((j, k))
            found.append(here)
        return found

    def forward(self, edges: list[list[tuple[int, int]]]) -> list[float]:
        """Logarithms of the probability of all spellings up to each place."""
        logs, upto, exp, log1p = self.logs, [-math.inf] * (len(edges) + 1), math.exp, math.log1p
        upto[0] = 0.0
        for i, here in enumerate(edges):
            a = upto[i]
            if a == -math.inf:
                continue
            for j, k in here:
                new, old = a + logs[k], upto[j]
                if old == -math.inf:
                    upto[j] = new
                else:
                    upto[j] = old + log1p(exp(new - old)) if old >= new else new + log1p(exp(old - new))
        return upto

    def log10(self, word: bytes) -> float:
        """Of the word's probability; of the end's for the empty word."""
        return (self.forward(self.edges(word))[-1] if word else self.end) / math.log(10.0)

    def expected(self, word: bytes, n: int = 1) -> dict[int, int]:
        """How often each piece is expected in n spellings of the word, in parts of 1 / UNIT."""
        edges = self.edges(word)
        upto = self.forward(edges)
        m, logs, found = len(edges), self.logs, {}
        onwards = [-math.inf] * m + [0.0]
        for i in range(m - 1, -1, -1):
            parts = [(j, k, logs[k] + onwards[j]) for j, k in edges[i] if onwards[j] > -math.inf]
            if not parts:
                continue
            top = max(p[2] for p in parts)
            onwards[i] = top + math.log(sum(math.exp(p[2] - top) for p in parts))
            for _, k, p in parts:
                found[k] = found.get(k, 0) + round(n * UNIT * math.exp(upto[i] + p - upto[m]))
        return found


class Lattices:
    """All spellings of many words at once: words of one length walk the pieces' tree together."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.logs, self.one_by_one = pieces, np.array(pieces.logs), None
        self.end = pieces.names.index(b"")
        steps: dict[tuple[int, int], int] = {}
        ends = {}
        for k, name in enumerate(pieces.names):
            node = 0
            for b in name:
                node = steps.setdefault((node, b), len(steps) + 1)
            ends[node] = k
        self.child = np.zeros((len(steps) + 1, 256), np.int32)
        at = np.array(list(steps), np.int64).reshape(-1, 2)
        self.child[at[:, 0], at[:, 1]] = list(steps.values())
        self.piece = np.full(len(steps) + 1, -1, np.int64)
        self.piece[list(ends)] = list(ends.values())

    def _groups(self, words: list[bytes]) -> Iterator[np.ndarray]:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(sizes).tolist():
            same = np.flatnonzero(sizes == n)
            for k in range(0, len(same), AT_ONCE):
                yield same[k : k + AT_ONCE]

    def _forward(self, text: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray, np.ndarray]]]:
        """For each place the logarithm of the probability of all spellings up to it, and the pieces: from, to, words, numbers."""
        n, m = text.shape
        upto, edges, every = np.full((m + 1, n), -np.inf), [], np.arange(n)
        upto[0] = 0.0
        for i in range(m):
            words, node = every, np.zeros(n, np.int32)
            for j in range(i, m):
                node = self.child[node, text[words, j]]
                going = np.flatnonzero(node)
                if not len(going):
                    break
                words, node = words[going], node[going]
                k = self.piece[node]
                whole = np.flatnonzero(k >= 0)
                own, k = words[whole], k[whole]
                upto[j + 1, own] = np.logaddexp(upto[j + 1, own], upto[i, own] + self.logs[k])
                edges.append((i, j + 1, own, k))
        return upto, edges

    def _texts(self, words: list[bytes], rows: np.ndarray) -> np.ndarray:
        return np.frombuffer(b"".join([MARK + words[r] for r in rows.tolist()]), np.uint8).reshape(len(rows), -1)

    def _slowly(self) -> Lattice:
        self.one_by_one = self.one_by_one or self.pieces.lattice()
        return self.one_by_one

    def log10(self, words: list[bytes]) -> np.ndarray:
        found = np.zeros(len(words))
        for rows in self._groups(words):
            n = len(words[rows[0]])
            if not n:
                found[rows] = self.logs[self.end] / math.log(10.0)
            elif n > LONG:
                found[rows] = [self._slowly().log10(words[r]) for r in rows.tolist()]
            else:
                found[rows] = self._forward(self._texts(words, rows))[0][-1] / math.log(10.0)
        return found

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """How often each piece is expected in the words, each as often as counted, in parts of 1 / UNIT."""
        found = np.zeros(len(self.logs), np.int64)
        for rows in self._groups(words):
            if not len(words[rows[0]]):
                continue
            if len(words[rows[0]]) > LONG:
                for r in rows.tolist():
                    for k, parts in self._slowly().expected(words[r], int(counts[r])).items():
                        found[k] += parts
                continue
            text, n = self._texts(words, rows), counts[rows] * UNIT
            upto, edges = self._forward(text)
            onwards = np.full(upto.shape, -np.inf)
            onwards[-1] = 0.0
            for i, j, own, k in reversed(edges):
                part = self.logs[k] + onwards[j, own]
                onwards[i, own] = np.logaddexp(onwards[i, own], part)
                np.add.at(found, k, np.rint(n[own] * np.exp(upto[i, own] + part - upto[-1, own])).astype(np.int64))
        return found


class Block:
    """Documents' words as numbers, until the block is full."""

    def __init__(self, number: int):
        self.number, self.size = number, 0
        self.words: dict[bytes, int] = {b"": 0}
        self.ids: list[np.ndarray] = []
        self.train: list[bool] = []

    def add(self, text: str, train: bool) -> None:
        words = self.words
        found = words_and_end(text)
        self.ids.append(np.fromiter((words.setdefault(w, len(words)) for w in found), np.int32, len(found)))
        self.train.append(train)
        self.size += len(text) + DOC_BYTES


def blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """docs (..., text, _train) in blocks, in the shared folder: documents (_kind 0) with the numbers of their words in the block,
    and the block's words (_kind 1), a row a bucket, with their counts in its training texts. Words are numbered bucket by bucket."""
    rest = [f for f in docs.schema if f.name not in ("text", "_train")]
    names = [f.name for f in rest]
    schema = StructType([*rest, *StructType.fromDDL(WORKING)])

    def batch_of(n: int, columns: list[pa.Array], own: dict[str, pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*columns, *(own.get(c, pa.nulls(n, t)) for c, t in _WORKING.items())], names=[*names, *_WORKING])

    def rows(block: Block, documents: list[list[pa.Array]], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
        n_words, sizes = len(block.words), np.array([len(x) for x in block.ids])
        bucket = np.fromiter((zlib.crc32(w) % buckets for w in block.words), np.int32, n_words)
        order = np.argsort(bucket, kind="stable")
        number = np.empty(n_words, np.int32)
        number[order] = np.arange(n_words, dtype=np.int32)
        ids, train = number[np.concatenate(block.ids)], np.repeat(block.train, sizes)
        counts = np.bincount(ids[train], minlength=n_words)
        ends, at = np.concatenate(([0], np.cumsum(sizes))), 0
        for columns in documents:
            n = len(columns[-1])
            part = pa.ListArray.from_arrays(pa.array(ends[at : at + n + 1] - ends[at], pa.int32()), pa.array(ids[ends[at] : ends[at + n]]))
            own = {"_block": pa.array([block.number] * n, pa.int64()), "_kind": pa.array([0] * n, pa.int32()), "_no": pa.array(range(at, at + n), pa.int32()), "_train": pa.array(block.train[at : at + n]), "_ids": part}
            yield batch_of(n, columns[:-1], own)
            at += n
        first = np.flatnonzero(np.concatenate(([True], bucket[order][1:] != bucket[order][:-1])))
        lists = pa.array(np.append(first, n_words), pa.int32())
        words, n = list(block.words), len(first)
        own = {"_block": pa.array([block.number] * n, pa.int64()), "_kind": pa.array([1] * n, pa.int32()), "_bucket": pa.array(bucket[order][first])}
        own["_words"] = pa.ListArray.from_arrays(lists, pa.array([words[k] for k in order.tolist()], pa.binary()))
        own["_n"] = pa.ListArray.from_arrays(lists, pa.array(counts, pa.int64()))
        yield batch_of(n, [pa.nulls(n, t) for t in types], own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        block, documents, types = Block(number), [], []
        for batch in batches:
            types = [f.type for f in batch.schema][: len(names)]
            texts, train = (batch.column(len(names) + k) for k in range(2))
            start = 0
            held = lambda a, b: [*(c.slice(a, b - a) for c in batch.columns[: len(names)]), train.slice(a, b - a)]  # noqa: B023, E731
            for k, (text, t) in enumerate(zip(texts.to_pylist(), train.to_pylist(), strict=True)):
                block.add(text or "", t)
                if block.size >= BLOCK_BYTES:
                    yield from rows(block, [*documents, held(start, k + 1)], types)
                    number += 1
                    block, documents, start = Block(number), [], k + 1
            if start < len(texts):
                documents.append(held(start, len(texts)))
        if block.ids:
            yield from rows(block, documents, types)

    return keep(docs.select(*names, "text", "_train").mapInArrow(run, schema), "word-blocks", "_kind")


def _by(keys: np.ndarray) -> list[tuple[int, int]]:
    edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else []
    return list(zip(edges, edges[1:], strict=False))


#: Rows of a bucket: its distinct words with their counts (_block null), and for each block the numbers of its words among them.
BUCKET = "_bucket int, _block long, _words array<binary>, _n array<long>, _ids array<int>"
_BUCKET = pa.schema([("_bucket", pa.int32()), ("_block", pa.int64()), ("_words", pa.list_(pa.binary())), ("_n", pa.list_(pa.int64())), ("_ids", pa.list_(pa.int32()))])


def counted(rows: DataFrame) -> DataFrame:
    """The blocks' words, counted bucket by bucket, in the shared folder."""

    def bucket_rows(bucket: int, blocks: list[int], words: list[pa.Array], n: list[pa.Array]) -> pa.RecordBatch:
        found = pa.concat_arrays(words).dictionary_encode()
        at = found.indices.to_numpy()
        totals = np.zeros(len(found.dictionary), np.int64)
        np.add.at(totals, at, pa.concat_arrays(n).to_numpy())
        ends = np.concatenate(([0, 0], np.cumsum([len(w) for w in words])))
        none = [None] * len(blocks)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([bucket] * (len(blocks) + 1), pa.int32()),
                pa.array([None, *blocks], pa.int64()),
                pa.concat_arrays([pa.ListArray.from_arrays(pa.array([0, len(found.dictionary)], pa.int32()), found.dictionary), pa.array(none, pa.list_(pa.binary()))]),
                pa.concat_arrays([pa.ListArray.from_arrays(pa.array([0, len(totals)], pa.int32()), pa.array(totals)), pa.array(none, pa.list_(pa.int64()))]),
                pa.ListArray.from_arrays(pa.array([None, *ends[1:].tolist()], pa.int32()), pa.array(at, pa.int32())),
            ],
            schema=_BUCKET,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blocks, words, n = None, [], [], []
        for batch in batches:
            key = batch.column(0).to_numpy()
            for a, b in _by(key):
                if key[a] != bucket:
                    if bucket is not None:
                        yield bucket_rows(bucket, blocks, words, n)
                    bucket, blocks, words, n = int(key[a]), [], [], []
                for r in range(a, b):
                    blocks.append(batch.column(1)[r].as_py())
                    words.append(batch.column(2)[r].values)
                    n.append(batch.column(3)[r].values)
        if bucket is not None:
            yield bucket_rows(bucket, blocks, words, n)

    packed = rows.where("_kind = 1").select("_bucket", "_block", "_words", "_n").repartition("_bucket").sortWithinPartitions("_bucket", "_block")
    return keep(packed.mapInArrow(run, BUCKET), "word-counts")


def learn(counts: DataFrame, pieces: Pieces, texts: int, rounds: int) -> Pieces:
    """The pieces with probabilities from the buckets' words: expected counts, and the first probabilities as so many counts as
    there are pieces. texts: how many ends there are."""
    first = np.exp(pieces.logs)
    prior = first / first.sum() * len(first)
    end = pieces.names.index(b"")
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], pieces: Pieces = pieces) -> Iterator[pa.RecordBatch]:
            lattices, found = pieces.lattices(), np.zeros(len(pieces.names), np.int64)
            for batch in batches:
                for words, n in zip(batch.column(0), batch.column(1), strict=True):
                    n = n.values.to_numpy()
                    known = np.flatnonzero(n)
                    found += lattices.expected(words.values.take(pa.array(known)).to_pylist(), n[known])
            told = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(told, pa.int32()), pa.array(found[told])], names=["piece", "parts"])

        told = counts.where("_block is null").select("_words", "_n").mapInArrow(run, "piece int, parts long").groupBy("piece").agg(F.sum("parts").alias("parts")).collect()
        expected = np.zeros(len(first))
        expected[[r["piece"] for r in told]] = [r["parts"] / UNIT for r in told]
        expected[end] = texts
        pieces = Pieces.of(pieces.names, expected + prior)
    return pieces


def valued(counts: DataFrame, pieces: Pieces) -> DataFrame:
    """_block, _bucket, and for each of the block's words of the bucket its count in all training texts (_n) and its logarithm (_log10)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices, n, logs = pieces.lattices(), None, None
        for batch in batches:
            for r in range(batch.num_rows):
                bucket, block, words, counts, ids = (batch.column(k)[r] for k in range(5))
                if not block.is_valid:  # comes first
                    n, logs = counts.values.to_numpy(), lattices.log10(words.values.to_pylist())
                    continue
                at = ids.values.to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array([block.as_py()], pa.int64()), pa.array([bucket.as_py()], pa.int32()), pa.array([n[at]], pa.list_(pa.int64())), pa.array([logs[at]], pa.list_(pa.float64()))], names=["_block", "_bucket", "_n", "_log10"])

    met = counts.repartition("_bucket").sortWithinPartitions("_bucket", F.asc_nulls_first("_block"))
    return met.mapInArrow(run, "_block long, _bucket int, _n array<long>, _log10 array<double>")


def score(docs: DataFrame, vocabulary: str, training: Column | None = None, rounds: int = 2) -> DataFrame:
    """docs (doc_id, text, ...) without text but with held_out, n_tokens, n_known, train_tokens, base_score and score.

    The result reads tables in the shared folder; call it inside `settled` or `scratch`."""
    rest = [c for c in docs.columns if c not in ("text", *OWN, *_WORKING)]
    texts = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    rows = blocks(docs.select(*rest, "text").withColumn("_train", is_training() if training is None else training), 1 + texts // BUCKET_BYTES)
    counts = counted(rows)
    each = counts.where("_block is null").select(F.explode(F.arrays_zip("_words", "_n")).alias("w")).select(F.col("w._words").alias("word"), F.col("w._n").alias("n"))
    of = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("v"), F.coalesce(F.sum(F.when(F.length("word") == 0, F.col("n"))), F.lit(0)).alias("ends")).first()
    pieces = learn(counts, existing_pieces(vocabulary), of["ends"], rounds)
    types = {f.name: f.dataType for f in rows.schema}
    columns = [*rest, "_block", "_bucket", "_no", "_ids", "_train", "_n", "_log10"]
    empty = lambda c: F.lit(None).cast(types.get(c, "array<double>")).alias(c)
    told = valued(counts, pieces).select(*[empty(c) for c in rest], "_block", "_bucket", empty("_no"), empty("_ids"), empty("_train"), "_n", "_log10")
    documents = rows.where("_kind = 0").select(*rest, "_block", empty("_bucket"), "_no", "_ids", "_train", empty("_n"), empty("_log10"))
    met = documents.select(columns).unionByName(told).repartition("_block").sortWithinPartitions("_block", F.asc_nulls_last("_bucket"), "_no")
    total, denominator = of["n"], float(of["n"] + of["v"] + 1)
    schema = StructType([*docs.select(rest).schema, *StructType.fromDDL("held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, n, logs = None, [], []
        for batch in batches:
            at = {c: batch.column(len(rest) + k) for k, c in enumerate(columns[len(rest) :])}
            key, is_doc = at["_block"].to_numpy(), at["_bucket"].is_null().to_numpy(zero_copy_only=False)
            for a, b in _by(key * 2 + is_doc):
                if key[a] != block:
                    block, n, logs = key[a], [], []
                if not is_doc[a]:  # the block's words, bucket by bucket, come first
                    n.append(at["_n"].slice(a, b - a).flatten().to_numpy())
                    logs.append(at["_log10"].slice(a, b - a).flatten().to_numpy())
                    continue
                n, logs = [np.concatenate(n)], [np.concatenate(logs)]
                ids = at["_ids"].slice(a, b - a)
                words, sizes = ids.flatten().to_numpy(), np.diff(ids.offsets.to_numpy())
                starts = np.cumsum(sizes) - sizes  # every document has an end at least
                summed = lambda v: np.add.reduceat(v, starts)  # noqa: B023, E731
                base = np.log10((n[0] + 1) / denominator)
                own = [pa.array(~at["_train"].slice(a, b - a).to_numpy(zero_copy_only=False).astype(bool)), pa.array(sizes.astype(np.int64)), pa.array(summed((n[0] > 0).astype(np.int64)[words])), pa.array(np.full(b - a, total)), pa.array(summed(base[words])), pa.array(summed(logs[0][words]))]
                yield pa.RecordBatch.from_arrays([*(x.slice(a, b - a) for x in batch.columns[: len(rest)]), *own], names=[*rest, *OWN])

    return met.mapInArrow(run, schema)


def op11_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return settled(spark, "lattice-scores", lambda: score(docs, public_tokenizers.path("piece_bpe_32k.model")))
