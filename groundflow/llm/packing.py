"""Operator 2: vector bin packing of token sequences under three limits at once.

A piece of a document has a vector (tokens, segments, loss-bearing tokens), each divided by its limit. A
sequence is filled greedily: of the pieces in a bounded pool that still fit, the one with the largest dot
product of its vector and the sequence's remaining capacity comes next; if none fits whole, the one with the
largest product is cut to fill the rest, and its remainder returns to the pool. Loss-bearing tokens are those
behind the first `prompt_tokens` of a document (none by default: all tokens bear loss). Pieces with equal vectors are
weighed as one, so that a pool of very many short texts costs no more than their different lengths.

Every input partition packs its own documents, so nothing is shuffled and a lost task is simply repeated with
the same result. A sequence that closes short, at the end of a partition or because its segments or loss-bearing
tokens are used up, is cut into sequences whose lengths are powers of two, which need no padding; a piece goes on in the next of them.
Null or empty text is a document of the end id alone; repeated rows are packed as often as they occur, rows without doc_id
like others; a missing or negative number of prompt tokens is 0, and one beyond the document is the
whole document. An empty table gives no row. The strings of special tokens in a text are ordinary text (`tokens`).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, texts_of
from .tokens import encoder, slices

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])

#: Tokens held in the pool from which sequences are filled, as a multiple of the token limit.
POOL_SEQUENCES = 24


class Packer:
    """Fills sequences from a stream of documents; memory is bounded by the pool and one document."""

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, first_id: int):
        self.limits = np.array([max_tokens, max_segments, max_loss], float)
        self.next_id = first_id
        self.place: dict[tuple[int, int], int] = {}  # of each vector among the groups
        self.groups: list[list[tuple]] = []  # documents (doc_id, ids, start of what is left) with that vector
        self.vectors = np.zeros((64, 2), np.int64)  # tokens left, and those without loss at their start
        self.held = 0
        self.out: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray, prompt: int, start: int = 0) -> None:
        """A document of which the ids from `start` on are left, the first `prompt` of those without loss."""
        left = len(ids) - start
        key = left, min(max(prompt, 0), left)
        k = self.place.get(key)
        if k is None:
            k = self.place[key] = len(self.groups)
            self.groups.append([])
            if k == len(self.vectors):
                self.vectors = np.concatenate((self.vectors, np.zeros_like(self.vectors)))
            self.vectors[k] = key
        self.groups[k].append((doc_id, ids, start))
        self.held += left

    def choose(self, rest: np.ndarray) -> tuple[int, int]:
        """The next piece's group and the piece's length; length 0: nothing can be added."""
        left, prompt = self.vectors[: len(self.groups)].T
        score = left * (rest[0] / self.limits[0] ** 2) + rest[1] / self.limits[1] ** 2 + (left - prompt) * (rest[2] / self.limits[2] ** 2)
        takes = np.minimum(np.minimum(left, int(rest[0])), int(rest[2]) + prompt)
        whole = takes == left
        k = int(np.argmax(np.where(whole, score, -1.0))) if whole.any() else int(np.argmax(np.where(takes > 0, score, -1.0)))
        return k, int(takes[k])

    def take(self, k: int, n: int) -> tuple:
        """A piece of n ids of a document of the group; the rest of the document goes back into the pool."""
        left, prompt = self.vectors[k].tolist()
        doc_id, ids, at = self.groups[k].pop()
        self.held -= left
        if not self.groups[k]:
            last = len(self.groups) - 1
            del self.place[left, prompt]
            if k != last:
                self.groups[k], self.vectors[k] = self.groups[last], self.vectors[last]
                self.place[tuple(self.vectors[k].tolist())] = k
            self.groups.pop()
        if n < left:
            self.add(doc_id, ids, prompt - n, at + n)
        return doc_id, at, n, zlib.crc32(ids[at : at + n].astype("<u4").tobytes()), len(ids), n - min(n, prompt), ids

    def fill(self) -> list[tuple]:
        rest, pieces = self.limits.copy(), []
        while rest[0] > 0 and rest[1] > 0 and self.groups:
            k, n = self.choose(rest)
            if n <= 0:
                break
            pieces.append(self.take(k, n))
            rest -= (n, 1, pieces[-1][5])
        return pieces

    def emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc_id, start, n, crc, total, loss, _ in pieces:
            self.out.append((doc_id, start, n, crc, total, self.next_id, at, loss))
            at += n
        self.next_id += 1

    def emit_tail(self, pieces: list[tuple]) -> None:
        """Cut a partly filled sequence into ones whose lengths are powers of two."""
        total = sum(p[2] for p in pieces)
        room, current = 1 << (total.bit_length() - 1), []
        for doc_id, start, n, _, whole, loss, ids in pieces:
            free = n - loss  # prompt tokens of this piece still to place
            while n:
                k = min(n, room)
                current.append((doc_id, start, k, zlib.crc32(ids[start : start + k].astype("<u4").tobytes()), whole, k - min(k, free), ids))
                start, n, room, total, free = start + k, n - k, room - k, total - k, max(0, free - k)
                if not room:
                    self.emit(current)
                    room, current = 1 << (total.bit_length() - 1) if total else 0, []

    def drain(self, down_to: int) -> None:
        while self.held > down_to:
            pieces = self.fill()
            if sum(p[2] for p in pieces) < self.limits[0]:
                self.emit_tail(pieces)
            else:
                self.emit(pieces)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, max_tokens: int = 4096, max_segments: int = 64, max_loss: int | None = None, prompt_column: str | None = None, keeps_space: bool = False) -> DataFrame:
    """One row for each piece: where it lies in its document and in its sequence. docs: doc_id, text."""
    max_loss = max_tokens if max_loss is None else max_loss
    if min(max_tokens, max_segments, max_loss) < 1:
        raise ValueError("a sequence takes at least one token, one segment and one loss-bearing token")
    prompt = F.coalesce(F.col(prompt_column), F.lit(0)).cast("long") if prompt_column else F.lit(0).cast("long")

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path, keeps_space)
        packer = Packer(max_tokens, max_segments, max_loss, TaskContext.get().partitionId() << 32)

        def rows() -> Iterator[tuple]:
            for batch in found:
                ids, prompts, k = batch.column("doc_id").to_pylist(), batch.column("prompt").to_pylist(), 0
                for texts in slices(texts_of(batch)):
                    for got in coder.encode(texts):
                        packer.add(ids[k], np.append(got, coder.dtype.type(end_id)), prompts[k])
                        k += 1
                        if packer.held > 2 * POOL_SEQUENCES * max_tokens:
                            packer.drain(POOL_SEQUENCES * max_tokens)
                            yield from packer.out
                            packer.out = []
            packer.drain(0)
            yield from packer.out

        yield from batches(rows(), _ARROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", prompt.alias("prompt")).mapInArrow(run, SCHEMA)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with word_bpe_49k and end id 2, in sequences of at most 4096 tokens."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
