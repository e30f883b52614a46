"""Operator 6: benchmark decontamination by a distributed positional inverted index.

The index cuts the training documents into blocks of bounded size. For each block it stores one row a term with
all its positions in the block, and one row with the block's documents (ids, number of words, first position).
Positions run through a block; documents are `GAP` positions apart, so that no phrase crosses two. All terms are stored.

Test items are a table, as large as it may be; nothing of it goes through the driver. Their terms' numbers of occurrences
come from the index, and every window of an item (10 consecutive words, or the whole of a shorter item) is anchored at its
rarest term. Only where a block holds an anchor is the item searched there: postings, items and documents meet block by
block. Within a block a window's rarest term's postings minus the term's offset are the candidate starts; they are
intersected with the offset-adjusted postings of the other terms, from rare to frequent. Proximity search takes an item's
rarest terms and returns the places where all of them lie within a number of positions.

Words are the maximal runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] with A-Z in lower case. Null or empty texts have no
words and no hits; items without words occur nowhere. Rows with equal doc_id are told apart, rows without doc_id are
searched like others; items with equal item_id count once, and one without item_id marks words as hit but is not listed.
An empty documents table gives no row, an empty benchmark no hit. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, settled, words_of

WINDOW = 10
#: Bytes of text in a block.
BLOCK_BYTES = 8 << 20
#: Free positions between documents; more than any item's window and any proximity asked for.
GAP = 1 << 10
#: What a document adds to its block's size besides its text, so that a block's documents are bounded too.
DOC_BYTES = 32

#: A row of the index: a term's number and differences of positions, or (term null) a block's documents with words and starts.
INDEX = "block long, term binary, n int, positions array<int>, doc_ids array<long>, n_words array<long>"
_INDEX = pa.schema([("block", pa.int64()), ("term", pa.binary()), ("n", pa.int32()), ("positions", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64()))])
ITEM = "name string, words array<binary>"
_ITEM = pa.schema([("name", pa.string()), ("words", pa.list_(pa.binary()))])
FOUND = "block long, doc_no long, doc_id long, n_words long, places array<long>, items array<string>"
_FOUND = pa.schema([("block", pa.int64()), ("doc_no", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("places", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])


class Block:
    """Collects the postings of documents until it is full."""

    def __init__(self, number: int):
        self.number, self.size, self.at = number, 0, 0
        self.terms: dict[bytes, int] = {}
        self.ids: list = []
        self.n_words: list[int] = []
        self.starts: list[int] = []
        self.term: list[np.ndarray] = []

    def add(self, doc_id: int | None, text: str) -> None:
        words, terms = words_of(text), self.terms
        self.term.append(np.fromiter((terms.setdefault(w, len(terms)) for w in words), np.int32, len(words)))
        self.ids.append(doc_id)
        self.n_words.append(len(words))
        self.starts.append(self.at)
        self.at += len(words) + GAP
        self.size += len(text) + DOC_BYTES

    def rows(self) -> Iterator[pa.RecordBatch]:
        term, starts, n_words = np.concatenate(self.term), np.array(self.starts), np.array(self.n_words)
        position = np.arange(len(term)) + np.repeat(starts - np.cumsum(n_words) + n_words, n_words)
        order = np.argsort(term, kind="stable")
        term, position = term[order], position[order]
        first = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.zeros(0, np.int64)
        step = np.diff(position, prepend=0)
        step[first] = position[first]
        names, n = list(self.terms), len(first) + 1
        ends = np.append(first, len(term))
        lists = pa.concat_arrays([pa.array([np.diff(starts, prepend=0)], pa.list_(pa.int32())), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(step, pa.int32()))])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n, self.number), pa.int64()),
                pa.array([None, *(names[k] for k in term[first].tolist())], pa.binary()),
                pa.array(np.concatenate(([len(starts)], np.diff(ends))), pa.int32()),
                lists,
                pa.array([self.ids, *[None] * (n - 1)], pa.list_(pa.int64())),
                pa.array([self.n_words, *[None] * (n - 1)], pa.list_(pa.int64())),
            ],
            schema=_INDEX,
        )


def build_index(docs: DataFrame) -> DataFrame:
    """The index of docs (doc_id, text), written to the shared folder."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        block = Block(number)
        for batch in found:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                block.add(doc_id, text or "")
                if block.size >= BLOCK_BYTES:
                    yield from block.rows()
                    number += 1
                    block = Block(number)
        if block.ids:
            yield from block.rows()

    return keep(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, INDEX), "positional-index")


def items_of(benchmark: DataFrame) -> DataFrame:
    """no, name (the item_id as text) and words of the items that have words, written to the shared folder."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            words = [words_of(t or "") for t in batch.column("text").to_pylist()]
            rows = pa.RecordBatch.from_arrays([batch.column("name"), pa.array(words, _ITEM.field("words").type)], schema=_ITEM)
            yield rows.filter(pa.array([bool(w) for w in words], pa.bool_()))

    named = benchmark.select(F.col("item_id").cast("string").alias("name"), "text").mapInArrow(run, ITEM)
    return keep(named.withColumn("no", F.monotonically_increasing_id()), "benchmark-items")


def window_anchors(words: list[bytes], counts: np.ndarray, size: int = WINDOW) -> set[bytes]:
    """The rarest term of each window whose terms all occur."""
    size = min(size, len(words))
    absent = np.concatenate(([0], np.cumsum(counts == 0)))
    open_ = np.flatnonzero(absent[size:] == absent[: len(words) - size + 1])
    if not len(open_):
        return set()
    spans = np.lib.stride_tricks.sliding_window_view(counts, size)[open_]
    return {words[k] for k in np.unique(open_ + spans.argmin(axis=1)).tolist()}


class Searcher:
    """One block's postings."""

    def __init__(self, postings: dict[bytes, np.ndarray]):
        self.postings = postings

    def count(self, term: bytes) -> int:
        return len(self.postings.get(term, ()))

    def holds(self, term: bytes, places: np.ndarray) -> np.ndarray:
        """Which places have the term."""
        own = self.postings.get(term)
        if own is None:
            return np.zeros(len(places), bool)
        return own[np.minimum(np.searchsorted(own, places), len(own) - 1)] == places

    def windows(self, words: list[bytes], size: int = WINDOW) -> np.ndarray:
        """(place, length) of every window of the item that occurs."""
        size = min(size, len(words))
        counts = np.array([self.count(w) for w in words])
        n = len(words) - size + 1
        # a window in which a term is absent can't occur
        absent = np.concatenate(([0], np.cumsum(counts == 0)))
        open_ = np.flatnonzero(absent[size:] == absent[:n])
        if not len(open_):
            return np.zeros((0, 2), np.int64)
        spans = np.lib.stride_tricks.sliding_window_view(counts, size)[open_]
        anchors = open_ + spans.argmin(axis=1)
        found = []
        for anchor in np.unique(anchors).tolist():
            served = open_[anchors == anchor]
            starts = self.postings[words[anchor]] - anchor  # where the item's first word would be
            for w in served.tolist():
                left = starts
                for k in sorted(range(w, w + size), key=counts.__getitem__):
                    if k != anchor and len(left):
                        left = left[self.holds(words[k], left + k)]
                found.append(left + w)
        places = np.unique(np.concatenate(found))
        return np.stack((places, np.full(len(places), size)), axis=1)

    def near(self, rare: list[bytes], within: int) -> np.ndarray:
        """Places of the first term around which all others lie within so many positions."""
        left = self.postings.get(rare[0], np.zeros(0, np.int64))
        for w in rare[1:]:
            own = self.postings.get(w, np.zeros(0, np.int64))
            left = left[np.searchsorted(own, left + within, side="right") > np.searchsorted(own, left - within)]
        return left


class Hits:
    """What was found in one block."""

    def __init__(self, number: int, ids: pa.Array, n_words: pa.Array, starts: np.ndarray):
        self.number, self.ids, self.n_words, self.starts = number, ids, n_words, starts
        self.spans: list[np.ndarray] = []
        self.items: dict[int, set[str]] = {}

    def add(self, name: str | None, got: np.ndarray) -> None:
        if len(got):
            self.spans.append(got)
            if name is not None:
                for k in np.unique(np.searchsorted(self.starts, got[:, 0], side="right") - 1).tolist():
                    self.items.setdefault(k, set()).add(name)
            if len(self.spans) > 1000:
                self.spans = [np.unique(np.concatenate(self.spans), axis=0)]

    def rows(self) -> pa.RecordBatch:
        covered, starts, n = np.zeros(0, np.int64), self.starts, len(self.starts)
        if self.spans:
            spans = np.unique(np.concatenate(self.spans), axis=0)
            covered = np.unique(np.concatenate([np.arange(a, a + k) for a, k in spans.tolist()]))
        owner = np.searchsorted(starts, covered, side="right") - 1
        places = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), pa.array(covered - starts[owner], pa.int64()))
        items = pa.array([sorted(self.items.get(k, ())) for k in range(n)], pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, self.number), pa.int64()), pa.array(np.arange(n), pa.int64()), self.ids, self.n_words, places, items], schema=_FOUND)


def _ranked(items: DataFrame, own: DataFrame) -> DataFrame:
    """items with `counts`: how often each of their words occurs in all documents."""
    counts = own.groupBy("term").agg(F.sum("n").alias("count"))
    placed = items.select("no", F.posexplode("words").alias("at", "term")).join(counts, "term", "left")
    listed = placed.groupBy("no").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("count", F.lit(0)).alias("count")))).alias("c"))
    return items.join(listed.select("no", F.col("c.count").alias("counts")), "no")


def search(index: DataFrame, items: DataFrame, window: int = WINDOW, within: int | None = None, n_terms: int = 4) -> DataFrame:
    """Each document's hits: the places of its words inside windows that occur, and the items they are from. items: as
    items_of gives them.

    With `within`, a proximity search: the places of an item's rarest term where its n_terms rarest terms lie that close."""
    if within is not None and within >= GAP or window > GAP:
        raise ValueError(f"at most {GAP} positions")
    own = index.join(items.select(F.explode("words").alias("term")).distinct(), "term", "left_semi")

    def anchor(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The terms by which an item is found, and in a proximity search its rarest terms instead of its words."""
        for batch in found:
            rows: list[tuple] = []
            for no, name, words, counts in zip(*(batch.column(c).to_pylist() for c in ("no", "name", "words", "counts")), strict=True):
                if within is None:
                    terms = window_anchors(words, np.array(counts), window)
                else:
                    count = dict(zip(words, counts, strict=True))
                    words = sorted(count, key=lambda w: (count[w], w))[:n_terms]
                    terms = words[:1]  # if it occurs nowhere, no block has it
                rows += [(no, name, words, t) for t in terms]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.list_(pa.binary()), pa.binary()), strict=True)], names=["no", "name", "words", "term"])

    anchors = keep(_ranked(items, own).mapInArrow(anchor, "no long, name string, words array<binary>, term binary"), "anchors")
    met = own.select("block", "term").join(anchors.select("no", "term"), "term").select("block", "no").distinct()
    asked = met.join(anchors.select("no", "name", "words").dropDuplicates(["no"]), "no").select("block", F.lit(2).alias("kind"), "name", "words")
    known = index.where("term is null").select("block", F.lit(0).alias("kind"), "positions", "doc_ids", "n_words")
    held = own.select("block", F.lit(1).alias("kind"), "term", "positions")
    rows = known.unionByName(held, allowMissingColumns=True).unionByName(asked, allowMissingColumns=True)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits, postings, searcher = None, {}, None
        for batch in found:
            positions = batch.column("positions")
            for k, (block, kind, term, name) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("block", "kind", "term", "name")), strict=True)):
                if kind == 0:
                    if hits is not None:
                        yield hits.rows()
                    starts = np.cumsum(positions[k].values.to_numpy(zero_copy_only=False), dtype=np.int64)
                    hits, postings, searcher = Hits(block, batch.column("doc_ids")[k].values, batch.column("n_words")[k].values, starts), {}, None
                elif kind == 1:
                    postings[term] = np.cumsum(positions[k].values.to_numpy(zero_copy_only=False), dtype=np.int64)
                else:  # items pass by, one at a time
                    searcher = searcher or Searcher(postings)
                    words = batch.column("words")[k].as_py()
                    if within is None:
                        hits.add(name, searcher.windows(words, window))
                    else:
                        places = searcher.near(words, within)
                        hits.add(name, np.stack((places, np.ones(len(places), np.int64)), axis=1))
        if hits is not None:
            yield hits.rows()

    return rows.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(run, FOUND)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, the words' places and the sorted items of every document."""
    found = search(build_index(docs), items_of(benchmark), window)
    return found.select("doc_id", "n_words", F.size("places").cast("long").alias("n_hit"), "places", "items")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the whole benchmark, windows of 10 words."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))

    def digest() -> DataFrame:
        return decontaminate(docs, benchmark).select(
            "doc_id",
            "n_words",
            "n_hit",
            F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
            (F.col("n_hit") > 0).alias("contaminated"),
        )

    return settled(spark, "op6", digest)
