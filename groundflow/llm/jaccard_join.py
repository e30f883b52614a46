"""Operator 7: exact set-similarity join of documents' n-gram sets by universe partitioning and pigeonhole.

Sets are told apart by a 128-bit hash and equal sets collapse into one. Sizes are cut into bands, so that partners
lie in the same or the next band; both bands of a group share one partition of the universe of n-grams into m
segments (by hash). Sets of Jaccard similarity t differ in at most H = (1-t)/(1+t) (|r|+|s|) n-grams, so with

* m > H segments, one segment's subset is equal in both: its hash is the signature (`exact`), or
* m > H/2 segments, one segment differs in at most one n-gram: signatures are the subset's hash and those of
  its one-deletion neighbourhood (`deletion`).

Which of the two a band gets is decided by cost: the number of signatures, weighted up by the share that
hold a single n-gram and so meet by chance. Empty subsets say nothing and are left out; that is sound as long as
one of the two sets has more telling segments than H (H/2) can spoil. A set that has not also emits its untelling
signatures; if both have not, these meet. So no pair is lost.

Signatures travel in packed arrays, one row for each task and bucket; the number of buckets follows the text's bytes, so
that a bucket's size does not grow. Where a signature is shared, its smallest set, the centre, is compared with the others (a
star, never all pairs) and verified pairs are contracted to components. A signature that very many sets of one task share
is made a star there, and only its centre travels on; whatever that centre meets later then is a centre for the star's
sets too, so that a group of near copies, however large, reaches its bucket as a few entries a task. Only where the sets around a centre still span several components are they compared with each other,
in blocks: counts of hashed n-grams give a lower bound of the difference that refutes most pairs, the rest is verified
on the whole sets, once a pair. Every pair that
shares a signature is thus linked, in one component already, or refuted.

Words are the maximal runs of [^\\x20\\x09-\\x0D] with A-Z in lower case; fewer words than `n` form one n-gram; null,
empty and blank texts have none and link with nothing. Rows with equal doc_id are one document; rows
without doc_id are not joined and have no component. An empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_BYTES, batches, keep, settled
from .components import components

#: Signatures held by a task before they are handed over.
FLUSH = 2_000_000
#: Bytes of text whose signatures make up a bucket.
BUCKET_BYTES = 64 << 20
#: A signature that so many sets of one hand-over share is made a star before it travels.
HOT = 256
#: Sets around a centre that are compared with each other at once; more are cut into blocks.
BLOCK = 512
#: Documents that take part in a pair are looked up by broadcast up to this number, by a shuffle beyond.
BROADCAST_DOCS = 1_000_000
#: Weight of signatures that hold one n-gram only.
CHANCE_COST = 8.0

_B, _C1, _C2 = 0x9E3779B97F4A7C15, np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_B_INVERSE = pow(_B, -1, 1 << 64)
_S33 = np.uint64(33)
_SHIFTS = np.array([0, 2, 4, 6], np.uint8)
_UNPACKED = (np.arange(256, dtype=np.uint8)[:, None] >> _SHIFTS & np.uint8(3)).view("u4").ravel()  # four counts as one number


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S33)) * _C1
    x = (x ^ (x >> _S33)) * _C2
    return x ^ (x >> _S33)


class _Powers:
    """Powers of the hash's base and of its inverse, as far as texts need them."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> None:
        if len(cls.up) < n:
            n = max(n, 1 << 17)
            cls.up, cls.down = (np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n - 1, b, np.uint64)))) for b in (_B, _B_INVERSE))


def ngram_set(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams."""
    data = b" ".join((text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split())
    if not data:
        return np.zeros(0, np.uint64)
    a = np.frombuffer(data, np.uint8)
    _Powers.upto(len(a) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((a.astype(np.uint64) + np.uint64(1)) * _Powers.up[: len(a)])))
    space = np.flatnonzero(a == 32)
    starts, ends = np.concatenate(([0], space + 1)), np.concatenate((space, [len(a)]))
    if len(starts) > n:
        starts, ends = starts[: len(starts) - n + 1], ends[n - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    return np.unique(mix((total[ends] - total[starts]) * _Powers.down[starts] + (ends - starts).astype(np.uint64)))


def key_of(found: np.ndarray) -> tuple[int, int]:
    digest = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


@dataclass(frozen=True)
class Band:
    low: int
    most: int  # largest set that meets one of this band as the smaller
    differ: int  # H of the group's largest pair
    segments: int
    deletion: bool


class Plan:
    """Bands of sizes for a similarity of num/den, made as far as sizes need them."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.lows, self.bands = [1], []

    def differ(self, r: int, s: int) -> int:
        return (self.den - self.num) * (r + s) // (self.den + self.num)

    def upto(self, size: int) -> None:
        while self.lows[-1] <= size:
            low = self.lows[-1]
            following = max(low + 1, -(-low * self.den // self.num))
            self.lows.append(following)
            top = following - 1
            most = top * self.den // self.num
            self.bands.append(self.choose(low, most, self.differ(top, most)))

    def choose(self, low: int, most: int, differ: int) -> Band:
        mid = (low * most) ** 0.5
        exact = Band(low, most, differ, math.ceil(1.17 * (differ + 1)) + 2 * (differ > 0), False)
        deletion = Band(low, most, differ, differ // 2 + 1 + differ // 16, True)

        def cost(b: Band, least: int) -> float:
            w = mid / b.segments
            single = sum(math.exp(-w) * w**k / math.factorial(k) for k in range(1, least + 1))
            return (b.segments + b.deletion * mid) * (1.0 + CHANCE_COST * single)

        return min((exact, deletion), key=lambda b: cost(b, 1 + b.deletion))

    def band(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(np.array(self.lows), sizes, side="right") - 1


def signatures(sets: list[np.ndarray], plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """(signature, number of its set) of all sets, as uint64 and int32."""
    sizes = np.array([len(s) for s in sets])
    plan.upto(int(sizes.max(initial=1)))
    own, found, of = plan.band(sizes), [], []
    for role in (0, 1):  # as a member of its own band's group, and as the larger partner in the one below
        group = own - role
        part = [k for k in range(len(sets)) if group[k] >= 0 and sizes[k] <= plan.bands[group[k]].most and plan.bands[group[k]].differ > 0]
        if not part:
            continue
        bands = [plan.bands[group[k]] for k in part]
        elements = np.concatenate([sets[k] for k in part])
        n = sizes[part]
        doc = np.repeat(np.arange(len(part)), n)
        m = np.array([b.segments for b in bands])
        first = np.concatenate(([0], np.cumsum(m)))
        salt = mix(group[part].astype(np.uint64) + np.uint64(0x5EED))
        placed = (mix(elements ^ salt[doc]) >> np.uint64(32)) * m.astype(np.uint64)[doc] >> np.uint64(32)
        segment = first[doc] + placed.astype(np.int64)
        weight = (mix(elements + np.uint64(0xABCDEF)) >> np.uint64(20)).astype(np.float64)
        total = np.bincount(segment, weights=weight, minlength=first[-1])
        count = np.bincount(segment, minlength=first[-1])
        seg_doc = np.repeat(np.arange(len(part)), m)
        by_deletion = np.array([b.deletion for b in bands])
        # telling segments against those that the largest difference with a partner of this group can spoil
        telling = np.add.reduceat(np.where(by_deletion[seg_doc], count >= 2, count >= 1).astype(np.int64), first[:-1])
        top = np.array([plan.lows[group[k] + 1] - 1 for k in part])
        partner = np.where(role == 0, np.minimum(n * plan.den // plan.num, [b.most for b in bands]), top)
        spoilt = (plan.den - plan.num) * (n + partner) // (plan.den + plan.num)
        failing = telling <= np.where(by_deletion, spoilt // 2, spoilt)
        place = mix((np.arange(first[-1]) - first[seg_doc]).astype(np.uint64) * np.uint64(0x10001) ^ salt[seg_doc])
        whole = np.flatnonzero((count > 0) | failing[seg_doc])
        found.append(mix(total[whole].astype(np.uint64) ^ place[whole]))
        of.append(seg_doc[whole])
        less = np.flatnonzero(by_deletion[doc] & ((count[segment] > 1) | failing[doc]))
        found.append(mix((total[segment[less]] - weight[less]).astype(np.uint64) ^ place[segment[less]]))
        of.append(doc[less])
        of[-2:] = [np.array(part)[x] for x in of[-2:]]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    return np.concatenate(found), np.concatenate(of).astype(np.int32)


SIGNED = "doc_id long, n_shingles long, k1 long, k2 long, cells binary, bucket int, prints binary, sets binary, counts binary"
_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("cells", pa.binary()), ("bucket", pa.int32()), ("prints", pa.binary()), ("sets", pa.binary()), ("counts", pa.binary())])


def _local_stars(prints: np.ndarray, of: np.ndarray, keys: np.ndarray, hot: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Signatures without those of hot ones' sets but their centres, and the stars of these: a centre's key, then the others'."""
    ordered = np.sort(prints)
    if len(ordered) < hot or not (ordered[hot - 1 :] == ordered[: len(ordered) - hot + 1]).any():
        return prints, of, []
    order = np.argsort(prints, kind="stable")
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    sizes = np.diff(np.append(starts, len(order)))
    many = np.flatnonzero(sizes >= hot)
    gone, pairs = np.zeros(len(prints), bool), []
    for at, size in zip(starts[many].tolist(), sizes[many].tolist(), strict=True):
        rows = order[at : at + size]
        names = keys[of[rows]]
        centre = int(np.argmin(names))
        gone[rows] = True
        gone[rows[centre]] = False
        others = np.unique(names[names != names[centre]])
        pairs.append(np.stack((np.full(len(others), names[centre]), others), axis=1))
    found = np.unique(np.concatenate(pairs), axis=0)
    cuts = np.flatnonzero(np.append(True, found[1:, 0] != found[:-1, 0]))
    stars = [np.append(part[:1, 0], part[k : k + 50_000, 1]).astype("<i8").tobytes() for part in np.split(found, cuts[1:]) for k in range(0, len(part), 50_000)]
    return prints[~gone], of[~gone], stars


def _packed(prints: np.ndarray, of: np.ndarray, keys: np.ndarray, n_buckets: int, hot: int) -> pa.RecordBatch:
    """A row for each bucket: its signatures' lower halves, and which sets they are from; and rows without bucket: stars."""
    prints, of, stars = _local_stars(prints, of, keys, hot)
    bucket = ((prints >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(bucket * (len(keys) + 1) + of, kind="stable")
    bucket, of, low = bucket[order], of[order], (prints[order] & np.uint64(0xFFFFFFFF)).astype("<u4")
    rows: dict[str, list] = {c: [] for c in ("bucket", "prints", "sets", "counts")}
    borders = np.searchsorted(bucket, np.arange(n_buckets + 1))
    for b, (x, y) in enumerate(zip(borders, borders[1:], strict=False)):
        if x < y:
            sets, counts = np.unique(of[x:y], return_counts=True)
            for c, v in (("bucket", b), ("prints", low[x:y].tobytes()), ("sets", keys[sets].astype("<i8").tobytes()), ("counts", counts.astype("<u4").tobytes())):
                rows[c].append(v)
    for star in stars:
        for c, v in (("bucket", None), ("prints", None), ("sets", star), ("counts", None)):
            rows[c].append(v)
    n = len(rows["bucket"])
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name] if f.name in rows else [None] * n, f.type) for f in _SIGNED], schema=_SIGNED)


def sign(docs: DataFrame, n: int, num: int, den: int, n_buckets: int) -> DataFrame:
    """Rows: a document with its set's size, key and counts of hashed n-grams; packed signatures (bucket not null); and stars
    of signatures that were hot in a task (sets alone)."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, seen = Plan(num, den), set()
        held: list[np.ndarray] = []
        keys: list[int] = []
        prints, of, ready, waiting = [], [], 0, 0

        def turn() -> None:
            nonlocal held, ready, waiting
            if held:
                p, o = signatures(held, plan)
                prints.append(p)
                of.append(o + (len(keys) - len(held)))
                ready += len(p)
                held, waiting = [], 0

        for batch in found:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = ngram_set(text, n)
                k1, k2 = key_of(own)
                rows.append((doc_id, len(own), k1, k2, cells_of(own).tobytes()))
                if len(own) and doc_id is not None and (k1, k2) not in seen:
                    seen.add((k1, k2))
                    held.append(own)
                    keys.append(k1)
                    waiting += len(own)
                    if waiting > 200_000:
                        turn()
                if ready > FLUSH:
                    yield _packed(np.concatenate(prints), np.concatenate(of), np.array(keys), n_buckets, HOT)
                    prints, of, keys, ready = [], [], keys[len(keys) - len(held) :], 0
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows] if k < 5 else [None] * len(rows), f.type) for k, f in enumerate(_SIGNED)], schema=_SIGNED)
        turn()
        if ready:
            yield _packed(np.concatenate(prints), np.concatenate(of), np.array(keys), n_buckets, HOT)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SIGNED)


MET = "doc_id long, n_shingles long, k1 long, k2 long, cells binary, a long, b long, early boolean"
_MET = pa.schema([*list(_SIGNED)[:5], ("a", pa.int64()), ("b", pa.int64()), ("early", pa.bool_())])


def _stars(a: np.ndarray, b: np.ndarray, early: bool) -> pa.RecordBatch:
    nothing = [pa.nulls(len(a), f.type) for f in list(_MET)[:5]]
    return pa.RecordBatch.from_arrays([*nothing, pa.array(a), pa.array(b), pa.array(np.full(len(a), early))], schema=_MET)


def _of_bucket(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
    """The stars of one bucket's signatures: (smallest set, other). parts: (prints, sets, counts) of each task."""
    prints = np.concatenate([np.frombuffer(p, "<u4") for p, _, _ in parts])
    node = np.concatenate([np.repeat(np.frombuffer(s, "<i8"), np.frombuffer(c, "<u4")) for _, s, c in parts])
    order = np.argsort(prints, kind="stable")
    prints = prints[order]
    run = np.cumsum(np.concatenate(([True], prints[1:] != prints[:-1]))) - 1
    shared = np.flatnonzero(np.bincount(run)[run] > 1)
    if not len(shared):
        return
    names, node = np.unique(node[order[shared]], return_inverse=True)
    both = np.unique(run[shared].astype(np.int64) * len(names) + node)
    run, node = both // len(names), both % len(names)
    first = np.concatenate(([True], run[1:] != run[:-1]))
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, len(run)))
    least = np.repeat(node[starts], sizes)
    pairs = np.unique(least[~first] * len(names) + node[~first])
    yield _stars(names[pairs // len(names)], names[pairs % len(names)], False)


def meet(signed: DataFrame, n_buckets: int) -> DataFrame:
    """The documents as they are; and for sets that share a signature the smallest one (a) with each other (b); early: made
    in a task, before all that share the signature had met. Signatures are shuffled once and not stored."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts = None, []
        for batch in found:
            loose = batch.filter(pa.compute.is_null(batch.column("bucket")))
            docs = loose.filter(pa.compute.is_null(loose.column("sets")))
            if docs.num_rows:
                none = [pa.nulls(docs.num_rows, f.type) for f in list(_MET)[5:]]
                yield pa.RecordBatch.from_arrays([*(docs.column(f.name) for f in list(_MET)[:5]), *none], schema=_MET)
            for star in loose.column("sets").drop_null().to_pylist():
                names = np.frombuffer(star, "<i8")
                yield _stars(np.full(len(names) - 1, names[0]), names[1:], True)
            for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "prints", "sets", "counts")), strict=True):
                if row[0] is None:
                    continue
                if row[0] != number and parts:
                    yield from _of_bucket(parts)
                    parts = []
                number = row[0]
                parts.append(row[1:])
        if parts:
            yield from _of_bucket(parts)

    to = F.coalesce("bucket", F.pmod(F.xxhash64("doc_id", "sets"), F.lit(n_buckets)).cast("int"))
    return signed.withColumn("to", to).repartition(n_buckets, "to").sortWithinPartitions("bucket").mapInArrow(run, MET)


def cell_layout(size: int) -> tuple[int, bool]:
    """Number of cells for a set of that size, as a power of two's exponent, and whether a cell's count takes two bits (else a byte)."""
    bits = min(16, max(3, round(math.log2(size + 1)) + 1))
    return bits, 4 * size <= 3 << bits


def cells_of(found: np.ndarray) -> np.ndarray:
    """Counts of a set's n-grams by hash, cut off at 3 (255 in large sets), in about twice as many cells (a power of two,
    65536 at most)."""
    bits, narrow = cell_layout(len(found))
    counts = np.bincount((found >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    if not narrow:
        return np.minimum(counts, 255).astype(np.uint8)
    return (np.minimum(counts, 3).astype(np.uint8).reshape(-1, 4) << _SHIFTS).sum(axis=1, dtype=np.uint8)


def counts_in(cells: bytes, size: int) -> np.ndarray:
    """The counts that cells_of packed for a set of that size."""
    packed = np.frombuffer(cells, np.uint8)
    return _UNPACKED[packed].view(np.uint8) if cell_layout(size)[1] else packed


def folded(cells: np.ndarray, n: int) -> np.ndarray:
    """Rows of cells added up to n cells each."""
    kind = np.int16 if n >= 64 else np.int32
    return cells.astype(kind) if cells.shape[-1] == n else cells.reshape(*cells.shape[:-1], n, -1).sum(axis=-1, dtype=kind)


def aligned(cells: list[bytes], sizes: list[int]) -> np.ndarray:
    """The counts of some sets, a row each, over the same cells and cut off alike, so that two rows differ by no more than the
    sets do: over as many cells as the smallest set has, and at 3 unless all are wide."""
    layouts = [cell_layout(s) for s in sizes]
    n = 1 << min(bits for bits, _ in layouts)
    found = np.stack([folded(counts_in(c, s), n) for c, s in zip(cells, sizes, strict=True)])
    return np.minimum(found, 3) if any(narrow for _, narrow in layouts) else found


SET = "doc long, members binary"
_SET = pa.schema([("doc", pa.int64()), ("members", pa.binary())])


def sets_of(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """The whole sets of the wanted documents (doc, k1, k2)."""
    if wanted.count() <= BROADCAST_DOCS:
        wanted = F.broadcast(wanted)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in found:
                for doc, text, k1, k2 in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "k1", "k2")), strict=True):
                    own = ngram_set(text, n)
                    if key_of(own) == (k1, k2):
                        yield doc, own.tobytes()

        yield from batches(rows(), _SET, 2_000)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").join(wanted, "doc").select("doc", "text", "k1", "k2")
    return keep(texts.mapInArrow(run, SET), "ngram-sets")


def _both(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """a, b and the given columns of both sets."""
    b = sets.select(F.col("doc").alias("b"), *[F.col(c).alias(f"{c}_b") for c in columns])
    a = sets.select(F.col("doc").alias("a"), *[F.col(c).alias(f"{c}_a") for c in columns])
    return pairs.select("a", "b").join(b, "b").join(a, "a")


PAIR = "a long, b long"


def not_refuted(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs that sizes and cell counts leave possible."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            stay = np.zeros(batch.num_rows, bool)
            for k, (x, y, r, s) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("cells_a", "cells_b", "size_a", "size_b")), strict=True)):
                x, y = aligned([x, y], [r, s])
                stay[k] = np.abs(x - y).sum() * (den + num) <= (den - num) * (r + s)
            yield batch.select(["a", "b"]).filter(pa.array(stay))

    close = _both(pairs, sets, "size", "cells").where(F.least("size_a", "size_b") * den >= F.greatest("size_a", "size_b") * num)
    return close.select("a", "b", "size_a", "size_b", "cells_a", "cells_b").mapInArrow(run, PAIR)


def similar(x: bytes, y: bytes, num: int, den: int) -> bool:
    """Whether two whole sets have at least the similarity num/den."""
    both = np.sort(np.concatenate((np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"))), kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return den * shared >= num * (len(both) - shared)


def verified(pairs: DataFrame, docs: DataFrame, equal: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs whose sets are similar, compared whole. equal: doc, k1, k2."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    sets = sets_of(docs, keep(equal.join(ends, "doc", "left_semi").select("doc", "k1", "k2"), "wanted"), n)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            stay = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column("members_a"), batch.column("members_b"), strict=True)):
                stay[k] = similar(x.as_buffer(), y.as_buffer(), num, den)
            yield batch.select(["a", "b"]).filter(pa.array(stay))

    return _both(pairs, sets, "members").select("a", "b", "members_a", "members_b").mapInArrow(run, PAIR)


def across(members: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of different components around one centre that cell counts don't refute; each pair comes from the
    smallest centre that both have. members: centre, x, y (blocks), doc, component, size, cells, block, centres."""

    def of_group(centre: int, x: int, y: int, rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=lambda r: r[2])
        size, doc, part, block = (np.array([r[k] for r in rows]) for k in (2, 0, 1, 4))
        bits = np.array([cell_layout(s)[0] for s in size.tolist()])
        last = np.searchsorted(size, size * den // num, side="right")
        before = [frozenset(c for c in r[5] if c < centre) for r in rows]
        left, right = [], []
        for start in np.unique(bits, return_index=True)[1].tolist():  # sets with as many cells, and all that can be partners
            end = start + int((bits == bits[start]).sum())
            near = rows[start : int(last[end - 1])]
            fine = aligned([r[3] for r in near], [r[2] for r in near])
            coarse = folded(fine, max(8, fine.shape[1] // 4))
            for k in range(start, end):
                other = np.arange(k + 1, last[k])
                other = other[(part[other] != part[k]) & ((x == y) | (block[other] != block[k]))]
                for cells in (coarse, fine):
                    if len(other):
                        apart = np.abs(cells[other - start] - cells[k - start]).sum(axis=1, dtype=np.int64)
                        other = other[apart * (den + num) <= (den - num) * (size[other] + size[k])]
                for o in other.tolist():
                    if before[k].isdisjoint(before[o]):
                        left.append(doc[k])
                        right.append(doc[o])
        a, b = np.array(left, np.int64), np.array(right, np.int64)
        place = [pa.array(np.full(len(a), v), t) for v, t in ((centre, pa.int64()), (x, pa.int32()), (y, pa.int32()))]
        return pa.RecordBatch.from_arrays([*place, pa.array(a), pa.array(b)], names=["centre", "x", "y", "a", "b"])

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for batch in found:
            for centre, x, y, *row in zip(*(batch.column(c).to_pylist() for c in ("centre", "x", "y", "doc", "component", "size", "cells", "block", "centres")), strict=True):
                if (centre, x, y) != at and rows:
                    yield of_group(*at, rows)
                    rows = []
                at = centre, x, y
                rows.append(row)
        if rows:
            yield of_group(*at, rows)

    return members.repartition("centre", "x", "y").sortWithinPartitions("centre", "x", "y").mapInArrow(run, f"centre long, x int, y int, {PAIR}")


def verified_around(pairs: DataFrame, docs: DataFrame, equal: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """As `verified`, for the pairs of `across`: a set travels once for each block of a centre, not for each pair."""
    place = ["centre", "x", "y"]
    ends = pairs.select(*place, F.explode(F.array("a", "b")).alias("doc")).distinct()
    sets = sets_of(docs, keep(equal.join(ends.select("doc").distinct(), "doc", "left_semi").select("doc", "k1", "k2"), "wanted"), n)
    rows = ends.join(sets, "doc").select(*place, F.col("doc").alias("a"), F.lit(None).cast("long").alias("b"), "members")
    rows = rows.unionByName(pairs.withColumn("members", F.lit(None).cast("binary")))

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}
        for batch in found:
            left, right = [], []
            for *group, a, b, members in zip(*(batch.column(c).to_pylist() for c in (*place, "a", "b", "members")), strict=True):
                if group != at:
                    at, held = group, {}
                if b is None:
                    held[a] = members
                elif a in held and b in held and similar(held[a], held[b], num, den):
                    left.append(a)
                    right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return rows.repartition(*place).sortWithinPartitions(*place, F.col("b").asc_nulls_first()).mapInArrow(run, PAIR)


def _labelled(rows: DataFrame, labels: DataFrame, column: str, name: str) -> DataFrame:
    """rows with the component of a column; a document without links is its own."""
    own = labels.select(F.col("node").alias(column), F.col("component").alias("found"))
    return rows.join(own, column, "left").withColumn(name, F.coalesce("found", column)).drop("found")


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 3, den: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text)."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    met = keep(meet(sign(docs, n, num, den, n_buckets), n_buckets), "met")
    every = met.where("a is null").select("doc_id", "n_shingles", "k1", "k2", "cells")
    joined = every.where("doc_id is not null and n_shingles > 0")
    equal = keep(joined.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc")), "equal-sets")
    firsts = joined.join(equal.withColumnRenamed("doc", "doc_id"), ["k1", "k2", "doc_id"]).select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("size"), "cells")
    firsts = keep(firsts, "set-cells")
    name = equal.select("k1", "doc")
    stars = met.where("not early").select("a", "b").distinct()
    early = met.where("early").select("a", "b").distinct()
    # the sets of an early star are around its centre, and around whatever that centre is around
    around = early.withColumnRenamed("a", "via").join(stars.withColumnRenamed("b", "via"), "via").select("a", "b")
    stars = stars.unionByName(early).unionByName(around).distinct()
    stars = stars.join(name.withColumnRenamed("k1", "a").withColumnRenamed("doc", "centre"), "a").join(name.withColumnRenamed("k1", "b"), "b")
    stars = keep(stars.where("centre <> doc").select("centre", "doc").distinct(), "stars")
    pairs = stars.select(F.least("centre", "doc").alias("a"), F.greatest("centre", "doc").alias("b")).distinct()
    pairs = keep(not_refuted(pairs, firsts, num, den), "star-pairs")
    links = keep(verified(pairs, docs, equal, n, num, den), "links")
    twice = joined.groupBy("doc_id").agg(F.min("k1").alias("x"), F.max("k1").alias("y")).where("x <> y").select("doc_id")
    repeated = joined.select("doc_id", "k1", "k2").join(twice, "doc_id", "left_semi").join(equal, ["k1", "k2"]).select(F.col("doc").alias("a"), F.col("doc_id").alias("b"))
    labels = components(links.unionByName(repeated.where("a <> b")))
    found = keep(_labelled(stars, labels, "doc", "component"), "members")
    open_ = found.groupBy("centre").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("members")).where("x <> y").select("centre", "members")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    centres = stars.join(open_, "centre", "left_semi").groupBy("doc").agg(F.collect_set("centre").alias("centres"))  # no more than a document's signatures
    spread = found.join(open_, "centre").withColumn("block", F.when(blocks > 1, F.pmod(F.xxhash64("doc"), blocks)).otherwise(0).cast("int"))
    spread = spread.join(firsts.join(centres, "doc"), "doc").withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    spread = spread.withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")})
    across_pairs = keep(across(spread.select("centre", "x", "y", "doc", "component", "size", "cells", "block", "centres"), num, den), "pairs")
    more = keep(verified_around(across_pairs, docs, equal, n, num, den), "links")
    if not more.isEmpty():
        tops = components(_labelled(_labelled(more, labels, "a", "top_a"), labels, "b", "top_b").select(F.col("top_a").alias("a"), F.col("top_b").alias("b")))
        old = labels.select("node", F.col("component").alias("middle")).unionByName(tops.select("node", F.col("node").alias("middle"))).dropDuplicates(["node"])
        labels = keep(_labelled(old, tops, "middle", "component").select("node", "component"), "labels")
    placed = every.drop("cells").join(equal, ["k1", "k2"], "left").withColumn("doc", F.when(F.col("n_shingles") > 0, F.coalesce("doc", "doc_id")).otherwise(F.col("doc_id")))
    return _labelled(placed, labels, "doc", "component_id").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: five-word shingles, similarity of at least 0.75."""
    return settled(spark, "op7", lambda: jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), 5, 3, 4))
