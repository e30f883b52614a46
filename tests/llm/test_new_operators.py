"""Lattice scores, centroid clustering and importance resampling: by name against brute force, and on odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from groundflow.llm import centroid_clustering, importance, lattice_scores
from groundflow.llm.common import scratch

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = "doc_id long, text string, score string, _block int, rank int, _kind string"


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def odd_rows():
    """Null and repeated ids, blanks, equal and very long texts, control characters."""
    texts = [None, "", " \t\n", "one two three", "One TWO three", "É ß \x00 x\x01y 😀 ▁▁a ▁b", "word " * 40_000, "x" * 30_000, "a　b\x85c", "the same words " * 9, "the same words " * 9]
    return [(None if k % 5 == 4 else k // 2, t, "s", 1, 2, "k") for k, t in enumerate(texts)] + [(k, f"some words of {k % 7} texts that are long enough to be drawn from the whole of the table by number {k}", "s", 1, 2, "k") for k in range(20, 60)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), ODD).repartition(3)


def against_sql(spark, name, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in got.description]
    return sorted(map(repr, got.fetchall())), sorted(repr(tuple(r)) for r in entry.queries()[name](spark, SF).select(columns).collect())


def tokens(text):
    return [*(w for w in re.split(r"[\x20\x09-\x0D]+", low(text)) if w), ""]


def spellings(word, pieces):
    """The probability of a word by listing its spellings."""
    if not word:
        return 1.0
    return sum(p * spellings(word[len(name) :], pieces) for name, p in pieces.items() if name and word.startswith(name))


def test_lattice_sums_all_spellings():
    names = [lattice_scores.MARK, b"a", b"b", b"ab", b"ba", b"aba", lattice_scores.MARK + b"a", lattice_scores.MARK + b"ab", b""]
    pieces = lattice_scores.Pieces.of(names, np.arange(1.0, 10.0))
    chances = dict(zip(names, np.arange(1.0, 10.0) / 45, strict=True))
    lattice = pieces.lattice()
    for n in range(1, 7):
        for word in map(bytes, itertools.product(b"ab", repeat=n)):
            want = spellings(lattice_scores.MARK + word, chances)
            assert lattice.log10(word) == pytest.approx(math.log10(want))
            # expected pieces: the derivative of the logarithm by the logarithm of a piece's probability
            expected = lattice.expected(word, 10_000)
            for k, name in enumerate(names[:-1]):
                more = chances | {name: chances[name] * 1.0001}
                slope = (math.log(spellings(lattice_scores.MARK + word, more)) - math.log(want)) / math.log(1.0001)
                assert expected.get(k, 0) / 10_000 / lattice_scores.UNIT == pytest.approx(slope, abs=1e-3)
    assert lattice.log10(b"") == pytest.approx(math.log10(9 / 45)) and lattice.log10(b"c") == -math.inf


def test_many_words_are_spelled_like_one(monkeypatch):
    monkeypatch.setattr(lattice_scores, "AT_ONCE", 7)
    pieces, rng = lattice_scores.existing_pieces(public_tokenizers.path("piece_bpe_32k.model")), random.Random(2)
    words = ["".join(rng.choice("abest ñé中") for _ in range(rng.randint(0, 12))).encode() for _ in range(200)] + [b"x" * 64, b"x" * 65, b"y" * 300, b"\xff\x00"]
    one, many, counts = pieces.lattice(), pieces.lattices(), np.array([rng.randint(1, 50) for _ in words])
    assert many.log10(words) == pytest.approx([one.log10(w) for w in words], rel=1e-12)
    want = np.zeros(len(pieces.names))
    for w, n in zip(words, counts.tolist(), strict=True):
        for k, parts in (one.expected(w, n) if w else {}).items():
            want[k] += parts
    assert many.expected(words, counts) == pytest.approx(want, abs=0.5 * len(words))


def brute_scores(rows, rounds):
    """doc_id, text -> all columns, by plain loops over one dictionary."""
    known = [(i, t, i is not None and zlib.crc32(str(i).encode()) % 7 != 2) for i, t in rows]
    counts = Counter(w for _, t, train in known if train for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    pieces = lattice_scores.existing_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    first = np.exp(pieces.logs)
    for _ in range(rounds):
        lattice, found = pieces.lattice(), np.zeros(len(first))
        for word, c in counts.items():
            if word:
                for k, parts in lattice.expected(word.encode(), c).items():
                    found[k] += parts / 1024
        found[pieces.names.index(b"")] = counts[""]
        pieces = lattice_scores.Pieces.of(pieces.names, found + first / first.sum() * len(first))
    lattice = pieces.lattice()
    logs = {w: lattice.log10(w.encode()) for w in {w for _, t, _ in known for w in tokens(t)}}
    for i, t, train in known:
        words = tokens(t)
        yield i, not train, len(words), sum(counts[w] > 0 for w in words), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), sum(logs[w] for w in words)


COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def compare_scores(got, rows, rounds):
    key = lambda r: tuple((x is None, round(x, 6) if isinstance(x, float) else x) for x in r)
    want, got = sorted(brute_scores(rows, rounds), key=key), sorted((tuple(r[c] for c in COLUMNS) for r in got), key=key)
    assert len(want) == len(got)
    for a, b in zip(want, got, strict=True):
        assert a[:5] == b[:5] and b[5:] == pytest.approx(a[5:], rel=1e-6, abs=1e-9)  # parts are rounded piece by piece


def test_op11_by_name(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    found = entry.queries()["op11_lattice_scores"](spark, SF)
    assert found.columns == COLUMNS
    compare_scores(found.collect(), rows, 2)


@pytest.mark.parametrize("size", [1 << 20, 400])
def test_lattice_scores_of_odd_rows(odd, monkeypatch, size):
    monkeypatch.setattr(lattice_scores, "BLOCK_BYTES", size)
    monkeypatch.setattr(lattice_scores, "BUCKET_BYTES", 10 * size)
    with scratch():
        found = lattice_scores.score(odd, public_tokenizers.path("piece_bpe_32k.model"), rounds=1)
        assert found.columns == ["doc_id", "rank", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        compare_scores(found.collect(), [r[:2] for r in odd_rows()], 1)


def test_lattice_scores_without_rows_or_training(spark, odd):
    path = public_tokenizers.path("piece_bpe_32k.model")
    with scratch():
        assert lattice_scores.score(odd.limit(0), path).count() == 0
        rows = lattice_scores.score(odd, path, training=F.lit(False)).collect()
        assert all(r.held_out and r.n_known == r.train_tokens == r.base_score == 0 and r.score < 0 for r in rows)


def test_lattice_scores_rank_texts(spark):
    """Held-out texts are likelier than the same texts with their letters shuffled, and learning makes them likelier still."""
    rng = random.Random(1)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("length(text) between 200 and 5000")
    shuffled = []
    for r in docs.where(~lattice_scores.is_training()).collect():
        letters = [c for c in r.text if not c.isspace()]
        rng.shuffle(letters)
        at = iter(letters)
        shuffled.append((-1 - r.doc_id, "".join(c if c.isspace() else next(at) for c in r.text)))
    both = docs.unionByName(spark.createDataFrame(shuffled, "doc_id long, text string"))
    means = {}
    for rounds in (0, 1, 3):
        with scratch():
            found = {r.doc_id: r.score for r in lattice_scores.score(both, public_tokenizers.path("piece_bpe_32k.model"), (F.col("doc_id") >= 0) & lattice_scores.is_training(), rounds).collect()}
        pairs = [(found[-1 - i], s) for i, s in found.items() if i < 0]
        assert len(pairs) > 10 and all(true > wrong for true, wrong in pairs)
        means[rounds] = np.mean([true for true, _ in pairs])
    assert means[0] < means[1] < means[3]


def lloyd(vectors, k, rounds, seed):
    """Comparing every vector with every centroid, in whole numbers."""
    order = sorted(vectors, key=lambda v: (hashlib.sha256(f"{seed}:{v[0]}".encode()).hexdigest(), v[1]))
    centroids = [list(x) for _, x in order[:k]]
    away = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    for step in range(rounds + 1):
        at = [min(range(len(centroids)), key=lambda j: (away(x, centroids[j]), j)) for _, x in vectors]
        if step < rounds:
            for j in range(len(centroids)):
                if own := [x for (_, x), a in zip(vectors, at, strict=True) if a == j]:
                    centroids[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    return [(i, j, away(x, centroids[j])) for (i, x), j in zip(vectors, at, strict=True)], centroids


@pytest.mark.parametrize(("kind", "k", "wide"), [("grid", 5, 3), ("points", 12, 1000), ("wide", 4, 100_000_000), ("same", 6, 0), ("few", 40, 50)])
def test_clusters_equal_brute_force(spark, kind, k, wide):
    """Many ties on a small grid, plain points, numbers beyond exact doubles, equal points, fewer points than centroids."""
    gen = np.random.default_rng(k)
    n = 25 if kind == "few" else 300
    x = gen.integers(-wide, wide + 1, (n, 4))
    rows = [(i, [float(v) for v in row], i % 3, "c", 7) for i, row in enumerate(x.tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, cluster string, _n int").repartition(3)
    with scratch():
        found, centroids = centroid_clustering.cluster(df, k, 6, 3, 4, 1)
        assert found.columns == ["vec_id", "label", "vector", "cluster", "distance"]
        got = sorted((r.vec_id, r.cluster, r.distance) for r in found.collect())
    want, rows = lloyd([(i, row) for i, row in enumerate(x.tolist())], k, 6, 3)
    assert got == sorted(want) and centroids == rows


def test_exponion_leaves_comparisons_out():
    gen = np.random.default_rng(1)
    middle = gen.integers(-10_000, 10_000, (64, 8))
    x = (middle[gen.integers(0, 64, 4000)] + gen.integers(-200, 200, (4000, 8))).astype(np.int32)
    c = centroid_clustering.Centroids(middle.tolist(), [0.0] * 64)
    at, upper, lower, seen = centroid_clustering.assign(x, np.zeros(4000, np.int64), np.full(4000, np.inf), np.zeros(4000), c)
    assert (at == centroid_clustering.squared(x, middle).argmin(axis=1)).all() and seen <= 65 * 4000
    moved = middle + 1
    c = centroid_clustering.Centroids(moved.tolist(), [3.0] * 64)
    at, upper, lower, seen = centroid_clustering.assign(x, at, upper, lower, c)
    assert (at == centroid_clustering.squared(x, moved).argmin(axis=1)).all() and seen < 400


def test_op12_by_name(spark):
    want, got = against_sql(spark, "op12_centroid_clustering", ["embeddings"])
    assert want == got and len(got) > 0


def test_clustering_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(None, [0.1, -0.1]), (1, [0.5, 0.25]), (1, [0.5, 0.25]), (2, [-0.7, 0.3]), (None, [3.0, 3.0])]
    bad = [(3, None), (4, []), (5, [1.0]), (6, [1.0, None]), (7, [nan, 0.0]), (8, [inf, 0.0]), (9, [1.0, 2.0, 3.0]), (10, [1e30, 0.0])]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>")
    with scratch():
        found, centroids = centroid_clustering.cluster(df, 3, 10, 3, 2)
        rows = centroid_clustering.with_inertia(found, centroids).collect()
        assert sorted((r.vec_id is None, r.vec_id or 0) for r in rows) == [(False, 1), (False, 1), (False, 2), (True, 0), (True, 0)]
        assert {r.inertia for r in rows} == {sum(r.distance for r in rows)} and len({r.vector[0] for r in rows if r.vec_id == 1}) == 1
        assert next(tuple(r.vector) for r in rows if r.vec_id == 2) == (math.floor(1024 * np.float32(-0.7).astype(float)), math.floor(1024 * np.float32(0.3).astype(float)))
        none, no_centroids = centroid_clustering.cluster(df.limit(0), 3, 2, 3, 2)
        assert none.count() == 0 and no_centroids == [] and centroid_clustering.with_inertia(none, []).count() == 0


def brute_resample(docs, target, least=20, percent=25, k=10_000):
    grams = lambda w: [*w, *(" ".join(p) for p in zip(w, w[1:], strict=False))]
    bucket = lambda f: zlib.crc32(f.encode()) % k
    words = [WORD.findall(low(t)) for _, t in docs]
    features = [[bucket(f) for f in grams(w)] for w in words]
    s, t = Counter(b for f in features for b in f), Counter(bucket(f) for x in target for f in grams(WORD.findall(low(x))))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + k) / ((s[b] + 1) * (sum(t.values()) + k))))
    rows = []
    for (i, _), w, f in zip(docs, words, features, strict=True):
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    enough = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3], r[1]))
    for place, r in enumerate(enough):
        r.append(place + 1 if place < percent * len(enough) // 100 else None)
    return sorted(((r[0], *r[2:5], r[5] if len(r) > 5 else None) for r in rows), key=repr)


def test_op13_by_name(spark):
    want, got = against_sql(spark, "op13_importance_resampling", ["documents", "benchmark"])
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    brute = brute_resample(docs, [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    assert want == got == sorted(map(repr, brute)) and sum(r[4] is not None for r in brute) > 10


@pytest.mark.parametrize("size", [1 << 22, 300])
def test_resampling_of_odd_rows(spark, odd, monkeypatch, size):
    monkeypatch.setattr(importance, "SLICE_BYTES", size)
    target = spark.createDataFrame([("some words of texts",), (None,), ("",), ("SOME words",)], "text string")
    with scratch():
        found = importance.resample(odd, target)
        assert found.columns == ["doc_id", "_block", "_kind", "n_words", "n_features", "weight", "score", "rank"]
        got = sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in found.collect()), key=repr)
    assert got == brute_resample([r[:2] for r in odd_rows()], ["some words of texts", "", "SOME words"])


def test_resampling_without_rows_or_target(spark, odd):
    none = spark.createDataFrame([], "text string")
    with scratch():
        assert importance.resample(odd.limit(0), none).count() == 0
        got = sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in importance.resample(odd, none, most=2, percent=100, min_words=0).collect()), key=repr)
    assert got == brute_resample([r[:2] for r in odd_rows()], [], 0, 100)
    assert all(r[4] for r in got)


def test_a_very_long_text_fits():
    """Three million words of one document, in the memory that DuckDB is given."""
    counter = importance.Counter(2, 10_000)
    n_words, buckets, counts = counter.count_long("some word " * 1_500_000, importance.SLICE_BYTES)
    counter.close()
    want = {zlib.crc32(f.encode()) % 10_000: n for f, n in (("some", 1_500_000), ("word", 1_500_000), ("some word", 1_500_000), ("word some", 1_499_999))}
    assert n_words.tolist() == [3_000_000] and dict(zip(buckets[0].tolist(), counts[0].tolist(), strict=True)) == want


def test_packed_numbers():
    rows = [np.array([1, 65_535]), np.zeros(0, np.int64), np.array([70_000, 3, 4]), np.array([1 << 40]), np.array([5])]
    for some in (rows, rows[:2], rows[1:2]):
        column = pa.array([importance.packed(r) for r in [np.array([9]), *some]], pa.binary()).slice(1)
        got, sizes = importance.unpacked(column, np.array([len(r) for r in some]))
        assert got.tolist() == np.concatenate(some).tolist() and sizes.tolist() == [len(r) for r in some]
    got, sizes = importance.unpacked(pa.array([importance.packed(r) for r in rows[:2]], pa.binary()))
    assert got.tolist() == [1, 65_535] and sizes.tolist() == [2, 0]


def test_longer_grams():
    counter = importance.Counter(3, 1000)
    n_words, buckets, counts = counter.count(pa.array(["a b c a b c", "one", "", "two words"]))
    text = "É a\x00b, c' 12 " * 40 + "x" * 50 + "..." + "y z " * 30
    whole = counter.count(pa.array([text]))
    for piece in (1, 7, 60, 5000):
        assert all(np.array_equal(a, b) for x, y in zip(whole, counter.count_long(text, piece), strict=True) for a, b in zip(x, y, strict=True))
    counter.close()
    want = Counter(zlib.crc32(" ".join(p).encode()) % 1000 for n in (1, 2, 3) for p in zip(*("a b c a b c".split()[k:] for k in range(n)), strict=False))
    assert n_words.tolist() == [6, 1, 0, 2] and dict(zip(buckets[0].tolist(), counts[0].tolist(), strict=True)) == want and [int(c.sum()) for c in counts] == [15, 1, 0, 3]
