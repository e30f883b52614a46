"""Operator 3: language identification by error-correcting output codes.

Every language has a binary codeword. For each bit a binary classifier is learned over hashed n-grams of bytes
(A-Z in lower case): its weights are the n-grams' log-odds between the languages whose bit is 1 and those
whose bit is 0, each language counting alike; its bias and scale come from the training texts. A text's
value of a bit is the mean weight of its n-grams. Decoding is loss-weighted: a codeword costs the sum over
bits of the logistic loss of bit and value, weighted by how well that classifier did in training; the cheapest
codeword wins. The score is the winner's share of exp(-cost). A text is ambiguous if the two cheapest
codewords cost nearly the same.

Up to seven languages get the exhaustive code (all distinct splits of the languages), more get a random code of
15 log2(n) bits, the best of 100 by least distance. Learning uses a sample of `SAMPLE_PER_LANGUAGE` documents
a language in expectation (all where there are fewer), chosen by a hash of doc_id, of the labels that have `LEAST_SHARE` of
the labelled rows at least (others are dirt in the column, or too rare to learn); prediction reads every whole
text. Weights are integers, so that equal texts get equal scores on any cluster. Null text, or text
without a letter, is `und` with score 0, as is everything if nothing can be learned. Rows without doc_id are predicted but not
learned from, repeated rows count as often as they occur, extra columns are kept.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_BYTES, keep, scratch

SAMPLE_PER_LANGUAGE = 1000
#: A label is learned if it has this share of the labelled rows at least, so that there are no more than 1000 languages.
LEAST_SHARE = 0.001
#: n-gram lengths in bytes, and the table they are hashed to.
ORDERS, TABLE_BITS = (2, 4), 16
#: Weights are kept as integers of this many parts.
UNIT = 1024
#: Costs closer than this are ambiguous.
MARGIN = 0.5
SLICE_BYTES = 1 << 20


def code_matrix(n: int) -> np.ndarray:
    """n codewords of +1 and -1."""
    if n <= 1:
        return np.ones((n, 0), np.int8)
    if n <= 7:
        splits = [(1, *rest) for rest in itertools.product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(splits, np.int8).T
    bits = math.ceil(15 * math.log2(n))

    def draw(seed: int) -> tuple[int, np.ndarray]:
        code = np.random.default_rng(seed).choice(np.array([1, -1], np.int8), (n, bits))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        apart = (code.shape[1] - code.astype(int) @ code.T.astype(int)) // 2
        return int(apart[~np.eye(n, dtype=bool)].min()), code

    return max((draw(seed) for seed in range(100)), key=lambda x: x[0])[1]


def grams(data: bytes) -> list[np.ndarray]:
    """Hashed n-grams that start at each byte, for each order; the text is padded with spaces."""
    a = np.frombuffer(b" " + data.translate(LOWER_BYTES) + b"    ", np.uint8).astype(np.uint32)
    found = []
    for k, order in enumerate(ORDERS):
        h = np.full(len(a) - 4, k + 1, np.uint32)
        for i in range(order):
            h = h * np.uint32(0x01000193) + a[i : i + len(h)]
        h *= np.uint32(0x9E3779B1)
        found.append(h >> np.uint32(32 - TABLE_BITS))
    return found


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # table x bits, int16
    bias: np.ndarray
    scale: np.ndarray
    trust: np.ndarray

    def values(self, texts: list[bytes]) -> np.ndarray:
        """Each classifier's mean weight over each text's n-grams; texts are joined with a border between."""
        out, k = np.zeros((len(texts), self.code.shape[1])), 0
        while k < len(texts):
            last, size = k, 0
            while last < len(texts) and (last == k or size + len(texts[last]) <= SLICE_BYTES):
                size += len(texts[last])
                last += 1
            lengths = np.array([len(t) + 2 for t in texts[k:last]], np.int64)
            starts = np.concatenate(([0], np.cumsum(lengths + 6)[:-1]))
            borders = np.stack((starts, starts + lengths), axis=1).ravel()  # what lies between texts is left out
            total = np.zeros((last - k, self.code.shape[1]), np.int64)
            for h in grams((b" " * 8).join(texts[k:last]) + b" " * 8):
                total += np.add.reduceat(self.weights[h], borders, axis=0, dtype=np.int64)[::2]
            out[k:last] = total / (lengths[:, None] * (UNIT * len(ORDERS)))
            k = last
        return out

    def decode(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best codeword, score and ambiguity of each row of values."""
        margin = self.code[None].astype(float) * ((values - self.bias) * self.scale)[:, None, :]
        cost = (np.logaddexp(0.0, -margin) * self.trust).sum(axis=2)
        best = cost.argmin(axis=1)
        ordered = np.sort(cost, axis=1)
        share = 1.0 / np.exp(ordered[:, :1] - ordered).sum(axis=1)
        close = ordered[:, 1] - ordered[:, 0] < MARGIN if cost.shape[1] > 1 else np.zeros(len(cost), bool)
        return best, share, close


def is_training(doc_id: str = "doc_id") -> Column:
    """Documents that the classifiers may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1, F.lit(False))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Learn from the labelled rows of docs (all of which may be used)."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = labelled.groupBy(lang).agg(F.count("*").alias("n"))
    least = LEAST_SHARE * (sizes.agg(F.sum("n")).first()[0] or 0)
    counts = {r[lang]: r["n"] for r in sizes.where(F.col("n") >= least).collect()}  # 1 / LEAST_SHARE rows at most
    labelled = labelled.where(F.col(lang).isin(list(counts)))
    languages = sorted(counts)
    code = code_matrix(len(languages))
    empty = Model(languages, code, np.zeros((1 << TABLE_BITS, code.shape[1]), np.int16), *[np.zeros(code.shape[1])] * 3)
    if len(languages) < 2:
        return empty
    shares = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, SAMPLE_PER_LANGUAGE / counts[k]))])
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = keep(labelled.where(chance < shares[F.col(lang)]).select(F.col(lang).alias("lang"), F.encode(text, "UTF-8").alias("text")), "language-sample")

    def count(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in found:
            for name, data in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                total = totals.setdefault(name, np.zeros(1 << TABLE_BITS))
                for h in grams(data):  # a text counts by the share of its n-grams, so that long ones do not rule
                    total += np.bincount(h, minlength=1 << TABLE_BITS) / (len(h) ** 0.5)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(totals), pa.string()), "total": pa.array([t.tobytes() for t in totals.values()], pa.binary())})

    found = sorted((r["lang"], bytes(r["total"])) for r in sample.repartition("lang").sortWithinPartitions("lang", "text").mapInArrow(count, "lang string, total binary").collect())
    totals = np.stack([np.frombuffer(t) for _, t in found])
    share = totals / totals.sum(axis=1, keepdims=True)
    floor = 0.05 / (1 << TABLE_BITS)
    ones, zeros = (np.stack([share[code[:, b] == side].mean(axis=0) for b in range(code.shape[1])]) for side in (1, -1))
    weights = np.round(np.log((ones + floor) / (zeros + floor)) * UNIT).astype(np.int16).T
    model = Model(languages, code, np.ascontiguousarray(weights), *[np.zeros(code.shape[1])] * 3)

    def value(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            got = model.values(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(list(got), pa.list_(pa.float64()))], names=["lang", "values"])

    seen = sample.mapInArrow(value, "lang string, values array<double>").collect()  # a bounded sample's values
    values = np.array([r["values"] for r in seen])
    truth = code[[languages.index(r["lang"]) for r in seen]]
    up, down = (np.array([np.median(values[truth[:, b] == side, b]) for b in range(code.shape[1])]) for side in (1, -1))
    model.bias = np.round((up + down) / 2, 6)
    model.scale = np.round(4.0 / np.maximum((up - down) / 2, 1e-3), 6)
    loss = np.logaddexp(0.0, -truth * ((values - model.bias) * model.scale)).mean(axis=0)
    model.trust = np.round(1.0 / (0.1 + loss) / (1.0 / (0.1 + loss)).mean(), 6)
    return model


PREDICTION = "lang_pred string, score double, ambiguous boolean"


def has_letter(text: str) -> bool:
    return text.isalpha() or any(map(str.isalpha, text))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and ambiguous."""
    keeps = [c for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")]
    schema = docs.select(keeps).schema.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in found:
            texts = batch.column(text).to_pylist()
            known = [k for k, t in enumerate(texts) if model.languages and t and has_letter(t)]
            name, score, close = ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
            if known:
                best, share, doubt = model.decode(model.values([texts[k].encode("utf-8", "surrogatepass") for k in known]))
                for k, b, s, d in zip(known, best.tolist(), share.tolist(), doubt.tolist(), strict=True):
                    name[k], score[k], close[k] = model.languages[b], min(1.0, s), d
            columns = [batch.column(c) for c in keeps] + [pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(close, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keeps, "lang_pred", "score", "ambiguous"])

    return docs.select(keeps).mapInArrow(run, schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; learned from those whose crc32(doc_id) mod 3 is not 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch():
        model = fit(docs.where(is_training()))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    found = predict(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
