"""Operator 12: exact centroid clustering by exponion search.

Vectors become whole numbers, centroids are floored means of whole numbers, and every decision is made on squared distances
as whole numbers, so that the result is the one that comparing every vector with every centroid would give, ties
included (the smaller number wins). Most of those comparisons are left out. Each vector carries two bounds: `upper` on the
distance to its own centroid, and `lower` on the distance to any other. When centroids have moved, the bounds are widened by
how far. A vector whose upper bound lies below its lower one, or below half the distance from its centroid to the next one,
keeps its cluster unseen. For the others the upper bound is made exact, and if that does not settle it, only the
centroids in the ball around its own one of radius twice that distance plus the distance to the next centroid are looked at
(Newling and Fleuret's exponion): every centroid that is nearest or second nearest lies in it, radius included. The balls
are prefixes of each centroid's list of the others in order of distance. Bounds are rounded outwards.

A round is one pass over a table of vectors with their clusters and bounds, which writes the next one and, for each task, what
its vectors changed in the clusters' sums and counts; only vectors that moved count there. The driver holds the centroids,
k rows of the vectors' length, and nothing else. The last table but one is deleted.

Kept are vectors with exactly `size` components of which none is null, not finite or, in whole numbers, beyond 2^27 (squared
distances would not fit in 64 bits). Repeated rows count as often as they occur. A row without vec_id is clustered like
others but is chosen as a first centroid only when rows with one are too few. With fewer than k vectors there are as many centroids;
an empty table gives no row. Extra columns come back; columns named `vector`, `cluster` or `distance` give way to the result's own,
those named as in `OWN` to the working columns, and `embedding` to `vector`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, keep, settled, table

#: Components of this size or more, in whole numbers, can't be squared and summed in 64 bits.
LARGEST = 1 << 27
#: Below this size, sums of products are exact in doubles.
EXACT = 1 << 22
#: Distances worked out at once.
AT_ONCE = 1 << 19
#: Relative rounding of bounds; far more than doubles need.
SLACK = 1e-12
#: Names of the columns that a round works with, apart from any column of the input.
OWN = ["_cluster", "_upper", "_lower", "_vector", "_moved", "_n"]


def whole_vectors(embeddings: DataFrame, size: int = 64, parts: int = 1024) -> DataFrame:
    """The kept vectors' rows with `vector`: floor(parts * x) of each component, as whole numbers."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double") * F.lit(float(parts))) < F.lit(float(LARGEST))))
    kept = embeddings.where((F.size(x) == size) & F.coalesce(finite, F.lit(False)))
    return kept.withColumn("vector", F.transform(x, lambda v: F.floor(v.cast("double") * F.lit(float(parts))).cast("int")))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of every row of x to every row of c, exactly."""
    if not len(x) or not len(c):
        return np.zeros((len(x), len(c)), np.int64)
    if max(abs(int(x.min())), int(x.max()), abs(int(c.min())), int(c.max())) < EXACT:
        a, b = x.astype(float), c.astype(float)
        return ((a * a).sum(axis=1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(axis=1)[None]).astype(np.int64)
    return np.stack([((x.astype(np.int64) - row.astype(np.int64)) ** 2).sum(axis=1) for row in c], axis=1)


class Centroids:
    """Centroids with, for each, the others in order of distance."""

    def __init__(self, rows: list[list[int]], moved: list[float]):
        self.rows, self.moved = np.array(rows, np.int64).reshape(len(rows), -1), np.array(moved)
        between = np.sqrt(squared(self.rows, self.rows).astype(float))
        self.order = np.lexsort((np.broadcast_to(np.arange(len(rows)), between.shape), between))
        for a in range(len(rows)):  # a centroid leads its own list, whatever lies at the same place
            self.order[a] = np.concatenate(([a], self.order[a][self.order[a] != a]))
        self.far = np.take_along_axis(between, self.order, axis=1)
        self.next = self.far[:, 1] if len(rows) > 1 else np.full(len(rows), np.inf)
        most = np.argsort(self.moved)[::-1]  # how far any other centroid has moved
        self.others = np.full(len(rows), self.moved[most[0]] if len(rows) > 1 else 0.0)
        if len(rows) > 1:
            self.others[most[0]] = self.moved[most[1]]


def assign(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Clusters and bounds after one round, and how many distances were worked out."""
    if not len(x):
        return cluster, upper, lower, 0
    cluster = cluster.copy()
    upper = (upper + c.moved[cluster]) * (1 + SLACK)
    lower = np.maximum(lower - c.others[cluster], 0.0) * (1 - SLACK)
    settled_by = lambda r: np.maximum(lower[r], c.next[cluster[r]] * (0.5 * (1 - SLACK)))
    open_ = np.flatnonzero(upper >= settled_by(slice(None)))
    own = x[open_].astype(np.int64) - c.rows[cluster[open_]]
    upper[open_] = np.sqrt((own * own).sum(axis=1).astype(float)) * (1 + SLACK)
    seen = len(open_)
    open_ = open_[upper[open_] >= settled_by(open_)]
    for a in np.unique(cluster[open_]).tolist():
        rows = open_[cluster[open_] == a]
        ball = np.searchsorted(c.far[a], (2 * upper[rows] + c.next[a]) * (1 + SLACK), side="right")
        wide = np.minimum(1 << np.ceil(np.log2(np.maximum(ball, 2))).astype(int), len(c.rows))  # balls of nearly the same size go together
        for m in np.unique(wide).tolist():
            near = np.sort(c.order[a, :m])  # by number, so that the first of the least is the smaller number
            same = rows[wide == m]
            for k in range(0, len(same), max(1, AT_ONCE // m)):
                part = same[k : k + max(1, AT_ONCE // m)]
                d = squared(x[part], c.rows[near])
                seen += d.size
                best = d.argmin(axis=1)
                two = np.partition(d, 1, axis=1)[:, :2] if m > 1 else np.column_stack((d, np.full(len(d), np.iinfo(np.int64).max)))
                cluster[part] = near[best]
                upper[part] = np.sqrt(two[:, 0].astype(float)) * (1 + SLACK)
                lower[part] = np.sqrt(two[:, 1].astype(float)) * (1 - SLACK) if m > 1 else np.inf
    return cluster, upper, lower, seen


def _numbers(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size) if len(column) else np.zeros((0, size), np.int32)


def _round(state: DataFrame, c: Centroids, size: int) -> DataFrame:
    """The next state: each vector with its cluster and bounds, and for each task a row a cluster (_moved) of what changed there."""
    schema = state.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((len(c.rows), size), np.int64), np.zeros(len(c.rows), np.int64)
        names = None
        for batch in batches:
            names = batch.schema
            at = {n: k for k, n in enumerate(names.names)}
            x = _numbers(batch.column(at["_vector"]), size)
            before = batch.column(at["_cluster"]).to_numpy()
            known = before >= 0
            upper, lower = (batch.column(at[n]).to_numpy() for n in ("_upper", "_lower"))
            got, upper, lower, _ = assign(x, np.maximum(before, 0), upper, lower, c)
            changed = np.flatnonzero(got != before)
            moved = x[changed].astype(np.int64)
            np.add.at(sums, got[changed], moved)
            np.add.at(counts, got[changed], 1)
            left = changed[known[changed]]
            np.subtract.at(sums, before[left], x[left].astype(np.int64))
            np.subtract.at(counts, before[left], 1)
            columns = list(batch.columns)
            for name, values in (("_cluster", got.astype(np.int32)), ("_upper", upper), ("_lower", lower)):
                columns[at[name]] = pa.array(values)
            yield pa.RecordBatch.from_arrays(columns, schema=names)
        if names is None:
            return
        told = np.flatnonzero(counts.astype(bool) | sums.any(axis=1))
        own = {"_cluster": pa.array(told, pa.int32()), "_moved": pa.array(sums[told].tolist(), pa.list_(pa.int64())), "_n": pa.array(counts[told], pa.int64())}
        yield pa.RecordBatch.from_arrays([own[f.name].cast(f.type) if f.name in own else pa.nulls(len(told), f.type) for f in names], schema=names)

    return state.mapInArrow(run, schema)


def _changes(found: DataFrame, k: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """What a round changed in the clusters' sums and counts: k rows at most come to the driver."""
    told = found.where("_n is not null")
    per = told.select("_cluster", "_n", F.posexplode("_moved").alias("at", "v")).groupBy("_cluster", "at").agg(F.sum("v").alias("v"), F.sum("_n").alias("n"))
    rows = per.groupBy("_cluster").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("sums"), F.max("n").alias("n")).collect()
    sums, counts = np.zeros((k, size), object), np.zeros(k, np.int64)
    for r in rows:
        sums[r["_cluster"]] = [s["v"] for s in r["sums"]]
        counts[r["_cluster"]] = r["n"]
    return sums, counts


def _first(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors of the smallest hashes of their ids."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r[0]) for r in vectors.orderBy(name.asc_nulls_last(), "vector").select("vector").limit(k).collect()]


def cluster(embeddings: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, size: int = 64, parts: int = 1024) -> tuple[DataFrame, list[list[int]]]:
    """embeddings (vec_id, embedding, ...) of the kept vectors with vector, cluster and distance (squared, in whole numbers), and the
    centroids: rounds of assigning and averaging, and one assignment more.

    The result reads a table in the shared folder; call it inside `settled` or `scratch`."""
    rest = [c for c in embeddings.columns if c not in ("embedding", "vector", "cluster", "distance", *OWN)]
    vectors = whole_vectors(embeddings.select(*rest, "embedding"), size, parts).drop("embedding")
    spec = {"_cluster": "int", "_upper": "double", "_lower": "double", "_moved": "array<bigint>", "_n": "bigint"}
    # -1 and bounds that settle nothing: the first round compares every vector with all centroids
    start = {"_cluster": F.lit(-1), "_upper": F.lit(float("inf")), "_lower": F.lit(0.0), "_moved": F.lit(None), "_n": F.lit(None)}
    state = vectors.withColumnRenamed("vector", "_vector").withColumns({n: start[n].cast(t) for n, t in spec.items()})
    state = keep(state, "vectors")
    rows = _first(state.withColumnRenamed("_vector", "vector"), k, seed)
    if not rows:
        return _result(state, rest, np.zeros((0, size), np.int64), size), []
    moved = [float("inf")] * len(rows)
    sums, counts = np.zeros((len(rows), size), object), np.zeros(len(rows), np.int64)
    for step in range(rounds + 1):
        found = keep(_round(state.where("_n is null"), Centroids(rows, moved if step else [0.0] * len(rows)), size), f"vectors-{step}")
        drop(state)
        state = found
        if step == rounds:
            break
        more, n = _changes(state, len(rows), size)
        sums, counts = sums + more, counts + n
        new = [[int(s) // int(m) for s in part] if m else row for part, m, row in zip(sums, counts.tolist(), rows, strict=True)]
        moved = [float(np.sqrt(float(sum((a - b) ** 2 for a, b in zip(p, q, strict=True))))) * (1 + SLACK) for p, q in zip(new, rows, strict=True)]
        rows = new
    return _result(state.where("_n is null"), rest, np.array(rows, np.int64), size), rows


def _result(state: DataFrame, rest: list[str], centroids: np.ndarray, size: int) -> DataFrame:
    schema = state.select(*rest, F.col("_vector").alias("vector"), F.col("_cluster").alias("cluster"), F.lit(0).cast("long").alias("distance")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at = _numbers(batch.column(batch.num_columns - 2), size), batch.column(batch.num_columns - 1).to_numpy()
            away = x.astype(np.int64) - centroids[at]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((away * away).sum(axis=1))], names=[*rest, "vector", "cluster", "distance"])

    return state.select(*rest, F.col("_vector").alias("vector"), F.col("_cluster").alias("cluster")).mapInArrow(run, schema)


def with_inertia(clustered: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """clustered with cluster_inertia, inertia (sums of distances over the cluster and over all) and centroid_sha256.

    Joined is a row for each centroid."""
    spark = clustered.sparkSession
    names = [(k, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for k, row in enumerate(centroids)]
    sums = clustered.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()
    of = {r["cluster"]: r["cluster_inertia"] for r in sums}
    rows = [(k, of.get(k, 0), sum(of.values()), sha) for k, sha in names]
    told = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return clustered.join(F.broadcast(told), "cluster")


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    def made() -> DataFrame:
        found, centroids = cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
        known = keep(found.select("vec_id", "cluster", "distance"), "clusters")
        return with_inertia(known, centroids).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

    return settled(spark, "centroid-clustering", made)


def _sql(k: int, rounds: int, seed: int, size: int, parts: int) -> str:
    """One block of the SQL a round."""
    away = f"list_sum(list_transform(range(1, {size + 1}), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))"
    text = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor({parts} * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda e: isfinite(e))) = {size}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x FROM (SELECT sha256('{seed}:' || vec_id::VARCHAR) AS h, x FROM v ORDER BY h, x LIMIT {k}) s),
"""
    for step in range(rounds + 1):
        text += f"""a{step} AS MATERIALIZED (SELECT r, k, d FROM (SELECT v.r, c.k, {away} AS d, row_number() OVER (PARTITION BY v.r ORDER BY {away}, c.k) AS place FROM v, c{step} c) q WHERE place = 1),
"""
        if step < rounds:
            text += f"""c{step + 1} AS MATERIALIZED (SELECT o.k, coalesce(n.x, o.x) AS x FROM c{step} o LEFT JOIN (SELECT k, list(m ORDER BY i) AS x FROM
  (SELECT a.k, i, floor(sum(v.x[i])::DOUBLE / count(*))::BIGINT AS m FROM a{step} a JOIN v ON v.r = a.r, (SELECT unnest(range(1, {size + 1})) AS i) g GROUP BY a.k, i) f GROUP BY k) n ON n.k = o.k),
"""
    return (
        text
        + f"""z AS (SELECT k, sum(d)::BIGINT AS s FROM a{rounds} GROUP BY k)
SELECT v.vec_id, a.k::INT AS cluster, a.d::BIGINT AS distance, z.s AS cluster_inertia, (SELECT sum(s)::BIGINT FROM z) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v ON v.r = a.r JOIN z ON z.k = a.k JOIN c{rounds} c ON c.k = a.k"""
    )


OP12_SQL = _sql(8, 10, 3, 64, 1024)
