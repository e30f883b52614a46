"""Operator 1: k-d tree sharding by distributed weighted medians.

The documents are split again and again, each node at the byte-weighted quantile of its widest metadata
dimension, until every leaf has the target size. A split point is found by rounds of histograms over
55-bit positions (17 bits of the dimension's range in the node, 38 bits of a row hash that breaks ties), so
that one value held by a third of all rows is divided like any other. A round is one aggregation that
shuffles at most 16384 sums a node, and a node needs no more rounds once its split point lies at a single row. Documents'
texts are read once, for their size and checksum; rows never gather in one task, and they are written anew only every
few levels: in between, a row walks the levels' split points, small tables of a row a node. The law is `bytes`: a split is
off its target by no more than one position's rows, and with 38 bits of hash that is one unit (two with a chance of
one in twenty at ten thousand million rows of one value), so two leaves differ by little more than a unit a level.

A unit is a document, or all documents of one text together where these have no more than a `together`th part of a shard's bytes in
sum (one part in ten): those stay in one shard, dealt by the metadata of the one with the smallest doc_id. Larger groups of copies, which could not be
kept whole under this law, are dealt document by document; there are fewer of them than `together` times the shards.

Null text has size 16 and the checksum of the empty text; null dimensions count as 0; rows without doc_id are dealt like
others; equal rows (same doc_id and text) cannot be told apart and stay together. An empty table gives no row.
Extra columns are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, settled

RANGE_BITS, TIE_BITS, ROUND_BITS = 17, 38, 14
#: Levels of the tree after which the rows are written anew with their nodes.
REWRITE_LEVELS = 6
#: What tells texts apart: bytes, a checksum and a hash.
TEXT = ["text_size", "text_crc32", "text_hash"]
#: Parts into which each shard's rows are dealt for numbering its slots.
SLOT_PARTS = 64


def default_dimensions(docs: DataFrame) -> dict[str, Column]:
    """Number-valued metadata: the columns that documents have, categories by a hash of their value."""
    found = {"size": F.octet_length("text").cast("double")}
    for name, kind in docs.dtypes:
        if name in ("lang", "source"):
            found[name] = F.pmod(F.xxhash64(name), F.lit(1 << 20)).cast("double")
        elif name == "doc_id" and kind in ("int", "bigint"):
            found[name] = F.col(name).cast("double")
    return found


def _small(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of one row a node, as one literal that the JVM reads; there are no more nodes than shards."""
    text = F.lit(json.dumps(rows))
    return F.broadcast(spark.range(1).select(F.inline(F.from_json(text, f"array<struct<{schema}>>"))))


def _spread(rows: DataFrame, dims: list[str]) -> dict[int, dict]:
    """Bytes and each dimension's bounds of every node; as many rows as there are nodes come to the driver."""
    bounds = [f(d).alias(f"{a}_{d}") for d in dims for a, f in (("lo", F.min), ("hi", F.max))]
    return {r["node"]: r.asDict() for r in rows.groupBy("node").agg(F.sum("size").alias("bytes"), *bounds).collect()}


def _position(dims: list[str]) -> Column:
    """A row's position along its node's chosen dimension."""
    value = F.coalesce(*[F.when(F.col("dim") == k, F.col(d)) for k, d in enumerate(dims)])
    part = (value - F.col("lo")) * F.col("scale")
    top = F.lit((1 << RANGE_BITS) - 1)
    return F.least(F.floor(part), top).cast("long") * (1 << TIE_BITS) + F.col("tie")


def _split_points(rows: DataFrame, todo: dict[int, dict], dims: list[str]) -> list[dict]:
    """For each node the last position that goes left."""
    spark, bits = rows.sparkSession, RANGE_BITS + TIE_BITS
    state = {n: {"prefix": 0, "before": 0, "left": bits, "rows": 2} for n in todo}
    for left in range(bits - ROUND_BITS, -ROUND_BITS, -ROUND_BITS):
        left = max(left, 0)
        wide = min(s["left"] for s in state.values() if s["rows"] > 1)
        table = _small(
            spark,
            [{"node": n, "dim": t["dim"], "lo": t["lo"], "scale": t["scale"], "prefix": state[n]["prefix"], "target": float(t["target"] - state[n]["before"])} for n, t in todo.items() if state[n]["rows"] > 1],
            "node int, dim int, lo double, scale double, prefix bigint, target double",
        )
        placed = rows.join(table, "node").withColumn("position", _position(dims))
        part = placed.where(F.shiftright("position", wide) == F.col("prefix"))
        sums = part.groupBy("node", "target", F.shiftright("position", left).alias("bucket")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
        running = sums.withColumn("upto", F.sum("bytes").over(Window.partitionBy("node").orderBy("bucket")))
        chosen = running.where(F.col("upto") >= F.col("target")).groupBy("node").agg(F.min(F.struct("bucket", "upto", "bytes", "n")).alias("at"))
        for r in chosen.collect():
            before = state[r["node"]]["before"]
            state[r["node"]] = {"prefix": r["at"]["bucket"], "before": before + r["at"]["upto"] - r["at"]["bytes"], "upto": before + r["at"]["upto"], "left": left, "rows": r["at"]["n"]}
        if all(s["rows"] <= 1 for s in state.values()):
            break
    points = []
    for n, s in state.items():
        nearer_with = abs(s["upto"] - todo[n]["target"]) <= abs(s["before"] - todo[n]["target"])
        last = (s["prefix"] + nearer_with << s["left"]) - 1
        points.append({"node": n, "dim": todo[n]["dim"], "lo": todo[n]["lo"], "scale": todo[n]["scale"], "last": last, "right": n + todo[n]["left"]})
    return points


def _units(rows: DataFrame, dims: list[str], most: float) -> tuple[DataFrame, DataFrame]:
    """What is dealt: a row a text whose copies have no more than `most` bytes in sum, and the rows of the other texts; and those texts,
    of which there are as many as `most` goes into all bytes at most."""
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *dims)).alias("first")
    groups = rows.groupBy(*TEXT).agg(F.sum("size").alias("bytes"), first)
    large = keep(groups.where(F.col("bytes") > most).select(*TEXT), "kd-large")
    whole = groups.where(F.col("bytes") <= most).select(*TEXT, F.col("bytes").alias("size"), *[F.col(f"first.{d}").alias(d) for d in dims], F.lit(None).cast(rows.schema["doc_id"].dataType).alias("doc_id"), F.lit(True).alias("whole"))
    single = rows.join(F.broadcast(large), TEXT, "left_semi").select(*TEXT, "size", *dims, "doc_id", F.lit(False).alias("whole"))
    return whole.unionByName(single), large


def kd_shards(docs: DataFrame, n_shards: int | None = None, target_bytes: int | None = None, dimensions: dict[str, Column] | None = None, together: int = 10) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of docs (doc_id, text, metadata)."""
    dimensions = dimensions or default_dimensions(docs)
    dims = [f"d{k}" for k in range(len(dimensions))]
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
        *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(d) for d, c in zip(dims, dimensions.values(), strict=True)],
    )
    rows = keep(rows.withColumn("text_size", F.col("size")), "kd-rows")
    documents, total = rows, rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    n_shards = n_shards or max(1, math.ceil(total / target_bytes))
    units, large = _units(rows, dims, total / n_shards / together)
    rows = keep(units.withColumns({"tie": F.pmod(F.xxhash64("doc_id", *TEXT), F.lit(1 << TIE_BITS)), "node": F.lit(0)}), "kd-units")
    spread = _spread(rows, dims)
    whole = spread.get(0, {"bytes": 0} | {f"{a}_{d}": 0.0 for a in ("lo", "hi") for d in dims})
    leaves, level = {0: n_shards}, 0  # a node is named by its first leaf
    while True:
        todo = {}
        for node, n in leaves.items():
            if n > 1 and node in spread:
                at = spread[node]
                width = [(at[f"hi_{d}"] - at[f"lo_{d}"]) / ((whole[f"hi_{d}"] - whole[f"lo_{d}"]) or 1.0) for d in dims]
                k = width.index(max(width))
                across = at[f"hi_{dims[k]}"] - at[f"lo_{dims[k]}"]
                todo[node] = {"dim": k, "lo": at[f"lo_{dims[k]}"], "scale": (1 << RANGE_BITS) / across if across else 0.0, "left": n // 2, "target": at["bytes"] * (n // 2) / n}
        if not todo:
            break
        points = _small(rows.sparkSession, _split_points(rows, todo, dims), "node int, dim int, lo double, scale double, last bigint, right int")
        placed = rows.join(points, "node", "left")
        rows = placed.withColumn("node", F.when(_position(dims) > F.col("last"), F.col("right")).otherwise(F.col("node"))).select(rows.columns)
        level += 1
        if level % REWRITE_LEVELS == 0:
            rows = keep(rows, "kd-rows")
        for node in todo:
            leaves |= {node + leaves[node] // 2: leaves[node] - leaves[node] // 2, node: leaves[node] // 2}
        spread = _spread(rows, dims) if max(leaves.values()) > 1 else {}
    rows = rows.withColumnRenamed("node", "shard")
    members = documents.join(F.broadcast(large), TEXT, "left_anti").join(rows.where("whole").select(*TEXT, "shard"), TEXT)
    columns = ["doc_id", "text_size", "text_crc32", "shard"]
    placed = members.select(columns).unionByName(rows.where("not whole").select(columns)).withColumnRenamed("text_size", "size")
    return _with_slots(placed.withColumn("tie", F.xxhash64("doc_id", "text_crc32", "size")))


def _with_slots(rows: DataFrame) -> DataFrame:
    """Gapless numbers within each shard, without gathering a shard in one task."""
    rows = rows.withColumn("part", F.pmod("tie", F.lit(SLOT_PARTS)))
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size"))
    numbered = rows.withColumn("within", within).join(before, ["shard", "part"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("within") - 1).alias("slot"))


def op1_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return settled(spark, "op1", lambda: kd_shards(docs, n_shards=40).withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")}))
