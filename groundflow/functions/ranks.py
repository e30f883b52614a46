"""Exact percentiles without bringing all values into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Entries of the sketch that brackets a rank; its answers lie within 1/ACCURACY of the rank asked for.
ACCURACY = 10_000

#: Parts that a group's values are dealt into, by the value.
PARTS = 16


def exact_percentiles(rows: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """One row a group of `by`: p0, p1, ... for the shares, with linear interpolation between the two nearest values.

    The rows are read twice. A mergeable sketch first gives two values that enclose each rank; then the rows below are
    counted, each value once, and only values between the two (a few ten-thousandths of all) are walked in order. Should a
    sketch ever be further off than it promises, the query fails and does not answer wrongly. Nulls are left out; a
    group without values or with a null key has no row; without `by` there is one row, of nulls if there are no values."""
    if not by:
        whole = exact_percentiles(rows.select(F.lit(0).alias("all"), value), value, shares, ["all"]).drop("all")
        return whole.agg(*[F.max(f"p{k}").alias(f"p{k}") for k in range(len(shares))])
    by, slack = list(by), 4.0 / ACCURACY  # the sketch's error, and a rank counted from 0 instead of 1
    held = rows.select(*by, F.col(value).cast("double").alias("v"))
    edges = [min(1.0, max(0.0, s + d)) for s in shares for d in (-slack, slack)]
    sketch = held.groupBy(*by).agg(F.count("v").alias("n"), F.percentile_approx("v", edges, ACCURACY).alias("edges"), F.min("v").alias("least"), F.max("v").alias("most"))
    # few values are all taken: there a rank is a larger share than the slack
    edge = lambda k, end, name: F.when((F.col("n") <= ACCURACY) | F.lit(edges[k] == end), F.col(name)).otherwise(F.col("edges")[k])
    wanted = sketch.select(*by, "n", F.posexplode(F.array(*[
        F.struct(
            (F.lit(float(s)) * (F.col("n") - 1)).alias("rank"),
            edge(2 * k, 0.0, "least").alias("low"),
            edge(2 * k + 1, 1.0, "most").alias("high"),
        )
        for k, s in enumerate(shares)
    ])).alias("k", "w")).select(*by, "k", "w.*")
    # a group's ranks travel as one array, so that a value is not multiplied before most of its copies can go
    ranks = wanted.groupBy(*by).agg(F.collect_list(F.struct("k", "rank", "low", "high")).alias("ranks"))
    values = held.where("v is not null").groupBy(*by, "v").agg(F.count("*").alias("n"))
    if by == ["all"]:
        met = values.join(F.broadcast(ranks), by)  # one row
    else:  # few groups may hold all rows, so each meets its ranks in several parts
        ranks = ranks.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        met = values.withColumn("_part", F.pmod(F.xxhash64("v"), F.lit(PARTS)).cast("int")).join(ranks, [*by, "_part"])
    placed = met.select(*by, "v", "n", F.explode("ranks").alias("r"))
    near = placed.where(F.col("v") <= F.col("r.high")).select(*by, F.col("r.k").alias("k"), F.col("r.rank").alias("rank"), F.when(F.col("v") >= F.col("r.low"), F.col("v")).alias("v"), "n")
    counts = near.groupBy(*by, "k", "rank", "v").agg(F.sum("n").alias("n"))  # v null: the rows below the bracket
    upto = F.sum("n").over(Window.partitionBy(*by, "k", "rank").orderBy(F.col("v").asc_nulls_first()))
    steps = counts.withColumn("upto", upto).where("v is not null").withColumn("first", F.col("upto") - F.col("n"))
    at = lambda whole: F.max(F.when((F.col("first") <= whole) & (whole < F.col("upto")), F.col("v")))
    found = steps.groupBy(*by, "k", "rank").agg(at(F.floor("rank")).alias("a"), at(F.ceil("rank")).alias("b"))
    sure = F.when(F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.lit("a rank lies outside its bracket")).cast("double"))
    part = F.col("rank") - F.floor("rank")
    # the form that keeps both ends exact and never leaves the span between them
    exact = F.coalesce(sure, F.when(part == 0, F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * part))
    return found.withColumn("p", exact).groupBy(*by).agg(*[F.max(F.when(F.col("k") == k, F.col("p"))).alias(f"p{k}") for k in range(len(shares))])
