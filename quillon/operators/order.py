"""Exact ranks and quantiles by group without sorting a group in one task.

Values are put in order by ranges that sampling finds, as a sort would, so outliers and dense stretches don't crowd a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.sources.durable import materialise


def placed(df: DataFrame, value: str, by: list[str], weight: str | None = None) -> DataFrame:
    """Rows in the order of (by, value), written once, with ``_part``, the stretch of the order that a row is in, and
    ``_start``, the weight (default: rows) of the row's group in the stretches before.

    Stretches are cut by sampled splitters, so they hold about equally many rows whatever the values are; equal values of
    a group share a stretch."""
    d = df.repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id())
    d = materialise(d, "in-order")
    size = d.groupBy(*by, "_part").agg(F.sum(weight if weight else F.lit(1)).alias("_size"))
    up = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    size = size.withColumn("_start", F.coalesce(F.sum("_size").over(up), F.lit(0))).drop("_size")
    if not by:
        return d.join(size, "_part")
    same = [d[c].eqNullSafe(size[c]) for c in by]
    on = d["_part"] == size["_part"]
    for c in same:
        on = on & c
    return d.join(size, on).select(d["*"], size["_start"])


def positions(df: DataFrame, value: str, by: list[str], also: dict[str, Column] | None = None) -> DataFrame:
    """by, value, _n, _before: each distinct value of a group, how often it occurs, and how many smaller ones there are;
    ``also`` names further aggregates of a value's rows.  Null values are left out."""
    also = also or {}
    n = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"), *[c.alias(k) for k, c in also.items()])
    inside = Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_start") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    return placed(n, value, by, "_n").select(*by, value, "_n", before.alias("_before"), *also)


def row_ranks(df: DataFrame, value: str, by: list[str], out: str = "rank") -> DataFrame:
    """Rows with ranks from 1, ties at their mean, by group, without a join back on the value: for values that are mostly
    different, as all rows of one value meet in one stretch."""
    low = Window.partitionBy(*by, "_part").orderBy(value)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, "_part", value))
    rank = F.col("_start") + F.rank().over(low) + (ties - 1) / 2
    return placed(df, value, by).withColumn(out, rank).drop("_part", "_start")


def average_ranks(df: DataFrame, value: str, by: list[str], out: str = "rank") -> DataFrame:
    """Rows of ``df`` with ranks from 1, ties at their mean, by group, and ``tied``, the number of equal values."""
    n = positions(df, value, by).withColumn(out, F.col("_before") + (F.col("_n") + 1) / 2)
    return df.join(n.drop("_before").withColumnRenamed("_n", "tied"), [*by, value])


def quantiles(df: DataFrame, value: str, by: list[str], probs: dict[str, float]) -> DataFrame:
    """by and one column for each named probability: exact quantiles, interpolated between neighbours."""
    p = positions(df, value, by)
    total = p.groupBy(*by).agg(F.sum("_n").alias("_total"))
    p = p.join(total, by)
    covers = lambda at: (F.col("_before") <= at) & (at < F.col("_before") + F.col("_n"))
    agg = []
    for name, q in probs.items():
        at = (F.col("_total") - 1) * q
        agg += [F.max(F.when(covers(end(at)), F.col(value))).alias(f"{name}_{i}") for i, end in enumerate((F.floor, F.ceil))]
    g = p.groupBy(*by).agg(F.first("_total").alias("_total"), *agg)
    part = lambda q: (F.col("_total") - 1) * q - F.floor((F.col("_total") - 1) * q)
    return g.select(*by, *[(F.col(f"{n}_0") + (F.col(f"{n}_1") - F.col(f"{n}_0")) * part(q)).alias(n) for n, q in probs.items()])
