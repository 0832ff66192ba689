"""Centroids, distance matrices in long form, and cosine statistics from vector sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import vectors as V
from quillon.operators.ingest import labelled


def centroids(df: DataFrame, by: list[str], v: str = "v", nan_policy: str = "drop") -> DataFrame:
    """by, n, centroid over valid vectors; groups without any are absent.

    "drop" leaves out invalid vectors; "propagate" gives a null centroid to a group that has one."""
    keyed = df.where(" and ".join(f"`{b}` is not null" for b in by))
    ok = V.is_valid(v)
    g = keyed.where(ok).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), V.vector_sum(v).alias("s"))
    out = g.select(*by, "n", V.scaled(F.col("s"), F.col("n")).alias("centroid"))
    if nan_policy == "propagate":
        bad = keyed.where(~ok).select(*by).distinct().withColumn("_bad", F.lit(True))
        out = out.join(bad, by, "left").withColumn("centroid", F.when(F.col("_bad").isNull(), F.col("centroid"))).drop("_bad")
    return out


def long_matrix(c: DataFrame, key: str = "phoneme", v: str = "centroid", metric: str = "euclidean", within: list[str] | None = None) -> DataFrame:
    """(key_i, key_j, d) of all pairs, both triangles and the diagonal; ``within`` keeps groups apart.

    One row per label: the table that is paired is as small as the label set, whatever the number of tokens."""
    within = within or []
    a = c.select(*within, F.col(key).alias(f"{key}_i"), F.col(v).alias("_a"))
    b = c.select(*within, F.col(key).alias(f"{key}_j"), F.col(v).alias("_b"))
    pairs = a.join(b, within) if within else a.crossJoin(b)
    d = V.euclidean(F.col("_a"), F.col("_b")) if metric == "euclidean" else V.cosine_distance(F.col("_a"), F.col("_b"), "eps", True)
    return pairs.select(*within, f"{key}_i", f"{key}_j", d.alias("d"))


def between_class_ratio(df: DataFrame, by: str, v: str = "v", within: list[str] | None = None) -> DataFrame:
    """Between-class over total sum of squares of vectors, from class sums: sum n_k |m_k - m|^2 / sum |x - m|^2.

    Rows whose label is null or empty take no part."""
    within = within or []
    ok = labelled(df, by).where(V.is_valid(v)).withColumn("_q", V.dot(V.as_double(v), V.as_double(v)))
    k = ok.groupBy(*within, by).agg(F.count(F.lit(1)).alias("n"), F.sum("_q").alias("q"), V.vector_sum(v).alias("s"))
    k = k.withColumn("between", V.dot(F.col("s"), F.col("s")) / F.col("n"))
    g = k.groupBy(*within).agg(F.sum("n").alias("n"), F.sum("q").alias("q"), F.sum("between").alias("b"), V.vector_sum("s").alias("s"))
    grand = V.dot(F.col("s"), F.col("s")) / F.col("n")
    return g.select(*within, F.col("n").cast("bigint").alias("n"), F.try_divide(F.col("b") - grand, F.col("q") - grand).alias("between_class_ratio"))


def within_between_cosine(df: DataFrame, by: str, v: str = "v", within: list[str] | None = None) -> DataFrame:
    """Mean cosine similarity of ordered pairs inside and across classes, from sums of unit vectors (no pairs made).

    Rows whose label is null or empty take no part."""
    within = within or []
    ok = labelled(df, by).where(V.is_valid(v)).withColumn("_u", V.unit(V.as_double(v), "none"))
    ok = ok.where(F.col("_u")[0].isNotNull()).withColumn("_q", V.dot(F.col("_u"), F.col("_u")))
    k = ok.groupBy(*within, by).agg(F.count(F.lit(1)).alias("n"), F.sum("_q").alias("q"), V.vector_sum("_u").alias("s"))
    k = k.withColumn("ss", V.dot(F.col("s"), F.col("s")))
    g = k.groupBy(*within).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum("q").alias("q"), F.sum("ss").alias("ss"), V.vector_sum("s").alias("s")
    )
    inside = F.try_divide(F.col("ss") - F.col("q"), (F.col("n2") - F.col("n")).cast("double"))
    across = F.try_divide(V.dot(F.col("s"), F.col("s")) - F.col("ss"), (F.col("n") * F.col("n") - F.col("n2")).cast("double"))
    return g.select(*within, inside.alias("within_cosine"), across.alias("between_cosine"), F.try_divide(inside, across).alias("within_between_cosine_ratio"))


def intra_unit_cosine(df: DataFrame, by: list[str], unit: str = "spk", v: str = "v") -> DataFrame:
    """Mean cosine distance of pairs of one unit, pooled over units, by group; zero vectors count as similarity 0."""
    ok = df.where(V.is_valid(v)).withColumn("_u", V.unit(V.as_double(v), "eps"))
    k = ok.groupBy(*by, unit).agg(F.count(F.lit(1)).alias("n"), F.sum(V.dot(F.col("_u"), F.col("_u"))).alias("q"), V.vector_sum("_u").alias("s"))
    k = k.where("n >= 2").withColumn("pairs", F.col("n") * (F.col("n") - 1) / 2)
    far = F.col("pairs") - (V.dot(F.col("s"), F.col("s")) - F.col("q")) / 2
    return k.groupBy(*by).agg(F.try_divide(F.sum(far), F.sum("pairs")).alias("intra_cosine"), F.sum("pairs").cast("bigint").alias("n_pairs"))


def delta0(df: DataFrame, within: list[str], by: str = "phoneme", unit: str = "spk", v: str = "v") -> DataFrame:
    """Mean over labels of the intra-unit cosine distance, labels unweighted."""
    return intra_unit_cosine(df, [*within, by], unit, v).groupBy(*within).agg(F.avg("intra_cosine").alias("delta0"))
