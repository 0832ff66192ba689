"""Hierarchical clustering of labels, and scores of clusterings; plus speaker vectors, filling and scaling."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import vectors as V

#: Merges below this share of the greatest height are drawn in their cluster's colour.
COLOUR_SHARE = 0.7


def ward(d: np.ndarray) -> np.ndarray:
    """Linkage rows (left, right, height, size) by the Lance-Williams update for Ward's criterion on any distances.

    A chain of nearest neighbours on the squared distances: n^2 numbers and about 3 n steps over one row each.  Ward's
    criterion never brings a union nearer than its parts were, so the chain stays valid after a merge, and the merges
    sorted by height are those of always joining the closest pair.  Equal distances: the smallest number first."""
    n = len(d)
    d2 = np.square(np.asarray(d, dtype=float))
    np.fill_diagonal(d2, np.inf)
    size, top = np.ones(n), np.zeros(n)
    live = np.ones(n, bool)
    chain, found, start = [], [], 0
    for _ in range(n - 1):
        if not chain:
            while not live[start]:
                start += 1
            chain = [start]
        while True:
            i = chain[-1]
            j = int(d2[i].argmin())
            if len(chain) > 1 and d2[i, chain[-2]] <= d2[i, j]:
                j = chain[-2]
                break
            chain.append(j)
        del chain[-2:]
        i, j = min(i, j), max(i, j)
        v = d2[i, j]
        row = ((size[i] + size) * d2[i] + (size[j] + size) * d2[j] - size * v) / (size[i] + size[j] + size)
        live[i] = False
        row[~live] = np.inf
        row[j] = np.inf
        d2[i], d2[:, i], d2[j], d2[:, j] = np.inf, np.inf, row, row
        size[j] += size[i]
        # Rounding must not put a union below its parts.
        top[j] = max(v, top[i], top[j])
        found.append((top[j], i, j))
    # The union took its right part's place: follow places to the number of the cluster that stands there.
    place, count, out = list(range(n)), [1] * n, []
    for step, (v, i, j) in enumerate(sorted(found, key=lambda m: m[0])):
        left, right = sorted((place[i], place[j]))
        count[j] += count[i]
        place[j] = n + step
        out.append((left, right, math.sqrt(max(v, 0.0)), count[j]))
    return np.array(out)


def cut(z: np.ndarray, n: int, k: int) -> list[int]:
    """Cluster numbers from 1 with at most k clusters: the lowest height at which that many are left."""
    heights = sorted(z[:, 2]) if len(z) else []
    limit = -1.0 if k >= n else heights[n - k - 1]
    parent = list(range(2 * n - 1))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for s, row in enumerate(z):
        if row[2] <= limit:
            parent[find(int(row[0]))] = parent[find(int(row[1]))] = n + s
    roots, out = {}, []
    for i in range(n):
        out.append(roots.setdefault(find(i), len(roots) + 1))
    return out


def _per_matrix(matrix: DataFrame, by: list[str], key: str, d: str, columns: list[str], schema: str, rows) -> DataFrame:
    """``rows(items, z)`` for the Ward linkage z of each long distance matrix; none for a matrix of fewer than two items or
    with a gap.

    A matrix' row travels as one array in the order of its items, so a task holds n^2 numbers and n names, no pairs of
    names.  Items are labels or speakers, not tokens."""
    kinds = dict(matrix.dtypes)
    cells = F.array_sort(F.collect_list(F.struct(F.col(f"{key}_j").alias("j"), F.col(d).cast("double").alias("d"))))
    packed = matrix.groupBy(*by, F.col(f"{key}_i").alias("_item")).agg(cells.alias("_row")).select(*by, "_item", F.transform("_row", lambda c: c["d"]).alias("_row"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_item")
        n, out = len(pdf), []
        if n > 1 and all(len(r) == n for r in pdf["_row"]):
            m = np.array([np.asarray(r, dtype=float) for r in pdf["_row"]])
            if not np.isnan(m).any():
                out = [(*pdf[by].iloc[0], *r) for r in rows(list(pdf["_item"]), ward(m))]
        return pd.DataFrame(out, columns=[*by, *columns])

    return packed.groupBy(*by).applyInPandas(run, "".join(f"`{b}` {kinds[b]}, " for b in by) + schema)


def ward_clusters(matrix: DataFrame, by: list[str], key: str, ks: tuple[int, ...], d: str = "d") -> DataFrame:
    """(by, k, item, cluster) by Ward linkage of long distance matrices, one per group."""
    kind = dict(matrix.dtypes)[f"{key}_i"]
    rows = lambda items, z: [(k, item, c) for k in ks for item, c in zip(items, cut(z, len(items), k))]
    return _per_matrix(matrix, by, key, d, ["k", key, "cluster"], f"k int, `{key}` {kind}, cluster int", rows)


def linkage(matrix: DataFrame, by: list[str], key: str, d: str = "d") -> DataFrame:
    """Dendrogram rows (by, step, left, right, height, size); items are numbered in order from 0, merges go on from n."""
    rows = lambda items, z: [(s, int(r[0]), int(r[1]), r[2], int(r[3])) for s, r in enumerate(z)]
    return _per_matrix(matrix, by, key, d, ["step", "left", "right", "height", "size"], "step int, left int, right int, height double, size int", rows)


def below_threshold(merges: DataFrame, by: list[str], share: float = COLOUR_SHARE) -> DataFrame:
    """Adds ``coloured``: whether a merge lies below ``share`` of its dendrogram's greatest height."""
    top = F.max("height").over(Window.partitionBy(*by))
    return merges.withColumn("coloured", F.col("height") < share * top)


def silhouette(matrix: DataFrame, clusters: DataFrame, by: list[str], key: str, d: str = "d") -> DataFrame:
    """Mean silhouette by group; a singleton counts 0, and a single cluster or as many clusters as items give null."""
    i, j = f"{key}_i", f"{key}_j"
    a = clusters.select(*by, F.col(key).alias(i), F.col("cluster").alias("own"))
    b = clusters.select(*by, F.col(key).alias(j), F.col("cluster").alias("other"))
    shared = [c for c in by if c in matrix.columns]
    pairs = matrix.join(a, [*shared, i]).join(b, [*by, j])
    to = pairs.groupBy(*by, i, "own", "other").agg(F.sum(d).alias("s"), F.count(F.lit(1)).alias("n"))
    near = to.groupBy(*by, i).agg(
        F.max(F.when(F.col("own") == F.col("other"), F.try_divide("s", F.col("n") - 1))).alias("a"),
        F.min(F.when(F.col("own") != F.col("other"), F.col("s") / F.col("n"))).alias("b"), F.max("own").alias("own"),
    )
    s = F.when(F.col("a").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    g = near.groupBy(*by).agg(F.avg(s).alias("s"), F.count_distinct("own").alias("n_clusters"), F.count(F.lit(1)).alias("n"))
    return g.select(*by, F.when((F.col("n_clusters") > 1) & (F.col("n_clusters") < F.col("n")), F.col("s")).alias("silhouette"))


def adjusted_rand(clusters: DataFrame, by: list[str], truth: str, cluster: str = "cluster") -> DataFrame:
    """Adjusted Rand index by group over items whose truth is known (>= 0); null below two items, 1 if both are trivial."""
    d = clusters.where(F.col(truth) >= 0)
    pairs = lambda n: F.sum(F.col(n) * (F.col(n) - 1) / 2)
    cells = d.groupBy(*by, truth, cluster).agg(F.count(F.lit(1)).alias("n"))
    both = cells.groupBy(*by).agg(pairs("n").alias("both"), F.sum("n").alias("total"))
    one = lambda c, out: cells.groupBy(*by, c).agg(F.sum("n").alias("n")).groupBy(*by).agg(pairs("n").alias(out))
    j = both.join(one(truth, "rows"), by).join(one(cluster, "cols"), by)
    expected = F.try_divide(F.col("rows") * F.col("cols"), F.col("total") * (F.col("total") - 1) / 2)
    top = (F.col("rows") + F.col("cols")) / 2
    ari = F.when(top == expected, 1.0).otherwise(F.try_divide(F.col("both") - expected, top - expected))
    return j.select(*by, F.when(F.col("total") >= 2, ari).alias("ari"))


def unit_vectors(df: DataFrame, unit: str, label: str, v: str = "v", missing: float | None = None, within: list[str] | None = None) -> DataFrame:
    """(within, unit, label, dim, x): the units' label centroids one after another; a missing cell is null, or ``missing``.

    ``within`` keeps groups (models) apart, whose vectors may differ in width."""
    within = within or []
    c = df.where(V.is_valid(v)).groupBy(*within, unit, label).agg(F.count(F.lit(1)).alias("n"), V.vector_sum(v).alias("s"))
    c = c.select(*within, unit, label, V.scaled(F.col("s"), F.col("n")).alias("c"))
    labels = c.groupBy(*within, label).agg(F.max(F.size("c")).alias("width"))
    units = c.select(*within, unit).distinct()
    grid = units.join(labels, within) if within else units.crossJoin(labels)
    full = grid.join(c, [*within, unit, label], "left")
    cell = F.when(F.col("c").isNotNull(), F.col("c")).otherwise(F.array_repeat(F.lit(missing).cast("double"), F.col("width")))
    return full.select(*within, unit, label, F.posexplode(cell).alias("dim", "x"))


def impute_mean(long: DataFrame, by: list[str], x: str = "x") -> DataFrame:
    """Missing values as the mean of their column; columns without any value are dropped."""
    mean = long.groupBy(*by).agg(F.avg(x).alias("_mean"))
    return long.join(mean.where("_mean is not null"), by).withColumn(x, F.coalesce(F.col(x), F.col("_mean"))).drop("_mean")


def z_scores(long: DataFrame, by: list[str], x: str = "x") -> DataFrame:
    """(x - mean) / population deviation by column; a constant column becomes 0."""
    s = long.groupBy(*by).agg(F.avg(x).alias("_mean"), F.stddev_pop(x).alias("_sd"))
    return long.join(s, by).withColumn("z", (F.col(x) - F.col("_mean")) / F.when(F.col("_sd") == 0, 1.0).otherwise(F.col("_sd"))).drop("_mean", "_sd")


def best_partition(rows: DataFrame, by: str) -> DataFrame:
    """The k with the best silhouette, the smallest of equals; null where no k has one."""
    pick = F.min(F.when(F.col("silhouette").isNotNull(), F.struct((-F.col("silhouette")).alias("s"), F.col("k")))).alias("b")
    return rows.groupBy(by).agg(pick).select(by, F.col("b.k").alias("best_k"), (-F.col("b.s")).alias("silhouette"))
