"""Centroid clustering with Yinyang bounds.

Centroids are put into groups once, at the start.  Each vector carries an upper bound on the distance to its own centroid
and, for each group, a lower bound on the distance to the group's other centroids.  After the centroids have moved,
bounds are shifted by how far; a vector whose upper bound lies below all its group bounds keeps its cluster without a
distance computed.  The rest are filtered group by group, then centroid by centroid, and only what survives is measured.

Vectors are whole numbers and distances are compared as whole numbers, ties going to the smaller centroid, so that the
bounds (double precision, each step rounded outwards) only save work and never change the result.

A round is one pass over a written table of vectors and bounds.  It writes the next such table and, in rows of their
own, how its tasks changed the sums of each centroid; only these sums are shuffled, and one row a centroid reaches the
driver.  Vectors are never shuffled, so a common vector makes no hot task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.durable import discard, materialise

#: Largest whole-number component for which squared distances of 64 components stay within a long.
LIMIT = 1 << 27
#: Relative widening of bounds, far above the rounding of a few double operations.
SLACK = 1e-12


def centroid_groups(centroids: np.ndarray, n_groups: int, rounds: int = 5) -> np.ndarray:
    """The group of each centroid: a few rounds of Lloyd's method over the centroids alone (k rows, on the driver)."""
    c = centroids.astype(np.float64)
    n_groups = max(1, min(n_groups, len(c)))
    means = c[np.linspace(0, len(c) - 1, n_groups).astype(int)]
    group = np.zeros(len(c), dtype=np.int64)
    for _ in range(rounds):
        group = ((c[:, None, :] - means[None]) ** 2).sum(-1).argmin(1)
        means = np.stack([c[group == g].mean(0) if (group == g).any() else means[g] for g in range(n_groups)])
    return np.unique(group, return_inverse=True)[1]


def _up(x):
    return x * (1 + SLACK)


def _down(x):
    return np.where(x > 0, x * (1 - SLACK), x * (1 + SLACK))


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def first_assignment(x: np.ndarray, centroids: np.ndarray, group: np.ndarray):
    """Cluster, squared distance, upper and group bounds, distances measured: every centroid is measured."""
    exact = np.stack([_squared(x, c[None]) for c in centroids], axis=1) if len(x) else np.zeros((0, len(centroids)), np.int64)
    own = exact.argmin(1)
    at = np.arange(len(x))
    squared = exact[at, own]
    d = np.sqrt(exact.astype(np.float64))
    d[at, own] = np.inf
    lower = np.stack([d[:, group == g].min(1) for g in range(group.max() + 1)], axis=1)
    return own, squared, _up(np.sqrt(squared.astype(np.float64))), _down(lower), exact.size


def reassign(x, own, upper, lower, centroids, group, drift):
    """The same after the centroids moved by ``drift`` each; ``squared`` is -1 where it wasn't measured."""
    n_groups = lower.shape[1]
    most = np.array([drift[group == g].max() for g in range(n_groups)])
    own, upper, before, lower = own.copy(), _up(upper + drift[own]), lower, _down(lower - most)
    squared = np.full(len(x), -1, dtype=np.int64)
    rows = np.flatnonzero(upper >= lower.min(1))
    measured = len(rows)
    squared[rows] = _squared(x[rows], centroids[own[rows]])
    upper[rows] = _up(np.sqrt(squared[rows].astype(np.float64)))
    rows = rows[upper[rows] >= lower[rows].min(1)]
    if not len(rows):
        return own, squared, upper, lower, measured
    k = len(centroids)
    was, best, best_sq = own[rows], own[rows].copy(), squared[rows].copy()
    bound = np.full((len(rows), k), np.inf)  # of each centroid that was looked at: its distance, or a lower bound
    bound[np.arange(len(rows)), was] = _down(np.sqrt(best_sq.astype(np.float64)))
    open_groups = upper[rows, None] >= lower[rows]
    for j in range(k):
        g = group[j]
        look = np.flatnonzero(open_groups[:, g] & (was != j))
        own_bound = _down(before[rows[look], g] - drift[j])
        bound[look, j] = own_bound
        look = look[own_bound <= _up(np.sqrt(best_sq[look].astype(np.float64)))]
        sq = _squared(x[rows[look]], centroids[j][None])
        measured += len(look)
        bound[look, j] = _down(np.sqrt(sq.astype(np.float64)))
        closer = (sq < best_sq[look]) | ((sq == best_sq[look]) & (j < best[look]))
        best[look[closer]], best_sq[look[closer]] = j, sq[closer]
    bound[np.arange(len(rows)), best] = np.inf
    for g in range(n_groups):
        new = bound[:, group == g].min(1)
        # A group that stayed shut keeps its bound, but for the centroid that a vector has left.
        lower[rows, g] = np.where(open_groups[:, g], new, np.minimum(lower[rows, g], new))
    own[rows], squared[rows] = best, best_sq
    upper[rows] = _up(np.sqrt(best_sq.astype(np.float64)))
    return own, squared, upper, lower, measured


def _matrix(column, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width) if len(column) else np.zeros((0, width), np.int64)


def _list(values: np.ndarray, width: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * width), pa.array(values.ravel()))


def _pass(centroids: np.ndarray, group: np.ndarray, drift: np.ndarray | None, last: bool):
    """One round over batches of the state.  The rows after the vectors hold changes of sums: ``id`` null, ``cluster``
    the centroid, ``delta`` count and component sums; the one with cluster -1 counts measured distances."""
    k, width, groups = len(centroids), centroids.shape[1], int(group.max()) + 1

    def run(batches):
        delta, measured = np.zeros((k, width + 1), dtype=np.int64), 0
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            if drift is None:
                own, squared, upper, lower, n = first_assignment(x, centroids, group)
                was = np.full(len(x), -1)
            else:
                was = np.asarray(batch.column("cluster"))
                own, squared, upper, lower, n = reassign(x, was, np.asarray(batch.column("upper")), _matrix(batch.column("lower"), groups), centroids, group, drift)
            measured += n
            moved = was != own
            for j in range(k):
                for sign, rows in ((1, moved & (own == j)), (-1, moved & (was == j))):
                    if rows.any():
                        delta[j, 0] += sign * rows.sum()
                        delta[j, 1:] += sign * x[rows].sum(0)
            if last:
                todo = np.flatnonzero(squared < 0)
                squared[todo] = _squared(x[todo], centroids[own[todo]])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("x"), pa.array(own.astype(np.int32)), pa.array(squared), pa.array(upper), _list(lower, groups), pa.nulls(len(x), pa.list_(pa.int64()))],
                names=_NAMES,
            )
        changed = np.flatnonzero(delta.any(1))
        rows = np.vstack([delta[changed], np.full((1, width + 1), measured, dtype=np.int64)])
        n = len(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(n, pa.string()), pa.nulls(n, pa.list_(pa.int64())), pa.array([*changed.tolist(), -1], pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.list_(pa.float64())), _list(rows, width + 1)],
            names=_NAMES,
        )

    return run


_NAMES = ["id", "x", "cluster", "squared", "upper", "lower", "delta"]
_SCHEMA = "id string, x array<long>, cluster int, squared long, upper double, lower array<double>, delta array<long>"


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, width: int, scale: int) -> DataFrame:
    """``id, x`` of the vectors with ``width`` components, none null or not finite: floor(scale * component)."""
    value = lambda e: e.cast("double")
    fine = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(value(e)) != float("inf"))
    d = df.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).alias("v")).where((F.size("v") == width) & F.forall("v", fine))
    big = F.exists("v", lambda e: F.abs(value(e) * scale) > LIMIT)
    x = F.transform("v", lambda e: F.floor(value(e) * scale).cast("long"))
    # A squared distance of larger components may not fit into a long, so there is no right row to return.
    return d.select("id", F.when(big, F.raise_error(F.lit(f"a component exceeds {LIMIT} / {scale}")).cast("array<long>")).otherwise(x).alias("x"))


def cluster(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 8,
    rounds: int = 10,
    width: int = 64,
    scale: int = 1024,
    seed: int = 3,
    n_groups: int = 3,
    stats: list | None = None,
) -> DataFrame:
    """One row per kept vector: ``id`` (as text), ``cluster, distance, cluster_inertia, inertia, centroid_sha256``.

    Vectors of another width, null ones, and ones with a null or non-finite component are left out.  The first centroids
    are the k kept vectors with the smallest sha256 of ``seed:id`` (ties: the smaller vector; fewer vectors, fewer
    centroids); null ids count as the empty string there.  Repeated rows count again.  An empty cluster keeps its centroid.
    Components above 131,072 raise an error, since distances could exceed a long.  Further columns are ignored; empty
    input, empty output.  ``k`` bounds what the driver and every task hold: k centroids.  ``stats`` gets the number of
    distances measured in each pass.
    """
    spark = df.sparkSession
    start = materialise(whole_vectors(df, id_col, vector_col, width, scale), "yinyang-vectors")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce("id", F.lit(""))), 256)
    firsts = start.select(order.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    if not firsts:
        return spark.createDataFrame([], "id string, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r.x for r in firsts], dtype=np.int64)
    group = centroid_groups(centroids, n_groups)
    sums = np.zeros((len(centroids), width + 1), dtype=np.int64)
    empty = [F.lit(None).cast(t).alias(n) for n, t in (("cluster", "int"), ("squared", "long"), ("upper", "double"), ("lower", "array<double>"), ("delta", "array<long>"))]
    state, drift = start.select("id", "x", *empty), None

    def run(state: DataFrame, drift, last: bool) -> DataFrame:
        out = materialise(state.where("delta is null").mapInArrow(_pass(centroids, group, drift, last), _SCHEMA), "yinyang-state")
        if stats is not None:
            stats.append(out.where("cluster = -1").agg(F.sum(F.col("delta")[0])).first()[0])
        return out

    for _ in range(rounds):
        older, state = state, run(state, drift, False)
        discard(older if drift is not None else start)
        rows = state.where("delta is not null and cluster >= 0")
        rows = rows.groupBy("cluster").agg(*[F.sum(F.col("delta")[i]).alias(f"s{i}") for i in range(width + 1)])
        for r in rows.collect():
            sums[r[0]] += np.array(r[1:], dtype=np.int64)
        before = centroids
        full = sums[:, 0] > 0
        centroids = np.where(full[:, None], sums[:, 1:] // np.maximum(sums[:, :1], 1), before)
        drift = _up(np.sqrt(_squared(centroids, before).astype(np.float64)))
        if not drift.any():
            break  # the same centroids give the same clusters for ever
    older, state = state, run(state, drift, True)
    discard(older)
    vectors = state.where("delta is null")
    per = vectors.groupBy("cluster").agg(F.sum("squared").alias("cluster_inertia")).collect()
    total = sum(r.cluster_inertia for r in per)
    sha = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    named = spark.createDataFrame([(r.cluster, r.cluster_inertia, total, sha[r.cluster]) for r in per], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return vectors.join(F.broadcast(named), "cluster").select("id", "cluster", F.col("squared").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256")


def op11_yinyang_clusters(spark, sf_dir: str) -> DataFrame:
    d = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return d.select(F.col("id").cast("long").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = 8, rounds: int = 10, width: int = 64) -> str:
    """Plain rounds, unrolled: every vector against every centroid."""
    near = """near{r} as materialized (select id, x, struct_extract(min({{'d': d, 'c': c}}), 'c') as cluster, min(d) as distance from (
  select v.id, v.x, v.seq, m.c, list_sum(list_transform(range(1, {w} + 1), lambda i: (v.x[i] - m.x[i]) * (v.x[i] - m.x[i])))::bigint as d from v, mean{r} m) group by id, x, seq)"""
    mean = """sum{r} as materialized (select cluster, i, sum(x[i])::bigint as s, count(*) as n from near{p}, range(1, {w} + 1) t(i) group by all),
mean{r} as materialized (select m.c, coalesce(n.x, m.x) as x from mean{p} m left join (
  select cluster, list(((s - (((s % n) + n) % n)) // n)::bigint order by i) as x from sum{r} group by cluster) n on n.cluster = m.c)"""
    parts = [
        f"""with v as materialized (select vec_id as id, row_number() over () as seq, list_transform(embedding, lambda e: floor(1024 * e::double)::bigint) as x from embeddings
  where len(embedding) = {width} and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0)""",
        f"mean0 as materialized (select row_number() over (order by sha256('3:' || coalesce(id::varchar, '')), x) - 1 as c, x from v order by 1 limit {k})",
    ]
    for r in range(rounds):
        parts += [near.format(r=r, w=width), mean.format(r=r + 1, p=r, w=width)]
    parts.append(near.format(r=rounds, w=width))
    return (
        ",\n".join(parts)
        + f"""
select id as vec_id, cluster::int as cluster, distance, sum(distance) over (partition by cluster)::bigint as cluster_inertia,
  sum(distance) over ()::bigint as inertia, sha256(array_to_string(m.x, ',')) as centroid_sha256
from near{rounds} join mean{rounds} m on m.c = cluster"""
    )


SQL = _sql()
