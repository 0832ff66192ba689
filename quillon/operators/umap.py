"""UMAP under the cosine distance: a neighbour graph by descent, fuzzy weights, and a layout by rounds of forces.

Nothing but samples of a fixed size reaches the driver.  The graph starts from blocks of rows that lie together under the
signs of random projections and is refined by neighbour descent: the neighbours of a row, and a bounded sample of the
rows that have it as neighbour, are compared with each other; only pairs that may enter a row's list leave the task.  In a
round of the layout each row sends its place to its neighbours, one message an edge, and forces are summed where the
messages arrive; repulsion comes from a fresh sample of ``negatives`` points a round.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import vectors as V
from quillon.operators.reduce import pca, project
from quillon.sources.durable import materialise

BLOCK = 128
BITS = 24


def _blocks(k: int):
    """Best k of each row's block of consecutive rows."""

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        return _best_within(pdf["node"].to_numpy(), np.stack(pdf["v"].to_numpy()), k)

    def run(batches):
        held = []
        for pdf in batches:
            held.append(pdf)
            rows = pd.concat(held, ignore_index=True)
            full = len(rows) - len(rows) % BLOCK
            for lo in range(0, full, BLOCK):
                yield best(rows.iloc[lo : lo + BLOCK])
            held = [rows.iloc[full:]]
        rest = pd.concat(held) if held else []
        if len(rest) > 1:
            yield best(rest)

    return run


def _best_within(node: np.ndarray, x: np.ndarray, k: int) -> pd.DataFrame:
    far = 1 - np.clip(x @ x.T, -1, 1)
    far[node[:, None] == node[None, :]] = np.inf
    k = min(k, len(node) - 1)
    at = np.argpartition(far, k - 1, axis=1)[:, :k] if k else np.zeros((len(node), 0), int)
    out = pd.DataFrame({"node": np.repeat(node, k), "nbr": node[at].ravel(), "d": np.take_along_axis(far, at, 1).ravel()})
    return out[np.isfinite(out["d"])]


def _compared(centre: np.ndarray, node: np.ndarray, x: np.ndarray, reach: np.ndarray, k: int, block: int = 256):
    """For whole centres in order: pairs of members, with each row's k nearest of the centre and ties, none beyond its reach."""
    first = np.flatnonzero(np.r_[True, centre[1:] != centre[:-1]])
    size = np.diff(np.r_[first, len(centre)])
    for lo in range(0, len(first), block):
        start, many = first[lo : lo + block, None], size[lo : lo + block, None]
        place = np.arange(many.max())
        live = place < many
        at = np.where(live, start + place, start)
        v = x[at]
        far = 1 - np.clip(v @ v.transpose(0, 2, 1), -1, 1)
        far[~(live[:, :, None] & live[:, None, :])] = np.inf
        far[:, place, place] = np.inf
        kth = np.partition(far, min(k, len(place)) - 1, axis=2)[:, :, min(k, len(place)) - 1]
        c, i, j = np.nonzero(np.isfinite(far) & (far <= np.minimum(kth, reach[at])[:, :, None]))
        yield node[at[c, i]], node[at[c, j]], far[c, i, j]


def _local_join(k: int):
    """For rows sorted by centre: the members of a centre compared with each other, many centres at once."""

    def pairs(rows: pa.Table):
        centre, node, reach = (rows.column(c).to_numpy() for c in ("centre", "node", "reach"))
        x = rows.column("v").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        for found in _compared(centre, node, x, reach, k):
            yield pa.RecordBatch.from_arrays([pa.array(f) for f in found], ["node", "nbr", "d"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            more = pa.Table.from_batches([batch])
            rows = (more if held is None else pa.concat_tables([held, more])).combine_chunks()
            centre = rows.column("centre").to_numpy()
            whole = int(np.flatnonzero(centre == centre[-1])[0])
            held = rows.slice(whole)
            if whole:
                yield from pairs(rows.slice(0, whole))
        if held is not None:
            yield from pairs(held)

    return run


def _nearest(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("node").orderBy("d", "nbr")
    pairs = pairs.groupBy("node", "nbr").agg(F.min("d").alias("d"))
    return pairs.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")


def neighbours(points: DataFrame, k: int = 15, trees: int = 4, rounds: int = 4, seed: int = 42) -> DataFrame:
    """``node, nbr, d``: about the k nearest other rows of each row, by cosine distance.

    ``points`` has distinct ``node`` (long) and ``v`` of length one; a table of one row has no neighbours.  The lists are
    approximate, as the method's: recall against brute force is tested (0.9 at least)."""

    def coded(batches):
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy())
                for t in range(trees):
                    planes = np.random.default_rng(seed + t).standard_normal((x.shape[1], BITS))
                    code = ((x @ planes > 0) << np.arange(BITS)).sum(axis=1)
                    yield pdf.assign(tree=t, code=code)

    kinds = "node long, nbr long, d double"
    dealt = points.select("node", "v").mapInPandas(coded, "node long, v array<double>, tree int, code long")
    dealt = dealt.repartitionByRange("tree", "code", "node").sortWithinPartitions("tree", "code", "node").select("node", "v")
    graph = materialise(_nearest(dealt.mapInPandas(_blocks(k), kinds), k), "umap-graph")
    some = Window.partitionBy("nbr").orderBy(F.xxhash64(F.lit(seed), "node"))
    for _ in range(rounds):
        back = graph.withColumn("_n", F.row_number().over(some)).where(F.col("_n") <= k)
        lists = graph.select(F.col("node").alias("centre"), F.col("nbr").alias("node"))
        lists = lists.union(back.select(F.col("nbr").alias("centre"), "node")).union(points.select(F.col("node").alias("centre"), "node")).distinct()
        # A pair farther than the last of a full list can't enter it, so it isn't sent.
        reach = graph.groupBy("node").agg(F.when(F.count(F.lit(1)) >= k, F.max("d")).alias("reach"))
        known = points.select("node", "v").join(reach, "node", "left").fillna(float("inf"), ["reach"])
        members = lists.join(known, "node").repartition("centre").sortWithinPartitions("centre")
        found = members.select("centre", "node", "reach", "v").mapInArrow(_local_join(k), kinds)
        graph = materialise(_nearest(graph.union(found), k), "umap-graph")
    return graph


def fuzzy_weights(graph: DataFrame, k: int = 15) -> DataFrame:
    """``node, nbr, w`` in both directions: the fuzzy union of each row's own weights exp(-(d - nearest) / scale).

    A row's scale makes its weights sum to log2 of its number of neighbours, found by bisection."""

    def own(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            size = pdf["near"].map(len).to_numpy()
            d = np.full((len(pdf), size.max()), np.inf)
            for i, near in enumerate(pdf["near"]):  # at most k entries a row
                d[i, : size[i]] = [r["d"] for r in near]
            above = np.maximum(d - d[:, :1], 0)
            want, lo, hi = np.log2(np.maximum(size, 2)), np.full(len(d), 1e-12), np.full(len(d), 4.0)
            for _ in range(60):
                mid = (lo + hi) / 2
                over = np.exp(-above / mid[:, None]).sum(axis=1) > want
                lo, hi = np.where(over, lo, mid), np.where(over, mid, hi)
            w = np.exp(-above / hi[:, None])
            yield pd.DataFrame({
                "node": np.repeat(pdf["node"].to_numpy(), size),
                "nbr": [r["nbr"] for near in pdf["near"] for r in near],
                "w": w[np.isfinite(d)],
            })

    near = graph.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("d", "nbr"))).alias("near"))
    w = near.mapInPandas(own, "node long, nbr long, w double")
    both = w.union(w.select(F.col("nbr").alias("node"), F.col("node").alias("nbr"), "w"))
    # Each pair comes once or twice a direction; one that comes once has a weight of zero on the other side.
    pair = both.groupBy("node", "nbr").agg(F.sum("w").alias("s"), F.when(F.count("w") > 1, F.min("w") * F.max("w")).otherwise(0.0).alias("p"))
    return pair.select("node", "nbr", (F.col("s") - F.col("p")).alias("w"))


def curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """(a, b) of 1 / (1 + a x^(2b)), fitted by Gauss-Newton steps to 1 up to ``min_dist`` and exp(-(x - min_dist) / spread) beyond."""
    x = np.linspace(0, 3 * spread, 301)[1:]
    y = np.where(x <= min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    at = np.array([1.0, 1.0])
    for _ in range(200):
        power = x ** (2 * at[1])
        f = 1 / (1 + at[0] * power)
        slope = np.stack([-(f**2) * power, -(f**2) * at[0] * power * 2 * np.log(x)], axis=1)
        at = np.maximum(at + 0.5 * np.linalg.lstsq(slope, y - f, rcond=None)[0], 1e-3)
    return float(at[0]), float(at[1])


def layout(start: DataFrame, edges: DataFrame, k: int, rounds: int = 30, negatives: int = 256, rate: float = 5.0, min_dist: float = 0.1, seed: int = 42) -> DataFrame:
    """``node, y0, y1, ...`` after ``rounds`` steps from ``start`` under the forces of ``edges`` (node, nbr, w; both directions)."""
    a, b = curve(min_dist)
    ys = [f"y{i}" for i in range(k)]
    # A row tells all its neighbours where it is, so a round shuffles one message an edge.
    sends = edges.groupBy("nbr").agg(F.collect_list(F.struct("node", "w")).alias("to"), F.sum("w").alias("total"))
    sends = materialise(sends, "umap-edges")
    pulls = sends.select(F.col("nbr").alias("node"), "total")
    sends = sends.drop("total")
    at = materialise(start.join(pulls, "node", "left").select("node", F.coalesce("total", F.lit(0.0)).alias("total"), *ys), "umap-layout")
    n = at.count()
    kinds = at.schema
    for step in range(rounds):
        share = min(1.0, negatives / max(n, 1))
        drawn = F.pmod(F.xxhash64(F.lit(seed + step), "node"), F.lit(1 << 30)) < share * (1 << 30)
        sample = at.where(drawn).select("node", *ys).toPandas()  # about ``negatives`` rows
        others, ids, lr = sample[ys].to_numpy(), sample["node"].to_numpy(), 1.0 - step / rounds
        tail = at.select(F.col("node").alias("nbr"), *[F.col(y).alias(f"t{i}") for i, y in enumerate(ys)])
        told = sends.join(tail.hint("shuffle_hash"), "nbr").select(*[f"t{i}" for i in range(k)], F.inline("to"))
        ends = told.join(at.drop("total").hint("shuffle_hash"), "node")
        gaps = [F.col(y) - F.col(f"t{i}") for i, y in enumerate(ys)]
        d2 = sum((g * g for g in gaps), F.lit(0.0))
        pull = F.when(d2 > 0, -2 * a * b * F.pow(d2, b - 1) / (1 + a * F.pow(d2, b))).otherwise(0.0)
        force = [F.sum(F.col("w") * F.greatest(F.least(pull * g, F.lit(4.0)), F.lit(-4.0))).alias(f"f{i}") for i, g in enumerate(gaps)]
        forces = ends.groupBy("node").agg(*force)

        def move(batches, others=others, ids=ids, lr=lr):
            for pdf in batches:
                if not len(pdf):
                    continue
                y, total = pdf[ys].to_numpy(), pdf["total"].to_numpy()
                gap = y[:, None, :] - others[None, :, :]
                far = (gap**2).sum(axis=2)
                push = 2 * b / ((0.001 + far) * (1 + a * far**b))
                push[pdf["node"].to_numpy()[:, None] == ids[None, :]] = 0
                away = np.clip(push[:, :, None] * gap, -4, 4).mean(axis=1) if len(others) else 0.0
                step = pdf[[f"f{i}" for i in range(k)]].to_numpy() + rate * total[:, None] * away
                new = y + lr * np.clip(step, -4, 4)
                yield pd.DataFrame({"node": pdf["node"], "total": total, **{c: new[:, i] for i, c in enumerate(ys)}})

        moved = at.join(forces, "node", "left").fillna(0.0, [f"f{i}" for i in range(k)])
        at = materialise(moved.mapInPandas(move, kinds), "umap-layout")
    return at.select("node", *ys)


def embed(df: DataFrame, k: int = 2, v: str = "v", n_neighbors: int = 15, rounds: int = 30, seed: int = 42) -> DataFrame:
    """``df`` with ``pc`` (k coordinates, null for invalid vectors, whose rows stay) and ``keep``.

    Rows are told apart by a number of their own, so repeated and null ids do no harm; equal vectors are neighbours at
    distance 0; vectors of zeros have distance 1 to all others.  An empty table gives an empty result, a single valid row
    stays at the origin.  ``df`` must not have columns ``_node``, ``pc`` or ``keep``."""
    rows = materialise(df.withColumn("_node", F.monotonically_increasing_id()), "umap-rows")
    ok = rows.where(V.is_valid(v)).select(F.col("_node").alias("node"), V.as_double(v).alias("v"))
    ys = [f"y{i}" for i in range(k)]
    points = materialise(ok.select("node", V.unit(F.col("v")).alias("v")), "umap-points")
    if points.limit(2).count() < 2:
        at = points.select("node", *[F.lit(0.0).alias(y) for y in ys])
    else:
        mean, parts, _ = pca(points, k, "v")
        start = project(points, mean, parts, "v")
        start = start.select("node", *[F.coalesce(F.get("pc", F.lit(i)), F.lit(0.0)).alias(y) for i, y in enumerate(ys)])
        top = start.agg(*[F.max(F.abs(y)).alias(y) for y in ys]).first()
        scale = 10.0 / max(max(top), 1e-12)
        start = start.select("node", *[(F.col(y) * scale).alias(y) for y in ys])
        graph = neighbours(points, n_neighbors, seed=seed)
        at = layout(start, fuzzy_weights(graph, n_neighbors), k, rounds, seed=seed)
    at = at.select(F.col("node").alias("_node"), F.array(*ys).alias("pc"))
    return rows.join(at, "_node", "left").withColumn("keep", F.col("pc").isNotNull()).drop("_node")
