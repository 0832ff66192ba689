import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import umap as U


def planted(n=360, groups=4, dim=12, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dim)) * 2
    return centres[np.arange(n) % groups] + rng.standard_normal((n, dim)) * 0.7


def nearest(far, k):
    far = far.copy()
    np.fill_diagonal(far, np.inf)
    return np.argsort(far, axis=1, kind="stable")[:, :k]


def cosine(x):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    return u, 1 - u @ u.T


def trustworthiness(far, y, k):
    n = len(y)
    rank = np.empty((n, n), int)
    order = nearest(far, n - 1)
    rank[np.arange(n)[:, None], order] = np.arange(1, n)
    close = nearest(((y[:, None] - y[None]) ** 2).sum(2), k)
    worse = np.maximum(np.take_along_axis(rank, close, 1) - k, 0).sum()
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * worse


def test_neighbours_against_brute_force(spark):
    u, far = cosine(planted())
    points = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(u)], "node long, v array<double>").repartition(5)
    got = U.neighbours(points, 10).toPandas()
    assert (got.groupby("node").size() == 10).all() and (got["node"] != got["nbr"]).all()
    assert np.allclose(got["d"], far[got["node"], got["nbr"]], atol=1e-9)
    want = nearest(far, 10)
    hit = sum(len(set(want[i]) & set(g["nbr"])) for i, g in got.groupby("node"))
    assert hit / want.size >= 0.9


def test_compared_sends_only_pairs_that_may_enter_a_list():
    """Centres of unequal size at once give what each gives alone; nothing beyond a row's reach is sent."""
    rng = np.random.default_rng(4)
    sizes = [7, 1, 12, 3]
    centre, node = np.repeat(np.arange(4), sizes), rng.permutation(sum(sizes))
    x, _ = cosine(rng.standard_normal((sum(sizes), 6)))
    reach = np.where(np.arange(sum(sizes)) % 2, 0.8, np.inf)
    got = [p for found in U._compared(centre, node, x, reach, 4, block=3) for p in zip(*found)]
    want = set()
    for c in range(4):
        at = np.flatnonzero(centre == c)
        for i in at:
            near = sorted((1 - x[i] @ x[j], node[j], j) for j in at if j != i)[:4]
            want |= {(node[i], b) for d, b, _ in near if d <= reach[i]}
    assert {(a, b) for a, b, _ in got} == want and len(got) == len(want)


def test_layout_does_not_shuffle_edges_twice(spark, monkeypatch):
    """Each round sends one message an edge: nothing but places is joined to it, and the sums need no further exchange."""
    plans = []
    keep = U.materialise

    def seen(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return keep(df, name)

    monkeypatch.setattr(U, "materialise", seen)
    edges = [(a, b, 0.5) for a in range(30) for b in range(30) if a != b]
    start = spark.createDataFrame([(i, float(i % 5), float(i // 5)) for i in range(30)], "node long, y0 double, y1 double")
    got = U.layout(start, spark.createDataFrame(edges, "node long, nbr long, w double"), 2, rounds=1).toPandas()
    assert len(got) == 30 and np.isfinite(got[["y0", "y1"]].to_numpy()).all()
    last = [p for name, p in plans if name == "umap-layout"][-1]
    assert "SortMergeJoin" not in last.split("ShuffledHashJoin")[-1] and last.count("ShuffledHashJoin") == 2
    assert last.count("Exchange hashpartitioning(node") <= 3 and "inline(to" in last


def test_fuzzy_weights(spark):
    graph = [(0, 1, 0.1), (0, 2, 0.3), (0, 3, 0.6), (1, 0, 0.1), (1, 2, 0.2), (1, 3, 0.9), (2, 1, 0.2), (2, 0, 0.3), (2, 3, 0.4), (3, 2, 0.4), (3, 0, 0.6), (3, 1, 0.9)]
    w = U.fuzzy_weights(spark.createDataFrame(graph, "node long, nbr long, d double"), 3).toPandas().set_index(["node", "nbr"])["w"]
    own = {}
    for node in range(4):  # brute force: the scale by a fine search
        d = {b: x for a, b, x in graph if a == node}
        low = min(d.values())
        scale = min(np.linspace(1e-4, 4, 40_000), key=lambda s: abs(sum(np.exp(-(x - low) / s) for x in d.values()) - np.log2(3)))
        own |= {(node, b): np.exp(-(x - low) / scale) for b, x in d.items()}
    for a, b in own:
        assert w[a, b] == pytest.approx(own[a, b] + own[b, a] - own[a, b] * own[b, a], abs=1e-3)
        assert w[a, b] == w[b, a]


def test_curve_has_the_known_values():
    assert U.curve(0.1) == (pytest.approx(1.577, abs=0.02), pytest.approx(0.895, abs=0.01))


def test_layout_keeps_neighbourhoods(spark):
    x = planted()
    rows = [(i, r.tolist()) for i, r in enumerate(x)] + [(900, None), (901, [float("nan")] * 12), (None, x[0].tolist()), (5, x[5].tolist())]
    got = U.embed(spark.createDataFrame(rows, "id long, v array<double>").repartition(4), 2, rounds=20).toPandas()
    assert len(got) == len(rows) and list(got.columns) == ["id", "v", "pc", "keep"]
    assert got[~got["keep"]]["id"].tolist() and set(got[~got["keep"]]["id"]) == {900, 901}
    good = got[got["keep"]]
    y = np.stack(good["pc"].to_numpy())
    assert np.isfinite(y).all()
    _, far = cosine(np.stack(good["v"].to_numpy()))
    assert trustworthiness(far, y, 10) >= 0.9


@pytest.mark.parametrize("vectors", [[], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 3, [[0.0, 0.0], [1.0, 0.0]]])
def test_small_and_equal(spark, vectors):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "id long, v array<double>")
    got = U.embed(df, 2, rounds=2).orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(len(vectors)))
    assert all((r["pc"] is not None) == r["keep"] == (r["v"] is not None) for r in got)
