"""Dimensionality reduction: PCA from partition-wise moments, with a plug-in place for UMAP."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import vectors as V


def _moments(v: str):
    def run(batches):
        n, s, g = 0, 0.0, 0.0
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf[v].to_numpy()).astype(float)
                n, s, g = n + len(x), s + x.sum(0), g + x.T @ x
        if n:
            yield pd.DataFrame({"n": [n], "s": [s.tolist()], "g": [g.ravel().tolist()]})

    return run


def pca(df: DataFrame, k: int, v: str = "v") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, components k x d, share of variance) over valid vectors; the largest loading of a component is positive.

    Each partition sends one d x d sum of products, added up by Spark; the d x d eigenproblem is solved on the driver."""
    ok = df.where(V.is_valid(v)).select(V.as_double(v).alias(v))
    parts = ok.mapInPandas(_moments(v), "n long, s array<double>, g array<double>")
    r = parts.agg(F.sum("n").alias("n"), V.vector_sum("s").alias("s"), V.vector_sum("g").alias("g")).first()
    n, mean = r["n"], np.array(r["s"]) / r["n"]
    d = len(mean)
    cov = (np.array(r["g"]).reshape(d, d) - n * np.outer(mean, mean)) / max(n - 1, 1)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][: min(k, d, max(n - 1, 1))]
    parts = vectors[:, order].T
    parts *= np.sign(parts[np.arange(len(parts)), np.abs(parts).argmax(axis=1)])[:, None]
    return mean, parts, np.maximum(values[order], 0) / max(values.sum(), 1e-300)


def pca_by(df: DataFrame, by: list[str], k: int, v: str = "v") -> DataFrame:
    """A PCA for each group: by, mean, parts (up to k components), share (of variance); signs as in ``pca``.

    Partitions send a d x d sum of products for each group they hold; a group's eigenproblem is solved in one task, whose
    input is one row.  A group has at most as many components as rows less one, and groups of one row have none."""
    kinds = dict(df.dtypes)
    keys = "".join(f"`{b}` {kinds[b]}, " for b in by)

    def moments(batches):
        for pdf in batches:
            for key, g in pdf.groupby(by, sort=False):
                x = np.stack(g[v].to_numpy()).astype(float)
                yield pd.DataFrame([{**dict(zip(by, key)), "_n": len(x), "_s": x.sum(0), "_g": (x.T @ x).ravel()}])

    def solve(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                mean = np.asarray(row["_s"]) / row["_n"]
                d = len(mean)
                cov = (np.asarray(row["_g"]).reshape(d, d) - row["_n"] * np.outer(mean, mean)) / max(row["_n"] - 1, 1)
                values, vectors = np.linalg.eigh(cov)
                order = np.argsort(values)[::-1][: min(k, d, row["_n"] - 1)]
                parts = vectors[:, order].T
                parts = parts * np.sign(parts[np.arange(len(parts)), np.abs(parts).argmax(axis=1)])[:, None]
                share = np.maximum(values[order], 0) / max(values.sum(), 1e-300)
                yield pd.DataFrame([{**{b: row[b] for b in by}, "mean": mean, "parts": list(parts), "share": share}])

    ok = df.where(V.is_valid(v)).select(*by, V.as_double(v).alias(v))
    sums = ok.mapInPandas(moments, keys + "_n long, _s array<double>, _g array<double>").groupBy(*by).agg(
        F.sum("_n").alias("_n"), V.vector_sum("_s").alias("_s"), V.vector_sum("_g").alias("_g")
    )
    return sums.mapInPandas(solve, keys + "mean array<double>, parts array<array<double>>, share array<double>")


def project_by(df: DataFrame, parts: DataFrame, by: list[str], v: str = "v", out: str = "pc") -> DataFrame:
    """Valid vectors of ``df`` with their scores on the components of their group (``pca_by``: one small row per group)."""
    x = V.minus(V.as_double(v), F.col("mean"))
    scored = df.where(V.is_valid(v)).join(parts.select(*by, "mean", "parts"), by).withColumn("_x", x)
    return scored.withColumn(out, F.transform("parts", lambda p: V.dot(F.col("_x"), p))).drop("_x", "mean", "parts")


def project(df: DataFrame, mean: np.ndarray, parts: np.ndarray, v: str = "v", out: str = "pc") -> DataFrame:
    """Adds ``out`` (null for invalid vectors, which stay) and ``keep``; all in expressions."""
    ok = V.is_valid(v)
    x = V.minus(V.as_double(v), F.array(*[F.lit(float(m)) for m in mean]))
    rows = F.array(*[V.dot(F.col("_x"), F.array(*[F.lit(float(w)) for w in p])) for p in parts])
    return df.withColumn("_x", F.when(ok, x)).withColumn(out, F.when(ok, rows)).withColumn("keep", ok).drop("_x")


def reduce(df: DataFrame, method: str = "pca", k: int = 2, v: str = "v", umap=None, fit_rows: int = 20_000, seed: int = 42) -> DataFrame:
    """"pca", or "umap" with ``umap`` = (fit, transform), as none is built in.

    ``fit`` sees a matrix of about ``fit_rows`` rows chosen by hash and returns a model; ``transform`` maps the model and
    a matrix to k columns and runs on every partition."""
    if method == "pca":
        mean, parts, _ = pca(df, k, v)
        return project(df, mean, parts, v)
    if method != "umap":
        raise ValueError(f"unknown method {method!r}: expected 'pca' or 'umap'")
    if umap is None:
        raise NotImplementedError("UMAP is not built in: pass umap=(fit, transform)")
    fit, transform = umap
    ok = df.where(V.is_valid(v))
    share = min(1.0, fit_rows / max(ok.count(), 1))
    sample = ok.where(F.pmod(F.xxhash64(F.lit(seed), F.col(v)), F.lit(1 << 30)) < share * (1 << 30)).select(v).toPandas()
    model = df.sparkSession.sparkContext.broadcast(fit(np.stack(sample[v].to_numpy()).astype(float)))
    kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)

    def run(batches):
        for pdf in batches:
            if len(pdf):
                got = transform(model.value, np.stack(pdf[v].to_numpy()).astype(float))
                yield pdf.assign(pc=[list(map(float, r)) for r in got])

    return ok.mapInPandas(run, f"{kinds}, pc array<double>")
