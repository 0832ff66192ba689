"""Linear mixed models whose covariates vary within units, from moment matrices of each unit.

One aggregation over the tokens leaves n, y'y, X'y and X'X for each unit; the random part Z is some of X's columns, so Z'Z,
Z'X and Z'y are parts of these.  With V = s2 (I + Z D Z') every unit adds to X'V^-1 X, X'V^-1 y, y'V^-1 y and log |V| terms
that need its moments only, so a likelihood is a sum over units.  V^-1 depends on a unit by its Z'Z alone, and the rest of a
term is a product of two of its moments; so units of the same Z'Z are put together once, by sums of these products, without
loss.  Z'Z holds numbers of tokens, so of N tokens there are at most about sqrt(2 N) kinds where Z is constant inside units,
however many units there are.  Each pass over the table of kinds sums the terms for a whole grid of covariances D at once,
for all groups and models; grids close in on the best point.  The driver sees sums by grid point, never units.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import vectors as V
from quillon.functions.special import normal_two_sided
from quillon.sources.durable import materialise

#: A term is a column, or several of them joined by colons; the random part names columns that are in X.
POOLED = {
    "M0": ((), ("Intercept",)),
    "M1": (("L1", "Gender"), ("Intercept",)),
    "M2": (("L1", "Gender", "L1:Gender"), ("Intercept",)),
    "M3": (("L1", "Gender", "L1:Gender", "vowel_height"), ("Intercept",)),
    "M4": (("L1", "Gender", "L1:Gender"), ("Intercept", "L1")),
}


def treatment(df: DataFrame, factors: tuple[str, ...], terms: tuple[str, ...]) -> dict[str, list[tuple[str, Column]]]:
    """For each term its 0/1 columns and their names, such as L1[T.ru]; the first level in order is the reference.

    Levels are labels, few by nature; one small aggregation finds them."""
    levels = df.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in factors]).first()
    single = {c: [(f"{c}[T.{v}]", (F.col(c) == F.lit(v)).cast("double")) for v in levels[c][1:]] for c in factors}
    out = {"Intercept": [("Intercept", F.lit(1.0))]}
    for term in terms:
        combos = [("", F.lit(1.0))]
        for c in term.split(":"):
            combos = [(f"{a}:{b}" if a else b, x * y) for a, x in combos for b, y in single[c]]
        out[term] = combos
    return out


def unit_moments(df: DataFrame, y: str, x: list[Column], by: list[str], unit: str) -> DataFrame:
    """by, unit, ``n, yy, xy`` (array) and ``xx`` (the upper triangle by rows, array): one row per unit."""
    p = len(x)
    d = df.select(*by, unit, F.col(y).cast("double").alias("_y"), *[c.alias(f"_x{i}") for i, c in enumerate(x)])
    xs = [F.col(f"_x{i}") for i in range(p)]
    return d.groupBy(*by, unit).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("_y") * F.col("_y")).alias("yy"),
        F.array(*[F.sum(c * F.col("_y")) for c in xs]).alias("xy"),
        F.array(*[F.sum(xs[i] * xs[j]) for i in range(p) for j in range(i, p)]).alias("xx"),
    )


def covariance(theta: np.ndarray, q: int) -> np.ndarray:
    """Cholesky factors L of D for rows of theta: log standard deviations, then atanh of the correlation if q is 2.

    A logarithm below -15 stands for no variance."""
    theta = np.atleast_2d(theta)
    sd = np.where(theta[:, :q] < -15, 0.0, np.exp(theta[:, :q]))
    out = np.zeros((len(theta), q, q))
    out[:, 0, 0] = sd[:, 0]
    if q == 2:
        rho = np.tanh(theta[:, 2])
        out[:, 1, 0], out[:, 1, 1] = sd[:, 1] * rho, sd[:, 1] * np.sqrt(1 - rho**2)
    return out


def cells(df: DataFrame, y: str, by: list[str], unit: str, factors: tuple[str, ...]) -> DataFrame:
    """by, unit, factors, ``n, sy, syy``: the one aggregation over tokens."""
    v = F.col(y).cast("double")
    return df.groupBy(*dict.fromkeys([*by, unit, *factors])).agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("sy"), F.sum(v * v).alias("syy"))


def cell_moments(df: DataFrame, x: list[Column], by: list[str], unit: str) -> DataFrame:
    """The result of ``unit_moments``, from cells in which the columns x are constant."""
    p = len(x)
    d = df.select(*by, unit, "n", "sy", "syy", *[c.alias(f"_x{i}") for i, c in enumerate(x)])
    xs = [F.col(f"_x{i}") for i in range(p)]
    return d.groupBy(*by, unit).agg(
        F.sum("n").alias("n"), F.sum("syy").alias("yy"), F.array(*[F.sum(c * F.col("sy")) for c in xs]).alias("xy"),
        F.array(*[F.sum(xs[i] * xs[j] * F.col("n")) for i in range(p) for j in range(i, p)]).alias("xx"),
    )


def unit_kinds(units: DataFrame, by: list[str], p: int, z: list[int]) -> DataFrame:
    """Units of one Z'Z put together: by, its upper triangle ``zz``, ``u, n, yy, xy, xx`` (number of units and sums),
    ``ww``, the upper triangle of the summed products of [Z'X, Z'y] with itself (rows of Z after one another), and
    ``inside``, for each column of X in how many units it varies, for 0/1 columns."""
    upper = [(i, j) for i in range(p) for j in range(i, p)]
    xx = {k: f"_xx{at}" for at, k in enumerate(upper)}
    d = units.select(
        *by, "n", "yy", *[F.element_at("xy", i + 1).alias(f"_xy{i}") for i in range(p)],
        *[F.element_at("xx", at + 1).alias(name) for at, name in enumerate(xx.values())],
    )
    zz = [xx[min(a, b), max(a, b)] for at, a in enumerate(z) for b in z[at:]]
    w = [F.col(c) for a in z for c in [*[xx[min(a, j), max(a, j)] for j in range(p)], f"_xy{a}"]]
    square = [F.col(xx[i, i]) for i in range(p)]
    return d.groupBy(*by, *[F.col(c).alias(f"_zz{i}") for i, c in enumerate(zz)]).agg(
        F.count(F.lit(1)).alias("u"), F.sum("n").alias("n"), F.sum("yy").alias("yy"), F.array(*[F.sum(f"_xy{i}") for i in range(p)]).alias("xy"),
        F.array(*[F.sum(c) for c in xx.values()]).alias("xx"),
        F.array(*[F.sum(w[i] * w[j]) for i in range(len(w)) for j in range(i, len(w))]).alias("ww"),
        F.array(*[F.sum(((s != 0) & (s != F.col("n"))).cast("double")) for s in square]).alias("inside"),
    ).select(*by, F.array(*[f"_zz{i}" for i in range(len(zz))]).alias("zz"), "u", "n", "yy", "xy", "xx", "ww", "inside")


def full(upper: np.ndarray, p: int) -> np.ndarray:
    """Symmetric matrices from rows of upper triangles."""
    at = np.triu_indices(p)
    out = np.zeros((len(upper), p, p))
    out[:, at[0], at[1]] = upper
    out[:, at[1], at[0]] = upper
    return out


def partial_sums(u, yy, xy, xx, zz, ww, factors: np.ndarray, block: int = 32) -> np.ndarray:
    """Rows, one for each L: X'V^-1 X, X'V^-1 y, y'V^-1 y (all for s2 = 1) and log |V| - n log s2, summed over kinds of units.

    ``ww`` has the shape (kinds, q, p + 1, q, p + 1)."""
    p, q = xx.shape[1], zz.shape[1]
    out = np.empty((len(factors), p * p + p + 2))
    products = ww.transpose(0, 1, 3, 2, 4).reshape(-1, (p + 1) ** 2)
    for lo in range(0, len(factors), block):
        low = factors[lo : lo + block, None]
        turned = np.swapaxes(low, 2, 3)
        inner = np.eye(q) + turned @ zz @ low
        # V^-1 = I - Z L (I + L'Z'ZL)^-1 L'Z'
        a = low @ np.linalg.solve(inner, np.broadcast_to(turned, inner.shape))
        less = (a.reshape(len(a), -1) @ products).reshape(-1, p + 1, p + 1)
        to = out[lo : lo + block]
        to[:, : p * p] = (xx.sum(0) - less[:, :p, :p]).reshape(len(a), -1)
        to[:, p * p : -2] = xy.sum(0) - less[:, :p, p]
        to[:, -2] = yy.sum() - less[:, p, p]
        to[:, -1] = np.linalg.slogdet(inner)[1] @ u
    return out


def profiled(row: np.ndarray, p: int, keep: list[int], total: float, reml: bool) -> dict:
    """Log likelihood, coefficients and s2 at one D, from its sums."""
    xtx, xty = row[: p * p].reshape(p, p)[np.ix_(keep, keep)], row[p * p : -2][keep]
    beta = np.linalg.solve(xtx, xty)
    free = total - len(keep) if reml else total
    s2 = max((row[-2] - beta @ xty) / free, 1e-300)
    ll = -0.5 * (free * math.log(2 * math.pi * s2) + row[-1] + free)
    if reml:
        ll -= 0.5 * np.linalg.slogdet(xtx)[1]
    return {"loglik": float(ll), "beta": beta, "s2": s2, "cov": np.linalg.inv(xtx) * s2}


@dataclass
class Fit:
    """A model of one group while its grids close in."""

    key: tuple
    name: str
    reml: bool
    keep: list[int]
    z: list[int]
    centre: np.ndarray = field(default=None)
    half: np.ndarray = field(default=None)
    best: dict = field(default=None)
    at: np.ndarray = field(default=None)

    def grid(self) -> np.ndarray:
        q = len(self.z)
        if self.centre is None:
            self.centre, self.half = (np.array([-2.0]), np.array([6.0])) if q == 1 else (np.array([-2.0, -2.0, 0.0]), np.array([6.0, 6.0, 2.4]))
            none = np.array([[-20.0] * q + [0.0] * (q == 2)])
        else:
            none = np.zeros((0, len(self.centre)))
        steps = 33 if q == 1 else 9
        axes = [np.linspace(c - h, c + h, steps if i < q else 7) for i, (c, h) in enumerate(zip(self.centre, self.half))]
        return np.vstack([none, np.stack([g.ravel() for g in np.meshgrid(*axes, indexing="ij")], axis=1)])

    def take(self, grid: np.ndarray, rows: np.ndarray, p: int, total: float) -> None:
        for theta, row in zip(grid, rows):
            got = profiled(row, p, self.keep, total, self.reml)
            if self.best is None or got["loglik"] > self.best["loglik"] + 1e-10:
                self.best, self.at = got, theta
        # Two steps of the grid on each side; from no variance, the whole range stays open.
        self.centre = np.where(self.at < -15, self.centre, self.at)
        self.half = self.half * (2 / 16 if len(self.z) == 1 else 0.3)


def independent(gram: np.ndarray, columns: list[int]) -> list[int]:
    """The columns that add something to those before them, by the Gram matrix of all."""
    keep: list[int] = []
    for c in columns:
        at = [*keep, c]
        scale = np.sqrt(np.maximum(np.diag(gram)[at], 1e-300))
        if gram[c, c] > 0 and np.linalg.matrix_rank(gram[np.ix_(at, at)] / np.outer(scale, scale), tol=1e-9) == len(at):
            keep.append(c)
    return keep


def _evaluate(kinds: DataFrame, by: list[str], p: int, z: list[int], jobs: dict[tuple, list[tuple[int, list[int], np.ndarray]]]) -> dict:
    """Sums over units for every (group, job, grid point): one pass over the kinds of units."""
    q = len(z)

    def run(batches):
        for pdf in batches:
            for key, g in pdf.groupby(by, sort=False, dropna=False) if by else [((), pdf)]:
                key = key if isinstance(key, tuple) else (key,)
                if key not in jobs or not len(g):
                    continue
                u, yy, xy = g["u"].to_numpy(float), g["yy"].to_numpy(float), np.stack(g["xy"].to_numpy())
                xx, zz = full(np.stack(g["xx"].to_numpy()), p), full(np.stack(g["zz"].to_numpy()), q)
                ww = full(np.stack(g["ww"].to_numpy()), q * (p + 1)).reshape(-1, q, p + 1, q, p + 1)
                for job, some, grid in jobs[key]:
                    at = [z.index(i) for i in some]
                    sums = partial_sums(u, yy, xy, xx, zz[:, at][:, :, at], ww[:, at][:, :, :, at], covariance(grid, len(at)))
                    yield pd.DataFrame({"job": job, "point": range(len(grid)), "sums": list(sums)})

    rows = kinds.select(*by, "u", "yy", "xy", "xx", "zz", "ww").mapInPandas(run, "job int, point int, sums array<double>")
    out: dict = {}
    for r in rows.groupBy("job", "point").agg(V.vector_sum("sums").alias("sums")).collect():
        out.setdefault(r.job, {})[r.point] = np.array(r.sums)
    return {job: np.stack([x[i] for i in range(len(x))]) for job, x in out.items()}


_OUT = (
    "model string, reml boolean, term string, coef double, se double, pval double, aic double, bic double, loglik double, icc double, r2_marginal double, "
    "r2_conditional double, var_u double, var_slope double, cov_slope double, var_e double, n_params int, n_tokens long, n_units long, status string"
)


def mixed_models(
    df: DataFrame, y: str, by: list[str], models: dict = POOLED, factors: tuple[str, ...] = ("L1", "Gender", "vowel_height"), unit: str = "spk",
    reml: tuple[str, ...] = ("M0",), min_units: int = 3, min_tokens: int = 10, passes: int = 12,
) -> DataFrame:
    """Every model by group in long form, one row per term: by maximum likelihood, those named in ``reml`` by REML as well.

    Rows with a null among value, unit and factors are left out, as are groups of fewer than ``min_units`` units or
    ``min_tokens`` rows; columns that add nothing in a group (a factor of one level there) have no term.  Groups are
    labels: each has a few sums on the driver.  ``status`` is "boundary" where no variance between units is left, and
    "slope_not_separate" where the slope's column is constant within units, so that only a combination of the three
    covariances is determined; "ok" otherwise."""
    parts = cells(df.dropna(subset=[y, unit, *factors]), y, by, unit, factors)
    return mixed_models_of_cells(parts, by, models, factors, unit, reml, min_units, min_tokens, passes)


def mixed_models_of_cells(
    df: DataFrame, by: list[str], models: dict = POOLED, factors: tuple[str, ...] = ("L1", "Gender", "vowel_height"), unit: str = "spk",
    reml: tuple[str, ...] = ("M0",), min_units: int = 3, min_tokens: int = 10, passes: int = 12,
) -> DataFrame:
    """``mixed_models`` of tokens that are added up already: by, unit, factors, ``n, sy, syy``, any number of rows a cell."""
    spark = df.sparkSession
    keys = [*dict.fromkeys([*by, unit, *factors])]
    d = df.dropna(subset=["sy", unit, *factors]).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "sy", "syy")])
    terms = list(dict.fromkeys(t for fixed, _ in models.values() for t in fixed))
    parts = materialise(d, "mixed-cells")
    columns = treatment(parts, factors, tuple(terms))
    names = [n for t in columns.values() for n, _ in t]
    place = {t: [names.index(n) for n, _ in columns[t]] for t in columns}
    p = len(names)
    random = sorted({i for _, z in models.values() for t in z for i in place[t]})
    units = cell_moments(parts, [c for t in columns.values() for _, c in t], by, unit)
    kinds = materialise(unit_kinds(units, by, p, random), "unit-kinds")
    schema = ", ".join([*[f"`{b}` {dict(d.dtypes)[b]}" for b in by], _OUT])
    if kinds.isEmpty():
        return spark.createDataFrame([], schema)
    sums = kinds.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("u").alias("u"), V.vector_sum("xx").alias("xx"), V.vector_sum("inside").alias("inside")
    )
    totals, fits = {}, []
    for r in sums.where((F.col("u") >= min_units) & (F.col("n") >= min_tokens)).collect():
        key = tuple(r[b] for b in by)
        gram = np.zeros((p, p))
        gram[np.triu_indices(p)] = r.xx
        gram = np.maximum(gram, gram.T)
        totals[key] = (r.n, r.u, gram, r.inside)
        for name, (fixed, slopes) in models.items():
            keep = independent(gram, [0, *[i for t in fixed for i in place[t]]])
            z = [i for t in slopes for i in place[t] if gram[i, i] > 0][:2]
            fits += [Fit(key, name, m, keep, z) for m in ((True, False) if name in reml else (False,))]
    for step in range(passes):
        todo = [(i, f, f.grid()) for i, f in enumerate(fits) if step == 0 or len(f.z) > 1 or step < 7]
        jobs: dict = {}
        for i, f, grid in todo:
            jobs.setdefault(f.key, []).append((i, f.z, grid))
        got = _evaluate(kinds, by, p, random, jobs) if jobs else {}
        for i, f, grid in todo:
            f.take(grid, got[i], p, float(totals[f.key][0]))
    rows = []
    for f in fits:
        n, u, gram, inside = totals[f.key]
        low = covariance(f.at, len(f.z))[0]
        cov = low @ low.T * f.best["s2"]
        beta, se = f.best["beta"].tolist(), np.sqrt(np.diag(f.best["cov"])).tolist()
        g = gram[np.ix_(f.keep, f.keep)]
        mean = gram[0, f.keep] / n
        b = f.best["beta"]
        fixed = float((b @ g @ b - n * (mean @ b) ** 2) / max(n - 1, 1))
        var_u, s2 = float(cov[0, 0]), float(f.best["s2"])
        k = len(f.keep) + len(f.z) * (len(f.z) + 1) // 2 + 1
        status = "boundary" if cov[0, 0] == 0 else "slope_not_separate" if len(f.z) > 1 and not inside[f.z[1]] else "ok"
        for i, b, s in zip(f.keep, beta, se):
            rows.append((
                *f.key, f.name, f.reml, names[i], b, s, normal_two_sided(b / s) if s > 0 else None,
                None if f.reml else 2 * k - 2 * f.best["loglik"], None if f.reml else k * math.log(n) - 2 * f.best["loglik"], float(f.best["loglik"]),
                var_u / (var_u + s2), fixed / (fixed + var_u + s2), (fixed + var_u) / (fixed + var_u + s2),
                var_u, float(cov[1, 1]) if len(f.z) > 1 else None, float(cov[0, 1]) if len(f.z) > 1 else None, s2, k, n, u, status,
            ))
    return spark.createDataFrame(rows, schema)
