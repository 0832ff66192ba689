"""Linear mixed models with a random intercept by unit, from sufficient statistics of each unit.

Covariates are constant within a unit, so a unit is known by n, sum(y) and sum(y^2): one aggregation over the tokens,
after which units of equal n and covariates are put together, by the sums of sum(y), sum(y^2) and sum(y)^2, which is all
that the likelihood needs of them.  Of N tokens there are at most about sqrt(2 N) such kinds for each cell of the covariates,
however many units there are.  With V = s2 (I + r J) the likelihood is profiled over r, r = 0 included.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quillon.functions.special import chi2_upper, normal_two_sided
from statistics import NormalDist


def unit_stats(df: DataFrame, value: str, by: list[str], unit: str = "spk", carry: tuple[str, ...] = ("L1", "Gender")) -> DataFrame:
    """by, unit, ``n, sy, syy`` and the smallest value of each column in ``carry``.

    Smallest labels are found among the cells of a unit: an aggregate of strings would sort all tokens of a task, while
    numbers alone are added up by hash."""
    return unit_stats_by_column(df, {"": value}, by, "_column", unit, carry).drop("_column")


def unit_stats_by_column(
    df: DataFrame, values: dict[str, str], by: list[str], name: str, unit: str = "spk", carry: tuple[str, ...] = ("L1", "Gender")
) -> DataFrame:
    """``unit_stats`` of several columns, told apart by ``name``: tokens are aggregated as they are, one row becomes several
    after that only."""
    x = {k: F.col(c) for k, c in values.items()}
    sums = [F.struct(F.lit(k).alias(name), F.count(c).alias("n"), F.sum(c).alias("sy"), F.sum(c**2).alias("syy")) for k, c in x.items()]
    cells = df.where(F.col(unit).isNotNull()).groupBy(*by, unit, *carry).agg(F.array(*sums).alias("_each"))
    return unit_totals(cells.select(*by, unit, *carry, F.inline("_each")).where("n > 0"), [*by, name], unit, carry)


def unit_totals(cells: DataFrame, by: list[str], unit: str = "spk", carry: tuple[str, ...] = ("L1", "Gender")) -> DataFrame:
    """``unit_stats`` from cells (by, unit, carry, ``n, sy, syy``) whose values are counted already."""
    return cells.groupBy(*by, unit).agg(F.sum("n").alias("n"), F.sum("sy").alias("sy"), F.sum("syy").alias("syy"), *[F.min(c).alias(c) for c in carry])


def unit_kinds(stats: DataFrame, by: list[str], carry: tuple[str, ...] = ("L1", "Gender")) -> DataFrame:
    """Units of equal n and covariates put together: by, carry, n, ``u`` (their number), ``sy, syy`` (sums) and ``sy2``, the
    sum of the squares of the units' sums."""
    return stats.groupBy(*by, *carry, "n").agg(
        F.count(F.lit(1)).alias("u"), F.sum("sy").alias("sy"), F.sum("syy").alias("syy"), F.sum(F.col("sy") * F.col("sy")).alias("sy2")
    )


def profile(r, n: np.ndarray, sy: np.ndarray, syy: np.ndarray, x: np.ndarray, reml: bool, u=1.0, sy2=None):
    """(log likelihood, beta, s2, inverse of X'V^-1 X / s2) at variance ratio r, a number or one per row.

    A row stands for ``u`` units of n tokens each, with the sum ``sy2`` of their squared sums; by default for one unit."""
    sy2 = sy**2 if sy2 is None else sy2
    u = np.broadcast_to(u, n.shape)
    d = 1 + n * r
    xtx = (x * (u * n / d)[:, None]).T @ x
    xty = x.T @ (sy / d)
    beta = np.linalg.solve(xtx, xty)
    rss = float((syy - r / d * sy2).sum() - beta @ xty)
    total, p = float((u * n).sum()), x.shape[1]
    free = total - p if reml else total
    s2 = max(rss / free, 1e-300)
    out = -0.5 * (free * math.log(2 * math.pi * s2) + float((u * np.log(d)).sum()) + free)
    if reml:
        out -= 0.5 * np.linalg.slogdet(xtx)[1]
    return out, beta, s2, np.linalg.inv(xtx)


def _golden(f, lo: float, hi: float, steps: int = 80) -> float:
    g = (math.sqrt(5) - 1) / 2
    a, b = hi - g * (hi - lo), lo + g * (hi - lo)
    fa, fb = f(a), f(b)
    for _ in range(steps):
        if fa < fb:
            lo, a, fa = a, b, fb
            b = lo + g * (hi - lo)
            fb = f(b)
        else:
            hi, b, fb = b, a, fa
            a = hi - g * (hi - lo)
            fa = f(a)
    return (lo + hi) / 2


def fit(n, sy, syy, x, reml: bool = True, slope: np.ndarray | None = None, u=None, sy2=None) -> dict:
    """Fit one model to units, or to kinds of ``u`` units each (see ``profile``); ``slope`` (0/1 by row) lets the intercept variance differ between its two groups, which is all a
    random slope of a covariate that is constant within units can say."""
    n, sy, syy, x = (np.asarray(v, float) for v in (n, sy, syy, x))
    u = np.ones(len(n)) if u is None else np.asarray(u, float)
    sy2 = sy**2 if sy2 is None else np.asarray(sy2, float)
    # Centre the response: sums of squares lose less.
    total = float((u * n).sum())
    mid = sy.sum() / total
    sy2 = np.maximum(sy2 - 2 * mid * n * sy + u * (n * mid) ** 2, 0)
    syy, sy = syy - 2 * mid * sy + u * n * mid**2, sy - u * n * mid
    one = lambda r: profile(r, n, sy, syy, x, reml, u, sy2)[0]
    if slope is None:
        t = _golden(lambda t: one(math.exp(t)), -16, 12)
        r = math.exp(t) if one(math.exp(t)) > one(0.0) + 1e-12 else 0.0
        parts, k = np.full(len(n), r), 1
    else:
        s, a, b, k = np.asarray(slope, float), 0.1, 0.1, 3
        each = lambda a, b: np.where(s == 0, a, b)
        for _ in range(12):
            a = math.exp(_golden(lambda t: one(each(math.exp(t), b)), -16, 12, 50))
            b = math.exp(_golden(lambda t: one(each(a, math.exp(t))), -16, 12, 50))
        parts = each(a, b)
        r = float((u * parts).sum() / u.sum())
    ll, beta, s2, inv = profile(parts, n, sy, syy, x, reml, u, sy2)
    beta = beta.copy()
    beta[0] += mid
    se = np.sqrt(np.diag(inv) * s2)
    fixed = x @ beta
    all_n = u * n
    var_fixed = float((all_n * (fixed - (all_n * fixed).sum() / total) ** 2).sum() / max(total - 1, 1))
    var_u = r * s2
    params = x.shape[1] + k + 1
    return {
        "loglik": ll, "var_u": var_u, "var_e": s2, "icc": var_u / (var_u + s2), "beta": beta, "se": se,
        "r2_marginal": var_fixed / (var_fixed + var_u + s2), "r2_conditional": (var_fixed + var_u) / (var_fixed + var_u + s2),
        "aic": None if reml else 2 * params - 2 * ll, "bic": None if reml else params * math.log(total) - 2 * ll, "params": params,
        "status": "boundary" if r == 0 else ("slope_not_separate" if slope is not None else "ok"),
    }


def design(pdf: pd.DataFrame, terms: tuple[str, ...]) -> tuple[np.ndarray, list[str]]:
    """Treatment coding, first level in order as reference: columns and names such as L1[T.ru] and L1[T.ru]:Gender[T.m]."""
    cols, names = [np.ones(len(pdf))], ["Intercept"]
    for term in terms:
        parts = [[(f"{c}[T.{v}]", (pdf[c] == v).to_numpy(float)) for v in sorted(pdf[c].dropna().unique())[1:]] for c in term.split(":")]
        combos = [("", np.ones(len(pdf)))]
        for part in parts:
            combos = [(f"{a}:{b}" if a else b, x * y) for a, x in combos for b, y in part]
        for name, col in combos:
            cols.append(col)
            names.append(name)
    x = np.column_stack(cols)
    keep = [0]  # drop columns that add nothing, such as an interaction without its cell
    for i in range(1, x.shape[1]):
        if np.linalg.matrix_rank(x[:, [*keep, i]]) > len(keep):
            keep.append(i)
    return x[:, keep], [names[i] for i in keep]


MODELS = {"M0": (), "M1": ("L1", "Gender"), "M2": ("L1", "Gender", "L1:Gender"), "M4": ("L1", "Gender")}
_OUT = (
    "model string, reml boolean, term string, coef double, se double, pval double, aic double, bic double, loglik double, "
    "icc double, r2_marginal double, r2_conditional double, var_u double, var_e double, n_params int, status string"
)


def ladder(stats: DataFrame, by: list[str], min_units: int = 3, min_tokens: int = 10, models: tuple[str, ...] = ("M0", "M1", "M2", "M4")) -> DataFrame:
    """All models by group in long form, one row per term, REML and ML; groups that are too small are left out.

    A group is the table of its kinds of units (see ``unit_kinds``), few whatever the number of units is."""
    kinds = dict(stats.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, key = [], list(pdf[by].iloc[0])
        if pdf["u"].sum() >= min_units and (pdf["u"] * pdf["n"]).sum() >= min_tokens:
            pdf = pdf.sort_values(["L1", "Gender", "n"])
            for name in models:
                x, names = design(pdf, MODELS[name])
                slope = (pdf["L1"] != pdf["L1"].min()).to_numpy(float) if name == "M4" else None
                for reml in (True, False):
                    try:
                        m = fit(pdf["n"], pdf["sy"], pdf["syy"], x, reml, slope, pdf["u"], pdf["sy2"])
                    except np.linalg.LinAlgError:
                        rows.append([*key, name, reml, None, *[None] * 11, 0, "singular"])
                        continue
                    for t, b, s in zip(names, m["beta"], m["se"]):
                        p = normal_two_sided(b / s) if s > 0 else None
                        rows.append([*key, name, reml, t, b, s, p, *(m[c] for c in ("aic", "bic", "loglik", "icc", "r2_marginal", "r2_conditional", "var_u", "var_e")), m["params"], m["status"]])
        return pd.DataFrame(rows, columns=[*by, *[c.split()[0] for c in _OUT.split(", ")]])

    return unit_kinds(stats, by).groupBy(*by).applyInPandas(run, ", ".join(f"`{b}` {kinds[b]}" for b in by) + ", " + _OUT)


def likelihood_ratios(models: DataFrame, by: list[str], pairs: tuple = (("M0", "M1"), ("M1", "M2"), ("M1", "M4"))) -> DataFrame:
    """Pairs of nested models by maximum likelihood: statistic, difference of parameters (at least 1), p."""
    one = models.where(~F.col("reml") & F.col("loglik").isNotNull()).groupBy(*by, "model").agg(F.first("loglik").alias("ll"), F.first("n_params").alias("k"))
    out = None
    for a, b in pairs:
        x = one.where(F.col("model") == a).select(*by, F.col("ll").alias("la"), F.col("k").alias("ka"))
        y = one.where(F.col("model") == b).select(*by, F.col("ll").alias("lb"), F.col("k").alias("kb"))
        j = x.join(y, by).select(*by, F.lit(f"{a}_vs_{b}").alias("comparison"), (2 * (F.col("lb") - F.col("la"))).alias("lrt_stat"), F.greatest(F.col("kb") - F.col("ka"), F.lit(1)).alias("df_diff"))
        out = j if out is None else out.union(j)
    return out.withColumn("p_lrt", _chi2(F.greatest("lrt_stat", F.lit(0.0)), F.col("df_diff").cast("double")))


@F.pandas_udf(DoubleType())
def _chi2(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if a != a or b != b else chi2_upper(a, b) for a, b in zip(x, df)], dtype="float64")


def wald_intervals(models: DataFrame, by: list[str], alpha: float = 0.05) -> DataFrame:
    """Wald intervals of the main effects (M1) and interactions (M2), from maximum-likelihood fits."""
    z = NormalDist().inv_cdf(1 - alpha / 2)
    inter = F.contains("term", F.lit(":"))
    pick = ~F.col("reml") & (F.col("term") != "Intercept") & (((F.col("model") == "M1") & ~inter) | ((F.col("model") == "M2") & inter))
    return models.where(pick).select(
        *by, F.col("term").alias("effect"), "coef", "se", (F.col("coef") - z * F.col("se")).alias("ci_lo"), (F.col("coef") + z * F.col("se")).alias("ci_hi"),
        F.col("pval").alias("p_value"), F.lit("wald").alias("ci_method"),
    )
