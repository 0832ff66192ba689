"""Two-sample tests by group, and false discovery rates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.special import p_f, p_mann_whitney, p_t, shapiro
from quillon.operators.order import average_ranks, positions, quantiles  # noqa: F401 (ranks are named here too)

SHAPIRO_LIMIT = 5000


def two_groups(df: DataFrame, value: str, by: list[str], group: str, first: str, second: str) -> DataFrame:
    """n, mean and sample variance of each of two groups."""
    d = df.where(F.col(value).isNotNull())
    agg = []
    for i, g in ((1, first), (2, second)):
        x = F.when(F.col(group) == g, F.col(value))
        agg += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"mean{i}"), F.var_samp(x).alias(f"var{i}")]
    return d.groupBy(*by).agg(*agg)


def t_tests(df: DataFrame, value: str, by: list[str], group: str, first: str, second: str) -> DataFrame:
    """Student's and Welch's t of first minus second, with two-sided p; null where a group has fewer than two values."""
    g = two_groups(df, value, by, group, first, second)
    n1, n2, v1, v2 = (F.col(c) for c in ("n1", "n2", "var1", "var2"))
    gap = F.col("mean1") - F.col("mean2")
    pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
    a, b = v1 / n1, v2 / n2
    ok = (n1 > 1) & (n2 > 1)
    g = g.withColumns({
        "student_t": F.when(ok, F.try_divide(gap, F.sqrt(pooled * (1 / n1 + 1 / n2)))),
        "student_df": F.when(ok, (n1 + n2 - 2).cast("double")),
        "welch_t": F.when(ok, F.try_divide(gap, F.sqrt(a + b))),
        "welch_df": F.when(ok, F.try_divide((a + b) ** 2, a**2 / (n1 - 1) + b**2 / (n2 - 1))),
    })
    return g.withColumns({"student_p": p_t("student_t", "student_df"), "welch_p": p_t("welch_t", "welch_df")})


def levene(df: DataFrame, value: str, by: list[str], group: str, first: str, second: str) -> DataFrame:
    """Brown-Forsythe F of absolute deviations from the group medians, and p."""
    d = df.where(F.col(value).isNotNull() & F.col(group).isin(first, second))
    mid = quantiles(d, value, [*by, group], {"_mid": 0.5})
    z = d.join(mid, [*by, group]).withColumn("z", F.abs(F.col(value) - F.col("_mid")))
    k = z.groupBy(*by, group).agg(F.count(F.lit(1)).alias("n"), F.avg("z").alias("m"), (F.var_pop("z") * F.count(F.lit(1))).alias("inside"))
    g = k.groupBy(*by).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("inside").alias("inside"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"),
        F.sum(F.col("n") * F.col("m") ** 2).alias("s2"),
    )
    between = F.col("s2") - F.col("n") * F.col("grand") ** 2
    stat = F.when(F.col("k") == 2, F.try_divide((F.col("n") - 2) * between, F.col("inside")))
    return g.select(*by, stat.alias("levene_stat"), p_f(stat, F.lit(1.0), (F.col("n") - 2).cast("double")).alias("levene_p"))


def mann_whitney(df: DataFrame, value: str, by: list[str], group: str, first: str, second: str) -> DataFrame:
    """U of the first group, two-sided p (exact for small samples without ties), group sizes and the tie term."""
    d = df.where(F.col(value).isNotNull() & F.col(group).isin(first, second))
    # Rows of one value share a rank, so the first group's are counted by value: no row is joined with its rank.
    p = positions(d, value, by, {"_first": F.count_if(F.col(group) == first)})
    n = F.col("_n").cast("double")
    g = p.groupBy(*by).agg(
        F.sum(F.when(F.col("_first") > 0, (F.col("_before") + (F.col("_n") + 1) / 2) * F.col("_first"))).alias("r1"),
        F.sum("_first").alias("n1"), F.sum(F.col("_n") - F.col("_first")).alias("n2"),
        F.sum(n * (n * n - 1)).alias("ties"),  # sum over values of t^3 - t
    )
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    g = g.where("n1 > 0 and n2 > 0").withColumn("u", u)
    return g.select(*by, "n1", "n2", "u", "ties", p_mann_whitney("u", "n1", "n2", "ties").alias("mwu_p"))


def benjamini_hochberg(df: DataFrame, p: str, family: list[str], alpha: float = 0.05, decimals: int | None = None) -> DataFrame:
    """Adds ``p_adj_BH`` and ``reject_H0_BH``; null p-values take no part.  ``decimals`` rounds p first.

    A family is one row per test, not per token."""
    x = F.round(p, decimals) if decimals is not None else F.col(p)
    d = df.withColumn("_p", x)
    tested = F.col("_p").isNotNull()
    part = [*[F.col(c) for c in family], tested]
    rank = F.row_number().over(Window.partitionBy(*part).orderBy("_p"))
    m = F.count("_p").over(Window.partitionBy(*part))
    d = d.withColumn("_raw", F.when(tested, F.col("_p") * m / rank)).withColumn("_rank", rank)
    down = Window.partitionBy(*part).orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    adj = F.when(tested, F.least(F.min("_raw").over(down), F.lit(1.0)))
    return d.withColumn("p_adj_BH", adj).withColumn("reject_H0_BH", F.col("p_adj_BH") <= alpha).drop("_p", "_raw", "_rank")


def normality(df: DataFrame, value: str, by: list[str], limit: int = SHAPIRO_LIMIT) -> DataFrame:
    """Shapiro-Wilk W and p by group; null for fewer than three or more than ``limit`` values.

    Only groups within the limit are gathered for the kernel, so a group's size is bounded."""
    d = df.where(F.col(value).isNotNull())
    n = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    fit = d.join(n.where(F.col("n").between(3, limit)).select(*by), by, "left_semi").select(*by, value)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w, p = shapiro(pdf[value].to_numpy())
        return pd.DataFrame([[*pdf[by].iloc[0], w, p]], columns=[*by, "sw_stat", "sw_p"])

    kinds = dict(df.dtypes)
    got = fit.groupBy(*by).applyInPandas(run, ", ".join(f"`{b}` {kinds[b]}" for b in by) + ", sw_stat double, sw_p double")
    return n.join(got, by, "left")


def compare_groups(df: DataFrame, value: str, by: list[str], group: str, first: str, second: str, alpha: float = 0.05, assume: float = 0.05, levene_branch: bool = True, min_n: int = 3) -> DataFrame:
    """The full comparison: normality of each group, equal variances, then Student, Welch or Mann-Whitney, then BH.

    Groups below ``min_n`` values are "insufficient_data".  ``levene_branch`` off always takes Welch for normal groups.
    ``mean_diff`` is second minus first, the statistic first minus second.  p is rounded to 6 digits before BH."""
    d = df.where(F.col(group).isin(first, second)).select(*by, group, value)
    base = t_tests(d, value, by, group, first, second)
    sw = normality(d, value, [*by, group])
    for i, g in ((1, first), (2, second)):
        one = sw.where(F.col(group) == g).select(*by, F.col("sw_stat").alias(f"sw_stat_{i}"), F.col("sw_p").alias(f"sw_p_{i}"))
        base = base.join(one, by, "left").withColumn(f"normal_{i}", F.coalesce(F.col(f"sw_p_{i}") > assume, F.lit(False)))
    base = base.join(levene(d, value, by, group, first, second), by, "left").join(
        mann_whitney(d, value, by, group, first, second).select(*by, "u", "mwu_p"), by, "left"
    )
    enough = (F.col("n1") >= min_n) & (F.col("n2") >= min_n)
    normal = F.col("normal_1") & F.col("normal_2")
    equal = F.coalesce(F.col("levene_p") > assume, F.lit(False)) if levene_branch else F.lit(False)
    used = F.when(~enough, "insufficient_data").when(normal & equal, "student_t").when(normal, "welch_t").otherwise("mann_whitney_u")
    base = base.withColumn("test_used", used)
    take = lambda s, w, u: F.when(F.col("test_used") == "student_t", F.col(s)).when(F.col("test_used") == "welch_t", F.col(w)).when(F.col("test_used") == "mann_whitney_u", F.col(u))
    out = base.withColumns({
        "stat": take("student_t", "welch_t", "u"), "p_raw": take("student_p", "welch_p", "mwu_p"),
        "equal_var": F.when(enough, equal), "mean_diff": F.when(enough, F.col("mean2") - F.col("mean1")),
    })
    out = benjamini_hochberg(out, "p_raw", [], alpha, 6)
    return out.select(
        *by, "n1", "n2", "sw_stat_1", "sw_p_1", "normal_1", "sw_stat_2", "sw_p_2", "normal_2", "levene_stat", "levene_p", "equal_var",
        "test_used", "stat", "p_raw", "mean1", "mean2", "mean_diff", "p_adj_BH", "reject_H0_BH",
    )
