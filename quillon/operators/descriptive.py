"""Normalisation and descriptive statistics by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.ingest import is_vowel
from quillon.operators.order import quantiles
from quillon.schema import CV_VOWELS, ELLIPSE_STD


def lobanov(tokens: DataFrame, cols: tuple[str, ...] = ("F1", "F2"), by: str = "spk") -> DataFrame:
    """Adds ``<col>_normed``: z-scores with the mean and sample deviation of the speaker's vowels, for all rows.

    A speaker with fewer than two vowel values, or with equal ones, gets null.  The statistics are a small aggregate
    joined back, so a speaker with many tokens is not gathered in one task."""
    v = is_vowel("phoneme")
    stats = tokens.where(v).groupBy(F.col(by).alias("_by")).agg(
        *[f(F.col(c)).alias(f"_{n}_{c}") for c in cols for n, f in (("mean", F.avg), ("sd", F.stddev_samp))]
    )
    # One row a speaker: a task keeps its share of them in a hash table rather than sort its tokens by speaker.
    out = tokens.join(stats.hint("shuffle_hash"), tokens[by] == stats["_by"], "left")
    out = out.withColumns({f"{c}_normed": F.try_divide(F.col(c) - F.col(f"_mean_{c}"), F.col(f"_sd_{c}")) for c in cols})
    return out.select(*tokens.columns, *[f"{c}_normed" for c in cols])


def lobanov_cells(tokens: DataFrame, keys: list[str], cols: tuple[str, ...] = ("F1", "F2"), by: str = "spk", name: str = "formant") -> DataFrame:
    """by, keys, name, ``n, sy, syy``: numbers, sums and sums of squares of ``lobanov``'s columns over vowels, by cell and column.

    A z-score is a line in the value, so cells of raw values (number, mean, variance) give both the speaker's statistics and
    the sums: one aggregation over the tokens, which are neither joined nor sorted.  Cells without values are left out."""
    stats = {"n": F.count, "m": F.avg, "v": F.var_pop, "low": F.min, "high": F.max}
    d = tokens.where(is_vowel("phoneme") & F.col(by).isNotNull())
    raw = d.groupBy(by, *keys).agg(*[f(F.col(c).cast("double")).alias(f"_{n}_{c}") for c in cols for n, f in stats.items()])
    each = [F.struct(F.lit(c).alias(name), *[F.col(f"_{n}_{c}").alias(f"_{n}") for n in stats]) for c in cols]
    long = raw.select(by, *keys, F.inline(F.array(*each))).where("_n > 0")
    all_ = Window.partitionBy(by, name)
    long = long.withColumns({"_all": F.sum("_n").over(all_), "_flat": F.min("_low").over(all_) == F.max("_high").over(all_)})
    long = long.withColumn("_off", F.col("_m") - F.sum(F.col("_n") * F.col("_m")).over(all_) / F.col("_all"))
    square = F.col("_n") * (F.col("_v") + F.col("_off") ** 2)
    long = long.withColumn("_square", square).withColumn("_var", F.try_divide(F.sum("_square").over(all_), F.col("_all") - 1))
    return long.where("_all > 1 and not _flat").select(
        by, *keys, name, F.col("_n").alias("n"), (F.col("_n") * F.col("_off") / F.sqrt("_var")).alias("sy"), (F.col("_square") / F.col("_var")).alias("syy")
    )


def vowels(tokens: DataFrame) -> DataFrame:
    return tokens.where(is_vowel("phoneme"))


def describe(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """n-free summary of each column by group: cv, iqr, mean, median, std (sample), q1, q3."""
    d = df.where(" and ".join(f"`{b}` is not null" for b in by)).select(*by, *cols)
    g = d.groupBy(*by).agg(*[f(c).alias(f"{c}_{n}") for c in cols for n, f in (("mean", F.avg), ("std", F.stddev_samp))])
    # All columns go through one ordering, told apart by their number.
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(cols)]))
    long = quantiles(d.select(*by, each.alias("_e")).select(*by, "_e.*"), "_v", [*by, "_c"], {"q1": 0.25, "median": 0.5, "q3": 0.75})
    named = [F.max(F.when(F.col("_c") == i, F.col(q))).alias(f"{c}_{q}") for i, c in enumerate(cols) for q in ("q1", "median", "q3")]
    g = g.join(long.groupBy(*by).agg(*named), by, "left")
    out = []
    for c in cols:
        out += [
            F.try_divide(f"{c}_std", f"{c}_mean").alias(f"{c}_cv"), (F.col(f"{c}_q3") - F.col(f"{c}_q1")).alias(f"{c}_iqr"), f"{c}_mean",
            f"{c}_median", f"{c}_std", f"{c}_q1", f"{c}_q3",
        ]
    return g.select(*by, *out)


def missing_summary(tokens: DataFrame, value: str = "F1") -> DataFrame:
    """Rows and missing values by phoneme and by phoneme and L1 (L1 = 'all' for the coarse level), in one pass."""
    t = tokens.select(F.coalesce("phoneme", F.lit("")).alias("phoneme"), F.coalesce("L1", F.lit("")).alias("L1"), F.col(value).alias("x"))
    g = t.groupingSets([["phoneme"], ["phoneme", "L1"]], "phoneme", "L1").agg(
        F.grouping("L1").alias("coarse"), F.count(F.lit(1)).alias("total"), F.count_if(F.col("x").isNull()).alias("missing")
    )
    return g.select(
        "phoneme", F.when(F.col("coarse") == 1, "all").otherwise(F.col("L1")).alias("L1"), "total", "missing",
        (F.col("missing") / F.col("total") * 100).alias("missing_pct"),
    )


def variance_decomposition(df: DataFrame, value: str, by: str = "phoneme", unit: str = "spk") -> DataFrame:
    """n, number of units, total variance and the mean of the variances inside units, by group (sample variances)."""
    d = df.where(F.col(value).isNotNull() & F.col(by).isNotNull())
    inner = d.groupBy(by, unit).agg(
        F.count(F.lit(1)).alias("n"), F.var_samp(value).alias("v"), F.sum(value).alias("s"), F.sum(F.col(value) ** 2).alias("ss"), F.avg(value).alias("m")
    )
    # The total variance from the parts: inside and between sums of squares, without a second pass.
    inside = F.sum(F.col("n") * (F.col("ss") / F.col("n") - F.col("m") ** 2))
    total = d.groupBy(by).agg(F.var_samp(value).alias("var_total"))
    parts = inner.groupBy(by).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_speakers"), F.avg("v").alias("var_intra_speaker"),
        F.try_divide(inside, F.sum("n") - F.count(F.lit(1))).alias("var_pooled"),
    )
    return parts.join(total, by).select(by, "n", "n_speakers", "var_total", "var_intra_speaker", "var_pooled")


def unit_means(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.avg(value).alias(f"{value}_mean"), F.count(F.lit(1)).alias("n"))


def ellipse(df: DataFrame, x: str, y: str, by: list[str], n_std: float = ELLIPSE_STD) -> DataFrame:
    """Centre, width, height and angle (degrees) of the covariance ellipse by group; null below three points."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    g = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.var_samp(x).alias("a"), F.var_samp(y).alias("c"),
        F.covar_samp(x, y).alias("b"),
    )
    root = F.sqrt((F.col("a") - F.col("c")) ** 2 / 4 + F.col("b") ** 2)
    mid = (F.col("a") + F.col("c")) / 2
    angle = F.degrees(F.atan2(mid + root - F.col("a"), F.col("b")))
    # Without covariance the long axis is the coordinate axis of the larger variance.
    angle = F.when(F.col("b") == 0, F.when(F.col("a") >= F.col("c"), 0.0).otherwise(90.0)).otherwise(angle)
    ok = F.col("n") >= 3
    return g.select(
        *by, "n", "cx", "cy", F.when(ok, 2 * n_std * F.sqrt(mid + root)).alias("width"),
        F.when(ok, 2 * n_std * F.sqrt(F.greatest(mid - root, F.lit(0.0)))).alias("height"), F.when(ok, angle).alias("angle"),
    )


def box_plot(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Quartiles and the farthest values within 1.5 times the quartile range, by group."""
    d = df.where(F.col(value).isNotNull())
    q = quantiles(d, value, by, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    near = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    return d.join(q, by).groupBy(*by).agg(
        F.min("q1").alias("q1"), F.min("median").alias("median"), F.min("q3").alias("q3"), F.min(F.when(near, F.col(value))).alias("low"),
        F.max(F.when(near, F.col(value))).alias("high"), F.count_if(~near).alias("outliers"),
    )


def feature_table(tokens: DataFrame, by: str = "phoneme", vowel_set: tuple[str, ...] = CV_VOWELS) -> DataFrame:
    """Mean F1, F2 (vowels), duration in ms by label, missing means filled by the column mean, then z-scores (ddof 0).

    A column without values is 0, a constant column is centred only.  One row per label, so the windows are small."""
    v = F.col(by).isin(*vowel_set)
    g = tokens.where(F.col(by).isNotNull()).groupBy(by).agg(
        F.avg(F.when(v, F.col("F1"))).alias("F1"), F.avg(F.when(v, F.col("F2"))).alias("F2"), (F.avg("dur") * 1000).alias("dur_ms")
    )
    every = Window.partitionBy()
    for c in ("F1", "F2", "dur_ms"):
        g = g.withColumn(c, F.coalesce(F.col(c), F.avg(c).over(every), F.lit(0.0)))
        sd = F.stddev_pop(c).over(every)
        g = g.withColumn(f"{c}_z", (F.col(c) - F.avg(c).over(every)) / F.when(sd == 0, 1.0).otherwise(sd))
    return g


def best(df: DataFrame, by: str, score: str, tie: str, lowest: bool = False) -> DataFrame:
    """The row of each group with the best score, the smallest ``tie`` of equals; none for groups without a score."""
    key = F.col(score) if lowest else -F.col(score)
    rest = [c for c in df.columns if c != by]
    pick = F.min(F.struct(key.alias("_key"), F.col(tie).alias("_tie"), *[F.col(c) for c in rest])).alias("b")
    return df.where(F.col(score).isNotNull()).groupBy(by).agg(pick).select(by, *[f"b.{c}" for c in rest])


def first_by(order: str, *cols: str) -> Column:
    return F.min_by(F.struct(*cols), order)
