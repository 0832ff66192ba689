"""Equivalence classification of intervals against a region of practical equivalence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.schema import ROPE_ACOUSTIC, ROPE_CLASSES


def classify(lo: Column, hi: Column, rope_lo: Column, rope_hi: Column) -> Column:
    """Inside (bounds count) is equivalent, strictly outside is not, else indeterminate; nulls have classes of their own."""
    return (
        F.when(rope_hi.isNull() | rope_lo.isNull(), "rope_undefined")
        .when(lo.isNull() | hi.isNull(), "insufficient_data")
        .when((lo >= rope_lo) & (hi <= rope_hi), "equivalent")
        .when((hi < rope_lo) | (lo > rope_hi), "non-equivalent")
        .otherwise("indeterminate")
    )


def classify_acoustic(ci: DataFrame, lo: float = ROPE_ACOUSTIC[0], hi: float = ROPE_ACOUSTIC[1]) -> DataFrame:
    """Intervals (phoneme, formant, effect, coef, ci_lo, ci_hi, p_value) whose effect is about L1, classified."""
    note = F.lit(f"fixed band of {lo:+.2f} to {hi:+.2f} speaker deviations")
    return ci.where(F.col("effect").rlike("(?i)L1")).select(
        F.concat(F.lit("acoustic_"), "formant").alias("representation"), "phoneme", "effect", F.col("coef").alias("point_est"), "ci_lo", "ci_hi",
        F.lit(lo).alias("rope_lo"), F.lit(hi).alias("rope_hi"), note.alias("rope_note"),
        classify(F.col("ci_lo"), F.col("ci_hi"), F.lit(lo), F.lit(hi)).alias("classification"), "p_value",
    )


def classify_neural(ci: DataFrame, delta0: DataFrame) -> DataFrame:
    """Intervals (model, phoneme, obs_dist, ci_lo, ci_hi) against [0, delta0] of their model."""
    j = ci.join(delta0, "model", "left")
    note = F.when(F.col("delta0").isNull(), "no distance inside speakers").otherwise(F.concat(F.lit("up to "), F.format_string("%.4f", F.col("delta0")), F.lit(", the mean distance inside speakers")))
    return j.select(
        F.concat(F.lit("neural_"), "model").alias("representation"), "phoneme", F.lit("L1_vs_L2_centroid_distance").alias("effect"),
        F.col("obs_dist").alias("point_est"), "ci_lo", "ci_hi", F.lit(0.0).alias("rope_lo"), F.col("delta0").alias("rope_hi"), note.alias("rope_note"),
        classify(F.col("ci_lo"), F.col("ci_hi"), F.lit(0.0), F.col("delta0")).alias("classification"), F.lit(None).cast("double").alias("p_value"),
    )


def significant_equivalent(rows: DataFrame, prefix: str = "acoustic", alpha: float = 0.05) -> DataFrame:
    """Effects of the representations whose name starts with ``prefix`` that differ from zero and yet are equivalent."""
    return rows.where(F.startswith("representation", F.lit(prefix)) & (F.col("classification") == "equivalent") & (F.col("p_value") < alpha))


def summary(rows: DataFrame) -> DataFrame:
    """Counts of each class by representation (all classes as columns), total and the share that is not equivalent."""
    g = rows.groupBy("representation").pivot("classification", list(ROPE_CLASSES)).count().fillna(0)
    total = sum((F.col(f"`{c}`") for c in ROPE_CLASSES), F.lit(0))
    g = g.withColumn("total", total)
    return g.withColumn("pct_non_equivalent", F.round(F.col("`non-equivalent`") / F.col("total") * 100, 1))
