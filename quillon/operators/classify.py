"""Leave-one-group-out nearest-centroid classification and its scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import vectors as V
from quillon.functions.special import p_mcnemar


def loso(df: DataFrame, id_col: str = "token_id", unit: str = "spk", label: str = "phoneme", v: str = "v", metric: str = "euclidean", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, unit, label as y_true, y_pred): each token classified by centroids of all other units.

    Centroids without a unit are differences of sums, so nothing is trained per unit.  A unit is skipped if the others
    hold fewer than two classes or two tokens.  Ties go to the smallest label.  Tokens with invalid vectors are left out.
    """
    ok = df.where(V.is_valid(v) & F.col(label).isNotNull()).select(id_col, unit, label, *carry, V.as_double(v).alias("x"))
    own = ok.groupBy(unit, label).agg(F.count(F.lit(1)).alias("n"), V.vector_sum("x").alias("s"))
    whole = own.groupBy(label).agg(F.sum("n").alias("n_all"), V.vector_sum("s").alias("s_all"))
    grid = own.select(unit).distinct().crossJoin(whole).join(own, [unit, label], "left")
    n = F.col("n_all") - F.coalesce("n", F.lit(0))
    s = F.when(F.col("s").isNull(), F.col("s_all")).otherwise(V.minus(F.col("s_all"), F.col("s")))
    train = grid.withColumn("m", n).where("m > 0").select(unit, F.col(label).alias("class"), "m", V.scaled(s, F.col("m")).alias("c"))
    if metric == "cosine":
        train = train.withColumn("c", V.unit(F.col("c"), "eps"))
        ok = ok.withColumn("x", V.unit(F.col("x"), "eps"))
    packed = train.groupBy(unit).agg(F.array_sort(F.collect_list(F.struct("class", "c"))).alias("classes"), F.sum("m").alias("rows"))
    packed = packed.where((F.size("classes") >= 2) & (F.col("rows") >= 2))
    far = lambda k: V.dot(V.minus(F.col("x"), k["c"]), V.minus(F.col("x"), k["c"])) if metric == "euclidean" else -V.dot(F.col("x"), k["c"])
    pick = F.array_min(F.transform("classes", lambda k: F.struct(far(k).alias("d"), k["class"].alias("class"))))
    return ok.join(packed, unit).select(id_col, unit, *carry, F.col(label).alias("y_true"), pick["class"].alias("y_pred"))


def class_scores(pred: DataFrame, by: list[str]) -> DataFrame:
    """Per class: true positives, support, predictions, F1 (0 where undefined), over classes seen or predicted."""
    t = pred.groupBy(*by, F.col("y_true").alias("class")).agg(F.count(F.lit(1)).alias("support"), F.count_if(F.col("y_true") == F.col("y_pred")).alias("tp"))
    p = pred.groupBy(*by, F.col("y_pred").alias("class")).agg(F.count(F.lit(1)).alias("predicted"))
    j = t.join(p, [*by, "class"], "full").fillna(0, ["support", "tp", "predicted"])
    return j.withColumn("f1", F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("support") + F.col("predicted")), F.lit(0.0)))


def scores(pred: DataFrame, by: list[str]) -> DataFrame:
    """accuracy, macro F1 (over classes seen or predicted) and the number of tokens by group."""
    g = class_scores(pred, by).groupBy(*by)
    return g.agg((F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("f1_macro"), F.sum("support").cast("bigint").alias("n_tokens"))


def confusion(pred: DataFrame, by: list[str]) -> DataFrame:
    """Counts of (true, predicted) over the full grid of labels, zeros included."""
    labels = pred.select(F.explode(F.array("y_true", "y_pred")).alias("l")).distinct()
    grid = pred.select(*by).distinct().crossJoin(labels.withColumnRenamed("l", "y_true")).crossJoin(labels.withColumnRenamed("l", "y_pred"))
    n = pred.groupBy(*by, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("count"))
    return grid.join(n, [*by, "y_true", "y_pred"], "left").fillna(0, ["count"])


def pivot_f1(by_class: DataFrame, model: str = "model", values: list[str] | None = None) -> DataFrame:
    return by_class.groupBy(F.col("class").alias("phoneme")).pivot(model, values).agg(F.first("f1"))


def mcnemar(pred: DataFrame, a: str, b: str, id_col: str = "token_id", model: str = "model") -> DataFrame:
    """The 2 x 2 table of two models on the tokens both classified, and McNemar's test (exact below 25 discordant)."""
    right = pred.withColumn("ok", F.col("y_true") == F.col("y_pred"))
    x = right.where(F.col(model) == a).select(id_col, F.col("ok").alias("a"))
    y = right.where(F.col(model) == b).select(id_col, F.col("ok").alias("b"))
    cell = lambda c: F.count_if(c).alias
    g = x.join(y, id_col).agg(
        cell(F.col("a") & F.col("b"))("n11"), cell(F.col("a") & ~F.col("b"))("n10"), cell(~F.col("a") & F.col("b"))("n01"), cell(~F.col("a") & ~F.col("b"))("n00")
    )
    n = F.col("n10") + F.col("n01")
    chi = F.try_divide((F.abs(F.col("n10") - F.col("n01")) - 1) ** 2, n)
    return g.select(
        F.lit(a).alias("model_A"), F.lit(b).alias("model_B"), "n11", "n10", "n01", "n00", n.alias("discordant"),
        F.when(n < 25, F.least("n10", "n01").cast("double")).otherwise(chi).alias("statistic"),
        p_mcnemar("n10", "n01").alias("p_value"), (n < 25).alias("exact"),
    )
