"""Bootstrap, permutation and Mantel inference with hash randomness.

Draws come from md5 of seed, replicate and slot (or item), so every engine and every rerun sees the same ones.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import vectors as V
from quillon.operators.order import row_ranks
from quillon.sources.durable import materialise

#: Replicates whose sums travel as one row.
BLOCK = 250
#: Hashes of one task of a permutation test, and rows of its groups and replicates that may be broadcast.
HASHES, BROADCAST = 4_000_000, 200_000


def hash_key(seed: int, b: Column, item: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}-"), b.cast("string"), F.lit("-"), item.cast("string")))


def draw(seed: int, b: Column, slot: Column, n: Column) -> Column:
    """An integer from 0 to n - 1: the first 32 bits of the hash modulo n."""
    return F.conv(F.substring(hash_key(seed, b, slot), 1, 8), 16, 10).cast("bigint") % n


def unit_draws(df: DataFrame, unit: str, n_boot: int, seed: int) -> DataFrame:
    """(unit, picks): the replicates that draw each unit, once for every time; as many draws as units, with replacement.

    Units are numbered in their order; the tables here hold units and draws, not tokens."""
    units = df.where(F.col(unit).isNotNull()).select(unit).distinct()
    numbered = units.withColumn("slot", F.row_number().over(Window.orderBy(unit)) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    reps = df.sparkSession.range(n_boot).withColumnRenamed("id", "b")
    drawn = reps.crossJoin(numbered.select("slot", "n")).withColumn("pick", draw(seed, F.col("b"), F.col("slot"), F.col("n")))
    picks = drawn.groupBy("pick").agg(F.collect_list("b").alias("picks"))
    return picks.join(numbered.select(F.col("slot").alias("pick"), unit), "pick").select(unit, "picks")


def _distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Row by row; NaN for the cosine of a zero vector."""
    if metric == "euclidean":
        return np.sqrt(((a - b) ** 2).sum(axis=1))
    size = np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1))
    return 1 - (a * b).sum(axis=1) / np.where(size == 0, np.nan, size)


def _block_sums(rows: DataFrame, keys: list[str], weights) -> DataFrame:
    """(keys, block, t): for BLOCK replicates at a time, the sums of the vectors ``x``, weighted by replicate, flattened.

    ``weights`` makes the matrix (rows x replicates) of a group.  Each batch of rows is one matrix product; partial sums
    are added by Spark."""
    kinds = dict(rows.dtypes)

    def run(batches):
        for pdf in batches:
            for key, g in pdf.groupby(keys, sort=False) if keys else [((), pdf)]:
                if len(g):
                    t = weights(g).T @ np.stack(g["x"].to_numpy()).astype(float)
                    parts = [t[lo : lo + BLOCK].ravel() for lo in range(0, len(t), BLOCK)]
                    yield pd.DataFrame({**dict(zip(keys, key)), "block": np.arange(len(parts)), "t": parts})

    sums = rows.mapInPandas(run, "".join(f"`{c}` {kinds[c]}, " for c in keys) + "block long, t array<double>")
    return sums.groupBy(*keys, "block").agg(V.vector_sum("t").alias("t"))


def bootstrap_centroid_distance(
    df: DataFrame, side: str, first: str, second: str, v: str = "v", unit: str = "spk", within: list[str] | None = None,
    metric: str = "cosine", n_boot: int = 2000, alpha: float = 0.05, seed: int = 42, min_n: int = 1, units: DataFrame | None = None,
) -> DataFrame:
    """Distance of the centroids of two values of ``side``, with a percentile interval from resampling units.

    A replicate needs only the sums and counts of each unit, so tokens are read once.  Replicates that lack a side are
    left out.  ``units`` says whom to draw from (default: the units of ``df``).  Columns: within, n_first, n_second,
    obs_sample (on all tokens), obs_boot_mean, ci_lo, ci_hi."""
    within = within or []
    kinds = dict(df.dtypes)
    ok = df.where(V.is_valid(v) & F.col(side).isin(first, second))
    sums = ok.groupBy(*within, unit, side).agg(F.count(F.lit(1)).alias("n"), V.vector_sum(v).alias("s"))
    draws = unit_draws(units if units is not None else df, unit, n_boot, seed)
    counted = F.concat(F.array(F.col("n").cast("double")), "s").alias("x")
    drawn = _block_sums(
        sums.join(draws, unit).select(*within, side, counted, "picks"), [*within, side],
        lambda g: np.stack([np.bincount(p, minlength=n_boot) for p in g["picks"]]).astype(float),
    )
    of = lambda name, t: F.first(F.when(F.col(side) == name, F.col(t)), ignorenulls=True)
    both = drawn.groupBy(*within, "block").agg(of(first, "t").alias("t1"), of(second, "t").alias("t2")).where("t1 is not null and t2 is not null")

    def replicates(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                n = min(BLOCK, n_boot - row["block"] * BLOCK)
                a, b = np.asarray(row["t1"]).reshape(n, -1), np.asarray(row["t2"]).reshape(n, -1)
                a, b = (x[(a[:, 0] > 0) & (b[:, 0] > 0)] for x in (a, b))
                d = _distances(a[:, 1:] / a[:, :1], b[:, 1:] / b[:, :1], metric)
                yield pd.DataFrame({**{c: row[c] for c in within}, "d": d[~np.isnan(d)]})

    replicate = both.mapInPandas(replicates, "".join(f"`{c}` {kinds[c]}, " for c in within) + "d double")
    summary = replicate.groupBy(*within).agg(
        F.avg("d").alias("obs_boot_mean"), F.percentile("d", F.lit(alpha / 2)).alias("ci_lo"), F.percentile("d", F.lit(1 - alpha / 2)).alias("ci_hi")
    )
    sides = sums.groupBy(*within, side).agg(F.sum("n").alias("n"), V.vector_sum("s").alias("s"))
    sample = sides.groupBy(*within).agg(*[of(x, c).alias(f"{c}{i}") for i, x in ((1, first), (2, second)) for c in ("n", "s")])
    sample = sample.where((F.col("n1") >= min_n) & (F.col("n2") >= min_n))
    a, b = V.scaled(F.col("s1"), F.col("n1")), V.scaled(F.col("s2"), F.col("n2"))
    far = V.euclidean(a, b) if metric == "euclidean" else V.cosine_distance(a, b, "null")
    sample = sample.select(*within, F.col("n1").cast("bigint").alias("n_first"), F.col("n2").cast("bigint").alias("n_second"), far.alias("obs_sample"))
    return sample.join(summary, within, "left") if within else sample.crossJoin(summary)


def _cell_digits(n: int) -> int:
    """Leading hex digits of a hash that cut n items into cells of a few thousand, one at least: hashes of
    one cell are moved, those of the others only counted."""
    digits = 1
    while n > 4096 << (4 * digits):
        digits += 1
    return digits


def permutation_centroid_distance(
    df: DataFrame, side: str, first: str, second: str, id_col: str = "token_id", v: str = "v", within: list[str] | None = None,
    n_perm: int = 999, seed: int = 42, min_n: int = 2,
) -> DataFrame:
    """One-sided permutation test of the cosine distance of two centroids: within, n1, n2, obs, p_raw.

    A replicate orders tokens by hash and gives the first n1 to the first side; the other side's sum is the total less
    that.  Vectors are not multiplied: the n1-th hash of a (group, replicate) comes from counts by leading digits, then
    from the one cell in which it falls; a second pass compares every token's hashes with these limits and adds up its
    vector for the replicates it belongs to, by one small matrix product per batch and group."""
    within = within or []
    spark = df.sparkSession
    ok = df.where(V.is_valid(v) & F.col(side).isin(first, second)).select(*within, id_col, side, V.as_double(v).alias("x"))
    whole = ok.groupBy(*within).agg(
        F.count_if(F.col(side) == first).alias("n1"), F.count_if(F.col(side) == second).alias("n2"),
        V.vector_sum(F.when(F.col(side) == first, F.col("x")).otherwise(V.zero(F.col("x")))).alias("s1"), V.vector_sum("x").alias("s"),
    ).where((F.col("n1") >= min_n) & (F.col("n2") >= min_n))
    far = lambda one: V.cosine_distance(V.scaled(one, F.col("n1")), V.scaled(V.minus(F.col("s"), one), F.col("n2")), "null")
    whole = materialise(whole.withColumn("obs", far(F.col("s1"))), "permuted-groups")
    both = F.col("n1") + F.col("n2")
    most = whole.agg(F.max(both).alias("largest"), F.sum(both).alias("rows"), F.count(F.lit(1)).alias("groups")).first()
    # Each row becomes n_perm hashes: tasks are counted by those, and by number, so that they aren't joined up again.
    tasks = max(spark.sparkContext.defaultParallelism, min(-(-(most.rows or 0) * n_perm // HASHES), 4096))
    reps = spark.range(n_perm).withColumnRenamed("id", "b")
    hashes = ok.select(*within, id_col).repartition(tasks, id_col).crossJoin(F.broadcast(reps)).withColumn("h", hash_key(seed, F.col("b"), F.col(id_col)))
    hashes = hashes.withColumn("cell", F.substring("h", 1, _cell_digits(most.largest or 0)))
    count = hashes.groupBy(*within, "b", "cell").agg(F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy(*within, "b").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    count = count.withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0)))
    sizes = whole.select(*within, "n1")
    last = count.join(sizes, within) if within else count.crossJoin(sizes)
    last = last.where("before < n1 and before + n >= n1").select(*within, "b", "cell", (F.col("n1") - F.col("before")).cast("int").alias("place"))
    # One row for each group and replicate: sent to the rows while these are few, so that hashes of other cells stay.
    send = F.broadcast if most.groups * n_perm <= BROADCAST else (lambda t: t)
    last = send(last)
    inside = hashes.join(last, [*within, "b", "cell"]).groupBy(*within, "b").agg(
        F.element_at(F.array_sort(F.collect_list(F.struct("h", F.col(id_col).alias("id")))), F.first("place")).alias("limit")
    )
    limits = inside.groupBy(*within).agg(F.array_sort(F.collect_list(F.struct("b", "limit"))).alias("limits"))
    limits = send(limits)
    member = lambda m: F.struct(hash_key(seed, m["b"], F.col(id_col)).alias("h"), F.col(id_col).alias("id")) <= m["limit"]
    told = ok.repartition(tasks, id_col)
    told = told.join(limits, within) if within else told.crossJoin(limits)
    told = told.select(*within, "x", F.transform("limits", lambda m: member(m).cast("float")).alias("first"))
    sums = _block_sums(told, within, lambda g: np.stack(g["first"].to_numpy()).astype(float))
    kinds = dict(ok.dtypes)

    def reached(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                n = min(BLOCK, n_perm - row["block"] * BLOCK)
                one = np.asarray(row["t"]).reshape(n, -1)
                d = _distances(one / row["n1"], (np.asarray(row["s"]) - one) / row["n2"], "cosine")
                yield pd.DataFrame([{**{c: row[c] for c in within}, "k": int((d >= row["obs"] - 1e-12).sum())}])

    null = (sums.join(whole, within) if within else sums.crossJoin(whole)).where("obs is not null")
    null = null.mapInPandas(reached, "".join(f"`{c}` {kinds[c]}, " for c in within) + "k long")
    p = null.groupBy(*within).agg(((F.sum("k") + 1) / (F.lit(n_perm) + 1)).alias("p_raw"))
    out = whole.join(p, within, "left") if within else whole.crossJoin(p)
    return out.select(*within, "n1", "n2", "obs", F.when(F.col("obs").isNotNull(), F.col("p_raw")).alias("p_raw"))


def upper_ranks(matrix: DataFrame, by: str, key: str, d: str) -> DataFrame:
    """Average ranks of the upper triangle of each long matrix, centred and of unit length, as ``c``."""
    i, j = f"{key}_i", f"{key}_j"
    up = matrix.where(F.col(i) < F.col(j)).select(by, i, j, F.col(d).alias("x"))
    ties = F.count(F.lit(1)).over(Window.partitionBy(by, "x"))
    rank = F.rank().over(Window.partitionBy(by).orderBy("x")) + (ties - 1) / 2
    every = Window.partitionBy(by)
    r = up.withColumn("r", rank).withColumn("c", F.col("r") - F.avg("r").over(every))
    return r.select(by, i, j, F.try_divide("c", F.sqrt(F.sum(F.col("c") ** 2).over(every))).alias("c"))


def mantel(
    matrices: DataFrame, pairs: list[tuple[str, str]], by: str = "m", key: str = "phoneme", d: str = "d", n_perm: int = 999, seed: int = 42
) -> DataFrame:
    """Spearman correlation of pairs of label-by-label matrices and its two-sided permutation p.

    ``matrices`` is long, with the matrix' name in ``by``.  Columns D1, D2, mantel_r, p_value, n_perm.  Permuting labels
    only rearranges the ranks, which are found once for all pairs.  A matrix without spread gives null for both."""
    spark = matrices.sparkSession
    i, j = f"{key}_i", f"{key}_j"
    ranks = upper_ranks(matrices, by, key, d)
    which = F.broadcast(spark.createDataFrame(pairs, "D1 string, D2 string"))
    left = which.join(ranks.select(F.col(by).alias("D1"), i, j, F.col("c").alias("ca")), "D1")
    r = left.join(ranks.select(F.col(by).alias("D2"), i, j, F.col("c").alias("cb")), ["D2", i, j]).groupBy("D1", "D2").agg(
        F.sum(F.col("ca") * F.col("cb")).alias("mantel_r")
    )
    labels = matrices.select(F.col(i).alias("l")).union(matrices.select(F.col(j).alias("l"))).distinct()
    numbered = labels.withColumn("place", F.row_number().over(Window.orderBy("l")))
    reps = spark.range(n_perm).withColumnRenamed("id", "b")
    moved = reps.crossJoin(labels).withColumn("place", F.row_number().over(Window.partitionBy("b").orderBy(hash_key(seed, F.col("b"), F.col("l")), "l")))
    moved = moved.join(numbered.withColumnRenamed("l", "to"), "place").select("b", "l", "to")
    full = ranks.select(F.col(by).alias("D2"), F.col(i).alias("ti"), F.col(j).alias("tj"), F.col("c").alias("cb"))
    full = full.unionByName(full.select("D2", F.col("tj").alias("ti"), F.col("ti").alias("tj"), "cb"))
    x = left.join(moved.select("b", F.col("l").alias(i), F.col("to").alias("ti")), i).join(
        moved.select("b", F.col("l").alias(j), F.col("to").alias("tj")), ["b", j]
    )
    null = x.join(full, ["D2", "ti", "tj"]).groupBy("D1", "D2", "b").agg(F.sum(F.col("ca") * F.col("cb")).alias("s"))
    p = null.join(r, ["D1", "D2"]).groupBy("D1", "D2").agg(
        F.max("mantel_r").alias("mantel_r"), ((F.count_if(F.abs("s") >= F.abs("mantel_r") - 1e-12) + 1) / (F.lit(n_perm) + 1)).alias("p")
    )
    return p.select("D1", "D2", "mantel_r", F.when(F.col("mantel_r").isNotNull(), F.col("p")).alias("p_value"), F.lit(n_perm).alias("n_perm"))


def token_sample(df: DataFrame, id_col: str, max_tokens: int, seed: int) -> DataFrame:
    """The ``max_tokens`` tokens with the smallest hashes: a feature of the token-level test, whose pairs grow squarely."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}-"), F.col(id_col).cast("string"))), id_col).limit(max_tokens)


def _similarities(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Of all pairs of rows: negative Euclidean distance, or cosine (a zero vector's norm counts as EPS)."""
    if metric == "euclidean":
        return -np.sqrt(sum((x[:, k, None] - y[None, :, k]) ** 2 for k in range(x.shape[1])))
    norm = lambda v: v / np.where((n := np.linalg.norm(v, axis=1)) == 0, V.EPS, n)[:, None]
    return norm(x) @ norm(y).T


def similarity_ranks(sample: DataFrame, metrics: dict[str, str], id_col: str = "token_id", block: int = 250) -> DataFrame:
    """``m, i, j, c``: for each vector column and pair i < j of tokens, the rank of its similarity, centred, of unit length.

    Tokens are numbered from 0 by id and dealt to blocks; each pair of blocks is a task of its own, and ranks come from one
    range sort of all pairs.  A matrix without spread has c = 0.  The sample bounds the pairs (see ``token_sample``)."""
    d = sample.select(F.row_number().over(Window.orderBy(id_col)).alias("i"), *metrics).withColumn("i", F.col("i") - 1)
    d = materialise(d.withColumn("block", F.floor(F.col("i") / block)), "mantel-tokens")
    rows = d.groupBy("block").agg(F.collect_list(F.struct("i", *metrics)).alias("rows"))
    pairs = rows.select(F.col("block").alias("a"), F.col("rows").alias("ra")).join(rows.select(F.col("block").alias("b"), F.col("rows").alias("rb")), F.col("a") <= F.col("b"))

    def run(batches):
        for pdf in batches:
            for ra, rb in zip(pdf["ra"], pdf["rb"]):
                i, j = (np.array([r["i"] for r in x]) for x in (ra, rb))
                at = np.nonzero(i[:, None] < j)
                for m, metric in metrics.items():
                    x, y = (np.stack([np.asarray(r[m], float) for r in z]) for z in (ra, rb))
                    yield pd.DataFrame({"m": m, "i": i[at[0]], "j": j[at[1]], "x": _similarities(x, y, metric)[at]})

    # One row, a pair of blocks, a partition: the work of a row is block x block pairs.
    long = pairs.repartition("a", "b").mapInPandas(run, "m string, i int, j int, x double")
    r = row_ranks(long, "x", ["m"], "r")
    r = materialise(r.select("m", "i", "j", "r"), "mantel-ranks")
    spread = r.groupBy("m").agg(F.avg("r").alias("mid"), F.var_pop("r").alias("var"), F.count(F.lit(1)).alias("n"))
    c = (F.col("r") - F.col("mid")) / F.sqrt(F.col("var") * F.col("n"))
    return r.join(F.broadcast(spread), "m").select("m", "i", "j", F.when(F.col("var") > 0, c).otherwise(0.0).alias("c"))


def token_correlation(ranks: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """``first, second, mantel_r``: Spearman correlations of pairs of similarity matrices, from ``similarity_ranks``."""
    which = F.broadcast(ranks.sparkSession.createDataFrame(pairs, "first string, second string"))
    a = which.join(ranks.select(F.col("m").alias("first"), "i", "j", F.col("c").alias("ca")), "first")
    b = ranks.select(F.col("m").alias("second"), "i", "j", F.col("c").alias("cb"))
    return a.join(b, ["second", "i", "j"]).groupBy("first", "second").agg(F.sum(F.col("ca") * F.col("cb")).alias("mantel_r"))


def token_mantel(
    sample: DataFrame, metrics: dict[str, str], pairs: list[tuple[str, str]], id_col: str = "token_id", n_perm: int = 999, seed: int = 42, parts: int = 8, block: int = 250, alpha: float = 0.05
) -> DataFrame:
    """Mantel tests between token similarity matrices: first, second, mantel_r, p_value, n_perm, n_tokens, significant.

    ``metrics`` gives each vector column "euclidean" or "cosine".  Tokens with an invalid vector in any column are left
    out.  Each of ``parts`` tasks gets the ranked matrices, 8 n^2 bytes each for at most ``token_sample``'s n, and a share
    of the permutations; nothing passes through the driver.  Fewer than 3 tokens give null for r and p."""
    spark = sample.sparkSession
    ok = sample
    for m in metrics:
        ok = ok.where(V.is_valid(m))
    ok = materialise(ok.select(id_col, *metrics), "mantel-sample")
    n = ok.count()
    schema = "first string, second string, mantel_r double, p_value double, n_perm int, n_tokens int, significant boolean"
    if n < 3:
        return spark.createDataFrame([(a, b, None, None, n_perm, n, None) for a, b in pairs], schema)
    ranks = materialise(similarity_ranks(ok, metrics, id_col, block), "mantel-unit-ranks")
    observed = token_correlation(ranks, pairs)
    # A matrix' row without its lower half: the ranks of (i, i + 1), (i, i + 2), ...
    rows = ranks.groupBy("m", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "c"))), lambda x: x["c"]).alias("row"))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        full = {m: np.zeros((n, n)) for m in metrics}
        for m, i, row in zip(pdf["m"], pdf["i"], pdf["row"]):
            full[m][i, i + 1 :] = row
        for m in full:
            full[m] += full[m].T
        part, out = int(pdf["part"].iloc[0]), []
        for b in range(part, n_perm, parts):
            order = np.random.default_rng([seed, b]).permutation(n)
            moved = {m: full[m][np.ix_(order, order)] for m in {b for _, b in pairs}}
            out += [(x, y, float((full[x] * moved[y]).sum() / 2)) for x, y in pairs]
        return pd.DataFrame(out, columns=["first", "second", "s"])

    null = rows.groupBy("part").applyInPandas(run, "first string, second string, s double")
    p = null.join(F.broadcast(observed), ["first", "second"]).groupBy("first", "second").agg(
        F.first("mantel_r").alias("mantel_r"), ((F.count_if(F.abs("s") >= F.abs("mantel_r") - 1e-12) + 1) / (n_perm + 1)).alias("p_value")
    )
    return p.select("first", "second", "mantel_r", "p_value", F.lit(n_perm).alias("n_perm"), F.lit(n).alias("n_tokens"), (F.col("p_value") < alpha).alias("significant"))
