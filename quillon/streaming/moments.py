"""Running moments of each speaker's vowels on a token stream, for Lobanov's normalisation (an extension).

The state is that of a streaming aggregation: count, mean and squared deviations by speaker.  A batch is combined inside
its tasks first, so the state is read and written once for a speaker and batch, and no Python runs for a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.ingest import is_vowel
from quillon.sources.durable import folder

FORMANTS = ("F1", "F2")
_MOMENTS = ", ".join(f"n_{f} long, mean_{f} double, ss_{f} double" for f in FORMANTS)
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def join_moments(a: tuple, b: tuple) -> tuple:
    """(count, mean, sum of squared deviations) of two sets put together."""
    (n, m, s), (k, x, t) = a, b
    if not n or not k:
        return b if k else a
    d = x - m
    return n + k, m + d * k / (n + k), s + t + d * d * n * k / (n + k)


def running_moments(tokens: DataFrame, shards: int = 1) -> DataFrame:
    """(spk, shard, moments) after each batch of a token stream with spk, phoneme, F1 and F2; null and NaN are missing.

    Each batch gives one row for each key it brings, with the state after it.  Tasks send one row a key, so a speaker that
    holds a third of all tokens is no hot key; ``shards`` may still deal a speaker to several keys by the hash of the
    token's values, which ``merged`` adds up.  Tokens without a speaker are left out."""
    dealt = tokens.where(is_vowel("phoneme") & F.col("spk").isNotNull()).select(
        "spk", F.pmod(F.xxhash64(*FORMANTS, "phoneme"), F.lit(shards)).cast("int").alias("shard"),
        *[F.when(~F.isnan(f), F.col(f).cast("double")).alias(f) for f in FORMANTS],
    )
    each = [
        c for f in FORMANTS
        for c in (
            F.count(f).alias(f"n_{f}"), F.coalesce(F.avg(f), F.lit(0.0)).alias(f"mean_{f}"),
            F.coalesce(F.var_pop(f) * F.count(f), F.lit(0.0)).alias(f"ss_{f}"),
        )
    ]
    return dealt.groupBy("spk", "shard").agg(*each)


def merged(latest: DataFrame) -> DataFrame:
    """(spk, n_F1, mean_F1, sd_F1, ...) from the newest moments of each shard; the deviation is null below two values."""
    total = [F.sum(f"n_{f}").alias(f"n_{f}") for f in FORMANTS]
    mean = [F.try_divide(F.sum(F.col(f"n_{f}") * F.col(f"mean_{f}")), F.sum(f"n_{f}")).alias(f"mean_{f}") for f in FORMANTS]
    grand = latest.groupBy("spk").agg(*total, *mean)
    apart = latest.join(grand.select("spk", *[F.col(f"mean_{f}").alias(f"_m_{f}") for f in FORMANTS]), "spk")
    ss = apart.groupBy("spk").agg(*[F.sum(F.col(f"ss_{f}") + F.when(F.col(f"n_{f}") > 0, F.col(f"n_{f}") * (F.col(f"mean_{f}") - F.col(f"_m_{f}")) ** 2).otherwise(0.0)).alias(f"ss_{f}") for f in FORMANTS])
    sd = lambda f: F.when(F.col(f"n_{f}") > 1, F.sqrt(F.col(f"ss_{f}") / (F.col(f"n_{f}") - 1))).alias(f"sd_{f}")
    return grand.join(ss, "spk").select("spk", *[c for f in FORMANTS for c in (f"n_{f}", f"mean_{f}", sd(f))])


def consume(stream: DataFrame, checkpoint: str | None = None, out: str | None = None, shards: int = 1) -> DataFrame:
    """Run the stream over all that has arrived and return the newest moments of each (speaker, shard).

    Each batch is written to a folder of its number, anew if it is repeated after a failure.  Started again with the same
    ``checkpoint`` and ``out``, it goes on where it ended.  The state lives in RocksDB, so it isn't held in memory."""
    spark = stream.sparkSession
    checkpoint = checkpoint or folder(spark, "moments-checkpoint")
    out = out or folder(spark, "moments")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, _ROCKSDB)
    try:
        write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/epoch={number}")
        run = running_moments(stream, shards).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        run.trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    finally:
        spark.conf.set(key, before)
    kinds = f"spk string, shard int, {_MOMENTS}, epoch long"
    try:
        every = spark.read.schema(kinds).parquet(out)
    except Exception as e:  # no batch has ever come
        if "PATH_NOT_FOUND" not in str(e):
            raise
        every = spark.createDataFrame([], kinds)
    rest = [c for c in every.columns if c not in ("spk", "shard", "epoch")]
    newest = every.groupBy("spk", "shard").agg(F.max_by(F.struct(*rest), "epoch").alias("s"))
    return newest.select("spk", "shard", "s.*")
