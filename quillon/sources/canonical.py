"""Canonical views of the driver's tables as tokens and representations (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _when(c, cases: dict, other):
    out = F.lit(other)
    for k, v in reversed(list(cases.items())):
        out = F.when(c == k, v).otherwise(out)
    return out


#: Up to so many rows of a table that others look up by key are broadcast.
BROADCAST_ROWS = 2_000_000


def looked_up(small: DataFrame) -> DataFrame:
    """``small`` for a join with a larger table by its key, which is then not sorted: few rows are broadcast, of more each
    task has its share in a hash table."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small.hint("shuffle_hash")


PHONE_OF_TYPE = {"ECONOMY": "a", "LARGE": "e", "MEDIUM": "ɛ", "PROMO": "i", "SMALL": "u"}
PHONE_OF_LABEL = {0: "a", 1: "e", 2: "ɛ", 3: "i", 4: "o", 5: "ø", 6: "u", 7: "y", 8: "t"}


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acoustic tokens from the line items: speaker = supplier, phone = type of the part."""
    item, part, supplier = (table(spark, sf_dir, n) for n in ("lineitem", "part", "supplier"))
    missing = F.col("l_quantity") == 1
    return (
        item.join(looked_up(part.select("p_partkey", "p_type")), F.col("l_partkey") == F.col("p_partkey"))
        .join(looked_up(supplier.select("s_suppkey", "s_nationkey")), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("spk"),
            F.when(F.col("s_nationkey") % 2 == 0, "fr").otherwise("ru").alias("L1"),
            F.when(F.col("l_suppkey") % 3 == 0, "f").otherwise("m").alias("Gender"),
            F.col("l_orderkey").alias("sent_id"),
            F.col("l_linenumber").alias("rep_id"),
            _when(F.col("p_type"), PHONE_OF_TYPE, "t").alias("phoneme"),
            (F.col("l_quantity") / 100).alias("dur"),
            F.when(~missing, F.col("l_extendedprice") / 100).alias("F1"),
            F.when(~missing, F.col("l_extendedprice") / 50 + F.col("l_discount") * 1000).alias("F2"),
        )
    )


TOKENS_SQL = """
select concat('S', cast(l_suppkey as varchar)) as spk, case when s_nationkey % 2 = 0 then 'fr' else 'ru' end as L1,
       case when l_suppkey % 3 = 0 then 'f' else 'm' end as Gender, l_orderkey as sent_id, l_linenumber as rep_id,
       case p_type when 'ECONOMY' then 'a' when 'LARGE' then 'e' when 'MEDIUM' then 'ɛ' when 'PROMO' then 'i' when 'SMALL' then 'u' else 't' end as phoneme,
       l_quantity / 100 as dur, case when l_quantity = 1 then null else l_extendedprice / 100 end as F1,
       case when l_quantity = 1 then null else l_extendedprice / 50 + l_discount * 1000 end as F2
from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey
"""


def reps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens with vectors, from the embeddings; ``v`` is of doubles."""
    e = table(spark, sf_dir, "embeddings")
    n = F.col("vec_id") % 20
    missing = F.col("vec_id") % 17 == 0
    v = F.col("embedding").cast("array<double>")
    return e.select(
        F.col("vec_id").alias("token_id"),
        F.concat(F.lit("S"), F.lpad(n.cast("string"), 2, "0")).alias("spk"),
        F.when(n % 2 == 0, "fr").otherwise("ru").alias("L1"),
        F.when(n % 3 == 0, "f").otherwise("m").alias("Gender"),
        _when(F.col("label"), PHONE_OF_LABEL, "s").alias("phoneme"),
        F.when(~missing, 500 + 100 * v[0]).alias("F1"),
        F.when(~missing, 1500 + 300 * v[1]).alias("F2"),
        v.alias("v"),
    )


def models(r: DataFrame) -> DataFrame:
    """The two models: all dimensions, and the first half of them."""
    both = r.withColumn("model", F.explode(F.array(F.lit("whisper"), F.lit("xlsr"))))
    return both.withColumn("v", F.when(F.col("model") == "whisper", F.col("v")).otherwise(F.slice("v", 1, 32)))


REPS_SQL = """
select vec_id as token_id, concat('S', lpad(cast(vec_id % 20 as varchar), 2, '0')) as spk,
       case when (vec_id % 20) % 2 = 0 then 'fr' else 'ru' end as L1, case when (vec_id % 20) % 3 = 0 then 'f' else 'm' end as Gender,
       case label when 0 then 'a' when 1 then 'e' when 2 then 'ɛ' when 3 then 'i' when 4 then 'o' when 5 then 'ø' when 6 then 'u'
                  when 7 then 'y' when 8 then 't' else 's' end as phoneme,
       case when vec_id % 17 = 0 then null else 500 + 100 * embedding[1]::double end as F1,
       case when vec_id % 17 = 0 then null else 1500 + 300 * embedding[2]::double end as F2, embedding
from embeddings
"""
