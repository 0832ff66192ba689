"""Exact dedup by skew-safe combining.

Copies are first combined inside each map task, then per (digest, salt), then over the salts.  Every stage groups by the
digest *and* the full content, so a digest collision never merges different texts.  One hot text of any size shrinks to
at most one row per map task before the first shuffle and to ``salts`` rows before the last.

The way back from a group to its documents is a join by digest in which large groups are salted: those with more than
1/HOT_SHARE of all rows, of which there are fewer than HOT_SHARE, so their digests are broadcast.  It needs only the
digest, unless a digest belongs to several contents; those
rows (none for SHA-256, many for the weak digests of the tests) are joined on the content as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.durable import materialise

HOT_SHARE = 1000
SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Text with every run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = 16,
    digest=lambda content: F.sha2(content, 256),
) -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept, digest``.

    Equal texts are those with equal normalised content; null text equals empty text.  The smallest id of a group stays.
    Null ids: they count in ``group_size``; ``keep_id`` is the smallest non-null id, and where a group has only null
    ids, keep_id is null and each of its rows is kept.  Rows that repeat an id are kept if the id is.  Further columns
    of ``docs`` are ignored, whatever their names.  An empty table gives an empty result.
    """
    content = normalised(F.col(text_col))
    base = docs.select(F.col(id_col).alias("_id"), content.alias("_content"))
    keyed = base.select("_id", "_content", digest(F.col("_content")).alias("_digest"))
    local = keyed.withColumn("_salt", F.spark_partition_id() % F.lit(salts))
    salted = local.groupBy("_digest", "_salt", "_content").agg(F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    winners = salted.groupBy("_digest", "_content").agg(F.min("_keep").alias("keep_id"), F.sum("_n").alias("group_size"))
    groups = materialise(
        winners.select("_digest", "keep_id", "group_size", F.sha2("_content", 512).alias("_check")), "exact-groups"
    )
    # A digest with several contents is told apart by a second, longer hash of the content; any digest with one content
    # was proven by the comparison of full contents above.
    clashing = groups.groupBy("_digest").agg(F.count(F.lit(1)).alias("_contents")).where("_contents > 1").select("_digest")
    members = keyed.select("_id", "_digest", F.lit(None).cast("string").alias("_check"))
    on = ["_digest", "_salt"]
    if clashing.isEmpty():
        members, groups = members.drop("_check"), groups.drop("_check")
    else:
        members, on = keyed.select("_id", "_digest", F.sha2("_content", 512).alias("_check")), [*on, "_check"]
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    large = F.col("group_size") * HOT_SHARE > total
    hot = F.broadcast(groups.where(large).select("_digest", F.lit(salts).alias("_salts")).distinct())
    members = members.join(hot, "_digest", "left").withColumn("_salt", F.coalesce(F.spark_partition_id() % F.col("_salts"), F.lit(0))).drop("_salts")
    spread = F.explode(F.when(large, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    out = members.join(groups.withColumn("_salt", spread), on)
    return out.select(
        F.col("_id").alias("id"),
        "keep_id",
        "group_size",
        F.coalesce(F.col("_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.col("_digest").alias("digest"),
    )


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_groups(docs).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with exactly one row for each normalised text: that of the smallest id, null ids last.

    Of rows that repeat this id and text one stays, and of rows without an id one, where no row with the text has an id;
    which of them is open.  Columns as in ``docs``; an empty table stays empty."""
    content = F.sha2(normalised(F.col(text_col)), 256)
    kept = exact_groups(docs, id_col, text_col).where("kept").groupBy("id", "digest").agg(F.count(F.lit(1)).alias("times"))
    kept = materialise(kept.select(F.col("id").alias("_kept_id"), F.col("digest").alias("_kept_digest"), "times"), "exact-kept")
    same = docs[id_col].eqNullSafe(kept["_kept_id"]) & (content == kept["_kept_digest"])
    out = docs.join(kept, same, "left_semi")
    if kept.where("times > 1").isEmpty():
        return out
    # Only rows of repeated (id, text) meet again, pre-combined in each map task.
    repeated = kept.where("times > 1")
    once = docs.join(kept.where("times = 1"), same, "left_semi")
    again = docs.join(repeated, docs[id_col].eqNullSafe(repeated["_kept_id"]) & (content == repeated["_kept_digest"]), "left_semi")
    again = again.groupBy(F.col(id_col).alias("_kept_id"), content.alias("_kept_digest")).agg(F.first(F.struct(*[F.col(c) for c in docs.columns])).alias("_row"))
    return once.unionByName(again.select("_row.*"))


SQL = r"""
with d as (
  select doc_id, sha256(t) as text_sha256, t from (
    select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents))
select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = min(doc_id) over (partition by t) as kept, text_sha256
from d
"""
