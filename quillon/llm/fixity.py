"""WARC fixity audit with Merkle trees, in DataFrame operations only.

Records of an archive are hashed; record hashes are hashed by ordered offset ranges; ranges by groups of FANOUT until an
archive has one node; archives by groups of FANOUT until one root is left.  Two replicas are compared from their roots
down: only the children of nodes that differ are ever looked at, and the records at the bottom are the damage.

A node is (archive, place).  Inside an archive its parent is (archive, place / FANOUT); once all archives are down to
place 0 the parent is (archive / FANOUT, 0).  Both replicas get the height that the larger one needs, so any two trees
meet level by level.  A range holds the records that start in it, so a lost or extra record changes one range and not its
neighbours.  Records are hashed and measured where they are read; only hashes, lengths and ids are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.durable import materialise

RANGE_BYTES = 1 << 16
FANOUT = 16
PER_ARCHIVE = 512
CRLF = "\r\n"


def warc_record(record_id: Column, uri: Column, body: Column) -> Column:
    """One WARC/1.0 resource record as text; nulls are written as empty."""
    body = F.coalesce(body, F.lit(""))
    return F.concat(
        F.lit(f"WARC/1.0{CRLF}WARC-Type: resource{CRLF}WARC-Record-ID: <urn:page:"), F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(f">{CRLF}WARC-Target-URI: "), F.coalesce(uri, F.lit("")),
        F.lit(f"{CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF * 2), body, F.lit(CRLF * 2),
    )


def lay_out(
    pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", body_col: str = "html", per_archive: int = PER_ARCHIVE, copy=None
) -> DataFrame:
    """``archive, offset, record_id, length, hash_a, hash_b``: pages as records of archives of ``per_archive`` ids.

    ``hash_a`` is the record's hash, ``hash_b`` that of ``copy`` (record id, record), a second replica's record, null
    where it has none (by default the same record).  Null ids are dealt by their hash over as many archives below zero as
    they need; rows of equal id follow each other in the order of their hashes.  Offsets are running sums within one
    archive over ids, hashes and lengths; the texts stay where they are read."""
    nulls = pages.where(F.col(id_col).isNull()).count()
    spare = -(-nulls // per_archive) or 1
    record = warc_record(F.col(id_col), F.col(uri_col), F.col(body_col))
    r = pages.select(F.col(id_col).cast("bigint").alias("record_id"), record.alias("record"))
    other = copy(F.col("record_id"), F.col("record")) if copy else F.col("record")
    r = r.select(
        "record_id", F.octet_length("record").cast("bigint").alias("length"), F.sha2("record", 256).alias("hash_a"), F.sha2(other, 256).alias("hash_b")
    )
    archive = F.coalesce(F.floor(F.col("record_id") / per_archive), -1 - F.pmod(F.xxhash64("hash_a"), F.lit(spare))).cast("bigint")
    before = Window.partitionBy("archive").orderBy("record_id", "hash_a").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("archive", archive).withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    return r.select("archive", "offset", "record_id", "length", "hash_a", "hash_b")


def replica(records: DataFrame, side: str) -> DataFrame:
    """Record hashes of one side of ``lay_out``: ``archive, offset, record_id, length, hash``; records it lacks are left out."""
    return records.select("archive", "offset", "record_id", "length", F.col(f"hash_{side}").alias("hash")).where("hash is not null")


def _fold(place: str, hash_: str) -> Column:
    """Hash of the children's hashes in the order of their places; the children of one node are few."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(place), F.col(hash_))))
    return F.sha2(F.concat_ws("|", F.transform(ordered, lambda x: F.concat_ws(":", x[place].cast("string"), x[hash_]))), 256)


def _folds(largest: int, fanout: int) -> int:
    """How often ``largest`` is divided, towards zero, until nothing is left."""
    n = 0
    while largest:
        largest, n = largest // fanout, n + 1
    return n


def merkle_levels(leaves: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> list[tuple[DataFrame, str, str]]:
    """Levels from the ranges to the root, each (nodes, archive of the parent, place of the parent) with nodes
    ``side, archive, place, hash`` and the parents as SQL; leaves have ``side, archive, offset, hash``."""
    reach = leaves.agg(F.max(F.floor(F.col("offset") / range_bytes)).alias("place"), F.max(F.abs("archive")).alias("archive")).first()
    inner, outer = _folds(reach["place"] or 0, fanout), _folds(reach["archive"] or 0, fanout)
    steps = [("archive", f"place div {fanout}")] * inner + [(f"archive div {fanout}", "0L")] * outer
    place = F.floor(F.col("offset") / range_bytes).cast("bigint").alias("place")
    nodes = materialise(leaves.groupBy("side", "archive", place).agg(_fold("offset", "hash").alias("hash")), "merkle-0")
    levels = []
    for n, (archive, up) in enumerate(steps):
        levels.append((nodes, archive, up))
        child = "place" if archive == "archive" else "archive"
        keyed = nodes.select("side", F.expr(archive).alias("to_archive"), F.expr(up).cast("bigint").alias("to_place"), F.col(child).alias("child"), "hash")
        nodes = keyed.groupBy("side", F.col("to_archive").alias("archive"), F.col("to_place").alias("place")).agg(_fold("child", "hash").alias("hash"))
        nodes = materialise(nodes, f"merkle-{n + 1}")
    return [*levels, (nodes, "archive", "place")]


def _differing(nodes: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """Keys whose hashes differ between the sides or that one side lacks, with both hashes.

    Rows of one side that share the keys (records at one offset) count together, by their sorted hashes."""
    of = lambda side: F.array_join(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.col("hash")))), "|")
    both = nodes.groupBy(*keys).agg(of("a").alias("hash_a"), of("b").alias("hash_b"), *more).where("hash_a <> hash_b")
    return both.withColumns({c: F.when(F.col(c) != "", F.col(c)) for c in ("hash_a", "hash_b")})


def audit(a: DataFrame, b: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """Records that differ between two replicas: ``archive, offset, record_id, length, hash_a, hash_b, status``.

    ``a`` and ``b`` are record hashes (``replica``).  Status is changed, missing (only in a) or extra (only in b); id and
    length are those in a, or in b where a lacks the record.  Equal replicas give an empty result after the comparison of
    two roots.  Records of one side that share archive and offset are compared together; two empty replicas are equal.
    """
    columns = ["archive", "offset", "record_id", "length", "hash"]
    leaves = a.select(F.lit("a").alias("side"), *columns).unionByName(b.select(F.lit("b").alias("side"), *columns))
    levels = merkle_levels(leaves, range_bytes, fanout)
    open_ = _differing(levels[-1][0], ["archive", "place"]).select("archive", "place")
    for i in range(len(levels) - 2, -1, -1):
        nodes, archive, up = levels[i]
        wanted = materialise(open_.select(F.col("archive").alias("to_archive"), F.col("place").alias("to_place")), f"merkle-open-{i}")
        inside = nodes.withColumn("to_archive", F.expr(archive)).withColumn("to_place", F.expr(up).cast("bigint"))
        inside = inside.join(wanted, ["to_archive", "to_place"], "left_semi")
        open_ = _differing(inside, ["archive", "place"]).select("archive", "place")
    open_ = materialise(open_, "merkle-open")
    records = leaves.withColumn("place", F.floor(F.col("offset") / range_bytes).cast("bigint")).join(open_, ["archive", "place"], "left_semi")
    first = lambda c: F.coalesce(F.min(F.when(F.col("side") == "a", F.col(c))), F.min(c)).alias(c)
    found = _differing(records, ["archive", "offset"], first("record_id"), first("length"))
    status = F.when(F.col("hash_b").isNull(), "missing").when(F.col("hash_a").isNull(), "extra").otherwise("changed")
    return found.select("archive", "offset", "record_id", "length", "hash_a", "hash_b", status.alias("status"))


def damaged(record_id: Column, record: Column) -> Column:
    """A second replica for the query: of every 97 records one has a byte appended, one is lost, one cut in half."""
    k = F.coalesce(F.pmod(record_id, F.lit(97)), F.lit(0))
    half = F.substr(record, F.lit(1), F.floor(F.length(record) / 2).cast("int"))
    return F.when(k == 5, F.concat(record, F.lit("x"))).when(k == 50, half).when(k != 31, record)


def op1_merkle_fixity(spark, sf_dir: str) -> DataFrame:
    records = materialise(lay_out(spark.read.parquet(f"{sf_dir}/pages.parquet"), copy=damaged), "merkle-records")
    found = audit(replica(records, "a"), replica(records, "b"))
    return found.select(F.col("record_id").alias("page_id"), "archive", "offset", "length", "status", "hash_a", "hash_b")


SQL = r"""
with r as (
  select page_id, floor(page_id / 512)::bigint as archive,
         'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id
         || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: '
         || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) as record
  from pages),
o as (select *, strlen(record)::bigint as length,
        coalesce(sum(strlen(record)) over (partition by archive order by page_id rows between unbounded preceding and 1 preceding), 0)::bigint as offset
      from r)
select page_id, archive, "offset", length,
       case page_id % 97 when 31 then 'missing' else 'changed' end as status, sha256(record) as hash_a,
       case page_id % 97 when 5 then sha256(record || 'x') when 50 then sha256(record[1 : floor(length(record) / 2)::bigint]) end as hash_b
from o where page_id % 97 in (5, 31, 50)
"""
