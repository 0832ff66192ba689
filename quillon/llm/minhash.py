"""Near-duplicate detection by one-permutation hashing.

One pass hashes every word shingle of a document once.  The top bits of a hash name one of BINS bins, the smallest hash
of a bin is its value, and an empty bin takes the value of the first non-empty bin of its own fixed random order of the
bins (optimal densification).  BANDS bands of ROWS bins each give the bucket keys.  With 32 bands of 4, two sets of
similarity 0.8 share no bucket with a probability of about 5e-8.

Equal sets are merged before bucketing.  Within a bucket, candidates are the edges of a star around its hub, the member
that shares most with others over all buckets; each edge is measured on the full shingle sets.  Members that end up
outside the hub's component are stragglers, which may still be linked to other members:

* In a bucket of up to SMALL_BUCKET members, pairs across components are measured too, but for those that the triangle
  inequality of the Jaccard distance rules out (their distances to the hub differ by more than a link's).
* Larger buckets that share members form a family.  A family's stragglers are compared with all its members in blocks of
  BLOCK by BLOCK texts, each block pair one small matrix product over the shared shingles; only a spanning forest of its
  links comes out of it.

So whatever is connected by linked pairs that share a bucket is found connected, and rows are at most some multiple of the bucket members plus
stragglers x members / BLOCK.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import text as T
from quillon.llm.components import connected_components
from quillon.llm.durable import materialise, shuffled

BINS = 128
BANDS = 32
ROWS = BINS // BANDS
SMALL_BUCKET = 16
BLOCK = 256
#: Bytes of text shingled at once; each takes about 130 bytes of a worker's memory, which it keeps for the stages after it.
CHUNK = 1 << 18
#: Up to so many candidate nodes, their ids (and no more of them) are broadcast to pick their texts; beyond that all texts are
#: shuffled.  Nothing else that grows with the input is broadcast.
BROADCAST_NODES = 500_000


def _probe_order() -> np.ndarray:
    """For each bin, a random order of all bins, itself first."""
    rng = np.random.default_rng(20240607)
    order = np.argsort(rng.random((BINS, BINS)), axis=1)
    return np.stack([np.concatenate(([b], row[row != b])) for b, row in enumerate(order)])


PROBES = _probe_order()
_BAND_MIX = (np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
_ROW_MIX = np.array([pow(0xC2B2AE3D27D4EB4F, i + 1, 1 << 64) | 1 for i in range(ROWS)], dtype=np.uint64)


def shingle_sets(texts: pa.Array, k: int):
    """For each text its sorted distinct shingle hashes: k consecutive words, or all words if there are fewer."""
    data, offsets = T.utf8(texts)
    for lo, hi in T.chunks(offsets, CHUNK):
        with np.errstate(over="ignore"):
            w = T.words(T.LOWER[data[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo], T.NOT_SPACE)
            g = T.grams(w.hash, k)
        row = w.row.tolist()
        for i in range(hi - lo):
            a, b = row[i], row[i + 1]
            if b - a >= k:
                s = np.sort(g[a : b - k + 1])
                if len(s) > 1:
                    s = s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif b > a:
                with np.errstate(over="ignore"):
                    s = T.mix(T.grams(w.hash[a:b], b - a) ^ np.uint64(b - a))
            else:
                s = np.zeros(0, dtype=np.uint64)
            yield s


def bucket_keys(s: np.ndarray) -> np.ndarray:
    """The BANDS bucket keys of a non-empty sorted set of hashes."""
    bins = (s >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.concatenate(([True], bins[1:] != bins[:-1]))
    value, full = np.zeros(BINS, dtype=np.uint64), np.zeros(BINS, dtype=bool)
    value[bins[first]] = s[first]
    full[bins[first]] = True
    if not full.all():
        empty = np.flatnonzero(~full)
        probes = PROBES[empty]
        value[empty] = value[probes[np.arange(len(empty)), full[probes].argmax(axis=1)]]
    with np.errstate(over="ignore"):
        return T.mix((value.reshape(BANDS, ROWS) * _ROW_MIX).sum(axis=1, dtype=np.uint64)[:, None] + _BAND_MIX)[:, 0].view(np.int64)


def _scan(k: int):
    kinds = pa.schema([
        ("row", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()), ("keys", pa.list_(pa.int64())),
    ])

    def run(batches):
        for batch in batches:
            sizes, ids, keys = [], [], []
            for s in shingle_sets(batch.column("text"), k):
                sizes.append(len(s))
                ids.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                if len(s):
                    keys.append(bucket_keys(s))
            n = np.array(sizes, dtype=np.int64)
            bounds = np.concatenate(([0], np.cumsum((n > 0) * BANDS))).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column("row"), batch.column("doc_id"), pa.array(n), pa.array(ids, pa.binary()),
                pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat)),
            ], schema=kinds)

    return run


def _compare(k: int):
    """Sizes of intersection and union of the full sets of two texts."""

    def run(batches):
        for batch in batches:
            both, either = [], []
            for x, y in zip(shingle_sets(batch.column("text_a"), k), shingle_sets(batch.column("text_b"), k)):
                m = len(np.intersect1d(x, y, assume_unique=True))
                both.append(m)
                either.append(len(x) + len(y) - m)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(both, pa.int64()), pa.array(either, pa.int64())], ["a", "b", "both", "either"]
            )

    return run


def _links_of(k: int, percent: int, sides: list[list]) -> list[tuple[int, int]]:
    """Links of different components between two lists of (node, component, text), by exact intersections; of all such
    links a spanning forest, which connects the same nodes."""
    (left, right) = (list(shingle_sets(pa.array([r[2] for r in side], pa.string()), k)) for side in sides)
    if not left or not right:
        return []
    shared = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    both = np.zeros((len(left), len(right)), dtype=np.float32)
    for lo in range(0, len(shared), 8192):
        part = shared[lo : lo + 8192]
        m = []
        for one in (left, right):
            x = np.zeros((len(one), len(part)), dtype=np.float32)
            for i, h in enumerate(one):
                at = np.minimum(np.searchsorted(part, h), len(part) - 1)
                x[i, at[part[at] == h]] = 1
            m.append(x)
        both += m[0] @ m[1].T
    size = np.add.outer([len(h) for h in left], [len(h) for h in right])
    ok = 100 * both >= percent * (size - both)
    ok &= np.not_equal.outer([r[1] for r in sides[0]], [r[1] for r in sides[1]])
    return [tuple(sorted((sides[0][i][0], sides[1][j][0]))) for i, j in _forest(ok)]


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a two-sided graph: fewer links than nodes, and the same components."""
    out = []
    left_seen, right_seen = (np.zeros(n, bool) for n in linked.shape)
    for root in np.flatnonzero(linked.any(axis=1)).tolist():
        todo = [] if left_seen[root] else [root]
        left_seen[root] = True
        while todo:
            i = todo.pop()
            new = np.flatnonzero(linked[i] & ~right_seen)
            right_seen[new] = True
            for j in new.tolist():
                out.append((i, j))
                more = np.flatnonzero(linked[:, j] & ~left_seen)
                left_seen[more] = True
                out += [(k, j) for k in more.tolist()]
                todo += more.tolist()
    return out


def _compare_blocks(k: int, percent: int):
    """Links between the two sides of each (family, i, j); rows come sorted by these and the side."""

    def run(batches):
        def table(links):
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

        here, sides = None, [[], []]
        for batch in batches:
            links = []
            for family, i, j, side, node, component, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (family, i, j) != here:
                    links += _links_of(k, percent, sides)
                    here, sides = (family, i, j), [[], []]
                sides[side].append((node, component, text))
            yield table(links)
        yield table(_links_of(k, percent, sides))

    return run


def _block_rows(big: DataFrame, labels: DataFrame, block: int, broadcast_nodes: int) -> DataFrame:
    """(family, i, j, side, node, component): stragglers on side 0, all members of the family on side 1."""
    family = connected_components(big.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")), "minhash-families")
    m = shuffled(family.withColumnRenamed("component", "family")).join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = m.groupBy("family", "component").agg(F.count(F.lit(1)).alias("n"))
    parts = parts.groupBy("family").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n")).where(F.col("top.n") < F.col("n"))
    parts = parts.select(
        "family", F.col("top.component").alias("main"), F.ceil(F.col("n") / block).alias("right"), F.ceil((F.col("n") - F.col("top.n")) / block).alias("left")
    )
    parts = materialise(parts, "minhash-families-split")
    # One row for each family, so a large one is not gathered.
    parts = F.broadcast(parts) if parts.limit(broadcast_nodes + 1).count() <= broadcast_nodes else shuffled(parts)
    m = materialise(m.join(parts, "family"), "minhash-family-members")
    of = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    left = m.where("component <> main").select("family", of(1, "left").alias("i"), every("right").alias("j"), F.lit(0).alias("side"), "node", "component")
    right = m.select("family", every("left").alias("i"), of(2, "right").alias("j"), F.lit(1).alias("side"), "node", "component")
    return left.union(right)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    small_bucket: int = SMALL_BUCKET,
    block: int = BLOCK,
    broadcast_nodes: int = BROADCAST_NODES,
) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id``.

    Documents are linked when their sets of ``shingle``-word shingles (lower-cased A-Z, words split at ASCII white space)
    have a Jaccard similarity of at least ``percent`` / 100; a component is what links connect, named by its smallest
    id.  A text with fewer words is one shingle; null, empty or blank texts have no shingles and link with nothing, so
    their component is their own id.  Rows that repeat a text are one set and one component.  Null ids link like others
    but never name a component that has a non-null id.  Ids are integers.  Further columns are ignored.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")
    )
    scan = materialise(
        rows.mapInArrow(_scan(shingle), "row long, doc_id long, n_shingles long, set_id binary, keys array<long>"), "minhash-scan"
    )
    some = scan.where("n_shingles > 0")
    # The node of a set is the row of its smallest id; only that row's text and keys are used.
    sets = some.groupBy("set_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    sets = materialise(sets.select("set_id", F.col("first.doc_id").alias("set_doc"), F.col("first.row").alias("node")), "minhash-sets")
    keyed = shuffled(some).join(sets, F.col("row") == F.col("node"), "left_semi").select(F.col("row").alias("node"), F.explode("keys").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialise(shuffled(keyed).join(buckets, "key"), "minhash-members")

    nodes = members.groupBy("node").agg(F.sum("n").alias("weight"))
    nodes = materialise(shuffled(nodes).join(some.select(F.col("row").alias("node"), "doc_id", "set_id"), "node"), "minhash-nodes")
    wanted = nodes.select("node", "doc_id", "set_id")
    some_texts = rows.select(F.col("doc_id").alias("id"), "text")
    if nodes.limit(broadcast_nodes + 1).count() <= broadcast_nodes:  # one long each; the number for null may let other rows by
        mark = lambda c: F.coalesce(F.col(c), F.lit(-(1 << 63))).alias("mark")
        some_texts = some_texts.withColumn("mark", mark("id")).join(F.broadcast(wanted.select(mark("doc_id"))), "mark", "left_semi")
    texts = materialise(
        shuffled(some_texts).join(wanted, F.col("id").eqNullSafe(F.col("doc_id"))).select("node", "set_id", "text"), "minhash-texts"
    )
    if not texts.groupBy("node").count().where("count > 1").isEmpty():  # ids repeat: keep the text that made the set
        texts = materialise(texts.mapInArrow(_same_set(shingle), "node long, text string").dropDuplicates(["node"]), "minhash-texts-own")
    texts = texts.select("node", "text")

    def measured(pairs: DataFrame, name: str) -> DataFrame:
        told = shuffled(pairs).join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        told = shuffled(told).join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        told = told.mapInArrow(_compare(shingle), "a long, b long, both long, either long")
        return materialise(told.withColumn("far", 1 - F.col("both") / F.col("either")), name)

    def linked(tested: DataFrame) -> DataFrame:
        return tested.where(F.col("both") * 100 >= F.col("either") * percent).select("a", "b")

    weight = shuffled(members).join(nodes.select("node", "weight"), "node")
    hubs = weight.groupBy("key").agg(F.max(F.struct(F.col("weight"), (-F.col("node")).alias("low"))).alias("top")).select("key", (-F.col("top.low")).alias("hub"))
    stars = materialise(shuffled(members).join(hubs, "key"), "minhash-stars")
    ends = [F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")]
    tested = measured(stars.where("node <> hub").select(*ends).distinct(), "minhash-measured")
    labels = connected_components(linked(tested), "minhash-components-1")

    live = shuffled(stars).join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    state = live.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    live = materialise(shuffled(live).join(state, "key"), "minhash-live")
    small = shuffled(live.where(F.col("n") <= small_bucket).select("*", *ends)).join(tested.select("a", "b", "far"), ["a", "b"], "left").drop("a", "b")
    small = small.withColumn("far", F.coalesce("far", F.lit(0.0)))  # the hub itself
    home = small.where("node = hub").select("key", F.col("component").alias("home"))
    other = small.select("key", F.col("node").alias("other"), F.col("component").alias("there"), F.col("far").alias("far_there"))
    crossing = shuffled(shuffled(small).join(home, "key").where("component <> home")).join(other, "key").where(
        (F.col("node") != F.col("other")) & (F.col("component") != F.col("there")) & (F.abs(F.col("far") - F.col("far_there")) <= 1 - percent / 100 + 1e-9)
    )
    crossing = crossing.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    extra = linked(measured(shuffled(crossing).join(tested, ["a", "b"], "left_anti"), "minhash-crossing"))

    big = live.where(F.col("n") > small_bucket)
    if not big.isEmpty():
        blocks = shuffled(_block_rows(big, labels, block, broadcast_nodes)).join(texts, "node")
        blocks = blocks.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "side")
        blocks = blocks.select("family", "i", "j", "side", "node", "component", "text")
        extra = extra.union(materialise(blocks.mapInArrow(_compare_blocks(shingle, percent), "a long, b long"), "minhash-blocks"))
    if not extra.isEmpty():
        labels = connected_components(linked(tested).union(extra), "minhash-components-2")
    names = shuffled(labels).join(sets.select("node", "set_doc"), "node").groupBy("component").agg(F.min("set_doc").alias("component_id"))
    names = materialise(names, "minhash-names")  # so that both sides are only shuffled, and Spark may split a large component
    named = shuffled(labels).join(names, "component").select("node", "component_id")
    sets = shuffled(sets).join(named, "node", "left").select("set_id", F.coalesce("component_id", "set_doc").alias("component_id"))
    out = scan.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set_id")).alias("set_id"))
    return shuffled(out).join(sets, "set_id", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def _same_set(k: int):
    def run(batches):
        for batch in batches:
            ids = batch.column("set_id").to_pylist()
            keep = [
                i for i, s in enumerate(shingle_sets(batch.column("text"), k))
                if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == ids[i]
            ]
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("node").take(at), batch.column("text").take(at)], ["node", "text"])

    return run


def op2_minhash_neardup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4)
    return found.select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component, that of its smallest id; columns as in ``docs``.

    Ids must be whole numbers and unique, but for nulls: a row without id counts under a number from its text that lies
    above 2^62, so it goes if a row with an id is near."""
    own = F.coalesce(F.col(id_col).cast("long"), F.lit(1 << 62) + F.pmod(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), F.lit(1 << 61)))
    found = near_duplicates(docs.select(own.alias("_own"), text_col), "_own", text_col, **options)
    rest = found.where("component_id < doc_id").select(F.col("doc_id").alias("_copy_id"))
    return shuffled(docs).join(rest, own == F.col("_copy_id"), "left_anti")


SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') as w from documents),
sh as (select distinct doc_id, array_to_string(w[i : i + 3], ' ') as s
       from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 0) + 2)) as i from w where len(w) > 0)),
n as (select doc_id, count(*)::bigint as n from sh group by doc_id),
rare as (select s from sh group by s having count(*) > 1),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as m from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id
          where a.s in (select s from rare) group by all),
links as (select a, b from pairs join n x on a = x.doc_id join n y on b = y.doc_id where 100 * m >= 80 * (x.n + y.n - m)),
edges as (select a, b from links union select b, a from links),
reach(doc_id, r) as (select doc_id, doc_id from documents union select reach.doc_id, e.b from reach join edges e on reach.r = e.a),
comp as (select doc_id, min(r) as component_id from reach group by doc_id)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, component_id, w.doc_id = component_id as kept
from w left join n using (doc_id) join comp using (doc_id)
"""
