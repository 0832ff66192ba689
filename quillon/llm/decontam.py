"""Benchmark decontamination by winnowing.

Words are runs of letters, digits and non-ASCII characters in lower-cased text.  Of every ``window - GRAM + 1``
consecutive GRAM-word hashes the smallest is kept as a fingerprint, on both sides; any shared span of ``window`` words
therefore shares a fingerprint.  Distinct fingerprints of documents meet those of the benchmark in a join that names the
items a document may contain.  For these the hits are extended to all their windows: a window of the document counts if
the item has the same words, found by the window's hash and compared word by word, so the time is linear in both texts.
Items shorter than the window have one fingerprint, their whole text, and are looked up at every word.

Documents are read once.  If the benchmark has at most BROADCAST_FINGERPRINTS fingerprints (counted first), these are
broadcast, drop document fingerprints that cannot join, and join without a shuffle, so a common fingerprint gathers
nothing; beyond that all are shuffled.  Item texts are broadcast if they are at most BROADCAST_BYTES, measured first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import text as T
from quillon.llm.durable import materialise

WINDOW = 10
GRAM = 5
BROADCAST_FINGERPRINTS = 4_000_000
BROADCAST_BYTES = 64 << 20


def _selected(g: np.ndarray, w: int) -> np.ndarray:
    """Which gram hashes are the minimum of some w consecutive ones (all ties count)."""
    n = len(g) - w + 1
    if n <= 0:
        return np.zeros(len(g), dtype=bool)
    low = g[:n].copy()
    for j in range(1, w):
        np.minimum(low, g[j : j + n], out=low)
    high = np.zeros(len(g), dtype=np.uint64)  # the largest minimum of the windows over a position
    for j in range(w):
        np.maximum(high[j : j + n], low, out=high[j : j + n])
    return high == g


def _fingerprints(h: np.ndarray, row: np.ndarray, window: int, short: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, positions, hashes): winnowed grams as length 0, then all grams of each short length.

    A gram that would reach over the end of its row is left out.
    """
    for size in [0, *short]:
        k = size or min(GRAM, window)
        g = T.grams(h, k)
        at = np.flatnonzero(_selected(g, window - k + 1)) if not size else np.arange(len(g))
        last = row[np.searchsorted(row, at, side="right")] if len(at) else at
        at = at[at + k <= last]
        yield size, at, T.mix(g[at] ^ np.uint64(size * 0x51ED270B))


def _lower(data: np.ndarray) -> np.ndarray:
    return T.LOWER[data]


class _Known:
    """Membership among the benchmark's fingerprints: a bit table, then a binary search."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.sort(hashes)
        self.mask = np.uint64((1 << max(12, int(16 * len(hashes)).bit_length())) - 1)
        self.table = np.zeros(int(self.mask) + 1, dtype=bool)
        self.table[self.hashes & self.mask] = True

    def where(self, h: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.table[h & self.mask])
        if not len(at) or not len(self.hashes):
            return at[:0]
        found = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        return at[self.hashes[found] == h[at]]


def _item_fingerprints(window: int):
    def run(batches):
        for batch in batches:
            data, offsets = T.utf8(batch.column("text"))
            ids = batch.column("item_key").to_numpy(zero_copy_only=False)
            keys, sizes, hashes = [], [], []
            for lo, hi in T.chunks(offsets):
                with np.errstate(over="ignore"):
                    w = T.words(_lower(data[offsets[lo] : offsets[hi]]), offsets[lo : hi + 1] - offsets[lo], T.ALNUM)
                    count = np.diff(w.row)
                    for size, at, fp in _fingerprints(w.hash, w.row, window, sorted({int(c) for c in count if 0 < c < window})):
                        item = np.searchsorted(w.row, at, side="right") - 1
                        fit = count[item] >= window if not size else count[item] == size
                        keys.append(ids[lo:hi][item[fit]])
                        sizes.append(np.full(int(fit.sum()), size))
                        hashes.append(fp[fit])
            if keys:
                cols = [np.concatenate(x).astype(np.int64) for x in (keys, sizes)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(hashes).view(np.int64)), *map(pa.array, cols)], ["fp", "item_key", "size"]
                )

    return run


def _scan(window: int, short: list[int], known):
    """Per document: the number of words, its matching fingerprints, and its text if it has any."""
    kinds = pa.schema([
        ("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("text", pa.string()),
        ("fp", pa.list_(pa.int64())),
    ])

    def run(batches):
        look = _Known(known.value) if known is not None else None
        for batch in batches:
            data, offsets = T.utf8(batch.column("text"))
            for lo, hi in T.chunks(offsets):
                with np.errstate(over="ignore"):
                    w = T.words(_lower(data[offsets[lo] : offsets[hi]]), offsets[lo : hi + 1] - offsets[lo], T.ALNUM)
                    docs, hashes = [], []
                    for _, at, fp in _fingerprints(w.hash, w.row, window, short):
                        if look is not None:
                            hit = look.where(fp)
                            at, fp = at[hit], fp[hit]
                        docs.append(np.searchsorted(w.row, at, side="right") - 1)
                        hashes.append(fp)
                doc = np.concatenate(docs)
                order = np.argsort(doc, kind="stable")
                bounds = pa.array(np.searchsorted(doc[order], np.arange(hi - lo + 1)).astype(np.int32))
                part = batch.slice(lo, hi - lo)
                none = np.diff(bounds.to_numpy()) == 0
                texts = part.column("text").take(pa.array(np.arange(hi - lo), mask=none))
                yield pa.RecordBatch.from_arrays([
                    part.column("row"), part.column("doc_id"), pa.array(np.diff(w.row).astype(np.int64)), texts,
                    pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(hashes)[order].view(np.int64))),
                ], schema=kinds)

    return run


def split_words(text: str | None) -> tuple[list[bytes], np.ndarray]:
    """Words of one text, as bytes, and their hashes."""
    data, offsets = T.utf8(pa.array([text or ""]))
    low = _lower(data)
    with np.errstate(over="ignore"):
        w = T.words(low, offsets, T.ALNUM)
    raw = low.tobytes()
    return [raw[a:b] for a, b in zip(w.start.tolist(), w.end.tolist())], w.hash


@lru_cache(maxsize=4096)
def _windows(item: str, window: int) -> tuple[list[bytes], int, dict[int, list[int]]]:
    """Words of an item, the length of its windows, and their places by hash; of windows with equal words the first."""
    words, h = split_words(item)
    n = min(window, len(words))
    places: dict[int, list[int]] = {}
    with np.errstate(over="ignore"):
        for j, g in enumerate(T.grams(h, n).tolist() if n else []):
            same = places.setdefault(g, [])
            if not any(words[i : i + n] == words[j : j + n] for i in same):
                same.append(j)
    return words, n, places


def _extend(window: int):
    """Per document with candidates: words covered by windows that an item also has."""

    def run(batches):
        for batch in batches:
            rows, hits, items, spans = [], [], [], []
            for row, text, found in zip(*(batch.column(c).to_pylist() for c in ("row", "text", "found"))):
                doc, h = split_words(text)
                covered, ids, grams = np.zeros(len(doc) + 1, dtype=np.int32), set(), {}
                for f in found:
                    item, n, places = _windows(f["item_text"], window)
                    if not n or n > len(doc):
                        continue
                    if n not in grams:
                        with np.errstate(over="ignore"):
                            grams[n] = T.grams(h, n)
                    at = np.flatnonzero(np.isin(grams[n], np.fromiter(places, np.uint64, len(places))))
                    at = [i for i, g in zip(at.tolist(), grams[n][at].tolist()) if any(doc[i : i + n] == item[j : j + n] for j in places[g])]
                    if at:
                        np.add.at(covered, at, 1)
                        np.add.at(covered, np.array(at) + n, -1)
                        if f["item_id"] is not None:
                            ids.add(str(f["item_id"]))
                inside = np.cumsum(covered)[:-1] > 0
                if not inside.any():
                    continue
                edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.astype(np.int8), [0]))))
                rows.append(row)
                hits.append(int(inside.sum()))
                items.append(sorted(ids))
                spans.append([{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
            yield pa.RecordBatch.from_arrays([
                pa.array(rows, pa.int64()), pa.array(hits, pa.int64()), pa.array(items, pa.list_(pa.string())),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ], ["row", "n_hit", "items", "spans"])

    return run


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    broadcast_limit: int = BROADCAST_FINGERPRINTS,
) -> DataFrame:
    """One row per document row: ``row, doc_id, n_words, n_hit, items, spans``.

    ``n_hit`` counts words inside any run of ``window`` words that an item also has (for an item of fewer words: its
    whole word sequence); ``items`` lists the ids of those items, sorted as strings; ``spans`` are the covered word
    ranges.  Null or empty texts have no words and no hits, items without words never hit, an item without an id marks
    words but is not listed, items that share an id count once.  Rows that repeat a document each get their own result.
    Ids are integers.  Further columns are ignored; an empty benchmark or an empty table gives zero hits or no rows.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(item_text_col).alias("text"))
    items = materialise(items.withColumn("item_key", F.monotonically_increasing_id()), "decontam-items")
    prints = materialise(
        items.select("item_key", "text").mapInArrow(_item_fingerprints(window), "fp long, item_key long, size long"),
        "decontam-prints",
    )
    short = sorted(r["size"] for r in prints.where("size > 0").select("size").distinct().collect())
    distinct = prints.select("fp").distinct()
    known = None
    if distinct.limit(broadcast_limit + 1).count() <= broadcast_limit:
        known = spark.sparkContext.broadcast(distinct.toPandas()["fp"].to_numpy(dtype=np.int64).view(np.uint64))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")
    )
    scan = materialise(
        rows.mapInArrow(
            _scan(window, short, known),
            "row long, doc_id long, n_words long, text string, fp array<long>",
        ),
        "decontam-scan",
    )
    hits = scan.where("size(fp) > 0").select("row", F.explode(F.array_distinct("fp")).alias("fp"))
    pairs = prints.select("fp", "item_key").distinct()
    texts = items.select("item_key", "item_id", F.coalesce("text", F.lit("")).alias("item_text"))
    size = texts.agg(F.sum(F.octet_length("item_text") + 64)).first()[0] or 0
    found = hits.join(pairs if known is None else F.broadcast(pairs), "fp").select("row", "item_key").distinct()
    found = found.join(texts if size > BROADCAST_BYTES else F.broadcast(texts), "item_key")
    found = found.groupBy("row").agg(F.collect_list(F.struct("item_id", "item_text")).alias("found"))
    marked = scan.where("size(fp) > 0").select("row", "text").join(found, "row").mapInArrow(
        _extend(window), "row long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
    )
    return scan.select("row", "doc_id", "n_words").join(marked, "row", "left").select(
        "row",
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        "spans",
    )


def op10_winnow_decontam(spark, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without rows that have a hit; columns as in ``docs``.

    Rows are known by a 64-bit hash of id and text, so null and repeated ids do no harm."""
    key = F.xxhash64(F.col(id_col).isNull(), id_col, text_col)
    found = contamination(docs.select(key.alias("_key"), text_col), benchmark, "_key", text_col, **options)
    bad = found.where("n_hit > 0").select(F.col("doc_id").alias("_bad"))
    return docs.join(bad.distinct(), key == F.col("_bad"), "left_anti")


SQL = r"""
with words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
items as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
iw as (select distinct item_id, least(len(w), 10) as n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as s
       from (select item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as i from items where len(w) > 0)),
sizes as (select distinct n from iw),
dw as (select doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') as s
       from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from words, sizes where len(w) >= n)),
hit as (select dw.doc_id, iw.item_id, dw.i, dw.n from dw join iw using (n, s)),
cover as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hit) group by doc_id),
ids as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids
        from hit group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words left join cover using (doc_id) left join ids using (doc_id)
"""
