import hashlib
import re
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import corpus, empty, frame, no_broadcast
from quillon.llm import components, exact, minhash, suffix


# --- exact ------------------------------------------------------------------------------------------------------------


def normal(t):
    return re.sub("[\x20\x09-\x0d]+", " ", t or "")


@pytest.mark.parametrize("digest", [None, lambda c: F.pmod(F.crc32(c), F.lit(3)).cast("string")])
def test_exact_equals_grouping_by_content(spark, digest):
    rows = corpus(1)
    kind = {} if digest is None else {"digest": digest}  # the weak digest makes almost all digests clash
    got = {r.id: (r.keep_id, r.group_size, r.kept) for r in exact.exact_groups(frame(spark, rows), salts=2, **kind).collect()}
    groups = defaultdict(list)
    for i, t in rows:
        groups[normal(t)].append(i)
    assert got == {i: (min(g), len(g), i == min(g)) for g in groups.values() for i in g}


def test_exact_edges(spark):
    assert exact.exact_groups(empty(spark)).count() == 0
    rows = [(None, "a"), (None, "a"), (3, "b"), (3, "b"), (4, None), (5, "")]
    got = sorted((str(r.id), str(r.keep_id), r.group_size, r.kept) for r in exact.exact_groups(frame(spark, rows)).collect())
    assert got == [("3", "3", 2, True), ("3", "3", 2, True), ("4", "4", 2, True), ("5", "4", 2, False), ("None", "None", 2, True), ("None", "None", 2, True)]


def test_drop_copies_keeps_one_row_of_each_text(spark):
    rows = [(1, "x"), (1, "x"), (2, "y"), (None, "x"), (1, "z"), (0, "z"), (None, "n"), (None, "n"), (3, None), (4, ""), (5, "x ")]
    docs = frame(spark, rows)
    out = exact.drop_copies(docs)
    assert out.columns == docs.columns
    assert sorted((str(r.doc_id), normal(r.text)) for r in out.collect()) == [("0", "z"), ("1", "x"), ("2", "y"), ("3", ""), ("5", "x "), ("None", "n")]
    assert exact.drop_copies(frame(spark, [(1, "a"), (2, "a"), (3, "c")])).count() == 2
    assert exact.drop_copies(empty(spark)).count() == 0


# --- near duplicates --------------------------------------------------------------------------------------------------


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))


def shingles(t, k):
    w = re.findall("[^\x20\x09-\x0d]+", lower(t))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components_of(rows, k):
    sets = {i: shingles(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("options", [{}, {"small_bucket": 0, "block": 3, "broadcast_nodes": 0}])
def test_near_equals_all_pairs(spark, options):
    rows = corpus(2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(spark, rows), shingle=4, **options).collect()}
    assert got == components_of(rows, 4)


def test_near_broadcasts_nothing_beyond_its_limit(spark):
    rows = corpus(5)
    with no_broadcast(spark):
        out = minhash.near_duplicates(frame(spark, rows), shingle=4, small_bucket=0, block=3, broadcast_nodes=0)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()}
        kept = {r.doc_id for r in minhash.drop_near_copies(frame(spark, rows), shingle=4, broadcast_nodes=0).collect()}
    assert got == components_of(rows, 4) and kept == {i for i, (_, low) in got.items() if i == low}


def test_near_edges(spark):
    assert minhash.near_duplicates(empty(spark)).count() == 0
    assert minhash.near_duplicates(frame(spark, [(1, None), (2, ""), (3, " ")])).where("component_id <> doc_id").count() == 0
    rows = [(7, "p q r s t"), (7, "u v w x y"), (None, "p q r s t"), (9, "u v w x y")]
    got = sorted(str(tuple(r)) for r in minhash.near_duplicates(frame(spark, rows), shingle=2).select("doc_id", "component_id").collect())
    assert got == ["(7, 7)", "(7, 7)", "(9, 7)", "(None, 7)"]
    assert minhash.drop_near_copies(frame(spark, [(1, "a b c"), (2, "a b c"), (3, "z")])).count() == 2


def test_densified_buckets_find_small_sets():
    rng = np.random.default_rng(0)
    misses = 0
    for _ in range(300):
        s = np.sort(rng.integers(0, 1 << 63, 10, dtype=np.uint64) * np.uint64(2))
        misses += not set(minhash.bucket_keys(s)) & set(minhash.bucket_keys(np.sort(rng.choice(s, 8, replace=False))))
    assert misses == 0


def test_words_that_defeat_a_linear_hash():
    from quillon.llm import text as T

    word = "a"
    while len(word) < 1024:  # Thue-Morse
        word += word.translate(str.maketrans("ab", "ba"))
    sets = list(minhash.shingle_sets(pa.array([word, word.translate(str.maketrans("ab", "ba"))]), 4))
    assert sets[0] != sets[1]
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    at = rng.integers(0, 3900, 20000)
    size = rng.integers(1, 40, 20000)
    h = T.span_hash(T.prefix_hash(data), at, at + size)
    seen = {}
    for a, n, x in zip(at.tolist(), size.tolist(), h.tolist()):
        assert seen.setdefault(x, data[a : a + n].tobytes()) == data[a : a + n].tobytes()
    assert len(set(seen.values())) == len(seen)


def test_forest_connects_what_links_connect():
    rng = np.random.default_rng(2)
    for density in (0.02, 0.1, 0.9):
        linked = rng.random((40, 60)) < density
        forest = minhash._forest(linked)
        assert len(forest) < 100 and all(linked[i, j] for i, j in forest)

        def groups(pairs):
            parent = list(range(100))

            def find(x):
                while parent[x] != x:
                    x = parent[x]
                return x

            for i, j in pairs:
                parent[find(i)] = find(40 + j)
            return [[find(x) == find(y) for y in range(100)] for x in range(100)]

        assert groups(forest) == groups(zip(*np.nonzero(linked)))


def test_planted_pairs_near_the_threshold_are_found(spark):
    """Recall on pairs of similarity 0.80 to 0.85, the hardest ones."""
    rng = np.random.default_rng(3)
    rows, planted = [], 0
    while planted < 150:
        w = [f"w{x}" for x in rng.integers(0, 5000, 120)]
        v = list(w)
        for at in rng.choice(120, 3, replace=False):
            v[at] = "changed"
        a, b = (shingles(" ".join(x), 4) for x in (w, v))
        if 0.8 <= len(a & b) / len(a | b) < 0.85:
            rows += [(2 * planted, " ".join(w)), (2 * planted + 1, " ".join(v))]
            planted += 1
    found = minhash.near_duplicates(frame(spark, rows), shingle=4).collect()
    assert sum(r.component_id % 2 == 0 and r.component_id < r.doc_id for r in found) == planted


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (7, 7), (2, 1)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 9: 8, 8: 8, 7: 7}
    path = spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long")
    assert {r.component for r in components.connected_components(path).collect()} == {0}
    assert components.connected_components(edges.limit(0)).count() == 0


def test_shingling_holds_a_small_part_of_a_batch():
    """The memory is that of one chunk, not of the batch, beside which a worker of the pipeline has that of earlier stages."""
    rng = np.random.default_rng(2)
    text = pa.array([" ".join(f"w{i}" for i in rng.integers(0, 5_000, 600)) for _ in range(1_500)])
    list(minhash.shingle_sets(text[:100], 5))
    tracemalloc.start()
    n = sum(len(s) for s in minhash.shingle_sets(text, 5))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 500_000 and peak < 64e6


# --- repeated strings -------------------------------------------------------------------------------------------------


def without_repeats(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        rest = bytes(x for x, y in zip(b, gone) if not y)
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(rest).hexdigest(), rest)
    return out


@pytest.mark.parametrize("shard_bytes", [1 << 20, 300])
def test_suffix_equals_brute_force(spark, shard_bytes):
    rows = corpus(3)
    got = suffix.remove_repeats(frame(spark, rows), keep_text=True, shard_bytes=shard_bytes)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got.collect()} == without_repeats(rows, 100)


def test_suffix_hot_anchor_is_dealt_to_bounded_groups(spark):
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    passage = word(150)
    rows = [(i, word(60) + passage + word(60)) for i in range(60)]
    got = suffix.remove_repeats(frame(spark, rows), keep_text=True, shard_bytes=1500)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got.collect()} == without_repeats(rows, 100)
    docs = pa.table({"key": [i for i, _ in rows], "text": [t for _, t in rows]})
    packed = pa.Table.from_batches(suffix._emit_contexts(1, 100, 16)(docs.to_batches()))
    matched = suffix._match_contexts(1, 1500)(packed)
    cut = suffix._cut_contexts()(matched.filter(pa.array(matched.column("kind").to_numpy() == suffix._ASKED)), docs)
    anchor = {d: set(np.frombuffer(a, np.uint64)) for d, a in zip(cut.column("dest").to_pylist(), cut.column("a").to_pylist())}
    size = {d: len(e) for d, e in zip(cut.column("dest").to_pylist(), cut.column("e").to_pylist())}
    own = [d for d in anchor if d >= 1]  # groups of divided anchors
    assert len(own) > 2 and all(len(anchor[d]) == 1 and size[d] <= 1500 + 184 for d in own)
    assert len(set().union(*(anchor[d] for d in own))) < len(own)


def test_suffix_tasks_hold_little_beside_their_texts():
    rng, n, size = np.random.default_rng(0), 6000, 160
    texts = [rng.integers(97, 123, 1000).astype(np.uint8).tobytes().decode() for _ in range(n)]
    docs = pa.table({"key": range(n), "doc_id": range(n), "text": texts})
    i, zero = np.arange(n), np.zeros(n, np.int64)
    asked = suffix._pack(suffix._ASKED, zero, [i, zero, np.full(n, 900, np.int32), i.astype(np.uint64), i % 9])
    contexts = suffix._pack(suffix._ASKED, zero, [(i // 4).astype(np.uint64), i, zero, np.full(n, size, np.int32) + suffix._SEARCHED])
    contexts = contexts.set_column(6, "e", pa.array(["".join(texts)[: n * size].encode()], pa.binary()))
    covers = suffix._covered(i, zero, np.full(n, 150), 1)
    table = lambda x: pa.Table.from_batches([x])
    for work, held in [
        (lambda: suffix._remove(False)(table(covers), docs), 6), (lambda: suffix._cut_contexts()(table(asked), docs), 8),
        (lambda: suffix._search_shard(12, 100, 1 << 17)(table(contexts)), 30),
    ]:
        tracemalloc.start()
        work()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < held * 1000 * n, (held, peak)


def test_suffix_edges(spark):
    assert suffix.remove_repeats(empty(spark)).count() == 0
    rows = [(1, "q" * 250), (1, "q" * 250), (None, "q" * 250), (0, None)]
    got = sorted((str(r.doc_id), r.n_removed) for r in suffix.remove_repeats(frame(spark, rows)).collect())
    # Of the first row the strings from the second byte on repeat; the other rows repeat it.
    assert got == [("0", 0), ("1", 249), ("1", 250), ("None", 250)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=30).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=6).filter(lambda x: any(x)))
def test_suffix_array_and_kasai(texts):
    texts = [t for t in texts if t]
    data, sizes = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
    sa, key = suffix.suffix_array(data, sizes)
    ends = np.cumsum(sizes)
    number = np.repeat(np.arange(len(sizes)), sizes)
    whole = [(list(data[i : ends[number[i]]] + 1) + [0], number[i]) for i in range(len(data))]
    assert sa.tolist() == sorted(range(len(data)), key=lambda i: whole[i])
    lcp = suffix.common_prefixes(data, sa, key, ends[number], ends - sizes, 12)
    for r in range(1, len(sa)):
        a, b = whole[sa[r - 1]][0][:-1], whole[sa[r]][0][:-1]
        n = 0
        while n < min(len(a), len(b), 12) and a[n] == b[n]:
            n += 1
        assert lcp[r] == n


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab", max_size=60), min_size=1, max_size=8), st.sampled_from([1 << 20, 40]))
def test_shards_cover_what_brute_force_covers(texts, shard_bytes):
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    sizes = np.array([len(r) for r in raw])
    n = len(raw)
    key, start = suffix.cover_shards(np.zeros(n, np.uint64), np.arange(n), np.zeros(n, np.int64), sizes, data, 5, shard_bytes) if len(data) else ([], [])
    gone = defaultdict(set)
    for k, s in zip(key, start):
        gone[int(k)].update(range(s, s + 5))
    want = without_repeats(list(enumerate(texts)), 5)
    assert {i: len(gone[i]) for i in range(n)} == {i: want[i][1] for i in range(n)}
