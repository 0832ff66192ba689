"""Clustering, spelling variants and packing against brute force."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import EDGES, corpus, empty, frame, no_broadcast
from quillon.llm import packing, queries, spelling, yinyang

SF = "/root/testdata/sf0.001"


# ---- clustering


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("x", "cluster", "id", "upper", "delta")}).repartition(3)


def lloyd(x, start, rounds):
    c = x[start].copy()
    near = lambda: ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
    for _ in range(rounds):
        own = near()
        for j in range(len(c)):
            if (own == j).any():
                c[j] = x[own == j].sum(0) // (own == j).sum()
    own = near()
    return own, ((x - c[own]) ** 2).sum(1)


@pytest.mark.parametrize("groups", [1, 3, 50])
def test_clusters_equal_plain_rounds(spark, groups):
    import hashlib

    rng = np.random.default_rng(groups)
    x = np.concatenate([rng.normal(m, 0.1, (60, 4)) for m in range(6)])
    x[:40] = x[0]  # one common vector
    stats = []
    got = yinyang.cluster(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)]), k=12, rounds=6, width=4, n_groups=groups, stats=stats)
    whole = np.floor(x * 1024).astype(np.int64)
    start = sorted(range(len(x)), key=lambda i: (hashlib.sha256(f"3:{i}".encode()).hexdigest(), whole[i].tolist()))[:12]
    own, d = lloyd(whole, start, 6)
    rows = {int(r.id): r for r in got.collect()}
    assert [rows[i].cluster for i in range(len(x))] == own.tolist() and [rows[i].distance for i in range(len(x))] == d.tolist()
    assert {r.inertia for r in rows.values()} == {d.sum()}
    assert all(rows[i].cluster_inertia == d[own == own[i]].sum() for i in range(len(x)))
    if groups == 3:  # bounds save most distances once clusters settle
        assert stats[-1] < 0.5 * len(x) * 12


def test_clusters_of_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (None, [5.0, 5.0]), (2, None), (3, []), (4, [1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0])]
    out = yinyang.cluster(vectors(spark, rows), width=2, k=8, rounds=3).collect()
    assert Counter(r.id for r in out) == {"1": 2, None: 1} and all(r.distance == 0 for r in out)
    assert yinyang.cluster(vectors(spark, rows[3:]), width=2).count() == 0
    with pytest.raises(Exception, match="exceeds"):
        yinyang.cluster(vectors(spark, [(1, [1e9, 0.0])]), width=2).collect()


# ---- spelling


def variants(rows, min_length, min_count, factor, damage):
    import re

    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= min_length and k >= min_count}
    near = {w: [v for v in n if v != w and edits(v, w) == 1] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= factor * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] is not None else None))
    return out


def edits(a, b):
    if abs(len(a) - len(b)) > 1:
        return 2
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def misspelt(seed, n=120):
    """Texts of words of few letters, so that many are one edit apart and grams repeat."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(6, 9))) for _ in range(25)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(30):
            w = rng.choice(base[: rng.randint(1, 25)])
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abA") + w[k:], w[:k] + rng.choice("ab") + w[k + 1 :]])
            words.append(w)
        rows.append((i, rng.choice([" ", ", ", "1"]).join(words)))
    return rows + [(None, "aaaaaa " * 20), (500, "x" * 5000 + " " + "y" * 40)] + [(1000 + i, t) for i, t in enumerate(EDGES)]


@pytest.mark.parametrize("block", [7, 2000])
def test_spelling_equals_brute_force(spark, block):
    rows = misspelt(block) * 2
    got = spelling.spelling_variants(frame(spark, rows), min_length=6, min_count=3, factor=2, damage=7, block=block).collect()
    want = variants(rows, 6, 3, 2, 7)
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert any(r.root not in (r.word, r.form) for r in got)  # a chain of two


def test_spelling_on_nothing(spark):
    assert spelling.spelling_variants(empty(spark)).count() == 0
    assert spelling.spelling_variants(frame(spark, [(1, None), (2, "short words only")])).count() == 0


def test_spelling_broadcasts_nothing(spark):
    rows = misspelt(3)
    with no_broadcast(spark):
        got = spelling.spelling_variants(frame(spark, rows), min_length=6, min_count=3, factor=2, damage=7).collect()
    assert {tuple(r) for r in got} == variants(rows, 6, 3, 2, 7)


def test_merge_skip_counts():
    rng = random.Random(1)
    for _ in range(200):
        lists = [sorted(rng.sample(range(30), rng.randint(1, 12))) for _ in range(rng.randint(1, 8))]
        least = rng.randint(1, 6)
        n = Counter(x for y in lists for x in y)
        assert spelling.merge_skip(lists, least) == sorted(x for x in n if n[x] >= least)


# ---- packing


def fewest(items, cap):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        seen = set()
        for k, room in enumerate(bins):
            if room >= items[i] and room not in seen:
                seen.add(room)
                bins[k] -= items[i]
                go(i + 1, bins)
                bins[k] += items[i]
        go(i + 1, [*bins, cap - items[i]])

    go(0, [])
    return best[0]


def test_search_finds_the_fewest_sequences():
    rng = random.Random(5)
    for _ in range(120):
        cap = rng.choice([10, 20, 30, 50])
        items = [rng.randint(1, cap) for _ in range(rng.randint(1, 11))]
        counts = np.bincount(items, minlength=cap + 1)
        plan = packing.Search(counts).solve().plan
        used = np.zeros(cap + 1, dtype=int)
        for n, filling in plan:
            assert sum(a * b for a, b in filling) <= cap
            for a, b in filling:
                used[a] += n * b
        assert (used == counts).all() and packing.lower_bound(counts) <= sum(n for n, _ in plan) == fewest(items, cap)


def test_search_beats_best_fit():
    """A case of many lengths where best-fit decreasing takes more sequences than the lower bound."""
    rng = np.random.default_rng(3)
    counts = np.bincount(rng.integers(20, 700, 6000), minlength=1025)
    search = packing.Search(counts).solve()
    assert sum(n for n, _ in search.plan) <= sum(n for n, _ in packing.best_fit(counts))
    assert sum(n for n, _ in search.plan) <= packing.lower_bound(counts) + 1


def ids_of(text, vocab=None):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_vocabulary())
    return [*t.encode(text or "", add_special_tokens=False).ids, 2]


def checked(rows, texts, capacity):
    """Pieces cover each document, sequences are gapless; returns the number of sequences."""
    want = Counter()
    for i, text in texts:
        ids = ids_of(text)
        first = (len(ids) - 1) % capacity + 1
        for p, s in enumerate([0, *range(first, len(ids), capacity)]):
            part = ids[s : s + (capacity if p else first)]
            want[i, p, s, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_columns(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = queries.queries()["op13_bin_completion_packing"](spark, SF).collect()
    n = checked(rows, texts, 1024)
    assert n <= -(-sum(r.length for r in rows) // 1024) + 1


def test_packing_of_odd_texts(spark):
    rows = [*corpus(3), (None, "no id"), (None, "no id"), (7, "again"), (7, "again"), (8, "a<|endoftext|>  b   c  'll 's x'S \x1c d"), (9, "word " * 3000), (10, "漢" * 2000)]
    pieces = packing.token_pieces(frame(spark, rows), packing.default_vocabulary(), capacity=64)
    packed = packing.place(pieces, 64)
    out = packed.withColumns({"doc_id": F.col("id").cast("long"), "ids_crc32": F.crc32("ids")}).collect()
    checked(out, rows, 64)
    # By shuffled tables as by broadcast ones.
    other = packing.place(pieces, 64, broadcast_rows=0).collect()
    assert {(r.id, r.piece, r.sequence_id, r.offset) for r in other} == {(r.id, r.piece, r.sequence_id, r.offset) for r in out}
    for r in packing.sequences(packed).collect():
        parts = sorted((x.offset, bytes(x.ids)) for x in out if x.sequence_id == r.sequence_id)
        assert bytes(r.ids) == b"".join(p for _, p in parts) and r.starts == [o for o, _ in parts]
    assert packing.pack(empty(spark), packing.default_vocabulary()).count() == 0
