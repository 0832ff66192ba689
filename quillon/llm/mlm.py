"""Masked pseudo-likelihood: a window network predicts every token from the tokens on both sides.

Tokens are word numbers: the FREQUENT most frequent words of the corpus by rank, all others by hash.  The network adds
one embedding for each of the SIDES * 2 neighbours, squashes the sum, and predicts the middle token in two steps, its
group and its place in the group.  Which word of its hash bucket a rarer word is comes third, by the word's share of the
bucket's count: P(word | neighbours) = P(number | neighbours) * count(word) / count(bucket).  Summed conditional log
probabilities of the words score a document.

Training is data parallel in numpy: from common parameters each partition takes Adagrad steps over all its documents,
and the partitions' parameters are averaged, weighted by tokens, through a shuffle.  The word counts cover the whole
corpus too: they are a written table with one row for each word (its 64-bit hash), which grows with the corpus.  Scoring
sends only the KNOWN most frequent words of it to the tasks; a document's other words meet the table in a join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import text as T
from quillon.llm.durable import materialise

FREQUENT = 1920
HASHED = 128
SIZE = FREQUENT + HASHED
KNOWN = 65_536
GROUP = 32
GROUPS = SIZE // GROUP
SIDES = 2
WIDTH = 16
BATCH = 4096
SCORE_BATCH = 8192
RATE = 0.15
ROUNDS = 1
CHUNKS = 32
OFFSETS = [*range(-SIDES, 0), *range(1, SIDES + 1)]


class Window:
    """Parameters and passes of the network; all parameters live in one flat array."""

    shapes = {"E": (len(OFFSETS), SIZE + 1, WIDTH), "U": (GROUPS, WIDTH), "u": (GROUPS,), "W": (GROUPS, GROUP, WIDTH), "w": (GROUPS, GROUP)}

    def __init__(self, flat: np.ndarray) -> None:
        self.flat, at = flat, 0
        for name, shape in self.shapes.items():
            n = int(np.prod(shape))
            setattr(self, name, flat[at : at + n].reshape(shape))
            at += n

    @classmethod
    def length(cls) -> int:
        return sum(int(np.prod(s)) for s in cls.shapes.values())

    @classmethod
    def start(cls, counts: np.ndarray, seed: int) -> Window:
        """Random embeddings; output biases that make it the unigram model of ``counts``."""
        rng = np.random.default_rng(seed)
        net = cls((rng.standard_normal(cls.length()) * 0.1).astype(np.float32))
        c = (counts + 0.5).reshape(GROUPS, GROUP)
        net.u[:] = np.log(c.sum(axis=1) / c.sum())
        net.w[:] = np.log(c / c.sum(axis=1)[:, None])
        return net

    def hidden(self, around: np.ndarray) -> np.ndarray:
        z = self.E[0][around[:, 0]]
        for p in range(1, len(OFFSETS)):
            z = z + self.E[p][around[:, p]]
        return np.tanh(z)

    def log_probs(self, around: np.ndarray, token: np.ndarray, grad: bool = False):
        """log P(token | neighbours), or with ``grad`` that and the gradient of its mean."""
        # In the order of the groups, so that each one's rows are a slice.
        order = np.argsort(token.astype(np.int16), kind="stable")  # counting sort for 16 bits
        around, token = around[order], token[order]
        h = self.hidden(around)
        n, group, place = len(token), token // GROUP, token % GROUP
        each = np.arange(n)
        logits = h @ self.U.T + self.u
        logits -= logits.max(axis=1, keepdims=True)
        own = logits[each, group]
        p = np.exp(logits, out=logits)
        total = p.sum(axis=1)
        out = own - np.log(total)
        if grad:
            p /= -total[:, None] * n
            p[each, group] += 1 / n
            d = {"U": p.T @ h, "u": p.sum(axis=0), "W": np.zeros_like(self.W), "w": np.zeros_like(self.w)}
            dh = p @ self.U
        cut = np.searchsorted(group, np.arange(GROUPS + 1)).tolist()
        for g in range(GROUPS):
            lo, hi = cut[g], cut[g + 1]
            if lo == hi:
                continue
            hg, of, row = h[lo:hi], place[lo:hi], each[: hi - lo]
            inner = hg @ self.W[g].T + self.w[g]
            inner -= inner.max(axis=1, keepdims=True)
            own = inner[row, of]
            q = np.exp(inner, out=inner)
            total = q.sum(axis=1)
            out[lo:hi] += own - np.log(total)
            if grad:
                q /= -total[:, None] * n
                q[row, of] += 1 / n
                d["W"][g], d["w"][g] = q.T @ hg, q.sum(axis=0)
                dh[lo:hi] += q @ self.W[g]
        if not grad:
            back = np.empty_like(out)
            back[order] = out
            return back
        dz = dh * (1 - h * h)
        d["E"] = []
        for p_ in range(len(OFFSETS)):
            by = np.argsort(around[:, p_].astype(np.int16), kind="stable")
            ids = around[by, p_]
            first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
            d["E"].append((ids[first], np.add.reduceat(dz[by], first, axis=0)))
        return out, d


class Steps:
    """Adagrad over one partition's tokens."""

    def __init__(self, flat: np.ndarray) -> None:
        self.net = Window(flat.copy())
        self.seen = Window(np.full_like(flat, 1e-6))
        self.tokens = 0

    def take(self, around: np.ndarray, token: np.ndarray) -> None:
        for lo in range(0, len(token), BATCH):
            a, t = around[lo : lo + BATCH], token[lo : lo + BATCH]
            _, d = self.net.log_probs(a, t, grad=True)
            rate = np.float32(RATE)
            for name in ("U", "u", "W", "w"):
                s = getattr(self.seen, name)
                s += d[name] ** 2
                getattr(self.net, name)[...] += rate * d[name] / np.sqrt(s)
            for p, (ids, g) in enumerate(d["E"]):
                self.seen.E[p][ids] += g**2
                self.net.E[p][ids] += rate * g / np.sqrt(self.seen.E[p][ids])
            self.tokens += len(t)


def _tokens(batch, top: np.ndarray, rank: np.ndarray):
    """Row range, neighbours, tokens, row offsets and word hashes of each chunk of a batch."""
    data, offsets = T.utf8(batch.column("text"))
    for lo, hi in T.chunks(offsets):
        with np.errstate(over="ignore"):
            w = T.words(T.LOWER[data[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo], T.NOT_SPACE)
        token = numbers(w.hash, top, rank)
        yield lo, hi, neighbours(token, w.row), token, w.row, w.hash


def numbers(h: np.ndarray, top: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Token numbers of word hashes, given the sorted hashes of the frequent words and their ranks."""
    token = FREQUENT + (h % np.uint64(HASHED)).astype(np.int64)
    if len(top):
        at = np.minimum(np.searchsorted(top, h), len(top) - 1)
        token = np.where(top[at] == h, rank[at], token)
    return token


def neighbours(token: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The tokens at OFFSETS around each token; SIZE stands beyond the ends of its document."""
    n = len(token)
    size = np.diff(row)
    place = np.arange(n) - np.repeat(row[:-1], size)
    length = np.repeat(size, size)
    out = np.full((n, len(OFFSETS)), SIZE, dtype=np.int64)
    for i, o in enumerate(OFFSETS):
        ok = np.flatnonzero((place + o >= 0) & (place + o < length))
        out[ok, i] = token[ok + o]
    return out


def _count(batches):
    for batch in batches:
        data, offsets = T.utf8(batch.column("text"))
        found = []
        for lo, hi in T.chunks(offsets):
            with np.errstate(over="ignore"):
                w = T.words(T.LOWER[data[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo], T.NOT_SPACE)
            found.append(w.hash)
        h, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])


def _train(flat: np.ndarray, top: np.ndarray, rank: np.ndarray):
    def run(batches):
        steps = Steps(flat)
        for batch in batches:
            for _, _, around, token, _, _ in _tokens(batch, top, rank):
                steps.take(around, token)
        if steps.tokens:
            parts = np.array_split(steps.net.flat, CHUNKS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(CHUNKS), pa.int32()), pa.array([steps.tokens] * CHUNKS, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())],
                ["chunk", "tokens", "data"],
            )

    return run


def _average(table: pa.Table) -> pa.Table:
    """The mean of one chunk of the parameters over all partitions, weighted by tokens."""
    order = np.lexsort(([x[:64] for x in table.column("data").to_pylist()], table.column("tokens").to_numpy()))
    total, mean = 0, 0.0
    for i in order.tolist():  # a fixed order of the sum
        n = table.column("tokens")[i].as_py()
        mean = mean + n * np.frombuffer(table.column("data")[i].as_py(), np.float32).astype(np.float64)
        total += n
    return pa.table({
        "chunk": table.column("chunk").slice(0, 1), "tokens": pa.array([total], pa.int64()),
        "data": pa.array([(mean / total).astype(np.float32).tobytes()], pa.binary()),
    })


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``word, n``: how often each word, by its hash, stands in all texts; written once."""
    texts = docs.select(F.col(text_col).alias("text")).where("text is not null")
    return materialise(texts.mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "mlm-words")


def fit(
    docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS, seed: int = 11, counts: DataFrame | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted hashes of frequent words, their ranks, flat parameters), learned from all texts.

    ``counts`` is the table of ``count_words``; it is made here if it isn't given."""
    texts = docs.select(F.col(text_col).alias("text")).where("text is not null")
    counts = count_words(docs, text_col) if counts is None else counts
    best = counts.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    buckets = _bucket_counts(counts).collect()
    size = np.zeros(SIZE)
    for i, r in enumerate(best):
        size[i] = r["n"]
        size[FREQUENT + r["word"] % HASHED] -= r["n"]
    for r in buckets:
        size[FREQUENT + r["bucket"]] += r["n"]
    top = np.array([r["word"] for r in best], dtype=np.int64).view(np.uint64)
    rank = np.argsort(top, kind="stable")
    top = top[rank]
    flat = Window.start(size, seed).flat
    for _ in range(rounds):
        got = texts.mapInArrow(_train(flat, top, rank), "chunk int, tokens long, data binary")
        got = got.groupBy("chunk").applyInArrow(_average, "chunk int, tokens long, data binary").collect()
        if got:
            flat = np.concatenate([np.frombuffer(r["data"], np.float32) for r in sorted(got, key=lambda r: r["chunk"])])
    return top, rank, flat


def _bucket_counts(counts: DataFrame) -> DataFrame:
    return counts.groupBy(F.pmod("word", F.lit(HASHED)).alias("bucket")).agg(F.sum("n").alias("n"))


def _shares(counts: DataFrame, top: np.ndarray, known: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted hashes of the ``known`` most frequent words, logs of their counts, logs of the buckets' counts by number).

    Words at ``top`` have numbers of their own and are in no bucket."""
    got = counts.orderBy(F.desc("n"), "word").limit(known).toArrow()
    word, n = got.column("word").to_numpy().view(np.uint64), got.column("n").to_numpy().astype(np.float64)
    order = np.argsort(word)
    word, n = word[order], n[order]
    total = np.zeros(SIZE)
    for r in _bucket_counts(counts.where(~F.col("word").isin(top.view(np.int64).tolist()))).collect():
        total[FREQUENT + r["bucket"]] = r["n"]
    return word, np.log(n), np.log(np.maximum(total, 1))


def _pairs(h: np.ndarray, owner: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """List offsets by row, words and times of the distinct (owner, word hash) pairs."""
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])))) if len(h) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(h)))
    return np.searchsorted(owner[first], np.arange(rows + 1)), h[first], times


_SCORED = "n_tokens long, score double, words array<long>, times array<long>"


def _score(flat: np.ndarray, top: np.ndarray, rank: np.ndarray, word: np.ndarray, log_n: np.ndarray, log_total: np.ndarray):
    def run(batches):
        net = Window(flat)
        for batch in batches:
            n, s = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            rare, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for lo, hi, around, token, row, h in _tokens(batch, top, rank):
                sums = np.zeros(len(token) + 1)
                for a in range(0, len(token), SCORE_BATCH):
                    sums[a + 1 : a + 1 + SCORE_BATCH] = net.log_probs(around[a : a + SCORE_BATCH], token[a : a + SCORE_BATCH])
                hashed = np.flatnonzero(token >= FREQUENT)
                sums[hashed + 1] -= log_total[token[hashed]]
                if len(word):
                    at = np.minimum(np.searchsorted(word, h[hashed]), len(word) - 1)
                    hit = word[at] == h[hashed]
                    sums[hashed[hit] + 1] += log_n[at[hit]]
                    hashed = hashed[~hit]
                rare.append(h[hashed])
                owner.append(lo + np.searchsorted(row, hashed, side="right") - 1)
                sums = np.cumsum(sums)
                n[lo:hi], s[lo:hi] = np.diff(row), sums[row[1:]] - sums[row[:-1]]
            cut, h, times = _pairs(np.concatenate(rare), np.concatenate(owner), batch.num_rows)
            lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x)) for x in (h.view(np.int64), times.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(n), pa.array(s), *lists], ["row", "doc_id", "n_tokens", "score", "words", "times"]
            )

    return run


def score(
    docs: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text",
    counts: DataFrame | None = None, known: int = KNOWN,
) -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, score``, the sum of log P(word | two tokens on either side).

    ``counts`` is the table of ``count_words`` that the model was fitted with, by default that of ``docs``.  A word that it
    lacks counts as seen once.  Null, empty and blank texts have no tokens and score 0.  Rows that repeat a text score
    alike.  Further columns are ignored; an empty table gives an empty result.
    """
    top, rank, flat = model
    counts = count_words(docs, text_col) if counts is None else counts
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("row", F.monotonically_increasing_id())
    schema = f"row long, doc_id {dict(rows.dtypes)['doc_id']}, {_SCORED}"
    # Written, because numbers of rows must not change between the two uses.
    scored = materialise(rows.mapInArrow(_score(flat, top, rank, *_shares(counts, top, known)), schema), "mlm-scored")
    pairs = scored.where(F.size("words") > 0).select("row", F.inline(F.arrays_zip("words", "times")).alias("word", "times"))
    # log 1 = 0: words seen once add nothing here.  Sums of whole billionths don't depend on the order of rows.
    nano = F.round(F.log(F.col("n").cast("double")) * 1e9).cast("long") * F.col("times")
    more = pairs.join(counts.where("n > 1"), "word").groupBy("row").agg(F.sum(nano).alias("nano"))
    out = scored.select("row", "doc_id", "n_tokens", "score").join(more, "row", "left")
    return out.select("doc_id", "n_tokens", (F.col("score") + F.coalesce("nano", F.lit(0)) / 1e9).alias("score"))


def op5_masked_likelihood(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = count_words(docs)
    out = score(docs, fit(docs, counts=counts), counts=counts)
    return out.withColumn("mean_score", F.try_divide("score", "n_tokens"))
