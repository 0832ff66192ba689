"""Language identification with segmentation-marginalised unigrams.

A language gives each piece of a fixed public vocabulary a probability.  The probability of a word is the sum over all
ways to cut it into pieces, found by a forward algorithm over its UTF-8 bytes; a text's score is the sum of its words'
log probabilities.  Piece probabilities are expected counts under the same sum (forward-backward), a few rounds of
expectation-maximisation from a uniform start.

Words are runs of lower-cased ASCII letters and non-ASCII bytes; a piece that opens a word (marked in the vocabulary) is
told apart from the same bytes inside a word, and every byte is a piece of its own, so each word has a segmentation.
Each distinct word of a batch is segmented once; a bounded table keeps the scores of words seen before.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from quillon.llm import text as T
from quillon.llm.durable import materialise

LONGEST = 16  # bytes of a piece
ROUNDS = 3
SMOOTHING = 0.05
#: Bytes of a run of letters that are segmented together; longer runs (unspaced scripts) are read as parts, cut between code
#: points, so that the forward pass goes over many parts at once and takes as many steps as a part has bytes.
PART = 192
CACHE_WORDS = 400_000
BLOCK_WORDS = 40_000
#: Bytes of the words that forward-backward holds at once; each needs about 50 bytes of tables.
BLOCK_BYTES = 1 << 20
#: Bytes of text whose words are scored at once; a worker keeps the memory that this takes for the stages after it.
CHUNK = 1 << 19
#: The fit uses about this many documents per language, chosen by a hash of their id; see ``fit``.
DOCS_PER_LANGUAGE = 2_000
UNKNOWN = "und"

LETTERS = np.zeros(256, dtype=bool)
LETTERS[0x61:0x7B] = LETTERS[0x80:] = True
_OPENING = np.uint64(0x5851F42D4C957F2D)


def vocabulary(path: str) -> list[tuple[bytes, bool]]:
    """(bytes, opens a word) of the usable pieces of a sentencepiece model: letters only, in lower case, plus all bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {(bytes([b]), False) for b in range(256)} | {(b"", True)}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i)
        opens, body = piece.startswith("▁"), piece.removeprefix("▁")
        raw = body.encode()
        if body and body == body.lower() and len(raw) <= LONGEST and LETTERS[np.frombuffer(raw, np.uint8)].all():
            pieces.add((raw, opens))
    return sorted(pieces)


class Pieces:
    """Hash lookup of pieces; number ``len(self)`` stands for no piece."""

    def __init__(self, pieces: list[tuple[bytes, bool]]) -> None:
        with np.errstate(over="ignore"):
            size = np.array([len(raw) for raw, _ in pieces], dtype=np.int64)
            end = np.cumsum(size)
            h = T.span_hash(T.prefix_hash(np.frombuffer(b"".join(raw for raw, _ in pieces), np.uint8)), end - size, end)
            h[[opens for _, opens in pieces]] ^= _OPENING
        self.n, bits = len(pieces), 18
        while True:  # at most two pieces in a slot
            slot = h >> np.uint64(64 - bits)
            if np.bincount(slot.astype(np.int64)).max() <= 2:
                break
            bits += 1
        self.shift = np.uint64(64 - bits)
        order = np.argsort(slot, kind="stable")
        slot = slot[order].astype(np.int64)
        lead = np.concatenate(([True], slot[1:] != slot[:-1]))
        second = np.flatnonzero(~lead)
        self.first = np.full(1 << bits, self.n, dtype=np.int32)
        self.first[slot[lead]] = order[lead]
        self.key = np.concatenate((h, [np.uint64(0)]))
        self.other = np.full(self.n + 1, self.n, dtype=np.int32)
        self.other[order[second - 1]] = order[second]
        self.bare = pieces.index((b"", True))

    def __len__(self) -> int:
        return self.n

    def find(self, h: np.ndarray) -> np.ndarray:
        at = self.first[h >> self.shift]
        miss = np.flatnonzero(self.key[at] != h)
        if len(miss):
            second = self.other[at[miss]]
            at[miss] = np.where(self.key[second] == h[miss], second, self.n)
        return at


@lru_cache(maxsize=2)
def load_pieces(path: str) -> Pieces:
    return Pieces(vocabulary(path))


def _cuts(pieces: Pieces, prefix: np.ndarray, start: np.ndarray, i: int) -> list[tuple[int, np.ndarray]]:
    """(length, piece numbers) of the pieces that end at byte i of the words; length -1 opens the word."""
    out = []
    for n in range(1, min(i, LONGEST) + 1):
        h = T.span_hash(prefix, start + (i - n), start + i)
        out.append((n, pieces.find(h)))
        if n == i:
            out.append((-1, pieces.find(h ^ _OPENING)))
    return out


def word_scores(pieces: Pieces, prob: np.ndarray, prefix: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """log P(word | language), one row per word, one column per column of ``prob`` (pieces + 1 rows, the last zero)."""
    out = np.zeros((len(start), prob.shape[1]))
    order = np.argsort(length, kind="stable")
    for lo in range(0, len(order), BLOCK_WORDS):
        block = order[lo : lo + BLOCK_WORDS]
        s, size = start[block], length[block]
        scale = np.zeros((len(block), prob.shape[1]))
        alpha = {0: np.tile(prob[pieces.bare], (len(block), 1))}
        for i in range(1, int(size[-1]) + 1):
            on = int(np.searchsorted(size, i))
            acc = np.zeros((len(block), prob.shape[1]))
            for n, at in _cuts(pieces, prefix, s[on:], i):
                if n < 0:
                    acc[on:] += prob[at]
                else:
                    acc[on:] += alpha[i - n][on:] * prob[at]
            alpha[i] = acc
            alpha.pop(i - LONGEST, None)
            done = int(np.searchsorted(size, i, side="right"))
            out[block[on:done]] = np.log(acc[on:done]) + scale[on:done]
            if i % LONGEST == 0:  # keep the numbers in range, for each word and language
                top = np.max(list(alpha.values()), axis=0)
                top[top == 0] = 1
                for a in alpha.values():
                    a /= top
                scale += np.log(top)
    return out


def expected_counts(pieces: Pieces, prob: np.ndarray, prefix: np.ndarray, start: np.ndarray, length: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece, over all segmentations of words that occur ``times`` times (one language)."""
    total = np.zeros(len(pieces) + 1)
    order = np.argsort(length, kind="stable")
    for size in np.unique(length):
        group = order[np.searchsorted(length[order], size) : np.searchsorted(length[order], size, side="right")]
        size = int(size)
        block = max(1, min(BLOCK_WORDS, BLOCK_BYTES // max(size, 1)))
        for lo in range(0, len(group), block):
            s, w = start[group[lo : lo + block]], times[group[lo : lo + block]]
            cuts = [None] + [_cuts(pieces, prefix, s, i) for i in range(1, size + 1)]
            alpha = np.zeros((size + 1, len(s)))
            alpha[0] = prob[pieces.bare]
            # Logarithms of each word's scale: words of one length differ too much to share one.
            grow = np.zeros((size + 1, len(s)))
            for i in range(1, size + 1):
                for n, at in cuts[i]:
                    alpha[i] += prob[at] * (np.exp(-grow[i - 1]) if n < 0 else alpha[i - n] * np.exp(grow[i - n] - grow[i - 1]))
                step = np.where(alpha[i] > 0, alpha[i], 1.0)
                alpha[i] /= step
                grow[i] = grow[i - 1] + np.log(step)
            beta = np.zeros((size + 1, len(s)))
            beta[size] = np.where(alpha[size] > 0, w, 0.0)  # alpha[size] is 1 after scaling
            for i in range(size, 0, -1):
                for n, at in cuts[i]:
                    if n < 0:
                        total += np.bincount(at, prob[at] * beta[i] * np.exp(-grow[i]), len(total))
                    else:
                        part = prob[at] * beta[i] * np.exp(grow[i - n] - grow[i])
                        beta[i - n] += part
                        total += np.bincount(at, part * alpha[i - n], len(total))
            total[pieces.bare] += float((beta[0] * alpha[0]).sum())
    return total[:-1]


def _words_of(batch_text, lo, hi, data, offsets):
    low = data[offsets[lo] : offsets[hi]]
    bounds = offsets[lo : hi + 1] - offsets[lo]
    w = T.words(low, bounds, LETTERS)
    far = np.flatnonzero(w.end - w.start > PART)
    if not len(far):
        return w, low
    cuts = []
    for a, b in zip(w.start[far].tolist(), w.end[far].tolist()):
        at = a + PART
        while at < b:
            while low[at] & 0xC0 == 0x80:  # inside a code point
                at -= 1
            cuts.append(at)
            at += PART
    start, end = np.sort(np.concatenate((w.start, cuts))).astype(np.int64), np.sort(np.concatenate((w.end, cuts))).astype(np.int64)
    return T.Words(start, end, T.span_hash(T.prefix_hash(low), start, end), np.searchsorted(start, bounds)), low


def _count_words(batches):
    """(lang, word, n) of the distinct words of each batch and language."""
    for batch in batches:
        data, offsets = T.utf8(batch.column("text"))
        lang = batch.column("lang").to_numpy(zero_copy_only=False)
        for lo, hi in T.chunks(offsets, CHUNK):
            with np.errstate(over="ignore"):
                w, low = _words_of(batch, lo, hi, data, offsets)
            codes, names = np.unique(lang[lo:hi].astype(str), return_inverse=True)
            owner = np.repeat(names, np.diff(w.row))
            raw = low.tobytes()
            for g, name in enumerate(codes):
                mine = np.flatnonzero(owner == g)
                _, first, n = np.unique(w.hash[mine], return_index=True, return_counts=True)
                spots = mine[first]
                words = [raw[a:b] for a, b in zip(w.start[spots].tolist(), w.end[spots].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([str(name)] * len(words), pa.string()), pa.array(words, pa.binary()), pa.array(n.astype(np.int64))],
                    ["lang", "word", "n"],
                )


def _expect(path: str, languages: list[str], prob: np.ndarray):
    def run(batches):
        pieces = load_pieces(path)
        total = np.zeros((len(languages), len(pieces)))
        for batch in batches:
            data, offsets = T.utf8(batch.column("word"))
            base = offsets[0]
            data, offsets = data[base : offsets[-1]], offsets - base
            lang = batch.column("lang").to_numpy(zero_copy_only=False)
            n = batch.column("n").to_numpy().astype(float)
            with np.errstate(over="ignore"):
                prefix = T.prefix_hash(data)
                for g, name in enumerate(languages):
                    mine = np.flatnonzero(lang == name)
                    total[g] += expected_counts(pieces, prob[:, g], prefix, offsets[mine], np.diff(offsets)[mine], n[mine])
        g, piece = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(g.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(total[g, piece])], ["g", "piece", "n"]
        )

    return run


def fit(
    labelled: DataFrame, path: str, docs_per_language: int = DOCS_PER_LANGUAGE, rounds: int = ROUNDS,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> tuple[list[str], np.ndarray]:
    """Languages and their piece probabilities, an array of (pieces + 1) x languages whose last row is zero.

    A language with more than ``docs_per_language`` labelled rows is represented by the rows whose hashed id falls below
    docs_per_language / rows, about that many; the bound keeps the fit small, all other work covers every row.  Rows
    without text or language are not used.
    """
    rows = labelled.select(
        F.xxhash64(F.lit("langid"), F.col(id_col).cast("string")).alias("h"),
        F.lower(F.col(text_col)).alias("text"),
        F.col(lang_col).alias("lang"),
    ).where("text is not null and lang is not null")
    sizes = rows.groupBy("lang").count().collect()
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        return [], np.zeros((len(load_pieces(path)) + 1, 0))
    limit = F.lit(0.0)
    for r in sizes:
        limit = F.when(F.col("lang") == r["lang"], F.lit(min(1.0, docs_per_language / r["count"]))).otherwise(limit)
    sample = rows.where(F.pmod("h", F.lit(1 << 40)) < limit * float(1 << 40)).select("lang", "text")
    counts = sample.mapInArrow(_count_words, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "langid-words")
    size = len(load_pieces(path))
    prob = np.zeros((size + 1, len(languages)))
    prob[:size] = 1 / size
    for _ in range(rounds):
        got = counts.mapInArrow(_expect(path, languages, prob), "g int, piece int, n double").groupBy("g", "piece").agg(F.sum("n").alias("n"))
        got = got.toPandas()
        c = np.full((size, len(languages)), SMOOTHING)
        np.add.at(c, (got["piece"].to_numpy(), got["g"].to_numpy()), got["n"].to_numpy())
        prob[:size] = c / c.sum(axis=0)
    return languages, prob


def _predict(path: str, languages: list[str], prob: np.ndarray):
    names = np.array([*languages, UNKNOWN], dtype=object)

    def run(batches):
        pieces = load_pieces(path)
        known_hash, known = np.zeros(0, np.uint64), np.zeros((0, len(languages)))
        for batch in batches:
            data, offsets = T.utf8(batch.column("text"))
            letter = batch.column("letter").to_numpy(zero_copy_only=False).astype(bool)
            lang, score = np.full(len(letter), len(languages)), np.zeros(len(letter))
            for lo, hi in T.chunks(offsets, CHUNK):
                with np.errstate(over="ignore", divide="ignore"):
                    w, low = _words_of(batch, lo, hi, data, offsets)
                    uniq, first, back = np.unique(w.hash, return_index=True, return_inverse=True)
                    table = np.zeros((len(uniq), len(languages)))
                    at = np.minimum(np.searchsorted(known_hash, uniq), max(len(known_hash) - 1, 0))
                    old = known_hash[at] == uniq if len(known_hash) else np.zeros(len(uniq), bool)
                    table[old] = known[at[old]]
                    new = np.flatnonzero(~old)
                    if len(new):
                        start = w.start[first[new]]
                        size = w.end[first[new]] - start
                        at = np.cumsum(size) - size  # the new words, end to end
                        together = low[np.repeat(start - at, size) + np.arange(size.sum())]
                        table[new] = word_scores(pieces, prob, T.prefix_hash(together), at, size)
                    if len(known_hash) < CACHE_WORDS and len(new):
                        new = new[: CACHE_WORDS - len(known_hash)]
                        both = np.concatenate((known_hash, uniq[new]))
                        order = np.argsort(both)
                        known_hash, known = both[order], np.concatenate((known, table[new]))[order]
                    sums = np.zeros((len(w.hash) + 1, len(languages)))
                    np.cumsum(table[back], axis=0, out=sums[1:])
                    total = sums[w.row[1:]] - sums[w.row[:-1]]
                if len(languages):
                    best = total.argmax(axis=1)
                    post = 1 / np.exp(total - total.max(axis=1)[:, None]).sum(axis=1)
                    ok = letter[lo:hi]
                    lang[lo:hi] = np.where(ok, best, len(languages))
                    score[lo:hi] = np.where(ok, post, 0.0)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in batch.schema.names if c not in ("text", "letter")), pa.array(names[lang], pa.string()), pa.array(score)],
                [*(c for c in batch.schema.names if c not in ("text", "letter")), "lang_pred", "score"],
            )

    return run


def _seen(text_col: str) -> list[Column]:
    """What the model sees of a row: the lower-cased text, and whether it has a letter of any script."""
    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    return [F.lower(F.col(text_col)).alias("text"), letter.alias("letter")]


def identify(docs: DataFrame, path: str, languages: list[str], prob: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, lang_pred, score``; only the text is looked at.

    ``score`` is the posterior of the predicted language under equal priors.  Null texts and texts without a letter (any
    script) are "und" with score 0; so is everything if no language was learned.  A text whose letters are all outside
    the learned pieces still gets the language that gives its bytes the most.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), *_seen(text_col))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(_predict(path, languages, prob), f"doc_id {kind}, lang_pred string, score double")


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op6_segmentation_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = default_vocabulary()
    languages, prob = fit(docs.where(~held_out()), path)
    return identify(docs, path, languages, prob).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, path: str, min_score: float = 0.4, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without rows whose language is "und" or whose score is below ``min_score``; columns as in ``docs``.

    The model is fitted on the rows with a language.  Rows are judged by their text alone, so equal texts share a fate,
    and null and repeated ids do no harm."""
    languages, prob = fit(docs, path, id_col=id_col, text_col=text_col, lang_col=lang_col)
    # Whole rows go past the model and come back, so nothing is shuffled or joined.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_seen(text_col))
    kinds = StructType([StructField("row", docs.schema), StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    judged = rows.mapInArrow(_predict(path, languages, prob), kinds)
    return judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)).select("row.*")
