"""Spelling variants: words one edit apart, found by a positional q-gram index, and the form each of them goes back to.

Every occurrence of a word is counted where it is read; only the vocabulary is shuffled.  A word of L code points, padded
on both sides, has L + Q - 1 grams of Q code points.  One edit spoils at most Q of them and moves the others by at most
one place, so two near words, the longer one of L, share at least L - 1 grams at places that differ by at most one.

The index is dealt by *signatures*: a word's Q + 1 rarest grams (by number of words, then by code points).  Near words
have a gram of their signatures in common, so a word is posted under its own length at each of them and looks there, and
under the next length, for partners.  A gram of very many words is dealt to several blocks: a word is posted in one of
them and looks in all.  In each block, a word's posting lists within the limits of place and length are merged with a
heap that jumps over words which can't reach the bound; what reaches it is verified.  A pair comes out at the first
gram that both signatures share and nowhere else.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.durable import materialise, shuffled

Q = 5
#: Words of one gram and length that one block of the index holds, about.
BLOCK = 2000
MIN_LENGTH = 6
MIN_COUNT = 5
FORM_FACTOR = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Padding, outside the letters.
_HEAD, _TAIL = "^", "$"


def one_edit(a: str, b: str) -> bool:
    """Whether a becomes b by exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def occurrences(docs: DataFrame, id_col: str, text_col: str, min_length: int, damage: int | None) -> DataFrame:
    """``word`` for every run of letters of at least ``min_length`` code points, A-Z lower-cased.

    With ``damage``, runs whose crc32 of ``id:run`` is divisible by it lose the code point at crc32 % length."""
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), _UPPER, _LOWER)
    runs = F.regexp_extract_all(text, F.lit(f"[a-zÀ-ÿ]{{{min_length},}}"), F.lit(0))
    d = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    if damage is None:
        return d.select(F.col("run").alias("word"))
    d = d.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    cut = F.expr("concat(left(run, cast(h % length(run) as int)), substring(run, cast(h % length(run) as int) + 2))")
    d = d.select(F.when(F.col("h") % damage == 0, cut).otherwise(F.col("run")).alias("word"))
    return d.where(F.length("word") >= min_length)


def signatures(words: DataFrame, q: int = Q) -> DataFrame:
    """``word, n, grams``: (gram, words that hold it, place) of each word's q + 1 rarest grams, rarest first."""
    padded = F.concat(F.lit(_HEAD * (q - 1)), "word", F.lit(_TAIL * (q - 1)))
    places = F.sequence(F.lit(1), F.length("word") + (q - 1))
    grams = words.select("word", "n", padded.alias("padded"), F.explode(places).alias("place"))
    grams = grams.select("word", "n", F.substring("padded", F.col("place"), F.lit(q)).alias("gram"), (F.col("place") - 1).alias("place"))
    df = grams.groupBy("gram").agg(F.count("*").alias("df"))
    ranked = shuffled(grams).join(df, "gram").groupBy("word", "n").agg(F.sort_array(F.collect_list(F.struct("df", "gram", "place"))).alias("grams"))
    return ranked.select("word", "n", F.slice("grams", 1, q + 1).alias("grams"))


def _postings(signed: DataFrame, block: int) -> DataFrame:
    """A row for each block of the index that a word is posted in (``own``) or only looks in."""
    d = signed.withColumn("places", F.transform("grams", lambda g: g["place"]))
    one = F.array_distinct(F.transform("grams", lambda g: F.struct(g["gram"].alias("gram"), (1 + F.floor(g["df"] / block)).cast("int").alias("blocks"))))
    d = d.select("word", "n", "places", F.explode(one).alias("g"))
    mine = F.pmod(F.xxhash64("word"), F.col("g.blocks")).cast("int")
    d = d.select("word", "n", "places", F.col("g.gram").alias("gram"), mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("g.blocks") - 1)).alias("block"))
    d = d.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("longer"))
    own = (F.col("longer") == 0) & (F.col("mine") == F.col("block"))
    return d.select("gram", (F.length("word") + F.col("longer")).alias("length"), "block", own.alias("own"), "word", "n", "places")


def _grams(word: str, q: int) -> list[str]:
    padded = _HEAD * (q - 1) + word + _TAIL * (q - 1)
    return [padded[i : i + q] for i in range(len(word) + q - 1)]


def merge_skip(lists: list[list[int]], least: int) -> list[int]:
    """Values that occur in at least ``least`` of the sorted lists, by a heap of the lists' heads.

    When the smallest head is in too few lists, least - 1 heads are taken off and their lists jump to the head that is
    left, since nothing before it can occur often enough."""
    if len(lists) < least:
        return []
    out, at = [], [0] * len(lists)
    heap = [(x[0], k) for k, x in enumerate(lists)]
    heapify(heap)
    while len(heap) >= least:
        low, taken = heap[0][0], []
        while heap and heap[0][0] == low:
            taken.append(heappop(heap)[1])
        if len(taken) >= least:
            out.append(low)
            goal = low + 1
        else:
            while len(taken) < least - 1:
                taken.append(heappop(heap)[1])
            goal = heap[0][0]
        for k in taken:
            at[k] = bisect_left(lists[k], goal, at[k])
            if at[k] < len(lists[k]):
                heappush(heap, (lists[k][at[k]], k))
    return out


class _Block:
    """The positional index over the words posted in one block."""

    def __init__(self, gram: str, length: int, q: int):
        self.gram, self.length, self.q = gram, length, q
        self.rows: list[tuple] = []
        self.index: dict | None = None

    def build(self) -> None:
        self.index = defaultdict(list)
        for i, (word, _, _) in enumerate(self.rows):
            for place, gram in enumerate(_grams(word, self.q)):
                self.index[gram, place].append(i)

    def look(self, word: str, n: int, places: list[int]):
        """Verified partners of a word: those of its own length that come after it, and all that are longer."""
        grams, get = _grams(word, self.q), self.index.get
        lists = []
        for place, gram in enumerate(grams):
            near = [x for x in (get((gram, place - 1)), get((gram, place)), get((gram, place + 1))) if x]
            if near:
                lists.append(near[0] if len(near) == 1 else sorted(set().union(*near)))
        same = len(word) == self.length
        for i in merge_skip(lists, self.length - 1):
            other, m, others = self.rows[i]
            if (same and other <= word) or not one_edit(word, other):
                continue
            theirs = _grams(other, self.q)
            theirs = {theirs[p] for p in others}
            if next(g for g in (grams[p] for p in places) if g in theirs) == self.gram:
                yield word, n, other, m


def _pairs(q: int):
    names = ["a", "n_a", "b", "n_b"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]

    def batch_of(found):
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kinds[k]) for k in range(4)], names)

    def run(batches):
        """Rows come sorted by block, those posted in it first."""
        key, block, found = None, None, []
        for batch in batches:
            for gram, length, number, own, word, n, places in zip(*(batch.column(c).to_pylist() for c in batch.schema.names)):
                if key != (gram, length, number):
                    if block is not None and block.index is None:
                        block.build()
                        for row in block.rows:
                            found.extend(block.look(*row))
                    key, block = (gram, length, number), _Block(gram, length, q)
                if own:
                    block.rows.append((word, n, places))
                    continue
                if block.index is None:
                    block.build()
                    for row in block.rows:
                        found.extend(block.look(*row))
                if block.rows:
                    found.extend(block.look(word, n, places))
            if found:
                yield batch_of(found)
                found = []
        if block is not None and block.index is None:
            block.build()
            for row in block.rows:
                found.extend(block.look(*row))
        yield batch_of(found)

    return run


def near_pairs(words: DataFrame, q: int = Q, block: int = BLOCK) -> DataFrame:
    """``a, n_a, b, n_b``: every pair of distinct words one edit apart, once, from (word, n)."""
    rows = _postings(signatures(words, q), block).repartition("gram", "length", "block")
    rows = rows.sortWithinPartitions("gram", "length", "block", F.desc("own"))
    return rows.mapInArrow(_pairs(q), "a string, n_a long, b string, n_b long")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` from (word, form): the last word of each chain of forms; null form ends a chain.

    Pointers are doubled, so rounds grow with the logarithm of the longest chain; a chain is short, as counts rise by a
    factor from word to form."""
    up = materialise(forms.where("form is not null").select("word", F.col("form").alias("root")), "spelling-up-0")
    step = 0
    while True:
        step += 1
        over = up.select(F.col("word").alias("root"), F.col("root").alias("top"))
        up = materialise(shuffled(up).join(over, "root", "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), f"spelling-up-{step}")
        if up.where("moved").isEmpty():
            break
        up = up.select("word", "root")
    return up.select("word", "root")


def spelling_variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    factor: int = FORM_FACTOR,
    damage: int | None = None,
    q: int = Q,
    block: int = BLOCK,
) -> DataFrame:
    """One row per word: ``word, form, root, n, n_near, form_n``.

    Words are runs of letters (A-Z, a-z, U+00C0 to U+00FF; A-Z lower-cased) of at least ``min_length`` code points that
    occur at least ``min_count`` times in all texts.  The form is the near word with the largest n (ties: the first in
    code-point order) if it is at least ``factor`` times the word's own, else null.  Repeated rows count again; null and
    empty texts have no words; null ids count as the empty string; texts are read whole; further columns are ignored.
    No words give no rows.  ``factor`` must be over 1, so that chains of forms end.
    """
    if factor <= 1:
        raise ValueError("factor must be over 1")
    words = occurrences(docs, id_col, text_col, min_length, damage).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    words = materialise(words, "spelling-words")
    pairs = materialise(near_pairs(words, q, block), "spelling-pairs")
    ends = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    both = pairs.select(F.inline(ends))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    enough = -F.col("best.less") >= factor * F.col("n")
    d = shuffled(words).join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"),
    )
    d = materialise(d, "spelling-forms")
    return shuffled(d).join(roots(d), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"), damage=199)


#: crc32 from its rule (a table of 256 by eight shifts), then near words by deletion of one code point.
SQL = r"""
with recursive bits as (select i as v, i, 0 as k from range(256) t(i) union all
  select case when (v & 1) = 1 then xor(v >> 1, 3988292384) else v >> 1 end, i, k + 1 from bits where k < 8),
crc as materialized (select list(v order by i) as t from bits where k = 8),
runs as materialized (select coalesce(doc_id::varchar, '') as id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as n
  from (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) as run from documents)
  where length(run) >= 6 group by all),
hexed as (select *, hex(encode(id || ':' || run)) as x from runs),
hashed as (select id, run, n, xor(list_reduce(list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::bigint),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295::bigint), 4294967295) as h from hexed, crc),
words as materialized (select word, sum(n)::bigint as n from (
    select case when h % 199 = 0 then run[1 : (h % length(run))::int] || run[(h % length(run))::int + 2 :] else run end as word, n from hashed)
  where length(word) >= 6 group by word having sum(n) >= 5),
cut as materialized (select word, i, word[1 : i] || word[i + 2 :] as rest from (select word, unnest(range(length(word))) as i from words)),
pairs as (select a.word as a, b.word as b from cut a join cut b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select w.word, c.word from cut c join words w on c.rest = w.word
  union select c.word, w.word from cut c join words w on c.rest = w.word),
best as (select a as word, count(*) as n_near, min({'less': -w.n, 'near': b}) as best from pairs join words w on w.word = b group by a),
forms as materialized (select words.word, words.n, coalesce(n_near, 0) as n_near,
    case when -best.less >= 5 * words.n then best.near end as form, case when -best.less >= 5 * words.n then -best.less end as form_n
  from words left join best using (word)),
chain as (select word, word as root, 0 as k from forms union all
  select chain.word, f.form, k + 1 from chain join forms f on f.word = chain.root where f.form is not null),
last as (select word, arg_max(root, k) as root from chain group by word)
select word, form, root, n, n_near, form_n from forms join last using (word)
"""
