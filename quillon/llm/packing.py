"""Best-fit packing of token sequences by bin completion.

Documents become token ids and an end id; a document that is longer than a sequence is cut into full pieces, but for its
first, which takes what is left.  How many sequences are needed depends only on how many pieces there are of each length,
a table of at most ``capacity`` rows whatever the input.  On that table runs a branch-and-bound search that completes one
sequence after the other: it takes the largest piece left, lists the undominated fillings of the room beside it, fullest
first, and applies a filling to as many sequences as the counts allow.  Branches end where the waste so far and a lower
bound for the rest show that they can't beat the incumbent; incumbents are best-fit solutions, of the whole at the start
and of what a branch leaves.  The outcome is a list of fillings with how often each is used.

Pieces find their places in parallel: a piece's rank among those of its length (its place within its task plus what
earlier tasks have) falls into the span of ranks of one filling, which gives sequence and offset.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.durable import materialise

CAPACITY = 1024
END = 2
#: Nodes of the search, fillings listed at one node, and rows of offsets that are broadcast.
MAX_NODES = 1500
WIDTH = 24
BROADCAST_ROWS = 200_000

Filling = tuple[tuple[int, int], ...]  # (length, times), longest first


# ---- the search -------------------------------------------------------------------------------------------------------


def lower_bound(counts: np.ndarray) -> int:
    """Sequences that any packing needs: for each t, pieces over capacity - t are alone but for pieces below t, those
    over half are in different sequences, and what pieces of at least t lack beside them needs sequences of its own."""
    cap = len(counts) - 1
    sizes = np.arange(cap + 1, dtype=np.int64)
    n, volume = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * sizes)])  # below each length
    t = np.arange(0, cap // 2 + 1)
    over = n[cap + 1] - n[cap - t + 1]  # longer than cap - t
    half = n[cap - t + 1] - n[cap // 2 + 1]
    half_volume = volume[cap - t + 1] - volume[cap // 2 + 1]
    rest = volume[cap // 2 + 1] - volume[t]
    lacking = rest - (half * cap - half_volume)
    return int((over + half + np.maximum(0, -(-lacking // cap))).max())


def best_fit(counts: np.ndarray) -> list[tuple[int, Filling]]:
    """Best-fit decreasing on counts: longest pieces first, each into the fullest sequence that takes it."""
    cap = len(counts) - 1
    open_bins: dict[int, dict[Filling, int]] = {}  # by room left
    rooms = np.zeros(cap + 1, dtype=np.int64)

    def put(room: int, filling: Filling, n: int) -> None:
        if n:
            slot = open_bins.setdefault(room, {})
            slot[filling] = slot.get(filling, 0) + n
            rooms[room] += n

    for size in range(cap, 0, -1):
        c = int(counts[size])
        while c:
            fits = np.flatnonzero(rooms[size:])
            if not len(fits):
                per = cap // size
                put(cap - per * size, ((size, per),), c // per)
                if c % per:
                    put(cap - c % per * size, ((size, c % per),), 1)
                break
            room = size + int(fits[0])
            filling, n = next(iter(open_bins[room].items()))
            per = room // size
            use = min(n, c // per)
            times = per if use else c
            use = use or 1
            open_bins[room][filling] -= use
            rooms[room] -= use
            if not open_bins[room][filling]:
                del open_bins[room][filling]
            put(room - times * size, (*filling, (size, times)), use)
            c -= use * times
    return [(n, f) for slot in open_bins.values() for f, n in slot.items()]


def dominates(a: list[int], b: list[int]) -> bool:
    """Whether the pieces of b can be put into the pieces of a as if these were bins (so a in place of b loses nothing)."""
    if sum(b) > sum(a):
        return False
    if not b:
        return True
    seen = set()
    for i, room in enumerate(a):
        if room >= b[0] and room not in seen:
            seen.add(room)
            if dominates(sorted([*a[:i], room - b[0], *a[i + 1 :]], reverse=True), b[1:]):
                return True
    return False


def _even(counts: np.ndarray, sizes: np.ndarray, room: int, top: int, pieces: int, width: int) -> list[list[int]]:
    """Sets of so many pieces, none over ``top``, that fill the room exactly, the most even ones first."""
    if pieces < 1 or pieces > 8:
        return []
    if pieces == 1:
        return [[room]] if room <= top and counts[room] else []
    options = sizes[(sizes * pieces >= room) & (sizes <= min(top, room - 1))][::-1]
    if pieces == 2:
        options = options[counts[room - options] > 0][:width]
        return [[a, room - a] for a in options.tolist()]
    return [[a, *rest] for a in options[: 2 * width].tolist() for rest in _even(counts, sizes, room - a, a, pieces - 1, width)]


def fillings(counts: np.ndarray, room: int, width: int = WIDTH) -> list[list[int]]:
    """Undominated sets of pieces (lengths, longest first) for the room beside the largest piece: fullest first, then those
    whose smallest pieces are largest, since small pieces are the easiest to place later.

    Sets are grown from their longest piece down; at most ``width`` branches a level and ``8 * width`` sets are followed,
    the longest pieces first; even sets that fill the room exactly are added.  Small tables are listed whole."""
    sizes = np.flatnonzero(counts[: room + 1])[::-1]
    found: list[list[int]] = []
    if not len(sizes):
        return [[]]
    limit = 8 * width

    def grow(taken: list[int], left: int) -> None:
        if len(found) >= limit:
            return
        top = min(left, taken[-1]) if taken else left
        if taken and counts[taken[-1]] <= taken.count(taken[-1]):
            top = min(top, taken[-1] - 1)
        options = sizes[np.searchsorted(-sizes, -top) :]
        if not len(options) or top <= 0:
            found.append(taken)
            return
        # The last piece of a set is best the longest that fits; others leave room for more pieces.
        wide = width if len(taken) < 2 else max(2, width // 8)
        for size in options[:wide].tolist():
            grow([*taken, size], left - size)
            if len(found) >= limit:
                return

    grow([], room)
    top = int(sizes[0])
    for pieces in range(-(-room // top), -(-room // top) + 2):
        found += _even(counts, sizes, room, top, pieces, 2)
    enough = lambda f: all(counts[x] >= f.count(x) for x in set(f[:9]))
    unique = sorted({tuple(f) for f in found if enough(f)}, key=lambda f: (-sum(f), [-x for x in f[::-1]]))
    kept: list[list[int]] = []
    for f in unique:
        if len(kept) >= width:
            break
        if len(f) > 8 or not any(len(k) <= 8 and dominates(k, list(f)) for k in kept):
            kept.append(list(f))
    return kept


@dataclass
class Search:
    """Bin completion over counts by length; ``plan`` is the best solution found, ``proven`` if nothing can beat it."""

    counts: np.ndarray
    max_nodes: int = MAX_NODES
    width: int = WIDTH
    plan: list[tuple[int, Filling]] = field(default_factory=list)
    nodes: int = 0
    proven: bool = False

    def solve(self) -> Search:
        counts = self.counts.astype(np.int64).copy()
        cap = len(counts) - 1
        fixed: list[tuple[int, Filling]] = []
        # Full pieces, and pairs that fill a sequence exactly, are in some best packing.
        for size in range(cap, (cap - 1) // 2, -1):
            other = cap - size
            n = int(counts[size] // 2 if size == other else counts[size] if not other else min(counts[size], counts[other]))
            if n:
                fixed.append((n, ((size, 1),) if not other else ((size, 2),) if size == other else ((size, 1), (other, 1))))
                counts[size] -= n * (1 + (size == other))
                if other and size != other:
                    counts[other] -= n
        self.floor = lower_bound(counts)
        self.incumbent = best_fit(counts)
        self.most = sum(n for n, _ in self.incumbent)
        self.seen: set[bytes] = set()
        complete = self._branch(counts, [], 0) if self.most > self.floor else True
        self.proven = self.most <= self.floor or complete
        self.plan = fixed + self.incumbent
        return self

    def _branch(self, root: np.ndarray, path: list, used: int) -> bool:
        """Depth first with a stack of iterators; False if the node budget ran out."""
        stack = [(root, path, used, self._children(root))]
        while stack:
            counts, path, used, children = stack[-1]
            step = next(children, None)
            if step is None:
                stack.pop()
                continue
            n, filling = step
            left, now = counts.copy(), used + n
            for size, times in filling:
                left[size] -= n * times
            if not left.any():
                if now < self.most:
                    self.most, self.incumbent = now, [*path, step]
                continue
            if now + lower_bound(left) >= self.most or (key := left.tobytes()) in self.seen:
                continue
            if self.nodes >= self.max_nodes:
                return False
            self.nodes += 1
            self.seen.add(key)
            if self.nodes % 16 == 1:
                rest = best_fit(left)
                if (total := now + sum(m for m, _ in rest)) < self.most:
                    self.most, self.incumbent = total, [*path, step, *rest]
            if self.most <= self.floor:
                return True
            stack.append((left, [*path, step], now, self._children(left)))
        return True

    def _children(self, counts: np.ndarray):
        """Fillings of the next sequence, as often as they go; then, for an exact search, once each."""
        cap = len(counts) - 1
        largest = int(np.flatnonzero(counts)[-1])
        beside = counts.copy()
        beside[largest] -= 1
        once = []
        for extra in fillings(beside, cap - largest, self.width):
            sizes, times = np.unique([largest, *extra], return_counts=True)
            filling = tuple(zip(sizes[::-1].tolist(), times[::-1].tolist()))
            n = int((counts[sizes] // times).min())
            yield n, filling
            if n > 1:
                once.append((1, filling))
        yield from once


# ---- tokens and pieces ------------------------------------------------------------------------------------------------


@lru_cache(maxsize=2)
def _encoder(vocab_path: str):
    """Ids of a text by the byte-level BPE of a ``tokenizers`` file.

    Its merges stand in the order of their ids, so the same table drives tiktoken's encoder, which is several times as
    fast; where a file is of another kind, its own library encodes."""
    with open(vocab_path, encoding="utf-8") as f:
        spec = json.load(f)
    model, vocab = spec["model"], spec["model"]["vocab"]
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    if all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges)) and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not spec["pre_tokenizer"].get("add_prefix_space") and not spec.get("normalizer"):
        import tiktoken

        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in word): i for word, i in vocab.items() if word not in special}
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        e = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        return lambda text: e.encode(text, allowed_special="all")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocab_path)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def _cut(vocab_path: str, capacity: int, end: int):
    """Pieces of each document, and each piece's rank among those of its length within this task."""
    names = ["id", "piece", "start", "length", "task", "rank", "ids"]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]

    def run(batches):
        from pyspark import TaskContext

        encode, task, seen = _encoder(vocab_path), TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            rows, held = [], 0
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.array([*(encode(text) if text else ()), end], dtype="<u4")
                first = (len(ids) - 1) % capacity + 1
                for piece, start in enumerate([0, *range(first, len(ids), capacity)]):
                    part = ids[start : start + (capacity if piece else first)]
                    rows.append((key, piece, start, len(part), task, int(seen[len(part)]), part.tobytes()))
                    seen[len(part)] += 1
                held += len(ids)
                if held > 1 << 20:
                    yield _batch(rows, names, kinds)
                    rows, held = [], 0
            yield _batch(rows, names, kinds)

    return run


def _batch(rows, names, kinds):
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_pieces(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """``id, piece, start, length, task, rank, ids`` (little-endian unsigned 32-bit), written once.

    The rank of a piece is that within the task that wrote it, so the table must be read back, not computed again."""
    d = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    schema = "id string, piece int, start long, length int, task int, rank long, ids binary"
    return materialise(d.mapInArrow(_cut(vocab_path, capacity, end), schema), "packing-pieces")


def place(pieces: DataFrame, capacity: int = CAPACITY, max_nodes: int = MAX_NODES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to (length, task, rank, ...), as few sequences as the search finds.

    Sequences are numbered by filling; offsets are gapless from 0.  The table of counts has at most ``capacity`` rows;
    the plan has one row per filling and length."""
    spark = pieces.sparkSession
    counted = materialise(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "packing-counts")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r.length] = r.n
    plan, base, used = [], 0, np.zeros(capacity + 1, dtype=np.int64)
    for n, filling in Search(counts, max_nodes).solve().plan:
        offset = 0
        for length, times in filling:
            first = int(used[length])
            used[length] += n * times
            plan.append((length, first, int(used[length]), times, base, offset))
            offset += length * times
        base += n
    plan = spark.createDataFrame(plan, "length int, low long, high long, times int, base long, at int")
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    if counted.limit(broadcast_rows + 1).count() <= broadcast_rows:
        before = F.broadcast(before)
    d = pieces.join(before, ["length", "task"]).withColumn("global", F.col("rank") + F.col("before"))
    d = d.join(F.broadcast(plan), "length").where("global >= low and global < high")
    within = F.col("global") - F.col("low")
    sequence = F.col("base") + F.floor(within / F.col("times"))
    offset = F.col("at") + (within % F.col("times")) * F.col("length")
    return d.withColumns({"sequence_id": sequence.cast("long"), "offset": offset.cast("long")}).drop("global", "before", "low", "high", "times", "base", "at", "task", "rank")


def pack(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, max_nodes: int = MAX_NODES) -> DataFrame:
    """One row per piece: ``id`` (as text), ``piece, start, length, ids, sequence_id, offset``.

    Null and empty texts are one piece, the end id.  Repeated rows are documents of their own, null ids included; texts
    are cut whole, at any length.  Further columns are ignored; empty input, empty output.  The strings of the file's
    special tokens become their ids, as the file's own library does it."""
    return place(token_pieces(docs, vocab_path, id_col, text_col, capacity, end), capacity, max_nodes)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, starts``: the ids of each sequence in order, and where its pieces begin.

    A sequence has at most ``capacity`` pieces, so a row stays small."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    d = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return d.select("sequence_id", ids.alias("ids"), F.transform("parts", lambda p: p["offset"]).alias("starts"))


def op13_bin_completion_packing(spark, sf_dir: str) -> DataFrame:
    pieces = token_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_vocabulary())
    # The digest is taken before pieces are placed, so that no ids travel.
    d = place(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return d.select(F.col("id").cast("long").alias("doc_id"), "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
