"""Removal of repeated byte strings with suffix arrays.

A byte goes if a string of LENGTH bytes that covers it also starts earlier (smaller id, or earlier in the document).
Every such string has an *anchor*, its smallest GRAM-byte hash (the first of equals), and equal strings have equal anchors at equal places.
So strings are dealt to shards by anchor, equal strings meet in one shard, and only there are suffixes sorted:

1. One pass cuts each text into *contexts*: an anchor with all the strings it is the anchor of, LENGTH to LENGTH + 84
   bytes.  Equal contexts of one batch are combined there, byte by byte; of the others only hashes travel, packed.  Asked
   for are contexts whose hash occurs again, and contexts that share an anchor and half of what a common string must hold
   beside it.  Hashes only say which contexts to look at: nothing is removed before its bytes were compared.
2. The texts of the asked contexts are cut out and dealt to shards by anchor; an anchor with more bytes than a shard may
   hold is dealt to several, each a group of its own.
3. Each shard combines contexts with equal bytes, covering all but the earliest, and builds a suffix array over the rest
   by Larsson-Sadakane refinement and the common prefixes by Kasai's method, in numpy; suffixes that agree on LENGTH
   bytes form a group, and all but its earliest are covered.  A shard has a bounded size; where one anchor fills several,
   their distinct strings meet once more, dealt by the string's hash and compared byte by byte, and again all but the
   earliest are covered.
4. The covered ranges of a document meet its text again and are cut out.

Anchors are chosen by the upper bits of the hash and then by place, the same number of bits for every text, so equal
strings choose equal anchors wherever they stand.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import text as T
from quillon.llm.durable import materialise

LENGTH = 100
GRAM = 16
SHARD_BYTES = 2 << 20
BROADCAST_IDS = 500_000
STRING_GROUPS = 64
#: Low bits of a hash that give way to the place; a longer text is cut into overlapping pieces.
PLACE_BITS = 24
#: Bytes of text that one group of documents should hold, however few partitions a shuffle has.
GROUP_BYTES = 8 << 20
#: Bytes of a batch's text whose contexts are held at once.
SLICE_BYTES = 4 << 20
#: Strings packed at once.
STRINGS_AT_ONCE = 1 << 16
#: Marks a context's size if it may share strings with another context.
_SEARCHED = 1 << 16

_PACKED = "kind int, dest long, a binary, b binary, c binary, d binary, e binary"
_ANCHORS, _COVERED, _ASKED, _STRINGS = 0, 1, 2, 3


# --- anchors and contexts ---------------------------------------------------------------------------------------------


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """min(v[i : i + width]) for every i that has them all, by doubling."""
    m, have = v, 1
    while 2 * have <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < width:
        m = np.minimum(m[: len(m) - (width - have)], m[width - have :])
    return m


def contexts(data: np.ndarray, bounds: np.ndarray, length: int, gram: int):
    """(row, start, end, anchor hash, context hash, left hash, right hash) of the contexts of rows at ``bounds``."""
    none = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 4
    n = len(data)
    if n < length:
        return none
    prefix = T.prefix_hash(data)
    at = np.arange(n - gram + 1)
    g = T.span_hash(prefix, at, at + gram)
    place = np.uint64((1 << PLACE_BITS) - 1)
    low = _sliding_min((g & ~place) | at.astype(np.uint64), length - gram + 1)
    anchor = (low & place).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    p, lo, hi = anchor[first], first, np.concatenate((first[1:], [len(anchor)])) - 1
    row = np.searchsorted(bounds, p, side="right") - 1
    lo, hi = np.maximum(lo, bounds[row]), np.minimum(hi, bounds[row + 1] - length)
    ok = lo <= hi
    row, p, lo, end = row[ok], p[ok], lo[ok], hi[ok] + length
    half = (length - gram) // 2
    left, right = np.zeros(len(p), np.uint64), np.zeros(len(p), np.uint64)
    far = p - lo >= half
    left[far] = T.span_hash(prefix, p[far] - half, p[far]) | np.uint64(1)
    far = end - p - gram >= half
    right[far] = T.span_hash(prefix, p[far] + gram, p[far] + gram + half) | np.uint64(1)
    return row, lo, end, g[p], T.span_hash(prefix, lo, end), left, right


def _bucket(key: np.ndarray, parts: int) -> np.ndarray:
    return (key ^ (key >> 15) ^ (key >> 33)) % parts


def _bucket_sql(key: str, parts: int):
    k = F.col(key)
    return F.pmod(k.bitwiseXOR(F.shiftright(k, 15)).bitwiseXOR(F.shiftright(k, 33)), F.lit(parts))


def _pack(kind: int, dest: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch | None:
    """One row for each value of ``dest``, with the bytes of its slice of every column."""
    if not len(dest):
        return None
    order = np.argsort(dest, kind="stable")
    dest = dest[order]
    cut = np.flatnonzero(np.concatenate(([True], dest[1:] != dest[:-1], [True])))
    blobs = []
    for c in columns:
        raw, size = np.ascontiguousarray(c[order]).tobytes(), c.dtype.itemsize
        blobs.append(pa.array([raw[x * size : y * size] for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())], pa.binary()))
    blobs += [pa.nulls(len(cut) - 1, pa.binary())] * (5 - len(blobs))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(cut) - 1, kind, np.int32)), pa.array(dest[cut[:-1]].astype(np.int64)), *blobs], ["kind", "dest", *"abcde"]
    )


def _unpack(table: pa.Table, name: str, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in table.column(name).to_pylist() if x), dtype=dtype)


def _covered(key, start, size, parts):
    return _pack(_COVERED, _bucket(key, parts), [key.astype(np.int64), start.astype(np.int64), size.astype(np.int32)])


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of all ranges, one after another."""
    total = np.cumsum(size)
    step = np.ones(int(total[-1]) if len(total) else 0, np.int64)
    if len(step):
        step[0] = start[0]
        step[total[:-1]] = start[1:] - start[:-1] - size[:-1] + 1
    return np.cumsum(step)


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all ranges (of at least one each), one after another; the indices of a part of them are held at once."""
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, data.dtype)
    lo = 0
    while lo < len(size):
        base = int(ends[lo] - size[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, base + T.CHUNK_BYTES, side="right")))
        out[base : int(ends[hi - 1])] = data[_ranges(start[lo:hi], size[lo:hi])]
        lo = hi
    return out


def _hash_pieces(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``span_hash`` of ranges in the order of their starts, by pieces of the data."""
    out = np.empty(len(start), np.uint64)
    lo = 0
    while lo < len(start):
        a = int(start[lo])
        hi = max(lo + 1, int(np.searchsorted(start, a + T.CHUNK_BYTES // 2)))
        at, end = start[lo:hi] - a, start[lo:hi] - a + size[lo:hi]
        with np.errstate(over="ignore"):
            out[lo:hi] = T.span_hash(T.prefix_hash(data[a : a + int(end.max())]), at, end)
        lo = hi
    return out


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` (at least one) bytes at ``a`` equal those at ``b``, for arrays of places."""
    out = np.zeros(len(a), bool)
    ends = np.cumsum(size)
    lo = 0
    while lo < len(a):
        base = ends[lo] - size[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, base + T.CHUNK_BYTES, side="right")))
        differ = data[_ranges(a[lo:hi], size[lo:hi])] != data[_ranges(b[lo:hi], size[lo:hi])]
        out[lo:hi] = ~np.logical_or.reduceat(differ, ends[lo:hi] - size[lo:hi] - base)
        lo = hi
    return out


def _repeats(data: np.ndarray, label: np.ndarray, place: np.ndarray, size: np.ndarray, *order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges that repeat the bytes of the first range with their label, and those that share a label without that.

    First is first by ``order``, given from the last key to the first as for lexsort."""
    by = np.lexsort((*order, label))
    lead = np.concatenate(([True], label[by][1:] != label[by][:-1])) if len(by) else np.zeros(0, bool)
    rest, top = by[~lead], by[lead][np.cumsum(lead)[~lead] - 1]
    same = size[rest] == size[top]
    same[same] = _same_bytes(data, place[rest][same], place[top][same], size[rest][same])
    return rest[same], rest[~same]


def _pieces(offsets: np.ndarray, length: int):
    """(first row, last row + 1, from byte, to byte): chunks of rows; a very long text in overlapping pieces."""
    for lo, hi in T.chunks(offsets):
        a, end = int(offsets[lo]), int(offsets[hi])
        while end - a > 1 << PLACE_BITS:
            yield lo, hi, a, a + (1 << PLACE_BITS)
            a += (1 << PLACE_BITS) - length + 1
        yield lo, hi, a, end


_SIDE = np.dtype([("size", "<u4"), ("left", "<u2"), ("right", "<u2")])


def _emit_contexts(parts: int, length: int, gram: int):
    def emit(data, offsets, key):
        found = []
        for lo, hi, a, b in _pieces(offsets, length):
            with np.errstate(over="ignore"):
                row, start, end, *hashes = contexts(data[a:b], np.clip(offsets[lo : hi + 1], a, b) - a, length, gram)
            found.append((key[lo:hi][row], start + a - offsets[lo:hi][row], start + a, end - start, *hashes))
        if not found:
            return
        keys, start, place, size, anchor, ctx, left, right = (np.concatenate(x) for x in zip(*found))
        del found
        # Combine here first: of equal contexts in this slice only the first one travels on.
        with np.errstate(over="ignore"):
            both = T.mix(anchor + ctx * np.uint64(0x9E3779B97F4A7C15))
        again = np.zeros(len(both), bool)
        again[_repeats(data, both, place, size, np.arange(len(both)))[0]] = True
        out = _covered(keys[again], start[again], size[again], parts)
        if out is not None:
            yield out
        once = ~again
        side = np.zeros(int(once.sum()), _SIDE)
        side["size"], side["left"], side["right"] = size[once], left[once] & np.uint64(0xFFFF), right[once] & np.uint64(0xFFFF)
        out = _pack(
            _ANCHORS, (anchor[once] % np.uint64(parts)).astype(np.int64),
            [anchor[once], ctx[once], keys[once], start[once].astype(np.uint32 if len(start) == 0 or start.max() < 1 << 32 else np.int64), side],
        )
        if out is not None:
            yield out

    def run(batches):
        for batch in batches:
            key = batch.column("key").to_numpy()
            batch = batch.take(pa.array(np.argsort(key, kind="stable")))
            key = batch.column("key").to_numpy()
            data, offsets = T.utf8(batch.column("text"))
            for lo, hi in T.chunks(offsets, SLICE_BYTES):
                yield from emit(data, offsets[lo : hi + 1], key[lo:hi])

    return run


def _shared(group: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Which members share a non-zero side hash with another member of their group."""
    out = np.zeros(len(group), bool)
    order = np.lexsort((side, group))
    g, s = group[order], side[order]
    same = (g[1:] == g[:-1]) & (s[1:] == s[:-1]) & (s[1:] != 0)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _shards(anchor: np.ndarray, size: np.ndarray, parts: int, shard_bytes: int) -> np.ndarray:
    """The shard of each context, given contexts in the order of their anchors.

    Below ``parts`` a shard holds whole anchors; an anchor of more than ``shard_bytes`` gets shards of its own, numbered
    from ``parts`` on, each full after that many bytes."""
    dest = (anchor % np.uint64(parts)).astype(np.int64)
    if len(anchor):
        head = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        count = np.diff(np.append(head, len(anchor)))
        before = np.cumsum(size) - size
        within = before - np.repeat(before[head], count)
        hot = np.repeat(np.add.reduceat(size, head) > shard_bytes, count)
        with np.errstate(over="ignore"):
            own = T.mix(anchor[hot] + (within[hot] // shard_bytes + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        dest[hot] = parts + (own >> np.uint64(2)).astype(np.int64)
    return dest


def _match_contexts(parts: int, shard_bytes: int):
    """Per partition of anchors: ask for contexts that may be equal or share strings, pass covers through."""

    def run(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_numpy()
        out = [table.filter(pa.array(kinds == _COVERED))]
        table = table.filter(pa.array(kinds == _ANCHORS))
        if table.num_rows:
            anchor, ctx, key = (_unpack(table, c, t) for c, t in (("a", np.uint64), ("b", np.uint64), ("c", np.int64)))
            start = np.concatenate([
                np.frombuffer(d, np.uint32 if len(d) * 2 == len(c) else np.int64).astype(np.int64)
                for c, d in zip(table.column("c").to_pylist(), table.column("d").to_pylist())
            ])
            side = _unpack(table, "e", _SIDE)
            order = np.argsort(anchor, kind="stable")
            a = anchor[order]
            twice = np.zeros(len(a) + 1, bool)
            twice[1:-1] = a[1:] == a[:-1]
            order = order[twice[:-1] | twice[1:]]  # anchors that occur again
            order = order[np.lexsort((start[order], key[order], ctx[order], anchor[order]))]
            a, x = anchor[order], ctx[order]
            again = np.zeros(len(order), bool)
            again[1:] = (a[1:] == a[:-1]) & (x[1:] == x[:-1])
            again[:-1] |= again[1:]  # all members of a group
            lead = np.concatenate(([True], (a[1:] != a[:-1]) | (x[1:] != x[:-1]))) if len(a) else again
            first = order[lead]
            searched = np.zeros(len(order), bool)
            searched[lead] = _shared(anchor[first], side["left"][first]) | _shared(anchor[first], side["right"][first])
            ask, searched = order[again | searched], searched[again | searched]
            size = side["size"][ask].astype(np.int32)
            shard = _shards(anchor[ask], size.astype(np.int64), parts, shard_bytes)
            out.append(_pack(_ASKED, _bucket(key[ask], parts), [key[ask], start[ask], size + searched * np.int32(_SEARCHED), anchor[ask], shard]))
        return pa.concat_tables([t if isinstance(t, pa.Table) else pa.Table.from_batches([t]) for t in out if t is not None])

    return run


def _rows_of(docs: pa.Table, asked_key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets and the row of each asked key."""
    data, offsets = T.utf8(docs.column("text"))
    key = docs.column("key").to_numpy()
    order = np.argsort(key)
    at = np.searchsorted(key[order], asked_key)
    return data, offsets, order[at]


def _cut_contexts():
    """Per bucket of documents: the bytes of the asked contexts, dealt to their shards."""

    def run(asked: pa.Table, docs: pa.Table) -> pa.Table:
        out = []
        if asked.num_rows and docs.num_rows:
            key, start, size, anchor, dest = (
                _unpack(asked, c, t) for c, t in (("a", np.int64), ("b", np.int64), ("c", np.int32), ("d", np.uint64), ("e", np.int64))
            )
            data, offsets, row = _rows_of(docs, key)
            order = np.argsort(dest, kind="stable")
            key, start, mark, anchor, row, dest = key[order], start[order], size[order], anchor[order], row[order], dest[order]
            size = mark.astype(np.int64) % _SEARCHED
            raw = _gather(data, offsets[row] + start, size).tobytes()
            out = _pack(0, dest, [anchor, key, start, mark])
            ends = np.concatenate(([0], np.cumsum(size)))
            cut = np.flatnonzero(np.concatenate(([True], dest[1:] != dest[:-1], [True])))
            blobs = pa.array([raw[ends[x] : ends[y]] for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())], pa.binary())
            return pa.Table.from_batches([out.set_column(6, "e", blobs)])
        return pa.table({"kind": pa.array([], pa.int32()), "dest": pa.array([], pa.int64()), **{c: pa.array([], pa.binary()) for c in "abcde"}})

    return run


# --- suffix arrays ----------------------------------------------------------------------------------------------------


def suffix_array(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of all texts (one after another, of ``sizes`` bytes) in order, by Larsson-Sadakane refinement.

    A suffix ends where its text ends, as if each text had a final symbol of its own, smaller than any byte and ordered
    by the texts' numbers; so no two suffixes are equal.  Returns (array, eight-byte keys).  Each round doubles the
    compared prefix and sorts only inside groups that are still tied, by the group of the suffix that many bytes on.
    """
    n = len(data)
    if n >= 1 << 30:
        raise ValueError("places are 32-bit numbers here")
    ends = np.cumsum(sizes).astype(np.int32)
    number = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    end = ends[number]
    at = np.arange(n, dtype=np.int32)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        byte = np.zeros(n, np.uint64)
        byte[: max(n - j, 0)] = data[j:]
        if j:
            byte[at + j >= end] = 0
        key = (key << np.uint64(8)) | byte
    sa = np.argsort(key, kind="stable").astype(np.int32)
    byte = key[sa]
    head = np.concatenate(([True], byte[1:] != byte[:-1])) if n else np.zeros(0, bool)
    del byte
    group = np.maximum.accumulate(np.where(head, at, np.int32(0)))
    rank = np.empty(n, np.int32)
    rank[sa] = group
    ended = len(sizes) * (int(sizes.max(initial=0)) + 1)
    h = 8
    while True:
        tied = ~head
        tied[:-1] |= ~head[1:]
        spots = np.flatnonzero(tied)
        if not len(spots):
            return sa, key
        who = sa[spots]
        beyond = who + np.int32(min(h, n))
        nxt = rank[np.minimum(beyond, n - 1)].astype(np.int64) + ended
        over = np.flatnonzero(beyond >= end[who])  # ended: shorter first, then by text
        nxt[over] = (end[who[over]] - who[over]).astype(np.int64) * len(sizes) + number[who[over]]
        del beyond, over
        order = np.lexsort((nxt, group[spots]))
        who, nxt, owner = who[order], nxt[order], group[spots]
        sa[spots] = who
        head[spots] = np.concatenate(([True], (owner[1:] != owner[:-1]) | (nxt[1:] != nxt[:-1])))
        group = np.maximum.accumulate(np.where(head, at, np.int32(0)))
        rank[sa[spots]] = group[spots]
        h *= 2


def common_prefixes(data: np.ndarray, sa: np.ndarray, key: np.ndarray, end: np.ndarray, begin: np.ndarray, limit: int) -> np.ndarray:
    """Kasai: common prefix length, up to ``limit``, of each suffix with its predecessor in ``sa``.

    Positions of a text are visited in order and keep all but one of the bytes that matched before; the texts that start
    at ``begin`` are visited side by side.
    """
    n = len(data)
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    found = np.zeros(n, np.int32)
    at, h = begin.copy(), np.zeros(len(begin), np.int64)
    stop = end[begin]
    while len(at):
        j = before[at]
        room = np.where(j >= 0, np.minimum(np.minimum(stop - at, end[j] - j), limit), 0)
        h = np.minimum(np.maximum(h - 1, 0), room)
        go = np.flatnonzero(h < room)
        while len(go):  # eight bytes at a time, then the rest of the last eight
            x, y = at[go] + h[go], j[go] + h[go]
            left = room[go] - h[go]
            differ = key[x] ^ key[y]
            same = np.where(differ == 0, 8, 0)
            odd = differ != 0
            same[odd] = (63 - np.floor(np.log2(differ[odd].astype(np.float64))).astype(np.int64)) // 8
            # log2 of a value just under a power of two may round up; the byte itself decides
            bump = odd & (same < 7)
            step = x[bump] + same[bump]
            same[bump] += (step < n) & (data[np.minimum(step, n - 1)] == data[np.minimum(y[bump] + same[bump], n - 1)])
            same = np.minimum(same, left)
            h[go] += same
            go = go[(same == 8) & (h[go] < room[go])]
        found[at] = h
        on = at + 1 < stop
        at, h, stop = at[on] + 1, h[on], stop[on]
    return found[sa]


def repeated_strings(data: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Group number and position of every string of ``length`` bytes inside the texts, in sorted order."""
    ends = np.cumsum(sizes)
    begin = ends - sizes
    end = np.repeat(ends.astype(np.int32), sizes)
    sa, key = suffix_array(data, sizes)
    lcp = common_prefixes(data, sa, key, end, begin, length)
    number = np.cumsum(lcp < length, dtype=np.int32)
    whole = end[sa] - sa >= length
    return number[whole], sa[whole]


def _earliest(number: np.ndarray, key: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (group, key, start), and which members of that order come first in their group."""
    order = np.lexsort((start, key, number))
    g = number[order]
    return order, np.concatenate(([True], g[1:] != g[:-1])) if len(g) else np.zeros(0, bool)


def cover_shards(anchor: np.ndarray, key: np.ndarray, start: np.ndarray, sizes: np.ndarray, data: np.ndarray, length: int, shard_bytes: int = SHARD_BYTES):
    """Strings (key, start) that also start earlier, among contexts with their anchors, keys, starts and bytes."""
    some = sizes >= length
    if not some.all():  # shorter texts hold no string
        data = data[np.repeat(some, sizes)]
        anchor, key, start, sizes = anchor[some], key[some], start[some], sizes[some]
    order = np.argsort(anchor, kind="stable")
    ends = np.cumsum(sizes)
    data = _gather(data, (ends - sizes)[order], sizes[order])
    anchor, key, start, sizes = anchor[order], key[order], start[order], sizes[order]
    ends = np.cumsum(sizes)
    out_key, out_start = [], []
    lo, n = 0, len(sizes)
    merged = None  # sorted strings and their earliest (key, start), of an anchor that goes on
    while lo < n:
        base = int(ends[lo] - sizes[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, base + shard_bytes, side="right")))
        if hi < n and anchor[hi] == anchor[hi - 1]:  # cut between anchors if the shard has more than one
            back = int(np.searchsorted(anchor[lo:hi], anchor[hi - 1])) + lo
            hi = back if back > lo else hi
        text = data[base : int(ends[hi - 1])]
        number, at = repeated_strings(text, sizes[lo:hi], length)
        owner = np.searchsorted(ends[lo:hi] - base, at, side="right")
        k = key[lo:hi][owner]
        s = start[lo:hi][owner] + at - (ends[lo:hi] - sizes[lo:hi] - base)[owner]
        by, lead = _earliest(number, k, s)
        # The same (key, start) may stand in a group twice only if contexts repeat; it is then not its own repeat.
        rest = by[~lead]
        top = by[lead][np.cumsum(lead)[~lead] - 1]
        real = (k[rest] != k[top]) | (s[rest] != s[top])
        out_key.append(k[rest][real])
        out_start.append(s[rest][real])
        goes_on = hi < n and anchor[hi] == anchor[hi - 1]
        if merged is not None or goes_on:
            w = by[lead]
            strings = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, length)[at[w]]).view(f"S{length}")[:, 0]
            wk, ws = k[w], s[w]
            if merged is None:
                merged = (strings, wk, ws)
            else:
                ms, mk, mp = merged
                spot = np.searchsorted(ms, strings)
                hit = np.flatnonzero(ms[np.minimum(spot, len(ms) - 1)] == strings)
                m = spot[hit]
                earlier = (wk[hit] < mk[m]) | ((wk[hit] == mk[m]) & (ws[hit] < mp[m]))
                out_key.append(np.where(earlier, mk[m], wk[hit]))
                out_start.append(np.where(earlier, mp[m], ws[hit]))
                mk[m[earlier]], mp[m[earlier]] = wk[hit][earlier], ws[hit][earlier]
                new = np.ones(len(strings), bool)
                new[hit] = False
                merged = tuple(np.insert(x, spot[new], y[new]) for x, y in ((ms, strings), (mk, wk), (mp, ws)))
            if not goes_on:
                merged = None
        lo = hi
    return np.concatenate(out_key or [np.zeros(0, np.int64)]), np.concatenate(out_start or [np.zeros(0, np.int64)])


def _cover_strings(key: np.ndarray, start: np.ndarray, length: int, parts: int) -> pa.RecordBatch | None:
    """Covers of strings at (key, start); runs of neighbouring starts become one range."""
    order = np.lexsort((start, key))
    key, start = key[order], start[order]
    head = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (start[1:] > start[:-1] + 1)))) if len(key) else np.zeros(0, int)
    last = np.concatenate((head[1:], [len(key)])) - 1 if len(head) else head
    return _covered(key[head], start[head], start[last] - start[head] + length, parts)


def _distinct(number: np.ndarray, key: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members that repeat an earlier one of their group, and the earliest of each group."""
    by, lead = _earliest(number, key, start)
    rest, top = by[~lead], by[lead][np.cumsum(lead)[~lead] - 1]
    return rest[(key[rest] != key[top]) | (start[rest] != start[top])], by[lead]


def _search_part(key, start, sizes, data, length: int, parts: int) -> list[pa.RecordBatch | None]:
    """Covers inside one shard of a divided anchor, and its distinct strings with their earliest places, by their hash."""
    ends = np.cumsum(sizes)
    number, at = repeated_strings(data, sizes, length)
    owner = np.searchsorted(ends, at, side="right")
    k, s = key[owner], start[owner] + at - (ends - sizes)[owner]
    again, lead = _distinct(number, k, s)
    out = [_cover_strings(k[again], s[again], length, parts)]
    at, k, s, n = at[lead].astype(np.int64), k[lead], s[lead], len(lead)
    by = np.argsort(at)
    dest = np.empty(n, np.int64)
    dest[by] = (_hash_pieces(data, at[by], np.full(n, length)) % np.uint64(STRING_GROUPS * parts)).astype(np.int64)
    text = np.lib.stride_tricks.sliding_window_view(data, length)
    order = np.argsort(dest, kind="stable")
    for lo in range(0, n, STRINGS_AT_ONCE):
        o = order[lo : lo + STRINGS_AT_ONCE]
        out.append(_pack(_STRINGS, dest[o], [k[o], s[o], np.ascontiguousarray(text[at[o]]).view(f"S{length}")[:, 0]]))
    return out


def _search_shard(parts: int, length: int, shard_bytes: int):
    def run(table: pa.Table) -> pa.Table:
        anchor, key, start, sizes, data = (
            _unpack(table, c, t) for c, t in zip("abcde", (np.uint64, np.int64, np.int64, np.int32, np.uint8))
        )
        searched, sizes = sizes >= _SEARCHED, sizes.astype(np.int64) % _SEARCHED
        place = np.cumsum(sizes) - sizes
        label = _hash_pieces(data, place, sizes)
        again, odd = _repeats(data, label, place, sizes, start, key)
        out = [_covered(key[again], start[again], sizes[again], parts)]
        divided = table.column("dest")[0].as_py() >= parts
        stay = np.ones(len(sizes), bool) if divided else searched
        stay[odd] = True
        stay[again] = False
        if not divided:  # a context alone with its anchor has no strings in common with others
            _, group, count = np.unique(anchor[stay], return_inverse=True, return_counts=True)
            stay[stay] = count[group] > 1
        anchor, key, start, data, sizes = anchor[stay], key[stay], start[stay], _gather(data, place[stay], sizes[stay]), sizes[stay]
        if not len(sizes):
            pass
        elif divided:
            out += _search_part(key, start, sizes, data, length, parts)
        else:
            out.append(_cover_strings(*cover_shards(anchor, key, start, sizes, data, length, shard_bytes), length, parts))
        out = [x for x in out if x is not None]
        return pa.Table.from_batches(out) if out else table.slice(0, 0)

    return run


def _merge_strings(parts: int, length: int):
    """Per hash of strings from the shards of divided anchors: cover all but the earliest of equal strings."""

    def run(table: pa.Table) -> pa.Table:
        key, start, strings = (_unpack(table, c, t) for c, t in (("a", np.int64), ("b", np.int64), ("c", f"S{length}")))
        again, _ = _distinct(np.unique(strings, return_inverse=True)[1], key, start)
        out = _cover_strings(key[again], start[again], length, parts)
        return pa.Table.from_batches([out]) if out is not None else table.slice(0, 0)

    return run


def _remove(keep_text: bool):
    """Per bucket of documents: cut the covered ranges out."""

    def run(covers: pa.Table, docs: pa.Table) -> pa.Table:
        key, start, size = (_unpack(covers, c, t) for c, t in (("a", np.int64), ("b", np.int64), ("c", np.int32)))
        data, offsets, row = _rows_of(docs, key)
        order = np.argsort(row, kind="stable")
        row, start, size = row[order], start[order], size[order]
        count = lambda x, at: (s := np.concatenate(([0], np.cumsum(x))))[at[1:]] - s[at[:-1]]
        removed, spans = np.zeros(docs.num_rows, np.int64), np.zeros(docs.num_rows, np.int64)
        sums, rest = [], []
        for lo, hi in T.chunks(offsets):
            at = offsets[lo : hi + 1] - offsets[lo]
            total = int(at[-1])
            some = slice(*np.searchsorted(row, [lo, hi]).tolist())
            edge = np.zeros(total + 1, np.int32)
            np.add.at(edge, at[row[some] - lo] + start[some], 1)
            np.add.at(edge, at[row[some] - lo] + start[some] + size[some], -1)
            gone = np.cumsum(edge[:-1]) > 0
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            inner = at[:-1][(at[:-1] < total) & (np.diff(at) > 0)]
            begins[inner] = gone[inner]
            removed[lo:hi], spans[lo:hi] = count(gone, at), count(begins, at)
            left = data[offsets[lo] : offsets[hi]][~gone].tobytes()
            cut = np.concatenate(([0], np.cumsum(np.diff(at) - removed[lo:hi]))).tolist()
            kept = [left[x:y] for x, y in zip(cut[:-1], cut[1:])]
            sums += [hashlib.sha256(x).hexdigest() for x in kept]
            rest += kept if keep_text else [None] * len(kept)
        return pa.table({
            "key": docs.column("key"), "doc_id": docs.column("doc_id"), "n_bytes": pa.array(np.diff(offsets)),
            "n_removed": pa.array(removed), "n_spans": pa.array(spans),
            "kept_sha256": pa.array(sums, pa.string()), "kept": pa.array(rest, pa.binary()),
        })

    return run


# --- the operator -----------------------------------------------------------------------------------------------------


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
    keep_text: bool = False, shard_bytes: int = SHARD_BYTES, broadcast_ids: int = BROADCAST_IDS,
) -> DataFrame:
    """One row per input row: ``key, doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept``.

    Texts are UTF-8 bytes, null as empty; strings never cross documents.  ``kept`` holds the remaining bytes if
    ``keep_text`` is set (they may cut a character), else null.  Rows come first in the order of their ids; null ids come
    last, and rows that repeat an id (or have none) are ordered by their text's hash, then arbitrarily among equal
    texts.  Ids are integers.  Documents shorter than ``length`` lose nothing.  Further columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    each = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    known = each.agg(F.sum("bytes").alias("bytes"), F.count_if(F.expr("n > 1 or doc_id is null")).alias("unclear")).first()
    if not known["unclear"]:
        rows = rows.withColumn("key", F.col("doc_id"))
    else:
        rows = _number(rows)
    parts = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), (known["bytes"] or 0) // GROUP_BYTES)
    packed = rows.select("key", "text").mapInArrow(_emit_contexts(parts, length, gram), _PACKED)
    matched = materialise(packed.groupBy("dest").applyInArrow(_match_contexts(parts, shard_bytes), _PACKED), "suffix-matched")
    asked = matched.where(F.col("kind") == _ASKED)
    keyed = rows.withColumn("dest", _bucket_sql("key", parts))

    ids = asked.mapInArrow(_ids, "key long").distinct()
    some = keyed
    if ids.limit(broadcast_ids + 1).count() <= broadcast_ids:
        some = keyed.join(F.broadcast(ids), "key", "left_semi")
    cut = asked.groupBy("dest").cogroup(some.select("dest", "key", "text").groupBy("dest")).applyInArrow(_cut_contexts(), _PACKED)
    searched = materialise(cut.groupBy("dest").applyInArrow(_search_shard(parts, length, shard_bytes), _PACKED), "suffix-searched")
    merged = searched.where(F.col("kind") == _STRINGS).groupBy("dest").applyInArrow(_merge_strings(parts, length), _PACKED)
    covers = matched.unionByName(searched).where(F.col("kind") == _COVERED).unionByName(merged)
    return covers.groupBy("dest").cogroup(keyed.groupBy("dest")).applyInArrow(
        _remove(keep_text), "key long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )


def _ids(batches):
    for batch in batches:
        key = np.unique(_unpack(pa.Table.from_batches([batch]), "a", np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(key)], ["key"])


def _number(rows: DataFrame) -> DataFrame:
    """Rows with repeated or null ids get new keys in the order of id, then text hash; written once to stay the same."""
    rows = rows.withColumn("h", F.xxhash64("text"))
    ordered = materialise(rows.repartitionByRange(F.col("doc_id").asc_nulls_last(), "h"), "suffix-rows")
    ordered = ordered.repartitionByRange(F.col("doc_id").asc_nulls_last(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "h")
    return materialise(ordered.withColumn("key", F.monotonically_increasing_id()).drop("h"), "suffix-numbered")


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
