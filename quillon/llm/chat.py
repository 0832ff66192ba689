"""Chat formatting as a prefix tree.

Conversations that share their initial turns share tree nodes.  A node is a turn after a given history, known by a chain
hash; nodes are laid out depth first in one packed token stream, each once, with position ids that count from the start
of the conversation and with the stream intervals of its ancestors, all that its tokens may attend to besides
themselves.

Depth-first order comes from the order of the conversations' paths (eight bytes of chain hash a turn, one path for each
conversation): conversations with a common beginning stand together, a node belongs to the first of them, and nodes
follow each other by (rank of their conversation, turn).  A range sort and running sums over its partitions give every
node its place in the stream; no tree is gathered anywhere, and large sets of conversations that share a turn are salted.

A conversation is read back as a consumer of the packed stream would read it: the stream is cut into blocks, the
intervals of a conversation's last node (its ancestors' and its own) pick stretches of blocks, and position ids put their
tokens in order.

Template of a turn: ``### role: text</turn>\\n``.  Inside role and text, backslash, ``###``, ``</turn>`` (and ``:`` in a
role) are written with a backslash before them, so no text can open or close a turn, and reading back is exact.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.durable import materialise

ASSISTANT = "assistant"
HOT_SHARE = 1000
SALTS = 32
#: Tokens of the packed stream that are read as one row.
BLOCK = 512
_TURN = re.compile(r"### ((?:\\.|[^\\:])*): (.*?)(?<!\\)((?:\\\\)*)</turn>\n", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("###", "\\###").replace("</turn>", "\\</turn>")


def unescape(text: str) -> str:
    return re.sub(r"\\(\\|###|</turn>|:)", r"\1", text)


def format_turn(role: str, text: str) -> str:
    return f"### {escape(role).replace(':', chr(92) + ':')}: {escape(text)}</turn>\n"


def parse_turns(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end of the escaped text) of each turn; raises if the text is not a sequence of turns."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2] + m[3]), m.start(2), m.end(3)))
        at = m.end()
    return out


@lru_cache(maxsize=2)
def _encoder(path: str | None, pattern: str):
    """Encode and decode of text with a file of byte-pair ranks, or of its UTF-8 bytes if there is no file."""
    if path is None:
        return (lambda t: list(t.encode())), (lambda ids: bytes(ids).decode())
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    e = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return e.encode_ordinary, (lambda ids: e.decode_bytes(ids).decode())


def _chain(batches):
    """Chain hashes along each conversation, and its whole path beside its last turn; rows come sorted, conversations whole
    or over several batches."""
    conv, chain, path, idx, held = object(), b"", [], 0, None

    def table(rows):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary()]
        names = ["conv_id", "idx", "role", "text", "node", "path"]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    for batch in batches:
        out = []
        for c, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text"))):
            if held is not None:
                out.append((*held, b"".join(path) if c != conv else None))
            if held is None or c != conv:
                conv, chain, path, idx = c, b"", [], 0
            r, t = role.encode(), text.encode()
            chain = hashlib.blake2b(b"%s%d:%s%s" % (chain, len(r), r, t), digest_size=16).digest()
            path.append(chain[:8])
            held = (c, idx, role, text, chain)
            idx += 1
        yield table(out)
    if held is not None:
        yield table([(*held, b"".join(path))])


def _tokens(vocab_path: str | None, pattern: str):
    """Formatted text, tokens and loss mask of each node, with a running offset inside the partition."""

    def run(batches):
        encode, _ = _encoder(vocab_path, pattern)
        offset = 0
        for batch in batches:
            start, tokens, loss = [], [], []
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist()):
                formatted = format_turn(role, text)
                # The masked text is encoded by itself, so that the mask falls on token borders.
                cut = len(formatted) - len("</turn>\n")
                head = formatted.index(": ", 4 + len(escape(role).replace(":", "\\:"))) + 2
                a, b, c = encode(formatted[:head]), encode(formatted[head:cut]), encode(formatted[cut:])
                start.append(offset)
                tokens.append(a + b + c)
                loss.append([len(a), len(a) + len(b)] if role == ASSISTANT else [0, 0])
                offset += len(a) + len(b) + len(c)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x) for x in ("pid", "node", "owner", "idx")), pa.array(start, pa.int64()), pa.array(tokens, pa.list_(pa.int32())),
                 pa.array([len(x) for x in tokens], pa.int64()), pa.array([x[0] for x in loss], pa.int64()), pa.array([x[1] for x in loss], pa.int64())],
                ["pid", "node", "owner", "idx", "local", "tokens", "n_tokens", "loss_from", "loss_to"],
            )

    return run


def _attend(batches):
    """First position and ancestor intervals of nodes, from the conversation that owns them.

    Stretches that touch are one interval, so a conversation has one more for each turn at which another one's branch
    lies in between, and the list is only copied for the nodes that are written."""
    rank, position, spans = object(), 0, []
    for batch in batches:
        out_node, out_position, out_spans = [], [], []
        rows = zip(*(batch.column(x).to_pylist() for x in ("rank", "owner", "node", "start", "n_tokens")))
        for r, owner, node, start, n in rows:
            if r != rank:
                rank, position, spans = r, 0, []
            if owner == r:
                out_node.append(node)
                out_position.append(position)
                out_spans.append([{"start": a, "end": b} for a, b in spans])
            position += n
            if spans and spans[-1][1] == start:
                spans[-1] = (spans[-1][0], start + n)
            else:
                spans.append((start, start + n))
        yield pa.RecordBatch.from_arrays(
            [pa.array(out_node, pa.binary()), pa.array(out_position, pa.int64()),
             pa.array(out_spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
            ["node", "position", "attend"],
        )


def _join_shared(many: DataFrame, one: DataFrame, key: str) -> DataFrame:
    """Inner join of many rows with one row for each key, where single keys may hold a large part of the rows.

    Keys with more than 1/HOT_SHARE of the rows (fewer than HOT_SHARE, so they are broadcast) are dealt over SALTS."""
    counts = many.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = many.count()
    hot = F.broadcast(counts.where(F.col("_n") * HOT_SHARE > total).select(key, F.lit(SALTS).alias("_salts")))
    salted = many.join(hot, key, "left").withColumn("_salt", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("_salts")), F.lit(0))).drop("_salts")
    spread = one.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return salted.join(spread.withColumn("_salt", F.col("_salt").cast("bigint")), [key, "_salt"]).drop("_salt")


def _in_order(df: DataFrame, *order: str) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def prefix_tree(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    vocab_path: str | None = None, pattern: str = "",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The nodes of the tree, their tokens, and the turns that lead through it.

    Nodes: ``node, start, n_tokens, position, attend, loss_from, loss_to``.  ``start`` is a node's place in the packed
    stream, ``position`` the position id of its first token (the next ones count up), ``attend`` the stream intervals of
    its ancestors, merged where they touch, and loss_from to loss_to its tokens under the loss mask (the text of assistant
    turns).  Tokens: ``start, tokens``, one row per node.  Turns: ``conv_id, idx, node``, one row per input row.

    Rows of a conversation are ordered by turn (null first), then role and text; null role or text is empty.  Rows with
    a null conversation id form one conversation.  Repeated conversations share all nodes.  Ids are integers.  An
    empty table gives two empty tables; further columns are ignored.
    """
    rows = conversations.select(
        F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    turns = materialise(
        _in_order(rows, "turn", "role", "text").drop("turn").mapInArrow(
            _chain, "conv_id long, idx long, role string, text string, node binary, path binary"
        ),
        "chat-turns",
    )
    # Ranks grow in the order of the partitions of a range sort, and inside them.
    ends = turns.where("path is not null").select("conv_id", "path")
    ranks = ends.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").select("conv_id", F.monotonically_increasing_id().alias("rank"))
    ranks = materialise(ranks, "chat-ranks")
    same = turns["conv_id"].eqNullSafe(ranks["conv_id"])
    walk = materialise(turns.join(ranks, same).select(turns["conv_id"], "rank", "idx", "node"), "chat-walk")
    # The owner is the first conversation through a node; its turn is the node's row.
    owners = walk.groupBy("node").agg(F.min(F.struct("rank", "conv_id")).alias("o"), F.min("idx").alias("at"))
    owners = owners.select(F.col("node").alias("own"), F.col("o.rank").alias("owner"), F.col("o.conv_id").alias("by"), "at")
    mine = (turns["node"] == owners["own"]) & (turns["idx"] == owners["at"]) & turns["conv_id"].eqNullSafe(owners["by"])
    ordered = turns.drop("path").join(owners, mine).repartitionByRange("owner", "idx").sortWithinPartitions("owner", "idx")
    packed = materialise(
        ordered.select(F.spark_partition_id().alias("pid"), "node", "owner", "idx", "role", "text").mapInArrow(
            _tokens(vocab_path, pattern),
            "pid int, node binary, owner long, idx long, local long, tokens array<int>, n_tokens long, loss_from long, loss_to long",
        ),
        "chat-tokens",
    )
    totals = packed.groupBy("pid").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    packed = packed.join(F.broadcast(totals), "pid").withColumn("start", F.col("base") + F.col("local"))
    seen = _join_shared(walk.select("rank", "idx", "node"), packed.select("node", "owner", "start", "n_tokens"), "node")
    seen = seen.repartition("rank").sortWithinPartitions("rank", "idx")
    seen = seen.mapInArrow(_attend, "node binary, position long, attend array<struct<start:long,end:long>>")
    nodes = materialise(packed.select("node", "start", "n_tokens", "loss_from", "loss_to").join(seen, "node"), "chat-nodes")
    return nodes, packed.select("start", "tokens"), walk.select("conv_id", "idx", "node")


def _read_back(vocab_path: str | None, pattern: str):
    """Per conversation: what its tokens say, parsed and unescaped; rows come sorted, a conversation's by position."""

    def run(batches):
        _, decode = _encoder(vocab_path, pattern)
        conv, none, tokens, loss = None, True, [], []

        def row():
            formatted = decode(tokens)
            turns, n = hashlib.sha256(), 0
            for role, text, _, _ in parse_turns(formatted):
                turns.update(f"{role}\n{text}\n".encode())
                n += 1
            masked, chars = hashlib.sha256(), 0
            edge = np.flatnonzero(np.diff(np.concatenate(([0], np.array(loss, np.int8), [0])))).tolist()
            for a, b in zip(edge[::2], edge[1::2]):
                text = unescape(decode(tokens[a:b]))
                masked.update(text.encode())
                chars += len(text)
            return [conv, n, turns.hexdigest(), chars, masked.hexdigest(), len(formatted)]

        def table(out):
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

        for batch in batches:
            out = []
            for c, begin, part, runs in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "begin", "tokens", "runs"))):
                if none or c != conv:
                    if not none:
                        out.append(row())
                    conv, none, tokens, loss = c, False, [], []
                tokens += part
                mask = np.zeros(len(part), np.int8)
                for r in runs:
                    mask[max(r["start"] + r["loss_from"] - begin, 0) : max(r["start"] + r["loss_to"] - begin, 0)] = 1
                loss += mask.tolist()
            yield table(out)
        if not none:
            yield table([row()])

    return run


def _blocks(start: Column, size: Column) -> Column:
    """The blocks that ``size`` (at least one) tokens from ``start`` on touch."""
    return F.explode(F.sequence(F.floor(start / BLOCK), F.floor((start + size - 1) / BLOCK)))


def stream_blocks(nodes: DataFrame, tokens: DataFrame) -> DataFrame:
    """The packed stream: ``block, tokens, runs``: BLOCK tokens, and the nodes they are of with position and loss mask."""
    cut = tokens.where("size(tokens) > 0").withColumn("block", _blocks(F.col("start"), F.size("tokens")))
    lo = F.greatest(F.col("block") * BLOCK - F.col("start"), F.lit(0))
    size = F.least((F.col("block") + 1) * BLOCK - F.col("start"), F.size("tokens")) - lo
    cut = cut.select("block", F.struct("start", F.slice("tokens", (lo + 1).cast("int"), size.cast("int")).alias("tokens")).alias("p"))
    cut = cut.groupBy("block").agg(F.array_sort(F.collect_list("p")).alias("p")).select("block", F.flatten("p.tokens").alias("tokens"))
    runs = nodes.where("n_tokens > 0").withColumn("block", _blocks(F.col("start"), F.col("n_tokens")))
    runs = runs.groupBy("block").agg(F.collect_list(F.struct("start", "n_tokens", "position", "loss_from", "loss_to")).alias("runs"))
    return cut.join(runs, "block")


def read_back(nodes: DataFrame, tokens: DataFrame, turns: DataFrame, vocab_path: str | None = None, pattern: str = "") -> DataFrame:
    """One row per conversation, read from the packed stream through the intervals of its last node: turns, digests, sizes."""
    stream = materialise(stream_blocks(nodes, tokens), "chat-stream")
    last = turns.groupBy("conv_id").agg(F.max_by("node", "idx").alias("node"))
    own = F.struct(F.col("start"), (F.col("start") + F.col("n_tokens")).alias("end"))
    leaves = _join_shared(last, nodes.select("node", F.concat("attend", F.array(own)).alias("spans")), "node")
    spans = leaves.select("conv_id", F.explode("spans").alias("s")).where("s.end > s.start").select("conv_id", "s.start", "s.end")
    wanted = materialise(spans.withColumn("block", _blocks(F.col("start"), F.col("end") - F.col("start"))), "chat-wanted")
    got = _join_shared(wanted, stream, "block").withColumn("begin", F.greatest(F.col("start"), F.col("block") * BLOCK))
    lo = F.col("begin") - F.col("block") * BLOCK
    part = F.slice("tokens", (lo + 1).cast("int"), (F.least("end", (F.col("block") + 1) * BLOCK) - F.col("begin")).cast("int"))
    runs = F.filter("runs", lambda r: (r["start"] < F.col("end")) & (r["start"] + r["n_tokens"] > F.col("begin")))
    first = F.get(F.filter("runs", lambda r: (r["start"] <= F.col("begin")) & (r["start"] + r["n_tokens"] > F.col("begin"))), F.lit(0))
    got = got.select("conv_id", "begin", part.alias("tokens"), runs.alias("runs"), (first["position"] + F.col("begin") - first["start"]).alias("at"))
    return _in_order(got, "at").select("conv_id", "begin", "tokens", "runs").mapInArrow(
        _read_back(vocab_path, pattern),
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


def op3_prefix_tree_chat(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    chats = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    trap = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], chats.schema)
    path, pattern = str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN
    nodes, tokens, turns = prefix_tree(chats.unionByName(extra), vocab_path=path, pattern=pattern)
    return read_back(nodes, tokens, turns, path, pattern)


SQL = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (select *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') as escaped from c)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(length('### ' || role || ': ' || escaped || '</turn>' || chr(10)))::bigint as formatted_chars
from e group by conv_id
"""
