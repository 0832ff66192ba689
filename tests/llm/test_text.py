import hashlib
import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helpers import EDGES, corpus, empty, frame
from quillon.llm import chat, decontam, fixity, langid, mixing, mlm, pii


# --- decontamination --------------------------------------------------------------------------------------------------


def words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def hits(rows, items):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(len(w), 10)
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(i)
    out = {}
    for d, t in rows:
        w, covered, ids = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                found = windows.get(tuple(w[s : s + n]))
                if found:
                    covered.update(range(s, s + n))
                    ids |= found
        out[d] = (len(w), len(covered), sorted(map(str, ids)))
    return out


@pytest.mark.parametrize("limit", [4_000_000, 0])
def test_winnowing_finds_every_window(spark, limit):
    rows = corpus(4)
    long = max((t or "" for _, t in rows), key=len).split()
    items = [(1, " ".join(long[5:30])), (2, "WORD"), (10, "a b c"), (3, None), (4, "!!"), (5, " ".join(long[20:31])), (6, "never seen here at all by anyone in this whole corpus"), (2, "漢字 😀")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("fp", F.lit(1))
    got = decontam.contamination(frame(spark, rows), bench, broadcast_limit=limit)
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got.collect()} == hits(rows, items)


def test_decontamination_edges(spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontam.contamination(empty(spark), bench).count() == 0
    assert decontam.contamination(frame(spark, corpus(5)), bench.limit(0)).where("n_hit > 0").count() == 0
    both = decontam.contamination(frame(spark, [(1, "x a b c"), (1, "x a b c"), (None, "a b c")]), bench).collect()
    assert [r.n_hit for r in both] == [3, 3, 3]
    assert decontam.drop_contaminated(frame(spark, [(1, "x a b c"), (2, "d")]), bench).count() == 1


# --- mixing -----------------------------------------------------------------------------------------------------------


def targets(sizes, weights=(1, 2, 3), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, full, out = sum(sizes.values()), set(), {}
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        share = sum(weight[s] for s in open_)
        out = {s: float(cap * sizes[s]) if s in full else left * weight[s] / share for s in order}
        over = {s for s in open_ if out[s] > cap * sizes[s]}
        if not over:
            return out
        full |= over


def test_mix_meets_its_targets(spark):
    rng = random.Random(0)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 60))), rng.choice([None, "", "b", "c", "d", "é"])) for i in range(800)]
    rows += [(1000 + i, "w " * 5, "tiny") for i in range(3)] + [(2000, None, "void")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("x"))
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r["size"]
        taken[r.source] += r.taken
    for s, n in taken.items():
        assert abs(n - want[s]) <= 60
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs.repartition(7), broadcast_rows=0).collect()))


def test_mix_takes_documents_at_unequal_rates(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" for _ in range(rng.choice([1, 3, 9, 30, 100]))), "ab"[i % 2]) for i in range(4000)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    for _, s in got.groupby("source"):
        assert s["expected"].nunique() > 2  # longer documents are taken more often
        by_size = s.groupby("size")
        assert by_size["expected"].first().is_monotonic_increasing
        assert (s["expected"] * s["size"]).sum() == pytest.approx(s["target"].iloc[0])
        for _, c in by_size:
            part = c["expected"] % 1
            assert ((c["copies"] - c["expected"]).abs() < 1 + 1e-9).all()  # whole copies are certain
            assert abs(c["copies"].sum() - c["expected"].sum()) <= 4 * (part * (1 - part)).sum() ** 0.5 + 2


def test_mix_edges(spark):
    assert mixing.mix_sources(empty(spark)).count() == 0
    docs = spark.createDataFrame([(None, "a b", "s"), (1, "a b", "s"), (1, "a b", "s"), (2, None, None)], "doc_id long, text string, source string")
    got = mixing.mix_sources(docs).collect()
    assert len(got) == 4 and sum(r.taken for r in got if r.source == "s") == 6


# --- language ---------------------------------------------------------------------------------------------------------


def test_forward_sum_equals_all_segmentations():
    pieces = langid.Pieces([(b"", True), (b"a", False), (b"ab", False), (b"b", False), (b"ab", True), (b"a", True), (b"bab", False)])
    names = [(b"", True), (b"a", False), (b"ab", False), (b"b", False), (b"ab", True), (b"a", True), (b"bab", False)]
    p = np.array([0.1, 0.2, 0.15, 0.05, 0.3, 0.12, 0.08])
    prob = np.vstack([np.column_stack([p, p[::-1]]), [0, 0]])

    def brute(word, table, at_start=True):
        total = 0.0
        if at_start:
            total += table[0] * brute(word, table, False)
            for i, (raw, opens) in enumerate(names):
                if opens and raw and word.startswith(raw):
                    total += table[i] * brute(word[len(raw) :], table, False)
            return total
        if not word:
            return 1.0
        return sum(table[i] * brute(word[len(raw) :], table, False) for i, (raw, opens) in enumerate(names) if not opens and word.startswith(raw))

    texts = [b"a", b"ab", b"abab", b"b", b"ababababab"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts])
    with np.errstate(over="ignore"):
        from quillon.llm.text import prefix_hash

        got = langid.word_scores(pieces, prob, prefix_hash(data), np.cumsum(size) - size, size)
        counts = langid.expected_counts(pieces, prob[:, 0], prefix_hash(data), np.cumsum(size) - size, size, np.ones(5))
    for i, t in enumerate(texts):
        assert np.exp(got[i]) == pytest.approx([brute(t, prob[:, 0]), brute(t, prob[:, 1])])
    # Expected counts are p * d log P / d p.
    for j in range(7):
        up = prob[:7, 0].copy()
        up[j] *= 1 + 1e-6
        slope = sum(np.log(brute(t, up)) - np.log(brute(t, prob[:7, 0])) for t in texts) / 1e-6
        assert counts[j] == pytest.approx(slope, rel=1e-3, abs=1e-6)


def test_language_held_out_accuracy_and_edges(spark):
    rng = random.Random(1)
    parts = {"xx": ["the", "ing", "sh", "ou"], "yy": ["ung", "sch", "ei", "ich"], "zz": ["aux", "oi", "é", "que"]}
    rows = [(i, " ".join("".join(rng.choice(parts[k]) for _ in range(rng.randint(1, 4))) for _ in range(12)), k) for i in range(240) for k in [sorted(parts)[i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    path = langid.default_vocabulary()
    languages, prob = langid.fit(docs.where(~langid.held_out()), path, docs_per_language=50)
    assert languages == ["xx", "yy", "zz"] and prob[:-1].sum(axis=0) == pytest.approx([1, 1, 1])
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, path, languages, prob).collect()}
    assert np.mean([got[i] == k for i, _, k in rows]) > 0.98
    edge = {r.doc_id: r for r in langid.identify(frame(spark, list(enumerate(EDGES)) + [(None, "ung")]), path, languages, prob).collect()}
    for i, t in enumerate(EDGES):
        assert (edge[i].lang_pred == "und") == (not any(c.isalpha() for c in t or "")) and 0 <= edge[i].score <= 1
    none = langid.fit(docs.withColumn("lang", F.lit(None).cast("string")), path)
    assert {r.lang_pred for r in langid.identify(docs, path, *none).collect()} == {"und"}
    assert langid.identify(empty(spark), path, languages, prob).count() == 0


def test_language_scoring_holds_a_small_part_of_a_batch():
    """As in ``near``: a worker keeps the largest memory that a task of it took, so it is that of one chunk of words."""
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefghijklmnop"))
    text = [" ".join("".join(letters[rng.integers(0, 16, 7)]) for _ in range(400)) for _ in range(1_500)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1_500)), "text": text, "letter": [True] * 1_500})
    pieces = langid.load_pieces(langid.default_vocabulary())
    prob = rng.random((len(pieces) + 1, 4))
    prob[-1] = 0
    tracemalloc.start()
    (got,) = langid._predict(langid.default_vocabulary(), list("abcd"), prob)([batch])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.num_rows == 1_500 and peak < 120e6


# --- personal data ----------------------------------------------------------------------------------------------------


def luhn(s):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(s))) % 10 == 0


def base_spans(t):
    out, t = [], t or ""
    only = lambda m: re.sub("[^0-9]", "", m[0])
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        if 16 <= len(only(m)) <= 19 and luhn(only(m)):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 8 <= len(only(m)) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_base_spans_equal_the_patterns(spark):
    rng = random.Random(2)
    texts = [
        "a@b.c%d@e.f x@y .@..", "1.2.3.4.5.6.7.8 300.1.1.1 00001.2.3.4 1.2.3 000000000256.1.1.1", "4111 1111 1111 1111, 4111-1111-1111-1111 4111111111111111 41111111111111112222",
        "+1 (743) 555-3824 +12 +123456789012345678 +1-----2345678 x+44 20 7946 0958.", "é😀 a@b.co 😀 1.1.1.1 +33 1 23 45 67 89", "1 1 1 1 " * 60, "9" * 500, "call (415) 555-2671", *EDGES,
    ]
    texts += ["".join(rng.choice("0123 .-+@ab1") for _ in range(rng.randint(1, 200))) for _ in range(150)]
    texts += ["".join(rng.choice("41 -") for _ in range(60)) for _ in range(60)]
    got = pii.find_spans(frame(spark, list(enumerate(texts)))).collect()
    assert len(got) == len(texts)
    for r in got:
        assert [(s.kind, s.start, s.end) for s in r.spans if s.base] == base_spans(texts[r.doc_id]), texts[r.doc_id]
    assert pii.find_spans(empty(spark)).count() == 0
    twice = pii.find_spans(frame(spark, [(1, "a@b.cd"), (1, "a@b.cd"), (None, "1.1.1.1")])).collect()
    assert [len(r.spans) for r in twice] == [1, 1, 1]


def test_many_matches_in_one_text_and_added_kinds(spark):
    many = " ".join(f"user{i}@host{i % 97}.com" for i in range(20_000))  # quadratic time would not end
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    texts = [many, *[f'api token = "{key[i:]}{key[:i]}" goes here' for i in range(12)], "checksum deadbeef"]
    got = {r.doc_id: r.spans for r in pii.find_spans(frame(spark, list(enumerate(texts)))).collect()}
    assert len(got[0]) == 20_000 and all(s.base for s in got[0]) and got[0][-1].end == len(many)
    for i in range(1, 13):
        assert [(s.kind, texts[i][s.start : s.end], s.base) for s in got[i]] == [("secret", key[i - 1 :] + key[: i - 1], False)]
    assert got[13] == []


def test_reliabilities_rise_with_agreement(spark):
    rows = [("email", 1, 1, 1, 1, 1)] * 40 + [("email", -1, -1, -1, 0, 1)] * 40
    names = [f"{x}_vote" for x in pii.LABELERS]
    df = spark.createDataFrame(rows, ["kind", *names]).withColumn("kind", F.col("kind"))
    params = pii.reliabilities(df)
    p = {r.strict_vote: r.p for r in df.withColumn("p", pii.posterior(params)).collect()}
    assert p[1] > 0.95 > 0.05 > p[-1] and params["email", "strict"][1][0] > 0.9


# --- chat -------------------------------------------------------------------------------------------------------------


def test_templates_are_reversible():
    rng = random.Random(3)
    for _ in range(500):
        turns = [("".join(rng.choice(["user", ":", "\\", "### "]) for _ in range(2)), "".join(rng.choice(["\\", "#", "###", "</turn>", "\n", "x", ": "]) for _ in range(rng.randint(0, 8)))) for _ in range(3)]
        formatted = "".join(chat.format_turn(*t) for t in turns)
        assert [(r, t) for r, t, _, _ in chat.parse_turns(formatted)] == turns


def test_prefix_tree(spark):
    rng = random.Random(4)
    rows = []
    for c in range(30):
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, ["user", "assistant", None][(t + (c == 3)) % 2 if c != 5 else 2], rng.choice(["hi", "ok", None, "\\### Assistant: </turn> ok", "long " * 30])))
    rows += [(None, 0, "user", "nobody"), (40, None, "user", "no turn")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("path", F.lit(1))
    tree, tokens, turns = chat.prefix_tree(df.repartition(3))
    nodes = {bytes(r.node): r for r in tree.join(tokens, "start").collect()}
    walk = {}
    for r in turns.collect():
        walk.setdefault(r.conv_id, []).append((r.idx, bytes(r.node)))
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        want.setdefault(c, []).append((role or "", text or ""))
    prefixes = {tuple(v[: i + 1]) for v in want.values() for i in range(len(v))}
    assert len(nodes) == len(prefixes)  # every shared prefix is written once
    spans = sorted((r.start, r.start + len(r.tokens)) for r in nodes.values())
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))  # one gapless stream
    for c, steps in walk.items():
        steps = [n for _, n in sorted(steps)]
        for i, n in enumerate(steps):
            before = [x for m in steps[:i] for x in range(nodes[m].start, nodes[m].start + len(nodes[m].tokens))]
            assert nodes[n].position == len(before)
            assert [x for s in nodes[n].attend for x in range(s.start, s.end)] == before
            if i:
                assert nodes[n].start >= nodes[steps[i - 1]].start + len(nodes[steps[i - 1]].tokens)  # depth first
    got = {r.conv_id: r for r in chat.read_back(tree, tokens, turns).collect()}
    for c, v in want.items():
        r = got[c]
        said = "".join(t for role, t in v if role == "assistant")
        assert r.n_turns == len(v) and r.loss_chars == len(said) and r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in v).encode()).hexdigest()
        assert r.formatted_chars == sum(len(chat.format_turn(*t)) for t in v)
    # What is read depends on the intervals: without those of the ancestors only last turns are left.
    alone = chat.read_back(tree.withColumn("attend", F.slice("attend", 1, 0)), tokens, turns).collect()
    assert len(alone) == len(want) and {r.n_turns for r in alone} == {1}
    parts = chat.prefix_tree(df.limit(0))
    assert [p.count() for p in parts] == [0, 0, 0] and chat.read_back(*parts).count() == 0


def test_packing_with_a_public_vocabulary(spark):
    import public_tokenizers

    path, pattern = str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN
    df = spark.createDataFrame([(1, 0, "user", "héllo 😀"), (1, 1, "assistant", "wörld <|endoftext|>")], "conv_id long, turn long, role string, text string")
    r = chat.read_back(*chat.prefix_tree(df, vocab_path=path, pattern=pattern), path, pattern).first()
    assert r.loss_sha256 == hashlib.sha256("wörld <|endoftext|>".encode()).hexdigest()


# --- fixity -----------------------------------------------------------------------------------------------------------


def test_audit_finds_exactly_the_damage(spark):
    rows = [(i, f"http://h/{i % 5}", "x" * (i * 37 % 900)) for i in range(600)] + [(None, None, None), (None, "u", "v"), (3, "again", "row")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("offset", F.lit("clash"))
    def copy(i, record):
        return F.when(i == 77, F.lit("broken")).when(i.isNull() | ~i.isin(5, 400), record)

    records = fixity.lay_out(pages, per_archive=16, copy=copy)
    a, b = fixity.replica(records, "a"), fixity.replica(records, "b")
    found = fixity.audit(a, b, range_bytes=1024, fanout=2).collect()
    assert {(r.record_id, r.status) for r in found} == {(5, "missing"), (400, "missing"), (77, "changed")}
    assert {(r.record_id, r.status) for r in fixity.audit(b, a, range_bytes=1024, fanout=2).collect()} == {(5, "extra"), (400, "extra"), (77, "changed")}
    assert fixity.audit(a, a).count() == 0
    assert fixity.audit(a.limit(0), a.limit(0)).count() == 0
    # Trees that need different heights: one archive with a high number against many.
    one = a.where("archive = 37")
    assert fixity.audit(a, one, range_bytes=1024, fanout=2).where("status = 'missing'").count() == a.where("archive <> 37").count()


# --- masked language model --------------------------------------------------------------------------------------------


def test_scores_equal_a_loop_over_tokens(spark):
    rows = corpus(6, n=20)
    docs = frame(spark, rows)
    top, rank, flat = mlm.fit(docs)
    net = mlm.Window(flat.astype(float))
    got = {r.doc_id: r for r in mlm.score(docs, (top, rank, flat)).collect()}
    import pyarrow as pa

    from quillon.llm import text as T

    for i, t in rows:
        data, offsets = T.utf8(pa.array([t], pa.string()))
        with np.errstate(over="ignore"):
            w = T.words(T.LOWER[data[offsets[0] : offsets[1]]], offsets - offsets[0], T.NOT_SPACE)
        token = mlm.numbers(w.hash, top, rank)
        total = 0.0
        for j in range(len(token)):
            z = sum(net.E[p][token[j + o] if 0 <= j + o < len(token) else mlm.SIZE] for p, o in enumerate(mlm.OFFSETS))
            h = np.tanh(z)
            a, b = net.U @ h + net.u, net.W[token[j] // mlm.GROUP] @ h + net.w[token[j] // mlm.GROUP]
            total += a[token[j] // mlm.GROUP] - np.log(np.exp(a).sum()) + b[token[j] % mlm.GROUP] - np.log(np.exp(b).sum())
        assert got[i].n_tokens == len(token) == len((t or "").split()) and got[i].score == pytest.approx(total, rel=1e-4, abs=1e-4)
    assert mlm.score(empty(spark), mlm.fit(empty(spark))).count() == 0


def test_training_beats_the_unigram_start(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(w for _ in range(60) for w in rng.choice(["a b c", "d e f", "g h i"]).split())) for i in range(120)]
    docs = frame(spark, rows, extra=False)
    mean = lambda m: mlm.score(docs, m).agg(F.sum("score") / F.sum("n_tokens")).first()[0]
    assert mean(mlm.fit(docs)) > mean(mlm.fit(docs, rounds=0)) + 0.3


def test_rare_words_are_told_apart(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(2 * mlm.FREQUENT)]
    rows = [(i, " ".join(rng.choices(vocab, weights=[1 / (k + 1) for k in range(len(vocab))], k=150))) for i in range(80)]
    rows += [(None, "w1500 w1 w1500"), (None, "w1501"), (3, ""), (4, None)]
    docs = frame(spark, rows)
    top, rank, flat = mlm.fit(docs)
    n = Counter(w for _, t in rows for w in (t or "").split())
    number = {w: int(mlm.numbers(h, top, rank)[0]) for w in n for h in [word_hash(w)]}
    total = Counter()
    for w in n:
        total[number[w]] += n[w]
    assert any(number[w] >= mlm.FREQUENT and n[w] < total[number[w]] for w in n)
    net = mlm.Window(flat)
    want = []
    for i, t in rows:
        words = (t or "").split()
        token = np.array([number[w] for w in words], dtype=np.int64)
        s = net.log_probs(mlm.neighbours(token, np.array([0, len(token)])), token).sum() if words else 0
        want.append((str(i), len(words), s + sum(math.log(n[w] / total[number[w]]) for w in words)))
    for known in (mlm.KNOWN, 0):  # the second joins all words that have no number of their own
        got = [(str(r.doc_id), r.n_tokens, r.score) for r in mlm.score(docs, (top, rank, flat), known=known).collect()]
        for a, b in zip(sorted(got), sorted(want), strict=True):
            assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-4, abs=1e-4)
    # A word the corpus lacks scores below a common word of the same bucket.
    common = max((w for w in n if number[w] >= mlm.FREQUENT), key=lambda w: n[w])
    typo = next(f"x{i}" for i in range(100_000) if int(mlm.numbers(word_hash(f"x{i}"), top, rank)[0]) == number[common])
    got = {r.doc_id: r.score for r in mlm.score(frame(spark, [(1, common), (2, typo)]), (top, rank, flat), counts=mlm.count_words(docs)).collect()}
    assert got[1] - got[2] == pytest.approx(math.log(n[common]), abs=1e-4)


def word_hash(w):
    from quillon.llm import text as T

    data = np.frombuffer(w.encode(), np.uint8)
    with np.errstate(over="ignore"):
        return T.words(data, np.array([0, len(data)]), T.NOT_SPACE).hash


def test_languages_with_unlike_long_words_stay_finite(spark):
    """Two long words of one length, one far less likely than the other, and runs without spaces."""
    import time

    en, fr = "the cat sat on the mat and looked at the dog", "le chat est sur le tapis et regarde le chien"
    rows = [(i, en, "en") for i in range(40)] + [(100 + i, fr, "fr") for i in range(40)] + [(200, "the" * 100, "en"), (201, "漢" * 100, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    path = langid.default_vocabulary()
    languages, prob = langid.fit(docs, path)
    assert np.isfinite(prob).all()
    got = {r.doc_id: r for r in langid.identify(docs, path, languages, prob).collect()}
    assert all(0 <= r.score <= 1 and r.lang_pred == dict((i, x) for i, _, x in rows)[i] for i, r in got.items())
    text = "".join(chr(0x4E00 + i * 7919 % 5000) for i in range(60_000))
    began = time.time()
    r = langid.identify(spark.createDataFrame([(1, text), (2, text[:5] + "é" * 5000)], "doc_id long, text string"), path, languages, prob).collect()
    assert all(0 <= x.score <= 1 for x in r) and time.time() - began < 60


def test_language_filter_returns_whole_rows(spark):
    """Columns named like the model's own come back as they were; blocks of one word give the same counts."""
    from quillon.llm import langid as L

    en, fr = "the house and the garden are near the river", "la maison et le jardin sont au bord de la riviere"
    rows = [(i, en if i % 2 else fr, "en" if i % 2 else "fr", f"r{i}", -1.0, None) for i in range(30)] + [(None, "12 34", None, "x", 2.0, [1]), (40, None, None, "y", None, [])]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, row string, score double, letter array<int>")
    kept = L.keep_identified(d, L.default_vocabulary())
    assert kept.schema == d.schema and sorted(map(tuple, kept.collect())) == sorted(r for r in rows if r[2])
    pieces = L.load_pieces(L.default_vocabulary())
    data = np.frombuffer("maisonhousegarden".encode(), np.uint8)
    start, length = np.array([0, 6, 11]), np.array([6, 5, 6])
    prob = np.append(np.full(len(pieces), 1 / len(pieces)), 0.0)
    with np.errstate(over="ignore"):
        run = lambda: L.expected_counts(pieces, prob, L.T.prefix_hash(data), start, length, np.array([1.0, 2.0, 3.0]))
        whole = run()
        old, L.BLOCK_BYTES = L.BLOCK_BYTES, 1
        try:
            assert np.allclose(whole, run())
        finally:
            L.BLOCK_BYTES = old
