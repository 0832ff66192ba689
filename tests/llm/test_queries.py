import hashlib

import pytest
from pyspark.sql import functions as F

from oracle import connect, rows, same
from quillon.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_matches_sql(spark, duck, name):
    same(Q.queries()[name](spark, SF), duck.sql(Q.oracle_sql()[name]))


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql()) - {"op13_bin_completion_packing"}))
def test_one_row_per_document(spark, name):
    assert Q.queries()[name](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_pii_columns(spark):
    from test_text import base_spans

    joined = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = Q.queries()["op4_weak_pii"](spark, SF).collect()
    assert len(got) == len(text)
    for r in got:
        base = base_spans(text[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for x, _, _ in base) for k in ("email", "ip", "card", "phone")]
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        spans = [x for x in r.spans.split(",") if x]
        assert set(joined(base).split(",")) - {""} <= set(spans) and len(spans) == r.n_spans
        order = ["email", "ip", "card", "phone", "secret"]
        key = [(order.index(x.split(":")[0]), int(x.split(":")[1])) for x in spans]
        assert key == sorted(key)


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline as P
    from quillon.llm import decontam, exact, langid, minhash
    from test_dedup import components_of, normal
    from test_text import hits

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.union(docs.where("doc_id = 3").withColumn("doc_id", F.lit(10_000).cast("bigint")))
    docs = docs.union(spark.createDataFrame([(20_000, "123 !!", None, None, 6), (20_001, None, "en", "src1", 0)], docs.schema))
    kept = docs.collect()
    # Language: only what has no letter goes here, and no clean document.
    out = P.language(spark, docs, SF)
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in kept if any(c.isalpha() for c in r.text or "")}
    kept = out.collect()
    out = P.exact(spark, out, SF)
    first = {}
    for r in sorted(kept, key=lambda r: r.doc_id):
        first.setdefault(normal(r.text), r.doc_id)
    assert {r.doc_id for r in out.collect()} == set(first.values())
    kept = out.collect()
    out = P.near(spark, out, SF)
    comp = components_of([(r.doc_id, r.text) for r in kept], 5)
    assert {r.doc_id for r in out.collect()} == {i for i, (_, c) in comp.items() if i == c}
    kept = out.collect()
    out = P.decontaminate(spark, out, SF)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = hits([(r.doc_id, r.text) for r in kept], items)
    assert {r.doc_id for r in out.collect()} == {i for i, (_, n, _) in found.items() if n == 0}
    assert out.columns == docs.columns
    mixed = P.mix(spark, out, SF)
    assert mixed.count() == out.count()
    assert [name for name, _ in P.STAGES] == ["language", "exact", "near", "decontaminate", "mix"]


def test_pipeline_on_empty_and_repeated_rows(spark, tmp_path):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = docs.where("doc_id in (1, 2, 5)")
    odd = spark.createDataFrame([(None, "a text without an id", "en", None, 20)], docs.schema)
    for name, rows in (("empty", docs.limit(0)), ("odd", some.union(some).union(odd))):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    assert P.run(spark, f"{tmp_path}/empty").count() == 0
    out = [r.doc_id for r in P.run(spark, f"{tmp_path}/odd").collect()]
    assert len(out) == len(set(out)) and set(out) <= {1, 2, 5, None} and None in out


def test_pipeline_filters_rows_without_an_id(spark):
    """Null and repeated ids: each row is judged by its own text."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    clean = max((r.text for r in docs.where("doc_id < 40").collect()), key=len)
    near = clean.replace(clean.split()[len(clean.split()) // 2], "changed", 1)
    odd = [(None, "123 456"), (None, None), (1, "789 !!"), (None, f"some words before {item} and some after"), (None, near)]
    docs = docs.unionByName(spark.createDataFrame([(i, t, None, None, 0) for i, t in odd], docs.schema))
    good = docs.where("doc_id = 1 and text like '%a%'").count()
    out = P.language(spark, docs, SF)
    left = out.collect()
    assert {r.text for r in left if r.doc_id is None} == {odd[3][1], near} and sum(r.doc_id == 1 for r in left) == good
    assert near not in {r.text for r in P.near(spark, P.exact(spark, out, SF), SF).where("doc_id is null").collect()}
    assert odd[3][1] not in {r.text for r in P.decontaminate(spark, out, SF).collect()}


def test_suffix_columns(spark):
    """The registered query against brute force over the whole table."""
    from test_dedup import without_repeats

    text = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {i: x[:4] for i, x in without_repeats(text, 100).items()}
    got = Q.queries()["op8_suffix_dedup"](spark, SF).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want and len(got) == len(want)


def test_language_columns_and_held_out_accuracy(spark):
    """Only held-out documents count; language is learned from the others."""
    import zlib

    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    learned = {r.lang for i, r in docs.items() if zlib.crc32(str(i).encode()) % 4 != 2 and r.lang is not None}
    hits = []
    for r in Q.queries()["op6_segmentation_langid"](spark, SF).collect():
        d = docs[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in d.text or "")) and r.lang_pred in learned | {"und"}
        if r.held_out and d.lang is not None:
            hits.append(r.lang_pred == d.lang)
    print("held-out accuracy", sum(hits), len(hits))
    assert hits and sum(hits) / len(hits) >= 0.9


def test_masked_likelihood_columns(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = Q.queries()["op5_masked_likelihood"](spark, SF).collect()
    for r in got:
        n = len([w for w in (text[r.doc_id] or "").encode().split()])
        assert r.n_tokens == n and (r.score < 0 if n else r.score == 0)
        assert r.mean_score == (pytest.approx(r.score / n) if n else None)
