import hashlib
import io
import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.config import Config
from quillon.functions import nulls
from quillon.functions import vectors as V
from quillon.operators import classify as C
from quillon.operators import cluster as K
from quillon.operators import descriptive as D
from quillon.operators import distance as X
from quillon.operators import hypothesis as H
from quillon.operators import ingest as I
from quillon.operators import reduce as R
from quillon.operators import resampling as B
from quillon.operators import rope as P
from quillon.plans import catalogue
from quillon.sources import canonical as S
from quillon.sources import readers


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.005, 0.2])] + [(9, None)], "i int, p double")
    got = {r.i: r.p_adj_BH for r in H.benjamini_hochberg(df, "p", []).collect()}
    assert [round(got[i], 6) for i in range(5)] == [0.025, 0.05, 0.05, 0.025, 0.2] and got[9] is None


def test_quantiles_and_ranks_equal_sorting(spark):
    from quillon.operators.order import quantiles

    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "c"], 400), "x": np.round(rng.standard_cauchy(400), 1)})
    pdf = pd.concat([pdf, pd.DataFrame({"g": ["one", "same", "same"], "x": [5.0, 2.0, 2.0]})], ignore_index=True)
    df = spark.createDataFrame([*pdf.itertuples(index=False, name=None), ("a", None)], "g string, x double")
    got = {r.g: r for r in quantiles(df, "x", ["g"], {"lo": 0.025, "mid": 0.5, "hi": 0.975}).collect()}
    for g, x in pdf.groupby("g")["x"]:
        assert [got[g].lo, got[g].mid, got[g].hi] == pytest.approx(np.quantile(x, [0.025, 0.5, 0.975]))
    ranks = sorted((r.g, r.x, r["rank"]) for r in H.average_ranks(df, "x", ["g"]).collect())
    assert ranks == sorted(zip(pdf["g"], pdf["x"], pdf.groupby("g")["x"].rank()))


def test_pca_by_group_equals_one_pca_a_group(spark):
    rng = np.random.default_rng(5)
    rows = [(g, (rng.standard_normal(4) * [3, 2, 1, 0.5] + k).tolist()) for k, g in enumerate("ab") for _ in range(40)] + [("c", [1.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame(rows, "g string, v array<double>")
    got = {r.g: r for r in R.pca_by(df, ["g"], 3).collect()}
    assert got["c"].parts == []
    for g in "ab":
        mean, parts, share = R.pca(df.where(F.col("g") == g), 3)
        assert np.allclose(got[g].mean, mean) and np.allclose(got[g].parts, parts) and np.allclose(got[g].share, share)
    z = R.project_by(df, R.pca_by(df, ["g"], 3), ["g"]).where("g = 'a'").toPandas()
    x = np.stack(z["v"])
    assert np.allclose(np.stack(z["pc"]), (x - got["a"].mean) @ np.array(got["a"].parts).T)


def test_average_ranks(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 2.0, 5.0)], "x double").withColumn("g", F.lit(1))
    assert sorted(r["rank"] for r in H.average_ranks(df, "x", ["g"]).collect()) == [1.0, 2.5, 2.5, 4.0]


def test_insufficient_data(spark):
    df = spark.createDataFrame([("a", "fr", 1.0), ("a", "ru", 2.0), ("a", "ru", None)], "phoneme string, L1 string, x double")
    r = H.compare_groups(df, "x", ["phoneme"], "L1", "fr", "ru").first()
    assert r.test_used == "insufficient_data" and r.p_raw is None and r.p_adj_BH is None


def test_lobanov_edges(spark):
    rows = [("A", "a", 1.0), ("A", "t", 5.0), ("B", "a", 2.0), ("B", " A ", 4.0), ("B", None, 9.0), ("C", "e", 3.0), ("C", "e", 3.0)]
    t = spark.createDataFrame(rows, "spk string, phoneme string, F1 double").withColumn("F2", F.col("F1"))
    got = {(r.spk, r.phoneme, r.F1): r.F1_normed for r in D.lobanov(t).collect()}
    assert got["A", "a", 1.0] is None and got["C", "e", 3.0] is None  # one vowel, or no spread
    assert got["B", None, 9.0] == pytest.approx((9 - 3) / math.sqrt(2))


def test_right_join_keeps_phones_and_fans_out(spark):
    phones = spark.createDataFrame([("A", 1, "a"), ("Z", 2, "e")], "spk string, sent_id int, phoneme string")
    people = spark.createDataFrame([("A", "fr"), ("Q", "ru")], "spk string, L1 string")
    assert {(r.spk, r.L1) for r in I.attach_speakers(phones, people).collect()} == {("A", "fr"), ("Z", None)}
    words = spark.createDataFrame([(1, 1), (2, 1)], "rep_id int, sent_id int")
    assert I.attach_repetitions(phones, words).count() == 3


def test_names(spark):
    df = spark.createDataFrame([("x/ab_x_y_p12_z.TextGrid",), ("x/ab.TextGrid",)], "path string")
    assert [(r.spk, r.sent_id) for r in readers.name_parts(df, "path").collect()] == [("AB", 12), ("AB", None)]


def test_readers(spark, tmp_path):
    (tmp_path / "s.csv").write_text("spk;L1;x;Gender;Age\nA;fr;1;f;30\n")
    r = readers.read_speakers(spark, str(tmp_path / "s.csv")).first()
    assert (r.spk, r.L1, r.Age, r.Gender) == ("A", "fr", 30.0, "f")
    (tmp_path / "w.csv").write_text("Word\tocc.1\tocc.2\nun\t4\t7\n")
    assert {(r.Word, r.rep_id, r.sent_id) for r in readers.read_sentences(spark, str(tmp_path / "w.csv")).collect()} == {("un", 1, 4), ("un", 2, 7)}
    np.savez(tmp_path / "v.npz", word_reps=np.array([[1.0, np.nan], [3.0, 4.0]]))
    got = {r.token_id: r.v for r in readers.read_npz(spark, str(tmp_path / "v.npz")).collect()}
    assert got[1] == [3.0, 4.0] and got[0] == [1.0, None]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "m.wav").write_bytes(readers.encode_wav(np.zeros(100), 8000))
    with pytest.raises(Exception, match="8000"):
        readers.read_wavs(spark, str(tmp_path / "a")).collect()
    assert len(readers.read_wavs(spark, str(tmp_path / "a"), strict=False).first().samples) == 200


def test_npz_of_objects_runs_no_code(spark, tmp_path):
    ragged = np.empty(3, dtype=object)
    ragged[:] = [np.array([1.0, 2.0], dtype="float32"), np.array([np.nan, 4.0]), [5, 6, 7]]
    np.savez(tmp_path / "o.npz", word_reps=ragged, token_id=np.array([7, 8, 9]))
    got = {r.token_id: r.v for r in readers.read_npz(spark, str(tmp_path / "o.npz"), ids="token_id").collect()}
    assert got == {7: [1.0, 2.0], 8: [None, 4.0], 9: [5.0, 6.0, 7.0]}
    bad = np.empty(1, dtype=object)
    bad[0] = math.sqrt
    np.savez(tmp_path / "bad.npz", word_reps=bad)
    with pytest.raises(Exception, match="not an array"):
        readers.read_npz(spark, str(tmp_path / "bad.npz")).collect()


def test_resampled_files_are_written_beside_the_originals(spark, tmp_path):
    (tmp_path / "in").mkdir()
    t = np.arange(800) / 8000
    raw = readers.encode_wav(0.5 * np.sin(2 * np.pi * 200 * t), 8000)
    (tmp_path / "in" / "a.wav").write_bytes(raw)
    r = readers.resample_wavs(spark, str(tmp_path / "in"), str(tmp_path / "out")).first()
    x, rate = readers.decode_wav(bytes(r.data))
    assert r.rate == rate == 16000 and len(x) == 1600 and x == pytest.approx(0.5 * np.sin(2 * np.pi * 200 * np.arange(1600) / 16000), abs=1e-3)
    assert (tmp_path / "in" / "a.wav").read_bytes() == raw


def test_labels_and_row_numbers(spark):
    df = spark.createDataFrame([("b", 1), ("", 2), (None, 3), ("a", 4), ("b", 0)], "l string, i int").repartition(3)
    assert sorted(r.i for r in I.labelled(df, "l").collect()) == [0, 1, 4] and I.two_labels(I.labelled(df, "l"), "l") == ("a", "b")
    with pytest.raises(ValueError, match="two labels"):
        I.two_labels(df, "l")
    want = sorted(((r.l or "", r.i) for r in df.collect()), key=lambda x: (x[0], x[1]))
    got = I.number_rows(df.na.fill("", ["l"]), ["l", "i"], "n").orderBy("n").collect()
    assert [(r.l, r.i) for r in got] == want and [r.n for r in got] == list(range(5))
    assert I.number_rows(df.limit(0), ["l", "i"]).count() == 0


def test_significant_but_equivalent(spark):
    rows = [("acoustic_F1", "equivalent", 0.01), ("acoustic_F1", "equivalent", 0.2), ("neural_x", "equivalent", 0.01), ("acoustic_F2", "indeterminate", 0.01), ("acoustic_F2", "equivalent", None)]
    df = spark.createDataFrame(rows, "representation string, classification string, p_value double")
    assert [tuple(r) for r in P.significant_equivalent(df).collect()] == rows[:1]


def test_formant_extraction_reports_errors(spark):
    tokens = spark.createDataFrame(
        [("a", 0.0, 0.5, "f", "w"), ("", 0.0, 0.5, "f", "w"), ("e", 0.0, 0.5, "m", "none")], "phoneme string, onset double, offset double, Gender string, wav_path string"
    )
    x = np.random.default_rng(0).standard_normal(16000).tolist()
    audio = spark.createDataFrame([("w", 16000, x)], "path string, rate int, samples array<double>")
    got = {r.phoneme: r for r in I.extract_formants(tokens, audio).collect()}
    assert got["a"].F1 is not None and got[""].F1 is None and got[""].error is None and "no audio" in got["e"].error


def test_frames(spark):
    df = spark.createDataFrame([(29.99, 31.0, 40.0), (0.0, 0.001, 1.0)], "a double, b double, d double")
    got = [tuple(r) for r in df.select(*I.encoder_frames(F.col("a"), F.col("b"), F.col("d"))).collect()]
    assert got == [(1499, 1500), (0, 1)]
    m = spark.createDataFrame([(1, [[1.0, 2.0], [3.0, 4.0]], 0, 2), (2, [[1.0, 2.0]], 1, 1)], "k int, f array<array<double>>, s int, e int")
    assert {r.k: r.v for r in I.mean_pool(m, ["k"], "f", "s", "e").collect()} == {1: [2.0, 3.0], 2: None}


def vectors(n=80, d=6, seed=0):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({
        "token_id": range(n), "spk": rng.choice(list("ABCD"), n), "phoneme": rng.choice(list("aei"), n), "v": list(rng.standard_normal((n, d)).tolist())
    })


def test_cosine_statistics_without_pairs(spark):
    p = vectors()
    df = spark.createDataFrame(p)
    u = np.stack(p["v"]) / np.linalg.norm(np.stack(p["v"]), axis=1)[:, None]
    s = u @ u.T
    same = p["phoneme"].to_numpy()[:, None] == p["phoneme"].to_numpy()
    off = ~np.eye(len(p), dtype=bool)
    r = X.within_between_cosine(df, "phoneme").first()
    assert r.within_cosine == pytest.approx(s[same & off].mean(), abs=1e-12) and r.between_cosine == pytest.approx(s[~same].mean(), abs=1e-12)
    spk = p["spk"].to_numpy()[:, None] == p["spk"].to_numpy()
    got = {r.phoneme: r.intra_cosine for r in X.intra_unit_cosine(df, ["phoneme"]).collect()}
    for k in "aei":
        mine = same & spk & off & (p["phoneme"].to_numpy() == k)[:, None]
        assert got[k] == pytest.approx((1 - s[mine]).mean(), abs=1e-12)


def test_cosine_of_zero_vectors(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    r = df.select(V.cosine_distance(F.col("a"), F.col("b"), "eps").alias("e"), V.cosine_distance(F.col("a"), F.col("b"), "null").alias("n")).first()
    assert r.e == 1.0 and r.n is None


def test_centroid_policies(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [float("nan"), 1.0]), ("e", [1.0, 1.0]), ("i", None)], "phoneme string, v array<double>")
    assert {r.phoneme: r.centroid for r in X.centroids(df, ["phoneme"]).collect()} == {"a": [1.0, 2.0], "e": [1.0, 1.0]}
    assert {r.phoneme: r.centroid for r in X.centroids(df, ["phoneme"], nan_policy="propagate").collect()} == {"a": None, "e": [1.0, 1.0]}


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_loso_equals_refitting(spark, metric):
    p = vectors(seed=4)
    got = {r.token_id: r.y_pred for r in C.loso(spark.createDataFrame(p), metric=metric).collect()}
    x = np.stack(p["v"])
    for s in p["spk"].unique():
        train, test = p["spk"] != s, np.flatnonzero(p["spk"] == s)
        labels = sorted(p["phoneme"][train].unique())
        c = np.stack([x[train & (p["phoneme"] == k)].mean(0) for k in labels])
        for i in test:
            far = ((x[i] - c) ** 2).sum(1) if metric == "euclidean" else -(c / np.linalg.norm(c, axis=1)[:, None]) @ x[i]
            assert got[i] == labels[int(np.argmin(far))]


def test_loso_ties_take_the_smallest_label(spark):
    rows = [(0, "A", "b", [1.0]), (1, "A", "a", [-1.0]), (2, "B", "a", [0.0])]
    got = {r.token_id: r.y_pred for r in C.loso(spark.createDataFrame(rows, "token_id int, spk string, phoneme string, v array<double>")).collect()}
    assert got == {2: "a"}  # the others' training sides have one class only


def test_mantel_by_refitting_ranks(spark):
    rng = np.random.default_rng(2)
    m = [np.abs(rng.standard_normal((6, 6))) for _ in range(2)]
    m = [x + x.T for x in m]
    rows = [(k, f"p{i}", f"p{j}", float(m[k][i, j])) for k in (0, 1) for i in range(6) for j in range(6)]
    long = spark.createDataFrame(rows, "m int, phoneme_i string, phoneme_j string, d double")
    r = B.mantel(long, [("0", "1")], n_perm=19).first()
    up = np.triu_indices(6, 1)
    want = np.corrcoef(*[pd.Series(x[up]).rank() for x in m])[0, 1]
    assert r.mantel_r == pytest.approx(want) and 1 / 20 <= r.p_value <= 1


def test_token_mantel_equals_whole_matrices(spark):
    """300 tokens in blocks of 70 against numpy on whole matrices: correlations and permutation p-values."""
    p = vectors(300, seed=5)
    x = np.stack(p["v"])
    p["w"] = [v[:3].tolist() for v in x]
    p["u"] = [[float(round(4 * abs(v[0])))] for v in x]  # many ties
    df = spark.createDataFrame(p)
    df = df.union(df.limit(1).withColumn("token_id", F.lit(-1).cast("long")).withColumn("w", F.lit(None).cast("array<double>")))
    metrics, pairs = {"v": "euclidean", "w": "cosine", "u": "euclidean"}, [("v", "w"), ("v", "u"), ("w", "u")]
    got = {(r.first, r.second): r for r in B.token_mantel(df.select("token_id", "v", "w", "u"), metrics, pairs, n_perm=19, parts=3, block=70).collect()}
    order = np.argsort(p["token_id"].to_numpy())
    up = np.triu_indices(300, 1)
    c = {}
    for m, metric in metrics.items():
        y = np.stack(p[m])[order].astype(float)
        sim = -np.sqrt(((y[:, None] - y[None]) ** 2).sum(-1)) if metric == "euclidean" else (y @ y.T) / np.outer(*[np.linalg.norm(y, axis=1)] * 2)
        r = pd.Series(sim[up]).rank().to_numpy()
        r -= r.mean()
        c[m] = np.zeros((300, 300))
        c[m][up] = r / np.sqrt(r @ r)
        c[m] += c[m].T
    for a, b in pairs:
        obs = (c[a] * c[b]).sum() / 2
        null = [(c[a] * c[b][np.ix_(q, q)]).sum() / 2 for q in (np.random.default_rng([42, k]).permutation(300) for k in range(19))]
        assert got[a, b].mantel_r == pytest.approx(obs, abs=1e-6) and got[a, b].n_tokens == 300
        assert got[a, b].p_value == pytest.approx((sum(abs(s) >= abs(obs) - 1e-12 for s in null) + 1) / 20)
        assert got[a, b].significant == (got[a, b].p_value < 0.05)
    few = B.token_mantel(df.limit(2).select("token_id", "v", "w", "u"), metrics, pairs, n_perm=19).collect()
    assert len(few) == 3 and few[0].mantel_r is None


def test_outliers_do_not_crowd_a_stretch(spark, request):
    from quillon.operators import order

    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")  # small stretches would be joined
    request.addfinalizer(lambda: spark.conf.unset(setting))

    largest = []
    for extra in (20_000.0, 1e12):
        values = [float(i) for i in range(20_000)] + [extra]
        df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
        d = order.placed(df, "v", ["g"])
        largest.append(d.groupBy("_part").count().agg(F.max("count")).first()[0])
        r = {x.v: (x.rank, x.tied) for x in order.average_ranks(df.union(df.where("v < 2")), "v", ["g"]).distinct().collect()}
        assert r[0.0] == (1.5, 2) and r[2.0] == (5.0, 1) and r[extra] == (20_003.0, 1)
        assert {x.v: x.rank for x in order.row_ranks(df.union(df.where("v < 2")), "v", ["g"]).collect()} == {k: v[0] for k, v in r.items()}
    assert largest[1] <= 2 * largest[0] and largest[1] < 15_000


def test_bootstrap_on_sums_equals_concatenating_tokens(spark):
    p = vectors(60, seed=6)
    df = spark.createDataFrame(p)
    r = B.bootstrap_centroid_distance(df, "phoneme", "a", "e", n_boot=20).first()
    draws = B.unit_draws(df, "spk", 20, 42).select("spk", F.explode("picks").alias("b")).toPandas()
    x, far = np.stack(p["v"]), []
    for b in range(20):
        idx = list(itertools.chain.from_iterable(np.flatnonzero(p["spk"] == t.spk).tolist() for t in draws[draws.b == b].itertuples()))
        one, two = (x[[i for i in idx if p["phoneme"][i] == k]].mean(0) for k in "ae")
        far.append(1 - one @ two / np.linalg.norm(one) / np.linalg.norm(two))
    assert r.obs_boot_mean == pytest.approx(np.mean(far)) and r.ci_lo == pytest.approx(np.quantile(far, 0.025))


def test_rope_bounds(spark):
    rows = [(-0.2, 0.2, "equivalent"), (0.2, 0.5, "indeterminate"), (0.21, 0.5, "non-equivalent"), (None, 0.1, "insufficient_data")]
    df = spark.createDataFrame(rows, "lo double, hi double, want string")
    for r in df.select("want", P.classify(F.col("lo"), F.col("hi"), F.lit(-0.2), F.lit(0.2)).alias("got")).collect():
        assert r.got == r.want
    assert df.select(P.classify(F.col("lo"), F.col("hi"), F.lit(0.0), F.lit(None).cast("double")).alias("g")).first().g == "rope_undefined"


def test_ward_of_long_matrices_with_gaps(spark):
    """A matrix with a null, a missing pair or one item gives no rows and leaves the others alone."""
    full = [("ok", i, j, float(abs(i - j))) for i in (1, 2, 9) for j in (1, 2, 9)]
    null = [("null", i, j, None if i != j else 0.0) for i in (1, 2) for j in (1, 2)]
    m = spark.createDataFrame([*full, *null, *[("gap", i, j, d) for _, i, j, d in full[:-1]], ("one", 1, 1, 0.0)], "m string, x_i int, x_j int, d double")
    got = {(r.m, r.k, r.x): r.cluster for r in K.ward_clusters(m, ["m"], "x", (2,)).collect()}
    assert got == {("ok", 2, 1): 1, ("ok", 2, 2): 1, ("ok", 2, 9): 2}
    assert [(r.left, r.right, r.size) for r in K.linkage(m, ["m"], "x").orderBy("step").collect()] == [(0, 1, 2), (2, 3, 3)]


def test_unit_vectors_within_groups(spark):
    """Groups may differ in width; a label that one unit lacks is filled in that unit's group only."""
    d = spark.createDataFrame([("a", "s", "x", [1.0]), ("a", "t", "y", [3.0]), ("b", "s", "x", [1.0, 2.0])], "m string, u string, l string, v array<double>")
    got = sorted(tuple(r) for r in K.unit_vectors(d, "u", "l", missing=0.0, within=["m"]).collect())
    assert got == [("a", "s", "x", 0, 1.0), ("a", "s", "y", 0, 0.0), ("a", "t", "x", 0, 0.0), ("a", "t", "y", 0, 3.0), ("b", "s", "x", 0, 1.0), ("b", "s", "x", 1, 2.0)]


def test_rand_index_and_silhouette(spark):
    c = spark.createDataFrame([(1, i, i // 2, 1 - i // 2, 0) for i in range(4)], "k int, item int, truth int, cluster int, one int")
    assert K.adjusted_rand(c, ["k"], "truth").first().ari == 1.0
    assert K.adjusted_rand(c, ["k"], "truth", "one").first().ari == 0.0
    x = [0.0, 1.0, 10.0, 11.0]
    m = spark.createDataFrame([(1, i, j, abs(x[i] - x[j])) for i in range(4) for j in range(4)], "k int, item_i int, item_j int, d double")
    want = np.mean([1 - 1 / 10.5, 1 - 1 / 9.5, 1 - 1 / 9.5, 1 - 1 / 10.5])
    assert K.silhouette(m, c.select("k", "item", "cluster"), ["k"], "item").first().silhouette == pytest.approx(want)
    single = spark.createDataFrame([(1, i, int(i > 0)) for i in range(4)], "k int, item int, cluster int")
    assert K.silhouette(m, single, ["k"], "item").first().silhouette is not None


def test_pca(spark):
    p = vectors(50, seed=7)
    df = spark.createDataFrame(p).union(spark.createDataFrame([(99, "A", "a", [float("nan")] * 6)], "token_id long, spk string, phoneme string, v array<double>"))
    mean, parts, share = R.pca(df, 2)
    x = np.stack(p["v"])
    values = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2
    assert share == pytest.approx(values[:2] / values.sum())
    got = {r.token_id: (r.pc, r.keep) for r in R.project(df, mean, parts).collect()}
    assert got[99] == (None, False) and got[3][0] == pytest.approx(((x[3] - mean) @ parts.T).tolist())
    with pytest.raises(NotImplementedError):
        R.reduce(df, "umap")
    flat = R.reduce(df, "umap", umap=(lambda m: m.mean(0), lambda mean, m: (m - mean)[:, :2]))
    assert flat.count() == 50


def test_nan_is_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert nulls.no_nan(df).where("x is null").count() == 1


def test_stream_equals_batch(spark, tmp_path):
    from quillon.streaming import windows as W

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = W.hourly(stream).writeStream.format("memory").queryName("hourly_out").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("hourly_out").exceptAll(W.hourly(events)).count() == 0


def test_registered_replicates_are_the_reference_s_and_equal_brute_force(spark):
    assert (catalogue.N_PERM, catalogue.N_BOOT) == (Config().n_perm, Config().n_boot) == (999, 2000)
    rng = np.random.default_rng(4)
    rows = [(i, "fr" if i < 5 else "ru", (rng.standard_normal(3) + (i < 5)).tolist()) for i in range(11)]
    x = {i: np.array(v) for i, _, v in rows}
    total = sum(x.values())

    def far(ids):
        a = sum(x[i] for i in ids)
        b = total - a
        return 1 - a @ b / math.sqrt((a @ a) * (b @ b))

    order = [sorted(x, key=lambda i: (hashlib.md5(f"42-{b}-{i}".encode()).hexdigest(), i))[:5] for b in range(catalogue.N_PERM)]
    p = (sum(far(o) >= far(range(5)) - 1e-12 for o in order) + 1) / 1000
    df = spark.createDataFrame(rows, "token_id long, L1 string, v array<double>")
    got = B.permutation_centroid_distance(df.selectExpr("*", "1 as g"), "L1", "fr", "ru", within=["g"], n_perm=catalogue.N_PERM).first()
    assert got.p_raw == pytest.approx(p, abs=1e-12)


def test_permutation_moves_the_hashes_of_one_cell_only():
    from quillon.operators import resampling as B

    assert B._cell_digits(10) == B._cell_digits(1000) == B._cell_digits(65_536) == 1 and B._cell_digits(65_537) == 2


def test_mann_whitney_joins_no_row_with_its_rank(spark):
    """One table of distinct values is written and aggregated; heavy ties give the ranks' mean."""
    from quillon.operators import hypothesis as H

    rows = [("a", "x" if i % 3 else "y", float(i % 4)) for i in range(120)] + [("a", "z", 0.0), ("a", "x", None)]
    out = H.mann_whitney(spark.createDataFrame(rows, "p string, g string, v double"), "v", ["p"], "g", "x", "y")
    assert "_first" in out._jdf.queryExecution().analyzed().toString()
    got = out.first()
    x, y = ([v for _, g, v in rows if g == k and v is not None] for k in "xy")
    assert (got.n1, got.n2) == (len(x), len(y)) and got.u == sum((a > b) + 0.5 * (a == b) for a in x for b in y)
    assert got.ties == 4 * (30**3 - 30)


def test_lobanov_sorts_no_tokens(spark):
    """A speaker's statistics are looked up in a hash table where they are too many to be sent to all tasks."""
    d = spark.createDataFrame([(f"S{i % 3}", "a", float(i), float(i * i)) for i in range(30)], "spk string, phoneme string, F1 double, F2 double")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = D.lobanov(d)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "Sort [" not in plan
        assert out.where("F1_normed is not null").count() == 30
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


@pytest.mark.parametrize("most", [0, 10**6])
def test_tokens_are_not_sorted_by_part(spark, monkeypatch, most):
    """Whatever Spark takes the tables' sizes for: few parts are broadcast, of many each task has its share in a hash table."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    want = S.tokens(spark, "/root/testdata/sf0.001").agg(F.count("*"), F.sum("F1"), F.min("phoneme")).first()
    monkeypatch.setattr(S, "BROADCAST_ROWS", most)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = S.tokens(spark, "/root/testdata/sf0.001")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin" if most else "ShuffledHashJoin") in plan and "SortMergeJoin" not in plan and "Sort [" not in plan
        got = out.agg(F.count("*"), F.sum("F1"), F.min("phoneme")).first()
        assert (got[0], got[2]) == (want[0], want[2]) and got[1] == pytest.approx(want[1])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
