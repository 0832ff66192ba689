import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import descriptive as D
from quillon.operators import ingest as I
from quillon.streaming import moments as SM

KIND = "spk string, phoneme string, F1 double, F2 double"


def rows(n, seed):
    rng = np.random.default_rng(seed)
    # One speaker holds two thirds of the tokens; some values are missing, one token has no speaker, one is no vowel.
    return [("hot" if i % 3 else f"s{i % 4}", "aeiou"[i % 5], None if i % 11 == 0 else float(rng.normal(500, 50)), float(rng.normal(1500, 90))) for i in range(n)]


def test_moments_of_two_sets():
    x = np.arange(7.0) ** 2
    of = lambda v: (len(v), float(v.mean()) if len(v) else 0.0, float(((v - v.mean()) ** 2).sum()) if len(v) else 0.0)
    for cut in (0, 1, 4, 7):
        assert SM.join_moments(of(x[:cut]), of(x[cut:])) == pytest.approx(of(x))


def test_stream_equals_batch_and_goes_on(spark, tmp_path):
    """Three batches, a stop, then one more from the same checkpoint: each time the batch's statistics of all so far."""
    pytest.importorskip("google.protobuf")
    source, check, out = (str(tmp_path / x) for x in ("in", "check", "out"))

    def compare(all_rows):
        stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(source)
        got = {r.spk: r for r in SM.merged(SM.consume(stream, check, out, shards=3)).collect()}
        t = spark.createDataFrame(all_rows, KIND).where(I.is_vowel("phoneme") & F.col("spk").isNotNull())
        want = t.groupBy("spk").agg(*[f(c).alias(f"{n}_{c}") for c in ("F1", "F2") for n, f in (("n", F.count), ("mean", F.avg), ("sd", F.stddev_samp))]).collect()
        assert set(got) == {r.spk for r in want}
        for r in want:
            for c in r.asDict():
                a, b = got[r.spk][c], r[c]
                assert a == b if c == "spk" or b is None else a == pytest.approx(b), (r.spk, c)

    first = [*rows(90, 1), (None, "a", 1.0, 1.0), ("hot", "t", 1e9, 1e9), ("lone", "a", None, 7.0)]
    spark.createDataFrame(first, KIND).repartition(3).write.parquet(source)
    compare(first)
    more = [*rows(40, 2), ("lone", "e", 3.0, None), ("new", "a", None, None)]
    spark.createDataFrame(more, KIND).coalesce(1).write.mode("append").parquet(source)
    compare(first + more)


def test_stream_without_tokens(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    source = str(tmp_path / "in")
    spark.createDataFrame([], KIND).write.parquet(source)
    stream = spark.readStream.schema(KIND).parquet(source)
    assert SM.merged(SM.consume(stream, str(tmp_path / "check"), str(tmp_path / "out"))).count() == 0


def test_encoder_batches_and_windows(spark):
    """Batches are at most eight; sound beyond the window is not heard; filling gives no frames; another rate raises."""
    rate = 50 * 4
    audio = [(f"f{i}", rate, [float(i + k) for k in range(10 + i)]) for i in range(20)] + [("long", rate, [1.0] * 500), ("empty", rate, []), ("null", rate, None)]

    def make():
        encode = I.energy_encoder(2, 4)()

        def run(x):
            assert len(x) <= 8 and x.shape[1] == rate
            return encode(x)

        return run

    df = spark.createDataFrame(audio, "path string, rate int, samples array<double>").coalesce(1)
    got = {r.wav_path: r for r in I.encode_windows(df, make, 2, rate, seconds=1).collect()}
    assert got["empty"].frames == [] and got["null"].frames == [] and got["long"].n_frames == 50 and got["long"].frames == [[1.0, 1.0]] * 50
    for path, _, x in audio[:20]:
        full = np.zeros(4 * -(-len(x) // 4))
        full[: len(x)] = x
        assert np.allclose(got[path].frames, full.reshape(-1, 2, 2).mean(2))
    with pytest.raises(Exception, match="resample first: f0"):
        I.encode_windows(df.withColumn("rate", F.lit(7)), make, 2, rate, seconds=1).collect()


def test_lobanov_agrees_with_the_streams_moments(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    source = str(tmp_path / "in")
    t = spark.createDataFrame(rows(60, 3), KIND)
    t.write.parquet(source)
    m = SM.merged(SM.consume(spark.readStream.schema(KIND).parquet(source), str(tmp_path / "c"), str(tmp_path / "o")))
    z = D.lobanov(t).join(m, "spk").where("F1 is not null")
    far = z.select(F.max(F.abs(F.col("F1_normed") - (F.col("F1") - F.col("mean_F1")) / F.col("sd_F1")))).first()[0]
    assert far < 1e-9


def test_no_python_runs_for_a_key(spark, tmp_path):
    """Many speakers cost no call of Python each: the state is an aggregation's, combined in the tasks of a batch first."""
    source = str(tmp_path / "in")
    spark.createDataFrame([(f"s{i}", "a", float(i), float("nan")) for i in range(2000)] + [("s0", "e", 2.0, 1.0)], KIND).write.parquet(source)
    stream = spark.readStream.schema(KIND).parquet(source)
    plan = SM.running_moments(stream)._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" in plan and "TransformWithState" not in plan
    got = {r.spk: r for r in SM.merged(SM.consume(stream, str(tmp_path / "c"), str(tmp_path / "o"))).collect()}
    assert len(got) == 2000 and got["s7"].mean_F1 == 7 and got["s7"].n_F2 == 0 and got["s7"].mean_F2 is None
    assert got["s0"].n_F1 == 2 and got["s0"].sd_F1 == pytest.approx(2**0.5) and got["s0"].n_F2 == 1
