"""Data sources and sinks: round trips, planned row ranges, commits and aborts."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import ingest
from quillon.sources import files, readers


def test_npz_is_read_by_row_ranges(spark, tmp_path):
    a, b = np.arange(20.0).reshape(10, 2), np.arange(100.0, 106.0).reshape(3, 2)
    a[1, 0] = np.nan
    np.savez(tmp_path / "a.npz", word_reps=a, ids=np.arange(50, 60))
    np.savez_compressed(tmp_path / "b.npz", word_reps=b, ids=np.arange(60, 63))
    df = files.read_npz_rows(spark, str(tmp_path), rows=4)
    assert df.rdd.getNumPartitions() == 4  # three of the first file, one of the second
    got = {r.token_id: r.v for r in df.collect()}
    want = [[None if x != x else x for x in row] for row in [*a.tolist(), *b.tolist()]]
    assert got == dict(enumerate(want))  # numbers go on over files
    assert {r.token_id for r in files.read_npz_rows(spark, str(tmp_path), ids="ids", rows=4).collect()} == set(range(50, 63))
    np.savez(tmp_path / "c.npz", word_reps=np.array([np.zeros(2), np.ones(3)], dtype=object))
    assert files.read_npz_rows(spark, "file:" + str(tmp_path / "c.npz")).count() == 2
    (tmp_path / "none").mkdir()
    assert files.read_npz_rows(spark, str(tmp_path / "none")).count() == 0


def test_npz_files_come_back_equal(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i), None if i == 3 else 0.5]) for i in range(25)], "token_id long, v array<double>").repartition(2)
    files.write_npz_files(df, str(tmp_path / "out"), rows=10)
    names = sorted(os.listdir(tmp_path / "out"))
    assert len([n for n in names if n.endswith(".npz")]) == len(names) >= 3
    back = files.read_npz_rows(spark, str(tmp_path / "out"), ids="token_id")
    assert sorted(map(tuple, ((r.token_id, *r.v) for r in back.collect()))) == sorted((r.token_id, *r.v) for r in df.collect())


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    good = spark.range(4).select(F.concat(F.lit("d/"), F.col("id").cast("string")).alias("name"), F.lit(b"x").alias("content"))
    bad = good.withColumn("content", F.when(F.col("name") == "d/3", F.raise_error(F.lit("stop")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="stop"):
        files.write_files(bad.repartition(3), str(tmp_path / "out"))
    assert [f for _, _, names in os.walk(tmp_path / "out") for f in names] == []
    with pytest.raises(Exception, match="twice"):
        files.write_files(good.union(good), str(tmp_path / "out"))
    with pytest.raises(Exception, match="no file name"):
        files.write_files(good.withColumn("name", F.lit("../x")), str(tmp_path / "out"))
    files.write_files(good, str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out" / "d")) == list("0123") and os.listdir(tmp_path / "out") == ["d"]


def test_resampled_wav_files(spark, tmp_path):
    t = np.arange(8000) / 8000
    (tmp_path / "in" / "s").mkdir(parents=True)
    for n in ("a.wav", "s/b.wav"):
        (tmp_path / "in" / n).write_bytes(readers.encode_wav(0.5 * np.sin(2 * np.pi * 200 * t), 8000))
    readers.write_resampled_wavs(spark, str(tmp_path / "in"), str(tmp_path / "out"), 16000)
    for n in ("a.wav", "s/b.wav"):
        x, rate = readers.decode_wav((tmp_path / "out" / n).read_bytes())
        assert rate == 16000 and len(x) == 16000 and np.abs(x).max() == pytest.approx(0.5, abs=0.02)


def test_tables_are_aligned_by_place(spark):
    a = spark.createDataFrame([(i, f"a{i}") for i in range(50)], "i long, a string").repartition(7)
    b = spark.createDataFrame([(100 - i, f"b{i}") for i in range(50)], "j long, b string").repartition(3)
    got = {r.place: (r.a, r.b) for r in ingest.align(a, b, ["i"], ["j"]).collect()}
    assert got == {k: (f"a{k}", f"b{49 - k}") for k in range(50)}
    with pytest.raises(ValueError, match="50 and 49"):
        ingest.align(a, b.where("j > 51"), ["i"], ["j"])
    with pytest.raises(ValueError, match="both"):
        ingest.align(a, a, ["i"], ["i"])
