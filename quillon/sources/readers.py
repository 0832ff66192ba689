"""Readers and writers of the corpus formats: CSV, TextGrid, NPZ, WAV."""

from __future__ import annotations

import io
import pickle
import re
import wave
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from quillon.schema import SAMPLE_RATE, SPEAKERS

_INTERVAL = re.compile(r'xmin\s*=\s*([-+.\deE]+)\s*xmax\s*=\s*([-+.\deE]+)\s*text\s*=\s*"((?:[^"]|"")*)"')
_TIER = re.compile(r"item\s*\[\d+\]\s*:?")


def read_csv(spark: SparkSession, path: str, schema: t.StructType, sep: str = ",") -> DataFrame:
    """A CSV with a header and a fixed schema; columns the schema lacks are not read."""
    return spark.read.schema(schema).option("header", True).option("sep", sep).option("enforceSchema", False).csv(path)


def read_speakers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("sep", ";").csv(path).select(
        *[F.col(f.name).cast(f.dataType) for f in SPEAKERS.fields]
    )


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    """The wide sentence table (Word, occ.1, occ.2, ...) in long form: Word, rep_id, sent_id."""
    wide = spark.read.option("header", True).option("sep", "\t").csv(path)
    return unpivot_occurrences(wide)


def unpivot_occurrences(wide: DataFrame, id_col: str = "Word", prefix: str = "occ.") -> DataFrame:
    """Columns ``occ.N`` as rows (Word, rep_id = N, sent_id)."""
    names = [c for c in wide.columns if c.startswith(prefix)]
    long = wide.unpivot([f"`{id_col}`"], [f"`{c}`" for c in names], "occ", "sent_id")
    return long.select(
        F.col(f"`{id_col}`").alias(id_col), F.replace("occ", F.lit(prefix), F.lit("")).cast("int").alias("rep_id"),
        F.col("sent_id").cast("int").alias("sent_id"),
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def parse_textgrid(text: str, tier: int = 1) -> list[tuple[str, float, float]]:
    """(label, start, end) of the intervals of one tier (from 0) of a long-format TextGrid, empty labels kept."""
    tiers = _TIER.split(text)[1:]
    if len(tiers) <= tier:
        return []
    body = tiers[tier]
    body = body[body.find("intervals") :]
    return [(m[3].replace('""', '"'), float(m[1]), float(m[2])) for m in _INTERVAL.finditer(body)]


def read_textgrids(spark: SparkSession, folder: str) -> DataFrame:
    """Phone intervals of all TextGrid files below a folder, one file a row group; see ``name_parts`` for the names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.TextGrid").load(folder)

    def run(batches):
        for pdf in batches:
            rows = []
            for path, raw in zip(pdf["path"], pdf["content"]):
                text = bytes(raw).decode("utf-16" if bytes(raw[:2]) in (b"\xff\xfe", b"\xfe\xff") else "utf-8-sig")
                rows += [(path, *r) for r in parse_textgrid(text)]
            yield pd.DataFrame(rows, columns=["path", "phoneme", "onset", "offset"])

    long = files.select("path", "content").mapInPandas(run, "path string, phoneme string, onset double, offset double")
    return name_parts(long, "path").withColumn("dur", F.col("offset") - F.col("onset")).withColumn(
        "wav_path", F.regexp_replace("path", r"\.TextGrid$", ".wav")
    ).drop("path")


def name_parts(df: DataFrame, col: str) -> DataFrame:
    """Adds ``spk`` (first part of the file name, upper case) and ``sent_id`` (digits of its fourth part)."""
    stem = F.split_part(F.element_at(F.split(F.col(col), "/"), -1), F.lit("."), F.lit(1))
    digits = F.regexp_extract(F.split_part(stem, F.lit("_"), F.lit(4)), r"\d+", 0)
    return df.withColumns({"spk": F.upper(F.split_part(stem, F.lit("_"), F.lit(1))), "sent_id": F.when(digits != "", digits.cast("int"))})


class _ArraysOnly(pickle.Unpickler):
    """Builds numpy arrays and numbers, and refuses every other name, so a file can't run code."""

    # The names that pickled object arrays of numbers refer to.
    NAMES = {
        ("numpy.core.multiarray", "_reconstruct"), ("numpy._core.multiarray", "_reconstruct"), ("numpy.core.multiarray", "scalar"),
        ("numpy._core.multiarray", "scalar"), ("numpy._core.numeric", "_frombuffer"), ("numpy.core.numeric", "_frombuffer"),
        ("numpy", "ndarray"), ("numpy", "dtype"), ("_codecs", "encode"),
    }

    def find_class(self, module, name):
        if (module, name) not in self.NAMES:
            raise pickle.UnpicklingError(f"not an array: {module}.{name}")
        return super().find_class(module, name)


def load_array(archive: zipfile.ZipFile, key: str) -> np.ndarray:
    """One array of an NPZ file; arrays of objects (one vector an element) are read without running their code."""
    with archive.open(f"{key}.npy") as f:
        raw = io.BytesIO(f.read())
    version = np.lib.format.read_magic(raw)
    shape, _, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(raw)
    if kind.hasobject:
        return _ArraysOnly(raw).load().reshape(shape)
    raw.seek(0)
    return np.lib.format.read_array(raw, allow_pickle=False)


def read_npz(spark: SparkSession, path: str, key: str = "word_reps", ids: str | None = None) -> DataFrame:
    """Vectors of NPZ files as (token_id, v); ragged rows are kept, NaN becomes null, row numbers stand for missing ids.

    Files are read where Spark reads them; each file is one task's work."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for pdf in batches:
            for raw in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(bytes(raw))) as z:
                    v = load_array(z, key)
                    n = load_array(z, ids) if ids else np.arange(len(v))
                yield pd.DataFrame({"token_id": np.asarray(n, dtype="int64"), "v": [np.asarray(x, dtype=float).tolist() for x in v]})

    return files.mapInPandas(run, "token_id long, v array<double>")


def write_npz(df: DataFrame, path: str, id_col: str = "token_id", vector_col: str = "v") -> DataFrame:
    """Write each partition's vectors as one NPZ below ``path``; Parquet is the better sink where the format is free."""
    packed = df.select(id_col, vector_col).mapInPandas(_pack_npz(id_col, vector_col), "data binary")
    packed.write.mode("overwrite").parquet(path)
    return packed


def _pack_npz(id_col, vector_col):
    def run(batches):
        for pdf in batches:
            if len(pdf):
                out = io.BytesIO()
                np.savez(out, token_id=pdf[id_col].to_numpy(), word_reps=np.stack(pdf[vector_col].to_numpy()))
                yield pd.DataFrame({"data": [out.getvalue()]})

    return run


def decode_wav(raw: bytes) -> tuple[np.ndarray, int]:
    """Samples in [-1, 1] (mean of the channels) and the rate."""
    with wave.open(io.BytesIO(raw)) as w:
        n, width, channels, rate = w.getnframes(), w.getsampwidth(), w.getnchannels(), w.getframerate()
        data = w.readframes(n)
    x = np.frombuffer(data, dtype={1: np.uint8, 2: np.int16, 4: np.int32}[width]).astype(float)
    x = (x - 128) / 128 if width == 1 else x / float(1 << (8 * width - 1))
    return x.reshape(-1, channels).mean(axis=1), rate


def encode_wav(x: np.ndarray, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(x, -1, 1) * 32767).round().astype("<i2").tobytes())
    return out.getvalue()


def resample(x: np.ndarray, rate: int, to: int = SAMPLE_RATE) -> np.ndarray:
    """Band-limited resampling through the spectrum."""
    if rate == to or not len(x):
        return x
    n = int(round(len(x) * to / rate))
    spectrum = np.fft.rfft(x)
    keep = np.zeros(n // 2 + 1, dtype=complex)
    m = min(len(keep), len(spectrum))
    keep[:m] = spectrum[:m]
    return np.fft.irfft(keep, n) * n / len(x)


def resample_wavs(spark: SparkSession, folder: str, out: str, rate: int = SAMPLE_RATE) -> DataFrame:
    """Write all WAV files below ``folder`` at another rate to the table ``out``: (path, rate, data), data a WAV file of
    one channel.  The originals stay."""
    files = read_wavs(spark, folder, rate, strict=False)

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "rate": pdf["rate"], "data": [encode_wav(np.asarray(x, float), rate) for x in pdf["samples"]]})

    files.mapInPandas(run, "path string, rate int, data binary").write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def write_resampled_wavs(spark: SparkSession, folder: str, out: str, rate: int = SAMPLE_RATE) -> None:
    """Real WAV files below ``out``, of one channel and of ``rate``, under the names they have below ``folder``."""
    from pyspark.sql import functions as F

    from quillon.sources.files import write_files

    files = read_wavs(spark, folder, rate, strict=False)
    root = folder.rstrip("/").split(":")[-1].lstrip("/") + "/"
    encode = lambda batches: (
        pd.DataFrame({"path": pdf["path"], "content": [encode_wav(np.asarray(x, float), rate) for x in pdf["samples"]]}) for pdf in batches
    )
    d = files.mapInPandas(encode, "path string, content binary")
    write_files(d.select(F.element_at(F.split("path", root, 2), -1).alias("name"), "content"), out)


def read_wavs(spark: SparkSession, folder: str, rate: int = SAMPLE_RATE, strict: bool = True) -> DataFrame:
    """(path, rate, samples); a file of another rate is an error if ``strict``, else it is resampled."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(folder)

    def run(batches):
        for pdf in batches:
            for path, raw in zip(pdf["path"], pdf["content"]):
                x, r = decode_wav(bytes(raw))
                if r != rate:
                    if strict:
                        raise ValueError(f"{path}: expected {rate} Hz, found {r}")
                    x = resample(x, r, rate)
                yield pd.DataFrame({"path": [path], "rate": [rate], "samples": [x.tolist()]})

    return files.select("path", "content").mapInPandas(run, "path string, rate int, samples array<double>")
