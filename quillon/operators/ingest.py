"""Token-table building: joins, labels, frames and formants."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.schema import ENCODER_FRAMES_PER_SECOND, ENCODER_SECONDS, FORMANT_CEILING, LOBANOV_VOWELS, SAMPLE_RATE
from quillon.sources.durable import materialise


def is_vowel(phoneme: Column | str, vowels: tuple[str, ...] = LOBANOV_VOWELS) -> Column:
    """Case and surrounding white space do not matter; null is no vowel."""
    p = F.col(phoneme) if isinstance(phoneme, str) else phoneme
    return F.coalesce(F.lower(F.regexp_replace(p, r"^\s+|\s+$", "")).isin(*vowels), F.lit(False))


def labelled(df: DataFrame, col: str) -> DataFrame:
    """Rows whose label is neither null nor empty."""
    return df.where(F.length(F.col(col).cast("string")) > 0)


def two_labels(df: DataFrame, col: str) -> tuple[str, str]:
    """The two labels of a column in order; an error if it doesn't hold exactly two."""
    found = sorted(r[0] for r in df.where(F.col(col).isNotNull()).select(col).distinct().limit(3).collect())
    if len(found) != 2:
        raise ValueError(f"{col} must hold two labels, found {found}")
    return found[0], found[1]


def number_rows(df: DataFrame, order: list[str], out: str = "token_id") -> DataFrame:
    """Adds the place of each row, from 0, in the order of columns; equal rows are numbered arbitrarily.

    Rows are dealt by ranges and sorted inside them; a partition's first number is the count of the rows before it, so no
    task orders the whole table.  Written once, as numbers must not change between uses."""
    in_order = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    in_order = materialise(in_order, "numbered").withColumn("_part", F.shiftright("_at", 33))
    sizes = in_order.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row per partition
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    place = F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)
    return in_order.join(starts, "_part").withColumn(out, place).drop("_part", "_start", "_at")


def align(a: DataFrame, b: DataFrame, order_a: list[str], order_b: list[str], out: str = "place") -> DataFrame:
    """The columns of both tables side by side, row by row in their own orders, and the row's place from 0.

    However differently the tables are split, each is numbered by ranges (see ``number_rows``) and the two meet on the
    number; tables of different lengths are an error, as are columns of one name in both."""
    clash = set(a.columns) & set(b.columns)
    if clash:
        raise ValueError(f"columns in both tables: {sorted(clash)}")
    x, y = number_rows(a, order_a, out), number_rows(b, order_b, out)
    n, m = x.count(), y.count()
    if n != m:
        raise ValueError(f"tables of {n} and {m} rows can't be aligned")
    return x.join(y, out)


def attach_speakers(phones: DataFrame, speakers: DataFrame) -> DataFrame:
    """All phones, with speaker data where there is any (a right outer join; the speaker side is small)."""
    return speakers.join(phones, "spk", "right")


def attach_repetitions(phones: DataFrame, sentences: DataFrame) -> DataFrame:
    """Repetition numbers by sentence; a sentence listed under several words multiplies its phones."""
    return phones.join(sentences.select("rep_id", "sent_id"), "sent_id", "left")


def attach_frames(phones: DataFrame, audio: DataFrame) -> DataFrame:
    """Frame matrices (one row per audio file) onto tokens."""
    return phones.join(audio, "wav_path", "left")


def map_label(c: Column | str, labels: dict[str, str], other: str | None = None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    m = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    found = F.element_at(m, F.coalesce(c, F.lit("")))
    return found if other is None else F.coalesce(found, F.lit(other))


def class_code(c: Column | str, labels: dict[str, str]) -> Column:
    """Number of the class in code-point order of the classes, -1 for labels outside the partition."""
    order = {k: i for i, k in enumerate(sorted(set(labels.values())))}
    c = F.col(c) if isinstance(c, str) else c
    m = F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), F.lit(order[v]))])
    return F.coalesce(F.element_at(m, F.coalesce(c, F.lit(""))), F.lit(-1))


def group_label(*cols: str) -> Column:
    """Columns joined by a slash; null as nan, as a text table would show it."""
    return F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in cols])


def formant_ceiling(gender: Column | str) -> Column:
    g = F.lower(F.col(gender) if isinstance(gender, str) else gender)
    return F.when(g == "f", FORMANT_CEILING["f"]).otherwise(FORMANT_CEILING["m"])


def model_frames(start: Column, end: Column, n_frames: Column, duration: Column) -> tuple[Column, Column]:
    """First and last frame (exclusive) of a token in a frame matrix that spans the whole audio."""
    a = F.floor(start * n_frames / duration).cast("int")
    b = F.greatest(a + 1, F.floor(end * n_frames / duration).cast("int"))
    return a, F.least(b, n_frames.cast("int"))


def encoder_frames(start: Column, end: Column, duration: Column) -> tuple[Column, Column]:
    """The same for an encoder of fixed frame rate that hears at most 30 seconds."""
    rate = F.lit(ENCODER_FRAMES_PER_SECOND)
    a = F.floor(start * rate).cast("int")
    b = F.greatest(a + 1, F.floor(end * rate).cast("int"))
    return a, F.least(b, F.floor(F.least(duration, F.lit(ENCODER_SECONDS)) * rate).cast("int"))


def mean_pool(frames: DataFrame, keys: list[str], matrix: str, start: str, end: str) -> DataFrame:
    """Mean of rows start..end (exclusive) of a frame matrix column, as ``v``; an empty range gives null."""
    n = F.greatest(F.col(end) - F.col(start), F.lit(0))
    part = F.when((n > 0) & (F.col(start) >= 0) & (F.col(start) < F.size(matrix)), F.slice(F.col(matrix), F.col(start) + 1, n))
    width = F.size(part[0])
    zero = F.array_repeat(F.lit(0.0), width)
    total = F.aggregate(part, zero, lambda acc, row: F.zip_with(acc, row.cast("array<double>"), lambda x, y: x + y))
    return frames.withColumn("v", F.transform(total, lambda x: x / F.size(part))).drop(matrix)


def burg(x: np.ndarray, order: int) -> np.ndarray:
    """Linear prediction coefficients (leading 1) by Burg's recursion."""
    a, f, b = np.array([1.0]), x[1:].copy(), x[:-1].copy()
    for _ in range(order):
        den = f @ f + b @ b
        k = -2 * (f @ b) / den if den > 0 else 0.0
        a = np.concatenate((a, [0.0])) + k * np.concatenate((a, [0.0]))[::-1]
        f, b = f[1:] + k * b[1:], b[:-1] + k * f[:-1]
    return a


def formants(x: np.ndarray, rate: int, ceiling: float, n_formants: int = 5, window: float = 0.05, at: float = 0.5) -> tuple[float, float]:
    """F1 and F2 in Hz near the relative time ``at`` of a segment; NaN where none is found."""
    from quillon.sources.readers import resample

    y = resample(np.asarray(x, float), rate, int(2 * ceiling))
    rate = int(2 * ceiling)
    half = int(window * rate / 2)
    mid = int(at * len(y))
    seg = y[max(0, mid - half) : mid + half]
    if len(seg) < 2 * n_formants + 2:
        return float("nan"), float("nan")
    seg = np.append(seg[0], seg[1:] - np.exp(-2 * np.pi * 50 / rate) * seg[:-1]) * np.hanning(len(seg) + 2)[1:-1]
    roots = np.roots(burg(seg, 2 * n_formants))
    roots = roots[np.imag(roots) > 0]
    hz = np.sort(np.angle(roots) * rate / (2 * np.pi))
    hz = hz[(hz > 50) & (hz < ceiling - 50)]
    hz = np.concatenate((hz, [np.nan, np.nan]))
    return float(hz[0]), float(hz[1])


def extract_formants(tokens: DataFrame, audio: DataFrame, at: float = 0.5) -> DataFrame:
    """tokens with F1, F2 and an error text; audio is (path, rate, samples) joined by ``wav_path``.

    Every non-empty label is measured, vowel or not; empty labels get null and no error."""
    joined = tokens.join(audio.withColumnRenamed("path", "wav_path"), "wav_path", "left").withColumn("ceiling", formant_ceiling("Gender"))

    def run(batches):
        for pdf in batches:
            out = []
            for p, on, off, rate, x, top in zip(*(pdf[c] for c in ("phoneme", "onset", "offset", "rate", "samples", "ceiling"))):
                if not p:
                    out.append((None, None, None))
                elif x is None:
                    out.append((None, None, "FileNotFoundError: no audio"))
                else:
                    seg = np.asarray(x)[int(on * rate) : int(off * rate)]
                    f1, f2 = formants(seg, int(rate), float(top), at=at)
                    bad = np.isnan(f1) or np.isnan(f2)
                    out.append((None if np.isnan(f1) else f1, None if np.isnan(f2) else f2, "no formant found at the measuring point" if bad else None))
            pdf = pdf.drop(columns=["samples", "rate", "ceiling"])
            yield pdf.assign(**dict(zip(("F1", "F2", "error"), map(list, zip(*out)) if out else ([], [], []))))

    plain = joined.drop("samples", "rate", "ceiling", "F1", "F2")
    kinds = ", ".join(f"`{c}` {k}" for c, k in plain.dtypes) + ", F1 double, F2 double, error string"
    return joined.drop("F1", "F2").mapInPandas(run, kinds)


def embed_audio(audio: DataFrame, predict, width: int) -> DataFrame:
    """Plug-in for frame representations: ``predict`` maps (samples, rate) of one file to a frame matrix.

    Models are loaded inside the function, once per worker; no model ships with this library."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"wav_path": pdf["path"], "frames": [[list(map(float, r)) for r in predict(np.asarray(x), int(r_))] for x, r_ in zip(pdf["samples"], pdf["rate"])]})

    return audio.mapInPandas(run, "wav_path string, frames array<array<double>>")


def encode_windows(audio: DataFrame, make_encoder, width: int, rate: int = SAMPLE_RATE, seconds: int = ENCODER_SECONDS, batch: int = 8) -> DataFrame:
    """(wav_path, n_frames, frames): an encoder of fixed windows over audio (path, rate, samples) at ``rate``.

    ``make_encoder`` loads the model once a worker and returns a function from a (batch x samples) array to a (batch x
    frames x ``width``) array of ENCODER_FRAMES_PER_SECOND; files go through it ``batch`` at a time, cut or filled with
    zeros to ``seconds``.  ``n_frames`` counts the frames that hold sound; those of the filling are dropped.  Null or empty
    samples have no frames; samples at another rate raise, as they must be resampled first."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, DoubleType

    size = rate * seconds

    def make():
        encode = make_encoder()
        return lambda x: np.asarray(encode(x), dtype=np.float64).reshape(len(x), -1)

    predict = predict_batch_udf(make, return_type=ArrayType(DoubleType()), batch_size=batch, input_tensor_shapes=[[size]])
    right = F.when(F.col("rate") == rate, F.coalesce("samples", F.array().cast("array<double>"))).otherwise(F.raise_error(F.concat(F.lit("resample first: "), F.col("path"))))
    d = audio.select(F.col("path").alias("wav_path"), F.slice(right.cast("array<double>"), 1, size).alias("x"))
    d = d.withColumn("n_frames", F.ceil(F.size("x") * ENCODER_FRAMES_PER_SECOND / F.lit(rate)).cast("int"))
    d = d.withColumn("y", predict(F.concat("x", F.array_repeat(F.lit(0.0), size - F.size("x")))))
    frame = lambda i: F.slice("y", i * width + 1, F.lit(width))
    frames = F.when(F.col("n_frames") > 0, F.transform(F.sequence(F.lit(0), F.col("n_frames") - 1), frame)).otherwise(F.array().cast("array<array<double>>"))
    return d.select("wav_path", "n_frames", frames.alias("frames"))


def energy_encoder(width: int, step: int):
    """A stand-in encoder without weights: each frame of ``step`` samples as means over ``width`` equal parts of it."""
    return lambda: lambda x: x.reshape(len(x), -1, width, step // width).mean(axis=3)
