"""Schemas and fixed label tables."""

from __future__ import annotations

from pyspark.sql import types as t

TOKENS = t.StructType([
    t.StructField("token_id", t.LongType()), t.StructField("spk", t.StringType()), t.StructField("L1", t.StringType()),
    t.StructField("Gender", t.StringType()), t.StructField("Age", t.DoubleType()), t.StructField("sent_id", t.LongType()),
    t.StructField("rep_id", t.IntegerType()), t.StructField("phoneme", t.StringType()), t.StructField("onset", t.DoubleType()),
    t.StructField("offset", t.DoubleType()), t.StructField("dur", t.DoubleType()), t.StructField("wav_path", t.StringType()),
    t.StructField("F1", t.DoubleType()), t.StructField("F2", t.DoubleType()),
])
REPS = t.StructType([
    t.StructField("token_id", t.LongType()), t.StructField("model", t.StringType()), t.StructField("v", t.ArrayType(t.FloatType())),
])
SPEAKERS = t.StructType([t.StructField(c, k) for c, k in (("spk", t.StringType()), ("L1", t.StringType()), ("Age", t.DoubleType()), ("Gender", t.StringType()))])

# Phone labels and their classes.
LOBANOV_VOWELS = ("a", "ɑ", "e", "ɛ", "i", "ɪ", "o", "ø", "œ", "u", "y")
CV_VOWELS = ("a", "e", "ɛ", "i", "o", "ø", "u", "y")
CONSONANTS = ("p", "b", "f", "v", "s", "z", "ʃ", "ʒ", "t", "d", "k", "g", "m", "n", "l", "ʁ")
VOWEL_HEIGHT = {
    "high": ("i", "y", "ɪ", "u"),
    "mid": ("e", "ø", "o", "ɛ", "œ"),
    "low": ("a", "ɑ"),
}
PARTITIONS = {
    "front_back": {"front": ("i", "e", "ɛ", "a", "y", "ø"), "back": ("u", "o")},
    "height": {"high": ("i", "y", "u"), "mid": ("e", "ø", "o", "ɛ"), "low": ("a",)},
    "rounding": {"unrounded": ("i", "e", "ɛ", "a"), "rounded": ("y", "ø", "u", "o")},
    "C_vs_V": {"vowel": CV_VOWELS, "consonant": CONSONANTS},
    "manner": {
        "vowel": CV_VOWELS, "stop": ("p", "b", "t", "d", "k", "g"), "fricative": ("f", "v", "s", "z", "ʃ", "ʒ", "ʁ"),
        "nasal": ("m", "n"), "lateral": ("l",),
    },
    "voicing": {
        "voiced": (*CV_VOWELS, "b", "d", "g", "v", "z", "ʒ", "m", "n", "l", "ʁ"),
        "voiceless": ("p", "t", "k", "f", "s", "ʃ"),
    },
}
ROPE_ACOUSTIC = (-0.20, 0.20)
ROPE_CLASSES = ("equivalent", "non-equivalent", "indeterminate", "insufficient_data", "rope_undefined")
ELLIPSE_STD = 2.4477
FORMANT_CEILING = {"f": 5000, "m": 4500}
ENCODER_FRAMES_PER_SECOND = 50
ENCODER_SECONDS = 30
SAMPLE_RATE = 16_000


def label_of(classes: dict[str, tuple[str, ...]]) -> dict[str, str]:
    """phone -> class, from class -> phones."""
    return {p: c for c, phones in classes.items() for p in phones}
