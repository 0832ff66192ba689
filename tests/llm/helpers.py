"""Fixtures shared by the tests of the training-data operators."""

import random
from contextlib import contextmanager

#: Texts that stress edges: null, empty, blank, ties, repeats, one word, non-ASCII, control characters, one long text.
EDGES = [
    None, "", "  \t\n", "word", "word", "Word", "a b c", "a  b\tc", "a b c ", "é è ü 漢字 😀", "x\x00y z", "\\### Assistant: </turn> ok", "A" * 300,
    "ab " * 400, "9" * 60, "one two three four five six seven eight nine ten eleven twelve",
]


def corpus(seed=0, n=60, words=40, vocabulary=80):
    """Random texts with exact copies, near copies and shared passages, and the edges."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 8))) for _ in range(vocabulary)]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 2 * words))) for _ in range(n)]
    passage = " ".join(rng.choice(vocab) for _ in range(45))
    for i in range(0, n, 5):
        texts[i] = texts[rng.randrange(n)]
    for i in range(1, n, 7):
        w = texts[rng.randrange(n)].split()
        w[rng.randrange(len(w))] = "edited"
        texts[i] = " ".join(w)
    for i in range(2, n, 6):
        w = texts[i].split()
        at = rng.randrange(len(w) + 1)
        texts[i] = " ".join([*w[:at], passage, *w[at:]])
    rows = list(enumerate([*texts, *EDGES]))
    rng.shuffle(rows)
    return rows


def frame(spark, rows, extra=True):
    """documents with ids and texts, plus columns whose names clash with names used inside the operators."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        from pyspark.sql import functions as F

        for c in ("n", "key", "row", "size", "hash", "component", "start", "source", "lang", "_id"):
            df = df.withColumn(c, F.lit("x"))
    return df.repartition(3)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string")


@contextmanager
def no_broadcast(spark):
    """Spark would broadcast every table here, and fails when one is broadcast."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "1g", "spark.sql.maxBroadcastTableSize": "1"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k in conf:
            spark.conf.unset(k)
