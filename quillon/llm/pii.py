"""Personal data by weak supervision, in DataFrame operations only.

Candidates come from strict patterns (matches that pass their checks are *base* spans and always stay) and from looser
ones.  Labelers vote on each candidate: the strict pattern, a structure check, gazetteers, the words before it and the
characters around it.  Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is
for each kind; the resulting probabilities are soft labels for a naive Bayes span classifier over shape features, which
decides on the looser candidates.  Strict matches that fail their checks vote and train as candidates, but never return
as spans.

A span's place comes from splitting the text at the pattern: the pieces between matches and the matches themselves add
up to it.  Pieces and matches are found once for each text and pattern and bound to a name before they are walked, and
running sums over the matches of one document give all places, so the time is linear in the matches of a text.

Besides the four kinds with base spans there is ``secret``: keys, tokens and passwords.  It has no strict pattern, so the
classifier decides on all of its spans.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.durable import materialise

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
ROUNDS = 8

# Strict patterns.  Look-behinds start a match only where a run starts, which leaves the leftmost matches as they are
# and keeps the time linear on long runs.
_USER = "[A-Za-z0-9._%+-]"
STRICT = {
    "email": rf"(?:(?<!{_USER})|\G){_USER}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"{_USER}++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]{1,3}(?:\x20?[(\[](?:\.|dot)[)\]]\x20?[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[./_][0-9]{4}){3}(?![0-9])|(?<![0-9])3[47][0-9]{2}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}(?![\x20-]?[0-9])",
    "phone": r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
    "secret": (
        r"(?<=(?:key|ecret|oken|assword|passwd|auth)[\"']?\x20?[=:]\x20?[\"']?)[A-Za-z0-9/+_-]{16,}+"
        r"|(?<![A-Za-z0-9])(?:AKIA|ghp_|sk-|xox[bp]-)[A-Za-z0-9_-]{16,}+|(?<![A-Za-z0-9])[0-9a-f]{32,64}(?![A-Za-z0-9])"
    ),
}

# Words that speak for or against a kind when they stand shortly before a span, endings and prefixes.
FOR = {
    "email": "mail|contact|write|reach|address|reply",
    "ip": "ip|host|server|address|login|client|gateway",
    "card": "card|visa|credit|payment|pay|iban|account",
    "phone": "phone|call|tel|mobile|fax|contact|dial",
    "secret": "key|secret|token|password|passwd|auth|bearer",
}
AGAINST = {
    "email": "regex|pattern|placeholder",
    "ip": "version|release|section|chapter|v",
    "card": "isbn|serial|order|hash|token|key|tracking",
    "phone": "isbn|serial|order|version|id",
    "secret": "sha|digest|checksum|commit|etag|uuid",
}
DOMAINS = "com|org|net|edu|gov|de|fr|es|uk|io|info|eu"
CARD_PREFIX = "4|5[1-5]|2[2-7]|3[47]|6"
SECRET_FORM = "^(?:AKIA|ghp_|sk-|xox[bp]-)|^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$"

LABELERS = ("strict", "structure", "gazetteer", "context", "border")
FEATURES = ("length", "separators", "digits", "before", "after")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check (from the right, every second digit doubled)."""
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda acc, i: acc + F.when((n - i) % 2 == 0, _digit(digits, i)).otherwise(
            _digit(digits, i) * 2 - F.when(_digit(digits, i) > 4, 9).otherwise(0)
        ),
    )
    return total % 10 == 0


def _digit(digits: Column, i: Column) -> Column:
    return F.substr(digits, i, F.lit(1)).cast("int")


def _only_digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def _small_parts(span: Column) -> Column:
    """Whether all numbers of an address are at most 255."""
    parts = F.filter(F.split(span, "[^0-9]+"), lambda p: p != "")
    parts = F.transform(parts, lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.try_to_number(F.lpad(p, 3, "0"), F.lit("000")) <= 255))


def _passes(kind: Column, span: Column) -> Column:
    """The checks a strict match must pass to be a base span."""
    digits = _only_digits(span)
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", _small_parts(span))
        .when(kind == "card", F.length(digits).between(16, 19) & _luhn(digits))
        .otherwise(F.length(digits).between(8, 15))
    )


def _matches(text: Column, kind: str, pattern: str, strict: bool, needed: Column) -> Column:
    """Array of (kind, strict, i, gap, span, before, after): matches with the length and borders of the gaps around them."""

    def each(found):
        return F.transform(
            found["spans"],
            lambda span, i: F.struct(
                F.lit(kind).alias("kind"), F.lit(strict).alias("strict"), i.alias("i"), F.length(F.get(found["gaps"], i)).alias("gap"),
                span.alias("span"), F.right(F.get(found["gaps"], i), F.lit(40)).alias("before"),
                F.left(F.get(found["gaps"], i + 1), F.lit(1)).alias("after"),
            ),
        )

    # Bound as the one element of an array: inside the inner function both are values, not expressions to be run again.
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("spans"), F.split(text, pattern, -1).alias("gaps"))
    none = F.array().cast("array<struct<kind:string,strict:boolean,i:int,gap:int,span:string,before:string,after:string>>")
    return F.when(needed & text.rlike(pattern), F.get(F.transform(F.array(found), each), F.lit(0))).otherwise(none)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, doc_id, found``: all matches of all patterns in each document, written once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), text.alias("text"))
    digit = F.col("text").rlike("[0-9]")
    needed = {
        "email": F.contains("text", F.lit("@")), "ip": digit, "card": digit, "phone": F.contains("text", F.lit("+")) & digit,
    }
    bracket = F.col("text").rlike(r"[(\[](?:at|dot|\.)[)\]]")
    # Cheap tests of what every match must hold, before the slow look-behind.
    assigned = F.col("text").rlike(r"[=:]\x20?[\"']?[A-Za-z0-9/+_-]{16}")
    prefixed = F.contains("text", F.lit("AKIA")) | F.contains("text", F.lit("ghp_")) | F.contains("text", F.lit("sk-")) | F.contains("text", F.lit("xox"))
    loose = {"email": bracket, "ip": bracket & digit, "card": digit, "phone": digit, "secret": assigned | prefixed | F.col("text").rlike("[0-9a-f]{32}")}
    arrays = [_matches(F.col("text"), k, STRICT[k], True, needed[k]) for k in BASE_KINDS]
    arrays += [_matches(F.col("text"), k, LOOSE[k], False, loose[k]) for k in LOOSE]
    return materialise(d.select("row", "doc_id", F.concat(*arrays).alias("found")), "pii-scan")


def candidates(scanned: DataFrame) -> DataFrame:
    """One row per candidate with its place: ``row, kind, start, end, span, before, after, base``.

    Loose matches that overlap a base span of any kind are dropped, as they are only a worse view of it."""
    one = scanned.where("size(found) > 0").select("row", F.explode("found").alias("m")).select("row", "m.*")
    run = Window.partitionBy("row", "kind", "strict").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.sum(F.col("gap") + F.length("span")).over(run), F.lit(0))
    one = one.withColumn("start", (done + F.col("gap")).cast("bigint")).withColumn("end", F.col("start") + F.length("span"))
    one = one.withColumn("base", F.col("strict") & _passes(F.col("kind"), F.col("span")))
    # Running values from both ends; a frame that ends at the last row would be summed up anew for every row.
    order = ["start", "end", "kind", "strict", "i"]
    run = Window.partitionBy("row").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max(F.when(F.col("base"), F.col("end"))).over(run.orderBy(*order)), F.lit(0))
    next_ = F.min(F.when(F.col("base"), F.col("start"))).over(run.orderBy(*[F.desc(c) for c in order]))
    clear = (reach <= F.col("start")) & (next_.isNull() | (next_ >= F.col("end")))
    one = one.withColumn("clear", clear).where("base or clear")
    return one.select("row", "kind", "strict", "start", "end", "span", "before", "after", "base")


def votes(found: DataFrame) -> DataFrame:
    """Adds one column per labeler (1 for, -1 against, 0 no opinion) and one per feature (a short string)."""
    kind, span, before = F.col("kind"), F.col("span"), F.lower("before")

    def by_kind(patterns: dict[str, str], text: Column, frame: str) -> Column:
        out = F.lit(False)
        for k, words in patterns.items():
            out = F.when(kind == k, text.rlike(frame.format(words))).otherwise(out)
        return out

    digits = _only_digits(span)
    ending = F.lower(span).rlike(rf"\.(?:{DOMAINS})$")
    gazetteer = (
        F.when(kind == "email", ending)
        .when(kind == "ip", ~span.rlike(r"^(?:0|255)\."))
        .when(kind == "card", digits.rlike(f"^(?:{CARD_PREFIX})"))
        .when(kind == "secret", span.rlike(SECRET_FORM))
        .otherwise(span.rlike(r"^\+[1-9]") | span.rlike(r"^\("))
    )
    loose = (
        F.when(kind == "email", ending)
        .when(kind == "ip", _small_parts(span))
        .when(kind == "card", F.length(digits).between(15, 19) & _luhn(digits))
        .when(kind == "secret", span.rlike("[0-9]") & span.rlike("[A-Za-z]"))
        .otherwise(~span.rlike(r"^\(?[01]"))
    )
    structure = F.when(F.col("strict"), _passes(kind, span)).otherwise(loose)
    word = r"(?:^|[^a-z])(?:{})[^a-z]{{0,5}}(?:[a-z]+[^a-z]{{1,3}}){{0,2}}$"
    open_border = F.col("before").rlike(r"[A-Za-z0-9]$") | F.col("after").rlike("^[A-Za-z0-9]")
    length = F.length(span)
    return found.withColumns({
        "strict_vote": F.when(F.col("strict"), F.when(F.col("base"), 1).otherwise(-1)).otherwise(0),
        "structure_vote": F.when(structure, 1).otherwise(-1),
        "gazetteer_vote": F.when(gazetteer, 1).otherwise(-1),
        "context_vote": F.when(by_kind(FOR, before, word), 1).when(by_kind(AGAINST, before, word), -1).otherwise(0),
        "border_vote": F.when(open_border, -1).otherwise(1),
        "length_feature": F.least(F.floor(length / 4), F.lit(12)).cast("string"),
        "separators_feature": F.least(length - F.length(F.regexp_replace(span, "[^A-Za-z0-9]", "")), F.lit(8)).cast("string"),
        "digits_feature": F.floor(F.length(digits) * 8 / F.greatest(length, F.lit(1))).cast("string"),
        "before_feature": _shape(F.right("before", F.lit(1))),
        "after_feature": _shape(F.col("after")),
    })


def _shape(c: Column) -> Column:
    return F.when(c == "", "none").when(c.rlike(r"^\s$"), "space").when(c.rlike("^[A-Za-z]$"), "letter").when(c.rlike("^[0-9]$"), "digit").otherwise("mark")


def reliabilities(voted: DataFrame, rounds: int = ROUNDS) -> dict:
    """{(kind, None): prior, (kind, labeler): {vote: (P(vote | true), P(vote | false))}} by expectation-maximisation.

    Works on the counts of vote patterns, at most 5 x 3**5 rows whatever the input, written once.  The start trusts each
    vote a little.  Counts are smoothed, so labelers that never vote stay neutral.
    """
    names = [f"{x}_vote" for x in LABELERS]
    patterns = materialise(voted.groupBy("kind", *names).agg(F.count(F.lit(1)).alias("n")), "pii-patterns")
    params = {(k, None): 0.5 for k in KINDS}
    params |= {(k, x): {1: (0.6, 0.2), 0: (0.2, 0.2), -1: (0.2, 0.6)} for k in KINDS for x in LABELERS}
    for _ in range(rounds):
        p = posterior(params)
        sums = [F.sum(F.col("n") * p).alias("true"), F.sum(F.col("n") * (1 - p)).alias("false")]
        long = patterns.withColumn("p", p).select(
            "kind", "n", "p", F.explode(F.array(*[F.struct(F.lit(x).alias("labeler"), F.col(f"{x}_vote").alias("vote")) for x in LABELERS])).alias("l")
        )
        by_vote = long.groupBy("kind", "l.labeler", "l.vote").agg(F.sum(F.col("n") * F.col("p")).alias("true"), F.sum(F.col("n") * (1 - F.col("p"))).alias("false"))
        total = {r["kind"]: (r["true"], r["false"]) for r in patterns.groupBy("kind").agg(*sums).collect()}
        seen = {(r["kind"], r["labeler"], r["vote"]): (r["true"], r["false"]) for r in by_vote.collect()}
        for k, (t, f) in total.items():
            params[k, None] = (t + 1) / (t + f + 2)
            for x in LABELERS:
                params[k, x] = {
                    v: tuple((seen.get((k, x, v), (0.0, 0.0))[side] + 1) / ((t, f)[side] + 3) for side in (0, 1)) for v in (1, 0, -1)
                }
    return params


def posterior(params: dict) -> Column:
    """P(true | votes) as an expression."""
    odds = F.lit(0.0)
    for k in KINDS:
        s = F.lit(params[k, None]) / F.lit(1 - params[k, None])
        s = F.log(s)
        for x in LABELERS:
            vote = F.col(f"{x}_vote")
            table = {v: F.log(F.lit(a) / F.lit(b)) for v, (a, b) in params[k, x].items()}
            s = s + F.when(vote == 1, table[1]).when(vote == -1, table[-1]).otherwise(table[0])
        odds = F.when(F.col("kind") == k, s).otherwise(odds)
    return 1 / (1 + F.exp(-odds))


def classifier(labelled: DataFrame) -> Column:
    """Log odds of a naive Bayes classifier over the features, trained on the soft labels ``p`` of all candidates.

    Its tables hold at most 5 kinds x 5 features x 13 values."""
    long = labelled.select(
        "kind", "p", F.explode(F.array(*[F.struct(F.lit(x).alias("feature"), F.col(f"{x}_feature").alias("value")) for x in FEATURES])).alias("f")
    )
    rows = long.groupBy("kind", "f.feature", "f.value").agg(F.sum("p").alias("true"), F.sum(1 - F.col("p")).alias("false")).collect()
    score = F.lit(0.0)
    for k in KINDS:
        mine = [r for r in rows if r["kind"] == k]
        t = sum(r["true"] for r in mine if r["feature"] == FEATURES[0]) + 1
        f = sum(r["false"] for r in mine if r["feature"] == FEATURES[0]) + 1
        s = F.lit(0.0) + F.log(F.lit(t / f))
        for x in FEATURES:
            step = F.log(F.lit(f / t))
            for r in mine:
                if r["feature"] == x:
                    step = F.when(F.col(f"{x}_feature") == r["value"], F.log(F.lit((r["true"] + 1) / (t + 13) / ((r["false"] + 1) / (f + 13))))).otherwise(step)
            s = s + step
        score = F.when(F.col("kind") == k, s).otherwise(score)
    return score


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``row, doc_id, spans`` with spans an array of (kind, start, end, base, p), sorted.

    Places are code points, ends exclusive; the order is that of KINDS, then start.  Null and empty texts have none;
    rows that repeat a document get their own result; ids may be null.  With no candidates at all nothing is learned.
    Further columns are ignored.
    """
    scanned = scan(docs, id_col, text_col)
    voted = materialise(votes(candidates(scanned)), "pii-votes")
    labelled = voted.withColumn("p", posterior(reliabilities(voted)))
    kept = labelled.withColumn("score", classifier(labelled)).where("base or (not strict and score > 0 and p > 0.5)")
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    spans = kept.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct(place.alias("order"), "start", "end", "kind", "base", F.round("p", 6).alias("p")))).alias("spans")
    )
    none = F.array().cast("array<struct<order:bigint,start:bigint,end:bigint,kind:string,base:boolean,p:double>>")
    return scanned.select("row", "doc_id").join(spans, "row", "left").withColumn("spans", F.coalesce("spans", none))


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def _is_kind(kind: str, s: Column) -> Column:
    return s["kind"] == kind


def op4_weak_pii(spark, sf_dir: str) -> DataFrame:
    found = find_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter(base, partial(_is_kind, k))).cast("bigint").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", partial(_is_kind, "secret"))).cast("bigint").alias("n_secret"), F.size("spans").cast("bigint").alias("n_spans"),
    )
