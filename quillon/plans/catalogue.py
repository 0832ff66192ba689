"""The registered queries of the statistics engine and their SQL.

A query is a composition of operators over the canonical views; its SQL computes the same from the raw tables in another
engine.  Doubles are rounded on both sides, as sums differ in their last digits.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import schema
from quillon.config import Config
from quillon.functions import vectors as V
from quillon.operators import classify as C
from quillon.operators import cluster as K
from quillon.operators import descriptive as D
from quillon.operators import distance as X
from quillon.operators import hypothesis as H
from quillon.operators import ingest as I
from quillon.operators import mixed as M
from quillon.operators import moments as MM
from quillon.operators import reduce as R
from quillon.operators import resampling as B
from quillon.operators import rope as P
from quillon.operators import umap as U
from quillon.sources import canonical as S
from quillon.sources.durable import materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_NORMED = f"""
t as ({S.TOKENS_SQL}),
vs as (select spk, avg(F1) as m1, stddev_samp(F1) as s1, avg(F2) as m2, stddev_samp(F2) as s2 from t
       where lower(trim(phoneme)) in ('a','ɑ','e','ɛ','i','ɪ','o','ø','œ','u','y') group by spk),
nt as (select t.*, (F1 - m1) / nullif(s1, 0) as F1_normed, (F2 - m2) / nullif(s2, 0) as F2_normed from t left join vs using (spk)),
v as (select * from nt where lower(trim(phoneme)) in ('a','ɑ','e','ɛ','i','ɪ','o','ø','œ','u','y'))
"""
_VECTORS = f"""
r as ({S.REPS_SQL}),
rx as (select r.* exclude (embedding), unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as dim from r),
mx as (select 'whisper' as model, * from rx union all select 'xlsr' as model, * from rx where dim < 32),
vx as (select * from mx where phoneme in ('a','e','ɛ','i','o','ø','u','y'))
"""
_CENTROID_DIST = """
c as (select model, phoneme, dim, avg(x) as x from vx group by all),
far as (select a.model, a.phoneme as phoneme_i, b.phoneme as phoneme_j,
          1 - greatest(least(sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))), 1), -1) as d
        from c a join c b on a.model = b.model and a.dim = b.dim group by all),
ac as (select phoneme, avg(F1) as f1, avg(F2) as f2 from (select token_id, phoneme, F1, F2 from r where F1 is not null and phoneme in ('a','e','ɛ','i','o','ø','u','y')) group by phoneme),
eu as (select a.phoneme as phoneme_i, b.phoneme as phoneme_j, sqrt((a.f1 - b.f1) ** 2 + (a.f2 - b.f2) ** 2) as d from ac a, ac b)
"""


def query(sql: str | None = None):
    """Register a function as the query of its name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    # Adding zero turns a negative zero into zero.
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c, k in df.dtypes if k == "double"})


def normed(spark, d) -> DataFrame:
    return D.lobanov(S.tokens(spark, d))


def vowel_reps(spark, d) -> DataFrame:
    """Vectors of vowels under both models."""
    return S.models(S.reps(spark, d).where(I.is_vowel("phoneme")))


def acoustic_reps(spark, d) -> DataFrame:
    """Two-number acoustic vectors of vowels of the representation tokens; null where a formant is missing."""
    pair = F.when(F.col("F1").isNotNull() & F.col("F2").isNotNull(), F.array("F1", "F2"))
    return S.reps(spark, d).where(I.is_vowel("phoneme")).withColumn("v", pair)


# --- relational glue --------------------------------------------------------------------------------------------------


@query("""
with meta as (select concat('S', s_suppkey::varchar) as spk, case when s_nationkey % 2 = 0 then 'fr' else 'ru' end as L1, s_acctbal as age from supplier where s_suppkey % 3 <> 1)
select spk, L1, round(age, 6) as age, count(*)::bigint as n
from (select concat('S', l_suppkey::varchar) as spk from lineitem) p left join meta using (spk) group by all
""")
def meta_right_join(spark, d):
    meta = S.table(spark, d, "supplier").where("s_suppkey % 3 <> 1").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("spk"), F.when(F.col("s_nationkey") % 2 == 0, "fr").otherwise("ru").alias("L1"), F.col("s_acctbal").alias("age")
    )
    phones = S.table(spark, d, "lineitem").select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("spk"))
    return rounded(I.attach_speakers(phones, meta).groupBy("spk", "L1", "age").agg(F.count(F.lit(1)).alias("n")))


@query("""
with w as (select (l_orderkey % 500)::varchar as word, l_linenumber as rep, max(l_orderkey)::int as sent_id from lineitem where l_linenumber <= 6 group by all),
s as (select rep::int as rep_id, sent_id from w)
select o.o_orderpriority as priority, s.rep_id, count(*)::bigint as n from orders o left join s on o.o_orderkey = s.sent_id group by all
""")
def rep_unpivot_join(spark, d):
    item = S.table(spark, d, "lineitem").where("l_linenumber <= 6")
    wide = item.groupBy((F.col("l_orderkey") % 500).cast("string").alias("Word")).agg(
        *[F.max(F.when(F.col("l_linenumber") == i, F.col("l_orderkey"))).cast("int").alias(f"occ.{i}") for i in range(1, 7)]
    )
    from quillon.sources.readers import unpivot_occurrences

    long = unpivot_occurrences(wide).where("sent_id is not null")
    phones = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("sent_id"), F.col("o_orderpriority").alias("priority"))
    return I.attach_repetitions(phones, long).groupBy("priority", "rep_id").agg(F.count(F.lit(1)).alias("n"))


@query("""
with f as (select concat('spk', (l_suppkey % 40)::varchar, '_x_y_s', l_orderkey::varchar, 'z.TextGrid') as name from lineitem)
select upper(split_part(split_part(name, '.', 1), '_', 1)) as spk, regexp_extract(split_part(split_part(name, '.', 1), '_', 4), '\\d+')::int as sent_id, count(*)::bigint as n
from f group by all
""")
def filename_parse(spark, d):
    from quillon.sources.readers import name_parts

    f = S.table(spark, d, "lineitem").select(
        F.concat(F.lit("dir/spk"), (F.col("l_suppkey") % 40).cast("string"), F.lit("_x_y_s"), F.col("l_orderkey").cast("string"), F.lit("z.TextGrid")).alias("path")
    )
    return name_parts(f, "path").groupBy("spk", "sent_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
with t as ({S.TOKENS_SQL})
select phoneme, L1, count(*)::bigint as total, count(*) filter (F1 is null)::bigint as missing, round(count(*) filter (F1 is null) / count(*) * 100, 6) as missing_pct from t group by phoneme, L1
union all
select phoneme, 'all' as L1, count(*)::bigint as total, count(*) filter (F1 is null)::bigint as missing, round(count(*) filter (F1 is null) / count(*) * 100, 6) as missing_pct from t group by phoneme
""")
def missing_summary(spark, d):
    return rounded(D.missing_summary(S.tokens(spark, d)))


@query(f"""
with t as ({S.TOKENS_SQL})
select gender, (case when lower(gender) = 'f' then 5000 else 4500 end)::int as ceiling, L1 || '/' || gender as label, count(*)::bigint as n
from (select Gender as gender, L1 from t where phoneme <> 't') group by all
""")
def formant_ceiling(spark, d):
    t = S.tokens(spark, d).where(I.is_vowel("phoneme"))
    return t.groupBy("Gender", I.formant_ceiling("Gender").alias("ceiling"), I.group_label("L1", "Gender").alias("label")).agg(
        F.count(F.lit(1)).alias("n")
    ).withColumnRenamed("Gender", "gender")


@query(f"""
with t as ({S.TOKENS_SQL})
select phoneme, coalesce(case when phoneme in ('i','y','ɪ','u') then 'high' when phoneme in ('e','ø','o','ɛ','œ') then 'mid' when phoneme in ('a','ɑ') then 'low' end, 'unknown') as height, count(*)::bigint as n
from t group by all
""")
def vowel_height_map(spark, d):
    heights = schema.label_of(schema.VOWEL_HEIGHT)
    return S.tokens(spark, d).groupBy("phoneme", I.map_label("phoneme", heights, "unknown").alias("height")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
with t as (select distinct phoneme from ({S.REPS_SQL}))
select phoneme,
  (case when phoneme in ('u','o') then 0 when phoneme in ('i','e','ɛ','a','y','ø') then 1 else -1 end)::int as front_back,
  (case when phoneme in ('i','y','u') then 0 when phoneme = 'a' then 1 when phoneme in ('e','ø','o','ɛ') then 2 else -1 end)::int as height,
  (case when phoneme in ('y','ø','u','o') then 0 when phoneme in ('i','e','ɛ','a') then 1 else -1 end)::int as rounding,
  (case when phoneme in ('s','t') then 0 else 1 end)::int as C_vs_V,
  (case phoneme when 's' then 0 when 't' then 3 else 4 end)::int as manner,
  (case when phoneme in ('s','t') then 1 else 0 end)::int as voicing
from t
""")
def partition_codes(spark, d):
    t = S.reps(spark, d).select("phoneme").distinct()
    return t.select("phoneme", *[I.class_code("phoneme", schema.label_of(p)).alias(n) for n, p in schema.PARTITIONS.items()])


@query("""
with a as (select vec_id, embedding, (vec_id % 7) * 0.1::double as t0, (vec_id % 7) * 0.1::double + (vec_id % 3) * 0.35::double as t1 from embeddings),
f as (select *, floor(t0 * 32 / 1.6::double)::int as s, least(greatest(floor(t0 * 32 / 1.6::double)::int + 1, floor(t1 * 32 / 1.6::double)::int), 32) as e from a)
select vec_id, s::int as first_frame, e::int as last_frame,
  case when e > s then round((select avg(x::double) from unnest(list_slice(embedding, 2 * s + 1, 2 * e)) with ordinality as u(x, i) where i % 2 = 1), 6) end as v0,
  case when e > s then round((select avg(x::double) from unnest(list_slice(embedding, 2 * s + 1, 2 * e)) with ordinality as u(x, i) where i % 2 = 0), 6) end as v1
from f
""")
def frame_pooling(spark, d):
    e = S.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    frames = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.array(F.get("e", i * 2), F.get("e", i * 2 + 1)))
    t0 = F.col("vec_id") % 7 * F.lit(0.1)
    t1 = t0 + F.col("vec_id") % 3 * F.lit(0.35)
    a, b = I.model_frames(t0, t1, F.lit(32), F.lit(1.6))
    t = e.select("vec_id", frames.alias("frames"), a.alias("first_frame"), b.alias("last_frame"))
    p = I.mean_pool(t, ["vec_id"], "frames", "first_frame", "last_frame")
    return rounded(p.select("vec_id", "first_frame", "last_frame", F.get("v", F.lit(0)).alias("v0"), F.get("v", F.lit(1)).alias("v1")))


@query(f"""
with t as ({S.TOKENS_SQL})
select L1 as label, count(*)::bigint as n, count(distinct spk)::bigint as n_speakers from t where L1 is not null group by L1
""")
def label_domain(spark, d):
    t = S.tokens(spark, d).where("L1 is not null")
    return t.groupBy(F.col("L1").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("spk").alias("n_speakers"))


_TOKEN_ORDER = ["spk", "sent_id", "rep_id", "phoneme", "dur", "F1", "F2"]


@query(f"""
with t as ({S.TOKENS_SQL})
select spk, sent_id, rep_id, phoneme, round(dur, 6) as dur, round(F1, 6) as F1,
       row_number() over (order by {', '.join(c + ' nulls first' for c in _TOKEN_ORDER)}) - 1 as token_id from t
""")
def token_ids(spark, d):
    out = I.number_rows(S.tokens(spark, d), _TOKEN_ORDER)
    return rounded(out.select("spk", "sent_id", "rep_id", "phoneme", "dur", "F1", "token_id"))


# --- normalisation and description ------------------------------------------------------------------------------------


@query(f"with {_NORMED} select spk, sent_id, rep_id, phoneme, round(F1_normed, 6) as F1_normed, round(F2_normed, 6) as F2_normed from nt")
def lobanov_norm(spark, d):
    return rounded(normed(spark, d).select("spk", "sent_id", "rep_id", "phoneme", "F1_normed", "F2_normed"))


def _describe_sql(c: str) -> str:
    return (
        f"round(stddev_samp({c}) / nullif(avg({c}), 0), 4) as {c}_cv, round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 6) as {c}_iqr, round(avg({c}), 6) + 0.0 as {c}_mean, "
        f"round(quantile_cont({c}, 0.5), 6) as {c}_median, round(stddev_samp({c}), 6) as {c}_std, round(quantile_cont({c}, 0.25), 6) as {c}_q1, round(quantile_cont({c}, 0.75), 6) as {c}_q3"
    )


@query(f"with {_NORMED} select L1, Gender, phoneme, {_describe_sql('F1_normed')}, {_describe_sql('F2_normed')} from v group by all")
def descriptive_report(spark, d):
    out = D.describe(_l1(spark, d), ["L1", "Gender", "phoneme"], ["F1_normed", "F2_normed"])
    return rounded(out.withColumns({c: F.round(c, 4) for c in ("F1_normed_cv", "F2_normed_cv")}))


@query(f"""with {_NORMED},
s as (select phoneme, spk, count(*) as n, var_samp(F1_normed) as v, var_pop(F1_normed) * count(*) as ss from v where F1_normed is not null group by all)
select phoneme, a.n::bigint as n, n_speakers::bigint as n_speakers, round(var_total, 6) as var_total, round(var_intra, 6) as var_intra_speaker, round(pooled, 6) as var_pooled
from (select phoneme, sum(n) as n, count(*) as n_speakers, avg(v) as var_intra, sum(ss) / nullif(sum(n) - count(*), 0) as pooled from s group by phoneme) a
join (select phoneme, var_samp(F1_normed) as var_total from v group by phoneme) b using (phoneme)
""")
def variance_decomposition(spark, d):
    return rounded(D.variance_decomposition(D.vowels(normed(spark, d)), "F1_normed"))


@query(f"with {_NORMED} select spk, Gender, phoneme, round(avg(F1_normed), 6) as F1_normed_mean, count(F1_normed)::bigint as n from v where F1_normed is not null group by all")
def speaker_means(spark, d):
    return rounded(D.unit_means(D.vowels(normed(spark, d)), "F1_normed", ["spk", "Gender", "phoneme"]))


@query(f"""with {_NORMED},
g as (select phoneme, L1 || '/' || Gender as grp, count(*) as n, avg(F2_normed) as cx, avg(F1_normed) as cy, var_samp(F2_normed) as a, var_samp(F1_normed) as c, covar_samp(F2_normed, F1_normed) as b
      from v where F1_normed is not null and F2_normed is not null group by all),
h as (select *, (a + c) / 2 as mid, sqrt((a - c) ** 2 / 4 + b ** 2) as root from g)
select phoneme, grp, n::bigint as n, round(cx, 6) as cx, round(cy, 6) as cy, case when n >= 3 then round(2 * 2.4477 * sqrt(mid + root), 6) end as width,
  case when n >= 3 then round(2 * 2.4477 * sqrt(greatest(mid - root, 0)), 6) end as height, case when n >= 3 then round(degrees(atan2(mid + root - a, b)), 4) end as angle from h
""")
def ellipse_params(spark, d):
    v = D.vowels(normed(spark, d)).withColumn("grp", I.group_label("L1", "Gender"))
    out = D.ellipse(v, "F2_normed", "F1_normed", ["phoneme", "grp"])
    return rounded(out.withColumn("angle", F.round("angle", 4)))


@query(f"""with {_NORMED},
q as (select phoneme, L1, quantile_cont(F1_normed, 0.25) as q1, quantile_cont(F1_normed, 0.5) as md, quantile_cont(F1_normed, 0.75) as q3 from v where F1_normed is not null group by all)
select phoneme, L1, round(q1, 6) as q1, round(md, 6) as median, round(q3, 6) as q3, round(min(F1_normed) filter (F1_normed between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)), 6) as low,
  round(max(F1_normed) filter (F1_normed between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)), 6) as high, count(*) filter (not F1_normed between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1))::bigint as outliers
from v join q using (phoneme, L1) where F1_normed is not null group by all
""")
def boxplot_stats(spark, d):
    return rounded(D.box_plot(_l1(spark, d), "F1_normed", ["phoneme", "L1"]))


@query(f"with {_NORMED} select spk, phoneme, rep_id, round(F1_normed, 6) as F1_normed from v where rep_id in (1, 2, 3) and F1_normed is not null")
def intra_speaker_subset(spark, d):
    v = D.vowels(normed(spark, d)).where(F.col("rep_id").isin(1, 2, 3) & F.col("F1_normed").isNotNull())
    return rounded(v.select("spk", "phoneme", "rep_id", "F1_normed"))


@query(f"""with t as ({S.TOKENS_SQL}),
g as (select phoneme, avg(F1) filter (phoneme in ('a','e','ɛ','i','o','ø','u','y')) as a, avg(F2) filter (phoneme in ('a','e','ɛ','i','o','ø','u','y')) as b, avg(dur) * 1000 as c from t group by phoneme),
h as (select phoneme, coalesce(a, avg(a) over ()) as F1, coalesce(b, avg(b) over ()) as F2, c as dur_ms from g)
select phoneme, round(F1, 6) as F1, round((F1 - avg(F1) over ()) / stddev_pop(F1) over (), 6) + 0.0 as F1_z, round(F2, 6) as F2, round((F2 - avg(F2) over ()) / stddev_pop(F2) over (), 6) + 0.0 as F2_z,
  round(dur_ms, 6) as dur_ms, round((dur_ms - avg(dur_ms) over ()) / stddev_pop(dur_ms) over (), 6) + 0.0 as dur_ms_z from h
""")
def zscore_features(spark, d):
    return rounded(D.feature_table(S.tokens(spark, d)))


# --- vectors and distances --------------------------------------------------------------------------------------------


@query(f"with {_VECTORS} select model, phoneme, dim::int as dim, round(avg(x), 8) + 0.0 as x, count(*)::bigint as n from vx group by all")
def centroids_neural(spark, d):
    c = X.centroids(vowel_reps(spark, d), ["model", "phoneme"])
    return rounded(c.select("model", "phoneme", "n", F.posexplode("centroid").alias("dim", "x")), 8)


@query(f"""with {_VECTORS.split(',' + chr(10) + 'rx')[0]}
select phoneme, count(*)::bigint as n, round(avg(F1), 6) as F1, round(avg(F2), 6) as F2 from r where F1 is not null and F2 is not null and phoneme in ('a','e','ɛ','i','o','ø','u','y') group by phoneme
""")
def centroids_acoustic(spark, d):
    c = X.centroids(acoustic_reps(spark, d), ["phoneme"])
    return rounded(c.select("phoneme", "n", F.get("centroid", F.lit(0)).alias("F1"), F.get("centroid", F.lit(1)).alias("F2")))


def _neural_matrix(spark, d):
    return X.long_matrix(X.centroids(vowel_reps(spark, d), ["model", "phoneme"]), metric="cosine", within=["model"])


def _acoustic_matrix(spark, d):
    return X.long_matrix(X.centroids(acoustic_reps(spark, d), ["phoneme"]), metric="euclidean")


@query(f"with {_VECTORS}, {_CENTROID_DIST} select model, phoneme_i, phoneme_j, round(d, 6) + 0.0 as d from far")
def distance_matrix_cosine(spark, d):
    return rounded(_neural_matrix(spark, d))


@query(f"with {_VECTORS}, {_CENTROID_DIST} select phoneme_i, phoneme_j, round(d, 6) as d from eu")
def distance_matrix_euclid(spark, d):
    return rounded(_acoustic_matrix(spark, d))


@query(f"""with {_VECTORS}, {_CENTROID_DIST}
select phoneme_i, phoneme_j, round(eu.d, 6) as euclidean, round(w.d, 6) + 0.0 as whisper_cosine, round(x.d, 6) + 0.0 as xlsr_cosine
from eu join (select * from far where model = 'whisper') w using (phoneme_i, phoneme_j) join (select * from far where model = 'xlsr') x using (phoneme_i, phoneme_j)
""")
def distance_matrices_wide(spark, d):
    on, far = ["phoneme_i", "phoneme_j"], _neural_matrix(spark, d)
    out = _acoustic_matrix(spark, d).withColumnRenamed("d", "euclidean")
    for m in ("whisper", "xlsr"):
        out = out.join(far.where(F.col("model") == m).select(*on, F.col("d").alias(f"{m}_cosine")), on)
    return rounded(out)


@query(f"""with {_VECTORS},
g as (select model, dim, avg(x) as m from vx group by all), k as (select model, phoneme, dim, avg(x) as m, count(*) as n from vx group by all),
b as (select model, sum(n * (k.m - g.m) ** 2) as b from k join g using (model, dim) group by model), w as (select model, sum((x - m) ** 2) as w, count(distinct token_id) as n from vx join g using (model, dim) group by model)
select model, n::bigint as n, round(b / w, 8) as between_class_ratio from b join w using (model)
""")
def between_class_ratio(spark, d):
    return rounded(X.between_class_ratio(vowel_reps(spark, d), "phoneme", within=["model"]), 8)


@query(f"""with {_VECTORS},
u as (select model, token_id, phoneme, dim, x / sqrt(sum(x * x) over (partition by model, token_id)) as x from vx),
p as (select a.model, a.phoneme = b.phoneme as same, sum(a.x * b.x) as s from u a join u b on a.model = b.model and a.dim = b.dim and a.token_id <> b.token_id group by a.model, a.token_id, b.token_id, same)
select model, round(avg(s) filter (same), 6) as within_cosine, round(avg(s) filter (not same), 6) as between_cosine, round(avg(s) filter (same) / avg(s) filter (not same), 4) as within_between_cosine_ratio
from p group by model
""")
def within_between_cosine(spark, d):
    out = X.within_between_cosine(vowel_reps(spark, d), "phoneme", within=["model"])
    return rounded(out.withColumn("within_between_cosine_ratio", F.round("within_between_cosine_ratio", 4)))


_INTRA = """
u as (select model, token_id, spk, phoneme, dim, x / sqrt(sum(x * x) over (partition by model, token_id)) as x from vx),
p as (select a.model, a.phoneme, a.spk, 1 - sum(a.x * b.x) as far from u a join u b on a.model = b.model and a.phoneme = b.phoneme and a.spk = b.spk and a.dim = b.dim and a.token_id < b.token_id
      group by a.model, a.phoneme, a.spk, a.token_id, b.token_id),
i as (select model, phoneme, avg(far) as far from p group by all),
d0 as (select model, avg(far) as delta0 from i group by model)
"""


@query(f"with {_VECTORS}, {_INTRA} select model, round(delta0, 8) as delta0 from d0")
def delta0(spark, d):
    return rounded(X.delta0(vowel_reps(spark, d), ["model"]), 8)


# --- resampling -------------------------------------------------------------------------------------------------------

N_PERM, N_BOOT = Config().n_perm, Config().n_boot

_RANKS = """
ra as (select *, r - avg(r) over (partition by m) as c from (select m, phoneme_i, phoneme_j, rank() over (partition by m order by d) + (count(*) over (partition by m, d) - 1) / 2.0 as r
       from (select 'euclid' as m, phoneme_i, phoneme_j, d from eu union all select model, phoneme_i, phoneme_j, d from far) where phoneme_i < phoneme_j)),
rn as (select m, phoneme_i, phoneme_j, c / sqrt(sum(c * c) over (partition by m)) as c from ra)
"""


@query(f"""with {_VECTORS}, {_CENTROID_DIST}, {_RANKS},
pairs as (select 'euclid' as m1, 'whisper' as m2 union all select 'euclid', 'xlsr' union all select 'whisper', 'xlsr'),
obs as (select m1, m2, sum(a.c * b.c) as r from pairs join rn a on a.m = m1 join rn b on b.m = m2 and a.phoneme_i = b.phoneme_i and a.phoneme_j = b.phoneme_j group by all),
labels as (select distinct phoneme_i as l from eu), numbered as (select l, row_number() over (order by l) as place from labels),
moved as (select b, l, row_number() over (partition by b order by md5('42-' || b || '-' || l), l) as place from labels, range({N_PERM}) t(b)),
m as (select b, moved.l, n.l as t from moved join numbered n using (place)),
sym as (select m, phoneme_i, phoneme_j, c from rn union all select m, phoneme_j, phoneme_i, c from rn),
null_ as (select m1, m2, x.b, sum(a.c * s.c) as r from pairs join rn a on a.m = m1 join m x on x.l = a.phoneme_i join m y on y.l = a.phoneme_j and y.b = x.b
          join sym s on s.m = m2 and s.phoneme_i = x.t and s.phoneme_j = y.t group by all)
select m1 as D1, m2 as D2, round(o.r, 6) as mantel_r, round((count(*) filter (abs(n.r) >= abs(o.r) - 1e-12) + 1) / {N_PERM + 1}, 6) as p_value, {N_PERM}::int as n_perm
from obs o join null_ n using (m1, m2) group by m1, m2, o.r
""")
def mantel_perm_p(spark, d):
    m = _neural_matrix(spark, d).withColumnRenamed("model", "m").unionByName(_acoustic_matrix(spark, d).withColumn("m", F.lit("euclid")))
    return rounded(B.mantel(m, [("euclid", "whisper"), ("euclid", "xlsr"), ("whisper", "xlsr")], n_perm=N_PERM))


RSM = {"acoustic": "euclidean", "whisper": "cosine", "xlsr": "cosine"}
RSM_PAIRS = [("acoustic", "whisper"), ("acoustic", "xlsr"), ("whisper", "xlsr")]


def _rsm_tokens(spark, d):
    """The sample of vowel tokens that are valid in all three representations; its size is the reference's parameter."""
    r = acoustic_reps(spark, d).select("token_id", F.col("v").alias("acoustic"))
    v = S.reps(spark, d).select("token_id", F.col("v").alias("whisper"), F.slice("v", 1, 32).alias("xlsr"))
    r = r.join(v, "token_id").where(V.is_valid("acoustic") & V.is_valid("whisper") & V.is_valid("xlsr"))
    return B.token_sample(r, "token_id", 2000, 42)


@query()
def rsm_mantel(spark, d):
    return rounded(B.token_mantel(_rsm_tokens(spark, d), RSM, RSM_PAIRS, n_perm=N_PERM))


@query(f"""
with r as ({S.REPS_SQL}), s as materialized (select token_id, [F1, F2] as acoustic, embedding::double[] as whisper, embedding[1:32]::double[] as xlsr
  from r where phoneme in ('a','e','ɛ','i','o','ø','u','y') and F1 is not null and F2 is not null order by md5('42-' || token_id), token_id limit 2000),
p as materialized (select a.token_id as i, b.token_id as j, -list_distance(a.acoustic, b.acoustic) as acoustic,
  list_cosine_similarity(a.whisper, b.whisper) as whisper, list_cosine_similarity(a.xlsr, b.xlsr) as xlsr from s a join s b on a.token_id < b.token_id),
k as (select * replace (rank() over (order by acoustic) + (count(*) over (partition by acoustic) - 1) / 2 as acoustic,
  rank() over (order by whisper) + (count(*) over (partition by whisper) - 1) / 2 as whisper, rank() over (order by xlsr) + (count(*) over (partition by xlsr) - 1) / 2 as xlsr) from p)
select 'acoustic' as first, 'whisper' as second, round(corr(acoustic, whisper), 5) as mantel_r from k union all
select 'acoustic', 'xlsr', round(corr(acoustic, xlsr), 5) from k union all select 'whisper', 'xlsr', round(corr(whisper, xlsr), 5) from k
""")
def rsm_correlation(spark, d):
    """The observed correlations of ``rsm_mantel``."""
    return rounded(B.token_correlation(materialise(B.similarity_ranks(_rsm_tokens(spark, d), RSM), "rsm-ranks"), RSM_PAIRS), 5)


_DRAWS = f"""
units as (select spk, row_number() over (order by spk) - 1 as slot, count(*) over () as n from (select distinct spk from r where phoneme in ('a','e','ɛ','i','o','ø','u','y'))),
draws as (select b, u.spk, count(*) as times from (select b, ('0x' || substr(md5('42-' || b || '-' || slot), 1, 8))::bigint % n as pick from units, range({N_BOOT}) t(b)) d join units u on u.slot = d.pick group by all)
"""


def _boot_sql(side: str, groups: str, keys: str, metric: str = "cosine") -> str:
    """Bootstrap of the distance of two centroids: ``groups`` has keys, token_id, spk, side (1 or 2), dim, x."""
    cosine = "1 - sum(s1 / n1 * s2 / n2) / nullif(sqrt(sum((s1 / n1) ** 2)) * sqrt(sum((s2 / n2) ** 2)), 0)"
    measure = cosine if metric == "cosine" else f"case when max(model) = 'acoustic' then sqrt(sum((s1 / n1 - s2 / n2) ** 2)) else {cosine} end"

    def far(src):
        return f"""select {keys}{', b' if src == 'drawn' else ''}, {measure} as d, max(n1) as n1, max(n2) as n2
        from (select {keys}{', b' if src == 'drawn' else ''}, dim, sum(x * times) filter (side = 1) as s1, sum(times) filter (side = 1) as n1, sum(x * times) filter (side = 2) as s2, sum(times) filter (side = 2) as n2
              from {src} group by all) where n1 > 0 and n2 > 0 group by all"""
    return f"""g as ({groups}), drawn as (select g.*, b, times from g join draws using (spk)), whole as (select *, 1 as times from g),
rep as ({far('drawn')}), obs as ({far('whole')}),
ci as (select {keys}, avg(d) as obs_boot_mean, quantile_cont(d, 0.025) as ci_lo, quantile_cont(d, 0.975) as ci_hi from rep group by all)
select {keys}, n1::bigint as n_first, n2::bigint as n_second, round(d, 6) as obs_sample, round(obs_boot_mean, 6) as obs_boot_mean, round(ci_lo, 6) as ci_lo, round(ci_hi, 6) as ci_hi from obs left join ci using ({keys})"""


_L1L2 = _boot_sql("L1", "select model, phoneme, spk, case L1 when 'fr' then 1 else 2 end as side, dim, x from vx", "model, phoneme")


@query(f"with {_VECTORS}, {_DRAWS}, " + _L1L2)
def bootstrap_l1l2_ci(spark, d):
    return rounded(_l1l2_ci(spark, d))


def _l1l2_ci(spark, d):
    r = vowel_reps(spark, d)
    return B.bootstrap_centroid_distance(r, "L1", "fr", "ru", within=["model", "phoneme"], n_boot=N_BOOT, min_n=2)


#: Normed formants of the representation tokens as vectors of two numbers, beside the models' vectors.
_NORMED_PAIR = """
rs as (select spk, avg(F1) as m1, stddev_samp(F1) as s1, avg(F2) as m2, stddev_samp(F2) as s2 from r where phoneme in ('a','e','ɛ','i','o','ø','u','y') group by spk),
rn2 as (select token_id, spk, phoneme, (F1 - m1) / nullif(s1, 0) as a, (F2 - m2) / nullif(s2, 0) as b from r join rs using (spk) where phoneme in ('a','e','ɛ','i','o','ø','u','y')),
ax as (select 'acoustic' as model, phoneme, spk, token_id, unnest([0, 1]) as dim, unnest([a, b]) as x from rn2 where a is not null and b is not null)
"""


def _normed_pair(spark, d):
    """Normed formants of the representation tokens that are vowels, as vectors; null where one is missing."""
    pair = F.when(F.col("F1_normed").isNotNull() & F.col("F2_normed").isNotNull(), F.array("F1_normed", "F2_normed"))
    return D.lobanov(S.reps(spark, d)).where(I.is_vowel("phoneme")).withColumn("v", pair).withColumn("model", F.lit("acoustic"))


@query(f"with {_VECTORS}, {_NORMED_PAIR}, {_DRAWS}, " + _boot_sql("phoneme", """
select model, pair, spk, case when every.phoneme = split_part(pair, '-', 1) then 1 else 2 end as side, dim, x
from (select model, phoneme, spk, token_id, dim, x from vx union all select model, phoneme, spk, token_id, dim, x from ax) every
join (select unnest(['e-ɛ', 'o-ø', 'y-u']) as pair) p on every.phoneme in (split_part(pair, '-', 1), split_part(pair, '-', 2))""", "model, pair", "by model"))
def bootstrap_pair_ci(spark, d):
    """Three pairs under the two models (cosine) and over the normed formants (Euclidean)."""
    r, pair = vowel_reps(spark, d), _normed_pair(spark, d)
    out = None
    for a, b in Config().pair_list():
        for v, metric in ((r, "cosine"), (pair, "euclidean")):
            one = B.bootstrap_centroid_distance(v, "phoneme", a, b, within=["model"], n_boot=N_BOOT, units=r, metric=metric).withColumn("pair", F.lit(f"{a}-{b}"))
            out = one if out is None else out.unionByName(one)
    return rounded(out)


_PERMUTED = f"""with {_VECTORS},
tok as (select distinct model, phoneme, token_id, L1 from vx),
n as (select model, phoneme, count(*) filter (L1 = 'fr') as n1, count(*) filter (L1 = 'ru') as n2 from tok group by all having count(*) filter (L1 = 'fr') >= 2 and count(*) filter (L1 = 'ru') >= 2),
whole as (select model, phoneme, dim, sum(x) as s, sum(x) filter (L1 = 'fr') as s1 from vx group by all),
obs as (select model, phoneme, 1 - sum(s1 / n1 * (s - s1) / n2) / (sqrt(sum((s1 / n1) ** 2)) * sqrt(sum(((s - s1) / n2) ** 2))) as d from whole join n using (model, phoneme) group by all),
perm as (select model, phoneme, b, token_id, row_number() over (partition by model, phoneme, b order by md5('42-' || b || '-' || token_id), token_id) as place from tok, range({N_PERM}) t(b)),
half as (select p.model, p.phoneme, b, dim, sum(x) as t from perm p join n on p.model = n.model and p.phoneme = n.phoneme and place <= n1 join vx on vx.model = p.model and vx.token_id = p.token_id group by all),
null_ as (select h.model, h.phoneme, b, 1 - sum(t / n1 * (s - t) / n2) / (sqrt(sum((t / n1) ** 2)) * sqrt(sum(((s - t) / n2) ** 2))) as d from half h join whole using (model, phoneme, dim) join n using (model, phoneme) group by all),
perm_p as (select model, phoneme, max(n1)::bigint as n1, max(n2)::bigint as n2, round(max(o.d), 6) as obs, round((count(*) filter (x.d >= o.d - 1e-12) + 1) / {N_PERM + 1}, 6) as p_raw
from obs o join null_ x using (model, phoneme) join n using (model, phoneme) group by all)
"""


@query(_PERMUTED + "select * from perm_p")
def permutation_cosine(spark, d):
    return rounded(B.permutation_centroid_distance(vowel_reps(spark, d), "L1", "fr", "ru", within=["model", "phoneme"], n_perm=N_PERM))


@query(_PERMUTED.rstrip() + """,
placed as (select *, row_number() over (partition by model order by p_raw) as k, count(*) over (partition by model) as m from perm_p),
adj as (select * exclude (k, m), least(min(p_raw * m / k) over (partition by model order by k desc rows unbounded preceding), 1) as a from placed)
select * exclude (a), round(a, 6) as "p_adj_BH", a <= 0.05 as "reject_H0_BH" from adj
""")
def test_neural_fdr(spark, d):
    r = vowel_reps(spark, d)
    p = B.permutation_centroid_distance(r, "L1", *I.two_labels(r, "L1"), within=["model", "phoneme"], n_perm=N_PERM)
    return rounded(H.benjamini_hochberg(p, "p_raw", ["model"], decimals=6))


# --- hypothesis tests -------------------------------------------------------------------------------------------------

_GROUPS = f"""with {_NORMED}, g as (select phoneme, F1_normed as x, L1 from v where F1_normed is not null)"""


def _l1(spark, d):
    """Normalised vowels by group, computed once for operators that read them more than once."""
    return materialise(D.vowels(normed(spark, d)).select("spk", "L1", "Gender", "phoneme", "F1_normed", "F2_normed"), "normed-vowels")


@query(_GROUPS + """, s as (select phoneme, count(*) filter (L1 = 'fr') as n1, count(*) filter (L1 = 'ru') as n2, avg(x) filter (L1 = 'fr') as m1, avg(x) filter (L1 = 'ru') as m2, var_samp(x) filter (L1 = 'fr') as v1, var_samp(x) filter (L1 = 'ru') as v2 from g group by phoneme)
select phoneme, n1::bigint as n1, n2::bigint as n2, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)), 5) as student_t, round(n1 + n2 - 2, 4)::double as student_df,
  round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 5) as welch_t, round((v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)), 4) as welch_df from s""")
def t_tests(spark, d):
    t = H.t_tests(_l1(spark, d), "F1_normed", ["phoneme"], "L1", "fr", "ru").select("phoneme", "n1", "n2", "student_t", "student_df", "welch_t", "welch_df")
    return rounded(t.withColumns({c: F.round(c, k) for c, k in (("student_t", 5), ("welch_t", 5), ("student_df", 4), ("welch_df", 4))}))


@query(_GROUPS + """, md as (select phoneme, L1, quantile_cont(x, 0.5) as m from g group by all), z as (select phoneme, L1, abs(x - m) as z from g join md using (phoneme, L1)),
k as (select phoneme, L1, count(*) as n, avg(z) as m, var_pop(z) * count(*) as ss from z group by all), gr as (select phoneme, avg(z) as m, count(*) as n from z group by phoneme)
select phoneme, round((max(gr.n) - 2) * sum(k.n * (k.m - gr.m) ** 2) / sum(ss), 4) as levene_stat from k join gr using (phoneme) group by phoneme""")
def levene_stat(spark, d):
    return rounded(H.levene(_l1(spark, d), "F1_normed", ["phoneme"], "L1", "fr", "ru").select("phoneme", F.round("levene_stat", 4).alias("levene_stat")))


@query(_GROUPS + """, q as (select phoneme, L1, round(x, 9) as x from g), r as (select phoneme, L1, rank() over (partition by phoneme order by x) + (count(*) over (partition by phoneme, x) - 1) / 2.0 as r, count(*) over (partition by phoneme, x) as t from q)
select phoneme, count(*) filter (L1 = 'fr')::bigint as n1, count(*) filter (L1 = 'ru')::bigint as n2, sum(r) filter (L1 = 'fr') - count(*) filter (L1 = 'fr') * (count(*) filter (L1 = 'fr') + 1) / 2 as u, sum(t * t - 1)::double as ties from r group by phoneme""")
def mwu_u(spark, d):
    t = _l1(spark, d).withColumn("F1_normed", F.round("F1_normed", 9))
    return rounded(H.mann_whitney(t, "F1_normed", ["phoneme"], "L1", "fr", "ru").drop("mwu_p"))


@query()
def test_acoustic_l1l2(spark, d):
    t = _l1(spark, d).select("phoneme", "L1", F.explode(F.array(*[F.struct(F.lit(f).alias("formant"), F.col(f"{f}_normed").alias("x")) for f in ("F1", "F2")])).alias("f"))
    return rounded(H.compare_groups(t.select("phoneme", "L1", "f.formant", "f.x"), "x", ["phoneme", "formant"], "L1", "fr", "ru"))


@query()
def test_gender_residual(spark, d):
    v, out = _l1(spark, d), None
    for f in ("F1", "F2"):
        m = D.unit_means(v, f"{f}_normed", ["spk", "Gender", "phoneme"]).withColumnRenamed(f"{f}_normed_mean", "x").withColumn("formant", F.lit(f))
        out = m if out is None else out.unionByName(m)
    return rounded(H.compare_groups(materialise(out, "speaker-means"), "x", ["phoneme", "formant"], "Gender", "f", "m", levene_branch=False))


_P = "p as (select l_suppkey as id, l_returnflag as fam, count(*) as c, ((l_suppkey * 7919) % 1009) / 1009.0 as p from lineitem group by all)"


def _bh_sql(family: str, select: str) -> str:
    over = f"partition by {family}" if family else ""
    return f"""with {_P}, r as (select *, row_number() over ({over} order by p) as k, count(*) over ({over}) as m from p), a as (select *, p * m / k as raw from r)
select id, fam, round(p, 8) as p, round(least(min(raw) over ({over} order by k desc rows unbounded preceding), 1), 8) as p_adj_BH, least(min(raw) over ({over} order by k desc rows unbounded preceding), 1) <= 0.05 as reject_H0_BH from a"""


def _p_values(spark, d):
    t = S.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id"), F.col("l_returnflag").alias("fam")).count()
    return t.select("id", "fam", ((F.col("id") * 7919) % 1009 / F.lit(1009.0)).alias("p"))


@query(_bh_sql("", ""))
def bh_fdr(spark, d):
    return rounded(H.benjamini_hochberg(_p_values(spark, d), "p", []), 8)


@query(_bh_sql("fam", ""))
def bh_fdr_by_family(spark, d):
    return rounded(H.benjamini_hochberg(_p_values(spark, d), "p", ["fam"]), 8)


# --- leave one speaker out --------------------------------------------------------------------------------------------

_LOSO_AC = """
av as (select token_id, spk, L1, phoneme, F1, F2 from r where F1 is not null and F2 is not null and phoneme in ('a','e','ɛ','i','o','ø','u','y')),
ak as (select spk, phoneme, sum(F1) as a, sum(F2) as b, count(*) as n from av group by all), al as (select phoneme, sum(a) as a, sum(b) as b, sum(n) as n from ak group by all),
acn as (select sp.spk, al.phoneme as class, (al.a - coalesce(ak.a, 0)) / (al.n - coalesce(ak.n, 0)) as a, (al.b - coalesce(ak.b, 0)) / (al.n - coalesce(ak.n, 0)) as b
      from (select distinct spk from av) sp cross join al left join ak on ak.spk = sp.spk and ak.phoneme = al.phoneme where al.n - coalesce(ak.n, 0) > 0),
apred as (select token_id, spk, L1, phoneme as y_true, class as y_pred from (select av.*, class, row_number() over (partition by token_id order by (F1 - acn.a) ** 2 + (F2 - acn.b) ** 2, class) as rn from av join acn using (spk)) where rn = 1)
"""
_LOSO = f"""{_LOSO_AC},
k as (select model, spk, phoneme, dim, sum(x) as s, count(*) as n from vx group by all), a as (select model, phoneme, dim, sum(s) as s, sum(n) as n from k group by all),
sp as (select distinct model, spk from vx),
c as (select sp.model, sp.spk, a.phoneme as class, a.dim, (a.s - coalesce(k.s, 0)) / (a.n - coalesce(k.n, 0)) as c from sp join a using (model) left join k on k.model = sp.model and k.spk = sp.spk and k.phoneme = a.phoneme and k.dim = a.dim
      where a.n - coalesce(k.n, 0) > 0),
far as (select vx.model, token_id, vx.spk, L1, vx.phoneme as y_true, class, round(sum(x * c) / (sqrt(sum(x * x)) * sqrt(sum(c * c))), 12) as s from vx join c on c.model = vx.model and c.spk = vx.spk and c.dim = vx.dim group by all),
pred as (select model, token_id, spk, L1, y_true, class as y_pred from (select *, row_number() over (partition by model, token_id order by s desc, class) as rn from far) where rn = 1
  union all select 'acoustic', token_id, spk, L1, y_true, y_pred from apred)
"""


def _pred(spark, d):
    """Predictions from the acoustic and both neural representations."""
    r = vowel_reps(spark, d)
    out = C.loso(acoustic_reps(spark, d).withColumn("model", F.lit("acoustic")), metric="euclidean", carry=("L1", "model"))
    for m in ("whisper", "xlsr"):
        one = C.loso(r.where(F.col("model") == m), metric="cosine", carry=("L1", "model"))
        out = out.unionByName(one)
    return out


@query(f"with {_VECTORS}, {_LOSO} select model, token_id, spk, y_true, y_pred from pred")
def loso_predictions(spark, d):
    return _pred(spark, d).select("model", "token_id", "spk", "y_true", "y_pred")


@query(f"with {_VECTORS}, {_LOSO_AC} select token_id, spk, y_true, y_pred from apred")
def loso_acoustic(spark, d):
    return C.loso(acoustic_reps(spark, d), metric="euclidean").select("token_id", "spk", "y_true", "y_pred")


def _f1_sql(by: str) -> str:
    return f"""cls as (select {by}, class, sum(s) as support, sum(p) as predicted, sum(t) as tp from (select {by}, y_true as class, 1 as s, 0 as p, (y_true = y_pred)::int as t from pred union all
select {by}, y_pred, 0, 1, 0 from pred) group by all), f as (select *, coalesce(2.0 * tp / nullif(support + predicted, 0), 0) as f1 from cls)"""


@query(f"with {_VECTORS}, {_LOSO}, {_f1_sql('model')} select model, round(sum(tp) / sum(support), 6) as accuracy, round(avg(f1), 6) as f1_macro, sum(support)::bigint as n_tokens from f group by model")
def loso_scores(spark, d):
    return rounded(C.scores(_pred(spark, d), ["model"]))


@query(f"with {_VECTORS}, {_LOSO}, {_f1_sql('model, L1')} select model, L1, round(sum(tp) / sum(support), 6) as accuracy, round(avg(f1), 6) as f1_macro, sum(support)::bigint as n_tokens from f group by model, L1")
def loso_group_scores(spark, d):
    return rounded(C.scores(_pred(spark, d), ["model", "L1"]))


@query(f"with {_VECTORS}, {_LOSO}, {_f1_sql('model')} select model, class, round(f1, 6) as f1, support::bigint as support from f")
def loso_f1(spark, d):
    return rounded(C.class_scores(_pred(spark, d), ["model"]).select("model", "class", "f1", "support"))


@query(f"""with {_VECTORS}, {_LOSO}, l as (select y_true as l from pred union select y_pred from pred)
select model, a.l as y_true, b.l as y_pred, count(pred.token_id)::bigint as count from (select distinct model from pred) m cross join l a cross join l b left join pred on pred.model = m.model and pred.y_true = a.l and pred.y_pred = b.l group by m.model, a.l, b.l
""".replace("select model, a.l", "select m.model, a.l"))
def loso_confusion(spark, d):
    return C.confusion(_pred(spark, d), ["model"])


@query(f"with {_VECTORS}, {_LOSO}, {_f1_sql('model')} select class as phoneme, round(max(f1) filter (model = 'acoustic'), 6) as acoustic, round(max(f1) filter (model = 'whisper'), 6) as whisper, round(max(f1) filter (model = 'xlsr'), 6) as xlsr from f group by class")
def f1_pivot(spark, d):
    return rounded(C.pivot_f1(C.class_scores(_pred(spark, d), ["model"]), values=["acoustic", "whisper", "xlsr"]))


PAIRS = (("acoustic", "whisper"), ("acoustic", "xlsr"), ("whisper", "xlsr"))


def _mcnemar(spark, d):
    pred, out = materialise(_pred(spark, d), "loso-predictions"), None
    for a, b in PAIRS:
        one = C.mcnemar(pred, a, b)
        out = one if out is None else out.union(one)
    return out


@query(f"""with {_VECTORS}, {_LOSO}, ab as (select x.model as model_A, y.model as model_B, x.y_true = x.y_pred as a, y.y_true = y.y_pred as b from pred x join pred y on x.token_id = y.token_id and x.model < y.model)
select model_A, model_B, count(*) filter (a and b)::bigint as n11, count(*) filter (a and not b)::bigint as n10, count(*) filter (not a and b)::bigint as n01, count(*) filter (not a and not b)::bigint as n00,
  count(*) filter (a <> b)::bigint as discordant, count(*) filter (a <> b) < 25 as exact from ab group by all
""")
def mcnemar_cells(spark, d):
    """All pairs of representations, on the tokens that both classified."""
    return _mcnemar(spark, d).drop("statistic", "p_value")


@query()
def mcnemar_test(spark, d):
    return rounded(_mcnemar(spark, d))


# --- equivalence ------------------------------------------------------------------------------------------------------

_CI = f"""with {_NORMED}, ci as (select phoneme, 'L1[T.' || L1 || ']' as effect, avg(F1_normed) as coef, avg(F1_normed) - 1.96 * stddev_samp(F1_normed) / sqrt(count(F1_normed)) as ci_lo, avg(F1_normed) + 1.96 * stddev_samp(F1_normed) / sqrt(count(F1_normed)) as ci_hi from v group by all),
k as (select phoneme, effect, round(coef, 5) as point_est, round(ci_lo, 5) as ci_lo, round(ci_hi, 5) as ci_hi,
  case when ci_lo is null or ci_hi is null then 'insufficient_data' when ci_lo >= -0.2 and ci_hi <= 0.2 then 'equivalent' when ci_hi < -0.2 or ci_lo > 0.2 then 'non-equivalent' else 'indeterminate' end as classification from ci)"""


def _acoustic_ci(spark, d):
    g = D.vowels(normed(spark, d)).groupBy("phoneme", "L1").agg(
        F.avg("F1_normed").alias("coef"), (1.96 * F.stddev_samp("F1_normed") / F.sqrt(F.count("F1_normed"))).alias("w")
    )
    return g.select(
        "phoneme", F.lit("F1").alias("formant"), F.concat(F.lit("L1[T."), "L1", F.lit("]")).alias("effect"), "coef",
        (F.col("coef") - F.col("w")).alias("ci_lo"), (F.col("coef") + F.col("w")).alias("ci_hi"), F.lit(None).cast("double").alias("p_value"),
    )


@query(_CI + " select phoneme, effect, point_est, ci_lo, ci_hi, classification from k")
def rope_classify(spark, d):
    return rounded(P.classify_acoustic(_acoustic_ci(spark, d)).select("phoneme", "effect", "point_est", "ci_lo", "ci_hi", "classification"), 5)


def _count_sql(c: str) -> str:
    return f"count(*) filter (classification = '{c}')::bigint as \"{c}\""


@query(_CI + f" select 'acoustic_F1' as representation, {', '.join(map(_count_sql, schema.ROPE_CLASSES))}, count(*)::bigint as total, round(count(*) filter (classification = 'non-equivalent') / count(*) * 100, 1) as pct_non_equivalent from k")
def rope_summary(spark, d):
    return P.summary(P.classify_acoustic(_acoustic_ci(spark, d)))


_L1L2_CI, _L1L2_ROWS = _L1L2.rsplit("\nselect ", 1)


@query(f"with {_VECTORS}, {_DRAWS}, {_INTRA}, {_L1L2_CI}, boot as (select {_L1L2_ROWS})" + """
select 'neural_' || model as representation, phoneme, 'L1_vs_L2_centroid_distance' as effect, obs_sample as point_est, ci_lo, ci_hi, 0.0 as rope_lo, round(delta0, 6) as rope_hi,
  case when delta0 is null then 'no distance inside speakers' else 'up to ' || printf('%.4f', delta0) || ', the mean distance inside speakers' end as rope_note,
  case when delta0 is null then 'rope_undefined' when ci_lo is null or ci_hi is null then 'insufficient_data' when ci_lo >= 0 and ci_hi <= delta0 then 'equivalent'
       when ci_hi < 0 or ci_lo > delta0 then 'non-equivalent' else 'indeterminate' end as classification, null::double as p_value
from boot left join d0 using (model)
""")
def rope_neural(spark, d):
    ci = _l1l2_ci(spark, d).withColumnRenamed("obs_sample", "obs_dist")
    return rounded(P.classify_neural(ci, X.delta0(vowel_reps(spark, d), ["model"])))


@query(_CI + ", dom as (select unnest(['a','e','ɛ','i','o','ø','u','y']) as phoneme) select dom.phoneme, effect, point_est, ci_lo > 0 or ci_hi < 0 as excludes_zero from dom left join k using (phoneme)")
def forest_data(spark, d):
    domain = spark.createDataFrame([(p,) for p in schema.CV_VOWELS], "phoneme string")
    ci = _acoustic_ci(spark, d)
    return rounded(domain.join(ci, "phoneme", "left").select("phoneme", "effect", F.round("coef", 5).alias("point_est"), ((F.col("ci_lo") > 0) | (F.col("ci_hi") < 0)).alias("excludes_zero")))


# --- clustering -------------------------------------------------------------------------------------------------------

_UNIT = """
cell as (select model, spk, phoneme, dim, avg(x) as x from vx group by all),
grid as (select model, spk, phoneme, dim from (select distinct model, spk from cell) join (select distinct model, phoneme, dim from cell) using (model)),
uv as (select model, spk, phoneme, dim, x from grid left join cell using (model, spk, phoneme, dim))
"""
_COLUMN = ["model", "phoneme", "dim"]


def _units(spark, d, missing=None):
    return K.unit_vectors(vowel_reps(spark, d), "spk", "phoneme", missing=missing, within=["model"])


@query(f"with {_VECTORS}, {_UNIT} select model, spk, phoneme, dim::int as dim, round(coalesce(x, 0), 8) + 0.0 as x from uv")
def speaker_vectors(spark, d):
    return rounded(_units(spark, d, 0.0), 8)


@query(f"with {_VECTORS}, {_UNIT} select model, spk, phoneme, dim::int as dim, round(coalesce(x, avg(x) over (partition by model, phoneme, dim)), 8) + 0.0 as x from uv")
def impute_colmean(spark, d):
    return rounded(K.impute_mean(_units(spark, d), _COLUMN), 8)


@query(f"""with {_VECTORS}, {_UNIT}, f as (select model, spk, phoneme, dim, coalesce(x, avg(x) over (partition by model, phoneme, dim)) as x from uv)
select model, spk, phoneme, dim::int as dim, round((x - avg(x) over w) / nullif(stddev_pop(x) over w, 0), 5) + 0.0 as z from f window w as (partition by model, phoneme, dim)""")
def scaled_speaker_vectors(spark, d):
    return rounded(K.z_scores(K.impute_mean(_units(spark, d), _COLUMN), _COLUMN).select("model", "spk", "phoneme", "dim", "z"), 5)


def _ward_sql(distances: str) -> str:
    """Ward merges as a recursion over ``far`` (model, key_i, key_j, d), which ``distances`` ends in: each step replaces the
    closest pair by its union.  ``merges`` has the pairs of every step."""
    return f"""with recursive {distances.strip()},
item as (select model, key_i as key, row_number() over (partition by model order by key_i) - 1 as id, count(*) over (partition by model) as n from far where key_i = key_j),
pairs as (select far.model, 0 as step, a.n as n, a.id as i, b.id as j, d * d as v, [a.key] as mi, [b.key] as mj
  from far join item a on a.model = far.model and a.key = key_i join item b on b.model = far.model and b.key = key_j where a.id < b.id),
merges as (select * from pairs union all
  select model, step + 1, n, gi, gj, case when touched then (sum((own + other) * v) - max(other) * max(v0)) / max(merged + other) else max(v) end, max(gmi), max(gmj)
  from (select model, step, n, touched, v, m.v as v0, len(m.mi) + len(m.mj) as merged, case when i in (m.i, m.j) then len(mi) else len(mj) end as own,
          case when i in (m.i, m.j) then len(mj) else len(mi) end as other, case when not touched then i when i in (m.i, m.j) then j else i end as gi,
          case when touched then n + step else j end as gj, case when not touched then mi when i in (m.i, m.j) then mj else mi end as gmi,
          case when touched then list_sort(list_concat(m.mi, m.mj)) else mj end as gmj
        from (select *, i in (m.i, m.j) or j in (m.i, m.j) as touched
              from (select *, first_value({{'i': i, 'j': j, 'v': v, 'mi': mi, 'mj': mj}}) over (partition by model order by v, i, j) as m from merges)
              where not (i = m.i and j = m.j)))
  group by model, step, n, touched, gi, gj)
"""


def _cuts_sql(distances: str, ks: tuple[int, ...]) -> str:
    """``cl`` (model, k, key, cluster) by Ward's linkage, and ``sil`` (model, k, silhouette)."""
    return _ward_sql(distances) + f""",
parts as (select distinct model, k, unnest([mi, mj]) as m from merges join (select unnest({list(ks)}) as k) on step = greatest(n - k, 0)),
numbered as (select model, k, m, row_number() over (partition by model, k order by m[1]) as cluster from parts),
cl as (select model, k, unnest(m) as key, cluster from numbered),
p as (select a.model, a.k, a.key, a.cluster as own, b.cluster as other, sum(d) as s, count(*) as n from far join cl a on a.model = far.model and a.key = key_i join cl b on b.model = a.model and b.k = a.k and b.key = key_j group by all),
ab as (select model, k, key, max(own) as own, max(s / nullif(n - 1, 0)) filter (own = other) as a, min(s / n) filter (own <> other) as b from p group by all),
sil as (select model, k, case when count(distinct own) between 2 and count(*) - 1 then avg(case when a is null then 0 else coalesce((b - a) / nullif(greatest(a, b), 0), 0) end) end as silhouette from ab group by all)
"""


def _ari_sql(truth: str) -> str:
    """``ar`` (model, k, name, ari): adjusted Rand indices of ``cl`` with ``truth`` (name, key, class)."""
    pairs = "sum(n * (n - 1) / 2) as v"
    return f""",
truth as ({truth}), cells as (select model, k, name, class, cluster, count(*) as n from cl join truth using (key) group by all),
al as (select model, k, name, {pairs}, sum(n) as n from cells group by all),
ro as (select model, k, name, {pairs} from (select model, k, name, class, sum(n) as n from cells group by all) group by all),
co as (select model, k, name, {pairs} from (select model, k, name, cluster, sum(n) as n from cells group by all) group by all),
ex as (select model, k, name, n, al.v as both_, ro.v * co.v / nullif(n * (n - 1) / 2, 0) as e, (ro.v + co.v) / 2 as top from al join ro using (model, k, name) join co using (model, k, name)),
ar as (select model, k, name, case when n >= 2 then case when top = e then 1.0 else (both_ - e) / nullif(top - e, 0) end end as ari from ex)
"""


def _partition_sql(names: tuple[str, ...]) -> str:
    """The named partitions of phones as rows (name, key, class)."""
    rows = [f"('{n}', '{p}', '{c}')" for n in names for p, c in schema.label_of(schema.PARTITIONS[n]).items()]
    return "select * from (values " + ", ".join(rows) + ") x(name, key, class)"


def _scores_sql(names: tuple[str, ...]) -> str:
    """One row a model and k: silhouette and a column of adjusted Rand indices for each name."""
    columns = ", ".join(f"""round(max(ari) filter (name = '{n}'), 4) as "ARI_{n}\"""" for n in names)
    return f"select model, k::int as k, round(max(silhouette), 4) as silhouette, {columns} from sil left join ar using (model, k) group by all"


def _renamed(key: str, distances: str) -> str:
    """``distances`` with its table ``far`` in the columns that ``_ward_sql`` reads."""
    head, tail = distances.rsplit("far as (", 1)
    return f"{head}far_ as ({tail}, far as (select model, {key}_i as key_i, {key}_j as key_j, d from far_)"


_NEURAL_FAR = f"{_VECTORS.strip()}, {_CENTROID_DIST.strip().split(',' + chr(10) + 'ac as')[0]}"
_VOWEL_FAR = f"""{_VECTORS.strip()}, {_CENTROID_DIST.strip().replace('far as (', 'near_ as (')},
far as (select model, phoneme_i, phoneme_j, d from near_ union all select 'acoustic', phoneme_i, phoneme_j, d from eu)"""
_VOWEL_KS = (2, 3, 4, 5, 6)
_VOWEL_CLASSES = ("front_back", "height", "rounding")
_WARD = _ward_sql(_renamed("phoneme", _NEURAL_FAR))
_CUTS = _cuts_sql(_renamed("phoneme", _NEURAL_FAR), _VOWEL_KS)


def _vowel_cuts(spark, d):
    """Distances of vowels under both models, and their Ward clusters."""
    m = materialise(_neural_matrix(spark, d), "vowel-distances")
    return m, K.ward_clusters(m, ["model"], "phoneme", _VOWEL_KS)


@query(_CUTS + " select model, k::int as k, round(silhouette, 6) as silhouette from sil")
def silhouette(spark, d):
    return rounded(K.silhouette(*_vowel_cuts(spark, d), ["model", "k"], "phoneme"))


@query(_CUTS + " select model, arg_max(k, silhouette)::int as best_k, round(max(silhouette), 6) as silhouette from sil group by model")
def best_k(spark, d):
    return rounded(K.best_partition(K.silhouette(*_vowel_cuts(spark, d), ["model", "k"], "phoneme"), "model"))


@query(_CUTS + _ari_sql(_partition_sql(_VOWEL_CLASSES)) + " select model, k::int as k, name as partition, round(ari, 6) as ari from ar")
def ari(spark, d):
    """Agreement of the vowels' Ward clusters with each partition of vowels."""
    _, clusters = _vowel_cuts(spark, d)
    clusters = materialise(clusters, "vowel-clusters")
    out = None
    for name in _VOWEL_CLASSES:
        c = clusters.withColumn("truth", I.class_code("phoneme", schema.label_of(schema.PARTITIONS[name])))
        one = K.adjusted_rand(c, ["model", "k"], "truth").withColumn("partition", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return rounded(out)


def _clustering(matrix, key, by, ks, partitions):
    """Silhouette and adjusted Rand scores of Ward clusterings, in long form."""
    clusters = K.ward_clusters(matrix, by, key, ks)
    out = K.silhouette(matrix, clusters, [*by, "k"], key)
    for name in partitions:
        c = clusters.withColumn("truth", I.class_code(key, schema.label_of(schema.PARTITIONS[name])))
        out = out.join(K.adjusted_rand(c, [*by, "k"], "truth").withColumnRenamed("ari", f"ARI_{name}"), [*by, "k"], "left")
    return out


@query(_CUTS + " select model, k::int as k, key as phoneme, cluster::int as cluster from cl")
def ward_cut(spark, d):
    return K.ward_clusters(_neural_matrix(spark, d), ["model"], "phoneme", _VOWEL_KS)


@query(_WARD + """, b as (select *, row_number() over (partition by model, step order by v, i, j) as place from merges),
z as (select model, step::int as step, i::int as "left", j::int as "right", sqrt(v) as h, (len(mi) + len(mj))::int as size from b where place = 1)
select model, step, "left", "right", round(h, 6) as height, size, h < 0.7 * max(h) over (partition by model) as coloured from z""")
def dendrogram(spark, d):
    z = K.linkage(_neural_matrix(spark, d), ["model"], "phoneme")
    return rounded(K.below_threshold(z, ["model"]))


@query(_cuts_sql(_renamed("phoneme", _VOWEL_FAR), _VOWEL_KS) + _ari_sql(_partition_sql(_VOWEL_CLASSES)) + _scores_sql(_VOWEL_CLASSES))
def vowel_clustering(spark, d):
    m = _neural_matrix(spark, d).unionByName(_acoustic_matrix(spark, d).withColumn("model", F.lit("acoustic")))
    return rounded(_clustering(materialise(m, "vowel-distances"), "phoneme", ["model"], _VOWEL_KS, _VOWEL_CLASSES), 4)


_CV_CLASSES = ("C_vs_V", "manner", "voicing")
_CV_FAR = f"""{_VECTORS.strip()}, t as ({S.TOKENS_SQL}),
cvx as (select model, phoneme, dim, avg(x) as x from mx where phoneme in {(*schema.CV_VOWELS, *schema.CONSONANTS)} group by all),
fm as (select phoneme, avg(F1) filter (phoneme in {schema.CV_VOWELS}) as a, avg(F2) filter (phoneme in {schema.CV_VOWELS}) as b, avg(dur) * 1000 as c
       from t where phoneme in {(*schema.CV_VOWELS, *schema.CONSONANTS)} group by phoneme),
fi as (select phoneme, coalesce(a, avg(a) over (), 0) as a, coalesce(b, avg(b) over (), 0) as b, coalesce(c, avg(c) over (), 0) as c from fm),
fz as (select phoneme, (a - avg(a) over ()) / coalesce(nullif(stddev_pop(a) over (), 0), 1) as a, (b - avg(b) over ()) / coalesce(nullif(stddev_pop(b) over (), 0), 1) as b,
              (c - avg(c) over ()) / coalesce(nullif(stddev_pop(c) over (), 0), 1) as c from fi),
far as (select x.model, x.phoneme as phoneme_i, y.phoneme as phoneme_j, 1 - greatest(least(sum(x.x * y.x) / (sqrt(sum(x.x * x.x)) * sqrt(sum(y.x * y.x))), 1), -1) as d
        from cvx x join cvx y on x.model = y.model and x.dim = y.dim group by all
        union all select 'acoustic', x.phoneme, y.phoneme, sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2 + (x.c - y.c) ** 2) from fz x, fz y)"""


@query(_cuts_sql(_renamed("phoneme", _CV_FAR), Config().k_cv)
       + _ari_sql(_partition_sql(_CV_CLASSES)) + _scores_sql(_CV_CLASSES))
def cv_clustering(spark, d):
    r = S.models(S.reps(spark, d).where(F.col("phoneme").isin(*schema.CV_VOWELS, *schema.CONSONANTS)))
    m = X.long_matrix(X.centroids(r, ["model", "phoneme"], nan_policy="propagate"), metric="cosine", within=["model"])
    f = D.feature_table(S.tokens(spark, d).where(F.col("phoneme").isin(*schema.CV_VOWELS, *schema.CONSONANTS)))
    f = f.select(F.lit("acoustic").alias("model"), "phoneme", F.array("F1_z", "F2_z", "dur_ms_z").alias("centroid"))
    m = materialise(m.unionByName(X.long_matrix(f, metric="euclidean", within=["model"])), "cv-distances")
    return rounded(_clustering(m, "phoneme", ["model"], Config().k_cv, _CV_CLASSES), 4)


_SPEAKER_FAR = f"""{_VECTORS.strip()}, {_NORMED_PAIR.strip()},
every_cell as (select model, spk, phoneme, dim, avg(x) as x from (select model, spk, phoneme, dim, x from vx union all select model, spk, phoneme, dim, x from ax) group by all),
every_grid as (select model, spk, phoneme, dim from (select distinct model, spk from every_cell) join (select distinct model, phoneme, dim from every_cell) using (model)),
filled as (select model, spk, phoneme, dim, case when model = 'acoustic' then coalesce(x, avg(x) over (partition by model, phoneme, dim)) else coalesce(x, 0) end as x
           from every_grid left join every_cell using (model, spk, phoneme, dim)),
scaled as (select model, spk, phoneme, dim, case when model = 'acoustic' then (x - avg(x) over w) / coalesce(nullif(stddev_pop(x) over w, 0), 1) else x end as x
           from filled window w as (partition by model, phoneme, dim)),
far as (select a.model, a.spk as spk_i, b.spk as spk_j, case when max(a.model) = 'acoustic' then sqrt(sum((a.x - b.x) ** 2)) else
          1 - greatest(least(sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))), 1), -1) end as d
        from scaled a join scaled b on a.model = b.model and a.phoneme = b.phoneme and a.dim = b.dim group by all)"""


@query(_cuts_sql(_renamed("spk", _SPEAKER_FAR), Config().k_speaker)
       + _ari_sql("select 'L1' as name, spk as key, min(L1) as class from r group by spk union all select 'Gender', spk, min(Gender) from r group by spk") + _scores_sql(("L1", "Gender")))
def speaker_clustering(spark, d):
    """Acoustic speaker vectors are filled in, scaled and compared by distance; neural ones have zeros for a vowel that a
    speaker lacks and are compared by cosine."""
    acoustic = K.z_scores(K.impute_mean(K.unit_vectors(_normed_pair(spark, d), "spk", "phoneme", within=["model"]), _COLUMN), _COLUMN)
    acoustic = acoustic.drop("x").withColumnRenamed("z", "x")
    out = None
    for x, metric in ((acoustic, "euclidean"), (_units(spark, d, 0.0), "cosine")):
        x = x.groupBy("model", "spk").agg(F.transform(F.array_sort(F.collect_list(F.struct("phoneme", "dim", "x"))), lambda s: s["x"]).alias("centroid"))
        m = X.long_matrix(x, "spk", metric=metric, within=["model"])
        out = m if out is None else out.unionByName(m)
    out = materialise(out, "speaker-distances")
    clusters = materialise(K.ward_clusters(out, ["model"], "spk", Config().k_speaker), "speaker-clusters")
    people = S.reps(spark, d).groupBy("spk").agg(F.min("L1").alias("L1"), F.min("Gender").alias("Gender"))
    scores = K.silhouette(out, clusters, ["model", "k"], "spk")
    for c, first in (("L1", "fr"), ("Gender", "f")):
        truth = people.select("spk", F.when(F.col(c) == first, 0).when(F.col(c).isNotNull(), 1).otherwise(-1).alias("truth"))
        ari = K.adjusted_rand(clusters.join(truth, "spk"), ["model", "k"], "truth").withColumnRenamed("ari", f"ARI_{c}")
        scores = scores.join(ari, ["model", "k"], "left")
    return rounded(scores, 4)


# --- files ------------------------------------------------------------------------------------------------------------


@query("""
select vec_id as token_id, len(embedding)::int as dims, round(list_sum(list_transform(embedding, lambda x: x::double)), 5) as total,
  row_number() over (order by vec_id) - 1 as n_before from embeddings
""")
def npz_round_trip(spark, d):
    """The representations written to .npz files and read back by row ranges."""
    from quillon.sources import files
    from quillon.sources.durable import folder

    path = folder(spark, "npz")
    files.write_npz_files(S.reps(spark, d).select("token_id", "v"), path, rows=1000)
    r = files.read_npz_rows(spark, path, ids="token_id", rows=300)
    r = r.select("token_id", F.size("v").alias("dims"), F.aggregate("v", F.lit(0.0), lambda s, x: s + x).alias("total"))
    return rounded(I.number_rows(r, ["token_id"], "n_before"), 5)


@query("""
with b0 as (select l_orderkey, sum(l_quantity)::double as quantity from lineitem where l_orderkey in (select o_orderkey from orders) group by all),
a as (select o_orderkey, row_number() over (order by o_orderkey) as n from orders where o_orderkey in (select l_orderkey from lineitem)),
b as (select *, row_number() over (order by quantity, l_orderkey) as n from b0)
select n - 1 as place, o_orderkey, l_orderkey, quantity from a join b using (n)
""")
def positional_alignment(spark, d):
    """Orders by key beside orders by quantity: two tables that only the places of their rows relate."""
    item, order = S.table(spark, d, "lineitem"), S.table(spark, d, "orders").select("o_orderkey")
    same = F.col("o_orderkey") == F.col("l_orderkey")
    sums = item.join(order, same, "left_semi").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("double").alias("quantity"))
    return I.align(order.join(item, same, "left_semi"), sums, ["o_orderkey"], ["quantity", "l_orderkey"])


# --- mixed models and reduction ---------------------------------------------------------------------------------------


def _stats(spark, d):
    return M.unit_totals(_cells(spark, d), ["phoneme", "formant"])


def _cells(spark, d) -> DataFrame:
    """Sums of the normed formants by speaker, labels and vowel."""
    return D.lobanov_cells(S.tokens(spark, d), ["L1", "Gender", "phoneme"])


def _pooled_cells(spark, d) -> DataFrame:
    return _cells(spark, d).withColumn("vowel_height", I.map_label("phoneme", schema.label_of(schema.VOWEL_HEIGHT), "unknown"))


@query()
def lmm_null(spark, d):
    m = M.ladder(_stats(spark, d), ["phoneme", "formant"], models=("M0",)).where("reml")
    return rounded(m.select("phoneme", "formant", "coef", "var_u", "var_e", "icc", "loglik", "status"), 5)


@query()
def lmm_models(spark, d):
    return rounded(M.ladder(_stats(spark, d), ["phoneme", "formant"]), 5)


@query()
def lmm_main_ci(spark, d):
    return rounded(M.wald_intervals(M.ladder(_stats(spark, d), ["phoneme", "formant"], models=("M1", "M2")), ["phoneme", "formant"]), 5)


@query()
def lmm_lrt(spark, d):
    return rounded(M.likelihood_ratios(M.ladder(_stats(spark, d), ["phoneme", "formant"]), ["phoneme", "formant"]), 5)


def _pooled(spark, d):
    """Formants of all vowels in long form, with the height of each vowel."""
    heights = schema.label_of(schema.VOWEL_HEIGHT)
    t = D.vowels(normed(spark, d)).withColumn("vowel_height", I.map_label("phoneme", heights, "unknown"))
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("formant"), F.col(f"{f}_normed").alias("y")) for f in ("F1", "F2")]))
    return t.select("spk", "L1", "Gender", "vowel_height", "phoneme", each.alias("f")).select("spk", "L1", "Gender", "vowel_height", "phoneme", "f.formant", "f.y")


@query()
def lmm_pooled(spark, d):
    """The ladder over all vowels at once, up to vowel height and a random slope of L1."""
    return rounded(MM.mixed_models_of_cells(_pooled_cells(spark, d), ["formant"]), 5)


@query()
def lmm_pooled_lrt(spark, d):
    pairs = (("M0", "M1"), ("M1", "M2"), ("M2", "M3"), ("M3", "M4"))
    return rounded(M.likelihood_ratios(MM.mixed_models_of_cells(_pooled_cells(spark, d), ["formant"]), ["formant"], pairs), 5)


@query()
def lmm_random_slope(spark, d):
    """M2 and M4 (random slope of L1 by speaker) for each vowel and formant, and their likelihood ratio."""
    by = ["phoneme", "formant"]
    models = {k: MM.POOLED[k] for k in ("M2", "M4")}
    m = MM.mixed_models_of_cells(_pooled_cells(spark, d), by, models, ("L1", "Gender"), reml=())
    ratio = M.likelihood_ratios(m, by, (("M2", "M4"),)).drop("comparison")
    slope = m.where("model = 'M4' and term = 'Intercept'").select(*by, "var_u", "var_slope", "cov_slope", "var_e", "aic", "status")
    return rounded(slope.join(ratio, by), 4)


@query(f"""
with {_NORMED}, h as (select *, (phoneme in ('a', 'ɑ'))::int as low, (phoneme in ('e','ø','o','ɛ','œ'))::int as mid, (L1 = 'ru')::int as ru, (Gender = 'm')::int as m from v)
select formant, spk, count(*) as n, round(sum(y * y), 4) as yy, round(sum(y), 4) as y, round(sum(ru * y), 4) as ru_y, round(sum(m * y), 4) as m_y,
  round(sum(low * y), 4) as low_y, round(sum(mid * y), 4) as mid_y, sum(low)::double as low, sum(mid)::double as mid, sum(low * ru * m)::double as low_ru_m
from (select 'F1' as formant, F1_normed as y, * from h union all select 'F2', F2_normed, * from h) where y is not null group by all
""")
def lmm_unit_moments(spark, d):
    """The speakers' moments that the pooled models are fitted from."""
    t = _pooled(spark, d).dropna()
    is_ = lambda c, v: (F.col(c) == v).cast("double")
    low, mid, ru, m = is_("vowel_height", "low"), is_("vowel_height", "mid"), is_("L1", "ru"), is_("Gender", "m")
    x = [F.lit(1.0), ru, m, low, mid, low * ru * m]
    u = MM.unit_moments(t, "y", x, ["formant"], "spk")
    xy, first = (lambda i: F.element_at("xy", i + 1)), (lambda j: F.element_at("xx", j + 1))
    named = {"y": xy(0), "ru_y": xy(1), "m_y": xy(2), "low_y": xy(3), "mid_y": xy(4), "low": first(3), "mid": first(4), "low_ru_m": first(5)}
    return rounded(u.select("formant", "spk", "n", "yy", *[c.alias(k) for k, c in named.items()]), 4)


def _neural_models(spark, d):
    """M1 by maximum likelihood for each component of a PCA by model and phone, with the component's share of variance."""
    by = ["model", "phoneme"]
    r = vowel_reps(spark, d)
    parts = materialise(R.pca_by(r, by, Config().n_pc), "pca-by-phone")
    z = R.project_by(r, parts, by).select(*by, "spk", "L1", "Gender", F.posexplode("pc").alias("pc", "y"))
    m = M.ladder(M.unit_stats(z, "y", [*by, "pc"]).withColumnRenamed("model", "rep"), ["rep", "phoneme", "pc"], models=("M1",)).where("not reml")
    share = parts.select(F.col("model").alias("rep"), "phoneme", F.posexplode("share").alias("pc", "share"))
    return m.join(share, ["rep", "phoneme", "pc"]).withColumn("pct_var_explained", F.col("share") * 100).drop("share")


@query()
def lmm_neural(spark, d):
    return rounded(_neural_models(spark, d), 5)


@query()
def lmm_neural_r2(spark, d):
    """Marginal R2 over the components of a phone, weighted by their share of variance."""
    one = _neural_models(spark, d).groupBy("rep", "phoneme", "pc").agg(F.first("r2_marginal").alias("r2"), F.first("pct_var_explained").alias("w"))
    return rounded(one.groupBy("rep", "phoneme").agg((F.sum(F.col("w") * F.coalesce("r2", F.lit(0.0))) / F.sum("w")).alias("r2_marginal_weighted")), 5)


@query()
def lmm_acoustic_r2(spark, d):
    one = M.ladder(_stats(spark, d), ["phoneme", "formant"], models=("M1",)).where("not reml").groupBy("phoneme", "formant").agg(
        F.first("r2_marginal").alias("m"), F.first("r2_conditional").alias("c")
    )
    return rounded(one.groupBy("formant").agg(F.avg("m").alias("r2_marginal"), F.avg("c").alias("r2_conditional")), 5)


@query()
def variance_components(spark, d):
    """Total and mean within-speaker variance, and the speaker and residual variance of a random-intercept model."""
    v = D.vowels(normed(spark, d))
    parts = D.variance_decomposition(v, "F1_normed").drop("var_pooled")
    m = M.ladder(_stats(spark, d).where("formant = 'F1'").drop("formant"), ["phoneme"], models=("M0",)).where("reml")
    m = m.select("phoneme", F.col("var_u").alias("var_inter_speaker"), F.col("var_e").alias("var_residual"))
    return rounded(parts.join(m, "phoneme", "left"), 5)


def _lmm_rope(spark, d):
    by = ["phoneme", "formant"]
    return P.classify_acoustic(M.wald_intervals(M.ladder(_stats(spark, d), by, models=("M1", "M2")), by))


@query()
def rope_lmm(spark, d):
    """The mixed models' Wald intervals of the effects of L1 against the region of practical equivalence."""
    return rounded(_lmm_rope(spark, d), 5)


@query()
def rope_lmm_significant(spark, d):
    return rounded(P.significant_equivalent(_lmm_rope(spark, d)), 5)


@query()
def rope_lmm_summary(spark, d):
    return P.summary(_lmm_rope(spark, d))


_R2 = f"""with {_NORMED}, g as (select phoneme, rep_id, count(*) as w, corr(F1_normed, F2_normed) ** 2 as r2 from v where F1_normed is not null and F2_normed is not null group by all)"""


def _r2(spark, d):
    v = D.vowels(normed(spark, d)).where("F1_normed is not null and F2_normed is not null")
    return v.groupBy("phoneme", "rep_id").agg(F.count(F.lit(1)).alias("w"), (F.corr("F1_normed", "F2_normed") ** 2).alias("r2"))


@query(_R2 + " select phoneme, round(sum(w * coalesce(r2, 0)) / sum(w), 6) as weighted_r2 from g group by phoneme")
def weighted_r2(spark, d):
    g = _r2(spark, d).groupBy("phoneme")
    return rounded(g.agg((F.sum(F.col("w") * F.coalesce("r2", F.lit(0.0))) / F.sum("w")).alias("weighted_r2")))


@query(_R2 + " select rep_id, round(avg(r2), 6) as mean_r2 from g group by rep_id")
def mean_r2(spark, d):
    return rounded(_r2(spark, d).groupBy("rep_id").agg(F.avg("r2").alias("mean_r2")))


@query()
def pca_explained(spark, d):
    _, _, share = R.pca(S.reps(spark, d), 10)
    return rounded(spark.createDataFrame([(i + 1, float(s)) for i, s in enumerate(share)], "component int, share double"))


@query()
def pca_points(spark, d):
    r = S.reps(spark, d)
    p = R.reduce(r, "pca", 2)
    return rounded(p.select("token_id", "phoneme", "L1", "Gender", "keep", F.get("pc", F.lit(0)).alias("x"), F.get("pc", F.lit(1)).alias("y")))


@query()
def umap_points(spark, d):
    """Two UMAP coordinates of every token under both models; tokens without a valid vector keep their rows."""
    r = S.models(S.reps(spark, d)).select("token_id", "phoneme", "L1", "Gender", "model", "v")
    # The rounds are many short jobs, so the models run side by side.
    with ThreadPoolExecutor(2) as pool:
        one = inheritable_thread_target(spark)(lambda m: U.embed(r.where(F.col("model") == m), 2))
        parts = list(pool.map(one, ("whisper", "xlsr")))
    p = parts[0].union(parts[1])
    return p.select("token_id", "phoneme", "L1", "Gender", "model", "keep", F.get("pc", F.lit(0)).alias("x"), F.get("pc", F.lit(1)).alias("y"))


@query("""
select event_type, date_trunc('hour', ts) as hour, count(*)::bigint as n, round(sum(value), 4) as total from events group by all
""")
def hourly_events(spark, d):
    from quillon.streaming.windows import hourly

    out = hourly(S.table(spark, d, "events"))
    return out.withColumn("total", F.round("total", 4))


@query(f"""with {_NORMED}, m as (select spk, count(F1) as n1, avg(F1) as m1, stddev_samp(F1) as s1, count(F2) as n2, avg(F2) as m2, stddev_samp(F2) as s2
  from t where lower(trim(phoneme)) in {schema.LOBANOV_VOWELS} group by spk)
select spk, n1::bigint as "n_F1", round(m1, 6) as "mean_F1", round(s1, 6) as "sd_F1", n2::bigint as "n_F2", round(m2, 6) as "mean_F2", round(s2, 6) as "sd_F2" from m""")
def stream_lobanov_moments(spark, d):
    """Lobanov's means and deviations from a stream that brings the tokens in about four batches of files."""
    from quillon.streaming import moments as SM
    from quillon.sources.durable import folder

    path = folder(spark, "token-stream")
    t = S.tokens(spark, d).select("spk", "phoneme", "F1", "F2")
    # Each task writes to four folders, so that tokens needn't be shuffled for four files.
    t.withColumn("part", F.pmod(F.xxhash64("spk", "F1", "F2"), F.lit(4))).write.partitionBy("part").parquet(path)
    files = len(spark.read.schema(t.schema).parquet(path).inputFiles())
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", max(1, -(-files // 4))).parquet(path)
    return rounded(SM.merged(SM.consume(stream)))


#: A stand-in encoder's numbers: two values a frame of four samples, windows of a second.
_STEP, _WIDTH = 4, 2


@query(f"""with r as ({S.REPS_SQL}),
s as (select token_id, phoneme, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as i from r),
f as (select token_id, phoneme, (i // {_STEP})::int as frame, ((i % {_STEP}) // {_STEP // _WIDTH})::int as dim, avg(x) as x from s group by all)
select token_id, dim, round(avg(x), 6) + 0.0 as x from f where frame >= token_id % 5 and frame < token_id % 5 + 6 group by all
""")
def encoder_pooling(spark, d):
    """Frames of an encoder in batches of eight windows, pooled over each token's stretch of frames.

    A vector's components stand for the samples of its audio."""
    rate = schema.ENCODER_FRAMES_PER_SECOND * _STEP
    audio = S.reps(spark, d).select(F.col("token_id").cast("string").alias("path"), F.lit(rate).alias("rate"), F.col("v").alias("samples"))
    f = I.encode_windows(audio, I.energy_encoder(_WIDTH, _STEP), _WIDTH, rate, seconds=1)
    f = f.withColumn("token_id", F.col("wav_path").cast("bigint")).withColumn("a", (F.col("token_id") % 5).cast("int"))
    out = I.mean_pool(f.withColumn("b", F.least(F.col("a") + 6, F.col("n_frames"))), ["token_id"], "frames", "a", "b")
    return rounded(out.select("token_id", F.posexplode("v").alias("dim", "x")))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
