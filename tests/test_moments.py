"""Mixed models from moments against dense likelihoods and closed forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import moments as MM


def simulated(seed=1, units=14, balanced=False):
    rng = np.random.default_rng(seed)
    rows = []
    for u in range(units):
        a, b = rng.normal(0, 1.0), rng.normal(0, 0.7)
        for k in range(8 if balanced else rng.integers(4, 14)):
            x = k % 2 if balanced else int(rng.random() < 0.5)
            g = "m" if u % 2 else "f"
            rows.append((f"S{u:02d}", "ru" if x else "fr", g, ["high", "low", "mid"][int(rng.integers(3))], 2.0 + a + (0.5 + b) * x + (g == "m") * 0.3 + rng.normal(0, 0.5)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "spk string, L1 string, Gender string, vowel_height string, y double").repartition(3)


def dense(rows, columns, z, low, reml=False):
    """Log likelihood with every V written out."""
    x = np.array([[1.0, *[float(f(r)) for f in columns]] for r in rows])
    y, unit = np.array([r[4] for r in rows]), np.array([r[0] for r in rows])
    blocks, det = [], 0.0
    for u in sorted(set(unit)):
        i = np.flatnonzero(unit == u)
        v = np.eye(len(i)) + x[np.ix_(i, z)] @ low @ low.T @ x[np.ix_(i, z)].T
        blocks.append((x[i], y[i], np.linalg.inv(v)))
        det += np.linalg.slogdet(v)[1]
    xtx = sum(a.T @ w @ a for a, _, w in blocks)
    beta = np.linalg.solve(xtx, sum(a.T @ w @ b for a, b, w in blocks))
    free = len(y) - x.shape[1] if reml else len(y)
    s2 = sum((b - a @ beta) @ w @ (b - a @ beta) for a, b, w in blocks) / free
    ll = -0.5 * (free * np.log(2 * np.pi * s2) + det + free)
    return (ll - 0.5 * np.linalg.slogdet(xtx)[1] if reml else ll), beta, s2


RU, M, LOW, MID = (lambda r: r[1] == "ru"), (lambda r: r[2] == "m"), (lambda r: r[3] == "low"), (lambda r: r[3] == "mid")
BOTH = lambda r: r[1] == "ru" and r[2] == "m"


def by_model(df, reml=False):
    out = {}
    for r in df.where(F.col("reml") == reml).collect():
        out.setdefault(r.model, {})[r.term] = r
    return out


def test_fits_are_maxima_of_the_dense_likelihood(spark):
    rows = simulated()
    out = MM.mixed_models(frame(spark, rows), "y", [])
    got = by_model(out)
    designs = {"M1": [RU, M], "M2": [RU, M, BOTH], "M3": [RU, M, BOTH, LOW, MID], "M4": [RU, M, BOTH]}
    for name, columns in designs.items():
        first = got[name]["Intercept"]
        cov = np.array([[first.var_u]]) if name != "M4" else np.array([[first.var_u, first.cov_slope], [first.cov_slope, first.var_slope]])
        low = np.linalg.cholesky(cov / first.var_e)
        z = [0] if name != "M4" else [0, 1]
        ll, beta, s2 = dense(rows, columns, z, low)
        assert first.loglik == pytest.approx(ll, abs=1e-6) and first.var_e == pytest.approx(s2, rel=1e-5)
        names = ["Intercept", "L1[T.ru]", "Gender[T.m]", "L1[T.ru]:Gender[T.m]", "vowel_height[T.low]", "vowel_height[T.mid]"]
        assert [got[name][t].coef for t in names if t in got[name]] == pytest.approx(beta.tolist(), abs=1e-5)
        rng = np.random.default_rng(0)
        for _ in range(40):  # nothing near it is better
            other = low + np.tril(rng.normal(0, rng.choice([0.3, 0.03, 0.003]), low.shape))
            assert dense(rows, columns, z, other)[0] <= ll + 1e-6
    assert got["M4"]["Intercept"].status == "ok" and got["M3"]["Intercept"].n_params == 8
    assert got["M4"]["Intercept"].loglik > got["M2"]["Intercept"].loglik
    null = by_model(out, True)["M0"]["Intercept"]
    assert null.loglik == pytest.approx(dense(rows, [], [0], np.array([[np.sqrt(null.var_u / null.var_e)]]), True)[0], abs=1e-6)


def test_balanced_one_way_is_known_in_closed_form(spark):
    """n rows in each of k units: ML and REML variances by the analysis of variance."""
    rows = [(s, "fr", "f", "high", y) for s, _, _, _, y in simulated(2, 12, balanced=True)]
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r[4])
    k, n = len(groups), 8
    means = np.array([np.mean(v) for v in groups.values()])
    within = sum(((np.array(v) - np.mean(v)) ** 2).sum() for v in groups.values()) / (k * (n - 1))
    between = n * ((means - means.mean()) ** 2).sum()
    out = MM.mixed_models(frame(spark, rows), "y", [], {"M0": MM.POOLED["M0"]})
    for reml, share in ((True, between / (k - 1)), (False, between / k)):
        r = by_model(out, reml)["M0"]["Intercept"]
        assert r.var_e == pytest.approx(within, rel=1e-4) and r.var_u == pytest.approx((share - within) / n, rel=1e-4)
        assert r.coef == pytest.approx(means.mean()) and r.se == pytest.approx(np.sqrt(share / (k * n)), rel=1e-4)


def test_groups_nulls_and_boundaries(spark):
    rows = simulated(3)
    d = frame(spark, [*rows, (None, "fr", "f", "low", 9e9), ("S00", None, "f", "low", 9e9), ("S00", "fr", "f", "low", None)])
    d = d.withColumn("g", F.lit("all")).union(frame(spark, rows[:2]).withColumn("g", F.lit("small")))
    out = MM.mixed_models(d, "y", ["g"], {"M0": MM.POOLED["M0"], "M1": MM.POOLED["M1"]})
    assert {r.g for r in out.collect()} == {"all"} and out.first().n_tokens == len(rows)
    flat = [(s, x, g, h, float(i % 2)) for i, (s, x, g, h, _) in enumerate(simulated(2, 6, balanced=True))]
    r = MM.mixed_models(frame(spark, flat), "y", [], {"M0": MM.POOLED["M0"]}).where("not reml").first()
    assert r.status == "boundary" and r.var_u == 0 and r.coef == pytest.approx(0.5)
    between = [(s, "ru" if int(s[1:]) % 3 else "fr", g, h, y) for s, _, g, h, y in rows]
    r = MM.mixed_models(frame(spark, between), "y", [], {"M4": MM.POOLED["M4"]}).first()
    assert r.status == "slope_not_separate"
    assert MM.mixed_models(frame(spark, []), "y", []).count() == 0


def test_wald_intervals_are_of_maximum_likelihood(spark):
    from quillon.operators import mixed

    rows = simulated(4, 10)
    rows = [(s, "ru" if int(s[1:]) % 2 else "fr", "f" if int(s[1:]) % 3 else "m", h, y) for s, _, _, h, y in rows]
    d = frame(spark, rows).withColumn("p", F.lit("a"))
    a = mixed.wald_intervals(mixed.ladder(mixed.unit_stats(d, "y", ["p"]), ["p"], models=("M1",)), ["p"]).collect()
    b = by_model(MM.mixed_models(d, "y", ["p"], {"M1": MM.POOLED["M1"]}))["M1"]
    for r in a:
        assert r.coef == pytest.approx(b[r.effect].coef, abs=1e-5) and r.se == pytest.approx(b[r.effect].se, rel=1e-4)


def test_units_of_one_kind_are_put_together(spark):
    """Units with equal Z'Z make one row whatever their number, and the sums over kinds are those over units."""
    rows = [(f"{u}-{s}", x, "m" if u % 2 else "f", h, y + u) for u in range(30) for s, x, _, h, y in simulated(5, 4, balanced=True)]
    p, z = 3, [0, 1]
    d = frame(spark, rows)
    ru, m = (F.col("L1") == "ru").cast("double"), (F.col("Gender") == "m").cast("double")
    units = MM.unit_moments(d, "y", [F.lit(1.0), ru, m], [], "spk")
    again = MM.cell_moments(MM.cells(d, "y", [], "spk", ("L1", "Gender")), [F.lit(1.0), ru, m], [], "spk")
    one, two = ({r.spk: [r.n, r.yy, *r.xy, *r.xx] for r in t.collect()} for t in (units, again))
    assert len(one) == 120 and all(one[k] == pytest.approx(two[k]) for k in one)
    kinds = MM.unit_kinds(units, [], p, z).toPandas()
    assert len(kinds) == 1 and kinds["u"][0] == 120 and list(kinds["inside"][0]) == [0, 120, 0]
    low = MM.covariance(np.array([[0.3, -0.4, 0.5]]), 2)
    ww = MM.full(np.stack(kinds["ww"]), 2 * (p + 1)).reshape(-1, 2, p + 1, 2, p + 1)
    got = MM.partial_sums(kinds["u"].to_numpy(float), kinds["yy"].to_numpy(), np.stack(kinds["xy"]), MM.full(np.stack(kinds["xx"]), p), MM.full(np.stack(kinds["zz"]), 2), ww, low)[0]
    want = np.zeros(p * p + p + 2)
    for u in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == u]
        x, y = np.array([[1.0, RU(r), M(r)] for r in own]), np.array([r[4] for r in own])
        v = np.eye(len(own)) + x[:, z] @ low[0] @ low[0].T @ x[:, z].T
        w = np.linalg.inv(v)
        want += np.array([*(x.T @ w @ x).ravel(), *(x.T @ w @ y), y @ w @ y, np.linalg.slogdet(v)[1]])
    assert got == pytest.approx(want, rel=1e-9)


def test_kinds_of_pooled_models_do_not_grow_with_speakers(spark):
    """Heights vary inside speakers and differ between them; kinds are told apart by the random part only."""
    heights = ["high", "low", "mid"]
    of = lambda n: [(f"S{u}", "ru" if u % 2 else "fr", "m" if u % 3 else "f", heights[(u * k) % 3], float(u % 7 + k)) for u in range(n) for k in range(4 + u % 3)]
    sizes = []
    for n in (60, 240):
        columns = MM.treatment(frame(spark, of(n)), ("L1", "Gender", "vowel_height"), ("L1", "Gender", "vowel_height"))
        x = [c for t in columns.values() for _, c in t]
        units = MM.cell_moments(MM.cells(frame(spark, of(n)), "y", [], "spk", ("L1", "Gender", "vowel_height")), x, [], "spk")
        got = MM.unit_kinds(units, [], len(x), [0, 1]).toPandas()
        assert got["u"].sum() == n and got["n"].sum() == len(of(n))
        sizes.append(len(got))
    assert sizes == [6, 6]


def test_ladder_sees_kinds_of_units_not_units(spark):
    """Speakers of equal n and covariates are one row of the ladder; fits equal those to single speakers."""
    from quillon.operators import mixed

    rng = np.random.default_rng(6)
    rows = [("a", f"S{u:03d}", "ru" if u % 2 else "fr", "m" if u % 3 else "f", 900.0 + e + rng.normal()) for u in range(150) for e in [rng.normal()] for _ in range(3 + u % 4)]
    d = spark.createDataFrame(rows, "p string, spk string, L1 string, Gender string, y double").repartition(3)
    stats = mixed.unit_stats(d, "y", ["p"])
    kinds = mixed.unit_kinds(stats, ["p"]).toPandas()
    assert kinds["u"].sum() == 150 and len(kinds) == len({(u % 2, u % 3 > 0, u % 4) for u in range(150)})
    units = stats.toPandas().sort_values("spk")
    got = {(r.model, r.reml, r.term): r for r in mixed.ladder(stats, ["p"]).collect()}
    for name, terms in mixed.MODELS.items():
        x, names = mixed.design(units, terms)
        slope = (units["L1"] != "fr").to_numpy(float) if name == "M4" else None
        for reml in (True, False):
            want = mixed.fit(units["n"], units["sy"], units["syy"], x, reml, slope)
            for i, t in enumerate(names):
                r = got[name, reml, t]
                assert [r.coef, r.se, r.loglik] == pytest.approx([want["beta"][i], want["se"][i], want["loglik"]], rel=1e-6)
                assert [r.var_u, r.var_e, r.r2_marginal] == pytest.approx([want[c] for c in ("var_u", "var_e", "r2_marginal")], rel=1e-4)
                assert r.status == want["status"] and r.n_params == want["params"]


def test_unit_statistics_sort_no_tokens(spark):
    """Sums by unit go by hash; several columns are taken in one pass and give what each gives alone."""
    from quillon.operators import mixed

    d = spark.createDataFrame([("a", f"S{i % 5}", "fr", "m" if i % 2 else "f", float(i), None if i % 3 else i * 0.5) for i in range(60)] + [("a", None, "fr", "f", 1.0, 1.0)], "p string, spk string, L1 string, Gender string, F1 double, F2 double")
    both = mixed.unit_stats_by_column(d, {"F1": "F1", "F2": "F2"}, ["p"], "formant")
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    physical = both._jdf.queryExecution().sparkPlan().toString()
    assert "Aggregate" in plan and physical.split("Generate")[-1].count("SortAggregate") == 0
    for f in ("F1", "F2"):
        one = {r.spk: r.asDict() for r in mixed.unit_stats(d, f, ["p"]).collect()}
        got = {r.spk: {k: v for k, v in r.asDict().items() if k != "formant"} for r in both.where(F.col("formant") == f).collect()}
        assert got == one and len(got) == 5 and set(one["S1"].values()) >= {"f"}


def test_sums_of_normed_values_need_no_join_of_tokens(spark):
    """Cells of raw values give the sums over normalised tokens, without a join or a sort of them; speakers without a spread have none."""
    from quillon.operators import descriptive as D
    from quillon.operators import mixed

    rng = np.random.default_rng(8)
    rows = [(f"S{i % 6}", "ru" if i % 2 else "fr", "m" if i % 3 else "f", "aeiut"[i % 5], 1e5 + float(rng.normal()), None if i % 4 == 0 else float(rng.normal(9, 2))) for i in range(240)]
    rows += [("flat", "fr", "f", "aei"[i % 3], 0.1, 0.1) for i in range(10)] + [("one", "fr", "f", "a", 1.0, 2.0), (None, "fr", "f", "a", 3.0, 4.0), ("t", "fr", "f", "t", 5.0, 6.0)]
    d = spark.createDataFrame(rows, "spk string, L1 string, Gender string, phoneme string, F1 double, F2 double").repartition(3)
    by = ["phoneme", "formant"]
    cells = D.lobanov_cells(d, ["L1", "Gender", "phoneme"])
    key = lambda t: {(r.phoneme, r.formant, r.spk): [r.n, r.sy, r.syy] for r in t.collect()}
    got = key(mixed.unit_totals(cells, by))
    want = key(mixed.unit_stats_by_column(D.vowels(D.lobanov(d)), {f: f"{f}_normed" for f in ("F1", "F2")}, ["phoneme"], "formant"))
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], rel=1e-6, abs=1e-6) for k in want)
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "SortAggregate" not in plan
