import math

import numpy as np
import pytest

from quillon.functions import special as S
from quillon.operators import cluster as K
from quillon.operators import mixed as M
from quillon.operators.ingest import burg, formants
from quillon.sources import readers as R


def test_tails():
    assert S.t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert S.f_upper(4.0, 1, 20) == pytest.approx(0.0592658, abs=1e-6)
    assert S.chi2_upper(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-10)
    assert S.chi2_upper(5.991464547107979, 2) == pytest.approx(0.05, abs=1e-10)
    assert S.normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-12)


def test_mann_whitney_exact():
    assert S.mann_whitney(0, 3, 3, 0) == pytest.approx(0.1)
    assert S.mann_whitney_exact(4.5, 3, 3) == pytest.approx(1.0)


def test_mcnemar():
    assert S.mcnemar(3, 9)[1] == pytest.approx(598 / 4096)
    stat, p, exact = S.mcnemar(20, 40)
    assert stat == pytest.approx(19**2 / 60) and not exact and p == pytest.approx(math.erfc(math.sqrt(stat / 2)))
    assert S.mcnemar(0, 0)[1] == 1.0


def test_shapiro():
    # Weights of eleven men, the worked example of the 1965 paper: W = 0.79.
    w, p = S.shapiro([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert w == pytest.approx(0.79, abs=0.005) and 0.005 < p < 0.01
    normal = np.random.default_rng(1).standard_normal(200)
    assert S.shapiro(normal)[1] > 0.05 > S.shapiro(np.exp(normal))[1]
    assert math.isnan(S.shapiro([1.0, 2.0])[0])


def balanced(seed=3, k=12, n=8, spread=1.0):
    rng = np.random.default_rng(seed)
    return [5 + spread * rng.standard_normal() + rng.standard_normal(n) for _ in range(k)]


def test_mixed_model_is_anova_when_balanced():
    groups = balanced()
    n = len(groups[0])
    msw = np.mean([g.var(ddof=1) for g in groups])
    msb = n * np.var([g.mean() for g in groups], ddof=1)
    m = M.fit([n] * 12, [g.sum() for g in groups], [(g**2).sum() for g in groups], np.ones((12, 1)))
    assert m["var_e"] == pytest.approx(msw, rel=1e-5)
    assert m["var_u"] == pytest.approx((msb - msw) / n, rel=1e-4)
    assert m["beta"][0] == pytest.approx(np.mean(np.concatenate(groups)))


def test_mixed_model_boundary():
    g = np.array([1.0, 2.0, 3.0])
    m = M.fit([3] * 5, [g.sum()] * 5, [(g**2).sum()] * 5, np.ones((5, 1)))
    assert m["var_u"] == 0 and m["icc"] == 0 and m["status"] == "boundary"


def test_ward():
    x = np.array([0.0, 1.0, 5.0])
    z = K.ward(abs(x[:, None] - x))
    assert z[0][:3].tolist() == [0, 1, 1.0]
    assert z[1][2] == pytest.approx(math.sqrt(27))
    assert K.cut(z, 3, 2) == [1, 1, 2] and K.cut(z, 3, 3) == [1, 2, 3] and K.cut(z, 3, 1) == [1, 1, 1]


def closest_pairs(d):
    """Ward's linkage by joining the closest of all pairs, again and again."""
    n = len(d)
    d2, size, out = {(i, j): float(d[i, j]) ** 2 for i in range(n) for j in range(i + 1, n)}, dict.fromkeys(range(n), 1), []
    for new in range(n, 2 * n - 1):
        (i, j), v = min(d2.items(), key=lambda kv: (kv[1], kv[0]))
        del d2[i, j]
        a, b = size.pop(i), size.pop(j)
        for k, c in size.items():
            x, y = (d2.pop((min(k, o), max(k, o))) for o in (i, j))
            d2[k, new] = ((a + c) * x + (b + c) * y - c * v) / (a + b + c)
        size[new] = a + b
        out.append((i, j, math.sqrt(v), a + b))
    return np.array(out)


@pytest.mark.parametrize("n", [2, 3, 9, 40])
@pytest.mark.parametrize("metric", [True, False])
def test_ward_joins_the_closest_pairs(n, metric):
    """Euclidean distances, and numbers that are no metric."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 3))
    d = np.sqrt(((x[:, None] - x) ** 2).sum(-1)) if metric else rng.random((n, n))
    d = np.triu(d, 1) + np.triu(d, 1).T
    assert np.allclose(K.ward(d), closest_pairs(d))


def test_ward_of_ties_and_of_many():
    z = K.ward(1.0 - np.eye(6))
    assert z[0].tolist() == [0, 1, 1.0, 2] and (np.diff(z[:, 2]) >= 0).all() and z[-1, 3] == 6
    assert (K.ward(np.zeros((5, 5)))[:, 2] == 0).all()
    x = np.random.default_rng(0).normal(size=(3000, 2)) + 40 * (np.arange(3000) % 3)[:, None]
    square = (x**2).sum(1)
    z = K.ward(np.sqrt(np.maximum(square[:, None] + square - 2 * x @ x.T, 0)))
    parts = np.array(K.cut(z, 3000, 3))
    assert all(len(set(parts[i::3])) == 1 for i in range(3)) and len(set(parts)) == 3


def test_textgrid():
    text = '''File type = "ooTextFile"
item []:
    item [1]:
        class = "IntervalTier"
        intervals [1]:
            xmin = 0
            xmax = 1
            text = "word"
    item [2]:
        class = "IntervalTier"
        xmin = 0
        xmax = 1
        intervals: size = 2
        intervals [1]:
            xmin = 0
            xmax = 0.25
            text = "a"
        intervals [2]:
            xmin = 0.25
            xmax = 1
            text = ""
'''
    assert R.parse_textgrid(text) == [("a", 0.0, 0.25), ("", 0.25, 1.0)]
    assert R.parse_textgrid(text, 5) == []


def test_wav_round_trip_and_resampling():
    t = np.arange(8000) / 8000
    x = 0.5 * np.sin(2 * np.pi * 440 * t)
    y, rate = R.decode_wav(R.encode_wav(x, 8000))
    assert rate == 8000 and np.abs(x - y).max() < 1e-4
    z = R.resample(x, 8000, 16000)
    assert len(z) == 16000 and np.abs(z[::2] - x).max() < 1e-6


def test_formants_of_a_two_pole_source():
    rate, n = 16000, 4000
    rng = np.random.default_rng(0)
    x = rng.standard_normal(n)
    for hz, width in ((600, 60), (1600, 90)):
        r, th = math.exp(-math.pi * width / rate), 2 * math.pi * hz / rate
        y = np.zeros(n)
        for i in range(n):
            y[i] = x[i] + 2 * r * math.cos(th) * (y[i - 1] if i else 0) - r * r * (y[i - 2] if i > 1 else 0)
        x = y
    f1, f2 = formants(x, rate, 5000, n_formants=4)
    assert abs(f1 - 600) < 90 and abs(f2 - 1600) < 160
    assert len(burg(x, 4)) == 5
    assert math.isnan(formants(np.zeros(3), rate, 5000)[0])
