import numpy as np
import pytest

from inkwell.operators import thresholds as th

LOW, HIGH = [0.040, 0.042, 0.044, 0.046, 0.048, 0.050, 0.052, 0.055], [0.190, 0.195, 0.200, 0.205, 0.210]


def scores(spark, values):
    return spark.createDataFrame([(f"c{i:03}", None if v is None else float(v)) for i, v in enumerate(values)], "creation_id string, score double")


def brute(values):
    s, n, best = sorted(values), len(values), (-1.0, 0)
    for k in range(1, n):
        w, a, b = k / n, np.mean(s[:k]), np.mean(s[k:])
        v = w * (1 - w) * (a - b) ** 2
        if v > best[0] + 1e-15:
            best = (v, k)
    return best[1], (s[best[1] - 1] + s[best[1]]) / 2, best[0]


@pytest.mark.parametrize("values,k,tau,var", [([0.2, 0.8], 1, 0.5, 0.09), ([0, 0, 1, 1], 2, 0.5, 0.25), (LOW + HIGH, 8, 0.1225, None), ([0.3] * 4, 1, 0.3, 0.0)])
def test_otsu_golden(spark, values, k, tau, var):
    r = th.otsu_exact(scores(spark, values)).first()
    assert (r.k, round(r.tau, 9)) == (k, tau)
    assert var is None or abs(r.variance - var) < 1e-12


def test_otsu_against_brute_force(spark):
    rng = np.random.default_rng(5)
    for n in (2, 3, 17, 120):
        v = rng.random(n).round(4)
        r = th.otsu_exact(scores(spark, [*v, None])).first()
        k, tau, var = brute(list(v))
        assert r.n == n and r.k == k and abs(r.tau - tau) < 1e-9 and abs(r.variance - var) < 1e-9


def test_too_few_scores(spark):
    with pytest.raises(Exception, match="two scores"):
        th.otsu_exact(scores(spark, [0.5, None])).collect()


def test_binned_and_cross_check(spark):
    s = scores(spark, LOW + HIGH)
    assert abs(th.otsu_binned(s).first().tau - 0.0549) < 1e-4
    r = th.cross_check(s).first()
    assert r.same_gap and r.n_differ == 1


def test_diagnostics(spark):
    good, flat = th.diagnostics(scores(spark, LOW + HIGH)).first(), th.diagnostics(scores(spark, [i / 100 for i in range(49)])).first()
    assert good.bimodal and good.flags == ""
    assert not flat.bimodal and "narrow gap" in flat.flags


def test_labels_are_strict(spark):
    s = scores(spark, [0.1, 0.2, 0.3, None])
    got = {r.creation_id: (r.label, r.borderline) for r in th.classified(s, th.manual_threshold(s, 0.2)).collect()}
    assert got == {"c000": ("authentic", False), "c001": ("authentic", True), "c002": ("suspicious", False)}


def test_dispatch(spark):
    s = scores(spark, LOW + HIGH)
    taus = {m: th.threshold(s, m).first().tau for m in th.METHODS}
    assert all(0.05 < t < 0.19 for t in taus.values())
    with pytest.raises(ValueError):
        th.threshold(s, "nope")
    with pytest.raises(ValueError):
        th.threshold(s, "manual")


def test_scores_that_hardly_differ_are_parted_where_they_differ_most(spark):
    r = th.otsu_exact(scores(spark, [0.3 + x * 1e-9 for x in (0, 1, 2, 20, 21, 22, 23)])).first()
    assert r.k == 3


def test_equal_scores_have_no_binned_threshold(spark):
    with pytest.raises(Exception, match="equal scores"):
        th.otsu_binned(scores(spark, [0.3] * 4)).collect()
