"""Reference distributions and tests against published values and brute force."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sondage.functions import pvalues as P
from sondage.operators import stats as T


@pytest.mark.parametrize("z,p", [(0.0, 0.5), (1.0, 0.1586553), (1.6448536, 0.05), (1.959964, 0.025), (3.0, 0.0013499)])
def test_normal(z, p):
    assert P.normal_sf(z) == pytest.approx(p, abs=1e-6)
    assert P.normal_ppf(1 - p) == pytest.approx(z, abs=1e-4)


@pytest.mark.parametrize("t,dof,p", [(12.706, 1, 0.05), (2.228, 10, 0.05), (2.042, 30, 0.05), (2.750, 30, 0.01), (1.960, 1e6, 0.05)])
def test_student(t, dof, p):
    assert P.t_two_sided(t, dof) == pytest.approx(p, abs=2e-4)


@pytest.mark.parametrize("f,a,b,p", [(161.4476, 1, 1, 0.05), (4.9646, 1, 10, 0.05), (3.3258, 5, 10, 0.05), (2.5336, 5, 30, 0.05)])
def test_fisher(f, a, b, p):
    assert P.f_sf(f, a, b) == pytest.approx(p, abs=1e-4)


@pytest.mark.parametrize("x,dof,p", [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (18.307, 10, 0.05), (23.209, 10, 0.01), (124.342, 100, 0.05)])
def test_chi_square_tail(x, dof, p):
    assert P.chi2_sf(x, dof) == pytest.approx(p, abs=1e-5)


def test_t_test_by_hand(rows):
    df = rows([("a", v) for v in (30.02, 29.99, 30.11, 29.97, 30.01, 29.99)] + [("b", v) for v in (29.89, 29.93, 29.72, 29.98, 30.02, 29.98)], "g string, v double")
    r = T.ttest_ind(df, "v", "g", "a", "b").first()
    assert r["t"] == pytest.approx(1.959, abs=1e-3) and r["dof"] == 10 and r["p_value"] == pytest.approx(0.07857, abs=1e-4)


def test_anova_by_hand(rows):
    groups = {"a": (6, 8, 4, 5, 3, 4), "b": (8, 12, 9, 11, 6, 8), "c": (13, 9, 11, 8, 7, 12)}
    df = rows([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double")
    r = T.anova(df, "v", "g").first()
    assert r["f"] == pytest.approx(9.2647, abs=1e-3) and (r["df_between"], r["df_within"]) == (2, 15)
    assert r["p_value"] == pytest.approx(0.0024, abs=1e-4) and r["significant"]


def test_chi_square_two_by_two_is_corrected(rows):
    cells = {("m", "y"): 43, ("m", "n"): 9, ("f", "y"): 44, ("f", "n"): 4}
    df = rows([k for k, n in cells.items() for _ in range(n)], "a string, b string")
    r = T.chi_square(df, "a", "b").first()
    assert r["chi2"] == pytest.approx(1.0724, abs=1e-3) and r["dof"] == 1 and r["p_value"] == pytest.approx(0.3004, abs=1e-3)


def test_mann_whitney_brute_force(rows):
    rng = random.Random(3)
    a, b = [float(rng.randint(0, 20)) for _ in range(40)], [float(rng.randint(3, 23)) for _ in range(35)]
    r = T.mann_whitney(rows([("a", v) for v in a] + [("b", v) for v in b], "g string, v double"), "v", "g", "a", "b").first()
    assert r["u"] == sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert 0 < r["p_value"] < 1


@pytest.mark.parametrize("seed", [1, 2])
def test_kendall_and_spearman_brute_force(rows, seed):
    rng = random.Random(seed)
    data = [(float(rng.randint(0, 12)), float(rng.randint(0, 9)) if rng.random() > 0.1 else None) for _ in range(120)]
    df = rows(data, "a double, b double")
    pairs = [(x, y) for x, y in data if y is not None]
    sign = lambda v: (v > 0) - (v < 0)
    num = sum(sign(p[0] - q[0]) * sign(p[1] - q[1]) for p in pairs for q in pairs)
    dx = sum(abs(sign(p[0] - q[0])) for p in pairs for q in pairs)
    dy = sum(abs(sign(p[1] - q[1])) for p in pairs for q in pairs)
    assert T.corr_pairs(df, ["a", "b"], "kendall").first()["r"] == pytest.approx(num / math.sqrt(dx * dy))

    def ranks(values):
        return [sum(w < v for w in values) + (sum(w == v for w in values) + 1) / 2 for v in values]

    r = np.corrcoef(ranks([p[0] for p in pairs]), ranks([p[1] for p in pairs]))[0, 1]
    assert T.corr_pairs(df, ["a", "b"], "spearman").first()["r"] == pytest.approx(r)


def test_shapiro_known_weights(rows):
    """Men's weights example of Shapiro and Wilk (1965): W = 0.79, far from normal."""
    x = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    df = rows([(i, float(v), 5.0, None) for i, v in enumerate(x)], "k int, v double, one double, none double")
    for found in (T.shapiro_wilk(df, ["v", "one", "none"]), T.shapiro_wilk(df, ["v", "one", "none"], "k", most=5000)):
        r = {x["column"]: x for x in found.collect()}
        assert r["v"]["w"] == pytest.approx(0.79, abs=0.005) and r["v"]["p_value"] < 0.01 and r["v"]["n"] == 11
        assert (r["one"]["w"], r["one"]["n"], r["none"]["w"], r["none"]["n"]) == (None, 11, None, 0)


def test_normal_distribution_expressions(spark):
    from statistics import NormalDist

    from sondage.functions.columns import normal_cdf, normal_quantile

    zs = [0.0, 1e-9, -1e-9] + [s * z for z in (0.1, 0.66, 0.67, 1.0, 3.0, 5.6, 5.7, 8.0, 20.0, 37.0, 40.0) for s in (1, -1)]
    for r in spark.createDataFrame([(z,) for z in zs], "z double").select("z", normal_cdf(F.col("z")).alias("p")).collect():
        want = 0.5 * math.erfc(-r["z"] / math.sqrt(2))
        assert r["p"] == pytest.approx(want, rel=1e-12, abs=1e-300), r["z"]
    ps = [1e-300, 1e-20, 1e-5, 0.01, 0.07, 0.08, 0.3, 0.5, 0.6, 0.93, 0.99, 1 - 1e-12]
    for r in spark.createDataFrame([(p,) for p in ps], "p double").select("p", normal_quantile(F.col("p")).alias("z")).collect():
        assert r["z"] == pytest.approx(NormalDist().inv_cdf(r["p"]), rel=1e-12, abs=1e-15), r["p"]


def test_kolmogorov_law():
    """The value published with the exact method; both branches meet."""
    from sondage.functions.pvalues import kolmogorov_sf

    assert kolmogorov_sf(10, 0.274) == pytest.approx(1 - 0.6284796154565, abs=1e-12)
    assert kolmogorov_sf(1000, 0.04) == pytest.approx(kolmogorov_sf(1001, 0.04), abs=2e-3)
    assert kolmogorov_sf(5, 0.0) == 1.0 and kolmogorov_sf(5, 1.0) == 0.0 and kolmogorov_sf(10**9, 0.5) == 0.0


def test_normality_of_all_rows_against_plain_sums(rows, conf):
    """Ties, gaps and many order buckets; W and D from sorted values one by one."""
    from statistics import NormalDist

    conf(buckets=6)
    rng = random.Random(8)
    data = [(i, float(rng.randint(0, 40)), rng.gauss(5, 2) if rng.random() > 0.2 else None) for i in range(700)]
    df = rows(data, "id int, tied double, gaps double")
    w = {r["column"]: r for r in T.shapiro_wilk(df, ["tied", "gaps"]).collect()}
    ks = {r["column"]: r for r in T.ks_normal(df, ["tied", "gaps"]).collect()}
    for k, c in ((1, "tied"), (2, "gaps")):
        x = np.sort([r[k] for r in data if r[k] is not None])
        n = len(x)
        m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
        u, mm = 1 / math.sqrt(n), float(m @ m)
        a = np.empty(n)
        a[-1] = np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, m[-1] / math.sqrt(mm)], u)
        a[-2] = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, m[-2] / math.sqrt(mm)], u)
        a[0], a[1] = -a[-1], -a[-2]
        a[2:-2] = m[2:-2] / math.sqrt((mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * a[-1] ** 2 - 2 * a[-2] ** 2))
        assert w[c]["w"] == pytest.approx((a @ x) ** 2 / ((x - x.mean()) ** 2).sum(), abs=1e-10) and w[c]["n"] == n
        p = np.array([NormalDist(x.mean(), x.std(ddof=1)).cdf(v) for v in x])
        assert ks[c]["ks"] == pytest.approx(max(max((np.arange(n) + 1) / n - p), max(p - np.arange(n) / n)), abs=1e-10)


def test_normality_verdict_beyond_the_law_of_w(spark):
    df = spark.range(6000).select("id", F.randn(7).alias("normal"), F.pow(F.randn(7), F.lit(2.0)).alias("skewed"))
    t = {r["column"]: r for r in T.normality_table(df, ["normal", "skewed"]).collect()}
    assert t["normal"]["shapiro_p"] is None and t["normal"]["is_normal"] and not t["skewed"]["is_normal"]
    t = {r["column"]: r for r in T.normality_table(df, ["normal", "skewed"], "id", most=500).collect()}
    assert t["normal"]["shapiro_p"] > 0.01 and not t["skewed"]["is_normal"]


def test_normality_tells_normal_from_skewed(spark):
    df = spark.range(3000).select("id", F.randn(7).alias("normal"), F.pow(F.randn(7), F.lit(2.0)).alias("skewed")).cache()
    t = {r["column"]: r for r in T.normality_table(df, ["normal", "skewed"]).collect()}
    assert t["normal"]["is_normal"] and not t["skewed"]["is_normal"]
    assert t["normal"]["k2_p"] > 0.01 > t["skewed"]["k2_p"] and t["normal"]["ks"] < 0.03 < t["skewed"]["ks"]


def test_qq_points_of_a_normal_lie_on_a_line(spark):
    df = spark.range(5000).select((F.randn(11) * 3 + 10).alias("v"))
    pts = T.qq_points(df, "v", 21).orderBy("point").collect()
    assert pts[10]["theoretical"] == pytest.approx(0.0) and pts[0]["theoretical"] == pytest.approx(-2.3263, abs=1e-3)
    r = np.corrcoef([p["sample"] for p in pts], [p["theoretical"] for p in pts])[0, 1]
    assert r > 0.95


def test_correlation_p_value(rows):
    df = rows([(1.0, 2.0), (2.0, 1.0), (3.0, 4.0), (4.0, 3.0), (5.0, 5.0)], "a double, b double")
    r = T.corr_test(df, "a", "b").first()
    assert r["r"] == pytest.approx(0.8) and r["p_value"] == pytest.approx(0.104088, abs=1e-5)


def test_perfect_and_constant_correlation(rows):
    df = rows([(float(i), 2.0 * i, 5.0, None if i % 2 else 1.0) for i in range(10)], "a double, b double, c double, d double")
    got = {(r["a"], r["b"]): r["r"] for r in T.corr_matrix(df, ["a", "b", "c", "d"]).collect()}
    assert got["a", "b"] == 1.0 and got["a", "c"] is None and got["c", "c"] is None and got["a", "d"] is None


def _plain_rank_corr(table, method):
    """Upper triangle of pandas' own pairwise-complete matrix."""
    full = pd.DataFrame(table).corr(method=method)
    return {(i, j): full.iloc[i, j] for i in range(len(full)) for j in range(i + 1, len(full))}


@pytest.mark.parametrize("method", ["pearson", "spearman", "kendall"])
def test_all_pairs_at_once(spark, monkeypatch, method):
    """Columns with ties, gaps, opposite signs, one constant and one empty, against a plain pairwise matrix."""
    rng = np.random.default_rng(4)
    n = 90
    table = {f"c{i}": rng.integers(0, 4 + 9 * i, n).astype(float) for i in range(4)}
    table["gaps"] = np.where(rng.random(n) < 0.3, np.nan, rng.normal(size=n))
    table["more gaps"] = np.where(rng.random(n) < 0.5, np.nan, -table["c3"])
    table["one"], table["none"] = np.ones(n), np.full(n, np.nan)
    df = spark.createDataFrame(pd.DataFrame(table)).repartition(3)
    if method == "kendall":
        want = {}
        cols = list(table)
        for i in range(len(cols)):
            for j in range(i + 1, len(cols)):
                a, b = table[cols[i]], table[cols[j]]
                ok = ~(np.isnan(a) | np.isnan(b))
                sa, sb = (np.sign(v[ok][:, None] - v[ok][None, :]) for v in (a, b))
                down = math.sqrt(np.abs(sa).sum() * np.abs(sb).sum())
                want[i, j] = (sa * sb).sum() / down if down else math.nan
    else:
        want = _plain_rank_corr(table, method)
    for narrow, bits in ((16, 16), (2, 3)):
        monkeypatch.setattr(T, "_NARROW", narrow)
        monkeypatch.setattr(T, "_GROUP_BITS", bits)
        got = {(r["ia"], r["ib"]): r["r"] for r in T.corr_pairs(df, list(table), method).collect()}
        assert set(got) == set(want)
        for k, v in want.items():
            assert (got[k] is None) if math.isnan(v) else got[k] == pytest.approx(v, abs=1e-9), (k, got[k], v)


def test_three_hundred_columns_in_one_small_plan(spark):
    rng = np.random.default_rng(5)
    wide = rng.normal(size=(60, 300))
    wide[:, 7] = -3 * wide[:, 290] + 1
    df = spark.createDataFrame(pd.DataFrame(wide, columns=[f"c{i}" for i in range(300)])).repartition(2)
    out = T.corr_pairs(df, df.columns)
    got = {(r["ia"], r["ib"]): r["r"] for r in out.collect()}
    want = np.corrcoef(wide, rowvar=False)
    assert len(got) == 300 * 299 // 2 and got[7, 290] == pytest.approx(-1.0)
    assert max(abs(got[i, j] - want[i, j]) for i, j in got) < 1e-9


def test_rank_correlation_without_rows_or_pairs(spark):
    empty = spark.createDataFrame([], "a double, b double")
    for method in ("pearson", "spearman", "kendall"):
        assert [r["r"] for r in T.corr_pairs(empty, ["a", "b"], method).collect()] == [None]
        assert T.corr_pairs(empty, ["a"], method).count() == 0
    assert T.corr_test(empty, "a", "b", "spearman").first()["r"] is None
