"""The paths meant for large tables give what the small-table paths give, and their plans stay distributed."""

import io
import math
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from catalog.base import table
from sondage.operators import ordered as O
from sondage.operators import stats as T
from sondage.operators import timeseries as R
from sondage.operators.profile import duplicate_rows, numeric_summary
from sondage.operators.relational import filter_in
from sondage.plans.joins import attach
from sondage.plans.ordering import order_bounds, with_buckets, with_global_index
from sondage.plans.values import quantiles_long, top_per_column


def same(a, b):
    def rounded(df):
        cols = sorted(df.columns)
        return sorted(
            tuple(repr(round(v, 8)) if isinstance(v, float) else repr(v) for v in (r[c] for c in cols)) for r in df.collect()
        )

    assert rounded(a) == rounded(b)


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("simple")
    return out.getvalue()


QS = (0.0, 0.05, 0.25, 0.5, 0.9, 1.0)


@pytest.mark.parametrize("by", [[], ["orderstatus"]])
def test_ranked_quantiles_equal_percentile(spark, folder, conf, by):
    d = table(spark, folder, "dirty_orders")
    expected = quantiles_long(d, ["totalprice", "custkey", "sparse_col"], QS, by).collect()
    conf(sketch_rows=0, buckets=5)
    got = quantiles_long(d, ["totalprice", "custkey", "sparse_col"], QS, by)
    same(got, spark.createDataFrame(expected, got.schema))


def test_ranked_quantiles_of_one_dominating_value(spark, rows, conf):
    conf(sketch_rows=0, buckets=4)
    data = [(1.0,)] * 700 + [(float(i),) for i in range(300)]
    got = quantiles_long(rows(data, "v double"), ["v"], [0.1, 0.5, 0.99]).first()
    values = sorted(v for v, in data)
    for q, name in ((0.1, "q0_1"), (0.5, "q0_5"), (0.99, "q0_99")):
        at = q * (len(values) - 1)
        lo, hi = values[math.floor(at)], values[math.ceil(at)]
        assert got[name] == pytest.approx(lo + (hi - lo) * (at - math.floor(at)))


@pytest.mark.parametrize("buckets", [2, 9])
@pytest.mark.parametrize("partition_by", [None, "event_type"])
def test_ordered_operators_do_not_depend_on_buckets(spark, folder, conf, buckets, partition_by):
    g = table(spark, folder, "gappy_events")
    e = table(spark, folder, "events").select("event_id", "event_type")
    g = g.join(e, "event_id").where("value IS NOT NULL OR event_id % 6 IN (2, 3)")
    operators = [
        lambda d: O.running_total(d, "value", "ts", partition_by),
        lambda d: O.fill_forward(d, "value", "ts", partition_by),
        lambda d: O.fill_backward(d, "value", "ts", partition_by),
        lambda d: O.rolling_stats(d, "value", 5, "ts", partition_by),
        lambda d: O.diff(d, "value", "ts", partition_by),
        lambda d: with_global_index(d, "ts", partition_by),
    ]
    conf(buckets=1)
    expected = [op(g).collect() for op in operators]
    conf(buckets=buckets)
    for op, rows in zip(operators, expected):
        got = op(g.repartition(5))
        same(got, spark.createDataFrame(rows, got.schema))


def test_buckets_follow_the_order_and_split_a_dominating_partition(spark, rows, conf):
    conf(buckets=8)
    data = [("big", i) for i in range(900)] + [(f"p{i % 10}", i) for i in range(100)]
    df = rows(data, "p string, i int")
    bounds = order_bounds(df, ["p", "i"])
    b = with_buckets(df, ["p", "i"], bounds)
    sizes = [r["n"] for r in b.groupBy("_bucket").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < 350
    ends = b.groupBy("_bucket").agg(F.min(F.struct("p", "i")).alias("a"), F.max(F.struct("p", "i")).alias("b")).orderBy("_bucket").collect()
    assert all(x["b"] < y["a"] for x, y in zip(ends, ends[1:]))


def test_ten_thousand_buckets(spark, conf):
    """More buckets than the driver holds bounds for: every bucket small, in order, and the results those of one bucket."""
    conf(buckets=10_000)
    df = spark.range(30_000).select((F.col("id") * 7919 % 30_000).alias("k"), (F.col("id") % 5).alias("v"))
    bounds = order_bounds(df, ["k"])
    assert bounds.coarse.num_rows < 1024 and bounds.fine is not None
    per = with_buckets(df, ["k"], bounds).groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi")).orderBy("_bucket").collect()
    assert len(per) > 8_000 and max(r["n"] for r in per) <= 40
    assert all(a["hi"] < b["lo"] for a, b in zip(per, per[1:]))
    assert with_global_index(df, "k").where("row_index <> k").count() == 0
    grouped = with_global_index(df.withColumn("g", F.col("k") % 3), "k", "g")
    assert grouped.where("row_index <> floor(k / 3)").count() == 0


def test_buckets_of_a_key_that_is_mostly_null(spark, conf):
    """Rows without the first key are spread by the second; one bucket more or less apart from the others' size."""
    conf(buckets=12)
    df = spark.range(6000).select(F.when(F.col("id") % 10 == 0, F.col("id")).alias("a"), F.col("id").alias("b"))
    sizes = [r["count"] for r in with_buckets(df, ["a", "b"], order_bounds(df, ["a", "b"])).groupBy("_bucket").count().collect()]
    assert len(sizes) == 12 and max(sizes) < 1500
    placed = with_global_index(df, ["a", "b"]).orderBy("row_index").collect()
    assert [r["row_index"] for r in placed] == list(range(6000))
    assert [(r["a"] is not None, r["a"], r["b"]) for r in placed] == sorted((r["a"] is not None, r["a"], r["b"]) for r in placed)


def test_fill_reaches_across_empty_buckets(spark, rows, conf):
    conf(buckets=10)
    data = [(0, 7.0)] + [(i, None) for i in range(1, 200)] + [(200, 9.0)]
    df = rows(data, "i int, v double")
    assert O.fill_forward(df, "v", "i").where("i < 200 AND v = 7").count() == 200
    assert O.fill_backward(df, "v", "i").where("i > 0 AND v = 9").count() == 200


def test_window_larger_than_table_gives_nulls(rows, conf):
    conf(buckets=3)
    out = O.rolling_stats(rows([(i, float(i)) for i in range(5)], "i int, v double"), "v", 6, "i")
    assert out.where("rolling_mean IS NOT NULL").count() == 0 and out.count() == 5


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_attach_with_hot_and_null_keys(spark, rows, conf, how):
    left = rows([("hot", i) for i in range(60)] + [(None, i) for i in range(20)] + [(f"k{i}", i) for i in range(20)], "k string, i int")
    right = rows([("hot", 1), (None, 2)] + [(f"k{i}", i) for i in range(0, 20, 2)], "k string, v int")
    expected = attach(left, right, ["k"], how=how).collect()
    conf(broadcast_rows=1, hot_share=0.1)
    got = attach(left, right, ["k"], how=how)
    same(got, spark.createDataFrame(expected, got.schema))
    assert "CartesianProduct" not in plan(got)


def test_duplicate_rows_with_a_dominating_group(rows, conf):
    conf(broadcast_rows=1, hot_share=0.2)
    data = [(1, "a", None)] * 50 + [(i, "b", 1.0) for i in range(20)] + [(7, "c", 2.0)] * 2
    assert duplicate_rows(rows(data, "k int, s string, v double")).count() == 52


def test_semi_join_filter_beyond_broadcast(rows, conf):
    conf(broadcast_rows=1)
    df = rows([(i % 7,) for i in range(70)], "k int")
    wanted = rows([(1,), (3,), (1,), (None,)], "k int")
    assert filter_in(df, "k", wanted).count() == 20


def test_kendall_by_high_bits(spark, folder, conf, monkeypatch):
    conf(buckets=5)
    p = table(spark, folder, "planted")
    whole = T.corr_pairs(p, ["x_noisy", "x_tied"], "kendall").first()["r"]
    monkeypatch.setattr(T, "_GROUP_BITS", 4)
    assert T.corr_pairs(p, ["x_noisy", "x_tied"], "kendall").first()["r"] == pytest.approx(whole, abs=1e-12)


@pytest.mark.parametrize(
    "make",
    [
        lambda e: O.running_total(e, "value", "ts"),
        lambda e: O.rolling_stats(e, "value", 7, "ts"),
        lambda e: O.fill_forward(e, "value", "ts"),
        lambda e: O.diff(e, "value", "ts"),
        lambda e: R.trend_fitted(e, "value", "ts"),
        lambda e: with_global_index(e, "ts"),
    ],
)
def test_no_single_task_window(spark, folder, conf, make):
    """Nothing but grouped subtotals (one row per bucket) may be brought to a single partition before a window."""
    conf(buckets=6)
    text = plan(make(table(spark, folder, "events")))
    main = text.split("Subquery")[0].splitlines()
    for i, line in enumerate(main):
        if "Exchange SinglePartition" in line:
            below = next(x for x in main[i + 1 :] if x.strip(" :+-*()0123456789"))
            assert "HashAggregate" in below or "SortAggregate" in below or "ObjectHashAggregate" in below, text


def test_top_values_are_limited_before_the_shuffle(spark, folder):
    assert "WindowGroupLimit" in plan(top_per_column(table(spark, folder, "part"), ["p_brand", "p_name"], 5))


def test_filters_and_columns_reach_the_scan(spark, folder):
    from sondage.operators.relational import filter_equal, group_agg

    text = plan(group_agg(filter_equal(table(spark, folder, "lineitem"), "l_returnflag", "R"), "l_linestatus", "l_quantity", "sum"))
    assert "EqualTo(l_returnflag,R)" in text and "l_extendedprice" not in text


def test_summary_has_no_join_without_keys(spark, folder):
    text = plan(numeric_summary(table(spark, folder, "orders"), ["o_totalprice"]))
    assert "NestedLoop" not in text and "CartesianProduct" not in text


def test_sample_prefilter_keeps_the_same_rows(spark, folder, monkeypatch):
    from sondage.operators import relational as R

    o = table(spark, folder, "orders")
    small = sorted(r["o_orderkey"] for r in R.sample_n(o, 20, "o_orderkey").collect())
    monkeypatch.setattr(R, "_SAMPLE_PREFILTER", 10**9)
    assert sorted(r["o_orderkey"] for r in R.sample_n(o, 20, "o_orderkey").collect()) == small


def test_places_of_equal_values_are_dealt_out_and_none_is_sorted(spark):
    from statistics import NormalDist

    import numpy as np

    from sondage.operators import stats as S

    values = [1.0] * 300_000 + [2.0] * 200 + [3.0, 4.0, 5.0]
    df = spark.range(len(values)).selectExpr("CASE WHEN id < 300000 THEN 1D WHEN id < 300200 THEN 2D ELSE 3D + (id - 300200) END AS x")
    tallied = S._tallied(S._cells(df, ["x"]))
    assert tallied.count() == 5  # the ordered pass sees each value once
    placed = S._places(tallied, len(values))
    assert placed.agg(F.count("i"), F.countDistinct("i"), F.min("i"), F.max("i")).first()[:] == (300_203, 300_203, 0, 300_202)
    assert max(placed.rdd.glom().map(len).collect()) <= 3 * (1 << 16)  # of the one value no task has all
    n, x = len(values), np.sort(values)
    m = np.array([NormalDist().inv_cdf((i + 0.625) / (n + 0.25)) for i in range(n)])
    u, mm = 1 / np.sqrt(n), (m * m).sum()
    last, nxt = S._poly(S._ROYSTON_LAST, u) + m[-1] / np.sqrt(mm), S._poly(S._ROYSTON_NEXT, u) + m[-2] / np.sqrt(mm)
    a = m / np.sqrt((mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * nxt**2))
    a[[0, 1, -2, -1]] = -last, -nxt, nxt, last
    w = (a * (x - x.mean())).sum() ** 2 / ((x - x.mean()) ** 2).sum()
    assert S.shapiro_wilk(df, "x").first()["w"] == pytest.approx(w, rel=1e-6)


@pytest.mark.parametrize("margin", [0.005, 0.0])
def test_sliced_quantiles_are_exact(spark, monkeypatch, margin):
    """Order statistics of large tables come out of slices; where a sample misses one, out of the whole column."""
    from sondage.plans import values

    df = spark.range(40_000).selectExpr(
        "IF(id % 5 > 0, pow(id * 7919 % 40000, 1.7), NULL) AS skewed", "id % 3 AS tied", "7 AS same", "CAST(NULL AS DOUBLE) AS none", "IF(id % 4 = 0, double('nan'), -1.0 * id) AS holes",
        "CASE WHEN id < 300 THEN double('-inf') WHEN id > 39800 THEN double('inf') ELSE id * 0.5 END AS wide",
    )
    qs, cols = [0.5, 0.05, 0.0, 0.25, 0.999, 1.0], df.columns
    whole = {r["column"]: r for r in df.sparkSession.createDataFrame(values.quantiles_long(df, cols, qs).toArrow()).collect()}
    monkeypatch.setattr(values, "use_sketch", lambda d: False)
    monkeypatch.setattr(values, "_SAMPLED", 2_000)
    monkeypatch.setattr(values, "_MARGIN", margin)
    placed, old = [], values.global_prefix
    monkeypatch.setattr(values, "global_prefix", lambda d, *a, **k: placed.append(d.agg({"n": "sum"}).first()[0]) or old(d, *a, **k))
    got = values.quantiles_long(df, cols, qs)
    assert got.columns == ["column", "position", *[values.q_name(q) for q in qs]]
    for r in got.collect():
        for q in map(values.q_name, qs):
            a, b = r[q], whole[r["column"]][q]
            assert a == b or (a is not None and abs(a - b) < 1e-9 * max(1.0, abs(b)))
    assert len(placed) == 1 and placed[0] < 200_000


def test_few_values_are_placed_for_a_quantile(spark, monkeypatch):
    from sondage.plans import values

    df = spark.range(50_000).selectExpr("id * 7919 % 50000 + 0.5 AS x")
    monkeypatch.setattr(values, "use_sketch", lambda d: False)
    held, old = [], values.global_prefix
    monkeypatch.setattr(values, "global_prefix", lambda d, *a, **k: held.append(d.count()) or old(d, *a, **k))
    assert values.quantiles_long(df, ["x"], [0.5, 0.25]).first()["q0_25"] == 12_500.25
    assert held[0] < 2_500


def test_issues_count_different_values_of_texts_only(rows, monkeypatch):
    from sondage.operators import quality, tablefacts

    df = rows([(i, i * 0.5, f"t{i}", f"g{i % 3}") for i in range(60)], "k int, x double, t string, g string")
    asked, stats, distinct = [], tablefacts.distinct_stats, tablefacts.nunique_table
    monkeypatch.setattr(tablefacts, "distinct_stats", lambda d, c: asked.append(list(c)) or stats(d, c))
    monkeypatch.setattr(tablefacts, "nunique_table", lambda d, c: asked.append(list(c)) or distinct(d, c))
    found = quality.detect_issues(df).collect()
    assert [(r["issue"], r["column"], r["count"]) for r in found] == [("high cardinality", "t", 60)]
    assert asked == [["g"], ["t"]]


def test_report_measures_once(spark, folder, monkeypatch):
    """Sections are those of the operators alone, but quantiles, repeats and different values are measured once for all of them."""
    from sondage.operators import facts, profile, quality, stats, tablefacts
    from sondage.plans import values

    d = table(spark, folder, "dirty_orders")
    plain = lambda t: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in t.collect())
    alone = {"summary": profile.dataset_summary(d), "cleaning": quality.cleaning_recommendations(d), "importance": stats.important_columns(d), "health": quality.health_scores(d)}
    alone = {name: plain(t) for name, t in alone.items()}
    asked = {"quantiles": [], "distinct": [], "repeats": 0}
    quantiles, digests, repeats = values.quantiles_long, profile.digest_counts_long, profile.duplicate_count

    def repeated(df):
        asked["repeats"] += 1
        return repeats(df)

    monkeypatch.setattr(values, "quantiles_long", lambda df, cols, *a: asked["quantiles"].extend(cols) or quantiles(df, cols, *a))
    monkeypatch.setattr(profile, "digest_counts_long", lambda df, cols: asked["distinct"].extend(cols) or digests(df, cols))
    monkeypatch.setattr(profile, "duplicate_count", repeated)
    monkeypatch.setattr(tablefacts, "duplicate_count", repeated)
    report = facts.report_tables(d)
    assert {name: plain(report[name]) for name in alone} == alone
    assert sorted(asked["quantiles"]) == sorted(profile.numeric_columns(d))
    assert sorted(asked["distinct"]) == sorted(d.columns) and asked["repeats"] == 1
