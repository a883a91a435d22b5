"""Edge tables, properties and contracts of the operators."""

import math

import pytest
from pyspark.sql import functions as F

from catalog.base import table
from sondage.operators import chartdata as C
from sondage.operators import facts as I
from sondage.operators import ml as M
from sondage.operators import ordered as O
from sondage.operators import profile as P
from sondage.operators import quality as Q
from sondage.operators import relational as R
from sondage.operators import stats as T
from sondage.operators import timeseries as S
from sondage.operators.types import column_types, logical_types, semantic_types
from sondage.sources.tables import export_bundle, read_table, table_fingerprint, write_csv, write_json
from sondage.sources.versions import VersionedTable


# ------------------------------------------------------------------ types


def test_logical_type_boundaries(rows):
    data = [(i % 10, i % 11, (i % 9) / 2, None, f"v{i % 19}", f"v{i % 20}", i % 2 == 0) for i in range(200)]
    got = logical_types(rows(data, "ten int, eleven int, halves double, empty double, words19 string, words20 string, flag boolean"))
    assert got == {
        "ten": "categorical", "eleven": "numeric", "halves": "numeric", "empty": "categorical",
        "words19": "categorical", "words20": "text", "flag": "boolean",
    }


def test_type_levels_are_exact_or_many(rows):
    got = {r["column"]: r["nunique"] for r in column_types(rows([(i % 7, i) for i in range(100)], "few int, many int")).collect()}
    assert got == {"few": 7, "many": None}


def test_semantic_types_of_empty_and_few(rows):
    got = {r["column"]: r["semantic_type"] for r in semantic_types(rows([(None, "a"), (None, "b")], "gone string, few string")).collect()}
    assert got == {"gone": "Empty", "few": "Categorical / Ordinal"}


# ------------------------------------------------------------------ edge tables


def test_empty_table(spark):
    df = spark.createDataFrame([], "k int, v double, s string")
    assert P.numeric_summary(df, ["v"]).count() == 0
    assert P.duplicate_count(df).first().asDict() == {"rows": 0, "duplicates": 0}
    assert P.missing_table(df).where("missing_pct <> 0").count() == 0
    assert P.dataset_summary(df).first()["quality"] == "excellent"
    assert O.running_total(df, "v", "k").count() == 0
    assert O.rolling_stats(df, "v", 3, "k").count() == 0
    assert C.histogram(df, "v", 5).count() == 0
    assert C.box_stats(df, "v").count() == 0
    assert S.resample(df.select("v", F.lit(None).cast("timestamp").alias("t")), "t", "v", "D").count() == 0
    assert logical_types(df) == {"k": "categorical", "v": "categorical", "s": "categorical"}


def test_one_row_and_constant_columns(rows):
    df = rows([(1, 5.0, "a")], "k int, v double, s string")
    r = P.numeric_summary(df, ["v"]).first()
    assert r["mean"] == 5.0 and r["std"] is None and r["skewness"] is None and r["outliers"] == 0
    constant = rows([(i, 3.5) for i in range(20)], "k int, v double")
    r = P.numeric_summary(constant, ["v"]).first()
    assert r["std"] == 0.0 and r["skewness"] is None and r["outliers"] == 0 and r["mode"] == 3.5
    h = C.histogram(constant, "v", 4).collect()
    assert sum(x["count"] for x in h) == 20
    assert T.eta_squared(df, "s", "v").first()["eta_squared"] == 0.0


def test_nan_and_infinity(rows):
    df = rows([(1, float("nan")), (2, 1.0), (3, 3.0)], "k int, v double")
    r = P.numeric_summary(df, ["v"]).first()
    assert (r["count"], r["missing"], r["mean"]) == (2, 1, 2.0)
    inf = rows([(1, float("inf")), (2, 1.0)], "k int, v double")
    assert P.extreme_values(inf, {"v": "numeric"}).where("kind = 'max'").first()["value"] == math.inf


def test_derived_columns_guard_zero_and_negative(rows):
    df = rows([(1, 4.0, 0.0), (2, -4.0, 2.0), (3, None, 1.0)], "k int, a double, b double")
    out = R.derive(R.derive(R.derive(df, "q", "/", "a", "b"), "l", "log", "a"), "s", "sqrt", "a").orderBy("k").collect()
    assert [r["q"] for r in out] == [None, -2.0, None]
    assert out[0]["l"] == pytest.approx(math.log(4)) and out[1]["l"] is None
    assert [r["s"] for r in out] == [2.0, 0.0, None]


def test_integer_conversion_refuses_fractions(rows):
    df = rows([(1.5,), (2.0,)], "v double")
    with pytest.raises(ValueError):
        R.convert(df, "v", "integer")
    assert R.convert(df.where("v = 2.0"), "v", "integer").first()["v"] == 2


def test_dates_in_text(rows):
    text = "Due 2024-02-30 or 29/2/2024; 1 SEPT 2020, 12 Sep 2021, May 3 2019, July 4, 2018, 99/99/2020, 3 March"
    got = {str(r["date"]) for r in R.extract_dates(rows([(1, text), (2, "none"), (3, None)], "k int, t string"), "k", "t").collect()}
    assert got == {"2024-02-29", "2021-09-12", "2019-05-03", "2018-07-04"}


def test_growth_on_zero_base_and_labels(rows):
    df = rows([(1, 0.0), (2, 5.0), (3, 10.0), (4, None), (5, 20.0)], "k int, v double")
    got = [r["growth_pct"] for r in O.growth_rate(df, "v", "k").orderBy("k").collect()]
    assert got == [None, None, 100.0, 100.0]
    assert O.growth_summary(df, "v", "k").first()["pattern"] == "Consistently growing"


def test_rank_of_ties_and_nulls(rows):
    df = rows([(1, 5.0), (2, 5.0), (3, 9.0), (4, None), (5, 1.0)], "k int, v double")
    assert {r["k"]: r["rank"] for r in O.rank_by(df, "v").collect()} == {3: 1, 1: 2, 2: 2, 5: 4, 4: None}


def test_resample_keeps_empty_periods(rows):
    df = rows([("2024-01-15", 1.0), ("2024-04-02", 3.0)], "d string, v double").withColumn("d", F.to_timestamp("d"))
    got = [(str(r["period"]), r["mean"]) for r in S.resample(df, "d", "v", "ME").orderBy("period").collect()]
    assert got == [("2024-01-31", 1.0), ("2024-02-29", None), ("2024-03-31", None), ("2024-04-30", 3.0)]
    week = S.resample(df, "d", "v", "W").orderBy("period").first()
    assert str(week["period"]) == "2024-01-21"


def test_trend_of_a_line(rows):
    r = S.trend(rows([(i, 2.0 * i + 1) for i in range(50)], "k int, v double"), "v", "k").first()
    assert (r["slope"], r["intercept"]) == (pytest.approx(2.0), pytest.approx(1.0))
    assert r["r2"] == pytest.approx(1.0) and r["direction"] == "Increasing" and r["strength"] == "strong" and r["p_value"] < 1e-6


# ------------------------------------------------------------------ properties


def test_removed_and_kept_are_all_rows(spark, folder):
    d = table(spark, folder, "dirty_orders")
    for method in ("iqr", "zscore"):
        kept = Q.treat_outliers(d, "totalprice", method, "remove").count()
        assert kept + Q.outlier_summary(d, "totalprice", method).first()["outliers"] == d.count()


def test_auto_clean_is_complete_and_stable(spark, folder):
    cleaned, _ = Q.auto_clean(table(spark, folder, "dirty_orders"))
    assert "sparse_col" not in cleaned.columns
    assert P.missing_table(cleaned).where("missing > 0").count() == 0
    again, log = Q.auto_clean(cleaned)
    assert [r["action"] for r in log.collect()] == ["already clean"] and again.count() == cleaned.count()


def test_results_ignore_partitioning(spark, folder):
    d = table(spark, folder, "dirty_orders")
    for make in (
        lambda x: P.numeric_summary(x).drop("variance"), P.column_profile, P.data_dictionary, Q.cleaning_recommendations,
        lambda x: R.frequency_table(x, "orderstatus"), lambda x: R.sample_n(x.distinct(), 50, "orderkey"),
    ):
        cols = None
        results = []
        for parts in (1, 7):
            out = make(d.repartition(parts))
            cols = cols or sorted(out.columns)
            results.append(sorted(tuple(repr(round(v, 6)) if isinstance(v, float) else repr(v) for v in (r[c] for c in cols)) for r in out.collect()))
        assert results[0] == results[1]


def test_fingerprint_sees_content_not_order(spark, folder):
    o = table(spark, folder, "orders")
    a, b = table_fingerprint(o).first(), table_fingerprint(o.repartition(9).orderBy("o_custkey")).first()
    assert a == b
    assert table_fingerprint(o.union(o)).first() != a
    changed = o.withColumn("o_custkey", F.when(F.col("o_orderkey") == 3, -1).otherwise(F.col("o_custkey")))
    assert table_fingerprint(changed).first() != a


def test_versions_round_trip(spark, folder, tmp_path):
    o = table(spark, folder, "orders")
    v = VersionedTable(spark, str(tmp_path / "t"))
    assert v.log().count() == 0
    assert v.commit(o) == 1
    assert v.commit(o.limit(10), "Head", "first rows") == 2
    assert v.restore(1).count() == o.count()
    assert table_fingerprint(v.load()).first() == table_fingerprint(o).first()
    assert [r["name"] for r in v.log().orderBy("version").collect()] == ["Original Dataset", "Head", "Restored V1"]


def test_files_round_trip(spark, rows, tmp_path):
    df = rows([(1, 1.5, "a,b"), (2, None, 'say "x"')], "k int, v double, s string")
    write_csv(df, str(tmp_path / "c"))
    write_json(df, str(tmp_path / "j"))
    for fmt, path in (("csv", "c"), ("json", "j")):
        back = read_table(spark, str(tmp_path / path), fmt, schema=df.schema)
        assert sorted(back.collect()) == sorted(df.collect()) if fmt == "json" else back.count() == 2
    assert set(export_bundle(df, str(tmp_path / "b"))) >= {"dataset_csv", "dataset_json", "insights_csv"}


def test_density_integrates_to_one(spark, folder):
    pts = C.kde(table(spark, folder, "lineitem"), "l_extendedprice", grid=200).orderBy("x").collect()
    area = sum((b["x"] - a["x"]) * (a["density"] + b["density"]) / 2 for a, b in zip(pts, pts[1:]))
    assert area == pytest.approx(1.0, abs=0.06)


def test_frequency_shares_add_up(spark, folder):
    t = R.frequency_table(table(spark, folder, "part"), "p_brand")
    assert t.agg(F.sum("percentage").alias("s")).first()["s"] == pytest.approx(100, abs=0.2)


def test_dqi_counts_bad_text(rows):
    df = rows([("2024-01-01", "yes"), ("soon", "maybe"), ("2024-03-01", "no"), (None, "y")], "d string, b string")
    r = Q.dqi(df, {"d": "date", "b": "boolean"}).first()
    assert r["type_validity"] == 75.0 and r["completeness"] == 87.5


# ------------------------------------------------------------------ models


def test_default_regression_learns_a_planted_relation(spark, folder):
    p = table(spark, folder, "planted").select("event_id", "x", "x_linear", "event_type")
    model = M.fit_default(p, "x_linear", key="event_id")
    assert model.problem == "Regression" and model.metrics["r2"] > 0.7
    assert M.fit_default(p, "x_linear", key="event_id").metrics == model.metrics
    scored = M.predict_table(model, p.select("event_id"))
    assert scored.columns == ["event_id", "Predicted_x_linear"]
    assert scored.select("Predicted_x_linear").distinct().count() == 1


def test_default_classification_learns_labels(spark, folder):
    p = table(spark, folder, "planted").select("event_id", "x", F.when(F.col("x") > 40, "high").otherwise("low").alias("label"))
    model = M.fit_default(p, "label", key="event_id", trees=5)
    assert model.metrics["accuracy"] > 0.95
    assert {r[0] for r in M.predict_table(model, p.drop("label")).select("Predicted_label").distinct().collect()} == {"high", "low"}


def test_clusters_are_found(rows):
    data = [(float(c * 50 + i % 5), float(c * -20 + i % 3)) for c in range(3) for i in range(40)]
    t = M.cluster_profile(M.kmeans(rows(data, "a double, b double"), ["a", "b"], 3, restarts=2), ["a", "b"]).collect()
    assert sorted(r["size"] for r in t) == [40, 40, 40]


def test_isolation_flags_planted_anomalies(spark):
    df = spark.range(1000).select("id", F.randn(1).alias("a"), F.randn(2).alias("b"))
    df = df.withColumn("a", F.when(F.col("id") < 5, 40.0 + F.col("id")).otherwise(F.col("a")))
    out = M.isolation_forest(df, ["a", "b"], "id")
    assert out.where("id < 5 AND is_anomaly").count() == 5
    assert out.where("is_anomaly").count() <= 11
    planted = df.withColumn("is_anomaly", F.col("id") < 5)
    assert M.anomaly_drivers(planted, ["a", "b"], trees=20).first()["column"] == "a"


def test_scenarios_follow_the_model(spark, folder):
    p = table(spark, folder, "planted")
    scenarios = spark.createDataFrame([(10.0,), (100.0,)], "x double")
    out = M.score_scenarios(p, "x_linear", scenarios, drivers=["x"]).orderBy("x").collect()
    assert [r["prediction"] for r in out] == [pytest.approx(25.0, abs=0.5), pytest.approx(205.0, abs=0.5)]
    assert out[0]["ci_low"] < out[0]["prediction"] < out[0]["ci_high"]
    assert M.score_scenarios(p, "x_linear", drivers=["x"]).first()["delta"] == pytest.approx(0.0)


# ------------------------------------------------------------------ facts


def test_chart_candidates_contract(spark, folder):
    t = I.chart_candidates(table(spark, folder, "planted")).orderBy("rank").collect()
    assert [r["rank"] for r in t] == list(range(1, len(t) + 1))
    assert [r["priority"] for r in t] == sorted((r["priority"] for r in t), reverse=True)
    assert len({(r["chart"], r["x"], r["y"]) for r in t}) == len(t)
    assert t[0]["chart"] == "Scatter Plot" and t[0]["priority"] == pytest.approx(10.0)


def test_report_sections_in_order(spark, folder):
    t = I.report_tables(table(spark, folder, "orders"), ["health", "summary", "executive"])
    assert list(t) == ["summary", "health", "executive"]
    assert all(part.count() for part in t.values())


def test_row_facts_flag_extremes(rows):
    df = rows([(i, 0.0 if i else 100.0, "a" if i % 4 else None) for i in range(30)], "k int, v double, s string")
    got = {(r["row_key"], r["column"]): r for r in I.row_insight(df, "k", [0, 5], {"k": "numeric", "v": "numeric", "s": "categorical"}).collect()}
    assert got[0, "v"]["flag"] == "HIGH" and got[5, "v"]["flag"] == "normal" and got[0, "s"]["flag"] == "missing"
    compared = {r["column"]: r for r in I.row_comparison(df, "k", [4, 8], {"k": "numeric", "v": "numeric", "s": "categorical"}).collect()}
    assert compared["v"]["verdict"] == "consistent" and compared["k"]["delta"] == 4.0


def test_boosting_of_ten_classes(rows):
    """Ten bands of one column with gaps, and a class that is rare; every prediction is a known class and chances sum to one."""
    data = [(i, float(i % 30) if i % 13 else None, f"band {i % 30 // 3}") for i in range(900)] + [(2000 + i, 29.5, "rare, 'quoted'") for i in range(40)]
    df = rows(data, "id int, x double, band string")
    model = M.fit_default(df.where("x is not null"), "band", key="id", features=["x"], trees=3)
    out = M.predict_table(model, df.drop("band"), probabilities=True).collect()
    truth, known = {r[0]: r[2] for r in data}, {r[2] for r in data}
    assert len(out) == len(data) and all(r["Predicted_band"] == truth[r["id"]] for r in out if r["x"] is not None)
    assert all(set(r["Probabilities_band"]) == known and abs(sum(r["Probabilities_band"].values()) - 1) < 1e-9 for r in out)
