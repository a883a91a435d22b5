"""Feature vectors by distributed dictionaries, and profiles merged from parts."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from catalog.base import table
from sondage.operators import features, ml, profile, relational, sketches
from sondage.plans.values import digest_counts_long


def vectors(df, model, key="k"):
    out = model.transform(df)
    assert out.columns == [*df.columns, ml.FEATURES]
    return {r[0]: r[1] for r in out.select(key, vector_to_array(ml.FEATURES)).collect()}


def test_medians_scores_and_codes(rows):
    df = rows([(1, 1.0, "a"), (2, 3.0, "a"), (3, None, "b"), (4, 9.0, None), (5, 5.0, "c"), (6, float("nan"), "b")], "k int, x double, t string")
    model = ml.build_features(df, ["x", "t"]).fit(df)
    filled = np.array([1, 3, 4, 9, 5, 4.0])  # median of 1 3 5 9
    z = (filled - filled.mean()) / filled.std(ddof=1)
    hot = {"a": [1, 0, 0], "b": [0, 1, 0], "c": [0, 0, 1]}
    got = vectors(df, model)
    for k, t in zip(range(1, 7), ["a", "a", "b", "a", "c", "b"]):
        assert np.allclose(got[k], [z[k - 1], *hot[t]])
    new = rows([(1, 4.0, "never met"), (2, None, None)], "k int, x double, t string")
    assert vectors(new, model)[1][1:] == [0, 0, 0] and vectors(new, model)[2][1:] == [1, 0, 0]


def test_rare_categories_become_one(rows):
    df = rows([(i, t) for i, t in enumerate("aaaabbbccdef")], "k int, t string")
    got = vectors(df, ml.build_features(df, ["t"], category_cap=2).fit(df))
    assert got[0] == [1, 0, 0] and got[4] == [0, 1, 0] and got[7] == got[11] == [0, 0, 1]
    named = rows([(i, t) for i, t in enumerate(["Other", "Other", "a", "b"])], "k int, t string")
    assert vectors(named, ml.build_features(named, ["t"], category_cap=1).fit(named)) == dict.fromkeys(range(4), [1.0])
    few = vectors(df, ml.build_features(df, ["t"], category_cap=6).fit(df))
    assert len(few[0]) == 6


def test_columns_without_values_or_spread(rows):
    df = rows([(1, None, None, 7.0, "x"), (2, None, None, 7.0, "x")], "k int, x double, t string, c double, u string")
    assert vectors(df, ml.build_features(df, ["x", "t", "c", "u"]).fit(df)) == {1: [0, 0, 1], 2: [0, 0, 1]}
    model = ml.build_features(df, ["x", "c"]).fit(df)
    assert model.transform(df.limit(0)).count() == 0


@pytest.mark.parametrize("bytes_", [32_000_000, 1_000])
def test_many_categories_are_numbered_without_gathering(spark, conf, bytes_):
    conf(buckets=7, broadcast_bytes=bytes_)
    n = 20_000
    df = spark.range(n).selectExpr("id AS k", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('c', id) END AS t")
    found = features.dictionary(df, ["t"])
    size = found.count()
    assert size == n - (n + 2) // 3 + 1 and found.where("number = 0").first()["value"] == "hot"
    assert found.agg(F.count_distinct("number"), F.max("number")).first()[:] == (size, size - 1)
    model = ml.build_features(df, ["t"]).fit(df)
    assert not next(iter(model.stages[0].codes.values())).local and model.stages[0].width == size
    sums = model.transform(df).select("k", F.aggregate(vector_to_array(ml.FEATURES), F.lit(0.0), lambda a, x: a + x).alias("s")).where("k < 300")
    assert sums.count() == 300 and sums.where("s = 1").count() == 300


def test_digests_count_like_values(spark, folder):
    docs = table(spark, folder, "documents")
    exact = docs.agg(*[F.count_distinct(c).alias(c) for c in docs.columns]).first().asDict()
    assert {r["column"]: r["nunique"] for r in profile.nunique_table(docs).collect()} == exact
    plan = digest_counts_long(docs, ["text", "n_chars"])._jdf.queryExecution().executedPlan().toString()
    shuffled = [line for line in plan.splitlines() if "hashpartitioning" in line]
    assert shuffled and all("text" not in line.split("hashpartitioning")[1].split(")")[0] for line in shuffled)


def test_digests_of_gaps_zeros_and_no_columns(rows):
    df = rows([(0.0, "a"), (-0.0, None), (float("nan"), "a"), (None, "")], "x double, t string")
    assert {r["column"]: r["nunique"] for r in profile.nunique_table(df).collect()} == {"x": 1, "t": 2}
    assert digest_counts_long(df, []).count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_merged_state_is_that_of_one_pass(spark, parts):
    df = spark.range(30_000).selectExpr("id", "CASE WHEN id % 10 > 0 THEN 1e6 + pow(rand(3), 3) * 1000 END AS x", "concat('v', id % 700) AS t", "CAST(NULL AS DOUBLE) AS none")
    df = df.cache()
    states = None
    for p in range(parts):
        one = sketches.profile_state(df.where(F.col("id") % parts == p))
        states = one if states is None else states.unionByName(one)
    states = states.unionByName(sketches.profile_state(df.limit(0)))
    got = {r["column"]: r for r in sketches.state_profile(sketches.merge_states(states), [0.1, 0.5, 0.99]).collect()}
    true = df.agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    x = got["x"]
    assert list(got) == df.columns and (x["rows"], x["missing"]) == (30_000, 3_000)
    assert np.allclose([x["mean"], x["std"], x["min"], x["max"]], [true["m"], true["s"], true["lo"], true["hi"]], rtol=1e-9)
    for q, name in ((0.1, "q0_1"), (0.5, "q0_5"), (0.99, "q0_99")):
        assert abs(df.where(F.col("x") <= x[name]).count() / 27_000 - q) < 0.02
    assert abs(x["nunique"] / 27_000 - 1) < 0.03 and abs(got["t"]["nunique"] / 700 - 1) < 0.03 and got["t"]["mean"] is None
    assert got["none"]["missing"] == 30_000 and got["none"]["nunique"] == 0 and got["none"]["q0_5"] is None


def test_group_tables_cover_every_pair(rows):
    df = rows([("a", 1, 2.0, 5), ("a", 2, None, 6), ("b", 2, 4.0, None), (None, 1, 8.0, 7)], "s string, g int, x double, y int")
    got = {(r["category"], r["level"], r["column"]): tuple(r)[3:] for r in relational.group_tables(df, ["s", "g"], ["x", "y"]).collect()}
    assert len(got) == 8 and got["s", "a", "x"] == (1, 2.0, 2.0) and got["g", "1", "x"] == (2, 5.0, 10.0) and got["s", "b", "y"] == (0, None, 0.0)
    assert relational.group_tables(df, [], ["x"]).count() == 0


def test_boosting_fits_merged_rows(spark):
    """The chains read weighted bins, as many as there are different ones; rare codes and near cuts are told apart."""
    rows = spark.range(60_000).selectExpr("id", "(id * 7919) % 60000 / 600.0 AS value", "IF(id % 400 = 7, 'rare', 'usual') AS kind")
    rows = rows.selectExpr("id", "value", "kind", "CASE WHEN kind = 'rare' THEN 'odd' WHEN value < 30 THEN 'low' WHEN value < 33 THEN 'thin' ELSE 'top' END AS band")
    model = ml.fit_default(rows, "band", key="id", trees=5)
    merged = model.pipeline.stages[-1]
    assert isinstance(merged, ml.BinnedModel) and all(len(c) <= ml.BINS for c in merged.binned.cuts)
    out = ml.predict_table(model, rows, probabilities=True)
    assert out.columns == ["id", "value", "kind", "band", "Predicted_band", "Probabilities_band"]
    right = {r[0]: r[1] for r in out.groupBy("band").agg(F.avg((F.col("band") == F.col("Predicted_band")).cast("int"))).collect()}
    assert min(right.values()) > 0.9 and right["odd"] == 1.0


def test_regression_trees_fit_merged_rows(spark, monkeypatch):
    """Boosting on merged rows is that of all rows; a forest draws every row for every tree; rows that hardly repeat stay as they are."""
    monkeypatch.setattr(ml, "MERGED_ROWS", 10_000)
    rows = spark.range(20_000).selectExpr("id", "id % 12 AS x", "IF(id % 400 = 7, 'rare', 'usual') AS kind", "(id % 12) * (id % 12) + IF(id % 400 = 7, 90, 0) + (id * 7919) % 101 / 10.0 AS y")
    ready = ml.build_features(rows, ["x", "kind"]).fit(rows).transform(rows).withColumn(ml.LABEL, F.col("y").cast("double"))
    ready = ready.coalesce(2).select("id", ml.LABEL, ml.FEATURES).cache()
    set_up = lambda e: e.setLabelCol(ml.LABEL).setFeaturesCol(ml.FEATURES).setPredictionCol(ml.PREDICTION)
    predicted = lambda m: [r[0] for r in m.transform(ready).orderBy("id").select(ml.PREDICTION).limit(2_000).collect()]
    merged = ml.MergedRegression(set_up(ml.GBTRegressor(maxIter=5, seed=1))).fit(ready)
    assert isinstance(merged, ml.BinnedModel)
    assert np.allclose(predicted(merged), predicted(set_up(ml.GBTRegressor(maxIter=5, seed=1)).fit(ready)), rtol=1e-9)
    metrics, plain = ml._merged_metrics(merged, ready), ml._metrics(merged.transform(ready), ml.REGRESSION)
    assert all(abs(metrics[k] - plain[k]) < 1e-9 for k in plain)

    forest = ml.MergedRegression(set_up(ml.RandomForestRegressor(numTrees=12, maxDepth=8, featureSubsetStrategy="all", seed=1))).fit(ready)
    assert isinstance(forest, ml.BinnedModel) and len(forest.model.trees) == 12
    whole = ml._metrics(set_up(ml.RandomForestRegressor(numTrees=12, maxDepth=8, featureSubsetStrategy="all", seed=1)).fit(ready).transform(ready), ml.REGRESSION)
    assert abs(ml._merged_metrics(forest, ready)["r2"] - whole["r2"]) < 0.01

    few = ml.MergedRegression(set_up(ml.GBTRegressor(maxIter=1, seed=1))).fit(ready.limit(9_000))
    assert not isinstance(few, ml.BinnedModel)
    own = ready.withColumn(ml.FEATURES, ml.array_to_vector(F.array(*[F.rand(i) for i in range(6)])))
    assert not isinstance(ml.MergedRegression(set_up(ml.GBTRegressor(maxIter=1, seed=1))).fit(own), ml.BinnedModel)


def test_draws_of_a_forest_are_of_single_rows(spark):
    placed = spark.range(40_000).selectExpr("id % 4 AS _cell", "CAST(id % 4 * 10 + (id * 7919) % 1009 / 1009.0 AS DOUBLE) AS y").withColumnRenamed("y", ml.LABEL)
    got = ml._draws(placed, 4, 50, seed=3).toPandas()
    assert len(got) == 200 and len(set(got["_rows"])) > 60
    assert abs(got["_rows"].mean() - 10_000) < 40 and 70 < got["_rows"].std() < 135  # Poisson sums: a deviation of 100
    spread = (got[ml.LABEL] - got["_cell"] * 10).std()
    assert 0.0015 < spread < 0.006  # the deviation of a row, 0.29, over the root of 10,000 drawn ones
