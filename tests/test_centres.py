"""k-means whose restarts share their passes."""

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from sondage.operators import centres, ml
from sondage.session import materialize


def _cost(x, found):
    return float(((x[:, None, :] - found[None]) ** 2).sum(axis=2).min(axis=1).sum())


def test_cost_is_no_worse_than_that_of_separate_runs(spark):
    rng = np.random.default_rng(5)
    middles = rng.normal(scale=6, size=(7, 3))
    x = np.vstack([m + rng.normal(size=(n, 3)) for m, n in zip(middles, (900, 500, 300, 200, 60, 30, 10))])
    points = materialize(spark.createDataFrame(x.tolist(), "a double, b double, c double").repartition(5))
    vectors = VectorAssembler(inputCols=points.columns, outputCol="features").transform(points)
    apart = min(KMeans(k=7, seed=s).fit(vectors).summary.trainingCost for s in range(5))
    blocks = centres.packed(points)
    found = centres.best_centres(blocks, 3, 7, 42, 5)
    assert found.shape == (7, 3) and _cost(x, found) <= apart * 1.01
    assert np.array_equal(found, found[np.lexsort(found.T[::-1])])
    ((load, sums, cost),) = centres._sums(blocks, 3, [found])
    near = ((x[:, None, :] - found[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert load.tolist() == np.bincount(near, minlength=7).tolist() and np.isclose(cost, _cost(x, found))
    assert np.allclose(sums, [x[near == c].sum(axis=0) for c in range(7)])


def test_passes_do_not_grow_with_restarts(spark, monkeypatch):
    points = materialize(spark.range(3000).selectExpr("rand(3) AS a", "rand(4) AS b"))
    calls = []
    real = centres._sums
    monkeypatch.setattr(centres, "_sums", lambda p, w, sets: calls.append(len(sets)) or real(p, w, sets))
    centres.best_centres(centres.packed(points), 2, 4, 1, 10, rounds=6)
    assert len(calls) <= 8 and calls[0] == 10


def test_few_rows_gaps_and_constant_columns(spark, rows):
    same = ml.kmeans(rows([(1.0, 5.0)] * 4, "a double, b double"), ["a", "b"], 3)
    assert {r["cluster"] for r in same.collect()} == {"Cluster 0"} and same.columns == ["a", "b", "cluster"]
    two = ml.kmeans(rows([(1.0, 5.0, "x"), (2.0, 5.0, "y"), (None, 5.0, "z"), (1.0, 5.0, "w")], "a double, b double, t string"), ["a", "b"], 3)
    assert sorted((r["t"], r["cluster"]) for r in two.collect()) == [("w", "Cluster 0"), ("x", "Cluster 0"), ("y", "Cluster 1")]
    none = ml.kmeans(rows([], "a double, b double"), ["a", "b"], 3)
    assert none.count() == 0 and none.columns == ["a", "b", "cluster"]


def test_every_row_is_in_its_nearest_cluster(spark, folder):
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    items = spark.read.parquet(f"{folder}/lineitem.parquet")
    out = ml.kmeans(items, cols, 4, restarts=3)
    assert out.count() == items.count()
    pdf = out.select(*cols, "cluster").toPandas()
    z = (pdf[cols] - pdf[cols].mean()) / pdf[cols].std(ddof=0)
    means = z.groupby(pdf["cluster"]).mean()
    away = ((z.to_numpy()[:, None, :] - means.to_numpy()[None]) ** 2).sum(axis=2)
    assert (means.index[away.argmin(axis=1)] == pdf["cluster"]).mean() > 0.99
    assert out.select(F.count_distinct("cluster")).first()[0] == 4


def test_labels_run_in_generated_code_and_equal_distances_go_to_the_first(spark):
    df = spark.createDataFrame([(float(v), 0.0) for v in (0, 1, 2, 50, 51, 52, 100, 101, 102)], "a double, b double")
    found = ml.kmeans(df, ["a", "b"], 3)
    assert "lambdafunction" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.a // 50, r.cluster) for r in found.collect()) == [(float(c), f"Cluster {c}") for c in range(3) for _ in range(3)]
    blocks = centres.packed(spark.createDataFrame([(0.0,), (1.0,), (2.0,)], "x double"))
    (load, sums, cost), = centres._sums(blocks, 1, [np.array([[0.0], [2.0], [2.0]])])
    assert load.tolist() == [2, 1, 0] and sums.tolist() == [[1.0], [2.0], [0.0]] and cost == 1
