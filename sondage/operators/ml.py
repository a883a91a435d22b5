"""Model building on Spark ML, clustering, anomaly detection and scenario scoring."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.feature import Bucketizer, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sondage.functions.columns import as_double, numeric_columns, quoted
from sondage.operators.centres import best_centres, packed
from sondage.operators.features import Features
from sondage.operators.relational import sample_n
from sondage.operators.stats import one_row
from sondage.operators.tablefacts import table_of
from sondage.operators.types import NUMERIC_LEVELS, logical_types, of_type
from sondage.plans.joins import scalar_row
from sondage.plans.values import q_name, quantiles_long
from sondage.session import materialize

REGRESSION, CLASSIFICATION = "Regression", "Classification"
LABEL, FEATURES, PREDICTION = "_label", "_features", "_prediction"  # kept apart from the user's columns
BINS, MERGED_WIDTH = 128, 32  # places of a number that boosting tells apart; widest feature vector whose equal rows are merged
MERGED_CELLS, MERGED_SHARE = 20_000, 0.1  # regression trees read merged rows if these are at most so many, and at most this share of the rows
MERGED_ROWS = 50_000  # regression trees of fewer rows read them as they are: merging has a fixed cost for each tree


def detect_problem(df: DataFrame, target: str | None = None) -> DataFrame:
    """(target, problem): the last numeric column by default; regression when it is numeric with more than 10 values."""
    numeric = numeric_columns(df)
    target = target or (numeric[-1] if numeric else df.columns[-1])
    few = df.select(quoted(target).alias("v")).where(F.col("v").isNotNull()).distinct().limit(NUMERIC_LEVELS + 1).count()
    problem = REGRESSION if target in numeric and few > NUMERIC_LEVELS else CLASSIFICATION
    return one_row(df, target=target, problem=problem)


# ------------------------------------------------------------------ features


def build_features(
    df: DataFrame, features: Sequence[str], category_cap: int | None = None, scale: bool = True, impute: bool = True
) -> Pipeline:
    """Pipeline from raw columns to a feature vector; see :class:`Features`.

    ``category_cap`` keeps that many categories of a column and makes the others one; without it every category has a place.
    """
    numeric = [c for c in features if c in numeric_columns(df)]
    other = [c for c in features if c not in numeric]
    return Pipeline(stages=[Features(numeric, other, FEATURES, category_cap, scale, impute)])


@dataclass
class FittedModel:
    """A trained pipeline with what is needed to apply it elsewhere."""

    pipeline: PipelineModel
    target: str
    problem: str
    features: list[str]
    metrics: dict
    labels: list[str] | None
    defaults: dict


def _split(df: DataFrame, key: str | Sequence[str] | None) -> tuple[DataFrame, DataFrame]:
    """80/20 by a seeded key hash: a row's side never depends on partitioning."""
    keys = df.columns if key is None else [key] if isinstance(key, str) else list(key)
    side = F.pmod(F.xxhash64(*[quoted(k) for k in keys], F.lit(42)), F.lit(5))
    return df.where(side != 0), df.where(side == 0)


def _labelled(df: DataFrame, target: str, problem: str) -> tuple[DataFrame, list]:
    if problem == REGRESSION:
        return df.withColumn(LABEL, as_double(quoted(target))), []
    indexer = StringIndexer(inputCol="_target_text", outputCol=LABEL, handleInvalid="skip", stringOrderType="alphabetAsc")
    return df.withColumn("_target_text", quoted(target).cast("string")), [indexer]


def _metrics(pred: DataFrame, problem: str) -> dict:
    if problem == REGRESSION:
        pairs = pred.select(F.col(PREDICTION).alias("p"), F.col(LABEL).alias("y"))
        s = pairs.agg(
            F.sqrt(F.avg(F.pow(F.col("y") - F.col("p"), F.lit(2.0)))).alias("rmse"),
            F.avg(F.pow(F.col("y") - F.col("p"), F.lit(2.0))).alias("mse"),
            F.var_pop("y").alias("var"),
        ).first()
        return {"rmse": s["rmse"], "r2": 1 - s["mse"] / s["var"] if s["var"] else None}
    pred = materialize(pred.groupBy(LABEL, PREDICTION).agg(F.count(F.lit(1)).cast("double").alias("_rows")))  # rows are scored once
    e = MulticlassClassificationEvaluator(labelCol=LABEL, predictionCol=PREDICTION, weightCol="_rows")
    return {"accuracy": e.evaluate(pred, {e.metricName: "accuracy"}), "f1": e.evaluate(pred, {e.metricName: "f1"})}


def _merged_metrics(model: BinnedModel, test: DataFrame) -> dict:
    """Those of a regression whose trees see bins only: rows of the same bins are scored once, with their mean and variance."""
    known = test.where(F.col(LABEL).isNotNull())
    cells = model.binned.cells(known, F.avg(LABEL).alias("_y"), F.var_pop(LABEL).alias("_within"), F.count(F.lit(1)).alias("_rows"))
    scored = materialize(model.model.transform(cells).select(F.col(PREDICTION).alias("p"), "_y", "_within", "_rows"))
    total = scored.agg(F.sum("_rows").alias("n"), F.sum(F.col("_rows") * F.col("_y")).alias("y")).first()
    if not total["n"]:
        return {"rmse": None, "r2": None}
    off = lambda at: F.sum(F.col("_rows") * (F.col("_within") + F.pow(F.col("_y") - at, F.lit(2.0)))) / total["n"]
    s = scored.agg(off(F.col("p")).alias("mse"), off(F.lit(total["y"] / total["n"])).alias("var")).first()
    return {"rmse": math.sqrt(s["mse"]), "r2": 1 - s["mse"] / s["var"] if s["var"] else None}


def _fit(df: DataFrame, target: str, problem: str, features: list[str], estimator, key, prep: Pipeline) -> FittedModel:
    rows, label_stages = _labelled(df, target, problem)
    train, test = _split(rows, key)
    estimator = estimator.setLabelCol(LABEL).setFeaturesCol(FEATURES).setPredictionCol(PREDICTION)
    if problem == CLASSIFICATION and isinstance(estimator, (GBTClassifier, OneVsRest)):
        estimator = MergedBoosting(estimator)
    elif isinstance(estimator, (GBTRegressor, RandomForestRegressor)):
        estimator = MergedRegression(estimator)
    model = Pipeline(stages=[*label_stages, *prep.getStages(), estimator]).fit(train)
    labels = list(model.stages[0].labelsArray[0]) if label_stages else None
    if problem == REGRESSION and isinstance(model.stages[-1], BinnedModel):
        metrics = _merged_metrics(model.stages[-1], PipelineModel(model.stages[:-1]).transform(test))
    else:
        metrics = _metrics(model.transform(test), problem)
    return FittedModel(model, target, problem, features, metrics, labels, {})


class MergedBoosting(Estimator):
    """Boosting on rows merged by what its trees see: the bin of every number, the class, and how many rows have them.

    Trees of a chain see bins only and take every row, so weights stand for the rows exactly, and the passes of a fit read as many
    rows as there are different ones. Bins lie between approximate quantiles of all rows. Vectors wider than ``MERGED_WIDTH``,
    whose rows hardly repeat, are left to the estimator as they are.
    """

    def __init__(self, estimator: GBTClassifier | OneVsRest):
        super().__init__()
        self.estimator = estimator

    def _fit(self, dataset: DataFrame) -> Transformer:
        width = _width(dataset)
        if not 0 < width <= MERGED_WIDTH:
            return self.estimator.fit(dataset)
        binned = Binned(_cuts(dataset, width, BINS))
        names = [f"_c{i}" for i in range(width)]
        cells = binned.columns(dataset).groupBy(LABEL, *names).agg(F.count(F.lit(1)).cast("double").alias("_rows"))
        cells = materialize(VectorAssembler(inputCols=names, outputCol=FEATURES).transform(cells).select(LABEL, FEATURES, "_rows"))
        one = self.estimator.getClassifier() if isinstance(self.estimator, OneVsRest) else self.estimator
        one.setMaxBins(2 * BINS)  # every bin has a place of its own
        return BinnedModel(binned, self.estimator.setWeightCol("_rows").fit(cells))


def _width(dataset: DataFrame) -> int:
    first = dataset.select(FEATURES).first()
    return first[0].size if first else 0


def _cuts(dataset: DataFrame, width: int, bins: int) -> list[list[float]]:
    """Cuts of every part of the feature vector at approximate quantiles of all rows."""
    parts = dataset.select(vector_to_array(FEATURES).alias("_parts")).select(*[F.get("_parts", F.lit(i)).alias(f"_b{i}") for i in range(width)])
    cuts = parts.approxQuantile(parts.columns, [i / bins for i in range(1, bins + 1)], 0.1 / bins)  # the largest value is apart, so that rare codes are
    return [sorted({c for c in own if math.isfinite(c)}) for own in cuts]


class MergedRegression(Estimator):
    """Regression trees on rows merged by what the trees see, the bin of every number.

    A split is chosen by the counts, sums and squares of its two sides. Merging takes the same constant from the squares of both
    and of their parent, so weighted means give boosting the trees of all rows. A forest draws every row for every tree, a
    Poisson number of times as Spark's does, and the draws of a tree are merged in the same way. Numbers get as many bins as the
    estimator has, between quantiles of all rows. Where merging saves little (see ``MERGED_CELLS``, ``MERGED_ROWS``) the estimator
    reads the rows.
    """

    def __init__(self, estimator: GBTRegressor | RandomForestRegressor):
        super().__init__()
        self.estimator = estimator

    def _fit(self, dataset: DataFrame) -> Transformer:
        width = _width(dataset)
        if not 0 < width <= MERGED_WIDTH or dataset.count() < MERGED_ROWS:
            return self.estimator.fit(dataset)
        bins = self.estimator.getMaxBins()
        cuts = _cuts(dataset, width, bins)
        binned = Binned([own[:-1] if len(own) >= bins else own for own in cuts])  # the largest value is apart only among few
        names = binned.names
        cells = materialize(binned.cells(dataset, F.avg(LABEL).alias(LABEL), F.count(F.lit(1)).cast("double").alias("_rows")))
        size = cells.agg(F.count(F.lit(1)).alias("cells"), F.sum("_rows").alias("rows")).first()
        if size["cells"] > min(MERGED_CELLS, MERGED_SHARE * size["rows"]):
            return self.estimator.fit(dataset)
        self.estimator.setMaxBins(2 * bins)  # every bin has a place of its own
        if isinstance(self.estimator, GBTRegressor):
            return BinnedModel(binned, self.estimator.setWeightCol("_rows").fit(cells.select(LABEL, FEATURES, "_rows")))
        numbered = cells.select(*names, FEATURES).rdd.zipWithIndex().map(lambda r: (*r[0], r[1])).toDF([*names, FEATURES, "_cell"])
        numbered = materialize(numbered)  # at most MERGED_CELLS rows
        placed = binned.columns(dataset).join(F.broadcast(numbered.select(*names, "_cell")), names).select("_cell", LABEL)
        drawn = _draws(placed, size["cells"], self.estimator.getNumTrees(), self.estimator.getSeed())
        bags = materialize(drawn.join(F.broadcast(numbered.select("_cell", FEATURES)), "_cell").select("_tree", LABEL, FEATURES, "_rows"))
        return BinnedModel(binned, _forest(self.estimator, bags))


def _draws(placed: DataFrame, cells: int, trees: int, seed: int) -> DataFrame:
    """(_tree, _cell, label, _rows): mean label and number of the rows that each tree draws out of each cell, every row Poisson(1) times.

    A task holds two numbers for each cell and tree, of which there are at most ``MERGED_CELLS`` times the trees.
    """

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        rows, sums = np.zeros((trees, cells)), np.zeros((trees, cells))
        for batch in batches:
            at, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(at):
                continue
            order = np.argsort(at, kind="stable")
            at, y = at[order], y[order]
            starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            times = rng.poisson(1.0, (trees, len(at)))
            rows[:, at[starts]] += np.add.reduceat(times, starts, axis=1)
            sums[:, at[starts]] += np.add.reduceat(times * y, starts, axis=1)
        for t in range(trees):
            met = np.flatnonzero(rows[t])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(met), t)), pa.array(met), pa.array(rows[t, met]), pa.array(sums[t, met])], names=["_tree", "_cell", "_rows", "_sum"])

    drawn = placed.mapInArrow(draw, "_tree long, _cell long, _rows double, _sum double").groupBy("_tree", "_cell").agg(F.sum("_rows").alias("_rows"), F.sum("_sum").alias("_sum"))
    return drawn.select("_tree", "_cell", (F.col("_sum") / F.col("_rows")).alias(LABEL), "_rows")


def _forest(estimator: RandomForestRegressor, bags: DataFrame) -> Forest:
    """One tree for each bag, a few at a time; nodes see the share of features that they see in a whole forest."""
    trees, seed = estimator.getNumTrees(), estimator.getSeed()
    share = estimator.getFeatureSubsetStrategy()
    share = ("all" if trees == 1 else "onethird") if share == "auto" else share
    seeds = np.random.SeedSequence(seed % 2**32).generate_state(trees).tolist()

    def grow(t: int) -> Transformer:
        one = estimator.copy().setNumTrees(1).setBootstrap(False).setFeatureSubsetStrategy(share).setSeed(seeds[t]).setWeightCol("_rows")
        return one.setPredictionCol(f"_tree_{t}").fit(bags.where(F.col("_tree") == t).select(LABEL, FEATURES, "_rows"))

    pool = ThreadPool(min(8, trees))
    try:
        return Forest(pool.map(inheritable_thread_target(bags.sparkSession)(grow), range(trees)))
    finally:
        pool.close()


class Forest(Transformer):
    """The mean of the predictions of trees that were fitted one by one."""

    def __init__(self, trees: list[Transformer]):
        super().__init__()
        self.trees = trees

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = dataset
        for tree in self.trees:
            out = tree.transform(out)
        names = [f"_tree_{t}" for t in range(len(self.trees))]
        total = F.aggregate(F.array(*names), F.lit(0.0), lambda a, x: a + x)
        return out.withColumn(PREDICTION, total / len(self.trees)).drop(*names)


@dataclass
class Binned:
    """Bins of the parts of the feature vector: bin i holds the values from cut i - 1 up to below cut i."""

    cuts: list[list[float]]

    @property
    def names(self) -> list[str]:
        return [f"_c{i}" for i in range(len(self.cuts))]

    def cells(self, rows: DataFrame, *aggs: Column) -> DataFrame:
        """One row for each combination of bins that occurs, with its feature vector of bins."""
        found = self.columns(rows).groupBy(*self.names).agg(*aggs)
        return VectorAssembler(inputCols=self.names, outputCol=FEATURES, handleInvalid="keep").transform(found)

    def columns(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the bins as ``_c0``, ``_c1`` and so on."""
        width = len(self.cuts)
        parts = rows.withColumn("_parts", vector_to_array(FEATURES))
        parts = parts.withColumns({f"_b{i}": F.get("_parts", F.lit(i)) for i in range(width)})
        splits = [[-math.inf, *(own or [0.0]), math.inf] for own in self.cuts]
        out = Bucketizer(splitsArray=splits, inputCols=[f"_b{i}" for i in range(width)], outputCols=[f"_c{i}" for i in range(width)], handleInvalid="keep").transform(parts)
        out = out.withColumns({f"_c{i}": F.col(f"_c{i}") + 0.0 for i in range(width)})  # plain numbers: as marked categories they would lose their order
        return out.drop("_parts", *[f"_b{i}" for i in range(width)])


class BinnedModel(Transformer):
    """The fitted boosting behind the bins; the columns of its model, and the feature vector as it came."""

    def __init__(self, binned: Binned, model: Transformer):
        super().__init__()
        self.binned, self.model = binned, model

    def _transform(self, dataset: DataFrame) -> DataFrame:
        names = [f"_c{i}" for i in range(len(self.binned.cuts))]
        rows = self.binned.columns(dataset).withColumnRenamed(FEATURES, "_whole")
        rows = VectorAssembler(inputCols=names, outputCol=FEATURES, handleInvalid="keep").transform(rows).drop(*names)
        return self.model.transform(rows).drop(FEATURES).withColumnRenamed("_whole", FEATURES)


def boosting(classes: int, rounds: int, seed: int = 42):
    """Gradient boosting for a target of ``classes`` classes.

    Two classes are one chain of trees. More are one chain against the rest for each class, fitted a few at a time; the class
    with the largest margin wins, and :func:`class_probabilities` normalises the margins jointly.
    """
    one = GBTClassifier(maxIter=rounds, seed=seed)
    return one if classes <= 2 else OneVsRest(classifier=one, parallelism=min(classes, 4))


def class_probabilities(classes: int) -> Column:
    """Probability of every class, in label order, from the margins (``rawPrediction``) of a fitted :func:`boosting`.

    A chain's margin m stands for the odds exp(2m) of its class, as its logistic loss has it; the chances of all classes are
    then brought to a sum of one.
    """
    chances = F.transform(vector_to_array("rawPrediction"), lambda m: 1 / (1 + F.exp(-2 * m)))
    if classes <= 2:
        return chances  # the two margins of one chain are each other's negative
    total = F.aggregate(chances, F.lit(0.0), lambda a, x: a + x)
    return F.transform(chances, lambda x: F.coalesce(F.try_divide(x, total), F.lit(1.0 / classes)))


def _classes(rows: DataFrame, target: str) -> int:
    return rows.agg(F.count_distinct(quoted(target))).first()[0]


def fit_default(
    df: DataFrame, target: str | None = None, key: str | Sequence[str] | None = None,
    features: Sequence[str] | None = None, max_features: int | None = None, category_cap: int | None = None, trees: int = 20, seed: int = 42,
) -> FittedModel:
    """Default model: 20-tree depth-5 forest (every split sees all features) for regression, 20-iteration boosting for any number of classes.

    Trained on all complete rows; ``max_features`` optionally limits the predictors to the first ones.
    """
    found = detect_problem(df, target).first()
    target, problem = found["target"], found["problem"]
    skip = {target, *([key] if isinstance(key, str) else key or [])}
    features = list(features or [c for c in df.columns if c not in skip])[: max_features or None]
    complete = df.na.drop(subset=[target, *features])
    rows = complete if complete.limit(5).count() == 5 else df
    prep = build_features(rows, features, category_cap)
    if problem == REGRESSION:
        estimator = RandomForestRegressor(numTrees=trees, maxDepth=5, featureSubsetStrategy="all", seed=seed)
    else:
        estimator = boosting(_classes(rows, target), trees, seed)
    model = _fit(rows, target, problem, features, estimator, key, prep)
    model.defaults = _defaults(rows, features)
    return model


def _defaults(df: DataFrame, features: Sequence[str]) -> dict:
    """Value per feature for input tables that lack it: training median, or first category in order."""
    numeric = [c for c in features if c in numeric_columns(df)]
    other = [c for c in features if c not in numeric]
    out: dict = {}
    if numeric:
        out.update({r["column"]: r["q0_5"] for r in quantiles_long(df, numeric, [0.5]).collect()})
    if other:
        first = df.agg(*[F.min(quoted(c).cast("string")).alias(f"m{i}") for i, c in enumerate(other)]).first()
        out.update({c: first[f"m{i}"] for i, c in enumerate(other)})
    return out


def metrics_table(model: FittedModel, df: DataFrame) -> DataFrame:
    """(target, problem, metric, value)."""
    rows = [{"target": model.target, "problem": model.problem, "metric": k, "value": v} for k, v in model.metrics.items()]
    return table_of(df, rows, "target string,problem string,metric string,value double")


def compare_models(
    df: DataFrame, target: str, problem: str | None = None, key: str | Sequence[str] | None = None,
    features: Sequence[str] | None = None, trees: int = 100, boost: int = 100, seed: int = 42,
) -> DataFrame:
    """(model, metric, value, best): ridge or logistic, forest and boosting on the same split; best by R2 or accuracy."""
    problem = problem or detect_problem(df, target).first()["problem"]
    skip = {target, *([key] if isinstance(key, str) else key or [])}
    features = list(features or [c for c in df.columns if c not in skip])
    rows = df.where(quoted(target).isNotNull())
    n = max(rows.count(), 1)  # a penalty of one on the sum of losses is one of 1/n on their mean
    if problem == REGRESSION:
        models = {
            "Ridge": LinearRegression(regParam=1.0 / n, elasticNetParam=0.0, standardization=False),
            "Random Forest": RandomForestRegressor(numTrees=trees, maxDepth=8, seed=seed),
            "Gradient Boosting": GBTRegressor(maxIter=boost, seed=seed),
        }
    else:
        models = {
            "Logistic Regression": LogisticRegression(maxIter=500, regParam=1.0 / n, standardization=False),
            "Random Forest": RandomForestClassifier(numTrees=trees, maxDepth=8, seed=seed),
            "Gradient Boosting": boosting(_classes(rows, target), boost, seed),
        }
    prep = build_features(rows, features, category_cap=None)
    prep = Pipeline(stages=prep.fit(_split(rows, key)[0]).stages)  # the same for every model
    main = "r2" if problem == REGRESSION else "accuracy"
    out = []
    for name, estimator in models.items():
        fitted = _fit(rows, target, problem, features, estimator, key, prep)
        out += [{"model": name, "metric": m, "value": v, "best": False} for m, v in fitted.metrics.items()]
    scored = [r for r in out if r["metric"] == main and r["value"] is not None]
    if scored:
        best = max(scored, key=lambda r: r["value"])["model"]
        for r in out:
            r["best"] = r["model"] == best
    return table_of(df, out, "model string,metric string,value double,best boolean")


def predict_table(
    model: FittedModel, df: DataFrame, defaults: Mapping[str, object] | None = None, probabilities: bool = False
) -> DataFrame:
    """Batch prediction: the input columns plus ``Predicted_<target>``; absent features take their defaults.

    With ``probabilities`` a boosted classifier adds ``Probabilities_<target>``, a map from class to its probability.
    """
    filled = df
    values = {**model.defaults, **(defaults or {})}
    for c in model.features:
        if c not in df.columns:
            filled = filled.withColumn(c, F.lit(values.get(c)))
    if model.target not in filled.columns:
        filled = filled.withColumn(model.target, F.lit(None).cast("double" if model.problem == REGRESSION else "string"))
    stages = model.pipeline.stages if model.labels is None else model.pipeline.stages[1:]
    scored = PipelineModel(stages).transform(filled)
    value = F.col(PREDICTION)
    if model.labels is not None:
        value = F.get(F.array(*[F.lit(v) for v in model.labels]), F.col(PREDICTION).cast("int"))
    more = []
    if probabilities:
        if model.labels is None or "rawPrediction" not in scored.columns:
            raise ValueError("probabilities come with classification only")
        names = F.array(*[F.lit(v) for v in model.labels])
        more = [F.map_from_arrays(names, class_probabilities(len(model.labels))).alias(f"Probabilities_{model.target}")]
    return scored.select(*[quoted(c) for c in df.columns], value.alias(f"Predicted_{model.target}"), *more)


# ------------------------------------------------------------------ clusters


def _standardised(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Complete rows with a ``_z`` array of (x - mean) / population deviation (0 for a constant column)."""
    complete = df.na.drop(subset=list(cols))
    s = scalar_row(
        complete.agg(
            *[a for i, c in enumerate(cols) for a in (F.avg(as_double(quoted(c))).alias(f"m{i}"), F.stddev_pop(as_double(quoted(c))).alias(f"s{i}"))]
        )
    )
    scaled = [F.coalesce(F.try_divide(as_double(quoted(c)) - s[f"m{i}"], s[f"s{i}"]), F.lit(0.0)) for i, c in enumerate(cols)]
    return complete.withColumn("_z", F.array(*scaled))


def kmeans(df: DataFrame, cols: Sequence[str], k: int = 3, seed: int = 42, restarts: int = 10) -> DataFrame:
    """Complete rows with ``cluster`` ("Cluster i"): k-means on standardised columns, best of several starts run together.

    Clusters are numbered by their centres in the order of ``cols``. Fewer than ``k`` where there are fewer different rows.
    """
    rows = _standardised(df, cols)
    names = [f"z{i}" for i in range(len(cols))]
    points = rows.select(*[F.get("_z", F.lit(i)).alias(n) for i, n in enumerate(names)])
    cores = df.sparkSession.sparkContext.defaultParallelism
    if points.rdd.getNumPartitions() < cores:  # few input splits: give the passes all cores
        points = points.repartition(cores)
    centres = best_centres(materialize(packed(points)), len(cols), k, seed, restarts)
    if not len(centres):
        return rows.withColumn("cluster", F.lit(None).cast("string")).drop("_z")
    # plain sums, so that they run in generated code
    aways = [f"_away{j}" for j in range(len(centres))]
    for name, centre in zip(aways, centres.tolist()):
        apart = [F.lit(c) - F.get("_z", F.lit(i)) for i, c in enumerate(centre)]
        rows = rows.withColumn(name, sum((d * d for d in apart), F.lit(0.0)))
    least = F.least(*aways) if len(aways) > 1 else F.col(aways[0])
    number = F.lit(None).cast("string")
    for j, name in reversed(list(enumerate(aways))):
        number = F.when(F.col(name) == F.col("_least"), F.lit(f"Cluster {j}")).otherwise(number)
    return rows.withColumn("_least", least).withColumn("cluster", number).drop("_z", "_least", *aways)


def cluster_profile(clustered: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(cluster, size, mean of each column to 3 dp)."""
    return clustered.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"), *[F.round(F.avg(as_double(quoted(c))), 3).alias(c) for c in cols]
    )


# ------------------------------------------------------------------ anomalies

_TREES, _TREE_ROWS = 200, 256


def _average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points (isolation-forest normaliser)."""
    n = np.asarray(n, dtype=float)
    out = np.where(n == 2, 1.0, 0.0)
    big = n > 2
    h = np.log(np.where(big, n - 1, 1.0)) + 0.5772156649015329
    return np.where(big, 2.0 * h - 2.0 * (n - 1) / np.where(big, n, 1.0), out)


def _grow(points: np.ndarray, rng: np.random.Generator, limit: int) -> tuple[np.ndarray, ...]:
    """One isolation tree as flat arrays (feature, threshold, left, right, path)."""
    feature, threshold, left, right, path = [], [], [], [], []

    def node(rows: np.ndarray, depth: int) -> int:
        at = len(feature)
        for a, v in ((feature, -1), (threshold, 0.0), (left, at), (right, at), (path, 0.0)):
            a.append(v)
        low, high = rows.min(axis=0), rows.max(axis=0)
        varied = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(varied):
            path[at] = depth + float(_average_path(len(rows)))
            return at
        f = int(rng.choice(varied))
        cut = float(rng.uniform(low[f], high[f]))
        inside = rows[:, f] <= cut
        feature[at], threshold[at] = f, cut
        left[at] = node(rows[inside], depth + 1)
        right[at] = node(rows[~inside], depth + 1)
        return at

    node(points, 0)
    return tuple(np.array(a) for a in (feature, threshold, left, right, path))


def isolation_scores(df: DataFrame, cols: Sequence[str], key: str | Sequence[str], trees: int = _TREES, seed: int = 42) -> DataFrame:
    """Complete rows with ``anomaly_score`` (higher is more isolated).

    The model has a fixed size: 200 trees of 256 rows.  Spark draws those rows by key hash,
    the trees travel with the task, and every row is scored in parallel.
    """
    cols = list(cols)
    complete = df.na.drop(subset=cols)
    keys = [key] if isinstance(key, str) else list(key)
    names = [f"x{i}" for i in range(len(cols))]
    slim = complete.select(*[quoted(k).alias(f"k{i}") for i, k in enumerate(keys)], *[as_double(quoted(c)).alias(n) for c, n in zip(cols, names)])
    drawn = sample_n(slim, trees * _TREE_ROWS, [f"k{i}" for i in range(len(keys))], seed).select(*names).toPandas().to_numpy(dtype=float)
    rng = np.random.default_rng(seed)
    drawn = drawn[np.lexsort(drawn.T[::-1])]
    size = min(_TREE_ROWS, len(drawn))
    limit = max(1, math.ceil(math.log2(max(size, 2))))
    shuffled = rng.permutation(len(drawn))
    forest = []
    for t in range(trees):
        at = (t * size) % max(len(drawn) - size + 1, 1) if len(drawn) < trees * size else t * size
        rows = shuffled[at : at + size] if len(drawn) >= trees * size else rng.choice(len(drawn), size, replace=False)
        forest.append(_grow(drawn[rows], rng, limit))
    normal = float(_average_path(size)) or 1.0

    shared = df.sparkSession.sparkContext.broadcast(forest)  # of fixed size: trees x rows of a tree

    @F.pandas_udf("double")
    def score(*features: pd.Series) -> pd.Series:
        x = np.column_stack([f.to_numpy(dtype=float) for f in features])
        total = np.zeros(len(x))
        for feature, threshold, left, right, path in shared.value:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(limit):
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                goes_left = x[np.arange(len(x)), np.where(inner, f, 0)] <= threshold[at]
                at = np.where(inner, np.where(goes_left, left[at], right[at]), at)
            total += path[at]
        return pd.Series(np.power(2.0, -total / trees / normal))

    return complete.withColumn("anomaly_score", score(*[as_double(quoted(c)) for c in cols]))


def isolation_forest(df: DataFrame, cols: Sequence[str], key: str | Sequence[str], seed: int = 42) -> DataFrame:
    """Complete rows with ``anomaly_score`` and ``is_anomaly``; the expected share is 5/n kept within 1 % and 10 %."""
    scored = materialize(isolation_scores(df, cols, key, seed=seed))
    n = max(scored.count(), 1)
    share = min(0.1, max(0.01, 5 / n))
    cut = quantiles_long(scored, ["anomaly_score"], [1 - share]).select(F.col(q_name(1 - share)).alias("v"))
    return scored.withColumn("is_anomaly", F.col("anomaly_score") > scalar_row(cut)["v"])


def anomaly_drivers(df: DataFrame, cols: Sequence[str], flag: str = "is_anomaly", trees: int = 120, seed: int = 42) -> DataFrame:
    """(column, importance): which columns separate flagged rows from the rest (forest importances).

    The target is the anomaly flag as 0/1.  It is fitted as a regression: a classification
    tree drops splits whose two sides have the same majority, which for rare flags is all of them.
    """
    rows = _standardised(df, cols).select("*", array_to_vector("_z").alias("features"), quoted(flag).cast("double").alias("label"))
    model = RandomForestRegressor(numTrees=trees, maxDepth=6, maxBins=128, seed=seed).fit(rows.select("features", "label"))
    weights = model.featureImportances.toArray()
    found = [{"column": c, "importance": float(w)} for c, w in zip(cols, weights)]
    found.sort(key=lambda r: (-r["importance"], r["column"]))
    return table_of(df, found, "column string,importance double")


# ------------------------------------------------------------------ scenarios


def scenario_bounds(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, baseline, low, high): median and the 5-95 % range, or the full range when that is empty."""
    from sondage.plans.values import numeric_base

    t = numeric_base(df, list(cols), (0.05, 0.5, 0.95), fields=("low", "high"))
    flat = F.col("q0_95") <= F.col("q0_05")
    return t.select(
        "column",
        F.col("q0_5").alias("baseline"),
        F.when(flat, F.col("low")).otherwise(F.col("q0_05")).alias("low"),
        F.when(flat, F.col("high")).otherwise(F.col("q0_95")).alias("high"),
    )


def top_drivers(df: DataFrame, target: str, cols: Sequence[str], k: int = 4) -> DataFrame:
    """(column, strength): columns by |r| with the target, more than five complete pairs, best k."""
    from sondage.operators.stats import _pearson_all

    others = [c for c in cols if c != target]
    y = as_double(quoted(target))
    pairs = df.agg(*[F.count_if(as_double(quoted(c)).isNotNull() & y.isNotNull()).alias(f"n{i}") for i, c in enumerate(others)])
    sizes = F.array(*[F.col(f"n{i}") for i in range(len(others))])
    counts = scalar_row(pairs.select(sizes.alias("n")))["n"]
    names = F.array(*[F.lit(c) for c in others])
    t = _pearson_all(df, [target, *others]).where((F.col("ia") == 0) & F.col("r").isNotNull())
    usable = t.where(F.get(counts, F.col("ib") - 1) > 5)
    return usable.select(F.get(names, F.col("ib") - 1).alias("column"), F.abs("r").alias("strength"), "ib").orderBy(
        F.desc("strength"), "ib"
    ).limit(k).drop("ib")


def score_scenarios(
    df: DataFrame, target: str, scenarios: DataFrame | None = None, k: int = 4, drivers: Sequence[str] | None = None, alpha: float = 1.0
) -> DataFrame:
    """Score a table of scenarios with a ridge model on standardised drivers.

    Output: the scenario columns plus prediction, ci_low, ci_high, baseline, delta,
    delta_pct and r2.  The normal equations (means, covariances) are one aggregate over all
    complete rows; only the k x k solve happens on the driver, and scoring is a column
    expression.  Drivers missing from a scenario sit at their median.
    """
    if drivers is None:
        numeric = of_type(logical_types(df), "numeric")
        drivers = [r["column"] for r in top_drivers(df, target, numeric, k).collect()]
    drivers = list(drivers)
    complete = df.na.drop(subset=[target, *drivers])
    x = [as_double(quoted(c)) for c in drivers]
    y = as_double(quoted(target))
    size = len(drivers)
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(y).alias("my"), F.var_pop(y).alias("vy")]
    for i in range(size):
        aggs += [F.avg(x[i]).alias(f"m{i}"), F.covar_pop(x[i], y).alias(f"cy{i}")]
        aggs += [F.covar_pop(x[i], x[j]).alias(f"c{i}_{j}") for j in range(i, size)]
    s = complete.agg(*aggs).first().asDict()
    if s["n"] < 10:
        raise ValueError("fewer than ten complete rows to fit the scenario model")
    cov = np.array([[s[f"c{min(i, j)}_{max(i, j)}"] for j in range(size)] for i in range(size)])
    scale = np.sqrt(np.diag(cov))
    scale[scale == 0] = 1.0
    corr, toward = cov / np.outer(scale, scale), np.array([s[f"cy{i}"] for i in range(size)]) / scale
    weights = np.linalg.solve(s["n"] * corr + alpha * np.eye(size), s["n"] * toward)
    mse = max(0.0, s["vy"] - 2 * weights @ toward + weights @ corr @ weights)
    half = 1.96 * math.sqrt(mse) * math.sqrt(1 + 1 / s["n"])
    r2 = 1 - mse / s["vy"] if s["vy"] else 0.0
    medians = {r["column"]: r["q0_5"] for r in quantiles_long(df, drivers, [0.5]).collect()}

    def predict(values: list[Column]) -> Column:
        out = F.lit(float(s["my"]))
        for i, v in enumerate(values):
            out = out + F.lit(float(weights[i] / scale[i])) * (v - F.lit(float(s[f"m{i}"])))
        return out

    if scenarios is None:
        scenarios = df.sparkSession.range(1).select(*[F.lit(medians[c]).alias(c) for c in drivers])
    chosen = [F.coalesce(as_double(quoted(c)), F.lit(medians[c])) if c in scenarios.columns else F.lit(medians[c]) for c in drivers]
    base = predict([F.lit(medians[c]) for c in drivers])
    scored = scenarios.withColumn("prediction", predict(chosen)).withColumn("baseline", base)
    delta = F.col("prediction") - F.col("baseline")
    return scored.withColumns(
        {
            "ci_low": F.col("prediction") - F.lit(half),
            "ci_high": F.col("prediction") + F.lit(half),
            "delta": delta,
            "delta_pct": delta / F.greatest(F.abs("baseline"), F.lit(0.01)) * 100,
            "r2": F.lit(r2),
        }
    )
