"""Feature vectors: exact medians, z-scores, and categories numbered by a distributed dictionary."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator, Transformer
from pyspark.ml.feature import OneHotEncoder, OneHotEncoderModel, VectorAssembler
from pyspark.sql import DataFrame, functions as F

from sondage.functions.columns import as_double, quoted
from sondage.plans.joins import attach
from sondage.plans.ordering import with_global_index
from sondage.plans.values import quantiles_long, top_counts, value_counts_long
from sondage.session import materialize

OTHER = "Other"
LOCAL = 1_000  # a dictionary of at most so many values is held as a local table and broadcast


def dictionary(df: DataFrame, cols: Sequence[str], cap: int | None = None) -> DataFrame:
    """(column, value, number): the values of every column as text, numbered from 0 by falling frequency, ties to the smaller value.

    With ``cap`` only the ``cap`` most frequent. Without, the numbers are a distributed running count: no column's values are gathered.
    """
    texts = df.select(*[quoted(c).cast("string").alias(c) for c in cols])
    counts = value_counts_long(texts, cols)
    if cap is not None:
        return top_counts(counts, cap).select("column", "value", (F.col("rank") - 1).cast("long").alias("number"))
    ready = materialize(counts.select("column", F.col("text").alias("value"), (-F.col("n")).alias("_less")))
    return with_global_index(ready, ["_less", "value"], "column", out="number").select("column", "value", F.col("number").cast("long").alias("number"))


@dataclass
class _Coded:
    """How one column is coded: its (value, number) table, numbers in all, the filler of gaps and the number of other values."""

    table: DataFrame
    size: int
    local: bool
    filler: str | None
    other: int | None


class Features(Estimator):
    """Numbers: gaps become the exact median, then (x - mean) / sample deviation. Everything else as text: gaps become the most
    frequent value, with ``cap`` the values beyond the ``cap`` most frequent become one more, then one-hot by the dictionary's
    numbers; a value that was not met in training has the all-zero code."""

    def __init__(self, numeric: Sequence[str], other: Sequence[str], output: str, cap: int | None, scale: bool, impute: bool):
        super().__init__()
        self.numeric, self.other, self.output = list(numeric), list(other), output
        self.cap, self.scale, self.impute = cap, scale, impute

    def _fit(self, dataset: DataFrame) -> FeaturesModel:
        return FeaturesModel(self, self._numbers(dataset), self._codes(dataset))

    def _numbers(self, df: DataFrame) -> list[tuple[float | None, float, float]]:
        """(median, mean, deviation) of each numeric column."""
        if not self.numeric:
            return []
        medians: list[float | None] = [None] * len(self.numeric)
        if self.impute:
            for r in quantiles_long(df, self.numeric, [0.5]).collect():  # one row a column
                medians[r["position"]] = r["q0_5"]
        if not self.scale:
            return [(m, 0.0, 1.0) for m in medians]
        aggs = []
        for i, (c, m) in enumerate(zip(self.numeric, medians)):
            x = _filled(c, m)
            aggs += [F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}")]
        s = df.agg(*aggs).first()
        return [(m, s[f"m{i}"] or 0.0, s[f"s{i}"] or 0.0) for i, m in enumerate(medians)]

    def _codes(self, df: DataFrame) -> dict[str, _Coded]:
        if not self.other:
            return {}
        found = materialize(dictionary(df, self.other, None if self.cap is None else self.cap + 1))
        sizes = {r["column"]: r["k"] for r in found.groupBy("column").agg(F.count(F.lit(1)).alias("k")).collect()}
        fillers = {r["column"]: r["value"] for r in found.where("number = 0").collect()} if self.impute else {}
        out = {}
        for c in self.other:
            size, other = sizes.get(c, 0), None
            table = found.where(F.col("column") == c).select("value", "number")
            if self.cap is not None and size > self.cap:
                size = self.cap
                table = table.where(F.col("number") < size)
                named = table.where(F.col("value") == OTHER).first()
                other = named["number"] if named else size
                size += named is None
            local = size <= LOCAL
            if local:  # at most LOCAL rows
                table = df.sparkSession.createDataFrame([tuple(r) for r in table.collect()], "value string, number long")
            if size:
                out[c] = _Coded(table, size, local, fillers.get(c), other)
        return out


class FeaturesModel(Transformer):
    """Adds the feature vector; rows and other columns stay as they are."""

    def __init__(self, spec: Features, numbers: list[tuple[float | None, float, float]], codes: dict[str, _Coded]):
        super().__init__()
        self.spec, self.numbers, self.codes = spec, numbers, codes
        self._encoder: OneHotEncoderModel | None = None

    @property
    def width(self) -> int:
        return len(self.numbers) + sum(c.size for c in self.codes.values())

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out, inputs = dataset, []
        for i, (c, (median, mean, spread)) in enumerate(zip(self.spec.numeric, self.numbers)):
            x = _filled(c, median)
            z = (x - mean) / spread if spread else F.when(x.isNotNull(), F.lit(0.0))
            missing = F.lit(0.0 if self.spec.impute else float("nan"))
            out = out.withColumn(f"_f_num_{i}", F.coalesce(z, missing))
            inputs.append(f"_f_num_{i}")
        codes, hots = [], []
        for i, (c, coded) in enumerate(self.codes.items()):
            out = self._coded(out, c, coded, f"_f_code_{i}")
            codes.append(f"_f_code_{i}")
            hots.append(f"_f_hot_{i}")
        if codes:
            if self._encoder is None:
                widest = dataset.sparkSession.createDataFrame([tuple(float(c.size - 1) for c in self.codes.values())], codes)
                self._encoder = OneHotEncoder(inputCols=codes, outputCols=hots, handleInvalid="keep").fit(widest)
            out = self._encoder.transform(out)
        vector = VectorAssembler(inputCols=inputs + hots, outputCol=self.spec.output, handleInvalid="keep").transform(out)
        return vector.drop(*inputs, *codes, *hots)

    def _coded(self, rows: DataFrame, c: str, coded: _Coded, name: str) -> DataFrame:
        """Add the number of the value: a value without one gets that of other values, or else the first number beyond."""
        value = quoted(c).cast("string")
        if coded.filler is not None:
            value = F.coalesce(value, F.lit(coded.filler))
        rows = rows.withColumn("_f_value", value)
        table = coded.table.select(F.col("value").alias("_f_value"), F.col("number").alias("_f_number"))
        if coded.local:
            rows = rows.join(F.broadcast(table), "_f_value", "left")
        else:  # measured, its frequent values broadcast and the rest shuffled; written, as the next such column reads it several times
            rows = materialize(attach(rows, table, ["_f_value"]))
        beyond = F.lit(coded.size) if coded.other is None else F.when(F.col("_f_value").isNotNull(), F.lit(coded.other)).otherwise(F.lit(coded.size))
        return rows.withColumn(name, F.coalesce("_f_number", beyond).cast("double")).drop("_f_value", "_f_number")


def _filled(c: str, median: float | None):
    x = as_double(quoted(c).cast("double"))
    return x if median is None else F.coalesce(x, F.lit(median))
