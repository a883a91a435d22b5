"""Profiles that grow with their table: a mergeable state per part, so that a new part is profiled alone and added."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from sondage.functions.columns import as_double, atomic_columns, clean_nan, numeric_columns, quoted
from sondage.plans.values import fused, q_name

RANK_K = 400  # quantile sketch: rank error about 1 %, falling with 1 / k to the power 0.9
DISTINCT_LG = 14  # distinct sketch: 2^14 registers, error about 0.8 %


def profile_state(df: DataFrame, cols: Sequence[str] | None = None, k: int = RANK_K, lg: int = DISTINCT_LG) -> DataFrame:
    """(column, position, rows, n, mean, m2, low, high, ranks, levels): the state of one part of a table, one row a column.

    ``ranks`` is a KLL sketch of a number's values (NULL for other columns, like the moments), ``levels`` a distinct-count
    sketch of any column's. States of parts are kept together (a Parquet table of a few kilobytes a column) and merged by :func:`merge_states`.
    """
    cols = list(cols or atomic_columns(df))
    numbers = set(numeric_columns(df))
    df = clean_nan(df)
    numeric, other = [c for c in cols if c in numbers], [c for c in cols if c not in numbers]
    common = {
        "rows": lambda c: F.count(F.lit(1)),
        "n": lambda c: F.count(c),
        "levels": lambda c: F.hll_sketch_agg(F.when(c.isNotNull(), F.xxhash64(c)), lg),
    }
    moments = {
        "mean": lambda c: F.avg(as_double(c)),
        "m2": lambda c: F.var_pop(as_double(c)) * F.count(c),
        "low": lambda c: F.min(as_double(c)),
        "high": lambda c: F.max(as_double(c)),
        "ranks": lambda c: F.kll_sketch_agg_double(as_double(c), k),
    }
    known = fused(df, numeric, {**common, **moments})
    known = known if not other else known.unionByName(fused(df, other, common), allowMissingColumns=True)
    place = F.array_position(F.array(*[F.lit(c) for c in cols]), F.col("column")).cast("int") - 1
    return known.select("column", place.alias("position"), "rows", "n", "mean", "m2", "low", "high", "ranks", "levels")


def merge_states(states: DataFrame) -> DataFrame:
    """One state a column from the states of any number of parts; merging in any order and grouping describes the same table.

    Sums, extremes and both sketches are combined before they move. Squared deviations are taken about the common mean.
    """
    some = F.col("n") > 0
    whole = states.groupBy("column").agg(
        F.min("position").alias("position"),
        F.sum("rows").alias("rows"),
        F.sum("n").alias("n"),
        F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum(F.when(F.col("mean").isNotNull(), F.col("n")))).alias("mean"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.kll_merge_agg_double(F.when(some, F.col("ranks"))).alias("ranks"),
        F.hll_union_agg("levels").alias("levels"),
    )
    centre = whole.select(F.col("column").alias("_c"), F.col("mean").alias("_m"))  # one row a column
    spread = states.where(some).join(F.broadcast(centre), F.col("column") == F.col("_c")).groupBy("_c").agg(
        F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("_m")) * (F.col("mean") - F.col("_m"))).alias("m2")
    )
    out = whole.join(F.broadcast(spread), F.col("column") == F.col("_c"), "left")
    has = F.col("mean").isNotNull()
    return out.select("column", "position", "rows", "n", "mean", "m2", "low", "high", F.when(has, F.col("ranks")).alias("ranks"), "levels")


def state_profile(state: DataFrame, qs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(column, rows, missing, mean, std, min, max, nunique, q0_25, ..): what a state says; ``nunique`` and quantiles within the sketches' errors."""
    n = F.col("n").cast("double")
    quantile = lambda q: F.when(F.col("mean").isNotNull(), F.kll_sketch_get_quantile_double("ranks", F.lit(float(q))))
    return state.orderBy("position").select(
        "column", "rows", (F.col("rows") - F.col("n")).alias("missing"), "mean", F.when(n > 1, F.sqrt(F.col("m2") / F.nullif(n - 1, F.lit(0.0)))).alias("std"),
        F.col("low").alias("min"), F.col("high").alias("max"), F.hll_sketch_estimate("levels").alias("nunique"), *[quantile(q).alias(q_name(q)) for q in qs],
    )
