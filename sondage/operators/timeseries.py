"""Trend over row position, calendar resampling and linear forecast."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from sondage.functions.columns import as_double, quoted
from sondage.functions.pvalues import t_two_sided
from sondage.operators.stats import one_row
from sondage.plans.joins import scalar_row
from sondage.plans.ordering import with_global_index


def _positions(df: DataFrame, col: str, order_by) -> DataFrame:
    x = as_double(quoted(col))
    return with_global_index(df.where(x.isNotNull()), order_by, out="position")


def _line(indexed: DataFrame, col: str) -> DataFrame:
    y, i = as_double(quoted(col)), F.col("position").cast("double")
    return indexed.agg(
        F.regr_slope(y, i).alias("slope"),
        F.regr_intercept(y, i).alias("intercept"),
        F.regr_r2(y, i).alias("r2"),
        F.var_pop(y).alias("var"),
        F.count(y).alias("n"),
    )


def trend(df: DataFrame, col: str, order_by) -> DataFrame:
    """(slope, intercept, r, r2, p_value, n, direction, strength) of the column against its row position."""
    s = _line(_positions(df, col, order_by), col).first()
    slope, r2, n = s["slope"], s["r2"], s["n"]
    if slope is None:
        return one_row(df, slope=None, intercept=None, r=None, r2=None, p_value=None, n=n, direction="none", strength="none")
    r2 = min(1.0, r2 or 0.0)
    r = math.copysign(math.sqrt(r2), slope)
    p = None
    if n > 2:
        p = 0.0 if r2 >= 1.0 else t_two_sided(r * math.sqrt((n - 2) / (1 - r2)), n - 2)
    strength = "strong" if abs(r) > 0.7 else "moderate" if abs(r) > 0.4 else "weak"
    return one_row(
        df, slope=slope, intercept=s["intercept"], r=r, r2=r2, p_value=p, n=n,
        direction="Increasing" if slope > 0 else "Decreasing", strength=strength,
    )


def trend_fitted(df: DataFrame, col: str, order_by) -> DataFrame:
    """Non-null rows with their position and the fitted trend value."""
    indexed = _positions(df, col, order_by)
    line = scalar_row(_line(indexed, col).select("slope", "intercept"))
    return indexed.withColumn("fitted", line["intercept"] + line["slope"] * F.col("position"))


def forecast(df: DataFrame, col: str, order_by, periods: int = 20) -> DataFrame:
    """(period, label, forecast, ci_low, ci_high, direction, confidence) for the next positions.

    The band is 1.96 population deviations of the residuals, which for a least-squares line
    is sqrt(var(y) * (1 - r2)), so one aggregate is enough.
    """
    t = _line(_positions(df, col, order_by), col)
    future = t.select("*", F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("period"))
    at = F.col("n") + F.col("period") - 1
    y = F.col("intercept") + F.col("slope") * at
    half = 1.96 * F.sqrt(F.greatest(F.col("var") * (1 - F.col("r2")), F.lit(0.0)))
    confidence = F.when(F.col("r2") > 0.7, "high").when(F.col("r2") > 0.4, "moderate").otherwise("low")
    return future.select(
        "period",
        F.concat(F.lit("+"), F.col("period").cast("string")).alias("label"),
        F.round(y, 4).alias("forecast"),
        F.round(y - half, 4).alias("ci_low"),
        F.round(y + half, 4).alias("ci_high"),
        F.when(F.col("slope") > 0, "increase").otherwise("decrease").alias("direction"),
        confidence.alias("confidence"),
    )


_UNITS = {"D": "day", "W": "week", "ME": "month", "QE": "quarter", "YE": "year"}
_STEPS = {"D": "1 day", "W": "7 days", "ME": "1 month", "QE": "3 months", "YE": "1 year"}


def _period_end(start: Column, freq: str) -> Column:
    if freq == "D":
        return start
    if freq == "W":
        return F.date_add(start, 6)
    months = {"ME": 1, "QE": 3, "YE": 12}[freq]
    return F.date_sub(F.add_months(start, months), 1)


def resample(df: DataFrame, date: str, value: str, freq: str = "ME") -> DataFrame:
    """(period, mean, min, max) per day, week (ending Sunday), month, quarter or year, labelled by period end.

    Periods without rows are kept with NULLs: the grouped rows are joined to a calendar
    spine that spans the data (one row per period, so its size is the calendar's).
    """
    x = as_double(quoted(value))
    day = quoted(date).cast("timestamp_ntz")
    start = F.to_date(F.date_trunc(_UNITS[freq], day.cast("timestamp")))
    grouped = (
        df.where(day.isNotNull() & x.isNotNull()).groupBy(start.alias("start"))
        .agg(F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"))
    )
    ends = grouped.agg(F.min("start").alias("a"), F.max("start").alias("b")).where(F.col("a").isNotNull())
    spine = ends.select(F.explode(F.sequence("a", "b", F.expr(f"INTERVAL {_STEPS[freq]}"))).alias("start"))
    return spine.join(grouped, "start", "left").select(_period_end(F.col("start"), freq).alias("period"), "mean", "min", "max")
