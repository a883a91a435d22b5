"""Data behind distribution charts: boxes, histograms, densities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sondage.functions.columns import as_double, quoted
from sondage.plans.joins import attach, scalar_row
from sondage.plans.values import q_name, quantiles_long


def box_stats(df: DataFrame, num: str, by: str | None = None) -> DataFrame:
    """(by, n, q1, median, q3, whisker_low, whisker_high, outliers): Tukey box overall or per group.

    Whiskers end at the last value within 1.5 IQR.  The fences return to the rows as a
    scalar, or per group through a join that keeps big groups spread out.
    """
    x = as_double(quoted(num))
    keys = [by] if by else []
    rows = df.where(x.isNotNull()).select(*[quoted(k) for k in keys], x.alias("_x"))
    rows = rows.na.drop(subset=keys) if keys else rows
    q = quantiles_long(rows, ["_x"], (0.25, 0.5, 0.75), keys).select(
        *[quoted(k) for k in keys],
        F.col(q_name(0.25)).alias("q1"), F.col(q_name(0.5)).alias("median"), F.col(q_name(0.75)).alias("q3"),
    )
    if keys:
        placed = attach(rows, q, keys, how="inner")
        grouped = placed.groupBy(*[quoted(k) for k in keys], "q1", "median", "q3")
    else:
        s = scalar_row(q)
        placed = rows.select("_x", s["q1"].alias("q1"), s["median"].alias("median"), s["q3"].alias("q3"))
        grouped = placed.groupBy("q1", "median", "q3")
    spread = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("_x") >= F.col("q1") - spread) & (F.col("_x") <= F.col("q3") + spread)
    return grouped.agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(inside, F.col("_x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_x"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    ).select(*[quoted(k) for k in keys], "n", "q1", "median", "q3", "whisker_low", "whisker_high", "outliers")


_BITS = 32_768  # of the built-in bitmap


def default_bins(df: DataFrame, col: str, most: int = 50) -> Column:
    """Bin count by cardinality: a fifth of the distinct values, between 10 and ``most``.

    A bitmap of hashed values cannot hold more bits than there are values, so 5 x ``most`` bits prove the upper limit in one
    scan of 4 KB a task; only a column of about as few values is counted exactly.
    """
    values = df.select(quoted(col).alias("v")).where(F.col("v").isNotNull())
    bits = values.agg(F.bitmap_count(F.bitmap_construct_agg(F.pmod(F.xxhash64("v"), F.lit(_BITS)))).alias("k")).first()["k"]
    if bits >= 5 * most:
        return F.lit(most)
    distinct = values.distinct().agg(F.count(F.lit(1)).alias("k"))
    return F.least(F.lit(most), F.greatest(F.lit(10), F.floor(scalar_row(distinct)["k"] / 5))).cast("int")


def _bin(x: Column, low: Column, width: Column, bins: Column) -> Column:
    """Equi-width bin number; the upper end belongs to the last bin."""
    return F.when(x.isNotNull(), F.least(F.coalesce(F.floor(F.try_divide(x - low, width)), F.lit(0)), bins - 1)).cast("int")


def histogram(df: DataFrame, col: str, bins: int | None = None, density: bool = False, by: str | None = None, most: int = 50) -> DataFrame:
    """(by, bin, low, high, count[, density]): equi-width histogram with empty bins kept.

    Bin edges span the whole column, so groups share them.
    """
    x = as_double(quoted(col))
    n_bins = F.lit(bins) if bins else default_bins(df, col, most)
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("n")).where(F.col("n") > 0)
    s = scalar_row(ends)
    width = (s["hi"] - s["lo"]) / n_bins
    keys = [by] if by else []
    rows = df.na.drop(subset=keys) if keys else df
    counts = (
        rows.where(x.isNotNull()).select(*[quoted(k) for k in keys], _bin(x, s["lo"], width, n_bins).alias("bin"))
        .groupBy(*[quoted(k) for k in keys], "bin").agg(F.count(F.lit(1)).alias("count"))
    )
    edges = ends.select(
        F.explode(F.sequence(F.lit(0), n_bins - 1)).alias("bin"), "lo", ((F.col("hi") - F.col("lo")) / n_bins).alias("w")
    )
    edges = edges.select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("high"))
    if keys:
        shells = counts.select(*[quoted(k) for k in keys]).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), n_bins - 1)))
        full = shells.join(counts, [*keys, "bin"], "left").join(F.broadcast(edges), "bin")  # edges: one row per bin
    else:
        full = edges.join(counts, "bin", "left")
    out = full.select(*[quoted(k) for k in keys], "bin", "low", "high", F.coalesce("count", F.lit(0)).alias("count"))
    if not density:
        return out
    total = scalar_row(counts.agg(F.sum("count").alias("t")))["t"]
    return out.withColumn("density", F.try_divide(F.col("count"), total * (F.col("high") - F.col("low"))))


def histogram2d(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """(x_bin, y_bin, count) over complete pairs, occurring cells only."""
    a, b = as_double(quoted(x)), as_double(quoted(y))
    rows = df.select(a.alias("a"), b.alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    s = scalar_row(rows.agg(F.min("a").alias("a0"), F.max("a").alias("a1"), F.min("b").alias("b0"), F.max("b").alias("b1")))
    k = F.lit(bins)
    return rows.select(
        _bin(F.col("a"), s["a0"], (s["a1"] - s["a0"]) / k, k).alias("x_bin"),
        _bin(F.col("b"), s["b0"], (s["b1"] - s["b0"]) / k, k).alias("y_bin"),
    ).groupBy("x_bin", "y_bin").agg(F.count(F.lit(1)).alias("count"))


def kde(df: DataFrame, num: str, by: str | None = None, grid: int = 64, fine: int = 1024) -> DataFrame:
    """(by, x, density): Gaussian density on an even grid with Scott's bandwidth.

    Values are first counted in ``fine`` narrow bins, so the kernel sum is over bins, not
    rows: per group at most ``fine`` x ``grid`` terms, generated from the bin itself.
    """
    x = as_double(quoted(num))
    keys = [by] if by else []
    rows = df.where(x.isNotNull()).select(*[quoted(k) for k in keys], x.alias("_x"))
    rows = rows.na.drop(subset=keys) if keys else rows
    s = scalar_row(rows.agg(F.min("_x").alias("lo"), F.max("_x").alias("hi")))
    width = (s["hi"] - s["lo"]) / fine
    keyed = [quoted(k) for k in keys]
    bins = rows.select(*keyed, "_x", _bin(F.col("_x"), s["lo"], width, F.lit(fine)).alias("bin")).groupBy(*keyed, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("_x").alias("at")
    )
    spread = rows.groupBy(*keyed).agg(F.stddev_samp("_x").alias("sd"), F.count(F.lit(1)).alias("total"))
    spread = spread.withColumn("h", F.col("sd") * F.pow(F.col("total").cast("double"), F.lit(-0.2))).where(F.col("h") > 0)
    if keys:
        joined = attach(bins, spread, keys, how="inner")
    else:
        one = scalar_row(spread)
        joined = bins.withColumns({"h": one["h"], "total": one["total"]}).where(F.col("h") > 0)
    step = (s["hi"] - s["lo"]) / (grid - 1)
    points = joined.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    z = (s["lo"] + F.col("i") * step - F.col("at")) / F.col("h")
    kernel = F.exp(-z * z / 2) * F.col("n") / (F.col("h") * F.col("total") * F.sqrt(F.lit(2.0) * F.pi()))
    return points.groupBy(*keyed, "i").agg(F.sum(kernel).alias("density")).select(
        *keyed, (s["lo"] + F.col("i") * step).alias("x"), "density"
    )
