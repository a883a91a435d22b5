"""Running, rolling and positional operators.

Each takes a unique ``order_by`` and an optional ``partition_by``.  Both variants run in
order buckets (see :mod:`sondage.plans.ordering`), so neither a table without partitions
nor one oversized partition ends up in a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sondage.functions.columns import as_double, present, quoted
from sondage.plans.joins import attach, scalar_row
from sondage.plans.ordering import BUCKET, OrderedPass, drop_halo, global_prefix, with_halo
from sondage.session import materialize

Keys = str | Sequence[str]


def running_total(df: DataFrame, col: str, order_by: Keys, partition_by: Keys | None = None, out: str = "running_total") -> DataFrame:
    """Cumulative sum; NULLs add nothing and stay NULL."""
    x = as_double(quoted(col))
    rows = global_prefix(df, x, "_run", order_by, partition_by)
    return rows.withColumn(out, F.when(x.isNotNull(), F.col("_run"))).drop("_run")


def rank_by(df: DataFrame, col: str, partition_by: str | None = None, out: str = "rank") -> DataFrame:
    """Descending average rank cut to an integer; NULL and NaN have no rank.

    Values are counted and ordered in their own type (long, decimal, text, date), the counts accumulated over the ordered
    distinct values, and the rank attached back by value: what lies above a value is the total less what lies up to it.
    """
    keys = [partition_by] if partition_by else []
    df = df.withColumn(col, present(df, col))
    there = df.where(quoted(col).isNotNull())
    counts = materialize(there.groupBy(*[quoted(k) for k in keys], quoted(col)).agg(F.count(F.lit(1)).alias("_n")))
    upto = global_prefix(counts, F.col("_n"), "_upto", col, keys or None)
    if keys:
        totals = counts.groupBy(quoted(partition_by).alias("_part")).agg(F.sum("_n").alias("_all"))
        upto = upto.join(totals, quoted(partition_by).eqNullSafe(F.col("_part"))).drop("_part")
    else:
        upto = upto.withColumn("_all", scalar_row(counts.agg(F.sum("_n").alias("n")))["n"])
    average = F.col("_all") - F.col("_upto") + (F.col("_n") + 1) / 2
    ranks = upto.select(*[quoted(k) for k in keys], quoted(col), "_n", F.floor(average).alias(out))
    ranked = attach(there, ranks, [*keys, col], weight="_n", how="inner").drop("_n")
    return ranked.unionByName(df.where(quoted(col).isNull()).withColumn(out, F.lit(None).cast("long")))


def rolling_stats(df: DataFrame, col: str, window: int, order_by: Keys, partition_by: Keys | None = None) -> DataFrame:
    """Rolling mean and sample deviation over ``window`` rows with one-sigma bands; NULL until the frame is full."""
    rows, w = with_halo(df, window - 1, order_by, partition_by)
    x = as_double(quoted(col))
    frame = w.rowsBetween(-(window - 1), 0)
    full = F.count(x).over(frame) == window
    rows = rows.withColumn("rolling_mean", F.when(full, F.avg(x).over(frame))).withColumn(
        "rolling_std", F.when(full, F.stddev_samp(x).over(frame))
    )
    return drop_halo(rows).withColumn("upper", F.col("rolling_mean") + F.col("rolling_std")).withColumn(
        "lower", F.col("rolling_mean") - F.col("rolling_std")
    )


def _with_previous(df: DataFrame, value: Column, order_by: Keys, partition_by: Keys | None) -> DataFrame:
    rows, w = with_halo(df, 1, order_by, partition_by)
    return drop_halo(rows.withColumn("_prev", F.lag(value).over(w)))


def diff(df: DataFrame, col: str, order_by: Keys, partition_by: Keys | None = None, out: str = "difference") -> DataFrame:
    """Difference from the previous row."""
    x = as_double(quoted(col))
    return _with_previous(df, x, order_by, partition_by).withColumn(out, x - F.col("_prev")).drop("_prev")


def growth_rate(df: DataFrame, col: str, order_by: Keys, partition_by: Keys | None = None) -> DataFrame:
    """Percent change between consecutive non-null rows; NULL on a zero base (not infinite)."""
    x = as_double(quoted(col))
    rows = _with_previous(df.where(x.isNotNull()), x, order_by, partition_by)
    change = F.try_divide(x - F.col("_prev"), F.col("_prev")) * 100
    return rows.withColumn("growth_pct", change).drop("_prev")


def growth_summary(df: DataFrame, col: str, order_by: Keys) -> DataFrame:
    """(mean_growth, positive_pct, pattern): share of growing periods, labelled above 70 % and below 30 %."""
    t = growth_rate(df, col, order_by).agg(
        F.avg("growth_pct").alias("mean_growth"),
        (F.avg(F.when(F.col("growth_pct").isNotNull(), (F.col("growth_pct") > 0).cast("int"))) * 100).alias("positive_pct"),
    )
    p = F.col("positive_pct")
    label = F.when(p > 70, "Consistently growing").when(p < 30, "Consistently declining").otherwise("Mixed growth pattern")
    return t.withColumn("pattern", label)


def fill_forward(df: DataFrame, col: str, order_by: Keys, partition_by: Keys | None = None) -> DataFrame:
    """Replace NULLs by the last value before them."""
    return _fill(df, col, order_by, partition_by, forward=True)


def fill_backward(df: DataFrame, col: str, order_by: Keys, partition_by: Keys | None = None) -> DataFrame:
    """Replace NULLs by the next value after them."""
    return _fill(df, col, order_by, partition_by, forward=False)


def _fill(df: DataFrame, col: str, order_by: Keys, partition_by: Keys | None, forward: bool) -> DataFrame:
    p = OrderedPass(df, order_by, partition_by)
    x = present(df, col)
    position = F.struct(*[quoted(k) for k in p.order])
    known = F.when(x.isNotNull(), position)
    pick = F.max_by(x, known) if forward else F.min_by(x, known)
    totals = p.subtotals(_edge=pick)
    side = p.bucket_window(forward)
    carried = F.last("_edge", ignorenulls=True).over(side)
    rows = p.carry(totals, _in=carried)
    # backward is forward in the opposite order: a frame that only grows is carried along in one pass
    way = p.window if forward else p.opposite
    inside = F.last(x, ignorenulls=True).over(way.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(col, F.coalesce(inside, F.col("_in"))).drop("_in", BUCKET)


def is_monotonic(df: DataFrame, col: str, order_by: Keys) -> DataFrame:
    """(increasing, decreasing): whether no value is below (above) the one before it."""
    x = quoted(col)
    rows = _with_previous(df.where(x.isNotNull()), x, order_by, None)
    return rows.agg(
        F.coalesce(F.bool_and(x >= F.col("_prev")), F.lit(True)).alias("increasing"),
        F.coalesce(F.bool_and(x <= F.col("_prev")), F.lit(True)).alias("decreasing"),
    )


def first_last_trend(df: DataFrame, cols: Sequence[str], order_by: str) -> DataFrame:
    """(column, first_value, last_value, direction) from the first and last row of the order; no window needed."""
    ord_ = quoted(order_by)
    ends = []
    for i, c in enumerate(cols):
        x = as_double(quoted(c))
        ends += [F.min(F.struct(ord_.alias("o"), x.alias("v"))).alias(f"a{i}"), F.max(F.struct(ord_.alias("o"), x.alias("v"))).alias(f"b{i}")]
    wide = df.agg(*ends)
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"), F.col(f"a{i}.v").alias("first_value"), F.col(f"b{i}.v").alias("last_value")
            )
            for i, c in enumerate(cols)
        ]
    )
    t = wide.select(F.explode(entries).alias("e")).select("e.*")
    up = F.when(F.col("last_value") > F.col("first_value"), F.lit("increased")).otherwise(F.lit("decreased"))
    return t.withColumn("direction", up)


def drop_duplicates(df: DataFrame, order_by: Keys | None = None, keep: str = "first", subset: Sequence[str] | None = None) -> DataFrame:
    """Distinct rows, or with ``subset`` the first/last row (by ``order_by``) of each key.

    A map-side combined extreme of (order, row) does it without ranking any group.
    """
    if not subset:
        return df.distinct()
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    packed = F.struct(*[quoted(k).alias(f"_o{i}") for i, k in enumerate(order)], F.struct(*[quoted(c) for c in df.columns]).alias("row"))
    pick = F.min(packed) if keep == "first" else F.max(packed)
    return df.groupBy(*[quoted(c) for c in subset]).agg(pick.alias("_p")).select("_p.row.*")
