"""Per-column statistics for many columns at once.

Two shapes cover most operators:

* *wide*: one fused aggregate over all columns (counts, moments, extremes), turned
  into one row per column afterwards;
* *long*: rows unpivoted to (column, value), counted per value in one map-side
  combined shuffle; distinct counts, modes, entropies and samples are read from it.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from sondage.functions.columns import as_double, kurt_g2, quoted, skew_g1, type_of
from sondage.plans.joins import attach, scalar_row
from sondage.plans.ordering import global_prefix
from sondage.session import materialize, settings

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTION = (T.FloatType, T.DoubleType)


def no_columns(df: DataFrame) -> DataFrame:
    """The table with one empty number, for results about no column at all: made for it and emptied, they have the right schema."""
    return df.withColumn(_NONE, F.lit(None).cast("double"))


_NONE = "_no_column"


def wide_to_long(one_row_per_group: DataFrame, cols: Sequence[str], fields: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Turn ``<i>_<field>`` columns of a wide aggregate into one row per column ``cols[i]``."""
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"), *[F.col(f"_{i}_{f}").alias(f) for f in fields])
            for i, c in enumerate(cols)
        ]
    )
    keys = [quoted(b) for b in by]
    return one_row_per_group.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.*")


def fused(df: DataFrame, cols: Sequence[str], aggs: Mapping[str, object], by: Sequence[str] = ()) -> DataFrame:
    """Run ``aggs`` (field -> function of a Column) on every column in one aggregate; one row per column."""
    if not cols:
        return fused(no_columns(df), [_NONE], aggs, by).where(F.lit(False))
    exprs = [make(quoted(c)).alias(f"_{i}_{field}") for i, c in enumerate(cols) for field, make in aggs.items()]
    wide = df.groupBy(*[quoted(b) for b in by]).agg(*exprs) if by else df.agg(*exprs)
    return wide_to_long(wide, cols, list(aggs), by)


# ------------------------------------------------------------------ long form


def _slots(df: DataFrame, name: str) -> tuple[Column, Column, Column]:
    """A value as (whole, fraction, text), two of them NULL: numbers are counted without being printed."""
    dtype, c = type_of(df, name), quoted(name)
    none_l, none_d, none_s = F.lit(None).cast("long"), F.lit(None).cast("double"), F.lit(None).cast("string")
    if isinstance(dtype, _WHOLE):
        return c.cast("long"), none_d, none_s
    if isinstance(dtype, _FRACTION):
        return none_l, as_double(c) + F.lit(0.0), none_s
    return none_l, none_d, c.cast("string")


def value_counts_long(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by.., column, whole, fraction, text, n): how often each non-null value occurs in each column."""
    if not cols:
        return value_counts_long(no_columns(df), [_NONE], by).where(F.lit(False))
    entries = []
    for c in cols:
        whole, fraction, text = _slots(df, c)
        entries.append(F.struct(F.lit(c).alias("column"), whole.alias("whole"), fraction.alias("fraction"), text.alias("text")))
    keys = [quoted(b) for b in by]
    cells = df.select(*keys, F.explode(F.array(*entries)).alias("e")).select(*keys, "e.*")
    present = cells.where(F.col("whole").isNotNull() | F.col("fraction").isNotNull() | F.col("text").isNotNull())
    return present.groupBy(*keys, "column", "whole", "fraction", "text").agg(F.count(F.lit(1)).alias("n"))


def digest_counts_long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, d1, d2, n): how often each non-null value occurs, the value known by its 128-bit digest.

    For figures that need no value shown: 16 bytes of a value are shuffled, however long its text.
    """
    if not cols:
        return digest_counts_long(no_columns(df), [_NONE]).where(F.lit(False))
    entries = []
    for c in cols:
        whole, fraction, text = _slots(df, c)
        value = whole if isinstance(type_of(df, c), _WHOLE) else fraction if isinstance(type_of(df, c), _FRACTION) else text
        entries.append(
            F.when(value.isNotNull(), F.struct(F.lit(c).alias("column"), F.xxhash64(value).alias("d1"), F.xxhash64(F.lit(1), value).alias("d2")))
        )
    cells = df.select(F.explode(F.array(*entries)).alias("e")).where(F.col("e").isNotNull()).select("e.*")  # array_compact would leave generated code
    return cells.groupBy("column", "d1", "d2").agg(F.count(F.lit(1)).alias("n"))


def shown() -> Column:
    """Display text of a long-form value."""
    return F.coalesce(F.col("text"), F.col("whole").cast("string"), F.col("fraction").cast("string"))


def value_order() -> Column:
    """Sort key of a long-form value: numbers by size, text alphabetically."""
    return F.struct("whole", "fraction", "text")


def columns_frame(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, position) of the given columns, as a DataFrame without touching data."""
    if not cols:
        return columns_frame(df, [_NONE]).where(F.lit(False))
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(i).alias("position")) for i, c in enumerate(cols)])
    return df.sparkSession.range(1).select(F.explode(entries).alias("e")).select("e.*")


def distinct_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, nunique, mode, mode_n, rare, entropy, n): everything the value counts say about a column.

    The mode is the smallest of the most frequent values; ``rare`` the largest of the least
    frequent; entropy uses natural logs and the 1e-10 guard.  Two map-side combined aggregates.
    """
    counts = value_counts_long(df, cols)
    totals = fused(df, cols, {"total": lambda c: F.count(c)})  # one row per column
    joined = counts.join(F.broadcast(totals.select("column", "total")), "column")
    p = F.col("n") / F.col("total")
    stats = joined.groupBy("column").agg(
        F.count(F.lit(1)).alias("nunique"),
        F.min(F.struct((-F.col("n")).alias("k"), value_order().alias("v"), shown().alias("s"))).alias("top"),
        F.max(F.struct((-F.col("n")).alias("k"), value_order().alias("v"), shown().alias("s"))).alias("low"),
        (-F.sum(p * F.ln(p + 1e-10))).alias("entropy"),
    )
    return columns_frame(df, cols).join(F.broadcast(stats), "column", "left").select(
        "column",
        "position",
        F.coalesce("nunique", F.lit(0).cast("long")).alias("nunique"),
        F.col("top.s").alias("mode"),
        (-F.col("top.k")).alias("mode_n"),
        F.col("low.s").alias("rare"),
        F.coalesce("entropy", F.lit(0.0)).alias("entropy"),
    )


# ------------------------------------------------------------------ order statistics


def use_sketch(df: DataFrame) -> bool:
    """True when the table is counted to be small enough for one in-memory value map per group."""
    limit = settings(df.sparkSession).sketch_rows
    return limit > 0 and df.count() <= limit


def q_name(q: float) -> str:
    return "q" + f"{q:.6f}".rstrip("0").rstrip(".").replace(".", "_")


def quantiles_long(
    df: DataFrame, cols: Sequence[str], qs: Sequence[float], by: Sequence[str] = (), accuracy: int | None = None
) -> DataFrame:
    """(by.., column, position, q0_25, ...): linear-interpolated quantiles of every column and group.

    ``accuracy`` switches to ``approx_percentile``.  Otherwise the result is exact: by the
    built-in ``percentile`` while the table is counted to fit one value map, else by
    :func:`_sliced_quantiles` or, in groups, :func:`_ranked_quantiles`, which never gather a group.
    """
    names = [q_name(q) for q in qs]
    if not cols:
        return quantiles_long(no_columns(df), [_NONE], qs, by, accuracy).where(F.lit(False))
    if accuracy is not None or use_sketch(df):
        probs = F.array(*[F.lit(float(q)) for q in qs])
        if accuracy is not None:
            make = lambda c: F.approx_percentile(as_double(c), probs, F.lit(accuracy))
        else:
            make = lambda c: F.percentile(as_double(c), probs)
        table = fused(df, cols, {"q": make}, by)
        return table.select(
            *[quoted(b) for b in by], "column", "position", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(names)]
        )
    if not by and len(cols) * len(qs) <= _SLICES:
        return _sliced_quantiles(df, cols, qs)
    return _ranked_quantiles(df, cols, qs, by)


#: Most order statistics found by slices, rows sampled for the slices' ends, and how far these are from the wanted share.
_SLICES, _SAMPLED, _MARGIN = 400, 1_000_000, 0.005


def _sliced_quantiles(df: DataFrame, cols: Sequence[str], qs: Sequence[float]) -> DataFrame:
    """Exact quantiles of whole columns without ordering them.

    A sample says between which two values each quantile lies, one pass counts what is below and inside, and only the values of
    these slices (about a hundredth of the rows for each quantile) are counted and placed by :func:`global_prefix`. A slice that
    the counts prove to miss its quantile becomes the whole column. The driver sees a few numbers for each column and quantile.
    """
    spark, inf = df.sparkSession, math.inf
    slim = df.select(*[as_double(quoted(c)).alias(f"_x{i}") for i, c in enumerate(cols)])
    share = min(1.0, _SAMPLED / max(df.count(), 1))
    shares = F.array(*[F.lit(min(1.0, max(0.0, q + side))) for q in qs for side in (-_MARGIN, _MARGIN)])
    ends = (slim if share >= 1.0 else slim.sample(share, seed=42)).agg(*[F.approx_percentile(f"_x{i}", shares).alias(f"e{i}") for i in range(len(cols))]).first()
    slices: list[list[tuple[float, float]]] = []
    for i in range(len(cols)):
        own: list[tuple[float, float]] = []
        for j, q in sorted(enumerate(qs), key=lambda x: x[1]):
            low = -inf if ends[i] is None or q <= _MARGIN else ends[i][2 * j]
            high = inf if ends[i] is None or q >= 1 - _MARGIN else ends[i][2 * j + 1]
            if own and low <= own[-1][1]:
                own[-1] = (own[-1][0], max(high, own[-1][1]))
            else:
                own.append((low, high))
        slices.append(own)
    counts = []
    for i, own in enumerate(slices):
        x = F.col(f"_x{i}")
        counts.append(F.count(x).alias(f"n{i}"))
        for k, (low, high) in enumerate(own):
            counts += [F.count_if(x < F.lit(low)).alias(f"b{i}_{k}"), F.count_if(x <= F.lit(high)).alias(f"u{i}_{k}")]
    known = slim.agg(*counts).first()
    wanted: dict[tuple[int, int], tuple[int, int, int]] = {}  # (column, quantile) -> slice and the two places in it
    ranges: list[tuple[int, float, float]] = []
    for i, own in enumerate(slices):
        total, places = known[f"n{i}"], {}
        if not total:
            continue
        for j, q in enumerate(qs):
            at = float(q) * (total - 1)
            lo, hi = math.floor(at), math.ceil(at)
            inside = [k for k in range(len(own)) if known[f"b{i}_{k}"] <= lo and hi < known[f"u{i}_{k}"]]
            places[j] = (inside[0] if inside else None, lo, hi)
        if any(k is None for k, _, _ in places.values()):
            ranges.append((i, -inf, inf))
            wanted |= {(i, j): (len(ranges) - 1, lo, hi) for j, (_, lo, hi) in places.items()}
            continue
        first = len(ranges)
        ranges += [(i, low, high) for low, high in own]
        wanted |= {(i, j): (first + k, lo - known[f"b{i}_{k}"], hi - known[f"b{i}_{k}"]) for j, (k, lo, hi) in places.items()}
    found: dict[tuple[int, int], tuple[float, float]] = {}
    if ranges:
        cells = []
        for i in sorted({i for i, _, _ in ranges}):  # the slices of a column are apart
            own = F.lit(None).cast("int")
            for r, (_, low, high) in [(r, x) for r, x in enumerate(ranges) if x[0] == i]:
                own = F.when(F.col(f"_x{i}").between(low, high), F.lit(r)).otherwise(own)
            cells.append(F.struct(own.alias("slice"), F.col(f"_x{i}").alias("value")))
        held = slim.select(F.explode(F.array(*cells)).alias("e")).select("e.*").where("slice IS NOT NULL")
        held = held.groupBy("slice", "value").agg(F.count(F.lit(1)).alias("n"))
        placed = global_prefix(materialize(held), F.col("n"), "upto", order_by="value", partition_by="slice")
        picks = []
        for (i, j), (r, *ends_in) in wanted.items():
            for side, pos in zip(("lo", "hi"), ends_in):
                covers = (F.col("slice") == r) & (F.col("upto") > pos) & (F.col("upto") - F.col("n") <= pos)
                picks.append(F.max(F.when(covers, F.col("value"))).alias(f"{side}{i}_{j}"))
        at_places = placed.agg(*picks).first()
        found = {(i, j): (at_places[f"lo{i}_{j}"], at_places[f"hi{i}_{j}"]) for i, j in wanted}
    columns: dict[str, list] = {"column": list(cols), "position": list(range(len(cols)))}
    for j, q in enumerate(qs):
        values = []
        for i in range(len(cols)):
            at = float(q) * (known[f"n{i}"] - 1)
            lo, hi = found.get((i, j), (None, None))
            part = at - math.floor(at)
            if lo is None or lo == hi:
                values.append(lo)
            else:  # beside an infinity the difference would be no number
                values.append(lo + (hi - lo) * part if math.isfinite(hi - lo) else (1 - part) * lo + part * hi)
        columns[q_name(q)] = values
    kinds = [("column", pa.string()), ("position", pa.int32()), *[(q_name(q), pa.float64()) for q in dict.fromkeys(qs)]]
    return spark.createDataFrame(pa.table(columns, schema=pa.schema(kinds)))


def _ranked_quantiles(df: DataFrame, cols: Sequence[str], qs: Sequence[float], by: Sequence[str]) -> DataFrame:
    """Exact quantiles from value counts and their running totals.

    Equal values are merged before the shuffle, the running total is a bucketed prefix sum
    (a group may span many buckets), and only the two order statistics next to each
    quantile leave the last aggregate.
    """
    keys = [quoted(b) for b in by]
    groups = [*by, "column"]
    entries = F.array(*[F.struct(F.lit(c).alias("column"), as_double(quoted(c)).alias("value")) for c in cols])
    cells = df.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.*").where(F.col("value").isNotNull())
    counts = materialize(cells.groupBy(*keys, "column", "value").agg(F.count(F.lit(1)).alias("n")))
    running = global_prefix(counts, F.col("n"), "upto", order_by="value", partition_by=groups)
    totals = counts.groupBy(*keys, "column").agg(F.sum("n").alias("total"))
    placed = attach(running, totals, groups, how="inner")
    picks = []
    for q, name in zip(qs, [q_name(q) for q in qs]):
        at = F.lit(float(q)) * (F.col("total") - 1)
        for side, pos in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            covers = (F.col("upto") > pos) & (F.col("upto") - F.col("n") <= pos)
            picks.append(F.max(F.when(covers, F.col("value"))).alias(f"{name}_{side}"))
    found = placed.groupBy(*keys, "column").agg(F.max("total").alias("total"), *picks)
    out = []
    for q, name in zip(qs, [q_name(q) for q in qs]):
        at = F.lit(float(q)) * (F.col("total") - 1)
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        out.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    result = found.select(*keys, "column", *out)
    if by:
        # every (group, column) pair appears, as it does in the fused aggregate
        shells = df.select(*keys).distinct().select(*keys, F.explode(_positions(cols)).alias("e")).select(*keys, "e.*")
        renamed = result.withColumnsRenamed({"column": "_c", **{b: f"_b{i}" for i, b in enumerate(by)}})
        cond = F.col("column") == F.col("_c")
        for i, b in enumerate(by):
            cond = cond & quoted(b).eqNullSafe(F.col(f"_b{i}"))
        return shells.join(renamed, cond, "left").drop("_c", *[f"_b{i}" for i in range(len(by))])
    return columns_frame(df, cols).join(F.broadcast(result), "column", "left").select("column", "position", *[q_name(q) for q in qs])


def _positions(cols: Sequence[str]) -> Column:
    return F.array(*[F.struct(F.lit(c).alias("column"), F.lit(i).alias("position")) for i, c in enumerate(cols)])


# What each reported moment needs from the aggregate, and how it follows from it.
_RAW = {
    "n": F.count,
    "rows": lambda c: F.count(F.lit(1)),
    "total": F.sum,
    "var_pop": F.var_pop,
    "low": F.min,
    "high": F.max,
    "skew_pop": F.skewness,
    "kurt_pop": F.kurtosis,
}
_NEEDS = {
    "n": ("n",), "missing": ("rows", "n"), "total": ("total",), "mean": ("total", "n"), "std": ("var_pop", "n"),
    "std_pop": ("var_pop",), "variance": ("var_pop", "n"), "low": ("low",), "high": ("high",),
    "skew": ("skew_pop", "var_pop", "n"), "kurt": ("kurt_pop", "var_pop", "n"),
}
MOMENTS = tuple(_NEEDS)


def _moment(field: str) -> Column:
    n, var = F.col("n").cast("double"), F.col("var_pop")
    if field == "missing":
        return F.col("rows") - F.col("n")
    if field == "mean":
        return F.try_divide(F.col("total"), n)
    if field == "std_pop":
        return F.sqrt(var)
    sample = F.when(n > 1, var * n / F.nullif(n - 1, F.lit(0.0)))
    if field == "variance":
        return sample
    if field == "std":
        return F.sqrt(sample)
    if field == "skew":
        return skew_g1(F.col("skew_pop"), n, var)
    if field == "kurt":
        return kurt_g2(F.col("kurt_pop"), n, var)
    return F.col(field)


def numeric_base(
    df: DataFrame,
    cols: Sequence[str],
    qs: Sequence[float] = (),
    by: Sequence[str] = (),
    fields: Sequence[str] = MOMENTS,
    accuracy: int | None = None,
) -> DataFrame:
    """(by.., column, position, moments.., quantiles..): one row per column (and group).

    All moments of all columns come from one aggregate over a handful of primitive sums, so
    it stays in generated code; the derived figures are computed on its few result rows.
    Quantiles are a second aggregate: ``percentile`` cannot be code-generated and would pull
    the moments out of generated code with it.
    """
    if not cols:
        return numeric_base(no_columns(df), [_NONE], qs, by, fields, accuracy).where(F.lit(False))
    keys = [quoted(b) for b in by]
    raw = list(dict.fromkeys(r for f in fields for r in _NEEDS[f]))
    slim = df.select(*keys, *[as_double(quoted(c)).alias(f"_x{i}") for i, c in enumerate(cols)])
    exprs = [_RAW[r](F.col(f"_x{i}")).alias(f"_{i}_{r}") for i in range(len(cols)) for r in raw]
    wide = slim.groupBy(*keys).agg(*exprs) if by else slim.agg(*exprs)
    table = wide_to_long(wide, cols, raw, by)
    moments = table.select(*keys, "column", "position", *[_moment(f).alias(f) for f in fields])
    if not qs:
        return moments
    ranks = quantiles_long(df, cols, qs, by, accuracy).drop("position").withColumnsRenamed(
        {"column": "_c", **{b: f"_b{i}" for i, b in enumerate(by)}}
    )
    cond = F.col("column") == F.col("_c")
    for i, b in enumerate(by):
        cond = cond & quoted(b).eqNullSafe(F.col(f"_b{i}"))
    side = ranks if by else F.broadcast(ranks)  # without groups: one row per column
    return moments.join(side, cond, "left").drop("_c", *[f"_b{i}" for i in range(len(by))])


def stats_map(table: DataFrame, cols: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One-row DataFrame with ``<column position>_<field>`` columns, for use as scalar statistics."""
    return table.agg(
        *[
            F.max(F.when(F.col("position") == i, F.col(f))).alias(f"s{i}_{f}")
            for i in range(len(cols))
            for f in fields
        ]
    )


def top_per_column(df: DataFrame, cols: Sequence[str], k: int) -> DataFrame:
    """(column, rank, value, n) for the k most frequent values; ties go to the smaller value."""
    counts = value_counts_long(df, cols)
    return top_counts(counts, k)


def top_counts(counts: DataFrame, k: int) -> DataFrame:
    """Keep the k most frequent values of each column.

    The rank filter lets Spark keep only k rows per column in every task before the
    shuffle (window group limit), so no task ranks all values of a column.
    """
    w = Window.partitionBy("column").orderBy(F.col("n").desc(), value_order().asc())
    ranked = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.withColumn("value", shown()).select("column", "rank", "value", "n")


def second_pass(
    df: DataFrame,
    cols: Sequence[str],
    stats: DataFrame,
    fields: Sequence[str],
    aggs: Mapping[str, object],
) -> DataFrame:
    """Aggregate every column against its own statistics from a first pass.

    ``stats`` has one row per column (``position`` and ``fields``); it reaches the rows as a
    scalar subquery.  Each aggregate is a function of (value, {field: Column}).
    """
    if not cols:
        return second_pass(no_columns(df), [_NONE], stats, fields, aggs).where(F.lit(False))
    known = scalar_row(stats_map(stats, cols, fields))
    exprs = []
    for i, c in enumerate(cols):
        own = {f: known[f"s{i}_{f}"] for f in fields}
        exprs += [make(as_double(quoted(c)), own).alias(f"_{i}_{field}") for field, make in aggs.items()]
    return wide_to_long(df.agg(*exprs), cols, list(aggs))


def pin(table: DataFrame) -> DataFrame:
    """Hold a schema-sized result (one row per column of some table) as a local relation.

    For statistics that took several jobs and are read by more than one later step.
    Refuses anything larger than a wide schema.
    """
    held = table.limit(100_001).toArrow()
    if held.num_rows > 100_000:
        raise ValueError("only per-column statistics may be held on the driver")
    return table.sparkSession.createDataFrame(held, schema=table.schema)
