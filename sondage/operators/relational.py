"""Projection, filtering, grouping, pivoting, top-k and ad-hoc queries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from sondage.functions.columns import as_double, atomic_columns, quoted, type_of
from sondage.plans.joins import attach, is_small, scalar_row
from sondage.plans.values import q_name, quantiles_long, wide_to_long

#: Longest list of values that becomes a literal; a longer one is joined.
_LITERALS = 200

# ------------------------------------------------------------------ projection and filters


def select_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[quoted(c) for c in cols])


def search_rows(df: DataFrame, term: str, cols: Sequence[str] | None = None, regex: bool = False) -> DataFrame:
    """Rows in which any column, printed as text, contains ``term`` ignoring case (or matches it as a regex)."""
    hit = F.lit(False)
    for c in cols or atomic_columns(df):
        text = quoted(c).cast("string")
        found = text.rlike("(?i)" + term) if regex else F.contains(F.lower(text), F.lit(term.lower()))
        hit = hit | F.coalesce(found, F.lit(False))
    return df.where(hit)


def filter_in(df: DataFrame, col: str, values: Sequence | DataFrame) -> DataFrame:
    """Rows whose value is in a list, or in the first column of a DataFrame (semi join)."""
    if isinstance(values, DataFrame):
        wanted = values.select(quoted(values.columns[0]).alias(col)).where(quoted(col).isNotNull()).distinct()
        return attach(df, wanted, [col], how="left_semi")
    values = list(values)
    if len(values) > _LITERALS:
        kind = type_of(df, col)
        wanted = df.sparkSession.createDataFrame([(v,) for v in values if v is not None], T.StructType([T.StructField(col, kind)]))
        return attach(df, wanted.distinct(), [col], how="left_semi")
    return df.where(quoted(col).isin(values))


def filter_equal(df: DataFrame, col: str, value) -> DataFrame:
    return df.where(quoted(col) == F.lit(value))


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*cols)


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.withColumnRenamed(old, new)


def reorder_columns(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Listed columns first, the others after them in their old order."""
    return df.select(*[quoted(c) for c in [*order, *[c for c in df.columns if c not in order]]])


def derive(df: DataFrame, name: str, op: str, a: str, b: str | None = None) -> DataFrame:
    """Add ``a op b`` (+ - * /) or ``log``/``sqrt`` of ``a``.

    Division by zero and the log of zero are NULL; the log of a negative is NULL too;
    the root is taken of max(a, 0).
    """
    x = as_double(quoted(a))
    if op in ("log", "sqrt"):
        y = F.when(x > 0, F.ln(x)) if op == "log" else F.when(x.isNotNull(), F.sqrt(F.greatest(x, F.lit(0.0))))
    else:
        z = as_double(quoted(b))
        y = {"+": lambda: x + z, "-": lambda: x - z, "*": lambda: x * z, "/": lambda: F.try_divide(x, z)}[op]()
    return df.withColumn(name, y)


def drop_nulls(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """Complete cases over ``subset``."""
    return df.na.drop(subset=list(subset))


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], variable: str = "variable", value: str = "value") -> DataFrame:
    """Wide to long; numeric value columns are brought to one type first."""
    kinds = {type_of(df, c) for c in values}
    common = None if len(kinds) == 1 else ("string" if T.StringType() in kinds else "double")
    cols = [quoted(c) if common is None else quoted(c).cast(common).alias(c) for c in values]
    return df.select(*[quoted(i) for i in ids], *cols).unpivot(list(ids), list(values), variable, value)


def convert(df: DataFrame, col: str, to: str, truthy: bool = False) -> DataFrame:
    """Convert a column to integer, float, text, date, category or boolean; unreadable values become NULL.

    A column that holds fractions, as numbers or as text, cannot become integer and raises. Whole numbers of any size that a
    long holds are kept exactly. Deviations from the usual dataframe library: NULL stays NULL as text, and booleans are read from words (``truthy=True`` treats any non-empty value as true, NULL included).
    """
    c = quoted(col)
    if to == "integer":
        number = as_double(c.try_cast("double"))
        exact = c.try_cast("long")
        if isinstance(type_of(df, col), (T.FloatType, T.DoubleType, T.DecimalType, T.StringType)):
            if not df.where(exact.isNull() | (number != F.floor(number))).where(number != F.floor(number)).isEmpty():
                raise ValueError(f"column '{col}' holds fractions and cannot become integer")
        whole = F.when(number == F.floor(number), number.try_cast("long"))
        new = F.coalesce(exact, whole) if not isinstance(type_of(df, col), (T.FloatType, T.DoubleType)) else whole
    elif to == "float":
        new = as_double(c.try_cast("double"))
    elif to in ("text", "category"):
        new = c.cast("string")
    elif to == "date":
        new = c.try_cast("timestamp_ntz")
    elif to == "boolean":
        if truthy:
            filled = F.length(c.cast("string")) > 0 if isinstance(type_of(df, col), T.StringType) else c.cast("double") != 0
            new = F.coalesce(filled, F.lit(True))
        else:
            word = F.lower(F.trim(c.cast("string")))
            yes = word.isin("yes", "y", "true", "t", "1", "1.0")
            no = word.isin("no", "n", "false", "f", "0", "0.0")
            new = F.when(yes, F.lit(True)).when(no, F.lit(False))
    else:
        raise ValueError(f"unknown target type '{to}'")
    return df.withColumn(col, new)


def cap_categories(df: DataFrame, col: str, k: int = 20, other: str = "Other") -> DataFrame:
    """Keep the k most frequent values (ties to the smaller), turn the rest into ``other``; k rows are broadcast."""
    top = value_counts(df.select(quoted(col).cast("string").alias("_v")), "_v", k).select(F.col("_v").alias("_keep"))
    kept = df.join(F.broadcast(top), quoted(col).cast("string") == F.col("_keep"), "left")
    value = F.when(quoted(col).isNull(), F.lit(None)).otherwise(F.coalesce("_keep", F.lit(other)))
    return kept.withColumn(col, value).drop("_keep")


# ------------------------------------------------------------------ grouping

_SIMPLE = {
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0)),
    "mean": F.avg,
    "count": F.count,
    "max": F.max,
    "min": F.min,
    "std": F.stddev_samp,
    "var": F.var_samp,
}


def group_agg(df: DataFrame, by: str | Sequence[str], value: str, fn: str) -> DataFrame:
    """One aggregate per group: sum, mean, count, max, min, median, std or var.  Rows with a NULL key are dropped."""
    keys = [by] if isinstance(by, str) else list(by)
    present = df.na.drop(subset=keys)
    if fn == "median":
        q = quantiles_long(present, [value], [0.5], keys)
        return q.select(*[quoted(k) for k in keys], F.col(q_name(0.5)).alias(f"median_{value}"))
    return present.groupBy(*[quoted(k) for k in keys]).agg(_SIMPLE[fn](as_double(quoted(value))).alias(f"{fn}_{value}"))


def pivot_table(
    df: DataFrame, index: str, values: str, fn: str = "mean", columns: str | None = None, levels: Sequence | None = None
) -> DataFrame:
    """Aggregate ``values`` per ``index``, spread over the values of ``columns`` when given."""
    if columns is None:
        return group_agg(df, index, values, fn)
    present = df.na.drop(subset=[index, columns])
    cells = group_agg(present, [index, columns], values, fn)
    grouped = cells.groupBy(quoted(index))
    spread = grouped.pivot(columns, list(levels)) if levels else grouped.pivot(columns)
    return spread.agg(F.first(f"{fn}_{values}", ignorenulls=True))


def group_multi(df: DataFrame, by: str, value: str) -> DataFrame:
    """count, mean and sum per group."""
    x = as_double(quoted(value))
    return (
        df.na.drop(subset=[by])
        .groupBy(quoted(by))
        .agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.coalesce(F.sum(x), F.lit(0.0)).alias("sum"))
    )


def group_tables(df: DataFrame, cats: Sequence[str], nums: Sequence[str]) -> DataFrame:
    """(category, level, column, count, mean, sum): every number in the groups of every category, from one aggregate over all rows."""
    if not cats or not nums:
        return df.sparkSession.createDataFrame([], "category string, level string, column string, count long, mean double, sum double")
    levels = F.array(*[F.struct(F.lit(c).alias("category"), quoted(c).cast("string").alias("level")) for c in cats])
    rows = df.select(F.explode(levels).alias("_e"), *[as_double(quoted(c)).alias(f"_x{i}") for i, c in enumerate(nums)])
    rows = rows.select("_e.*", *[f"_x{i}" for i in range(len(nums))]).where(F.col("level").isNotNull())
    aggs = []
    for i in range(len(nums)):
        x = F.col(f"_x{i}")
        aggs += [F.count(x).alias(f"_{i}_count"), F.avg(x).alias(f"_{i}_mean"), F.coalesce(F.sum(x), F.lit(0.0)).alias(f"_{i}_sum")]
    wide = rows.groupBy("category", "level").agg(*aggs)
    return wide_to_long(wide, nums, ["count", "mean", "sum"], ["category", "level"]).drop("position")


def top_groups_by_mean(df: DataFrame, cat: str, num: str, n: int = 10) -> DataFrame:
    return group_agg(df, cat, num, "mean").orderBy(F.desc_nulls_last(f"mean_{num}"), quoted(cat)).limit(n)


def value_counts(df: DataFrame, col: str, k: int | None = None) -> DataFrame:
    """(value, count), most frequent first, ties by value."""
    counts = df.where(quoted(col).isNotNull()).groupBy(quoted(col)).agg(F.count(F.lit(1)).alias("count"))
    ordered = counts.orderBy(F.desc("count"), quoted(col))
    return ordered.limit(k) if k is not None else ordered


def frequency_table(df: DataFrame, col: str) -> DataFrame:
    """count, percentage (2 dp) and cumulative percentage (running sum of the rounded percentages).

    The running sum goes over value groups; for a column with more values than may be
    broadcast it is done in order buckets instead of one task.
    """
    counts = df.where(quoted(col).isNotNull()).groupBy(quoted(col)).agg(F.count(F.lit(1)).alias("count"))
    total = scalar_row(df.agg(F.count(quoted(col)).alias("n")))["n"]
    shares = counts.withColumn("percentage", F.round(F.col("count") / total * 100, 2))
    if is_small(counts):
        w = Window.orderBy(F.desc("count"), quoted(col)).rowsBetween(Window.unboundedPreceding, 0)
        return shares.withColumn("cumulative", F.round(F.sum("percentage").over(w), 2))
    from sondage.plans.ordering import global_prefix

    ranked = global_prefix(shares.withColumn("_neg", -F.col("count")), F.col("percentage"), "cumulative", ["_neg", col])
    return ranked.withColumn("cumulative", F.round("cumulative", 2)).drop("_neg")


def crosstab(df: DataFrame, r: str, c: str, wide: bool = False, zeros: bool = False) -> DataFrame:
    """Counts of the (r, c) value pairs that occur; rows with a NULL in either are dropped.

    ``zeros`` adds the pairs that do not occur, from the product of both columns' distinct values. ``wide`` makes every value of
    ``c`` a column (which implies them): the levels of ``c`` are then gathered, as they become the width of the result.
    """
    pairs = df.na.drop(subset=[r, c]).groupBy(quoted(r), quoted(c).cast("string").alias(c)).agg(F.count(F.lit(1)).alias("count"))
    if not (wide or zeros):
        return pairs
    if wide:
        levels = [x[0] for x in pairs.select(quoted(c)).distinct().orderBy(quoted(c)).collect()]
        return pairs.groupBy(quoted(r)).pivot(c, levels).agg(F.sum("count")).na.fill(0)
    cells = pairs.select(quoted(r)).distinct().crossJoin(pairs.select(quoted(c)).distinct())
    empty = cells.select(quoted(r), quoted(c), F.lit(0).cast("long").alias("count"))
    return empty.unionByName(pairs).groupBy(quoted(r), quoted(c)).agg(F.sum("count").alias("count"))


def counts_over_time(df: DataFrame, date: str, cat: str) -> DataFrame:
    return df.na.drop(subset=[date, cat]).groupBy(quoted(date), quoted(cat)).agg(F.count(F.lit(1)).alias("count"))


def category_sums(
    df: DataFrame, cat: str, num: str, positive_only: bool = False, k: int | None = None, color: str | None = None
) -> DataFrame:
    """Sum of ``num`` per category (and colour), largest first; optionally only positive sums or the first k."""
    keys = [cat] if color is None else [cat, color]
    out = group_agg(df, keys, num, "sum").withColumnRenamed(f"sum_{num}", "total")
    if positive_only:
        out = out.where(F.col("total") > 0)
    return out if k is None else out.orderBy(F.desc_nulls_last("total"), *[quoted(x) for x in keys]).limit(k)


def group_extremes(df: DataFrame, cat: str, num: str) -> DataFrame:
    """(best, best_mean, worst, worst_mean, gap_pct, flagged): groups with the highest and lowest mean.

    The gap is relative to max(|lowest|, 0.01) and flagged above 20 %.  Ties go to the smaller label.
    """
    means = group_agg(df, cat, num, "mean").where(F.col(f"mean_{num}").isNotNull())
    m, label = F.col(f"mean_{num}"), quoted(cat)
    ends = means.agg(
        F.min(F.struct((-m).alias("k"), label.alias("g"))).alias("hi"),
        F.min(F.struct(m.alias("k"), label.alias("g"))).alias("lo"),
        F.count(F.lit(1)).alias("groups"),
    )
    gap = F.abs(-F.col("hi.k") - F.col("lo.k")) / F.greatest(F.abs(F.col("lo.k")), F.lit(0.01)) * 100
    return ends.where(F.col("groups") > 1).select(
        F.col("hi.g").alias("best"),
        (-F.col("hi.k")).alias("best_mean"),
        F.col("lo.g").alias("worst"),
        F.col("lo.k").alias("worst_mean"),
        gap.alias("gap_pct"),
        (gap > 20).alias("flagged"),
    )


# ------------------------------------------------------------------ sorts, limits, samples

_SAMPLE_PREFILTER = 16


def top_n(df: DataFrame, col: str, n: int = 10, ascending: bool = False, tie: str | None = None, select: Sequence[str] | None = None) -> DataFrame:
    """First n rows by a column (NULLs last); ``tie`` makes the choice among equals definite."""
    order = quoted(col).asc_nulls_last() if ascending else quoted(col).desc_nulls_last()
    out = df.orderBy(order, *([quoted(tie)] if tie else [])).limit(n)
    return out.select(*[quoted(c) for c in select]) if select else out


def bottom_n(df: DataFrame, col: str, n: int = 10, ascending: bool = True, tie: str | None = None) -> DataFrame:
    return top_n(df, col, n, ascending, tie)


def head_n(df: DataFrame, n: int, order_by: str | Sequence[str]) -> DataFrame:
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    return df.orderBy(*[quoted(k) for k in keys]).limit(n)


def tail_n(df: DataFrame, n: int, order_by: str | Sequence[str]) -> DataFrame:
    """Last n rows of the order, in order."""
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    return df.orderBy(*[quoted(k).desc() for k in keys]).limit(n).orderBy(*[quoted(k) for k in keys])


def ordered_series(df: DataFrame, x: str, y: str) -> DataFrame:
    """Complete (x, y) pairs in x order (ties by y)."""
    return df.select(quoted(x), quoted(y)).na.drop().orderBy(quoted(x), quoted(y))


def sample_n(df: DataFrame, n: int, key: str | Sequence[str], seed: int = 42) -> DataFrame:
    """n rows chosen by a seeded hash of the key: the same rows under any partitioning.

    The rows are those with the n smallest hashes.  On a table much larger than n, rows whose
    hash is clearly too large are dropped first, so the final top-n gets about 4n rows in all
    rather than n from every partition; should fewer than n remain, nothing is dropped.
    """
    keys = [key] if isinstance(key, str) else list(key)
    cols = [quoted(k) for k in keys]
    h = F.xxhash64(*cols, F.lit(seed))
    rows, total = df, df.count()
    if total > _SAMPLE_PREFILTER * n:
        near = df.where(h < F.lit(int(-(2**63) + 4 * n / total * 2**64)))
        rows = near if near.count() >= n else df
    return rows.orderBy(h, *cols).limit(n)


def plot_rows(df: DataFrame, cols: Sequence[str], n: int, key: str, seed: int = 42) -> DataFrame:
    """Up to n complete sampled rows of a few columns, for point charts."""
    keep = list(dict.fromkeys([key, *cols]))
    return sample_n(df.select(*[quoted(c) for c in keep]).na.drop(), n, key, seed)


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def pct_contribution(df: DataFrame, col: str, key: str, n: int = 20) -> DataFrame:
    """(key, contribution): share of the column total per row, largest n."""
    total = scalar_row(df.agg(F.sum(as_double(quoted(col))).alias("t")))["t"]
    rows = df.select(quoted(key), (as_double(quoted(col)) / F.nullif(total, F.lit(0.0)) * 100).alias("contribution"))
    return rows.orderBy(F.desc_nulls_last("contribution"), quoted(key)).limit(n)


def waterfall(df: DataFrame, label: str, value: str, order_by: str, n: int = 12) -> DataFrame:
    """(step, label, value, measure, level): first n non-null rows as steps, the first one absolute."""
    first = df.where(quoted(value).isNotNull()).select(
        quoted(order_by).alias("_o"), quoted(label).cast("string").alias("label"), as_double(quoted(value)).alias("value")
    ).orderBy("_o").limit(n)
    w = Window.orderBy("_o")  # over at most n rows
    return first.select(
        F.row_number().over(w).alias("step"),
        "label",
        "value",
        F.when(F.row_number().over(w) == 1, F.lit("absolute")).otherwise(F.lit("relative")).alias("measure"),
        F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("level"),
    )


def arg_extreme(df: DataFrame, col: str, key: str, which: str = "max") -> DataFrame:
    """(key, value) of the row holding the column's largest or smallest value; ties to the smaller key."""
    x = quoted(col)
    rows = df.where(x.isNotNull())
    if which == "max":
        best = rows.agg(F.max(x).alias("v"))
        keyed = rows.where(x == scalar_row(best)["v"])
    else:
        best = rows.agg(F.min(x).alias("v"))
        keyed = rows.where(x == scalar_row(best)["v"])
    return keyed.agg(F.min(quoted(key)).alias(key), F.min(x).alias(col))


# ------------------------------------------------------------------ two tables


def compare_tables(a: DataFrame, b: DataFrame) -> DataFrame:
    """(column, status, unique_a, unique_b, missing_a, missing_b, changed): column by column comparison."""
    from sondage.operators.profile import nunique_table

    def side(df: DataFrame, tag: str) -> DataFrame:
        return nunique_table(df).select(
            F.col("column").alias(f"column_{tag}"), F.col("nunique").alias(f"unique_{tag}"), F.col("missing").alias(f"missing_{tag}")
        )

    both = side(a, "a").join(side(b, "b"), F.col("column_a") == F.col("column_b"), "full_outer")
    common = F.col("column_a").isNotNull() & F.col("column_b").isNotNull()
    status = F.when(common, F.lit("common")).when(F.col("column_a").isNull(), F.lit("added")).otherwise(F.lit("removed"))
    differs = (F.col("unique_a") != F.col("unique_b")) | (F.col("missing_a") != F.col("missing_b"))
    return both.select(
        F.coalesce("column_a", "column_b").alias("column"),
        status.alias("status"),
        "unique_a",
        "unique_b",
        "missing_a",
        "missing_b",
        F.when(common, differs).alias("changed"),
    )


def compare_kpis(a: DataFrame, b: DataFrame) -> DataFrame:
    """(column, mean_a, mean_b, delta_pct, change) for numeric columns of both; Stable within 1 %."""
    from sondage.functions.columns import numeric_columns
    from sondage.plans.values import numeric_base

    shared = [c for c in numeric_columns(a) if c in numeric_columns(b)]
    left = numeric_base(a, shared, fields=("mean",)).select("column", F.col("mean").alias("mean_a"))
    right = numeric_base(b, shared, fields=("mean",)).select("column", F.col("mean").alias("mean_b"))
    delta = F.coalesce(F.round(F.try_divide(F.col("mean_b") - F.col("mean_a"), F.col("mean_a")) * 100, 1), F.lit(0.0))
    change = F.when(delta > 1, F.lit("Increase")).when(delta < -1, F.lit("Decrease")).otherwise(F.lit("Stable"))
    return left.join(F.broadcast(right), "column").select("column", "mean_a", "mean_b", delta.alias("delta_pct"), change.alias("change"))


# ------------------------------------------------------------------ ad-hoc queries


def sql(df: DataFrame, query: str, view: str = "dataset", **tables: DataFrame) -> DataFrame:
    """Run any SQL text over the table (and further named ones); Catalyst does the rest.

    The names exist as temporary views only while the text is analysed; views of these names from before come back.
    """
    spark, named = df.sparkSession, {view: df, **tables}
    temporary = {t.name for t in spark.catalog.listTables() if t.isTemporary}
    before = {name: spark.table(name) for name in named if name in temporary}
    for name, table in named.items():
        table.createOrReplaceTempView(name)
    try:
        return spark.sql(query)
    finally:
        for name in named:
            spark.catalog.dropTempView(name)
            if name in before:
                before[name].createOrReplaceTempView(name)


def expr_query(
    df: DataFrame,
    select: Sequence[str] | None = None,
    where: str | None = None,
    group_by: Sequence[str] | None = None,
    aggs: Mapping[str, str] | None = None,
    order_by: Sequence[str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Projection, filter, aggregation and sort given as expression strings.

    ``aggs`` maps result names to aggregate expressions; an order item may end in ``desc``.
    """
    out = df.where(where) if where else df
    if aggs:
        columns = [F.expr(e).alias(n) for n, e in aggs.items()]
        out = out.groupBy(*[F.expr(g) for g in group_by or []]).agg(*columns)
    if select:
        out = out.selectExpr(*select)
    if order_by:
        out = out.orderBy(*[_order_item(o) for o in order_by])
    return out.limit(limit) if limit is not None else out


def _order_item(text: str) -> Column:
    if text.lower().endswith(" desc"):
        return F.expr(text[:-5]).desc_nulls_last()
    return F.expr(text[:-4] if text.lower().endswith(" asc") else text).asc_nulls_last()


# ------------------------------------------------------------------ text to dates

# Month names (full or three letters) and the four date notations read from text.
_MONTHS = [
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
]
_DATE_NOTATIONS = {
    "ymd": r"\b(\d{4})[-/](\d{1,2})[-/](\d{1,2})\b",
    "dmy": r"\b(\d{1,2})[-/](\d{1,2})[-/](\d{4})\b",
    "d_month_y": r"\b(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})\b",
    "month_d_y": r"\b([A-Za-z]+)\s+(\d{1,2})[,\s]+(\d{4})\b",
}


def extract_dates(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, date): distinct valid dates mentioned in a text column, in four notations.

    Each notation is found over the whole text with a built-in regex function; impossible
    dates (month 13, 30 February) are dropped.
    """
    month = F.create_map(*[x for i, m in enumerate(_MONTHS) for n in {m, m[:3]} for x in (F.lit(n), F.lit(f"{i + 1}"))])

    def mentions(notation: str) -> Column:
        pattern = _DATE_NOTATIONS[notation]
        found = F.regexp_extract_all(quoted(text), F.lit(pattern), F.lit(0))

        def part(m: Column, i: int) -> Column:
            return F.regexp_extract(m, pattern, i)

        def read(m: Column) -> Column:
            if notation == "ymd":
                y, mo, d = part(m, 1), part(m, 2), part(m, 3)
            elif notation == "dmy":
                y, mo, d = part(m, 3), part(m, 2), part(m, 1)
            elif notation == "d_month_y":
                y, mo, d = part(m, 3), F.try_element_at(month, F.lower(part(m, 2))), part(m, 1)
            else:
                y, mo, d = part(m, 3), F.try_element_at(month, F.lower(part(m, 1))), part(m, 2)
            # concat, not concat_ws: an unknown month must make the whole date NULL
            dash = F.lit("-")
            return F.concat(y, dash, F.lpad(mo, 2, "0"), dash, F.lpad(d, 2, "0")).try_cast("date")

        return F.transform(found, read)

    dates = F.array_distinct(F.concat(*[mentions(n) for n in _DATE_NOTATIONS]))
    return (
        df.select(quoted(key), F.explode(dates).alias("date"))
        .where(F.year("date") >= 1)
        .distinct()
    )
