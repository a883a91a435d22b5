"""Column and table profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from sondage.functions.columns import as_double, atomic_columns, band, clean_nan, numeric_columns, percent, quoted, type_of
from sondage.operators.types import logical_types, of_type
from sondage.plans.joins import attach, scalar_row
from sondage.plans.values import (
    columns_frame,
    digest_counts_long,
    distinct_stats,
    fused,
    numeric_base,
    q_name,
    quantiles_long,
    second_pass,
    value_counts_long,
    value_order,
    shown,
    wide_to_long,
)

# ------------------------------------------------------------------ numeric summaries

_DESCRIBE = ("n", "mean", "std", "low", "high")


def describe(
    df: DataFrame, cols: Sequence[str] | None = None, by: str | Sequence[str] | None = None, digits: int | None = None, base: DataFrame | None = None
) -> DataFrame:
    """(by.., column, count, mean, std, min, q25, median, q75, max), overall or per group; ``base`` holds the figures if they are known."""
    cols = list(cols or numeric_columns(df))
    keys = [] if by is None else [by] if isinstance(by, str) else list(by)
    rows = df.na.drop(subset=keys) if keys else df
    t = numeric_base(rows, cols, (0.25, 0.5, 0.75), keys, _DESCRIBE) if base is None else base
    out = {
        "count": F.col("n"), "mean": F.col("mean"), "std": F.col("std"), "min": F.col("low"),
        "q25": F.col("q0_25"), "median": F.col("q0_5"), "q75": F.col("q0_75"), "max": F.col("high"),
    }
    if digits is not None:
        out = {n: c if n == "count" else F.round(c, digits) for n, c in out.items()}
    return t.select(*[quoted(k) for k in keys], "column", *[c.alias(n) for n, c in out.items()])


def quantiles(df: DataFrame, cols: Sequence[str], qs: Sequence[float], accuracy: int | None = None) -> DataFrame:
    """(column, q, value) in long form; exact unless ``accuracy`` is given."""
    t = quantiles_long(df, list(cols), list(qs), accuracy=accuracy)
    entries = F.array(*[F.struct(F.lit(float(q)).alias("q"), F.col(q_name(q)).alias("value")) for q in qs])
    return t.select("column", F.explode(entries).alias("e")).select("column", "e.*")


def sigma_counts(df: DataFrame, cols: Sequence[str], sigmas: float = 3.0) -> DataFrame:
    """(column, position, outliers): values further than ``sigmas`` sample deviations from the mean."""
    base = numeric_base(df, cols, fields=("mean", "std"))
    beyond = lambda x, s: F.count_if((s["std"] > 0) & (F.abs(x - s["mean"]) / F.nullif(s["std"], F.lit(0.0)) > sigmas))
    return second_pass(df, cols, base, ("mean", "std"), {"outliers": beyond})


def numeric_summary(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """The 22 summary figures of each numeric column (one row per column).

    One fused aggregate for moments and quantiles, one pass against the column means for the
    mean absolute deviation and the 3-sigma count, and one long-form count for the mode.
    """
    cols = list(cols or of_type(logical_types(df), "numeric"))
    base = numeric_base(df, cols, (0.05, 0.25, 0.5, 0.75, 0.95))
    light = numeric_base(df, cols, fields=("mean", "std"))
    deviations = second_pass(
        df,
        cols,
        light,
        ("mean", "std"),
        {
            "mad": lambda x, s: F.avg(F.abs(x - s["mean"])),
            "outliers": lambda x, s: F.count_if((s["std"] > 0) & (F.abs(x - s["mean"]) / F.nullif(s["std"], F.lit(0.0)) > 3)),
        },
    ).drop("position")
    modes = distinct_stats(df, cols).select("column", F.col("mode").cast("double").alias("mode"))
    t = base.join(F.broadcast(deviations), "column").join(F.broadcast(modes), "column")  # one row per column each
    half = 1.96 * F.col("std") / F.sqrt(F.col("n"))
    return t.where(F.col("n") > 0).select(
        "column",
        F.col("n").alias("count"),
        "missing",
        "mean",
        F.col("q0_5").alias("median"),
        "mode",
        F.col("low").alias("min"),
        F.col("high").alias("max"),
        (F.col("high") - F.col("low")).alias("range"),
        "std",
        "variance",
        "mad",
        F.when(F.col("mean") != 0, F.col("std") / F.nullif(F.col("mean"), F.lit(0.0)) * 100).alias("cv_pct"),
        F.col("q0_25").alias("q1"),
        F.col("q0_75").alias("q3"),
        (F.col("q0_75") - F.col("q0_25")).alias("iqr"),
        F.col("q0_05").alias("p5"),
        F.col("q0_95").alias("p95"),
        F.col("skew").alias("skewness"),
        F.col("kurt").alias("kurtosis"),
        (F.col("mean") - half).alias("ci_low"),
        (F.col("mean") + half).alias("ci_high"),
        "outliers",
    )


def moments_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, mean, std, skewness, kurtosis, outliers): compact comparison of columns."""
    base = numeric_base(df, cols, fields=("n", "mean", "std", "skew", "kurt"))
    return (
        base.join(F.broadcast(sigma_counts(df, cols).drop("position")), "column")
        .where(F.col("n") > 0)
        .select("column", "mean", "std", F.col("skew").alias("skewness"), F.col("kurt").alias("kurtosis"), "outliers")
    )


# ------------------------------------------------------------------ missing, duplicates, distinct


def missing_counts(df: DataFrame) -> DataFrame:
    """(column, position, missing, rows) from one scan of null counts."""
    cols = atomic_columns(df)
    return fused(clean_nan(df), cols, {"missing": lambda c: F.count_if(c.isNull()), "rows": lambda c: F.count(F.lit(1))})


def missing_table(df: DataFrame) -> DataFrame:
    """(column, missing, missing_pct), most missing first."""
    t = missing_counts(df)
    return t.select("column", "missing", percent(F.col("missing"), F.col("rows")).alias("missing_pct")).orderBy(
        F.desc("missing"), "column"
    )


def duplicate_count(df: DataFrame) -> DataFrame:
    """(rows, duplicates): rows that repeat an earlier one.  Copies are merged map-side, so a huge group stays small."""
    groups = df.groupBy(*[quoted(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates")
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Every member of every group of equal rows (NULLs compare equal).

    Rows are grouped whole, with a map-side combined count, so equality is exact; what is joined back is a 128-bit digest of
    each repeated row, never the row. Two different rows of one digest are as good as impossible.
    """
    cols = [quoted(c) for c in df.columns]
    holes = F.concat(*[F.when(c.isNull(), F.lit("1")).otherwise(F.lit("0")) for c in cols])
    one, two = F.xxhash64(holes, *cols), F.xxhash64(F.lit(1), holes, *cols)
    groups = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(one.alias("_d1"), two.alias("_d2"), "_n")
    marked = df.withColumns({"_d1": one, "_d2": two})
    return attach(marked, groups, ["_d1", "_d2"], weight="_n", how="left_semi").drop("_d1", "_d2")


def nunique_table(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """(column, nunique, missing) for every column; ``approx`` uses sketches instead of the exact long-form count."""
    cols = list(cols or atomic_columns(df))
    df = clean_nan(df)
    if approx:
        return fused(
            df, cols, {"nunique": lambda c: F.approx_count_distinct(c), "missing": lambda c: F.count_if(c.isNull())}
        ).drop("position")
    counted = digest_counts_long(df, cols).groupBy("column").agg(F.count(F.lit(1)).alias("nunique"))
    missing = fused(df, cols, {"missing": lambda c: F.count_if(c.isNull())})
    return missing.join(F.broadcast(counted), "column", "left").select(
        "column", F.coalesce("nunique", F.lit(0)).alias("nunique"), "missing"
    )


def most_unique(df: DataFrame) -> DataFrame:
    """(column, nunique) of the column with the most distinct values; ties to the first column."""
    cols = atomic_columns(df)
    t = nunique_table(df, cols).join(F.broadcast(columns_frame(df, cols)), "column")
    return t.orderBy(F.desc("nunique"), "position").limit(1).select("column", "nunique")


def dataset_summary(df: DataFrame, types: Mapping[str, str] | None = None, known: DataFrame | None = None) -> DataFrame:
    """One row: rows, columns, columns per type, missing cells, duplicates, their percentages and a quality class.

    ``known`` is one row of (rows, duplicates, missing) that were measured before.
    """
    types = types or logical_types(df)
    width = len(df.columns)
    if known is None:
        missing = scalar_row(missing_counts(df).agg(F.sum("missing").alias("m")))["m"]
        t = duplicate_count(df).withColumn("missing", F.coalesce(missing, F.lit(0)))
    else:
        t = known.select("rows", "duplicates", "missing")
    missing_pct = F.round(percent(F.col("missing"), F.col("rows") * width), 2)
    dup_pct = F.round(percent(F.col("duplicates"), F.col("rows")), 2)
    worst = F.greatest("missing_pct", "duplicate_pct")
    kinds = {k: len(of_type(types, k)) for k in ("numeric", "categorical", "date", "text", "boolean")}
    return (
        t.withColumn("missing_pct", missing_pct)
        .withColumn("duplicate_pct", dup_pct)
        .select(
            "rows",
            F.lit(width).cast("long").alias("columns"),
            *[F.lit(n).cast("long").alias(f"{k}_cols") for k, n in kinds.items()],
            "missing",
            "duplicates",
            "missing_pct",
            "duplicate_pct",
            band(worst, [(20, "poor"), (5, "fair")], "excellent").alias("quality"),
        )
    )


# ------------------------------------------------------------------ column profiles


def text_lengths(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, position, n, avg_length, min_length, max_length)."""
    size = lambda c: F.length(c.cast("string"))
    return fused(
        df,
        cols,
        {
            "n": lambda c: F.count(c),
            "avg_length": lambda c: F.avg(size(c)),
            "min_length": lambda c: F.min(size(c)),
            "max_length": lambda c: F.max(size(c)),
        },
    )


def column_profile(df: DataFrame, types: Mapping[str, str] | None = None) -> DataFrame:
    """One row per column: nulls, distinct, repeats, and figures that fit its type (others NULL)."""
    types = types or logical_types(df)
    cols = list(types)
    is_num = {c: types[c] == "numeric" for c in cols}
    is_text = {c: types[c] == "text" for c in cols}
    is_date = {c: types[c] == "date" for c in cols}
    wide = []
    for i, c in enumerate(cols):
        x = quoted(c)
        num = as_double(x) if is_num[c] else F.lit(None).cast("double")
        size = F.length(x.cast("string")) if is_text[c] else F.lit(None).cast("int")
        day = x.cast("date") if is_date[c] else F.lit(None).cast("date")
        wide += [
            F.count_if(x.isNull()).alias(f"_{i}_nulls"),
            F.count(F.lit(1)).alias(f"_{i}_rows"),
            F.min(num).alias(f"_{i}_min"),
            F.max(num).alias(f"_{i}_max"),
            F.avg(num).alias(f"_{i}_mean"),
            F.stddev_samp(num).alias(f"_{i}_std"),
            F.max(size).alias(f"_{i}_longest"),
            F.min(size).alias(f"_{i}_shortest"),
            F.min(day).alias(f"_{i}_earliest"),
            F.max(day).alias(f"_{i}_latest"),
        ]
    fields = ["nulls", "rows", "min", "max", "mean", "std", "longest", "shortest", "earliest", "latest"]
    base = wide_to_long(df.agg(*wide), cols, fields)
    distinct = distinct_stats(df, cols).drop("position")
    numeric = of_type(types, "numeric")
    t = base.join(F.broadcast(distinct), "column")
    if numeric:
        medians = quantiles_long(df, numeric, [0.5]).select("column", F.col("q0_5").alias("median"))
        t = t.join(F.broadcast(medians), "column", "left")
    else:
        t = t.withColumn("median", F.lit(None).cast("double"))
    kind = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(types[c]))])[F.col("column")]
    return t.select(
        "column",
        kind.alias("logical_type"),
        "nulls",
        F.round(percent(F.col("nulls"), F.col("rows")), 2).alias("missing_pct"),
        F.col("nunique").alias("unique"),
        (F.col("rows") - F.col("nunique")).alias("repeats"),
        "min",
        "max",
        "mean",
        "median",
        "std",
        "longest",
        "shortest",
        F.when(kind == "text", F.col("mode")).alias("most_common"),
        "earliest",
        "latest",
    )


def filter_profile(profile: DataFrame, name: str | None = None, types: Sequence[str] | None = None) -> DataFrame:
    """Profile rows whose column name contains ``name`` (any case) and whose type is listed."""
    out = profile
    if types:
        out = out.where(F.col("logical_type").isin(list(types)))
    if name:
        out = out.where(F.contains(F.lower("column"), F.lit(name.lower())))
    return out


_TYPE_LABEL = {"bigint": "Integer", "double": "Float", "string": "Text", "timestamp": "Date", "timestamp_ntz": "Date", "date": "Date", "boolean": "Boolean"}


def data_dictionary(df: DataFrame, samples: int = 3) -> DataFrame:
    """(column, type, role, missing, completeness, unique, sample): reference card of the table.

    Samples are the ``samples`` smallest distinct values of the column.
    """
    cols = atomic_columns(df)
    counts = value_counts_long(df, cols)
    unique = counts.groupBy("column").agg(F.count(F.lit(1)).alias("unique"))
    w = _smallest_first()
    firsts = counts.withColumn("r", F.row_number().over(w)).where(F.col("r") <= samples)
    shown_values = firsts.groupBy("column").agg(
        F.array_sort(F.collect_list(F.struct("r", shown().alias("v")))).alias("s")  # at most ``samples`` entries
    ).select("column", F.concat_ws(", ", F.transform("s", lambda e: e["v"])).alias("sample"))
    t = (
        missing_counts(df)
        .join(F.broadcast(unique), "column", "left")
        .join(F.broadcast(shown_values), "column", "left")
        .withColumn("unique", F.coalesce("unique", F.lit(0)))
    )
    names = F.create_map(
        *[x for c in cols for x in (F.lit(c), F.lit(_TYPE_LABEL.get(type_of(df, c).simpleString(), type_of(df, c).simpleString())))]
    )
    broad = F.array(*[F.lit(c) for c in cols if type_of(df, c).simpleString() in ("bigint", "double")] or [F.lit("")])
    big = F.col("rows") > 100
    role = (
        F.when((F.col("unique") == F.col("rows")) & big, F.lit("ID / Primary Key"))
        .when((F.col("unique") <= 20) & big, F.lit("Categorical"))
        .when(F.array_contains(broad, F.col("column")), F.lit("Numeric"))
        .otherwise(F.lit("Text / Description"))
    )
    complete = F.round((1 - F.col("missing") / F.greatest(F.col("rows"), F.lit(1))) * 100, 1)
    return t.select(
        "column", names[F.col("column")].alias("type"), role.alias("role"), "missing", complete.alias("completeness"), "unique",
        F.coalesce("sample", F.lit("")).alias("sample"),
    )


def _smallest_first():
    from pyspark.sql import Window

    return Window.partitionBy("column").orderBy(value_order().asc())


def mode_value(df: DataFrame, col: str) -> DataFrame:
    """(value, count) of the most frequent value; ties to the smallest."""
    return _counts(df, col).orderBy(F.desc("count"), "value").limit(1)


def least_frequent(df: DataFrame, col: str) -> DataFrame:
    """(value, count) of the least frequent value; ties to the largest (last of the frequency table)."""
    return _counts(df, col).orderBy("count", F.desc("value")).limit(1)


def _counts(df: DataFrame, col: str) -> DataFrame:
    return df.where(quoted(col).isNotNull()).groupBy(quoted(col).alias("value")).agg(F.count(F.lit(1)).alias("count"))


def entropy(df: DataFrame, col: str) -> DataFrame:
    """(entropy): Shannon entropy in nats with the 1e-10 guard inside the log."""
    counts = digest_counts_long(df, [col])
    total = scalar_row(df.agg(F.count(quoted(col)).alias("n")))["n"]
    p = F.col("n") / total
    return counts.agg((-F.sum(p * F.ln(p + 1e-10))).alias("entropy"))


# Name parts that mark a money column.
MONEY_WORDS = ["revenue", "sales", "amount", "price"]


def kpis(df: DataFrame, types: Mapping[str, str] | None = None) -> DataFrame:
    """(kpi, value): rows, columns, missing, duplicates, mean of column means, and a total.

    The total is over columns named like money (``Total Revenue``) or else over all numeric
    columns (``Total Sum``).
    """
    types = types or logical_types(df)
    numeric = of_type(types, "numeric")
    summary = dataset_summary(df, types)
    entries = [(name, F.col(col).cast("double")) for name, col in
               [("Total Rows", "rows"), ("Total Columns", "columns"), ("Missing Values", "missing"), ("Duplicates", "duplicates")]]
    if numeric:
        base = numeric_base(df, numeric, fields=("mean", "total"))
        money = [c for c in numeric if any(w in c.lower() for w in MONEY_WORDS)]
        totals = scalar_row(
            base.agg(F.avg("mean").alias("m"), F.sum(F.when(F.col("column").isin(money or numeric), F.col("total"))).alias("s"))
        )
        entries.append(("Average Value", F.round(totals["m"], 2)))
        entries.append(("Total Revenue" if money else "Total Sum", F.round(totals["s"], 2)))
    rows = F.array(*[F.struct(F.lit(n).alias("kpi"), c.alias("value")) for n, c in entries])
    return summary.select(F.explode(rows).alias("e")).select("e.*")


def extreme_values(df: DataFrame, types: Mapping[str, str] | None = None) -> DataFrame:
    """(kind, column, value): largest and smallest value over all numeric columns and where it sits."""
    numeric = of_type(types or logical_types(df), "numeric")
    t = numeric_base(df, numeric, fields=("low", "high"))
    ends = t.agg(
        F.min(F.struct((-F.col("high")).alias("k"), F.col("position"), F.col("column"))).alias("hi"),
        F.min(F.struct(F.col("low").alias("k"), F.col("position"), F.col("column"))).alias("lo"),
    )
    rows = F.array(
        F.struct(F.lit("max").alias("kind"), F.col("hi.column").alias("column"), (-F.col("hi.k")).alias("value")),
        F.struct(F.lit("min").alias("kind"), F.col("lo.column").alias("column"), F.col("lo.k").alias("value")),
    )
    return ends.select(F.explode(rows).alias("e")).select("e.*")


def text_stats(df: DataFrame, col: str) -> DataFrame:
    """(n, avg_length, min_length, max_length, most_common) of a text column."""
    size = F.length(quoted(col).cast("string"))
    common = scalar_row(mode_value(df, col).agg(F.first("value").alias("v")))["v"]
    return df.agg(
        F.count(quoted(col)).alias("n"),
        F.avg(size).alias("avg_length"),
        F.min(size).alias("min_length"),
        F.max(size).alias("max_length"),
    ).withColumn("most_common", common)


def date_span(df: DataFrame, col: str) -> DataFrame:
    """(earliest, latest, years, days) of a date column."""
    d = quoted(col).cast("timestamp_ntz")
    t = df.agg(F.min(d).alias("a"), F.max(d).alias("b"), F.count_distinct(F.year(d)).alias("years"))
    whole_days = F.floor((F.unix_micros(F.col("b").cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp"))) / 86_400_000_000)
    return t.select(F.to_date("a").alias("earliest"), F.to_date("b").alias("latest"), "years", whole_days.alias("days"))


def monthly_counts(df: DataFrame, col: str) -> DataFrame:
    """(month, count) with the month as its first day."""
    month = F.to_date(F.date_trunc("month", quoted(col).cast("timestamp_ntz").cast("timestamp")))
    return df.where(quoted(col).isNotNull()).groupBy(month.alias("month")).agg(F.count(F.lit(1)).alias("count"))


def boolean_split(df: DataFrame, col: str) -> DataFrame:
    """(true_pct, false_pct) of a boolean column, 1 dp."""
    share = F.round(F.avg(quoted(col).cast("int")) * 100, 1)
    return df.agg(share.alias("true_pct")).withColumn("false_pct", F.round(100 - F.col("true_pct"), 1))
