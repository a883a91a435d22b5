"""Logical and semantic column types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sondage.functions.columns import DATES, NUMERIC, as_double, atomic_columns, quoted, string_columns
from sondage.plans.values import columns_frame, value_counts_long

NUMERIC_LEVELS = 10
TEXT_LEVELS = 20
# A sparse HyperLogLog++ sketch of at most 20 distinct values counts linearly over its
# registers and cannot report more than 21, so a larger estimate proves more than 20.
_PROOF = 30


def column_types(df: DataFrame) -> DataFrame:
    """(column, position, logical_type, nunique): logical type of every atomic column.

    date, boolean, numeric, categorical (numbers with at most 10 distinct, all integral
    values; strings with fewer than 20 distinct values) or text.  ``nunique`` is the exact
    distinct count where it is at most 20 and otherwise NULL ("many").

    One scan of sketches rules out the high-cardinality columns; only columns that may
    qualify are counted exactly, and those have few values, so the shuffle is tiny.
    """
    logical = logical_types(df, with_counts=True)
    table = columns_frame(df, list(logical))
    types = F.create_map(*[x for c, (t, _) in logical.items() for x in (F.lit(c), F.lit(t))])
    counts = F.create_map(*[x for c, (_, n) in logical.items() for x in (F.lit(c), F.lit(n).cast("long"))])
    return table.select("column", "position", types[F.col("column")].alias("logical_type"), counts[F.col("column")].alias("nunique"))


def logical_types(df: DataFrame, with_counts: bool = False) -> dict:
    """Logical types as a schema-sized dict {column: type}."""
    cols = atomic_columns(df)
    fields = {f.name: f.dataType for f in df.schema.fields}
    open_cols = [c for c in cols if isinstance(fields[c], NUMERIC + (T.StringType,))]
    facts: dict = {}
    if open_cols:
        aggs = []
        for i, c in enumerate(open_cols):
            col = quoted(c)
            aggs.append(F.approx_count_distinct(_clean(fields[c], col)).alias(f"d{i}"))
            if isinstance(fields[c], (T.FloatType, T.DoubleType, T.DecimalType)):
                aggs.append(F.bool_and(as_double(col) == F.floor(as_double(col))).alias(f"w{i}"))
        facts = df.agg(*aggs).first().asDict()
    maybe = [c for i, c in enumerate(open_cols) if facts[f"d{i}"] <= _PROOF]
    exact: dict = {}
    if maybe:
        counted = value_counts_long(df, maybe).groupBy("column").agg(F.count(F.lit(1)).alias("n"))
        exact = {r["column"]: r["n"] for r in counted.collect()}
    out: dict = {}
    for c in cols:
        dtype = fields[c]
        levels = exact.get(c, 0) if c in maybe else None
        if isinstance(dtype, DATES):
            kind = "date"
        elif isinstance(dtype, T.BooleanType):
            kind = "boolean"
        elif isinstance(dtype, NUMERIC):
            whole = facts.get(f"w{open_cols.index(c)}")
            integral = True if whole is None else whole
            kind = "categorical" if levels is not None and levels <= NUMERIC_LEVELS and integral else "numeric"
        elif isinstance(dtype, T.StringType):
            kind = "categorical" if levels is not None and levels < TEXT_LEVELS else "text"
        else:
            kind = "text"
        shown = levels if levels is not None and levels <= TEXT_LEVELS else None
        out[c] = (kind, shown) if with_counts else kind
    return out


def _clean(dtype: T.DataType, c: Column) -> Column:
    return as_double(c) if isinstance(dtype, (T.FloatType, T.DoubleType)) else c


def of_type(types: dict, *kinds: str) -> list[str]:
    return [c for c, t in types.items() if t in kinds]


# Semantic patterns and boolean words, tried in this order; the first with a share above 0.85 wins.
SEMANTIC_SHARE = 0.85
SEMANTIC_PATTERNS = [
    ("Date (ISO 8601)", r"^\d{4}-\d{1,2}-\d{1,2}([T ]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"),
    ("Date (Common Format)", r"^\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}$"),
    ("Email Address", r"^[^@\s]+@[^@\s]+\.[^@\s]+$"),
    ("Geographic Coordinates (Lat, Lon)", r"^-?\d{1,3}(\.\d+)?\s*[,;\s]\s*-?\d{1,3}(\.\d+)?$"),
    ("Currency String", r"^[\$€£¥]\s?-?[\d,]+(\.\d{1,2})?$"),
    ("Boolean Equivalent", None),
    ("Phone Number", r"^\+?[\d\s\-()]{7,20}$"),
]
BOOLEAN_WORDS = ["yes", "no", "y", "n", "true", "false", "t", "f", "1", "0"]
FEW_LEVELS = 10


def semantic_types(df: DataFrame) -> DataFrame:
    """(column, position, semantic_type, confidence): what the values of each column look like.

    All (string column, pattern) shares come from one aggregate over whole values; numeric
    columns are told apart by having at most 10 distinct values.
    """
    cols = atomic_columns(df)
    fields = {f.name: f.dataType for f in df.schema.fields}
    counts = logical_types(df, with_counts=True)
    strings = string_columns(df)
    shares = {}
    if strings:
        aggs = []
        for i, c in enumerate(strings):
            col = quoted(c)
            aggs.append(F.count(col).alias(f"n{i}"))
            for j, (_, pattern) in enumerate(SEMANTIC_PATTERNS):
                hit = F.lower(F.regexp_replace(col, r"^\s+|\s+$", "")).isin(BOOLEAN_WORDS) if pattern is None else col.rlike(pattern)
                aggs.append(F.avg(hit.cast("double")).alias(f"p{i}_{j}"))
        shares = df.agg(*aggs).first().asDict()
    verdicts = []
    for pos, c in enumerate(cols):
        dtype, (_, levels) = fields[c], counts[c]
        few = levels is not None and levels <= FEW_LEVELS
        if isinstance(dtype, NUMERIC):
            verdict = ("Ordinal / Binned Numeric" if few else "Continuous Numeric", 95.0)
        elif isinstance(dtype, DATES):
            verdict = ("Date / Time", 100.0)
        elif isinstance(dtype, T.BooleanType):
            # booleans count as numeric, and never have more than two values
            verdict = ("Ordinal / Binned Numeric", 95.0)
        else:
            i = strings.index(c)
            verdict = ("Empty", 0.0) if shares[f"n{i}"] == 0 else None
            for j, (label, _) in enumerate(SEMANTIC_PATTERNS):
                share = shares[f"p{i}_{j}"]
                if verdict is None and share is not None and share > SEMANTIC_SHARE:
                    verdict = (label, round(share * 100, 1))
            verdict = verdict or ("Categorical / Ordinal" if few else "Free Text", 100.0)
        verdicts.append((c, pos, *verdict))
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"), F.lit(p).alias("position"), F.lit(t).alias("semantic_type"), F.lit(v).alias("confidence")
            )
            for c, p, t, v in verdicts
        ]
    )
    return df.sparkSession.range(1).select(F.explode(entries).alias("e")).select("e.*")
