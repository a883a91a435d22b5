"""Readers, writers and table-level descriptions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sondage.functions.columns import NUMERIC, as_double, clean_nan, quoted


def read_table(spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType | str | None = None) -> DataFrame:
    """Read CSV (header, inferred types unless a schema is given), JSON lines or Parquet; NaN becomes missing.

    Inference costs one extra pass over the file; pass ``schema`` for large inputs.
    """
    reader = spark.read
    if fmt == "csv":
        reader = reader.option("header", True)
        if schema is None:
            reader = reader.option("inferSchema", True)
    if schema is not None:
        reader = reader.schema(schema)
    return clean_nan(reader.format(fmt).load(path))


def coerce_types(df: DataFrame, col_types: Mapping[str, str]) -> DataFrame:
    """Columns typed ``date`` become timestamps and ``numeric`` doubles; unreadable values become NULL."""
    out = []
    for f in df.schema.fields:
        kind, c = col_types.get(f.name), quoted(f.name)
        if kind == "numeric" and not isinstance(f.dataType, NUMERIC):
            c = as_double(c.try_cast("double"))
        elif kind == "date" and isinstance(f.dataType, T.StringType):
            c = c.try_cast("timestamp_ntz")
        out.append(c.alias(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str) -> None:
    """Write as a directory of CSV parts with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Write as a directory of JSON-lines parts (one record per row)."""
    df.write.mode("overwrite").json(path)


def schema_table(df: DataFrame) -> DataFrame:
    """(column, position, type, sample): physical type and smallest non-null value of every column."""
    from sondage.functions.columns import atomic_columns
    from sondage.plans.values import wide_to_long

    cols = atomic_columns(df)
    wide = df.agg(*[F.min(quoted(c)).cast("string").alias(f"_{i}_sample") for i, c in enumerate(cols)])
    types = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(df.schema[c].dataType.simpleString()))])
    return wide_to_long(wide, cols, ["sample"]).select(
        "column", "position", types[F.col("column")].alias("type"), "sample"
    )


def table_fingerprint(df: DataFrame) -> DataFrame:
    """(rows, hash_xor, hash_sum): order-insensitive fingerprint of the table's content.

    XOR alone cancels pairs of equal rows, so the sum of row hashes is kept beside it.
    """
    parts = []
    for c in df.columns:
        parts += [quoted(c).isNull(), quoted(c)]
    h = F.xxhash64(*parts)
    return df.select(h.alias("h")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.bit_xor("h").alias("hash_xor"),
        F.sum(F.col("h").cast("decimal(38,0)")).alias("hash_sum"),
    )


def export_bundle(df: DataFrame, out_dir: str) -> list[str]:
    """Write the dataset (CSV and JSON) with its description, correlations and insights under one directory."""
    from sondage.operators.facts import auto_insights
    from sondage.operators.profile import describe
    from sondage.operators.stats import corr_matrix
    from sondage.operators.types import logical_types, of_type

    types = logical_types(df)
    numeric = of_type(types, "numeric")
    parts = {"dataset_csv": df, "insights_csv": auto_insights(df, types)}
    if numeric:
        parts["statistics_csv"] = describe(df, numeric, digits=3)
    if len(numeric) >= 2:
        parts["correlation_csv"] = corr_matrix(df, numeric)
    for name, part in parts.items():
        write_csv(part, f"{out_dir}/{name}")
    write_json(df, f"{out_dir}/dataset_json")
    return sorted([*parts, "dataset_json"])
