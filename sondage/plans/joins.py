"""Putting small results back on rows without collecting them or losing balance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sondage.functions.columns import quoted
from sondage.session import materialize, settings


def scalar_row(one_row: DataFrame) -> Column:
    """One-row DataFrame as a struct-typed scalar subquery.

    The plan stays lazy and no join is needed: Spark runs the subquery once and
    hands its value to the tasks that use it.
    """
    return one_row.select(F.struct(*[quoted(c).alias(c) for c in one_row.columns]).alias("row")).scalar()


def null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], names: Sequence[str] | None = None) -> Column:
    """Equi-join condition under which NULL keys match each other."""
    cond = F.lit(True)
    for a, b in zip(on, names or on):
        cond = cond & left[f"`{a}`"].eqNullSafe(right[f"`{b}`"])
    return cond


def _width(df: DataFrame) -> Column:
    """Bytes of a row, about: text and binary by length, nested values by their printed length, 8 for the rest."""
    out = F.lit(0)
    for f in df.schema.fields:
        c = quoted(f.name)
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            out = out + F.coalesce(F.octet_length(c), F.lit(0)) + 8
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            out = out + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        else:
            out = out + 8
    return out.cast("long")


def is_small(df: DataFrame, limit: int | None = None) -> bool:
    """True when the DataFrame has at most ``limit`` rows and ``broadcast_bytes`` bytes, by a distributed count.

    Not by ``limit(n).count()``: that would send up to n rows of every partition to one task.
    """
    s = settings(df.sparkSession)
    size = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(_width(df)), F.lit(0)).alias("bytes")).first()
    return size["n"] <= (s.broadcast_rows if limit is None else limit) and size["bytes"] <= s.broadcast_bytes


def attach(rows: DataFrame, table: DataFrame, on: Sequence[str], weight: str | None = None, how: str = "left") -> DataFrame:
    """Join ``table`` (one row per key) onto ``rows``; every row of ``rows`` keeps its place in a balanced task.

    A table measured to be small (rows and bytes) is broadcast.  Otherwise the keys that hold more than
    ``hot_share`` of all rows (at most ``1/hot_share`` of them, so that part always is
    small) are broadcast and only the remaining, evenly spread keys go through a shuffle.
    ``weight`` names a column of ``table`` with the number of rows per key; when absent it is counted.
    ``how`` is ``left``, ``inner``, ``left_semi`` or ``left_anti``; keys compare null-safe.
    """
    on = list(on)
    spark = rows.sparkSession
    table = materialize(table)  # measured, and then read up to four times
    if is_small(table):
        return _join(rows, F.broadcast(table), on, how)
    share = settings(spark).hot_share
    weights = (
        table.select(*[quoted(c) for c in on], quoted(weight).alias("_w"))
        if weight
        else rows.groupBy(*[quoted(c) for c in on]).agg(F.count(F.lit(1)).alias("_w"))
    )
    total = scalar_row(weights.agg(F.sum("_w").alias("n")))["n"]
    hot = weights.where(F.col("_w") > total * share).drop("_w")
    hot_table = _join(table, F.broadcast(hot), on, "left_semi")
    cold_table = _join(table, F.broadcast(hot), on, "left_anti")
    hot_rows = _join(rows, F.broadcast(hot), on, "left_semi")
    cold_rows = _join(rows, F.broadcast(hot), on, "left_anti")
    return _join(hot_rows, F.broadcast(hot_table), on, how).unionByName(_join(cold_rows, cold_table, on, how))


def _join(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    renamed = right.withColumnsRenamed({c: f"_k_{i}" for i, c in enumerate(on)})
    cond = F.lit(True)
    for i, c in enumerate(on):
        cond = cond & quoted(c).eqNullSafe(F.col(f"_k_{i}"))
    out = left.join(renamed, cond, how)
    return out.drop(*[f"_k_{i}" for i in range(len(on))])
