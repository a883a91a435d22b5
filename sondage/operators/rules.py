"""Findings as rule tables: each rule is a condition over measured columns, column pairs or the table as a whole.

What is measured has one row per column or column pair, however large the data. Every rule sees every column; ``most`` cuts the
ranked findings only where a caller asks for it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from sondage.operators.tablefacts import TableFacts, table_of

_NUMBERS = ["n", "low", "high", "mean", "total", "variance"]
_QUANTILES = ["q0_05", "q0_25", "q0_5", "q0_75", "q0_95"]
_COLUMN = (
    "column string,position int,kind string,text boolean,rows long,missing long,distinct long,top string,top_n long,outliers long,"
    + ",".join(f"{c} double" for c in _NUMBERS + _QUANTILES)
)


@dataclass(frozen=True)
class Rule:
    """One kind of finding; all but ``kind`` and ``over`` are SQL over the measurements named by ``over``."""

    kind: str
    over: str  # column, pair, mix (a categorical or date column with a numeric one) or table
    when: str = "true"
    column: str = "column"
    other: str = "NULL"
    value: str = "NULL"
    text: str = "NULL"


def columns(f: TableFacts, needs: Sequence[str] = ()) -> DataFrame:
    """Measured columns. ``needs`` names what costs a further pass: quantiles, outliers, levels (of all columns, not just categories),
    distinct (of all columns, counts alone) or texts (of those of strings)."""
    numbers = f.moments if "quantiles" in needs or "outliers" in needs else f.spread
    levels = f.levels if "levels" in needs else f.tops
    counted = f.distinct if "distinct" in needs else f.distinct_texts if "texts" in needs else {}
    outliers = f.iqr if "outliers" in needs else {}
    strings = {x.name for x in f.df.schema.fields if x.dataType.typeName() == "string"}
    rows = []
    for i, (c, kind) in enumerate(f.types.items()):
        level, number = levels.get(c, {}), numbers.get(c, {}) if kind == "numeric" else {}
        rows.append(
            {"column": c, "position": i, "kind": kind, "text": c in strings, "rows": f.rows, "missing": f.missing.get(c, 0), "distinct": counted.get(c, level.get("nunique")),
             "top": level.get("mode"), "top_n": level.get("mode_n"), "outliers": outliers.get(c)}
            | {k: None if number.get(k) is None else float(number[k]) for k in _NUMBERS + _QUANTILES}
        )
    out = table_of(f.df, rows, _COLUMN)
    first = lambda c: F.row_number().over(Window.orderBy(F.desc_nulls_last(c), "position"))  # noqa: E731  as many rows as columns
    return out.withColumns({f"{c}_place": first(c) for c in ("missing", "distinct", "high", "total")}).withColumn(
        "low_place", F.row_number().over(Window.orderBy(F.asc_nulls_last("low"), "position"))
    )


def pairs(f: TableFacts) -> DataFrame:
    """Correlations of the numeric columns: (column, other, r, position), the strongest first by ``place``."""
    rows = [{"column": a, "other": b, "r": r, "position": i} for i, (a, b, r) in enumerate(f.pairs)]
    out = table_of(f.df, rows, "column string,other string,r double,position int")
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.abs("r")), "position")))


def whole(f: TableFacts, duplicates: bool = True) -> DataFrame:
    row = {"rows": f.rows, "columns": f.width, "missing": f.missing_cells, "duplicates": f.duplicates if duplicates else None, "numeric": len(f.numeric), "position": 0}
    return table_of(f.df, [row], "rows long,columns long,missing long,duplicates long,numeric long,position int").withColumn("column", F.lit(None).cast("string"))


def mixes(measured: DataFrame) -> DataFrame:
    """Every categorical or date column with every numeric one: the columns of the first, and ``other``."""
    side = measured.where("kind IN ('categorical', 'date')")
    numbers = measured.where("kind = 'numeric'").agg(F.array_sort(F.collect_list(F.struct("position", "column"))).alias("x")).scalar()
    each = side.withColumn("o", F.explode(numbers)).withColumn("other", F.col("o.column"))
    return each.withColumn("position", F.col("position") * 100_000 + F.col("o.position")).drop("o")


def evaluate(rules: Sequence[Rule], sources: dict[str, DataFrame], most: int | None = None) -> DataFrame:
    """(rank, kind, column, other, value, text) of all findings, by rule and then by column."""
    found = None
    for i, r in enumerate(rules):
        part = sources[r.over].where(r.when).selectExpr(
            f"{i} AS _rule", "position AS _position", f"'{r.kind}' AS kind", f"CAST({r.column} AS STRING) AS column",
            f"CAST({r.other} AS STRING) AS other", f"CAST({r.value} AS DOUBLE) AS value", f"CAST({r.text} AS STRING) AS text",
        )
        found = part if found is None else found.unionByName(part)
    ranked = found.withColumn("rank", F.row_number().over(Window.orderBy("_rule", "_position"))).drop("_rule", "_position")
    ranked = ranked.select("rank", "kind", "column", "other", "value", "text")
    return ranked if most is None else ranked.where(F.col("rank") <= most)


def or_else(found: DataFrame, group: str, kind: str) -> DataFrame:
    """``found`` and, if it holds no finding whose kind starts with ``group``, one row of ``kind``."""
    spare = found.sparkSession.range(1).selectExpr("CAST(0 AS INT) AS rank", f"'{kind}' AS kind", "CAST(NULL AS STRING) AS column", "CAST(NULL AS STRING) AS other", "CAST(NULL AS DOUBLE) AS value", "CAST(NULL AS STRING) AS text")
    any_ = found.where(F.col("kind").startswith(group)).agg(F.count(F.lit(1)).alias("n")).scalar()
    return found.unionByName(spare.where(any_ == 0))
