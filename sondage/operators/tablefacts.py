"""Schema-sized facts about one table, each measured by one job and kept for reuse.

The quality, root-cause and insight operators are lists of findings drawn from the same
few measurements.  ``TableFacts`` runs each measurement at most once; what it holds is one
number per column (or per column pair), never data.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sondage.functions.columns import atomic_columns, string_columns
from sondage.operators.profile import duplicate_count, missing_counts, nunique_table, sigma_counts
from sondage.operators.types import logical_types, of_type
from sondage.plans.values import distinct_stats, fused, numeric_base, pin, second_pass

QUARTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def iqr_outliers(df: DataFrame, cols: Sequence[str], base: DataFrame | None = None) -> DataFrame:
    """(column, position, n, q1, q3, lower, upper, outliers): values outside the 1.5 IQR fences."""
    if base is None:
        base = pin(numeric_base(df, cols, (0.25, 0.75), fields=("n",)))
    fences = base.select(
        "column",
        "position",
        "n",
        F.col("q0_25").alias("q1"),
        F.col("q0_75").alias("q3"),
        (F.col("q0_25") - 1.5 * (F.col("q0_75") - F.col("q0_25"))).alias("lower"),
        (F.col("q0_75") + 1.5 * (F.col("q0_75") - F.col("q0_25"))).alias("upper"),
    )
    outside = lambda x, s: F.count_if((x < s["lower"]) | (x > s["upper"]))
    counted = second_pass(df, cols, fences, ("lower", "upper"), {"outliers": outside})
    return fences.join(F.broadcast(counted.drop("position")), "column")  # one row per column


class TableFacts:
    """Measurements of ``df``; attributes are computed on first use."""

    def __init__(self, df: DataFrame, types: dict | None = None):
        self.df = df
        if types is not None:
            self.types = dict(types)

    @cached_property
    def types(self) -> dict:
        return logical_types(self.df)

    @property
    def numeric(self) -> list[str]:
        return of_type(self.types, "numeric")

    @property
    def categorical(self) -> list[str]:
        return of_type(self.types, "categorical")

    @property
    def dates(self) -> list[str]:
        return of_type(self.types, "date")

    @cached_property
    def missing(self) -> dict:
        """Missing cells per column, in column order."""
        rows = missing_counts(self.df).collect()
        self.rows = rows[0]["rows"] if rows else self.df.count()
        return {r["column"]: r["missing"] for r in sorted(rows, key=lambda r: r["position"])}

    @cached_property
    def rows(self) -> int:
        self.missing  # noqa: B018 - measured together
        return self.__dict__["rows"]

    @cached_property
    def duplicates(self) -> int:
        return duplicate_count(self.df).first()["duplicates"]

    @property
    def width(self) -> int:
        return len(self.df.columns)

    @property
    def missing_cells(self) -> int:
        return sum(self.missing.values())

    @cached_property
    def base(self) -> DataFrame:
        return pin(numeric_base(self.df, self.numeric, QUARTILES))

    @cached_property
    def spread(self) -> dict:
        """Moments per numeric column, without the costlier quantiles."""
        if "moments" in self.__dict__:
            return self.moments
        return {r["column"]: r.asDict() for r in numeric_base(self.df, self.numeric).collect()} if self.numeric else {}

    @cached_property
    def moments(self) -> dict:
        """Moments and quartiles per numeric column."""
        return {r["column"]: r.asDict() for r in self.base.collect()} if self.numeric else {}

    @cached_property
    def iqr(self) -> dict:
        """Outliers beyond the IQR fences per numeric column."""
        if not self.numeric:
            return {}
        return {r["column"]: r["outliers"] for r in iqr_outliers(self.df, self.numeric, self.base).collect()}

    def beyond(self, sigmas: float) -> dict:
        if not self.numeric:
            return {}
        return {r["column"]: r["outliers"] for r in sigma_counts(self.df, self.numeric, sigmas).collect()}

    @cached_property
    def levels(self) -> dict:
        """nunique, mode, its count and entropy of every column."""
        cols = atomic_columns(self.df)
        return {r["column"]: r.asDict() for r in distinct_stats(self.df, cols).collect()}

    @cached_property
    def distinct(self) -> dict:
        """Number of different values of every column; nothing but digests is shuffled."""
        return self._nunique(atomic_columns(self.df))

    @cached_property
    def distinct_texts(self) -> dict:
        """``distinct`` of the string columns alone; those of categories are among ``tops``."""
        texts = [c for c in string_columns(self.df) if c not in self.categorical]
        counted = self.distinct if "distinct" in self.__dict__ else self._nunique(texts)
        return {c: counted[c] for c in texts}

    def _nunique(self, cols: list[str]) -> dict:
        return {r["column"]: r["nunique"] for r in nunique_table(self.df, cols).collect()} if cols else {}

    @cached_property
    def tops(self) -> dict:
        """Like ``levels`` but only for the categorical columns (few values, so nearly free)."""
        if "levels" in self.__dict__:
            return self.levels
        return {r["column"]: r.asDict() for r in distinct_stats(self.df, self.categorical).collect()} if self.categorical else {}

    @cached_property
    def pairs(self) -> list[tuple[str, str, float]]:
        """(a, b, r) of numeric column pairs in matrix order, pairs without a correlation left out."""
        from sondage.operators.stats import corr_pairs

        if len(self.numeric) < 2:
            return []
        rows = corr_pairs(self.df, self.numeric).collect()
        return [(r["a"], r["b"], r["r"]) for r in sorted(rows, key=lambda r: (r["ia"], r["ib"])) if r["r"] is not None]

    @cached_property
    def lengths(self) -> dict:
        from sondage.operators.profile import text_lengths

        cols = of_type(self.types, "text")
        return {r["column"]: r.asDict() for r in text_lengths(self.df, cols).collect()} if cols else {}

    @cached_property
    def spans(self) -> dict:
        """Earliest and latest day and number of years per date column."""
        if not self.dates:
            return {}
        t = fused(
            self.df,
            self.dates,
            {
                "n": lambda c: F.count(c),
                "earliest": lambda c: F.min(c.cast("date")),
                "latest": lambda c: F.max(c.cast("date")),
                "years": lambda c: F.size(F.collect_set(F.year(c))),
            },
        )
        return {r["column"]: r.asDict() for r in t.collect()}

    @cached_property
    def truths(self) -> dict:
        cols = of_type(self.types, "boolean")
        if not cols:
            return {}
        t = fused(self.df, cols, {"n": lambda c: F.count(c), "share": lambda c: F.avg(c.cast("int"))})
        return {r["column"]: r.asDict() for r in t.collect()}

    def worst_missing(self) -> str | None:
        """First column with the most missing values."""
        return max(self.missing, key=self.missing.get) if self.missing_cells else None


def table_of(df: DataFrame, rows: list[dict], schema: str) -> DataFrame:
    """Small list of findings as a DataFrame with a fixed schema."""
    kinds = {"string": pa.string(), "double": pa.float64(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    fields = [part.split() for part in schema.split(",")]
    arrow = pa.schema([(name, kinds[kind]) for name, kind in fields])
    return df.sparkSession.createDataFrame(pa.Table.from_pylist(rows, schema=arrow))
