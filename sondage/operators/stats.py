"""Correlation, association, normality and hypothesis tests.

Statistics are Spark aggregates over all rows.  A p-value is computed on the driver from
the handful of aggregated numbers that define it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sondage.functions.columns import as_double, band, normal_cdf, normal_quantile, quoted
from sondage.functions.pvalues import chi2_sf, f_sf, kolmogorov_sf, normal_ppf, normal_sf, t_two_sided
from sondage.operators.profile import nunique_table
from sondage.operators.relational import sample_n
from sondage.operators.tablefacts import table_of
from sondage.operators.types import logical_types
from sondage.plans.joins import attach, scalar_row
from sondage.plans.ordering import global_prefix, with_global_index
from sondage.plans.values import distinct_stats, fused, numeric_base, q_name, quantiles_long
from sondage.session import materialize, settings


def one_row(df: DataFrame, **values) -> DataFrame:
    """Small result assembled on the driver."""
    return df.sparkSession.createDataFrame(pa.Table.from_pylist([values], schema=pa.schema([(k, _arrow(v)) for k, v in values.items()])))


def _arrow(v) -> pa.DataType:
    if isinstance(v, bool):
        return pa.bool_()
    if isinstance(v, int):
        return pa.int64()
    return pa.string() if isinstance(v, str) else pa.float64()


# ------------------------------------------------------------------ correlation


def _complete(df: DataFrame, a: str, b: str) -> DataFrame:
    x, y = as_double(quoted(a)), as_double(quoted(b))
    return df.select(x.alias("a"), y.alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull())


#: Columns up to which products are summed by one expression for each pair; wider tables go by blocks.
_NARROW = 16
_BLOCK = 16


def _pearson_all(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(ia, ib, r) of all column pairs over their pairwise complete rows; NULL where a column does not vary."""
    if len(cols) < 2:
        return _stacked(df, [])
    return _pearson_narrow(df, cols) if len(cols) <= _NARROW else _pearson_blocks(df, cols)


def _pearson_blocks(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Correlations of many columns from one pass over the rows, in a plan that does not grow with their number.

    With values shifted by their means and gaps as zero (v), their squares (q) and marks of what is present (m), the products
    v'm, q'm, m'm and v'v hold the sums, squares, counts and products of every pair's common rows. A task adds them up over its batches
    and sends out square blocks, which are summed by block; the pairs are put together from the cells.
    """
    size = len(cols)
    slim = df.select(*[as_double(quoted(c)).alias(f"x{i}") for i, c in enumerate(cols)])
    means = slim.agg(*[F.coalesce(F.avg(f"x{i}"), F.lit(0.0)).alias(f"m{i}") for i in range(size)]).first()
    shift = np.array([means[f"m{i}"] for i in range(size)])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4 * size, size))
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                v = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in part.columns]) - shift
                m = ~np.isnan(v)
                v[~m] = 0.0
                m = m.astype(float)
                total += np.concatenate([v.T @ m, (v * v).T @ m, m.T @ m, v.T @ v])
        if total.any():
            rows, width = -(-4 * size // _BLOCK), -(-size // _BLOCK)
            padded = np.zeros((rows * _BLOCK, width * _BLOCK))
            padded[: 4 * size, :size] = total
            cells = padded.reshape(rows, _BLOCK, width, _BLOCK).transpose(0, 2, 1, 3).reshape(-1)
            ends = np.arange(rows * width + 1, dtype=np.int32) * _BLOCK * _BLOCK
            number = np.arange(rows * width, dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(cells))
            yield pa.RecordBatch.from_arrays([pa.array(number // width), pa.array(number % width), lists], ["i", "j", "cells"])

    blocks = slim.mapInArrow(products, "i int, j int, cells array<double>")
    summed = blocks.groupBy("i", "j").agg(F.array(*[F.sum(F.get("cells", F.lit(k))) for k in range(_BLOCK * _BLOCK)]).alias("cells"))
    cell = summed.select("i", "j", F.posexplode("cells").alias("k", "s")).select(
        (F.col("i") * _BLOCK + F.floor(F.col("k") / _BLOCK)).alias("u"), (F.col("j") * _BLOCK + F.col("k") % _BLOCK).alias("b"), "s"
    ).where((F.col("u") < 4 * size) & (F.col("b") < size)).select(F.floor(F.col("u") / size).alias("kind"), (F.col("u") % size).alias("a"), "b", "s")
    of = lambda kind, first: F.max(F.when((F.col("kind") == kind) & ((F.col("a") < F.col("b")) == F.lit(first)), F.col("s")))
    pairs = cell.where("a <> b").groupBy(F.least("a", "b").cast("int").alias("ia"), F.greatest("a", "b").cast("int").alias("ib")).agg(
        of(0, True).alias("sa"), of(0, False).alias("sb"), of(1, True).alias("qa"), of(1, False).alias("qb"), of(2, True).alias("n"), of(3, True).alias("p")
    )
    every = df.sparkSession.range(size).select(F.col("id").cast("int").alias("ia"), F.explode(F.sequence(F.col("id") + 1, F.lit(size))).alias("ib"))
    every = every.where(F.col("ib") < size).select("ia", F.col("ib").cast("int").alias("ib"))
    n, a, b, aa, bb = F.nullif(F.col("n"), F.lit(0.0)), F.col("sa"), F.col("sb"), F.col("qa"), F.col("qb")
    va, vb = aa - a * a / n, bb - b * b / n
    r = F.try_divide(F.col("p") - a * b / n, F.sqrt(F.greatest(va, F.lit(0.0))) * F.sqrt(F.greatest(vb, F.lit(0.0))))
    known = F.when((va > aa * 1e-12) & (vb > bb * 1e-12), F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)))
    return every.join(pairs, ["ia", "ib"], "left").select("ia", "ib", known.alias("r"))


def _pearson_narrow(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Correlations of a few columns as one sum for each pair.

    A first aggregate finds each column's mean and gaps (one number per column).  The second
    sums products of mean-shifted values: one sum per pair of gap-free columns, six where
    rows must be left out pair by pair.  Plain sums keep the wide aggregate in generated
    code, and the shift keeps them accurate.
    """
    slim = df.select(*[as_double(quoted(c)).alias(f"x{i}") for i, c in enumerate(cols)])
    size = len(cols)
    first = slim.agg(
        F.count(F.lit(1)).alias("rows"),
        *[a for i in range(size) for a in (F.count(f"x{i}").alias(f"n{i}"), F.avg(f"x{i}").alias(f"m{i}"), (F.min(f"x{i}") < F.max(f"x{i}")).alias(f"v{i}"))],
    ).first()
    whole = [first[f"n{i}"] == first["rows"] for i in range(size)]
    varies = [bool(first[f"v{i}"]) for i in range(size)]
    shifted = slim.select(*[(F.col(f"x{i}") - F.lit(float(first[f"m{i}"] or 0.0))).alias(f"d{i}") for i in range(size)])
    d = [F.col(f"d{i}") for i in range(size)]
    aggs, parts = [], []
    for i in range(size):
        if varies[i] and whole[i]:
            aggs += [F.sum(d[i]).alias(f"s{i}"), F.sum(d[i] * d[i]).alias(f"q{i}")]
    for i in range(size):
        for j in range(i + 1, size):
            if not (varies[i] and varies[j]):
                continue
            p = f"{i}_{j}"
            aggs.append(F.sum(d[i] * d[j]).alias(f"p{p}"))
            if whole[i] and whole[j]:
                n = F.lit(float(first["rows"]))
                a, b, aa, bb = F.col(f"s{i}"), F.col(f"s{j}"), F.col(f"q{i}"), F.col(f"q{j}")
            else:
                x, y = F.when(d[j].isNotNull(), d[i]), F.when(d[i].isNotNull(), d[j])
                aggs += [
                    F.count(x).alias(f"n{p}"), F.sum(x).alias(f"a{p}"), F.sum(y).alias(f"b{p}"),
                    F.sum(x * x).alias(f"c{p}"), F.sum(y * y).alias(f"e{p}"),
                ]
                n = F.nullif(F.col(f"n{p}").cast("double"), F.lit(0.0))
                a, b, aa, bb = (F.col(f"{k}{p}") for k in "abce")
            va, vb = aa - a * a / n, bb - b * b / n
            r = F.try_divide(F.col(f"p{p}") - a * b / n, F.sqrt(F.greatest(va, F.lit(0.0))) * F.sqrt(F.greatest(vb, F.lit(0.0))))
            spread = (va > aa * 1e-12) & (vb > bb * 1e-12)
            clipped = F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0))
            parts.append(F.struct(F.lit(i).alias("ia"), F.lit(j).alias("ib"), F.when(spread, clipped).alias("r")))
    missing = [
        F.struct(F.lit(i).alias("ia"), F.lit(j).alias("ib"), F.lit(None).cast("double").alias("r"))
        for i in range(size) for j in range(i + 1, size) if not (varies[i] and varies[j])
    ]
    summed = shifted.agg(*aggs) if aggs else df.sparkSession.range(1)
    return summed.select(F.explode(F.array(*parts, *missing)).alias("e")).select("e.*")


def _pair_counts(df: DataFrame, cols: Sequence[str], pairs: Sequence[tuple[int, int]]) -> DataFrame:
    """(pair, a, b, w): how often two values meet in the complete rows of each pair of columns, all pairs in one pass."""
    x = [as_double(quoted(c)) + F.lit(0.0) for c in cols]  # one zero
    entries = F.array(*[F.struct(F.lit(k).alias("pair"), x[i].alias("a"), x[j].alias("b")) for k, (i, j) in enumerate(pairs)])
    cells = df.select(F.explode(entries).alias("e")).select("e.*").where(F.col("a").isNotNull() & F.col("b").isNotNull())
    return materialize(cells.groupBy("pair", "a", "b").agg(F.count(F.lit(1)).alias("w")))


def _pair_ranks(counts: DataFrame, col: str, out: str) -> DataFrame:
    """(pair, col, _n, out): average rank of each distinct value in its pair."""
    per_value = materialize(counts.groupBy("pair", col).agg(F.sum("w").alias("_n")))
    upto = global_prefix(per_value, F.col("_n"), "_upto", col, partition_by="pair")
    return upto.select("pair", col, "_n", (F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2).alias(out))


def _spearman_pairs(df: DataFrame, cols: Sequence[str], pairs: Sequence[tuple[int, int]]) -> DataFrame:
    """(pair, r, n): Pearson correlation of average ranks over the complete rows of each pair, all pairs in one chain of jobs."""
    counts = _pair_counts(df, cols, pairs)
    with_a = attach(counts, _pair_ranks(counts, "a", "ra"), ["pair", "a"], how="inner").drop("_n")
    both = attach(with_a, _pair_ranks(counts, "b", "rb"), ["pair", "b"], how="inner").drop("_n")
    total = counts.groupBy("pair").agg(((F.sum("w") + 1) / 2).alias("mid"))  # one row per pair
    centred = both.join(F.broadcast(total), "pair").select("pair", "w", (F.col("ra") - F.col("mid")).alias("x"), (F.col("rb") - F.col("mid")).alias("y"))
    w, x, y = F.col("w"), F.col("x"), F.col("y")
    return centred.groupBy("pair").agg(
        F.try_divide(F.sum(w * x * y), F.sqrt(F.sum(w * x * x)) * F.sqrt(F.sum(w * y * y))).alias("r"), F.sum(w).alias("n")
    )


def _spearman_whole(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(ia, ib, r) of columns without gaps: each value has one rank whatever the other column, so ranks are made once for each column."""
    rows = df.select(*[(as_double(quoted(c)) + F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(cols)])
    entries = F.array(*[F.struct(F.lit(i).alias("pair"), F.col(f"x{i}").alias("a")) for i in range(len(cols))])
    counts = rows.select(F.explode(entries).alias("e")).select("e.*").groupBy("pair", "a").agg(F.count(F.lit(1)).alias("w"))
    table = materialize(_pair_ranks(counts, "a", "r"))
    for i in range(len(cols)):
        own = table.where(F.col("pair") == i).select(F.col("a").alias(f"x{i}"), "_n", F.col("r").alias(f"r{i}"))
        rows = attach(rows, own, [f"x{i}"], weight="_n").drop(f"x{i}", "_n")
    return _pearson_all(rows, [f"r{i}" for i in range(len(cols))])


def _gap_free(df: DataFrame, cols: Sequence[str]) -> list[int]:
    counted = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(as_double(quoted(c))).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    return [i for i in range(len(cols)) if counted[f"n{i}"] == counted["rows"]]


def _spearman_all(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(ia, ib, r): pairs of gap-free columns by one rank of each value, the others by ranks among their common rows."""
    whole = _gap_free(df, cols)
    parts = []
    if len(whole) > 1:
        place = F.array(*[F.lit(i) for i in whole])
        ranked = _spearman_whole(df, [cols[i] for i in whole])
        parts.append(ranked.select(F.get(place, F.col("ia")).alias("ia"), F.get(place, F.col("ib")).alias("ib"), "r"))
    rest = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols)) if i not in whole or j not in whole]
    if rest:
        parts.append(_by_pair(df, rest, _spearman_pairs(df, cols, rest)))
    return _stacked(df, parts)


def _stacked(df: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """The union of the parts; without any, an empty (ia, ib, r)."""
    if not parts:
        return df.sparkSession.createDataFrame([], "ia int, ib int, r double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _by_pair(df: DataFrame, pairs: Sequence[tuple[int, int]], found: DataFrame) -> DataFrame:
    """(ia, ib, r) of every pair, NULL where it has no complete row."""
    entries = F.array(*[F.struct(F.lit(k).alias("pair"), F.lit(i).alias("ia"), F.lit(j).alias("ib")) for k, (i, j) in enumerate(pairs)])
    names = df.sparkSession.range(1).select(F.explode(entries).alias("e")).select("e.*")
    return names.join(F.broadcast(found.select("pair", "r")), "pair", "left").select("ia", "ib", "r")  # one row per pair


#: Bits of a position that are left to one task: a group has 2^16 rows at most, whatever the table's size.
_GROUP_BITS = 16


def _kendall_pairs(df: DataFrame, cols: Sequence[str], pairs: Sequence[tuple[int, int]]) -> DataFrame:
    """(pair, r): Kendall's tau-b over the complete rows of each pair, all pairs in one chain of jobs.

    Equal pairs of values are merged, then numbered in (a, b) and in (b, a) order, which turns ties into non-inversions.
    Discordant pairs are inversions of the two numberings, x and y. They are told apart by the highest bit in which their y differ:
    where two y agree above bit k, one with the bit set that comes earlier in x is an inversion with each later one without it.
    For a high bit that is a running sum over x of the rows with equal upper bits (bucketed, so no task holds such a group);
    rows that agree above the low 16 bits are at most 65,536 and are counted together, bit by bit, in one task.
    """
    counts = _pair_counts(df, cols, pairs)
    numbered = with_global_index(counts, ["a", "b"], "pair", out="x")
    numbered = materialize(with_global_index(numbered, ["b", "a"], "pair", out="y"))
    sizes = numbered.groupBy("pair").agg(F.count(F.lit(1)).alias("m"), F.sum("w").cast("double").alias("n"))
    bits = int(sizes.agg(F.coalesce(F.max("m"), F.lit(1))).first()[0] - 1).bit_length()

    low = numbered.withColumn("above", F.shiftright("y", _GROUP_BITS)).select("pair", "above", "x", "y", "w")
    inside = low.groupBy("pair", "above").applyInPandas(_group_inversions, "pair int, d double")
    parts = [inside]
    if bits > _GROUP_BITS:
        high = F.sequence(F.lit(_GROUP_BITS), F.lit(bits - 1))
        spread = numbered.select("pair", "x", "y", "w", F.explode(high).alias("bit"))
        spread = spread.withColumn("above", F.expr("shiftright(y, bit + 1)")).withColumn("on", F.expr("shiftright(y, bit) & 1"))
        before = global_prefix(spread.drop("y"), F.col("w") * F.col("on"), "ones", "x", ["pair", "bit", "above"])
        parts.append(before.where("on = 0").select("pair", (F.col("w").cast("double") * F.col("ones")).alias("d")))
    discordant = _stacked(df, parts).groupBy("pair").agg(F.sum("d").alias("d"))

    def tied(*keys: str) -> DataFrame:
        w = F.col("w").cast("double")
        merged = numbered.groupBy("pair", *keys).agg(F.sum("w").alias("w")) if len(keys) == 1 else numbered
        return merged.groupBy("pair").agg(F.sum(w * (w - 1) / 2).alias("t" + "".join(keys)))

    known = sizes  # from here on one row per pair
    for more in (discordant, tied("a"), tied("b"), tied("a", "b")):
        known = known.join(F.broadcast(more), "pair", "left")
    total = F.col("n") * (F.col("n") - 1) / 2
    above = total - F.col("ta") - F.col("tb") + F.col("tab") - 2 * F.coalesce("d", F.lit(0.0))
    return known.select("pair", F.try_divide(above, F.sqrt(total - F.col("ta")) * F.sqrt(total - F.col("tb"))).alias("r"), F.col("n").cast("long").alias("n"))


def _group_inversions(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"pair": [int(rows["pair"].iloc[0])], "d": [_inversions(rows)]})


def _inversions(rows: pd.DataFrame) -> float:
    """Sum of w_i * w_j over i before j in x with y_i > y_j, bit by bit over the y positions."""
    ordered = rows.sort_values("x")
    y = ordered["y"].rank(method="first").to_numpy(dtype=np.int64) - 1
    w = ordered["w"].to_numpy(dtype=float)
    total = 0.0
    for bit in range(int(len(y)).bit_length()):
        order = np.argsort(y >> (bit + 1), kind="stable")
        prefix, high, weight = y[order] >> (bit + 1), (y[order] >> bit) & 1, w[order]
        ones = np.cumsum(weight * high)
        starts = np.r_[True, prefix[1:] != prefix[:-1]]
        base = np.where(starts, ones - weight * high, 0.0)
        before = ones - np.maximum.accumulate(base)
        total += float((weight * (1 - high) * before).sum())
    return total


def _kendall_all(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(ia, ib, r) of all column pairs."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    return _by_pair(df, pairs, _kendall_pairs(df, cols, pairs)) if pairs else _stacked(df, [])


def corr_pairs(df: DataFrame, cols: Sequence[str], method: str = "pearson") -> DataFrame:
    """(ia, ib, a, b, r): unrounded correlation of every column pair, upper triangle."""
    cols = list(cols)
    names = F.array(*[F.lit(c) for c in cols])
    t = {"pearson": _pearson_all, "spearman": _spearman_all, "kendall": _kendall_all}[method](df, cols)
    return t.select("ia", "ib", F.get(names, F.col("ia")).alias("a"), F.get(names, F.col("ib")).alias("b"), "r")


def corr_matrix(df: DataFrame, cols: Sequence[str], method: str = "pearson", digits: int = 3) -> DataFrame:
    """(a, b, r): the full symmetric matrix in long form."""
    cols = list(cols)
    upper = corr_pairs(df, cols, method).select("a", "b", F.round("r", digits).alias("r"))
    flip = F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = upper.select(F.explode(flip).alias("e"), "r").select("e.a", "e.b", "r")
    varies = fused(df, cols, {"v": lambda c: F.min(as_double(c)) < F.max(as_double(c))})
    diagonal = varies.select(F.col("column").alias("a"), F.col("column").alias("b"), F.when(F.col("v"), F.lit(1.0)).alias("r"))
    return both.unionByName(diagonal)


STRENGTH = [(0.8, "Very Strong"), (0.6, "Strong"), (0.4, "Moderate")]


def ranked_pairs(df: DataFrame, cols: Sequence[str], method: str = "pearson", k: int | None = None) -> DataFrame:
    """(a, b, r, strength): pairs by falling |r| (3 dp)."""
    t = corr_pairs(df, cols, method).withColumn("r", F.round("r", 3)).where(F.col("r").isNotNull())
    out = t.select("a", "b", "r", band(F.abs("r"), STRENGTH, "Weak").alias("strength"), "ia", "ib")
    out = out.orderBy(F.desc(F.abs("r")), "ib", "ia").drop("ia", "ib")
    return out if k is None else out.limit(k)


def pair_counts(df: DataFrame, cols: Sequence[str], method: str = "pearson") -> DataFrame:
    """(strong, weak): pairs with |r| above 0.7 and below 0.3."""
    r = F.abs(F.round("r", 3))
    return corr_pairs(df, cols, method).agg(F.count_if(r > 0.7).alias("strong"), F.count_if(r < 0.3).alias("weak"))


def related_columns(df: DataFrame, col: str, cols: Sequence[str]) -> DataFrame:
    """(column, r, relation): other columns by their correlation with ``col``, split at +-0.3."""
    others = [c for c in cols if c != col]
    pairs = _pearson_all(df, [col, *others]).where(F.col("ia") == 0)
    names = F.array(*[F.lit(c) for c in [col, *others]])
    relation = F.when(F.col("r") > 0.3, F.lit("positive")).when(F.col("r") < -0.3, F.lit("negative")).otherwise(F.lit("weak"))
    return pairs.where(F.col("r").isNotNull()).select(F.get(names, F.col("ib")).alias("column"), "r", relation.alias("relation"))


def corr_test(df: DataFrame, a: str, b: str, method: str = "pearson") -> DataFrame:
    """(r, n, p_value, significant): correlation with its two-sided p-value."""
    if method == "pearson":
        n = _complete(df, a, b).agg(F.count(F.lit(1)).alias("n"))
        row = _pearson_all(df, [a, b]).select("r", scalar_row(n)["n"].alias("n")).first()
    else:
        row = _spearman_pairs(df, [a, b], [(0, 1)]).first()
    r, n = (row["r"], row["n"]) if row else (None, 0)
    if r is None or n < 3:
        p = None
    elif abs(r) >= 1.0:
        p = 0.0
    else:
        p = t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)
    return one_row(df, r=r, n=n, p_value=p, significant=bool(p is not None and p < 0.05))


# ------------------------------------------------------------------ association of categories


def _eta(between: Column, total: Column, groups: Column) -> Column:
    ratio = F.when((groups >= 2) & (total > 0), F.try_divide(between, total))
    return F.round(F.coalesce(ratio, F.lit(0.0)), 4)


ETA_BANDS = [(0.14, "Strong"), (0.06, "Moderate")]


def eta_squared(df: DataFrame, cat: str, num: str) -> DataFrame:
    """(eta_squared, strength): share of variance explained; the grand mean includes rows without a category."""
    return eta_matrix(df, [cat], [num]).select("eta_squared", "strength")


def eta_matrix(df: DataFrame, cats: Sequence[str], nums: Sequence[str]) -> DataFrame:
    """(category, numeric, eta_squared, strength) of every pair, from one grouped pass over (category, value)."""
    if not cats or not nums:
        return df.sparkSession.createDataFrame([], "category string, numeric string, eta_squared double, strength string")
    whole = df.agg(
        *[F.avg(as_double(quoted(c))).alias(f"m{i}") for i, c in enumerate(nums)],
        *[(F.var_pop(as_double(quoted(c))) * F.count(as_double(quoted(c)))).alias(f"t{i}") for i, c in enumerate(nums)],
    )
    known = scalar_row(whole)
    entries = F.array(*[F.struct(F.lit(c).alias("category"), quoted(c).cast("string").alias("value")) for c in cats])
    cells = df.select(*[as_double(quoted(c)).alias(f"x{i}") for i, c in enumerate(nums)], F.explode(entries).alias("e"))
    groups = (
        cells.select("*", "e.*").where(F.col("value").isNotNull()).groupBy("category", "value")
        .agg(*[a for i in range(len(nums)) for a in (F.count(f"x{i}").alias(f"n{i}"), F.avg(f"x{i}").alias(f"a{i}"))])
    )
    per_cat = groups.groupBy("category").agg(
        *[
            a
            for i in range(len(nums))
            for a in (
                F.sum(F.col(f"n{i}") * F.pow(F.col(f"a{i}") - known[f"m{i}"], F.lit(2.0))).alias(f"b{i}"),
                F.count_if(F.col(f"n{i}") > 0).alias(f"g{i}"),
            )
        ]
    )
    out = F.array(
        *[
            F.struct(F.lit(c).alias("numeric"), _eta(F.col(f"b{i}"), known[f"t{i}"], F.col(f"g{i}")).alias("eta_squared"))
            for i, c in enumerate(nums)
        ]
    )
    t = per_cat.select("category", F.explode(out).alias("e")).select("category", "e.*")
    return t.withColumn("strength", band(F.col("eta_squared"), ETA_BANDS, "Weak"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """(chi2, dof, p_value, cramers_v, association): independence of two categories.

    Only occurring pairs are needed: the statistic is sum(O^2/E) - N.  With one degree of
    freedom the continuity correction is applied on the four cells.  V divides by all rows.
    """
    cells = materialize(df.na.drop(subset=[a, b]).groupBy(quoted(a).alias("a"), quoted(b).alias("b")).agg(F.count(F.lit(1)).alias("o")))
    rows = cells.groupBy("a").agg(F.sum("o").alias("ra"))
    cols = cells.groupBy("b").agg(F.sum("o").alias("cb"))
    placed = attach(attach(cells, rows, ["a"], how="inner"), cols, ["b"], how="inner")
    o, ra, cb = (F.col(c).cast("double") for c in ("o", "ra", "cb"))
    facts = placed.agg(F.sum(o * o / (ra * cb)).alias("s"), F.sum("o").alias("n")).select("s", "n").first()
    levels = (rows.count(), cols.count())
    everything = df.count()
    dof = (levels[0] - 1) * (levels[1] - 1)
    chi2 = 0.0 if dof <= 0 or not facts["n"] else facts["n"] * (facts["s"] - 1.0)
    if dof == 1:
        n = float(facts["n"])
        r = [x["ra"] for x in rows.collect()]  # two values each
        c = [x["cb"] for x in cols.collect()]
        one = placed.orderBy("a", "b").limit(1).select("o", "ra", "cb").first()
        gap = abs(one["o"] - one["ra"] * one["cb"] / n)
        chi2 = (gap - min(0.5, gap)) ** 2 * sum(n / (x * y) for x in r for y in c)
    p = chi2_sf(chi2, dof) if dof > 0 else 1.0
    low = min(levels) - 1
    v = math.sqrt(chi2 / (everything * low)) if everything * low > 0 else 0.0
    strength = "strong" if v > 0.5 else "moderate" if v > 0.3 else "weak"
    return one_row(df, chi2=chi2, dof=dof, p_value=p, cramers_v=v, association=strength, significant=bool(p < 0.05))


# ------------------------------------------------------------------ tests on groups


def _two_groups(df: DataFrame, num: str, cat: str, g1, g2) -> dict:
    x = as_double(quoted(num))
    aggs = []
    for i, g in ((1, g1), (2, g2)):
        xi = F.when(quoted(cat) == F.lit(g), x)
        aggs += [F.count(xi).alias(f"n{i}"), F.avg(xi).alias(f"m{i}"), F.var_samp(xi).alias(f"v{i}")]
    return df.agg(*aggs).first().asDict()


def ttest_ind(df: DataFrame, num: str, cat: str, g1, g2) -> DataFrame:
    """(t, dof, p_value, mean_1, mean_2, significant): equal-variance t-test of two groups."""
    s = _two_groups(df, num, cat, g1, g2)
    dof = s["n1"] + s["n2"] - 2
    t = None
    if s["n1"] > 1 and s["n2"] > 1:
        pooled = ((s["n1"] - 1) * s["v1"] + (s["n2"] - 1) * s["v2"]) / dof
        t = (s["m1"] - s["m2"]) / math.sqrt(pooled * (1 / s["n1"] + 1 / s["n2"])) if pooled > 0 else None
    p = t_two_sided(t, dof)
    return one_row(df, t=t, dof=dof, p_value=p, mean_1=s["m1"], mean_2=s["m2"], significant=bool(p is not None and p < 0.05))


def ttest_1samp(df: DataFrame, num: str, mu: float) -> DataFrame:
    """(t, dof, p_value, mean, significant) against a known mean."""
    x = as_double(quoted(num))
    s = df.agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.stddev_samp(x).alias("s")).first()
    t = (s["m"] - mu) / (s["s"] / math.sqrt(s["n"])) if s["s"] else None
    p = t_two_sided(t, s["n"] - 1)
    return one_row(df, t=t, dof=s["n"] - 1, p_value=p, mean=s["m"], significant=bool(p is not None and p < 0.05))


def mann_whitney(df: DataFrame, num: str, cat: str, g1, g2) -> DataFrame:
    """(u, n1, n2, p_value, significant): two-sided rank test, normal approximation with tie and continuity correction.

    Values are counted per group first; ranks follow from the running totals of those counts.
    """
    x = as_double(quoted(num))
    picked = df.where(quoted(cat).isin([g1, g2]) & x.isNotNull()).select(
        x.alias("v"), (quoted(cat) == F.lit(g1)).cast("long").alias("one")
    )
    counts = materialize(picked.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.sum("one").alias("n1")))
    ranked = global_prefix(counts, F.col("n"), "upto", "v")
    n = F.col("n").cast("double")
    rank = F.col("upto") - F.col("n") + (F.col("n") + 1) / 2
    s = ranked.agg(
        F.sum(F.col("n1") * rank).alias("r1"), F.sum("n").alias("n"), F.sum("n1").alias("n1"), F.sum(n * n * n - n).alias("ties")
    ).first()
    n1, total = s["n1"] or 0, s["n"] or 0
    n2 = total - n1
    u = p = None
    if n1 and n2:
        u = s["r1"] - n1 * (n1 + 1) / 2
        spread = n1 * n2 / 12 * ((total + 1) - s["ties"] / (total * (total - 1)))
        if spread > 0:
            z = (max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / math.sqrt(spread)
            p = min(1.0, 2 * normal_sf(z))
    return one_row(df, u=u, n1=n1, n2=n2, p_value=p, significant=bool(p is not None and p < 0.05))


def anova(df: DataFrame, num: str, cat: str) -> DataFrame:
    """(f, df_between, df_within, p_value, significant): one-way analysis of variance."""
    x = as_double(quoted(num))
    groups = (
        df.where(x.isNotNull()).na.drop(subset=[cat]).groupBy(quoted(cat))
        .agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v"))
    )
    mean = scalar_row(df.where(x.isNotNull()).na.drop(subset=[cat]).agg(F.avg(x).alias("m")))["m"]
    s = groups.agg(
        F.sum(F.col("n") * F.pow(F.col("m") - mean, F.lit(2.0))).alias("ssb"),
        F.sum(F.col("n") * F.col("v")).alias("ssw"),
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("n"),
    ).first()
    k, n = s["k"], s["n"] or 0
    f = (s["ssb"] / (k - 1)) / (s["ssw"] / (n - k)) if k > 1 and n > k and s["ssw"] > 0 else None
    p = f_sf(f, k - 1, n - k)
    return one_row(df, f=f, df_between=max(k - 1, 0), df_within=max(n - k, 0), p_value=p, significant=bool(p is not None and p < 0.05))


# ------------------------------------------------------------------ normality


def shapiro_wilk(
    df: DataFrame, cols: str | Sequence[str], key: str | Sequence[str] | None = None, most: int | None = None, seed: int = 42
) -> DataFrame:
    """(column, w, p_value, n): Shapiro-Wilk over all values of each column.

    W relates the values in order to the matching normal quantiles; places come from one ordered pass over the
    counts of different values of all columns and the sums from one aggregate, so no column is gathered and no tie is sorted. Royston's law of W is fitted for 8 to 5,000 values: outside,
    the p-value is NULL. ``most`` tests a sample of at most that many rows instead, chosen by a hash of ``key``.
    """
    names = [cols] if isinstance(cols, str) else list(cols)
    if most is not None:
        keys = [key] if isinstance(key, str) else list(key or [])
        if not keys:
            raise ValueError("a sample needs a key")
        slim = df.select(*[quoted(k).alias(f"k{i}") for i, k in enumerate(keys)], *[as_double(quoted(c)).alias(f"x{i}") for i, c in enumerate(names)])
        parts = [sample_n(slim.where(F.col(f"x{i}").isNotNull()), most, [f"k{j}" for j in range(len(keys))], seed).select(F.lit(c).alias("column"), F.col(f"x{i}").alias("value")) for i, c in enumerate(names)]
        cells = parts[0]
        for p in parts[1:]:
            cells = cells.unionByName(p)
    else:
        cells = _cells(df, names)
    return _shapiro_tallied(_tallied(cells), df, names)


def _cells(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(column, value) of all values that are there."""
    if not names:
        return df.sparkSession.createDataFrame([], "column string, value double")
    entries = F.array(*[F.struct(F.lit(c).alias("column"), (as_double(quoted(c)) + F.lit(0.0)).alias("value")) for c in names])
    return df.select(F.explode(entries).alias("e")).select("e.*").where(F.col("value").isNotNull())


def _tallied(cells: DataFrame) -> DataFrame:
    """(column, value, w, upto): the different values of each column, how often they occur and how many are not above them."""
    counts = materialize(cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("w")))
    return materialize(global_prefix(counts, F.col("w"), "upto", "value", "column"))


def _basics(tallied: DataFrame) -> DataFrame:
    """(column, n, mean, std) from the counts of values."""
    means = tallied.groupBy("column").agg(F.sum("w").alias("n"), (F.sum(F.col("value") * F.col("w")) / F.sum("w")).alias("mean"))
    x = F.col("value") - F.col("mean")
    spread = tallied.join(F.broadcast(means), "column").groupBy("column").agg(F.max("n").alias("n"), F.max("mean").alias("mean"), F.sum(x * x * F.col("w")).alias("xx"))
    return materialize(spread.select("column", "n", "mean", F.sqrt(F.try_divide("xx", F.col("n") - 1)).alias("std")))


_TIED, _PIECE = 16, 1 << 16  # more equal values than the first have their places dealt out in pieces of the second


def _places(tallied: DataFrame, n: int) -> DataFrame:
    """(column, value, i): every place of each value. Equal values need no order; a value that holds many places is dealt over tasks."""
    first, last = F.col("upto") - F.col("w"), F.col("upto") - 1
    light = tallied.where(F.col("w") <= _TIED).select("column", "value", first.alias("_a"), last.alias("_z"))
    spark = tallied.sparkSession
    tasks = min(10_000, max(spark.sparkContext.defaultParallelism, math.ceil(n / settings(spark).bucket_rows)))
    heavy = tallied.where(F.col("w") > _TIED).select("column", "value", last.alias("_last"), F.explode(F.sequence(first, last, F.lit(_PIECE).cast("long"))).alias("_a"))
    heavy = heavy.select("column", "value", "_a", F.least(F.col("_a") + (_PIECE - 1), "_last").alias("_z")).repartition(tasks, "column", "value", "_a")
    return light.unionByName(heavy).select("column", "value", F.explode(F.sequence("_a", "_z")).alias("i"))


def _shapiro_tallied(tallied: DataFrame, df: DataFrame, names: Sequence[str]) -> DataFrame:
    basics = _basics(tallied)
    size = basics.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    placed = _places(tallied, size).join(F.broadcast(basics), "column")  # one row per column
    x, n, i = F.col("value") - F.col("mean"), F.col("n"), F.col("i")
    m = normal_quantile((i + F.lit(0.625)) / (n + F.lit(0.25)))
    at = lambda place: F.max(F.when(i == place, F.col("value")))
    summed = placed.groupBy("column").agg(
        F.max("n").alias("n"), F.sum(m * x).alias("mx"), F.sum(m * m).alias("mm"), F.sum(x * x).alias("xx"),
        at(F.lit(0)).alias("x1"), at(F.lit(1)).alias("x2"), at(n - 2).alias("y2"), at(n - 1).alias("y1"),
    )
    found = {r["column"]: r for r in summed.collect()}  # one row per column
    out = []
    for c in names:
        w, p, size = _royston(found[c]) if c in found else (None, None, 0)
        out.append((c, w, p, size))
    return df.sparkSession.createDataFrame(out, "column string, w double, p_value double, n long")


# Royston's (1995) polynomial coefficients for the weights and for the null distribution of W.
_ROYSTON_LAST = [0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056]
_ROYSTON_NEXT = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
_ROYSTON_MEAN = [-1.5861, -0.31082, -0.083751, 0.0038915]
_ROYSTON_SCALE = [-0.4803, -0.082676, 0.0030302]
_ROYSTON_SMALL_MEAN = [0.5440, -0.39978, 0.025054, -0.0006714]
_ROYSTON_SMALL_SCALE = [1.3822, -0.77857, 0.062767, -0.0020322]
_ROYSTON_SMALL_SHIFT = [-2.273, 0.459]


def _poly(coef: Sequence[float], x: float) -> float:
    return float(np.polynomial.polynomial.polyval(x, coef))


def _royston(r) -> tuple[float | None, float | None, int]:
    """(w, p, n) from the sums over one column: only the two outermost weights differ from the scaled normal quantiles."""
    n = r["n"]
    if n < 8 or r["x1"] == r["y1"]:
        return None, None, n
    m1, m2 = (normal_ppf((n - k + 0.625) / (n + 0.25)) for k in (1, 2))
    mm, u = r["mm"], 1.0 / math.sqrt(n)
    last = _poly(_ROYSTON_LAST, u) + m1 / math.sqrt(mm)
    nxt = _poly(_ROYSTON_NEXT, u) + m2 / math.sqrt(mm)
    phi = (mm - 2 * m1**2 - 2 * m2**2) / (1 - 2 * last**2 - 2 * nxt**2)
    outer, inner = r["y1"] - r["x1"], r["y2"] - r["x2"]
    ax = (r["mx"] - m1 * outer - m2 * inner) / math.sqrt(phi) + last * outer + nxt * inner
    w = min(1.0, ax * ax / r["xx"])
    if n > 5000:
        return w, None, n
    if w >= 1.0:
        return w, 1.0, n
    if n <= 11:
        y = -math.log(_poly(_ROYSTON_SMALL_SHIFT, n) - math.log(1 - w))
        mu, sigma = _poly(_ROYSTON_SMALL_MEAN, n), math.exp(_poly(_ROYSTON_SMALL_SCALE, n))
    else:
        y, size = math.log(1 - w), math.log(n)
        mu, sigma = _poly(_ROYSTON_MEAN, size), math.exp(_poly(_ROYSTON_SCALE, size))
    return w, normal_sf((y - mu) / sigma), n


def dagostino_k2(df: DataFrame, cols: str | Sequence[str]) -> DataFrame:
    """(column, k2, p_value): omnibus test from skewness and kurtosis, for all columns in one aggregate."""
    names = [cols] if isinstance(cols, str) else list(cols)
    t = fused(
        df,
        names,
        {
            "n": lambda c: F.count(as_double(c)).cast("double"),
            "g": lambda c: F.skewness(as_double(c)),
            "b": lambda c: F.kurtosis(as_double(c)) + 3,
        },
    )
    n, g, b = F.col("n"), F.col("g"), F.col("b")
    # skewness to a standard normal
    y = g * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    alpha = F.sqrt(2 / (w2 - 1))
    zs = F.asinh(y / alpha) / F.sqrt(0.5 * F.ln(w2))
    # kurtosis to a standard normal
    mean = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / (F.pow(n + 1, F.lit(2.0)) * (n + 3) * (n + 5))
    x = (b - mean) / F.sqrt(var)
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + F.sqrt(1 + 4 / (root * root)))
    denom = 1 + x * F.sqrt(2 / (a - 4))
    cube = F.signum(denom) * F.cbrt((1 - 2 / a) / F.nullif(F.abs(denom), F.lit(0.0)))
    zk = (1 - 2 / (9 * a) - cube) / F.sqrt(2 / (9 * a))
    usable = t.where((n >= 8) & g.isNotNull() & ~F.isnan(g))
    return usable.select("column", (zs * zs + zk * zk).alias("k2")).withColumn("p_value", F.exp(-F.col("k2") / 2))


def ks_normal(df: DataFrame, cols: str | Sequence[str]) -> DataFrame:
    """(column, ks, p_value): greatest distance of each column's distribution from the normal with its own mean and sample deviation.

    Both suprema lie at values that occur, before and after their jump, so counts of values and their running totals over
    all columns are enough. NULL for a column that does not vary.
    """
    names = [cols] if isinstance(cols, str) else list(cols)
    return _ks_tallied(_tallied(_cells(df, names)), df, names)


def _ks_tallied(tallied: DataFrame, df: DataFrame, names: Sequence[str]) -> DataFrame:
    running = tallied.join(F.broadcast(_basics(tallied)), "column")  # one row per column
    expected = normal_cdf((F.col("value") - F.col("mean")) / F.col("std"))
    size = F.col("n").cast("double")
    apart = F.greatest(F.col("upto") / size - expected, expected - (F.col("upto") - F.col("w")) / size)
    found = {r["column"]: r for r in running.where("std > 0").groupBy("column").agg(F.max(apart).alias("d"), F.max("n").alias("n")).collect()}
    out = [(c, found[c]["d"], kolmogorov_sf(found[c]["n"], found[c]["d"])) if c in found else (c, None, None) for c in names]
    return df.sparkSession.createDataFrame(out, "column string, ks double, p_value double")


def normality_table(df: DataFrame, cols: Sequence[str], key: str | Sequence[str] | None = None, most: int | None = None) -> DataFrame:
    """(column, shapiro_w, shapiro_p, k2, k2_p, ks, ks_p, is_normal) over all rows, all columns in each job.

    Normal means a Shapiro-Wilk p above 0.05, and above 5,000 values, where its law is not known, a D'Agostino p above 0.05. With
    ``most`` Shapiro-Wilk is taken on a sample of at most that many rows by a hash of ``key``, and decides at any size.
    """
    names = list(cols)
    tallied = _tallied(_cells(df, names))
    shapiro = shapiro_wilk(df, names, key, most) if most is not None else _shapiro_tallied(tallied, df, names)
    omnibus = dagostino_k2(df, names).select("column", "k2", F.col("p_value").alias("k2_p"))
    apart = _ks_tallied(tallied, df, names).select("column", "ks", F.col("p_value").alias("ks_p"))
    joined = shapiro.join(F.broadcast(omnibus), "column", "left").join(F.broadcast(apart), "column", "left")  # one row per column
    return joined.select(
        "column", F.round("w", 4).alias("shapiro_w"), F.round("p_value", 6).alias("shapiro_p"), F.round("k2", 4).alias("k2"),
        F.round("k2_p", 6).alias("k2_p"), F.round("ks", 4).alias("ks"), F.round("ks_p", 6).alias("ks_p"),
        F.coalesce(F.coalesce("p_value", "k2_p") > 0.05, F.lit(False)).alias("is_normal"),
    )


def qq_points(df: DataFrame, col: str, n_points: int = 99) -> DataFrame:
    """(point, theoretical, sample, fitted): sample quantiles against normal ones on an even grid, with the least-squares line.

    The grid runs over the 0..1 quantiles of the sample; the matching normal probabilities
    run from 0.01 to 0.99.
    """
    qs = [i / (n_points - 1) for i in range(n_points)]
    wide = quantiles_long(df, [col], qs)
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("point"),
                F.lit(normal_ppf(0.01 + 0.98 * q)).alias("theoretical"),
                F.col(q_name(q)).alias("sample"),
            )
            for i, q in enumerate(qs)
        ]
    )
    points = wide.select(F.explode(entries).alias("e")).select("e.*")
    line = scalar_row(points.agg(F.regr_slope("sample", "theoretical").alias("s"), F.regr_intercept("sample", "theoretical").alias("i")))
    return points.withColumn("fitted", line["i"] + line["s"] * F.col("theoretical"))


# ------------------------------------------------------------------ shape, lines, importance


def skew_class(skew: Column) -> Column:
    return F.when(skew > 0.5, F.lit("right-skewed")).when(skew < -0.5, F.lit("left-skewed")).otherwise(F.lit("symmetric"))


def distribution_shape(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, skewness, skew_class, kurtosis, tail_class, cv, variability, outliers_2s)."""
    from sondage.operators.profile import sigma_counts

    t = numeric_base(df, cols, fields=("n", "mean", "std", "skew", "kurt")).join(
        F.broadcast(sigma_counts(df, cols, 2.0).drop("position")), "column"
    )
    cv = F.coalesce(F.try_divide(F.col("std"), F.col("mean")), F.lit(0.0))
    tail = F.when(F.col("kurt") > 2, "heavy-tailed").when(F.col("kurt") < -2, "light-tailed").otherwise("normal-tailed")
    spread = F.when(cv < 0.1, "very low").when(cv < 0.3, "moderate").otherwise("high")
    return t.select(
        "column", F.col("skew").alias("skewness"), skew_class(F.col("skew")).alias("skew_class"), F.col("kurt").alias("kurtosis"),
        tail.alias("tail_class"), cv.alias("cv"), spread.alias("variability"), F.col("outliers").alias("outliers_2s"),
    )


def ols_line(df: DataFrame, x: str, y: str, by: str | None = None) -> DataFrame:
    """(by, slope, intercept, r2, n): least-squares line overall or per group."""
    a, b = as_double(quoted(x)), as_double(quoted(y))
    aggs = [
        F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), F.regr_r2(b, a).alias("r2"),
        F.regr_count(b, a).alias("n"),
    ]
    return df.na.drop(subset=[by]).groupBy(quoted(by)).agg(*aggs) if by else df.agg(*aggs)


def important_columns(df: DataFrame, k: int = 5, types: dict | None = None, distinct: dict | None = None) -> DataFrame:
    """(column, score, logical_type): columns by how much they vary, best k.

    numeric: coefficient of variation x distinct; categorical: entropy x ln(distinct + 1);
    date: years x 10; text: mean length x distinct / 100; boolean 0. Values are told apart by digests, but for the categories;
    ``distinct`` holds the counts of all columns if they are known.
    """
    types = types or logical_types(df)
    cols = list(types)
    wide = []
    for i, c in enumerate(cols):
        x = quoted(c)
        numeric, date, text = types[c] == "numeric", types[c] == "date", types[c] == "text"
        none = F.lit(None).cast("double")
        wide += [
            F.count(x).alias(f"_{i}_n"),
            (F.avg(as_double(x)) if numeric else F.max(none)).alias(f"_{i}_mean"),
            (F.stddev_samp(as_double(x)) if numeric else F.max(none)).alias(f"_{i}_std"),
            (F.size(F.collect_set(F.year(x))) if date else F.max(F.lit(None).cast("int"))).alias(f"_{i}_years"),
            (F.avg(F.length(x.cast("string"))) if text else F.max(none)).alias(f"_{i}_len"),
        ]
    from sondage.plans.values import wide_to_long

    base = wide_to_long(df.agg(*wide), cols, ["n", "mean", "std", "years", "len"])
    counted = [c for c in cols if types[c] in ("numeric", "text")]
    if distinct is None:
        levels = nunique_table(df, counted).select("column", "nunique") if counted else None
    else:
        levels = table_of(df, [{"column": c, "nunique": distinct[c]} for c in counted], "column string,nunique long")
    entropies = distinct_stats(df, [c for c in cols if types[c] == "categorical"]).select("column", "nunique", "entropy")
    known = entropies if levels is None else entropies.unionByName(levels.withColumn("entropy", F.lit(None).cast("double")))
    t = base.join(F.broadcast(known), "column", "left").where(F.col("n") > 0)
    kind = F.create_map(*[e for c in cols for e in (F.lit(c), F.lit(types[c]))])[F.col("column")]
    score = (
        F.when(kind == "numeric", F.coalesce(F.try_divide(F.col("std"), F.col("mean")), F.lit(0.0)) * F.col("nunique"))
        .when(kind == "categorical", F.col("entropy") * F.ln(F.col("nunique") + 1))
        .when(kind == "date", F.col("years") * 10.0)
        .when(kind == "text", F.col("len") * F.col("nunique") / 100)
        .otherwise(F.lit(0.0))
    )
    ranked = t.select("column", F.round(score, 2).alias("score"), kind.alias("logical_type"), "position")
    return ranked.orderBy(F.desc("score"), "position").limit(k).drop("position")
