"""Globally ordered passes without a one-task window.

Spark rows have no position.  A global running calculation over an ordered table is
done in *order buckets*: consecutive key ranges whose bounds come from a small key
sample (the driver sees at most 1,023 bounds; tables with more buckets cut them finer in tasks).  The bucket of a row is a deterministic expression of its key, so lost tasks
recompute to the same place and nothing has to be frozen.  Per-bucket subtotals give
each bucket its carry-in (one row per bucket, so that side is always small), and the
rest is an ordinary window inside a bucket.

With ``partition_by`` the same buckets run over (partition keys, order keys): a
partition that holds a third of the table is split like any other key range.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sondage.functions.columns import quoted
from sondage.plans.joins import attach, null_safe
from sondage.session import materialize, settings

_OVERSAMPLE = 32
#: Most buckets whose bounds the driver sees; more are cut out of these in tasks.
_COARSE = 1024
BUCKET = "_bucket"


def _bucket_count(df: DataFrame, rows: int) -> int:
    s = settings(df.sparkSession)
    if s.buckets:
        return s.buckets
    by_size = math.ceil(rows / s.bucket_rows)
    by_cores = min(df.sparkSession.sparkContext.defaultParallelism, rows // 2000)
    return max(1, by_size, by_cores)


@dataclass(frozen=True)
class Bounds:
    """Upper key bounds of the order buckets.

    ``coarse`` are at most 1,023 keys, whatever the table's size. Where more buckets are wanted, ``fine`` is a table of the bounds
    inside each coarse bucket (``_coarse``, ``_edges``: a sorted array of at most ``inner`` keys), made and kept by the executors.
    """

    coarse: pa.Table
    fine: DataFrame | None = None
    inner: int = 0

    def keys(self, spark, names: Sequence[str]) -> DataFrame:
        """The named key columns of all bounds."""
        out = spark.createDataFrame(self.coarse.select(names))
        if self.fine is None:
            return out
        return out.unionByName(self.fine.select(F.explode("_edges").alias("e")).select(*[F.col("e").getField(n).alias(n) for n in names]))


def _sampled(keys: DataFrame, rows: int, buckets: int) -> DataFrame:
    share = min(1.0, buckets * _OVERSAMPLE / max(rows, 1))
    return (keys if share >= 1.0 else keys.sample(share, seed=42)).distinct()


def order_bounds(df: DataFrame, keys: Sequence[str]) -> Bounds:
    """Bounds of the order buckets, from samples of about 32 keys per bucket; the driver takes those of the coarse ones only."""
    only_keys = df.select(*[quoted(k).alias(k) for k in keys])
    rows = only_keys.count()
    buckets = _bucket_count(df, rows)
    if buckets == 1:
        return Bounds(only_keys.limit(0).toArrow())
    coarse = min(buckets, _COARSE)
    ordered = _sampled(only_keys, rows, coarse).orderBy(*[quoted(k) for k in keys]).toArrow()
    step = max(1, ordered.num_rows // coarse)
    bounds = Bounds(ordered.take(list(range(step - 1, ordered.num_rows, step))[: coarse - 1]))
    if buckets <= _COARSE:
        return bounds
    # about 32 sampled keys for each fine bucket, numbered inside their coarse one; every 32nd is a bound
    each = math.ceil(buckets / coarse)
    marked = with_buckets(_sampled(only_keys, rows, buckets), keys, bounds).withColumnRenamed(BUCKET, "_coarse")
    inside = Window.partitionBy("_coarse").orderBy(*[quoted(k) for k in keys])
    sized = marked.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy("_coarse"))).withColumn("_nth", F.row_number().over(inside))
    every = F.greatest(F.lit(1), F.ceil(F.col("_size") / each))
    key = F.struct(*[quoted(k).alias(k) for k in keys])
    fine = sized.where((F.col("_nth") % every == 0) & (F.col("_nth") < F.col("_size"))).groupBy("_coarse").agg(F.array_sort(F.collect_list(key)).alias("_edges"))
    fine = materialize(fine)  # a sample drawn again could differ
    return Bounds(bounds.coarse, fine, fine.agg(F.coalesce(F.max(F.size("_edges")), F.lit(0))).first()[0])


def _below(out: DataFrame, edges: Column, size: Column, most: int, key: Column, name: str) -> DataFrame:
    """Add the number of ``edges`` (sorted, ``size`` of them and at most ``most``) that are below the key, by binary search."""
    out = out.withColumn(name, F.lit(0))
    step = 1 << (most.bit_length() - 1) if most else 0
    while step:
        probe = F.col(name) + F.lit(step - 1)
        inside = (F.col(name) + F.lit(step) <= size) & (F.get(edges, probe) < key)
        out = out.withColumn(name, F.col(name) + F.when(inside, F.lit(step)).otherwise(F.lit(0)))
        step //= 2
    return out


def with_buckets(df: DataFrame, keys: Sequence[str], bounds: Bounds) -> DataFrame:
    """Add the bucket number: how many bounds are below the row's key, among the coarse ones and then among those of its coarse bucket.

    Keys compare field by field with NULL first, so rows with a NULL in one key column are spread by the others.
    """
    size = bounds.coarse.num_rows
    if size == 0:
        return df.withColumn(BUCKET, F.lit(0))
    key = F.struct(*[quoted(k).alias(k) for k in keys])
    held = df.sparkSession.createDataFrame(bounds.coarse)
    edges = held.agg(F.array_sort(F.collect_list(F.struct(*[quoted(k).alias(k) for k in keys]))).alias("e")).scalar()
    out = _below(df, edges, F.lit(size), size, key, BUCKET)
    if bounds.fine is None:
        return out
    joined = attach(out.withColumnRenamed(BUCKET, "_coarse"), bounds.fine, ["_coarse"])
    placed = _below(joined, F.col("_edges"), F.coalesce(F.size("_edges"), F.lit(0)), bounds.inner, key, "_fine")
    return placed.withColumn(BUCKET, F.col("_coarse") * (bounds.inner + 1) + F.col("_fine")).drop("_coarse", "_fine", "_edges")


class OrderedPass:
    """Bucketed view of ``df`` in the unique order ``order_by`` inside each ``partition_by`` group."""

    def __init__(self, df: DataFrame, order_by: Sequence[str] | str, partition_by: Sequence[str] | str | None = None):
        self.order = [order_by] if isinstance(order_by, str) else list(order_by)
        self.parts = [] if partition_by is None else [partition_by] if isinstance(partition_by, str) else list(partition_by)
        keys = self.parts + self.order
        self.bounds = order_bounds(df, keys)
        self.rows = with_buckets(df, keys, self.bounds)
        inside = Window.partitionBy(*[quoted(k) for k in self.parts], F.col(BUCKET))
        self.window = inside.orderBy(*[quoted(k).asc() for k in self.order])
        self.opposite = inside.orderBy(*[quoted(k).desc() for k in self.order])

    def _small(self, table: DataFrame) -> DataFrame:
        """A table of at most two rows per bucket: broadcast while the buckets are the coarse ones, else as Spark sees fit."""
        return F.broadcast(table) if self.bounds.fine is None else table

    def subtotals(self, **aggs: Column) -> DataFrame:
        """One row per (partition crossing a bucket bound, bucket): at most two per bucket."""
        rows = self.rows
        if self.parts and self.bounds.coarse.num_rows:
            crossing = self.bounds.keys(rows.sparkSession, self.parts).distinct()
            crossing = crossing.withColumnsRenamed({p: f"_c_{p}" for p in self.parts})
            rows = rows.join(
                self._small(crossing), null_safe(rows, crossing, self.parts, [f"_c_{p}" for p in self.parts]), "left_semi"
            )
        elif self.parts:
            rows = rows.where(F.lit(False))
        return rows.groupBy(*[quoted(p) for p in self.parts], BUCKET).agg(*[c.alias(n) for n, c in aggs.items()])

    def carry(self, totals: DataFrame, **carried: Column) -> DataFrame:
        """Rows with per-bucket carry-ins joined on."""
        names = {p: f"_c_{p}" for p in self.parts}
        small = totals.select(
            *[quoted(p).alias(names[p]) for p in self.parts],
            F.col(BUCKET).alias("_c_bucket"),
            *[c.alias(n) for n, c in carried.items()],
        )
        cond = F.col(BUCKET) == F.col("_c_bucket")
        for p in self.parts:
            cond = cond & quoted(p).eqNullSafe(F.col(names[p]))
        return self.rows.join(self._small(small), cond, "left").drop("_c_bucket", *names.values())

    def bucket_window(self, forward: bool = True):
        w = Window.partitionBy(*[quoted(p) for p in self.parts])
        return w.orderBy(F.col(BUCKET).asc() if forward else F.col(BUCKET).desc()).rowsBetween(Window.unboundedPreceding, -1)


def global_prefix(
    df: DataFrame,
    value: Column,
    out: str,
    order_by: Sequence[str] | str,
    partition_by: Sequence[str] | str | None = None,
) -> DataFrame:
    """Inclusive running sum of ``value`` (NULL counts as nothing) as column ``out``."""
    zero = F.lit(0)
    work = df.withColumn("_v", value)
    p = OrderedPass(work, order_by, partition_by)
    totals = p.subtotals(_s=F.sum("_v"))
    rows = p.carry(totals, _in=F.sum("_s").over(p.bucket_window()))
    inside = F.sum("_v").over(p.window.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(out, F.coalesce(F.col("_in"), zero) + F.coalesce(inside, zero)).drop("_v", "_in", BUCKET)


def with_global_index(
    df: DataFrame, order_by: Sequence[str] | str, partition_by: Sequence[str] | str | None = None, out: str = "row_index"
) -> DataFrame:
    """Zero-based position of each row in the order (inside its partition when given)."""
    p = OrderedPass(df, order_by, partition_by)
    totals = p.subtotals(_s=F.count(F.lit(1)))
    rows = p.carry(totals, _in=F.sum("_s").over(p.bucket_window()))
    return rows.withColumn(out, F.coalesce(F.col("_in"), F.lit(0)) + F.row_number().over(p.window) - 1).drop("_in", BUCKET)


def with_halo(
    df: DataFrame, back: int, order_by: Sequence[str] | str, partition_by: Sequence[str] | str | None = None
) -> tuple[DataFrame, "Window"]:
    """Rows cut into equal position chunks, each preceded by copies of the ``back`` rows before it.

    Returns the rows (copies flagged ``_halo``) and the window inside a chunk.  Chunks are
    exact row counts, so tasks stay equal whatever the keys look like, and a frame reaching
    ``back`` rows back never leaves its chunk.
    """
    parts = [] if partition_by is None else [partition_by] if isinstance(partition_by, str) else list(partition_by)
    s = settings(df.sparkSession)
    size = max(back + 1, s.bucket_rows if not s.buckets else back + 1)
    indexed = with_global_index(df, order_by, parts or None, out="_i").withColumn("_chunk", F.floor(F.col("_i") / size))
    copies = F.when(F.col("_i") % size >= size - back, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    rows = indexed.withColumn("_halo", F.explode(copies)).withColumn(
        "_chunk", F.col("_chunk") + F.when(F.col("_halo"), F.lit(1)).otherwise(F.lit(0))
    )
    return rows, Window.partitionBy(*[quoted(p) for p in parts], F.col("_chunk")).orderBy("_i")


def drop_halo(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("_halo")).drop("_halo", "_chunk", "_i")
