"""Embedding near duplicates: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sondage.functions.columns import quoted
from sondage.llm.common import components, groups, held, shards


def vectors(df: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>, usable): usable vectors are not null, not empty, not zero, and all finite."""
    v = quoted(column).cast("array<double>")
    big = F.lit(float("inf"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == big))
    fine = v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    return df.select(quoted(id_column).cast("long").alias("vec_id"), v.alias("v"), fine.alias("usable"))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, without overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (a power of two long)."""
    n, width = x.shape
    h = 1
    while h < width:
        x = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        h *= 2
    return x.reshape(n, width)


def codes(x: np.ndarray, tables: int, parts: int, probes: int, seed: int) -> np.ndarray:
    """[row, table, probe]: bucket numbers of unit vectors.

    A table joins ``parts`` cross-polytope hashes, each the nearest signed axis after three rounds of random signs and Hadamard
    rotation. The first probe is the bucket itself; each further one replaces the least certain hash by its runner-up.
    """
    n, d = x.shape
    width = 1 << max(int(d - 1).bit_length(), 1)
    wide = np.zeros((n, width))
    wide[:, :d] = x
    rng = np.random.default_rng([seed, d])
    out = np.empty((n, tables, 1 + probes), dtype=np.int64)
    for t in range(tables):
        best, second, gap = [], [], []
        for _ in range(parts):
            y = wide
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], width)) / np.sqrt(width)
            size = np.abs(y)
            top = np.argpartition(size, width - 2, axis=1)[:, -2:]
            val = np.take_along_axis(size, top, axis=1)
            order = np.lexsort((top, -val), axis=1)
            top = np.take_along_axis(top, order, axis=1)
            val = np.take_along_axis(val, order, axis=1)
            sign = np.take_along_axis(y, top, axis=1) < 0
            axis = 2 * top + sign
            best.append(axis[:, 0])
            second.append(axis[:, 1])
            gap.append(val[:, 0] - val[:, 1])
        gap = np.argsort(np.stack(gap, axis=1), axis=1, kind="stable")
        hashes = np.stack(best, axis=1)
        runner = np.stack(second, axis=1)
        for p in range(1 + probes):
            h = hashes.copy()
            if p:
                swap = gap[:, min(p, parts) - 1 : min(p, parts)]
                np.put_along_axis(h, swap, np.take_along_axis(runner, swap, axis=1), axis=1)
            code = np.zeros(n, dtype=np.int64)
            for j in range(parts):
                code = code * (2 * width) + h[:, j]
            out[:, t, p] = code
    return out


def near_duplicates(df: DataFrame, threshold: float = 0.95, id_column: str = "vec_id", column: str = "embedding", tables: int = 8, parts: int = 3, probes: int = 1, seed: int = 42, most: int = 4_096) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; vectors are linked at a cosine of ``threshold`` or more, in doubles.

    Equal vectors are one class, linked by definition, and only classes are hashed. Classes that share a bucket are candidates;
    each pair is counted in the first bucket that it shares (by table, then number), so a task can count links without
    gathering pairs. A bucket returns sums and one edge per class; an over-full one is cut into pairs of pieces.

    Defined cases: a vector that is null, empty, zero, or holds a null or non-finite component has no link and is its own
    component; vectors of different lengths are not compared; repeated rows are rows of their own, and rows that share a
    ``vec_id`` but not the vector are judged apart; rows without ``vec_id`` take part, and their component is null if it holds no id;
    an empty table gives an empty result. Other columns are ignored.
    """
    rows = vectors(df, id_column, column)
    classes = rows.where("usable").groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"))
    digest = F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(k), "v")), 16, "0") for k in (0, 1)])  # rows of one id may hold different vectors
    classes = classes.withColumn("key", F.unhex(digest))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.diff(b.column("v").offsets.to_numpy())
            for d in np.unique(size).tolist():
                own = b.filter(pa.array(size == d))
                x = unit(matrix(own.column("v")))
                c = np.concatenate([codes(x[lo : lo + 1000], tables, parts, probes, seed) for lo in range(0, len(x), 1000)])
                c += (np.arange(tables, dtype=np.int64) << 44)[None, :, None] + (np.int64(d) << 48)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(c.ravel()), tables * (1 + probes)).cast(pa.list_(pa.int64()))
                yield pa.record_batch([own.column(k) for k in ("key", "least", "n", "v")] + [flat], names=["key", "least", "n", "v", "codes"])

    classes = held(classes.mapInArrow(place, "key binary, least long, n long, v array<double>, codes array<long>"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["bucket", "shard_a", "shard_b"]):
            key, n, piece = (g.column(k).to_numpy() for k in ("key", "n", "piece"))  # key: 128 bits of the vector
            every, x = matrix(g.column("codes")).reshape(len(key), tables, 1 + probes), unit(matrix(g.column("v")))
            bucket = g.column("bucket")[0].as_py()
            split = g.column("shard_a")[0].as_py() != g.column("shard_b")[0].as_py()
            links, label = np.zeros(len(key), dtype=np.int64), np.arange(len(key))
            for lo in range(0, len(key), 512):
                near = x[lo : lo + 512] @ x.T >= threshold
                near[np.arange(len(near)), np.arange(lo, lo + len(near))] = False
                if split:
                    near &= piece[lo : lo + 512, None] != piece[None, :]
                a, b = np.nonzero(near)
                first = _is_first(every[lo + a], every[b], bucket)
                np.add.at(links, lo + a[first], n[b[first]])
                for i in np.unique(a).tolist():
                    seen = np.unique(label[np.append(np.flatnonzero(near[i]), lo + i)])
                    if len(seen) > 1:
                        label[np.isin(label, seen)] = seen[0]
            moved = (label != np.arange(len(key))) | (links > 0)
            if moved.any():
                yield pa.record_batch([pa.array(key[moved]), pa.array(key[label[moved]]), pa.array(links[moved])], names=["a", "b", "links"])

    entries = classes.select("key", F.explode(F.array_distinct("codes")).alias("bucket"))
    dealt = shards(entries, "bucket", "key", most, classes.select("key", "n", "v", "codes"))
    found = held(dealt.mapInArrow(compare, "a binary, b binary, links long"))
    sums = found.groupBy("a").agg(F.sum("links").alias("links"))
    reach = components(found.select("a", "b"))
    owner = classes.join(reach, classes["key"] == reach["id"], "left").select("v", "key", "n", "least", F.coalesce("component", "key").alias("c"))
    least = owner.groupBy("c").agg(F.min("least").alias("component_id"))
    named = owner.join(least, "c").join(sums, owner["key"] == sums["a"], "left")
    named = named.select(F.col("v").alias("v_"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = rows.withColumn("v", F.when(F.col("usable"), F.col("v"))).join(named, F.col("v") == F.col("v_"), "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(True)).alias("kept"))


def _is_first(a: np.ndarray, b: np.ndarray, bucket: int) -> np.ndarray:
    """For pairs of [table, probe] bucket numbers that share ``bucket``: whether it is the least number that they share."""
    out = np.ones(len(a), dtype=bool)
    table = (bucket >> 44) & 15
    for lo in range(0, len(a), 50_000):
        x, y, ok = a[lo : lo + 50_000], b[lo : lo + 50_000], out[lo : lo + 50_000]
        for t in range(table + 1):
            same = x[:, t, :, None] == y[:, t, None, :]
            if t == table:
                same &= x[:, t, :, None] < bucket
            ok &= ~same.any(axis=(1, 2))
    return out
