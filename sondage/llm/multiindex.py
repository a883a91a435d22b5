"""Approximate nearest neighbours by multi-index hashing: learned rotated binary codes, substring tables, float reranking."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sondage.functions.columns import quoted
from sondage.llm.crosspolytope import matrix, unit, vectors

PIECE = 8  # bits of a substring


def learn_rotations(x: np.ndarray, bits: int, rounds: int = 15, seed: int = 42) -> np.ndarray:
    """[d, bits] projections by iterative quantisation: each block of d bits is a rotation of the (scaled) principal axes
    moved towards the corners of the cube, each from another random start."""
    d = x.shape[1]
    rng = np.random.default_rng(seed)
    out = []
    made = 0
    while made < bits:
        r, _ = np.linalg.qr(rng.standard_normal((d, d)))
        for _ in range(rounds):
            b = np.where(x @ r >= 0, 1.0, -1.0)
            u, _, v = np.linalg.svd(x.T @ b)
            r = u @ v
        take = min(d, bits - made)
        out.append(r[:, :take])
        made += take
    return np.concatenate(out, axis=1)


def encode(x: np.ndarray, rotations: np.ndarray) -> np.ndarray:
    """[row, byte] binary codes."""
    return np.packbits(x @ rotations >= 0, axis=1)


class Index:
    """Substring tables over codes: for every byte position the rows by byte value."""

    def __init__(self, codes: np.ndarray):
        self.n, self.pieces = codes.shape
        self.columns = [np.ascontiguousarray(codes[:, j]) for j in range(self.pieces)]
        self.order = [np.argsort(c, kind="stable").astype(np.int32) for c in self.columns]
        self.edge = [np.searchsorted(c[o], np.arange(257)).tolist() for c, o in zip(self.columns, self.order)]
        self.step = 8 if self.pieces % 8 == 0 else 1
        self.wide = [np.ascontiguousarray(x) for x in self._words(codes).T]

    def _words(self, codes: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(codes).view(np.uint64) if self.step == 8 else codes

    def near(self, code: np.ndarray, least: int) -> np.ndarray:
        """All rows within the smallest Hamming radius that holds ``least`` rows (all, if there are no more).

        Radii grow by rings (0, 1, 3, 5 bits): after probing all substring values within s bits, every row within pieces x (s + 1) - 1 bits has
        been met (pigeonhole), so counts up to that radius are exact. A ring of few values is read from the substring tables'
        lists, one of many values by a look at each row's substring. Distances are taken once, when a row is first met.
        """
        if self.n <= least:
            return np.arange(self.n)
        own = self._words(code)
        away = np.full(self.n, 8 * self.pieces + 1, dtype=np.int16)
        met = np.zeros(self.n, dtype=bool)
        for s, ring in _RINGS:
            hit = np.zeros(self.n, dtype=bool)
            for j in range(self.pieces):
                values = ring ^ code[j]
                if len(ring) > 10:
                    asked = np.zeros(256, dtype=bool)
                    asked[values] = True
                    hit |= asked.take(self.columns[j], mode="clip")
                else:
                    order, edge = self.order[j], self.edge[j]
                    for v in values.tolist():
                        hit[order[edge[v] : edge[v + 1]]] = True
            new = np.flatnonzero(hit & ~met)
            met |= hit
            away[new] = sum(np.bitwise_count(w[new] ^ x).astype(np.int16) for w, x in zip(self.wide, own))
            if len(new) and (away <= self.pieces * (s + 1) - 1).sum() >= least:
                return np.flatnonzero(away <= np.partition(away, least - 1)[least - 1])
        return np.arange(self.n)


def _ring(low: int, high: int) -> np.ndarray:
    """Substring differences of ``low`` to ``high`` bits."""
    return np.array([sum(1 << i for i in c) for s in range(low, high + 1) for c in combinations(range(PIECE), s)], dtype=np.uint8)


#: (bits, differences up to them that the ring before does not hold)
_RINGS = [(0, _ring(0, 0)), (1, _ring(1, 1)), (3, _ring(2, 3)), (5, _ring(4, 5)), (PIECE, _ring(6, PIECE))]


def _dealt(n: int, size: int, seed: int) -> Column:
    """Which of ceil(n / size) groups a row belongs to, by a hash of its id."""
    return F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(max(1, -(-n // size)))).cast("int")


def nearest(
    df: DataFrame, queries: DataFrame, k: int = 20, id_column: str = "vec_id", column: str = "embedding", bits: int = 256, depth: int = 2_048,
    sample: int = 4_096, shard: int = 65_536, block: int = 1_024, seed: int = 42,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of ``df`` found with the largest inner product with each query row.

    Rotations are learned from at most ``sample`` rows (least hashes); every row is indexed. Rows are dealt into shards and queries
    into blocks; a block meets a shard in one task, which indexes the shard and keeps the best k of each query. In a shard a
    query takes every code within the Hamming radius that holds ``depth`` codes, and ranks those by exact inner products in
    doubles; ties go to the smaller id. Codes are of directions; where lengths differ, a query also meets the longest
    ``depth`` rows of the shard, as they can win by length alone.

    Defined cases: a vector that is null, empty, zero or holds a null or non-finite component takes no part, neither as row nor as
    query; vectors of other lengths are no candidates; a row is no candidate of a query with its id; rows without id take no
    part; of repeated rows of one id and vector, one is a candidate; an empty table gives an empty result.
    """
    spark = df.sparkSession
    fine = vectors(df, id_column, column).where("usable and vec_id is not null").select("vec_id", "v").distinct()
    asked = vectors(queries, id_column, column).where("usable and vec_id is not null").select("vec_id", "v").distinct()
    n, m = fine.count(), asked.count()
    some = fine.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()  # at most ``sample`` rows
    fits: dict[int, np.ndarray] = {}
    rows = some.column("v").combine_chunks() if some.num_rows else pa.array([], pa.list_(pa.float64()))
    lengths = np.array([len(x) for x in rows.to_pylist()], dtype=np.int64)
    for d in np.unique(lengths).tolist():
        fits[d] = learn_rotations(unit(matrix(rows.filter(pa.array(lengths == d)))), bits, seed=seed)
    shared = spark.sparkContext.broadcast(fits)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for d in np.unique(_lengths(right)).tolist():
            base, ask = _of_length(left, d), _of_length(right, d)
            if not base.num_rows or not ask.num_rows:
                continue
            turn = shared.value.get(d)
            if turn is None:  # a length that the sample missed
                turn = learn_rotations(np.eye(d), bits, seed=seed)
            x, q = matrix(base.column("v")), matrix(ask.column("v"))
            ids = base.column("vec_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            x, ids = x[order], ids[order]
            index = Index(encode(unit(x), turn))
            size = np.linalg.norm(x, axis=1)
            long = np.argsort(-size, kind="stable")[:depth] if len(size) and size.max() > 1.001 * size.min() else np.zeros(0, dtype=np.int64)
            for own, code, v in zip(ask.column("vec_id").to_pylist(), encode(unit(q), turn), q):
                rows = index.near(code, depth)
                rows = np.union1d(rows, long) if len(long) else rows
                rows = rows[ids[rows] != own]
                score = x[rows] @ v
                if len(rows) > k:
                    edge = np.partition(score, len(score) - k)[len(score) - k]
                    keep = score >= edge
                    rows, score = rows[keep], score[keep]
                best = np.lexsort((ids[rows], -score))[:k]
                out.append((np.full(len(best), own), ids[rows[best]], score[best]))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    shards, blocks = max(1, -(-n // shard)), max(1, -(-m // block))
    base = fine.withColumn("s", _dealt(n, shard, 1)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    ask = asked.withColumn("b", _dealt(m, block, 2)).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    found = base.groupBy("s", "b").cogroup(ask.groupBy("s", "b")).applyInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _lengths(t: pa.Table) -> np.ndarray:
    return np.diff(t.column("v").combine_chunks().offsets.to_numpy()) if t.num_rows else np.zeros(0, dtype=np.int64)


def _of_length(t: pa.Table, d: int) -> pa.Table:
    return t.filter(pa.array(_lengths(t) == d)) if t.num_rows else t
