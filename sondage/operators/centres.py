"""k-means with all restarts in the same passes over the rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

_CELLS = 1 << 20  # distances held at a time
_ROUNDS = 2  # rounds of oversampling, each of twice as many rows as there are clusters
_TOLERANCE = 1e-4


def packed(points: DataFrame) -> DataFrame:
    """(x): rows of numbers in blocks, each the bytes of a matrix, so that a pass reads them as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns])
                yield pa.record_batch([pa.array([np.ascontiguousarray(x, dtype=np.float64).tobytes()])], names=["x"])

    return points.mapInArrow(run, "x binary")


def _blocks(batch: pa.RecordBatch, width: int, cells: int) -> Iterator[np.ndarray]:
    step = max(_CELLS // max(cells, 1), 1)
    for value in batch.column("x"):
        x = np.frombuffer(value.as_buffer(), dtype=np.float64).reshape(-1, width)
        for at in range(0, len(x), step):
            yield x[at : at + step]


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distance of every row to every centre."""
    out = (x * x).sum(axis=1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(axis=1)
    return np.maximum(out, 0.0, out=out)


def _draw(blocks: DataFrame, width: int, sets: list[np.ndarray], most: int, seed: int, step: int) -> list[np.ndarray]:
    """For each set of centres, up to ``most`` rows drawn without replacement by their squared distance from it (alike, where a
    set is empty). Rows with the least exponential variates of those rates are such a draw, so one pass does without the total."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([seed, step, TaskContext.get().partitionId()])
        best = [(np.empty(0), np.empty((0, width))) for _ in sets]
        for b in batches:
            for x in _blocks(b, width, max(len(c) for c in sets)):
                for r, c in enumerate(sets):
                    rate = _squares(x, c).min(axis=1) if len(c) else np.ones(len(x))
                    at = np.flatnonzero(rate > 0)
                    key = np.append(best[r][0], rng.exponential(size=len(at)) / rate[at])
                    rows = np.vstack([best[r][1], x[at]])
                    least = np.argsort(key, kind="stable")[:most]
                    best[r] = key[least], rows[least]
        for r, (key, rows) in enumerate(best):
            if len(key):
                yield pa.record_batch([pa.array(np.full(len(key), r)), pa.array(key), pa.array(rows.tolist())], names=["r", "key", "x"])

    drawn = blocks.mapInArrow(run, "r long, key double, x array<double>")
    order = Window.partitionBy("r").orderBy("key", "x")
    drawn = drawn.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    out = [[] for _ in sets]
    for row in drawn.orderBy("r", "_n").collect():  # at most ``most`` rows a set
        out[row["r"]].append(row["x"])
    return [np.vstack([c, np.array(o).reshape(-1, width)]) for c, o in zip(sets, out)]


def _sums(blocks: DataFrame, width: int, sets: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For each set of centres in one pass: rows nearest to each centre, their sums, and the cost of all rows."""
    first = np.append(0, np.cumsum([len(c) for c in sets]))
    every = np.vstack(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(every), width + 2))  # rows, cost, sums
        for b in batches:
            for x in _blocks(b, width, len(every)):
                away = np.ascontiguousarray(_squares(x, every).T)  # a row for each centre, so that comparing centres runs along rows
                facts = np.column_stack([np.ones(len(x)), x])
                for lo, hi in zip(first, first[1:]):
                    least = away[lo:hi].min(axis=0)
                    near, open_ = away[lo:hi] == least, np.ones(len(x), dtype=bool)
                    for j in range(hi - lo):  # the first of equally near centres
                        near[j] &= open_
                        open_ &= ~near[j]
                    near[0] |= open_  # distances that are no numbers
                    put = near.astype(np.float64)
                    total[lo:hi, [0, *range(2, width + 2)]] += put @ facts
                    total[lo:hi, 1] += put @ least
        used = np.flatnonzero(total[:, 0])
        yield pa.record_batch([pa.array(used), *[pa.array(total[used, j]) for j in range(width + 2)]], names=["c", *names])

    names = [f"s{j}" for j in range(width + 2)]
    parts = blocks.mapInArrow(run, "c long," + ",".join(f"{n} double" for n in names))
    total = np.zeros((len(every), width + 2))
    for row in parts.groupBy("c").agg(*[F.sum(n).alias(n) for n in names]).collect():  # one row a centre
        total[row["c"]] = row[1:]
    return [(t[:, 0], t[:, 2:], float(t[:, 1].sum())) for t in np.split(total, first[1:-1])]


def _reduce(candidates: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` of the weighted candidates, spread by k-means++ and settled by weighted means."""
    chosen = [int(rng.choice(len(candidates), p=weight / weight.sum()))]
    while len(chosen) < k:
        rate = weight * _squares(candidates, candidates[chosen]).min(axis=1)
        rate[chosen] = 0
        if not rate.sum() > 0:
            break
        chosen.append(int(rng.choice(len(candidates), p=rate / rate.sum())))
    centres = candidates[chosen]
    for _ in range(30):
        near = _squares(candidates, centres).argmin(axis=1)
        load = np.bincount(near, weight, len(centres))
        sums = np.column_stack([np.bincount(near, weight * candidates[:, j], len(centres)) for j in range(candidates.shape[1])])
        moved = np.where(load[:, None] > 0, sums / np.maximum(load, 1e-300)[:, None], centres)
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


def _means(centres: np.ndarray, load: np.ndarray, sums: np.ndarray) -> np.ndarray:
    return np.where(load[:, None] > 0, sums / np.maximum(load, 1)[:, None], centres)


def best_centres(blocks: DataFrame, width: int, k: int, seed: int, restarts: int, rounds: int = 20) -> np.ndarray:
    """Centres of the cheapest of ``restarts`` runs of k-means over the :func:`packed` rows of ``width`` numbers, sorted; fewer than ``k`` where
    there are fewer different rows, none for an empty table.

    Every pass over the rows serves all runs: a first row for each, two rounds that draw 2k far rows for each, the weights of
    those candidates, then at most ``rounds`` of Lloyd's steps (a settled run leaves the passes) and the costs. The driver holds
    restarts x (4k + 1) candidates. ``blocks`` is read once a pass and has to be cheap to read and stable.
    """
    sets = _draw(blocks, width, [np.empty((0, width))] * restarts, 1, seed, 0)
    if not len(sets[0]):
        return sets[0]
    for step in range(_ROUNDS):
        sets = _draw(blocks, width, sets, 2 * k, seed, step + 1)
    weights = _sums(blocks, width, sets)
    sets = [_reduce(c, w, k, np.random.default_rng([seed, r])) for r, (c, (w, _, _)) in enumerate(zip(sets, weights))]
    open_ = list(range(restarts))
    for _ in range(rounds):
        moving = []
        for r, (load, sums, _) in zip(open_, _sums(blocks, width, [sets[r] for r in open_])):
            moved = _means(sets[r], load, sums)
            if np.sqrt(((moved - sets[r]) ** 2).sum(axis=1)).max() > _TOLERANCE:
                moving.append(r)
            sets[r] = moved
        open_ = moving
        if not open_:
            break
    cost = [c for _, _, c in _sums(blocks, width, sets)]
    best = sets[int(np.argmin(cost))]
    return best[np.lexsort(best.T[::-1])]
