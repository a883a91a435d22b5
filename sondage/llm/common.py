"""What several operators share: held results, vectorised words, streamed groups, packed shards, components."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sondage.functions.columns import quoted
from sondage.session import materialize

U = np.uint64


def held(df: DataFrame) -> DataFrame:
    """Result written once to the shared checkpoint folder, for a table that several jobs read.

    The shuffle files behind it are of no more use; executors remove them when the driver's collector finds them unused, so it is asked to look.
    """
    jvm = df.sparkSession.sparkContext._jvm
    out = materialize(df)
    del df
    jvm.System.gc()
    return out


def documents(df: DataFrame, *more: str) -> DataFrame:
    """Only the columns in use: ``doc_id``, ``text`` as UTF-8 bytes (null: empty), then ``more``; other columns may have any name."""
    return df.select(
        quoted("doc_id").cast("long").alias("doc_id"),
        F.coalesce(quoted("text"), F.lit("")).cast("binary").alias("text"),
        *[quoted(c).alias(c) for c in more],
    )


def remainder(column: str, divisor: int) -> Column:
    """crc32 of the id written as text, modulo ``divisor`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(quoted(column).cast("string"), F.lit("")).cast("binary")) % divisor


# ------------------------------------------------------------------ words


def scramble(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixing."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = scramble(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
_PLACE = np.zeros(0, dtype=np.uint64)


def places(n: int) -> np.ndarray:
    """At least n odd multipliers, one per byte position."""
    global _PLACE
    if len(_PLACE) < n:
        _PLACE = scramble(np.arange(1, max(n, 1024) + 1, dtype=np.uint64) * U(0xD1342543DE82EF95)) | U(1)
    return _PLACE


class Words:
    """Words of a chunk of documents: byte ``starts`` and ``ends``, and ``bounds``: document i has words bounds[i] to bounds[i+1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.filled = ~SPACE[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        first = self.filled.copy()
        first[1:] &= ~self.filled[:-1] | edge[1:-1]
        last = self.filled.copy()
        last[:-1] &= ~self.filled[1:] | edge[1:-1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, longest: int | None = None) -> np.ndarray:
        """64-bit hash of every word; with ``longest``, of its first bytes only."""
        if not len(self.starts):
            return np.zeros(0, dtype=np.uint64)
        length = self.ends - self.starts
        at = np.cumsum(length) - length
        place = np.arange(int(length.sum())) - np.repeat(at, length)
        part = _BYTE[self.data[self.filled]] * places(int(length.max()))[place]
        if longest is not None:
            part[place >= longest] = 0
            length = np.minimum(length, longest)
        return scramble(np.add.reduceat(part, at) + length.astype(np.uint64) * U(0x9E3779B97F4A7C15))

    def of(self, i: int) -> list[bytes]:
        """The words of document i."""
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes().split()


def beginnings(row: np.ndarray, lo: np.ndarray, hi: np.ndarray, of: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes, as ``Words`` has them, of the beginnings up to ``ends`` of spans ``of`` those that make up ``row``."""
    size = hi - lo
    part = _BYTE[row] * places(int(size.max(initial=0)))[np.arange(len(row)) - np.repeat(lo, size)]
    upto = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(part)])
    return scramble(upto[ends] - upto[lo[of]] + (ends - lo[of]).astype(np.uint64) * U(0x9E3779B97F4A7C15))


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(different values by first place, first places, which of them each is)."""
    which, values = pd.factorize(hashes)
    new = np.flatnonzero(which > np.concatenate([[-1], np.maximum.accumulate(which)[:-1]])) if len(which) else np.zeros(0, dtype=np.int64)
    return values, new, which


def gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, tail: bytes = b" ") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the spans in a row with ``tail`` after each, and the spans in them."""
    size, more = ends - starts, len(tail)
    to = np.cumsum(size + more)
    lo = to - size - more
    out = data[np.minimum(np.repeat(starts - lo, size + more) + np.arange(to[-1] if len(to) else 0), max(len(data) - 1, 0))]
    for i, b in enumerate(tail):
        out[to - more + i] = b
    return out, lo, to - more


def lowered(row: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the capitals of Latin-1 (in UTF-8) in lower case."""
    row = LOWER[row]
    row[np.flatnonzero((row[:-1] == 0xC3) & (row[1:] >= 0x80) & (row[1:] <= 0x9E) & (row[1:] != 0x97)) + 1] += 0x20
    return row


_LETTER, _SECOND = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_SECOND[[x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)]] = True  # after C3


def letters(row: np.ndarray) -> np.ndarray:
    """Whether bytes belong to letters a-z or letters of Latin-1 (in UTF-8)."""
    out = _LETTER[row]
    two = np.flatnonzero((row[:-1] == 0xC3) & _SECOND[row[1:]])
    out[two] = out[two + 1] = True
    return out


def chunks(column: pa.Array, most: int = 1_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Parts of a binary column of about ``most`` bytes (one document at least): from row, to row, bytes, offsets."""
    if not len(column):
        return
    wide = pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, side="right")) - 1)
        hi = min(hi, len(column))
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi
    release()


def release() -> None:
    """Give memory that a worker has freed back to the machine, so that idle workers stay small."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


# ------------------------------------------------------------------ groups of a sorted partition


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of equal ``keys`` of a partition that is sorted by them, one group in memory at a time."""
    open_: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        step = np.zeros(batch.num_rows, dtype=bool)
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            step[1:] |= v[1:] != v[:-1]
            if open_ and open_[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py():
                step[0] = True
        cut = np.flatnonzero(step).tolist()
        at = 0
        for c in [*cut, batch.num_rows]:
            if c > at:
                open_.append(batch.slice(at, c - at))
            if c < batch.num_rows and open_:
                yield pa.Table.from_batches(open_)
                open_ = []
            at = c
    if open_:
        yield pa.Table.from_batches(open_)


def shards(entries: DataFrame, bucket: str, member: str, most: int, attach: DataFrame | None = None) -> DataFrame:
    """Entries of every bucket that holds two members or more, cut into shards of at most about 2 x ``most`` entries.

    A larger bucket is dealt into pieces by a hash of ``member``, and each pair of pieces is a shard of its own, so that any
    two members meet in some shard and none is gathered whole. Adds ``shard_a`` and ``shard_b``; partitions are sorted by
    (bucket, shard_a, shard_b).
    """
    sizes = entries.groupBy(bucket).agg(F.count(F.lit(1)).alias("n_")).where("n_ > 1")
    pieces = F.ceil(F.col("n_") / most).cast("int")
    own = F.pmod(F.xxhash64(F.col(member), F.lit(7)), pieces).cast("int")
    dealt = (
        entries.join(sizes, bucket)
        .withColumn("pieces_", pieces).withColumn("piece", own)
        .withColumn("other_", F.explode(F.sequence(F.lit(0), F.col("pieces_") - 1)))
        .withColumn("shard_a", F.least("piece", "other_")).withColumn("shard_b", F.greatest("piece", "other_"))
        .drop("n_", "pieces_", "other_")
    )
    if attach is not None:
        dealt = dealt.join(attach, member)
    return dealt.repartition(bucket, "shard_a", "shard_b").sortWithinPartitions(bucket, "shard_a", "shard_b")


# ------------------------------------------------------------------ connected components


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every vertex of ``edges`` (a, b): the smallest vertex it reaches.

    Alternating large-star and small-star rounds; each keeps at most as many edges as there were. Sums and minima are combined
    before they move, and a vertex with very many neighbours meets its minimum in a join that Spark can split.
    """
    now = held(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        moved = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = held(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(now)
        if state == before:
            break
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]
