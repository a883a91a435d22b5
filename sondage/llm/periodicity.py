"""Runs: maximal periodic stretches of words, found from Lyndon roots.

Phase one of Baier's suffix sorter keeps positions in groups of equal Lyndon prefixes and refines lower groups by higher ones,
from the highest down. A group's prefix is as long as the longest Lyndon word at its positions, so the phase yields the Lyndon
array without sorting suffixes. A run with period q has a Lyndon word of length q as the longest at some position, under the
order of words or under the reversed one; every such root is extended to both sides by longest common extensions.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sondage.llm.common import Words, chunks, documents, release

# ------------------------------------------------------------------ Lyndon arrays


def lyndon_array(word: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each position of ``word`` (symbols are small non-negative numbers).

    ``left`` and ``right`` link the positions whose groups are not done. While group g is processed, the position left of a
    member in that list is the nearest one with a smaller suffix group: its prefix is followed by copies of g's prefix.
    Each position is moved at most once for each later position, so moves are at most ``len(word)`` in all.
    """
    n = len(word)
    symbols = sorted(set(word))
    number = {c: g for g, c in enumerate(symbols)}
    group = [number[c] for c in word]
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    reach = [1] * len(symbols)
    below = list(range(-1, len(symbols) - 1))
    above = list(range(1, len(symbols) + 1))
    above[-1:] = [-1]
    left, right = list(range(-1, n)), list(range(1, n + 2))  # position n stands for both ends
    lengths = [0] * n
    g = len(symbols) - 1
    while g >= 0:
        span = reach[g]
        mine = [i for i in members[g] if group[i] == g]
        members[g] = []
        owner: dict[int, int] = {}
        copies: dict[int, int] = {}
        for i in mine:
            lengths[i] = span
            p = left[i]
            if p >= 0 and group[p] == g:
                p = owner[p]
            owner[i] = p
            if p >= 0:
                copies[p] = copies.get(p, 0) + 1
        for i in mine:
            p, r = left[i], right[i]
            left[r] = p
            if p >= 0:
                right[p] = r
        by_times: dict[int, list[int]] = {}
        for p, c in copies.items():
            by_times.setdefault(c, []).append(p)
        for times in sorted(by_times, reverse=True):
            split: dict[int, int] = {}
            for p in by_times[times]:
                old = group[p]
                new = split.get(old)
                if new is None:
                    new = split[old] = len(reach)
                    reach.append(reach[old] + times * span)
                    members.append([])
                    upper = above[old]
                    above.append(upper)
                    below.append(old)
                    above[old] = new
                    if upper >= 0:
                        below[upper] = new
                group[p] = new
                members[new].append(p)
        g = below[g]
    return lengths


# ------------------------------------------------------------------ common extensions


class Extensions:
    """Longest common extensions of two positions of an array, to the right and to the left, for many pairs at once.

    ``names[k]`` numbers the different stretches of 2^k symbols, up to stretches of ``longest`` symbols.
    """

    def __init__(self, symbols: np.ndarray, longest: int):
        self.size = len(symbols)
        self.names = [np.unique(symbols, return_inverse=True)[1].astype(np.int64)]
        width = 1
        while 2 * width <= min(longest, self.size):
            low = self.names[-1]
            pair = low[: len(low) - width] * (int(low.max()) + 1) + low[width:]
            self.names.append(np.unique(pair, return_inverse=True)[1].astype(np.int64))
            width *= 2

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that agree from a and from b on (a < b)."""
        return self._extend(a, b, 1)

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that agree before a and before b (a < b)."""
        return self._extend(a, b, -1)

    def _extend(self, a: np.ndarray, b: np.ndarray, way: int) -> np.ndarray:
        got = np.zeros(len(a), dtype=np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            names, width = self.names[k], 1 << k
            open_ = np.arange(len(a))
            while len(open_):  # the widest stretches may fit several times
                x, y = (a[open_] + got[open_], b[open_] + got[open_]) if way > 0 else (a[open_] - got[open_] - width, b[open_] - got[open_] - width)
                fits = (x >= 0) & (y < len(names))
                same = np.zeros(len(open_), dtype=bool)
                same[fits] = names[x[fits]] == names[y[fits]]
                open_ = open_[same]
                got[open_] += width
                if k < len(self.names) - 1:
                    break
        return got


# ------------------------------------------------------------------ runs


def runs(symbols: np.ndarray, bounds: np.ndarray, least: int = 6, power: int = 4) -> np.ndarray:
    """(start, length, period) of every run of the texts symbols[bounds[t]:bounds[t+1]], by start and period.

    A run has its smallest period q, at least max(``least``, ``power`` * q) symbols, and cannot be extended to either side within
    its text. Every symbol of a run occurs in its text at least ``power`` times, so rarer ones part a text into pieces
    that hold runs whole; pieces shorter than ``least`` hold none.
    """
    pieces = _pieces(symbols, bounds, least, power)
    if not len(pieces):
        return np.zeros((0, 3), dtype=np.int64)
    lengths = pieces[:, 1] - pieces[:, 0]
    at = np.cumsum(lengths + 1) - lengths - 1  # where a piece starts when all stand in a row, parted by a symbol of their own
    total = int(at[-1] + lengths[-1])
    kinds = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    row = np.full(total, -1, dtype=np.int64)
    starts, roots = [], []
    for (lo, hi), to in zip(pieces.tolist(), at.tolist()):
        piece = kinds[lo:hi]
        row[to : to + hi - lo] = piece
        own = np.unique(piece, return_inverse=True)[1]
        for order in (own, own.max() - own):
            root = np.array(lyndon_array(order.tolist()), dtype=np.int64)
            place = np.flatnonzero(root * power <= hi - lo)
            starts.append(place + to)
            roots.append(root[place])
    parting = np.flatnonzero(row < 0)
    row[parting] = -1 - np.arange(len(parting))
    a, q = np.concatenate(starts), np.concatenate(roots)
    reach = Extensions(row, int(lengths.max()))
    inside = a + q < total
    a, q = a[inside], q[inside]
    begin = a - reach.left(a, a + q)
    end = a + q + reach.right(a, a + q)
    good = end - begin >= np.maximum(least, power * q)
    found = np.unique(np.stack([begin[good], end[good] - begin[good], q[good]], axis=1), axis=0)
    home = np.searchsorted(at, found[:, 0], side="right") - 1
    found[:, 0] += pieces[home, 0] - at[home]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _pieces(symbols: np.ndarray, bounds: np.ndarray, least: int, power: int) -> np.ndarray:
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    if not len(text):
        return np.zeros((0, 2), dtype=np.int64)
    order = np.lexsort((symbols, text))
    step = np.ones(len(order), dtype=bool)
    step[1:] = (symbols[order][1:] != symbols[order][:-1]) | (text[order][1:] != text[order][:-1])
    first = np.flatnonzero(step)
    often = np.empty(len(order), dtype=bool)
    often[order] = np.repeat(np.diff(np.append(first, len(order))) >= power, np.diff(np.append(first, len(order))))
    opens, closes = often.copy(), often.copy()
    opens[1:] &= ~often[:-1] | (text[1:] != text[:-1])
    closes[:-1] &= ~often[1:] | (text[1:] != text[:-1])
    pieces = np.stack([np.flatnonzero(opens), np.flatnonzero(closes) + 1], axis=1)
    return pieces[pieces[:, 1] - pieces[:, 0] >= least]


def planted_repeats(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(from, period) of the repetition that the query puts into a document of n words, or None; a null id counts as empty text."""
    h = zlib.crc32(str("" if doc_id is None else doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    return g % n, 1 + (n - g % n) // (3 + g % 8)


RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def collapse(df: DataFrame, plant: Callable[[int | None, int], tuple[int, int] | None] | None = None, least: int = 6, power: int = 4) -> DataFrame:
    """(doc_id, runs, text): the runs of every document in words, and its words without the repetitions, joined by one space.

    Words are stretches of bytes other than 0x09-0x0D and 0x20. A word is left out if a run contains it after the run's first
    period. ``runs`` is ordered by start, then period. ``plant(doc_id, n_words)`` may name a word from which on a period is
    repeated first, as tests of the search need. One task reads a few documents at a time; nothing is shuffled.

    Null text has no words: no runs and an empty text. Repeated rows each come back; a null id stays null; columns other than
    ``doc_id`` and ``text`` are not read, whatever their names; an empty table gives an empty one.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, hi, data, offsets in chunks(batch.column(1)):
                yield _collapsed(ids[lo:hi], Words(data, offsets), plant, least, power)
        release()

    return documents(df).mapInArrow(search, f"doc_id bigint, runs {RUN}, text string")


def _collapsed(ids: list[int | None], words: Words, plant, least: int, power: int) -> pa.RecordBatch:
    bounds = words.bounds
    symbols = words.hashes()
    source = np.arange(len(symbols))
    changed = set()
    if plant:
        for i, doc_id in enumerate(ids):
            if repeat := plant(doc_id, int(bounds[i + 1] - bounds[i])):
                start, period = repeat
                lo = int(bounds[i]) + start
                source[lo : bounds[i + 1]] = lo + np.arange(int(bounds[i + 1]) - lo) % period
                changed.add(i)
    found = runs(symbols[source], bounds, least, power)
    begin = np.searchsorted(found[:, 0], bounds)
    edges = np.zeros(len(symbols) + 1, dtype=np.int64)
    np.add.at(edges, found[:, 0] + found[:, 2], 1)
    np.add.at(edges, found[:, 0] + found[:, 1], -1)
    repeated = np.cumsum(edges) > 0
    texts = []
    for i in range(len(ids)):
        lo, hi = int(bounds[i]), int(bounds[i + 1])
        own = words.of(i)
        if i in changed or begin[i] < begin[i + 1]:
            own = [own[at] for at in (source[lo:hi][~repeated[lo:hi]] - lo).tolist()]
        texts.append(b" ".join(own))
    home = np.repeat(bounds[:-1], np.diff(begin))
    parts = [pa.array(found[:, 0] - home), pa.array(found[:, 1]), pa.array(found[:, 2])]
    listed = pa.ListArray.from_arrays(pa.array(begin, type=pa.int32()), pa.StructArray.from_arrays(parts, ["start", "length", "period"]))
    return pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()), listed, pa.array(texts, type=pa.binary()).cast(pa.string())], ["doc_id", "runs", "text"])
