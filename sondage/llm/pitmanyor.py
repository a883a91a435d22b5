"""Word language model: a hierarchical Pitman-Yor process, its restaurants seated by Gibbs sampling.

Restaurants. Every word of the training texts and the start of a text is a context with a restaurant of its own, and all these share
one parent. All of them serve every word and the end of a text. The parent's base gives half its mass to the unknown word and the
rest evenly to the known ones. A token whose context was not met is served by the parent. All probabilities are proper over the
known words, the unknown word and the end.

Seating. Of a dish with c customers only the number of tables t is kept. A Gibbs move takes a random customer away - it sat
alone with probability S(c-1, t-1) / S(c, t), by generalised Stirling numbers - and seats it anew. A table sends a customer to
the parent. Predictions are averaged over the sweeps after burn-in; they are linear in t. A dish of one customer has one table.

Data flow. The corpus is held in chunks, tokens as numbers of the chunk's own words. Words belong to parts by their hash, and a part
numbers its words by falling count. A chunk sends each part its pairs (context, dish) of the contexts there; contexts of more than
``share`` of the tokens, and the start, are spread over the parts of their dishes instead. A part merges and seats its restaurants and
is the parent of its words; customers and parent probabilities travel between parts once a sweep, as arrays in an order agreed
once. What a chunk asked for comes back in the order in which it asked, so without keys. The driver holds sums, and of the contexts
that are spread (at most 1/share) their tables.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sondage.llm.common import LOWER, Words, chunks, documents, held

END = np.uint64(0xE5D0F7E87A11B055)
EXACT = 1_000  # up to so many customers Stirling ratios are exact, above they are asymptotic
STRENGTH = 1.0

# ------------------------------------------------------------------ seating


def alone_table(discount: float, most: int = EXACT) -> np.ndarray:
    """[c, t]: probability that a customer of c at t tables sits alone, for c up to ``most``."""
    t = np.arange(most + 1)
    log = np.full(most + 1, -np.inf)
    log[1] = 0.0
    out = np.zeros((most + 1, most + 1), dtype=np.float32)
    out[1, 1] = 1.0
    for c in range(2, most + 1):
        with np.errstate(divide="ignore"):
            stay = log + np.log(np.maximum(c - 1 - discount * t, 0))
        new = np.concatenate([[-np.inf], log[:-1]])
        log = np.logaddexp(stay, new)
        with np.errstate(invalid="ignore"):
            out[c] = np.where(np.isfinite(log), np.exp(new - log), 0)
    return out


def seat(c: np.ndarray, t: np.ndarray, base: np.ndarray, many: np.ndarray, discount: float, strength: float, steps: int, rng: np.random.Generator, table: np.ndarray, at: np.ndarray | None = None, fixed: np.ndarray | None = None) -> np.ndarray:
    """Tables after ``steps`` Gibbs moves of every dish of a restaurant; ``many`` dishes share a row's count and base probability.

    With ``at`` the dishes are of several restaurants, of which each has ``fixed`` tables besides.
    """
    c = c.astype(np.float64)
    t = t.astype(np.float64)
    small = c <= EXACT
    every = bool(small.all())
    index, flat = np.where(small, c, 0).astype(np.int64) * (EXACT + 1), table.ravel()
    moves = np.maximum(1.0, c / 50)  # of a large dish, so many customers move in a step
    for _ in range(steps):
        alone = flat[index + np.minimum(t, EXACT).astype(np.int64)]
        if not every:
            alone = np.where(small, alone, np.minimum(1.0, discount * (t - 1) / np.maximum(c - 1, 1)))
        if at is None:
            weight = (strength + discount * float((many * t).sum())) * base
            left = rng.random(len(c)) < alone
        else:
            left = rng.random(len(c)) < alone
            weight = (strength + discount * ((fixed + np.bincount(at, weights=many * t, minlength=len(fixed)))[at] - left)) * base
        after = t - left
        new = rng.random(len(c)) < weight / (weight + np.maximum(c - 1 - discount * after, 1e-12) * (after > 0))
        one = after + (new | (after == 0))
        if every:
            t = one
            continue
        born = rng.poisson(np.minimum(moves * weight / (weight + np.maximum(c - discount * t, 1e-12)), 1e15))
        gone = rng.poisson(np.minimum(moves * alone, 1e15))
        t = np.where(small, one, np.clip(t + born - gone, 1, c))
    return np.clip(t, 1, c)


def seat_many(c: np.ndarray, t: np.ndarray, base: np.ndarray, at: np.ndarray, fixed: np.ndarray, discount: float, steps: int, rng: np.random.Generator, table: np.ndarray) -> np.ndarray:
    """``seat`` for the dishes of many restaurants, two customers or more each.

    A move of a dish of two customers forgets where they sat (one is left, at one table), so a move every tenth step does for it.
    """
    t = t.astype(np.float64)
    two, more = np.flatnonzero(c == 2), np.flatnonzero(c != 2)
    tables = lambda i: np.bincount(at[i], weights=t[i], minlength=len(fixed))
    for done in range(0, steps, 10):
        if len(more):
            t[more] = seat(c[more], t[more], base[more], np.ones(len(more)), discount, STRENGTH, min(10, steps - done), rng, table, at[more], fixed + tables(two))
        if len(two):
            weight = (STRENGTH + discount * ((fixed + tables(two) + tables(more))[at[two]] - (t[two] - 1))) * base[two]
            t[two] = 1 + (rng.random(len(two)) < weight / (weight + 1 - discount))
    return t


def first_tables(c: np.ndarray, base: np.ndarray, discount: float, strength: float, dishes: np.ndarray | int) -> np.ndarray:
    weight = (strength + discount * dishes) * base
    return np.clip(np.rint(1 + weight * np.log1p((c - 1) / (weight + 1))), 1, c)


def discount_of(n1: float, n2: float) -> float:
    """n1 / (n1 + 2 n2) of the dishes of one and of two customers, within 0.05 and 0.95."""
    return min(max(n1 / (n1 + 2 * n2) if n1 + n2 else 0.5, 0.05), 0.95)


_TABLES: dict[float, np.ndarray] = {}


def _alone(discount: float) -> np.ndarray:
    if discount not in _TABLES:
        if len(_TABLES) > 3:
            _TABLES.clear()
        _TABLES[discount] = alone_table(discount)
    return _TABLES[discount]


# ------------------------------------------------------------------ blobs and parts


def put(**arrays: np.ndarray) -> bytes:
    """Arrays as one blob: whole numbers as narrow as they can be, bytes of equal weight side by side, compressed."""
    press, out = zstandard.ZstdCompressor(level=1), {}
    for k, a in arrays.items():
        kind = a.dtype.str
        if a.dtype.kind in "iu" and len(a) and a.min() >= 0:
            a = a.astype(np.min_scalar_type(a.max()))
        out[k] = (kind, a.dtype.str, press.compress(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes()))
    return pickle.dumps(out)


def got(blob: bytes) -> dict[str, np.ndarray]:
    out, press = {}, zstandard.ZstdDecompressor()
    for k, (kind, dtype, z) in pickle.loads(blob).items():
        planes = np.frombuffer(press.decompress(z), dtype=np.uint8).reshape(np.dtype(dtype).itemsize, -1)
        out[k] = np.ascontiguousarray(planes.T).view(dtype).reshape(-1).astype(kind)
    return out


def gaps(a: np.ndarray) -> np.ndarray:
    """Steps of a rising array; cumsum takes them back."""
    return np.diff(a, prepend=0)


Row = tuple[int, int, int, bytes]  # to part, kind, key, blob
ROW = "part long, kind long, key long, data binary"
ASK, RANK, WORDS, PAIRS, ALIGN, SEATS, LIST, PARENT, CUSTOMERS, SERVED, SUMS, BACK = range(12)


def _batch(rows: Iterable[Row]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), (), ()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 3 + [pa.binary()])], names=["part", "kind", "key", "data"])


def _at_parts(rows: DataFrame, parts: int, work: Callable[[int, dict[int, dict[int, bytes]]], Iterator[Row]]) -> DataFrame:
    """``work`` on each part and its rows {kind: {key: blob}}, keys rising."""

    def run(group: pa.Table) -> pa.Table:
        found: dict[int, dict[int, bytes]] = {}
        for r in sorted(group.to_pylist(), key=lambda r: (r["kind"], r["key"])):
            found.setdefault(r["kind"], {})[r["key"]] = r["data"]
        return pa.Table.from_batches([_batch(work(group.column("part")[0].as_py(), found))])

    return rows.repartition(2 * parts, "part").groupBy("part").applyInArrow(run, ROW)


def _of(rows: DataFrame, *kinds: int) -> DataFrame:
    return rows.where(F.col("kind").isin(*kinds))


def _sums(rows: DataFrame) -> dict[str, np.ndarray]:
    """The parts' SUMS, added up."""
    out: dict[str, np.ndarray] = {}
    for r in _of(rows, SUMS).select("data").collect():
        for k, a in got(r["data"]).items():
            out[k] = out[k] + a if k in out else a
    return out


# ------------------------------------------------------------------ chunks


def packed(docs: DataFrame, size: int = 8_000_000) -> DataFrame:
    """The corpus as chunks of about ``size`` bytes: (chunk, ids, train, tokens: their number, z, top, words).

    The words of a chunk, by falling number: ``top`` has the high 16 bits of their hashes, ``words`` the rest and their counts in the
    training texts; ``z`` has bounds of the texts and the word of every token, with an END after every text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId(), 0
        for b in batches:
            for lo, hi, data, offs in chunks(b.column("text"), size):
                ids = b.column("doc_id").slice(lo, hi - lo).to_pylist()
                train = np.array([zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2 for i in ids])
                words = Words(LOWER[data], offs)
                h = np.insert(words.hashes(), words.bounds[1:], END)
                bounds = words.bounds + np.arange(len(words.bounds))
                which, u = pd.factorize(h)
                order = np.lexsort((u, -np.bincount(which, minlength=len(u))))
                rank = np.empty(len(u), dtype=np.int64)
                rank[order] = np.arange(len(u))
                n = np.bincount(which, weights=np.repeat(train, np.diff(bounds)), minlength=len(u)).astype(np.int64)[order]
                u = u[order]
                blobs = put(bounds=gaps(bounds), token=rank[which]), put(top=(u >> np.uint64(48)).astype(np.int64)), put(low=u & np.uint64((1 << 48) - 1), n=n)
                kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                row = [task * (1 << 32) + k, ids, train.tolist(), len(h), *blobs]
                yield pa.record_batch([pa.array([x], t) for x, t in zip(row, kinds)], names=["chunk", "ids", "train", "tokens", "z", "top", "words"])
                k += 1

    return documents(docs).mapInArrow(run, "chunk long, ids array<long>, train array<boolean>, tokens long, z binary, top binary, words binary")


def _words_of(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(high bits, hashes, counts in the training texts) of a chunk's words."""
    top, words = got(row["top"])["top"], got(row["words"])
    return top, (top.astype(np.uint64) << np.uint64(48)) | words["low"], words["n"]


def word_rows(corpus: DataFrame) -> DataFrame:
    """(chunk, h, n): every different token of a chunk with its count in the chunk's training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                _, h, n = _words_of(row)
                yield pa.record_batch([pa.array(np.full(len(h), row["chunk"])), pa.array(h.view(np.int64)), pa.array(n)], names=["chunk", "h", "n"])

    return corpus.select("chunk", "top", "words").mapInArrow(run, "chunk long, h long, n long")


def part_of(top: np.ndarray, parts: int) -> np.ndarray:
    return (top * parts) >> 16


def numbered(corpus: DataFrame, parts: int) -> DataFrame:
    """Of every part its WORDS (hashes, counts; a word's number is its place) and for every chunk the RANKs of the chunk's words.

    The id of a word is its rank * parts + part, so that frequent words have small ones.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                top, h, n = _words_of(row)
                part = part_of(top, parts)
                order = np.argsort(part, kind="stable")
                cut = np.searchsorted(part[order], np.arange(parts + 1))
                yield _batch((p, ASK, row["chunk"], put(h=h[order[a:z]], n=n[order[a:z]])) for p, a, z in zip(range(parts), cut, cut[1:]) if z > a)

    def work(part: int, rows: dict[int, dict[int, bytes]]) -> Iterator[Row]:
        asked = [got(x) for x in rows[ASK].values()]
        which, h = pd.factorize(np.concatenate([x["h"] for x in asked]))
        n = np.bincount(which, weights=np.concatenate([x["n"] for x in asked]), minlength=len(h)).astype(np.int64)
        order = np.lexsort((h, -n))
        rank = np.empty(len(h), dtype=np.int64)
        rank[order] = np.arange(len(h))
        yield part, WORDS, 0, put(h=h[order], n=n[order])
        cut = np.cumsum([0] + [len(x["h"]) for x in asked])
        for chunk, a, z in zip(rows[ASK], cut, cut[1:]):
            yield part, RANK, chunk, put(rank=rank[which[a:z]])

    return _at_parts(corpus.select("chunk", "top", "words").mapInArrow(ask, ROW), parts, work)


def counted(numbers: DataFrame, parts: int) -> DataFrame:
    """(h, n, id) of all tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                w = got(row["data"])
                yield pa.record_batch([pa.array(w["h"].view(np.int64)), pa.array(w["n"]), pa.array(np.arange(len(w["n"])) * parts + row["part"])], names=["h", "n", "id"])

    return _of(numbers, WORDS).mapInArrow(run, "h long, n long, id long")


class Pairs:
    """The different pairs of a chunk in the order (part, restaurant, dish); ``which`` of them each token is.

    Restaurants of a part: its piece of each spread context (``hot`` ids, then the start), then its words by rank.
    """

    def __init__(self, z: dict[str, np.ndarray], top: np.ndarray, ranks: dict[int, np.ndarray], hot: np.ndarray, parts: int):
        self.bounds, token, spread = np.cumsum(z["bounds"]), z["token"], len(hot) + 1
        part = part_of(top, parts)
        self.asked = np.argsort(part, kind="stable")
        ids = self.align([ranks[p] * parts + p for p in sorted(ranks)])
        order = np.lexsort((ids, part))
        place = np.empty(len(top), dtype=np.int64)
        place[order] = np.arange(len(top))
        i = np.minimum(np.searchsorted(hot, ids), max(len(hot) - 1, 0))
        heat = np.where(hot[i] == ids, i, -1) if len(hot) else np.full(len(ids), -1)
        first = np.searchsorted(part[order], np.arange(parts + 1))
        begin = first + spread * np.arange(parts + 1)  # the slots of each part
        self.before = np.concatenate([[-1], token[:-1]])
        self.before[self.bounds[:-1]] = -1  # the start of a text
        self.heat = np.where(self.before < 0, len(hot), heat[self.before])  # spread context of a token, -1: none
        slot = np.where(self.heat >= 0, begin[part[token]] + self.heat, place[self.before] + spread * (part[self.before] + 1))
        key = slot * len(top) + place[token]
        by = np.argsort(key)
        new = np.concatenate([[True], np.diff(key[by]) > 0])
        self.which = np.empty(len(key), dtype=np.int64)
        self.which[by] = np.cumsum(new) - 1
        key = key[by[new]]
        slot, dish = key // len(top), key % len(top)
        self.part = np.searchsorted(begin, slot, side="right") - 1
        within = slot - begin[self.part]
        in_order = ids[order]
        self.restaurant = np.where(within < spread, within, spread + in_order[np.minimum(first[self.part] + np.maximum(within - spread, 0), len(ids) - 1)] // parts)
        self.dish, self.token = in_order[dish], token

    def align(self, by_part: list[np.ndarray]) -> np.ndarray:
        """Answers of the parts, in the order of the chunk's words."""
        out = np.empty(len(self.asked), dtype=by_part[0].dtype)
        out[self.asked] = np.concatenate(by_part)
        return out


def _with_rows(corpus: DataFrame, rows: DataFrame, parts: int, work: Callable[[dict, dict[int, dict[int, dict]]], pa.Table], schema: str, empty: pa.Schema) -> DataFrame:
    """``work`` on every chunk and the rows keyed by it, {kind: {part: arrays}}, parts rising."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[int, dict[int, dict]] = {}
        for r in sorted(right.to_pylist(), key=lambda r: (r["kind"], r["part"])):
            found.setdefault(r["kind"], {})[r["part"]] = got(r["data"])
        out = [work(row, found) for row in left.to_pylist()]
        return pa.concat_tables(out) if out else empty.empty_table()

    left = corpus.select("chunk", "ids", "train", "z", "top").repartition(4 * parts, "chunk")
    right = rows.select(F.col("key").alias("chunk"), "part", "kind", "data").repartition(4 * parts, "chunk")
    return left.groupBy("chunk").cogroup(right.groupBy("chunk")).applyInArrow(run, schema)


def _asked_pairs(corpus: DataFrame, numbers: DataFrame, hot: np.ndarray, parts: int) -> DataFrame:
    """The chunks' PAIRS, of training texts with their counts, of others with 0."""

    def work(row: dict, rows: dict[int, dict[int, dict]]) -> pa.Table:
        pairs = Pairs(got(row["z"]), got(row["top"])["top"], {p: x["rank"] for p, x in rows[RANK].items()}, hot, parts)
        train = np.repeat(np.array(row["train"], dtype=bool), np.diff(pairs.bounds))
        n = np.bincount(pairs.which[train], minlength=len(pairs.dish))
        cut = np.searchsorted(pairs.part, np.arange(parts + 1))
        return pa.Table.from_batches([_batch((p, PAIRS, row["chunk"], put(restaurant=gaps(pairs.restaurant[a:z]), dish=pairs.dish[a:z], n=n[a:z])) for p, a, z in zip(range(parts), cut, cut[1:]) if z > a)])

    return _with_rows(corpus, _of(numbers, RANK), parts, work, ROW, _batch([]).schema)


SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("perplexity", pa.float64())])


# ------------------------------------------------------------------ model


def _restaurants(asked: DataFrame, parts: int, spread: int) -> DataFrame:
    """Merges the chunks' pairs. SEATS: a part's restaurants, of their dishes of one customer only the number. ALIGN: what each pair that a
    chunk asked for is (0: not met, 1: met once, 2: a dish of SEATS). LIST: for the parts of the dishes, what they are served here."""

    def work(part: int, rows: dict[int, dict[int, bytes]]) -> Iterator[Row]:
        found = [got(x) for x in rows[PAIRS].values()]
        restaurant, dish = np.concatenate([np.cumsum(x["restaurant"]) for x in found]), np.concatenate([x["dish"] for x in found])
        wide = int(dish.max()) + 1
        key = restaurant * wide + dish
        by = np.argsort(key)
        new = np.concatenate([[True], np.diff(key[by]) > 0])
        which = np.empty(len(key), dtype=np.int64)
        which[by] = np.cumsum(new) - 1
        n = np.bincount(which, weights=np.concatenate([x["n"] for x in found])).astype(np.int64)
        restaurant, dish = restaurant[by[new]], dish[by[new]]
        kind = np.minimum(n, 2)
        seated = np.cumsum(kind == 2) - 1
        cut = np.cumsum([0] + [len(x["n"]) for x in found])
        for chunk, a, z in zip(rows[PAIRS], cut, cut[1:]):
            k = kind[which[a:z]]
            yield part, ALIGN, chunk, put(kind=k, at=gaps(seated[which[a:z]][k == 2]))
        once, more = kind == 1, kind == 2
        there = np.unique(restaurant[kind > 0])
        single = np.bincount(np.searchsorted(there, restaurant[once]), minlength=len(there))
        served = np.unique(dish[kind > 0])
        served = served[np.lexsort((served, served % parts))]
        order = np.argsort(served)
        of = order[np.searchsorted(served, dish, sorter=order).clip(max=max(len(served) - 1, 0))] if len(served) else np.zeros(len(dish), dtype=np.int64)
        once_of, more_of = (np.bincount(of[x], minlength=len(served)) for x in (once, more))
        travels = np.cumsum(more_of > 0) - 1
        to = served % parts
        for q in np.unique(to):
            here = to == q
            yield int(q), LIST, part, put(rank=gaps(served[here] // parts), single=once_of[here], more=more_of[here])
        at = np.searchsorted(there, restaurant[more])
        zero = np.zeros(int(more.sum()), dtype=np.int64)
        to, sizes = np.unique(to[more_of > 0], return_counts=True)
        yield part, SEATS, 0, put(there=gaps(there), single=single, at=gaps(at), dish=travels[of[more]], n=n[more], t=zero, sum_t=zero, to=to, sizes=sizes)
        yield part, SUMS, 0, put(n=np.array([(n == 1).sum(), (n == 2).sum()]), hot=np.bincount(restaurant[(kind > 0) & (restaurant < spread)], minlength=spread))

    return _at_parts(asked, parts, work)


def _parents(lists: DataFrame, parts: int) -> DataFrame:
    """PARENT: of a part's words the customers, first one for each context, and who is told of which words."""

    def work(part: int, rows: dict[int, dict[int, bytes]]) -> Iterator[Row]:
        n = got(rows[WORDS][0])["n"]
        single, more, told, sizes = np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int64), [], []
        for x in map(got, rows.get(LIST, {}).values()):
            rank = np.cumsum(x["rank"])
            single[rank] += x["single"]
            more[rank] += x["more"]
            told.append(gaps(rank[x["more"] > 0]))
            sizes.append(len(told[-1]))
        c = single + more
        zero = np.zeros(len(n))
        yield part, PARENT, 0, put(n=n, single=single, c=c, t=np.zeros(len(n), dtype=np.int64), sum=zero, told=np.concatenate([np.zeros(0, dtype=np.int64), *told]), to=np.array(list(rows.get(LIST, {})), dtype=np.int64), sizes=np.array(sizes, dtype=np.int64))
        yield part, SUMS, 0, put(n=np.array([(c == 1).sum(), (c == 2).sum()]), t=np.array([(c > 0).sum()]), c=np.array([c.sum()]))

    return _at_parts(lists, parts, work)


def _slices(sizes: np.ndarray) -> list[slice]:
    cut = np.cumsum(np.concatenate([[0], sizes])).astype(int)
    return [slice(a, z) for a, z in zip(cut, cut[1:])]


def _told(state: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype=np.int64), *(np.cumsum(state["told"][s]) for s in _slices(state["sizes"]))])


def _seat_parents(rows: DataFrame, parts: int, base: float, discount: float, tables: float, kept: float, steps: int, seed: int) -> DataFrame:
    """Seats the words of the parent, of which all parts have ``tables`` tables; SERVED: customers less discounted tables for the contexts.
    With ``kept`` the share of the customers before is added to the sum, divided by it."""

    def work(part: int, found: dict[int, dict[int, bytes]]) -> Iterator[Row]:
        s = got(found[PARENT][0])
        told = _told(s)
        if kept:
            s["sum"] = s["sum"] + np.where(s["c"] > 0, s["c"] - discount * s["t"], 0) / kept
        old = np.where(s["t"] > 0, s["t"], s["c"] > 0)
        if CUSTOMERS in found:
            come = {p: got(x)["t"] for p, x in found[CUSTOMERS].items()}
            s["c"] = s["single"] + np.bincount(told, weights=np.concatenate([come[p] for p, m in zip(s["to"].tolist(), s["sizes"]) if m]), minlength=len(s["n"])).astype(np.int64)
        rest = max(tables - old.sum(), 0)
        i = np.flatnonzero(s["c"] > 1)
        even = np.full(len(i), base)
        c = s["c"][i]
        t = np.where(s["t"][i] > 0, np.minimum(s["t"][i], c), first_tables(c, even, discount, STRENGTH, tables))
        s["t"] = np.minimum(s["c"], 1)
        s["t"][i] = seat_many(c, t, even, np.zeros(len(i), dtype=np.int64), np.array([rest + (s["c"] == 1).sum()]), discount, steps, np.random.default_rng([seed, part, 1]), _alone(discount)).astype(np.int64)
        left = s["c"] - discount * s["t"]
        for p, x in zip(s["to"].tolist(), _slices(s["sizes"])):
            if x.stop > x.start:
                yield p, SERVED, part, put(left=left[told[x]].astype(np.float32))
        yield part, PARENT, 0, put(**s)
        yield part, SUMS, 0, put(c=np.array([s["c"].sum()]), t=np.array([s["t"].sum()]))

    return _at_parts(rows, parts, work)


def _seat_contexts(rows: DataFrame, parts: int, spread: int, hot: np.ndarray, discount: float, share: Callable[[np.ndarray], np.ndarray], keep: bool, steps: int, seed: int) -> DataFrame:
    """Seats the restaurants of the contexts; ``hot``: tables of the spread ones in all parts, ``share``: from SERVED to the parent's
    probability. CUSTOMERS: the tables of every dish, for its parent."""

    def work(part: int, found: dict[int, dict[int, bytes]]) -> Iterator[Row]:
        s = got(found[SEATS][0])
        there, at, n = np.cumsum(s["there"]), np.cumsum(s["at"]), s["n"]
        size = int(s["sizes"].sum())
        known = {q: got(x)["left"] for q, x in found.get(SERVED, {}).items()}
        base = share(np.concatenate([np.zeros(0), *(known[q] for q in s["to"].tolist())]))[s["dish"]]
        fixed = s["single"].astype(np.float64)
        now = fixed + np.bincount(at, weights=np.maximum(s["t"], 1), minlength=len(there))
        here = there < spread
        fixed[here] += np.maximum(hot[there[here]] - now[here], 0)
        t = np.where(s["t"] > 0, s["t"], first_tables(n, base, discount, STRENGTH, (fixed + np.bincount(at, minlength=len(there)))[at]))
        s["t"] = seat_many(n, t, base, at, fixed, discount, steps, np.random.default_rng([seed, part, 0]), _alone(discount)).astype(np.int64)
        if keep:
            s["sum_t"] = s["sum_t"] + s["t"]
        sent = np.bincount(s["dish"], weights=s["t"], minlength=size).astype(np.int64)
        for q, x in zip(s["to"].tolist(), _slices(s["sizes"])):
            yield q, CUSTOMERS, part, put(t=sent[x])
        tables = s["single"] + np.bincount(at, weights=s["t"], minlength=len(there)).astype(np.int64)
        yield part, SEATS, 0, put(**s)
        yield part, SUMS, 0, put(hot=np.bincount(there[here], weights=tables[here], minlength=spread).astype(np.int64))

    return _at_parts(rows, parts, work)


def _answers(rows: DataFrame, parts: int, spread: int, sweeps: int) -> DataFrame:
    """BACK, for every chunk: of its words rank, count, parent's share (without the base) and tables as a context, of its pairs the
    customers and the tables beyond the first; tables are sums over the kept sweeps."""

    def work(part: int, found: dict[int, dict[int, bytes]]) -> Iterator[Row]:
        parent = got(found[PARENT][0])
        share = parent["sum"].astype(np.float32)
        tables = np.zeros(len(share), dtype=np.int64)
        if SEATS in found:
            s = got(found[SEATS][0])
            there, at = np.cumsum(s["there"]), np.cumsum(s["at"])
            here = there >= spread
            tables[there[here] - spread] = (s["single"] * sweeps + np.bincount(at, weights=s["sum_t"], minlength=len(there)).astype(np.int64))[here]
        for chunk, x in found[RANK].items():
            r, n, more = got(x)["rank"], np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
            if chunk in found.get(ALIGN, {}):
                a = got(found[ALIGN][chunk])
                n, more, at = a["kind"], np.zeros(len(a["kind"]), dtype=np.int64), np.cumsum(a["at"])
                more[n == 2], n[n == 2] = s["sum_t"][at] - sweeps, s["n"][at]
            yield part, BACK, chunk, put(rank=r, n=parent["n"][r], share=share[r], tables=tables[r], pair=n, more=more)

    return _at_parts(rows, parts, work)


@dataclass
class Scales:
    """What a task needs besides the answers of the parts: ids of the spread contexts by id, their and the start's tables, the discount; a
    known word has the parent's probability ``floor`` and its share, the unknown word ``unknown``."""

    parts: int
    hot: np.ndarray
    hot_tables: np.ndarray
    discount: float
    floor: float
    unknown: float
    sweeps: int
    texts: int
    total: int
    types: int

    def values(self, back: dict[int, dict]) -> np.ndarray:
        """Customers less discounted tables of a chunk's pairs."""
        n, more = (np.concatenate([x[k] for x in back.values()]) for k in ("pair", "more"))
        return np.where(n > 0, n - self.discount * (1 + more / self.sweeps), 0.0)

    def pairs(self, row: dict, back: dict[int, dict]) -> Pairs:
        return Pairs(got(row["z"]), got(row["top"])["top"], {p: x["rank"] for p, x in back.items()}, self.hot, self.parts)

    def scores(self, row: dict, rows: dict[int, dict[int, dict]]) -> pa.Table:
        """The texts of a chunk, scored."""
        back = rows[BACK]
        pairs = self.pairs(row, back)
        n, share, tables = (pairs.align([x[k] for x in back.values()]) for k in ("n", "share", "tables"))
        parent = np.where(n > 0, share.astype(np.float64) + self.floor, self.unknown)
        value = self.values(back)
        seats = np.where(pairs.before < 0, self.texts, n[pairs.before])
        at = np.where(pairs.heat >= 0, self.hot_tables[pairs.heat], tables[pairs.before] / self.sweeps)
        p = (value[pairs.which] + (STRENGTH + self.discount * at) * parent[pairs.token]) / (STRENGTH + seats)
        each = np.log10(p) if self.total else np.zeros(len(p))
        count, sizes = n[pairs.token], np.diff(pairs.bounds)
        add = lambda x: np.add.reduceat(x, pairs.bounds[:-1])  # noqa: E731  every text has its end
        s = add(each)
        columns = [row["ids"], [not x for x in row["train"]], sizes, add((count > 0).astype(np.int64)), np.full(len(s), self.total), add(np.log10((count + 1) / (self.total + self.types + 1))), s, 10 ** np.minimum(-s / sizes, 300)]
        return pa.table([pa.array(c, k) for c, k in zip(columns, SCORES.types)], schema=SCORES)


@dataclass
class Model:
    """The seated model: ``answers`` are BACK rows for the chunks of the corpus, ``hashes`` of ``scales.hot``."""

    corpus: DataFrame
    answers: DataFrame
    hashes: np.ndarray
    scales: Scales

    # what follows is a view of the frequent words, small enough for the driver

    @cached_property
    def core(self) -> np.ndarray:
        """Sorted hashes of the frequent words and the end."""
        return np.sort(self.hashes)

    @cached_property
    def _parent(self) -> pd.DataFrame:
        """(id, n, p, m): the parent's probabilities, of the frequent words by id, of the m others of each count added up (id -1)."""
        parts, floor = self.scales.parts, self.scales.floor

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    x = got(row["data"])
                    yield pa.record_batch([pa.array(x["rank"] * parts + row["part"]), pa.array(x["n"]), pa.array(x["share"].astype(np.float64) + floor)], names=["id", "n", "p"])

        words = self.answers.mapInArrow(run, "id long, n long, p double").where("n > 0").distinct()
        name = F.when(F.col("id").isin(self.scales.hot.tolist()), F.col("id")).otherwise(-1)
        return words.groupBy(name.alias("id"), "n").agg(F.sum("p").alias("p"), F.count(F.lit(1)).alias("m")).toPandas()

    @cached_property
    def _open(self) -> float:
        p = self._parent
        return float(p.p[p.id < 0].sum()) + self.scales.unknown

    @property
    def unknown(self) -> float:
        """log10 probability of the unknown word among all that are not frequent."""
        return float(np.log10(self.scales.unknown / self._open))

    def of_open(self, n: np.ndarray) -> np.ndarray:
        """log10 of the parent's mean probability of words of these counts among all that are not frequent."""
        p = self._parent[self._parent.id < 0].sort_values("n")
        if not len(p):
            return np.full(len(n), self.unknown)
        return np.where(n > 0, np.log10(np.interp(n, p.n, p.p / p.m / self._open)), self.unknown)

    @cached_property
    def table(self) -> np.ndarray:
        """log10 probabilities [context, dish] of the frequent words in the order of ``core``; then come the parent itself and the start as
        contexts, all other words together as a dish."""
        scales, kinds = self.scales, pa.schema([("context", pa.int64()), ("dish", pa.int64()), ("v", pa.float64())])
        k = len(scales.hot)

        def work(row: dict, rows: dict[int, dict[int, dict]]) -> pa.Table:
            pairs = scales.pairs(row, rows[BACK])
            value = scales.values(rows[BACK])
            keep = (pairs.restaurant <= k) & (value > 0)
            return pa.table([pairs.restaurant[keep], pairs.dish[keep], value[keep]], schema=kinds)

        pairs = _with_rows(self.corpus, self.answers, scales.parts, work, "context long, dish long, v double", kinds).distinct()
        dish = F.when(F.col("dish").isin(scales.hot.tolist()), F.col("dish")).otherwise(-1)
        sums = pairs.groupBy("context", dish.alias("dish")).agg(F.sum("v").alias("v")).toPandas()
        known = self._parent[self._parent.id >= 0].set_index("id")
        parent = np.append(known.p.reindex(scales.hot).fillna(scales.floor), self._open)
        seats = np.append(np.where(self.hashes == END, 0, known.n.reindex(scales.hot).fillna(0)), scales.texts)  # nothing follows an end
        out = (STRENGTH + scales.discount * scales.hot_tables)[:, None] * parent
        to = {x: i for i, x in enumerate(scales.hot.tolist())}
        for c, d, v in sums.itertuples(index=False):
            out[int(c), to.get(int(d), k)] += v
        out /= (STRENGTH + seats)[:, None]
        order = [*np.argsort(self.hashes), k]
        return np.log10(np.vstack([out[order[:k]][:, order], parent[order], out[k:][:, order]]))


def train(corpus: DataFrame, words: DataFrame, share: float = 0.001, unknown_share: float = 0.5, sweeps: int = 6, burn: int = 2, steps: int = 60, seed: int = 42, parts: int | None = None, numbers: DataFrame | None = None) -> Model:
    """Model of the training texts. ``words``: (h, n) of all tokens, ``numbers``: from ``numbered`` at this number of ``parts``, if there.

    Every word is a context and a dish. ``share`` does not bound the model: it says which contexts are spread over the parts of their dishes.
    """
    if numbers is None:
        parts = parts or parts_of(corpus)
        numbers = held(numbered(corpus, parts))
    stats = words.agg(F.sum("n").alias("total"), F.sum((F.col("n") > 0).cast("long")).alias("types")).first()
    total, types = stats["total"] or 0, stats["types"] or 0
    end = int(END.view(np.int64))
    frequent = counted(numbers, parts).where((F.col("n") > 0) & (F.col("n") >= share * total) | (F.col("h") == end)).collect()
    frequent = sorted((r["id"], r["h"], r["n"]) for r in frequent)
    hot = np.array([i for i, _, _ in frequent], dtype=np.int64)
    texts = sum(n for _, h, n in frequent if h == end)
    spread = len(hot) + 1

    merged = held(_restaurants(_asked_pairs(corpus, numbers, hot, parts), parts, spread))
    sums = _sums(merged)
    d1 = discount_of(*sums["n"]) if sums else 0.5
    tables = sums["hot"].astype(np.float64) if sums else np.zeros(spread)
    parent = held(_parents(_of(merged, LIST).unionByName(_of(numbers, WORDS)), parts))
    seats = _of(merged, SEATS)
    top = _sums(parent)
    d0 = discount_of(*top["n"]) if top else 0.5
    base = (1 - unknown_share) / max(types, 1)
    kept, floor, unknown, hot_tables = 0.0, 0.0, 0.0, np.zeros(spread)
    for r in range(-1, sweeps):
        if r >= 0:
            mass = STRENGTH + d0 * float(top["t"][0]) if top else STRENGTH
            all_ = STRENGTH + float(top["c"][0]) if top else STRENGTH
            contexts = held(_seat_contexts(seats.unionByName(_of(parent, SERVED)), parts, spread, tables, d1, lambda left, m=mass, a=all_: (left + m * base) / a, r >= burn, steps, seed + r))
            seats, sums = _of(contexts, SEATS), _sums(contexts)
            tables = sums["hot"].astype(np.float64) if sums else tables
            if r >= burn:
                hot_tables += tables / (sweeps - burn)
        come = _of(parent, PARENT).unionByName(_of(contexts, CUSTOMERS)) if r >= 0 else _of(parent, PARENT)
        parent = held(_seat_parents(come, parts, base, d0, float(top["t"][0]) if top else 0.0, kept, steps, seed + r + 1))
        top = _sums(parent)
        mass, all_ = (STRENGTH + d0 * float(top["t"][0]), STRENGTH + float(top["c"][0])) if top else (STRENGTH, STRENGTH)
        kept = all_ * (sweeps - burn) if r >= burn else 0.0
        if r >= burn:
            floor += mass * base / all_ / (sweeps - burn)
            unknown += mass * unknown_share / all_ / (sweeps - burn)
    parent = _added(_of(parent, PARENT), parts, d0, kept)
    answers = _answers(seats.unionByName(parent).unionByName(_of(merged, ALIGN)).unionByName(_of(numbers, RANK)), parts, spread, sweeps - burn)
    scales = Scales(parts, hot, hot_tables, d1, floor, unknown if types else 1.0, sweeps - burn, int(texts), int(total), int(types))
    return Model(corpus, answers, np.array([h for _, h, _ in frequent], dtype=np.int64).view(np.uint64), scales)


def _added(parent: DataFrame, parts: int, discount: float, kept: float) -> DataFrame:
    """PARENT with the last sweep in its sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                s = got(row["data"])
                s["sum"] = s["sum"] + np.where(s["c"] > 0, s["c"] - discount * s["t"], 0) / kept
                yield _batch([(row["part"], PARENT, 0, put(**s))])

    return parent.mapInArrow(run, ROW)


def parts_of(corpus: DataFrame, most: int = 5_000_000) -> int:
    """Parts of about ``most`` tokens each."""
    return max(1, -(-(corpus.agg(F.sum("tokens").alias("n")).first()["n"] or 0) // most))


def score(docs: DataFrame, share: float = 0.001, parts: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row.

    The model learns from the rows whose crc32(doc_id as text) mod 7 is not 2. ``score`` is the log10 probability of the text and
    its end, ``perplexity`` 10 to the power of -score / n_tokens. ``parts``: tasks that share the model, by default from the tokens.

    Defined cases: a null or empty text is the end alone; a null ``doc_id`` counts as the empty string for the hash; repeated rows
    each count and come back; with no training row the base is over the unknown word alone (0) and so is the score; an empty table
    gives an empty result. Other columns are not read.
    """
    corpus = held(packed(docs))
    parts = parts or parts_of(corpus)
    numbers = held(numbered(corpus, parts))
    model = train(corpus, counted(numbers, parts), share, parts=parts, numbers=numbers)
    scales = model.scales
    return _with_rows(corpus, model.answers, parts, lambda row, rows: scales.scores(row, rows), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double", SCORES)
