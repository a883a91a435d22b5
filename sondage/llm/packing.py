"""Packing token sequences of fixed size: pieces, a bin-completion plan over the histogram of lengths, and its assignment.

Only lengths matter for a plan and there are at most ``size`` of them, so the plan is made from the histogram (one count per
length, whatever the corpus) and then dealt out to the pieces by their number within their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from sondage.llm.common import LOWER, Words, chunks, distinct, documents, gathered, held, letters, lowered, release

# ------------------------------------------------------------------ tokens

#: Most parts of words that a task remembers; beyond it the memory starts anew with the parts of the chunk in hand, and it ends with the task.
REMEMBERED = 600_000
#: Parts of words that go to the tokenizer as one text.
TOGETHER = 256
_WORKER: dict[str, WordTokens] = {}
_SIGN = np.zeros(256, dtype=bool)
_SIGN[list(b".,;:!?&#$%*|()")] = True
#: The signs (UTF-16) that byte-level vocabularies have for bytes: printable ones their own, the others from 256 up; a blank stays one.
_SIGNS = np.arange(256, dtype="<u2")
_OTHERS = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
_SIGNS[_OTHERS] = np.arange(256, 256 + len(_OTHERS))
_SIGNS[32] = 32


def cuts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where the signs begin, odd) of words: a word of plain letters and then plain signs is cut between them by the tokenizer too.

    Any other word is odd and is not cut.
    """
    if not len(starts):
        return ends, np.zeros(0, dtype=bool)
    row, lo, hi = gathered(data, starts, ends)
    stem = np.minimum.reduceat(np.where(letters(row), len(row), np.arange(len(row))), lo) - lo  # the blank is no letter
    odd = stem + np.add.reduceat(_SIGN[row], lo, dtype=np.int64) != hi - lo
    return np.where(odd, ends, starts + stem), odd


class WordTokens:
    """Token ids by word. The tokenizer splits at white space and lowers case, so a text's ids are those of its words in a row.

    Words are cut into letters and signs, and parts that are new go to the tokenizer many at a time: without its normalizer and its
    own cutting, which change nothing in such parts. The tokens that end a part are told by the suffix that the model gives them.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = None
        self.bare.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        suffix = getattr(self.bare.model, "end_of_word_suffix", None)
        vocabulary = self.bare.get_vocab()
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.last[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.forget()
        self.joins = self._joins()

    def forget(self) -> None:
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.at = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.used = 0

    def whole(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, dtype=np.uint32)

    def _joins(self) -> bool:
        """Whether letters and signs have the same ids together, without normalizer and cutting, as each on its own."""
        letters = [chr(x) for x in [*range(97, 123), *(x for x in range(0xC0, 0x100) if x not in (0xD7, 0xF7))]]
        some = [*letters, *(a + b for a, b in zip(letters, letters[7:] + letters[:7])), "".join(letters), "thequick", "straße", *".,;:!?&#$%*|()", "...", "?!", "$$$"]
        parts = [x.encode() for x in some]
        one = [self.whole(x) for x in parts]
        row, lo, hi = gathered(np.frombuffer(b"".join(parts), dtype=np.uint8), *(lambda n: (np.cumsum(n) - n, np.cumsum(n)))(np.array([len(x) for x in parts])))
        ids, size = self._together(row, lo, hi)
        return size.tolist() == [len(x) for x in one] and np.array_equal(ids, np.concatenate(one))

    def _together(self, row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each) of parts that lie in ``row`` with a blank after each."""
        signs, edges = _SIGNS[lowered(row)], [*lo[::TOGETHER].tolist(), len(row)]
        texts = [signs[a : z - 1].tobytes().decode("utf-16-le") for a, z in zip(edges, edges[1:])]
        got = [np.array(x.ids, dtype=np.uint32) for x in self.bare.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate(got) if got else np.zeros(0, dtype=np.uint32)
        return ids, np.diff(np.flatnonzero(self.last[ids]), prepend=-1)

    def _learn(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, odd: np.ndarray) -> None:
        odd = odd if self.joins else np.ones_like(odd)
        new, size = self._together(*gathered(data, starts[~odd], ends[~odd])) if not odd.all() else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        if len(size) != np.count_nonzero(~odd):
            raise ValueError("the tokenizer cut a part of a word")
        spans = list(zip(starts[odd].tolist(), ends[odd].tolist()))
        for i in range(0, len(spans), 4096):
            texts = [data[a:z].tobytes().decode("utf-8", "replace") for a, z in spans[i : i + 4096]]
            got = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            new, size = np.concatenate([new, np.array([x for ids in got for x in ids], dtype=np.uint32)]), np.concatenate([size, np.array([len(x) for x in got], dtype=np.int64)])
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(new)] = new
        at = self.used + np.cumsum(size) - size
        self.used += len(new)
        hashes = np.concatenate([self.hashes, hashes[~odd], hashes[odd]])
        at, size = np.concatenate([self.at, at]), np.concatenate([self.size, size])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.at, self.size = hashes[order], at[order], size[order]

    def _found(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``flat``, how many ids) of parts of words, none of them empty. Parts go by their 64-bit hash."""
        row, lo, hi = gathered(data, starts, ends)
        hashes, first, which = np.unique(Words(row, np.array([0, len(row)])).hashes(), return_index=True, return_inverse=True)
        i = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        new = np.flatnonzero(self.hashes[i] != hashes) if len(self.hashes) else np.arange(len(hashes))
        if len(new):
            if len(self.hashes) + len(new) > REMEMBERED:  # starts anew, with all parts of this chunk whatever their number
                self.forget()
                new = np.arange(len(hashes))
            some = first[new]
            self._learn(hashes[new], row, lo[some], hi[some], odd[some])
            i = np.searchsorted(self.hashes, hashes)
        return self.at[i][which], self.size[i][which]

    def ids(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a chunk with ``end`` after each, bounds of the texts in them). Words go by their 64-bit hash."""
        words = Words(LOWER[data], offsets)
        _, first, which = distinct(words.hashes())
        starts, ends = words.starts[first], words.ends[first]
        cut, odd = cuts(words.data, starts, ends)
        lo, hi = np.stack([starts, cut], axis=1).ravel(), np.stack([cut, ends], axis=1).ravel()
        at, size = np.zeros(len(lo), dtype=np.int64), np.zeros(len(lo), dtype=np.int64)
        own = np.flatnonzero(hi > lo)
        at[own], size[own] = self._found(words.data, lo[own], hi[own], np.repeat(odd, 2)[own])
        flat = self.flat[_spans(at, size)]  # ids of the different words of the chunk
        size = size.reshape(-1, 2).sum(axis=1)
        at, size = (np.cumsum(size) - size)[which], size[which]
        bounds = np.concatenate([[0], np.cumsum(size)])[words.bounds]
        return np.insert(flat[_spans(at, size)], bounds[1:], end).astype("<u4", copy=False), bounds + np.arange(len(bounds))


def _spans(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of spans in a row."""
    upto = np.cumsum(size)
    return np.repeat(at - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)


def token_ids(texts: pa.Array, path: str, end: int) -> Iterator[np.ndarray]:
    """Ids of every text and ``end``, in order. A text with the opening sign of a special token is encoded as a whole."""
    if path not in _WORKER:
        _WORKER[path] = WordTokens(path)
    known = _WORKER[path]
    for lo, hi, data, offsets in chunks(texts):
        ids, bounds = known.ids(data, offsets, end)
        special = (data[:-1] == 60) & (data[1:] == 124)
        odd = set((np.searchsorted(offsets, np.flatnonzero(special), side="right") - 1).tolist())
        for k in range(hi - lo):
            if k in odd:
                yield np.append(known.whole(data[offsets[k] : offsets[k + 1]].tobytes()), np.uint32(end)).astype("<u4")
            else:
                yield ids[bounds[k] : bounds[k + 1]]


def _end_of_task() -> None:
    for known in _WORKER.values():
        known.forget()
    release()


def pieces(docs: DataFrame, path: str, size: int = 2048, end: int = 0, ids: bool = False) -> DataFrame:
    """Pieces of every document: its ids and then ``end``, cut every ``size`` tokens.

    (doc_id, piece, start, length, ids_crc32, part, nth, and with ``ids`` the tokens): ``nth`` numbers the pieces of one
    length within partition ``part``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(size + 1, dtype=np.int64)
        for b in batches:
            doc, piece, start, length, crc, tokens = [], [], [], [], [], []
            for doc_id, body in zip(b.column("doc_id").to_pylist(), token_ids(b.column("text"), path, end)):
                for k, at in enumerate(range(0, len(body), size)):
                    own = body[at : at + size]
                    doc.append(doc_id)
                    piece.append(k)
                    start.append(at)
                    length.append(len(own))
                    crc.append(zlib.crc32(own))
                    if ids:
                        tokens.append(own.astype(np.int64))
            n = np.array(length, dtype=np.int64)
            order = np.argsort(n, kind="stable")
            first = np.searchsorted(n[order], n[order])
            nth = np.empty(len(n), dtype=np.int64)
            nth[order] = np.arange(len(n)) - first + seen[n[order]]
            seen += np.bincount(n, minlength=size + 1)
            cols = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(n), pa.array(crc, pa.int64()), pa.array(np.full(len(n), part, dtype=np.int32)), pa.array(nth)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            yield pa.record_batch(cols + ([pa.array(tokens, pa.list_(pa.int64()))] if ids else []), names=names + ["ids"] * ids)
        _end_of_task()

    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
    return documents(docs).mapInArrow(run, kinds + (", ids array<long>" if ids else ""))


# ------------------------------------------------------------------ plan


def completion(room: int, left: dict[int, int], lengths: list[int], budget: int) -> list[int]:
    """Lengths (falling) out of ``lengths`` (rising, ``left`` of each) that fill ``room`` with the least waste found.

    Branch and bound: fillings are enumerated largest first, so one that another dominates (the same room in more and smaller
    pieces) comes later and only replaces the incumbent if it wastes less. The incumbent starts as the best fit. A branch ends
    where its room is below the least length, or cannot lower the incumbent's waste. All pieces of a length are taken at once, so
    a branch is as deep as there are different lengths in a sequence (63 of 2,048 tokens). ``budget`` bounds the nodes; the
    incumbent then stands.
    """
    best: list[tuple[int, int]] = []
    waste = room
    stack: list[tuple[int, int]] = []
    nodes = budget

    def descend(space: int, top: int) -> None:
        nonlocal best, waste, nodes
        if space < waste:
            best, waste = list(stack), space
        for i in range(min(top, bisect_right(lengths, space) - 1), -1, -1):
            # all that is left of this length and below cannot fill what would still be wasted
            if not waste or nodes <= 0 or upto[i] < space - waste + 1:
                return
            n = lengths[i]
            for times in range(min(left[n], space // n), 0, -1):
                nodes -= 1
                stack.append((n, times))
                descend(space - n * times, i - 1)
                stack.pop()
                if not waste or nodes <= 0:
                    return

    upto = []
    total = 0
    for n in lengths:
        total += n * left[n]
        upto.append(total)
    descend(room, len(lengths) - 1)
    return [n for n, times in best for _ in range(times)]


def best_fit(histogram: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """Best-fit decreasing over the histogram: each piece, longest first, goes to the fullest sequence that can hold it.

    Sequences of equal room are alike, so they are kept as one group; a sequence that takes a piece is the fullest that can take the
    next of that length, so it takes as many as it holds.
    """
    rooms: dict[int, list[list]] = {}
    order: list[int] = []  # rooms in use, rising

    def add(room: int, own: tuple, times: int) -> None:
        if room not in rooms:
            rooms[room] = []
            insort(order, room)
        rooms[room].append([own, times])

    for n in sorted((n for n, c in histogram.items() if c > 0), reverse=True):
        c = histogram[n]
        while c:
            i = bisect_left(order, n)
            if i == len(order):
                each = size // n
                if c >= each:
                    add(size - each * n, ((n, each),), c // each)
                    c %= each
                if c:
                    add(size - c * n, ((n, c),), 1)
                break
            room = order[i]
            own, times = rooms[room][-1]
            each = min(room // n, c)
            used = min(times, c // each)
            rooms[room][-1][1] -= used
            if not rooms[room][-1][1]:
                rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    del order[i]
            add(room - each * n, (*own, (n, each)), used)
            c -= each * used
    return [([n for n, t in own for _ in range(t)], times) for group in rooms.values() for own, times in group]


def least_bins(histogram: dict[int, int], size: int) -> int:
    """A lower bound on the number of sequences: pieces over half the size need one each, and what small ones need besides."""
    count = np.zeros(size + 1, dtype=np.int64)
    for n, c in histogram.items():
        count[n] = c
    many, length = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * np.arange(size + 1))])
    half = size // 2
    k = np.arange(half + 1)  # pieces of k to half the size are small, over size - k they stand alone
    large = many[size + 1] - many[half + 1]
    spare = size * (many[size - k + 1] - many[half + 1]) - (length[size - k + 1] - length[half + 1])
    rest = length[half + 1] - length[k]
    return int(large + max(0, (-(-(rest - spare) // size)).max()))


def fillings(room: int, left: dict[int, int], lengths: list[int], waste: int, most: int = 24, nodes: int = 600) -> list[list[int]]:
    """Up to ``most`` undominated fillings of ``room`` that waste at most ``waste``, least waste first, then fewest pieces."""
    found: list[tuple[int, int, list[tuple[int, int]]]] = []
    own: list[tuple[int, int]] = []

    def descend(space: int, top: int) -> None:
        nonlocal nodes
        nodes -= 1
        if space <= waste and not dominated(own, left, lengths, space):
            found.append((space, sum(t for _, t in own), list(own)))
        for i in range(min(top, bisect_right(lengths, space) - 1), -1, -1):
            n = lengths[i]
            for times in range(min(left[n], space // n), 0, -1):
                if nodes <= 0:
                    return
                own.append((n, times))
                descend(space - n * times, i - 1)
                own.pop()

    descend(room, len(lengths) - 1)
    return [[n for n, t in f for _ in range(t)] for _, _, f in sorted(found)[:most]]


def dominated(own: list[tuple[int, int]], left: dict[int, int], lengths: list[int], waste: int) -> bool:
    """Whether another filling is at least as good: a piece left out would fit in besides, or in the place of shorter ones.

    A piece of length x may replace pieces that are together s long if s <= x <= s + waste; one piece must be shorter than x.
    Then whatever is done with x elsewhere can be done with the pieces that it replaces.
    """
    taken = dict(own)
    out = 0  # lengths of which a piece is left out, as bits
    for n in lengths:
        if left[n] > taken.get(n, 0):
            out |= 1 << n
    one, many = 0, 0  # sums of one piece, and of several
    for n, times in own:
        every, step = 1, 1
        while times > 0:
            k = min(step, times)
            every |= every << n * k
            times -= k
            step *= 2
        several = every & ~(1 | 1 << n)
        many |= several | (one | many) << n | _spread(one | many, several)
        one |= 1 << n
    return bool(out & (_upto(1, waste) & ~1 | _upto(many, waste) | _upto(one << 1, waste - 1)))


def _spread(sums: int, steps: int) -> int:
    """Sums of one of each."""
    out, n = 0, 0
    while steps:
        zeros = (steps & -steps).bit_length() - 1
        n += zeros
        out |= sums << n
        steps >>= zeros + 1
        n += 1
    return out


def _upto(sums: int, more: int) -> int:
    """Sums and all that are larger by at most ``more`` (none if that is negative)."""
    if more < 0:
        return 0
    width = 1
    while width <= more:
        k = min(width, more + 1 - width)
        sums |= sums << k
        width += k
    return sums


def search(histogram: dict[int, int], size: int, bins: int, nodes: int) -> list[list[int]] | None:
    """A packing into ``bins`` sequences, or None if none is met within ``nodes`` steps.

    Branch and bound over sequences: each is a filling around the largest piece left, and a branch ends when its waste is more
    than ``bins`` sequences can have in all.
    """
    left = {n: c for n, c in histogram.items() if c}
    allowed = bins * size - sum(n * c for n, c in left.items())
    if allowed < 0:
        return None
    path: list[list[int]] = []
    open_: list[list[list[int]]] = []

    def step(own: list[int], sign: int) -> None:
        for n in own:
            left[n] = left.get(n, 0) + sign
            if not left[n]:
                del left[n]

    while nodes > 0:
        if not left:
            return [list(p) for p in path]
        top = max(left)
        step([top], -1)
        lengths = sorted(n for n in left if n <= size - top)
        made = [[top, *f] for f in fillings(size - top, left, lengths, allowed)]
        step([top], 1)
        open_.append(made[::-1])
        nodes -= 1
        while open_ and not open_[-1]:
            open_.pop()
            if path:
                back = path.pop()
                step(back, 1)
                allowed += size - sum(back)
        if not open_:
            return None
        own = open_[-1].pop()
        step(own, -1)
        allowed -= size - sum(own)
        path.append(own)
    return None


def plan(histogram: dict[int, int], size: int = 2048, budget: int = 3_000, part: int = 150) -> list[tuple[list[int], int]]:
    """(lengths of one sequence, how many such sequences) that use every piece of the histogram exactly once.

    The incumbent is the better of best-fit decreasing and of bin completion (the largest piece left is completed by ``completion``,
    and the filling found is repeated while the counts last), so the plan never needs more sequences than best fit. While it needs more
    than the lower bound, ``search`` repacks the pieces of the ``part`` sequences that waste most into fewer; passes are repeated until
    one brings nothing. Sequences outside that part are full or nearly so and stay.
    """
    made = min(best_fit(histogram, size), _incumbent(histogram, size, budget), key=lambda m: sum(times for _, times in m))
    used, low = sum(times for _, times in made), least_bins(histogram, size)
    while used > low:
        kept, loose = [], []
        for own, times in sorted(made, key=lambda m: sum(m[0])):
            take = min(times, part - len(loose))
            loose += [own] * take
            if times > take:
                kept.append((own, times - take))
        pieces_ = dict(Counter(n for own in loose for n in own))
        for fewer in range(min(used - low, len(loose) - least_bins(pieces_, size), 3), 0, -1):
            better = search(pieces_, size, len(loose) - fewer, budget // 6)
            if better is not None:
                made, used = [*kept, *((own, 1) for own in better)], used - fewer
                break
        else:
            break
    return made


def _incumbent(histogram: dict[int, int], size: int, budget: int) -> list[tuple[list[int], int]]:
    left = {n: c for n, c in histogram.items() if c > 0}
    out = []
    while left:
        lengths = sorted(left)
        top = lengths[-1]
        left[top] -= 1
        room = size - top
        inside = lengths[: bisect_right(lengths, room)]
        own = [top, *completion(room, left, inside, budget)] if inside else [top]
        left[top] += 1
        need = {n: own.count(n) for n in set(own)}
        times = min(left[n] // m for n, m in need.items())
        for n, m in need.items():
            left[n] -= m * times
            if not left[n]:
                del left[n]
        out.append((own, times))
    return out


def slots(made: list[tuple[list[int], int]], histogram: dict[int, int], size: int) -> dict[str, np.ndarray]:
    """Where the numbered pieces go: runs of places, sorted by place = pieces of lesser lengths + number within the length."""
    base, at = {}, 0
    for n in sorted(histogram):
        base[n] = at
        at += histogram[n]
    rows, sequence = [], 0
    for own, times in made:
        offset = 0
        for n in sorted(set(own), reverse=True):
            m = own.count(n)
            rows.append((base[n], m, sequence, offset, n))
            base[n] += m * times
            offset += m * n
        sequence += times
    place, m, seq, off, n = (np.array(x, dtype=np.int64) for x in zip(*rows)) if rows else [np.zeros(0, np.int64)] * 5
    order = np.argsort(place)
    lesser = np.zeros(size + 1, dtype=np.int64)
    for k in sorted(histogram):
        lesser[k + 1 :] += histogram[k]
    return {"place": place[order], "m": m[order], "sequence": seq[order], "offset": off[order], "length": n[order], "lesser": lesser}


def pack(docs: DataFrame, path: str, size: int = 2048, end: int = 0, ids: bool = False, budget: int = 3_000) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with ``ids`` the tokens), one row per piece.

    Only documents longer than ``size`` tokens are cut. Pieces lie in their sequence without gaps, from 0.

    Defined cases: a null or empty text is the end token alone; repeated rows are packed each; a null ``doc_id`` is kept as
    null; an empty table gives an empty result. Other columns are ignored.
    """
    found = held(pieces(docs, path, size, end, ids))
    counts = held(found.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    made = slots(plan(histogram, size, budget), histogram, size)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("base"))
    shared = docs.sparkSession.sparkContext.broadcast(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for b in batches:
            n = b.column("length").to_numpy()
            place = s["lesser"][n] + b.column("base").to_numpy() + b.column("nth").to_numpy()
            i = np.searchsorted(s["place"], place, side="right") - 1
            k = place - s["place"][i]
            sequence = s["sequence"][i] + k // s["m"][i]
            offset = s["offset"][i] + k % s["m"][i] * n
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            more = ["ids"] * ids
            yield pa.record_batch([*[b.column(c) for c in names], pa.array(sequence), pa.array(offset), *[b.column(c) for c in more]], names=[*names, "sequence_id", "offset", *more])

    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return found.join(bases, ["length", "part"]).mapInArrow(run, kinds + (", ids array<long>" if ids else ""))
