"""Toxicity: noisy-channel restoration of disguised words, and a score over the restored text learned from labelled documents.

A word that is not a known one and holds signs, separators or repeated letters, and a run of short pieces between blanks, is
seen as a noisy copy of a plain word: Viterbi decoding finds the letters that most likely gave rise to it under a character
language model and a channel of look-alike signs, inserted separators and repetition. Where both a plain and a restored reading
are possible, costs under the words and letters of the labelled documents choose. Known words stay as they are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sondage.functions.columns import quoted
from sondage.llm.common import Words, beginnings, chunks, distinct, documents, gathered, held, letters as letter_bytes, lowered, remainder

# Fixed values of the channel: which letters a sign may stand for.
LOOKS_LIKE = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
SEPARATORS = ".-_*~'`·,/\\"
EDGE = " \t.,;:!?\"'()[]{}<>|&#%$*~-_=+/\\…«»“”„"
SUBSTITUTE, SKIP, REPEAT, DOUBLE = 1.5, 0.3, 0.7, 3.0  # channel costs, in nats; DOUBLE: one of just two equal letters is noise
UNKNOWN, SIGN, BLANK = 6.0, 2.3, 2.0  # costs of a word that is not known, of a sign in it, and of an inserted blank
PREFIXES = (4, 5, 6)
LONGEST_PIECE, MOST_PIECES = 3, 16  # letters of a piece between blanks, pieces of a word
KNOWN_SHARE = 1 / 8192  # least share of labelled documents that a known word is in (three documents at least): bounds the model, not the rows
REMEMBERED = 300_000
#: About this many bytes of text are worked on at a time.
CHUNK = 2_000_000
#: Bits of the filter that tells documents with a label before texts are shuffled: a fixed size; a full filter lets more pass, never less.
LABEL_BITS = 1 << 25

_APART = re.compile(r"[^\W\d_](?:[.\-_*~·,/\\][^\W_]){2,}|[^\W\d_]+[.\-_*~·][^\W\d_]+")
_DRAWN = re.compile(r"(.)\1\1")
_DOUBLED = re.compile(r"(.)\1+")
_CUTS = re.compile("[" + re.escape(SEPARATORS) + "]+")


def disguised(core: str) -> bool:
    """Whether a word without its edge punctuation looks like a disguise of a plain word."""
    if core.isalpha():
        return bool(_DRAWN.search(core))
    letters = sum(c.isalpha() for c in core)
    if letters < 2:
        return False
    signs = sum(c in LOOKS_LIKE for c in core)
    return 0 < signs <= letters + 1 or bool(_APART.fullmatch(core)) or bool(_DRAWN.search(core))


@dataclass
class Letters:
    """Character language model: letter pairs, interpolated with single letters; and costs of known words."""

    cost: dict[str, float] = field(default_factory=dict)
    single: dict[str, float] = field(default_factory=dict)
    unseen: float = 12.0
    words: dict[str, float] = field(default_factory=dict)
    alike: dict[str, list[str]] = field(default_factory=dict)  # words of doubled letters, by what is left without repetition

    @classmethod
    def learn(cls, pairs: dict[str, int], weight: float = 0.9, words: dict[str, int] | None = None) -> Letters:
        first, total = Counter(), 0
        for p, n in pairs.items():
            first[p[0]] += n
            total += n
        last = Counter()
        for p, n in pairs.items():
            last[p[1]] += n
        single = {c: n / max(total, 1) for c, n in last.items()}
        cost = {p: -math.log(weight * n / first[p[0]] + (1 - weight) * single[p[1]]) for p, n in pairs.items()}
        known = sum(words.values()) if words else 0
        out = cls(cost, {c: -math.log((1 - weight) * v) for c, v in single.items()}, words={w: -math.log(n / known) for w, n in (words or {}).items()})
        for w in out.words:
            out.alike.setdefault(_DOUBLED.sub(r"\1", w), []).append(w)
        return out

    def step(self, a: str, b: str) -> float:
        return self.cost.get(a + b) or self.single.get(b, self.unseen)

    def plainly(self, word: str) -> float:
        """Cost of a word as it stands."""
        known = self.words.get(word)
        if known is not None:
            return known
        return UNKNOWN + sum(self.step(a, b) if b.isalpha() or b == "$" else SIGN for a, b in zip("^" + word, word + "$"))


def decode(seen: str, letters: Letters) -> str:
    """The likeliest plain word behind ``seen``: Viterbi over the lattice of what each character may stand for."""
    paths: dict[str, tuple[float, str]] = {"^": (0.0, "")}
    for i, c in enumerate(seen):
        before = seen[i - 1] if i else ""
        if len(paths) == 1 and c != before and c.isalpha():  # nothing to choose
            ((last, (cost, text)),) = paths.items()
            paths = {c: (cost + letters.step(last, c), text + c)}
            continue
        if c.isalpha():
            options = [(c, 0.0)]
        else:
            options = [(x, SUBSTITUTE) for x in LOOKS_LIKE.get(c, "")]
        drawn = c == before and (seen[i + 1 : i + 2] == c or seen[i - 2 : i - 1] == c)
        skip = SKIP if c in SEPARATORS else REPEAT if drawn else DOUBLE if c == before else None if options else SKIP + SUBSTITUTE
        after: dict[str, tuple[float, str]] = {}
        if skip is not None:
            for last, (cost, text) in paths.items():
                after[last] = (cost + skip, text)
        for x, own in options:
            best = (math.inf, "")
            for last, (cost, text) in paths.items():
                if (whole := cost + own + letters.step(last, x)) < best[0]:
                    best = (whole, text)
            if x not in after or best[0] < after[x][0]:
                after[x] = (best[0], best[1] + x)
        paths = after
    return min(((cost + letters.step(last, "$"), text) for last, (cost, text) in paths.items()), key=lambda v: v[0])[1]


def reading(core: str, letters: Letters) -> str:
    """The likelier of a word as it stands and what ``decode`` makes of it; a known word stays."""
    if core in letters.words or core.isalpha() and not _DOUBLED.search(core):
        return core
    parts = [x for x in _CUTS.split(core) if x]
    apart = len(parts) > 1 and sum(c.isalpha() for c in core) > 1 and all(c.isalpha() or c in LOOKS_LIKE or c in SEPARATORS for c in core)
    doubled = core.isalpha() and _DOUBLED.search(core) is not None
    if not (apart or doubled or disguised(core)):
        return core
    found = decode(core, letters)
    if found not in letters.words:
        others = [w for w in letters.alike.get(_DOUBLED.sub(r"\1", found), ()) if len(w) <= len(core)]
        found = min(others, key=letters.plainly, default=found)
    if apart:
        channel = SKIP * (len(core) - len("".join(parts)))
        return found if channel + letters.plainly(found) < sum(map(letters.plainly, parts)) else core
    if doubled and not disguised(core):
        if found not in letters.words:  # a word that is just not known has hardly every other letter doubled
            return found if 2 * (len(core) - len(found)) >= len(found) else core
        return found if DOUBLE * (len(core) - len(found)) + letters.plainly(found) < letters.plainly(core) else core
    return found


def piece(word: str, letters: Letters) -> int:
    """0 for a word that is no piece of another between blanks, 1 for a short one, 2 for a short one that is not known."""
    if len(word) > LONGEST_PIECE and word.isalpha():
        return 0
    core = word.lower().strip(EDGE)
    if not 0 < len(core) <= LONGEST_PIECE or not all(c.isalpha() or c in LOOKS_LIKE for c in core):
        return 0
    return 1 + (core not in letters.words and any(map(str.isalpha, core)))


def joined(own: list[str], letters: Letters, fits: Callable[[str], bool]) -> list[tuple[int, int, str]]:
    """(from, to, word) of pieces in a row that are likelier one word that ``fits`` than words of their own; the longest first."""
    cores = [w.lower().strip(EDGE) for w in own]
    odd = np.concatenate([[0], np.cumsum([c not in letters.words for c in cores])]).tolist()
    alone = np.concatenate([[0.0], np.cumsum([letters.plainly(c) for c in cores])]).tolist()
    out, a = [], 0
    while a < len(cores) - 1:
        for z in range(min(len(cores), a + MOST_PIECES), a + 1, -1):
            if 2 * (odd[z] - odd[a]) < z - a:
                continue
            whole = reading("".join(cores[a:z]), letters)
            if len(whole) > 2 and fits(whole) and BLANK * (z - a - 1) + letters.plainly(whole) < alone[z] - alone[a]:
                out.append((a, z, whole))
                a = z - 1
                break
        a += 1
    return out


def plain(word: str, letters: Letters | None) -> str:
    """A word in lower case without edge punctuation, restored if that is the likelier ``reading``."""
    low = word.lower()
    core = low.strip(EDGE)
    if letters is None:
        return core
    if (found := reading(core, letters)) != core:
        return found
    if core != low and core not in letters.words:  # a sign at the edge may be part of the word
        whole = low.strip(".,;:!?\"'()[]{}<>|&#%*~-_=/\\…«»“”„")
        if 0 < len(whole) - len(core) <= 2 and len(core) > 1 and core.isalpha() and whole[0] + whole[-1] != core[0] + core[-1]:
            return decode(whole, letters)
    return core


def features(core: str) -> list[str]:
    """A word and its beginnings."""
    return [core + "$", *[core[:n] for n in PREFIXES if len(core) >= n]] if core else []


def _table(signs: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) for c in signs if ord(c) < 128]] = True
    return out


_EDGES = _table(re.sub("[ \\t]", "", EDGE))
_PLAIN_EDGES = _table(re.sub(r"[$+ \t]", "", EDGE))  # signs at the edge that stand for no letter
#: Blanks of ``str.split`` besides those of ``Words``, and the bytes that they start with.
_BLANKS = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_LEADS = _table("\x1c\x1d\x1e\x1f")
_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def split(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of a chunk as ``str.split`` has them."""
    if _LEADS[data].any():
        data = np.frombuffer(_BLANKS.sub(lambda m: b" " * len(m[0]), data.tobytes()), dtype=np.uint8)
    return Words(data, offsets)


class Cores:
    """Different words of a chunk in lower case; one of plain letters between signs of ``edges`` is without these signs.

    ``which`` of the different words each word is; core i is ``row[lo[i]:hi[i]]``, and ``plain`` if it is such a word, else as it stands.
    """

    def __init__(self, words: Words, edges: np.ndarray):
        _, first, self.which = distinct(words.hashes())
        self.starts, self.ends, self.data = words.starts[first], words.ends[first], words.data
        row, lo, hi = gathered(words.data, self.starts, self.ends)
        self.row = row = lowered(row)
        own, at = letter_bytes(row), np.arange(len(row))
        begin, end = np.minimum.reduceat(np.where(own, at, len(row)), lo), np.maximum.reduceat(np.where(own, at, -1), lo) + 1
        n = np.add.reduceat(own, lo, dtype=np.int64)
        self.plain = (n > 0) & (end - begin == n) & (n + np.add.reduceat(edges[row], lo, dtype=np.int64) == hi - lo)
        self.lo, self.hi = np.where(self.plain, begin, lo), np.where(self.plain, end, hi)

    def texts(self, which: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(number, word as it stands) of some."""
        for i, a, z in zip(which.tolist(), self.starts[which].tolist(), self.ends[which].tolist()):
            yield i, self.data[a:z].tobytes()

    def put(self, which: np.ndarray, cores: list[str]) -> None:
        """Other cores for some words."""
        row = [c.encode() for c in cores]
        size = np.array([len(c) for c in row], dtype=np.int64)
        self.lo[which] = len(self.row) + np.cumsum(size + 1) - size - 1
        self.hi[which] = self.lo[which] + size
        self.row = np.concatenate([self.row, np.frombuffer(b"".join(c + b" " for c in row), dtype=np.uint8)])


def hashed(texts: Iterable[str]) -> np.ndarray:
    """Hashes of texts without blanks, as ``feature_table`` has them."""
    row = np.frombuffer("".join(t + " " for t in texts).encode(), dtype=np.uint8)
    return Words(row, np.array([0, len(row)])).hashes()


def feature_table(row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``features`` of cores: (bytes, starts, ends, hashes) of all of them, and for each core where its features are, -1 where it has less."""
    some, full = np.flatnonzero(hi > lo), np.full((len(lo), 1 + len(PREFIXES)), -1, dtype=np.int64)
    row, lo, hi = gathered(row, lo[some], hi[some], b"$ ")
    begins = (row & 0xC0) != 0x80
    number, places = np.cumsum(begins) - 1, np.flatnonzero(begins)
    of, ends = [np.arange(len(some))], [hi + 1]
    for n in PREFIXES:
        long = np.flatnonzero(number[hi] - number[lo] >= n)
        of, ends = [*of, long], [*ends, places[number[lo[long]] + n]]
    at = 0
    for k, own in enumerate(of):
        full[some[own], k] = np.arange(at, at + len(own))
        at += len(own)
    of, ends = np.concatenate(of), np.concatenate(ends)
    return row, lo[of], ends, beginnings(row, lo, hi + 2, of, ends), full


class Hashes:
    """Numbers of values by hash."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes, kind="stable")
        self.sorted = hashes[self.order]

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Which each is; -1 for none."""
        if not len(self.sorted):
            return np.full(len(hashes), -1, dtype=np.int64)
        i = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[i] == hashes, self.order[i], -1)


def doubled(row: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Whether cores of plain letters, in a row with signs after each, hold a letter twice in a row."""
    if not len(lo):
        return np.zeros(0, dtype=bool)
    same = np.zeros(len(row), dtype=bool)
    same[:-1] = (row[:-1] == row[1:]) & (row[:-1] < 128)
    same[:-3] |= (row[:-3] == 0xC3) & (row[2:-1] == 0xC3) & (row[1:-2] == row[3:])
    return np.logical_or.reduceat(same, lo)


def owners(words: Words) -> np.ndarray:
    """The document that each word is in."""
    return np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))


def short_runs(kind: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int]]:
    """(first word, end) of runs within a document of words whose ``piece`` is not 0, two at least and one of them not known."""
    start = np.zeros(len(kind) + 1, dtype=bool)
    start[bounds] = True
    short = kind > 0
    first = np.flatnonzero(short & (start[:-1] | ~np.concatenate([[False], short[:-1]])))
    end = np.flatnonzero(short & (start[1:] | ~np.concatenate([short[1:], [False]]))) + 1
    odd = np.concatenate([[0], np.cumsum(kind == 2)])
    keep = (end - first > 1) & (odd[end] > odd[first])
    return list(zip(first[keep].tolist(), end[keep].tolist()))


def set_apart(words: Words) -> list[tuple[int, int]]:
    """Runs of four or more one-letter words of one document: (first word, end)."""
    length = words.ends - words.starts
    lead = words.data[words.starts] if len(words) else np.zeros(0, dtype=np.uint8)
    one = (length == 1) | ((length == 2) & (lead >= 0xC3) & (lead < 0xD0))
    one &= lead != 124
    owner = np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))
    edge = np.flatnonzero(np.diff(np.concatenate([[False], one, [False]]).astype(np.int8)))
    edge = edge.reshape(-1, 2)
    out = []
    for a, b in edge[edge[:, 1] - edge[:, 0] >= 4].tolist():
        cut = [a, *(np.flatnonzero(np.diff(owner[a:b])) + a + 1).tolist(), b]
        out += [(x, y) for x, y in zip(cut, cut[1:]) if y - x >= 4]
    return out


def log_odds(p: float) -> float:
    return math.log(p / (1 - p))


def weight(bad: int, good: int, base: float, shrink: float, telling: float) -> float:
    """Log odds of a feature's share of toxic documents, shrunk to the base rate, over those of the base rate.

    0 if the share is not above the base rate, or so little that chance may have done it: the documents times the divergence of
    their share from the base rate (half the likelihood ratio statistic) must be ``telling`` or more, whatever the base rate.
    """
    n = bad + good
    share = bad / n if n else 0.0
    if share <= base:
        return 0.0
    far = bad * math.log(share / base) + (good * math.log((1 - share) / (1 - base)) if good else 0.0)
    return log_odds((bad + shrink * base) / (n + shrink)) - log_odds(base) if far >= telling else 0.0


def calibrated(sums: DataFrame, base: float, prior: float = 1.0) -> tuple[float, float]:
    """(start, slope) of the log odds of being toxic over the sum of weights: Newton steps, held near (log odds of base, 1).

    ``sums`` (sum, toxic, count) stays where it is: a pass brings back the loss and its slopes at all steps that may be taken.
    """
    centre = np.array([log_odds(base), 1.0])
    names = ["loss", "h0", "h1", "h2", "g0", "g1"]

    def totals(points: list[np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((len(points), 6))
            for b in batches:
                x, y, k = (b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("sum", "toxic", "count"))
                for i, at in enumerate(points):
                    z = at[0] + at[1] * x
                    p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                    h, g = k * p * (1 - p), k * (p - y)
                    out[i] += [(k * (np.logaddexp(0, z) - y * z)).sum(), h.sum(), (h * x).sum(), (h * x * x).sum(), g.sum(), (g * x).sum()]
            yield pa.record_batch([pa.array(np.arange(len(points))), *[pa.array(out[:, j]) for j in range(6)]], names=["i", *names])

        out = np.zeros((len(points), 6))
        parts = sums.mapInArrow(run, "i long, " + ", ".join(f"{n} double" for n in names))
        for r in parts.groupBy("i").agg(*[F.sum(n) for n in names]).collect():  # one row a point
            out[r[0]] = r[1:]
        for i, at in enumerate(points):
            out[i, 0] += prior / 2 * ((at - centre) ** 2).sum()
        return out

    at, sizes = centre, [0.5**i for i in range(21)]
    here = totals([at])[0]
    for _ in range(50):
        step = np.linalg.solve(np.array([[here[1], here[2]], [here[2], here[3]]]) + prior * np.eye(2), here[4:] + prior * (at - centre))
        if np.abs(step).max() < 1e-9:
            break
        after = totals([at - s * step for s in sizes])
        best = next((i for i in range(len(sizes)) if after[i, 0] <= here[0]), len(sizes) - 1)
        at, here = at - sizes[best] * step, after[best]
        if np.abs(sizes[best] * step).max() < 1e-9:
            break
    return float(at[0]), max(float(at[1]), 0.0)


@dataclass
class Model:
    """Cues: feature -> weight; letters: the character model; start and slope: from a sum of weights to log odds."""

    cues: dict[str, float]
    letters: Letters
    start: float
    slope: float
    number: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.number = {f: i for i, f in enumerate(self.cues)}

    def heaviest(self, found: Iterable[str]) -> tuple[int, float]:
        """(number, weight) of the cue of most weight among features; (-1, 0) if there is none."""
        best, most = None, 0.0
        for f in found:
            v = self.cues.get(f)
            if v is not None and (best is None or v > most):
                best, most = f, v
        return (self.number[best], most) if best else (-1, 0.0)

    def of_word(self, word: str) -> tuple[int, float]:
        core = plain(word, self.letters)
        return self.heaviest(features(core) if core.isalpha() else [f for x in (core, *_CUTS.split(core)) for f in features(x)])

    def of_pieces(self, own: list[str]) -> list[int]:
        """Numbers of the cues of words that pieces in a row make up."""
        known = self.letters.words
        found = joined(own, self.letters, lambda w: w in known or len(w) > 4 and self.heaviest(features(w))[0] >= 0)
        return [self.heaviest(features(w))[0] for _, _, w in found]

    def of_run(self, text: str) -> tuple[int, float]:
        whole = decode(text.lower(), self.letters) if not text.isalpha() else text.lower()
        return self.heaviest(f for f in self.cues if f[-1] == "$" and len(f) > 4 and f[:-1] in whole)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of all labelled training rows: those whose crc32 remainder by 3 is not 1.

    Only texts that a bit array of the labelled ids lets pass are shuffled to their labels. The labels are never broadcast, however
    few they are, so that what is written grows with the input and does not leap at a size.
    """
    rows = labels.select(quoted("doc_id").cast("long").alias("doc_id"), quoted("toxic").cast("int").alias("toxic"))
    rows = rows.where((remainder("doc_id", 3) != 1) & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    place = F.xxhash64("doc_id").bitwiseAND(F.lit(LABEL_BITS - 1))
    word, bit = F.shiftright(place, 6).alias("_word"), F.expr("shiftleft(1L, cast(xxhash64(doc_id) & 63 as int))")
    bits = rows.select(word, bit.alias("_bits")).groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))  # LABEL_BITS / 64 rows at most
    passed = documents(docs).withColumn("_word", word).join(F.broadcast(bits), "_word").where(F.col("_bits").bitwiseAND(bit) != 0)
    return passed.select("doc_id", "text").join(rows.hint("merge"), "doc_id")


def learn(docs: DataFrame, labels: DataFrame, shrink: float = 10.0, telling: float = 6.0) -> Model:
    """Model from all labelled documents, whose whole texts are read.

    A cue is a word or beginning of a word of positive ``weight``. A beginning that owes most of its toxic documents to whole
    words that are cues themselves is none. The calibration is fitted to the labelled documents, each weighed by counts that
    leave it out.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, latin, n = Counter(), np.zeros(1 << 16, dtype=np.int64), [0, 0]
        found: list[tuple] = []  # hashes, texts and documents of features, summed up now and then

        def summed() -> tuple:
            hashes, bad, good = (np.concatenate([f[i] for f in found]) for i in (0, 2, 3))
            values, first, code = distinct(hashes)
            return values, pa.concat_arrays([f[1] for f in found]).take(pa.array(first)), *(np.bincount(code, x, len(first)).astype(np.int64) for x in (bad, good))

        for b in batches:
            kinds = b.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
            n[1] += int(kinds.sum())
            n[0] += len(kinds) - int(kinds.sum())
            for from_, to, data, offsets in chunks(b.column("text"), CHUNK):
                words = split(data, offsets)
                if not len(words):
                    continue
                toxic, cores = kinds[from_:to], Cores(words, _EDGES)
                m = len(cores.plain)
                held_in = pd.unique(owners(words) * m + cores.which)  # different words of the documents as they stand
                doc, word = held_in // m, held_in % m
                times = np.bincount(word, minlength=m)
                odd = np.flatnonzero(~cores.plain)
                others = [plain(w.decode("utf-8", "replace"), None) for _, w in cores.texts(odd)]
                cores.put(odd, others)
                for core, k in zip(others, times[odd].tolist()):
                    if core.isalpha():
                        for x, y in zip("^" + core, core + "$"):
                            pairs[x + y] += k
                own = np.flatnonzero(cores.plain)
                row, lo, hi = gathered(cores.row, cores.lo[own], cores.hi[own], b"$^")
                signs = np.frombuffer(("^" + row.tobytes().decode()).encode("latin-1"), dtype=np.uint8)
                ends = np.flatnonzero(signs == 36)
                every = np.repeat(times[own], np.diff(ends, prepend=-1))[: ends[-1]] if len(ends) else np.zeros(0)
                latin += np.bincount(signs[: len(every)].astype(np.int64) << 8 | signs[1 : len(every) + 1], every, 1 << 16).astype(np.int64)
                texts, starts, stops, hashes, table = feature_table(cores.row, cores.lo, cores.hi)
                _, first, code = distinct(hashes)
                table = np.append(code, -1)[table]
                code = table[word]
                one = pd.unique((doc[:, None] * max(len(first), 1) + code)[code >= 0])
                bad = np.bincount(one % max(len(first), 1), toxic[one // max(len(first), 1)], len(first)).astype(np.int64)
                every = np.bincount(one % max(len(first), 1), minlength=len(first))
                row, lo, hi = gathered(texts, starts[first], stops[first], b"")
                keys = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(np.append(lo, len(row)).astype(np.int64)), pa.py_buffer(row))
                found.append((hashes[first], keys, bad, every - bad))
                if sum(len(f[0]) for f in found[1:]) > REMEMBERED:
                    found[:] = [summed()]
        for code in np.flatnonzero(latin).tolist():
            if (code >> 8, code & 255) != (36, 94):
                pairs[chr(code >> 8) + chr(code & 255)] += int(latin[code])
        rows = [("p", p, c, 0) for p, c in pairs.items()] + [("n", "", n[1], n[0])]
        names, kinds = ["kind", "key", "bad", "good"], (pa.string(), pa.string(), pa.int64(), pa.int64())
        for lo in range(0, len(rows), 100_000):
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows[lo : lo + 100_000]), kinds)], names=names)
        _, keys, bad, good = summed() if found else (None, pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, np.int64))
        for lo in range(0, len(keys), 100_000):
            part = keys[lo : lo + 100_000].cast(pa.string())
            yield pa.record_batch([pa.array(["f"] * len(part)), part, pa.array(bad[lo : lo + 100_000]), pa.array(good[lo : lo + 100_000])], names=names)

    counted = held(labelled(docs, labels).mapInArrow(count, "kind string, key string, bad long, good long").groupBy("kind", "key").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")))
    n = counted.where("kind = 'n'").first()
    n_bad, n_good = (n["bad"], n["good"]) if n else (0, 0)
    base = (n_bad + 0.5) / (n_bad + n_good + 1)
    good = F.greatest(F.col("good") - 1, F.lit(0))  # a clean document that leaves itself out
    share = F.col("bad") / (F.col("bad") + good)
    far = F.col("bad") * F.log(share / base) + F.when(good > 0, good * F.log((1 - share) / (1 - base))).otherwise(0.0)
    # features that tell, and letter pairs: a part of the vocabulary, whatever the rows
    found = counted.where("kind = 'f' and bad > 0").where((share > base) & (far >= telling * (1 - 1e-9))).select("key", "bad", "good").collect()
    counts = {r["key"]: (r["bad"], r["good"]) for r in found}
    whole = [(f[:-1], bad) for f, (bad, good) in counts.items() if f.endswith("$") and weight(bad, good, base, shrink, telling)]
    owed = Counter()
    for w, bad in whole:
        owed.update({w[:k]: bad for k in PREFIXES if len(w) >= k})
    counts = {f: (bad, good) for f, (bad, good) in counts.items() if f.endswith("$") or owed[f] < 0.7 * bad}

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # cues in the order of their weight (of equal ones, of their texts) as clean and as toxic documents that leave themselves out weigh them
        own = [sorted((weight(bad - toxic, good - (1 - toxic), base, shrink, telling), f) for f, (bad, good) in shared.value.items() if (good, bad)[toxic]) for toxic in (0, 1)]
        most = max(*map(len, own), 1)
        ordered = [Hashes(hashed(f for _, f in cues)) for cues in own]
        for b in batches:
            kinds = b.column("toxic").to_pylist()
            sums = [0.0] * len(kinds)
            for from_, to, data, offsets in chunks(b.column("text"), CHUNK):
                words = split(data, offsets)
                if not len(words):
                    continue
                cores = Cores(words, _EDGES)
                odd = np.flatnonzero(~cores.plain)
                cores.put(odd, [plain(w.decode("utf-8", "replace"), None) for _, w in cores.texts(odd)])
                *_, hashes, table = feature_table(cores.row, cores.lo, cores.hi)
                heaviest = np.stack([np.append(cues.number(hashes), -1)[table].max(axis=1) for cues in ordered])[:, cores.which]
                doc = owners(words)
                best = heaviest[np.array(kinds[from_:to])[doc], np.arange(len(doc))]
                hit = best >= 0
                of: dict[int, list[float]] = {}
                for d, i in zip(*(x.tolist() for x in np.divmod(pd.unique(doc[hit] * most + best[hit]), most))):
                    of.setdefault(d, []).append(own[kinds[from_ + d]][i][0])
                for d, weights in of.items():
                    sums[from_ + d] = math.fsum(weights)
            yield pa.record_batch([pa.array(sums, pa.float64()), pa.array(kinds, pa.int32())], names=["sum", "toxic"])

    shared = docs.sparkSession.sparkContext.broadcast(counts)
    fitted = held(labelled(docs, labels).mapInArrow(alone, "sum double, toxic int").groupBy("sum", "toxic").count())
    start, slope = calibrated(fitted, base)
    cues = {f: w for f, (bad, good) in sorted(counts.items()) if (w := weight(bad, good, base, shrink, telling))}
    pairs = {r["key"]: r["bad"] for r in counted.where("kind = 'p'").collect()}
    known = counted.where("kind = 'f' and key like '%$'").where(F.col("bad") + F.col("good") >= max(3, KNOWN_SHARE * (n_bad + n_good))).selectExpr("key", "bad + good as n").collect()
    words = {r["key"][:-1]: r["n"] for r in known if r["key"][:-1].isalpha()}
    return Model(cues, Letters.learn(pairs, words=words), start, slope)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row: the calibrated probability for the sum of the weights of its different cues.

    Defined cases: a null or empty text has the least score; words may be of any length; repeated rows each come back; an empty
    table gives an empty result. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        weights = np.array(list(m.cues.values()))
        cues, plainly = Hashes(hashed(m.cues)), Hashes(hashed(w + "$" for w in m.letters.words))
        known: dict[bytes, tuple[int, int]] = {}
        for b in batches:
            total = np.zeros(b.num_rows)
            for lo, hi, data, offs in chunks(b.column("text"), CHUNK):
                words = Words(data, offs)
                if not len(words):
                    continue
                cores = Cores(words, _PLAIN_EDGES)
                which = cores.which
                cue, kind = np.full(len(cores.plain), -1, dtype=np.int64), np.zeros(len(cores.plain), dtype=np.int8)
                own = np.flatnonzero(cores.plain)
                row, a, z, hashes, table = feature_table(cores.row, cores.lo[own], cores.hi[own])
                a, z = a[: len(own)], z[: len(own)]
                is_known = plainly.number(hashes[: len(own)]) >= 0
                size = np.add.reduceat((row & 0xC0) != 0x80, a, dtype=np.int64) - 2 if len(own) else a
                kind[own] = np.where(size > LONGEST_PIECE, 0, np.where(is_known, 1, 2))
                stays = is_known | ~doubled(row, a)  # what ``plain`` leaves as it is
                found = np.append(cues.number(hashes), -1)[table[stays]]
                cue[own[stays]] = found[np.arange(len(found)), np.append(weights, -1.0)[found].argmax(axis=1)]
                if len(known) > REMEMBERED:
                    known.clear()
                for i, w in cores.texts(np.concatenate([own[~stays], np.flatnonzero(~cores.plain)])):
                    p = known.get(w)
                    if p is None:
                        text = w.decode("utf-8", "replace")
                        p = known[w] = m.of_word(text)[0], piece(text, m.letters)
                    cue[i], kind[i] = p
                hit = np.flatnonzero(cue[which] >= 0)
                pairs = [np.stack([np.searchsorted(words.bounds, hit, side="right") - 1, cue[which[hit]]], axis=1)]
                for a, z in set_apart(words):
                    text = b"".join(data[words.starts[a] : words.ends[z - 1]].tobytes().split()).decode("utf-8", "replace")
                    pairs.append(np.array([[np.searchsorted(words.bounds, a, side="right") - 1, m.of_run(text)[0]]]))
                for a, z in short_runs(kind[which], words.bounds):
                    own = data[words.starts[a] : words.ends[z - 1]].tobytes().decode("utf-8", "replace").split()
                    d = np.searchsorted(words.bounds, a, side="right") - 1
                    pairs += [np.array([[d, c]]) for c in m.of_pieces(own) if c >= 0]
                doc, cue = np.unique(np.concatenate(pairs), axis=0).T
                np.add.at(total, lo + doc[cue >= 0], weights[cue[cue >= 0]])
            yield pa.record_batch([b.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(m.start + m.slope * total, -500, 500))))], names=["doc_id", "score"])

    return documents(docs).mapInArrow(run, "doc_id long, score double")


def restore(docs: DataFrame, model: Model, column: str = "restored") -> DataFrame:
    """``docs`` with the text whose disguised words are decoded in ``column``; other words, and their punctuation, stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model.letters)

    @F.pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        def word(w: str) -> str:
            low = plain(w, None)
            new = plain(w, shared.value)
            return w if new == low else new

        def line(t: str) -> str:
            own = t.split()
            kind = np.array([piece(w, shared.value) for w in own], dtype=np.int8)
            made = [(a + i, a + j, w) for a, z in short_runs(kind, np.array([0, len(own)])) for i, j, w in joined(own[a:z], shared.value, shared.value.words.__contains__)]
            for a, z, w in reversed(made):
                own[a:z] = [w]
            return " ".join(map(word, own))

        return pd.Series([None if t is None else line(t) for t in text], dtype=object)

    return docs.withColumn(column, run(quoted("text")))


def toxicity(docs: DataFrame, labels: DataFrame, cut: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; see ``learn`` and ``score``."""
    scored = score(docs, learn(docs, labels))
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
