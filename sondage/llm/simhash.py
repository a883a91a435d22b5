"""Near duplicates by SimHash: fingerprints of word shingles, and BK-trees over pigeonhole shards."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from sondage.functions.columns import quoted
from sondage.llm.common import U, components, documents, groups, held, scramble, shards

BITS = 64


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """SimHash of a text: bit i is set where more than half of the shingles' XXH64 (seed 42) have it; no words: 0."""
    hashes = shingle_hashes(text, shingle)
    return _majority(hashes) if len(hashes) else 0


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of every word shingle of a text, repeats included; of all words, if they are fewer; none of no words."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    if n <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], dtype=np.uint64)
    length = np.fromiter(map(len, words), np.int64, n)
    end = np.cumsum(length + 1) - 1
    first = (end - length)[: n - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[i:j], 42) for i, j in zip(first, end[shingle - 1 :].tolist())), np.uint64, len(first))


def _majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    count = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        count += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, whole: 64-bit hash of the text, fp long: the fingerprint as a signed number) of every row; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = np.array([fingerprint(x.as_py(), shingle) for x in b.column("text")], dtype=np.uint64).view(np.int64)
            yield pa.record_batch([b.column("doc_id"), b.column("whole"), pa.array(codes)], names=["doc_id", "whole", "fp"])

    return documents(docs).withColumn("whole", F.xxhash64("text")).mapInArrow(run, "doc_id long, whole long, fp long")


# ------------------------------------------------------------------ links


def masks(radius: int, n: int, load: int = 64) -> list[int]:
    """Bit masks such that any two codes within ``radius`` bits agree under one of them.

    The bits are cut into m blocks and a mask takes m - radius of them. m is the least for which ``load`` codes per mask value
    hold n codes, so that shards stay small at any size; every choice finds the same links.
    """
    if not 0 <= radius < BITS:
        raise ValueError(f"radius must be from 0 to {BITS - 1}")
    for m in range(radius + 1, BITS + 1):
        if m == BITS or (BITS // m) * (m - radius) >= np.log2(max(n / load, 1)) or m - radius >= 5:
            break
    edge = [round(i * BITS / m) for i in range(m + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edge, edge[1:])]
    return [sum(c) for c in combinations(block, m - radius)]


def bk_labels(codes: np.ndarray, radius: int) -> np.ndarray:
    """For each of the distinct codes, the position of the least one that it reaches by links of at most ``radius`` bits.

    A BK-tree is laid out over the codes (a child holds what lies at one distance from its parent); all codes are searched
    in it at once and follow only the edges whose distance is within the radius of their own.
    """
    n = len(codes)
    label = np.arange(n)
    stack = [(np.arange(n), np.arange(n))]
    while stack:
        inside, asking = stack.pop()
        root = inside[0]
        away = np.bitwise_count(codes[asking] ^ codes[root]).astype(np.int64)
        seen = np.unique(np.append(label[asking[away <= radius]], label[root]))
        if len(seen) > 1:
            label[np.isin(label, seen)] = seen[0]
        rest = inside[1:]
        if not len(rest):
            continue
        edge = np.bitwise_count(codes[rest] ^ codes[root]).astype(np.int64)
        order = np.argsort(edge, kind="stable")
        rest, edge = rest[order], edge[order]
        cut = np.flatnonzero(np.diff(edge)) + 1
        for child, d in zip(np.split(rest, cut), edge[np.append(0, cut)].tolist()):
            follow = asking[np.abs(away - d) <= radius]
            if len(follow):
                stack.append((child, follow))
    return label


def links(codes: DataFrame, radius: int = 4, most: int = 8_192) -> DataFrame:
    """Edges (a, b) between distinct ``fp`` values that join the same codes as all pairs within ``radius`` bits do.

    Codes meet in shards: they agree on the bits of a mask (pigeonhole). Each shard gets a BK-tree in the task that owns it,
    so no tree grows with the corpus; an over-full mask value is cut into pairs of pieces. A shard returns one edge per
    linked code, not its pairs.
    """
    n = codes.count()
    each = F.array(*[F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(_signed(mask)).alias("v")) for i, mask in enumerate(masks(radius, n))])
    entries = codes.select("fp", F.explode(each).alias("k")).select("fp", F.xxhash64("k.m", "k.v").alias("bucket"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = [], []
        for g in groups(batches, ["bucket", "shard_a", "shard_b"]):
            fp = np.unique(g.column("fp").to_numpy())
            low = fp[bk_labels(fp.view(np.uint64), radius)]
            left.append(fp[low != fp])
            right.append(low[low != fp])
            if len(left) >= 1000:
                yield _edges(left, right)
                left, right = [], []
        if left:
            yield _edges(left, right)

    return shards(entries, "bucket", "fp", most).mapInArrow(run, "a long, b long").distinct()


def _edges(left: list[np.ndarray], right: list[np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])


def _signed(mask: int) -> Column:
    return F.lit(mask - (1 << BITS) if mask >> (BITS - 1) else mask).cast("long")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` among the texts reachable by fingerprints that differ in at most ``radius``
    bits. Defined cases: a null or empty text has fingerprint 0 and links like any other; texts of fewer than ``shingle``
    words hash as one shingle; repeated rows each come back; rows whose ``doc_id`` is null take part, but a null is never the
    smallest id of a class that has another; an empty table gives an empty result. Other columns are ignored.
    """
    marked, named = _classes(docs, shingle, radius)
    least = named.groupBy("c").agg(F.min("least").alias("component_id"))
    named = named.join(least, "c").select(F.col("fp").alias("fp_"), "component_id")
    return marked.join(named, marked["fp"] == named["fp_"]).select("doc_id", "fp", "component_id")


def _classes(docs: DataFrame, shingle: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, whole, fp), and for every fp its class c with the least doc_id of the fp."""
    marked = held(fingerprints(docs, shingle))
    codes = held(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    reach = components(links(codes.select("fp"), radius))
    return marked, codes.join(reach, codes["fp"] == reach["id"], "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))


def keep_first(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """``docs`` with one row of each class of near duplicates: that of the smallest ``doc_id`` (null ids last, ties by text hash).

    Defined cases as in :func:`near_duplicates`: null and empty texts are one class, of repeated rows one stays, an empty table
    gives an empty result; columns may have any name.
    """
    return _one_each(docs, *_classes(docs, shingle, radius))


def _one_each(docs: DataFrame, marked: DataFrame, named: DataFrame) -> DataFrame:
    """One row of ``docs`` for each class of ``named`` (fp, c), by the rows ``marked`` (doc_id, whole, fp)."""
    classes = marked.join(named.select(F.col("fp").alias("fp_"), "c"), F.col("fp") == F.col("fp_"))
    best = classes.groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "whole")).alias("b"))
    best = best.select(F.col("b.doc_id").alias("keep_id"), F.col("b.whole").alias("keep_whole"))
    whole = F.xxhash64(F.coalesce(quoted("text"), F.lit("")).cast("binary"))
    rows = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"), quoted("doc_id").cast("long").alias("id"), whole.alias("whole"))
    kept = rows.join(best, F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("whole") == F.col("keep_whole")))
    once = Window.partitionBy("keep_id", "keep_whole").orderBy(F.lit(0))
    return kept.withColumn("n", F.row_number().over(once)).where("n = 1").select("row.*")


# ------------------------------------------------------------------ by similarity

WIDE = 4  # 64-bit words of a wide fingerprint
_LOAD = 1_024  # wide fingerprints that meet in a shard, about
_MISSED = 0.1  # share of pairs just at the radius that meet in no shard; of closer pairs far fewer
_LEAF = 2_048  # a tree node of at most so many codes is compared as it is


def radius_of(similarity: float, bits: int = BITS * WIDE) -> int:
    """Differing bits up to which two texts count as similar: expected at that Jaccard similarity of their shingles, and half a deviation more.

    At similarity s the shingle counts have a cosine of 2s / (1 + s), and a bit differs with the angle's share of a half turn. For
    0.8 that is 42 of 256 bits: it links 0.99 of the pairs at 0.9, 0.7 at 0.8, 0.13 at 0.7 and 0.006 at 0.6.
    """
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return round(bits * p + np.sqrt(bits * p * (1 - p)) / 2)


def wide_fingerprint(text: bytes, shingle: int = 5) -> np.ndarray:
    """SimHash of 256 bits, as :func:`fingerprint` takes 64: each shingle's hash is mixed anew for every further word of bits."""
    hashes = shingle_hashes(text, shingle)
    out = np.zeros(WIDE, dtype=np.uint64)
    if len(hashes):
        for w in range(WIDE):
            own = hashes if w == 0 else scramble(hashes + U(w * 0x9E3779B97F4A7C15 % (1 << BITS)))
            out[w] = _majority(own)
    return out


def wide_labels(codes: np.ndarray, radius: int) -> np.ndarray:
    """As :func:`bk_labels`, for distinct codes of several words ([code, word])."""
    n = len(codes)
    label = np.arange(n)

    def join(seen: np.ndarray) -> None:
        seen = np.unique(seen)
        if len(seen) > 1:
            label[np.isin(label, seen)] = seen[0]

    def away(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros((len(a), len(b)), dtype=np.uint16)
        for w in range(codes.shape[1]):
            out += np.bitwise_count(codes[a, w][:, None] ^ codes[b, w][None, :])
        return out

    stack = [(np.arange(n), np.arange(n))]
    while stack:
        inside, asking = stack.pop()
        if len(inside) <= _LEAF:
            for lo in range(0, len(asking), 256):
                part = asking[lo : lo + 256]
                near = away(part, inside) <= radius
                for i in np.flatnonzero(near.sum(axis=1) > 0).tolist():
                    hit = label[inside[near[i]]]
                    if len(hit) > 1 or hit[0] != label[part[i]]:
                        join(np.append(hit, label[part[i]]))
            continue
        root, rest = inside[:1], inside[1:]
        far = away(asking, root)[:, 0].astype(np.int64)
        join(np.append(label[asking[far <= radius]], label[root]))
        edge = away(rest, root)[:, 0]
        order = np.argsort(edge, kind="stable")
        rest, edge = rest[order], edge[order].astype(np.int64)
        cut = np.flatnonzero(np.diff(edge)) + 1
        for child, d in zip(np.split(rest, cut), edge[np.append(0, cut)].tolist()):
            follow = asking[np.abs(far - d) <= radius]
            if len(follow):
                stack.append((child, follow))
    return label


def pieces(radius: int, n: int, seed: int = 42) -> list[list[int]]:
    """Bit masks (a word each) of random pieces: codes that agree on a piece meet. Pieces have as many bits as keep shards at
    ``_LOAD`` of n codes, and there are so many that two codes ``radius`` bits apart miss each other with a chance of ``_MISSED``."""
    width = BITS * WIDE
    bits = max(1, int(np.ceil(np.log2(max(n / _LOAD, 2)))))
    met = float(np.prod([(width - radius - i) / (width - i) for i in range(bits)]))
    many = int(np.ceil(np.log(_MISSED) / np.log1p(-met)))
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(many):
        mask = [0] * WIDE
        for b in rng.choice(width, bits, replace=False).tolist():
            mask[b // BITS] |= 1 << (b % BITS)
        out.append(mask)
    return out


def similar_links(codes: DataFrame, radius: int, most: int = 8_192) -> DataFrame:
    """Edges (a, b) between the ``fp`` of codes (fp, w0, w1, ..) that meet by a piece and differ in at most ``radius`` bits.

    As in :func:`links`, each shard gets its tree in the task that owns it and returns one edge per linked code.
    """
    n = codes.count()
    words = [f"w{w}" for w in range(WIDE)]
    each = F.array(*[F.xxhash64(F.lit(i), *[F.col(w).bitwiseAND(_signed(m)) for w, m in zip(words, mask) if m]) for i, mask in enumerate(pieces(radius, n))])
    entries = codes.select("fp", *words, F.explode(each).alias("bucket"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["bucket", "shard_a", "shard_b"]):
            fp, first = np.unique(g.column("fp").to_numpy(), return_index=True)
            own = np.column_stack([g.column(w).to_numpy()[first] for w in words]).view(np.uint64)
            low = fp[wide_labels(own, radius)]
            if (low != fp).any():
                yield _edges([fp[low != fp]], [low[low != fp]])

    return shards(entries, "bucket", "fp", most).mapInArrow(run, "a long, b long").distinct()


def keep_similar_first(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each class of texts linked at an estimated ``similarity`` of their word shingles, as in :func:`keep_first`.

    The estimate comes from wide fingerprints; :func:`radius_of` says how sharp it is. Texts of one fingerprint are one class at any
    length; null and empty texts are one class; fewer than ``shingle`` words are one shingle; repeated rows count once; an empty
    table gives an empty result; columns may have any name.
    """
    words = [f"w{w}" for w in range(WIDE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = np.array([wide_fingerprint(x.as_py(), shingle) for x in b.column("text")], dtype=np.uint64).reshape(-1, WIDE).view(np.int64)
            yield pa.record_batch([b.column("doc_id"), b.column("whole"), *[pa.array(np.ascontiguousarray(codes[:, w])) for w in range(WIDE)]], names=["doc_id", "whole", *words])

    marked = documents(docs).withColumn("whole", F.xxhash64("text")).mapInArrow(run, "doc_id long, whole long, " + ", ".join(f"{w} long" for w in words))
    marked = held(marked.withColumn("fp", F.xxhash64(*words)))
    codes = held(marked.groupBy("fp").agg(*[F.min(w).alias(w) for w in words]))
    reach = components(similar_links(codes, radius_of(similarity)))
    named = codes.join(reach, codes["fp"] == reach["id"], "left").select("fp", F.coalesce("component", "fp").alias("c"))
    return _one_each(docs, marked, named)
