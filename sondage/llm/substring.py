"""Substring deduplication by relative Lempel-Ziv parsing against an index of the corpus's own reference blocks.

A reference block is a run of GRAM words. Of every WINDOW-word window the block with the least hash is indexed (winnowing), so
equal windows index the same block at the same place. A document is factored against the first occurrence of its blocks:
neighbouring blocks that point to one place of one earlier document are a factor, and since neighbours overlap, a factor is
proven word by word. What windows a factor does not decide (they reach over its ends) are compared by 128-bit hashes with the
windows around the same block's first occurrence and around its other undecided occurrences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from sondage.functions.columns import quoted
from sondage.llm.common import U, Words, chunks, held, scramble

WINDOW = 20
GRAM = 11
_SPAN = WINDOW - GRAM + 1  # blocks in a window
_A, _B = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: Bits of the filter that tells repeated blocks: a fixed size, whatever the corpus; a full filter lets more pass, never less.
FILTER_BITS = 1 << 27


def runs(h: np.ndarray, n: int, base: int) -> np.ndarray:
    """Polynomial hash of every n consecutive word hashes."""
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64)
    power, size, block, out, got = h, 1, n, None, 0
    while block:
        if block & 1:
            if out is None:
                out, got = power, size
            else:
                k = len(h) - got - size + 1
                out, got = out[:k] * U(pow(base, size, 1 << 64)) + power[got : got + k], got + size
        block >>= 1
        if block:
            k = len(power) - size
            power, size = power[:k] * U(pow(base, size, 1 << 64)) + power[size : size + k], size * 2
    return scramble(out)


def indexed(words: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of the windows that lie in one document, position of each window's block, hashes of all blocks)."""
    if len(h) < WINDOW:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(0, dtype=np.uint64)
    g = runs(h, GRAM, _A)
    owner = np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))
    start = np.flatnonzero(owner[: len(h) - WINDOW + 1] == owner[WINDOW - 1 :])
    best, size, at = g, 1, np.arange(len(g))
    levels = {1: (best, at)}
    while size * 2 <= _SPAN:
        best, at = _lesser(best, at, size)
        size *= 2
        levels[size] = (best, at)
    done, (best, at) = size, levels[size]
    while done < _SPAN:
        step = max(s for s in levels if s <= _SPAN - done)
        v, p = levels[step]
        k = len(v) - done
        left = best[:k] <= v[done:]
        best, at = np.where(left, best[:k], v[done:]), np.where(left, at[:k], p[done:])
        done += step
    return start, at[start], g


def _lesser(v: np.ndarray, p: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    left = v[:-step] <= v[step:]
    return np.where(left, v[:-step], v[step:]), np.where(left, p[:-step], p[step:])


def _rows(docs: DataFrame) -> DataFrame:
    """(did, rk, text): the id (null: before all others) and a hash of the text, which together name a row and its exact repeats."""
    text = F.coalesce(quoted("text"), F.lit(""))
    return docs.select(
        F.coalesce(quoted("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("did"), F.xxhash64(text).alias("rk"), text.cast("binary").alias("text")
    )


def _blocks(rows: DataFrame, filter_: object | None) -> DataFrame:
    """Indexed blocks: hash alone without ``filter_``; else (h, did, rk, pos) of those that pass it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if filter_ is None else filter_.value
        for b in batches:
            did, rk = b.column("did").to_numpy(), b.column("rk").to_numpy()
            for lo, _, data, offs in chunks(b.column("text")):
                words = Words(data, offs)
                _, at, g = indexed(words, words.hashes())
                at = np.unique(at)
                h = g[at]
                if bits is None:
                    yield pa.record_batch([pa.array(h.view(np.int64))], names=["h"])
                    continue
                i = h & U(FILTER_BITS - 1)
                ok = (bits[(i >> U(6)).astype(np.int64)] >> (i & U(63))) & U(1) == 1
                at, h = at[ok], h[ok]
                doc = np.searchsorted(words.bounds, at, side="right") - 1
                pos = (at - words.bounds[doc]).astype(np.int32)
                yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(did[lo + doc]), pa.array(rk[lo + doc]), pa.array(pos)], names=["h", "did", "rk", "pos"])

    return rows.mapInArrow(run, "h long" if filter_ is None else "h long, did long, rk long, pos int")


def _repeated(blocks: DataFrame) -> np.ndarray:
    """Bit array of FILTER_BITS with a bit for every block that occurs twice or more, put together on the executors."""
    twice = blocks.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    place = F.col("h").bitwiseAND(FILTER_BITS - 1)
    words = twice.select(F.shiftright(place, 6).alias("w"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    got = words.toArrow()
    bits = np.zeros(FILTER_BITS >> 6, dtype=np.uint64)
    bits[got.column("w").to_numpy()] = got.column("b").to_numpy().view(np.uint64)
    return bits


def factors(did: int, rk: int, entries: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Factors of one document and its undecided blocks.

    ``entries`` hold its blocks that occur more than once, by position, with the place of their first occurrence. Returns the
    [start, end) of every factor of WINDOW words or more, and the indices of the blocks with windows that no factor decides.
    """
    pos, rd, rr, rp = entries["pos"].astype(np.int64), entries["r_did"], entries["r_rk"], entries["r_pos"].astype(np.int64)
    older = (rd < did) | ((rd == did) & (rp < pos))
    link = older[1:] & older[:-1] & (rd[1:] == rd[:-1]) & (rr[1:] == rr[:-1]) & (rp[1:] - pos[1:] == rp[:-1] - pos[:-1]) & (pos[1:] - pos[:-1] <= _SPAN)
    chain = np.concatenate([[0], np.cumsum(~link)])
    start = pos[np.searchsorted(chain, np.arange(chain[-1] + 1))]
    end = pos[np.searchsorted(chain, np.arange(chain[-1] + 1), side="right") - 1] + GRAM
    open_ = older & ((pos - _SPAN + 1 < start[chain]) | (pos + WINDOW > end[chain]))
    long = (end - start >= WINDOW) & older[np.searchsorted(chain, np.arange(chain[-1] + 1))]
    return np.stack([start[long], end[long]], axis=1), np.flatnonzero(open_)


def _parsed(gathered: DataFrame) -> DataFrame:
    """(did, rk, spans: flat starts and ends, need: the undecided blocks) of every document with repeated blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for did, rk, e in zip(b.column("did").to_pylist(), b.column("rk").to_pylist(), b.column("e")):
                rows = e.values
                entries = {k: rows.field(k).to_numpy() for k in ("pos", "h", "r_did", "r_rk", "r_pos")}
                _, keep = np.unique(entries["pos"], return_index=True)
                entries = {k: v[keep] for k, v in entries.items()}
                span, need = factors(did, rk, entries)
                out.append((did, rk, span.ravel().tolist(), entries["pos"][need].tolist(), entries["h"][need].tolist()))
            cols = list(zip(*out)) if out else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
            yield pa.record_batch([pa.array(list(c), type=k) for c, k in zip(cols, kinds)], names=["did", "rk", "spans", "at", "h"])

    return gathered.mapInArrow(run, "did long, rk long, spans array<long>, at array<int>, h array<long>")


def _packed(rows: DataFrame) -> DataFrame:
    """The rows with their text compressed, for a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.record_batch([b.column("did"), b.column("rk"), pa.array([c.compress(x.as_buffer()) for x in b.column("text")], type=pa.binary())], names=["did", "rk", "z"])

    return rows.mapInArrow(run, "did long, rk long, z binary")


def _windows(asked: DataFrame) -> DataFrame:
    """128-bit hashes of the windows whose block was asked for: (a, b, did, rk, start, first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()
        for batch in batches:
            for did, rk, z, at, first in zip(*[batch.column(c) for c in ("did", "rk", "z", "at", "first")]):
                data = np.frombuffer(d.decompress(z.as_buffer()), dtype=np.uint8)
                words = Words(data, np.array([0, len(data)]))
                h = words.hashes()
                start, block, _ = indexed(words, h)
                at, first = at.values.to_numpy(), first.values.to_numpy(zero_copy_only=False)
                for flag in (False, True):
                    s = start[np.isin(block, at[first == flag])]
                    if len(s):
                        a, b = runs(h, WINDOW, _A)[s], runs(h, WINDOW, _B)[s]
                        n = len(s)
                        yield pa.record_batch(
                            [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(n, did.as_py())), pa.array(np.full(n, rk.as_py())), pa.array(s.astype(np.int32)), pa.array(np.full(n, flag))],
                            names=["a", "b", "did", "rk", "start", "first"],
                        )

    return asked.mapInArrow(run, "a long, b long, did long, rk long, start int, first boolean")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(did, rk, spans array<long>): for every row with something to remove, starts and ends (in words, end excluded) of spans to remove."""
    rows = _rows(docs)
    filter_ = docs.sparkSession.sparkContext.broadcast(_repeated(_blocks(rows, None)))
    blocks = _blocks(rows, filter_)
    first = blocks.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("did", "pos", "rk")).alias("r")).where("n > 1")
    first = held(first.select("h", F.col("r.did").alias("r_did"), F.col("r.pos").alias("r_pos"), F.col("r.rk").alias("r_rk")))
    gathered = blocks.join(first, "h").groupBy("did", "rk").agg(F.sort_array(F.collect_list(F.struct("pos", "h", "r_did", "r_rk", "r_pos"))).alias("e"))
    parsed = held(_parsed(gathered))
    open_ = parsed.where(F.size("at") > 0)
    wanted = open_.select(F.explode("h").alias("h")).distinct()
    there = first.join(wanted, "h").select(F.col("r_did").alias("did"), F.col("r_rk").alias("rk"), F.col("r_pos").alias("at"), F.lit(True).alias("first"))
    here = open_.select("did", "rk", F.explode("at").alias("at"), F.lit(False).alias("first"))
    asked = there.unionByName(here).groupBy("did", "rk").agg(F.collect_list(F.struct("at", "first")).alias("x")).select("did", "rk", F.col("x.at").alias("at"), F.col("x.first").alias("first"))
    windows = held(_windows(_packed(rows).join(asked, ["did", "rk"]).select("did", "rk", "z", "at", "first")))
    earliest = windows.groupBy("a", "b").agg(F.min(F.struct("did", "start")).alias("r"))
    late = windows.where("not first").join(earliest, ["a", "b"]).where("r.did < did or (r.did = did and r.start < start)")
    hits = late.select("did", "rk", F.array(F.col("start").cast("long"), F.col("start").cast("long") + WINDOW).alias("spans"))
    spans = parsed.where(F.size("spans") > 0).select("did", "rk", "spans").unionByName(hits)
    return spans.groupBy("did", "rk").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def keep_words(text: bytes, spans: np.ndarray | None) -> tuple[list[bytes], int]:
    """(kept words, number of words) of a text without the words in ``spans``."""
    words = text.split()
    if spans is None or not len(spans):
        return words, len(words)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, spans[0::2], 1)
    np.add.at(change, spans[1::2], -1)
    keep = np.cumsum(change[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist()) if k], len(words)


def without_repeats(docs: DataFrame, texts: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, and with ``texts`` kept_text) for every row of ``docs``.

    A word goes if a WINDOW-word window that covers it has the words of a window that starts earlier (smaller ``doc_id``, or the
    same ``doc_id`` and an earlier start), judged on the input. Kept words are joined by one space.

    Defined cases: a null text has no words; fewer than WINDOW words are never removed; a null ``doc_id`` comes before all
    others; rows that share a ``doc_id`` count as one document, so an exact repeat of a row removes nothing from the other; an
    empty table gives an empty result. Other columns are ignored.
    """
    rows = _rows(docs)
    spans = repeated_spans(docs)
    joined = _packed(rows).join(spans, ["did", "rk"], "left").select("did", "z", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()
        for b in batches:
            total, gone, digest, kept = [], [], [], []
            for z, s in zip(b.column("z"), b.column("spans")):
                words, n = keep_words(d.decompress(z.as_buffer()), s.values.to_numpy() if s.is_valid else None)
                out = b" ".join(words)
                total.append(n)
                gone.append(n - len(words))
                digest.append(hashlib.sha256(out).hexdigest())
                if texts:
                    kept.append(out.decode("utf-8", "replace"))
            cols = [b.column("did"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())]
            yield pa.record_batch(cols + ([pa.array(kept, pa.string())] if texts else []), names=["did", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * texts)

    out = joined.mapInArrow(run, "did long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if texts else ""))
    return out.select(F.nullif("did", F.lit(-(1 << 63)).cast("long")).alias("doc_id"), *out.columns[1:])


def strip_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns, the text of rows with repeats replaced by the kept words and ``n_chars`` (if there) by their length.

    Rows of which nothing is left go; a text without repeats stays as it is, white space included. Null and empty texts stay;
    of repeated rows only the first keeps repeated windows; an empty table stays empty; columns may have any name.
    """
    spans = repeated_spans(docs).select(F.col("did").alias("cut_id"), F.col("rk").alias("cut_rk"), F.col("spans").alias("cut"))
    did = F.coalesce(quoted("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long"))
    rows = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"), did.alias("id"), F.xxhash64(F.coalesce(quoted("text"), F.lit(""))).alias("rk"))
    joined = rows.join(spans, (F.col("id") == F.col("cut_id")) & (F.col("rk") == F.col("cut_rk")), "left")

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        kept = [None if t is None else b" ".join(keep_words(t.encode(), s)[0]).decode("utf-8", "replace") for t, s in zip(text, spans)]
        return pd.Series(kept, dtype=object)

    there = F.col("cut").isNotNull()
    out = joined.withColumn("kept", cut(F.when(there, F.col("row")["text"]), "cut")).where("kept is null or kept <> ''")
    changed = {"text": F.coalesce("kept", F.col("row")["text"])}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(there, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row")["n_chars"])
    return out.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
