"""Quality by co-training: a classifier of the text's content and one of the document's metadata teach each other.

Both are logistic regressions fitted by Newton steps whose sums Spark adds up over all rows. In every round each view labels the
unlabelled documents it is sure of, and the other view learns from them. At the end each view is calibrated on labelled
documents it has not learned from, and the calibrated views are combined.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sondage.functions.columns import quoted
from sondage.llm.common import Words, chunks, held

LANGS, SOURCES = 8, 32
_KIND = np.zeros(256, dtype=np.int8)  # 1 capital, 2 other letter, 3 digit, 4 sign, 5 line end, 0 the rest
_KIND[65:91], _KIND[97:123], _KIND[128:] = 1, 2, 2
_KIND[48:58] = 3
_KIND[[ord(c) for c in "!#$%&*|<>{}[]=_^~@\\/+"]] = 4
_KIND[10] = 5
CONTENT = 13
METADATA = 1 + 4 + LANGS + SOURCES


def content(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Content features of a chunk of texts, one row each; the first is 1."""
    n = len(offs) - 1
    kinds = _KIND[data]
    count = np.zeros((n, 6))
    for k in range(1, 6):
        total = np.concatenate([[0], np.cumsum(kinds == k)])
        count[:, k] = np.diff(total[offs])
    size = np.maximum(np.diff(offs), 1)
    words = Words(data, offs)
    number = np.diff(words.bounds)
    many = np.maximum(number, 1)
    owner = np.repeat(np.arange(n), number)
    h = words.hashes()
    again = np.zeros(n)
    if len(h) > 1:
        same = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
        again = np.bincount(owner[1:][same], minlength=n)
    different = np.zeros(n)
    if len(h):
        order = np.lexsort((h, owner))
        fresh = np.ones(len(h), dtype=bool)
        fresh[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        different = np.bincount(owner[order][fresh], minlength=n)
    signed = np.bincount(owner[kinds[words.ends - 1] == 4], minlength=n) if len(h) else np.zeros(n)
    shout = np.bincount(owner[(kinds[words.starts] == 1) & (kinds[np.minimum(words.starts + 1, words.ends - 1)] == 1) & (words.ends - words.starts > 1)], minlength=n) if len(h) else np.zeros(n)
    letters = np.maximum(count[:, 1] + count[:, 2], 1)
    share = [count[:, 1] / letters, count[:, 4] / size, count[:, 3] / size, again / many, signed / many, shout / many]
    log = [np.log(s + 0.01) for s in share[1:4] + share[4:]]
    return np.stack([np.ones(n), *share, *log, np.log(different / many + 0.01)], axis=1)


def metadata(lang: pd.Series, source: pd.Series, n_chars: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Metadata features: length, line length, hashed language and source; the first is 1."""
    n = len(lang)
    out = np.zeros((n, METADATA))
    size = np.maximum(np.nan_to_num(n_chars.astype(np.float64)), 0)
    out[:, 0] = 1
    out[:, 1] = np.log1p(size) / 5 - 1.5
    out[:, 2] = out[:, 1] ** 2
    out[:, 3] = np.log1p(size / (lines + 1)) / 5 - 1
    out[:, 4] = np.isnan(n_chars.astype(np.float64))
    for column, at, width in ((lang, 5, LANGS), (source, 5 + LANGS, SOURCES)):
        code, values = pd.factorize(column)
        place = np.array([zlib.crc32(str(v).encode()) % width for v in values] + [0])
        out[np.arange(n), at + place[code]] = np.where(code < 0, 0, 1)
    return out


def both_views(text: pa.Array, lang: pd.Series, source: pd.Series, n_chars: np.ndarray) -> np.ndarray:
    """Content and metadata features side by side."""
    lines = np.zeros(len(text))
    parts = []
    for lo, hi, data, offs in chunks(text):
        parts.append(content(data, offs))
        total = np.concatenate([[0], np.cumsum(data == 10)])
        lines[lo:hi] = np.diff(total[offs])
    body = np.concatenate(parts) if parts else np.zeros((0, CONTENT))
    return np.concatenate([body, metadata(lang, source, n_chars, lines)], axis=1)


_VIEW = {"content": slice(0, CONTENT), "metadata": slice(CONTENT, CONTENT + METADATA)}


def _features(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    n_chars = batch.column("n_chars").to_numpy(zero_copy_only=False).astype(np.float64)
    return both_views(batch.column("text"), batch.column("lang").to_pandas(), batch.column("source").to_pandas(), n_chars)


def _inputs(docs: DataFrame) -> list:
    have = set(docs.columns)
    pick = lambda c, kind: quoted(c).cast(kind).alias(c) if c in have else F.lit(None).cast(kind).alias(c)
    return [F.coalesce(quoted("text"), F.lit("")).cast("binary").alias("text"), pick("lang", "string"), pick("source", "string"), pick("n_chars", "double")]


@dataclass
class Model:
    """Weights of the views, their calibration (slope, shift), and the log odds of good documents among the labelled."""

    weights: dict[str, np.ndarray]
    scale: dict[str, tuple[float, float]]
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality: the calibrated views' evidence beyond the prior is added up."""
        z = np.full(len(x), self.prior)
        for name, part in _VIEW.items():
            slope, shift = self.scale[name]
            z += slope * (x[:, part] @ self.weights[name]) + shift - self.prior
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, most: int = 20_000, rounds: int = 3, steps: int = 4, sure: float = 0.98, weight: float = 0.2, ridge: float = 1.0) -> Model:
    """Co-trained model. At most ``most`` labelled documents (least hashes) count as labelled; a fifth of them, by hash, only calibrate.

    All other documents are the unlabelled pool: from the second round on a view learns a document with ``weight`` if the other
    view's probability is ``sure`` or more for either label.
    """
    rows = labels.select(quoted("doc_id").cast("long").alias("label_id"), quoted("quality").cast("int").alias("quality"))
    rows = rows.where(F.col("label_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("label_id").agg(F.min("quality").alias("quality"))
    some = rows.orderBy(F.xxhash64("label_id"), "label_id").limit(most)
    joined = docs.select(quoted("doc_id").cast("long").alias("doc_id"), *_inputs(docs)).join(F.broadcast(some), F.col("doc_id") == F.col("label_id"), "left")  # at most ``most`` rows of 12 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _features(b)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.astype(np.float32).ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
            yield pa.record_batch([flat, b.column("quality"), b.column("aside")], names=["x", "quality", "aside"])

    aside = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(3)), F.lit(5)) == 0
    table = held(joined.withColumn("aside", aside).mapInArrow(run, "x array<float>, quality int, aside boolean"))
    known = table.where("quality is not null").groupBy("quality").count().collect()
    good, bad = (sum(r["count"] for r in known if r["quality"] == v) for v in (1, 0))
    prior = float(np.log((good + 1) / (bad + 1)))
    weights = {name: np.zeros(part.stop - part.start) for name, part in _VIEW.items()}
    for name in weights:
        weights[name][0] = prior
    for r in range(rounds):
        teacher = {k: v.copy() for k, v in weights.items()} if r else None
        for _ in range(steps if not r else 2):
            weights = _newton(table, weights, teacher, sure, weight, ridge)
    return Model(weights, _calibrated(table, weights, prior), prior)


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return b.column("x").flatten().to_numpy().reshape(b.num_rows, -1).astype(np.float64)


def _newton(table: DataFrame, weights: dict, teacher: dict | None, sure: float, weight: float, ridge: float) -> dict:
    """Weights of both views after one Newton step over all rows; tasks send sums of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros((len(v) + 1, len(v))) for k, v in weights.items()}
        for b in batches:
            x = _matrix(b)
            quality = b.column("quality").to_numpy(zero_copy_only=False).astype(np.float64)
            aside = b.column("aside").to_numpy(zero_copy_only=False)
            for name, part in _VIEW.items():
                y = np.where(aside, np.nan, quality)
                mass = np.where(np.isnan(y), 0.0, 1.0)
                if teacher is not None:
                    other = next(k for k in _VIEW if k != name)
                    p = _sigmoid(x[:, _VIEW[other]] @ teacher[other])
                    lend = np.isnan(quality) & ((p >= sure) | (p <= 1 - sure))
                    y = np.where(lend, (p >= 0.5).astype(float), y)
                    mass = np.where(lend, weight, mass)
                own = mass > 0
                v, y, mass = x[own][:, part], y[own], mass[own]
                p = _sigmoid(v @ weights[name])
                sums[name][0] += v.T @ (mass * (y - p))
                sums[name][1:] += (v * (mass * p * (1 - p))[:, None]).T @ v
        flat = np.concatenate([s.ravel() for s in sums.values()])
        yield pa.record_batch([pa.array(np.arange(len(flat))), pa.array(flat)], names=["i", "s"])

    got = table.mapInArrow(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).toArrow()
    flat = np.zeros(sum(len(v) * (len(v) + 1) for v in weights.values()))
    flat[got.column("i").to_numpy()] = got.column("s").to_numpy()
    out, at = {}, 0
    for name, w in weights.items():
        s = flat[at : at + len(w) * (len(w) + 1)].reshape(len(w) + 1, len(w))
        at += s.size
        step = np.linalg.solve(s[1:] + ridge * np.eye(len(w)), s[0] - ridge * w)
        out[name] = w + step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
    return out


def _calibrated(table: DataFrame, weights: dict, prior: float) -> dict:
    """Slope and shift of each view's log odds on the labelled rows kept aside (a fifth of the bounded sample)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b)
            yield pa.record_batch([pa.array(x[:, part] @ weights[k]) for k, part in _VIEW.items()] + [b.column("quality")], names=[*_VIEW, "y"])

    got = table.where("aside and quality is not null").mapInArrow(run, "content double, metadata double, y int").toArrow()
    y = got.column("y").to_numpy().astype(np.float64)
    out = {}
    for name in _VIEW:
        z = got.column(name).to_numpy()
        v = np.stack([z, np.ones(len(z))], axis=1)
        w = np.array([0.0, prior])
        for _ in range(30):
            p = _sigmoid(v @ w)
            w = w + np.linalg.solve((v * (p * (1 - p))[:, None]).T @ v + 1e-2 * np.eye(2), v.T @ (y - p) - 1e-2 * (w - [0.0, prior]))
            w = np.clip(w, -50, 50)
        out[name] = (float(max(w[0], 0.0)), float(w[1]))
    return out


def with_score(docs: DataFrame, model: Model, column: str = "quality_score") -> DataFrame:
    """``docs`` with the probability of good quality of every row, from its whole text and its metadata.

    Defined cases: a null text counts as empty; null or missing ``lang``, ``source`` and ``n_chars`` are no evidence; texts may be
    of any length; repeated rows each get the same score; an empty table gives an empty result. Other columns stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(text: pa.Array, lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> pa.Array:
        x = both_views(text, lang.to_pandas(), source.to_pandas(), n_chars.to_numpy(zero_copy_only=False).astype(np.float64))
        return pa.array(shared.value.score(x))

    return docs.withColumn(column, run(*_inputs(docs)))


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = 0.5, most: int = 20_000) -> DataFrame:
    """The rows of ``docs`` with a quality score of ``cut`` or more, with their columns, whatever their names.

    Null and empty texts and null columns are scored like any other; repeated rows each stay or go; an empty table stays empty.
    """
    name = "_quality"
    while name in docs.columns:
        name += "_"
    return with_score(docs, learn(docs, labels, most), name).where(F.col(name) >= cut).drop(name)
