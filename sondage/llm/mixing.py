"""Mixing sources to target weights by Poisson replication, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sondage.functions.columns import quoted

#: Largest rate that one inversion handles; a larger one is the sum of equal parts with draws of their own.
PART = 256.0
#: A table of rates within these bounds is broadcast, else it is joined by shuffling.
BROADCAST_ROWS, BROADCAST_BYTES = 10_000, 1_000_000


def rates(docs: DataFrame, weights: DataFrame | None = None, temperature: float = 0.7, epochs: float = 1.0, source: str = "source") -> DataFrame:
    """(source, size, rate): mean number of copies of each document of a source.

    The mix holds ``epochs`` times the characters of the corpus and the share of a source in it is its target: the given weight
    (``weights``: source, weight; sources without one get 0) or its size to the power ``temperature``, each over the sum.
    """
    length = F.length(F.coalesce(quoted("text"), F.lit(""))).cast("double")
    sizes = docs.groupBy(quoted(source).cast("string").alias("source")).agg(F.sum(length).alias("size"))
    if weights is None:
        sizes = sizes.withColumn("target", F.pow("size", F.lit(temperature)))
    else:
        given = weights.select(F.col("source").alias("source_"), F.col("weight").cast("double").alias("weight_"))
        sizes = sizes.join(given, F.col("source").eqNullSafe(F.col("source_")), "left").withColumn("target", F.coalesce("weight_", F.lit(0.0)))
    total = sizes.agg(F.struct(F.sum("size").alias("size"), F.sum(F.when(F.col("size") > 0, F.col("target"))).alias("target")).alias("row")).scalar()
    rate = F.when((F.col("size") > 0) & (total["target"] > 0), F.col("target") / total["target"] * total["size"] * epochs / F.col("size")).otherwise(0.0)
    return sizes.select("source", "size", rate.alias("rate"))


def _draw(seed: int, *parts: Column) -> Column:
    """Uniform number in [0, 1) from 52 bits of an MD5 over seed and parts."""
    text = F.concat_ws(":", F.lit(str(seed)), *parts)
    return F.conv(F.substr(F.md5(text.cast("binary")), F.lit(1), F.lit(13)), 16, 10).cast("double") / float(1 << 52)


def poisson_steps(rate: Column) -> Column:
    """Distribution function of the Poisson distribution from 0 on, until nothing is left in doubles."""
    zero = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("all"))
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")

    def step(a: Column, k: Column) -> Column:
        p = a["p"] * rate / k
        return F.struct(p.alias("p"), (a["sum"] + p).alias("sum"), F.concat(a["all"], F.array(a["sum"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), last), zero, step, lambda a: a["all"])


def replicate(docs: DataFrame, table: DataFrame, seed: int = 42, source: str = "source") -> DataFrame:
    """``docs`` with ``_rate`` and ``_copies``, the hash-seeded Poisson draw of every row (rows of one ``doc_id`` draw alike)."""
    steps = table.select(F.col("source").alias("_source"), F.col("rate").alias("_rate"), F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int").alias("_parts"))
    steps = steps.withColumn("_steps", poisson_steps(F.col("_rate") / F.col("_parts")))
    size = table.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.coalesce("source", F.lit("")))).alias("b")).first()
    small = size["n"] <= BROADCAST_ROWS and (size["b"] or 0) <= BROADCAST_BYTES
    joined = docs.join(F.broadcast(steps) if small else steps, quoted(source).cast("string").eqNullSafe(F.col("_source")))
    name = F.coalesce(quoted("doc_id").cast("string"), F.lit(""))

    def add(n: Column, part: Column) -> Column:
        u = _draw(seed, name, part.cast("string"))
        return n + F.size(F.filter(F.col("_steps"), lambda c: c <= u))

    copies = F.aggregate(F.sequence(F.lit(1), F.col("_parts")), F.lit(0), add)
    return joined.withColumn("_copies", copies).drop("_source", "_parts", "_steps")


def mix(docs: DataFrame, weights: DataFrame | None = None, temperature: float = 0.7, epochs: float = 1.0, seed: int = 42, source: str = "source") -> DataFrame:
    """Every document as often as it is drawn, in globally shuffled order, with ``_rate``, ``_copy`` (from 0) and ``_shuffle``.

    A document's number of copies is the Poisson quantile, at its source's rate, of a number hashed from the seed and ``doc_id``. The
    result is dealt over all partitions by a hash of (seed, document, copy) and sorted by it within each, so that order is random,
    repeatable, and no source stays together.

    Defined cases: a null source is a source of its own; a null text has length 0 and is copied like others of its source; a
    source of size 0 or without weight has rate 0 and goes; a null ``doc_id`` draws as the empty string; repeated rows draw alike;
    an empty table gives an empty result. Columns of ``docs`` come back as they are.
    """
    drawn = replicate(docs, rates(docs, weights, temperature, epochs, source), seed, source).where("_copies > 0")
    each = drawn.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).drop("_copies")
    name = F.coalesce(quoted("doc_id").cast("string"), F.lit(""))
    key = F.md5(F.concat_ws(":", F.lit(f"{seed}#"), name, F.col("_copy").cast("string")).cast("binary"))
    return each.withColumn("_shuffle", F.substr(key, F.lit(1), F.lit(16))).repartition("_shuffle").sortWithinPartitions("_shuffle")
