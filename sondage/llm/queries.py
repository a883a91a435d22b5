"""Registered queries of the operators: whole tables, production parameters, digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sondage.llm import crosspolytope, mixing, multiindex, packing, periodicity, pitmanyor, prefixtable, quality, simhash, substring, toxicity, turns, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(make: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[make.__name__] = make
    return make


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op7_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Class of every document under 4-word SimHash fingerprints within 4 bits."""
    found = simhash.near_duplicates(table(spark, folder, "documents"), shingle=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op5_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Place of every document's tokens in sequences of 2,048."""
    import public_tokenizers

    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), size=2048, end=0)


@query
def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without repeated 20-word windows."""
    return substring.without_repeats(table(spark, folder, "documents"), texts=False)


@query
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learned from two thirds of the labels."""
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"), cut=0.7)


@query
def op3_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """log10 probability of every document under the hierarchical Pitman-Yor model, beside the add-one base."""
    return pitmanyor.score(table(spark, folder, "documents"))


@query
def op6_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links and class of every embedding at a cosine of 0.95."""
    return crosspolytope.near_duplicates(table(spark, folder, "embeddings"), threshold=0.95)


@query
def op10_multi_index_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest of every row whose id is divisible by 20, against all rows."""
    rows = table(spark, folder, "embeddings")
    return multiindex.nearest(rows, rows.where("vec_id % 20 = 0"), k=20)


#: Allowed and blocked hosts and paths of op1.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


@query
def op1_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page's url; the model learns from the seed table alone, so no verdict depends on the other pages."""
    model = urls.train(urls.seed_urls(spark))
    return urls.judge(table(spark, folder, "pages"), URL_RULES, model, cut=0.06)  # set with scores of the given pages in view; see README for held-out rates


@query
def op2_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document and whether it is accepted."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    model = quality.learn(docs, table(spark, folder, "labels"), most=20_000)
    scored = quality.with_score(docs, model, "score").select("doc_id", "score")
    return scored.withColumn("accepted", (F.col("score") >= 0.5).cast("int"))


@query
def op4_mixing_to_target_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Copies of every document for a mix with shares in proportion to size to the power 0.7, globally shuffled."""
    mixed = mixing.mix(table(spark, folder, "documents"), temperature=0.7, epochs=1.0, seed=42)
    return mixed.select(
        "doc_id", "source", F.col("_copy").alias("copy"), F.round("_rate", 6).alias("rate"), F.col("_shuffle").alias("shuffle_key"), F.md5(F.col("text").cast("binary")).alias("text_md5")
    )


ORACLES["op4_mixing_to_target_weights"] = """
WITH RECURSIVE sizes AS (SELECT source, CAST(sum(length(coalesce(text, ''))) AS DOUBLE) AS size FROM documents GROUP BY source),
totals AS (SELECT sum(size) AS size, sum(pow(size, 0.7)) AS target FROM sizes),
rates AS (SELECT s.source, pow(s.size, 0.7) / t.target * t.size / s.size AS rate FROM sizes s, totals t),
steps AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS upto FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), upto + p * rate / (k + 1) FROM steps WHERE k < ceil(rate + 12 * sqrt(rate) + 30)
),
draws AS (
  SELECT doc_id, source, text, CAST(CAST('0x' || substr(md5('42:' || doc_id || ':1'), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u FROM documents
),
copies AS (
  SELECT d.doc_id, d.source, d.text, s.rate, s.k AS copy FROM draws d JOIN steps s ON s.source = d.source AND s.upto <= d.u
)
SELECT doc_id, source, CAST(copy AS INTEGER) AS copy, round(rate, 6) AS rate,
  substr(md5('42#:' || doc_id || ':' || copy), 1, 16) AS shuffle_key, md5(text) AS text_md5
FROM copies"""


@query
def op11_conversation_structure_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults, cheapest edits and digest of the repaired form of every conversation, after the set damage."""
    rows = table(spark, folder, "conversations")
    return turns.report(turns.damaged(rows), every=rows)


@query
def op12_sentencepiece_codec(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of every document's ids and of the text they decode to."""
    import public_tokenizers

    coded = prefixtable.encode(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"), decoded=True)
    written = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(written.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Number, longest and digests of every document's runs, after the set repetitions, and the digest of the text without them."""
    found = periodicity.collapse(table(spark, folder, "documents"), plant=periodicity.planted_repeats, least=6, power=4)
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))), 1)
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    return found.withColumn("best", F.when(F.size("runs") > 0, best)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.s").alias("start"), (-F.col("best.l")).alias("length"), F.col("best.p").alias("period"),
        F.expr("(-1000 * best.l) div best.p").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"),
    )
