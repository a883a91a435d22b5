"""A training-data pipeline over ``documents``: classify, drop near copies, strip repeated passages, mix, pack.

Every stage works on all that the one before kept, and every decision takes effect: rejected documents go, one document of each
group of near copies stays, repeated words go, and documents are copied or left out as drawn. All stages but the last return the
columns of ``documents``. Null and empty texts, null columns, repeated rows and empty tables are defined by the operators called.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sondage.llm import mixing, packing, quality, simhash, substring
from sondage.session import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained quality classifier accepts."""
    return quality.keep_good(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"), cut=0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each class of documents that SimHash links: four-word shingles, at most 7 of 64 bits apart."""
    return simhash.keep_first(docs.select(COLUMNS), shingle=4, radius=7)


def strip_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without words of 20-word windows that occur earlier; documents of which nothing is left go."""
    return substring.strip_repeats(docs.select(COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated towards shares in proportion to source size to the power 0.7, shuffled."""
    return mixing.mix(docs.select(COLUMNS), temperature=0.7, epochs=1.0, seed=42).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all token pieces in sequences of 2,048; each copy of a document is packed by itself."""
    import public_tokenizers

    return packing.pack(docs.select(COLUMNS), public_tokenizers.path("word_bpe_49k.json"), size=2048, end=0)


STAGES = [
    ("quality classifier", classify),
    ("SimHash near-dedup", drop_near_copies),
    ("substring dedup", strip_passages),
    ("mixing to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The classifier, fingerprints of XXH64 and the tokenizer are beyond SQL; the stages are tested one by one instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; every earlier stage is written to the shared folder as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
