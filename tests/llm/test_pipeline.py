"""The pipeline's stages on edge rows and on documents."""

import numpy as np

import corpus_pipeline as P
from sondage.llm import simhash
from tests.conftest import SMALL
from tests.llm import edge


def test_stages_keep_the_columns(spark):
    docs = edge.table(spark)
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == P.COLUMNS, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert P.STAGES[-1][1](spark, docs, SMALL).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_stages_on_an_empty_table(spark):
    for name, stage in P.STAGES:
        assert stage(spark, edge.empty(spark), SMALL).count() == 0, name


def test_run_packs_what_the_stages_keep(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = P.run(spark, SMALL).collect()
    known = {r.doc_id for r in docs.select("doc_id").collect()}
    rejected = {r.doc_id for r in docs.select("doc_id").subtract(P.classify(spark, docs, SMALL).select("doc_id")).collect()}
    assert got and {r.doc_id for r in got} <= known - rejected
    used = {}
    for r in got:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 2048


def test_near_copies_are_those_of_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, simhash.fingerprint((r.text or "").encode())) for r in docs.select("doc_id", "text").collect())
    codes = np.array([c for _, c in rows], dtype=np.uint64)
    away = np.bitwise_count(codes[:, None] ^ codes[None, :])
    label = np.arange(len(codes))
    while True:  # the least index that each reaches
        least = np.where(away <= 7, label[None, :], len(codes)).min(axis=1)
        if (least == label).all():
            break
        label = least
    kept = {r.doc_id for r in P.drop_near_copies(spark, docs, SMALL).select("doc_id").collect()}
    assert kept == {rows[i][0] for i in np.unique(label)}
