from functools import partial

import pytest
from pyspark.sql import functions as F

from leafwork.llm import bpe
from tests.oracle import SMALL

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_over_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, ids, texts = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert set(docs.columns) == set(columns)
            texts = {r["doc_id"]: r["text"] for r in docs.collect()}
        now = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert now <= ids, name
        ids = now
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == texts


def test_stages_of_no_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() == 0


def test_stages_of_odd_rows(spark):
    """Nulls, long and blank texts, repeated rows and ids, ties, and columns named as those that stages use."""
    text = "the people of the town have seen that it was good and went home with the others in the evening"
    rows = [(i, f"{text} and number {i} is the one of them that {'many' * (i % 7)} said", "en", "ab"[i % 2], 9) for i in range(60)]
    rows += [(1, rows[1][1], "en", "a", 9)] * 3 + [(2, "but this is a text that has nothing to do with what the other says", "en", "b", 9), (None, text, None, None, None)]
    rows += [(100, None, "en", "a", 0), (101, "", "en", "a", 0), (102, " \n ", "en", None, 3), (103, (text + " ") * 2000, "en", "a", 9), (104, "!!! ???", None, "b", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("key", "gone", "again", "host", "bad", "shard", "block", "tokens", "component", "node", "hash", "__gone", "__chosen"):
        docs = docs.crossJoin(spark.range(1).select(F.lit(1).alias(c)))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        if name != "bpe":
            assert out.columns == docs.columns, name
        ids = [r["doc_id"] for r in out.select("doc_id").collect()]
        assert len(ids) == len(rows) if name in ("line_dedup", "bpe") else len(ids) < len(rows), name
        if name == "language_id":
            assert not set(ids) & {100, 101, 102, 104} and ids.count(1) == 4
        if name == "near_dedup":
            assert ids.count(1) <= 1 and {None, 100, 101, 102, 104} <= set(ids)


def test_last_stage_shuffles_no_documents_beyond_its_table(spark, monkeypatch):
    """As with a vocabulary that is larger than the broadcast table."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    monkeypatch.setattr(bpe, "encode", partial(bpe.encode, broadcast_bytes=0))
    out = dict(corpus_pipeline.STAGES)["bpe"](spark, docs, SMALL)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {r["doc_id"]: r["text"] for r in docs.collect()}


def test_pipeline_writes_each_stage_and_keeps_the_last(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns == ["doc_id", "ids", "text"] and out.count() > 0
