"""The pipeline's stages on small tables: their decisions take effect, clean rows stay."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyloom.llm import lines, mixing, simhash, toxicity

STAGES = dict(corpus_pipeline.STAGES)
DATA = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark, table):
    docs = table("documents")
    labels = table("labels")
    frames = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, DATA).persist()
        frames[name] = now
    kept = {r["doc_id"] for r in frames["toxicity"].collect()}
    scores = toxicity.score_documents(docs, toxicity.train(docs, labels)).collect()
    assert kept == {r["doc_id"] for r in scores if r["score"] < 0.7}
    want = {r["doc_id"]: r["text"] for r in lines.dedup_lines(frames["toxicity"]).collect()}
    assert {r["doc_id"]: r["text"] for r in frames["line_dedup"].collect()} == want
    groups = simhash.near_duplicates(frames["line_dedup"]).collect()
    assert {r["doc_id"] for r in frames["simhash"].collect()} == {r["component_id"] for r in groups}
    taken = mixing.mix(frames["simhash"]).agg(F.sum("taken")).first()[0]
    words = frames["source_mix"].agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0]
    assert words == taken
    for name in ("toxicity", "line_dedup", "simhash", "source_mix"):
        assert frames[name].dtypes == docs.dtypes
        assert frames[name].where("n_chars <> length(text)").count() == 0
    copies = {r["doc_id"]: r["n"] for r in frames["source_mix"].groupBy("doc_id").agg(
        F.count("*").alias("n")).collect()}
    first = {r["doc_id"]: r["n"] for r in frames["packing"].where("start = 0").groupBy("doc_id").agg(
        F.count("*").alias("n")).collect()}
    assert first == copies


def test_run_returns_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, DATA)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert rows.count() > 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_and_empty_tables(spark, odd, no_documents, name):
    made = STAGES[name](spark, odd, DATA)
    if name != "packing":
        assert made.dtypes == odd.dtypes
    assert made.count() > 0
    assert STAGES[name](spark, no_documents, DATA).count() == 0


def test_hot_source_and_large_group_of_copies(spark, documents):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    hot = " ".join(rng.choices(words, k=80))
    rows = [(i, hot if i % 3 == 0 else " ".join(rng.choices(words, k=60)), "hot" if i % 3 else "b")
            for i in range(900)]
    docs = documents(rows, 6)
    kept = STAGES["simhash"](spark, docs, DATA)
    assert kept.where("doc_id % 3 = 0").count() == 1 and kept.count() == 601
    assert STAGES["source_mix"](spark, kept, DATA).count() > 0
