"""Extra columns with names that operators use themselves, ids that are strings, repeated rows and empty tables."""

import pytest
from pyspark.sql import functions as F

from weftgraph.llm import chat, decontaminate, html, line_dedup, mixing, ngram_join, paragraph_dedup, quality, queries, token_count, toxicity

NAMES = ["__in0", "__in1", "__x", "__features", "__y", "__raw", "__p", "__probability", "__row", "__text", "__keys", "__lang", "__source", "__domain", "__tokens", "__whole", "__host", "__templates", "__html", "g", "m0", "l00", "l10", "x0", "x4", "d", "scale", "uid", "a.b", "hits", "items"]
LINE = "A line that some of these documents have in common, more than once"


def extended(df):
    for c in NAMES:
        df = df.withColumn(c, F.lit(f"own {c}"))
    return df


def documents(spark):
    rows = [(f"d{i:02d}", f"{LINE}\nwords of their own number {i} and {i * 7} and some more of them here", "en" if i % 2 else None, "src0") for i in range(30)]
    rows += [rows[3], rows[3], ("null", None, None, None), (None, "", "en", "src1"), ("long", "word " * 3000, "en", "src1")]
    return spark.createDataFrame(rows, "doc_id string, text string, lang string, source string")


def toxic_model(spark):
    rows = [(f"word{i % 7} you idiot thing{i}", 1) for i in range(20)] + [(f"word{i % 7} you friend thing{i}", 0) for i in range(30)]
    return toxicity.fit(spark.createDataFrame(rows, "text string, label int"))


def vocabulary():
    return {"▁": -5.0, **{c: -6.0 for c in "abcdefghijklmnopqrstuvwxyz"}, "▁word": -2.0, "<unk>": -10.0}


KEEPING = {
    "op1": lambda spark, docs: decontaminate.find_contamination(docs, spark.createDataFrame([("q", LINE)], "item_id string, text string")),
    "op3": lambda spark, docs: toxic_model(spark).score(docs),
    "op4": lambda spark, docs: quality.judge_quality(docs, keep=docs.columns),
    "op5": lambda spark, docs: mixing.mix_sources(docs, budget_share=1.0, epochs=1),
    "op7": lambda spark, docs: html.extract_text(docs.withColumns({"html": F.col("text"), "url": F.lit("http://h.example.com/")})),
    "op8": lambda spark, docs: line_dedup.dedup_lines(docs),
}


@pytest.mark.parametrize("op", sorted(KEEPING))
def test_extra_columns_come_back(spark, op):
    docs = extended(documents(spark))
    out = KEEPING[op](spark, docs)
    replaced = {"op1": {"hits", "items"}}.get(op, set())
    rows = out.collect()
    assert len(rows) == docs.count()
    for c in NAMES:
        if c not in replaced:
            assert {r[c] for r in rows} == {f"own {c}"}, c
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in docs.select("doc_id").collect())
    assert KEEPING[op](spark, docs.limit(0)).count() == 0


def test_token_counts_keep_extra_columns(spark):
    words, fallback = token_count.read_vocabulary(f"{queries.TOKENIZERS}/piece_bpe_32k.model")
    docs = extended(documents(spark))
    rows = token_count.count_tokens(docs, words, fallback).collect()
    assert len(rows) == docs.count() and all(r[c] == f"own {c}" for r in rows for c in NAMES)
    assert token_count.count_tokens(docs.limit(0), words, fallback).count() == 0


def test_pairs_pay_no_heed_to_extra_columns(spark):
    docs = documents(spark)
    for f in (ngram_join.ngram_components, paragraph_dedup.repeated_paragraphs):
        assert sorted(map(repr, f(extended(docs)).collect())) == sorted(map(repr, f(docs).collect()))
        assert f(extended(docs).limit(0)).count() == 0


def test_conversations_with_extra_columns(spark):
    turns = spark.createDataFrame([("c", 0, "user", "hi"), ("c", 1, "assistant", "ho"), ("e", 0, "user", None)], "conv_id string, turn int, role string, text string")
    with open(f"{queries.TOKENIZERS}/byte_bpe_50k.json", encoding="utf-8") as f:
        tokenizer = f.read()
    assert sorted(map(repr, chat.format_conversations(extended(turns), tokenizer).collect())) == sorted(map(repr, chat.format_conversations(turns, tokenizer).collect()))
    assert chat.format_conversations(extended(turns).limit(0), tokenizer).count() == 0
