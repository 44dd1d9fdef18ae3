"""A corpus pipeline of five stages; each works on all that the stage before has kept.

run(spark, sf_dir) applies them to the documents table; each stage's rows are written as Parquet to the shared
folder and read again. The stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import decontaminate, line_dedup, mixing, ngram_join
from weftgraph.llm.queries import MIX, mix_domain, table, toxicity_model
from weftgraph.llm.staging import Staging

ORACLE_SQL = None  # trained trees decide in the first stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model predicts as toxic go. A null or empty text is scored like one without words;
    equal texts have equal scores; without labels of both kinds the share of toxic ones decides."""
    scored = toxicity_model(spark, docs, sf_dir).score(docs)
    return scored.where("predicted = 0").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more hold stay in the largest doc_id; n_chars follows the text. All documents stay;
    a null text becomes an empty one, and repeated rows of a doc_id lose the same lines."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each component stays, with all its rows. Documents without words are in
    no component and stay, those with a null doc_id too."""
    copies = ngram_join.ngram_components(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; those without words, or all for an empty benchmark, stay."""
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("hits") == 0).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents selected for the mix, with their domain, n_tokens and copies. Null languages and sources are leaves of
    their own; documents without tokens come with the first range of their leaf; an empty table gives an empty mix."""
    return mixing.mix_sources(docs, domain=mix_domain(), **MIX)


STAGES = [("toxicity", drop_toxic), ("line dedup", dedup_lines), ("n-gram Jaccard join", drop_near_copies), ("benchmark decontamination", drop_contaminated), ("mixing", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    staging = Staging(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, staging.save(stage(spark, docs, sf_dir), f"stage{k}")
        staging.drop(before)
    return docs
