"""The corpus pipeline: documents in, a mixed training set out.

Each stage is one operator of ``gearlens.llm`` applied to all documents that the
stage before it kept.  ``run`` writes every stage's result to the shared folder
and reads it back, so a lost executor never repeats an earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gearlens.llm import decontam, langid, minhash, mixing, secrets
from gearlens.llm.common import stage, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn the languages from the labelled documents that are not held out;
    documents without any text to identify (``und``) go.  ``lang``, where it is
    null, becomes the predicted language.  Without any language to learn nothing is
    predicted, and the documents without a letter go."""
    model = langid.fit(docs.where(~langid.held_out()))
    found = langid.identify(docs.withColumn("__text", F.col("text")), model, "__text", *[c for c in docs.columns if c not in ("doc_id", "text")])
    _, automata = model
    kept = found.where(F.col("lang_pred") != langid.UNKNOWN if automata else F.col("__text").rlike(r"\p{L}")).withColumnRenamed("__text", "text")
    return kept.withColumn("lang", F.coalesce("lang", F.nullif("lang_pred", F.lit(langid.UNKNOWN)))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words a shingle, similarity 0.8."""
    return minhash.deduplicate(docs, width=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that the benchmark contaminates."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the found secrets masked."""
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document."""
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination),
          ("secret_scan", secret_scan), ("source_mix", source_mix)]
#: Cross-parsing and min-max signatures can't be stated in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
