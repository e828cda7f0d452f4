"""From raw documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and is written as Parquet and read
again before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from myospark.llm import decontaminate, near_dedup, quality_rules, secret_scan, sentencepieces
from myospark.llm.queries import PIECE_MODEL, table
from myospark.storage import discard, materialize, workspace


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or a certified cutoff go."""
    return quality_rules.kept_documents(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document of the least id stays."""
    return near_dedup.one_of_each(docs)


def keep_clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark; n_chars follows the text."""
    return secret_scan.redact_documents(docs, secret_scan.train(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token count, and digests of the ids and of the decoded text."""
    return sentencepieces.encode_text(docs.select("doc_id", "text"), PIECE_MODEL, ids_col=None, digest=True)


STAGES = [
    ("quality_rules", keep_quality),
    ("near_dedup", keep_one_of_each),
    ("decontamination", keep_clean_of_benchmark),
    ("secret_scan", redact_secrets),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with workspace(spark) as keep:  # what the stage wrote for itself goes, and then what it read
            docs = keep(materialize(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can express neither the Markov models nor the tokenizer; tests hold run() against brute force.
ORACLE_SQL = None
