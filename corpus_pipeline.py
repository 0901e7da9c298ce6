"""A corpus pipeline of five stages over documents; part of the llm subpackage.

STAGES lists (name, function). Each function takes (spark, docs, folder of the tables) and works on all rows the
stage before kept; all but the last return the columns of documents, clashing names included. Between stages rows are
written as Parquet and read again. Every stage reads whole texts of any length, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyworks.llm import decontaminate, ngram_join, piece_codec, rule_ledger, secret_forest
from tallyworks.session import durable

# Near copies of the corpus share 80 % of their runs of five words; the bar of op3 binds that query only.
NEAR = ngram_join.JoinParams(words=5, percent=80)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current rule policy keeps; null and empty texts have no words and go, repeated rows share a verdict."""
    return rule_ledger.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group that links join: the smallest doc_id, then the smallest hash of the text; none counts as largest.

    Repeated rows are one; rows without words link with nothing and stay.
    """
    return ngram_join.one_of_each(docs, NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage; null and empty texts have none and stay, as do repeated rows."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark; null texts stay null, repeated rows repeat."""
    return secret_forest.redacted(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document; null and empty texts have none, repeated rows repeat."""
    return piece_codec.encoded(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_join", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scans", secret_redaction),
    ("sentencepiece", encoding),
]

# The join, the forest and the piece model have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = durable(docs)
    return docs


def registered() -> tuple[dict, dict]:
    """(queries, oracle SQL) of the pipeline."""
    return {"pipeline": run}, {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
