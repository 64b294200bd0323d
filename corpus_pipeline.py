"""The corpus pipeline: language, near duplicates, benchmark passages, secrets, then packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from anchora.llm import decontaminate, jaccard, langid, packing, secrets
from anchora.plans.tables import shared_dir


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the table's own ``lang`` values teach; others go.

    Null texts and texts without a letter go, whatever their lang; a tie between languages keeps the document; repeated
    rows stay or go together; an empty table stays empty; other columns are carried along."""
    return langid.keep_known_languages(docs, docs.select("text", "lang"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words a shingle, a similarity of 0.8 or more.

    The least doc_id stays, and one of its rows where they are repeated; texts without words, and rows without an id,
    are in no group and stay; an empty table stays empty; other columns are carried along."""
    return jaccard.keep_one_of_each(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null and empty texts have none and stay; all rows of an id with a passage go, the null id being one of them; an empty
    table, or an empty benchmark, changes nothing; other columns are carried along."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked, row for row, repeated ones too.

    A null text stays null; overlapping secrets share a mask; n_chars follows a changed text; other columns are carried
    along."""
    return secrets.redact_secrets(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 2048 ids.

    A null or empty text is one piece with the end id; repeated rows are packed each; an empty table has no pieces; other
    columns are left behind."""
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", languages),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("secret scans", secret_spans),
    ("best-fit packing", packed),
]

#: Packing and the learnt models are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again for the next."""
    import uuid

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
