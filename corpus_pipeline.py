"""A training corpus from raw documents: five stages, each on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmark.llm._store import small_batches, table, written
from quillmark.llm.bpe import round_trip
from quillmark.llm.decontaminate import decontaminated
from quillmark.llm.jaccard import keep_one_of_each
from quillmark.llm.langid import keep_identified
from quillmark.llm.lines import dedup_lines


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; those without a letter or mostly of unknown n-grams go."""
    small_batches(spark)
    return keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the line chunks that an earlier one has; those that consist of such chunks go."""
    return dedup_lines(docs).where("n_removed = 0 or n_removed < n_lines").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies, the document of least doc_id."""
    small_batches(spark)
    return keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that benchmark items have."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to."""
    small_batches(spark)
    return round_trip(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("byte_bpe", byte_bpe)]

#: SQL can express neither the learned filter of the first stage nor the encoder of the last; tests/llm has brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of what all stages leave of documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
