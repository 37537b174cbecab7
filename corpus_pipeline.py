"""The corpus pipeline: from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and reread as the next one's ``docs``. All but the last
return the columns of ``documents``:

1. quality rules: documents the rules reject go,
2. n-gram Jaccard join: one document of each group of near-duplicates stays,
3. secret scan: every secret found is replaced by a mark (no document goes),
4. mixing: each document appears as often as the mix takes it,
5. packing: one row a piece of a token sequence.

Defined results: a null text is empty (the rules reject it); documents with a
null id or source, repeated rows and equal ids are documents of their own; an
empty table gives an empty result; further columns of any name stay as they
are through all stages but the last. Null ids come after others where the
smallest is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from llm import jaccard_join, mixing, packing, quality_rules, secret_scan
from llm.common import WRITTEN, discard_since, materialize, read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the host-level rules keep, unchanged."""
    return quality_rules.kept_documents(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each near-duplicate group."""
    return jaccard_join.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; ``n_chars`` follows a changed text."""
    return secret_scan.masked(docs, length="n_chars")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document zero, one or two times."""
    return mixing.repeat_taken(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return packing.pack(docs)


STAGES = [("quality rules", quality), ("n-gram Jaccard join", deduplicate), ("secret scan", secrets), ("mixing", mix), ("packing", pack)]
#: Groups by similarity, a systematic sample and a tokenizer are beyond SQL;
#: tests hold each stage and the whole against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        mark = len(WRITTEN)
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{k}")
        discard_since(spark, mark, docs)  # what the stage wrote for itself
    return STAGES[-1][1](spark, docs, sf_dir)
