"""From raw documents to packed training windows: five stages, each on all that the one before it kept.

Every stage but the last returns the columns of documents, whatever others there are beside doc_id, text and source. The
result of each is written as Parquet before the next reads it. Texts of any length are read whole, and an empty table gives an
empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meshlark.llm import line_runs, mixing, near_groups, packing, rule_ledger
from meshlark.llm.common import documents, forget, written
from meshlark.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose bits in the ledger pass the policy corpus-1; the others go. Null and empty texts fail no rule of it."""
    return rule_ledger.keep_clean(docs, "corpus-1")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the runs of lines that occur at an earlier place too. `n_chars` follows the text.

    Null texts stay null; equal rows lose the same lines; the first place of a run (least doc_id, null first) stays.
    """
    return line_runs.dedup_lines(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8, verified exactly.

    The least doc_id stays (null last); rows go by doc_id and text; texts without words are copies of each other.
    """
    return near_groups.keep_one(docs, words=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: 0 to 3 times; null is a source; texts without words stay once."""
    return mixing.mixed(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 tokens. A null or empty text is the end id alone; equal rows are packed each."""
    return packing.pack(docs, vocabulary(), capacity=2048, end_id=1)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mix_sources", mix_sources),
    ("pack_windows", pack_windows),
]

#: SQL can't express runs of repeated lines, fingerprints and packing; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs, before = written(stage(spark, docs, sf_dir)), docs
        forget(before)  # nothing reads it again
    return STAGES[-1][1](spark, docs, sf_dir)
