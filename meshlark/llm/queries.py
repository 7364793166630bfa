"""The registered queries of this subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from meshlark.llm.common import documents


def op8_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshlark.llm import rule_ledger as ops

    base = ops.mask_of(ops.POLICIES["base-1"])
    base_failed = F.col("failed").bitwiseAND(F.lit(base)) != 0
    return ops.ledger(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), (~base_failed & ops.verdict("prose-1")).alias("kept"), F.col("failed").alias("failed_rules"),
    )


def op2_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshlark.llm.run_index import remove_repeats

    kept = remove_repeats(documents(spark, sf_dir))
    return kept.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshlark.llm.line_runs import dedup_texts

    kept = dedup_texts(documents(spark, sf_dir))
    n_kept = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("kept_bytes")
    return kept.select("doc_id", "n_lines", "n_removed", n_kept, F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def vocabulary() -> str:
    """The vocabulary of the registered queries, where the installed package of public tokenizers keeps it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_rank_merging(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshlark.llm.token_counts import token_counts

    return token_counts(documents(spark, sf_dir), vocabulary(), limit=1024)


def op5_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshlark.llm.packing import pack

    return pack(documents(spark, sf_dir), vocabulary(), capacity=2048, end_id=1)


def op1_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshlark.llm.imatch import edited_fingerprints

    return edited_fingerprints(documents(spark, sf_dir))


def op6_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshlark.llm.mixing import mix

    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op7_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshlark.llm.ring import shard

    law, grown = F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return shard(documents(spark, sf_dir), shards=16).select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)


def op9_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshlark.llm.simhash_trie import classes

    return classes(documents(spark, sf_dir), words=3, budget=3)


def op10_nearest_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshlark.llm.toxicity import toxicity

    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_imatch": op1_imatch,
    "op2_run_index": op2_run_index,
    "op3_line_chunks": op3_line_chunks,
    "op4_rank_merging": op4_rank_merging,
    "op5_differencing": op5_differencing,
    "op6_entropy_balancing": op6_entropy_balancing,
    "op7_bounded_ring": op7_bounded_ring,
    "op8_rule_ledger": op8_rule_ledger,
    "op9_simhash_trie": op9_simhash_trie,
    "op10_nearest_examples": op10_nearest_examples,
}
_WORD = r"[^\x20\x09-\x0D]+"
#: SQL can express the ledger of rules; the other queries need hash functions, iterations or merges that it lacks, or are
#: too slow in it over whole tables, and are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op8_rule_ledger": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents),
windows AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 1))) AS i FROM d)),
twice AS (SELECT doc_id, w FROM windows GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM windows JOIN twice USING (doc_id, w)) GROUP BY 1),
m AS (SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines,
  CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, len(list_filter(words, lambda x: upper(x) = x AND lower(x) <> x)) AS n_upper, len(list_distinct(words)) AS n_distinct
  FROM d LEFT JOIN covered USING (doc_id)),
r AS (SELECT *, len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines FROM m),
f AS (SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (100 * n_symbols > 30 * n_words)::INT + 8 * (n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines)::INT
  + 16 * (100 * n_upper > 60 * n_words)::INT + 32 * (word_chars < 2 * n_words)::INT + 64 * (word_chars > 20 * n_words)::INT + 128 * (n_words >= 50 AND 100 * n_distinct < 10 * least(n_words, 1000))::INT AS BIGINT) AS failed_rules FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_rules & 3 <> 0 AS base_failed, failed_rules = 0 AS kept, failed_rules FROM f""",
}
