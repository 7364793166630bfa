"""Token counts of whole texts by rank-synchronous array merging (see byte_bpe).

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows are counted each; a text of any length is
read whole. Strings of special tokens inside a text count as the one token the library makes of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from meshlark.llm import byte_bpe

#: Texts and bytes that wait together for merging.
TOGETHER, BYTES = 512, 4_000_000


def slices(texts: list[str]) -> Iterator[list[str]]:
    start = size = 0
    for k, t in enumerate(texts):
        if k > start and (k - start >= TOGETHER or size + len(t) > BYTES):
            yield texts[start:k]
            start, size = k, 0
        size += len(t)
    if start < len(texts):
        yield texts[start:]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than `limit` tokens). One pass, no shuffle.

    vocabulary: path of a byte-level .json file of the tokenizers library, the same on every executor.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            sizes = [len(t.encode()) for t in texts]
            tokens = [n for some in slices(texts) for n in byte_bpe.count_tokens(vocabulary, some)]
            over = pa.array([n > limit for n in tokens], pa.bool_())
            yield pa.record_batch([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), over], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(counted, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
