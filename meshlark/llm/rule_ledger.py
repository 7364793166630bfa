"""Quality rules: a bitmask ledger.

Every rule is evaluated once for each document. The ledger keeps the measurements and one failure bit a rule; a policy
is a named, versioned mask over those bits, so trying another policy, or leaving one rule out, reads the ledger and
never the texts. All counts cover whole texts.

Defined results: a null or empty text has no words, fails `few_words` and no ratio rule; texts of any length are read whole;
a value that equals a rule's limit passes; repeated rows each get a row of their own; further columns may have any name; an
empty table gives an empty ledger.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper_words", "n_distinct_words")


@dataclass(frozen=True)
class Rule:
    """A document fails where `fails` holds; its bit in the ledger is the place of the rule in RULES."""

    name: str
    fails: str


#: Bits are given by place and never reused; a new rule goes to the end.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "100 * n_symbols > 30 * n_words"),
    Rule("duplicate_lines", "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines"),
    Rule("shouting", "100 * n_upper_words > 60 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("few_distinct_words", "n_words >= 50 AND 100 * n_distinct_words < 10 * least(n_words, 1000)"),
)
#: Policies by version: the names of the rules that reject.
POLICIES = {
    "base-1": ("few_words", "repeated_windows"),
    "prose-1": tuple(r.name for r in RULES),
    # a short document isn't a bad one: what a corpus keeps is judged by the other rules alone
    "corpus-1": tuple(r.name for r in RULES if r.name != "few_words"),
}


def mask_of(names: tuple[str, ...]) -> int:
    places = {r.name: k for k, r in enumerate(RULES)}
    return sum(1 << places[n] for n in names)


def measure(text: str) -> tuple[int, ...]:
    """The values of MEASURES for one text."""
    words = _WORDS.findall(text)
    n = len(words)
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        times, hit = Counter(windows), bytearray(n)
        for k, w in enumerate(windows):
            if times[w] > 1:
                hit[k : k + 3] = b"\1\1\1"
        repeated = sum(hit)
    lines = [x for x in text.split("\n") if _WORDS.search(x)]
    return (
        n,
        sum(map(len, words)),
        sum(map(text.count, _SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated,
        sum(map(str.isupper, words)),
        len(set(words)),
    )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measure(t or "") for t in batch.column("text").to_pylist()]
        columns = list(zip(*rows)) or [()] * len(MEASURES)
        yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", *MEASURES])


def failure_bits() -> Column:
    bits = [F.when(F.expr(r.fails), F.lit(1 << k)).otherwise(F.lit(0)) for k, r in enumerate(RULES)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return total.cast("long")


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and `failed`: the bits of the rules that the document fails. One pass, no shuffle."""
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, " + ", ".join(f"{m} bigint" for m in MEASURES)
    return docs.select("doc_id", "text").mapInArrow(_measured, schema).withColumn("failed", failure_bits())


def verdict(policy: str) -> Column:
    """True where a document of the ledger passes the policy."""
    return F.col("failed").bitwiseAND(F.lit(mask_of(POLICIES[policy]))) == 0


def ablation(book: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: how many documents fail it, and how many it alone rejects. One aggregate over bits."""
    mask = mask_of(POLICIES[policy])
    hit = F.col("failed").bitwiseAND(F.lit(mask))
    counts = book.groupBy(hit.alias("hit")).agg(F.count(F.lit(1)).alias("n"))
    places = [k for k, r in enumerate(RULES) if mask >> k & 1]
    rules = F.explode(F.array(*(F.struct(F.lit(k).alias("bit"), F.lit(RULES[k].name).alias("rule")) for k in places)))
    each = counts.select("hit", "n", rules.alias("r"))
    bit = F.expr("(shiftright(hit, r.bit) & 1) = 1")
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(bit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.expr("hit = shiftleft(1L, r.bit)"), F.col("n")).otherwise(0)).alias("n_only"),
    )


def judged(docs: DataFrame) -> DataFrame:
    """The ledger beside the rows that it judges: `row` (a struct of all columns of `docs`), the measurements, `failed`."""
    names, kinds = docs.columns, [f.dataType.simpleString() for f in docs.schema]
    place = names.index("text")

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t or "") for t in batch.column(place).to_pylist()]
            arrays = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * len(MEASURES)
            yield pa.record_batch([pa.StructArray.from_arrays(batch.columns, names), *arrays], ["row", *MEASURES])

    fields = ",".join(f"`{n}`:{k}" for n, k in zip(names, kinds))
    return docs.mapInArrow(passed, f"row struct<{fields}>, " + ", ".join(f"{m} bigint" for m in MEASURES)).withColumn("failed", failure_bits())


def keep_clean(docs: DataFrame, policy: str = "prose-1") -> DataFrame:
    """The rows of `docs`, all columns, whose bits in the ledger pass a policy: one mask, no rule is read again."""
    return judged(docs).filter(verdict(policy)).select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
