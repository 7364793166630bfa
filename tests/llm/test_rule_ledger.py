import re
from collections import Counter

from pyspark.sql import functions as F
from shared import empty, odd_rows

from meshlark.llm import rule_ledger as R


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    times = Counter(windows)
    hit = {j for k, w in enumerate(windows) if times[w] > 1 for j in (k, k + 1, k + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:k] for k, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_measures_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in R.ledger(docs).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(texts[r["doc_id"]])


def test_odd_rows(spark):
    got = R.ledger(odd_rows(spark)).collect()
    assert len(got) == 8 and {r["n_words"] for r in got if r["doc_id"] in (1, 2)} == {0}
    assert R.ledger(empty(spark)).count() == 0
    kept = R.keep_clean(odd_rows(spark))
    assert kept.columns == odd_rows(spark).columns and kept.count() == 0
    assert R.keep_clean(empty(spark)).count() == 0


def test_ablation_counts_bits(spark):
    book = R.ledger(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    failed = [r["failed"] & R.mask_of(R.POLICIES["prose-1"]) for r in book.collect()]
    for r in R.ablation(book, "prose-1").collect():
        bit = 1 << [x.name for x in R.RULES].index(r["rule"])
        assert r["n_failed"] == sum(bool(f & bit) for f in failed) and r["n_only"] == sum(f == bit for f in failed)
    assert book.filter(R.verdict("base-1")).count() >= book.filter(R.verdict("prose-1")).count()
    assert book.select(F.max("failed")).first()[0] < 1 << len(R.RULES)
