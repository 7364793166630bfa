import random

import pytest
import xxhash
from pyspark.sql import functions as F

from meshlark.llm import simhash_trie as S

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fingerprint string"


def brute(fps: dict[int, int], budget: int) -> dict[int, int]:
    ids = sorted(fps)
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= budget and root(a) != root(b):
                up[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}


def test_fingerprint_of_hand_made_texts():
    assert S.majority(S.shingle_hashes("", 3)) == 0
    assert S.majority(S.shingle_hashes("One  TWO", 3)) == xxhash.xxh64_intdigest("one two", 42)
    assert len(S.shingle_hashes("a b c a b c a b c", 3)) == 7
    assert S.shingle_hashes("É a", 3)[0] == xxhash.xxh64_intdigest("É a", 42)


@pytest.mark.parametrize("rows", [50_000, 8])
def test_links_equal_brute_force(spark, monkeypatch, rows):
    """With 8 rows a node the distributed descent of node pairs takes part as well."""
    monkeypatch.setattr(S, "NODE_ROWS", rows)
    rng = random.Random(7)
    centres = [rng.getrandbits(64) for _ in range(6)]
    fps = {}
    for i in range(300):
        x = rng.choice(centres) if i % 3 else rng.getrandbits(64)
        for _ in range(rng.randrange(6)):
            x ^= 1 << rng.randrange(64)
        fps[i] = x
    fps = {min(i for i in fps if fps[i] == x): x for x in fps.values()}
    leaves = spark.createDataFrame([(i, None, S._signed(x)) for i, x in fps.items()], "id bigint, signature array<bigint>, x bigint")
    prints = leaves.select(F.col("id").alias("doc_id"), F.col("x").alias("fingerprint"))
    monkeypatch.setattr(S, "fingerprints", lambda docs, words: prints)
    got = {r["doc_id"]: r["component_id"] for r in S.classes(prints).collect()}
    assert got == brute(fps, 3)


def test_odd_rows(spark):
    long = "word " * 30_000
    rows = [(1, None, None, None, None, "x"), (2, "", "en", "a", 0, "x"), (3, long, "en", "a", 1, "x"), (3, long, "en", "a", 1, "x"), (4, "Some words here", None, None, 1, None), (5, " SOME\twords  here\n", "en", None, 1, None)]
    got = {(r["doc_id"], r["component_id"]) for r in S.classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 4)}
    assert S.classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_equals_brute_force_over_a_whole_table(spark, monkeypatch):
    """Fingerprints by XXH64 and majority in plain Python, components by all pairs; equal texts dealt over several tasks."""
    from meshlark.llm.queries import QUERIES

    monkeypatch.setattr("meshlark.llm.common.LEAST_HOT", 2)
    sf, fps = "/root/testdata/sf0.001", {}
    lower = {c: c + 32 for c in range(65, 91)}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        w = [x for x in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in (r["text"] or "").translate(lower)).split(" ") if x]
        shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        fps[r["doc_id"]] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    want = brute(fps, 3)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op9_simhash_trie"](spark, sf).collect()}
    assert got == {i: (f"{x:016x}", want[i]) for i, x in fps.items()}
