import random
from collections import Counter

import numpy as np
from shared import empty, odd_rows

from meshlark.llm import run_index as R


def brute(texts, length):
    times = Counter(t[k : k + length] for t in texts.values() for k in range(len(t) - length + 1))
    out = {}
    for i, t in texts.items():
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if times[t[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int(np.count_nonzero(np.diff(np.r_[0, gone.astype(np.int8)]) == 1))
        out[i] = len(t), int(gone.sum()), spans, bytes(np.frombuffer(t, np.uint8)[~gone])
    return out


def whole(rows):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["removed"]), bytes(r["kept"])) for r in rows.collect()}


def test_matching_statistics_equal_brute_force():
    rng = random.Random(2)
    for _ in range(40):
        base = bytes(rng.choice(b"ab\0c") for _ in range(150))
        texts = list(dict.fromkeys(base[i : i + rng.randrange(1, 90)] for i in (rng.randrange(100) for _ in range(6))))
        best, ends = R.matches(texts)
        for length in (1, 4, 15):
            times = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
            start = 0
            for t, end in zip(texts, ends):
                got = (best[start:end] >= length)[: max(0, len(t) - length + 1)].tolist()
                assert got == [times[t[k : k + length]] > 1 for k in range(len(t) - length + 1)]
                start = end + 1


def test_anchors_deal_every_window_once():
    rng = random.Random(5)
    for n in (399, 400, 401, 5000):
        data = np.frombuffer(bytes(rng.choice(b"abcd") for _ in range(n)), np.uint8)
        _, first, last = R.anchors(data)
        assert sum(last - first + 1) == max(0, n - 399)


def passages(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    shared = " ".join(word() for _ in range(90))
    texts = {}
    for i in range(40):
        own = " ".join(word() for _ in range(rng.randrange(20, 300)))
        texts[i] = own[:100] + (shared[i % 7 * 20 :] if i % 3 == 0 else "") + own[100:]
    texts[40] = texts[1]
    texts[41] = texts[2][:700] + "X" + texts[2][701:]
    texts[42] = "ab" * 1500
    texts[43] = "é" * 500 + "same line\n" * 100
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "h", "r", "s", "b", 0.1, "k") for i, t in texts.items()], odd_rows(spark).schema)
    return docs, {i: t.encode() for i, t in texts.items()}


def test_removal_equals_brute_force(spark):
    docs, texts = passages(spark)
    assert whole(R.remove_repeats(docs)) == brute(texts, R.LENGTH)


def test_query_equals_brute_force_over_a_whole_table(spark):
    """The registered query, all its columns, over a whole table."""
    import hashlib

    from meshlark.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {i: (n, gone, spans, hashlib.sha256(kept).hexdigest()) for i, (n, gone, spans, kept) in brute(texts, 400).items()}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in QUERIES["op2_run_index"](spark, sf).collect()}
    assert got == want and any(gone for _, gone, _, _ in want.values())


def test_large_anchors_are_counted_by_window(spark, monkeypatch):
    """All anchors beyond the bound, and the bound between the anchors: the result is the same."""
    docs, texts = passages(spark)
    want = brute(texts, R.LENGTH)
    for most in (1, 2500):
        monkeypatch.setattr(R, "ANCHOR_BYTES", most)
        assert whole(R.remove_repeats(docs)) == want


def test_hot_segments_and_anchors_are_met_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr("meshlark.llm.common.LEAST_HOT", 3)
    docs, texts = passages(spark)
    many = {**texts, **{100 + k: texts[3] for k in range(30)}}
    rows = docs.unionByName(docs.filter("doc_id = 3").selectExpr("explode(sequence(100, 129)) AS d", "*").drop("doc_id").selectExpr("CAST(d AS bigint) AS doc_id", "* EXCEPT (d)"))
    assert whole(R.remove_repeats(rows)) == brute(many, R.LENGTH)


def test_memory_of_an_index_is_bounded():
    import tracemalloc

    rng = random.Random(1)
    base = bytes(rng.randrange(97, 105) for _ in range(600))
    texts = []
    for _ in range(1600):
        t = bytearray(base)
        for _ in range(3):
            t[rng.randrange(600)] = rng.randrange(97, 123)
        texts.append(bytes(t))
    tracemalloc.start()
    R.matches(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < R.SUFFIX_BYTES * sum(map(len, texts)) and R.SUFFIX_BYTES * (R.INDEX_BYTES + R.ANCHOR_BYTES) < 500e6


def test_odd_rows(spark):
    got = R.remove_repeats(odd_rows(spark)).collect()
    assert len(got) == 8 and all(r["n_removed"] == 0 for r in got if r["doc_id"] != 3)
    assert next(r for r in got if r["doc_id"] == 3)["n_removed"] == next(r for r in got if r["doc_id"] == 3)["n_bytes"]
    assert R.remove_repeats(empty(spark)).count() == 0
