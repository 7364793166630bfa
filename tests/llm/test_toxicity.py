import math
import zlib
from collections import Counter

import numpy as np
import pytest
from shared import empty, odd_rows

from meshlark.llm import toxicity as T


def read(spark, name, sf="sf0.1"):
    return spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet")


def plain_scores(docs, labels):
    """The definition again, in plain Python: dense dot products over all terms, no blocks, no batches."""
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    text_of = dict(docs)
    rows = sorted((i, y) for i, y in labels if not held(i) and i in text_of)
    words = {i: Counter(w for w in T._TERM.findall((text_of[i] or "").lower())) for i in text_of}
    seen = Counter(w for c in words.values() for w in c)
    n, n_toxic = len(rows), sum(y for _, y in rows)
    have, toxic = Counter(w for i, _ in rows for w in words[i]), Counter(w for i, y in rows if y for w in words[i])
    strength = {}
    for w, d in have.items():
        sd = math.sqrt(max(d * (n - d), 1) / n * (n_toxic / n) * (1 - n_toxic / n)) + 1e-9
        z = max(abs(toxic[w] - d * n_toxic / n) - 1, 0) / sd
        strength[w] = (1 + math.log((1 + len(docs)) / (1 + seen[w]))) * (0.01 + 0.99 * z**4 / (z**4 + 81))

    def unit(counts):
        v = {w: (1 + math.log(c)) * strength[w] for w, c in counts.items() if w in strength}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    vectors = {i: unit(words[i]) for i, _ in rows}
    rate = n_toxic / n

    def share(v, without=None):
        near = sorted(((sum(x * u.get(w, 0.0) for w, x in v.items()), i, y) for i, y in rows if i != without for u in [vectors[i]]), key=lambda r: -r[0])
        near = [r for r in near if r[0] > 1e-12]
        last = near[14][0] if len(near) >= 15 else 0.0
        sure, tied = [r for r in near if r[0] > last + 1e-9], [r for r in near if abs(r[0] - last) <= 1e-9]
        part = (15 - len(sure)) / len(tied) if len(sure) + len(tied) > 15 else 1.0
        votes = [(1 / (max(0.0, 1 - s) + 0.05) * (1.0 if s > last + 1e-9 else part), y) for s, _, y in sure + (tied if last else [])]
        return (sum(v for v, y in votes if y) + rate) / (sum(v for v, _ in votes) + 1)

    logit = lambda p: np.log((p + 0.01) / (1.01 - p))
    a, b = T.logistic_fit(logit(np.array([share(vectors[i], i) for i, _ in rows])), np.array([float(y) for _, y in rows]))
    out = {}
    for i in text_of:
        v = unit(words[i])
        out[i] = 1 / (1 + math.exp(-(a + b * logit(share(v))))) if v else rate
    return out


def test_scores_equal_brute_force(spark):
    docs, labels = read(spark, "documents", "sf0.001"), read(spark, "labels", "sf0.001")
    want = plain_scores([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in labels.select("doc_id", "toxic").collect()])
    got = {r["doc_id"]: r["score"] for r in T.toxicity(docs, labels).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[i] - want[i]) for i in want) < 1e-6


def test_index_is_exact_for_random_vectors():
    rng = np.random.default_rng(3)
    terms = [np.sort(rng.choice(2000, rng.integers(0, 60), replace=False)) for _ in range(700)]
    rows = [(k, int(rng.integers(2)), t, rng.integers(1, 9, len(t))) for k, t in enumerate(terms)]
    index = T.BlockMaxIndex(rows, rng.random(2000) + 0.01)
    dense = np.zeros((700, 2000))
    for place, k in enumerate(index.ids):
        dense[place, rows[k][2]] = index.vector(rows[k][2], rows[k][3])
    queries = [(t, n) for _, _, t, n in rows[:90]]
    for (names, counts), (found, cosine) in zip(queries, index.nearest(queries, 15)):
        q = np.zeros(2000)
        q[names] = index.vector(names, counts)
        exact = dense @ q
        best = np.sort(exact[exact > 1e-12])[::-1][:15]
        assert np.allclose(cosine[: len(best)], best) and np.allclose(exact[found], cosine)
        assert len(found) == (exact >= best[-1] - 1e-9).sum() if len(best) == 15 else len(found) == len(best)


def test_held_out_rows_are_found_and_scores_are_probabilities(spark):
    labels = read(spark, "labels")
    rows = T.toxicity(read(spark, "documents"), labels).join(labels.select("doc_id", "toxic"), "doc_id").filter("held_out").collect()
    score, y = np.array([r["score"] for r in rows]), np.array([r["toxic"] for r in rows])
    assert (score[y == 1] >= 0.5).mean() > 0.88 and (score[y == 0] >= 0.5).mean() < 0.01
    assert ((score - y) ** 2).mean() < 0.015  # Brier score; the rate alone has 0.104
    for low, high in ((0.0, 0.1), (0.1, 0.6), (0.6, 1.01)):  # reliability
        some = (score >= low) & (score < high)
        assert abs(score[some].mean() - y[some].mean()) < 2.5 / math.sqrt(some.sum()) * 0.5


def test_labels_of_held_out_rows_are_never_read(spark):
    from pyspark.sql import functions as F

    docs, labels = read(spark, "documents", "sf0.01"), read(spark, "labels", "sf0.01")
    turned = labels.withColumn("toxic", F.when(T.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    of = lambda some: {r["doc_id"]: r["score"] for r in T.toxicity(docs, some).collect()}
    assert of(labels) == of(turned)


def test_the_sample_is_bounded_and_texts_without_neighbour_are_rare(spark):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    assert len(T.examples(docs, labels, 300)) == 300
    rows = T.toxicity(docs, labels).join(docs.filter("length(text) > 0").select("doc_id"), "doc_id").collect()
    assert sum(not r["evidence"] for r in rows) < 0.01 * len(rows)


@pytest.mark.parametrize("labelled", [False, True])
def test_odd_rows(spark, labelled):
    labels = spark.createDataFrame([(1, 0), (2, 0), (4, 1), (6, 0), (None, 1), (3, None), (3, 0)] if labelled else [], "doc_id long, toxic int")
    rows = T.toxicity(odd_rows(spark), labels).collect()
    assert len(rows) == 8 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    bare = [r["score"] for r in rows if r["doc_id"] in (1, 2)]
    assert bare[0] == bare[1] and (labelled or bare[0] == 0)
    same = [r["score"] for r in rows if r["doc_id"] in (4, 5)]
    assert len(same) == 3 and len(set(same)) == 1
    assert T.toxicity(empty(spark), labels).count() == 0


def test_tied_examples_share_the_votes():
    """A vector of 200 toxic rows and one mislabelled one, at the last place all of them, votes nearly all toxic."""
    rows = [(k, int(k > 0), np.array([0]), np.array([1])) for k in range(201)]
    share, near = T.BlockMaxIndex(rows, np.ones(1)).shares([(np.array([0]), np.array([1]))], 0.1)[0]
    assert share > 0.97 and len(near) == 3
