import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from shared import empty, odd_rows

from meshlark.llm import near_groups as N

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, row string, group string"


def shingles(text):
    w = [x.lower() for x in text.split()]
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "k", "r", "g") for i, t in rows], SCHEMA)


def edited(rng, base, similarity):
    """A copy a little above that similarity: single words replaced, each of which changes five shingles."""
    words = list(base)
    for _ in range(200):
        trial = list(words)
        trial[rng.randrange(len(trial))] = f"e{rng.random()}"
        if jaccard(" ".join(trial), " ".join(base)) < similarity:
            break
        words = trial
    return words


@pytest.mark.parametrize(("similarity", "low", "high"), [(0.72, 0.0, 0.0), (0.80, 0.95, 1.0), (0.85, 0.97, 1.0)])
def test_recall_and_precision(spark, similarity, low, high):
    """Pairs a little above each similarity: none below 0.8 is linked, at least 0.95 of those at 0.8 are."""
    rng = random.Random(int(100 * similarity))
    rows, near = [], 0
    for i in range(0, 400, 2):
        base = [f"w{rng.randrange(3000)}" for _ in range(300)]
        rows += [(i, " ".join(base)), (i + 1, " ".join(edited(rng, base, similarity)))]
    found = {r["key"]["doc_id"]: r["group"] for r in N.near_groups(table(spark, rows)).collect()}
    text = dict(rows)
    for i in range(0, 400, 2):
        near += found[i] == found[i + 1]
        if found[i] == found[i + 1]:
            assert jaccard(text[i], text[i + 1]) >= 0.8
    assert low <= near / 200 <= high and len(set(found.values())) == 400 - near


def test_groups_equal_brute_force_over_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids, links = sorted(sets), 0
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y):
                links += 1
                up[max(root(a), root(b))] = min(root(a), root(b))
    want = {i: root(i) for i in ids}
    got = {r["key"]["doc_id"]: r["group"] for r in N.near_groups(docs).collect()}
    split = sum(got[i] != got[want[i]] for i in ids)  # a member apart from the least of its group
    assert links > 20 and split <= 0.02 * sum(want[i] != i for i in ids) + 1
    by_group = {}
    for i in ids:
        by_group.setdefault(got[i], set()).add(want[i])
    assert all(len(g) == 1 for g in by_group.values())  # nothing is linked that shouldn't be
    kept = [r["doc_id"] for r in N.keep_one(docs).collect()]
    assert len(kept) == len(set(got.values())) and set(ids) - set(kept) <= {i for i in ids if len([j for j in ids if got[j] == got[i]]) > 1}


def test_rows_go_by_text_and_not_by_doc_id(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    got = sorted(((r["doc_id"], r["text"]) for r in N.keep_one(table(spark, [(1, a), (2, a), (2, b), (1, a), (None, b), (None, "z " * 9)])).collect()), key=str)
    assert got == sorted([(1, a), (2, b), (None, "z " * 9)], key=str)


def test_any_type_of_doc_id_and_clashing_columns(spark):
    docs = table(spark, [(k, f"text {k // 2} of some more words than five") for k in range(8)])
    named = docs.withColumn("doc_id", F.concat(F.lit("id"), "doc_id"))
    kept = N.keep_one(named)
    assert kept.columns == named.columns and sorted(r["doc_id"] for r in kept.collect()) == ["id0", "id2", "id4", "id6"]


def test_odd_rows(spark):
    kept = N.keep_one(odd_rows(spark))
    assert kept.columns == odd_rows(spark).columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 1, 3, 4, 6]  # 1 is null, 2 is empty; 4 twice and 5 are alike
    assert N.keep_one(empty(spark)).count() == 0


def test_crowds_are_linked_without_all_pairs(monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 8).astype(np.uint64)
    sigs = np.repeat(base[None], 3000, 0)
    for row in sigs[:2990]:
        for _ in range(25):
            row[rng.integers(8)] ^= np.uint64(1 << int(rng.integers(64)))
    sigs[2990:] = rng.integers(0, 1 << 62, (10, 8)).astype(np.uint64)
    calls, forest, real = [], N.BestForest(3000), N.estimate
    monkeypatch.setattr(N, "estimate", lambda *a: calls.append(len(a[2])) or real(*a))
    N.crowd_links(sigs, np.full(3000, 300), np.arange(3000), 0.7, forest.add)
    i, j, _ = forest.links()
    assert len(i) == 2989 and not (np.r_[i, j] >= 2990).any() and sum(calls) < 100 * 3000


def test_best_forest_equals_kruskal():
    rng = np.random.default_rng(5)
    i, j, w = rng.integers(0, 60, 400), rng.integers(0, 60, 400), rng.random(400).round(2)
    i, j, w = i[i != j], j[i != j], w[i != j]
    forest = N.BestForest(60)
    for part in np.array_split(np.arange(len(i)), 5):
        forest.add(i[part], j[part], w[part])
    up, total = list(range(60)), 0.0

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k in np.argsort(-w, kind="stable"):
        a, b = root(i[k]), root(j[k])
        if a != b:
            up[a], total = b, total + w[k]
    assert abs(forest.links()[2].sum() - total) < 1e-9


def test_hot_nodes_are_split(spark, monkeypatch):
    """A third of all texts in one group, and nodes of 50 rows at most: the group is still found whole."""
    monkeypatch.setattr(N, "NODE_ROWS", 50)
    rng = random.Random(2)
    base = [f"b{k}" for k in range(300)]
    rows = [(k, " ".join(f"o{rng.randrange(4000)}" for _ in range(100))) for k in range(800)]
    for k in range(400):
        copy = list(base)
        for _ in range(2):
            copy[rng.randrange(300)] = f"x{rng.random()}"
        rows.append((1000 + k, " ".join(copy)))
    kept = N.keep_one(table(spark, rows)).collect()
    assert sum(r["doc_id"] < 1000 for r in kept) == 800 and sum(r["doc_id"] >= 1000 for r in kept) <= 4


def family(rng, n):
    """Texts about as alike as the threshold, so that exact similarity refutes many of the links that estimates propose."""
    base = [f"b{k}" for k in range(300)]
    rows = []
    for k in range(n):
        copy = list(base)
        for at in rng.sample(range(300), rng.randrange(1, 13)):
            copy[at] = f"x{k}y{at}"
        rows.append((k, " ".join(copy)))
    return rows


def partition(of):
    by_group = {}
    for i, g in of.items():
        by_group.setdefault(g, set()).add(i)
    return sorted(map(sorted, by_group.values()))


def exact(rows):
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in rows:
        for j, b in rows:
            if i < j and jaccard(a, b) >= 0.8:
                up[root(i)] = root(j)
    return partition({i: root(i) for i, _ in rows})


def test_what_is_found_depends_on_no_number_of_texts():
    assert N.plan(0.8) == (23, N.SHOWN) and N.plan(0.5)[0] > N.plan(0.9)[0]


@pytest.mark.parametrize(("node_rows", "block"), [(500_000, 2_000_000), (20, 2_000), (7, 20_000)])
def test_groups_are_the_components_of_exact_similarity(spark, monkeypatch, node_rows, block):
    """Whatever nodes and blocks texts are dealt in; a refuted link of a forest hides none."""
    monkeypatch.setattr(N, "NODE_ROWS", node_rows)
    monkeypatch.setattr(N, "BLOCK_SHINGLES", block, raising=False)
    rows = family(random.Random(11), 120)
    want = exact(rows)
    got = partition({r["key"]["doc_id"]: r["group"] for r in N.near_groups(table(spark, rows)).collect()})
    assert got == want and 60 < len(want) < 100


def test_links_that_refuted_ones_hid_are_found():
    """Five members are linked, the others aren't: what is alike among all of them is connected, without all pairs."""
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 40, 30).astype(np.int32)) for _ in range(60)]
    like = lambda a, b: len(np.intersect1d(a, b)) >= 0.48 * len(np.union1d(a, b))
    ids, labels = np.arange(100, 160), np.r_[[100] * 5, np.arange(105, 160)]
    links = N.exact_links(ids, labels, 100, sets, labels != 100, 0.48)
    assert all(like(sets[i - 100], sets[j - 100]) for i, j in links)
    near = [(i, j) for i in range(60) for j in range(i) if like(sets[i], sets[j])]

    def groups(pairs):
        comp = np.arange(60)
        for i, j in [(0, k) for k in range(1, 5)] + pairs:
            comp[comp == comp[i]] = comp[j]
        return partition(dict(enumerate(comp.tolist())))

    assert groups(near) == groups([(i - 100, j - 100) for i, j in links]) and len(links) < len(near)
