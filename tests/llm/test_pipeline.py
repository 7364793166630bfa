import hashlib
import re
from collections import Counter

import pytest
from shared import empty, odd_rows

import corpus_pipeline as P
from meshlark.llm import rule_ledger
from test_line_runs import brute as brute_lines
from test_mixing_ring import brute_targets
from test_near_groups import shingles

SF = "/root/testdata/sf0.001"
NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """The rows after each stage, the input first."""
    docs = P.documents(spark, SF)
    out = [docs]
    for _, stage in P.STAGES[:-1]:
        docs = P.written(stage(spark, docs, SF))
        assert docs.columns == NAMES
        out.append(docs)
    return [[r.asDict() for r in d.collect()] for d in out], docs


def test_rules_equal_brute_force(stages):
    before, after = stages[0][:2]
    mask = rule_ledger.mask_of(rule_ledger.POLICIES["corpus-1"])

    def fails(text):
        v = dict(zip(rule_ledger.MEASURES, rule_ledger.measure(text or "")))
        n, lines = v["n_words"], v["n_lines"]
        bits = [n < 50, 100 * v["n_repeat_words"] > 50 * n, 100 * v["n_symbols"] > 30 * n, lines >= 4 and 100 * v["n_dup_lines"] > 50 * lines, 100 * v["n_upper_words"] > 60 * n, v["word_chars"] < 2 * n, v["word_chars"] > 20 * n, n >= 50 and 100 * v["n_distinct_words"] < 10 * min(n, 1000)]
        return sum(bit << k for k, bit in enumerate(bits)) & mask

    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before if not fails(r["text"])) and len(after) < len(before)


def test_lines_equal_brute_force(stages):
    before, after = stages[0][1:3]
    want = brute_lines({r["doc_id"]: r["text"] or "" for r in before})
    assert {r["doc_id"]: r["text"] or "" for r in after} == want
    assert all(r["n_chars"] == len(r["text"] or "") for r in after if want[r["doc_id"]] != next(b["text"] for b in before if b["doc_id"] == r["doc_id"]))


def test_near_copies_equal_brute_force(stages):
    """Every row that goes has a kept one in its group; all but one of each group of at most 2 % go; no other row goes."""
    before, after = stages[0][2:4]
    sets = {r["doc_id"]: shingles(r["text"] or "") for r in before}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if not x | y or len(x & y) >= 0.8 * len(x | y):
                up[max(root(a), root(b))] = min(root(a), root(b))
    groups = Counter(root(i) for i in ids)
    kept = Counter(root(r["doc_id"]) for r in after)
    assert kept.keys() == groups.keys()  # nothing but a copy goes
    assert sum(kept.values()) <= 1.02 * len(groups) and len(after) < len(before)


def test_mix_takes_effect(stages):
    before, after = stages[0][3:5]
    times = Counter(r["doc_id"] for r in after)
    texts = {r["doc_id"]: r["text"] for r in before}
    assert max(times.values()) <= 3 and times.keys() <= texts.keys() and all(r["text"] == texts[r["doc_id"]] for r in after)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = Counter(), Counter()
    for r in before:
        sizes[r["source"]] += words(r["text"])
        taken[r["source"]] += words(r["text"]) * times[r["doc_id"]]
    largest = {s: max(words(r["text"]) for r in before if r["source"] == s) for s in sizes}
    for s, t in brute_targets(sizes).items():  # a source has some ten documents here, one more or less of which is a step
        assert abs(taken[s] - t) <= max(0.01 * t, largest[s] / 2)


def test_windows_hold_every_id_once(spark, stages):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    rows, docs = stages
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = [r.asDict() for r in P.STAGES[-1][1](spark, docs, SF).collect()]
    total = Counter()
    for r in rows[4]:
        total[r["doc_id"]] += len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1
    held = Counter()
    for p in pieces:
        held[p["doc_id"]] += p["length"]
    assert held == total
    windows = {}
    for p in pieces:
        windows.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for spans in windows.values():
        spans.sort()
        assert [o for o, _ in spans] == np.cumsum([0, *(n for _, n in spans)])[:-1].tolist() and sum(n for _, n in spans) <= 2048


def test_run_equals_its_stages(spark, stages):
    got = Counter((r["doc_id"], r["start"], r["length"]) for r in P.run(spark, SF).collect())
    held = Counter()
    for (i, _, n), k in got.items():
        held[i] += n * k
    again = Counter()
    for p in P.STAGES[-1][1](spark, stages[1], SF).collect():
        again[p["doc_id"]] += p["length"]
    assert held == again


def test_stages_on_odd_rows(spark):
    docs = odd_rows(spark)
    plain = lambda rows: sorted(((r["doc_id"], hashlib.md5((r["text"] or "").encode()).hexdigest()[:6]) for r in rows), key=str)
    out = {}
    for name, stage in P.STAGES:
        found = stage(spark, docs, "")
        if name != P.STAGES[-1][0]:
            assert found.columns == docs.columns
        out[name] = found.collect()
        assert stage(spark, empty(spark), "").count() == 0
    assert sorted(str(r["doc_id"]) for r in out["quality_rules"]) == ["1", "2", "4", "4", "5", "None"]  # 3 repeats itself, 6 has symbols
    assert plain(out["line_dedup"])[:2] == plain(docs.collect())[:2] and len(out["line_dedup"]) == 8
    assert [r["text"] for r in out["line_dedup"] if r["doc_id"] == 5] == [""] and [r["text"] for r in out["line_dedup"] if r["doc_id"] == 1] == [None]
    assert sorted(str(r["doc_id"]) for r in out["simhash_near_dedup"]) == ["1", "3", "4", "6", "None"]
    times = Counter(str(r["doc_id"]) for r in out["mix_sources"])
    assert times["1"] == times["2"] == 1 and max(times.values()) <= 6  # 4 is two rows
    assert sum(p["length"] for p in out["pack_windows"] if p["doc_id"] in (1, 2)) == 2
