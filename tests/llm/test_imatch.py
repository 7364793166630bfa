import hashlib
import math
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F
from shared import empty, odd_rows

from meshlark.llm import imatch as M


def test_edits_and_fingerprints(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    out = M.edited_fingerprints(docs)
    got = {r["doc_id"]: r for r in out.collect()}
    prints, better = {}, 0
    for k, (i, t) in enumerate(rows):
        after, q = rows[(k + 1) % len(rows)][1], len(t) // 4
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - q] + after[:q]).encode()).hexdigest()
        assert prints.setdefault(t, got[i]["fingerprint"]) == got[i]["fingerprint"]
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
        better += got[i]["near_edited"] > got[i]["near_next"]
    assert better > 0.9 * len(rows)
    assert "Python" not in out._jdf.queryExecution().toString()


def test_codes_are_hashes_of_sorted_terms_in_the_band(spark):
    docs = spark.createDataFrame([(i, f"common word{i % 4} only{i}") for i in range(40)], "doc_id bigint, text string")
    bits = M.lexicon(docs, (0.1, 0.5))  # of these words, only word0 to word3 lie in the band
    codes = {r["doc_id"]: r["codes"] for r in M.with_codes(docs, "text", "codes", bits).collect()}
    assert codes[0] == codes[4] != codes[1] and len(codes[0]) == 1 + sum(n for _, n in M.LEVELS)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain(rows, band=M.BAND):
    """Band, codes and likeness again, in plain Python, for rows (doc_id, text) in order."""
    terms = lambda t: {signed(xxhash.xxh64_intdigest(w, 42)) for w in re.split(r"[\x20\x09-\x0D]+", t.lower()) if w}
    seen = Counter(h for _, t in rows for h in terms(t))
    inside = {h for h, n in seen.items() if band[0] * len(rows) <= n <= band[1] * len(rows)}
    width = max(M.LEAST_BITS, math.ceil(math.log2(len(inside) + 1)) + M.SPARE)
    marked = {h & (1 << width) - 1 for h in inside}

    def code(some):
        h = 42
        for t in sorted(some):
            h = xxhash.xxh64_intdigest((t & (1 << 64) - 1).to_bytes(8, "little"), h)
        return max(1, h & 0xFFFF) if some else 0

    def codes(text):
        every = terms(text)
        kept = {h for h in every if h & (1 << width) - 1 in marked} or every
        out = [code(kept)]
        for k, (lots, n) in enumerate(M.LEVELS):
            lot = lambda h: ((h & (1 << 64) - 1) >> (63 - 9 * (k + 1))) & (lots - 1)  # noqa: B023, E731
            out += [code({h for h in kept if lot(h) == j}) for j in range(n)]
        return out

    def like(a, b):
        starts = [1]
        for _, n in M.LEVELS:
            starts.append(starts[-1] + n)
        for start in [*reversed(starts[:-1]), 0]:
            part = [(x, y) for x, y in zip(a[start : starts[-1]], b[start : starts[-1]]) if x or y]
            if start == 0 or len(part) >= M.ENOUGH:
                return sum(x == y for x, y in part) / len(part) if part else 1.0

    out = {}
    for k, (i, t) in enumerate(rows):
        after, q = rows[(k + 1) % len(rows)][1], len(t) // 4
        own, edit = codes(t), codes(t[: len(t) - q] + after[:q])
        text = lambda c: "".join(f"{x:04x}" for x in c)
        out[i] = (text(own), text(edit), like(own, edit), like(own, codes(after)))
    return out


def result(out):
    return {r["doc_id"]: (r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) for r in out.collect()}


def test_fingerprints_and_likeness_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    want, got = plain(rows), result(M.edited_fingerprints(docs))
    assert got.keys() == want.keys()
    for i in want:
        assert got[i][:2] == want[i][:2] and got[i][2:] == pytest.approx(want[i][2:])


def test_ids_of_any_spread_and_type(spark):
    """One outlying id, ids in two far ranges, and strings: ranges stay small and every row finds the next."""
    for ids in ([*range(3000), 1 << 60], [*range(0, 9000, 3), *(10**15 + k * k for k in range(500))]):
        docs = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id bigint, text string")
        sizes = [r["count"] for r in M.with_next(docs).groupBy("place").count().collect()]
        assert max(sizes) < 1000 and sum(sizes) == len(ids) + len(sizes)
        named = docs.withColumn("doc_id", F.concat(F.lit("id"), F.lpad(F.col("doc_id").cast("string"), 20, "0")))
        of = lambda d: sorted((str(k).removeprefix("id").lstrip("0") or "0", v) for k, v in result(M.edited_fingerprints(d)).items())
        assert of(docs) == of(named)


def test_odd_rows(spark):
    got = M.edited_fingerprints(odd_rows(spark)).collect()
    assert len(got) == 8
    same = {r["fingerprint"] for r in got if r["doc_id"] in (4, 5)}
    assert len(same) == 1
    assert {r["n_chars"] for r in got if r["doc_id"] in (1, 2)} == {0}
    assert M.edited_fingerprints(empty(spark)).count() == 0
