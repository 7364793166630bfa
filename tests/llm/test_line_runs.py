import random

from meshlark.llm import line_runs as R

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, lines string, key string"


def brute(docs):
    seen, out = set(), {}
    for i, text in sorted(docs.items()):
        lines, lost = text.split("\n"), set()
        for s in range(len(lines) - 1):
            two = lines[s], lines[s + 1]
            if " ".join(two).split():
                if two in seen:
                    lost |= {s, s + 1}
                seen.add(two)
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in lost)
    return out


def table(spark, docs):
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", "y") for i, t in docs.items()], SCHEMA)


def test_short_passages_go_whole_whatever_stands_around_them(spark):
    """Passages of 2 to 6 lines in unlike surroundings; content-defined chunks leave most of them."""
    docs = {}
    for n in range(2, 7):
        passage = [f"passage {n} line {k}" for k in range(n)]
        for copy in range(2):
            around = [[f"text {n} {copy} {side} {k}" for k in range(5)] for side in "ab"]
            docs[10 * n + copy] = "\n".join(around[0] + passage + around[1])
    got = {r["doc_id"]: r["text"] for r in R.dedup_lines(table(spark, docs)).collect()}
    for n in range(2, 7):
        assert got[10 * n] == docs[10 * n]
        assert got[10 * n + 1] == "\n".join(x for x in docs[10 * n + 1].split("\n") if not x.startswith("passage"))


def test_equals_brute_force(spark):
    rng = random.Random(6)
    pool = [" ".join(rng.choices("abcdefgh", k=6)) for _ in range(300)]
    docs = {}
    for i in range(80):
        lines = rng.choices(pool, k=rng.randrange(40))
        if i % 3 == 0:
            lines[len(lines) // 2 : len(lines) // 2] = pool[rng.randrange(5) : 30]
        if i % 7 == 0:
            lines += ["", "", "same", "same", "same", "", "\t", ""]
        docs[i] = "\n".join(lines)
    docs[81] = docs[80] = docs[3]
    got = {r["doc_id"]: r["text"] for r in R.dedup_lines(table(spark, docs)).collect()}
    assert got == brute(docs)
    assert {x for t in docs.values() for x in t.split("\n")} == {x for t in got.values() for x in t.split("\n")} | {""}


def test_odd_rows(spark):
    long = "\n".join(f"line {k % 5000}" for k in range(40_000))
    rows = [(1, None), (2, ""), (3, "\n\n\n"), (4, long), (5, "a\nb"), (5, "a\nb"), (None, "a\nb")]
    made = spark.createDataFrame([(i, t, "en", "s", 1, "c", "k") for i, t in rows], SCHEMA)
    out = R.dedup_lines(made)
    assert out.columns == made.columns
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert len(got) == 7 and (1, None) in got and (2, "") in got and (3, "\n\n\n") in got and (None, "a\nb") in got
    assert dict(got)[4] == "\n".join(f"line {k}" for k in range(5000))
    assert got.count((5, "")) == 2
    assert R.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_equals_brute_force_over_a_whole_table(spark):
    """The registered query, all its columns."""
    import hashlib

    from meshlark.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    kept = brute(texts)
    got = {r["doc_id"]: r for r in QUERIES["op3_line_chunks"](spark, sf).collect()}
    assert got.keys() == texts.keys() and any(kept[i] != texts[i] for i in texts)
    for i, r in got.items():
        lines = texts[i].split("\n")
        assert (r["kept_bytes"], r["kept_sha256"]) == (len(kept[i].encode()), hashlib.sha256(kept[i].encode()).hexdigest())
        left = kept[i].split("\n") if kept[i] or len(lines) == 1 else []
        assert r["n_lines"] == (len(lines) if texts[i] else r["n_lines"]) and r["n_removed"] == len(lines) - len(left) or not kept[i]


def test_a_window_in_a_third_of_all_rows(spark, monkeypatch):
    """Its places, and the copies of its run, are dealt over several tasks; the result is the same, without Python."""
    monkeypatch.setattr("meshlark.llm.common.LEAST_HOT", 20)
    rng = random.Random(3)
    passage = [f"common line {k}" for k in range(4)]
    docs = {}
    for i in range(240):
        lines = [f"own {i} {rng.random()}" for _ in range(6)]
        if i % 3 == 0:
            lines[rng.randrange(5) : 0] = passage
        docs[i] = "\n".join(lines)
    out = R.dedup_lines(table(spark, docs))
    assert {r["doc_id"]: r["text"] for r in out.collect()} == brute(docs)
    assert "Python" not in out._jdf.queryExecution().toString()
