import random
from collections import defaultdict

import xxhash
from meshlark.llm import line_chunks as L

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, chunks string, key string"


def spark_hash(values, seed=42):
    """xxhash64 of a row of strings or longs."""
    for v in values:
        data = v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def brute_chunks(text):
    lines = text.split("\n")
    h = [spark_hash([x]) for x in lines]
    mark = [i >= L.WINDOW - 1 and spark_hash([h[i - k] for k in range(L.WINDOW)]) % L.SPACING == 0 for i in range(len(lines))]
    out, start = [], 0
    for i in range(len(lines)):
        if i == len(lines) - 1 or mark[i] and not mark[i - 1]:
            out.append((len(out), lines[start : i + 1]))
            start = i + 1
    return out


def brute(docs):
    seen, out = defaultdict(list), {}
    for i, text in sorted(docs.items()):
        for start, lines in brute_chunks(text):
            if len(lines) > 1 and " ".join(lines).split():
                seen["\n".join(lines)].append((i, start))
    for i, text in docs.items():
        out[i] = "\n".join("\n".join(x) for s, x in brute_chunks(text) if not (len(x) > 1 and " ".join(x).split() and min(seen["\n".join(x)]) != (i, s)))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(5)
    pool = [" ".join(rng.choices("abcdefgh", k=6)) for _ in range(300)]
    passage = rng.choices(pool, k=30)
    docs = {}
    for i in range(80):
        lines = rng.choices(pool, k=rng.randrange(40))
        if i % 3 == 0:
            lines[len(lines) // 2 : len(lines) // 2] = passage[rng.randrange(5) :]
        if i % 5 == 0:
            lines += ["|bar", "||", ""]
        if i % 7 == 0:
            lines += ["", "", "same", "same", "same"]
        docs[i] = "\n".join(lines)
    docs[81] = docs[80] = docs[3]
    table = spark.createDataFrame([(i, t, "en", "s", 1, "x", "y") for i, t in docs.items()], SCHEMA)
    got = {r["doc_id"]: r["text"] for r in L.dedup_lines(table).collect()}
    assert got == brute(docs)
    assert sum(map(len, got.values())) < 0.8 * sum(map(len, docs.values()))


def test_odd_rows(spark):
    long = "\n".join(f"line {k % 5000}" for k in range(40_000))
    rows = [(1, None, None, None, None, None, "k"), (2, "", "en", None, 0, "c", None), (3, "\n\n\n", "en", "s", 3, "c", "k"), (4, long, "en", "s", 1, "c", "k"), (5, "a\nb", None, "s", 1, "c", "k"), (5, "a\nb", None, "s", 1, "c", "k"), (None, "a\nb", None, "s", 1, "c", "k")]
    table = spark.createDataFrame(rows, SCHEMA)
    out = L.dedup_lines(table)
    assert out.columns == table.columns
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert len(got) == 7 and (1, None) in got and (2, "") in got and (3, "\n\n\n") in got
    assert len(dict(got)[4]) <= len(long)
    assert L.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0
