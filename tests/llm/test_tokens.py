import random
import zlib

import numpy as np
import public_tokenizers
from shared import LONG, empty, odd_rows
from tokenizers import Tokenizer

from meshlark.llm import byte_bpe, packing
from meshlark.llm.token_counts import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library():
    return Tokenizer.from_file(PATH)


def test_equals_library_on_random_texts():
    rng, t = random.Random(4), library()
    near = list(" \t\n\r\x0b\x0c\x1c\x85\xa0'sStdrvel12½²٣aé.,!?<|endoftext|>")
    wide = [chr(c) for c in [*range(0x250), *(rng.randrange(0x300, 0x20000) for _ in range(2000))] if not 0xD800 <= c < 0xE000]
    texts = ["".join(rng.choices(near if k % 2 else wide, k=rng.randrange(60))) for k in range(1500)]
    texts += ["a" * 20_000, "ab" * 3000, " " * 999, "<|endoftext|>" * 3, "x <|endoftext|> y"]
    want = [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    assert byte_bpe.count_tokens(PATH, texts) == list(map(len, want))
    assert [np.frombuffer(b, byte_bpe.id_type(PATH)).tolist() for b in byte_bpe.encode(PATH, texts)] == want
    ids, counts = byte_bpe.vocabulary(PATH).merge([b"hello", b" world", b"aaaa"])
    assert ids.tolist() == t.encode("hello world", add_special_tokens=False).ids + t.encode("aaaa", add_special_tokens=False).ids and counts.sum() == len(ids)


def test_cache_generations(monkeypatch):
    monkeypatch.setattr(byte_bpe, "KEEP", 10)
    rng = random.Random(1)
    texts = [" ".join(rng.choices("abcdefgh", k=5)) + str(k) for k in range(200)]
    assert [byte_bpe.count_tokens(PATH, [x])[0] for x in texts] == [len(x.ids) for x in library().encode_batch(texts, add_special_tokens=False)]


def test_odd_rows_count(spark):
    got = {r["doc_id"]: r for r in token_counts(odd_rows(spark), PATH).collect()}
    assert (got[1]["n_bytes"], got[1]["n_tokens"], got[2]["n_tokens"]) == (0, 0, 0) and got[3]["over_limit"]
    assert got[3]["n_tokens"] == len(library().encode(LONG, add_special_tokens=False).ids)
    assert token_counts(empty(spark), PATH).count() == 0


def check_pieces(pieces, ids):
    """Every id in exactly one piece, checksums, gapless sequences of at most 2048."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert set(by_doc) == set(ids)
    for i, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p["start"]):
            part = ids[i][p["start"] : p["start"] + p["length"]]
            assert p["start"] == at and p["doc_tokens"] == len(ids[i]) and zlib.crc32(part.astype("<u4").tobytes()) == p["ids_crc32"]
            at += p["length"]
        assert at == len(ids[i])
    padding = 0
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 2048 - at
    return padding / sum(map(len, ids.values()))


def test_packing_holds_every_id_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    t = library()
    ids = {r["doc_id"]: np.array(t.encode(r["text"] or "", add_special_tokens=False).ids + [1]) for r in docs.collect()}
    assert check_pieces(packing.pack(docs, PATH).collect(), ids) < 0.02


def test_odd_rows_pack(spark):
    got = packing.pack(odd_rows(spark), PATH).collect()
    assert sum(p["length"] for p in got if p["doc_id"] in (1, 2)) == 2
    assert sum(p["length"] for p in got if p["doc_id"] == 4) == 2 * next(p["doc_tokens"] for p in got if p["doc_id"] == 4)
    assert packing.pack(empty(spark), PATH).count() == 0


def test_differencing_gives_near_equal_windows():
    rng = random.Random(3)
    for n, k in ((1, 1), (7, 3), (500, 60)):
        sizes = [rng.randrange(1, 900) for _ in range(n)]
        groups = packing.differencing(sizes, k)
        assert sorted(i for g in groups for i in g) == list(range(n))
        sums = [sum(sizes[i] for i in g) for g in groups]
        assert n < 100 or max(sums) - min(sums) < 60
    windows = packing.windows_of([2047] * 5 + [3] * 4, 2048)
    assert all(sum(p[2] for p in w) <= 2048 for w in windows) and sum(p[2] for w in windows for p in w) == 5 * 2047 + 12


def test_differencing_decides_nearly_all_ids():
    """Windows keep what differencing put into them but for the excess, and only the last can have much room."""
    rng = random.Random(8)
    lengths = [min(2047, int(rng.lognormvariate(6.3, 0.8)) + 1) for _ in range(2048)]
    windows = packing.windows_of(lengths, 2048)
    whole = sum(n for w in windows for i, start, n in w if (start, n) == (0, lengths[i]))
    longest = {}
    for w in windows:
        for i, _, n in w:
            longest[i] = max(longest.get(i, 0), n)
    assert sum(longest.values()) > (1 - packing.EXCESS) * sum(lengths) and whole > 0.85 * sum(lengths)
    assert len(windows) <= 1.005 * sum(lengths) / 2048 + 1
    sums = sorted(sum(n for _, _, n in w) for w in windows)
    assert sums[-1] <= 2048 and sums[len(sums) // 20] > 1900


def test_the_window_count_rises():
    """Items that fit the least number of windows only with much cutting: the count rises until little is cut."""
    windows = packing.windows_of([1500] * 40, 2048)
    assert len(windows) > -(-40 * 1500 // 2048) and all(sum(n for *_, n in w) <= 2048 for w in windows)
    whole = sum(n == 1500 for w in windows for *_, n in w)
    assert whole >= 38 and sum(n for w in windows for *_, n in w) == 40 * 1500


def test_many_equal_rows_spread_over_batches(spark, monkeypatch):
    monkeypatch.setattr(packing, "BATCH", 50)
    docs = spark.createDataFrame([(None, "")] * 3000 + [(k, "a few words") for k in range(100)], "doc_id bigint, text string")
    pieces = packing.pack(docs, PATH).collect()
    batches = {}
    for p in pieces:
        batches[p["sequence_id"] >> 32] = batches.get(p["sequence_id"] >> 32, 0) + 1
    assert len(pieces) >= 3100 and len(batches) > 50 and max(batches.values()) < 150
