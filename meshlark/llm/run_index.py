"""Repeated passages by a run-length compressed suffix index.

Removed is every byte under a string of LENGTH bytes that also starts anywhere else. Windows of LENGTH bytes are dealt by
content: a window's anchor is its Q-gram of least hash (the leftmost of equals), so equal windows have equal anchors, at the
same place in them, and the windows of one anchor lie next to each other in a segment. Then
 1. anchors that occur once can't hold a repeat, and drop out;
 2. anchors all of whose segments are equal are repeats from end to end, and need no index;
 3. the segments of the other anchors, each text once, go to tasks by anchor. A task sorts their suffixes, forms the
    Burrows-Wheeler transform, keeps only its runs with the suffixes sampled at run ends, and streams matching statistics:
    inside a run the neighbour of the next suffix in the text is the next suffix of the neighbour, so a match found at a
    sample only loses a byte a step until the next sample. Windows that match a neighbour over LENGTH bytes are marked.
Sorting holds a full order of the suffixes of one index at a time, SUFFIX_BYTES bytes for a byte of text; what is kept and
queried are the runs. An index holds at most INDEX_BYTES of text and one anchor more. An anchor of more than ANCHOR_BYTES
of distinct segments never meets in a task: its windows are counted by two hashes of 64 bits each instead, with partial
sums, which decides the same.

On a corpus of one part copies (25 MB), 87 % of the bytes removed lie in segments that are equal as a whole (step 2, and equal
texts of step 3), and 13 % are found by the index alone. Equal segments are told by hashes of 128 bits, not byte by byte: with 10^15 segments a false pair has a chance of 10^-9.
Anchors of very many segments are met in several tasks (see common.spread_join), as are segments of very many copies.

Defined results: a null or empty text has no bytes and loses none; a repeat inside one document counts; copies, however
many, are all removed, the first included; a text below LENGTH bytes keeps all; rows with an equal doc_id are told apart by
their text, and equal rows are copies of each other; texts of any length are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from meshlark.llm.common import hot_keys, partitions, spread_join, text_of, written

LENGTH, Q = 400, 64
#: Bytes of text in one index, and distinct bytes of one anchor beyond which it is split by windows.
INDEX_BYTES, ANCHOR_BYTES = 1_000_000, 5_000_000
#: What building an index holds for a byte of its text; a test measures it.
SUFFIX_BYTES = 60
_BASE = np.uint64(0x9E3779B97F4A7C15)

def gram_hashes(data: np.ndarray, q: int, base: np.uint64 = _BASE) -> np.ndarray:
    """A hash of every run of q bytes, by doubling."""
    codes = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    h, width, power = codes[data], 1, base
    done, total = None, 0
    with np.errstate(over="ignore"):
        while True:
            if q & width:
                if done is None:
                    done, total = h, width
                else:  # done covers `total` bytes, followed by `width` more
                    n = len(data) - total - width + 1
                    done, total = done[:n] * power + h[total : total + n], total + width
            if total == q:
                break
            n = len(h) - width
            if n <= 0:
                return np.zeros(0, np.uint64)
            h = h[:n] * power + h[width:]
            width, power = width * 2, power * power
        done = done ^ (done >> np.uint64(31))
        done *= np.uint64(0xBF58476D1CE4E5B9)
        return done ^ (done >> np.uint64(29))


def anchors(data: np.ndarray, length: int = LENGTH, q: int = Q) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each anchor in turn: its hash, and the first and last start of its windows."""
    if len(data) < length:
        empty = np.zeros(0, np.int64)
        return empty.view(np.uint64), empty, empty
    h = gram_hashes(data, q)
    w = length - q + 1
    top = h >> np.uint64(24)
    out_hash, out_first, out_last = [], [], []
    step = 1 << 22  # places fit in the low 24 bits of a piece
    starts = len(data) - length + 1
    for base in range(0, starts, step):
        n = min(step, starts - base)
        x = (top[base : base + n + w - 1] << np.uint64(24)) | np.arange(n + w - 1, dtype=np.uint64)
        width = 1
        least = x
        while width * 2 <= w:
            least = np.minimum(least[: len(least) - width], least[width:])
            width *= 2
        least = np.minimum(least[:n], least[w - width : w - width + n])
        place = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        last = np.r_[first[1:] - 1, n - 1]
        out_hash.append(h[base + place[first]])
        out_first.append(first + base)
        out_last.append(last + base)
    return np.concatenate(out_hash), np.concatenate(out_first), np.concatenate(out_last)


def suffixes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts with an end mark each, the order of their suffixes, and where each text ends.

    End marks rank below all bytes and by the number of their text. Prefix doubling sorts groups that are still tied.
    """
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    n = int(ends[-1]) + 1
    symbols = np.zeros(n, np.int16)
    body = np.ones(n, bool)
    body[ends] = False
    symbols[body] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int16) + 1
    lengths = np.diff(np.r_[-1, ends])
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    left = np.repeat(ends.astype(np.int32), lengths) - np.arange(n, dtype=np.int32)  # bytes before the end mark
    key = np.zeros(n, np.int64)
    for k in range(7):
        key *= 257
        key[: n - k] += np.where(left[: n - k] >= k, symbols[k:], 0)
    order = np.argsort(key, kind="stable").astype(np.int32)
    key = key[order]
    h = 7
    change = np.r_[True, key[1:] != key[:-1]]
    del key, body
    rank = np.zeros(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(change, np.arange(n, dtype=np.int32), 0))
    # tied suffixes are those whose group holds more than one
    while True:
        tied = np.flatnonzero(~(change & np.r_[change[1:], True])).astype(np.int32)
        if not len(tied):
            return symbols, order, ends
        of = order[tied]
        both = rank[of].astype(np.int64)
        both *= n + len(texts) + 1
        both += np.where(left[of] >= h, rank[np.minimum(of.astype(np.int64) + h, n - 1)] + np.int32(len(texts)), owner[of])
        again = np.argsort(both)
        order[tied] = of[again]
        both = both[again]
        fresh = np.r_[True, both[1:] != both[:-1]]
        del both, again
        change[tied] = fresh
        rank[order[tied]] = np.maximum.accumulate(np.where(fresh, tied, 0))
        h *= 2


def matches(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The longest match of every suffix with another suffix of the texts, end marks excluded, and where each text ends."""
    symbols, order, ends = suffixes(texts)
    n = len(order)
    before = symbols[order - 1]
    before[order == 0] = 0
    left = np.repeat(ends.astype(np.int32), np.diff(np.r_[-1, ends])) - np.arange(n, dtype=np.int32)
    # runs of the transform; an end mark is a run of its own. Of the order only the suffixes at run ends stay.
    heads = np.flatnonzero(np.r_[True, (before[1:] != before[:-1]) | (before[1:] == 0)])
    tails = np.r_[heads[1:] - 1, n - 1]
    samples = [(order[heads[1:]], order[heads[1:] - 1], int(order[0])), (order[tails[:-1]], order[tails[:-1] + 1], int(order[-1]))]
    del order, before
    data = np.zeros(n + 8, np.uint8)
    data[:n] = np.maximum(symbols - 1, 0)
    del symbols
    word = np.lib.stride_tricks.sliding_window_view(data, 8)
    read = lambda at: word[at].copy().view("<u8").ravel()  # eight bytes from each place on
    best = np.zeros(n, np.int32)
    for at, other, edge in samples:
        match = np.zeros(len(at), np.int32)
        room = np.minimum(left[at], left[other])
        open_ = np.arange(len(at))
        while len(open_):  # compare from the samples on, a word at a time
            m = match[open_]
            differ = read(at[open_] + m) ^ read(other[open_] + m)
            low = differ & (~differ + np.uint64(1))
            same = np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)) >> 3).astype(np.int32)
            match[open_] = np.minimum(m + same, room[open_])
            open_ = open_[(same == 8) & (match[open_] < room[open_])]
        # stream over the text: from a sample to the next a match loses a byte a step
        value = np.full(n, -1, np.int32)
        value[at] = match
        value[edge] = 0
        spot = np.maximum.accumulate(np.where(value >= 0, np.arange(n, dtype=np.int32), np.int32(-1)))
        found = value[spot] - (np.arange(n, dtype=np.int32) - spot)
        best = np.maximum(best, np.where(spot >= 0, found, 0))
    return best, ends


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.r_[0, flags.astype(np.int8), 0])
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _halves(segment: bytes) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(segment)
    return tuple(y - (1 << 64) if y >> 63 else y for y in (x >> 64, x & (1 << 64) - 1))


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, hash, first and last start, two halves of the segment's hash, and `more`.

    Of equal segments in one text a single row goes on. They are repeats from end to end, so the row has in `more` the
    starts of all of them, joined where they touch; text of a short period makes no row for each of its places.
    """
    names = ["row", "hash", "first", "last", "a", "b", "more"]
    kinds = [pa.int64()] * 5 + [pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))]
    for batch in batches:
        held: list[list] = [[] for _ in names]

        def out() -> pa.RecordBatch:
            made = pa.record_batch([batch.column("row").take(pa.array(held[0], pa.int64())), *(pa.array(c, t) for c, t in zip(held[1:], kinds))], names)
            for c in held:
                c.clear()
            return made

        for k, text in enumerate(batch.column("text").to_pylist()):
            data = text.encode()
            hashes, first, last = anchors(np.frombuffer(data, np.uint8))
            rows: dict[tuple, list] = {}
            for h, f, e in zip(hashes.view(np.int64).tolist(), first.tolist(), last.tolist()):
                a, b = _halves(data[f : e + LENGTH])
                if (r := rows.setdefault((h, a, b), [h, f, e, a, b, None]))[1] != f:
                    if r[5] is None:
                        r[5] = [{"first": r[1], "last": r[2]}]
                    if r[5][-1]["last"] == f - 1:
                        r[5][-1]["last"] = e
                    else:
                        r[5].append({"first": f, "last": e})
            held[0] += [k] * len(rows)
            for c, values in zip(held[1:], zip(*rows.values())):
                c += values
            if len(held[0]) > 50_000:
                yield out()
        if held[0]:
            yield out()


def _index_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments sorted by anchor to those of their windows' starts that repeat: (hash, a, b, from, to), relative, to inclusive."""

    def marked(rows: list[tuple]) -> pa.RecordBatch:
        best, ends = matches([r[3] for r in rows])
        out = []
        start = 0
        for (h, a, b, _), end in zip(rows, ends.tolist()):
            lo, hi = _spans(best[start:end] >= LENGTH)
            out += [(h, a, b, x, y - 1) for x, y in zip(lo.tolist(), hi.tolist())]
            start = end + 1
        return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)] or [pa.array([], pa.int64())] * 5, ["hash", "a", "b", "low", "high"])

    held: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("hash", "a", "b", "segment"))):
            if size > INDEX_BYTES and held[-1][0] != row[0]:
                yield marked(held)
                held, size = [], 0
            held.append(row)
            size += len(row[3])
    if held:
        yield marked(held)


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of large anchors to a row for each window: its place and two hashes of it."""
    for batch in batches:
        for h, a, b, s in zip(*(batch.column(c).to_pylist() for c in ("hash", "a", "b", "segment"))):
            data = np.frombuffer(s, np.uint8)
            x, y = (gram_hashes(data, LENGTH, base).view(np.int64) for base in (_BASE, np.uint64(0xC2B2AE3D27D4EB4F)))
            fixed = [np.full(len(x), c, np.int64) for c in (h, a, b)]
            yield pa.record_batch([pa.array(c) for c in (*fixed, np.arange(len(x)), x, y)], ["hash", "a", "b", "low", "x", "y"])


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [(w["hash"], w["a"], w["b"], data[w["first"] : w["last"] + LENGTH]) for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist()) for data in [text.encode()] for w in wanted]
        kinds = [pa.int64()] * 3 + [pa.binary()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)] or [pa.array([], t) for t in kinds], ["hash", "a", "b", "segment"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            data = text.encode()
            if not spans:
                out.append((len(data), 0, [], data))
                continue
            edge = np.zeros(len(data) + 1, np.int64)
            pairs = np.array([(s["first"], s["last"] + LENGTH) for s in spans])
            np.add.at(edge, pairs[:, 0], 1)
            np.add.at(edge, pairs[:, 1], -1)
            gone = np.cumsum(edge)[:-1] > 0
            lo, hi = _spans(gone)
            out.append((len(data), int(gone.sum()), [{"first": x, "last": y} for x, y in zip(lo.tolist(), hi.tolist())], np.frombuffer(data, np.uint8)[~gone].tobytes()))
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])), pa.binary()]
        yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*out), kinds))], ["doc_id", "n_bytes", "n_removed", "removed", "kept"])


def repeated(rows: DataFrame) -> DataFrame:
    """rows(row, text) to row, spans: the starts (first to last, inclusive) of repeated windows, for rows that have some."""
    kind = dict(rows.dtypes)["row"]
    span = "array<struct<first:bigint,last:bigint>>"
    every = written(rows.mapInArrow(_anchor_rows, f"row {kind}, hash bigint, first bigint, last bigint, a bigint, b bigint, more {span}"))
    often = written(every.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.count("more").alias("m")).filter("n > 1 OR m > 0"))
    hot = hot_keys(often, ["hash"], every.count())
    found = written(spread_join(every, often.select("hash"), ["hash"], hot, ["row", "first"]))
    same = found.groupBy("hash", "a", "b").agg(F.count(F.lit(1)).alias("n"), F.count("more").alias("m"), F.min(F.struct("row", "first", "last")).alias("one"))
    same = written(same.select("hash", "a", "b", "one", "n", F.expr("n > 1 OR m > 0").alias("repeats")))
    of_bytes = F.sum(F.col("one.last") - F.col("one.first") + LENGTH).alias("bytes")
    mixed = written(same.groupBy("hash").agg(F.count(F.lit(1)).alias("texts"), of_bytes).filter("texts > 1"))
    # the index reads each segment's text from one of its places
    place = F.struct("hash", "a", "b", F.col("one.first").alias("first"), F.col("one.last").alias("last"))
    wanted = same.join(mixed, "hash").groupBy(F.col("one.row").alias("row")).agg(F.collect_list(place).alias("wanted"))
    segments = rows.join(wanted, "row").select("text", "wanted").mapInArrow(_segment_rows, "hash bigint, a bigint, b bigint, segment binary")
    large = mixed.filter(F.col("bytes") > ANCHOR_BYTES).select("hash")
    counted = None
    if not large.isEmpty():
        segments = written(segments)
        windows = written(segments.join(large, "hash", "left_semi").mapInArrow(_window_rows, "hash bigint, a bigint, b bigint, low bigint, x bigint, y bigint"))
        twice = written(windows.groupBy("hash", "x", "y").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
        shared = spread_join(windows, twice.drop("n"), ["hash", "x", "y"], hot_keys(twice, ["hash", "x", "y"], windows.count()), ["a", "b", "low"])
        counted = shared.select("hash", "a", "b", "low", F.col("low").alias("high"))
        segments = segments.join(large, "hash", "left_anti")
    dealt = segments.repartition(partitions(rows.sparkSession), "hash").sortWithinPartitions("hash", "a", "b")
    marks = dealt.mapInArrow(_index_task, "hash bigint, a bigint, b bigint, low bigint, high bigint")
    marks = marks if counted is None else marks.unionByName(counted)
    # a mark holds for every place of its segment
    whole = same.filter("repeats").select("hash", "a", "b", F.lit(0).cast("long").alias("low"), F.lit(1 << 40).alias("high"))
    marks = marks.unionByName(whole).groupBy("hash", "a", "b").agg(F.collect_list(F.struct("low", "high")).alias("marks"))
    keys = ["hash", "a", "b"]
    placed = spread_join(found.select("row", "first", "last", *keys), marks, keys, hot_keys(same, keys, found.count()), ["row", "first"])
    each = placed.select("row", "first", "last", F.explode("marks").alias("m"))
    starts = each.select("row", (F.col("first") + F.col("m.low")).alias("from"), F.least("last", F.col("first") + F.col("m.high")).alias("to"))
    more = found.select("row", F.explode_outer("more").alias("m")).filter("m IS NOT NULL").select("row", F.col("m.first").alias("from"), F.col("m.last").alias("to"))
    return starts.unionByName(more).groupBy("row").agg(F.collect_list(F.struct(F.col("from").alias("first"), F.col("to").alias("last"))).alias("spans"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, removed (spans of bytes, end exclusive), kept (the other bytes).

    The index and the removal both read texts by row, so one shuffle of the texts serves both.
    """
    keyed = docs.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("row"), text_of().alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    joined = keyed.join(repeated(keyed), "row", "left").select(F.col("row.doc_id").alias("doc_id"), "text", "spans")
    return joined.mapInArrow(_kept, f"doc_id {kind}, n_bytes bigint, n_removed bigint, removed array<struct<first:bigint,last:bigint>>, kept binary")
