"""Packing token sequences by Karmarkar-Karp multiway differencing.

A document is cut at multiples of the capacity; full windows are finished at once and only remainders are packed.
Remainders are dealt into batches of a bounded size. In a batch every remainder starts as a partition of its own; the two
partitions with the largest spreads merge with opposing imbalances, the fullest windows of one onto the emptiest of the
other, until one partition is left. Differencing starts at the least window count; the count rises while windows exceed
the capacity by more than EXCESS of all ids. Documents may be cut, so that last excess (0.7 % of the ids at 2048 remainders
of 700 ids) is cut off and fills windows with room; differencing decides the place of all other ids.

Batches are dealt by doc_id and place in the input, so that many equal rows spread over all of them. Defined results: a null
or empty text is the end id alone; rows with an equal doc_id are packed each; an empty table gives no piece; texts of any
length are read whole.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from meshlark.llm import byte_bpe
from meshlark.llm.common import text_of
from meshlark.llm.token_counts import slices

#: Documents whose remainders are packed together.
BATCH = 2048
#: The share of ids that may be cut off overfull windows before the window count rises.
EXCESS = 0.02


def differencing(lengths: list[int], windows: int) -> list[list[int]]:
    """Items dealt into `windows` groups with near-equal sums, as lists of item numbers."""
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    made = n = len(lengths)
    heap = [(-x, k, np.array([x]), np.array([k])) for k, x in enumerate(lengths)]
    heapq.heapify(heap)
    spread = lambda sums: int(sums[0] - (sums[-1] if len(sums) == windows else 0))
    turn = n
    while len(heap) > 1:
        _, _, a, of_a = heapq.heappop(heap)
        _, _, b, of_b = heapq.heappop(heap)
        both = len(a) + len(b) - windows
        if both <= 0:
            sums, of = np.concatenate([a, b]), np.concatenate([of_a, of_b])
        else:  # falling sums of one meet rising sums of the other; `both` of the smallest of each side overlap
            one, two = a[len(a) - both :], b[len(b) - both :][::-1]
            left.append(of_a[len(a) - both :])
            right.append(of_b[len(b) - both :][::-1])
            sums = np.concatenate([a[: len(a) - both], b[: len(b) - both], one + two])
            of = np.concatenate([of_a[: len(a) - both], of_b[: len(b) - both], made + np.arange(both)])
            made += both
        order = np.argsort(-sums, kind="stable")
        sums, of, turn = sums[order], of[order], turn + 1
        heapq.heappush(heap, (-spread(sums), turn, sums, of))
    joined = list(zip(np.concatenate(left).tolist(), np.concatenate(right).tolist())) if left else []
    out = []
    for top in heap[0][3].tolist() if heap else []:
        members, rest = [], [top]
        while rest:
            k = rest.pop()
            if k < n:
                members.append(k)
            else:
                rest += joined[k - n]
        out.append(members)
    return out


def windows_of(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (item, start in the item, length), each of at most `capacity`.

    The partition is the one that differencing makes. The window count rises while more than EXCESS of all ids lie beyond
    the capacity of their windows; what then lies beyond is cut off the last item of its window, and goes to windows with
    room. All other ids stay where differencing put them.
    """
    total = sum(lengths)
    count = -(-total // capacity)
    while True:
        groups = differencing(lengths, count)
        sums = [sum(lengths[i] for i in g) for g in groups]
        if sum(max(0, s - capacity) for s in sums) <= EXCESS * total:
            break
        count += max(1, count // 100)
    out, cut = [], []
    for group, used in zip(groups, sums):
        pieces = [(i, 0, lengths[i]) for i in sorted(group)]
        while used > capacity:
            i, start, length = pieces.pop()
            gone = min(length, used - capacity)
            cut.append((i, start + length - gone, gone))
            if gone < length:
                pieces.append((i, start, length - gone))
            used -= gone
        out.append((used, pieces))
    out += [(0, [])] * (count - len(groups))  # fewer items than windows
    done = []
    for used, pieces in sorted(out, key=lambda w: -w[0]):
        while cut and used < capacity:
            i, start, length = cut.pop()
            take = min(length, capacity - used)
            pieces = [*pieces, (i, start, take)]
            if take < length:
                cut.append((i, start + take, length - take))
            used += take
        if pieces:
            done.append(pieces)
    return done


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """A row for each piece: doc_id, start and length in its document's ids, ids_crc32, doc_tokens, sequence_id, offset.

    Memory of a task is bounded by the remainders of a batch, each below `capacity` ids.
    """
    batches = max(1, -(-docs.count() // BATCH))
    kind = dict(docs.dtypes)["doc_id"]
    keyed = docs.select("doc_id", text_of().alias("text")).withColumn("batch", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(batches)))

    def crc(ids: np.ndarray) -> int:
        return zlib.crc32(ids.astype("<u4").tobytes())

    def encoded(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = byte_bpe.id_type(vocabulary)
        names = ["batch", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
        for some in stream:
            place = 0
            for texts in slices(some.column("text").to_pylist()):
                rows, places = [], []
                for k, flat in enumerate(byte_bpe.encode(vocabulary, texts), place):
                    ids = np.append(np.frombuffer(flat, unit), unit.type(end_id))
                    full = len(ids) - len(ids) % capacity
                    for start in range(0, full, capacity):
                        rows.append((start, capacity, crc(ids[start : start + capacity]), len(ids), None))
                        places.append(k)
                    if full < len(ids):
                        rows.append((full, len(ids) - full, None, len(ids), ids[full:].tobytes()))
                        places.append(k)
                place += len(texts)
                at = pa.array(places, pa.int64())
                kinds = [pa.int64()] * 4 + [pa.binary()]
                yield pa.record_batch([some.column("batch").take(at), some.column("doc_id").take(at), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names)

    def packed(table: pa.Table) -> pa.Table:
        unit = byte_bpe.id_type(vocabulary)
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("doc_tokens", "ascending"), ("ids", "ascending")])
        rows = table.select(["start", "length", "ids_crc32", "doc_tokens", "ids"]).to_pylist()
        first = (table["batch"][0].as_py() if len(rows) else 0) << 32
        out, places, sequence = [], [], first
        for k, r in enumerate(rows):
            if r["ids"] is None:
                out.append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"], sequence, 0))
                places.append(k)
                sequence += 1
        rest = [k for k, r in enumerate(rows) if r["ids"] is not None]
        for window in windows_of([rows[k]["length"] for k in rest], capacity) if rest else []:
            offset = 0
            for i, start, length in window:
                r = rows[rest[i]]
                ids = np.frombuffer(r["ids"], unit)[start : start + length]
                out.append((r["start"] + start, length, crc(ids), r["doc_tokens"], sequence, offset))
                places.append(rest[i])
                offset += length
            sequence += 1
        columns = [pa.array(c, pa.int64()) for c in zip(*out)]
        return pa.table([table["doc_id"].take(pa.array(places, pa.int64())), *columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    pieces = keyed.mapInArrow(encoded, f"batch bigint, doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, ids binary")
    return pieces.groupBy("batch").applyInArrow(packed, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
