"""SimHash near-duplicates by a binary-trie self-join.

Fingerprints are leaves of a binary trie. The join traverses pairs of nodes together: both go down by one bit, equal bits
cost nothing, different bits add one error, and a pair whose errors exceed the budget is pruned with all below it. With a
budget of e, two linked fingerprints agree in one of e+1 blocks of bits, so the trie is entered once with each block in
front and the levels of that block are descended without error; that makes the nodes at that depth independent, and they are
dealt to tasks. A node with more than NODE_ROWS fingerprints is descended further as a distributed join of its children,
four levels at a time, before tasks take over. Inside a task the traversal is level-synchronous on sorted numpy arrays.
Equal fingerprints are one leaf. Each task hands on a spanning forest of its links, so groups never become all their pairs.

Defined results: a null or empty text, or one without words, has fingerprint zero and links like any other; a text of fewer
words than a shingle is one shingle; repeated rows share a class; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from meshlark.llm.common import hot_keys, partitions, spread_join, written
from meshlark.llm.components import components

#: Fingerprints under one node pair that a task takes as they are.
NODE_ROWS = 50_000
#: Candidate pairs compared at once in a task, and the product of sizes from which a node pair is compared and not descended.
AT_ONCE, LEAF = 2_000_000, 256


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles of a text, A-Z in lower case; repeats included."""
    w = text.encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    shingles = [b" ".join(w)] if len(w) < words else map(b" ".join, zip(*(w[k:] for k in range(words))))
    return np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of 64 bits: a bit is set if it is in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        some = hashes[k : k + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    x = hashes + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and its SimHash fingerprint as a signed long. One pass, no shuffle."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [_signed(majority(shingle_hashes(t or "", words))) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(prints, pa.int64())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(made, f"doc_id {dict(docs.dtypes)['doc_id']}, fingerprint bigint")


class Forest:
    """Union-find on 0..n-1 in arrays: the root of a set is its least member."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            a, b = self.parent[a], self.parent[b]
            apart = a != b
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
            while (up := self.parent[self.parent]).tobytes() != self.parent.tobytes():
                self.parent = up


def trie_join(values: np.ndarray, pairs: np.ndarray, depth: int, budget: int, linked, end: int = 64, crowd=None) -> None:
    """Descend node pairs together. values: sorted within each node, left-justified in 64 bits, `end` bits of them used.

    pairs: rows of (from, to, other from, other to, errors); a node with itself has equal ranges. Calls linked(i, j) with
    the places of pairs that differ in at most `budget` bits, batch by batch. Pairs of leaves of more than AT_ONCE pairs go
    to crowd(members) where it is given: all their members differ in at most `budget` bits.
    """

    def compare(some: np.ndarray) -> None:
        own = some[:, 0] == some[:, 2]
        wide, high = some[:, 1] - some[:, 0], some[:, 3] - some[:, 2]
        total = wide * high
        edges = np.cumsum(total)
        start = 0
        while start < len(some):
            stop = max(start + 1, int(np.searchsorted(edges, (edges[start - 1] if start else 0) + AT_ONCE, "right")))
            part = slice(start, stop)
            which = np.repeat(np.arange(start, stop), total[part])
            at = np.arange(len(which)) - np.repeat(edges[part] - total[part] - (edges[start - 1] if start else 0), total[part])
            i, j = some[which, 0] + at // high[which], some[which, 2] + at % high[which]
            near = (np.bitwise_count(values[i] ^ values[j]) <= budget) & ((i < j) | ~own[which])
            if near.any():
                linked(i[near], j[near])
            start = stop

    stack = [(depth, pairs)]
    while stack:
        d, some = stack.pop()
        if len(some) > AT_ONCE // 8:
            stack += [(d, some[: len(some) // 2]), (d, some[len(some) // 2 :])]
            continue
        product = (some[:, 1] - some[:, 0]) * (some[:, 3] - some[:, 2])
        small = (product <= LEAF) | (d >= end)
        if crowd is not None and d >= end:
            for a0, a1, b0, b1, _ in some[product > AT_ONCE].tolist():
                crowd(np.union1d(np.arange(a0, a1), np.arange(b0, b1)))
            some, small = some[product <= AT_ONCE], small[product <= AT_ONCE]
        compare(some[small])
        some = some[~small]
        if not len(some):
            continue
        ones = np.concatenate([[0], np.cumsum((values >> np.uint64(63 - d)) & np.uint64(1), dtype=np.int64)])
        a0, a1, b0, b1, err = some.T
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        own = a0 == b0
        down = [
            np.stack([a0, am, b0, bm, err], 1),
            np.stack([am, a1, bm, b1, err], 1),
            np.stack([a0, am, bm, b1, err + 1], 1),
            np.stack([am, a1, b0, bm, err + 1], 1)[~own],
        ]
        below = np.concatenate(down)
        below = below[(below[:, 4] <= budget) & (below[:, 0] < below[:, 1]) & (below[:, 2] < below[:, 3])]
        if len(below):
            stack.append((d + 1, below))


def _node_tables(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """The rows of a task, sorted by node, in tables that hold whole nodes."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows > limit:
            table = pa.Table.from_batches(held).combine_chunks()
            nodes = table["node"].to_numpy()
            cut = int(np.searchsorted(nodes, nodes[-1])) if nodes[0] != nodes[-1] else 0
            if cut:
                yield table.slice(0, cut)
                held = table.slice(cut).to_batches()
                rows = table.num_rows - cut
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _task(budget: int):
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _node_tables(batches, 200_000):
            node, side = table["node"].to_numpy(), table["side"].to_numpy()
            values, ids = table["value"].to_numpy().view(np.uint64), table["id"].to_numpy()
            forest = Forest(len(ids))
            starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            ends = np.r_[starts[1:], len(node)]
            depths, errors = table["depth"].to_numpy()[starts], table["errors"].to_numpy()[starts]
            middle = starts + np.add.reduceat(side < 2, starts)
            cross = side[starts] > 0
            one = np.stack([starts, np.where(cross, middle, ends), np.where(cross, middle, starts), ends, errors], 1).astype(np.int64)
            one = one[(one[:, 0] < one[:, 1]) & (one[:, 2] < one[:, 3])] if cross.any() else one
            if cross.any():
                kept = (starts < np.where(cross, middle, ends)) & (np.where(cross, middle, starts) < ends)
                depths = depths[kept]
            for d in np.unique(depths):
                trie_join(values, one[depths == d], int(d), budget, forest.join)
            child = np.flatnonzero(forest.parent != np.arange(len(ids)))
            u, v = ids[child], ids[forest.parent[child]]
            yield pa.record_batch([pa.array(u), pa.array(v)], ["u", "v"])

    return joined


def _children(nodes: DataFrame, budget: int) -> DataFrame:
    """The pairs of children, four levels down, of nodes that are too large for a task."""
    child = F.expr("CAST(shiftrightunsigned(shiftleft(value, depth), 60) AS INT)")
    other = F.explode(F.sequence(F.lit(0), F.lit(15))).alias("other")
    pairs = nodes.withColumn("child", child).select("*", other).withColumn("more", F.col("errors") + F.bit_count(F.col("child").bitwiseXOR(F.col("other"))))
    pairs = pairs.filter(F.col("more") <= budget)
    alone = (F.col("side") == 0) & (F.col("child") == F.col("other"))
    side = F.when(alone, 0).when(F.col("side") > 0, F.col("side")).when(F.col("child") < F.col("other"), 1).otherwise(2).cast("int")
    first = F.when(side == 2, F.col("other")).otherwise(F.col("child"))
    second = F.when(side == 2, F.col("child")).otherwise(F.col("other"))
    return pairs.select(F.xxhash64("node", first, second).alias("node"), side.alias("side"), "value", "id", (F.col("depth") + 4).alias("depth"), F.col("more").cast("int").alias("errors"))


def entered(leaves: DataFrame, tables: list[Column], bits: int, budget: int, *more: str) -> DataFrame:
    """The nodes at which tries are entered: node, value (left-justified), id, signature and further columns of the leaves.

    tables: the values, `bits` low bits each. Each is entered once with each of its budget + 1 blocks of bits in front.
    """
    width = bits // (budget + 1)
    mask = -1 if bits == 64 else (1 << bits) - 1
    views = []
    for t, x in enumerate(tables):
        for r in range(budget + 1):
            k = r * width
            turned = x if not k else F.shiftleft(x, k).bitwiseOR(F.shiftrightunsigned(x, bits - k)).bitwiseAND(F.lit(mask))
            views.append(F.struct(F.lit(t * (budget + 1) + r).alias("view"), (F.shiftleft(turned, 64 - bits) if bits < 64 else turned).alias("value")))
    each = leaves.select("id", "signature", *more, F.explode(F.array(*views)).alias("v"))
    return each.select(F.xxhash64("v.view", F.shiftrightunsigned(F.col("v.value"), 64 - width)).alias("node"), F.col("v.value").alias("value"), "id", "signature", *more)


def links(leaves: DataFrame, fingerprint: Column, bits: int, budget: int) -> DataFrame:
    """A spanning forest (u, v) of the ids whose fingerprints differ in at most `budget` of `bits` bits.

    leaves: id and what `fingerprint` reads, one row a distinct fingerprint.
    """
    zero, width = F.lit(0), bits // (budget + 1)
    bare = leaves.withColumn("signature", F.lit(None).cast("array<bigint>"))
    nodes = entered(bare, [fingerprint], bits, budget).select("node", zero.alias("side"), "value", "id", F.lit(width).alias("depth"), zero.alias("errors"))
    large = written(nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > NODE_ROWS).select("node"))
    ready = []
    while not large.isEmpty():
        ready.append(nodes.join(large, "node", "left_anti"))
        nodes = written(_children(nodes.join(large, "node", "left_semi"), budget))
        large = written(nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > NODE_ROWS)).join(nodes.filter("depth <= 60").select("node").distinct(), "node", "left_semi").select("node"))
    ready.append(nodes)
    every = ready[0]
    for more in ready[1:]:
        every = every.unionByName(more)
    dealt = every.repartition(partitions(leaves.sparkSession), "node").sortWithinPartitions("node", "side", F.col("value").bitwiseXOR(F.lit(-(1 << 63))))
    return dealt.mapInArrow(_task(budget), "u bigint, v bigint")


def classes(docs: DataFrame, words: int = 3, budget: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the least doc_id that links of at most `budget` bits reach."""
    prints = written(fingerprints(docs, words))
    distinct = written(prints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("id")))
    found = components(links(distinct.filter("id IS NOT NULL"), F.col("fingerprint"), 64, budget))
    named = distinct.join(found, distinct["id"] == found["node"], "left").select("fingerprint", F.coalesce("component", "id").alias("component_id"))
    text = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    hot = hot_keys(distinct, ["fingerprint"], prints.count())  # of many equal texts, or empty ones
    return spread_join(prints, named, ["fingerprint"], hot, ["doc_id"]).select("doc_id", text.alias("fingerprint"), "component_id")
