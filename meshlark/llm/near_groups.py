"""Groups of near copies: several binary tries of SimHash bits propose pairs, the sets of shingles decide.

One fingerprint of 64 bits can't tell a similarity of 0.8: such pairs differ in about ten bits. So every distinct text has a
signature of independent fingerprints, and several tries, each over a few bits of its own, are joined with themselves under
an error budget of one (see simhash_trie). Bits of a trie (BITS) and words of the signature (SHOWN) are constants, and `plan`
gives the number of tries from the recall wanted at the threshold: what is found never depends on how many texts there are.

A pair is a candidate if a trie finds it and the similarity that all bits estimate (with the sizes of both sets) isn't far
below the threshold. A task hands on the best spanning forest of its candidates, and every link of these forests is verified:
the exact Jaccard similarity of both sets of shingles must reach the threshold. Which links a forest has depends on what a
task holds, but what they connect doesn't; so where a refuted link leaves its ends apart, all texts that candidates connect
to them are compared exactly, each with all that it isn't linked to yet (`mended`). Groups are thus the components of exact
similarity within what the candidates connect, however rows are dealt.

Where very many texts share all bits of a trie, pairs aren't compared one by one: members outside the largest component are
compared with all, until one component is left or none remains to compare. A node of more than NODE_ROWS texts is dealt in
blocks, of which each pair meets in a task; so is a set of texts that `mended` compares, by BLOCK_SHINGLES.

Defined results: rows are told apart by doc_id and text, so a row never goes because another with its doc_id does; a null
text is empty; texts without any word are copies of each other; a text of fewer words than a shingle is one shingle; of
rows equal in doc_id and text one stays; a doc_id may have any type, and null comes last where the least is kept; further
columns may have any name; an empty table gives an empty result. Texts of any length are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from meshlark.llm.common import HOT_KEYS, forget, hot_keys, partitions, spread_join, text_of, written
from meshlark.llm.components import components
from meshlark.llm.simhash_trie import _mixed, _node_tables, _signed, entered, majority, shingle_hashes, trie_join

#: Recall of the tries at the threshold, and how far below it an estimate may lie (in standard errors of the bits).
RECALL, SLACK = 0.985, 3.0
#: Bits of a trie, words of the signature, and pairs that a task holds before it thins them to a forest.
BITS, SHOWN, HELD = 20, 8, 3_000_000
#: Texts under one node that a task takes as they are, and shingles of a block of texts that are compared exactly.
NODE_ROWS, BLOCK_SHINGLES = 500_000, 2_000_000


def angle(similarity: float) -> float:
    """The share of bits in which two sets of that Jaccard similarity differ, equal in size."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def plan(similarity: float, recall: float = RECALL) -> tuple[int, int]:
    """Number of tries (BITS each, error budget one), and fingerprints in a signature; neither depends on the input."""
    p = angle(similarity)
    hit = (1 - p) ** BITS + BITS * p * (1 - p) ** (BITS - 1)
    tries = max(1, math.ceil(math.log(1 - recall) / math.log(1 - hit)))
    return tries, max(SHOWN, -(-tries // (64 // BITS)))


class BestForest:
    """Links (i, j, weight) among n members, thinned to a spanning forest of largest weights."""

    def __init__(self, n: int) -> None:
        self.n, self.held, self.size = n, [], 0

    def add(self, i: np.ndarray, j: np.ndarray, weight: np.ndarray) -> None:
        self.held.append((i, j, weight))
        self.size += len(i)
        if self.size > HELD:
            self.held = [self.links()]
            self.size = len(self.held[0][0])

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Boruvka's rounds: every component takes its best link to another one; ties go by the places of the link."""
        if not self.held:
            empty = np.zeros(0, np.int64)
            return empty, empty, np.zeros(0)
        i, j, w = (np.concatenate([h[k] for h in self.held]) for k in range(3))
        i, j = np.minimum(i, j), np.maximum(i, j)
        order = np.lexsort((j, i, -w))
        i, j, w = i[order], j[order], w[order]
        root, taken = np.arange(self.n), np.zeros(len(i), bool)
        alive = np.arange(len(i))
        while True:
            a, b = root[i[alive]], root[j[alive]]
            apart = a != b
            alive, a, b = alive[apart], a[apart], b[apart]
            if not len(alive):
                return i[taken], j[taken], w[taken]
            best = np.full(self.n, len(i))
            np.minimum.at(best, a, alive)
            np.minimum.at(best, b, alive)
            chosen = np.unique(best[best < len(i)])
            taken[chosen] = True
            a, b = root[i[chosen]], root[j[chosen]]
            up = np.arange(self.n)
            while True:  # join the chosen components; the order of links is total, so they form no cycle
                a, b = up[a], up[b]
                differ = a != b
                if not differ.any():
                    break
                a, b = a[differ], b[differ]
                np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
                while (more := up[up]).tobytes() != up.tobytes():
                    up = more
            root = up[root]


def estimate(sigs: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Jaccard similarity as the bits of both signatures and the sizes of both sets give it."""
    differ = np.bitwise_count(sigs[i] ^ sigs[j]).sum(1, dtype=np.int64) / (64 * sigs.shape[1])
    a, b = sizes[i].astype(float), sizes[j].astype(float)
    both = np.cos(np.pi * differ) * np.sqrt(a * b)
    return np.where((a == 0) & (b == 0), 1.0, both / np.maximum(a + b - both, 1e-9))


def crowd_links(sigs: np.ndarray, sizes: np.ndarray, members: np.ndarray, least: float, linked) -> None:
    """Links that connect all members of estimated similarity `least`, without comparing all pairs.

    A member that hasn't been compared and lies outside the largest component is compared with all others, until there is
    none. Members of the largest component needn't be: their links among each other connect nothing new, and those to
    others were found from the others.
    """
    comp, open_ = np.arange(len(members)), np.ones(len(members), bool)
    while True:
        labels, sizes_ = np.unique(comp, return_counts=True)
        left = np.flatnonzero(open_ & (comp != labels[np.argmax(sizes_)])) if len(labels) > 1 else []
        if not len(left):
            return
        hub = int(left[0])
        open_[hub] = False
        others = np.flatnonzero(comp != comp[hub])
        near = estimate(sigs, sizes, np.full(len(others), members[hub]), members[others])
        hit = near >= least
        if hit.any():
            linked(np.full(int(hit.sum()), members[hub]), members[others[hit]], near[hit])
            comp[np.isin(comp, comp[others[hit]])] = comp[hub]


def _candidates(bits: int, least: float):
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _node_tables(batches, 100_000):
            node, values, ids = table["node"].to_numpy(), table["value"].to_numpy().view(np.uint64), table["id"].to_numpy()
            sigs = table["signature"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, SHOWN)
            sizes = table["size"].to_numpy()
            forest = BestForest(len(ids))

            def linked(i: np.ndarray, j: np.ndarray) -> None:
                near = estimate(sigs, sizes, i, j)
                hit = near >= least
                forest.add(i[hit], j[hit], near[hit])

            starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            ends = np.r_[starts[1:], len(node)]
            pairs = np.stack([starts, ends, starts, ends, np.zeros(len(starts), np.int64)], 1)
            trie_join(values, pairs, bits // 2, 1, linked, bits, lambda members: crowd_links(sigs, sizes, members, least, forest.add))  # noqa: B023
            i, j, _ = forest.links()
            yield pa.record_batch([pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j]))], ["u", "v"])

    return joined


def candidates(leaves: DataFrame, similarity: float, recall: float = RECALL) -> DataFrame:
    """Pairs (u, v), u < v, that connect whatever all candidates connect. leaves: id, signature, size."""
    bits, (tries, _) = BITS, plan(similarity, recall)
    per = 64 // bits
    piece = lambda t: F.shiftrightunsigned(F.shiftleft(F.element_at("every", t // per + 1), bits * (t % per)), 64 - bits)
    p = angle(similarity)
    widest = min(0.45, p + SLACK * math.sqrt(p * (1 - p) / (64 * SHOWN)))
    cosine = math.cos(math.pi * widest)
    shown = leaves.select("id", "size", F.slice("signature", 1, SHOWN).alias("signature"), F.col("signature").alias("every"))
    nodes = entered(shown, [piece(t) for t in range(tries)], bits, 1, "size")
    crowded = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > NODE_ROWS)
    large = written(crowded.select("node", F.ceil(2 * F.col("n") / NODE_ROWS).cast("int").alias("blocks")))
    if n_large := large.count():
        split = nodes.join(F.broadcast(large) if n_large <= HOT_KEYS else large, "node", "left").withColumn("own", F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1))))
        other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("other")
        both = F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other"))
        nodes = split.select("*", other).withColumn("node", F.when(F.col("blocks").isNotNull(), both).otherwise(F.col("node")))
    nodes = nodes.select("node", "value", "id", "signature", "size")
    dealt = nodes.repartition(partitions(leaves.sparkSession), "node").sortWithinPartitions("node", F.col("value").bitwiseXOR(F.lit(-(1 << 63))))
    return dealt.mapInArrow(_candidates(bits, cosine / (2 - cosine)), "u bigint, v bigint").distinct()


def verified(pairs: DataFrame, sets: DataFrame, n_pairs: int, similarity: float) -> DataFrame:
    """The pairs, and `near`: whether their sets have at least that exact Jaccard similarity. sets: id, shingles (distinct), one
    row an id."""

    def with_set(rows: DataFrame, end: str) -> DataFrame:
        counted = pairs.groupBy(end).agg(F.count(F.lit(1)).alias("n"))
        other = "v" if end == "u" else "u"
        return spread_join(rows, sets.select(F.col("id").alias(end), F.col("shingles").alias(f"set_{end}")), [end], hot_keys(counted, [end], n_pairs), [other])

    both = with_set(with_set(pairs, "u"), "v")
    shared = F.size(F.array_intersect("set_u", "set_v"))
    union = F.size("set_u") + F.size("set_v") - shared
    return both.select("u", "v", ((union == 0) | (shared >= F.lit(similarity) * union)).alias("near"))


def exact_links(ids: np.ndarray, labels: np.ndarray, largest: int, sets: list[np.ndarray], apart: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links that connect all members of that exact similarity; labels tell what is linked already.

    Each member marked `apart` is compared with all that it isn't linked to, as long as it isn't linked to the label `largest`:
    members of that needn't be compared, as links to others are found from the others.
    """
    names, comp = np.unique(np.r_[labels, largest], return_inverse=True)
    comp, home = comp[:-1], int(comp[-1])
    up = np.arange(len(names))  # the component of each label
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    tokens = np.concatenate(sets) if len(sets) else np.zeros(0, np.int32)
    order = np.argsort(tokens, kind="stable")
    vocabulary, starts = np.unique(tokens[order], return_index=True)
    owner, ends = owner[order], np.r_[starts[1:], len(tokens)]
    out = []
    for k in np.flatnonzero(apart).tolist():
        mine = up[comp[k]]
        if mine == up[home]:
            continue
        at = np.searchsorted(vocabulary, sets[k])
        lists = [owner[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]
        shared = np.bincount(np.concatenate(lists) if lists else np.zeros(0, np.int64), minlength=len(sets))
        union = sizes + sizes[k] - shared
        other = up[comp]
        near = np.flatnonzero((other != mine) & ((union == 0) | (shared >= similarity * union)))
        met, first = np.unique(other[near], return_index=True)
        out += [(int(ids[k]), int(ids[m])) for m in near[first].tolist()]
        up[np.isin(up, met)] = mine
    return out


def _exact_task(similarity: float):
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _node_tables(batches, 1):
            node = table["node"].to_numpy()
            ids, labels, largest, apart = (table[c].to_numpy() for c in ("id", "label", "largest", "apart"))
            edges = np.flatnonzero(np.r_[True, node[1:] != node[:-1], True]).tolist()
            shingles = table["shingles"].combine_chunks()
            flat, offsets = shingles.values.to_numpy(), shingles.offsets.to_numpy()
            links = []
            for a, b in zip(edges[:-1], edges[1:]):
                sets = [flat[x:y] for x, y in zip(offsets[a:b].tolist(), offsets[a + 1 : b + 1].tolist())]
                links += exact_links(ids[a:b], labels[a:b], int(largest[a]), sets, apart[a:b] == 1, similarity)
            yield pa.record_batch([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["u", "v"])

    return joined


def mended(judged: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The verified links (u, v), and those that refuted ones hid. judged: u, v, near; sets: id, shingles.

    Components that a refuted link would have joined are one lot. In a lot every text outside the largest component is
    compared exactly with all texts of other components: they are dealt in blocks, of which each pair meets in a task.
    """
    good, refuted = judged.filter("near").select("u", "v"), judged.filter("NOT near").select("u", "v")
    n_refuted = refuted.count()
    if not n_refuted:
        return good
    found = components(good)
    placed = sets.select("id", F.size("shingles").alias("size")).join(found, F.col("id") == found["node"], "left")
    placed = written(placed.select("id", "size", F.coalesce("component", "id").alias("label")))

    def of_end(rows: DataFrame, end: str, other: str) -> DataFrame:
        hot = hot_keys(refuted.groupBy(end).agg(F.count(F.lit(1)).alias("n")), [end], n_refuted)
        return spread_join(rows, placed.select(F.col("id").alias(end), F.col("label").alias(f"label_{end}")), [end], hot, [other])

    cut = of_end(of_end(refuted, "u", "v"), "v", "u").select(F.col("label_u").alias("u"), F.col("label_v").alias("v")).filter("u != v")
    lots = written(components(cut).select(F.col("node").alias("label"), F.col("component").alias("lot")))
    if lots.isEmpty():
        return good
    n = placed.count()
    by_label = placed.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    members = written(spread_join(placed, lots, ["label"], hot_keys(by_label, ["label"], n), ["id"]))
    of_label = members.groupBy("lot", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    largest = F.max(F.struct("n", "label", "size")).alias("most")
    of_lot = of_label.groupBy("lot").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), largest)
    blocks = lambda size: F.greatest(F.lit(1), F.ceil(size / BLOCK_SHINGLES)).cast("int")
    of_lot = written(of_lot.select("lot", "n", F.col("most.label").alias("largest"), blocks(F.col("size")).alias("every"), blocks(F.col("size") - F.col("most.size")).alias("outer")))
    known = spread_join(members, of_lot.drop("n"), ["lot"], hot_keys(of_lot, ["lot"], n), ["id"])
    own = lambda of, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(of)).cast("int")
    every = lambda of: F.sequence(F.lit(0), F.col(of) - 1)
    place = lambda a, b, apart: F.struct(F.xxhash64("lot", a, b).alias("node"), F.lit(apart).alias("apart"))
    met = lambda others: F.transform(others, lambda b: place(own("every", 0), b, 0))
    apart = F.transform(every("every"), lambda a: place(a, own("outer", 1), 1))
    twice = F.filter(every("outer"), lambda b: b != own("outer", 1))
    places = F.when(F.col("label") == F.col("largest"), met(every("outer"))).otherwise(F.concat(apart, met(twice)))
    rows = known.join(sets, "id").select("id", "label", "largest", "shingles", F.explode(places).alias("p")).select("*", "p.node", "p.apart")
    tasks = rows.repartition(partitions(judged.sparkSession), "node").sortWithinPartitions("node", "id")
    more = written(tasks.select("node", "id", "label", "largest", "apart", "shingles").mapInArrow(_exact_task(similarity), "u bigint, v bigint"))
    return good.unionByName(more)


def _key(docs: DataFrame):
    text = text_of()
    return F.struct(docs["doc_id"].alias("doc_id"), F.xxhash64(text).alias("h"), F.xxhash64(text, F.lit(1)).alias("g"))


def near_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, recall: float = RECALL) -> DataFrame:
    """key (doc_id and two hashes of the text) and group, for every distinct key: texts linked by verified similarity."""
    _, length = plan(similarity, recall)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs, sets = [], []
            for t in batch.column("text").to_pylist():
                h = np.unique(shingle_hashes(t, words))
                sigs.append([_signed(majority(_mixed(h, k))) if len(h) else 0 for k in range(length)])
                sets.append(np.unique(h.astype(np.uint32)).view(np.int32))
            yield pa.record_batch([batch.column("h"), batch.column("g"), pa.array(sigs, pa.list_(pa.int64())), pa.array(sets, pa.list_(pa.int32()))], ["h", "g", "signature", "shingles"])

    keys = written(docs.select(_key(docs).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    texts = docs.select(F.col("text"), _key(docs).alias("key")).select("key.h", "key.g", text_of().alias("text"))
    prints = texts.mapInArrow(made, "h bigint, g bigint, signature array<bigint>, shingles array<int>")
    rows = written(prints)
    leaves = written(rows.groupBy("h", "g").agg(F.first("signature").alias("signature"), F.first(F.size("shingles")).alias("size")).withColumn("id", F.monotonically_increasing_id()))
    pairs = written(candidates(leaves, similarity, recall))
    ends = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    named = leaves.select("id", "h", "g").join(ends, "id", "left_semi")
    sets = written(rows.join(named, ["h", "g"]).groupBy("id").agg(F.first("shingles").alias("shingles")))
    forget(rows)
    judged = written(verified(pairs, sets, pairs.count(), similarity))
    found = components(mended(judged, sets, similarity))
    groups = leaves.join(found, leaves["id"] == found["node"], "left").select("h", "g", F.coalesce("component", "id").alias("group"))
    counted = keys.groupBy("key.h", "key.g").agg(F.count(F.lit(1)).alias("n"))
    placed = keys.select("key", "key.h", "key.g")
    return spread_join(placed, groups, ["h", "g"], hot_keys(counted, ["h", "g"], keys.count()), ["key"]).select("key", "group")


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of `docs`, all columns, one of each group: that of least doc_id (then by the hash of its text)."""
    groups = written(near_groups(docs, words, similarity))
    order = F.struct(F.col("key.doc_id").isNull().alias("without"), F.col("key"))
    keepers = groups.groupBy("group").agg(F.min(order)["key"].alias("key")).select("key")
    columns = docs.columns
    row = F.struct(*(F.col(f"`{c}`") for c in columns))
    rows = docs.select(_key(docs).alias("key"), row.alias("row"), F.xxhash64(*(F.col(f"`{c}`") for c in columns)).alias("order"))
    one = rows.groupBy("key").agg(F.min_by("row", "order").alias("row"))
    kept = one.join(keepers.hint("merge"), "key", "left_semi")
    return kept.select(*(F.col(f"row.`{c}`").alias(c) for c in columns))
