"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Documents and virtual nodes hash onto a ring of CELLS cells; a document's home is the first virtual node clockwise. Every
shard has a bound, the mean load rounded down or up, and what overflows a full shard goes on clockwise to the next one with
room. Home documents go first, so only the overflow moves. The plan needs one count a cell (at most CELLS, whatever the
corpus) and is made on the driver; documents take their shard from their rank in their cell. A cell of very many documents,
such as that of all rows without a doc_id, is ranked in lots, which several tasks share.

Native: DataFrame and SQL functions only. Defined results: a null text has size 1 and the checksum of no bytes; rows with
an equal doc_id, null among them, share a home and are ranked by checksum and size, equal rows as they come; a doc_id may
have any type that can be ordered; texts of any length are read whole; an empty table gives no rows. Reruns over the same
files agree.
"""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left

from pyspark.sql import DataFrame, Window, functions as F

from meshlark.llm.common import hot_keys, written

#: Cells of the ring, a power of two: the bound on what is collected and broadcast.
CELLS = 1 << 14
VIRTUAL = 64


def virtual_nodes(shards: int) -> list[tuple[int, int]]:
    """(cell, shard) in ring order; a shard's places don't depend on how many others there are."""
    place = lambda s, k: int.from_bytes(hashlib.blake2b(f"{s}/{k}".encode(), digest_size=8).digest(), "big") % CELLS
    return sorted((place(s, k), s) for s in range(shards) for k in range(VIRTUAL))


def plan(counts: dict[int, int], shards: int) -> list[tuple[int, int, int, int]]:
    """(cell, first rank, shard, first slot): the documents of a cell from that rank on go to that shard."""
    nodes = virtual_nodes(shards)
    cells = [c for c, _ in nodes]
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    filled = [0] * shards
    out, over = [], []
    for cell in sorted(counts):
        at = bisect_left(cells, cell) % len(nodes)
        s = nodes[at][1]
        take = min(counts[cell], room[s] - filled[s])
        if take:
            out.append((cell, 0, s, filled[s]))
            filled[s] += take
        if take < counts[cell]:
            over.append((cell, take, at))
    for cell, rank, at in over:
        while rank < counts[cell]:
            at = (at + 1) % len(nodes)
            s = nodes[at][1]
            take = min(counts[cell] - rank, room[s] - filled[s])
            if take:
                out.append((cell, rank, s, filled[s]))
                filled[s] += take
                rank += take
    return out


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32, shard, slot (gapless from 0). Shard counts are at most one apart."""
    spark = docs.sparkSession
    bits = CELLS.bit_length() - 1
    keyed = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - bits).cast("int").alias("cell"),
        F.monotonically_increasing_id().alias("row"),
    )
    keyed = written(keyed)  # no text: a few numbers a row, and equal rows told apart once and for all
    counted = written(keyed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")))
    counts = {r["cell"]: r["n"] for r in counted.collect()}
    hot = hot_keys(counted, ["cell"], sum(counts.values()))
    steps: dict[int, list] = {}
    for cell, rank, s, slot in plan(counts, shards):
        steps.setdefault(cell, []).append([rank, s, slot])
    text = json.dumps([{"cell": c, "steps": [{"rank": r, "shard": s, "slot": k} for r, s, k in sorted(x)]} for c, x in steps.items()])
    kind = "array<struct<cell:int,steps:array<struct<rank:bigint,shard:int,slot:bigint>>>>"
    table = spark.range(1).select(F.inline(F.from_json(F.lit(text), kind)))
    lot = F.coalesce(F.pmod(F.xxhash64("doc_id", "text_crc32", "size", "row"), F.col("salts")), F.lit(0)).cast("int").alias("lot")
    dealt = keyed.join(F.broadcast(hot), "cell", "left").select("doc_id", "size", "text_crc32", "cell", "row", lot)
    inside = Window.partitionBy("cell", "lot").orderBy("doc_id", "text_crc32", "size", "row")
    ranked = dealt.withColumn("at", F.row_number().over(inside).cast("long") - 1)
    if not hot.isEmpty():  # ranks of a lot follow those of the lots before it; at most as many rows as hot cells have lots
        lots = dealt.join(F.broadcast(hot.select("cell")), "cell", "left_semi").groupBy("cell", "lot").agg(F.count(F.lit(1)).alias("n"))
        before = Window.partitionBy("cell").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
        lots = lots.select("cell", "lot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
        ranked = ranked.join(F.broadcast(lots), ["cell", "lot"], "left").withColumn("at", F.col("at") + F.coalesce("ahead", F.lit(0)))
    step = F.element_at(F.filter("steps", lambda x: x["rank"] <= F.col("at")), -1)
    found = ranked.join(F.broadcast(table), "cell").withColumn("step", step)
    return found.select("doc_id", "size", "text_crc32", F.col("step.shard").alias("shard"), (F.col("step.slot") + F.col("at") - F.col("step.rank")).alias("slot"))
