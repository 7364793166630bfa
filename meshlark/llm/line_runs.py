"""Line dedup by repeated runs of lines, cut at every line.

Every two adjacent lines are a window; windows are cut at every line, so a boundary depends on nothing around it. A window
with a word that occurs at an earlier place too (a smaller doc_id, or further up) is a repeat, and its two lines go. Windows
that follow one another and repeat the same earlier passage make a run, so a passage of two lines or more goes from its first
line to its last, whatever stands around it. The first place of every line stays, so no line is lost altogether.

Hashes alone travel first; only runs send their bytes, and each line of a run is compared with that of the earlier place.
Counts and first places are found with partial aggregates. The places of a window, or the copies of a run, that are very many
meet their first place in several tasks: the rows are dealt by a hash and the one row that they meet goes to each of them. So
a window that a third of all documents share costs no task more than its share.

Native: DataFrame and SQL functions only. Defined results: a null text stays null and has no lines; single lines, and windows
without any word, are no repeats; of rows with an equal doc_id and text, all lose the same lines; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from meshlark.llm.common import WORD, hot_keys, spread_join, written
from meshlark.llm.line_chunks import keyed


def windows(rows: DataFrame) -> DataFrame:
    """key, start, hash, size of every two adjacent lines that hold a word."""
    split = rows.filter(F.instr("text", "\n") > 0).select("key", F.split("text", "\n", -1).alias("lines"))
    after = lambda i: F.get("lines", i + 1)
    made = F.transform("lines", lambda x, i: F.struct(F.xxhash64(x, after(i)).alias("hash"), (F.octet_length(x) + F.octet_length(after(i))).alias("size"), (x.rlike(WORD) | after(i).rlike(WORD)).alias("word")))
    each = split.select("key", made.alias("windows"), F.size("lines").alias("n")).select("key", "n", F.posexplode_outer("windows").alias("start", "w"))
    return each.filter((F.col("start") < F.col("n") - 1) & F.col("w.word")).select("key", "start", "w.hash", "w.size")


def lost_lines(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """key, lost: the numbers of the removed lines of a row; only rows that lose one. rows: keyed(docs).

    Texts meet their runs by key in a merge join, as they do in dedup_texts(): one shuffle of `rows` serves both.
    """
    places = written(windows(keyed(docs)))
    first = written(places.groupBy("hash", "size").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "start")).alias("first")).filter("n > 1"))
    hot = hot_keys(first, ["hash", "size"], places.count())
    again = spread_join(places, first.drop("n"), ["hash", "size"], hot, ["key", "start"]).filter(F.struct("key", "start") != F.col("first"))
    apart = again.select("key", "start", F.col("first.key").alias("origin"), (F.col("start") - F.col("first.start")).alias("delta"))
    starts = apart.groupBy("key", "origin", "delta").agg(F.array_sort(F.collect_set("start")).alias("starts"))
    at = F.array_sort(F.array_union("starts", F.transform("starts", lambda s: s + 1)))
    runs = written(starts.select("key", "origin", "delta", F.transform(at, lambda i: i - F.col("delta")).alias("at")))
    copies = runs.select(F.col("key"), F.struct("origin", "at", "delta").alias("w"))
    origins = runs.select(F.col("origin").alias("key"), F.struct("origin", "at", F.lit(None).cast("int").alias("delta")).alias("w")).distinct()
    by_row = copies.unionByName(origins).groupBy("key").agg(F.collect_list("w").alias("wanted"))
    split = rows.join(by_row.hint("merge"), "key").select("key", "wanted", F.split("text", "\n", -1).alias("lines"))
    found = split.select("key", "lines", F.explode("wanted").alias("w")).select("key", "lines", "w.origin", "w.at", "w.delta")
    place = lambda i: i + F.coalesce("delta", F.lit(0))
    bodies = found.select("key", "origin", "at", "delta", F.transform("at", lambda i: F.get("lines", place(i))).alias("body"))
    original = bodies.filter("delta IS NULL").groupBy("origin", "at").agg(F.first("body").alias("original"))
    copied = runs.groupBy("origin", "at").agg(F.count(F.lit(1)).alias("n"))
    both = spread_join(bodies.filter("delta IS NOT NULL"), original, ["origin", "at"], hot_keys(copied, ["origin", "at"], runs.count()), ["key", "delta"], "merge")
    good = F.transform(F.filter(F.arrays_zip("at", "body", "original"), lambda x: x["body"] == x["original"]), lambda x: x["at"])
    paired = F.filter(good, lambda i: F.array_contains(good, i - 1) | F.array_contains(good, i + 1))  # after a collision only
    same = both.select("key", "delta", F.when(F.col("body") == F.col("original"), F.col("at")).otherwise(paired).alias("at"))
    return same.select("key", F.transform("at", lambda i: i + F.col("delta")).alias("some")).groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("some"))).alias("lost"))


def _cut(joined: DataFrame) -> tuple[DataFrame, Column, Column, Column]:
    """joined(whole, lost) with its lines; the kept text, the lines of `whole`, and the lines removed."""
    cut = joined.withColumn("lines", F.when(F.col("lost").isNotNull(), F.split("whole", "\n", -1)))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "lost")
    text = F.when(F.col("lost").isNull(), F.col("whole")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
    n_lines = F.coalesce(F.length("whole") - F.length(F.replace(F.col("whole"), F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    n_removed = F.when(F.col("lost").isNull(), 0).otherwise(F.size("lost")).cast("long")
    return cut, text, n_lines, n_removed


def dedup_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text as it is kept, n_lines and n_removed (lines)."""
    rows = keyed(docs)
    joined = rows.join(lost_lines(docs, rows).hint("merge"), "key", "left").withColumnRenamed("text", "whole")
    cut, text, n_lines, n_removed = _cut(joined)
    return cut.select("key.doc_id", text.alias("text"), n_lines.alias("n_lines"), n_removed.alias("n_removed"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, with `text` as it is kept; n_chars, where there is one, follows a changed text."""
    rows = docs.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("key"), F.struct(*docs.columns).alias("row"))
    joined = rows.join(lost_lines(docs, keyed(docs)).hint("merge"), "key", "left").withColumn("whole", F.col("row.text"))
    cut, text, _, n_removed = _cut(joined)
    done = cut.select("row", text.alias("text"), n_removed.alias("n_removed"))
    own = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        n_chars = F.char_length("text").cast(dict(docs.dtypes)["n_chars"])
        own["n_chars"] = F.when(F.col("n_removed") > 0, n_chars).otherwise(F.col("row.n_chars")).alias("n_chars")
    return done.select(*(own[c] if c in own else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
