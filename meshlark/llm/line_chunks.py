"""Line dedup by content-defined chunks of lines.

Every line is hashed, and a rolling hash over the hashes of the last WINDOW lines decides where a chunk ends, so that
boundaries depend on the lines around them and survive insertions elsewhere. A chunk of several lines that occurs more than
once in the corpus is kept at its first place (least doc_id, then least place in it) and removed elsewhere, after its bytes were
compared with those of the first place.

Hashes alone travel first; only chunks whose hash repeats send their bytes. Counts and first places are found with partial
aggregates, so a chunk that a third of all documents share costs no task more than its share.

Native: DataFrame and SQL functions only. Defined results: a null text stays null and has no lines; an empty text has no
chunk; chunks of one line, or without any word, are never removed; of rows with an equal doc_id and text, all lose the same
chunks; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from meshlark.llm.common import WORD, written

#: Lines under the rolling hash, and one in how many of its values marks a line. A chunk ends where a run of marks begins,
#: so that it has two lines at least, but for the end of a text, and four on average.
WINDOW, SPACING = 2, 2


def chunks(rows: DataFrame) -> DataFrame:
    """rows(key, text, ...): adds `chunks`, an array of (n_lines, body) that in order make up the text; null for null.

    Chunks are cut with string functions alone, so the work is linear in the text however many chunks it has: every line
    gets a bar before it and a chunk's first line another line break, which no line can hold, to split at. Chunks are to be
    exploded with the outer kind: for the other, Spark pushes a filter on the array down through its making.
    """
    split = rows.withColumn("_lines", F.split("text", "\n", -1))
    hashed = split.withColumn("_hashes", F.transform("_lines", lambda x: F.xxhash64(x)))
    rolling = lambda i: F.xxhash64(*(F.get("_hashes", i - k) for k in range(WINDOW)))
    marked = hashed.withColumn("_marks", F.transform("_lines", lambda _, i: (i >= WINDOW - 1) & (F.pmod(rolling(i), F.lit(SPACING)) == 0)))
    ends = lambda i: F.get("_marks", i) & ~F.coalesce(F.get("_marks", i - 1), F.lit(False))
    starts = lambda i: (i > 0) & F.coalesce(ends(i - 1), F.lit(False))
    coded = marked.withColumn("_coded", F.array_join(F.transform("_lines", lambda x, i: F.concat(F.when(starts(i), F.lit("\n|")).otherwise(F.lit("|")), x)), "\n"))
    n_lines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1
    body = lambda c: F.replace(F.substring(c, 2, 1 << 30), F.lit("\n|"), F.lit("\n"))
    made = coded.withColumn("chunks", F.transform(F.split("_coded", "\n\n", -1), lambda c: F.struct(n_lines(c).alias("n_lines"), body(c).alias("body"))))
    return made.drop("_lines", "_hashes", "_marks", "_coded")


def keyed(docs: DataFrame) -> DataFrame:
    """key and text; the key is the doc_id and a hash that tells rows apart that share it."""
    return docs.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("key"), "text")


def repeats(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """key, starts: the numbers of the removed chunks of a row; only rows that lose one. rows: keyed(docs).

    Texts meet their wanted chunks by key in a merge join, as they do in dedup_texts(): one shuffle of `rows` serves both.
    """
    each = chunks(keyed(docs).filter(F.instr("text", "\n") > 0)).select("key", F.posexplode_outer("chunks").alias("start", "c"))
    several = each.filter((F.col("c.n_lines") > 1) & F.col("c.body").rlike(WORD))
    places = written(several.select("key", "start", F.xxhash64("c.body").alias("hash"), F.octet_length("c.body").alias("size")))
    first = places.groupBy("hash", "size").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "start")).alias("first")).filter("n > 1").drop("n")
    wanted = written(places.join(first, ["hash", "size"]).select("key", "start", "first"))
    by_row = wanted.groupBy("key").agg(F.collect_set(F.struct("start", "first")).alias("wanted"))
    found = chunks(rows.join(by_row.hint("merge"), "key")).select("key", F.explode("wanted").alias("w"), "chunks")
    bodies = found.select("key", "w.start", "w.first", F.get("chunks", F.col("w.start"))["body"].alias("body"))
    origin = bodies.filter(F.struct("key", "start") == F.col("first")).select("first", F.col("body").alias("original")).distinct()
    same = bodies.filter(F.struct("key", "start") != F.col("first")).join(origin.hint("merge"), "first").filter("body = original")
    return same.groupBy("key").agg(F.array_sort(F.collect_set("start")).alias("starts"))


def _cut(joined: DataFrame, whole: Column) -> tuple[DataFrame, Column, Column, Column]:
    """joined(text, starts) with its chunks; the kept text, the lines of `whole`, and the lines removed."""
    cut = chunks(joined)
    kept = F.filter("chunks", lambda _, i: ~F.array_contains("starts", i))
    lost = F.filter("chunks", lambda _, i: F.array_contains("starts", i))
    text = F.coalesce(F.array_join(F.transform(kept, lambda c: c["body"]), "\n"), whole)
    n_lines = F.coalesce(F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    n_removed = F.coalesce(F.aggregate(lost, F.lit(0), lambda n, c: n + c["n_lines"]), F.lit(0)).cast("long")
    return cut, text, n_lines, n_removed


def dedup_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text as it is kept, n_lines and n_removed (lines)."""
    rows = keyed(docs)
    joined = rows.join(repeats(docs, rows).hint("merge"), "key", "left")
    joined = joined.select("key", F.col("text").alias("whole"), "starts", F.when(F.col("starts").isNotNull(), F.col("text")).alias("text"))
    cut, text, n_lines, n_removed = _cut(joined, F.col("whole"))
    return cut.select("key.doc_id", text.alias("text"), n_lines.alias("n_lines"), n_removed.alias("n_removed"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, with `text` as it is kept; n_chars, where there is one, follows a changed text."""
    rows = docs.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("key"), F.struct(*docs.columns).alias("row"))
    joined = rows.join(repeats(docs, keyed(docs)).hint("merge"), "key", "left").withColumn("text", F.when(F.col("starts").isNotNull(), F.col("row.text")))
    cut, text, _, n_removed = _cut(joined, F.col("row.text"))
    done = cut.select("row", text.alias("text"), n_removed.alias("n_removed"))
    own = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        n_chars = F.char_length("text").cast(dict(docs.dtypes)["n_chars"])
        own["n_chars"] = F.when(F.col("n_removed") > 0, n_chars).otherwise(F.col("row.n_chars")).alias("n_chars")
    return done.select(*(own[c] if c in own else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
