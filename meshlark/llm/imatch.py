"""Document fingerprints by I-Match over randomised lexicons.

A term counts if its inverse document frequency lies in a chosen band: words in too many documents say nothing, words in
too few are noise. Document frequencies are exact counts over all documents of 64-bit term hashes. At most
(distinct terms of a mean document) / (the band's least share) terms can lie in the band whatever the corpus, so the lexicon
is small; tasks get it as a bit map over the terms' low bits, SPARE bits wider than the lexicon needs, which lets a term
outside the band pass with a chance below 2 ** -SPARE, in every document alike. A document's terms in the band, distinct and
sorted, are hashed once for the whole lexicon and once for each of several random sub-lexicons; a small edit changes the
hashes of the sub-lexicons that hold a changed term and leaves the others. Sub-lexicons come in LEVELS of falling density, so
that short and long documents both have some that an edit spares: at each level a second hash deals the terms into many lots
and the first few are sub-lexicons.

The likeness of two fingerprints is the share of equal hashes among the sub-lexicons in which either has a term, from the
sparsest level up to the first by which ENOUGH of them do.

Native: DataFrame and SQL functions only. Defined results: a null text is empty; a text with no term in the band is
hashed over all its terms; texts without any term share a fingerprint; a null doc_id comes first; rows with an equal doc_id
are ordered by a hash of their text and each is next to the other; a doc_id may have any type that can be ordered; texts of
any length are read whole; an empty table gives an empty result. Texts go to ranges of (doc_id, hash of text), cut at rows
that a hash chooses, so that outlying or unevenly spread ids fill no range: only rows equal in both share one for certain.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from meshlark.llm.common import text_of, written

#: Bits of the map beyond those that number the lexicon's terms, and the bits of the smallest map.
SPARE, LEAST_BITS = 5, 16
#: Ranges of doc_id, at most about so many: their cuts and first rows are broadcast.
RANGES = 1 << 15
#: (lots, sub-lexicons) of each level, from dense to sparse; all terms are a further lexicon, the first.
LEVELS = ((8, 8), (32, 12), (128, 12), (512, 12))
ENOUGH = 6
#: The band: the least and the largest share of all documents that have a term.
BAND = (0.0002, 0.25)
_SPLIT = r"[\x20\x09-\x0D]+"


def terms_of(text: Column) -> Column:
    """Hashes of the distinct lower-case words of a text."""
    words = F.array_distinct(F.split(F.lower(text), _SPLIT))
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> tuple[Column, int]:
    """The bit map of the terms in the band, as a literal array of longs, and the number of low bits it reads."""
    present = docs.select(F.explode(terms_of(text_of())).alias("h"))
    counts = present.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    n = docs.count()
    inside = written(counts.filter(F.col("n").between(band[0] * n, band[1] * n)).select("h"))
    width = max(LEAST_BITS, math.ceil(math.log2(inside.count() + 1)) + SPARE)
    low = F.col("h").bitwiseAND(F.lit((1 << width) - 1))
    words = inside.select(low.alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(b & 63 AS INT))")).alias("bits"))
    bits = {r["w"]: r["bits"] for r in words.collect()}
    return F.split(F.lit(",".join(str(bits.get(w, 0)) for w in range(1 << (width - 6)))), ",").cast("array<bigint>"), width


def _in_band(lexicon: tuple[Column, int], h: Column) -> Column:
    bits, width = lexicon
    low = h.bitwiseAND(F.lit((1 << width) - 1))
    at = F.get(bits, F.shiftright(low, 6).cast("int"))
    return F.call_function("shiftrightunsigned", at, low.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1


def _code(terms: Column) -> Column:
    """16 bits of the hash of sorted terms; 0 for none."""
    return F.when(F.size(terms) == 0, F.lit(0)).otherwise(F.greatest(F.xxhash64(terms).bitwiseAND(F.lit(0xFFFF)), F.lit(1))).cast("int")


def _lot(h: Column, level: int, lots: int) -> Column:
    return F.shiftrightunsigned(h, 63 - 9 * (level + 1)).bitwiseAND(F.lit(lots - 1))


def with_codes(rows: DataFrame, text: str, codes: str, bits: tuple[Column, int]) -> DataFrame:
    """Adds the fingerprint of a text column: the code of the whole lexicon and of every sub-lexicon."""
    rows = rows.withColumn("_all", terms_of(F.col(text)))
    rows = rows.withColumn("_kept", F.array_sort(F.filter("_all", lambda h: _in_band(bits, h))))
    rows = rows.withColumn("_kept", F.when(F.size("_kept") == 0, F.array_sort("_all")).otherwise(F.col("_kept"))).drop("_all")
    parts = [F.array(_code(F.col("_kept")))]
    for k, (lots, n) in enumerate(LEVELS):
        rows = rows.withColumn(f"_level{k}", F.filter("_kept", lambda h: _lot(h, k, lots) < n))  # noqa: B023
    for k, (lots, n) in enumerate(LEVELS):
        chosen = lambda j: F.filter(f"_level{k}", lambda h: _lot(h, k, lots) == j)  # noqa: B023, E731
        parts.append(F.transform(F.array(*(F.lit(j) for j in range(n))), lambda j: _code(chosen(j))))  # noqa: B023
    return rows.withColumn(codes, F.concat(*parts)).drop("_kept", *(f"_level{k}" for k in range(len(LEVELS))))


def as_text(codes: str) -> Column:
    return F.array_join(F.transform(codes, lambda c: F.lpad(F.lower(F.hex(c)), 4, "0")), "")


def likeness(a: str, b: str) -> Column:
    """0 to 1: see the module."""
    marks = F.zip_with(a, b, lambda x, y: F.when((x == 0) & (y == 0), 0).when(x == y, 2).otherwise(1))
    starts = [1]
    for _, n in LEVELS:
        starts.append(starts[-1] + n)
    out = None
    for start in [0, *starts[:-1]]:  # from this level to the sparsest; the densest stands last in the chain of choices
        part = F.slice(marks, start + 1, starts[-1] - start)
        seen, same = F.size(F.filter(part, lambda m: m > 0)), F.size(F.filter(part, lambda m: m == 2))
        share = same / seen
        out = F.when(seen > 0, share).otherwise(F.lit(1.0)) if out is None else F.when(seen >= ENOUGH, share).otherwise(out)
    return out


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, h, text, place, last: rows in ranges of (doc_id, h), each followed by a copy of the row after its range.

    `place` is the range, `last` marks the copies. Cuts are the rows whose hash is divisible by a number that leaves about
    RANGES of them; a row finds its range by binary search.
    """
    rows = docs.select("doc_id", text_of().alias("text")).withColumn("h", F.xxhash64("text"))
    at = F.struct("doc_id", "h")
    spacing = max(64, docs.count() // RANGES)
    cuts = rows.filter(F.pmod(F.xxhash64("doc_id", "h"), F.lit(spacing)) == 0).agg(F.to_json(F.sort_array(F.collect_set(at))).alias("cuts"), F.count_distinct(at).alias("n")).first()
    table = F.from_json(F.lit(cuts["cuts"] or "[]"), f"array<struct<doc_id:{dict(docs.dtypes)['doc_id']},h:bigint>>")
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(max(1, cuts["n"].bit_length())))))
    step = lambda place, more: F.when(F.get(table, place + more) <= at, place + more).otherwise(place)
    rows = rows.withColumn("place", F.aggregate(steps, F.lit(-1), step))
    first = rows.select("place", at.alias("at")).groupBy("place").agg(F.min("at").alias("first"))
    before = Window.orderBy("place")  # a row for each range
    every = before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = first.withColumn("before", F.coalesce(F.lag("place").over(before), F.last("place").over(every)))
    joined = rows.join(F.broadcast(first), "place")
    stays = F.struct(F.col("place"), F.lit(False).alias("last"))
    goes = F.struct(F.col("before").alias("place"), F.lit(True).alias("last"))
    spread = F.explode(F.when(at == F.col("first"), F.array(stays, goes)).otherwise(F.array(stays))).alias("at")
    return joined.select("doc_id", "h", "text", spread).select("doc_id", "h", "text", "at.place", "at.last")


def edited_fingerprints(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """Fingerprints of every text and of an edit of it: its last quarter replaced from the start of the next document.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Texts are shuffled once.
    """
    bits = lexicon(docs, band)
    order = Window.partitionBy("place").orderBy("last", F.col("doc_id").asc_nulls_first(), "h", "text")
    rows = with_next(docs).withColumn("next_text", F.lead("text").over(order)).withColumn("n_chars", F.char_length("text").cast("long"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.when(~F.col("last"), F.concat(F.left("text", (F.col("n_chars") - quarter).cast("int")), F.left("next_text", quarter)))
    rows = rows.withColumn("edited", edited).withColumn("edited_sha256", F.sha2("edited", 256)).drop("next_text")
    rows = with_codes(rows, "text", "codes", bits)
    rows = with_codes(rows.withColumn("edited", F.coalesce("edited", F.lit(""))), "edited", "edited_codes", bits)
    narrow = rows.select("doc_id", "h", "place", "last", "text", "n_chars", "edited_sha256", "codes", "edited_codes")
    both = narrow.withColumn("next_codes", F.lead("codes").over(order)).filter(~F.col("last"))
    return both.select("doc_id", "n_chars", "edited_sha256", as_text("codes").alias("fingerprint"), as_text("edited_codes").alias("edited_fingerprint"), likeness("codes", "edited_codes").alias("near_edited"), likeness("codes", "next_codes").alias("near_next"))
