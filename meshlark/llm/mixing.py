"""Mixing sources to target weights by entropy balancing.

Among all ways to reweigh the words of a corpus so that every source reaches its target, and words lie in documents as long
as the corpus's own (the word-weighted mean of log size stays), entropy balancing takes the one nearest to the corpus: the
least relative entropy, with no rate above MOST. The dual of this problem is convex, and its solution tilts each document's
rate exponentially: rate = min(MOST, exp(lambda of its source + mu * its log size)). The constraint on length crosses all
sources and the bound bends every one, so there is no closed form; Newton's method solves the dual. The gradient and Hessian
need the corpus only through the words of each source and size, one table made once with partial sums; an iteration is one
aggregate over it. The Hessian is an arrow (each lambda meets itself and mu), so only sums over all sources come to the
driver, and the lambdas stay a distributed table however many sources there are. Iterations stop at TOLERANCE.
Sources whose target is MOST times their words have no freedom: their rate is MOST. The length constraint has a weak ridge,
since it can be out of reach, as when every source is a single document.

Rates become copies by systematic rounding along falling size, and the few words still missing are settled with single
documents, one for each size class and direction, as long as that lessens what is missing, and a last pair of them. Equal rows are counted first and dealt out at the end, so that no task holds them all;
(source, size) classes of very many rows are split into lots.

Native: DataFrame and SQL functions only. Defined results: a null or empty text has size 0 and takes 0 words (its row stays
once); null is a source of its own, last in order; rows with equal doc_id are rows of their own, and equal rows differ by
one copy at most; ties in size go by a hash of the row; texts of any length are read whole; further columns may have any
name; an empty table gives an empty mix. Reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from meshlark.llm.common import WORD, hot_keys, written

#: No document is taken more often, and no target exceeds this multiple of its source.
MOST = 3
#: Newton's iterations stop when no source misses its target, and the mean log size is missed, by more than this share.
TOLERANCE, MOST_STEPS, RIDGE = 1e-7, 60, 1e-3
#: Equal rows beyond which the rows of a group are dealt out by several tasks.
DEALT = 65_536


def groups_of(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Equal rows as one: at (struct of source and size), key (hashes of `columns`), doc_id and the number n of them."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    own = [F.col(f"`{c}`") for c in columns]
    key = F.struct(F.xxhash64(*own).alias("k"), F.xxhash64(F.lit(1), *own).alias("l"))
    rows = docs.select(F.struct("source", size.alias("size")).alias("at"), key.alias("key"), "doc_id")
    return rows.groupBy("at", "key", "doc_id").agg(F.count(F.lit(1)).alias("n"))


def targets_of(strata: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """A row for each source (as `of`, a struct): source_size, weight, target. strata: at, n.

    Weights go by the order of sources, whose places are counted by ranges of it. A target is weight * level, or MOST times
    the source's words; the level follows from what capped sources leave, and is raised until no further source is capped.
    """
    by_source = strata.groupBy(F.struct("at.source").alias("of")).agg(F.sum(F.col("n") * F.col("at.size")).alias("source_size"))
    ordered = written(by_source.orderBy(F.col("of.source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy(F.col("of.source").asc_nulls_last())
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    ranges = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    place = F.row_number().over(inside) - 1 + F.col("ahead")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    weighed = written(ordered.join(F.broadcast(ranges), "part").select("of", "source_size", weight.alias("weight")))
    most = F.col("source_size") * float(MOST)
    everything = weighed.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    words = float(everything["words"] or 0)
    level, capped = words / (everything["weight"] or 1.0), -1
    while True:
        over = most <= F.col("weight") * level
        state = weighed.agg(F.count(F.when(over, 1)).alias("capped"), F.sum(F.when(over, most).otherwise(0.0)).alias("given"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("free")).first()
        if state["capped"] == capped or not state["free"]:
            break
        capped, level = state["capped"], (words - state["given"]) / state["free"]
    return weighed.withColumn("target", F.least(F.col("weight") * level, most))


def _pair(of: Column, mu: float) -> tuple[Column, Column]:
    """The rate of a stratum, and whether it lies below its bound."""
    tilt = of + F.lit(mu) * F.col("z")
    return F.least(F.exp(F.least(tilt, F.lit(math.log(MOST)))), F.lit(float(MOST))), tilt < math.log(MOST)


def balanced(strata: DataFrame, targets: DataFrame) -> tuple[DataFrame, int]:
    """Rates of all strata (at, n, of, source_size, target, rate), and how many Newton steps they took."""
    log_size = F.log(F.col("at.size") + 1.0)
    base = strata.withColumn("of", F.struct("at.source")).join(targets, "of").withColumn("mass", (F.col("n") * F.col("at.size")).cast("double"))
    free = (F.col("mass") > 0) & (F.col("target") < MOST * F.col("source_size"))
    base = written(base.withColumn("free", free).withColumn("log_size", log_size))
    moments = base.filter("free").agg(F.sum("mass").alias("m"), F.sum(F.col("mass") * F.col("log_size")).alias("l"), F.sum(F.col("mass") * F.col("log_size") ** 2).alias("s")).first()
    mu, steps = 0.0, 0
    mean = spread = 0.0
    start = F.when(F.col("source_size") > 0, F.log(F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    lambdas = written(targets.filter("source_size > 0").select("of", start.alias("lambda")))
    if moments["m"]:
        mean = moments["l"] / moments["m"]
        spread = math.sqrt(max(0.0, moments["s"] / moments["m"] - mean**2)) or 1.0
        scaled = base.filter("free").withColumn("z", (F.col("log_size") - mean) / spread)
        total = targets.filter(F.col("target") < MOST * F.col("source_size")).agg(F.sum("target")).first()[0]
        while steps < MOST_STEPS:
            rate, below = _pair(F.col("lambda"), mu)
            word = F.col("mass") * rate
            bent = F.when(below, word).otherwise(0.0)
            each = scaled.join(lambdas, "of").groupBy("of").agg(
                (F.sum(word) - F.first("target")).alias("g"), F.first("target").alias("target"), F.sum(word * F.col("z")).alias("gz"), F.sum("mass").alias("mass"),
                F.sum(bent).alias("h"), F.sum(bent * F.col("z")).alias("c"), F.sum(bent * F.col("z") ** 2).alias("q"), F.first("lambda").alias("lambda"),
            ).withColumn("h", F.col("h") + 1e-6 * F.col("mass"))
            each = written(each)
            s = each.agg(
                F.sum("gz").alias("gz"), F.sum("q").alias("q"), F.sum(F.col("c") ** 2 / F.col("h")).alias("cc"), F.sum(F.col("c") * F.col("g") / F.col("h")).alias("cg"),
                F.max(F.abs("g") / F.col("target")).alias("worst"),
            ).first()
            gradient = s["gz"] + RIDGE * total * mu
            if s["worst"] <= TOLERANCE and abs(gradient) <= TOLERANCE * total:
                break
            step = (s["cg"] - gradient) / max(s["q"] + RIDGE * total - s["cc"], 1e-9 * total)
            step = max(-0.5, min(0.5, step))
            move = (-F.col("g") - F.col("c") * step) / F.col("h")
            lambdas = each.select("of", (F.col("lambda") + F.least(F.greatest(move, F.lit(-1.0)), F.lit(1.0))).alias("lambda"))
            mu, steps = mu + step, steps + 1
    z = (F.col("log_size") - mean) / (spread or 1.0)
    rated = base.withColumn("z", z).join(lambdas, "of", "left")
    rate = F.when(F.col("mass") == 0, 1.0).when(~F.col("free"), float(MOST)).otherwise(_pair(F.col("lambda"), mu)[0])
    # nine places: what the order of sums changes lies beyond, so reruns agree
    return rated.select("at", "n", "of", "source_size", "target", F.round(rate, 9).alias("rate")), steps


def mixed_groups(docs: DataFrame, columns: list[str], weights: tuple[int, ...]) -> DataFrame:
    """groups_of(docs) with source_size, target, rate, and `total`: the copies that the n equal rows get together."""
    groups = written(groups_of(docs, columns))
    strata = written(groups.groupBy("at").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups")))
    rated, _ = balanced(strata.drop("groups"), targets_of(strata, weights))
    # Where a stratum begins on the line of summed rates along falling size.
    falling = Window.partitionBy("of").orderBy(F.col("at.size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    based = written(rated.withColumn("begin", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(falling), F.lit(0.0))).drop("n"))
    hot = hot_keys(strata.select("at", F.col("groups").alias("n")), ["at"], groups.count())
    lot = F.coalesce(F.pmod(F.col("key.k"), F.col("salts")), F.lit(0)).cast("int").alias("lot")
    dealt = groups.join(F.broadcast(hot), "at", "left").select("at", "key", "doc_id", "n", lot)
    lots = dealt.groupBy("at", "lot").agg(F.sum("n").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("at").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lots = lots.withColumn("ahead", ahead).drop("n").join(based, "at")
    upto = F.sum("n").over(Window.partitionBy("at", "lot").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    placed = dealt.withColumn("upto", upto).join(lots, ["at", "lot"])
    mark = lambda n: F.floor(F.col("begin") + (F.col("ahead") + n) * F.col("rate") + 0.5)
    total = F.greatest(F.least(mark(F.col("upto")) - mark(F.col("upto") - F.col("n")), F.col("n") * MOST), F.lit(0)).cast("long")
    rounded = written(placed.select("at", "key", "doc_id", "n", "of", "source_size", "target", "rate", total.alias("total")))
    # What is missing, settled greedily from large to small with one document of each quarter octave and direction.
    size = F.col("at.size")
    missing = rounded.groupBy("of").agg(F.round(F.first("target") - F.sum(F.col("total") * size)).cast("long").alias("missing"))
    ways = F.explode(F.array(*(F.struct(F.lit(d).alias("delta")) for d in (1, -1)))).alias("way")
    offers = rounded.filter(size > 0).select("*", ways).filter((F.col("total") + F.col("way.delta")).between(F.lit(0), F.col("n") * MOST))
    best = F.max(F.struct(size.alias("size"), F.struct("at", "key", "doc_id").alias("who"))).alias("doc")
    offers = offers.groupBy("of", F.floor(4 * F.log2(size)).alias("class"), F.col("way.delta").alias("delta")).agg(best)
    offer = F.struct(F.col("doc.size").alias("size"), F.col("doc.who").alias("who"), F.col("delta").cast("long").alias("delta"))
    offers = offers.groupBy("of").agg(F.sort_array(F.collect_list(offer), asc=False).alias("offers")).join(missing, "of")
    used = F.filter("offers", lambda o: o["size"] < 0).alias("used")  # empty, of the right type
    state = F.struct(F.col("missing").alias("left"), used)
    use = lambda s, o: F.struct((s["left"] - o["delta"] * o["size"]).alias("left"), F.concat(s["used"], F.array(o)).alias("used"))
    step = lambda s, o: F.when(F.abs(s["left"] - o["delta"] * o["size"]) < F.abs(s["left"]), use(s, o)).otherwise(s)
    greedy = offers.select("offers", F.aggregate("offers", state, step).alias("s"))
    # What single documents leave, the best pair of the other offers lessens further: one more of one, one less of another.
    rest = F.filter("offers", lambda o: ~F.array_contains("s.used", o))
    miss = lambda a, b: F.abs(F.col("s.left") - a["delta"] * a["size"] - b["delta"] * b["size"])
    pair = F.array_min(F.transform("rest", lambda a: F.array_min(F.transform("rest", lambda b: F.struct(miss(a, b).alias("miss"), a.alias("a"), b.alias("b"))))))
    paired = greedy.withColumn("rest", rest).withColumn("best", F.when(F.col("s.left") != 0, pair))
    other = F.when((F.col("best.miss") < F.abs("s.left")) & (F.col("best.a") != F.col("best.b")), F.array("best.a", "best.b"))
    settled = paired.select(F.explode(F.concat("s.used", F.coalesce(other, F.filter("rest", lambda o: o["size"] < 0)))).alias("u"))
    changes = settled.groupBy(F.col("u.who").alias("who")).agg(F.sum("u.delta").alias("change"))
    done = rounded.withColumn("who", F.struct("at", "key", "doc_id")).join(changes, "who", "left")
    return done.withColumn("total", F.col("total") + F.coalesce("change", F.lit(0))).drop("who", "change")


def _repeated(groups: DataFrame, times: str, name: str) -> DataFrame:
    """Every row as often as `times` says, with `name` from 0; rows of very many are dealt out by several tasks."""
    most = groups.agg(F.max(times)).first()[0] or 0
    if most > DEALT:
        parts = F.explode(F.sequence(F.lit(0), F.floor((F.col(times) - 1) / DEALT))).alias("part")
        groups = groups.filter(F.col(times) > 0).select("*", parts).repartition("key", "part")
        low = F.col("part") * DEALT
        return groups.select("*", F.explode(F.sequence(low, F.least(low + DEALT, F.col(times)) - 1)).alias(name)).drop("part")
    return groups.filter(F.col(times) > 0).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1)).alias(name))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """A row for each document: doc_id, size, source, source_size, target, rate, copies, taken (= copies * size)."""
    groups = written(mixed_groups(docs, ["doc_id", "text", "source"], weights))
    rows = _repeated(groups, "n", "j")
    copies = (F.floor(F.col("total") / F.col("n")) + F.when(F.col("j") < F.col("total") % F.col("n"), 1).otherwise(0)).cast("long")
    size = F.col("at.size")
    return rows.select("doc_id", size.alias("size"), "at.source", "source_size", "target", "rate", copies.alias("copies"), (copies * size).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The rows of `docs`, all columns, each as often as the mix takes it."""
    groups = written(mixed_groups(docs, docs.columns, weights).select("key", "n", "total"))
    own = [F.col(f"`{c}`") for c in docs.columns]
    key = F.struct(F.xxhash64(*own).alias("k"), F.xxhash64(F.lit(1), *own).alias("l"))
    rows = docs.select(key.alias("key"), F.struct(*own).alias("row"))
    if (groups.agg(F.max("n")).first()[0] or 0) > 1:  # equal rows as one
        rows = rows.groupBy("key").agg(F.first("row").alias("row"))
    taken = _repeated(rows.join(groups.filter("total > 0").select("key", "total"), "key"), "total", "copy")
    return taken.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
