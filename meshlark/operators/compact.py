"""Mixed-level sets of cells in which no cell lies in another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from meshlark.errors import CompactSetError
from meshlark.functions import codec, topology
from meshlark.functions.constants import ALPHABETS, COUNTS, MAX_LEVEL, STEPS, check_level


def levels_of(rows: DataFrame, gid: str = "gid") -> list[int]:
    """The levels of a set, from one small aggregate: at most fifteen."""
    return sorted(r[0] for r in rows.select(F.length(gid)).distinct().collect() if r[0] is not None)


def ancestors_at(gid: str, levels: list[int], own: bool = False) -> Column:
    """The ancestors of a cell at some levels (with `own`, the cell itself where its level is one of them)."""
    g = F.col(gid)
    if not levels:
        return F.array().cast("array<string>")
    finer = (lambda n: F.length(g) >= n) if own else (lambda n: F.length(g) > n)
    return F.filter(F.array(*(F.when(finer(n), F.substring(g, 1, n) if n else F.lit("")) for n in levels)), lambda a: a.isNotNull())


def covered(cells: DataFrame, rows: DataFrame, gid: str = "gid") -> DataFrame:
    """The distinct gids of `cells` with a proper ancestor in `rows`: a hash semi-join on the ancestors at the levels that
    `rows` has, so that no key is shared by all cells unless it is in the set."""
    up = cells.select(gid, F.explode(ancestors_at(gid, levels_of(rows, gid))).alias("_a"))
    return up.join(rows.select(F.col(gid).alias("_a")).distinct(), "_a", "left_semi").select(gid).distinct()


def canonicalize(cells: DataFrame, gid: str = "gid") -> DataFrame:
    """gid, level: distinct valid cells, without those inside others, complete child groups replaced by their parent.

    Without cells inside others, areas add up: a cell is complete if the cells at or below it have its whole area, counted
    in cells of the last level. One aggregate over the ancestors finds every complete cell of every level, and those whose
    parent isn't complete are the result; there is no loop over levels. Levels so coarse that all cells together couldn't
    fill one cell of them are left out.
    """
    valid = cells.select(F.col(gid).alias("gid")).filter(codec.gid_level("gid").isNotNull()).distinct()
    held = valid.groupBy(F.length("gid").alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()
    if len(held) > 1:
        valid = valid.join(covered(valid, valid), "gid", "left_anti")
    leaves = lambda level: (COUNTS[MAX_LEVEL] // COUNTS[level]) ** 2
    whole = sum(r["n"] * leaves(r["level"]) for r in held)
    finest = max((r["level"] for r in held), default=0)
    levels = [n for n in range(finest + 1) if leaves(n) <= whole]
    area = F.element_at(F.array(*(F.lit(leaves(n)).cast("long") for n in range(MAX_LEVEL + 1))), F.length("gid") + 1)
    up = valid.select(area.alias("area"), F.explode(ancestors_at("gid", levels, own=True)).alias("gid"))
    complete = up.groupBy("gid").agg(F.sum("area").alias("covered")).filter(F.col("covered") == area).select("gid")
    below = complete.select(F.col("gid").alias("_p"))
    inside = complete.withColumn("_p", topology.parent_gid("gid"))
    return inside.join(below, "_p", "left_anti").select("gid", F.length("gid").alias("level"))


RULES = ("invalid", "level", "duplicate", "covered", "incomplete_promotion")


def violation_counts(rows: DataFrame) -> DataFrame:
    """One row: how many rows break each of RULES of a canonical set of (gid, level); nothing is counted on the driver."""
    one = rows.agg(
        F.count_if(codec.gid_level("gid").isNull()).alias("invalid"),
        F.count_if(F.col("level") != F.length("gid")).alias("level"),
        (F.count(F.lit(1)) - F.count_distinct("gid")).alias("duplicate"),
    )
    inside = covered(rows, rows).agg(F.count(F.lit(1)).alias("covered"))
    groups = rows.filter("level > 0").groupBy(topology.parent_gid("gid").alias("p"), "level").agg(F.count_distinct("gid").alias("n"))
    size = F.element_at(F.array(*(F.lit(s * s) for s in STEPS)), F.col("level"))
    full = groups.agg(F.count_if(F.col("n") == size).alias("incomplete_promotion"))
    key = F.lit(1).alias("_k")
    return one.select("*", key).join(inside.select("*", key), "_k").join(full.select("*", key), "_k").select(*RULES)


def violations(rows: DataFrame) -> dict[str, int]:
    return violation_counts(rows).first().asDict()


def validate(rows: DataFrame) -> None:
    bad = {k: n for k, n in violations(rows).items() if n}
    if bad:
        raise CompactSetError(f"not a canonical compact set: {bad}")


def expand(rows: DataFrame, level: int, gid: str = "gid", mode: str = "fail") -> DataFrame:
    """All distinct descendants at a level; a row finer than it fails (or is dropped with mode="null").

    Each level is one explode over its alphabet, and only the result is made distinct.
    """
    check_level(level)
    g = F.col(gid)
    ok = F.length(g) <= level
    cells = rows.select(codec.guarded(ok, g, mode, "a row is finer than the target level").alias("gid")).filter("gid IS NOT NULL")
    for at in range(level):
        more = F.array(*(F.lit(c) for c in ALPHABETS[STEPS[at]]))
        cells = cells.select(F.explode(F.when(F.length("gid") == at, F.transform(more, lambda c: F.concat("gid", c))).otherwise(F.array("gid"))).alias("gid"))
    return cells.distinct()


def member(cells: DataFrame, rows: DataFrame, gid: str = "gid") -> DataFrame:
    """`cells` with `in_set`: the cell or an ancestor is in the set."""
    up = cells.select(gid).distinct().select(gid, F.explode(ancestors_at(gid, levels_of(rows), own=True)).alias("_a"))
    inside = up.join(rows.select(F.col("gid").alias("_a")).distinct(), "_a", "left_semi").select(gid).distinct().withColumn("_in", F.lit(True))
    return cells.join(inside, gid, "left").withColumn("in_set", F.coalesce("_in", F.lit(False))).drop("_in")


def join_by_ancestor(cells: DataFrame, rows: DataFrame, gid: str = "gid") -> DataFrame:
    """Rows of `cells` with the row of the set that holds them (set_gid and its other columns); equal to expanding the set."""
    named = rows.select(*(F.col(f"`{c}`").alias("set_gid" if c == "gid" else f"set_{c}") for c in rows.columns))
    up = cells.select("*", F.explode(ancestors_at(gid, levels_of(rows), own=True)).alias("_a"))
    return up.join(named, up["_a"] == named["set_gid"]).drop("_a")


def join_by_expansion(cells: DataFrame, rows: DataFrame, level: int, gid: str = "gid") -> DataFrame:
    return cells.join(expand(rows, level).select(F.col("gid").alias(gid)), gid, "left_semi")
