"""Hierarchy and neighbourhood of cells as Column expressions and row generators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from meshlark.errors import ContractError
from meshlark.functions.codec import _col
from meshlark.functions.constants import ALPHABETS, CODE_BITS, STEPS, cell_count, cell_side, check_level


def parent_indices(x: Column | str, y: Column | str, level: int) -> tuple[Column, Column]:
    check_level(level, 1)
    return tuple(F.floor(_col(v) / STEPS[level - 1]).cast("long") for v in (x, y))


def parent_gid(gid: Column | str) -> Column:
    """Null at the root."""
    g = _col(gid)
    return F.when(F.length(g) > 0, g.substr(F.lit(1), F.length(g) - 1))


def ancestor_gid(gid: Column | str, level: int) -> Column:
    """The gid's own prefix at a coarser level; null if the gid is coarser."""
    g = _col(gid)
    return F.when(F.length(g) >= level, F.substring(g, 1, level))


def ancestors(gid: Column | str, own: bool = False) -> Column:
    """All proper ancestors from the root on, with the cell itself last if asked for."""
    g = _col(gid)
    last = F.length(g) if own else F.length(g) - 1
    return F.when(last < 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: g.substr(F.lit(1), i)))


def child_gids(gid: Column | str) -> Column:
    """Children row by row from the south-west; null at the last level."""
    g = _col(gid)
    choices = {s: F.array(*(F.lit(c) for c in a)) for s, a in ALPHABETS.items()}
    fives = [i for i, s in enumerate(STEPS) if s == 5]
    suffixes = F.when(F.length(g).isin(fives), choices[5]).otherwise(choices[2])
    return F.when(F.length(g) < len(STEPS), F.transform(suffixes, lambda c: F.concat(g, c)))


def child_count(level: int) -> int:
    """Children of a cell at a level."""
    return STEPS[check_level(level)] ** 2 if level < len(STEPS) else 0


def children(df: DataFrame, x: str, y: str, level: int) -> DataFrame:
    """A row for each child of each row's cell: child_x, child_y."""
    if check_level(level) == len(STEPS):
        raise ContractError("the last level has no children")
    s = STEPS[level]
    steps = F.explode(F.sequence(F.lit(0), F.lit(s * s - 1))).alias("_c")
    return df.select("*", steps).select(*df.columns, (F.col(x) * s + F.col("_c") % s).alias("child_x"), (F.col(y) * s + F.floor(F.col("_c") / s)).cast("long").alias("child_y"))


def neighbour(x: Column | str, y: Column | str, level: int, dx: int, dy: int) -> tuple[Column, Column]:
    """Null outside the root."""
    n = cell_count(level)
    a, b = _col(x) + dx, _col(y) + dy
    inside = a.between(0, n - 1) & b.between(0, n - 1)
    return F.when(inside, a), F.when(inside, b)


def disk(df: DataFrame, x: str, y: str, level: int, k: int, ring: bool = False) -> DataFrame:
    """A row for each cell within (ring: at) Chebyshev distance k, clipped to the root, row by row: near_x, near_y."""
    if type(k) is not int or k < 0:
        raise ContractError("k must be an integer from 0")
    n, w = cell_count(level), 2 * k + 1
    steps = F.explode(F.sequence(F.lit(0), F.lit(w * w - 1))).alias("_k")
    dx, dy = F.col("_k") % w - k, F.floor(F.col("_k") / w).cast("long") - k
    out = df.select("*", steps)
    if ring:
        out = out.filter(F.greatest(F.abs(dx), F.abs(dy)) == k)
    out = out.select(*df.columns, (F.col(x) + dx).alias("near_x"), (F.col(y) + dy).alias("near_y"))
    return out.filter(F.col("near_x").between(0, n - 1) & F.col("near_y").between(0, n - 1))


def distance_m(x1: Column | str, y1: Column | str, x2: Column | str, y2: Column | str, level: int) -> Column:
    """Between centres of cells of one level."""
    return F.hypot((_col(x1) - _col(x2)).cast("double"), (_col(y1) - _col(y2)).cast("double")) * cell_side(level)


def packed_ancestor(packed: Column | str, level: int, to: int) -> Column:
    """The packed id of a cell's ancestor, by shifts alone."""
    if check_level(to) > check_level(level):
        raise ContractError("an ancestor can't be finer than its cell")
    p = _col(packed)
    drop = sum(CODE_BITS[to:level])
    path = F.shiftright(F.shiftright(p, 1).bitwiseAND(F.lit((1 << 49) - 1)), drop)
    return F.shiftleft(F.shiftright(p, 54), 54).bitwiseOR(F.lit(to << 50)).bitwiseOR(F.shiftleft(path, 1))
