"""Cell identities as Column expressions: indices, gid, packed id and URI.

A literal level unrolls into plain arithmetic that stays in whole-stage codegen. Bad input gives null, or fails the query
with mode="fail".
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from meshlark.errors import ContractError
from meshlark.functions.constants import ALPHABETS, CODE_BITS, COUNTS, MAX_LEVEL, ORIGIN, ROOT_SIDE, STEPS, cell_count, cell_side, check_level, path_width

URI_SCHEME = "cell"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def guarded(ok: Column, value: Column, mode: str, message: str) -> Column:
    """The value where `ok` holds; else null or, in mode fail, an error."""
    if mode not in ("null", "fail"):
        raise ContractError(f"mode must be null or fail, not {mode!r}")
    return F.when(ok, value) if mode == "null" else F.when(ok, value).otherwise(F.raise_error(F.lit(message)))


def axis_index(coordinate: Column | str, level: int) -> Column:
    """Cells are half open, and the root's far edge belongs to the last cell; null outside the root."""
    c, n = _col(coordinate), cell_count(level)
    inside = c.between(ORIGIN, ORIGIN + ROOT_SIDE)
    return F.when(inside, F.least(F.floor((c - F.lit(ORIGIN)) / F.lit(cell_side(level))), F.lit(n - 1).cast("long")))


def cell_of(x_m: Column | str, y_m: Column | str, level: int, mode: str = "null") -> tuple[Column, Column]:
    x, y = axis_index(x_m, level), axis_index(y_m, level)
    both = x.isNotNull() & y.isNotNull()
    return guarded(both, x, mode, "coordinate is outside the root square"), guarded(both, y, mode, "coordinate is outside the root square")


def _div(a: Column, b: int) -> Column:
    return a if b == 1 else F.call_function("div", a, F.lit(b).cast("long"))


def child_codes(x: Column | str, y: Column | str, level: int) -> list[Column]:
    """Places of a cell in its ancestors, two levels (10 x 10 children) at a time and a last single level (5 x 5).

    Half as many steps as levels keep the generated code small enough for the JVM to compile.
    """
    x, y, out = _col(x), _col(y), []
    for i in range(0, level - 1, 2):
        below = COUNTS[level] // COUNTS[i + 2]
        out.append((_div(y, below) % 10 * 10 + _div(x, below) % 10).cast("int"))
    if level % 2:
        out.append((y % 5 * 5 + x % 5).cast("int"))
    return out


#: For each place: its two letters and its seven bits; and a single level's letter.
_PAIRS = [(v // 20 * 5 + v % 10 // 2, v // 10 % 2 * 2 + v % 2) for v in range(100)]
_PAIR_LETTERS = [ALPHABETS[5][a] + ALPHABETS[2][b] for a, b in _PAIRS]
_PAIR_BITS = [a << 2 | b for a, b in _PAIRS]


def _table(values: list) -> Column:
    return F.array(*(F.lit(v) for v in values))


def gid_from_codes(codes: list[Column], level: int) -> Column:
    pairs, single = _table(_PAIR_LETTERS), _table(list(ALPHABETS[5]))
    return F.concat(*(F.get(pairs if i < level // 2 else single, c) for i, c in enumerate(codes))) if codes else F.lit("")


def packed_from_codes(domain_id: int | Column, codes: list[Column], level: int) -> Column:
    pairs, left = _table(_PAIR_BITS), path_width(level)
    domain = F.lit(domain_id << 54 | level << 50).cast("long") if isinstance(domain_id, int) else F.shiftleft(domain_id.cast("long"), 54).bitwiseOR(F.lit(level << 50))
    packed = domain
    for i, c in enumerate(codes):
        left -= 7 if i < level // 2 else 5
        bits = F.get(pairs, c) if i < level // 2 else c
        packed = packed.bitwiseOR(F.shiftleft(bits.cast("long"), left + 1))
    return packed


def indices_ok(x: Column, y: Column, level: int) -> Column:
    n = cell_count(level)
    return x.between(0, n - 1) & y.between(0, n - 1)


def gid_of(x: Column | str, y: Column | str, level: int) -> Column:
    """One character a level; the root is the empty string."""
    x, y = _col(x), _col(y)
    check_level(level)
    return F.when(indices_ok(x, y, level), gid_from_codes(child_codes(x, y, level), level))


def pack(domain_id: int | Column, x: Column | str, y: Column | str, level: int) -> Column:
    """domain in 9 bits, level in 4, path in 49, and a reserved bit 0."""
    x, y = _col(x), _col(y)
    domain = F.lit(domain_id) if isinstance(domain_id, int) else domain_id
    return F.when(indices_ok(x, y, level) & domain.between(1, 511), packed_from_codes(domain_id, child_codes(x, y, level), level))


GID_PATTERN = "^" + "".join(f"(?:[{ALPHABETS[s]}]" for s in STEPS) + ")?" * len(STEPS) + "$"


def gid_level(gid: Column | str) -> Column:
    """The level of a valid gid, else null."""
    g = _col(gid)
    return F.when(g.rlike(GID_PATTERN), F.length(g))


def gid_to_cell(gid: Column | str) -> Column:
    """struct(level, x_idx, y_idx) of a gid of any level; null if it isn't valid."""
    g = _col(gid)
    x = y = F.lit(0).cast("long")
    for i, step in enumerate(STEPS):
        weight = COUNTS[MAX_LEVEL] // COUNTS[i + 1]
        code = F.call_function("instr", F.lit(ALPHABETS[step]), F.substring(g, i + 1, 1)).cast("long") - 1
        present = F.length(g) > i
        x = x + F.when(present, code % step * weight).otherwise(F.lit(0))
        y = y + F.when(present, F.floor(code / step).cast("long") * weight).otherwise(F.lit(0))
    unit = F.element_at(F.array(*(F.lit(COUNTS[MAX_LEVEL] // c).cast("long") for c in COUNTS)), F.length(g) + 1)
    scaled = lambda v: F.floor(v / unit).cast("long")
    return F.when(gid_level(g).isNotNull(), F.struct(F.length(g).alias("level"), scaled(x).alias("x_idx"), scaled(y).alias("y_idx")))


def indices_of(gid: Column | str, level: int) -> tuple[Column, Column]:
    """x_idx and y_idx of a valid gid of a given level."""
    g, x, y = _col(gid), F.lit(0).cast("long"), F.lit(0).cast("long")
    for i, step in enumerate(STEPS[:level]):
        code = F.call_function("instr", F.lit(ALPHABETS[step]), F.substring(g, i + 1, 1)).cast("long") - 1
        weight = COUNTS[level] // COUNTS[i + 1]
        x, y = x + code % step * weight, y + F.floor(code / step).cast("long") * weight
    return x, y


def unpack(packed: Column | str, level: int) -> Column:
    """struct(domain_id, level, x_idx, y_idx) of a packed id of a given level; null if it isn't an exact one."""
    p = _col(packed)
    x = y = F.lit(0).cast("long")
    ok = (p >= 0) & (p.bitwiseAND(F.lit(1)) == 0) & (F.shiftright(p, 54) >= 1) & (F.shiftright(p, 50).bitwiseAND(F.lit(15)) == level)
    path = F.shiftright(p, 1).bitwiseAND(F.lit((1 << 49) - 1))
    ok = ok & (F.shiftright(path, path_width(level)) == 0)
    left = path_width(level)
    for step, bits, count in zip(STEPS[:level], CODE_BITS, COUNTS[1:]):
        left -= bits
        code = F.shiftright(path, left).bitwiseAND(F.lit((1 << bits) - 1))
        ok = ok & (code < step * step)
        weight = COUNTS[level] // count
        x, y = x + code % step * weight, y + F.floor(code / step).cast("long") * weight
    return F.when(ok, F.struct(F.shiftright(p, 54).cast("int").alias("domain_id"), F.lit(level).alias("level"), x.alias("x_idx"), y.alias("y_idx")))


def unpack_any(packed: Column | str) -> Column:
    """As unpack(), of whatever level the id says."""
    p = _col(packed)
    return F.coalesce(*(unpack(p, level) for level in range(MAX_LEVEL + 1)))


def uri_of(domain: str | Column, gid: Column | str, scheme: str = URI_SCHEME) -> Column:
    domain = F.lit(domain) if isinstance(domain, str) else domain
    return F.concat(F.lit(f"{scheme}:v2:"), domain, F.lit(":"), _col(gid))


def parse_uri(uri: Column | str, scheme: str = URI_SCHEME) -> Column:
    """struct(domain, gid) of a URI; null if it isn't one."""
    u = _col(uri)
    parts = F.split(u, ":", 4)
    return F.when(u.rlike(rf"^{scheme}:v2:[A-Z][A-Z0-9]{{0,15}}:[^:]*$"), F.struct(parts[2].alias("domain"), parts[3].alias("gid")))


def bounds_of(x: Column | str, y: Column | str, level: int) -> Column:
    side = cell_side(level)
    low = lambda v: F.lit(ORIGIN) + _col(v) * side
    return F.struct(low(x).alias("min_x"), low(y).alias("min_y"), (low(x) + side).alias("max_x"), (low(y) + side).alias("max_y"))


def descendant_range(domain_id: int, gid: str, level: int) -> tuple[int, int]:
    """The packed ids of a cell's descendants at a level are those from the first to the second number."""
    code = 0
    for char, step, bits in zip(gid, STEPS, CODE_BITS):
        if char not in ALPHABETS[step]:
            raise ContractError(f"{gid!r} is no gid")
        code = code << bits | ALPHABETS[step].index(char)
    below = path_width(level) - path_width(len(gid))
    if len(gid) > check_level(level):
        raise ContractError("a descendant can't be coarser than its cell")
    head = domain_id << 54 | level << 50
    return head | (code << below) << 1, head | (((code + 1) << below) - 1) << 1
