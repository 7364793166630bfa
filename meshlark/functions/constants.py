"""The grid: a square of 50 000 km, cut 5 x 5 and 2 x 2 in turn, fourteen levels deep."""

from __future__ import annotations

from meshlark.errors import ContractError

# Fixed values.
ROOT_SIDE = 50_000_000.0
ORIGIN = -25_000_000.0
STEPS = (5, 2, 5, 2, 5, 2, 5, 2, 5, 2, 5, 2, 5, 2)
ALPHABETS = {5: "23456789CEFGHJLMNPQRTVWXY", 2: "2345"}
MAX_LEVEL = 14

#: Cells along an edge at each level, and how many bits of a packed id each level takes.
COUNTS = [1]
for _step in STEPS:
    COUNTS.append(COUNTS[-1] * _step)
CODE_BITS = tuple(5 if s == 5 else 2 for s in STEPS)


def check_level(level: int, least: int = 0) -> int:
    if type(level) is not int or not least <= level <= MAX_LEVEL:
        raise ContractError(f"level must be an integer from {least} to {MAX_LEVEL}, not {level!r}")
    return level


def cell_count(level: int) -> int:
    return COUNTS[check_level(level)]


def cell_side(level: int) -> float:
    return ROOT_SIDE / cell_count(level)


def path_width(level: int) -> int:
    """Bits of a packed id's path at a level."""
    return sum(CODE_BITS[: check_level(level)])
