"""DuckDB SQL for cell arithmetic: the oracle's own spelling, in integer division."""

from __future__ import annotations

from meshlark.functions.constants import ALPHABETS, CODE_BITS, COUNTS, STEPS, cell_count, cell_side

SCHEME = "cell"


def index(coordinate: str, level: int) -> str:
    return f"least(floor(({coordinate} + 25000000.0) / {cell_side(level)!r})::BIGINT, {cell_count(level) - 1})"


def codes(x: str, y: str, level: int) -> list[str]:
    return [f"((({y}) // {COUNTS[level] // COUNTS[i + 1]}) % {s}) * {s} + (({x}) // {COUNTS[level] // COUNTS[i + 1]}) % {s}" for i, s in enumerate(STEPS[:level])]


def gid(x: str, y: str, level: int) -> str:
    return " || ".join(f"substr('{ALPHABETS[s]}', CAST({c} + 1 AS INTEGER), 1)" for s, c in zip(STEPS, codes(x, y, level))) or "''"


def packed(domain_id: int, x: str, y: str, level: int) -> str:
    path, left = [], sum(CODE_BITS[:level])
    for bits, c in zip(CODE_BITS, codes(x, y, level)):
        left -= bits
        path.append(f"({c})::BIGINT * {1 << left}")
    return f"({domain_id << 54 | level << 50}::BIGINT + 2 * ({' + '.join(path) or '0'}))"


#: Points of orders anywhere in the root, and points of events crowded around its centre.
ORDERS = "(SELECT *, -25000000 + ((o_orderkey * 7919 + o_custkey * 104729) % 50000000) + 0.5 AS x_m, -25000000 + ((o_orderkey * 15485863 + o_custkey * 32452843) % 50000000) + 0.5 AS y_m FROM orders)"
EVENTS = "(SELECT *, ((event_id * 37) % 8000) - 4000.5 AS x_m, ((event_id * 53 + user_id) % 8000) - 4000.5 AS y_m FROM events)"


def cells(table: str, level: int, columns: str, domain_id: int = 1) -> str:
    return f"(SELECT {columns}, x_idx, y_idx, {gid('x_idx', 'y_idx', level)} AS gid, {packed(domain_id, 'x_idx', 'y_idx', level)} AS packed_id FROM (SELECT *, {index('x_m', level)} AS x_idx, {index('y_m', level)} AS y_idx FROM {table}))"
