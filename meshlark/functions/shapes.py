"""Plane geometry without dependencies: reading and writing shapes, clipping to squares, and predicates.

A shape is (kind, parts) with kind point, line or polygon; a polygon part is a list of rings, the first its outline. Rings
are arrays of (x, y). Parts may overlap and rings may cross themselves: what an odd number of a part's rings go round
belongs to it (see covered_area), and the shape is what any part covers.
"""

from __future__ import annotations

import json
import re
import struct

import numpy as np

from meshlark.errors import ContractError

Shape = tuple[str, list]
_NUMBERS = re.compile(r"[-+0-9.eE]+")


def _closed(ring: np.ndarray) -> np.ndarray:
    return ring if len(ring) and (ring[0] == ring[-1]).all() else np.concatenate([ring, ring[:1]])


def _from_coordinates(kind: str, c) -> Shape:
    at = lambda x: np.array(x, float).reshape(-1, np.shape(x)[-1] if len(x) else 2)[:, :2]
    if kind == "Point":
        return "point", [np.array(c[:2], float)] if len(c) else []
    if kind == "MultiPoint":
        return "point", [np.array(p[:2], float) for p in c]
    if kind == "LineString":
        return "line", [at(c)] if len(c) else []
    if kind == "MultiLineString":
        return "line", [at(x) for x in c if len(x)]
    if kind == "Polygon":
        return "polygon", [[_closed(at(r)) for r in c]] if len(c) else []
    if kind == "MultiPolygon":
        return "polygon", [[_closed(at(r)) for r in p] for p in c if len(p)]
    raise ContractError(f"geometry type {kind!r} is not supported")


def _merged(shapes: list[Shape]) -> Shape:
    kinds = {k for k, p in shapes if p}
    if len(kinds) > 1:
        raise ContractError("a collection must hold shapes of one kind")
    return (kinds.pop() if kinds else "polygon"), [x for _, p in shapes for x in p]


def from_geojson(doc: dict | str) -> Shape:
    """A geometry, a feature, or a collection of either."""
    doc = json.loads(doc) if isinstance(doc, str) else doc
    kind = doc.get("type")
    if kind == "Feature":
        return from_geojson(doc["geometry"])
    if kind == "FeatureCollection":
        return _merged([from_geojson(f) for f in doc["features"]])
    if kind == "GeometryCollection":
        return _merged([from_geojson(g) for g in doc["geometries"]])
    return _from_coordinates(kind, doc["coordinates"])


def from_wkt(text: str) -> Shape:
    m = re.match(r"\s*(?:SRID=\d+;)?\s*([A-Za-z]+)\s*(?:Z|M|ZM)?\s*(\(.*\)|EMPTY)\s*$", text, re.S)
    if not m:
        raise ContractError(f"not a WKT geometry: {text[:40]!r}")
    kind = {k.upper(): k for k in ("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon")}.get(m[1].upper())
    if m[2] == "EMPTY":
        return _from_coordinates(kind or m[1], [])
    body = re.sub(r"\(\s*([-+0-9.eE]+\s+[-+0-9.eE][-+0-9.eE\s]*)\)", r"(\1)", m[2])
    if kind == "MultiPoint":
        body = re.sub(r"\(\s*([-+0-9.eE ]+)\)", r"\1", body[1:-1])
        body = f"({body})"
    quoted = re.sub(r"([-+0-9.eE]+(?:\s+[-+0-9.eE]+)+)", lambda x: "[" + ",".join(x[1].split()) + "]", body)
    nested = json.loads(quoted.replace("(", "[").replace(")", "]"))
    return _from_coordinates(kind or m[1], nested[0] if kind == "Point" else nested)


def from_wkb(data: bytes) -> Shape:
    names = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}

    def read(at: int):
        order = "<" if data[at] else ">"
        code = struct.unpack_from(order + "I", data, at + 1)[0]
        at += 5
        dims = 2 + bool(code & 0x80000000 or 1000 <= code % 10000 < 2000 or code % 10000 >= 3000) + bool(code & 0x40000000 or 2000 <= code % 10000)
        if code & 0x20000000:
            at += 4
        kind = names.get((code & 0xFFFF) % 1000)

        def points(at: int, n: int):
            return np.frombuffer(data, order + "f8", n * dims, at).reshape(n, dims)[:, :2].astype(float), at + 8 * n * dims

        count = lambda at: struct.unpack_from(order + "I", data, at)[0]
        if kind == "Point":
            p, at = points(at, 1)
            return (kind, [] if np.isnan(p).any() else p[0]), at
        n, at = count(at), at + 4
        if kind == "LineString":
            p, at = points(at, n)
            return (kind, p), at
        if kind == "Polygon":
            rings = []
            for _ in range(n):
                k, at = count(at), at + 4
                p, at = points(at, k)
                rings.append(p)
            return (kind, rings), at
        parts = []
        for _ in range(n):
            p, at = read(at)
            parts.append(p)
        return (kind, parts), at

    def build(node) -> Shape:
        kind, c = node
        if kind == "GeometryCollection":
            return _merged([build(x) for x in c])
        return _from_coordinates(kind, [x[1] for x in c] if kind.startswith("Multi") else c)

    return build(read(0)[0])


def parse(value) -> Shape:
    if isinstance(value, (bytes, bytearray, memoryview)):
        return from_wkb(bytes(value))
    if isinstance(value, dict) or isinstance(value, str) and value.lstrip().startswith("{"):
        return from_geojson(value)
    if isinstance(value, str):
        return from_wkt(value)
    raise ContractError(f"no geometry in {type(value).__name__}")


def mapped(shape: Shape, f) -> Shape:
    """Every vertex through f(x, y)."""
    kind, parts = shape
    move = lambda a: np.stack(f(a[:, 0], a[:, 1]), 1)
    if kind == "point":
        return kind, [move(p[None])[0] for p in parts]
    return kind, [move(p) for p in parts] if kind == "line" else [[move(r) for r in p] for p in parts]


def wkt_polygon(ring: np.ndarray) -> str:
    return "POLYGON ((" + ", ".join(f"{x:.17g} {y:.17g}" for x, y in ring) + "))"


def wkb_polygon(ring: np.ndarray) -> bytes:
    return struct.pack("<BIII", 1, 3, 1, len(ring)) + np.asarray(ring, "<f8").tobytes()


def ring_area(r: np.ndarray) -> float:
    if len(r) < 3:
        return 0.0
    x, y = (r - r[0]).T
    return abs(float(np.dot(x[:-1], y[1:]) - np.dot(x[1:], y[:-1]))) / 2


def area(parts: list) -> float:
    return sum(ring_area(p[0]) - sum(map(ring_area, p[1:])) for p in parts)


_POINTS = ",".join([r"\s*([-+0-9.eE]+)\s+([-+0-9.eE]+)\s*"] * 5)
_FIVE = re.compile(r"\s*POLYGON\s*\(\(" + _POINTS + r"\)\)\s*")
_FIVES = re.compile(r"\s*MULTIPOLYGON\s*\((?:\s*\(\s*\(" + _POINTS.replace("([", "(?:[") + r"\)\s*\)\s*(?:,(?!\s*\)\s*$)|(?=\)\s*$)))+\)\s*")


def _rectangle(v: list[float]) -> tuple[float, float, float, float] | None:
    (ax, ay), (bx, by), (cx, cy), (dx, dy), end = zip(v[0::2], v[1::2])
    if end != (ax, ay) or not ((ay == by and bx == cx and cy == dy and dx == ax) or (ax == bx and by == cy and cx == dx and dy == ay)):
        return None
    return min(ax, cx), min(ay, cy), max(ax, cx), max(ay, cy)


def box_of(text) -> tuple[float, float, float, float] | None:
    """(low x, low y, high x, high y) of a WKT polygon that is one rectangle along the axes; None for all else."""
    m = _FIVE.fullmatch(text) if isinstance(text, str) else None
    return _rectangle([float(x) for x in m.groups()]) if m else None


def boxes_of(text) -> list[tuple[float, float, float, float]] | None:
    """box_of each part of a WKT polygon or multipolygon whose parts all are one rectangle along the axes; None for all else."""
    if box := box_of(text):
        return [box]
    if not isinstance(text, str) or not _FIVES.fullmatch(text):
        return None
    v = [float(x) for x in _NUMBERS.findall(text, text.index("("))]
    boxes = [_rectangle(v[k : k + 10]) for k in range(0, len(v), 10)]
    return None if None in boxes else boxes


def is_box(parts: list) -> bool:
    """One rectangle along the axes."""
    if len(parts) != 1 or len(parts[0]) != 1 or len(parts[0][0]) != 5:
        return False
    r = parts[0][0]
    step = r[1:] - r[:-1]
    return bool(((step[:, 0] == 0) != (step[:, 1] == 0)).all() and ((step[:-1, 0] == 0) != (step[1:, 0] == 0)).all())


def _crossings(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The heights at which segments a-b (rows) properly cross each other."""
    d = b - a
    out = []
    for k in range(len(a) - 1):
        rest = slice(k + 1, None)
        det = d[k, 0] * d[rest, 1] - d[k, 1] * d[rest, 0]
        ok = det != 0
        gap = a[rest] - a[k]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (gap[:, 0] * d[rest, 1] - gap[:, 1] * d[rest, 0]) / det
            u = (gap[:, 0] * d[k, 1] - gap[:, 1] * d[k, 0]) / det
        hit = ok & (t > 0) & (t < 1) & (u > 0) & (u < 1)
        if hit.any():
            out.append(a[k, 1] + t[hit] * d[k, 1])
    return np.concatenate(out) if out else np.zeros(0)


def is_tangled(parts: list) -> bool:
    """Parts may overlap (their boxes do), or a ring crosses itself."""
    boxes = [(p[0].min(0), p[0].max(0)) for p in parts if len(p[0])]
    for k, (low, high) in enumerate(boxes):
        for other_low, other_high in boxes[:k]:
            if (low < other_high).all() and (other_low < high).all():
                return True
    return any(len(r) > 4 and len(_crossings(r[:-1], r[1:])) > 0 for p in parts for r in p)


def covered_area(parts: list) -> float:
    """The area that any part covers, inside an odd number of its rings: slab by slab between the heights of vertices and
    crossings, where the covered stretches change linearly."""
    rings = [(k, r) for k, p in enumerate(parts) for r in p if len(r) > 2]
    if not rings:
        return 0.0
    a = np.concatenate([r[:-1] for _, r in rings])
    b = np.concatenate([r[1:] for _, r in rings])
    of = np.concatenate([np.full(len(r) - 1, k) for k, r in rings])
    heights = np.unique(np.concatenate([a[:, 1], b[:, 1], _crossings(a, b)]))
    total = 0.0
    for low, high in zip(heights[:-1].tolist(), heights[1:].tolist()):
        middle = (low + high) / 2
        up = (a[:, 1] <= middle) != (b[:, 1] <= middle)
        x = a[up, 0] + (middle - a[up, 1]) * (b[up, 0] - a[up, 0]) / (b[up, 1] - a[up, 1])
        spans = []
        for k in np.unique(of[up]):
            xs = np.sort(x[of[up] == k])
            spans += zip(xs[::2].tolist(), xs[1::2].tolist())
        width, end = 0.0, -np.inf
        for s, e in sorted(spans):
            width += max(0.0, e - max(s, end))
            end = max(end, e)
        total += width * (high - low)
    return total


def edges_meet(parts: list, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> np.ndarray:
    """Which closed rectangles meet an edge of a polygon; vectorised over the rectangles, an edge at a time."""
    hit = np.zeros(len(x0), bool)
    for polygon in parts:
        for r in polygon:
            for (ax, ay), (bx, by) in zip(r[:-1].tolist(), r[1:].tolist()):
                low, high = np.zeros(len(x0)), np.ones(len(x0))
                for p, d, lo, hi in ((ax, bx - ax, x0, x1), (ay, by - ay, y0, y1)):
                    if d == 0:
                        low = np.where((p < lo) | (p > hi), 2.0, low)
                    else:
                        t0, t1 = (lo - p) / d, (hi - p) / d
                        low, high = np.maximum(low, np.minimum(t0, t1)), np.minimum(high, np.maximum(t0, t1))
                hit |= low <= high
    return hit


def cut(ring: np.ndarray, axis: int, bound: float, above: bool) -> np.ndarray:
    """The part of a closed ring on one side of a line (Sutherland and Hodgman)."""
    if len(ring) < 2:
        return ring[:0]
    a, b = ring[:-1], ring[1:]
    da, db = (a[:, axis] - bound, b[:, axis] - bound) if above else (bound - a[:, axis], bound - b[:, axis])
    ina, inb = da >= 0, db >= 0
    cross = ina != inb
    t = np.where(cross, da / np.where(da == db, 1.0, da - db), 0.0)
    middle = a + t[:, None] * (b - a)
    middle[:, axis] = bound
    out = np.empty((2 * len(a), 2))
    out[0::2], out[1::2] = middle, b
    keep = np.empty(2 * len(a), bool)
    keep[0::2], keep[1::2] = cross, inb
    out = out[keep]
    return _closed(out) if len(out) else out


def clip(ring: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
    for axis, bound, above in ((0, x0, True), (0, x1, False), (1, y0, True), (1, y1, False)):
        ring = cut(ring, axis, bound, above)
    return ring


def segment_share(a: np.ndarray, b: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
    """The share of each segment a-b inside a closed rectangle (Liang and Barsky); -1 where it misses it."""
    d = b - a
    low, high = np.zeros(len(a)), np.ones(len(a))
    miss = np.zeros(len(a), bool)
    for axis, lo, hi in ((0, x0, x1), (1, y0, y1)):
        flat = d[:, axis] == 0
        miss |= flat & ((a[:, axis] < lo) | (a[:, axis] > hi))
        step = np.where(flat, 1.0, d[:, axis])
        t0, t1 = (lo - a[:, axis]) / step, (hi - a[:, axis]) / step
        low = np.where(flat, low, np.maximum(low, np.minimum(t0, t1)))
        high = np.where(flat, high, np.minimum(high, np.maximum(t0, t1)))
    return np.where(miss | (low > high), -1.0, high - low)


def covers_many(parts: list, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which points lie in a polygon; its edges count as inside. Vectorised over the points, an edge at a time."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    inside, on_edge = np.zeros(len(x), bool), np.zeros(len(x), bool)
    for polygon in parts:
        odd = np.zeros(len(x), bool)
        for r in polygon:
            for (ax, ay), (bx, by) in zip(r[:-1].tolist(), r[1:].tolist()):
                side = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
                on_edge |= (side == 0) & (min(ax, bx) <= x) & (x <= max(ax, bx)) & (min(ay, by) <= y) & (y <= max(ay, by))
                if ay != by:
                    odd ^= ((ay <= y) != (by <= y)) & (ax + (y - ay) * (bx - ax) / (by - ay) > x)
        inside |= odd
    return inside | on_edge


def covers(parts: list, x: float, y: float) -> bool:
    return bool(covers_many(parts, np.array([x]), np.array([y]))[0])


def centroid(parts: list) -> tuple[float, float]:
    """Of polygons, by area; holes count negative."""
    total = sx = sy = 0.0
    for polygon in parts:
        for k, r in enumerate(polygon):
            o = r[0]
            x, y = (r - o).T
            c = x[:-1] * y[1:] - x[1:] * y[:-1]
            signed = c.sum() / 2
            sign = (1 if k == 0 else -1) * (1 if signed >= 0 else -1)
            total += sign * signed
            sx += sign * (((x[:-1] + x[1:]) * c).sum() / 6 + o[0] * signed)
            sy += sign * (((y[:-1] + y[1:]) * c).sum() / 6 + o[1] * signed)
    if total == 0:
        raise ContractError("a polygon without area has no centroid")
    return sx / total, sy / total


def touches(parts: list, x0: float, y0: float, x1: float, y1: float) -> bool:
    """A closed rectangle and a polygon share a point."""
    for polygon in parts:
        for r in polygon:
            if (segment_share(r[:-1], r[1:], x0, y0, x1, y1) >= 0).any():
                return True
    return covers(parts, (x0 + x1) / 2, (y0 + y1) / 2)
