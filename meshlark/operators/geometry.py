"""Shapes to cells: polygons by covered area, lines by length, points by position; and cells to shapes.

Shapes are WKT, WKB or GeoJSON, in grid metres or WGS 84. Clipping runs in Arrow batches next to the rows, without a
shuffle; a shape's candidate cells are counted before they are made, and too many fail. Cells between the strips of a
column are only those of the strip, so the work follows the cells that a shape touches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from meshlark.errors import CandidateLimitError, ContractError
from meshlark.functions import codec, projection, shapes
from meshlark.functions.constants import ALPHABETS, ORIGIN, ROOT_SIDE, STEPS, cell_count, cell_side
from meshlark.functions.profiles import Domain, domain as find_domain

LIMIT = 100_000
PREDICATES = ("CENTROID_COVERED", "INTERSECTS", "MIN_COVERAGE")
CELL = "x_idx bigint, y_idx bigint, coverage_ratio double, length_ratio double, area double, assignment_method string"


def _window(low: np.ndarray, high: np.ndarray, level: int, closed: bool) -> tuple[int, int, int, int] | None:
    """The cells that a box meets, clipped to the root; with `closed`, those it touches as well."""
    side, n = cell_side(level), cell_count(level)
    if (high < ORIGIN).any() or (low > ORIGIN + ROOT_SIDE).any():
        return None
    a, b = (low - ORIGIN) / side, (high - ORIGIN) / side
    x0, y0 = (max(0, math.ceil(v) - 1 if closed else math.floor(v)) for v in a)
    x1, y1 = (min(n - 1, math.floor(v) if closed else max(math.ceil(v) - 1, math.floor(w))) for v, w in zip(b, a))
    return (x0, y0, x1, y1) if x0 <= x1 and y0 <= y1 else None


def _limited(window: tuple[int, int, int, int] | None, limit: int) -> tuple[int, int, int, int] | None:
    if window and (window[2] - window[0] + 1) * (window[3] - window[1] + 1) > limit:
        raise CandidateLimitError(f"a shape has more than {limit} candidate cells")
    return window


def _ratio(value: float) -> float:
    if not -1e-10 <= value <= 1 + 1e-10:
        raise ContractError(f"a ratio of {value} lies outside 0 to 1")
    return min(1.0, max(0.0, value))


def _equal_area(d: Domain):
    return lambda x, y: projection.equal_earth(*projection.from_grid(d, x, y))


def box_cells(box: tuple[float, float, float, float], level: int, limit: int = LIMIT) -> list[tuple[int, int, float, float]]:
    """polygon_cells of a rectangle along the axes: the overlaps of both axes, multiplied."""
    side, n, spans, room = cell_side(level), cell_count(level), [], 1
    for low, high in ((box[0], box[2]), (box[1], box[3])):
        cells = range(max(0, math.floor((low - ORIGIN) / side)), min(n, math.ceil((high - ORIGIN) / side)))
        room *= len(cells)
        if room > limit:
            raise CandidateLimitError(f"a shape has more than {limit} candidate cells")
        starts = ((k, ORIGIN + k * side) for k in cells)
        spans.append([(k, w) for k, s in starts if (w := min(high, s + side) - max(low, s)) > 0])
    return [(i, j, _ratio(w * h / side**2), w * h) for j, h in spans[1] for i, w in spans[0]]


def boxes_cells(boxes: list[tuple[float, float, float, float]], level: int, limit: int = LIMIT) -> list[tuple[int, int, float, float]]:
    """polygon_cells of rectangles along the axes, which may overlap: between the heights of all, stretches that touch are
    joined, and each such rectangle is dealt to its cells."""
    if len(boxes) == 1:
        return box_cells(boxes[0], level, limit)
    low, high = (np.array([f(b[k] for b in boxes) for k in at]) for f, at in ((min, (0, 1)), (max, (2, 3))))
    if not _limited(_window(low, high, level, False), limit):
        return []
    covered: dict[tuple[int, int], float] = {}
    heights = sorted({y for b in boxes for y in (b[1], b[3])})
    for bottom, top in zip(heights, heights[1:]):
        runs: list[list[float]] = []
        for x0, x1 in sorted((b[0], b[2]) for b in boxes if b[1] <= bottom and top <= b[3]):
            if runs and x0 <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], x1)
            else:
                runs.append([x0, x1])
        for x0, x1 in runs:
            for i, j, _, a in box_cells((x0, bottom, x1, top), level, limit):
                covered[i, j] = covered.get((i, j), 0.0) + a
    return [(i, j, _ratio(a / cell_side(level) ** 2), a) for (i, j), a in sorted(covered.items(), key=lambda c: (c[0][1], c[0][0]))]


def polygon_cells(parts: list, level: int, limit: int = LIMIT, equal_area: Domain | None = None, touching: bool = False) -> list[tuple[int, int, float, float]]:
    """(x_idx, y_idx, share of the cell, area in grid metres) of cells with a covered area, row by row.

    Parts that overlap, and rings that cross themselves, count an area once. With `touching`, cells that a polygon only
    touches come too, with a share of 0.
    """
    points = np.concatenate([r for p in parts for r in p]) if parts else np.zeros((0, 2))
    window = _limited(_window(points.min(0), points.max(0), level, touching) if len(points) else None, limit)
    if not window:
        return []
    side, out = cell_side(level), []
    if not equal_area and not touching and all(shapes.is_box([p]) for p in parts):
        return boxes_cells([(*r.min(0).tolist(), *r.max(0).tolist()) for [r] in parts], level, limit)
    size = shapes.covered_area if shapes.is_tangled(parts) else shapes.area
    flat = _equal_area(equal_area) if equal_area else None
    for i in range(window[0], window[2] + 1):
        x0 = ORIGIN + i * side
        strips = [[shapes.cut(shapes.cut(r, 0, x0, True), 0, x0 + side, False) for r in p] for p in parts]
        strips = [p for p in strips if len(p[0])]
        if not strips:
            continue
        ys = np.concatenate([r for p in strips for r in p])[:, 1]
        first, last = max(window[1], math.floor((ys.min() - ORIGIN) / side) - touching), min(window[3], math.floor((ys.max() - ORIGIN) / side))
        for j in range(first, last + 1):
            y0 = ORIGIN + j * side
            pieces = [[shapes.cut(shapes.cut(r, 1, y0, True), 1, y0 + side, False) for r in p] for p in strips]
            pieces = [[r for r in p if len(r)] for p in pieces if len(p[0])]
            covered = size(pieces)
            if covered > 0:
                if flat:
                    square = np.array([[x0, y0], [x0 + side, y0], [x0 + side, y0 + side], [x0, y0 + side], [x0, y0]])
                    part = size(shapes.mapped(("polygon", pieces), flat)[1])
                    whole = shapes.area(shapes.mapped(("polygon", [[square]]), flat)[1])
                    out.append((i, j, _ratio(part / whole), covered))
                else:
                    out.append((i, j, _ratio(covered / side**2), covered))
            elif touching and shapes.touches(parts, x0, y0, x0 + side, y0 + side):
                out.append((i, j, 0.0, 0.0))
    return sorted(out, key=lambda c: (c[1], c[0]))


def line_cells(parts: list, level: int, limit: int = LIMIT) -> list[tuple[int, int, float]]:
    """(x_idx, y_idx, share of the length inside the root). Squares are closed: a line on an edge is in both cells."""
    parts = [p for p in parts if len(p) > 1]
    if not parts:
        return []
    a, b = np.concatenate([p[:-1] for p in parts]), np.concatenate([p[1:] for p in parts])
    length = np.hypot(*(b - a).T)
    inside = np.maximum(shapes.segment_share(a, b, ORIGIN, ORIGIN, ORIGIN + ROOT_SIDE, ORIGIN + ROOT_SIDE), 0)
    total = float((inside * length).sum())
    both = np.concatenate([a, b])
    window = _limited(_window(both.min(0), both.max(0), level, True), limit)
    if not window or total == 0:
        return []
    side, found = cell_side(level), {}
    for k in range(len(a)):  # only the cells of each segment's own box, column by column
        own = _window(np.minimum(a[k], b[k]), np.maximum(a[k], b[k]), level, True)
        for i in range(own[0], own[2] + 1) if own else ():
            x0 = ORIGIN + i * side
            for j in range(own[1], own[3] + 1):
                share = shapes.segment_share(a[k : k + 1], b[k : k + 1], x0, ORIGIN + j * side, x0 + side, ORIGIN + (j + 1) * side)[0]
                if share > 0:
                    found[i, j] = found.get((i, j), 0.0) + share * length[k]
    return [(i, j, _ratio(v / total)) for (i, j), v in sorted(found.items(), key=lambda c: (c[0][1], c[0][0])) if v > 0]


def gid_text(level: int, x: int, y: int) -> str:
    out = ""
    for s in reversed(STEPS[:level]):
        out = ALPHABETS[s][y % s * s + x % s] + out
        x, y = x // s, y // s
    return out


def in_grid(shape: shapes.Shape, d: Domain, crs: str) -> shapes.Shape:
    if crs == "grid":
        return shape
    if crs in ("EPSG:4326", "OGC:CRS84"):
        return shapes.mapped(shape, lambda x, y: projection.to_grid(d, x, y))
    raise ContractError(f"coordinates in {crs!r} are not supported")


def geometry_to_cells(df: DataFrame, geometry: str, domain: str, level: int, crs: str = "grid", keep: list[str] | None = None, limit: int = LIMIT, coverage: str = "GRID_PLANAR", min_coverage: float = 0.0, of_source: bool = True, boundary: Boundary | None = None, predicate: str | None = None, touching: bool = False) -> DataFrame:  # noqa: F821
    """Contribution rows: kept columns, identity, coverage_ratio or length_ratio, assignment_method, boundary_policy.

    With of_source, coverage is the share of the source's area inside the grid, so shares of a source sum to one; else it
    is the share of the cell. Empty and null shapes give no row. A boundary drops cells (points: positions) outside it.
    """
    d = find_domain(domain)
    if coverage not in ("GRID_PLANAR", "EQUAL_AREA"):
        raise ContractError(f"no coverage mode {coverage!r}")
    kept = [c for c in (df.columns if keep is None else keep) if c != geometry]
    clash = set(kept) & {"domain", "level", "gid", "uri", "packed_id", "x_idx", "y_idx", "coverage_ratio", "length_ratio", "assignment_method", "boundary_policy"}
    kept = [c for c in kept if c not in clash]
    equal = d if coverage == "EQUAL_AREA" else None
    plain = crs == "grid" and equal is None and boundary is None and not touching

    def cells(value) -> list[tuple]:
        if plain and (boxes := shapes.boxes_of(value)):  # read and cut without arrays
            found = [c for c in boxes_cells(boxes, level, limit) if c[2] > 0 and c[2] >= min_coverage]
            total = sum(c[3] for c in found)
            return [(i, j, a / total if of_source else v, None, a, "area") for i, j, v, a in found]
        kind, parts = in_grid(shapes.parse(value), d, crs)
        if kind == "point":
            out = []
            for p in parts:
                if (p >= ORIGIN).all() and (p <= ORIGIN + ROOT_SIDE).all() and (boundary is None or shapes.covers(boundary.parts, *p)):
                    i, j = (min(cell_count(level) - 1, math.floor((v - ORIGIN) / cell_side(level))) for v in p)
                    out.append((i, j, None, None, None, "point"))
            return out
        if kind == "line":
            out = [(i, j, None, v, None, "length") for i, j, v in line_cells(parts, level, limit)]
        else:
            found = [c for c in polygon_cells(parts, level, limit, equal, touching) if (touching or c[2] > 0) and c[2] >= min_coverage]
            total = sum(c[3] for c in found)
            out = [(i, j, a / total if of_source else v, None, a, "area") for i, j, v, a in found]
        if boundary is not None and out:
            good = boundary.matches_many(np.array([c[0] for c in out]), np.array([c[1] for c in out]), level, predicate or "INTERSECTS", min_coverage)
            out = [c for c, ok in zip(out, good) if ok]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for k, value in enumerate(batch.column(geometry).to_pylist()):
                found = cells(value) if value is not None else []
                at += [k] * len(found)
                rows += found
            take = pa.array(at, pa.int64())
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.string()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds]
            yield pa.record_batch([*(batch.column(c).take(take) for c in kept), *columns], [*kept, "x_idx", "y_idx", "coverage_ratio", "length_ratio", "area", "assignment_method"])

    fields = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept), CELL])
    out = df.select(*kept, geometry).mapInArrow(run, fields)
    policy = F.lit(None if boundary is None else predicate or "INTERSECTS").cast("string")
    out = out.withColumn("domain", F.lit(domain)).withColumn("level", F.lit(level)).withColumn("gid", codec.gid_of("x_idx", "y_idx", level))
    return out.select(*kept, "domain", "level", "x_idx", "y_idx", "gid", codec.uri_of(domain, "gid").alias("uri"), "coverage_ratio", "length_ratio", "area", "assignment_method", policy.alias("boundary_policy"))


def polygons_to_cells(df: DataFrame, geometry: str, domain: str, level: int, **options) -> DataFrame:
    """As geometry_to_cells, with coverage as the share of the cell."""
    return geometry_to_cells(df, geometry, domain, level, of_source=False, **options)


def polygon_to_cell(df: DataFrame, geometry: str, domain: str, level: int, method: str = "largest_overlap", source: str = "source_id", **options) -> DataFrame:
    """One cell for each polygon: its largest overlap (ties: greatest gid), or the cell of its centroid."""
    if method == "largest_overlap":
        cells = polygons_to_cells(df, geometry, domain, level, **options)
        overlap = F.round("coverage_ratio", 9).alias("r")  # sums of equal parts may differ in the last bits
        return cells.groupBy(source).agg(F.max(F.struct(overlap, "gid", "coverage_ratio")).alias("b")).select(source, "b.gid", "b.coverage_ratio")
    if method not in ("centroid", "representative_point"):
        raise ContractError(f"no method {method!r}")
    d, crs = find_domain(domain), options.get("crs", "grid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = [None if g is None else representative(in_grid(shapes.parse(g), d, crs)[1], method) for g in batch.column(geometry).to_pylist()]
            yield pa.record_batch([batch.column(source), *(pa.array([p and p[k] for p in points], pa.float64()) for k in (0, 1))], [source, "_x", "_y"])

    flat = df.select(source, geometry).mapInArrow(run, f"`{source}` {df.schema[source].dataType.simpleString()}, _x double, _y double")
    x, y = codec.cell_of("_x", "_y", level)
    return flat.select(source, codec.gid_of(x, y, level).alias("gid"), F.lit(None).cast("double").alias("coverage_ratio"))


def representative(parts: list, method: str) -> tuple[float, float]:
    """The centroid, or a point surely inside: the middle of the widest stretch of the polygon at half its height."""
    x, y = shapes.centroid(parts)
    if method == "centroid" or shapes.covers(parts, x, y):
        return float(x), float(y)
    every = [r for p in parts for r in p]
    ys = np.unique(np.concatenate([r[:, 1] for r in every]))
    best = (-1.0, x, y)
    for y in (ys[:-1] + ys[1:]) / 2:
        xs = []
        for r in every:
            a, b = r[:-1], r[1:]
            up = (a[:, 1] <= y) != (b[:, 1] <= y)
            xs += (a[up, 0] + (y - a[up, 1]) * (b[up, 0] - a[up, 0]) / (b[up, 1] - a[up, 1])).tolist()
        xs.sort()
        for lo, hi in zip(xs[::2], xs[1::2]):
            best = max(best, (hi - lo, (lo + hi) / 2, y))
    return float(best[1]), float(best[2])


class Boundary:
    """An operational boundary in grid metres."""

    def __init__(self, parts: list) -> None:
        self.parts = parts

    @classmethod
    def read(cls, value, domain: str, crs: str = "grid") -> Boundary:
        kind, parts = in_grid(shapes.parse(value), find_domain(domain), crs)
        if kind != "polygon" or not parts:
            raise ContractError("a boundary must be a polygon")
        return cls(parts)

    @classmethod
    def from_file(cls, path: str, domain: str, crs: str = "OGC:CRS84", sha256: str | None = None) -> Boundary:
        import hashlib
        from pathlib import Path

        data = Path(path).read_bytes()
        if sha256 and hashlib.sha256(data).hexdigest() != sha256:
            raise ContractError("the boundary file isn't the one expected")
        return cls.read(data.decode(), domain, crs)

    def matches_many(self, i: np.ndarray, j: np.ndarray, level: int, predicate: str, min_coverage: float = 0.0) -> np.ndarray:
        """Which cells match; vectorised over the cells. Only cells on the boundary are clipped, for MIN_COVERAGE."""
        side = cell_side(level)
        x0, y0 = ORIGIN + i.astype(float) * side, ORIGIN + j.astype(float) * side
        centre = shapes.covers_many(self.parts, x0 + side / 2, y0 + side / 2)
        if predicate == "CENTROID_COVERED":
            return centre
        if predicate not in ("INTERSECTS", "MIN_COVERAGE"):
            raise ContractError(f"no predicate {predicate!r}")
        edge = shapes.edges_meet(self.parts, x0, y0, x0 + side, y0 + side)
        if predicate == "INTERSECTS":
            return edge | centre
        size = shapes.covered_area if shapes.is_tangled(self.parts) else shapes.area
        share = centre.astype(float)
        for n in np.flatnonzero(edge).tolist():
            pieces = [[shapes.clip(r, x0[n], y0[n], x0[n] + side, y0[n] + side) for r in p] for p in self.parts]
            share[n] = min(1.0, max(0.0, size([[r for r in p if len(r)] for p in pieces if len(p[0])]) / side**2))
        return share >= min_coverage

    def matches(self, i: int, j: int, level: int, predicate: str, min_coverage: float = 0.0) -> bool:
        return bool(self.matches_many(np.array([i]), np.array([j]), level, predicate, min_coverage)[0])

    def _box(self) -> tuple[float, ...]:
        points = np.concatenate([r for p in self.parts for r in p])
        return (*points.min(0).tolist(), *points.max(0).tolist())

    def covers_points(self, df: DataFrame, x: str = "x_m", y: str = "y_m", name: str = "inside_boundary") -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                px, py = (batch.column(c).cast(pa.float64()) for c in (x, y))
                flags = shapes.covers_many(self.parts, *(c.to_numpy(zero_copy_only=False) for c in (px, py)))
                missing = np.logical_or(*(c.is_null().to_numpy(zero_copy_only=False) for c in (px, py)))
                yield pa.record_batch([*batch.columns, pa.array(flags, pa.bool_(), mask=missing)], [*batch.schema.names, name])

        return df.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{name}` boolean"]))

    def near_points(self, df: DataFrame, x: str, y: str) -> DataFrame:
        """Rows in the boundary's box: a range filter, which reaches the scan where it can."""
        x0, y0, x1, y1 = self._box()
        return df.filter(F.col(x).between(x0, x1) & F.col(y).between(y0, y1))

    def filter_points(self, df: DataFrame, x: str = "x_m", y: str = "y_m") -> DataFrame:
        """Rows inside."""
        return self.covers_points(self.near_points(df, x, y), x, y, "_inside").filter("_inside").drop("_inside")

    def filter_cells(self, df: DataFrame, level: int, predicate: str = "INTERSECTS", min_coverage: float = 0.0) -> DataFrame:
        """Rows whose cell (x_idx, y_idx) matches; a batch of cells at a time."""
        side = cell_side(level)
        x0, y0, x1, y1 = (math.floor((v - ORIGIN) / side) for v in self._box())
        near = df.filter(F.col("x_idx").between(x0 - 1, x1) & F.col("y_idx").between(y0 - 1, y1))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                i, j = (batch.column(c).cast(pa.int64()).to_numpy(zero_copy_only=False) for c in ("x_idx", "y_idx"))
                yield batch.filter(pa.array(self.matches_many(i, j, level, predicate, min_coverage)))

        return near.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema))


def shape_areas(df: DataFrame, geometry: str, domain: str, crs: str = "grid", name: str = "area") -> DataFrame:
    """Adds the area of each polygon in grid metres, overlapping parts once; null for null."""
    d = find_domain(domain)

    def one(value) -> float | None:
        if value is None:
            return None
        kind, parts = in_grid(shapes.parse(value), d, crs)
        if kind != "polygon":
            raise ContractError("only polygons have an area")
        return shapes.covered_area(parts) if shapes.is_tangled(parts) else shapes.area(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            areas = pa.array([one(v) for v in batch.column(geometry).to_pylist()], pa.float64())
            yield pa.record_batch([*batch.columns, areas], [*batch.schema.names, name])

    return df.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{name}` double"]))


def cell_polygons(df: DataFrame, level: int, domain: str | None = None, crs: str = "grid", form: str = "wkt", max_segment_m: float = 25_000.0, name: str = "geometry") -> DataFrame:
    """Adds each cell's outline (x_idx, y_idx): in grid metres, or densified and then in WGS 84; wkt or wkb."""
    if form not in ("wkt", "wkb"):
        raise ContractError(f"no geometry format {form!r}")
    side = cell_side(level)
    d = find_domain(domain) if domain else None
    if crs != "grid" and d is None:
        raise ContractError("WGS 84 outlines need a domain")
    if crs == "grid" and form == "wkt":  # whole metres: text functions alone
        x0, y0 = (F.lit(ORIGIN) + F.col(c) * side for c in ("x_idx", "y_idx"))
        at = lambda a, b: F.concat_ws(" ", a.cast("bigint").cast("string"), b.cast("bigint").cast("string"))
        ring = F.concat_ws(", ", at(x0, y0), at(x0 + side, y0), at(x0 + side, y0 + side), at(x0, y0 + side), at(x0, y0))
        return df.withColumn(name, F.when(F.col("x_idx").isNotNull() & F.col("y_idx").isNotNull(), F.concat(F.lit("POLYGON (("), ring, F.lit("))"))))
    pieces = max(1, math.ceil(side / max_segment_m)) if crs != "grid" else 1
    t = np.arange(pieces) / pieces
    unit = np.concatenate([np.stack(p, 1) for p in ((t, 0 * t), (1 + 0 * t, t), (1 - t, 1 + 0 * t), (0 * t, 1 - t))] + [np.zeros((1, 2))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write = shapes.wkt_polygon if form == "wkt" else shapes.wkb_polygon
        for batch in batches:
            out = []
            for i, j in zip(batch.column("x_idx").to_pylist(), batch.column("y_idx").to_pylist()):
                if i is None or j is None:
                    out.append(None)
                    continue
                ring = ORIGIN + (unit + np.array([i, j])) * side
                out.append(write(np.stack(projection.from_grid(d, *ring.T), 1) if crs != "grid" else ring))
            yield pa.record_batch([*batch.columns, pa.array(out, pa.string() if form == "wkt" else pa.binary())], [*batch.schema.names, name])

    return df.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{name}` {'string' if form == 'wkt' else 'binary'}"]))
