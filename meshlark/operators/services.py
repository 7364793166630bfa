"""Services over tables of cells and points: neighbourhoods, distances, points of a table to cells, points to zones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from meshlark.errors import ContractError
from meshlark.functions import codec, projection, shapes, topology
from meshlark.functions.constants import ORIGIN, cell_count, cell_side
from meshlark.functions.profiles import domain as find_domain
from meshlark.operators import encode
from meshlark.operators.geometry import Boundary, cell_polygons, in_grid, polygons_to_cells


def neighbourhood(df: DataFrame, value: str, level: int, k: int, domain: str | None = None, kind: str = "ring", boundary: Boundary | None = None, predicate: str = "INTERSECTS", min_coverage: float = 0.0, scheme: str = codec.URI_SCHEME) -> DataFrame:
    """A row for each cell at (ring) or within (disk) distance k of each row's cell, a URI or, with a domain, a bare gid.

    Columns of `df`, near_domain, near_x, near_y, near_gid, near_uri; clipped to the root, and to the cells that meet a
    boundary where one is given. Values that name no cell of the level give no row.
    """
    if kind not in ("ring", "disk"):
        raise ContractError(f"a neighbourhood is a ring or a disk, not {kind!r}")
    v = F.col(f"`{value}`")
    uri, is_uri = codec.parse_uri(v, scheme), v.startswith(f"{scheme}:")
    named = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.when(is_uri, uri["domain"]).otherwise(F.lit(domain)).alias("domain"), F.when(is_uri, uri["gid"]).otherwise(v).alias("gid"))
    named = named.filter((F.length("gid") == level) & codec.gid_level("gid").isNotNull() & F.col("domain").isNotNull())
    x, y = codec.indices_of("gid", level)
    # a coalesce that changes no partition keeps reading and writing gids in generated methods of their own (see encode)
    cells = named.select("row", "domain", x.alias("x_idx"), y.alias("y_idx")).coalesce(encode.MANY)
    near = topology.disk(cells, "x_idx", "y_idx", level, k, ring=kind == "ring")
    if boundary is not None:
        placed = near.select("row", "domain", F.col("near_x").alias("x_idx"), F.col("near_y").alias("y_idx"))
        near = boundary.filter_cells(placed, level, predicate, min_coverage).withColumnsRenamed({"x_idx": "near_x", "y_idx": "near_y"})
    codes = {f"_code{n}": c for n, c in enumerate(codec.child_codes("near_x", "near_y", level))}
    coded = near.select("row", "domain", "near_x", "near_y").coalesce(encode.MANY).withColumns(codes)
    gid = codec.gid_from_codes([F.col(c) for c in codes], level).alias("near_gid")
    out = coded.select("row", F.col("domain").alias("near_domain"), "near_x", "near_y", gid)
    return out.select("row.*", "near_domain", "near_x", "near_y", "near_gid", codec.uri_of(F.col("near_domain"), "near_gid", scheme).alias("near_uri"))


def distance(df: DataFrame, first: str, second: str, name: str = "distance_m", mode: str = "null", scheme: str = codec.URI_SCHEME) -> DataFrame:
    """Adds the distance between the centres of two cells given as URIs, in metres of the grid.

    Cells of two domains or levels have none: null, or an error with mode="fail".
    """
    sides = F.array(*(F.lit(float(cell_side(n))) for n in range(15)))
    parsed = df.select("*", codec.parse_uri(first, scheme).alias("_a"), codec.parse_uri(second, scheme).alias("_b"))
    parsed = parsed.select("*", codec.gid_to_cell("_a.gid").alias("_c"), codec.gid_to_cell("_b.gid").alias("_d"))
    same = (F.col("_a.domain") == F.col("_b.domain")) & (F.col("_c.level") == F.col("_d.level"))
    across = F.hypot((F.col("_c.x_idx") - F.col("_d.x_idx")).cast("double"), (F.col("_c.y_idx") - F.col("_d.y_idx")).cast("double"))
    metres = across * F.element_at(sides, F.col("_c.level") + 1)
    return parsed.withColumn(name, codec.guarded(F.coalesce(same, F.lit(False)), metres, mode, "a distance needs two cells of one domain and level")).drop("_a", "_b", "_c", "_d")


def table_to_cells(df: DataFrame, domain: str, level: int, lon: str | None = "longitude", lat: str | None = "latitude", x: str | None = None, y: str | None = None, keep: list[str] | None = None, boundary: Boundary | None = None, drop_outside: bool = False, match: str = "boundary_match", geometry: bool = False, crs: str = "grid", form: str = "wkt", mode: str = "null", allow_candidate: bool = False) -> DataFrame:
    """Points of a table, by longitude and latitude or by projected x and y, to kept columns and cell identity.

    With a boundary, `match` says whether each point lies in it, and drop_outside leaves out those that don't; with
    `geometry`, the outline of each cell is added as WKT or WKB, in grid metres or in WGS 84.
    """
    if (x is None) != (y is None) or (x is None and (lon is None or lat is None)):
        raise ContractError("give longitude and latitude, or both x and y")
    kept = [c for c in (df.columns if keep is None else keep) if c not in encode.IDENTITY]
    d = find_domain(domain)
    if x is not None:
        placed = df.withColumns({"_px": F.col(x).cast("double"), "_py": F.col(y).cast("double")}) if boundary is not None else df
        both = ["_px", "_py"] if boundary is not None else []
        renamed = placed.withColumnsRenamed({"_px": "_bx", "_py": "_by"})
        cells = encode.encode_projected(renamed, x, y, domain, level, mode, [*kept, *(c.replace("_p", "_b") for c in both)])
    else:
        placed = projection.with_grid_xy(df, d, lon, lat, "_bx", "_by") if boundary is not None else df
        cells = encode.encode_lonlat(placed, lon, lat, domain, level, mode, [*kept, *(["_bx", "_by"] if boundary is not None else [])], allow_candidate)
    if boundary is not None:
        if drop_outside:
            cells = boundary.near_points(cells, "_bx", "_by")
        cells = boundary.covers_points(cells, "_bx", "_by", match).drop("_bx", "_by")
        if drop_outside:
            cells = cells.filter(F.col(f"`{match}`"))
    return cell_polygons(cells, level, domain, crs, form) if geometry else cells


def points_in_zones(points: DataFrame, zones: DataFrame, zone: str, geometry: str, domain: str, level: int, x: str = "x_m", y: str = "y_m", crs: str = "grid") -> DataFrame:
    """Rows of `points`, all columns, with the `zone` that holds them; a point in several zones comes once for each.

    Zones become cells of the level. Points meet them by an equi-join on the cell; in cells that lie wholly in a zone that
    decides, in those on its edge the exact shape does, a zone at a time in Arrow batches. A level whose cells are small
    beside the zones leaves few points to the exact test; edges count as inside.
    """
    cells = polygons_to_cells(zones.select(zone, geometry), geometry, domain, level, crs=crs, keep=[zone], touching=True)
    cells = cells.select(F.col(zone).alias("_zone"), F.col("x_idx").alias("_i"), F.col("y_idx").alias("_j"), (F.col("coverage_ratio") >= 1 - 1e-9).alias("_whole"))
    side, last = cell_side(level), cell_count(level) - 1
    place = lambda c: F.least(F.floor((F.col(c) - ORIGIN) / side), F.lit(last)).cast("long")
    met = points.withColumns({"_i": place(x), "_j": place(y)}).join(cells, ["_i", "_j"]).drop("_i", "_j")
    sure = met.filter("_whole").drop("_whole")
    shape = zones.select(F.col(zone).alias("_zone"), F.col(geometry).alias("_shape"))
    open_ = met.filter("NOT _whole").drop("_whole").join(shape, "_zone")
    d = find_domain(domain)

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            px, py = (batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in (x, y))
            values = batch.column("_shape").to_pylist()
            by_shape: dict = {}
            for n, v in enumerate(values):
                by_shape.setdefault(v, []).append(n)
            keep = np.zeros(batch.num_rows, bool)
            for v, at in by_shape.items():
                if v not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[v] = in_grid(shapes.parse(v), d, crs)[1]
                keep[at] = shapes.covers_many(known[v], px[at], py[at])
            yield batch.filter(pa.array(keep)).drop_columns(["_shape"])

    held = open_.drop("_shape")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema)
    exact = open_.select(*(F.col(f"`{c}`") for c in held.columns), "_shape").mapInArrow(inside, fields)
    both = sure.select(*(F.col(f"`{c}`") for c in held.columns)).unionByName(exact)
    return both.select(*(F.col(f"`{c}`") for c in points.columns), F.col("_zone").alias(zone))
