"""Points and tables to cells, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from meshlark.errors import ContractError
from meshlark.functions import codec, projection
from meshlark.functions.profiles import domain as find_domain

#: More partitions than any table has.
MANY = 1 << 30
IDENTITY = ("domain", "level", "x_idx", "y_idx", "gid", "uri", "packed_id")


def _columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ContractError(f"no column {', '.join(missing)}")


def encode_projected(df: DataFrame, x: str, y: str, domain: str, level: int, mode: str = "null", keep: list[str] | None = None, scheme: str = codec.URI_SCHEME) -> DataFrame:
    """Kept columns and the seven identity columns. A row outside the root has null indices, or fails with mode="fail"."""
    _columns(df, x, y, *(keep or ()))
    d = find_domain(domain)
    kept = [c for c in (df.columns if keep is None else keep) if c not in IDENTITY]
    # the check is one column of its own, read by all that follow: it keeps the generated method small
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    far = codec.ORIGIN + codec.ROOT_SIDE
    inside = F.coalesce((px >= codec.ORIGIN) & (px <= far) & (py >= codec.ORIGIN) & (py <= far), F.lit(False))
    if mode not in ("null", "fail"):
        raise ContractError(f"mode must be null or fail, not {mode!r}")
    if mode == "fail":
        inside = F.when(inside, F.lit(True)).otherwise(F.raise_error(F.lit("coordinate is outside the root square")).cast("boolean"))
    plain = [F.col(f"`{c}`") for c in kept]
    checked = df.select(*plain, inside.alias("_in"), px.alias("_px"), py.alias("_py"))
    side, last = codec.cell_side(level), F.lit(codec.cell_count(level) - 1).cast("long")
    place = lambda v: F.when(F.col("_in"), F.least(F.floor((F.col(v) - codec.ORIGIN) / side), last))
    cells = checked.select(*plain, "_in", F.lit(domain).alias("domain"), F.lit(level).alias("level"), place("_px").alias("x_idx"), place("_py").alias("y_idx"))
    codes = {f"_code{k}": c for k, c in enumerate(codec.child_codes("x_idx", "y_idx", level))}
    cells = cells.withColumns(codes)
    gid = F.when(F.col("_in"), codec.gid_from_codes([F.col(c) for c in codes], level)).alias("gid")
    packed = F.when(F.col("_in"), codec.packed_from_codes(d.id, [F.col(c) for c in codes], level)).alias("packed_id")
    cells = cells.select(*kept, "domain", "level", "x_idx", "y_idx", gid, packed)
    return cells.select(*kept, "domain", "level", "x_idx", "y_idx", "gid", codec.uri_of(domain, "gid", scheme).alias("uri"), "packed_id")


def encode_lonlat(df: DataFrame, lon: str, lat: str, domain: str, level: int, mode: str = "null", keep: list[str] | None = None, allow_candidate: bool = False, scheme: str = codec.URI_SCHEME) -> DataFrame:
    """As encode_projected, of WGS 84 coordinates. Points outside the domain's area of use are null, or fail."""
    _columns(df, lon, lat, *(keep or ()))
    d = find_domain(domain)
    projection.require_released(d, allow_candidate)
    inside = projection.inside_area(d, F.col(lon).cast("double"), F.col(lat).cast("double"))
    checked = df.withColumn("_lon", codec.guarded(inside, F.col(lon).cast("double"), mode, f"point is outside the area of use of {domain}")).withColumn("_lat", F.col(lat).cast("double"))
    # Projection and codec in one generated method exceed what the JVM compiles (8000 bytes of code), which is some fifteen
    # times slower; a coalesce that changes no partition puts them into two.
    flat = projection.with_grid_xy(checked, d, "_lon", "_lat", "_x", "_y").coalesce(MANY)
    kept = df.columns if keep is None else keep
    return encode_projected(flat, "_x", "_y", domain, level, "null", [c for c in kept if c not in IDENTITY], scheme)


def index_points(df: DataFrame, lon: str, lat: str, domain: str, level: int, allow_candidate: bool = False, boundary=None, mode: str = "null") -> DataFrame:
    """Point index service: identity, bounds, edge and support status of each point's cell.

    With a boundary (geometry.Boundary), points outside it have no cell either, or fail with mode="fail".
    """
    d = find_domain(domain)
    if boundary is not None:
        names = df.columns
        placed = boundary.covers_points(projection.with_grid_xy(df, d, lon, lat, "_bx", "_by"), "_bx", "_by", "_inside")
        inside = F.coalesce(F.col("_inside"), F.lit(False))
        df = placed.withColumn(lon, codec.guarded(inside, F.col(lon), mode, f"point is outside the operational boundary of {domain}")).select(*names)
    out = encode_lonlat(df, lon, lat, domain, level, mode, allow_candidate=allow_candidate)
    return out.withColumn("bounds", codec.bounds_of("x_idx", "y_idx", level)).withColumn("edge_m", F.lit(codec.cell_side(level))).withColumn("production_ready", F.lit(d.released))


def describe(df: DataFrame, value: str, domain: str | None = None, scheme: str = codec.URI_SCHEME) -> DataFrame:
    """URIs or bare gids (with a domain) to domain, gid, level, indices and bounds."""
    uri = codec.parse_uri(value, scheme)
    is_uri = F.col(value).startswith(f"{scheme}:")
    parsed = df.withColumn("domain", F.when(is_uri, uri["domain"]).otherwise(F.lit(domain))).withColumn("gid", F.when(is_uri, uri["gid"]).otherwise(F.col(value)))
    cells = parsed.withColumn("_cell", codec.gid_to_cell("gid")).select("*", F.col("_cell.level"), F.col("_cell.x_idx"), F.col("_cell.y_idx")).drop("_cell")
    side = F.element_at(F.array(*(F.lit(codec.cell_side(n)) for n in range(15))), F.col("level") + 1)
    low = lambda v: F.lit(codec.ORIGIN) + F.col(v) * side
    return cells.withColumn("bounds", F.struct(low("x_idx").alias("min_x"), low("y_idx").alias("min_y"), (low("x_idx") + side).alias("max_x"), (low("y_idx") + side).alias("max_y")))


def decode_gids(df: DataFrame, gid: str = "gid") -> DataFrame:
    cell = codec.gid_to_cell(gid)
    return df.withColumn("_cell", cell).select("*", F.col("_cell.level").alias("level"), F.col("_cell.x_idx").alias("x_idx"), F.col("_cell.y_idx").alias("y_idx")).drop("_cell")


def cell_aggregate(cells: DataFrame, key: str, value: Column | str) -> DataFrame:
    """Rows and sum by cell: one partial and one final aggregate, one shuffle on the key."""
    v = F.col(value) if isinstance(value, str) else value
    return cells.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("total"))
