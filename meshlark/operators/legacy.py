"""Cells of the older grid: fifteen levels over a longitude, latitude box, with other 2 x 2 letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from meshlark.functions.profiles import domain as find_domain
from meshlark.functions import projection
from meshlark.operators.encode import encode_projected

# Fixed values.
V1_STEPS = (5, 2, 5, 2, 5, 2, 5, 2, 5, 2, 5, 2, 5, 2, 5)
V1_LON = (-217.0, 232.157642055036)
V1_LAT = (-216.0, 233.157642055036)
V1_ALPHABETS = {5: "23456789CEFGHJLMNPQRTVWXY", 2: "2378"}

V1_PATTERN = "^" + "".join(f"(?:[{V1_ALPHABETS[s]}]" for s in V1_STEPS) + ")?" * len(V1_STEPS) + "$"


def decode_v1(df: DataFrame, gid: str = "gid") -> DataFrame:
    """Adds min_lon, min_lat, max_lon, max_lat and v1_level; null where the gid isn't valid.

    Bounds narrow level by level, each level from the one before, so rounding is that of the older grid.
    """
    g = F.col(gid)
    ok = g.rlike(V1_PATTERN) & (F.length(g) >= 1)
    state = F.struct(*(F.lit(v).alias(k) for k, v in zip(("w", "e", "s", "n"), (*V1_LON, *V1_LAT))))

    def narrow(b: Column, i: Column) -> Column:
        step = F.when(i % 2 == 0, F.lit(5)).otherwise(F.lit(2))
        char = g.substr(i + 1, F.lit(1))
        code = F.when(i % 2 == 0, F.call_function("instr", F.lit(V1_ALPHABETS[5]), char)).otherwise(F.call_function("instr", F.lit(V1_ALPHABETS[2]), char)) - 1
        width, height = (b["e"] - b["w"]) / step, (b["n"] - b["s"]) / step
        w = b["w"] + width * (code % step)
        s = b["s"] + height * F.floor(code / step)
        return F.struct(w.alias("w"), (w + width).alias("e"), s.alias("s"), (s + height).alias("n"))

    box = F.when(ok, F.aggregate(F.sequence(F.lit(0), F.greatest(F.length(g) - 1, F.lit(0))), state, narrow))
    out = df.withColumn("_box", box)
    names = {"min_lon": "w", "min_lat": "s", "max_lon": "e", "max_lat": "n"}
    return out.select("*", *(F.col(f"_box.{k}").alias(n) for n, k in names.items()), F.when(ok, F.length(g)).alias("v1_level")).drop("_box")


def migrate_points(df: DataFrame, domain: str, level: int, gid: str = "gid", lon: str | None = None, lat: str | None = None) -> DataFrame:
    """Each row's cell in a domain, from its own coordinates where it has some, else from its old cell's centre.

    `method` says which; points outside the domain's area of use have no cell.
    """
    d = find_domain(domain)
    boxed = decode_v1(df, gid)
    own = F.lit(False) if lon is None else F.col(lon).isNotNull() & F.col(lat).isNotNull()
    pick = lambda c, a, b: F.when(own, F.col(c)).otherwise((F.col(a) + F.col(b)) / 2) if c else (F.col(a) + F.col(b)) / 2
    placed = boxed.withColumn("_lon", pick(lon, "min_lon", "max_lon")).withColumn("_lat", pick(lat, "min_lat", "max_lat"))
    placed = placed.withColumn("method", F.when(own, "source_coordinates").otherwise("cell_centroid"))
    inside = projection.inside_area(d, F.col("_lon"), F.col("_lat"))
    placed = placed.withColumn("_lon", F.when(inside, F.col("_lon"))).withColumn("source_gid", F.col(gid))
    flat = projection.with_grid_xy(placed, d, "_lon", "_lat", "_x", "_y")
    kept = [c for c in (*df.columns, "source_gid", "method", "min_lon", "min_lat", "max_lon", "max_lat", "v1_level") if c != "gid"]
    return encode_projected(flat, "_x", "_y", domain, level, keep=list(dict.fromkeys(kept)))


def migrate_areas(df: DataFrame, domain: str, level: int, gid: str = "gid", coverage: str = "GRID_PLANAR", min_coverage: float = 0.0, limit: int = 100_000) -> DataFrame:
    """The cells that each old cell's box covers in a domain, with the share of each new cell."""
    from meshlark.operators.geometry import polygons_to_cells

    boxed = decode_v1(df.withColumn("source_gid", F.col(gid)), gid)
    w, s, e, n = (F.format_string("%.15f", F.col(c)) for c in ("min_lon", "min_lat", "max_lon", "max_lat"))
    ring = F.concat_ws(", ", *(F.concat_ws(" ", a, b) for a, b in ((w, s), (e, s), (e, n), (w, n), (w, s))))
    shaped = boxed.withColumn("_shape", F.when(F.col("v1_level").isNotNull(), F.concat(F.lit("POLYGON (("), ring, F.lit("))"))))
    kept = [c for c in (*df.columns, "source_gid", "v1_level") if c != gid]
    cells = polygons_to_cells(shaped, "_shape", domain, level, crs="EPSG:4326", keep=list(dict.fromkeys(kept)), coverage=coverage, min_coverage=min_coverage, limit=limit)
    return cells.withColumn("method", F.lit("area_coverage"))
