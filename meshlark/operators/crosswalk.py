"""Weights from source units to cells: sumber_id, gid, bobot; a source's weights sum to one."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from meshlark.errors import ContractError
from meshlark.functions import codec
from meshlark.functions.constants import MAX_LEVEL
from meshlark.functions.profiles import DOMAINS

TOLERANCE = 1e-9
# The manifest.
FIELDS = ("format_version", "spec_version", "domain_code", "level", "weight_kind", "source_description", "registry_version", "created_at")
WEIGHT_KINDS = ("luas", "bangunan", "populasi", "lainnya")
VERSIONS = {"format_version": "1.0", "spec_version": "2.0"}


def _is_time(v) -> bool:
    try:
        return bool(datetime.fromisoformat(v.replace("Z", "+00:00")))
    except (AttributeError, ValueError):
        return False


_named = lambda v: isinstance(v, str) and v.strip() != ""
#: What each field of a manifest must be.
TESTS = {
    **{f: (lambda v, want=want: v == want) for f, want in VERSIONS.items()},
    "domain_code": lambda v: v in DOMAINS,
    "level": lambda v: type(v) is int and 0 <= v <= MAX_LEVEL,
    "weight_kind": lambda v: v in WEIGHT_KINDS,
    "source_description": _named,
    "registry_version": _named,
    "created_at": _is_time,
}


def check_manifest(manifest: dict) -> int:
    """The level of a manifest all of whose fields pass; else an error that names those that don't."""
    bad = [f for f in FIELDS if f not in manifest or not TESTS[f](manifest[f])]
    if bad:
        raise ContractError(f"missing or wrong in the crosswalk's manifest: {', '.join(bad)}")
    return manifest["level"]


RULES = ("source", "gid", "weight", "duplicate", "sum")


def violation_counts(rows: DataFrame, level: int) -> DataFrame:
    """One row: how many rows (sum: sources) break each of RULES."""
    w = F.col("bobot").cast("double")
    by_source = rows.groupBy("sumber_id").agg(
        F.sum(F.when(F.coalesce(F.trim("sumber_id"), F.lit("")) == "", 1).otherwise(0)).alias("source"),
        F.sum(F.when(F.coalesce(codec.gid_level("gid"), F.lit(-1)) != level, 1).otherwise(0)).alias("gid"),
        F.sum(F.when(w.isNull() | F.isnan(w) | (w <= 0) | (w == float("inf")), 1).otherwise(0)).alias("weight"),
        F.sum(w).alias("s"),
    )
    twice = rows.groupBy("sumber_id", "gid").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("duplicate"))
    one = by_source.agg(F.sum("source").alias("source"), F.sum("gid").alias("gid"), F.sum("weight").alias("weight"), F.count_if(F.abs(F.col("s") - 1) > TOLERANCE).alias("sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    key = F.lit(1).alias("_k")
    return one.select("*", key).join(twice.select("*", key), "_k").select(*map(zero, RULES))


def violations(rows: DataFrame, level: int) -> dict[str, int]:
    return violation_counts(rows, level).first().asDict()


def summary(rows: DataFrame) -> DataFrame:
    """sources, rows and cells of a crosswalk."""
    return rows.agg(F.count_distinct("sumber_id").alias("sources"), F.count(F.lit(1)).alias("rows"), F.count_distinct("gid").alias("cells"))


def validate(rows: DataFrame, manifest: dict) -> dict[str, int]:
    bad = {k: n for k, n in violations(rows, check_manifest(manifest)).items() if n}
    counts = summary(rows).first().asDict()
    if bad or not counts["rows"]:
        raise ContractError(f"not a valid crosswalk: {bad or 'it has no rows'}")
    return counts


def apply(source: DataFrame, crosswalk: DataFrame, value: str, key: str = "sumber_id") -> DataFrame:
    """Values of source units allotted to cells."""
    named = crosswalk.select(F.col("sumber_id").alias(key), "gid", "bobot")
    return source.join(named, key).groupBy("gid").agg(F.sum(F.col(value) * F.col("bobot")).alias(value), F.count(F.lit(1)).alias("feature_count"))


def from_shares(shares: DataFrame, source: str, area: str, total: str, tolerance: float = 1e-6) -> DataFrame:
    """Overlap areas to crosswalk rows: cells must cover each source within the tolerance; weights then sum to one.

    What a source's cells cover is an aggregate with partial sums, so a source of very many cells burdens no task.
    """
    covered = shares.groupBy(source).agg(F.sum(area).alias("_covered"))
    ok = F.abs(F.col("_covered") / F.col(total) - 1) <= tolerance
    weight = F.when(ok, F.col(area) / F.col("_covered")).otherwise(F.raise_error(F.lit("cells don't cover a source's area")))
    return shares.join(covered, source).filter(F.col(area) > 0).select(F.col(source).cast("string").alias("sumber_id"), "gid", weight.alias("bobot"))


def from_polygons(polygons: DataFrame, source: str, geometry: str, domain: str, level: int, crs: str = "grid", tolerance: float = 1e-6) -> DataFrame:
    """sumber_id, gid, bobot from polygons (WKT, WKB or GeoJSON), one row a source: a cell's share of the polygon's area.

    Fails where a source has no name or no area, comes twice, or isn't covered by the cells of the grid: all sources are
    asked before the first row comes, so cells are written to the shared folder once and read from there.
    """
    from meshlark.operators.geometry import polygons_to_cells, shape_areas
    from meshlark.sources.datasets import temporary

    named = polygons.select(F.col(source).cast("string").alias("_source"), F.col(geometry).alias("_shape"))
    totals = shape_areas(named, "_shape", domain, crs, "_total").groupBy("_source").agg(F.count(F.lit(1)).alias("_n"), F.max("_total").alias("_total"))
    cells = polygons_to_cells(named, "_shape", domain, level, crs=crs, keep=["_source"]).select("_source", "gid", "area")
    path = temporary(polygons.sparkSession, "shares")
    totals.join(cells, "_source", "left").write.parquet(path)
    shares = polygons.sparkSession.read.parquet(path)
    size, held = F.first("_total"), F.coalesce(F.sum("area"), F.lit(0.0))
    faults = {
        "has no name": F.coalesce(F.trim("_source"), F.lit("")) == "",
        "comes twice": F.col("n") > 1,
        "has no area": ~F.coalesce((F.col("size") > 0) & (F.col("size") < float("inf")), F.lit(False)),
        "isn't covered by cells": F.abs(F.col("held") / F.nullif(F.col("size"), F.lit(0.0)) - 1) > tolerance,
    }
    by_source = shares.groupBy("_source").agg(F.first("_n").alias("n"), size.alias("size"), held.alias("held"))
    found = by_source.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(f"f{k}") for k, c in enumerate(faults.values()))).first()
    bad = [f"{n} {why}" for n, why in zip(found, faults) if n]
    if bad:
        raise ContractError("sources that break the crosswalk's contract: " + ", ".join(bad))
    return from_shares(shares.filter("area > 0"), "_source", "area", "_total", tolerance)
