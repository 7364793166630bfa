"""Cell datasets: a folder with data/ in Parquet and manifest.json beside it.

The manifest also travels in the Parquet schema, as metadata of the gid column. Paths are Hadoop URLs, so any store that
Spark reaches will do. A dataset is written under a temporary name and then renamed; an existing one is never replaced.
"""

from __future__ import annotations

import json
import math
import tempfile
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from meshlark.errors import DatasetError
from meshlark.functions import codec, projection
from meshlark.functions.constants import ORIGIN, cell_count, cell_side
from meshlark.functions.profiles import domain as find_domain
from meshlark.operators import compact, timecube
from meshlark.sources import manifests
from meshlark.sources.manifests import FIELD_KEYS, GRID, NUMERIC_SEMANTICS, RESERVED

ALIASES = {"float64": "double", "float": "double", "float32": "float", "str": "string", "large_string": "string", "bigint": "int64", "long": "int64", "int": "int32", "tinyint": "int8", "smallint": "int16", "boolean": "bool"}


def temporary(spark: SparkSession, name: str) -> str:
    """A new place in the folder that the session shares, or, where it names none and all runs on one machine, in a temporary
    folder; on a cluster executors would write to disks of their own, so there the folder must be named."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise DatasetError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.gettempdir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, where = _fs(spark, path)
    out = fs.create(where, False)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())


def publish(spark: SparkSession, temporary_path: str, path: str) -> None:
    fs, a = _fs(spark, temporary_path)
    if not fs.rename(a, spark._jvm.org.apache.hadoop.fs.Path(path)):
        raise DatasetError(f"can't publish {path}")


def new_manifest(domain: str, level: int, fields: list[tuple[str, str, str]], dataset_type: str = "cell_values", **more) -> dict:
    """A manifest for value fields given as (name, type, semantics)."""
    d = find_domain(domain)
    logical = lambda s: "numeric" if s in NUMERIC_SEMANTICS else s.lower()
    # The inner keys are those of manifests.SECTION_KEYS.
    doc = {
        "manifest_version": "1.0",
        "dataset_type": dataset_type,
        "grid_system": GRID,
        "grid_version": "2.0",
        "domain_code": domain,
        "domain_id": d.id,
        "level": level,
        "profile_version": "2.0",
        "registry_version": "2.0",
        "value_fields": [dict(zip(FIELD_KEYS, (n, t, logical(s), s, None, True, None))) for n, t, s in fields],
        "identity": {"gid_column": "gid", "uri_prefix": f"{codec.URI_SCHEME}:v2:{domain}:", "packed_id_column": None, "x_idx_column": None, "y_idx_column": None, "unique_gid": dataset_type == "cell_values"},
        "coverage": {"assignment_method": "point", "boundary_policy": None, "boundary_sha256": None, "coverage_mode": None, "min_coverage": None, "length_mode": None},
        "source": {"format": "table", "geometry_type": None, "source_crs": None, "source_id_column": None, "source_dataset": None, "source_row_count": None},
        "storage": {"parquet_compression": "zstd", "geometry_column": None, "geometry_format": None, "geometry_crs": None, "partitioning": [], "sorted_by": ["gid"], "row_count": None, "unique_cell_count": None},
        "provenance": {"created_at": datetime.now(timezone.utc).isoformat(), "created_by": "meshlark", "generator": "meshlark", "aggregation_rule": None, "value_semantics": None, "notes": None},
    }
    return doc | more


check_manifest = manifests.check


def canonical(doc: dict) -> str:
    return json.dumps(doc, sort_keys=True, separators=(",", ":"))


def _type(name: str) -> str:
    return ALIASES.get(name, name)


def check_schema(df: DataFrame, doc: dict) -> None:
    """Declared and no other columns. A float column may satisfy a declared double, as in the files of other writers."""
    kinds = dict(df.dtypes)
    if kinds.get("gid") != "string":
        raise DatasetError("gid must be a string column")
    declared = {f["name"]: f for f in doc["value_fields"]}
    extra = set(kinds) - set(declared) - set(RESERVED)
    if extra or set(declared) - set(kinds):
        raise DatasetError(f"columns differ from the manifest: {sorted(extra | set(declared) - set(kinds))}")
    for n, f in declared.items():
        want, got = _type(f["parquet_type"]), _type(kinds[n])
        if want != got and not (want == "double" and kinds[n] == "float"):
            raise DatasetError(f"{n} is {got}, declared {want}")


def violation_counts(df: DataFrame, doc: dict) -> DataFrame:
    """One row: how many rows break each rule, in one aggregate (unique_gid: how many come again; the counts: 0 or 1)."""
    level, names = doc["level"], set(df.columns)
    cell = codec.gid_to_cell("gid")
    bad = {"gid": codec.gid_level("gid").isNull() | (F.length("gid") != level)}
    if "domain" in names:
        bad["domain"] = ~F.col("domain").eqNullSafe(F.lit(doc["domain_code"]))
    if "level" in names:
        bad["level"] = ~F.col("level").eqNullSafe(F.lit(level))
    if "uri" in names:
        bad["uri"] = ~F.col("uri").eqNullSafe(F.concat(F.lit(doc["identity"]["uri_prefix"]), F.col("gid")))
    for c in ("x_idx", "y_idx"):
        if c in names:
            bad[c] = ~F.col(c).cast("bigint").eqNullSafe(cell[c])
    if "packed_id" in names:
        bad["packed_id"] = ~F.col("packed_id").eqNullSafe(codec.pack(doc["domain_id"], cell["x_idx"], cell["y_idx"], level))
    for c in ("coverage_ratio", "length_ratio"):
        if c in names:
            bad[c] = F.col(c).isNotNull() & ~F.col(c).between(0, 1)
    for f in doc["value_fields"]:
        if not f["nullable"]:
            bad[f["name"]] = F.col(f["name"]).isNull()
    n, cells = F.count(F.lit(1)), F.count_distinct("gid")
    wanted = [F.count_if(F.coalesce(c, F.lit(True))).alias(k) for k, c in bad.items()]
    if doc["identity"]["unique_gid"]:
        wanted.append((n - cells).alias("unique_gid"))
    for key, got in (("row_count", n), ("unique_cell_count", cells)):
        if doc["storage"][key] is not None:
            wanted.append((got != doc["storage"][key]).cast("long").alias(key))
    return df.agg(*wanted)


def row_violations(df: DataFrame, doc: dict) -> dict[str, int]:
    return {k: int(n) for k, n in violation_counts(df, doc).first().asDict().items()}


def validate(df: DataFrame, doc: dict) -> None:
    check_schema(df, check_manifest(doc))
    bad = {k: n for k, n in row_violations(df, doc).items() if n}
    if bad:
        raise DatasetError(f"rows break the dataset's contract: {bad}")


def write_dataset(df: DataFrame, path: str, manifest: dict, prefix_level: int | None = None, check: bool = True) -> None:
    """Sorted by gid, which is the order of packed ids, so that ranges and prefixes skip row groups.

    prefix_level partitions by the gid's prefix as well.
    """
    spark = df.sparkSession
    if exists(spark, path):
        raise DatasetError(f"{path} exists")
    if check:
        validate(df, manifest)
    doc = canonical(manifest)
    tagged = df.withMetadata("gid", {"grid.manifest": doc})
    part = f"{path}.writing-{uuid.uuid4().hex}"
    if prefix_level is None:
        out = tagged.repartitionByRange("gid").sortWithinPartitions("gid").write
    else:
        out = tagged.withColumn("gid_prefix", F.substring("gid", 1, prefix_level)).repartitionByRange("gid_prefix", "gid").sortWithinPartitions("gid_prefix", "gid").write.partitionBy("gid_prefix")
    out.option("compression", manifest["storage"]["parquet_compression"]).parquet(f"{part}/data")
    write_text(spark, f"{part}/manifest.json", doc)
    publish(spark, part, path)


def read_dataset(spark: SparkSession, path: str, check: bool = True) -> tuple[DataFrame, dict]:
    doc = check_manifest(json.loads(read_text(spark, f"{path}/manifest.json")))
    df = spark.read.parquet(f"{path}/data")
    inside = df.schema["gid"].metadata.get("grid.manifest")
    if inside is not None and inside != canonical(doc):
        raise DatasetError("the manifest in the data differs from the one beside it")
    if check:
        validate(df.drop("gid_prefix"), doc)
    return df, doc


def split_bbox(bbox: tuple[float, float, float, float]) -> list[tuple[float, float, float, float]]:
    """A box (west, south, east, north) as boxes whose west is below their east: two where it crosses the antimeridian."""
    try:
        w, s, e, n = (float(v) for v in bbox if not isinstance(v, bool))
    except (TypeError, ValueError):
        raise DatasetError("a bbox has four numbers: west, south, east, north") from None
    turn = (e - w) % 360.0  # how far east one goes from west; not a number for what isn't finite
    if not (turn > 0 and max(abs(w), abs(e)) <= 180 and -90 <= s < n <= 90):
        raise DatasetError(f"{(w, s, e, n)} bounds no area of the globe")
    cuts = [w, e] if w < e else [w, 180.0, -180.0, e]
    return [(a, s, b, n) for a, b in zip(cuts[::2], cuts[1::2]) if a < b]


def index_window(x0: float, y0: float, x1: float, y1: float, level: int) -> tuple[int, int, int, int] | None:
    """(first x, last x, first y, last y) of the cells that share an area with a projected box; None if there is none.

    A cell k holds places from k to k + 1, the upper end excluded, so a box from a to b (in cells) meets floor(a) to
    ceil(b) - 1; what of it lies in the grid is the overlap with 0 to the last cell.
    """
    side, n = cell_side(level), cell_count(level)
    spans = []
    for low, high in ((x0, x1), (y0, y1)):
        a, b = ((v - ORIGIN) / side for v in (low, high))
        cells = range(max(0, math.floor(a)), min(n, math.ceil(b)))
        if not cells or b <= 0 or a >= n:
            return None
        spans += [cells[0], cells[-1]]
    return tuple(spans)


def windows(bbox: tuple[float, float, float, float], domain: str, level: int, mode: str = "corners") -> list[tuple[int, int, int, int]]:
    """Index windows of a WGS 84 box: from its corners, or with mode="dense" from points along its edges as well."""
    d, out = find_domain(domain), []
    n = {"corners": 1, "dense": 64}[mode]
    for w, s, e, north in split_bbox(bbox):
        t = [k / n for k in range(n + 1)]
        lon = [w + (e - w) * k for k in t] * 2 + [w] * (n + 1) + [e] * (n + 1)
        lat = [s] * (n + 1) + [north] * (n + 1) + [s + (north - s) * k for k in t] * 2
        x, y = projection.to_grid(d, lon, lat)
        window = index_window(x.min(), y.min(), x.max(), y.max(), level)
        if window and window not in out:
            out.append(window)
    return out


def query_windows(spark: SparkSession, path: str, found: list[tuple[int, int, int, int]]) -> DataFrame:
    """Rows whose indices lie in a window: ranges that reach the Parquet reader. Rows aren't validated again."""
    df = spark.read.parquet(f"{path}/data")
    if not {"x_idx", "y_idx"} <= set(df.columns):
        raise DatasetError("a dataset without x_idx and y_idx can't be queried by place")
    keep = F.lit(False)
    for k, (a, b, c, d) in enumerate(found):
        one = (F.col("x_idx") >= a) & (F.col("x_idx") <= b) & (F.col("y_idx") >= c) & (F.col("y_idx") <= d)
        keep = one if k == 0 else keep | one
    return df.filter(keep)


def query_dataset(spark: SparkSession, path: str, bbox: tuple[float, float, float, float], domain: str, level: int, mode: str = "corners") -> DataFrame:
    doc = check_manifest(json.loads(read_text(spark, f"{path}/manifest.json")))
    if (doc["domain_code"], doc["level"]) != (domain, level):
        raise DatasetError("the dataset has another domain or level")
    return query_windows(spark, path, windows(bbox, domain, level, mode))


def _store(df: DataFrame, path: str, doc: dict, *order: str) -> None:
    spark = df.sparkSession
    if exists(spark, path):
        raise DatasetError(f"{path} exists")
    part = f"{path}.writing-{uuid.uuid4().hex}"
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.option("compression", "zstd").parquet(f"{part}/data")
    write_text(spark, f"{part}/manifest.json", canonical(doc))
    publish(spark, part, path)


def write_compact_set(rows: DataFrame, path: str, domain: str) -> None:
    compact.validate(rows)
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("level")).alias("levels")).first()
    doc = {"dataset_type": "cell_compact_set", "domain_code": domain, "domain_id": find_domain(domain).id, "row_count": counts["n"], "levels_present": [int(v) for v in counts["levels"]]}
    _store(rows.select("gid", F.col("level").cast("tinyint").alias("level")), path, doc, "gid", "level")


def read_compact_set(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    doc = json.loads(read_text(spark, f"{path}/manifest.json"))
    df = spark.read.parquet(f"{path}/data")
    if df.columns != ["gid", "level"]:
        raise DatasetError("a compact set has the columns gid and level")
    compact.validate(df)
    counts = df.agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("level")).alias("levels")).first()
    if counts["n"] != doc["row_count"] or [int(v) for v in counts["levels"]] != doc["levels_present"]:
        raise DatasetError("rows differ from the manifest's counts")
    return df, doc


def write_time_values(df: DataFrame, path: str, domain: str, level: int, period: str, period_start: str, period_end: str, fields: list[tuple[str, str, str]], bucket_hours: int | None = None) -> None:
    timecube.validate(df, level=level, period=period, period_start=period_start, period_end=period_end, bucket_hours=bucket_hours)
    names = [n for n, _, _ in fields]
    if "period" in names:
        raise DatasetError("period is a reserved name")
    cast = {"double": "double", "string": "string"}
    kept = df.select("gid", "period", *(F.col(n).cast(cast.get(t, t)).alias(n) for n, t, _ in fields))
    doc = {"dataset_type": "cell_time_values", "timezone": "UTC", "domain_code": domain, "domain_id": find_domain(domain).id, "level": level, "period_type": period, "bucket_hours": bucket_hours, "period_start": period_start, "period_end": period_end, "value_fields": [{"name": n, "parquet_type": t, "semantics": s} for n, t, s in fields], "identity": {"unique_key": ["gid", "period"], "unique_gid": False}, "storage": {"sorted_by": ["gid", "period"]}}
    _store(kept, path, doc, "gid", "period")


def read_time_values(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    doc = json.loads(read_text(spark, f"{path}/manifest.json"))
    df = spark.read.parquet(f"{path}/data")
    if df.columns != ["gid", "period", *(f["name"] for f in doc["value_fields"])]:
        raise DatasetError("columns differ from the manifest")
    timecube.validate(df, level=doc["level"], period=doc["period_type"], period_start=doc["period_start"], period_end=doc["period_end"], bucket_hours=doc["bucket_hours"])
    if unsorted_rows(df, "gid", "period"):
        raise DatasetError("rows of a file aren't sorted by gid, then period")
    return df, doc


def unsorted_rows(df: DataFrame, *order: str) -> int:
    """How many rows of the files come before the row ahead of them; each piece of a file is read in its own order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad, last, at = 0, None, None
        for batch in batches:
            keys = list(zip(batch.column("_file").to_pylist(), *(batch.column(c).to_pylist() for c in order)))
            for file, *key in keys:
                bad += file == at and key < last
                at, last = file, key
        yield pa.record_batch([pa.array([bad], pa.int64())], ["bad"])

    found = df.select(F.input_file_name().alias("_file"), *order).mapInArrow(run, "bad bigint")
    return int(found.agg(F.sum("bad")).first()[0] or 0)
