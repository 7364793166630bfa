"""The contract of a cell dataset's manifest, as a table of rules: one a value, then those between values.

A rule is a question and what it asks for. All are asked, and what fails comes in one error.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from meshlark.errors import ManifestError
from meshlark.functions import codec
from meshlark.functions.constants import MAX_LEVEL
from meshlark.functions.profiles import DOMAINS

# The manifest, version 1.
TOP_KEYS = ("manifest_version", "dataset_type", "grid_system", "grid_version", "domain_code", "domain_id", "level", "profile_version", "registry_version", "value_fields", "identity", "coverage", "source", "storage", "provenance")
FIELD_KEYS = ("name", "parquet_type", "logical_type", "semantics", "unit", "nullable", "aggregation_rule")
SECTION_KEYS = {
    "identity": ("gid_column", "uri_prefix", "packed_id_column", "x_idx_column", "y_idx_column", "unique_gid"),
    "coverage": ("assignment_method", "boundary_policy", "boundary_sha256", "coverage_mode", "min_coverage", "length_mode"),
    "source": ("format", "geometry_type", "source_crs", "source_id_column", "source_dataset", "source_row_count"),
    "storage": ("parquet_compression", "geometry_column", "geometry_format", "geometry_crs", "partitioning", "sorted_by", "row_count", "unique_cell_count"),
    "provenance": ("created_at", "created_by", "generator", "aggregation_rule", "value_semantics", "notes"),
}
RESERVED = ("domain", "level", "gid", "uri", "packed_id", "x_idx", "y_idx", "source_id", "source_row", "coverage_ratio", "length_ratio", "assignment_method", "boundary_policy", "geometry_wkb")
DATASET_TYPES = ("cell_values", "cell_contributions")
NUMERIC_SEMANTICS = ("COUNT", "TOTAL", "DENSITY", "MEASUREMENT", "RATE")
SEMANTICS_OF = {"numeric": NUMERIC_SEMANTICS, "categorical": ("CATEGORICAL",), "ordinal": ("ORDINAL",), "range": ("RANGE",)}
COMPRESSION = ("zstd", "snappy", "gzip", "brotli", "uncompressed")
BOUNDARY_POLICIES = ("COVERS_POINT", "CENTROID_COVERED", "INTERSECTS", "MIN_COVERAGE")
COVERAGE_MODES = ("GRID_PLANAR", "EQUAL_AREA")
GEOMETRY_FORMATS = ("wkb", "wkt", "shapely")
# The name of the grid is a parameter.
GRID = "metric-grid"

Test = Callable[[object], bool]


def _text(v) -> bool:
    return isinstance(v, str) and bool(v)


def _whole(low: int, high: float = float("inf")) -> Test:
    return lambda v: type(v) is int and low <= v <= high


def _texts(v) -> bool:
    return isinstance(v, list) and all(map(_text, v)) and len(set(v)) == len(v)


def _or_null(test: Test) -> Test:
    return lambda v: v is None or test(v)


def _one_of(values: Iterable) -> Test:
    return lambda v: isinstance(v, str) and v in values


def _matches(pattern: str) -> Test:
    return lambda v: isinstance(v, str) and re.fullmatch(pattern, v) is not None


_maybe_text, _flag = _or_null(lambda v: isinstance(v, str)), lambda v: type(v) is bool
_share = lambda v: type(v) in (int, float) and 0 <= v <= 1
#: What each value must be, by its place.
VALUES: dict[str, Test] = {
    "manifest_version": _one_of(("1.0",)),
    "dataset_type": _one_of(DATASET_TYPES),
    "grid_system": lambda v: v == GRID,
    "grid_version": _one_of(("2.0",)),
    "domain_code": _matches(r"[A-Z][A-Z0-9]{0,15}"),
    "domain_id": _whole(1, 511),
    "level": _whole(0, MAX_LEVEL),
    "profile_version": _text,
    "registry_version": _text,
    "identity.gid_column": _one_of(("gid",)),
    "identity.uri_prefix": _text,
    "identity.packed_id_column": _maybe_text,
    "identity.x_idx_column": _maybe_text,
    "identity.y_idx_column": _maybe_text,
    "identity.unique_gid": _flag,
    "coverage.assignment_method": _text,
    "coverage.boundary_policy": _or_null(_one_of(BOUNDARY_POLICIES)),
    "coverage.boundary_sha256": _or_null(_matches("[0-9a-f]{64}")),
    "coverage.coverage_mode": _or_null(_one_of(COVERAGE_MODES)),
    "coverage.min_coverage": _or_null(_share),
    "coverage.length_mode": _maybe_text,
    "source.format": _text,
    "source.geometry_type": _maybe_text,
    "source.source_crs": _maybe_text,
    "source.source_id_column": _maybe_text,
    "source.source_dataset": _maybe_text,
    "source.source_row_count": _or_null(_whole(0)),
    "storage.parquet_compression": _or_null(_one_of(COMPRESSION)),
    "storage.geometry_column": _maybe_text,
    "storage.geometry_format": _or_null(_one_of(GEOMETRY_FORMATS)),
    "storage.geometry_crs": _maybe_text,
    "storage.partitioning": _texts,
    "storage.sorted_by": _texts,
    "storage.row_count": _or_null(_whole(0)),  # null while a dataset is being written
    "storage.unique_cell_count": _or_null(_whole(0)),
    "provenance.created_at": _text,
    "provenance.created_by": _text,
    "provenance.generator": _text,
    "provenance.aggregation_rule": _maybe_text,
    "provenance.value_semantics": _or_null(_one_of([s for some in SEMANTICS_OF.values() for s in some])),
    "provenance.notes": _maybe_text,
}
#: What each value of a field must be.
FIELD_VALUES: dict[str, Test] = {
    "name": lambda v: _matches("[A-Za-z_][A-Za-z0-9_]*")(v) and v not in RESERVED,
    "parquet_type": _text,
    "logical_type": _one_of(SEMANTICS_OF),
    "semantics": _text,
    "unit": _maybe_text,
    "nullable": _flag,
    "aggregation_rule": _maybe_text,
}


def _index_columns(doc: dict) -> list:
    return [doc["identity"][k] for k in ("packed_id_column", "x_idx_column", "y_idx_column")]


def _counts_fit(doc: dict) -> bool:
    rows, cells = doc["storage"]["row_count"], doc["storage"]["unique_cell_count"]
    return rows is None or cells is None or (cells == rows if doc["dataset_type"] == "cell_values" else cells <= rows)


#: What must hold between values: a name, and the question.
BETWEEN: dict[str, Callable[[dict], bool]] = {
    "identity.uri_prefix is that of the domain": lambda d: d["identity"]["uri_prefix"] == f"{codec.URI_SCHEME}:v2:{d['domain_code']}:",
    "index columns come all three, with different names": lambda d: _index_columns(d) == [None] * 3 or len({*_index_columns(d)} - {None}) == 3,
    "one row a cell in cell_values": lambda d: d["dataset_type"] != "cell_values" or d["identity"]["unique_gid"],
    "geometry column, format and crs come together": lambda d: len({d["storage"][f"geometry_{k}"] is None for k in ("column", "format", "crs")}) == 1,
    "unique_cell_count fits row_count": _counts_fit,
    "value fields have names of their own": lambda d: len({f["name"] for f in d["value_fields"]}) == len(d["value_fields"]),
    "semantics fit the logical type": lambda d: all(f["semantics"] in SEMANTICS_OF[f["logical_type"]] for f in d["value_fields"]),
}


def problems(doc: object) -> list[str]:
    """Everything in a document that breaks the contract; shape first, then values, then what holds between them."""
    if not isinstance(doc, dict):
        return ["a manifest is an object"]
    found = [f"keys {sorted(set(doc) ^ set(TOP_KEYS))}"] if set(doc) != set(TOP_KEYS) else []
    for section, keys in SECTION_KEYS.items():
        if not isinstance(doc.get(section), dict) or set(doc[section]) != set(keys):
            found.append(f"keys of {section}")
    fields = doc.get("value_fields")
    if not isinstance(fields, list) or not fields or any(not isinstance(f, dict) or set(f) != set(FIELD_KEYS) for f in fields):
        found.append("value_fields")
    if found:
        return found
    at = lambda place: doc[place.split(".")[0]][place.split(".")[1]] if "." in place else doc[place]
    found = [f"{place} = {at(place)!r}" for place, test in VALUES.items() if not test(at(place))]
    found += [f"value_fields[{k}].{key} = {f[key]!r}" for k, f in enumerate(fields) for key, test in FIELD_VALUES.items() if not test(f[key])]
    return found or [name for name, holds in BETWEEN.items() if not holds(doc)]


def check(doc: dict, profiles: dict[str, dict] | None = None, columns: Iterable[str] | None = None) -> dict:
    """The document, if it keeps the contract, names a known domain, and fits trusted profiles and columns where given.

    profiles: by domain code, with domain_id, and where they are to be compared profile_version and boundary_sha256.
    """
    found = problems(doc)
    if not found:
        trusted = profiles if profiles is not None else {c: {"domain_id": d.id} for c, d in DOMAINS.items()}
        known = trusted.get(doc["domain_code"])
        if known is None or known["domain_id"] != doc["domain_id"]:
            found.append("domain_code and domain_id name no trusted domain")
        elif known.get("profile_version") not in (None, doc["profile_version"]):
            found.append("profile_version isn't the trusted one")
        elif None not in (sha := {known.get("boundary_sha256"), doc["coverage"]["boundary_sha256"]}) and len(sha) > 1:
            found.append("boundary_sha256 isn't the trusted one")
    if not found and columns is not None:
        have = list(columns)
        wanted = ["gid", *(f["name"] for f in doc["value_fields"]), *filter(None, (*_index_columns(doc), doc["storage"]["geometry_column"]))]
        found += [f"no column {c}" for c in wanted if c not in have]
        if len(set(have)) < len(have):
            found.append("columns share a name")
        if doc["dataset_type"] == "cell_contributions" and not {"source_id", "source_row"} & set(have):
            found.append("contributions need source_id or source_row")
    if found:
        raise ManifestError("the manifest breaks its contract: " + "; ".join(found))
    return doc
