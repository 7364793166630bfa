"""The eleven domains: ids, projections, datum steps and areas of use. Angles in degrees, lengths in metres."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from meshlark.errors import ContractError, UnknownDomainError
from meshlark.functions.constants import ORIGIN, ROOT_SIDE

# Ellipsoids as (semi-major axis, flattening).
ELLIPSOIDS = {
    "WGS84": (6378137.0, 1 / 298.257223563),
    "GRS80": (6378137.0, 1 / 298.257222101),
    "krass": (6378245.0, 1 / 298.3),
    "clrk66": (6378206.4, (6378206.4 - 6356583.8) / 6378206.4),
    "sphere": (6378137.0, 0.0),
}


@dataclass(frozen=True)
class Helmert:
    """Translation in metres, rotation in arc seconds (coordinate frame), scale in parts per million."""

    x: float
    y: float
    z: float
    rx: float = 0.0
    ry: float = 0.0
    rz: float = 0.0
    s: float = 0.0
    inverse: bool = False


@dataclass(frozen=True)
class Domain:
    code: str
    id: int
    projection: str  # lcc, tmerc or merc
    params: dict[str, float] = field(hash=False)
    ellipsoid: str
    area: tuple[float, float, float, float]  # west, south, east, north
    status: str
    datum: Helmert | None = None

    @property
    def released(self) -> bool:
        return self.status == "released"


def _lcc(lat0: float, lon0: float, lat1: float, lat2: float) -> dict[str, float]:
    return {"lat0": lat0, "lon0": lon0, "lat1": lat1, "lat2": lat2}


# The domains.
DOMAINS = {
    d.code: d
    for d in (
        Domain("ID", 1, "lcc", _lcc(-2.55029564999998, 118.01521445, -8.18864928333332, 3.08805798333335), "WGS84", (92.01, -13.95, 141.46, 7.79), "released", Helmert(-0.2773, 0.0534, 0.4819, 0.0192857593841035, -0.00589917345866696, 0.00199870597253436, -0.028)),
        Domain("VN", 2, "lcc", _lcc(16.0, 107.5, 11.0, 21.0), "WGS84", (102.14, 8.33, 109.53, 23.4), "candidate", Helmert(-191.90441429, -39.30318279, -111.45032835, -0.00928836, 0.01975479, -0.00427372, 0.252906278, True)),
        Domain("BN", 3, "lcc", _lcc(4.52406018063286, 114.722756845902, 4.17561629985239, 4.87250406141333), "GRS80", (114.0, 3.9, 115.5, 5.2), "released"),
        Domain("KH", 4, "lcc", _lcc(12.30190505, 104.9807535, 10.70968015, 13.89412995), "WGS84", (102.2, 9.8, 107.8, 14.8), "candidate"),
        Domain("LA", 5, "lcc", _lcc(18.2061856, 103.8596618, 15.3418453333334, 21.0705258666667), "krass", (100.09, 13.92, 107.64, 22.5), "released", Helmert(-44.585, 131.212, 39.544)),
        Domain("MY", 6, "lcc", _lcc(4.10831925000002, 109.4548108, 1.93865375000001, 6.27798475000003), "GRS80", (99.5, 0.7, 119.4, 7.5), "released"),
        Domain("MM", 7, "lcc", _lcc(19.108395482, 96.6713193360001, 12.816966562, 25.3998244020001), "WGS84", (92.0, 9.5, 101.3, 28.7), "candidate"),
        Domain("PH", 8, "lcc", _lcc(12.8545389070001, 120.441429557, 7.34304263366674, 18.3660351803334), "clrk66", (116.04, 3.0, 129.95, 22.18), "released", Helmert(-127.62, -67.24, -47.04, 3.068, -4.903, -1.578, -1.06, True)),
        Domain("SG", 9, "tmerc", {"lat0": 1.3299809, "lon0": 103.8469117}, "WGS84", (103.5, 1.1, 104.2, 1.6), "released"),
        Domain("TH", 10, "lcc", _lcc(13.03884235, 101.4903096, 8.08818145000001, 17.98950325), "WGS84", (97.2, 5.5, 105.8, 20.6), "candidate"),
        Domain("TL", 11, "lcc", _lcc(-8.81553470000003, 125.6918511, -9.27462523333337, -8.35644416666669), "WGS84", (123.9, -9.6, 127.5, -8.0), "candidate"),
    )
}


def domain(code: str) -> Domain:
    try:
        return DOMAINS[code]
    except KeyError:
        raise UnknownDomainError(f"no domain {code!r}") from None


def domain_table(spark: SparkSession) -> DataFrame:
    """A row for each domain; eleven rows, whatever the data."""
    rows = [(d.id, d.code, d.projection, d.ellipsoid, d.status, d.released, *d.area, ORIGIN, ROOT_SIDE) for d in DOMAINS.values()]
    return spark.createDataFrame(rows, "domain_id int, domain string, projection string, ellipsoid string, support_status string, production_ready boolean, west double, south double, east double, north double, origin double, root_side double")


def parse_pipeline(pipeline: str) -> tuple[str, dict[str, float], str, Helmert | None]:
    """Projection, its parameters, ellipsoid and datum step of an explicit pipeline string (lcc, tmerc, helmert, cart)."""
    datum, projection, params, ellipsoid = None, None, {}, "WGS84"
    for step in pipeline.split(" step ")[1:]:
        words = step.split()
        inverse = "inv" in words
        values = dict(w.split("=", 1) for w in words if "=" in w)
        kind = values.pop("proj", None)
        if kind == "helmert":
            if values.pop("convention", "coordinate_frame") != "coordinate_frame":
                raise ContractError("only the coordinate frame convention is supported")
            datum = Helmert(**{k: float(v) for k, v in values.items()}, inverse=inverse)
        elif kind in ("lcc", "tmerc", "merc"):
            projection, ellipsoid = kind, values.get("ellps", "WGS84")
            params = {k.replace("_", ""): float(v) for k, v in values.items() if k in ("lat_0", "lon_0", "lat_1", "lat_2")}
        elif kind not in ("unitconvert", "push", "pop", "cart", None):
            raise ContractError(f"pipeline step {kind!r} is not supported")
    if projection is None:
        raise ContractError("the pipeline has no projection")
    return projection, params, ellipsoid, datum


def load_profile(path: str) -> Domain:
    """A domain from a profile document (JSON) with an explicit WGS 84 pipeline in longitude, latitude order."""
    doc = json.loads(Path(path).read_text(encoding="utf-8"))
    t = doc["datum_transformation"]
    if t["source_crs"] != "EPSG:4326" or t["axis_order"] != "longitude_latitude":
        raise ContractError("the pipeline must start from EPSG:4326 in longitude, latitude order")
    if doc["root_side_m"] != ROOT_SIDE or (doc["origin_x_m"], doc["origin_y_m"]) != (ORIGIN, ORIGIN) or not 1 <= doc["domain_id"] <= 511:
        raise ContractError("the profile doesn't fit the grid")
    projection, params, ellipsoid, datum = parse_pipeline(t["operation_pipeline"])
    a = t["area_of_use"]
    return Domain(doc["domain_code"], doc["domain_id"], projection, params, ellipsoid, (a["west_lon"], a["south_lat"], a["east_lon"], a["north_lat"]), doc["support_status"], datum)
