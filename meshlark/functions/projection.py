"""WGS 84 to grid and back by published formulas, written once for Columns and for numpy.

A projection is a list of named steps. For a DataFrame each step becomes a column, so a value that several later steps use
is computed once; for numpy arrays the steps run as they are. Sources: Snyder 1987 (Lambert conformal conic, conformal
latitude series), Krueger's series (transverse Mercator), IOGP guidance note 7-2 (Helmert, geocentric conversion), Savric
et al. 2018 (Equal Earth).
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from meshlark.errors import ContractError
from meshlark.functions.profiles import ELLIPSOIDS, Domain, Helmert

Steps = list[tuple[str, Callable]]


class _Arrays:
    sin, cos, tan, log, exp, sqrt, sinh, cosh, atanh, asinh, atan, asin = np.sin, np.cos, np.tan, np.log, np.exp, np.sqrt, np.sinh, np.cosh, np.arctanh, np.arcsinh, np.arctan, np.arcsin
    atan2, pow = np.arctan2, np.power


class _Columns:
    sin, cos, tan, log, exp, sqrt, sinh, cosh, atanh, asinh, atan, asin = F.sin, F.cos, F.tan, F.log, F.exp, F.sqrt, F.sinh, F.cosh, F.atanh, F.asinh, F.atan, F.asin
    atan2, pow = F.atan2, F.pow


def _e2(ellipsoid: str) -> tuple[float, float]:
    a, f = ELLIPSOIDS[ellipsoid]
    return a, f * (2 - f)


def _cartesian(ellipsoid: str) -> Steps:
    a, e2 = _e2(ellipsoid)
    return [
        ("s", lambda m, v: m.sin(v["phi"])),
        ("n", lambda m, v: a * m.pow(1 - e2 * v["s"] * v["s"], -0.5)),
        ("r", lambda m, v: v["n"] * m.cos(v["phi"])),
        ("X", lambda m, v: v["r"] * m.cos(v["lam"])),
        ("Y", lambda m, v: v["r"] * m.sin(v["lam"])),
        ("Z", lambda m, v: v["n"] * (1 - e2) * v["s"]),
    ]


def _geographic(ellipsoid: str) -> Steps:
    """Bowring's formula, twice; the height is dropped."""
    a, e2 = _e2(ellipsoid)
    b = a * math.sqrt(1 - e2)
    second = e2 / (1 - e2)
    lat = lambda m, v: m.atan2(v["Z"] + second * b * m.pow(m.sin(v["t"]), 3.0), v["p"] - e2 * a * m.pow(m.cos(v["t"]), 3.0))
    return [
        ("lam", lambda m, v: m.atan2(v["Y"], v["X"])),
        ("p", lambda m, v: m.sqrt(v["X"] * v["X"] + v["Y"] * v["Y"])),
        ("t", lambda m, v: m.atan2(v["Z"] * a, v["p"] * b)),
        ("phi", lat),
        ("t", lambda m, v: m.atan2(b * m.sin(v["phi"]), a * m.cos(v["phi"]))),
        ("phi", lat),
    ]


def _shift(h: Helmert, forward: bool) -> Steps:
    scale = 1 + h.s * 1e-6
    rx, ry, rz = (math.radians(r / 3600) for r in (h.rx, h.ry, h.rz))
    rows = np.array([[1, rz, -ry], [-rz, 1, rx], [ry, -rx, 1]])
    t = np.array([h.x, h.y, h.z])
    if h.inverse == forward:
        rows, at, add = rows.T / scale, -t, np.zeros(3)
    else:
        rows, at, add = rows * scale, np.zeros(3), t
    add = add + rows @ at
    line = lambda k: lambda m, v: sum((float(rows[k, j]) * v[c] for j, c in enumerate("XYZ")), float(add[k]))
    return [("A", line(0)), ("B", line(1)), ("C", line(2)), *((c, (lambda name: lambda m, v: v[name])(s)) for c, s in zip("XYZ", "ABC"))]


def _conformal_to_geodetic(e2: float) -> Callable:
    """Snyder 3-5."""
    c = (
        e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12 + 13 * e2**4 / 360,
        7 * e2**2 / 48 + 29 * e2**3 / 240 + 811 * e2**4 / 11520,
        7 * e2**3 / 120 + 81 * e2**4 / 1120,
        4279 * e2**4 / 161280,
    )
    return lambda m, v: v["chi"] + sum(k * m.sin(2 * (i + 1) * v["chi"]) for i, k in enumerate(c))


def _lcc(d: Domain) -> tuple[Steps, Steps]:
    a, e2 = _e2(d.ellipsoid)
    e = math.sqrt(e2)
    lat0, lat1, lat2, lon0 = (math.radians(d.params[k]) for k in ("lat0", "lat1", "lat2", "lon0"))
    m_ = lambda x: math.cos(x) / math.sqrt(1 - e2 * math.sin(x) ** 2)
    t_ = lambda x: math.tan(math.pi / 4 - x / 2) / ((1 - e * math.sin(x)) / (1 + e * math.sin(x))) ** (e / 2)
    n = (math.log(m_(lat1)) - math.log(m_(lat2))) / (math.log(t_(lat1)) - math.log(t_(lat2)))
    af = a * m_(lat1) / (n * t_(lat1) ** n)
    rho0 = af * t_(lat0) ** n
    forward: Steps = [
        ("s", lambda m, v: e * m.sin(v["phi"])),
        ("t", lambda m, v: m.tan(math.pi / 4 - v["phi"] * 0.5) * m.pow(1 - v["s"], -e / 2) * m.pow(1 + v["s"], e / 2)),
        ("rho", lambda m, v: af * m.pow(v["t"], n)),
        ("theta", lambda m, v: n * (v["lam"] - lon0)),
        ("x", lambda m, v: v["rho"] * m.sin(v["theta"])),
        ("y", lambda m, v: rho0 - v["rho"] * m.cos(v["theta"])),
    ]
    sign = math.copysign(1.0, n)
    inverse: Steps = [
        ("rho", lambda m, v: sign * m.sqrt(v["x"] * v["x"] + (rho0 - v["y"]) * (rho0 - v["y"]))),
        ("lam", lambda m, v: m.atan2(sign * v["x"], sign * (rho0 - v["y"])) / n + lon0),
        ("chi", lambda m, v: math.pi / 2 - 2 * m.atan(m.pow(v["rho"] / af, 1 / n))),
        ("phi", _conformal_to_geodetic(e2)),
    ]
    return forward, inverse


def _tmerc(d: Domain) -> tuple[Steps, Steps]:
    a, e2 = _e2(d.ellipsoid)
    e, f = math.sqrt(e2), ELLIPSOIDS[d.ellipsoid][1]
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    lat0, lon0 = math.radians(d.params["lat0"]), math.radians(d.params["lon0"])
    xi0 = math.atan(math.sinh(math.atanh(math.sin(lat0)) - e * math.atanh(e * math.sin(lat0))))
    y0 = radius * (xi0 + sum(k * math.sin(2 * (i + 1) * xi0) for i, k in enumerate(alpha)))
    forward: Steps = [
        ("q", lambda m, v: m.sinh(m.atanh(m.sin(v["phi"])) - e * m.atanh(e * m.sin(v["phi"])))),
        ("xi", lambda m, v: m.atan2(v["q"], m.cos(v["lam"] - lon0))),
        ("eta", lambda m, v: m.asinh(m.sin(v["lam"] - lon0) / m.sqrt(v["q"] * v["q"] + m.cos(v["lam"] - lon0) * m.cos(v["lam"] - lon0)))),
        ("x", lambda m, v: radius * (v["eta"] + sum(k * m.cos(2 * (i + 1) * v["xi"]) * m.sinh(2 * (i + 1) * v["eta"]) for i, k in enumerate(alpha)))),
        ("y", lambda m, v: radius * (v["xi"] + sum(k * m.sin(2 * (i + 1) * v["xi"]) * m.cosh(2 * (i + 1) * v["eta"]) for i, k in enumerate(alpha))) - y0),
    ]
    inverse: Steps = [
        ("xi0", lambda m, v: (v["y"] + y0) / radius),
        ("eta0", lambda m, v: v["x"] / radius),
        ("xi", lambda m, v: v["xi0"] - sum(k * m.sin(2 * (i + 1) * v["xi0"]) * m.cosh(2 * (i + 1) * v["eta0"]) for i, k in enumerate(beta))),
        ("eta", lambda m, v: v["eta0"] - sum(k * m.cos(2 * (i + 1) * v["xi0"]) * m.sinh(2 * (i + 1) * v["eta0"]) for i, k in enumerate(beta))),
        ("chi", lambda m, v: m.asin(m.sin(v["xi"]) / m.cosh(v["eta"]))),
        ("lam", lambda m, v: m.atan2(m.sinh(v["eta"]), m.cos(v["xi"])) + lon0),
        ("phi", _conformal_to_geodetic(e2)),
    ]
    return forward, inverse


def _merc(d: Domain) -> tuple[Steps, Steps]:
    a, e2 = _e2(d.ellipsoid)
    e, lon0 = math.sqrt(e2), math.radians(d.params.get("lon0", 0.0))
    forward: Steps = [("x", lambda m, v: a * (v["lam"] - lon0)), ("y", lambda m, v: a * (m.asinh(m.tan(v["phi"])) - e * m.atanh(e * m.sin(v["phi"]))))]
    inverse: Steps = [("lam", lambda m, v: v["x"] / a + lon0), ("chi", lambda m, v: m.atan(m.sinh(v["y"] / a))), ("phi", _conformal_to_geodetic(e2))]
    return forward, inverse


def _steps(d: Domain) -> tuple[Steps, Steps]:
    forward, inverse = {"lcc": _lcc, "tmerc": _tmerc, "merc": _merc}[d.projection](d)
    if d.datum:
        forward = [*_cartesian("WGS84"), *_shift(d.datum, True), *_geographic(d.ellipsoid), *forward]
        inverse = [*inverse, *_cartesian(d.ellipsoid), *_shift(d.datum, False), *_geographic("WGS84")]
    return forward, inverse


def _run(m, steps: Steps, values: dict) -> dict:
    for name, step in steps:
        values[name] = step(m, values)
    return values


def _run_columns(df: DataFrame, steps: Steps, inputs: dict[str, Column], outputs: dict[str, Callable[[dict], Column]]) -> DataFrame:
    """Adds the outputs to df; columns of intermediate steps don't stay."""
    before = df.columns
    tag, at = "_step_", {}
    # Steps see no nulls, and divide by nothing but where they must: code for nulls at each step would double the size of
    # the generated method, and the JVM doesn't compile methods that are too large.
    there = F.lit(True)
    for k, c in inputs.items():
        there = c.isNotNull() if k == next(iter(inputs)) else there & c.isNotNull()
    df = df.select("*", there.alias(f"{tag}there"), *(F.coalesce(c, F.lit(0.0)).alias(f"{tag}{k}") for k, c in inputs.items()))
    values = {k: F.col(f"{tag}{k}") for k in inputs}
    for i, (name, step) in enumerate(steps):
        at[name] = f"{tag}{name}_{i}"
        df = df.withColumn(at[name], step(_Columns, values))
        values[name] = F.col(at[name])
    return df.select(*(F.col(f"`{c}`") for c in before if c not in outputs), *(F.when(F.col(f"{tag}there"), f(values)).alias(k) for k, f in outputs.items()))


def to_grid(d: Domain, lon, lat) -> tuple[np.ndarray, np.ndarray]:
    v = _run(_Arrays, _steps(d)[0], {"lam": np.radians(lon), "phi": np.radians(lat)})
    return v["x"], v["y"]


def from_grid(d: Domain, x, y) -> tuple[np.ndarray, np.ndarray]:
    v = _run(_Arrays, _steps(d)[1], {"x": np.asarray(x, float), "y": np.asarray(y, float)})
    return np.degrees(v["lam"]), np.degrees(v["phi"])


def with_grid_xy(df: DataFrame, d: Domain, lon: str, lat: str, x: str = "x_m", y: str = "y_m") -> DataFrame:
    """Adds projected coordinates of WGS 84 longitude and latitude; all of it stays in generated code."""
    radians = [("lam", lambda m, v: v["lon"] * (math.pi / 180)), ("phi", lambda m, v: v["lat"] * (math.pi / 180))]
    return _run_columns(df, [*radians, *_steps(d)[0]], {"lon": F.col(lon), "lat": F.col(lat)}, {x: lambda v: v["x"], y: lambda v: v["y"]})


def with_lonlat(df: DataFrame, d: Domain, x: str, y: str, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    return _run_columns(df, _steps(d)[1], {"x": F.col(x).cast("double"), "y": F.col(y).cast("double")}, {lon: lambda v: F.degrees(v["lam"]), lat: lambda v: F.degrees(v["phi"])})


def equal_earth(lon, lat) -> tuple[np.ndarray, np.ndarray]:
    """Equal Earth (EPSG:8857) on WGS 84."""
    a, e2 = _e2("WGS84")
    e = math.sqrt(e2)
    q = lambda s: (1 - e2) * (s / (1 - e2 * s * s) + np.arctanh(e * s) / e)
    beta = np.arcsin(np.clip(q(np.sin(np.radians(lat))) / q(1.0), -1, 1))
    radius = a * math.sqrt(q(1.0) / 2)
    theta = np.arcsin(math.sqrt(3) / 2 * np.sin(beta))
    c = (1.340264, -0.081106, 0.000893, 0.003796)
    slope = c[0] + 3 * c[1] * theta**2 + theta**6 * (7 * c[2] + 9 * c[3] * theta**2)
    x = radius * 2 * np.radians(lon) * np.cos(theta) / (math.sqrt(3) * slope)
    return x, radius * theta * (c[0] + c[1] * theta**2 + theta**6 * (c[2] + c[3] * theta**2))


def inside_area(d: Domain, lon: Column, lat: Column) -> Column:
    west, south, east, north = d.area
    return lon.between(west, east) & lat.between(south, north)


def require_released(d: Domain, allow_candidate: bool) -> None:
    if not d.released and not allow_candidate:
        raise ContractError(f"domain {d.code} is a {d.status}; pass allow_candidate=True to use it")
