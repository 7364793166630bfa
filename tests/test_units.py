"""Rules of the grid on literals and small tables: conformance, edge cases, and failures."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlark.errors import CandidateLimitError, CompactSetError, ContractError, DatasetError, DependencyError, ManifestError, TimeCubeError, UnknownDomainError
from meshlark.functions import codec, constants as C, periods, profiles, projection, shapes, topology
from meshlark.operators import aggregate as agg, compact, crosswalk, detect, encode, geometry as G, legacy, services, timecube
from meshlark.plans import sqlfuncs
from meshlark.sources import datasets, manifests, registry, tables


def gid(level, x, y):
    return G.gid_text(level, x, y)


def packed(domain, level, x, y):
    code, shift = 0, 0
    for s in reversed(C.STEPS[:level]):
        code |= (y % s * s + x % s) << shift
        shift += 5 if s == 5 else 2
        x, y = x // s, y // s
    return domain << 54 | level << 50 | code << 1


def test_levels():
    edges = [50_000_000, 10_000_000, 5_000_000, 1_000_000, 500_000, 100_000, 50_000, 10_000, 5_000, 1_000, 500, 100, 50, 10, 5]
    assert [C.cell_side(k) for k in range(15)] == edges
    for bad in (-1, 15, True, "3", 2.0):
        with pytest.raises(ContractError):
            C.cell_count(bad)


def test_codec_round_trips_at_every_level(spark):
    rng = random.Random(1)
    for level in range(15):
        n = C.COUNTS[level]
        cells = {(0, 0), (n - 1, n - 1), *((rng.randrange(n), rng.randrange(n)) for _ in range(20))}
        df = spark.createDataFrame(sorted(cells), "x bigint, y bigint")
        out = df.select("x", "y", codec.gid_of("x", "y", level).alias("gid"), codec.pack(11, "x", "y", level).alias("p"))
        out = out.select("*", codec.gid_to_cell("gid").alias("g"), codec.unpack("p", level).alias("u"), codec.unpack_any("p").alias("a"))
        for r in out.collect():
            assert r["gid"] == gid(level, r["x"], r["y"]) and r["p"] == packed(11, level, r["x"], r["y"])
            assert tuple(r["g"]) == (level, r["x"], r["y"]) and tuple(r["u"]) == tuple(r["a"]) == (11, level, r["x"], r["y"])


def test_bad_identities_are_null(spark):
    gids = spark.createDataFrame([("1",), ("H6",), ("H" * 15,), ("h",), (None,), ("H0",)], "gid string").select(codec.gid_to_cell("gid").alias("c"))
    assert all(r["c"] is None for r in gids.collect())
    good = packed(1, 3, 7, 9)
    bad = [-1, good | 1, good & ~(511 << 54), good | 15 << 50, good | 1 << 40, 1 << 54 | 1 << 50 | 25 << 1]
    df = spark.createDataFrame([(v,) for v in bad], "p bigint").select(codec.unpack_any("p").alias("c"))
    assert all(r["c"] is None for r in df.collect())
    u = spark.createDataFrame([("cell:v2:ID:H2",), ("cell:v1:ID:H2",), ("cell:v2:id:H2",), ("x",)], "u string").select(codec.parse_uri("u").alias("c"))
    assert [r["c"] and tuple(r["c"]) for r in u.collect()] == [("ID", "H2"), None, None, None]


def test_root_edges_and_modes(spark):
    rows = [(-25e6, -25e6), (25e6, 25e6), (math.nextafter(25e6, 0), 0.0), (25e6 + 1, 0.0), (None, 0.0), (float("nan"), 0.0)]
    df = spark.createDataFrame(rows, "x double, y double")
    got = [(r["x_idx"], r["y_idx"]) for r in encode.encode_projected(df, "x", "y", "ID", 12).collect()]
    assert got == [(0, 0), (999_999, 999_999), (999_999, 500_000), (None, None), (None, None), (None, None)]
    with pytest.raises(Exception, match="outside the root"):
        encode.encode_projected(df, "x", "y", "ID", 12, mode="fail").collect()
    with pytest.raises(UnknownDomainError):
        encode.encode_projected(df, "x", "y", "XX", 12)
    with pytest.raises(ContractError):
        encode.encode_projected(df, "x", "missing", "ID", 12)


# Published points: domain, longitude, latitude and the gid at level 12.
POINTS = [
    ("ID", 113.321534, 0.114714, "H462L5W3L2Y3"), ("ID", 106.8456, -6.2088, "H2X545V394J4"), ("VN", 107.868144, 15.981051, "H3T4T4X5R225"), ("BN", 114.535538, 4.525753, "H46363436294"),
    ("KH", 105.132458, 12.547473, "H52222G5G2E5"), ("LA", 104.692439, 18.206297, "H522235343L3"), ("MY", 102.08728, 3.995855, "H2Y4V5X292R2"), ("MM", 95.919335, 19.259754, "H463629484R2"),
    ("PH", 125.236552, 7.689755, "H3T3T2P55572"), ("SG", 103.830237, 1.340438, "H4636363C284"), ("TH", 101.700176, 13.038762, "H52222424333"), ("TL", 125.757875, -8.893209, "H3T4T4T392W3"),
]


@pytest.mark.parametrize("code", sorted(profiles.DOMAINS))
def test_published_points(spark, code):
    own = [p for p in POINTS if p[0] == code]
    df = spark.createDataFrame([p[1:] for p in own], "lon double, lat double, want string")
    for level in (5, 7, 9, 12):
        out = encode.encode_lonlat(df, "lon", "lat", code, level, allow_candidate=True)
        assert all(r["gid"] == r["want"][:level] for r in out.collect())
    d = profiles.domain(code)
    x, y = projection.to_grid(d, [p[1] for p in own], [p[2] for p in own])
    lon, lat = projection.from_grid(d, x, y)
    assert np.allclose(lon, [p[1] for p in own], atol=3e-8) and np.allclose(lat, [p[2] for p in own], atol=3e-8)
    if not d.released:
        with pytest.raises(ContractError):
            encode.encode_lonlat(df, "lon", "lat", code, 9)


def test_lonlat_area(spark):
    df = spark.createDataFrame([(106.8, -6.2), (10.0, 50.0)], "lon double, lat double")
    assert [r["gid"] is None for r in encode.encode_lonlat(df, "lon", "lat", "ID", 9).collect()] == [False, True]
    with pytest.raises(Exception, match="area of use"):
        encode.encode_lonlat(df, "lon", "lat", "ID", 9, mode="fail").collect()


def test_pipelines_parse():
    text = "proj=pipeline step proj=unitconvert xy_in=deg xy_out=rad step proj=push v_3 step proj=cart ellps=WGS84 step inv proj=helmert x=-127.62 y=-67.24 z=-47.04 rx=3.068 ry=-4.903 rz=-1.578 s=-1.06 convention=coordinate_frame step inv proj=cart ellps=clrk66 step proj=pop v_3 step proj=lcc lat_0=12.8545389070001 lon_0=120.441429557 lat_1=7.34304263366674 lat_2=18.3660351803334 x_0=0 y_0=0 ellps=clrk66"
    d = profiles.DOMAINS["PH"]
    assert profiles.parse_pipeline(text) == (d.projection, d.params, d.ellipsoid, d.datum)
    with pytest.raises(ContractError):
        profiles.parse_pipeline("proj=pipeline step proj=utm zone=1")


def test_equal_earth_keeps_area():
    for lat in (0.0, 20.0, 50.0):
        lon = np.array([10.0, 10.01, 10.01, 10.0, 10.0])
        ys = np.array([lat, lat, lat + 0.01, lat + 0.01, lat])
        got = shapes.ring_area(np.stack(projection.equal_earth(lon, ys), 1))
        a, e2 = 6378137.0, 0.00669437999014
        s = math.sin(math.radians(lat + 0.005))
        true = math.radians(0.01) ** 2 * a * a * (1 - e2) * math.cos(math.radians(lat + 0.005)) / (1 - e2 * s * s) ** 2
        assert got == pytest.approx(true, rel=1e-6)


def test_hierarchy(spark):
    df = spark.createDataFrame([("",), ("H",), ("H4",), ("H46363436294",)], "gid string")
    r = df.select("gid", topology.parent_gid("gid").alias("p"), topology.ancestors("gid").alias("a"), topology.child_gids("gid").alias("c")).collect()
    assert [x["p"] for x in r] == [None, "", "H", "H4636343629"]
    assert [len(x["a"]) for x in r] == [0, 1, 2, 12] and [len(x["c"]) for x in r] == [25, 4, 25, 25]
    assert r[1]["c"] == ["H2", "H3", "H4", "H5"]
    lo, hi = codec.descendant_range(3, "H4", 5)
    inside = packed(3, 5, 4 * 50 + 7, 5 * 50 + 49)
    assert lo <= inside <= hi and not lo <= packed(3, 5, 0, 0) <= hi
    with pytest.raises(ContractError):
        topology.parent_indices("x", "y", 0)
    corner = spark.createDataFrame([(0, 0)], "x bigint, y bigint")
    assert topology.disk(corner, "x", "y", 3, 1).count() == 4 and topology.disk(corner, "x", "y", 3, 0, ring=True).count() == 1


def test_aggregation_rules(spark):
    df = spark.createDataFrame([("A", 10.0, 0.25, "forest"), ("A", 20.0, 0.75, "urban"), ("B", 5.0, 1.0, "forest"), ("C", None, 1.0, None)], "gid string, v double, w double, k string")
    one = lambda rule, **o: {r["gid"]: r["v"] for r in agg.numeric(df, "v", rule, **o).collect()}
    assert one("weighted_sum", weight="w")["A"] == one("weighted_mean", weight="w")["A"] == 17.5
    assert one("count") == {"A": 2, "B": 1, "C": 1} and one("std")["A"] == 5.0 and one("quantile", q=0.3)["A"] == 13.0
    assert math.isnan(one("sum", strict_nan=True)["C"])
    assert one("median", weight="w")["A"] == 20.0
    cats = {r["gid"]: tuple(r)[1:] for r in agg.categorical(df, "k", "majority_weighted", "w").collect()}
    assert cats["A"] == ("urban", 0.75, 2)
    ties = spark.createDataFrame([("A", "x"), ("A", "y")], "gid string, k string")
    assert agg.categorical(ties, "k").first()["k"] == "y" and agg.categorical(ties, "k", "priority_order").first()["k"] == "x"
    with pytest.raises(Exception, match="negative"):
        agg.numeric(df.withColumn("w", F.lit(-1.0)), "v", "weighted_mean", "w").collect()
    with pytest.raises(Exception, match="all zero"):
        agg.numeric(df.withColumn("w", F.lit(0.0)), "v", "sum", "w").collect()
    with pytest.raises(Exception, match="exceeds"):
        agg.ranged(df.withColumn("lo", F.lit(2)).withColumn("hi", F.lit(1)), "lo", "hi").collect()
    with pytest.raises(ContractError):
        agg.numeric(df, "v", "mode")
    with pytest.raises(Exception, match="denominator is zero"):
        agg.contributions(df.withColumn("d", F.lit(0.0)), "RATE", numerator="v", denominator="d").collect()
    out = agg.contributions(df.withColumn("coverage_ratio", F.col("w")), "TOTAL", "v", output="t")
    assert {r["gid"]: r["t"] for r in out.collect()}["A"] == 17.5 and out.schema["t"].metadata["lineage"]["semantics"] == "TOTAL"
    assert agg.to_cells(df, "numeric", "v").count() == 3


def test_compact_sets(spark):
    make = lambda gids: spark.createDataFrame([(g,) for g in gids], "gid string")
    run = lambda gids: sorted(r["gid"] for r in compact.canonicalize(make(gids)).collect())
    five, two = C.ALPHABETS[5], C.ALPHABETS[2]
    assert run(list(five)) == [""] and run(["H", "H", "H4", "H46"]) == ["H"]
    assert run([f"H{c}" for c in two]) == ["H"] and run([f"H4{c}" for c in five[:-1]]) == sorted(f"H4{c}" for c in five[:-1])
    mixed = ["H2", "H3", "H4", *(f"H5{c}" for c in five)]
    assert run(mixed) == ["H"] and run(["bad", "H2"]) == ["H2"] and run([]) == []
    rng = random.Random(2)
    for _ in range(5):
        gids = [gid(k, rng.randrange(C.COUNTS[k]), rng.randrange(C.COUNTS[k])) for k in (rng.choice((1, 2)) for _ in range(40))]
        once = run(gids)
        assert run(once) == once
        full = lambda g: {r["gid"] for r in compact.expand(make(g), 3).collect()}
        assert full(once) == full([x for x in set(gids)])
        compact.validate(make(once).withColumn("level", F.length("gid")))
    with pytest.raises(CompactSetError):
        compact.validate(make(["H", "H4"]).withColumn("level", F.length("gid")))
    with pytest.raises(Exception, match="finer"):
        compact.expand(make(["H46"]), 2).collect()


def test_periods(spark):
    good = [("2024", "year", None), ("2024-02", "month", None), ("2024-02-29", "day", None), ("2024-01-01T08", "hour", 4)]
    bad = [("24", "year", None), ("0000", "year", None), ("2024-13", "month", None), ("2023-02-29", "day", None), ("2024-01-01T03", "hour", 4), ("2024-01-01T24", "hour", 1), ("2024-1-1", "day", None), ("2024-01-01T00Z", "hour", 1)]
    one = spark.range(1)
    for label, kind, hours in good:
        r = one.select(periods.start_of(F.lit(label), kind, hours).alias("a"), periods.end_of(F.lit(label), kind, hours).alias("b")).first()
        assert r["a"] < r["b"] and one.select(periods.label_of(F.lit(r["a"]), kind, hours).alias("l")).first()["l"] == label
    for label, kind, hours in bad:
        assert one.select(periods.start_of(F.lit(label), kind, hours).alias("a")).first()["a"] is None, label
    assert one.select(periods.end_of(F.lit("9999"), "year").alias("b")).first()["b"] is None
    with pytest.raises(TimeCubeError):
        periods.start_of(F.lit("x"), "hour", 5)
    assert periods.rollup_rule("COUNT") == "sum" and periods.rollup_rule("MEASUREMENT", "max") == "max"
    for args in (("MEASUREMENT",), ("CATEGORICAL", "mean")):
        with pytest.raises(TimeCubeError):
            periods.rollup_rule(*args)
    cube = spark.createDataFrame([("H4", "2024-01-01"), ("H4", "2024-01-01"), ("H", "2025-01-01"), ("zz", "x")], "gid string, period string")
    bad_rows = timecube.violations(cube, 2, "day", "2024-01-01", "2025-01-01")
    assert bad_rows == {"gid": 1, "level": 1, "label": 1, "range": 1, "duplicate": 1}


def test_period_join_relations(spark):
    a = spark.createDataFrame([("H", "2024-01"), ("H", "2024-02")], "gid string, period string")
    b = spark.createDataFrame([("H", "2024-01-31"), ("H", "2024-03-01"), ("J", "2024-01-05")], "gid string, period string")
    got = [tuple(r) for r in timecube.period_join(a, b, ("month", None), ("day", None)).collect()]
    assert got == [("H", "2024-01", "2024-01-31", "contains")]
    assert [r["relation"] for r in timecube.period_join(a, a, ("month", None), ("month", None)).collect()] == ["equal", "equal"]


def test_period_join_equals_all_pairs(spark):
    """Every kind of period with every other, buckets that nest and such that don't, and labels that are no period."""
    kinds = {("hour", 4): ["2024-01-31T00", "2024-01-31T04", "2024-02-01T20", "2024-02-01T21"], ("hour", 6): ["2024-01-31T00", "2024-01-31T06", "2024-02-01T18"], ("hour", 12): ["2024-01-31T12", "2024-02-01T12"], ("day", None): ["2024-01-31", "2024-02-30"], ("month", None): ["2024-01", "2024-02"], ("year", None): ["2024", "2023"]}
    frames = {k: spark.createDataFrame([("H", p) for p in v], "gid string, period string") for k, v in kinds.items()}
    at = {k: {r["period"]: (r["a"], r["b"]) for r in df.select("period", periods.start_of("period", *k).alias("a"), periods.end_of("period", *k).alias("b")).collect()} for k, df in frames.items()}
    for one, left in kinds.items():
        for two, right in kinds.items():
            want = set()
            for p in left:
                for q in right:
                    (a0, a1), (b0, b1) = at[one][p], at[two][q]
                    if a0 and b0 and a0 < b1 and b0 < a1:
                        kind = "equal" if (a0, a1) == (b0, b1) else "contains" if a0 <= b0 and b1 <= a1 else "contained" if b0 <= a0 and a1 <= b1 else "overlap"
                        want.add((p, q, kind))
            assert {tuple(r)[1:] for r in timecube.period_join(frames[one], frames[two], one, two).collect()} == want, (one, two)


def test_crosswalk_contract(spark):
    rows = spark.createDataFrame([("a", "H4", 0.5), ("a", "H5", 0.5), ("b", "H4", 1.0)], "sumber_id string, gid string, bobot double")
    doc = {"format_version": "1.0", "spec_version": "2.0", "domain_code": "ID", "level": 2, "weight_kind": "luas", "source_description": "x", "registry_version": "1", "created_at": "2026-01-01T00:00:00Z"}
    assert crosswalk.validate(rows, doc) == {"sources": 2, "rows": 3, "cells": 2}
    for change in ({"level": 15}, {"domain_code": "XX"}, {"created_at": "soon"}, {"format_version": "2"}, {"weight_kind": "area"}, {"level": True}, {"registry_version": " "}):
        with pytest.raises(ContractError):
            crosswalk.validate(rows, doc | change)
    broken = spark.createDataFrame([("a", "H4", 0.5), ("a", "H4", 0.4), ("", "H", -1.0)], "sumber_id string, gid string, bobot double")
    assert crosswalk.violations(broken, 2) == {"source": 1, "gid": 1, "weight": 1, "duplicate": 1, "sum": 2}


def test_shapes_read_and_measure():
    square = np.array([[0.0, 0], [4, 0], [4, 4], [0, 4], [0, 0]])
    kind, parts = shapes.from_wkt("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))")
    assert kind == "polygon" and shapes.area(parts) == 15.0 and shapes.covers(parts, 1, 1) and not shapes.covers(parts, 1.5, 1.5) and shapes.covers(parts, 4, 2)
    assert shapes.from_wkb(shapes.wkb_polygon(square))[1][0][0].tolist() == square.tolist()
    assert shapes.from_wkt(shapes.wkt_polygon(square))[1][0][0].tolist() == square.tolist()
    for text, n in (("MULTIPOINT ((1 2), (3 4))", 2), ("MULTIPOINT (1 2, 3 4)", 2), ("LINESTRING EMPTY", 0), ("MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))", 2), ("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))", 2), ("POINT (1 2)", 1)):
        assert len(shapes.from_wkt(text)[1]) == n
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [square.tolist()]}}]}
    assert shapes.area(shapes.parse(json.dumps(doc))[1]) == 16.0
    rng = random.Random(4)
    for _ in range(20):  # clipped areas of a star add up
        ring = np.array([[math.cos(t) * r, math.sin(t) * r] for t, r in ((2 * math.pi * k / 12, rng.uniform(1, 9)) for k in range(12))])
        ring = np.concatenate([ring, ring[:1]])
        pieces = sum(shapes.ring_area(shapes.clip(ring, x, y, x + 3, y + 3)) for x in range(-9, 9, 3) for y in range(-9, 9, 3))
        assert pieces == pytest.approx(shapes.ring_area(ring))
    assert shapes.centroid([[square]]) == (2.0, 2.0)
    with pytest.raises(ContractError):
        shapes.from_wkt("CIRCLE (1 2)")


def test_tangled_shapes_count_an_area_once():
    """Against a fine raster: parts that overlap, rings that cross themselves, holes of one part under another."""
    box = lambda x0, y0, x1, y1: np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]], float)
    bow = np.array([[0, 0], [4, 4], [4, 0], [0, 4], [0, 0]], float)
    star = np.array([[math.cos(4 * math.pi * k / 5) * 5, math.sin(4 * math.pi * k / 5) * 5] for k in range(6)])
    assert shapes.covered_area([[bow]]) == pytest.approx(8.0) and shapes.is_tangled([[bow]])
    for parts in ([[box(0, 0, 4, 4)], [box(2, 2, 6, 6)]], [[bow], [box(1, 1, 5, 3)]], [[box(0, 0, 6, 6), box(1, 1, 3, 3)], [box(2, 2, 5, 5)]], [[star]]):
        n = 600
        t = (np.arange(n) + 0.5) / n * 14 - 6.5
        x, y = np.meshgrid(t, t)
        raster = shapes.covers_many(parts, x.ravel(), y.ravel()).sum() * (14 / n) ** 2
        assert shapes.covered_area(parts) == pytest.approx(raster, rel=0.01)
        assert sum(a for *_, a in G.polygon_cells([[r * 1000 for r in p] for p in parts], 10)) == pytest.approx(shapes.covered_area(parts) * 1e6, rel=1e-9)
    assert not shapes.is_tangled([[box(0, 0, 1, 1)], [box(1, 0, 2, 1)]])
    whole = G.polygon_cells([[box(0, 0, 1300, 700)]], 9)  # the way of boxes and the way of all polygons
    assert whole == G.polygon_cells([[np.concatenate([box(0, 0, 1300, 700)[:1], [[650.0, 0.0]], box(0, 0, 1300, 700)[1:]])]], 9)


def test_parts_that_are_boxes_are_read_and_cut_without_arrays(monkeypatch):
    """Of random boxes that overlap, touch or lie apart: the cells are those of the general way, which cuts rings."""
    rng, n = random.Random(4), lambda: rng.randrange(-30, 30) * 100 + rng.choice([0, 0.5])
    ring = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    cases = []
    for _ in range(60):
        boxes = [(x, y, x + rng.randrange(1, 20) * 100, y + rng.randrange(1, 20) * 100) for x, y in ((n(), n()) for _ in range(rng.randrange(2, 6)))]
        text = "MULTIPOLYGON (" + ", ".join("((" + ", ".join(f"{x} {y}" for x, y in ring(*b)) + "))" for b in boxes) + ")"
        general = [[np.array([*ring(*b)[:1], ((b[0] + b[2]) / 2, b[1]), *ring(*b)[1:]], float)] for b in boxes]  # one more point
        cases.append((text, boxes, G.polygon_cells(general, 10)))
    monkeypatch.setattr(shapes, "cut", lambda *_: pytest.fail("a box was cut as a ring"))
    for text, boxes, want in cases:
        assert shapes.boxes_of(text) == boxes
        for got in (G.boxes_cells(boxes, 10), G.polygon_cells(shapes.parse(text)[1], 10)):
            assert [c[:2] for c in got] == [c[:2] for c in want] and np.allclose([c[2:] for c in got], [c[2:] for c in want], rtol=1e-9)
    assert shapes.boxes_of("MULTIPOLYGON (((0 0, 2 0, 2 2, 0 2, 0 0)), ((0 0, 4 0, 4 4, 0 0)))") is None
    assert shapes.boxes_of("MULTIPOLYGON (((0 0, 2 0, 2 2, 0 2, 0 0)), ((0 0, 4 0, 5 4, 0 4, 0 0)))") is None
    assert shapes.boxes_of("MULTIPOLYGON (((0 0, 9 0, 9 9, 0 9, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1)))") is None
    with pytest.raises(CandidateLimitError):
        G.boxes_cells([(0, 0, 10, 10), (1e6, 1e6, 1e6 + 10, 1e6 + 10)], 10, limit=1000)


def test_services(spark):
    rows = spark.createDataFrame([("cell:v2:ID:H4", 1), ("cell:v2:ID:H5", 2), ("cell:v2:MY:H4", 3), ("cell:v2:ID:H", 4), ("x", 5), (None, 6)], "uri string, gid int")
    near = services.neighbourhood(rows, "uri", 2, 1).collect()
    assert {r["gid"] for r in near} == {1, 2, 3} and all(r["near_uri"] == f"cell:v2:{r['near_domain']}:{r['near_gid']}" for r in near)
    assert len([r for r in near if r["gid"] == 1]) == 8 and services.neighbourhood(rows, "uri", 2, 1, kind="disk").count() == 27
    with pytest.raises(ContractError):
        services.neighbourhood(rows, "uri", 2, 1, kind="star")
    other = rows.withColumn("b", F.lit("cell:v2:ID:H4"))
    assert {r["gid"]: r["distance_m"] for r in services.distance(other, "uri", "b").collect()} == {1: 0.0, 2: 5_000_000.0, 3: None, 4: None, 5: None, 6: None}
    with pytest.raises(Exception, match="one domain and level"):
        services.distance(other, "uri", "b", mode="fail").collect()


def test_table_to_cells(spark):
    points = spark.createDataFrame([(1, 106.8456, -6.2088, "x"), (2, 110.0, -7.0, "y"), (3, 0.0, 0.0, "z"), (4, None, 1.0, None)], "id int, longitude double, latitude double, geometry string")
    city = G.Boundary.read("POLYGON ((106 -7, 107.5 -7, 107.5 -6, 106 -6, 106 -7))", "ID", "EPSG:4326")
    flagged = services.table_to_cells(points, "ID", 9, keep=["id"], boundary=city, geometry=True, crs="EPSG:4326").orderBy("id").collect()
    assert [r["boundary_match"] for r in flagged] == [True, False, False, None] and flagged[0]["gid"] == "H2X545V39"
    assert flagged[0]["geometry"].startswith("POLYGON ((106.8") and flagged[3]["geometry"] is None
    kept = services.table_to_cells(points, "ID", 9, boundary=city, drop_outside=True)
    assert kept.columns[:4] == points.columns and [r["id"] for r in kept.collect()] == [1]
    assert sum(r["gid"] is None for r in services.table_to_cells(points, "ID", 9).collect()) == 2
    with pytest.raises(ContractError):
        services.table_to_cells(points, "ID", 9, x="longitude")
    inside = encode.index_points(points, "longitude", "latitude", "ID", 9, boundary=city).orderBy("id").collect()
    assert [r["gid"] for r in inside] == ["H2X545V39", None, None, None] and [r["latitude"] for r in inside][1] == -7.0
    with pytest.raises(Exception, match="operational boundary"):
        encode.index_points(points, "longitude", "latitude", "ID", 9, boundary=city, mode="fail").collect()


def test_points_in_zones_equal_a_test_of_every_pair(spark):
    rng = random.Random(9)
    star = lambda: [[rng.uniform(0.3, 1) * 2000 * f(2 * math.pi * k / 9) for f in (math.cos, math.sin)] for k in range(9)]
    zones = [(k, shapes.wkt_polygon(np.array([*(ring := star()), ring[0]]))) for k in range(6)] + [(6, "POLYGON ((0 0, 500 0, 500 500, 0 500, 0 0))"), (7, None)]
    points = [(k, rng.uniform(-2000, 2000), rng.uniform(-2000, 2000)) for k in range(500)] + [(500, 0.0, 0.0), (501, 500.0, 500.0), (502, 250.0, 500.0), (503, None, 1.0)]
    got = services.points_in_zones(spark.createDataFrame(points, "id int, x_m double, y_m double"), spark.createDataFrame(zones, "z int, g string"), "z", "g", "ID", 10)
    want = {(i, z) for i, x, y in points if x is not None for z, g in zones if g and shapes.covers(shapes.parse(g)[1], x, y)}
    rows = [(r["id"], r["z"]) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_crosswalk_from_polygons(spark):
    make = lambda rows: crosswalk.from_polygons(spark.createDataFrame(rows, "s string, g binary"), "s", "g", "ID", 9)
    ring = lambda x: shapes.wkb_polygon(np.array([[x, 0], [x + 1500, 0], [x + 1500, 1000], [x, 1000], [x, 0]], float))
    rows = make([("a", ring(0.0)), ("b", ring(250.0))]).collect()
    assert sorted((r["sumber_id"], round(r["bobot"], 6)) for r in rows) == [("a", 0.333333), ("a", 0.666667), ("b", 0.5), ("b", 0.5)]
    flat = shapes.wkb_polygon(np.array([[0, 0], [5, 5], [0, 0]], float))
    for bad, why in (([("a", ring(0.0)), ("a", ring(9.0))], "twice"), ([(" ", ring(0.0))], "no name"), ([("a", flat)], "no area"), ([("a", None)], "no area"), ([("a", ring(24_999_500.0))], "covered"), ([("a", ring(30e6))], "covered")):
        with pytest.raises(ContractError, match=why):
            make(bad)


def test_registries(spark, tmp_path):
    import hashlib

    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "id.geojson").write_text("{}")
    digest = hashlib.sha256(b"{}").hexdigest()
    doc = {"domains": [{"domain_id": k, "domain_code": c, "name": c, "origin_x_m": -25e6, "origin_y_m": -25e6, "root_side_m": 5e7} for k, c in ((1, "ID"), (6, "MY"))]}
    doc["profiles"] = [{"domain_id": k, "profile_version": "2.0", "crs_authority": "X", "min_level": 0, "max_level": 14, "boundary_file": "id.geojson", "boundary_sha256": digest} for k in (1, 6)]
    doc["scale_metadata"] = [{"domain_id": k, "algorithm": "a", "sample_count": 300, "max_error_pct": 0.5} for k in (1, 6)]
    source = tmp_path / "registry.json"
    source.write_text(json.dumps(doc))
    sha = hashlib.sha256(source.read_bytes()).hexdigest()
    rows = sorted(map(tuple, registry.read_json(spark, str(source), sha, boundaries=str(tmp_path / "b")).collect()))
    assert [r[1] for r in rows] == ["ID", "MY"]
    target = str(tmp_path / "registry.db")
    made = registry.migrate(str(source), target, sha)
    assert sorted(map(tuple, registry.read_sqlite(spark, target, made).collect())) == rows
    for wrong in (lambda: registry.read_json(spark, str(source), "0" * 64), lambda: registry.read_json(spark, str(source)), lambda: registry.read_sqlite(spark, target, verify=lambda data: False), lambda: registry.migrate(str(source), target, sha)):
        with pytest.raises(ContractError):
            wrong()
    source.write_text(json.dumps(doc | {"profiles": doc["profiles"][:1]}))
    with pytest.raises(ContractError, match="one to one"):
        registry.read_json(spark, str(source), verify=lambda data: True)
    (tmp_path / "b" / "id.geojson").write_text("changed")
    with pytest.raises(ContractError, match="boundary"):
        registry.read_sqlite(spark, target, made, boundaries=str(tmp_path / "b"))


def test_manifests():
    doc = datasets.new_manifest("ID", 9, [("n", "int64", "COUNT")])
    assert manifests.check(doc, columns=["gid", "n"]) == doc
    for section, key, value in (("identity", "gid_column", "id"), ("identity", "uri_prefix", "cell:v2:MY:"), ("identity", "x_idx_column", "x"), ("identity", "unique_gid", False), ("coverage", "boundary_policy", "NEAR"), ("coverage", "boundary_sha256", "AB"), ("coverage", "min_coverage", 1.5), ("source", "source_row_count", -1), ("storage", "geometry_column", "g"), ("storage", "parquet_compression", "lzo"), ("storage", "sorted_by", ["gid", "gid"]), ("provenance", "generator", ""), ("provenance", "value_semantics", "SUM"), ("provenance", "more", 1)):
        with pytest.raises(ManifestError):
            manifests.check(doc | {section: doc[section] | {key: value}})
    counts = doc | {"storage": doc["storage"] | {"row_count": 5, "unique_cell_count": 4}}
    for bad in (counts, doc | {"grid_version": "1.0"}, doc | {"domain_code": "id"}, doc | {"value_fields": []}, doc | {"value_fields": doc["value_fields"] * 2}, doc | {"value_fields": [doc["value_fields"][0] | {"semantics": "RANGE"}]}, 5):
        with pytest.raises(ManifestError):
            manifests.check(bad)
    with pytest.raises(ManifestError, match="no column n"):
        manifests.check(doc, columns=["gid"])
    with pytest.raises(ManifestError, match="profile_version"):
        manifests.check(doc, {"ID": {"domain_id": 1, "profile_version": "3.0"}})
    assert manifests.check(doc, {"ID": {"domain_id": 1, "profile_version": "2.0", "boundary_sha256": "0" * 64}})


def test_time_values_must_be_sorted(spark, tmp_path):
    rows = spark.createDataFrame([("H2X545V39", f"2024-01-{d:02d}", 1.0) for d in range(1, 9)], "gid string, period string, v double")
    path = f"file://{tmp_path}/t"
    datasets.write_time_values(rows, path, "ID", 9, "day", "2024-01-01", "2025-01-01", [("v", "double", "TOTAL")])
    assert datasets.read_time_values(spark, path)[0].count() == 8
    rows.coalesce(1).orderBy(F.desc("period")).coalesce(1).write.mode("overwrite").parquet(f"{path}/data")
    with pytest.raises(DatasetError, match="sorted"):
        datasets.read_time_values(spark, path)


def test_sql_polyfill(spark):
    sqlfuncs.register_polyfill(spark)
    rows = spark.sql("SELECT c.* FROM VALUES ('POLYGON ((0 0, 1500 0, 1500 1000, 0 1000, 0 0))'), (NULL) t(g), LATERAL cell_polyfill(g, 9) c").collect()
    assert sorted(r["coverage_ratio"] for r in rows) == [0.5, 1.0] and {r["gid"] for r in rows} == {gid(9, 25000, 25000), gid(9, 25001, 25000)}


def test_geometry_tables(spark):
    rows = [
        ("box", "POLYGON ((0 0, 2000000 0, 2000000 1000000, 0 1000000, 0 0))"),
        ("line", "LINESTRING (100000 500000, 1900000 500000)"),
        ("edge", "LINESTRING (1000000 100000, 1000000 900000)"),
        ("point", "POINT (25000000 25000000)"),
        ("none", None),
        ("empty", "POLYGON EMPTY"),
    ]
    df = spark.createDataFrame(rows, "id string, geometry string")
    got = [r.asDict() for r in G.geometry_to_cells(df, "geometry", "ID", 3).collect()]
    of = lambda i: [r for r in got if r["id"] == i]
    assert [r["coverage_ratio"] for r in of("box")] == [0.5, 0.5] and sum(r["length_ratio"] for r in of("line")) == 1.0 and len(of("line")) == 2
    assert len(of("edge")) == 2 and of("point")[0]["gid"] == gid(3, 49, 49) and not of("none") + of("empty")
    equal = G.polygons_to_cells(df.filter("id = 'box'"), "geometry", "ID", 3, coverage="EQUAL_AREA").collect()
    assert all(r["coverage_ratio"] == pytest.approx(1.0) for r in equal)
    with pytest.raises(Exception, match="candidate cells"):
        G.geometry_to_cells(df, "geometry", "ID", 12, limit=100).collect()
    assert G.polygon_to_cell(df.filter("id = 'box'"), "geometry", "ID", 3, "centroid", "id").first()["gid"] in {r["gid"] for r in of("box")}
    assert issubclass(CandidateLimitError, ContractError)


def test_boundaries(spark):
    b = G.Boundary.read("POLYGON ((0 0, 1500 0, 1500 1000, 0 1000, 0 0))", "ID")
    base = 25_000_000 // 1000
    cells = spark.createDataFrame([(base + i, base + j) for i in range(-1, 3) for j in range(-1, 2)], "x_idx bigint, y_idx bigint")
    n = lambda p, m=0.0: b.filter_cells(cells, 9, p, m).count()
    assert n("CENTROID_COVERED") == 2 and n("MIN_COVERAGE", 0.6) == 1 and n("INTERSECTS") == 9
    points = spark.createDataFrame([(0.0, 0.0), (1500.0, 500.0), (1500.1, 500.0), (None, 1.0)], "x_m double, y_m double")
    assert b.filter_points(points).count() == 2
    assert [r["inside_boundary"] for r in b.covers_points(points).collect()] == [True, True, False, None]
    ring = shapes.from_wkt(G.cell_polygons(cells.limit(1), 9, "ID", "EPSG:4326").first()["geometry"])[1][0][0]
    assert len(ring) == 5 and 110 < ring[0][0] < 125


def test_datasets(spark, tmp_path):
    cells = encode.encode_projected(spark.createDataFrame([(1.0, 1.0, 5), (2000.0, 1.0, 6)], "x double, y double, n bigint"), "x", "y", "ID", 9, keep=["n"]).drop("uri")
    doc = datasets.new_manifest("ID", 9, [("n", "int64", "COUNT")])
    path = f"file://{tmp_path}/d"
    datasets.write_dataset(cells, path, doc)
    back, got = datasets.read_dataset(spark, path)
    assert back.count() == 2 and got == json.loads(datasets.canonical(doc))
    with pytest.raises(DatasetError):
        datasets.write_dataset(cells, path, doc)
    df = datasets.query_dataset(spark, path, (118.0, -2.56, 118.02, -2.54), "ID", 9)
    assert df.count() == 1 and "PushedFilters: [Or(" in df._jdf.queryExecution().toString() or "x_idx" in df._jdf.queryExecution().toString()
    with pytest.raises(DatasetError):
        datasets.query_dataset(spark, path, (118.0, -2.56, 118.02, -2.54), "ID", 8)
    with pytest.raises(DatasetError):
        datasets.write_dataset(cells.unionAll(cells), path + "2", doc)
    with pytest.raises(DatasetError):
        datasets.write_dataset(cells.withColumn("packed_id", F.col("packed_id") + 2), path + "3", doc)
    with pytest.raises(DatasetError):
        datasets.write_dataset(cells.withColumn("extra", F.lit(1)), path + "4", doc)
    for change in ({"dataset_type": "x"}, {"domain_id": 2}, {"level": 15}, {"more": 1}, {"value_fields": [{"name": "gid"}]}):
        with pytest.raises((ManifestError, ContractError)):
            datasets.check_manifest(doc | change)
    datasets.write_dataset(cells, path + "5", doc, prefix_level=3)
    assert datasets.read_dataset(spark, path + "5")[0].count() == 2
    assert datasets.split_bbox((170, -1, -170, 1)) == [(170.0, -1.0, 180.0, 1.0), (-180.0, -1.0, -170.0, 1.0)]
    for box in ((0, 0, 0, 1), (0, 1, 1, 1), (0, 0, 181, 1), (0, 0, 1)):
        with pytest.raises(DatasetError):
            datasets.split_bbox(box)
    assert datasets.index_window(-3e7, 0, -2.5e7, 1, 3) is None and datasets.index_window(0, 0, 1e6, 1e6, 3) == (25, 25, 25, 25)


def test_detection(spark):
    good = [gid(9, k, k) for k in range(200)]
    df = spark.createDataFrame([(g, f"cell:v2:ID:{g}", packed(1, 9, k, k), 22222 + k * 0, "22222", None, 1.5, k, k) for k, g in enumerate(good)], "g string, u string, p bigint, i bigint, d string, e string, f double, x_idx bigint, y_idx bigint")
    got = {r[0]: r for r in detect.detect(df)}
    assert [got[c][1:3] for c in "gupidef"] == [("gid", "needs_domain"), ("uri", "certain"), ("packed_id", "certain"), ("gid", "rejected"), ("gid", "needs_domain"), ("none", "rejected"), ("none", "rejected")]
    assert got["x_idx+y_idx"][2] == "needs_level"
    got = {r[0]: r for r in detect.detect(df, domain="ID", level=9)}
    assert got["g"][2] == "certain" and got["d"][2] == "needs_confirmation" and got["x_idx+y_idx"][2] == "certain" and got["u"][5] == ["ID"] and got["p"][6] == [1]
    worse = df.withColumn("g", F.when(F.col("x_idx") < 4, "bad").otherwise(F.col("g")))
    r = {r[0]: r for r in detect.detect(worse)}["g"]
    assert r[2] == "rejected" and r[4] == 0.98 and r[8] == ["bad"] * 3
    order = df.repartition(3, "g").withColumn("k", F.monotonically_increasing_id()).withColumn("g", F.when(F.col("k") % 50 == 7, F.concat(F.lit("bad"), "k")).otherwise(F.col("g")))
    bad = [r["g"] for r in order.orderBy("k").collect() if r["g"].startswith("bad")]
    assert len(bad) > 3 and {r[0]: r for r in detect.detect(order)}["g"][8] == bad[:3]  # the first of the input
    assert {r[0]: r[2] for r in detect.detect(df, domain="MY")}["u"] == "rejected"


def test_older_grid(spark):
    def loop(text):
        w, e, s, n = *legacy.V1_LON, *legacy.V1_LAT
        for step, char in zip(legacy.V1_STEPS, text):
            code = legacy.V1_ALPHABETS[step].index(char)
            dw, dh = (e - w) / step, (n - s) / step
            w, s = w + dw * (code % step), s + dh * (code // step)
            e, n = w + dw, s + dh
        return w, s, e, n

    texts = ["H", "H7", "H7N3", "H7N3T2W8E3H", "Y8Y8Y8Y8Y8Y8Y8Y"]
    df = spark.createDataFrame([(t,) for t in [*texts, "H6", "", None]], "gid string")
    got = legacy.decode_v1(df).collect()
    for t, r in zip(texts, got):
        assert (r["min_lon"], r["min_lat"], r["max_lon"], r["max_lat"]) == loop(t) and r["v1_level"] == len(t)
    assert all(r["min_lon"] is None for r in got[len(texts) :])
    points = spark.createDataFrame([("H7", 106.8456, -6.2088), ("H7", None, None)], "gid string, lon double, lat double")
    out = legacy.migrate_points(points, "ID", 12, "gid", "lon", "lat").collect()
    assert out[0]["gid"] == "H2X545V394J4" and [r["method"] for r in out] == ["source_coordinates", "cell_centroid"]


def test_older_areas_keep_their_size(spark):
    old = spark.createDataFrame([("J3N2M763T", 7), ("bad", 8)], "gid string, n int")
    cells = legacy.migrate_areas(old, "ID", 10).collect()
    box = legacy.decode_v1(old).first()
    a = 6371007.0
    true = math.radians(box["max_lon"] - box["min_lon"]) * a * a * (math.sin(math.radians(box["max_lat"])) - math.sin(math.radians(box["min_lat"])))
    assert sum(r["coverage_ratio"] for r in cells) * 500.0**2 == pytest.approx(true, rel=0.02) and {r["n"] for r in cells} == {7}


def test_encoder_texts_and_tables(spark, tmp_path):
    for engine in ("bigquery", "snowflake", "postgis"):
        text = sqlfuncs.render(engine)
        assert C.ALPHABETS[5] in text and "CREATE OR REPLACE FUNCTION" in text
    with pytest.raises(ContractError):
        sqlfuncs.render("oracle")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, s string")
    for suffix in ("csv", "parquet"):
        path = f"{tmp_path}/t.{suffix}"
        tables.write_table(df, path)
        assert tables.read_table(spark, path).count() == 2
    assert tables.read_table(spark, df) is df and tables.read_table(spark, df.toPandas()).count() == 2
    with pytest.raises(ContractError):
        tables.read_table(spark, "x.doc")
    with pytest.raises((DependencyError, FileNotFoundError)):
        tables.read_table(spark, f"{tmp_path}/x.xlsx")
    assert sum(c.count() for c in tables.read_chunks(spark, spark.range(1000), rows=300)) == 1000
