"""The registered queries of the grid engine: each reads whole tables of a scale folder; ORACLE_SQL has the same in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from meshlark.functions import codec, periods, projection, topology
from meshlark.functions.profiles import domain as find_domain, domain_table
from meshlark.operators import aggregate as agg, compact, crosswalk, detect, encode, legacy, services, timecube
from meshlark.operators.geometry import Boundary, cell_polygons, geometry_to_cells, polygon_to_cell, polygons_to_cells
from meshlark.plans import sql, sqlfuncs
from meshlark.sources import datasets, tables
from meshlark.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.lit(-25000000) + (F.col("o_orderkey") * 7919 + F.col("o_custkey") * 104729) % 50000000 + 0.5
    y = F.lit(-25000000) + (F.col("o_orderkey") * 15485863 + F.col("o_custkey") * 32452843) % 50000000 + 0.5
    return table(spark, sf_dir, "orders").withColumn("x_m", x).withColumn("y_m", y)


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = (F.col("event_id") * 37) % 8000 - 4000.5, (F.col("event_id") * 53 + F.col("user_id")) % 8000 - 4000.5
    return table(spark, sf_dir, "events").withColumn("x_m", x.cast("double")).withColumn("y_m", y.cast("double"))


def event_cells(spark: SparkSession, sf_dir: str, level: int = 11) -> DataFrame:
    return encode.encode_projected(event_points(spark, sf_dir), "x_m", "y_m", "ID", level)


def order_cells(spark: SparkSession, sf_dir: str, level: int) -> DataFrame:
    return encode.encode_projected(order_points(spark, sf_dir), "x_m", "y_m", "ID", level)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Seven decimals: beyond the ties of values with two or four, short of what the order of sums changes."""
    return df.withColumns({c: F.round(c, 7) for c in columns})


# --- codec (C1-C15, X9) ------------------------------------------------------------------------------------------


@query("flagship_encode_aggregate", f"SELECT packed_id, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {sql.cells(sql.ORDERS, 9, 'o_totalprice')} GROUP BY packed_id")
def flagship(spark, sf_dir):
    return encode.cell_aggregate(order_cells(spark, sf_dir, 9), "packed_id", "o_totalprice").withColumn("total", F.round("total", 2))


for _level in (5, 9, 12, 14):

    @query(f"c_encode_projected_l{_level}", f"SELECT o_orderkey, 'ID' AS domain, {_level} AS level, x_idx, y_idx, gid, 'cell:v2:ID:' || gid AS uri, packed_id FROM {sql.cells(sql.ORDERS, _level, 'o_orderkey')}")
    def _encode(spark, sf_dir, level=_level):
        return encode.encode_projected(order_points(spark, sf_dir), "x_m", "y_m", "ID", level, keep=["o_orderkey"])


@query("c5_gid_decode", f"SELECT gid, 12 AS level, x_idx, y_idx FROM {sql.cells(sql.ORDERS, 12, 'o_orderkey')}")
def c5(spark, sf_dir):
    return encode.decode_gids(order_cells(spark, sf_dir, 12).select("gid"))


@query("c7_packed_decode", f"SELECT packed_id, 1 AS domain_id, 12 AS level, x_idx, y_idx FROM {sql.cells(sql.ORDERS, 12, 'o_orderkey')}")
def c7(spark, sf_dir):
    p = order_cells(spark, sf_dir, 12).select("packed_id", codec.unpack("packed_id", 12).alias("c"))
    return p.select("packed_id", "c.domain_id", "c.level", "c.x_idx", "c.y_idx")


@query("c8_uri_parse", f"SELECT 'cell:v2:ID:' || gid AS uri, 'ID' AS domain, gid FROM {sql.cells(sql.ORDERS, 7, 'o_orderkey')}")
def c8(spark, sf_dir):
    u = order_cells(spark, sf_dir, 7).select("uri", codec.parse_uri("uri").alias("p"))
    return u.select("uri", "p.domain", "p.gid")


@query("c9_bounds", f"SELECT o_orderkey, x_idx * 5000.0 - 25000000.0 AS min_x, y_idx * 5000.0 - 25000000.0 AS min_y, x_idx * 5000.0 - 24995000.0 AS max_x, y_idx * 5000.0 - 24995000.0 AS max_y FROM {sql.cells(sql.ORDERS, 8, 'o_orderkey')}".replace("5000.0", "5000.0"))
def c9(spark, sf_dir):
    return order_cells(spark, sf_dir, 8).select("o_orderkey", codec.bounds_of("x_idx", "y_idx", 8).alias("b")).select("o_orderkey", "b.*")


@query("c15_describe", f"SELECT gid, 'ID' AS domain, 9 AS level, x_idx, y_idx, x_idx * 1000.0 - 25000000.0 AS min_x FROM {sql.cells(sql.ORDERS, 9, 'o_orderkey')}")
def c15(spark, sf_dir):
    d = encode.describe(order_cells(spark, sf_dir, 9).select("uri"), "uri")
    return d.select("gid", "domain", "level", "x_idx", "y_idx", "bounds.min_x")


def _lonlat(spark, sf_dir):
    lon, lat = 95 + (F.col("event_id") * 37) % 46000 / 1000.0, -11 + (F.col("event_id") * 53) % 17000 / 1000.0
    return table(spark, sf_dir, "events").select("event_id", "value", lon.alias("lon"), lat.alias("lat"))


#: The Lambert part of domain MY on GRS80 (no datum step), in DuckDB.
def _my_sql(level: int) -> str:
    import math

    d = find_domain("MY")
    a, f = 6378137.0, 1 / 298.257222101
    e2 = f * (2 - f)
    e = math.sqrt(e2)
    p = {k: math.radians(v) for k, v in d.params.items()}
    m = lambda t: math.cos(t) / math.sqrt(1 - e2 * math.sin(t) ** 2)
    t = lambda x: math.tan(math.pi / 4 - x / 2) / ((1 - e * math.sin(x)) / (1 + e * math.sin(x))) ** (e / 2)
    n = (math.log(m(p["lat1"])) - math.log(m(p["lat2"]))) / (math.log(t(p["lat1"])) - math.log(t(p["lat2"])))
    af = a * m(p["lat1"]) / (n * t(p["lat1"]) ** n)
    points = "(SELECT event_id, 100 + ((event_id * 37) % 19000) / 1000.0 AS lon, 1 + ((event_id * 53) % 6000) / 1000.0 AS lat FROM events)"
    rho = f"{af!r} * pow(tan({math.pi / 4!r} - radians(lat) / 2) / pow((1 - {e!r} * sin(radians(lat))) / (1 + {e!r} * sin(radians(lat))), {e / 2!r}), {n!r})"
    flat = f"(SELECT event_id, ({rho}) * sin({n!r} * (radians(lon) - {p['lon0']!r})) AS x_m, {af * t(p['lat0']) ** n!r} - ({rho}) * cos({n!r} * (radians(lon) - {p['lon0']!r})) AS y_m FROM {points})"
    return f"SELECT event_id, gid FROM {sql.cells(flat, level, 'event_id', 6)}"


@query("p1_lonlat_encode_my", _my_sql(9))
def p1(spark, sf_dir):
    lon, lat = 100 + (F.col("event_id") * 37) % 19000 / 1000.0, 1 + (F.col("event_id") * 53) % 6000 / 1000.0
    points = table(spark, sf_dir, "events").select("event_id", lon.alias("lon"), lat.alias("lat"))
    return encode.encode_lonlat(points, "lon", "lat", "MY", 9).select("event_id", "gid")


@query("c14_index_points_id")
def c14(spark, sf_dir):
    """With a datum step, which SQL would have to spell out in full; tests hold it against the published vectors."""
    return encode.index_points(_lonlat(spark, sf_dir), "lon", "lat", "ID", 9).select("event_id", "gid", "packed_id", "edge_m", "production_ready")


@query("p2_roundtrip_lonlat", "SELECT event_id, round(95 + ((event_id * 37) % 46000) / 1000.0, 6) AS longitude, round(-11 + ((event_id * 53) % 17000) / 1000.0, 6) AS latitude FROM events")
def p2(spark, sf_dir):
    d = find_domain("ID")
    flat = projection.with_grid_xy(_lonlat(spark, sf_dir), d, "lon", "lat")
    back = projection.with_lonlat(flat, d, "x_m", "y_m")
    return back.select("event_id", F.round("longitude", 6).alias("longitude"), F.round("latitude", 6).alias("latitude"))


@query("p4_area_check", "SELECT count(*) AS n, count(*) FILTER (WHERE lon BETWEEN 99.5 AND 119.4 AND lat BETWEEN 0.7 AND 7.5) AS inside FROM (SELECT 95 + ((event_id * 37) % 46000) / 1000.0 AS lon, -11 + ((event_id * 53) % 17000) / 1000.0 AS lat FROM events)")
def p4(spark, sf_dir):
    return _lonlat(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.count_if(projection.inside_area(find_domain("MY"), F.col("lon"), F.col("lat"))).alias("inside"))


# --- hierarchy and neighbourhood (T1-T10, F11, F12, A34) --------------------------------------------------------------

_o9 = sql.cells(sql.ORDERS, 9, "o_orderkey")
_o12 = sql.cells(sql.ORDERS, 12, "o_orderkey, o_totalprice")


@query("t1_parent", f"SELECT o_orderkey, x_idx // 5 AS parent_x, y_idx // 5 AS parent_y, substr(gid, 1, 8) AS parent_gid FROM {_o9}")
def t1(spark, sf_dir):
    x, y = topology.parent_indices("x_idx", "y_idx", 9)
    return order_cells(spark, sf_dir, 9).select("o_orderkey", x.alias("parent_x"), y.alias("parent_y"), topology.parent_gid("gid").alias("parent_gid"))


@query("t2_ancestors", f"SELECT o_orderkey, substr(gid, 1, CAST(k AS INTEGER)) AS ancestor FROM {_o9}, range(0, 9) t(k)")
def t2(spark, sf_dir):
    return order_cells(spark, sf_dir, 9).select("o_orderkey", F.explode(topology.ancestors("gid")).alias("ancestor"))


@query("t3_children", f"SELECT o_orderkey, gid || substr('2345', CAST(k + 1 AS INTEGER), 1) AS child FROM {_o9}, range(0, 4) t(k)")
def t3(spark, sf_dir):
    return order_cells(spark, sf_dir, 9).select("o_orderkey", F.explode(topology.child_gids("gid")).alias("child"))


@query("t3_children_indices", f"SELECT o_orderkey, x_idx * 2 + k % 2 AS child_x, y_idx * 2 + k // 2 AS child_y FROM {_o9}, range(0, 4) t(k)")
def t3b(spark, sf_dir):
    return topology.children(order_cells(spark, sf_dir, 9).select("o_orderkey", "x_idx", "y_idx"), "x_idx", "y_idx", 9).select("o_orderkey", "child_x", "child_y")


@query("t4_neighbour", f"SELECT o_orderkey, CASE WHEN x_idx + 1 < 10 AND y_idx >= 1 THEN x_idx + 1 END AS near_x, CASE WHEN x_idx + 1 < 10 AND y_idx >= 1 THEN y_idx - 1 END AS near_y FROM {sql.cells(sql.ORDERS, 2, 'o_orderkey')}")
def t4(spark, sf_dir):
    x, y = topology.neighbour("x_idx", "y_idx", 2, 1, -1)
    return order_cells(spark, sf_dir, 2).select("o_orderkey", x.alias("near_x"), y.alias("near_y"))


_near = "SELECT o_orderkey, x_idx + dx AS near_x, y_idx + dy AS near_y FROM {cells}, range(-2, 3) a(dx), range(-2, 3) b(dy) WHERE x_idx + dx BETWEEN 0 AND 49 AND y_idx + dy BETWEEN 0 AND 49"


@query("t5_disk", _near.format(cells=sql.cells(sql.ORDERS, 3, "o_orderkey")))
def t5(spark, sf_dir):
    return topology.disk(order_cells(spark, sf_dir, 3).select("o_orderkey", "x_idx", "y_idx"), "x_idx", "y_idx", 3, 2).select("o_orderkey", "near_x", "near_y")


@query("t6_ring", _near.format(cells=sql.cells(sql.ORDERS, 3, "o_orderkey")) + " AND greatest(abs(dx), abs(dy)) = 2")
def t6(spark, sf_dir):
    return topology.disk(order_cells(spark, sf_dir, 3).select("o_orderkey", "x_idx", "y_idx"), "x_idx", "y_idx", 3, 2, ring=True).select("o_orderkey", "near_x", "near_y")


@query("t7_distance", f"SELECT o_orderkey, round(sqrt((x_idx - 5000)::DOUBLE ** 2 + (y_idx - 5000)::DOUBLE ** 2) * 5000.0, 2) AS metres FROM {sql.cells(sql.ORDERS, 8, 'o_orderkey')}")
def t7(spark, sf_dir):
    d = topology.distance_m("x_idx", "y_idx", F.lit(5000), F.lit(5000), 8)
    return order_cells(spark, sf_dir, 8).select("o_orderkey", F.round(d, 2).alias("metres"))


@query("t10_packed_ancestor", f"SELECT o_orderkey, {sql.packed(1, '(x_idx // 20)', '(y_idx // 20)', 9)} AS ancestor FROM {_o12}")
def t10(spark, sf_dir):
    return order_cells(spark, sf_dir, 12).select("o_orderkey", topology.packed_ancestor("packed_id", 12, 9).alias("ancestor"))


@query("f11_descendant_range", f"SELECT o_orderkey, gid FROM {_o12} WHERE substr(gid, 1, 2) = 'H4'")
def f11(spark, sf_dir):
    low, high = codec.descendant_range(1, "H4", 12)
    return order_cells(spark, sf_dir, 12).filter(F.col("packed_id").between(low, high)).select("o_orderkey", "gid")


@query("f12_gid_prefix", f"SELECT o_orderkey, gid FROM {_o12} WHERE gid LIKE 'H%'")
def f12(spark, sf_dir):
    return order_cells(spark, sf_dir, 12).filter(F.col("gid").startswith("H")).select("o_orderkey", "gid")


@query("a34_parent_rollup", f"SELECT substr(gid, 1, 4) AS gid, round(sum(o_totalprice), 2) AS o_totalprice, count(*) AS feature_count FROM {_o12} GROUP BY 1")
def a34(spark, sf_dir):
    out = agg.rollup(order_cells(spark, sf_dir, 12), 4, "o_totalprice")
    return out.withColumn("o_totalprice", F.round("o_totalprice", 2))


# --- aggregation (A1-A31) -----------------------------------------------------------------------------------------------

_e = sql.cells(sql.EVENTS, 11, "event_id, user_id, event_type, value, ts, user_id + 1.0 AS w")
_numeric = {
    "count": "count(*)",
    "sum": "sum(value)",
    "weighted_sum": "sum(value * w)",
    "mean": "avg(value)",
    "weighted_mean": "sum(value * w) / sum(w)",
    "median": "quantile_cont(value, 0.5)",
    "min": "min(value)",
    "max": "max(value)",
    "std": "stddev_pop(value)",
    "quantile": "quantile_cont(value, 0.3)",
}


def _weighted_events(spark, sf_dir):
    return event_cells(spark, sf_dir).withColumn("w", F.col("user_id") + F.lit(1.0)).drop("domain", "level", "x_idx", "y_idx", "uri")


for _rule, _expression in _numeric.items():
    _shown = "count(*)" if _rule == "count" else f"round({_expression}, 7)"

    @query(f"a_numeric_{_rule}", f"SELECT gid, {_shown} AS value, count(*) AS feature_count FROM {_e} GROUP BY gid")
    def _numeric_query(spark, sf_dir, rule=_rule):
        out = agg.numeric(_weighted_events(spark, sf_dir), "value", rule, "w" if rule.startswith("weighted") else None, q=0.3)
        return out if rule == "count" else rounded(out, "value")


for _rule, _q in (("median", 0.5), ("quantile", 0.3)):

    @query(f"a_weighted_{_rule}", f"SELECT gid, round(min(value) FILTER (WHERE run >= {_q} * total), 7) AS value, max(n) AS feature_count FROM (SELECT gid, value, sum(w) OVER (PARTITION BY gid ORDER BY value ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY gid) AS total, count(*) OVER (PARTITION BY gid) AS n FROM {_e}) GROUP BY gid")
    def _weighted_query(spark, sf_dir, rule=_rule, q=_q):
        return rounded(agg.numeric(_weighted_events(spark, sf_dir), "value", rule, "w", q=q), "value")


_c = f"(SELECT gid, event_type AS k, sum(w) AS s, count(*) AS n FROM {_e} GROUP BY 1, 2)"
_picked = "SELECT gid, k AS event_type, round(s / total, 7) AS category_share, all_n AS feature_count FROM (SELECT *, sum(s) OVER (PARTITION BY gid) AS total, CAST(sum(n) OVER (PARTITION BY gid) AS BIGINT) AS all_n, row_number() OVER (PARTITION BY gid ORDER BY {order}) AS r FROM {c}) WHERE r = 1"

for _rule, _order in (("largest_overlap", "s DESC, k DESC"), ("majority_weighted", "s DESC, k DESC"), ("centroid_category", "n DESC, k DESC"), ("priority_order", "CASE k WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, s DESC, k")):

    @query(f"a_category_{_rule}", _picked.format(order=_order, c=_c))
    def _category_query(spark, sf_dir, rule=_rule):
        return rounded(agg.categorical(_weighted_events(spark, sf_dir), "event_type", rule, "w", priority=["purchase", "click"] if rule == "priority_order" else None), "category_share")


@query("a15_all_categories", f"SELECT gid, k AS category, round(s / sum(s) OVER (PARTITION BY gid), 4) AS share FROM {_c}")
def a15(spark, sf_dir):
    out = agg.categorical(_weighted_events(spark, sf_dir), "event_type", "all_categories", "w")
    return out.select("gid", F.explode("event_type").alias("category", "share")).withColumn("share", F.round("share", 4))


@query("a14_ordinal", f"SELECT gid, k AS o_orderpriority, round(n / total, 7) AS category_share, total AS feature_count FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY gid) AS BIGINT) AS total, row_number() OVER (PARTITION BY gid ORDER BY k) AS r FROM (SELECT gid, o_orderpriority AS k, count(*) AS n FROM {sql.cells(sql.ORDERS, 2, 'o_orderpriority')} GROUP BY 1, 2)) WHERE r = 1")
def a14(spark, sf_dir):
    levels = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    return rounded(agg.ordinal(order_cells(spark, sf_dir, 2).select("gid", "o_orderpriority"), "o_orderpriority", levels), "category_share")


_LINES = "(SELECT *, -25000000 + ((l_orderkey * 7919 + l_partkey * 104729) % 50000000) + 0.5 AS x_m, -25000000 + ((l_orderkey * 15485863 + l_suppkey * 32452843) % 50000000) + 0.5 AS y_m FROM lineitem)"
_l = sql.cells(_LINES, 3, "l_quantity AS lo, l_quantity + l_tax AS hi, l_discount + 0.01 AS w, l_extendedprice, l_discount, l_quantity")


def _line_cells(spark, sf_dir):
    x = F.lit(-25000000) + (F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729) % 50000000 + 0.5
    y = F.lit(-25000000) + (F.col("l_orderkey") * 15485863 + F.col("l_suppkey") * 32452843) % 50000000 + 0.5
    points = table(spark, sf_dir, "lineitem").withColumn("x_m", x).withColumn("y_m", y)
    cells = encode.encode_projected(points, "x_m", "y_m", "ID", 3)
    return cells.select("gid", F.col("l_quantity").alias("lo"), (F.col("l_quantity") + F.col("l_tax")).alias("hi"), (F.col("l_discount") + 0.01).alias("w"), "l_extendedprice", "l_discount", "l_quantity")


for _rule, _result in (("full_range", "min(lo) AS range_min, round(max(hi), 7) AS range_max"), ("min", "min(lo) AS range_min, round(min(hi), 7) AS range_max"), ("max", "max(lo) AS range_min, round(max(hi), 7) AS range_max"), ("weighted_mean", "round(sum((lo + hi) / 2 * w) / sum(w), 7) AS range_value")):

    @query(f"a_range_{_rule}", f"SELECT gid, {_result}, count(*) AS feature_count FROM {_l} GROUP BY gid")
    def _range_query(spark, sf_dir, rule=_rule):
        out = agg.ranged(_line_cells(spark, sf_dir), "lo", "hi", rule, "w" if rule == "weighted_mean" else None)
        return rounded(out, "range_value" if rule == "weighted_mean" else "range_max")


@query("a21_range_distribution", f"SELECT gid, lo AS min, hi AS max, w AS weight, count(*) OVER (PARTITION BY gid) AS feature_count FROM {_l}")
def a21(spark, sf_dir):
    out = agg.ranged(_line_cells(spark, sf_dir), "lo", "hi", "distribution", "w")
    return out.select("gid", F.inline("range_distribution"), "feature_count").select("gid", "min", "max", "weight", "feature_count")


@query("a26_contributions_categorical", _picked.format(order="s DESC, k DESC", c=f"(SELECT gid, event_type AS k, sum(value / 1000) AS s, count(*) AS n FROM {_e} GROUP BY 1, 2)"))
def a26_categorical(spark, sf_dir):
    cells = event_cells(spark, sf_dir).select("gid", "event_type", (F.col("value") / 1000).alias("coverage_ratio"))
    return rounded(agg.contributions(cells, "CATEGORICAL", "event_type"), "category_share")


@query("a26_contributions_ordinal", f"SELECT gid, k AS o_orderpriority, round(s / total, 7) AS category_share, all_n AS feature_count FROM (SELECT *, sum(s) OVER (PARTITION BY gid) AS total, CAST(sum(n) OVER (PARTITION BY gid) AS BIGINT) AS all_n, row_number() OVER (PARTITION BY gid ORDER BY k) AS r FROM (SELECT gid, o_orderpriority AS k, sum((1 + o_custkey % 9) / 10) AS s, count(*) AS n FROM {sql.cells(sql.ORDERS, 2, 'o_orderpriority, o_custkey')} GROUP BY 1, 2)) WHERE r = 1")
def a26_ordinal(spark, sf_dir):
    levels = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    cells = order_cells(spark, sf_dir, 2).select("gid", "o_orderpriority", ((1 + F.col("o_custkey") % 9) / 10).alias("length_ratio"))
    return rounded(agg.contributions(cells, "ORDINAL", "o_orderpriority", priority=levels), "category_share")


@query("a26_contributions_range", f"SELECT gid, min(lo) AS range_min, round(max(hi), 7) AS range_max, count(*) AS feature_count FROM {_l} GROUP BY gid")
def a26_range(spark, sf_dir):
    return rounded(agg.contributions(_line_cells(spark, sf_dir), "RANGE", lower="lo", upper="hi", coverage="w"), "range_max")


_contribution = {
    "count": ("COUNT", "count(*)"),
    "total": ("TOTAL", "round(sum(l_extendedprice * w), 5)"),
    "density": ("DENSITY", "round(sum(l_extendedprice * w) / sum(w), 5)"),
    "measurement": ("MEASUREMENT", "round(sum(l_extendedprice * w) / sum(w), 5)"),
}
for _name, (_semantics, _expression) in _contribution.items():

    @query(f"a26_contributions_{_name}", f"SELECT gid, {_expression} AS v, count(*) AS feature_count FROM {_l} GROUP BY gid")
    def _contribution_query(spark, sf_dir, semantics=_semantics):
        out = agg.contributions(_line_cells(spark, sf_dir), semantics, "l_extendedprice", coverage="w", output="v")
        return out if semantics == "COUNT" else out.withColumn("v", F.round("v", 5))


@query("a26_contributions_rate", f"SELECT gid, round(sum(l_extendedprice * w) / sum(l_quantity * w), 7) AS v, count(*) AS feature_count FROM {_l} GROUP BY gid")
def a26_rate(spark, sf_dir):
    return rounded(agg.contributions(_line_cells(spark, sf_dir), "RATE", numerator="l_extendedprice", denominator="l_quantity", coverage="w", output="v"), "v")


@query("a31_group_by_packed", f"SELECT packed_id, count(*) AS n, round(sum(value), 7) AS total FROM {_e} GROUP BY 1")
def a31(spark, sf_dir):
    return rounded(encode.cell_aggregate(event_cells(spark, sf_dir), "packed_id", "value"), "total")


@query("a31_group_by_gid", f"SELECT gid, count(*) AS n, round(sum(value), 7) AS total FROM {_e} GROUP BY 1")
def a31b(spark, sf_dir):
    return rounded(encode.cell_aggregate(event_cells(spark, sf_dir), "gid", "value"), "total")


@query("a33_unique_cells", f"SELECT count(*) AS n, count(DISTINCT gid) AS cells FROM {_e}")
def a33(spark, sf_dir):
    return event_cells(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("gid").alias("cells"))


# --- time cube (A30, J7, V6) --------------------------------------------------------------------------------------------

for _to, _label in (("day", "strftime(ts, '%Y-%m-%d')"), ("month", "strftime(ts, '%Y-%m')"), ("year", "strftime(ts, '%Y')")):

    @query(f"a30_time_rollup_{_to}", f"SELECT gid, {_label} AS period, round(sum(value), 7) AS value FROM {sql.cells(sql.EVENTS, 9, 'ts, value')} GROUP BY 1, 2")
    def _time_query(spark, sf_dir, to=_to):
        cells = event_cells(spark, sf_dir, 9).withColumn("start", F.col("ts").cast("timestamp_ntz"))
        return rounded(timecube.rollup(cells, "value", "TOTAL", to), "value")


@query("a30_time_rollup_4h_mean", f"SELECT gid, strftime(ts, '%Y-%m-%dT') || lpad(CAST(hour(ts) // 4 * 4 AS VARCHAR), 2, '0') AS period, round(avg(value), 7) AS value FROM {sql.cells(sql.EVENTS, 9, 'ts, value')} GROUP BY 1, 2")
def a30h(spark, sf_dir):
    cells = event_cells(spark, sf_dir, 9).withColumn("start", F.col("ts").cast("timestamp_ntz"))
    return rounded(timecube.rollup(cells, "value", "MEASUREMENT", "hour", 4, declared="mean"), "value")


_hours = f"(SELECT DISTINCT gid, date_trunc('day', ts) + to_hours(CAST(hour(ts) // 6 * 6 AS INTEGER)) AS a FROM {sql.cells(sql.EVENTS, 7, 'ts')})"


@query("j7_period_join", f"SELECT h.gid, strftime(a, '%Y-%m-%dT%H') AS left_period, strftime(b, '%Y-%m-%d') AS right_period, 'contained' AS relation FROM {_hours} h JOIN (SELECT DISTINCT gid, date_trunc('day', ts) AS b FROM {sql.cells(sql.EVENTS, 7, 'ts, event_type')} WHERE event_type = 'purchase') d ON h.gid = d.gid AND a >= b AND a < b + INTERVAL 1 DAY")
def j7(spark, sf_dir):
    cells = event_cells(spark, sf_dir, 7)
    hours = cells.select("gid", periods.label_of("ts", "hour", 6).alias("period")).distinct()
    days = cells.filter("event_type = 'purchase'").select("gid", periods.label_of("ts", "day").alias("period")).distinct()
    return timecube.period_join(hours, days, ("hour", 6), ("day", None))


_dirty_cube = f"(SELECT CASE WHEN event_type = 'error' AND user_id % 2 = 0 THEN '0' || gid WHEN event_type = 'error' THEN substr(gid, 1, 6) ELSE gid END AS gid, strftime(ts, '%Y-%m-%d') || CASE WHEN event_type = 'signup' THEN 'x' ELSE '' END AS period, event_type, user_id, ts FROM {sql.cells(sql.EVENTS, 7, 'ts, event_type, user_id')})"


@query("v6_time_violations", f"SELECT count(*) FILTER (WHERE event_type = 'error' AND user_id % 2 = 0) AS gid, count(*) FILTER (WHERE event_type = 'error' AND user_id % 2 = 1) AS level, count(*) FILTER (WHERE event_type = 'signup') AS label, count(*) FILTER (WHERE event_type <> 'signup' AND ts >= '2024-01-20') AS range, count(*) - count(DISTINCT gid || ' ' || period) AS duplicate FROM {_dirty_cube}")
def v6(spark, sf_dir):
    """A cube in which errors have bad gids, or gids of another level, and signups bad labels; its range ends early."""
    gid = F.when((F.col("event_type") == "error") & (F.col("user_id") % 2 == 0), F.concat(F.lit("0"), "gid")).when(F.col("event_type") == "error", F.substring("gid", 1, 6)).otherwise(F.col("gid"))
    label = F.concat(periods.label_of("ts", "day"), F.when(F.col("event_type") == "signup", "x").otherwise(""))
    return timecube.violation_counts(event_cells(spark, sf_dir, 7).select(gid.alias("gid"), label.alias("period")), 7, "day", "2024-01-01", "2024-01-20")


# --- compact sets (U2, U3, F13, J4, J5, V5) --------------------------------------------------------------------------------

#: The cells of level 3 that hold a finished order.
_seed = f"(SELECT DISTINCT substr(gid, 1, 3) AS gid FROM {sql.cells(sql.ORDERS, 4, 'o_orderstatus')} WHERE o_orderstatus = 'F')"
#: The canonical set is the coarsest cells that are full at level 3, worked out from the leaves.
_compact_sql = f"""WITH leaf AS {_seed}, l2 AS (SELECT substr(gid, 1, 2) AS gid FROM leaf GROUP BY 1 HAVING count(*) = 25), l1 AS (SELECT substr(gid, 1, 1) AS gid FROM l2 GROUP BY 1 HAVING count(*) = 4), l0 AS (SELECT '' AS gid FROM l1 HAVING count(*) = 25)
SELECT gid, CAST(length(gid) AS INTEGER) AS level FROM (SELECT gid FROM l0 UNION ALL SELECT gid FROM l1 WHERE NOT EXISTS (SELECT 1 FROM l0) UNION ALL SELECT gid FROM l2 WHERE substr(gid, 1, 1) NOT IN (SELECT gid FROM l1) UNION ALL SELECT gid FROM leaf WHERE substr(gid, 1, 2) NOT IN (SELECT gid FROM l2))"""


def _seeds(spark, sf_dir):
    return order_cells(spark, sf_dir, 4).filter("o_orderstatus = 'F'").select(F.substring("gid", 1, 3).alias("gid")).distinct()


@query("u2_compact_canonicalize", _compact_sql)
def u2(spark, sf_dir):
    return compact.canonicalize(_seeds(spark, sf_dir))


@query("u3_compact_expand", f"SELECT gid || substr('2345', CAST(k + 1 AS INTEGER), 1) AS gid FROM {_seed}, range(0, 4) t(k)")
def u3(spark, sf_dir):
    return compact.expand(compact.canonicalize(_seeds(spark, sf_dir)), 4)


_member = f"SELECT o_orderkey, substr(gid, 1, 3) IN (SELECT gid FROM {_seed}) AS in_set FROM {sql.cells(sql.ORDERS, 6, 'o_orderkey')}"


@query("f13_compact_member", _member)
def f13(spark, sf_dir):
    return compact.member(order_cells(spark, sf_dir, 6).select("o_orderkey", "gid"), compact.canonicalize(_seeds(spark, sf_dir))).select("o_orderkey", "in_set")


@query("j4_join_by_expansion", f"SELECT o_orderkey, gid FROM {sql.cells(sql.ORDERS, 4, 'o_orderkey')} WHERE substr(gid, 1, 3) IN (SELECT gid FROM {_seed})")
def j4(spark, sf_dir):
    return compact.join_by_expansion(order_cells(spark, sf_dir, 4).select("o_orderkey", "gid"), compact.canonicalize(_seeds(spark, sf_dir)), 4).select("o_orderkey", "gid")


@query("j5_join_by_ancestor", f"SELECT o_orderkey, gid FROM {sql.cells(sql.ORDERS, 6, 'o_orderkey')} WHERE substr(gid, 1, 3) IN (SELECT gid FROM {_seed})")
def j5(spark, sf_dir):
    return compact.join_by_ancestor(order_cells(spark, sf_dir, 6).select("o_orderkey", "gid"), compact.canonicalize(_seeds(spark, sf_dir))).select("o_orderkey", "gid")


# --- crosswalk (J8, A32, V7) -------------------------------------------------------------------------------------------

_xw = f"(SELECT CAST(o_custkey % 25 AS VARCHAR) AS sumber_id, gid, count(*) / sum(count(*)) OVER (PARTITION BY o_custkey % 25) AS bobot FROM {sql.cells(sql.ORDERS, 2, 'o_custkey')} GROUP BY o_custkey % 25, gid)"


def _crosswalk(spark, sf_dir):
    cells = order_cells(spark, sf_dir, 2)
    shares = cells.groupBy((F.col("o_custkey") % 25).alias("k"), "gid").agg(F.count(F.lit(1)).cast("double").alias("area"))
    totals = cells.groupBy((F.col("o_custkey") % 25).alias("k")).agg(F.count(F.lit(1)).cast("double").alias("total"))
    return crosswalk.from_shares(shares.join(totals, "k"), "k", "area", "total")


@query("x11_crosswalk_weights", f"SELECT sumber_id, gid, round(bobot, 6) AS bobot FROM {_xw}")
def x11(spark, sf_dir):
    return _crosswalk(spark, sf_dir).withColumn("bobot", F.round("bobot", 6))


@query("j8_crosswalk_apply", f"SELECT gid, round(sum(v * bobot), 3) AS v, count(*) AS feature_count FROM (SELECT CAST(c_nationkey AS VARCHAR) AS sumber_id, sum(c_acctbal) AS v FROM customer GROUP BY 1) JOIN {_xw} USING (sumber_id) GROUP BY gid")
def j8(spark, sf_dir):
    values = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("string").alias("sumber_id")).agg(F.sum("c_acctbal").alias("v"))
    return crosswalk.apply(values, _crosswalk(spark, sf_dir), "v").withColumn("v", F.round("v", 3))


@query("a32_crosswalk_summary", f"SELECT count(DISTINCT sumber_id) AS sources, count(*) AS rows, count(DISTINCT gid) AS cells FROM {_xw}")
def a32(spark, sf_dir):
    return crosswalk.summary(_crosswalk(spark, sf_dir))


# --- detection and the older grid (V8, M1, M2) ----------------------------------------------------------------------------


@query("v8_detect", "SELECT * FROM (VALUES ('o_orderkey', 'packed_id', 'rejected'), ('gid', 'gid', 'certain'), ('uri', 'uri', 'certain'), ('packed_id', 'packed_id', 'certain'), ('o_totalprice', 'none', 'rejected'), ('x_idx+y_idx', 'xy_indices', 'certain')) t(\"column\", kind, status)")
def v8(spark, sf_dir):
    cells = order_cells(spark, sf_dir, 9).select("o_orderkey", "gid", "uri", "packed_id", "o_totalprice", "x_idx", "y_idx")
    return detect.detection(spark, cells, domain="ID", level=9).select("column", "kind", "status")


def _v1_sql(cells: str, key: str, level: int) -> str:
    """Bounds of older gids, narrowed level by level as the older grid rounds them."""
    low = legacy.V1_LON, legacy.V1_LAT
    inner = f"(SELECT {key}, gid, {low[0][0]!r}::DOUBLE AS w, {low[0][1]!r}::DOUBLE AS e, {low[1][0]!r}::DOUBLE AS s, {low[1][1]!r}::DOUBLE AS n FROM {cells})"
    for k, step in enumerate(legacy.V1_STEPS[:level]):
        code = f"(instr('{legacy.V1_ALPHABETS[step]}', substr(gid, {k + 1}, 1)) - 1)"
        inner = f"(SELECT {key}, gid, w, w + dx AS e, s, s + dy AS n FROM (SELECT {key}, gid, w + dx * ({code} % {step}) AS w, s + dy * ({code} // {step}) AS s, dx, dy FROM (SELECT *, (e - w) / {step} AS dx, (n - s) / {step} AS dy FROM {inner})))"
    return inner


_old = f"(SELECT o_orderkey, translate(gid, '45', '78') AS gid FROM {sql.cells(sql.ORDERS, 3, 'o_orderkey')})"


@query("m1_decode_v1", f"SELECT o_orderkey, round(w, 9) AS min_lon, round(s, 9) AS min_lat, round(e, 9) AS max_lon, round(n, 9) AS max_lat, 3 AS v1_level FROM {_v1_sql(_old, 'o_orderkey', 3)}")
def m1(spark, sf_dir):
    old = order_cells(spark, sf_dir, 3).select("o_orderkey", F.translate("gid", "45", "78").alias("gid"))
    return legacy.decode_v1(old).select("o_orderkey", *(F.round(c, 9).alias(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")), "v1_level")


def _old_gids(points: DataFrame, level: int) -> DataFrame:
    """`gid`: the cell of the older grid that holds lon and lat, digit by digit."""
    (w, e), (s, n) = legacy.V1_LON, legacy.V1_LAT
    parts, cells = [], 1
    for step in legacy.V1_STEPS[:level]:
        cells *= step
        i, j = F.floor((F.col("lon") - w) / ((e - w) / cells)) % step, F.floor((F.col("lat") - s) / ((n - s) / cells)) % step
        parts.append(F.substring(F.lit(legacy.V1_ALPHABETS[step]), (j * step + i + 1).cast("int"), F.lit(1)))
    return points.withColumn("gid", F.concat(*parts))


@query("m2_migrate_points")
def m2(spark, sf_dir):
    """Points by their own coordinates, but errors, which have none, by the centre of their old cell."""
    points = _old_gids(_lonlat(spark, sf_dir), 9).join(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id")
    lost = F.col("event_type") == "error"
    bare = points.withColumns({c: F.when(~lost, F.col(c)) for c in ("lon", "lat")})
    return legacy.migrate_points(bare, "ID", 9, "gid", "lon", "lat").select("event_id", "gid", "method")


@query("m3_migrate_areas")
def m3(spark, sf_dir):
    """All old cells of level 5 that hold an event, to cells of level 6; tests hold the shares against their boxes."""
    old = _old_gids(_lonlat(spark, sf_dir), 5).select("gid").distinct()
    return legacy.migrate_areas(old, "ID", 6).select("source_gid", "gid", F.round("coverage_ratio", 9).alias("coverage_ratio"))


_statuses = "('ID', 1, 'released'), ('VN', 2, 'candidate'), ('BN', 3, 'released'), ('KH', 4, 'candidate'), ('LA', 5, 'released'), ('MY', 6, 'released'), ('MM', 7, 'candidate'), ('PH', 8, 'released'), ('SG', 9, 'released'), ('TH', 10, 'candidate'), ('TL', 11, 'candidate')"


@query("s18_domain_listing", f"SELECT domain, domain_id, support_status, count(o.x_idx) AS cells FROM (VALUES {_statuses}) t(domain, domain_id, support_status) LEFT JOIN {sql.cells(sql.ORDERS, 2, 'o_orderkey')} o ON o.o_orderkey % 13 = domain_id GROUP BY ALL")
def s18(spark, sf_dir):
    """Domains with what is stored for each, also those with nothing."""
    stored = order_cells(spark, sf_dir, 2).select("x_idx", (F.col("o_orderkey") % 13).alias("k"))
    named = domain_table(spark).select("domain", "domain_id", "support_status")
    return named.join(stored, F.col("domain_id") == F.col("k"), "left").groupBy("domain", "domain_id", "support_status").agg(F.count("x_idx").alias("cells"))


@query("v4_dataset_violations", f"SELECT 0::BIGINT AS gid, count(*) FILTER (WHERE o_orderkey % 50 = 0) AS uri, count(*) FILTER (WHERE o_orderkey % 100 = 0) AS packed_id, count(*) - count(DISTINCT gid) AS unique_gid FROM {sql.cells(sql.ORDERS, 9, 'o_orderkey')}")
def v4(spark, sf_dir):
    """Every fiftieth URI and every hundredth packed id is broken on purpose."""
    cells = order_cells(spark, sf_dir, 9).select("gid", "uri", "packed_id", "o_orderkey")
    uri = F.when(F.col("o_orderkey") % 50 == 0, F.concat("uri", F.lit("x"))).otherwise(F.col("uri"))
    packed = F.when(F.col("o_orderkey") % 100 == 0, F.col("packed_id") + 2).otherwise(F.col("packed_id"))
    manifest = datasets.new_manifest("ID", 9, [("o_orderkey", "int64", "COUNT")])
    return datasets.violation_counts(cells.withColumn("uri", uri).withColumn("packed_id", packed), manifest).select("gid", "uri", "packed_id", "unique_gid")


_two_levels = f"""WITH fine AS (SELECT DISTINCT gid FROM {sql.cells(sql.ORDERS, 4, 'o_orderstatus')} WHERE o_orderstatus = 'F'),
rows AS (SELECT gid, CAST(length(gid) AS INTEGER) AS level FROM fine UNION ALL SELECT gid, 3 FROM {_seed} UNION ALL SELECT '0' || gid, 5 FROM fine UNION ALL SELECT gid, 4 FROM {_seed}),
valid AS (SELECT * FROM rows WHERE gid NOT LIKE '0%')"""


@query("v5_compact_violations", _two_levels + """ SELECT (SELECT count(*) FROM rows WHERE gid LIKE '0%') AS invalid, (SELECT count(*) FROM rows WHERE level <> length(gid)) AS level, (SELECT count(*) - count(DISTINCT gid) FROM rows) AS duplicate, (SELECT count(DISTINCT gid) FROM valid WHERE length(gid) = 4) AS covered,
(SELECT count(*) FROM (SELECT substr(gid, 1, length(gid) - 1) AS p, level FROM rows GROUP BY 1, 2 HAVING count(DISTINCT gid) = CASE level WHEN 1 THEN 25 WHEN 2 THEN 4 WHEN 3 THEN 25 WHEN 4 THEN 4 WHEN 5 THEN 25 END)) AS incomplete_promotion""")
def v5(spark, sf_dir):
    """A set that breaks every rule: cells of two levels, one inside the other, some twice, invalid ones, wrong levels."""
    fine = order_cells(spark, sf_dir, 4).filter("o_orderstatus = 'F'").select("gid").distinct()
    seeds = _seeds(spark, sf_dir)
    own = fine.unionByName(seeds).withColumn("level", F.length("gid"))
    invalid = fine.select(F.concat(F.lit("0"), "gid").alias("gid"), F.lit(5).alias("level"))
    return compact.violation_counts(own.unionByName(invalid).unionByName(seeds.withColumn("level", F.lit(4))))


_dirty_xw = f"(SELECT CASE WHEN sumber_id = '3' THEN ' ' ELSE sumber_id END AS sumber_id, CASE WHEN sumber_id = '5' THEN gid || '2' ELSE gid END AS gid, CASE WHEN sumber_id = '7' THEN -bobot WHEN sumber_id = '9' THEN bobot / 2 ELSE bobot END AS bobot FROM {_xw} UNION ALL SELECT sumber_id, gid, bobot FROM {_xw} WHERE sumber_id = '11')"


@query("v7_crosswalk_violations", f"SELECT count(*) FILTER (WHERE trim(sumber_id) = '') AS source, count(*) FILTER (WHERE length(gid) <> 2) AS gid, count(*) FILTER (WHERE bobot <= 0) AS weight, (SELECT count(*) FROM (SELECT 1 FROM {_dirty_xw} GROUP BY sumber_id, gid HAVING count(*) > 1)) AS duplicate, (SELECT count(*) FROM (SELECT 1 FROM {_dirty_xw} GROUP BY sumber_id HAVING abs(sum(bobot) - 1) > 1e-9)) AS sum FROM {_dirty_xw}")
def v7(spark, sf_dir):
    """A crosswalk with one source of each fault: no name, finer cells, negative or too small weights, rows twice."""
    rows, s = _crosswalk(spark, sf_dir), F.col("sumber_id")
    weight = F.when(s == "7", -F.col("bobot")).when(s == "9", F.col("bobot") / 2).otherwise(F.col("bobot"))
    dirty = rows.select(F.when(s == "3", " ").otherwise(s).alias("sumber_id"), F.when(s == "5", F.concat("gid", F.lit("2"))).otherwise(F.col("gid")).alias("gid"), weight.alias("bobot"))
    return crosswalk.violation_counts(dirty.unionByName(rows.filter(s == "11")), 2)


# --- geometry (X2-X6, F1-F6, G1) -----------------------------------------------------------------------------------------

_BOX = "POLYGON (({x0} {y0}, {x1} {y0}, {x1} {y1}, {x0} {y1}, {x0} {y0}))"


def _boxes(spark, sf_dir):
    """A box of 1500 m by 700 m at each event, with its south-west corner half a metre off the grid."""
    e = event_points(spark, sf_dir)
    corner = lambda c, w: F.format_string("%.1f", F.col(c) + w)
    x0, y0, x1, y1 = corner("x_m", 0), corner("y_m", 0), corner("x_m", 1500), corner("y_m", 700)
    ring = F.concat_ws(", ", *(F.concat_ws(" ", a, b) for a, b in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))))
    return e.select("event_id", "value", F.concat(F.lit("POLYGON (("), ring, F.lit("))")).alias("geometry"))


_boxes_sql = "(SELECT event_id, value, ((event_id * 37) % 8000) - 4000.5 AS x_m, ((event_id * 53 + user_id) % 8000) - 4000.5 AS y_m FROM events)"
_overlap = f"(SELECT event_id, value, floor((x_m + 25000000) / 500)::BIGINT + i AS x_idx, floor((y_m + 25000000) / 500)::BIGINT + j AS y_idx, least(x_m + 1500, (floor((x_m + 25000000) / 500) + i + 1) * 500 - 25000000) - greatest(x_m, (floor((x_m + 25000000) / 500) + i) * 500 - 25000000) AS w, least(y_m + 700, (floor((y_m + 25000000) / 500) + j + 1) * 500 - 25000000) - greatest(y_m, (floor((y_m + 25000000) / 500) + j) * 500 - 25000000) AS h FROM {_boxes_sql}, range(0, 4) a(i), range(0, 3) b(j))"


@query("x2_polyfill_boxes", f"SELECT event_id, {sql.gid('x_idx', 'y_idx', 10)} AS gid, round(w * h / 250000, 6) AS coverage_ratio FROM {_overlap} WHERE w > 0 AND h > 0")
def x2(spark, sf_dir):
    cells = polygons_to_cells(_boxes(spark, sf_dir), "geometry", "ID", 10)
    return cells.select("event_id", "gid", F.round("coverage_ratio", 6).alias("coverage_ratio"))


@query("x5_geometry_table_shares", f"SELECT event_id, {sql.gid('x_idx', 'y_idx', 10)} AS gid, round(w * h / 1050000, 6) AS coverage_ratio FROM {_overlap} WHERE w > 0 AND h > 0")
def x5(spark, sf_dir):
    cells = geometry_to_cells(_boxes(spark, sf_dir), "geometry", "ID", 10)
    return cells.select("event_id", "gid", F.round("coverage_ratio", 6).alias("coverage_ratio"))


@query("a29_geometry_to_cell_totals", f"SELECT {sql.gid('x_idx', 'y_idx', 10)} AS gid, round(sum(value * w * h / 1050000), 5) AS value, count(*) AS feature_count FROM {_overlap} WHERE w > 0 AND h > 0 GROUP BY 1")
def a29(spark, sf_dir):
    cells = geometry_to_cells(_boxes(spark, sf_dir), "geometry", "ID", 10, keep=["value"])
    out = agg.contributions(cells.drop("domain", "level", "x_idx", "y_idx", "uri"), "TOTAL", "value")
    return out.withColumn("value", F.round("value", 5))


@query("x4_polygon_to_cell", f"SELECT event_id, max(gid) AS gid FROM (SELECT event_id, gid, r, max(r) OVER (PARTITION BY event_id) AS best FROM (SELECT event_id, {sql.gid('x_idx', 'y_idx', 10)} AS gid, round(w * h / 250000, 9) AS r FROM {_overlap} WHERE w > 0 AND h > 0)) WHERE r = best GROUP BY 1")
def x4(spark, sf_dir):
    return polygon_to_cell(_boxes(spark, sf_dir), "geometry", "ID", 10, source="event_id").select("event_id", "gid")


for _method in ("centroid", "representative_point"):

    @query(f"x4_polygon_to_cell_{_method}", f"SELECT event_id, gid FROM {sql.cells(_boxes_sql.replace('- 4000.5 AS x_m', '- 4000.5 + 750 AS x_m').replace('- 4000.5 AS y_m', '- 4000.5 + 350 AS y_m'), 10, 'event_id')}")
    def _point_query(spark, sf_dir, method=_method):
        return polygon_to_cell(_boxes(spark, sf_dir), "geometry", "ID", 10, method, source="event_id").select("event_id", "gid")


#: An L of two boxes that overlap in 500 m by 300 m, as a MultiPolygon: covered once.
_ell_sql = f"(SELECT event_id, x_idx, y_idx, greatest(0, least(x_m + 1500, cx + 500) - greatest(x_m, cx)) * greatest(0, least(y_m + 700, cy + 500) - greatest(y_m, cy)) + greatest(0, least(x_m + 2000, cx + 500) - greatest(x_m + 1000, cx)) * greatest(0, least(y_m + 1400, cy + 500) - greatest(y_m + 400, cy)) - greatest(0, least(x_m + 1500, cx + 500) - greatest(x_m + 1000, cx)) * greatest(0, least(y_m + 700, cy + 500) - greatest(y_m + 400, cy)) AS a FROM (SELECT *, x_idx * 500 - 25000000 AS cx, y_idx * 500 - 25000000 AS cy FROM (SELECT event_id, x_m, y_m, floor((x_m + 25000000) / 500)::BIGINT + i AS x_idx, floor((y_m + 25000000) / 500)::BIGINT + j AS y_idx FROM {_boxes_sql}, range(0, 6) a(i), range(0, 4) b(j))))"


@query("u5_overlapping_parts", f"SELECT event_id, {sql.gid('x_idx', 'y_idx', 10)} AS gid, round(a / 250000, 6) AS coverage_ratio FROM {_ell_sql} WHERE a > 0")
def u5(spark, sf_dir):
    ring = lambda x0, y0, x1, y1: "((%1$s %2$s, %3$s %2$s, %3$s %4$s, %1$s %4$s, %1$s %2$s))".replace("%1$s", f"%{x0}$.1f").replace("%2$s", f"%{y0}$.1f").replace("%3$s", f"%{x1}$.1f").replace("%4$s", f"%{y1}$.1f")
    text = f"MULTIPOLYGON ({ring(1, 2, 3, 4)}, {ring(5, 6, 7, 8)})"
    at = [F.col("x_m"), F.col("y_m"), F.col("x_m") + 1500, F.col("y_m") + 700, F.col("x_m") + 1000, F.col("y_m") + 400, F.col("x_m") + 2000, F.col("y_m") + 1400]
    shapes = event_points(spark, sf_dir).select("event_id", F.format_string(text, *at).alias("geometry"))
    cells = polygons_to_cells(shapes, "geometry", "ID", 10)
    return cells.select("event_id", "gid", F.round("coverage_ratio", 6).alias("coverage_ratio"))


@query("x11_polygon_crosswalk", f"SELECT CAST(event_id AS VARCHAR) AS sumber_id, {sql.gid('x_idx', 'y_idx', 10)} AS gid, round(w * h / 1050000, 6) AS bobot FROM {_overlap} WHERE w > 0 AND h > 0")
def x11_polygons(spark, sf_dir):
    rows = crosswalk.from_polygons(_boxes(spark, sf_dir), "event_id", "geometry", "ID", 10)
    return rows.withColumn("bobot", F.round("bobot", 6))


#: A line that climbs 700 m over 1500 m: its share of a cell is the overlap of two stretches of it.
_stretch = "(SELECT event_id, x_idx, y_idx, least(1, (cx + 500 - x_m) / 1500, (cy + 500 - y_m) / 700) - greatest(0, (cx - x_m) / 1500, (cy - y_m) / 700) AS t FROM (SELECT *, x_idx * 500 - 25000000 AS cx, y_idx * 500 - 25000000 AS cy FROM (SELECT event_id, x_m, y_m, floor((x_m + 25000000) / 500)::BIGINT + i AS x_idx, floor((y_m + 25000000) / 500)::BIGINT + j AS y_idx FROM " + _boxes_sql + ", range(0, 4) a(i), range(0, 3) b(j))))"


@query("x6_lines", f"SELECT event_id, {sql.gid('x_idx', 'y_idx', 10)} AS gid, round(t, 6) AS length_ratio FROM {_stretch} WHERE t > 1e-9")
def x6(spark, sf_dir):
    at = [F.col("x_m"), F.col("y_m"), F.col("x_m") + 1500, F.col("y_m") + 700]
    lines = event_points(spark, sf_dir).select("event_id", F.format_string("LINESTRING (%.1f %.1f, %.1f %.1f)", *at).alias("geometry"))
    cells = geometry_to_cells(lines, "geometry", "ID", 10).filter("length_ratio > 1e-9")
    return cells.select("event_id", "gid", F.round("length_ratio", 6).alias("length_ratio"))


@query("x5_geometry_table_mixed", f"SELECT event_id, gid, NULL::DOUBLE AS coverage_ratio, NULL::DOUBLE AS length_ratio, 'point' AS assignment_method FROM {sql.cells(sql.EVENTS, 10, 'event_id, event_type')} WHERE event_type IN ('click', 'view') UNION ALL SELECT event_id, {sql.gid('x_idx', 'y_idx', 10)}, NULL, round(t, 6), 'length' FROM {_stretch} JOIN events USING (event_id) WHERE t > 1e-9 AND event_type IN ('error', 'signup') UNION ALL SELECT event_id, {sql.gid('x_idx', 'y_idx', 10)}, round(w * h / 1050000, 6), NULL, 'area' FROM {_overlap} JOIN (SELECT event_id, event_type FROM events) USING (event_id) WHERE w > 0 AND h > 0 AND event_type = 'purchase'")
def x5_mixed(spark, sf_dir):
    """Points, lines and polygons in one table, by the type of event."""
    e = event_points(spark, sf_dir)
    at = [F.col("x_m"), F.col("y_m"), F.col("x_m") + 1500, F.col("y_m") + 700]
    point, line = F.format_string("POINT (%.1f %.1f)", *at[:2]), F.format_string("LINESTRING (%.1f %.1f, %.1f %.1f)", *at)
    box = F.format_string("POLYGON ((%1$.1f %2$.1f, %3$.1f %2$.1f, %3$.1f %4$.1f, %1$.1f %4$.1f, %1$.1f %2$.1f))", *at)
    kind = F.col("event_type")
    shapes = e.select("event_id", F.when(kind.isin("click", "view"), point).when(kind == "purchase", box).otherwise(line).alias("geometry"))
    cells = geometry_to_cells(shapes, "geometry", "ID", 10).filter("length_ratio IS NULL OR length_ratio > 1e-9")
    return cells.select("event_id", "gid", F.round("coverage_ratio", 6).alias("coverage_ratio"), F.round("length_ratio", 6).alias("length_ratio"), "assignment_method")


_TRIANGLE = "POLYGON ((-3000.25 -3000.25, 3000.25 -2000.25, 0.25 3500.25, -3000.25 -3000.25))"
_in_triangle = "((6000.5 * (y_m + 3000.25) - 1000.0 * (x_m + 3000.25)) >= 0 AND (-3000.0 * (y_m + 2000.25) - 5500.5 * (x_m - 3000.25)) >= 0 AND (-3000.5 * (y_m - 3500.25) + 6500.5 * (x_m - 0.25)) >= 0)"


@query("f1_points_in_boundary", f"SELECT event_id FROM {sql.EVENTS} WHERE {_in_triangle}")
def f1(spark, sf_dir):
    return Boundary.read(_TRIANGLE, "ID").filter_points(event_points(spark, sf_dir)).select("event_id")


@query("f2_cells_centroid_covered", f"SELECT DISTINCT gid FROM (SELECT gid, x_idx * 100 - 25000000 + 50.0 AS x_m, y_idx * 100 - 25000000 + 50.0 AS y_m FROM {_e}) WHERE {_in_triangle}")
def f2(spark, sf_dir):
    cells = event_cells(spark, sf_dir).select("gid", "x_idx", "y_idx").distinct()
    return Boundary.read(_TRIANGLE, "ID").filter_cells(cells, 11, "CENTROID_COVERED").select("gid")


_RECTANGLE = "POLYGON ((-1030 -2040, 2210 -2040, 2210 1870, -1030 1870, -1030 -2040))"
_squares = f"(SELECT DISTINCT gid, x_idx * 100 - 25000000 AS x0, y_idx * 100 - 25000000 AS y0 FROM {_e})"


@query("f3_cells_intersect", f"SELECT gid FROM {_squares} WHERE x0 + 100 >= -1030 AND x0 <= 2210 AND y0 + 100 >= -2040 AND y0 <= 1870")
def f3(spark, sf_dir):
    cells = event_cells(spark, sf_dir).select("gid", "x_idx", "y_idx").distinct()
    return Boundary.read(_RECTANGLE, "ID").filter_cells(cells, 11, "INTERSECTS").select("gid")


@query("f4_cells_min_coverage", f"SELECT gid FROM {_squares} WHERE greatest(0, least(x0 + 100, 2210) - greatest(x0, -1030)) * greatest(0, least(y0 + 100, 1870) - greatest(y0, -2040)) >= 5000")
def f4(spark, sf_dir):
    cells = event_cells(spark, sf_dir).select("gid", "x_idx", "y_idx").distinct()
    return Boundary.read(_RECTANGLE, "ID").filter_cells(cells, 11, "MIN_COVERAGE", 0.5).select("gid")


@query("x9_table_to_cells_boundary", f"SELECT event_id, gid, {_in_triangle} AS boundary_match, 'POLYGON ((' || concat_ws(', ', x0 || ' ' || y0, x1 || ' ' || y0, x1 || ' ' || y1, x0 || ' ' || y1, x0 || ' ' || y0) || '))' AS geometry FROM (SELECT *, x_idx * 100 - 25000000 AS x0, y_idx * 100 - 25000000 AS y0, x_idx * 100 - 24999900 AS x1, y_idx * 100 - 24999900 AS y1 FROM {sql.cells(sql.EVENTS, 11, 'event_id, x_m, y_m')})")
def x9(spark, sf_dir):
    triangle = Boundary.read(_TRIANGLE, "ID")
    cells = services.table_to_cells(event_points(spark, sf_dir), "ID", 11, x="x_m", y="y_m", keep=["event_id"], boundary=triangle, geometry=True)
    return cells.select("event_id", "gid", "boundary_match", "geometry")


@query("x9_table_to_cells_dropped", f"SELECT event_id, gid FROM {sql.cells(sql.EVENTS, 11, 'event_id, x_m, y_m')} WHERE {_in_triangle}")
def x9_dropped(spark, sf_dir):
    triangle = Boundary.read(_TRIANGLE, "ID")
    return services.table_to_cells(event_points(spark, sf_dir), "ID", 11, x="x_m", y="y_m", keep=["event_id"], boundary=triangle, drop_outside=True).select("event_id", "gid")


_near_uri = f"SELECT o_orderkey, {sql.gid('near_x', 'near_y', 8)} AS near_gid, 'cell:v2:ID:' || {sql.gid('near_x', 'near_y', 8)} AS near_uri FROM (SELECT o_orderkey, x_idx + dx AS near_x, y_idx + dy AS near_y, dx, dy FROM {sql.cells(sql.ORDERS, 8, 'o_orderkey')}, range(-2, 3) a(dx), range(-2, 3) b(dy)) WHERE near_x BETWEEN 0 AND 9999 AND near_y BETWEEN 0 AND 9999"


@query("t8_neighbourhood", f"{_near_uri} AND greatest(abs(dx), abs(dy)) = 2")
def t8(spark, sf_dir):
    near = services.neighbourhood(order_cells(spark, sf_dir, 8).select("o_orderkey", "uri"), "uri", 8, 2)
    return near.select("o_orderkey", "near_gid", "near_uri")


@query("t8_neighbourhood_boundary", f"{_near_uri} AND (near_x + 1) * 5000 - 25000000 >= -9003000 AND near_x * 5000 - 25000000 <= 8004000 AND (near_y + 1) * 5000 - 25000000 >= -7002000 AND near_y * 5000 - 25000000 <= 9001000")
def t8_boundary(spark, sf_dir):
    """Disks of bare gids, inside a rectangle."""
    inside = Boundary.read("POLYGON ((-9003000 -7002000, 8004000 -7002000, 8004000 9001000, -9003000 9001000, -9003000 -7002000))", "ID")
    near = services.neighbourhood(order_cells(spark, sf_dir, 8).select("o_orderkey", "gid"), "gid", 8, 2, "ID", "disk", inside)
    return near.select("o_orderkey", "near_gid", "near_uri")


@query("t9_distance", f"SELECT o_orderkey, round(sqrt((x_idx - a)::DOUBLE ** 2 + (y_idx - b)::DOUBLE ** 2) * 5000.0, 2) AS metres FROM (SELECT o_orderkey, x_idx, y_idx, (x_idx + o_orderkey * 31) % 10000 AS a, (y_idx + o_orderkey * 17) % 10000 AS b FROM {sql.cells(sql.ORDERS, 8, 'o_orderkey')})")
def t9(spark, sf_dir):
    cells = order_cells(spark, sf_dir, 8)
    a, b = (F.col("x_idx") + F.col("o_orderkey") * 31) % 10000, (F.col("y_idx") + F.col("o_orderkey") * 17) % 10000
    pairs = cells.select("o_orderkey", "uri", codec.uri_of("ID", codec.gid_of(a, b, 8)).alias("other"))
    return services.distance(pairs, "uri", "other", "metres").select("o_orderkey", F.round("metres", 2).alias("metres"))


#: A right triangle for every nation.
_zone = "-4000 + (n_nationkey * 317) % 6000 AS zx, -4000 + (n_nationkey * 1231) % 6000 AS zy, 1500 + n_nationkey * 40 AS zw, 2500 - n_nationkey * 30 AS zh"


@query("j6_points_in_zones", f"SELECT event_id, n_nationkey FROM {sql.EVENTS} JOIN (SELECT n_nationkey, {_zone} FROM nation) ON x_m >= zx AND y_m >= zy AND (x_m - zx) * zh + (y_m - zy) * zw <= zw * zh")
def j6(spark, sf_dir):
    n = F.col("n_nationkey")
    zx, zy, zw, zh = -4000 + (n * 317) % 6000, -4000 + (n * 1231) % 6000, 1500 + n * 40, 2500 - n * 30
    text = F.format_string("POLYGON ((%1$d %2$d, %3$d %2$d, %1$d %4$d, %1$d %2$d))", zx, zy, zx + zw, zy + zh)
    zones = table(spark, sf_dir, "nation").select("n_nationkey", text.alias("geometry"))
    return services.points_in_zones(event_points(spark, sf_dir).select("event_id", "x_m", "y_m"), zones, "n_nationkey", "geometry", "ID", 11).select("event_id", "n_nationkey")


@query("g1_cell_outlines", "SELECT DISTINCT 'POLYGON ((' || concat_ws(', ', x0 || ' ' || y0, x1 || ' ' || y0, x1 || ' ' || y1, x0 || ' ' || y1, x0 || ' ' || y0) || '))' AS geometry FROM (SELECT CAST(x_idx * 1000000 - 25000000 AS BIGINT) AS x0, CAST(y_idx * 1000000 - 25000000 AS BIGINT) AS y0, CAST(x_idx * 1000000 - 24000000 AS BIGINT) AS x1, CAST(y_idx * 1000000 - 24000000 AS BIGINT) AS y1 FROM " + sql.cells(sql.ORDERS, 3, "o_orderkey") + ")")
def g1(spark, sf_dir):
    cells = order_cells(spark, sf_dir, 3).select("x_idx", "y_idx").distinct()
    return cell_polygons(cells, 3).select("geometry")


# --- sources, SQL functions and streams (S1-S14, F7, section 2.15, 2.11) ----------------------------------------------------


@query("s7_dataset_roundtrip", f"SELECT gid, round(sum(value), 4) AS value FROM {_e} GROUP BY gid")
def s7(spark, sf_dir):
    values = encode.cell_aggregate(event_cells(spark, sf_dir), "gid", "value").select("gid", F.col("total").alias("value"))
    path = datasets.temporary(spark, "cells")
    manifest = datasets.new_manifest("ID", 11, [("value", "double", "TOTAL")])
    datasets.write_dataset(values, path, manifest)
    return datasets.read_dataset(spark, path)[0].withColumn("value", F.round("value", 4))


@query("f7_bbox_query", f"SELECT x_idx, y_idx, count(*) AS n FROM {sql.cells(sql.EVENTS, 11, 'event_id')} WHERE x_idx BETWEEN 249980 AND 250010 AND y_idx BETWEEN 249990 AND 250020 GROUP BY 1, 2")
def f7(spark, sf_dir):
    cells = event_cells(spark, sf_dir).groupBy("gid", "x_idx", "y_idx").agg(F.count(F.lit(1)).alias("n"))
    path = datasets.temporary(spark, "bbox")
    datasets.write_dataset(cells, path, datasets.new_manifest("ID", 11, [("n", "int64", "COUNT")]))
    return datasets.query_windows(spark, path, [(249980, 250010, 249990, 250020)]).select("x_idx", "y_idx", "n")


@query("s1_csv_roundtrip", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def s1(spark, sf_dir):
    """A table written as CSV and read again (S1, S6)."""
    path = datasets.temporary(spark, "orders")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    tables.write_table(orders, path, "csv")
    return tables.read_table(spark, path, "csv", schema=orders.schema)


@query("f7_bbox_lonlat", f"SELECT event_id, gid FROM ({_my_sql(9)}) JOIN (SELECT event_id, 100 + ((event_id * 37) % 19000) / 1000.0 AS lon, 1 + ((event_id * 53) % 6000) / 1000.0 AS lat FROM events) USING (event_id) WHERE lon BETWEEN 103 AND 109 AND lat BETWEEN 2 AND 5")
def f7_lonlat(spark, sf_dir):
    """The cells of a WGS 84 box hold all points of the box; the points themselves are filtered after."""
    lon, lat = 100 + (F.col("event_id") * 37) % 19000 / 1000.0, 1 + (F.col("event_id") * 53) % 6000 / 1000.0
    points = table(spark, sf_dir, "events").select("event_id", lon.alias("lon"), lat.alias("lat"))
    cells = encode.encode_lonlat(points, "lon", "lat", "MY", 9).select("event_id", "lon", "lat", "gid", "x_idx", "y_idx")
    path = datasets.temporary(spark, "lonlat")
    fields = [("event_id", "int64", "COUNT"), ("lon", "double", "MEASUREMENT"), ("lat", "double", "MEASUREMENT")]
    manifest = datasets.new_manifest("MY", 9, fields, "cell_contributions")
    datasets.write_dataset(cells, path, manifest)
    found = datasets.query_dataset(spark, path, (103.0, 2.0, 109.0, 5.0), "MY", 9, "dense")
    return found.filter("lon BETWEEN 103 AND 109 AND lat BETWEEN 2 AND 5").select("event_id", "gid")


@query("s13_time_store_roundtrip", f"SELECT gid, strftime(ts, '%Y-%m-%d') AS period, round(sum(value), 4) AS value FROM {sql.cells(sql.EVENTS, 9, 'ts, value')} GROUP BY 1, 2")
def s13(spark, sf_dir):
    cells = event_cells(spark, sf_dir, 9).withColumn("start", F.col("ts").cast("timestamp_ntz"))
    path = datasets.temporary(spark, "time")
    datasets.write_time_values(timecube.rollup(cells, "value", "TOTAL", "day"), path, "ID", 9, "day", "2024-01-01", "2025-01-01", [("value", "double", "TOTAL")])
    return datasets.read_time_values(spark, path)[0].withColumn("value", F.round("value", 4))


@query("s12_compact_store_roundtrip", _compact_sql)
def s12(spark, sf_dir):
    path = datasets.temporary(spark, "compact")
    datasets.write_compact_set(compact.canonicalize(_seeds(spark, sf_dir)), path, "ID")
    return datasets.read_compact_set(spark, path)[0].withColumn("level", F.col("level").cast("int"))


@query("udf_sql_functions", f"SELECT o_orderkey, x_idx, y_idx, gid, packed_id FROM {sql.cells(sql.ORDERS, 9, 'o_orderkey')}")
def udf_sql(spark, sf_dir):
    sqlfuncs.register(spark, 9)
    order_points(spark, sf_dir).createOrReplaceTempView("_points")
    return spark.sql("SELECT o_orderkey, cell_x_l9(x_m) AS x_idx, cell_y_l9(y_m) AS y_idx, cell_gid_l9(x_m, y_m) AS gid, cell_packed_l9(1L, x_m, y_m) AS packed_id FROM _points")


@query("udtf_polyfill", f"SELECT event_id, {sql.gid('x_idx', 'y_idx', 10)} AS gid, round(w * h / 250000, 6) AS coverage_ratio FROM {_overlap} WHERE w > 0 AND h > 0")
def udtf_polyfill(spark, sf_dir):
    sqlfuncs.register_polyfill(spark)
    _boxes(spark, sf_dir).createOrReplaceTempView("_boxes")
    return spark.sql("SELECT event_id, c.gid, round(c.coverage_ratio, 6) AS coverage_ratio FROM _boxes, LATERAL cell_polyfill(geometry, 10) c")


@query("stream_windowed_cells", f"SELECT gid, date_trunc('day', ts) + to_hours(CAST(hour(ts) // 4 * 4 AS INTEGER)) AS start, count(*) AS n FROM {sql.cells(sql.EVENTS, 7, 'ts')} GROUP BY 1, 2")
def stream(spark, sf_dir):
    return streams.replay(spark, f"{sf_dir}/events.parquet", "event_id", 7)
