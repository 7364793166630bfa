"""Cell functions for Spark SQL, and encoder texts for other warehouses."""

from __future__ import annotations

from pyspark.sql import SparkSession

from meshlark.errors import ContractError
from meshlark.functions.constants import ALPHABETS, CODE_BITS, COUNTS, STEPS, cell_count, cell_side, check_level


def _index(v: str, level: int) -> str:
    return f"CASE WHEN {v} BETWEEN -25000000D AND 25000000D THEN least(CAST(floor(({v} + 25000000D) / {cell_side(level)!r}D) AS BIGINT), {cell_count(level) - 1}L) END"


def _code(x: str, y: str, level: int, i: int) -> str:
    below, s = COUNTS[level] // COUNTS[i + 1], STEPS[i]
    return f"((({y}) DIV {below}L) % {s}L * {s}L + (({x}) DIV {below}L) % {s}L)"


def definitions(level: int) -> list[str]:
    """CREATE FUNCTION statements; Spark inlines their bodies into the plan."""
    check_level(level, 1)
    x, y = _index("px", level), _index("py", level)
    gid = ", ".join(f"substring('{ALPHABETS[s]}', CAST({_code(x, y, level, i)} AS INT) + 1, 1)" for i, s in enumerate(STEPS[:level]))
    left, path = sum(CODE_BITS[:level]), []
    for i, bits in enumerate(CODE_BITS[:level]):
        left -= bits
        path.append(f"{_code(x, y, level, i)} * {1 << left}L")
    return [
        f"CREATE OR REPLACE TEMPORARY FUNCTION cell_x_l{level}(px DOUBLE) RETURNS BIGINT RETURN {x}",
        f"CREATE OR REPLACE TEMPORARY FUNCTION cell_y_l{level}(py DOUBLE) RETURNS BIGINT RETURN {y}",
        f"CREATE OR REPLACE TEMPORARY FUNCTION cell_gid_l{level}(px DOUBLE, py DOUBLE) RETURNS STRING RETURN concat({gid})",
        f"CREATE OR REPLACE TEMPORARY FUNCTION cell_packed_l{level}(domain_id BIGINT, px DOUBLE, py DOUBLE) RETURNS BIGINT RETURN shiftleft(domain_id, 54) | {level << 50}L | (2L * ({' + '.join(path)}))",
    ]


def register(spark: SparkSession, level: int) -> None:
    for statement in definitions(level):
        spark.sql(statement)


def register_polyfill(spark: SparkSession, name: str = "cell_polyfill") -> None:
    """A table function for SQL: cell_polyfill(shape, level), a polygon as WKT, WKB or GeoJSON in grid metres.

    A row (gid, x_idx, y_idx, coverage_ratio) for each cell with a share in it; none for null. For whole tables
    geometry.polygons_to_cells, which reads batches, is the faster way.
    """
    from pyspark.sql.functions import udtf

    class Polyfill:
        def eval(self, shape, level: int):
            from meshlark.functions import shapes
            from meshlark.operators.geometry import gid_text, polygon_cells

            kind, parts = shapes.parse(shape) if shape is not None else ("polygon", [])
            if kind != "polygon":
                raise ContractError("only polygons can be filled")
            for x, y, share, _ in polygon_cells(parts, check_level(level)):
                yield gid_text(level, x, y), x, y, share

    spark.udtf.register(name, udtf(Polyfill, returnType="gid string, x_idx bigint, y_idx bigint, coverage_ratio double"))


def render(engine: str, name: str = "encode_cell") -> str:
    """Encoder text (domain_id, level, x, y) for bigquery or snowflake (JavaScript) or postgis (PL/pgSQL).

    Outside the root it gives null. The JavaScript engines give the packed id as text, which their numbers can't hold.
    """
    steps = ", ".join(map(str, STEPS))
    if engine in ("bigquery", "snowflake"):
        d, lv, x, y = ("domain_id", "level", "x", "y") if engine == "bigquery" else ("DOMAIN_ID", "LEVEL", "X", "Y")
        body = f"""
const steps = [{steps}], letters = {{5: "{ALPHABETS[5]}", 2: "{ALPHABETS[2]}"}}, half = 25000000;
const bad = (v) => !(v >= -half && v <= half);
if (bad({x}) || bad({y})) return null;
let n = 1;
for (let k = 0; k < {lv}; k++) n *= steps[k];
const at = (v) => Math.min(n - 1, Math.floor((v + half) / (2 * half / n)));
let col = at({x}), row = at({y}), gid = "", path = 0n, shift = 0n;
for (let k = {lv} - 1; k >= 0; k--) {{
  const s = steps[k], code = (row % s) * s + (col % s);
  gid = letters[s][code] + gid;
  path |= BigInt(code) << shift;
  shift += s === 5 ? 5n : 2n;
  col = Math.floor(col / s); row = Math.floor(row / s);
}}
const packed = (BigInt({d}) << 54n) | (BigInt({lv}) << 50n) | (path << 1n);
return {{gid: gid, packed_id: packed.toString()}};
"""
        if engine == "bigquery":
            return f'CREATE OR REPLACE FUNCTION {name}(domain_id INT64, level INT64, x FLOAT64, y FLOAT64)\nRETURNS STRUCT<gid STRING, packed_id STRING>\nLANGUAGE js AS r"""{body}""";\n'
        return f"CREATE OR REPLACE FUNCTION {name}(DOMAIN_ID DOUBLE, LEVEL DOUBLE, X DOUBLE, Y DOUBLE)\nRETURNS VARIANT\nLANGUAGE JAVASCRIPT AS $${body}$$;\n"
    if engine == "postgis":
        return f"""CREATE OR REPLACE FUNCTION {name}(domain_id bigint, level int, x double precision, y double precision)
RETURNS TABLE (gid text, packed_id bigint) LANGUAGE plpgsql IMMUTABLE AS $$
DECLARE
  steps int[] := ARRAY[{steps}]; n bigint := 1; c bigint; r bigint; code bigint; path bigint := 0; shift int := 0; half constant double precision := 25000000; t text := '';
BEGIN
  IF x IS NULL OR y IS NULL OR x < -half OR x > half OR y < -half OR y > half THEN RETURN; END IF;
  FOR k IN 1..level LOOP n := n * steps[k]; END LOOP;
  c := least(n - 1, floor((x + half) / (2 * half / n))::bigint);
  r := least(n - 1, floor((y + half) / (2 * half / n))::bigint);
  FOR k IN REVERSE level..1 LOOP
    code := (r % steps[k]) * steps[k] + c % steps[k];
    t := substr(CASE steps[k] WHEN 5 THEN '{ALPHABETS[5]}' ELSE '{ALPHABETS[2]}' END, code::int + 1, 1) || t;
    path := path | (code << shift);
    shift := shift + CASE steps[k] WHEN 5 THEN 5 ELSE 2 END;
    c := c / steps[k]; r := r / steps[k];
  END LOOP;
  gid := t; packed_id := (domain_id << 54) | (level::bigint << 50) | (path << 1);
  RETURN NEXT;
END $$;
"""
    raise ContractError(f"no encoder text for {engine!r}")
