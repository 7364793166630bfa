"""Which columns of a table hold cell keys: one aggregate over all columns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from meshlark.functions import codec
from meshlark.functions.constants import cell_count

# Fixed values.
LEAST_LENGTH, LEAST_RATIO, EXAMPLES = 5, 0.99, 3
RESULT = "column string, kind string, status string, reason string, valid_ratio double, domain_codes array<string>, domain_ids array<int>, levels array<int>, invalid_examples array<string>"


def _level(g: Column) -> Column:
    level = codec.gid_level(g)
    return F.when(level >= LEAST_LENGTH, level)


def _examples(df: DataFrame, bad: list[tuple[str, Column, Column]]) -> dict[str, list[str]]:
    """The first invalid values of each column in the order of the input, all in one job.

    A task keeps at most EXAMPLES rows for each column; the least row numbers of them win.
    """
    if not bad:
        return {}
    wanted = len(bad)
    rows = df.select(F.monotonically_increasing_id().alias("at"), *(F.when(wrong, value.cast("string")).alias(f"v{k}") for k, (_, wrong, value) in enumerate(bad)))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, out = [EXAMPLES] * wanted, []
        for batch in batches:
            for k in range(wanted):
                values = batch.column(f"v{k}")
                for n in values.is_valid().to_numpy(zero_copy_only=False).nonzero()[0][: left[k]].tolist() if left[k] else ():
                    out.append((k, batch.column("at")[n].as_py(), values[n].as_py()))
                    left[k] -= 1
        kinds = (pa.int32(), pa.int64(), pa.string())
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)] or [pa.array([], t) for t in kinds], ["k", "at", "v"])

    found = rows.mapInArrow(first, "k int, at bigint, v string").groupBy("k").agg(F.slice(F.sort_array(F.collect_list(F.struct("at", "v"))), 1, EXAMPLES)["v"].alias("v"))
    return {bad[r["k"]][0]: list(r["v"]) for r in found.collect()}


def _readings(df: DataFrame, domain: str | None, level: int | None, scheme: str) -> list[dict]:
    """How each column (or the pair of index columns) could be read: column, kind, value, ok and what it names."""
    kinds, lower = dict(df.dtypes), {c.lower(): c for c in df.columns}
    pair = [lower.get(c) for c in ("x_idx", "y_idx")]
    pair = pair if all(c and kinds[c] == "bigint" for c in pair) else []
    out = []
    for c in (c for c in df.columns if c not in pair):
        v = F.col(f"`{c}`")
        if kinds[c] == "string":
            uri = codec.parse_uri(v, scheme)
            named = _level(uri["gid"]).isNotNull() & (F.lit(True) if domain is None else uri["domain"] == domain)
            out.append({"column": c, "kind": "uri", "value": v, "ok": named, "marks": v.startswith(f"{scheme}:v2:"), "domains": uri["domain"], "levels": _level(uri["gid"])})
            out.append({"column": c, "kind": "gid", "value": v, "ok": _level(v).isNotNull(), "marks": v.rlike("^[0-9]+$"), "levels": _level(v)})
        elif kinds[c] == "bigint":
            p = codec.unpack_any(v)
            out.append({"column": c, "kind": "packed_id", "value": v, "ok": p.isNotNull(), "marks": _level(v.cast("string")).isNotNull(), "ids": p["domain_id"], "levels": p["level"]})
        else:
            out.append({"column": c, "kind": "none", "value": v, "ok": F.lit(False), "marks": F.lit(False)})
    if pair:
        x, y = (F.col(f"`{c}`") for c in pair)
        n = cell_count(level) if level is not None else 0
        inside = F.coalesce(x.between(0, n - 1) & y.between(0, n - 1), F.lit(False))
        shown = F.concat(F.lit("("), F.coalesce(x.cast("string"), F.lit("None")), F.lit(", "), F.coalesce(y.cast("string"), F.lit("None")), F.lit(")"))
        out.append({"column": "+".join(pair), "kind": "xy_indices", "value": shown, "ok": inside, "marks": F.lit(False)})
    return out


#: What is said of a reading, by the first rule that holds: (status, reason, question of the statistics and the hints).
#: `every` and `any` say whether all or some of the values bear the reading's mark: digits alone, for a gid; for a packed id,
#: text that would be a gid.
RULES = (
    ("rejected", "the column has no values", lambda s, h: not s["n"] and s["kind"] != "xy_indices"),
    ("rejected", "this type holds no cell keys", lambda s, h: s["kind"] == "none"),
    ("needs_level", "cell indices say nothing without a level", lambda s, h: s["kind"] == "xy_indices" and h["level"] is None),
    ("rejected", "these integers read as gids: give them as text", lambda s, h: s["kind"] == "packed_id" and s["every"]),
    ("rejected", "too few values are valid", lambda s, h: s["ratio"] < LEAST_RATIO),
    ("needs_domain", "the values are valid in any domain", lambda s, h: s["kind"] in ("gid", "xy_indices") and h["domain"] is None),
    ("needs_confirmation", "the values are valid, but so would be other codes of digits", lambda s, h: s["kind"] == "gid" and s["every"]),
    ("certain", "the values are valid", lambda s, h: True),
)
#: Statuses that keep what the values name.
_KEEPS = ("certain", "needs_domain", "needs_confirmation")


def detect(df: DataFrame, domain: str | None = None, level: int | None = None, scheme: str = codec.URI_SCHEME) -> list[tuple]:
    """A result (in the order of RESULT) for each column, and one for an x_idx, y_idx pair of longs."""
    readings, hints = _readings(df, domain, level, scheme), {"domain": domain, "level": level}
    wanted = []
    for k, r in enumerate(readings):
        present = r["value"].isNotNull()
        good = present & F.coalesce(r["ok"], F.lit(False))
        sets = [F.sort_array(F.collect_set(F.when(good, r[s]))).alias(s) for s in ("domains", "ids", "levels") if s in r]
        # the mark of a gid is asked of valid values, those of other readings of all
        marked = F.when(good if r["kind"] == "gid" else present, F.coalesce(r["marks"], F.lit(False)))
        wanted.append(F.struct(F.count_if(present).alias("n"), F.count_if(good).alias("ok"), F.min(marked).alias("every"), F.max(marked).alias("any"), *sets).alias(f"r{k}"))
    got = df.agg(*wanted).first() if wanted else []
    results, bad = [], []
    for r, found in zip(readings, got):
        s = found.asDict() | {"kind": r["kind"], "ratio": found["ok"] / found["n"] if found["n"] else 0.0}
        status, reason = next((status, reason) for status, reason, holds in RULES if holds(s, hints))
        results.append((r, s, status, reason))
    uris = {r["column"] for r, s, _, _ in results if r["kind"] == "uri" and s["any"]}  # the other reading of a text column goes
    results = [x for x in results if x[0]["kind"] not in ("uri", "gid") or (x[0]["kind"] == "uri") == (x[0]["column"] in uris)]
    for r, s, status, _ in results:
        if 0 < s["n"] and s["ok"] < s["n"] and r["kind"] != "none" and not (r["kind"] == "packed_id" and s["every"]) and status != "needs_level":
            bad.append((r["column"], r["value"].isNotNull() & ~F.coalesce(r["ok"], F.lit(False)), r["value"]))
    shown, out = _examples(df, bad), []
    for r, s, status, reason in results:
        kind, keeps = r["kind"] if s["n"] or r["kind"] == "xy_indices" else "none", status in _KEEPS
        if r["kind"] == "packed_id" and s["every"]:
            kind = "gid"
        ratio = 0.0 if kind == "none" or status == "needs_level" or (r["kind"] == "packed_id" and s["every"]) else s["ratio"]
        own = [domain] if domain is not None and status != "needs_domain" and r["kind"] in ("gid", "xy_indices") else list(s.get("domains") or [])
        levels = [level] if r["kind"] == "xy_indices" and level is not None else list(s.get("levels") or [])
        show = lambda values: values if keeps else []  # noqa: B023, E731
        out.append((r["column"], kind, status, reason, ratio, show(own), show(list(s.get("ids") or [])), show(levels) if r["kind"] != "xy_indices" else levels, shown.get(r["column"], [])))
    return out


def detection(spark: SparkSession, df: DataFrame, **hints) -> DataFrame:
    return spark.createDataFrame(detect(df, **hints), RESULT)
