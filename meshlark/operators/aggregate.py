"""Values to cells with explicit semantics.

Groups are the identity columns that the table has, null keys kept; every result has feature_count. Rules that the built-in
aggregates give run as one partial and one final aggregate; category rules take two such steps, so a category that most rows
share is counted before the shuffle. Weighted quantiles first add weights of equal values.

With strict_nan a null value counts as NaN, which spreads through sums; by default built-in null handling holds and the
divisor of a mean is the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from meshlark.errors import ContractError

KEYS = ("domain", "level", "x_idx", "y_idx")
NUMERIC_RULES = ("count", "sum", "weighted_sum", "mean", "weighted_mean", "median", "min", "max", "std", "quantile")
CATEGORY_RULES = ("largest_overlap", "majority_weighted", "centroid_category", "priority_order", "all_categories")
RANGE_RULES = ("full_range", "min", "max", "weighted_mean", "distribution")
SEMANTICS = ("COUNT", "TOTAL", "DENSITY", "MEASUREMENT", "RATE", "CATEGORICAL", "ORDINAL", "RANGE")


def group_keys(df: DataFrame, cell: str = "gid") -> list[str]:
    if cell not in df.columns:
        raise ContractError(f"no column {cell}")
    return [c for c in (*KEYS, cell, "uri") if c in df.columns]


def _weight(df: DataFrame, weight: str | None) -> Column:
    if weight is None:
        return F.lit(1.0)
    if weight not in df.columns:
        raise ContractError(f"no column {weight}")
    return F.col(weight).cast("double")


def _checked(df: DataFrame, keys: list[str], weight: str | None) -> DataFrame:
    """Negative weights fail the query where a row is read."""
    if weight is None:
        return df
    w = F.col(weight)
    return df.withColumn(weight, F.when(w < 0, F.raise_error(F.lit("weights can't be negative"))).otherwise(w))


def _some(total: Column, value: Column) -> Column:
    return F.when(total > 0, value).otherwise(F.raise_error(F.lit("a cell's weights are all zero")))


def numeric(df: DataFrame, value: str, rule: str, weight: str | None = None, cell: str = "gid", q: float = 0.5, output: str | None = None, strict_nan: bool = False) -> DataFrame:
    if rule not in NUMERIC_RULES:
        raise ContractError(f"no numeric rule {rule!r}")
    if not 0 <= q <= 1:
        raise ContractError("a quantile lies between 0 and 1")
    keys, name = group_keys(df, cell), output or value
    df = _checked(df, keys, weight)
    w, v = _weight(df, weight), F.col(value).cast("double")
    if strict_nan:
        v = F.coalesce(v, F.lit(float("nan")))
    n = F.count(F.lit(1))
    if rule in ("median", "quantile") and weight is not None:
        return _weighted_quantile(df, keys, value, weight, 0.5 if rule == "median" else q, name)
    plain = F.when(~F.isnan(v), v)
    results = {
        "count": n,
        "sum": F.sum(v),
        "weighted_sum": F.sum(v * w),
        "mean": F.sum(v) / n,
        "weighted_mean": F.sum(v * w) / F.nullif(F.sum(w), F.lit(0.0)),
        "median": F.percentile(plain, 0.5),
        "quantile": F.percentile(plain, q),
        "min": F.min(v),
        "max": F.max(v),
        "std": F.stddev_pop(plain),
    }
    out = df.groupBy(*keys).agg(results[rule].alias(name), n.alias("feature_count"), F.sum(w).alias("_w"))
    return (out if weight is None else out.withColumn(name, _some(F.col("_w"), F.col(name)))).drop("_w")


def _weighted_quantile(df: DataFrame, keys: list[str], value: str, weight: str, q: float, name: str) -> DataFrame:
    """The first value at which the running weight reaches q of the cell's weight."""
    v = F.col(value).cast("double")
    by_value = df.groupBy(*keys, v.alias("_v")).agg(F.sum(F.col(weight).cast("double")).alias("_w"), F.count(F.lit(1)).alias("_n"))
    cell = Window.partitionBy(*keys)
    running = F.sum("_w").over(cell.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = by_value.withColumn("_total", F.sum("_w").over(cell)).withColumn("_reached", running >= F.col("_total") * q)
    out = ranked.groupBy(*keys).agg(F.min(F.when(F.col("_reached"), F.col("_v"))).alias(name), F.sum("_n").alias("feature_count"), F.max("_total").alias("_t"))
    return out.withColumn(name, _some(F.col("_t"), F.col(name))).drop("_t")


def categorical(df: DataFrame, category: str, rule: str = "majority_weighted", weight: str | None = None, cell: str = "gid", priority: list[str] | None = None, output: str | None = None) -> DataFrame:
    """Ties go to the greatest category, but to the least under priority_order."""
    if rule not in CATEGORY_RULES:
        raise ContractError(f"no category rule {rule!r}")
    keys, name = group_keys(df, cell), output or category
    df = _checked(df, keys, weight)
    w = _weight(df, weight)
    scores = df.groupBy(*keys, F.col(category).alias("_c")).agg(F.sum(w).alias("_s"), F.count(F.lit(1)).alias("_n"))
    text, total, n = F.col("_c").cast("string"), F.sum("_s"), F.sum("_n").alias("feature_count")
    if rule == "all_categories":
        entries = F.sort_array(F.collect_list(F.struct(text.alias("k"), F.col("_s").alias("s"))))
        out = scores.groupBy(*keys).agg(entries.alias("_e"), total.alias("_t"), n)
        shares = F.map_from_entries(F.transform("_e", lambda e: F.struct(e["k"], e["s"] / F.col("_t"))))
        return out.select(*keys, _some(F.col("_t"), shares).alias(name) if weight else shares.alias(name), "feature_count")
    if rule == "priority_order":
        order = F.create_map(*(x for k, p in enumerate(priority or []) for x in (F.lit(p), F.lit(k)))) if priority else None
        rank = F.coalesce(F.try_element_at(order, text), F.lit(len(priority))) if priority else F.lit(0)
        best = F.min(F.struct(rank.alias("r"), (-F.col("_s")).alias("s"), text.alias("k"), F.col("_s").alias("own"))).alias("_b")
    else:
        score = F.col("_n").cast("double") if rule == "centroid_category" else F.col("_s")
        best = F.max(F.struct(score.alias("s"), text.alias("k"), F.col("_s").alias("own"))).alias("_b")
    out = scores.groupBy(*keys).agg(best, total.alias("_t"), n)
    share = F.col("_b.own") / F.nullif(F.col("_t"), F.lit(0.0))
    return out.select(*keys, (_some(F.col("_t"), F.col("_b.k")) if weight else F.col("_b.k")).alias(name), share.alias("category_share"), "feature_count")


def ordinal(df: DataFrame, value: str, priority: list[str], weight: str | None = None, cell: str = "gid", output: str | None = None) -> DataFrame:
    return categorical(df, value, "priority_order", weight, cell, priority, output)


def ranged(df: DataFrame, lower: str, upper: str, rule: str = "full_range", weight: str | None = None, cell: str = "gid", prefix: str = "range") -> DataFrame:
    """A row whose lower bound exceeds its upper fails the query."""
    if rule not in RANGE_RULES:
        raise ContractError(f"no range rule {rule!r}")
    keys = group_keys(df, cell)
    df = _checked(df, keys, weight)
    w = _weight(df, weight)
    lo, hi = F.col(lower).cast("double"), F.col(upper).cast("double")
    lo = F.when(lo > hi, F.raise_error(F.lit("a range's lower bound exceeds its upper"))).otherwise(lo)
    n = F.count(F.lit(1)).alias("feature_count")
    if rule == "weighted_mean":
        results = [(F.sum((lo + hi) / 2 * w) / F.nullif(F.sum(w), F.lit(0.0))).alias(f"{prefix}_value")]
    elif rule == "distribution":
        results = [F.sort_array(F.collect_list(F.struct(lo.alias("min"), hi.alias("max"), w.alias("weight")))).alias(f"{prefix}_distribution")]
    else:
        low, high = {"full_range": (F.min, F.max), "min": (F.min, F.min), "max": (F.max, F.max)}[rule]
        results = [low(lo).alias(f"{prefix}_min"), high(hi).alias(f"{prefix}_max")]
    out = df.groupBy(*keys).agg(*results, n, F.sum(w).alias("_w"))
    if weight is not None:
        first = next(c for c in out.columns if c.startswith(prefix))
        out = out.withColumn(first, _some(F.col("_w"), F.col(first)))
    return out.drop("_w")


def to_cells(df: DataFrame, value_type: str, value: str | None = None, lower: str | None = None, upper: str | None = None, rule: str | None = None, weight: str | None = None, cell: str = "gid", priority: list[str] | None = None, q: float = 0.5) -> DataFrame:
    """numeric (mean), categorical (majority_weighted), ordinal, or range (full_range) by default rules."""
    if value_type == "numeric":
        return numeric(df, value, rule or "mean", weight, cell, q)
    if value_type == "categorical":
        return categorical(df, value, rule or "majority_weighted", weight, cell, priority)
    if value_type == "ordinal":
        return ordinal(df, value, priority or [], weight, cell)
    if value_type == "range":
        return ranged(df, lower, upper, rule or "full_range", weight, cell)
    raise ContractError(f"no value type {value_type!r}")


def contribution_weight(coverage: str | None = "coverage_ratio", length: str | None = "length_ratio") -> Column:
    """The share by which a source counts in a cell: its coverage, else its length, else 1; both at once fail."""
    c, n = (F.col(x).cast("double") if x else F.lit(None).cast("double") for x in (coverage, length))
    both = F.when(c.isNotNull() & n.isNotNull(), F.raise_error(F.lit("a contribution has a coverage and a length")))
    w = F.coalesce(both.cast("double"), c, n, F.lit(1.0))
    return F.when(w.between(0, 1), w).otherwise(F.raise_error(F.lit("a contribution's share must lie in 0 to 1")))


def contributions(df: DataFrame, semantics: str, value: str | None = None, numerator: str | None = None, denominator: str | None = None, lower: str | None = None, upper: str | None = None, cell: str = "gid", output: str | None = None, category_rule: str = "majority_weighted", range_rule: str = "full_range", priority: list[str] | None = None, coverage: str | None = None, length: str | None = None) -> DataFrame:
    """Geometry contributions to cells: COUNT counts, TOTAL allots by share, DENSITY, MEASUREMENT and RATE weigh.

    RATE with numerator and denominator divides their allotted sums; a zero denominator fails the query.
    """
    if semantics not in SEMANTICS:
        raise ContractError(f"no semantics {semantics!r}")
    coverage = coverage or ("coverage_ratio" if "coverage_ratio" in df.columns else None)
    length = length or ("length_ratio" if "length_ratio" in df.columns else None)
    w = df.withColumn("_share", contribution_weight(coverage, length))
    keys, name = group_keys(df, cell), output or value or "value"
    if semantics == "COUNT":
        out = w.groupBy(*keys).agg(F.count(F.lit(1)).alias(name), F.count(F.lit(1)).alias("feature_count"))
    elif semantics == "TOTAL":
        out = numeric(w, value, "weighted_sum", "_share", cell, output=name)
    elif semantics == "RATE" and numerator:
        sums = w.groupBy(*keys).agg(F.sum(F.col(numerator) * F.col("_share")).alias("_a"), F.sum(F.col(denominator) * F.col("_share")).alias("_b"), F.count(F.lit(1)).alias("feature_count"))
        rate = F.when(F.col("_b") == 0, F.raise_error(F.lit("a cell's denominator is zero"))).otherwise(F.try_divide(F.col("_a"), F.col("_b")))
        out = sums.select(*keys, rate.alias(name), "feature_count")
    elif semantics in ("DENSITY", "MEASUREMENT", "RATE"):
        out = numeric(w, value, "weighted_mean", "_share", cell, output=name)
    elif semantics == "CATEGORICAL":
        out = categorical(w, value, category_rule, "_share", cell, None, name)
    elif semantics == "ORDINAL":
        out = ordinal(w, value, priority or [], "_share", cell, name)
    else:
        out = ranged(w, lower, upper, range_rule, "_share", cell)
    lineage = {"semantics": semantics, "allocation": "share", "source_column": value or numerator or lower or ""}
    first = next(c for c in out.columns if c not in (*KEYS, cell, "uri"))
    return out.withMetadata(first, {"lineage": lineage})


def rollup(cells: DataFrame, level: int, value: str, rule: str = "sum", gid: str = "gid") -> DataFrame:
    """Values of finer cells to their ancestors at a level."""
    if rule not in ("sum", "min", "max", "mean"):
        raise ContractError(f"no roll-up rule {rule!r}")
    f = {"sum": F.sum, "min": F.min, "max": F.max, "mean": F.avg}[rule]
    return cells.groupBy(F.substring(gid, 1, level).alias(gid)).agg(f(value).alias(value), F.count(F.lit(1)).alias("feature_count"))
