"""Tables with a row for each cell and period."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from meshlark.errors import TimeCubeError
from meshlark.functions import codec, periods


def rollup(df: DataFrame, value: str, semantics: str, to: str, bucket_hours: int | None = None, declared: str | None = None, start: str = "start") -> DataFrame:
    """gid, period, value: periods (with their start as a timestamp) to coarser ones."""
    rule = periods.rollup_rule(semantics, declared)
    f = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}[rule]
    return df.groupBy("gid", periods.label_of(start, to, bucket_hours).alias("period")).agg(f(value).alias(value))


def _nests(fine: tuple[str, int | None], coarse: tuple[str, int | None]) -> bool:
    """Every period of the first kind lies in one of the second."""
    if fine[0] == coarse[0]:
        return fine[0] != "hour" or coarse[1] % fine[1] == 0
    return periods.PERIODS.index(fine[0]) > periods.PERIODS.index(coarse[0])


def period_join(left: DataFrame, right: DataFrame, left_type: tuple[str, int | None], right_type: tuple[str, int | None]) -> DataFrame:
    """Rows of one cell whose periods meet: gid, left_period, right_period, relation, and both sides' other columns.

    Where the periods of one side lie in those of the other, a row's own coarser period is the key, and nothing is
    exploded. Hours of unlike buckets that don't nest are keyed by their day, and pairs that don't meet are dropped.
    """
    named = lambda df, side: df.select(*(F.col(f"`{c}`").alias(c if c == "gid" else f"{side}_{c}") for c in df.columns))
    a = named(left, "left").withColumn("_left0", periods.start_of("left_period", *left_type)).filter("_left0 IS NOT NULL")
    b = named(right, "right").withColumn("_right0", periods.start_of("right_period", *right_type)).filter("_right0 IS NOT NULL")
    kept = [c for c in dict.fromkeys((*a.columns, *b.columns)) if not c.startswith("_")]
    if _nests(left_type, right_type):
        kind = "equal" if left_type == right_type else "contained"
        both = a.withColumn("_key", periods.floor_of("_left0", *right_type)).join(b.withColumnRenamed("_right0", "_key"), ["gid", "_key"])
        return both.select(*kept, F.lit(kind).alias("relation"))
    if _nests(right_type, left_type):
        both = a.withColumnRenamed("_left0", "_key").join(b.withColumn("_key", periods.floor_of("_right0", *left_type)), ["gid", "_key"])
        return both.select(*kept, F.lit("contains").alias("relation"))
    day = lambda c: F.date_trunc("day", c).alias("_key")
    both = a.select("*", day("_left0")).join(b.select("*", day("_right0")), ["gid", "_key"])
    hours = lambda c, n: F.col(c) + F.make_dt_interval(hours=F.lit(n))
    ends = both.withColumns({"_left1": hours("_left0", left_type[1]), "_right1": hours("_right0", right_type[1])})
    kind = periods.relation(F.col("_left0"), F.col("_left1"), F.col("_right0"), F.col("_right1")).alias("relation")
    return ends.filter((F.col("_left0") < F.col("_right1")) & (F.col("_right0") < F.col("_left1"))).select(*kept, kind)


RULES = ("gid", "level", "label", "range", "duplicate")


def violation_counts(df: DataFrame, level: int, period: str, period_start: str, period_end: str, bucket_hours: int | None = None) -> DataFrame:
    """One row: how many rows break each of RULES (duplicate: how many (gid, period) come again)."""
    bounds = [periods.start_of(F.lit(v), period, bucket_hours) for v in (period_start, period_end)]
    a, b = df.sparkSession.range(1).select(*bounds).first()
    if a is None or b is None or a >= b:
        raise TimeCubeError("period_start must be a label before period_end")
    low, high = (F.lit(v.isoformat(sep=" ")).cast("timestamp_ntz") for v in (a, b))
    start = periods.start_of("period", period, bucket_hours)
    return df.agg(
        F.count_if(codec.gid_level("gid").isNull()).alias("gid"),
        F.count_if(codec.gid_level("gid") != level).alias("level"),
        F.count_if(start.isNull()).alias("label"),
        F.count_if((start < low) | (start >= high)).alias("range"),
        (F.count(F.lit(1)) - F.count_distinct(F.struct("gid", "period"))).alias("duplicate"),
    )


def violations(df: DataFrame, level: int, period: str, period_start: str, period_end: str, bucket_hours: int | None = None) -> dict[str, int]:
    return violation_counts(df, level, period, period_start, period_end, bucket_hours).first().asDict()


def validate(df: DataFrame, **declared) -> None:
    bad = {k: n for k, n in violations(df, **declared).items() if n}
    if bad:
        raise TimeCubeError(f"rows break the time cube's contract: {bad}")
