"""Cells of a stream of points: stateless encoding, then tumbling windows with a watermark, appended to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from meshlark.operators.encode import encode_projected
from meshlark.sources.datasets import temporary


def windowed_cells(points: DataFrame, x: str, y: str, ts: str, domain: str, level: int, hours: int = 4, late: str = "1 day") -> DataFrame:
    """gid, start, n of a stream with a watermark; rows later than `late` are dropped by Spark."""
    cells = encode_projected(points.withWatermark(ts, late), x, y, domain, level, keep=[ts])
    counts = cells.groupBy("gid", F.window(ts, f"{hours} hours")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("gid", F.col("window.start").alias("start"), "n")


def write_cells(points: DataFrame, path: str, checkpoint: str, x: str, y: str, domain: str, level: int):
    """A query that appends encoded points to a Parquet folder, exactly once, as files arrive."""
    return encode_projected(points, x, y, domain, level).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_windows(points: DataFrame, path: str, checkpoint: str, x: str, y: str, ts: str, domain: str, level: int, hours: int = 4, late: str = "1 day"):
    """A query that appends each window to a Parquet folder once the watermark has passed it; state holds open windows only."""
    out = windowed_cells(points, x, y, ts, domain, level, hours, late)
    return out.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay(spark: SparkSession, path: str, key: str, level: int, late: str = "1 day") -> DataFrame:
    """All of an events file through the windowed stream, and the windows that it wrote.

    A second file with one row far ahead of all others, which lies in no cell, moves the watermark past the last window.
    """
    folder = temporary(spark, "stream")
    x, y = ((F.col(key) * 37) % 8000 - 4000.5).cast("double"), ((F.col(key) * 53 + F.col("user_id")) % 8000 - 4000.5).cast("double")
    placed = spark.read.parquet(path).select(F.col("ts").cast("timestamp").alias("ts"), x.alias("x_m"), y.alias("y_m"))
    nowhere = F.lit(None).cast("double")
    ahead = placed.agg((F.max("ts") + F.expr("INTERVAL 100 DAYS")).alias("ts"), nowhere.alias("x_m"), nowhere.alias("y_m"))
    for name, rows in (("events", placed), ("ahead", ahead)):
        rows.write.parquet(f"{folder}/in/{name}")
        points = spark.readStream.schema(placed.schema).option("recursiveFileLookup", True).parquet(f"{folder}/in")
        write_windows(points, f"{folder}/out", f"{folder}/checkpoint", "x_m", "y_m", "ts", "ID", level, late=late).awaitTermination()
    found = spark.read.schema("gid string, start timestamp, n bigint").parquet(f"{folder}/out")
    return found.filter("gid IS NOT NULL").withColumn("start", F.col("start").cast("timestamp_ntz"))
