"""Tables by file format: csv, txt, parquet, pq; Excel only where its reader is installed."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from meshlark.errors import ContractError, DependencyError

#: Excel sheets hold no more rows; they are made on the driver, so a larger table is refused.
EXCEL_ROWS = 1_048_575
FORMATS = {"csv": "csv", "txt": "csv", "parquet": "parquet", "pq": "parquet", "xlsx": "excel", "xls": "excel"}


def _format(name: str, given: str | None) -> str:
    suffix = (given or name.rstrip("/").rpartition(".")[2]).lower()
    if suffix not in FORMATS:
        raise ContractError(f"no table format {suffix!r}")
    return FORMATS[suffix]


def read_table(spark: SparkSession, source, input_format: str | None = None, **options) -> DataFrame:
    """A path, a Spark or a pandas DataFrame. A csv's types are inferred unless a schema is given."""
    if isinstance(source, DataFrame):
        return source
    if not isinstance(source, str):
        return spark.createDataFrame(source)
    kind = _format(source, input_format)
    if kind == "csv":
        schema = options.pop("schema", None)
        reader = spark.read.options(header=True, **options)
        return reader.schema(schema).csv(source) if schema else reader.option("inferSchema", True).csv(source)
    if kind == "parquet":
        return spark.read.options(**options).parquet(source)
    import pandas as pd

    try:
        return spark.createDataFrame(pd.read_excel(source, **options))
    except ImportError as e:
        raise DependencyError("reading Excel needs openpyxl") from e


def write_table(df: DataFrame, destination: str, output_format: str | None = None, mode: str = "errorifexists", **options) -> None:
    kind = _format(destination, output_format)
    writer = df.write.mode(mode).options(**options)
    if kind == "csv":
        writer.option("header", True).csv(destination)
    elif kind == "parquet":
        writer.parquet(destination)
    else:
        rows = df.limit(EXCEL_ROWS + 1)
        if rows.count() > EXCEL_ROWS:
            raise ContractError(f"an Excel sheet holds at most {EXCEL_ROWS} rows")
        try:
            rows.toPandas().to_excel(destination, index=False)
        except ImportError as e:
            raise DependencyError("writing Excel needs openpyxl") from e


def read_chunks(spark: SparkSession, source, rows: int = 100_000, **options) -> Iterator[DataFrame]:
    """For callers that want pieces: one DataFrame for each group of partitions of about `rows` rows."""
    from pyspark.sql import functions as F

    df = read_table(spark, source, **options)
    pieces = max(1, -(-df.count() // rows))
    parts = max(1, df.rdd.getNumPartitions()) if pieces > 1 else 1
    spread = df.repartition(pieces) if parts < pieces else df
    for k in range(pieces):
        yield df if pieces == 1 else spread.filter(F.spark_partition_id() % pieces == k)
