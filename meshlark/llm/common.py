"""What the corpus operators share: the shared folder, written tables, and the shape of their input.

Every operator reads only the columns it names (`doc_id`, `text`, sometimes `source`), so further columns of any
name never clash with its own. A null text counts as empty. Rows that share a doc_id are told apart by their text.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Characters that separate words, in every operator here.
WORD = r"[^\x20\x09-\x0D]+"
_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset and all runs on one machine a
    folder of our own. On a cluster a machine-local folder would lose what executors write, so there it must be set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="meshlark-"))
    return _LOCAL[0]


def written(df: DataFrame) -> DataFrame:
    """The same rows, written as Parquet in the shared folder and read back: lineage is cut and survives lost executors.

    Tables lie in a folder of the application's name, which may go once the results that read them are written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table made by written() that no later step reads."""
    path = getattr(df, "_written_at", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


#: Keys with more rows than this share of all, and than LEAST_HOT, are hot: so there are at most HOT_KEYS of them.
HOT_KEYS, LEAST_HOT = 4096, 256


def hot_keys(counted: DataFrame, keys: list[str], total: int) -> DataFrame:
    """keys and `salts`, how many tasks should share the rows of a key, for keys of many rows. counted: keys and `n`, whose sum
    is `total` at most. At most HOT_KEYS rows whatever the input, which makes the table safe to broadcast."""
    bound = max(LEAST_HOT, total // HOT_KEYS)
    return written(counted.filter(F.col("n") > bound).select(*keys, F.ceil(F.col("n") / bound).cast("int").alias("salts")))


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], hot: DataFrame, row: list[str], hint: str | None = None) -> DataFrame:
    """many joined with `one`, which has one row a key at most. Rows of a hot key are dealt over several tasks by a hash of
    the columns `row`, and the one row that they meet goes to each of these tasks."""
    told = one if hint is None else one.hint(hint)
    if hot.isEmpty():
        return many.join(told, keys)
    salts = F.broadcast(hot)
    dealt = many.join(salts, keys, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(*row), F.col("salts")), F.lit(0)).cast("int")).drop("salts")
    copied = one.join(salts, keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1))).drop("salts")
    return dealt.join(copied if hint is None else copied.hint(hint), [*keys, "salt"]).drop("salt")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
