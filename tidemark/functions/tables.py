"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; set here only where it is unset, on a local master."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return context.getCheckpointDir().get().rstrip("/")


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: several branches read it, plans stay short, and nothing is lost
    with an executor."""
    path = _place(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def bucketed(df: DataFrame, name: str, *keys: str, dealt: bool = False) -> DataFrame:
    """df written to the shared folder in buckets of its keys. Joins and groups by those keys (and more) read it as it lies,
    without an exchange, also after rows were exploded or looked up in broadcast tables. `dealt` says that df comes from
    such tables itself and needs no exchange before it is written."""
    spark = df.sparkSession
    path, n = _place(spark, name), int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = "tidemark_" + path.rpartition("/")[2].replace("-", "_")
    (df if dealt else df.repartition(n, *keys)).write.bucketBy(n, *keys).option("path", path).format("parquet").saveAsTable(table)
    out = spark.table(table)
    out.saved_at, out.saved_as = path, table
    return out


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df, a saved table, dealt by its keys to a task for so many rows, and to all cores at least: for columns whose cost follows
    the rows, which small files hold many of."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // rows)), *keys)


def forget(*tables: DataFrame) -> None:
    """Deletes tables of `saved` or `bucketed` that nothing will read any more."""
    for df in tables:
        spark = df.sparkSession
        if hasattr(df, "saved_as"):
            spark.sql(f"DROP TABLE IF EXISTS {df.saved_as}")
        path = spark._jvm.org.apache.hadoop.fs.Path(df.saved_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by its keys to all cores if its files are fewer splits than that, as is a small file of one row group: costly
    columns would otherwise be worked out by one task. Larger tables stay as they lie and are not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df
