"""Cutting a DataFrame from its lineage by tables in the shared folder, and partitions by size."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows for which a partition is made at least.
PART = 1_000_000


def parts(spark: SparkSession, rows: int) -> int | None:
    """How many partitions so many rows need; None where spark.sql.shuffle.partitions is enough."""
    n = rows // PART + 1
    return n if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(df: DataFrame, rows: int, key: str) -> DataFrame:
    """`df` by its key, in partitions that don't grow with the table."""
    n = parts(df.sparkSession, rows)
    return df.repartition(key) if n is None else df.repartition(n, key)


def folder(spark: SparkSession) -> str:
    """The folder for checkpoints, in that of spark.checkpoint.dir; local sessions without one get a temporary folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(where or tempfile.mkdtemp(prefix="spark-shared-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in that folder: smaller than a checkpoint, and later steps read the columns that they need only."""
    path = f"{folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
