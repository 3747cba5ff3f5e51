"""Helpers shared by the operators of this subpackage."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; in local mode without that setting, a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    where = tempfile.mkdtemp(prefix="spark-shared-")
    spark.conf.set("spark.checkpoint.dir", where)
    return where


#: Removes a query's shuffle files when the query ends, not when the driver happens to collect its garbage. Another query
#: that ends meanwhile loses its files too; where its DataFrame is run again, Spark makes them again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write `df` to a table in the shared folder and read it back: later uses neither recompute it nor depend on
    the executors that made it. The shuffle files that it took are removed with it."""
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


class Tables:
    """The tables that one run of an operator writes. What the run's result still reads stays, since a DataFrame is read
    after the operator returns; the rest is dropped as soon as nothing reads it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.paths: dict[int, str] = {}
        self.held: list[DataFrame] = []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n}-{name}"
        table_ = materialize(df, name, path)
        self.paths[id(table_)] = path
        self.held.append(table_)
        return table_

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(t)))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
            self.held = [h for h in self.held if h is not t]


def values(column, step: int = 1024):
    """The values of an Arrow array as Python objects, a slice at a time: few of them are alive at once."""
    for i in range(0, len(column), step):
        yield from column.slice(i, step).to_pylist()


def fold(id_col, modulus: int):
    """crc32 of the id as text, modulo `modulus`: the split into training and held-out rows."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(col.cast("string")) % modulus


def scratch(df: DataFrame, stem: str) -> str:
    """A column name that `df` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = "_" + stem
    return stem
