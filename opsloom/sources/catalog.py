"""One place that turns a logical table name into a DataFrame."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from opsloom.sources import adapters
from opsloom.sources.shared import parts


class Catalog:
    """Tables of one store: Parquet files of a folder, adapter views over them, or tables behind JDBC.

    With `jdbc_url`, names that are neither files nor views are read from that database, with filters pushed down.
    """

    def __init__(self, spark: SparkSession, root: str, jdbc_url: str | None = None, **jdbc_options: str):
        self.spark, self.root, self.jdbc_url, self.jdbc_options = spark, root, jdbc_url, jdbc_options
        self.rows: dict[str, int] = {}

    def table(self, name: str) -> DataFrame:
        if name in adapters.VIEWS:
            base = adapters.numbered(name)
            if base and base not in self.rows:
                self.rows[base] = self.spark.read.parquet(f"{self.root}/{base}.parquet").count()  # from the files' footers
            return self.spark.sql(adapters.spark_view(name, self.root, parts(self.spark, self.rows[base]) if base else None))
        if self.jdbc_url:
            return self.spark.read.format("jdbc").options(url=self.jdbc_url, dbtable=name, **self.jdbc_options).load()
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)

    def append(self, df: DataFrame, name: str) -> None:
        """The sink of logs, metrics, errors and messages: rows are only ever added."""
        df.write.mode("append").parquet(f"{self.root}/{name}.parquet")

    def overwrite(self, df: DataFrame, name: str) -> None:
        """Replaces a table by `df`, which may read the table itself. The new files are complete in a folder beside the table
        before the old ones go; a write that fails leaves the table as it was. The two folders change names one after the
        other: a reader that comes between them finds no table, and after a crash there the old one lies in the `.old` folder."""
        path, mark = f"{self.root}/{name}.parquet", uuid.uuid4().hex
        fresh, old = f"{path}.new-{mark}", f"{path}.old-{mark}"
        try:
            df.write.parquet(fresh)
        except Exception:
            self.delete(fresh)
            raise
        if self.exists(path):
            self.rename(path, old)
        self.rename(fresh, path)
        self.delete(old)

    def read(self, name: str, schema: str | StructType) -> DataFrame:
        """A table whose files may be older than `schema`: columns that a file doesn't have are null in its rows, columns that
        the schema doesn't have are left out, and files may differ in this."""
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}.parquet")

    def _file(self, path: str):
        file = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return file.getFileSystem(self.spark._jsc.hadoopConfiguration()), file

    def exists(self, path: str) -> bool:
        system, file = self._file(path)
        return system.exists(file)

    def rename(self, path: str, to: str) -> None:
        system, file = self._file(path)
        if not system.rename(file, self._file(to)[1]):
            raise OSError(f"{path} couldn't be renamed to {to}")

    def delete(self, path: str) -> None:
        system, file = self._file(path)
        system.delete(file, True)
