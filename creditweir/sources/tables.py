"""Tables as folders of Parquet versions below one root.

A write goes to a new version folder and counts once Spark has committed it
(``_SUCCESS``), so readers never see half a table and a job never overwrites
what it reads. Append-only tables are plain partitioned folders.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditweir import schemas
from creditweir.operators.upsert import insert_if_absent, upsert
from creditweir.session import cut, small_table


class TableNotFoundError(LookupError):
    """No committed version of a table exists."""


class Tables:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _versions(self, name: str) -> list:
        """Committed version numbers, through the cluster's own file system."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path(name))
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        found = []
        for status in fs.listStatus(folder):
            child = status.getPath()
            done = jvm.org.apache.hadoop.fs.Path(child, "_SUCCESS")
            if child.getName().startswith("v=") and fs.exists(done):
                found.append(int(child.getName()[2:]))
        return sorted(found)

    def exists(self, name: str) -> bool:
        return bool(self._versions(name))

    def read(self, name: str, schema: T.StructType = None) -> DataFrame:
        versions = self._versions(name)
        if not versions:
            if schema is not None:
                return small_table(self.spark, [], schema)
            raise TableNotFoundError(f"no table {name} below {self.root}")
        return self._scan(f"{self.path(name)}/v={versions[-1]}", schema)

    def _scan(self, path: str, schema: T.StructType = None) -> DataFrame:
        """Files with the declared types, which partition columns need."""
        if schema is None:
            return self.spark.read.parquet(path)
        nullable = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
        return self.spark.read.schema(nullable).parquet(path).select(*schema.fieldNames())

    def replace(self, name: str, df: DataFrame, schema: T.StructType, partition_by: tuple = ()) -> None:
        """Write a new version; the old one stays readable for running jobs."""
        number = (self._versions(name) or [0])[-1] + 1
        writer = schemas.conform(df, schema).write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(f"{self.path(name)}/v={number}")

    def upsert(self, name: str, staged: DataFrame, keys: list, schema: T.StructType, keep: tuple = ()) -> None:
        staged = schemas.conform(staged, schema)
        target = self.read(name, schema)
        self.replace(name, upsert(target, staged, keys, keep), schema)

    def seed(self, name: str, staged: DataFrame, keys: list, schema: T.StructType) -> None:
        staged = schemas.conform(staged, schema)
        self.replace(name, insert_if_absent(self.read(name, schema), staged, keys), schema)

    # Append-only and date-partitioned tables: one folder, no versions.

    def append(self, name: str, df: DataFrame, schema: T.StructType, partition_by: tuple = ()) -> None:
        writer = schemas.conform(df, schema).write.mode("append")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.path(name))

    def read_appended(self, name: str, schema: T.StructType) -> DataFrame:
        """An append-only table; empty before the first append."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path(name))
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return small_table(self.spark, [], schema)
        return self._scan(self.path(name), schema)

    def upsert_partitions(self, name: str, staged: DataFrame, keys: list, schema: T.StructType,
                          partition: str) -> None:
        """Upsert that rewrites only the partitions named by the staged rows.

        ``partition`` is one of ``keys``, so a key never moves between
        partitions. The merged rows are written aside first; the touched
        partitions are then replaced from there.
        """
        staged = cut(schemas.conform(staged, schema))
        touched = [r[0] for r in staged.select(partition).distinct().collect()]
        if not touched:
            return
        current = self.read_appended(name, schema).filter(F.col(partition).isin(touched))
        merged = cut(upsert(current, staged, keys))
        (
            merged.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(partition)
            .parquet(self.path(name))
        )
