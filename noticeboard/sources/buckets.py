"""Tables in hash buckets of a key, changed by batches that read and write only the buckets they meet.

A batch's new buckets are written aside first, for all tables that it changes; then they take the old ones' place, by dynamic
partition overwrite, and the batch is marked as done. A batch that runs again is a no-op when it was done, and puts its
buckets in place once more when it stopped in between; so a lost driver leaves no half of a batch. Other buckets' files
aren't touched. A bucket that becomes empty keeps a row that says so and that no reader sees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class BucketStore:
    """Tables by name: (key columns, schema), in one folder that all machines share. n: buckets of each, for good."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, tuple[list[str], str]], n: int = 64):
        self.spark, self.root, self.n = spark, root.rstrip("/"), n
        self.keys = {name: key for name, (key, _) in tables.items()}
        self.schemas = {name: StructType.fromDDL(ddl) for name, (_, ddl) in tables.items()}

    def bucket(self, name: str) -> Column:
        return F.pmod(F.xxhash64(*self.keys[name]), F.lit(self.n)).cast("int")

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def _stored_schema(self, name: str) -> StructType:
        return StructType([*self.schemas[name].fields, *StructType.fromDDL("there boolean, bucket int").fields])

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """The table, or only some buckets of it: their numbers reach the scan as partition filters."""
        path = f"{self.root}/{name}"
        if not self._exists(path):
            return self.spark.createDataFrame([], self.schemas[name])
        df = self.spark.read.schema(self._stored_schema(name)).option("basePath", path).parquet(path)
        if buckets is not None:
            df = df.filter(F.col("bucket").isin(buckets))
        return df.filter("there").select(self.schemas[name].names)

    def met(self, name: str, keys: DataFrame) -> list[int]:
        """The buckets of keys; at most as many numbers as there are buckets reach the driver."""
        return sorted(r["bucket"] for r in keys.select(self.bucket(name).alias("bucket")).distinct().collect())

    def lookup(self, name: str, keys: DataFrame) -> DataFrame:
        """The rows of these keys, from their buckets alone. keys: a table or cheap, for it is read twice."""
        key = self.keys[name]
        return self.read(name, self.met(name, keys)).join(keys.select(*key).distinct(), key, "left_semi")

    def done(self, batch: int) -> bool:
        return self._exists(f"{self.root}/_batches/{batch}/done/_SUCCESS")

    def commit(self, batch: int, changes: dict[str, tuple[DataFrame | None, DataFrame | None]]) -> None:
        """changes: of each table the keys whose rows go, and the rows that come. Keys and rows should be tables, for they are read several times."""
        if not self.done(batch):
            aside = f"{self.root}/_batches/{batch}"
            if not self._exists(f"{aside}/written/_SUCCESS"):
                for name, (gone, rows) in changes.items():
                    self._write_aside(name, gone, rows, f"{aside}/{name}")
                self._mark(f"{aside}/written", list(changes))
            for r in self.spark.read.parquet(f"{aside}/written").collect():
                name = r["name"]
                df = self.spark.read.schema(self._stored_schema(name)).parquet(f"{aside}/{name}")
                df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.root}/{name}")
            self._mark(f"{aside}/done", list(changes))
            for name in changes:
                at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{aside}/{name}")
                at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def _mark(self, path: str, names: list[str]) -> None:
        self.spark.createDataFrame([(n,) for n in names], "name string").coalesce(1).write.mode("overwrite").parquet(path)

    def _write_aside(self, name: str, gone: DataFrame | None, rows: DataFrame | None, path: str) -> None:
        key, schema = self.keys[name], self.schemas[name]
        none = self.spark.createDataFrame([], schema)
        rows = none if rows is None else rows.select(schema.names)
        gone = none.select(key) if gone is None else gone.select(key)
        numbers = sorted({*self.met(name, rows), *self.met(name, gone)})
        kept = self.read(name, numbers).join(gone.distinct(), key, "left_anti")
        new = kept.unionByName(rows).withColumn("there", F.lit(True)).withColumn("bucket", self.bucket(name))
        empty = self.spark.createDataFrame([(i,) for i in numbers], "bucket int").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields], F.lit(False).alias("there"), "bucket")
        new.unionByName(empty).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
