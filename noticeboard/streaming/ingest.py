"""Micro-batches: a file stream, each batch handled as a whole (K01, K13), and state per source as a folded table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from noticeboard.operators.tasks import latest_by


def file_stream(spark: SparkSession, location: str, schema, *, files_per_batch: int = 100, fmt: str = "parquet", glob: str = "*") -> DataFrame:
    """New files of a folder whose names match."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", glob).format(fmt).load(location)


def run(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, *, every: str | None = None) -> StreamingQuery:
    """Each batch goes to `handle` once; `every` (such as "2 hours") is a trigger, without it all there is now."""
    w = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


class Latest:
    """The last row of each key, as versions of a table: a batch reads the version before and writes its own.

    A batch that runs again writes the same version again. The newest version is found in the folder, so a query that
    is started anew goes on from it, and `table` needs no query. A version is whole when its folder has _SUCCESS; of
    older ones the last two stay, for readers that have just opened them.
    """

    def __init__(self, spark: SparkSession, root: str, by: str, at: str, key: str, schema=None):
        self.spark, self.root, self.by, self.at, self.key, self.schema = spark, root.rstrip("/"), by, at, key, schema

    def _folder(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        """Whole versions, in order."""
        fs, root = self._folder()
        if not fs.exists(root):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(root)]
        numbers = sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())
        return [n for n in numbers if fs.exists(self._folder(f"/v={n}/_SUCCESS")[1])]

    def __call__(self, batch: DataFrame, n: int) -> None:
        older = [v for v in self.versions() if v < n]
        spark = batch.sparkSession
        rows = batch.unionByName(spark.read.schema(batch.schema).parquet(f"{self.root}/v={older[-1]}")) if older else batch
        latest_by(rows, self.by, self.at, self.key).write.mode("overwrite").parquet(f"{self.root}/v={n}")
        for v in older[:-2]:
            fs, path = self._folder(f"/v={v}")
            fs.delete(path, True)

    @property
    def version(self) -> int | None:
        return (self.versions() or [None])[-1]

    def table(self) -> DataFrame:
        """The newest version; without any, no rows (in the given schema)."""
        n = self.version
        if n is None:
            if self.schema is None:
                raise ValueError("there is no version yet, and no schema was given")
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.parquet(f"{self.root}/v={n}")


def touched(batch: DataFrame, posts: DataFrame, refresh: Callable[[DataFrame, DataFrame], DataFrame], key: str = "canonical_url") -> DataFrame:
    """The ids that a batch's rows have in posts drive an incremental refresh (entities.refreshed)."""
    keys = batch.select(F.col(key).alias("_k")).distinct()
    return refresh(posts, posts.join(keys, posts[key] == keys["_k"], "left_semi").select("id"))


def latest_by_stream(spark: SparkSession, landed: str, state: str) -> DataFrame:
    """events that land as files of a folder, folded to the last event of each user."""
    schema = spark.read.parquet(landed).schema
    folded = Latest(spark, f"{state}/table", "user_id", "ts", "event_id", schema)
    run(file_stream(spark, landed, schema, files_per_batch=2, glob="*.parquet"), folded, f"{state}/checkpoint").awaitTermination()
    return folded.table()
