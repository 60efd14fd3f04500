"""Pages far down a list (O01-O03): posts kept in ranges of (publish_date, id), with counts by range.

A page by its number adds up the ranges' counts to find which ranges hold it, and reads these alone; a page after a key
reads the key's range and as many below as the limit needs. The total is the counts' sum. Batches of new, changed and
deleted posts read and write only the ranges that they meet (see BucketStore). Order: newest first, posts without a date
last, ties by greater id, as `listing.page` has it; ids are unique and not null.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeboard.sources.buckets import BucketStore
from noticeboard.sources.tables import stored

UNDATED = -(2**31)
KEY = ["_day", "id"]


def keyed(df: DataFrame) -> DataFrame:
    """With `_day`: days since 1970, and the least integer where there is no date, so that a key is never null."""
    return df.withColumn("_day", F.coalesce(F.unix_date("publish_date"), F.lit(UNDATED)))


def _below(day: int, key: int) -> Column:
    return (F.col("_day") < day) | ((F.col("_day") == day) & (F.col("id") < key))


class _Ranges(BucketStore):
    """Buckets are ranges of the key: number i holds keys from bounds[i - 1] up to before bounds[i]."""

    def __init__(self, spark: SparkSession, root: str, tables: dict, bounds: list[tuple[int, int]]):
        super().__init__(spark, root, tables, len(bounds) + 1)
        self.bounds = bounds

    def bucket(self, name: str) -> Column:
        return F.col("range") if name == "counts" else self._within(0, len(self.bounds))

    def _within(self, low: int, high: int) -> Column:
        """By halving, so that a row is compared with few bounds."""
        if low == high:
            return F.lit(low)
        at = (low + high) // 2
        return F.when(_below(*self.bounds[at]), self._within(low, at)).otherwise(self._within(at + 1, high))

    def number(self, day: int, key: int) -> int:
        return sum(b <= (day, key) for b in self.bounds)


class KeysetPages:
    """columns: DDL of the posts' columns, with id bigint and publish_date date. ranges: how many to make of the first table, of about as
    many rows each. A page reads one or two of them, so their size bounds its cost; a table that has grown is built anew with more."""

    def __init__(self, spark: SparkSession, root: str, columns: str, ranges: int = 64):
        self.spark, self.root, self.ranges = spark, root.rstrip("/"), ranges
        self.tables = {"posts": (KEY, f"{columns}, _day int"), "counts": (["range"], "range int, n bigint")}
        self._store: _Ranges | None = None

    @property
    def store(self) -> _Ranges:
        if self._store is None:
            rows = self.spark.read.parquet(f"{self.root}/bounds").collect()  # fewer than ranges
            self._store = _Ranges(self.spark, self.root, self.tables, sorted((r["_day"], r["id"]) for r in rows))
        return self._store

    def build(self, posts: DataFrame) -> None:
        """The first table, as batch 0. Spark's range partitioning finds the bounds: a partition's keys are a range."""
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/bounds/_SUCCESS")
        if not done.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            keys = keyed(posts).select(KEY).repartitionByRange(self.ranges, *KEY)
            first = keys.groupBy(F.spark_partition_id()).agg(F.min(F.struct(*KEY)).alias("k")).select("k.*")
            bounds = sorted((r["_day"], r["id"]) for r in first.collect())[1:]  # fewer than `ranges`
            self.spark.createDataFrame(bounds, "_day int, id bigint").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/bounds")
        self.apply(0, posts)

    def apply(self, batch: int, posts: DataFrame | None = None, gone: DataFrame | None = None) -> None:
        """posts: new ones, and changed ones as they are now. gone: publish_date and id, as stored, of deleted posts and of changed ones whose date has moved."""
        store = self.store
        if store.done(batch):
            return
        schema = store.schemas["posts"]
        new = stored(self.spark.createDataFrame([], schema) if posts is None else keyed(posts).select(schema.names), "posts")
        keys = new.select(KEY)
        keys = stored((keys if gone is None else keys.unionByName(keyed(gone).select(KEY))).distinct(), "keys")
        by = store.bucket("posts").alias("range")
        less = store.lookup("posts", keys).groupBy(by).agg((-F.count("*")).alias("n"))
        moved = stored(less.unionByName(new.groupBy(by).agg(F.count("*").alias("n"))), "moved")
        counts = stored(store.lookup("counts", moved).unionByName(moved).groupBy("range").agg(F.sum("n").alias("n")), "counts")
        store.commit(batch, {"posts": (keys, new), "counts": (counts.select("range"), counts)})

    def counts(self) -> list[int]:
        """How many posts each range holds, the newest range last; a number for each range reaches the driver."""
        by = {r["range"]: r["n"] for r in self.store.read("counts").collect()}
        return [by.get(i, 0) for i in range(self.store.n)]

    def total(self) -> int:
        return sum(self.counts())

    def _newest(self, numbers: list[int], skip: int, limit: int) -> DataFrame:
        return self.store.read("posts", numbers).orderBy(F.desc("_day"), F.desc("id")).offset(skip).limit(limit)

    def page(self, skip: int = 0, limit: int = 20) -> DataFrame:
        """The posts from number `skip` on, of the whole list."""
        numbers, before, start = [], 0, None
        for i, n in reversed(list(enumerate(self.counts()))):
            if n and before < skip + limit and before + n > skip:
                start = before if start is None else start
                numbers.append(i)
            before += n
        return self._newest(numbers, skip - (start or 0), limit).drop("_day")

    def after(self, publish_date: dt.date | None, key: int, limit: int = 20, where: Column | None = None) -> DataFrame:
        """The posts that follow this key in the list (it need not exist any more), of those that meet `where`.

        Without a condition the counts tell which ranges suffice. With one, the ranges are read downwards, each time twice as many,
        until the page is full; what was read before isn't read again.
        """
        day = UNDATED if publish_date is None else (publish_date - dt.date(1970, 1, 1)).days
        counts, at = self.counts(), self.store.number(day, key)
        if where is None:
            low, have = at, 0
            while low > 0 and have < limit:
                low -= 1
                have += counts[low]
            return self._page_below(list(range(low, at + 1)), day, key, limit, F.lit(True)).drop("_day")
        out, found, high, step = None, 0, at, 1
        while high >= 0 and found < limit:
            low = max(0, high - step + 1)
            part = stored(self._page_below(list(range(low, high + 1)), day, key, limit - found, where), "page")
            out = part if out is None else out.unionByName(part)
            found, high, step = found + part.count(), low - 1, step * 2
        return out.orderBy(F.desc("_day"), F.desc("id")).drop("_day")

    def _page_below(self, numbers: list[int], day: int, key: int, limit: int, where: Column) -> DataFrame:
        return self.store.read("posts", numbers).filter(_below(day, key) & where).orderBy(F.desc("_day"), F.desc("id")).limit(limit)
