"""Summaries that merge (A01, A12, A13): partial results of each day, kept up to date by batches, put together for any range of days.

A summary of a range reads the partials of its days instead of all rows. Counts and sums add up and latest values take
the greatest; distinct ids are kept as bitmaps (a row for each day, group and block of 32,768 ids that has one), which are
or-ed over days and then counted, so an id of several days counts once and the count is exact. Partials lie in hash
buckets of their day: a batch reads and writes the buckets of its days only, a short range reads only those of its days.

`add` takes rows that come once each (a log, new posts), late days too. Where rows change or go, `refresh` makes the
partials of the days they touch anew from the table. Rows without a day belong to no range and are left out; a null
group is a group of its own; a null measure adds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeboard.sources.buckets import BucketStore
from noticeboard.sources.tables import stored


class DailySummary:
    """day: the expression of a row's day. groups: columns (text) to summarise by. The measures, name -> expression over a row:
    counts (a condition), sums and latest (with the type of the result), distinct (an integer id)."""

    def __init__(self, spark: SparkSession, root: str, day: Column, groups: tuple[str, ...] = (), *, counts: dict[str, Column] | None = None, sums: dict[str, tuple[Column, str]] | None = None, latest: dict[str, tuple[Column, str]] | None = None, distinct: dict[str, Column] | None = None, buckets: int = 64):
        self.spark, self.day, self.groups = spark, day, groups
        self.counts, self.sums, self.latest, self.distinct = counts or {}, sums or {}, latest or {}, distinct or {}
        self.types = {"n": "bigint", **{k: "bigint" for k in self.counts}, **{k: t for k, (_, t) in {**self.sums, **self.latest}.items()}}
        by = "".join(f", `{g}` string" for g in groups)
        tables = {
            "measures": (["day"], f"day date{by}, " + ", ".join(f"`{k}` {t}" for k, t in self.types.items())),
            "ids": (["day"], f"day date{by}, measure string, block bigint, bits binary"),
        }
        self.store = BucketStore(spark, root, tables, buckets)

    def _merged(self, df: DataFrame, by: list[str]) -> DataFrame:
        """Measures of several partials as one."""
        return df.groupBy(*by).agg(*[(F.max(k) if k in self.latest else F.sum(k)).cast(t).alias(k) for k, t in self.types.items()])

    def _merged_ids(self, df: DataFrame, by: list[str]) -> DataFrame:
        return df.groupBy(*by, "measure", "block").agg(F.bitmap_or_agg("bits").alias("bits"))

    def _partials(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        by = ["day", *self.groups]
        taken = rows.select(self.day.cast("date").alias("day"), *[F.col(g).cast("string").alias(g) for g in self.groups], F.lit(1).cast("bigint").alias("n"), *[F.when(c, 1).otherwise(0).cast("bigint").alias(k) for k, c in self.counts.items()], *[c.cast(t).alias(k) for k, (c, t) in {**self.sums, **self.latest}.items()], *[c.cast("bigint").alias(f"_{k}") for k, c in self.distinct.items()]).filter("day is not null")
        measures = self._merged(taken, by)
        if not self.distinct:
            return measures, self.spark.createDataFrame([], self.store.schemas["ids"])
        named = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.col(f"_{k}").alias("id")) for k in self.distinct]))
        ids = taken.select(*by, named.alias("m")).select(*by, "m.*").filter("id is not null")
        ids = ids.groupBy(*by, "measure", F.bitmap_bucket_number("id").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))
        return measures, ids

    def _commit(self, batch: int, days: DataFrame, measures: DataFrame, ids: DataFrame) -> None:
        self.store.commit(batch, {"measures": (days, stored(measures, "measures")), "ids": (days, stored(ids, "ids"))})

    def add(self, batch: int, rows: DataFrame) -> None:
        """New rows, of any day. A batch that runs again changes nothing."""
        if self.store.done(batch):
            return
        measures, ids = self._partials(rows)
        measures = stored(measures, "new-measures")
        days = stored(measures.select("day").distinct(), "days")
        by = ["day", *self.groups]
        self._commit(batch, days, self._merged(self.store.lookup("measures", days).unionByName(measures), by), self._merged_ids(self.store.lookup("ids", days).unionByName(ids), by))

    def refresh(self, batch: int, days: DataFrame, rows: DataFrame) -> None:
        """The partials of these days (column day) anew from the table's rows, after changes and deletions. A table in folders by day is read for these days only."""
        if self.store.done(batch):
            return
        days = stored(days.select(F.col("day").cast("date").alias("day")).filter("day is not null").distinct(), "days")
        theirs = rows.withColumn("_day", self.day.cast("date")).join(days.withColumnRenamed("day", "_day"), "_day", "left_semi")
        self._commit(batch, days, *self._partials(theirs))

    def summary(self, first: str, last: str, by: tuple[str, ...] = ()) -> DataFrame:
        """One row (n = 0 where no row is in range), or one for each group: the measures over all days from first to last."""
        days = self.spark.range(1).select(F.explode(F.when(F.lit(first) <= F.lit(last), F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last))))).alias("day"))
        numbers = self.store.met("measures", days)
        within = F.col("day").between(F.to_date(F.lit(first)), F.to_date(F.lit(last)))
        measures = self._merged(self.store.read("measures", numbers).filter(within), list(by))
        blocks = self._merged_ids(self.store.read("ids", numbers).filter(within), list(by))
        ids = blocks.groupBy(*by).agg(*[F.sum(F.when(F.col("measure") == k, F.bitmap_count("bits"))).alias(k) for k in self.distinct]) if self.distinct else None
        both = measures if ids is None else measures.unionByName(ids, allowMissingColumns=True)
        zero = lambda k: F.coalesce(F.max(k), F.lit(0)).alias(k)  # noqa: E731  one of the two has a value
        return both.groupBy(*by).agg(*[zero(k) if k == "n" or k in self.counts else F.max(k).alias(k) for k in self.types], *[zero(k) for k in self.distinct])
