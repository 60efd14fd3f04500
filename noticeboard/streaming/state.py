"""Keyed state of a stream of ledger events, of which a batch reads and writes only the buckets of its keys.

An event folds into its key's state whatever the order: the first cancelling event is absorbing, the last event by time
counts otherwise, and an event that comes again is known by its id. Both tables are changed in one commit under the
batch's number, so a batch that runs again after a restart changes nothing. Staleness is told when the state is read, from
the time then, and needs no timer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeboard.sources.buckets import BucketStore
from noticeboard.sources.tables import stored

LAST = "struct<at:timestamp,event:bigint,kind:string>"
TABLES = {
    "seen": (["event"], "event bigint, at timestamp"),
    "state": (["key"], f"key bigint, n bigint, first timestamp, last {LAST}, cancelled_at timestamp"),
}


def folded(rows: DataFrame) -> DataFrame:
    """States of one key put together: an aggregate that tasks begin before the shuffle, so no key is hot."""
    return rows.groupBy("key").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.min("cancelled_at").alias("cancelled_at"))


class LedgerState:
    """The fold of events (key, event, at, kind); kinds in `cancels` are absorbing."""

    def __init__(self, spark: SparkSession, root: str, cancels: tuple[str, ...], buckets: int = 64):
        self.spark, self.cancels, self.store = spark, cancels, BucketStore(spark, root, TABLES, buckets)

    def __call__(self, batch: DataFrame, number: int) -> None:
        """A handler of micro-batches (`ingest.run`). Events without key or id don't count."""
        if self.store.done(number):
            return
        events = stored(batch.filter("key is not null and event is not null").groupBy("event").agg(F.min(F.struct("at", "key", "kind")).alias("e")).select("event", "e.*"), "events")
        known = self.store.lookup("seen", events).select("event")
        new = stored(events.join(known, "event", "left_anti"), "new")
        cancel = F.when(F.col("kind").isin(*self.cancels), F.col("at"))
        one = new.select("key", F.lit(1).cast("bigint").alias("n"), F.col("at").alias("first"), F.struct("at", "event", "kind").alias("last"), cancel.alias("cancelled_at"))
        mine = stored(folded(one), "mine")
        state = stored(folded(mine.unionByName(self.store.lookup("state", mine))), "state")
        self.store.commit(number, {"seen": (None, new.select("event", "at")), "state": (state.select("key"), state)})

    def table(self, now: Column | None = None, stale_after: str = "INTERVAL 12 HOURS") -> DataFrame:
        """key, n, first, last_at, last_event, status: cancelled, the last event's kind, or, where that is older than `stale_after` at `now`, stale."""
        s = self.store.read("state")
        status = F.when(F.col("cancelled_at").isNotNull(), "cancelled")
        if now is not None:
            status = status.when(F.col("last.at") < now - F.expr(stale_after), "stale")
        return s.select("key", "n", "first", F.col("last.at").alias("last_at"), F.col("last.event").alias("last_event"), status.otherwise(F.col("last.kind")).alias("status"))
