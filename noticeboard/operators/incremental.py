"""Duplicate groups kept up to date by batches: an index of keys and a table of components.

Three bucketed tables: `rows` (each row's keys, by component), `labels` (id to component), `keys` (a key, with its day where the
rule allows a day's distance, to one row that has it: all rows of a key are of one component, so one is enough and no key
is hot). A batch looks up its own ids and keys only:

* a component that lost a row or a key of a row is taken apart: its other rows are compared anew, by their keys;
* any other component that a key of the batch meets stays one node: it is joined, not read;
* only components that merge into another one are read and moved.

The result is that of `entities.components` over all rows, after every batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeboard.operators import entities
from noticeboard.sources.buckets import BucketStore
from noticeboard.sources.tables import stored

KEYED = ["id", "source_id", "canonical", "original", "title_key", "day", "print"]
TABLES = {
    "rows": (["root"], "root bigint, id bigint, source_id string, canonical string, original string, title_key string, day date, print string"),
    "labels": (["id"], "id bigint, root bigint"),
    "keys": (["key"], "key string, day date, rep bigint"),
}


def entries(rows: DataFrame) -> DataFrame:
    """id, key, day: the keys under which rows of `entities.keyed` are found. Only the rule of a day's distance has a day beside its key."""

    def key(rule: int, *cols: str, day: Column | None = None) -> Column:
        have = F.col("source_id").isNotNull()
        for c in cols:
            have = have & F.col(c).isNotNull()
        text = F.to_json(F.array(F.lit(str(rule)), *[F.col(c).cast("string") for c in ("source_id", *cols)]))
        there = have if day is None else have & day.isNotNull()
        return F.when(there, F.struct(text.alias("key"), (F.lit(None).cast("date") if day is None else day).alias("day")))

    every = F.array(key(0, "canonical"), key(1, "original"), key(2, "title_key", "day"), key(3, "title_key", "print", day=F.col("day")))
    return rows.select("id", F.explode(F.array_compact(every)).alias("e")).select("id", "e.key", "e.day")


class DuplicateIndex:
    """The tables in a folder that all machines share, and the batches that change them."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.store = spark, BucketStore(spark, root, TABLES, buckets)

    def labels(self) -> DataFrame:
        """id, root: each row's component (its least id; of a row without duplicates its own)."""
        return self.store.read("labels")

    def components(self) -> DataFrame:
        """id, root of the rows that have duplicates, as `entities.components` gives them."""
        rows = self.labels()
        several = rows.groupBy("root").agg(F.count("*").alias("n")).filter("n > 1").select("root")
        return rows.join(several, "root").select("id", "root")

    def apply(self, batch: int, rows: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
        """Rows (of `entities.keyed`, one for each id; new or changed) come and `deleted` ids go; returns the ids whose component may have changed.

        A batch number that was applied before changes nothing and gives no ids.
        """
        if self.store.done(batch):
            return self.spark.createDataFrame([], "id bigint")
        rows = stored(rows.select(KEYED).dropDuplicates(["id"]), "batch")
        gone = self.spark.createDataFrame([], "id bigint") if deleted is None else deleted.select("id")
        gone = gone.join(rows.select("id"), "id", "left_anti").distinct()
        touched = stored(rows.select("id").unionByName(gone), "touched")

        # the touched rows as they were, with all of their components
        old = stored(self.store.lookup("labels", touched), "old")
        members = stored(self.store.lookup("rows", old.select("root").distinct()), "members")
        was = members.join(touched, "id", "left_semi")
        new_entries = entries(rows).withColumnRenamed("id", "_id").withColumnRenamed("key", "_key").withColumnRenamed("day", "_day")
        before = entries(was)
        dropped = before.join(new_entries, (F.col("id") == F.col("_id")) & (F.col("key") == F.col("_key")) & F.col("day").eqNullSafe(F.col("_day")), "left_anti").select("id")
        lost = stored(old.join(dropped.unionByName(gone).distinct(), "id", "left_semi").select("root").distinct(), "lost")

        # rows that are compared anew, among each other and with what their keys meet
        others = members.join(touched, "id", "left_anti")
        fresh = stored(others.join(lost, "root", "left_semi").select(KEYED).unionByName(rows), "fresh")
        holders = stored(entries(fresh).groupBy("key", "day").agg(F.min("id").alias("rep")), "holders")
        changed = stored(entries(members.join(lost, "root", "left_semi")).select("key").unionByName(holders.select("key")).distinct(), "keys")
        found = stored(self.store.lookup("keys", changed), "found")
        to = self.store.lookup("labels", stored(found.select(F.col("rep").alias("id")).distinct(), "reps")).withColumnRenamed("id", "rep")
        found = stored(found.join(to, "rep").join(lost, "root", "left_anti"), "found")
        near = found.select(F.col("key").alias("_key"), F.col("day").alias("_day"), F.col("root").alias("_root"))
        close = F.col("day").isNull() | (F.abs(F.datediff("day", "_day")) <= 1)
        outer = holders.join(near, (F.col("key") == F.col("_key")) & close).select(F.col("rep").alias("a"), F.col("_root").alias("b"))
        own = old.join(lost, "root", "left_anti").join(rows.select("id"), "id").select(F.col("id").alias("a"), F.col("root").alias("b"))
        whole = stored(outer.select(F.col("b").alias("root")).unionByName(own.select(F.col("b").alias("root"))).distinct(), "whole")
        links = entities.edges(fresh).select("a", "b").unionByName(outer).unionByName(own)
        nodes = stored(entities.components(links), "nodes")

        # what changes in the tables
        to = nodes.select("id", F.col("root").alias("new_root"))
        placed = fresh.join(to, "id", "left").withColumn("root", F.coalesce("new_root", "id")).drop("new_root")
        moved = stored(whole.join(to.withColumnRenamed("id", "root"), "root").filter("root <> new_root"), "moved")
        regrouped = stored(old.select("root").unionByName(moved.select("root")).unionByName(lost).distinct(), "regrouped")
        kept = stored(self.store.lookup("rows", regrouped).join(touched, "id", "left_anti").join(lost, "root", "left_anti"), "kept")
        kept = kept.join(moved, "root", "left").withColumn("is_moved", F.col("new_root").isNotNull()).withColumn("root", F.coalesce("new_root", "root")).drop("new_root")
        new_rows = stored(placed.withColumn("is_moved", F.lit(True)).unionByName(kept), "rows")
        relabelled = new_rows.filter("is_moved").select("id", "root")
        entry = found.select("key", "day", "rep").unionByName(holders.select("key", "day", "rep"))
        self.store.commit(
            batch,
            {
                "rows": (regrouped, new_rows.select("root", *KEYED)),
                "labels": (touched.unionByName(relabelled.select("id")), relabelled),
                "keys": (changed, stored(entry.groupBy("key", "day").agg(F.min("rep").alias("rep")), "entries")),
            },
        )
        return touched.unionByName(relabelled.select("id")).distinct()

    def groups(self, ids: DataFrame, members: DataFrame) -> DataFrame:
        """`entities.groups` of the components that hold these ids; only these are read. members: rank's columns of at least their rows."""
        roots = stored(self.store.lookup("labels", ids).select("root").distinct(), "roots")
        rows = stored(self.store.lookup("rows", roots), "rows")
        return entities.groups(stored(entities.edges(rows.select(KEYED)), "links"), members.join(rows.select("id"), "id", "left_semi"))


def refreshed(index: DuplicateIndex, batch: int, posts: DataFrame, changed: DataFrame, members: DataFrame, checked_at: Column, deleted: DataFrame | None = None) -> DataFrame:
    """Posts (as they are after the batch) with the marks of all groups that the batch changed; `entities.refreshed` without reading whole sources.

    changed: `entities.keyed` of the batch's rows.
    """
    ids = stored(index.apply(batch, changed, deleted), "affected")
    return entities.marked(posts, stored(index.groups(ids, members), "groups"), checked_at, ids)


def follow(index: DuplicateIndex, key_of) -> object:
    """A handler of micro-batches (`ingest.run`): a batch's rows go into the index under the batch's number. key_of: the batch's rows as `entities.keyed` gives them."""

    def handle(batch: DataFrame, number: int) -> None:
        index.apply(number, key_of(batch))

    return handle
