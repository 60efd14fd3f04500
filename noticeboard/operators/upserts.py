"""Upserts that write (M05, M08, S19): a batch of landed records goes into stored posts and fields, bad ones into a table of their own.

A batch reads and writes the hash buckets of its own URLs only. A record with a problem costs nothing but itself: it goes
to `rejected` with the batch's number, the others are written. A batch that runs again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticeboard.operators.merge import upsert_plan, upserted_posts
from noticeboard.sources.buckets import BucketStore
from noticeboard.sources.tables import split_valid, stored

VALUES = ("title", "publish_date", "original_url", "content")
TABLES = {
    "posts": (["canonical_url"], "canonical_url string, id bigint, title string, publish_date date, original_url string, content string, reclassify boolean, batch bigint"),
    "fields": (["post_url"], "post_url string, id bigint, field_name string, field_value string"),
    "rejected": (["canonical_url"], "canonical_url string, problem string, batch bigint"),
}


def problem() -> Column:
    """Why a record can't be written; null for a good one. Without any date a new post has none, which is no problem."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    return F.when(blank("canonical_url"), "no url").when(blank("title") & blank("content"), "no title and no content")


class PostStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.store = spark, BucketStore(spark, root, TABLES, buckets)

    def _numbered(self, name: str, new: DataFrame, there: DataFrame, order: list[str]) -> DataFrame:
        """new with ids where they are null: each bucket counts on for itself, in its own residue class, so no task numbers all rows."""
        bucket = self.store.bucket(name).alias("_b")
        most = there.groupBy(bucket).agg(F.max("id").alias("_most"))
        rank = F.row_number().over(Window.partitionBy("_b", F.col("id").isNull()).orderBy(*order))
        out = new.withColumn("_b", self.store.bucket(name)).join(most, "_b", "left")
        first = F.coalesce((F.col("_most") - F.col("_b")) / self.store.n, F.lit(-1)).cast("bigint")
        return out.withColumn("id", F.coalesce("id", (first + rank) * self.store.n + F.col("_b"))).drop("_b", "_most")

    def apply(self, batch: int, incoming: DataFrame, order: str, wrong: Column | None = None) -> DataFrame:
        """incoming: canonical_url, the values, fields (array of structs name, value), and a column of arrival; of records of one URL the last counts.

        Returns one row of counts: inserted, updated, kept, rejected, and of fields written and deleted.
        """
        if self.store.done(batch):
            return self.spark.createDataFrame([(0, 0, 0, 0, 0, 0)], "inserted bigint, updated bigint, kept bigint, rejected bigint, fields_written bigint, fields_deleted bigint")
        rows = stored(incoming.withColumn("_why", problem() if wrong is None else F.coalesce(problem(), wrong)), "incoming")
        good, bad = split_valid(rows, F.col("_why"))
        last = good.groupBy("canonical_url").agg(F.max_by(F.struct(*VALUES, "fields"), F.struct(F.col(order), F.xxhash64(*VALUES))).alias("r")).select("canonical_url", "r.*")
        last = stored(last.withColumn("publish_date", F.to_date("publish_date")), "records")

        there = stored(self.store.lookup("posts", last), "there")
        plan = stored(upserted_posts(there.drop("reclassify", "batch"), last, values=VALUES), "plan")
        changed = F.col("op") != "keep"
        known = self.store.read("posts", self.store.met("posts", last))  # ids count on from the bucket's greatest
        posts = self._numbered("posts", plan.filter(changed), known, ["canonical_url"])
        posts = stored(posts.select("canonical_url", "id", *VALUES, F.col("reclassify").alias("reclassify"), F.lit(batch).cast("bigint").alias("batch")), "posts")

        urls = stored(last.select(F.col("canonical_url").alias("post_url")), "urls")
        old = stored(self.store.lookup("fields", urls), "fields")
        named = last.select(F.col("canonical_url").alias("post_url"), F.posexplode_outer("fields").alias("at", "f")).select("post_url", "at", F.trim("f.name").alias("field_name"), F.col("f.value").alias("field_value")).filter("field_name <> ''")
        fields = stored(upsert_plan(old, named, ["post_url", "field_name"], ["field_value"], order="at"), "field-plan")
        every = self.store.read("fields", self.store.met("fields", urls))
        kept = stored(self._numbered("fields", fields.filter("op <> 'delete'").drop("op"), every, ["post_url", "field_name"]), "fields")
        rejected = bad.select("canonical_url", F.col("problem"), F.lit(batch).cast("bigint").alias("batch"))

        counts = plan.agg(F.count_if(F.col("op") == "insert").alias("inserted"), F.count_if(F.col("op") == "update").alias("updated"), F.count_if(F.col("op") == "keep").alias("kept"))
        wrote = fields.agg(F.count_if(F.col("op").isin("insert", "update")).alias("fields_written"), F.count_if(F.col("op") == "delete").alias("fields_deleted"))
        counts = stored(counts.crossJoin(bad.agg(F.count("*").alias("rejected"))).crossJoin(wrote), "counts")  # one row each
        self.store.commit(batch, {"posts": (posts.select("canonical_url"), posts), "fields": (urls, kept), "rejected": (None, stored(rejected, "rejected"))})
        return counts.select("inserted", "updated", "kept", "rejected", "fields_written", "fields_deleted")
