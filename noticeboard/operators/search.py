"""Keyword search by index (P03, P13): a table of character trigrams to post ids, so that a search doesn't scan all texts.

Trigrams that more than a share of the first batch's posts have are stop-grams and aren't kept; all other trigrams are kept
whole, in every batch. A search takes the rarest trigrams of its keyword that are kept, joins their posts and tests the texts of
these alone, so it returns what the scan returns. Postings of posts that have changed or gone since do no harm, as the text is
tested as it is now. A keyword without three characters in a row, or of stop-grams alone, is searched by the scan.

Postings lie in hash buckets of the trigram, sorted by it, in a folder for each batch, so a batch that runs again writes the
same folder again, and a search reads the buckets of its few trigrams.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeboard.operators.filters import search
from noticeboard.sources.tables import ship

POSTINGS = "gram bigint, id bigint, bucket int"


def grams(text: str) -> np.ndarray:
    """The distinct trigrams of a text, each as one number of three code points."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.unique((c[:-2] << 42) | (c[1:-1] << 21) | c[2:]) if len(c) > 2 else np.zeros(0, np.int64)


def pieces(keyword: str, wildcards: bool = False) -> list[str]:
    """What must stand in a text as it is: the keyword in lower case, or what is between its wildcards."""
    k = keyword.strip().lower()
    return [p for p in (k.replace("_", "%").split("%") if wildcards else [k]) if len(p) > 2]


class SearchIndex:
    """The index in a folder that all machines share. share: what part of the first batch's posts makes a stop-gram."""

    def __init__(self, spark: SparkSession, root: str, *, share: float = 0.02, buckets: int = 64):
        self.spark, self.root, self.share, self.buckets = spark, root.rstrip("/"), share, buckets

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def _grams(self, posts: DataFrame) -> DataFrame:
        ship(self.spark)
        text = F.lower(F.concat_ws("\x01", "title", "content"))

        def run(batches):
            for b in batches:
                for i in range(0, b.num_rows, 64):
                    found = [grams(t or "") for t in b.column(1).slice(i, 64).to_pylist()]
                    ids = b.column(0).slice(i, 64).take(pa.array(np.repeat(np.arange(len(found)), [len(g) for g in found])))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), ids], names=["gram", "id"])

        return posts.select("id", text.alias("t")).mapInArrow(run, "gram bigint, id bigint")

    def add(self, batch: int, posts: DataFrame) -> None:
        """posts (id, title, content), new or changed, go into the index. Read twice by the first batch."""
        every = self._grams(posts.filter("id is not null"))
        if not self._exists(f"{self.root}/stops/_SUCCESS"):
            most = math.ceil(posts.count() * self.share)
            counts = every.groupBy("gram").agg(F.count("*").alias("n"))
            counts.filter(F.col("n") > most).select("gram").write.mode("overwrite").parquet(f"{self.root}/stops")
        stops = self.spark.read.schema("gram bigint").parquet(f"{self.root}/stops")
        kept = every.join(F.broadcast(stops), "gram", "left_anti")  # stop-grams: at most a post's trigrams on average / share
        kept = kept.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(self.buckets)).cast("int"))
        kept.repartition("bucket").sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/postings/batch={batch}")

    def postings(self, wanted: list[int]) -> DataFrame:
        """gram, id of some trigrams, from their buckets alone."""
        numbers = [r[0] for r in self.spark.createDataFrame([(g,) for g in wanted], "gram bigint").select(F.pmod(F.xxhash64("gram"), F.lit(self.buckets))).distinct().collect()]
        df = self.spark.read.schema(f"{POSTINGS}, batch int").parquet(f"{self.root}/postings")
        return df.filter(F.col("bucket").isin(numbers) & F.col("gram").isin(wanted)).select("gram", "id")

    def rarest(self, keyword: str, wildcards: bool = False, most: int = 3) -> list[int]:
        """Up to `most` of the keyword's trigrams that are kept, the rarest first."""
        wanted = sorted({int(g) for p in pieces(keyword, wildcards) for g in grams(p)})
        if not wanted:
            return []
        stops = {r["gram"] for r in self.spark.read.schema("gram bigint").parquet(f"{self.root}/stops").filter(F.col("gram").isin(wanted)).collect()}
        left = [g for g in wanted if g not in stops]
        if not left:
            return []
        counts = {r["gram"]: r["n"] for r in self.postings(left).groupBy("gram").agg(F.count("*").alias("n")).collect()}
        return sorted(left, key=lambda g: (counts.get(g, 0), g))[:most]

    def search(self, posts: DataFrame, keyword: str, *, wildcards: bool = False) -> DataFrame:
        """The posts that `filters.search` finds."""
        test = search(keyword, wildcards=wildcards)
        few = self.rarest(keyword, wildcards)
        if not few:
            return posts.filter(test)
        hits = self.postings(few).distinct().groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") == len(few)).select(F.col("id").alias("_hit"))
        return posts.join(hits, posts["id"] == hits["_hit"], "left_semi").filter(test)
