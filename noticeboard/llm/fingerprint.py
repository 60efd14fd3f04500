"""Document fingerprints: threshold-scaled sketches of word shingles, in built-in functions only.

A text's shingles are the runs of five words (white space apart, letters lower-cased); with fewer words, all of them
are one. The sketch keeps every shingle hash in the lowest `fraction` of the hash range, so the sketches of two texts
hold the same share of what they have in common, whatever their sizes: sketches of parts merge by union, and
containment and likeness follow from intersection sizes. A text without a hash so low keeps its least one, so only a
text without words has an empty sketch.

Defined cases: a null text counts as empty; two empty sketches are alike (1), an empty and another aren't (0); rows of
one id are equals and share the next document; of several rows with the next id the one with the least beginning
counts; a row with a null id has no next document; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeboard.llm.common import stored, table

SHINGLE, FRACTION = 5, 0.25
_WHITE = " \t\n\x0b\f\r"


def sketch(text: Column, k: int = SHINGLE, fraction: float = FRACTION) -> Column:
    """Sorted array of the kept 64-bit hashes."""
    words = F.split(F.btrim(F.lower(text), F.lit(_WHITE)), r"[ \t\n\x0b\f\r]+")
    return F.transform(F.array(words), lambda w: _kept(w, k, fraction))[0]


def _kept(words: Column, k: int, fraction: float) -> Column:
    n = F.size(words)
    hashes = F.when((n == 1) & (words[0] == ""), F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, k))))
    return F.transform(F.array(hashes), lambda h: _lowest(h, fraction))[0]


def _lowest(hashes: Column, fraction: float) -> Column:
    low = F.filter(hashes, lambda h: h < F.lit(int(fraction * 2**64) - 2**63))
    return F.array_sort(F.array_distinct(F.when((F.size(low) == 0) & (F.size(hashes) > 0), F.array(F.array_min(hashes))).otherwise(low)))


def written(s: Column) -> Column:
    """A sketch as text: 16 hex digits a hash."""
    return F.concat_ws("", F.transform(s, lambda h: F.lpad(F.hex(h), 16, "0")))


def merged(a: Column, b: Column) -> Column:
    """The sketch of two texts' shingles together."""
    return F.array_sort(F.array_union(a, b))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles among all."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def fingerprints(docs: DataFrame, *, text_col: str = "text", k: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """docs with a column `fingerprint` (underscores in front if taken). No shuffle."""
    from noticeboard.llm.common import free_name

    return docs.withColumn(free_name(docs, "fingerprint"), sketch(F.coalesce(F.col(text_col), F.lit("")), k, fraction))


def successors(ids: DataFrame) -> DataFrame:
    """id, next: of distinct ids, each with the next greater one; the greatest with the least.

    Ids are dealt by range, and led within each range; the first ids of the ranges (one row for each) close the gaps.
    """
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(ids.repartitionByRange(parts, "id").withColumn("part", F.spark_partition_id()), "ids")
    within = Window.partitionBy("part").orderBy("id")
    firsts = ranged.groupBy("part").agg(F.min("id").alias("first"))
    order = Window.orderBy("part")  # a row for each range
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(order), F.min("first").over(Window.partitionBy(F.lit(0)))).alias("after"))
    led = ranged.withColumn("next", F.lead("id").over(within))
    return led.join(F.broadcast(firsts), "part").select("id", F.coalesce("next", "after").alias("next"))


def edited_with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """id, text, edited text and the next document's sketch: the last quarter gives way to the next one's beginning.

    The texts are shuffled once (both joins deal them by id); of the next document only the beginning that is needed
    and its sketch move.
    """
    every = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = every.filter("id is not null")  # the same plan on both sides of the joins, so that its exchange is reused
    sizes = stored(d.groupBy("id").agg(F.max(F.length("text")).alias("n")), "sizes")
    after = successors(sizes.select("id")).join(sizes, "id").select(F.col("id").alias("before"), F.col("next"), F.expr("n div 4").cast("int").alias("m"))
    heads = d.join(after, d["id"] == after["next"]).select(F.col("before"), F.expr("left(text, m)").alias("head"), sketch(F.col("text"), k, fraction).alias("next_sketch"))
    heads = heads.groupBy("before").agg(F.min(F.struct("head", "next_sketch")).alias("h"))
    both = d.join(heads, d["id"] == heads["before"], "left").select("id", "text", "h")
    both = both.unionByName(every.filter("id is null").withColumn("h", F.lit(None).cast(both.schema["h"].dataType)))
    n = F.length("text")
    m = F.expr("length(text) div 4").cast("int")
    head = F.expr("left(coalesce(h.head, ''), cast(length(text) div 4 as int))")
    return both.select("id", "text", n.cast("bigint").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - m), head).alias("edited"), F.coalesce("h.next_sketch", F.array().cast("array<bigint>")).alias("next_sketch"))


def op8(spark, sf_dir: str) -> DataFrame:
    e = edited_with_next(table(spark, sf_dir, "documents"))
    e = e.select("id", "n_chars", F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"), sketch(F.col("text")).alias("own"), sketch(F.col("edited")).alias("other"), "next_sketch")
    return e.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", written(F.col("own")).alias("fingerprint"), written(F.col("other")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next_sketch")).alias("near_next"))
