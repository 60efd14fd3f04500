"""Consolidation: fill gaps, and upsert plans with stable identity. Targets are immutable, so each plan is a table of operations for a new snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filled(base: DataFrame, extra: DataFrame, by: list[str], value: str, arrival: str) -> DataFrame:
    """Of each key base's last value; extras only where base has none (their first)."""
    b = base.groupBy(*by).agg(F.max_by(value, arrival).alias(value))
    e = extra.filter(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(*by).agg(F.min_by(value, arrival).alias("_extra"))
    return b.join(e, by, "full_outer").select(*by, F.coalesce(F.nullif(F.col(value), F.lit("")), F.col("_extra"), F.col(value)).alias(value))


def upsert_plan(existing: DataFrame, incoming: DataFrame, by: list[str], values: list[str], *, key: str = "id", order: str, replace: bool = True) -> DataFrame:
    """Op (keep, update, insert, delete), key, by, values.

    Of rows with the same key the first existing keeps its identity, later ones go; of incoming ones the last (by
    `order`, ties by the values) counts. replace: keys that don't come any more are deleted.
    """
    first = F.row_number().over(Window.partitionBy(*by).orderBy(key))
    e = existing.select(*by, key, *values).withColumn("_n", first)
    more = e.filter("_n > 1")
    e = e.filter("_n = 1").select(*by, F.col(key).alias("_key"), *[F.col(v).alias(f"_old_{v}") for v in values], F.lit(True).alias("_old"))
    i = incoming.filter(" and ".join(f"`{b}` is not null" for b in by))
    i = i.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(order).desc(), *[F.col(v).desc() for v in values]))).filter("_n = 1").select(*by, *values, F.lit(True).alias("_new"))
    j = e.join(i, by, "full_outer")
    same = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.col(f"_old_{v}"))
    op = F.when(F.col("_new").isNull(), "delete" if replace else "keep").when(F.col("_old").isNull(), "insert").when(same, "keep").otherwise("update")
    out = j.select(op.alias("op"), F.col("_key").alias(key), *by, *[F.when(F.col("_new").isNull(), F.col(f"_old_{v}")).otherwise(F.col(v)).alias(v) for v in values])
    return out.unionByName(more.select(F.lit("delete").alias("op"), key, *by, *values))


def attachment_upserts(existing: DataFrame, incoming: DataFrame, touched: DataFrame, order: str, replace: bool = True) -> DataFrame:
    """The plan for the attachments of touched posts (id): the key is the URL, rows without URL or name don't count, the last of equal ones does. A touched post for which nothing comes loses all of its own."""
    clean = incoming.withColumns({c: F.trim(F.coalesce(c, F.lit(""))) for c in ("file_url", "filename")}).filter("file_url <> '' and filename <> ''")
    mine = existing.join(touched.select(F.col("id").alias("_t")), F.col("post_id") == F.col("_t"), "left_semi")
    return upsert_plan(mine, clean, ["post_id", "file_url"], ["filename", "file_type"], order=order, replace=replace)


def applied(plan: DataFrame, next_key: Column | int, key: str = "id") -> DataFrame:
    """The new snapshot: inserts get keys from next_key on, in the order of their hash (no single-task numbering)."""
    kept = plan.filter("op in ('keep', 'update')").drop("op")
    new = plan.filter("op = 'insert'").drop("op", key)
    numbered = new.withColumn(key, F.monotonically_increasing_id() + next_key)
    return kept.unionByName(numbered.select(kept.columns))


def upserted_posts(existing: DataFrame, incoming: DataFrame, key: str = "canonical_url", values: tuple[str, ...] = ("title", "publish_date", "original_url", "content"), reclassify: tuple[str, ...] = ("title", "content")) -> DataFrame:
    """Incoming values count where they aren't empty; `changed`, and whether to classify again. Rows whose detail failed were left out before."""
    i = incoming.select(F.col(key).alias("_k"), *[F.col(v).alias(f"_{v}") for v in values])
    j = existing.join(i, existing[key] == i["_k"], "full_outer")
    new = {v: F.coalesce(F.when(F.col(f"_{v}").cast("string") != "", F.col(f"_{v}")), F.col(v)) for v in values}
    differ = lambda vs: F.coalesce(F.greatest(*[(~new[v].eqNullSafe(F.col(v))).cast("int") for v in vs], F.lit(0)) == 1, F.lit(False))
    there = F.col(key).isNotNull()
    op = F.when(F.col("_k").isNull(), "keep").when(~there, "insert").when(differ(values), "update").otherwise("keep")
    return j.select(op.alias("op"), differ(reclassify).alias("reclassify"), F.coalesce(key, "_k").alias(key), *[new[v].alias(v) for v in values], *[existing[c] for c in existing.columns if c not in (key, *values)])


def metadata_changed(existing: DataFrame, incoming: DataFrame, by: str, key: str, values: list[str]) -> DataFrame:
    """Parents whose children's metadata differ as a whole. Hashes by parent, order apart; one join of parents."""
    total = lambda df, name: df.groupBy(by).agg(F.sum(F.xxhash64(key, *values).cast("decimal(38,0)")).alias(name), F.count_distinct(key).alias(f"{name}_n"))
    j = total(existing, "a").join(total(incoming, "b"), by, "full_outer")
    return j.filter(~(F.col("a").eqNullSafe(F.col("b")) & F.col("a_n").eqNullSafe(F.col("b_n")))).select(by)


def upserted_results(existing: DataFrame, incoming: DataFrame, status: str, provider: str, force: bool = False) -> DataFrame:
    """One row per post: a model's success isn't overwritten by a rule's result, unless forced."""
    e = existing.select(F.col("post_id").alias("_p"), F.struct(*existing.columns).alias("_old"))
    i = incoming.select("post_id", F.struct(*existing.columns).alias("_new"))
    j = e.join(i, e["_p"] == i["post_id"], "full_outer")
    keep = F.col("_new").isNull() | (F.lit(not force) & (F.col(f"_old.{status}") == "success") & (F.col(f"_old.{provider}") == "openai") & (F.col(f"_new.{provider}") == "rule"))
    return j.select(F.when(F.coalesce(keep, F.lit(False)), F.col("_old")).otherwise(F.col("_new")).alias("r")).select("r.*")
