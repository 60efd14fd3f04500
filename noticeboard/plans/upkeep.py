"""Stored tables that batches keep up to date, bound to the driver's tables; each query ends in the tables' state, which SQL tells from all rows at once."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from noticeboard.operators import incremental, search, upserts
from noticeboard.operators.keyset import KeysetPages
from noticeboard.operators.partials import DailySummary
from noticeboard.plans.queries import _DUP, POSTS, _dup_keys, posts, query
from noticeboard.sources.tables import shared_dir, table
from noticeboard.streaming import ingest, state


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(_DUP.replace(f"WITH RECURSIVE {POSTS}", "WITH RECURSIVE posts AS (SELECT doc_id AS id, source AS source_id, string_split(text, chr(10))[1] AS title, text AS content, DATE '2024-01-01' + CAST(doc_id % 28 AS INTEGER) AS publish_date FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))") + " SELECT id, root FROM c")
def components_incremental(spark, d):
    """Components after three batches: all posts (those of good quality still without their day), these with their day, and toxic ones deleted."""
    index = incremental.DuplicateIndex(spark, _folder(spark, "index"), 16)
    keys, labels = _dup_keys(spark, d), table(spark, d, "labels")
    late = labels.filter("quality = 1").select("doc_id").distinct()
    draft = keys.join(late.withColumn("late", F.lit(True)), F.col("id") == F.col("doc_id"), "left").withColumn("day", F.when(F.col("late").isNull(), F.col("day")))
    index.apply(0, draft.select(keys.columns))
    index.apply(1, keys.join(late, F.col("id") == F.col("doc_id"), "left_semi"))
    index.apply(2, keys.limit(0), labels.filter("toxic = 1").select(F.col("doc_id").alias("id")))
    return index.components()


_UPSERTED = """WITH d AS (SELECT 'http://n/' || CAST(doc_id AS VARCHAR) AS url, string_split(text, chr(10))[1] AS title, text, lang, source, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS again, doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) AS bare, coalesce(trim(text), '') = '' AS empty FROM documents),
p AS (SELECT url, CASE WHEN again AND source <> '' THEN source ELSE title END AS title, md5(text) AS body, again AND NOT empty AND source <> '' AND source IS DISTINCT FROM title AS changed, CAST(CASE WHEN bare THEN 1 ELSE 2 END AS BIGINT) AS fields, CASE WHEN again THEN upper(lang) ELSE lang END AS lang FROM d WHERE NOT empty)"""


@query(f"{_UPSERTED} SELECT url, title, body, changed, fields, lang FROM p UNION ALL SELECT url, NULL, 'no title and no content', NULL, CAST(count(*) AS BIGINT), NULL FROM (SELECT url FROM d WHERE empty UNION ALL SELECT url FROM d WHERE empty AND bare) GROUP BY url")
def posts_upserted(spark, d):
    """Posts and fields after two batches, and the rejected records: all, then those with labels again, with other titles (empty ones change nothing) and fewer fields."""
    t = table(spark, d, "documents")
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    pair = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    none = F.lit(None).cast("string")
    url = F.concat(F.lit("http://n/"), F.col("doc_id").cast("string")).alias("canonical_url")
    title = F.split_part("text", F.lit("\n"), F.lit(1))
    first = t.select(url, title.alias("title"), F.lit("2024-01-01").alias("publish_date"), none.alias("original_url"), F.col("text").alias("content"), F.array(pair("lang", F.col("lang")), pair("source", F.col("source"))).alias("fields"), F.col("doc_id").alias("at"))
    good = F.col("quality") == 1
    fields = F.when(good, F.array(pair("lang", F.upper("lang")), pair("source", F.col("source")))).otherwise(F.array(pair("lang", F.col("lang"))))
    empty = F.trim(F.coalesce("text", F.lit(""))) == ""
    again = t.join(labels, "doc_id").filter(~(good & empty)).select(url, F.when(good, F.col("source")).otherwise("").alias("title"), F.lit("").alias("publish_date"), none.alias("original_url"), F.when(good, F.lit("")).otherwise(F.col("text")).alias("content"), fields.alias("fields"), F.col("doc_id").alias("at"))
    store = upserts.PostStore(spark, _folder(spark, "posts"), 16)
    store.apply(0, first, "at")
    store.apply(1, again.withColumn("publish_date", F.nullif("publish_date", F.lit(""))), "at")
    store.apply(1, first, "at")  # a batch that ran is a no-op
    f = store.store.read("fields").groupBy("post_url").agg(F.count("*").alias("fields"), F.max(F.when(F.col("field_name") == "lang", F.col("field_value"))).alias("lang"))
    p = store.store.read("posts").join(f, F.col("post_url") == F.col("canonical_url"))
    p = p.select(F.col("canonical_url").alias("url"), "title", F.md5(F.encode("content", "utf-8")).alias("body"), ((F.col("batch") == 1) & F.col("reclassify")).alias("changed"), "fields", "lang")
    bad = store.store.read("rejected").groupBy(F.col("canonical_url").alias("url"), F.col("problem").alias("body")).agg(F.count("*").alias("fields"))
    return p.unionByName(bad.select("url", none.alias("title"), "body", F.lit(None).cast("boolean").alias("changed"), "fields", none.alias("lang")))


@query("""WITH e AS (SELECT DISTINCT event_id, ts, user_id, event_type FROM events WHERE user_id IS NOT NULL)
SELECT user_id AS key, count(*) AS n, epoch_us(min(ts)) AS first_us, max(event_id) FILTER (WHERE ts = m) AS last_event, CASE WHEN bool_or(event_type = 'error') THEN 'cancelled' ELSE arg_max(event_type, (ts, event_id)) END AS status
FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) AS m FROM e) GROUP BY user_id""")
def ledger_folded(spark, d):
    """Events of a stream folded by key, in several batches, with a restart and events that come again."""
    landed, kept = _folder(spark, "landed"), _folder(spark, "ledger")
    events = table(spark, d, "events").select(F.col("user_id").cast("bigint").alias("key"), F.col("event_id").alias("event"), F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("kind"))
    fold = state.LedgerState(spark, f"{kept}/state", ("error",), 16)
    once = lambda: ingest.run(ingest.file_stream(spark, landed, events.schema, files_per_batch=2, glob="*.parquet"), fold, f"{kept}/checkpoint").awaitTermination()
    events.repartition(4, "event").write.mode("append").parquet(landed)
    once()
    events.filter("kind = 'error'").coalesce(1).write.mode("append").parquet(landed)
    once()
    return fold.table().select("key", "n", F.unix_micros("first").alias("first_us"), "last_event", "status")



_KEYWORDS = (("Licensed", False), ("password", False), ("to_en%=", True), ("@mail", False), ("e t", False), ("xq", False), ("no such phrase at all", False), ("100%", False), ("reserved", False))
_LIKE = " UNION ALL ".join(f"SELECT '{k}' AS keyword, id FROM posts WHERE " + (f"title ILIKE '%{k}%' OR content ILIKE '%{k}%'" if w else f"contains(lower(title), '{k.lower()}') OR contains(lower(content), '{k.lower()}')") for k, w in _KEYWORDS)


@query(f"WITH {POSTS} {_LIKE}")
def search_by_index(spark, d):
    """What keywords of several kinds find through an index that two batches made."""
    p = posts(spark, d)
    index = search.SearchIndex(spark, _folder(spark, "search"), buckets=16)
    later = table(spark, d, "labels").select("doc_id").distinct()
    index.add(0, p.join(later, F.col("id") == F.col("doc_id"), "left_anti"))
    index.add(1, p.join(later, F.col("id") == F.col("doc_id"), "left_semi"))
    found = [index.search(p.select("id", "title", "content"), k, wildcards=w).select(F.lit(k).alias("keyword"), "id") for k, w in _KEYWORDS]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


_SPANS = (("2024-01-01", "2024-01-31"), ("2024-01-05", "2024-01-11"), ("2024-01-09", "2024-01-09"), ("2023-01-01", "2023-06-30"))
_KINDS = "count(*) AS n, count(*) FILTER (WHERE value > 50) AS large, sum(CAST(floor(value) AS BIGINT)) AS total, epoch_us(max(ts)) AS latest_us, count(DISTINCT user_id) AS users, count(DISTINCT user_id) FILTER (WHERE value > 50) AS large_users"
_BY_SPAN = " UNION ALL ".join(f"SELECT '{a}' AS first, '{b}' AS last, NULL AS kind, {_KINDS} FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '{a}' AND DATE '{b}' UNION ALL SELECT '{a}', '{b}', event_type, {_KINDS} FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '{a}' AND DATE '{b}' GROUP BY event_type" for a, b in _SPANS)


@query(f"SELECT first, last, kind, n, large, CAST(total AS BIGINT) AS total, latest_us, users, large_users FROM ({_BY_SPAN})")
def summary_of_days(spark, d):
    """Summaries of several ranges, in all and by kind, from partials of days that two batches made, the second with late rows of every day, and some days made anew."""
    e = table(spark, d, "events")
    large = F.col("value") > 50
    s = DailySummary(spark, _folder(spark, "days"), F.to_date("ts"), ("event_type",), counts={"large": large}, sums={"total": (F.floor("value"), "bigint")}, latest={"latest": (F.col("ts"), e.schema["ts"].dataType.simpleString())}, distinct={"users": F.col("user_id"), "large_users": F.when(large, F.col("user_id"))}, buckets=16)
    late = F.coalesce(F.col("event_type") == "error", F.lit(False))
    s.add(0, e.filter(~late))
    s.add(1, e.filter(late))
    s.refresh(2, e.filter("value > 400").select(F.to_date("ts").alias("day")).distinct(), e)
    out = None
    for a, b in _SPANS:
        for by in ((), ("event_type",)):
            one = s.summary(a, b, by).select(F.lit(a).alias("first"), F.lit(b).alias("last"), (F.col("event_type") if by else F.lit(None).cast("string")).alias("kind"), "n", "large", "total", F.unix_micros(F.col("latest").cast("timestamp")).alias("latest_us"), "users", "large_users")
            out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {POSTS}, now AS (SELECT id, title, CASE WHEN id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN DATE '2024-02-01' + CAST(id % 5 AS INTEGER) ELSE publish_date END AS day, source_id FROM posts WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
r AS (SELECT *, row_number() OVER (ORDER BY day DESC, id DESC) AS pos, count(*) OVER () AS total FROM now), k AS (SELECT row_number() OVER (ORDER BY day DESC, id DESC) AS pos, id FROM now WHERE (day, id) < (DATE '2024-01-15', 500)), w AS (SELECT row_number() OVER (ORDER BY day DESC, id DESC) AS pos, id FROM now WHERE (day, id) < (DATE '2024-01-15', 500) AND source_id = 'src3')
SELECT 'first' AS page, id, total FROM r WHERE pos <= 20 UNION ALL SELECT 'far', id, total FROM r WHERE pos > 701 AND pos <= 741 UNION ALL SELECT 'beyond', id, total FROM r WHERE pos > 100000000 UNION ALL SELECT 'after', id, (SELECT count(*) FROM now) FROM k WHERE pos <= 30 UNION ALL SELECT 'after, of one source', id, (SELECT count(*) FROM now) FROM w WHERE pos <= 30""")
def pages_of_ranges(spark, d):
    """Pages, and the total, of a list kept in ranges: after a batch that gave posts of good quality another date, and one that deleted toxic ones."""
    p = posts(spark, d).select("id", "title", "publish_date", "source_id")
    labels = table(spark, d, "labels")
    of = lambda where: p.join(labels.filter(where).select("doc_id").distinct(), F.col("id") == F.col("doc_id"), "left_semi")
    k = KeysetPages(spark, _folder(spark, "list"), "id bigint, title string, publish_date date, source_id string", 16)
    k.build(p)
    dated = F.expr("date_add(date'2024-02-01', cast(id % 5 as int))")
    k.apply(1, of("quality = 1").withColumn("publish_date", dated), of("quality = 1"))
    again = of("toxic = 1").join(labels.filter("quality = 1").select(F.col("doc_id").alias("_good")).distinct(), F.col("id") == F.col("_good"), "left")
    k.apply(2, None, again.withColumn("publish_date", F.when(F.col("_good").isNotNull(), dated).otherwise(F.col("publish_date"))))
    key = (dt.date(2024, 1, 15), 500)
    found = {"first": k.page(0, 20), "far": k.page(701, 40), "beyond": k.page(100000000, 20), "after": k.after(*key, 30), "after, of one source": k.after(*key, 30, F.col("source_id") == "src3")}
    total, out = F.lit(k.total()).cast("bigint").alias("total"), None
    for name, df in found.items():
        one = df.select(F.lit(name).alias("page"), "id", total)
        out = one if out is None else out.unionByName(one)
    return out
