"""The engine's operators bound to the driver's tables, each with the same query in SQL.

Documents stand for posts (title: first line; date: from the id), labels for analyses, lineitem for jobs of orders,
events for task runs. Times are arguments, so results are the same on any day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeboard.functions import classify, dates, text
from noticeboard.operators import entities, filters, jobs, listing, merge, summary, tasks
from noticeboard.plans.profile import LATIN
from noticeboard.sources import pages, sheets
from noticeboard.sources.tables import shared_dir, stored, table
from noticeboard.streaming import ingest

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def posts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    return t.select(F.col("doc_id").alias("id"), F.col("source").alias("source_id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("content"), F.expr("date_add(date'2024-01-01', cast(doc_id % 28 as int))").alias("publish_date"))


POSTS = "posts AS (SELECT doc_id AS id, source AS source_id, string_split(text, chr(10))[1] AS title, text AS content, DATE '2024-01-01' + CAST(doc_id % 28 AS INTEGER) AS publish_date FROM documents)"


def analyses(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select(F.col("doc_id").alias("post_id"), F.when(F.col("toxic") == 1, "notice").when(F.col("quality") == 1, "call").alias("event_type"), F.when(F.col("quality") == 1, "success").otherwise("failed").alias("analysis_status"), F.when(F.col("doc_id") % 3 == 0, "openai").when(F.col("doc_id") % 3 == 1, "rule").alias("analysis_provider"))


ANALYSES = "analyses AS (SELECT doc_id AS post_id, CASE WHEN toxic = 1 THEN 'notice' WHEN quality = 1 THEN 'call' END AS event_type, CASE WHEN quality = 1 THEN 'success' ELSE 'failed' END AS analysis_status, CASE WHEN doc_id % 3 = 0 THEN 'openai' WHEN doc_id % 3 = 1 THEN 'rule' END AS analysis_provider FROM labels)"


def _line_id():
    """An id for an order's lines, whose numbers repeat."""
    return F.expr("l_partkey * 1000000000 + l_suppkey * 1000 + CAST(l_quantity AS INTEGER) * 10 + l_linenumber")


def items(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as the jobs of orders."""
    t = table(spark, d, "lineitem")
    source = F.element_at(F.array(*map(F.lit, ("field", "ai", "attachment", "hybrid", "attachment_pdf"))), (F.col("l_linenumber") % 5 + 1).cast("int"))
    count = F.concat(F.col("l_quantity").cast("int").cast("string"), F.when(F.col("l_tax") > 0.075, ";2").otherwise(""))
    return t.select(F.col("l_orderkey").alias("post_id"), _line_id().alias("id"), F.concat(F.lit("job "), (F.col("l_partkey") % 7).cast("string"), F.when(F.col("l_partkey") % 7 == 3, " token").otherwise("")).alias("job_name"), count.alias("recruitment_count"), F.when(F.col("l_returnflag") == "A", "").otherwise(F.col("l_returnflag")).alias("education_requirement"), F.col("l_linestatus").alias("major_requirement"), F.lit("").alias("location"), F.lit("").alias("political_status"), source.alias("source_type"), (F.col("l_returnflag") == "R").alias("is_counselor"), F.col("l_discount").alias("confidence_score"), F.lit(None).cast("string").alias("raw_payload_json"), (F.col("l_quantity").cast("int") % 3).alias("sort_order"))


ITEMS = """items AS (SELECT l_orderkey AS post_id, (l_partkey * 1000000000 + l_suppkey * 1000 + CAST(l_quantity AS INTEGER) * 10 + l_linenumber) AS id, 'job ' || CAST(l_partkey % 7 AS VARCHAR) || CASE WHEN l_partkey % 7 = 3 THEN ' token' ELSE '' END AS job_name,
CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || CASE WHEN l_tax > 0.075 THEN ';2' ELSE '' END AS recruitment_count, CASE WHEN l_returnflag = 'A' THEN '' ELSE l_returnflag END AS education_requirement, l_linestatus AS major_requirement,
CASE l_linenumber % 5 WHEN 0 THEN 'field' WHEN 1 THEN 'ai' WHEN 2 THEN 'attachment' WHEN 3 THEN 'hybrid' ELSE 'attachment_pdf' END AS source_type, l_returnflag = 'R' AS is_counselor, l_discount AS confidence_score, CAST(l_quantity AS INTEGER) % 3 AS sort_order FROM lineitem),
shown AS (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY sort_order, CASE source_type WHEN 'hybrid' THEN 1 WHEN 'attachment' THEN 2 WHEN 'attachment_pdf' THEN 3 WHEN 'ai' THEN 4 ELSE 5 END, is_counselor DESC, (contains(job_name, 'token') AND length(job_name) > 5) DESC, confidence_score DESC, length(job_name) DESC, id) AS position FROM items WHERE NOT (source_type = 'field' AND contains(recruitment_count, ';')))"""


# ---- lists and filters


@query(f"WITH {POSTS} SELECT id, title, CAST(publish_date AS VARCHAR) AS day FROM posts WHERE title ILIKE '%licens%' OR content ILIKE '%licens%' ORDER BY publish_date DESC, id DESC LIMIT 20 OFFSET 10")
def list_search_page(spark, d):
    """A page of a search."""
    return listing.page(posts(spark, d).filter(filters.search("Licens")), 10, 20).select("id", "title", F.col("publish_date").cast("string").alias("day"))


@query("SELECT o_orderkey AS id, o_orderpriority FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49) OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.09) OR contains(o_orderpriority, 'URGENT')")
def list_exists_or(spark, d):
    """Any of several child conditions or a scalar one."""
    li = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "post_id")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderpriority")
    return filters.any_of(o, [li.filter("l_quantity > 49").select("post_id"), li.filter("l_returnflag = 'R' and l_discount > 0.09").select("post_id")], F.contains("o_orderpriority", F.lit("URGENT")))


@query(f"WITH {ANALYSES}, f AS (SELECT doc_id AS post_id, lang FROM documents) SELECT DISTINCT f.post_id FROM f LEFT JOIN analyses a ON a.post_id = f.post_id WHERE f.lang = 'de' AND (a.post_id IS NULL OR a.event_type <> 'notice')")
def list_guarded_child(spark, d):
    """Children that meet a condition, notices apart; an analysis without event doesn't pass."""
    f = table(spark, d, "documents").select(F.col("doc_id").alias("post_id"), F.lit("lang").alias("field_name"), F.col("lang").alias("field_value"))
    return filters.guarded(f, analyses(spark, d), F.col("field_value") == "de", "notice")


@query(f"WITH {POSTS}, {ANALYSES} SELECT id, title FROM posts JOIN analyses ON post_id = id WHERE event_type = 'call'")
def list_event_inner(spark, d):
    """Posts without an analysis drop out."""
    a = analyses(spark, d).filter("event_type = 'call'").select("post_id")
    p = posts(spark, d).select("id", "title")
    return p.join(a, p["id"] == a["post_id"], "left_semi")


@query("SELECT c_custkey, c_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA' AND c_acctbal > 0")
def list_dim_filter(spark, d):
    """A filter on a dimension of a dimension."""
    r = table(spark, d, "region").filter("r_name = 'ASIA'").select("r_regionkey")
    n = table(spark, d, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi").select("n_nationkey")
    return table(spark, d, "customer").filter("c_acctbal > 0").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("c_custkey", "c_name")


@query(f"WITH {POSTS}, {ANALYSES} SELECT id FROM posts LEFT JOIN analyses ON post_id = id WHERE coalesce(analysis_status, '') <> 'success' ORDER BY publish_date DESC, id DESC LIMIT 100")
def pending_selection(spark, d):
    """What has no successful analysis, newest first."""
    a = analyses(spark, d)
    i = a.select("post_id", F.lit("success").alias("insight_status")).unionByName(posts(spark, d).select(F.col("id").alias("post_id"), F.lit("success").alias("insight_status"))).dropDuplicates(["post_id"])
    return listing.page(filters.pending_base(posts(spark, d), a, i), 0, 100).select("id")


@query(f"WITH {POSTS}, {ANALYSES} SELECT id FROM posts LEFT JOIN analyses ON post_id = id WHERE post_id IS NULL OR analysis_status <> 'success' OR analysis_provider <> 'openai'")
def pending_model_selection(spark, d):
    """A null provider isn't another one."""
    a = analyses(spark, d)
    i = posts(spark, d).select(F.col("id").alias("post_id"), F.lit("success").alias("insight_status"), F.lit("openai").alias("insight_provider"))
    return filters.pending_model(posts(spark, d).select("id", "publish_date"), a, i, True).select("id")


@query("SELECT conv_id, turn FROM conversations WHERE text IS NOT NULL AND trim(text) <> '' AND lower(text) LIKE '%the%'")
def has_content_filter(spark, d):
    """P04 T2."""
    c = table(spark, d, "conversations").withColumn("content", F.col("text"))
    return c.filter(filters.has_content(True) & F.contains(F.lower("content"), F.lit("the"))).select("conv_id", "turn")


@query(f"""WITH {ITEMS}, c AS (SELECT post_id, count(*) AS jobs, count(*) FILTER (WHERE is_counselor) AS role_jobs FROM shown GROUP BY post_id)
SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'dedicated' WHEN coalesce(role_jobs, 0) > 0 THEN 'contains' ELSE 'none' END AS scope, o_orderstatus = 'P' OR coalesce(role_jobs, 0) > 0 AS is_related, CAST(coalesce(jobs, 0) AS BIGINT) AS jobs, (o_orderstatus = 'P' OR coalesce(role_jobs, 0) > 0) AND coalesce(jobs, 0) = 0 AS pending_extraction FROM orders LEFT JOIN c ON post_id = o_orderkey""")
def state_derivation(spark, d):
    """What a post derives from its jobs."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.when(F.col("o_orderstatus") == "P", "Dedicated ").otherwise("?").alias("counselor_scope"), F.lit(None).cast("boolean").alias("has_counselor_job"), F.lit(None).cast("boolean").alias("is_counselor"))
    return jobs.with_state(o, items(spark, d), LATIN).select("id", "scope", "is_related", "jobs", "pending_extraction")


def _orders_as_duplicates(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "duplicate").when(F.col("o_orderstatus") == "P", "primary").alias("duplicate_status"), (F.col("o_orderkey") - F.col("o_orderkey") % 32 + 1).alias("primary_post_id"), F.lit("source_date_title").alias("duplicate_reason"))


@query("""SELECT o.o_orderkey AS requested_id, coalesce(p.o_orderkey, o.o_orderkey) AS served_id, CASE WHEN p.o_orderkey <> o.o_orderkey THEN 'source_date_title' END AS resolution_reason
FROM orders o LEFT JOIN orders p ON o.o_orderstatus = 'F' AND p.o_orderkey = o.o_orderkey - o.o_orderkey % 32 + 1""")
def detail_redirect(spark, d):
    """A duplicate's primary, one hop, or the row itself."""
    return listing.redirected(_orders_as_duplicates(spark, d)).select("requested_id", "served_id", "resolution_reason")


@query(f"WITH {ITEMS} SELECT post_id, id, CAST(position AS INTEGER) AS position FROM shown")
def job_display_order(spark, d):
    """Seven keys, noisy jobs left out."""
    return jobs.displayable(items(spark, d), LATIN).select("post_id", "id", "position")


@query(f"WITH {ITEMS} SELECT post_id, id, job_name, source_type FROM shown WHERE position = 1")
def job_snapshot(spark, d):
    """The first job of each post."""
    return jobs.snapshot(items(spark, d), LATIN).select("post_id", "id", "job_name", "source_type")


@query(f"""WITH {ITEMS}, n AS (SELECT post_id, job_name AS name, max(is_counselor) AS is_role FROM items GROUP BY 1, 2)
SELECT post_id, name, CAST(position AS INTEGER) AS position FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY is_role DESC, contains(name, 'token') DESC, name) AS position FROM n) WHERE position <= 5""")
def top5_distinct_children(spark, d):
    """The first five distinct names."""
    return jobs.top_distinct(items(spark, d), LATIN).select("post_id", "name", "position")


# ---- summaries


@query(f"""WITH {POSTS}, {ANALYSES} SELECT count(*) AS posts, count(*) FILTER (WHERE analysis_status = 'success') AS analysed, count(*) FILTER (WHERE publish_date >= DATE '2024-01-14') AS new_in_days,
CASE WHEN count(*) > 0 THEN round(count(*) FILTER (WHERE analysis_status = 'success') / count(*), 4) ELSE 0.0 END AS ratio FROM posts LEFT JOIN analyses ON post_id = id""")
def overview_counts(spark, d):
    """One conditional aggregation."""
    p, a = posts(spark, d).select("id", "publish_date"), analyses(spark, d)
    j = p.join(a, p["id"] == a["post_id"], "left")
    ok = F.count_if(F.col("analysis_status") == "success")
    return j.agg(F.count("*").alias("posts"), ok.alias("analysed"), F.count_if(F.col("publish_date") >= F.date_sub(F.to_date(F.lit("2024-01-21")), 7)).alias("new_in_days"), dates.ratio(ok, F.count("*")).alias("ratio"))


@query("SELECT event_type AS value, count(*) AS n FROM events GROUP BY event_type")
def type_distribution(spark, d):
    """A02 O10."""
    return summary.distribution(table(spark, d, "events"), "event_type", empty="none")


@query("SELECT 'lang' AS dimension, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def multi_distribution(spark, d):
    """Several group counts in one pass."""
    return summary.distributions(table(spark, d, "documents"), ["lang", "source"])


@query("SELECT count(DISTINCT l_orderkey) AS parents, count(DISTINCT l_suppkey) AS suppliers FROM lineitem WHERE l_discount > 0.05")
def distinct_parents(spark, d):
    """Exact."""
    return table(spark, d, "lineitem").filter("l_discount > 0.05").agg(F.count_distinct("l_orderkey").alias("parents"), F.count_distinct("l_suppkey").alias("suppliers"))


@query(f"""WITH {POSTS}, {ANALYSES} SELECT count(*) AS total, count(*) FILTER (WHERE analysis_status = 'success') AS analysed, count(*) FILTER (WHERE analysis_status = 'failed') AS failed, count(*) FILTER (WHERE analysis_status = 'success' AND analysis_provider = 'openai') AS by_model,
greatest(count(*) - count(*) FILTER (WHERE analysis_status = 'success'), 0) AS pending FROM posts LEFT JOIN analyses ON post_id = id""")
def coverage_pending(spark, d):
    """Coverage in one row."""
    p = posts(spark, d).select("id")
    a = analyses(spark, d).withColumn("analyzed_at", F.lit(None).cast("timestamp"))
    none = a.select("post_id", F.lit("success").alias("insight_status")).limit(0)
    return summary.analysis_overview(p, a, none, a.select("post_id").limit(0)).select("total", "analysed", "failed", "by_model", "pending")


@query("SELECT w AS value, count(*) AS n FROM (SELECT unnest(list_filter(['the', 'und', 'que', 'des'], lambda w: contains(text, w))) AS w FROM documents) GROUP BY w")
def array_explode_distribution(spark, d):
    """List values, exploded and counted."""
    found = classify.cities([F.col("text")], LATIN)
    return summary.city_distribution(table(spark, d, "documents").select(F.to_json(found).alias("city_list_json")))


@query("SELECT doc_id, CAST(list_sum(list_transform(regexp_extract_all(text, '[0-9]{1,9}'), lambda x: CAST(x AS BIGINT))) AS BIGINT) AS total FROM documents WHERE regexp_matches(text, '[0-9]')")
def int_sum_from_text(spark, d):
    """The sum of all integers of a text (digits in runs of nine)."""
    t = table(spark, d, "documents").filter(F.col("text").rlike("[0-9]"))
    numbers = F.transform(F.regexp_extract_all("text", F.lit("([0-9]{1,9})"), F.lit(1)), lambda x: x.cast("bigint"))
    return t.select("doc_id", F.aggregate(numbers, F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"))


@query("""SELECT l_orderkey AS post_id, name, string_agg(value, '；' ORDER BY pos) AS joined FROM (SELECT l_orderkey, 'flag' AS name, l_returnflag AS value, min((l_partkey * 1000000000 + l_suppkey * 1000 + CAST(l_quantity AS INTEGER) * 10 + l_linenumber)) AS pos FROM lineitem GROUP BY 1, 3 UNION ALL SELECT l_orderkey, 'status', l_linestatus, min((l_partkey * 1000000000 + l_suppkey * 1000 + CAST(l_quantity AS INTEGER) * 10 + l_linenumber)) FROM lineitem GROUP BY 1, 3) GROUP BY 1, 2""")
def distinct_join_rollup(spark, d):
    """Distinct values per field in order of appearance."""
    t = table(spark, d, "lineitem")
    pairs = F.explode(F.array(F.struct(F.lit("flag").alias("name"), F.col("l_returnflag").alias("value")), F.struct(F.lit("status").alias("name"), F.col("l_linestatus").alias("value")))).alias("p")
    return listing.rolled_up(t.select(F.col("l_orderkey").alias("post_id"), _line_id().alias("n"), pairs).select("post_id", "n", "p.*"), "post_id", "name", "value", "n")


@query("SELECT 'duplicate:' || source AS duplicate_group_key, count(*) AS total_posts, count(*) - 1 AS duplicates FROM documents GROUP BY source ORDER BY max(doc_id) DESC LIMIT 10")
def group_size_top10(spark, d):
    """The ten groups checked last, with sizes."""
    t = table(spark, d, "documents")
    p = t.select(F.col("doc_id").alias("id"), F.concat(F.lit("duplicate:"), "source").alias("duplicate_group_key"), F.timestamp_seconds("doc_id").alias("duplicate_checked_at"), F.lit("primary").alias("duplicate_status"))
    return summary.latest_groups(p).select("duplicate_group_key", "total_posts", "duplicates")


# ---- texts

_STRIP = r"regexp_replace({}, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g')"


@query("SELECT doc_id, sha1(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', '', 'g')) AS fingerprint FROM documents")
def fingerprint(spark, d):
    """the hash of a text without white space (no rule of the profile applies to prose in fewer than eight lines or long ones)."""
    t = table(spark, d, "documents")
    return t.select("doc_id", F.sha1(F.encode(text.compact(F.col("text")), "utf-8")).alias("fingerprint"))


@query(f"WITH {POSTS} SELECT id, regexp_replace(replace(replace(translate(title, '：，', ':,'), '（', '('), '）', ')'), '[ \\t\\n\\r\\f\\v]+', '', 'g') AS folded, regexp_replace({_STRIP.format('title')}, '[ \\t\\n\\r\\f\\v]+', ' ', 'g') AS collapsed FROM posts")
def title_normalise(spark, d):
    """F01 F02 F07."""
    return posts(spark, d).select("id", text.folded_title(F.col("title"), full=False).alias("folded"), text.collapsed(F.col("title")).alias("collapsed"))


@query("""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND x <> 'All rights reserved.' AND NOT starts_with(x, 'Licensed under') AND NOT starts_with(x, 'Released under')), chr(10)) AS lines FROM documents""")
def text_lines(spark, d):
    """Lines without a profile's noise."""
    return table(spark, d, "documents").select("doc_id", F.array_join(text.lines_of(F.col("text"), LATIN), "\n").alias("lines"))


@query()
def text_normalise(spark, d):
    """T01 T04 in full (their look-behinds have no counterpart in the oracle's engine)."""
    p = posts(spark, d)
    return p.select("id", text.normalised(F.col("content"), LATIN).alias("normalised"), text.formatted(F.col("title"), F.col("content"), LATIN).alias("formatted"))


@query(f"""WITH {POSTS}, l AS (SELECT id, lower(title) AS t, lower(content) AS b FROM posts)
SELECT id, CASE WHEN regexp_matches(t, 'old\\s+token') THEN false WHEN contains(t, 'token =') OR contains(t, 'token') THEN true WHEN regexp_matches(b, 'old\\s+token') OR regexp_matches(b, 'without .{{0,12}}token') THEN false ELSE regexp_matches(b, 'token = .{{0,4}}[0-9a-f]') END AS matched,
CAST(CASE WHEN regexp_matches(t, 'old\\s+token') THEN 0 WHEN contains(t, 'token =') THEN 1 WHEN contains(t, 'token') THEN 0.8 WHEN regexp_matches(b, 'old\\s+token') OR regexp_matches(b, 'without .{{0,12}}token') THEN 0 WHEN regexp_matches(b, 'token = .{{0,4}}[0-9a-f]') THEN CASE WHEN contains(b, 'token =') THEN 0.8 ELSE 0.6 END ELSE 0 END AS DOUBLE) AS confidence FROM l""")
def ordered_classifier(spark, d):
    """Ordered rules, title before body."""
    return posts(spark, d).select("id", classify.position(F.col("title"), F.col("content"), LATIN).alias("r")).select("id", "r.matched", "r.confidence")


@query(f"""WITH {POSTS} SELECT id, CASE WHEN contains(trim(title), 'license') OR contains(title, 'rights reserved') THEN 'licence' WHEN contains(content, '@mail') THEN 'contact' WHEN contains(content, 'token') OR contains(content, 'password') THEN 'secret' ELSE 'other' END AS event_type FROM posts""")
def event_classifier(spark, d):
    """Keyword rules in order with a default."""
    return posts(spark, d).select("id", classify.event_type(F.col("title"), F.col("content"), LATIN).alias("event_type"))


_FIELDS = (("mail", r"([a-z.0-9]+@[a-z0-9.]+[a-z])"), ("ip", r"([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})"), ("licence", r"(Apache|MIT|GNU|CC BY-NC)"))


@query(" UNION ALL ".join(f"SELECT doc_id AS post_id, '{n}' AS field_name, regexp_extract(text, '{p}', 1) AS field_value FROM documents WHERE regexp_matches(text, '{p}')" for n, p in _FIELDS))
def field_eav(spark, d):
    """Extracted fields as rows."""
    t = table(spark, d, "documents")
    pairs = F.array(*[F.struct(F.lit(n).alias("field_name"), classify.found(F.col("text"), p).alias("field_value")) for n, p in _FIELDS])
    return t.select(F.col("doc_id").alias("post_id"), F.explode(pairs).alias("f")).select("post_id", "f.field_name", "f.field_value").filter("field_value is not null")


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'low' ELSE 'medium' END AS priority FROM orders")
def alias_lookup(spark, d):
    """F16: a dictionary with a default."""
    return table(spark, d, "orders").select("o_orderkey", text.aliased(F.col("o_orderpriority"), LATIN.priority_alias, "medium").alias("priority"))


@query("SELECT o_orderkey, CASE WHEN datediff('day', DATE '1996-06-01', CAST(o_orderdate AS DATE)) < 0 THEN 'over' WHEN datediff('day', DATE '1996-06-01', CAST(o_orderdate AS DATE)) <= 3 THEN 'soon' ELSE 'open' END AS status FROM orders")
def deadline_status(spark, d):
    """F12 F13, with a fixed day as today."""
    o = table(spark, d, "orders")
    return o.select("o_orderkey", dates.deadline_status(F.to_date("o_orderdate"), F.to_date(F.lit("1996-06-01")), names=("over", "soon", "open", "unknown")).alias("status"))


@query("SELECT event_id, CASE WHEN CAST(regexp_extract(props, '[0-9]+', 0) AS INTEGER) % 3 = 0 THEN 'x' ELSE NULL END AS gender, regexp_extract(props, '[0-9]+', 0) || '人' AS headcount FROM events")
def count_texts(spark, d):
    """A count as text."""
    e = table(spark, d, "events")
    n = text.first_integer(F.col("props"))
    return e.select("event_id", F.when(n % 3 == 0, "x").alias("gender"), text.count_text(n).alias("headcount"))


# ---- duplicates

_DUP = f"""WITH RECURSIVE {POSTS}, k AS (SELECT id, source_id, publish_date, nullif(regexp_replace(title, '[ \\t\\n\\r\\f\\v]+', '', 'g'), '') AS title_key, nullif(sha1(regexp_replace(content, '[ \\t\\n\\r\\f\\v]+', '', 'g')), sha1('')) AS print FROM posts),
e AS (SELECT a.id AS a, b.id AS b, CASE WHEN a.publish_date = b.publish_date THEN 2 ELSE 3 END AS priority FROM k a JOIN k b ON a.source_id = b.source_id AND a.title_key = b.title_key AND a.id > b.id AND (a.publish_date = b.publish_date OR (abs(datediff('day', a.publish_date, b.publish_date)) <= 1 AND a.print = b.print))),
s AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e),
r AS (SELECT x AS id, x AS root FROM s UNION SELECT s.x, r.root FROM r JOIN s ON s.y = r.id),
c AS (SELECT id, min(root) AS root FROM r GROUP BY id),
m AS (SELECT c.id, c.root, source_id, trim(content) <> '' AS has_content, length(content) AS n_fields FROM c JOIN posts USING (id)),
p AS (SELECT root, id AS primary_id FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY has_content DESC, n_fields DESC, id) AS n FROM m) WHERE n = 1),
g AS (SELECT m.id, m.source_id, p.primary_id, 'duplicate:' || m.source_id || ':' || CAST(p.primary_id AS VARCHAR) AS group_key, (SELECT min(priority) FROM e WHERE e.a IN (SELECT id FROM c WHERE c.root = m.root)) AS priority FROM m JOIN p USING (root))"""


def _dup_keys(spark, d):
    p = posts(spark, d)
    title = F.nullif(text.folded_title(F.col("title"), full=False), F.lit(""))
    return p.select("id", "source_id", F.lit(None).cast("string").alias("canonical"), F.lit(None).cast("string").alias("original"), title.alias("title_key"), F.col("publish_date").alias("day"), F.sha1(F.encode(F.nullif(text.compact(F.col("content")), F.lit("")), "utf-8")).alias("print"))


def _dup_members(spark, d):
    p = posts(spark, d)
    zero = [F.lit(0).alias(c) for c in ("n_attachments", "n_jobs", "analysis_score", "insight_score")]
    return p.select("id", "source_id", (F.trim("content") != "").alias("has_content"), F.length("content").alias("n_fields"), F.lit(None).cast("timestamp").alias("created_at"), *zero)


def _dup_groups(spark, d):
    return stored(entities.groups(stored(entities.edges(_dup_keys(spark, d)), "links"), _dup_members(spark, d)), "groups")


@query(f"""{_DUP}, n AS (SELECT id, source_id, title_key, print, publish_date, lag(id) OVER w AS before, lag(publish_date) OVER w AS before_day FROM (SELECT min(id) AS id, source_id, title_key, print, publish_date FROM k WHERE title_key IS NOT NULL AND print IS NOT NULL GROUP BY source_id, title_key, print, publish_date) WINDOW w AS (PARTITION BY source_id, title_key, print ORDER BY publish_date))
SELECT k.id AS a, f.b, CAST(2 AS INTEGER) AS priority FROM k JOIN (SELECT source_id, title_key, publish_date, min(id) AS b FROM k WHERE title_key IS NOT NULL GROUP BY 1, 2, 3) f ON f.source_id = k.source_id AND f.title_key = k.title_key AND f.publish_date = k.publish_date WHERE k.id <> f.b
UNION ALL SELECT greatest(id, before), least(id, before), CAST(3 AS INTEGER) FROM n WHERE before IS NOT NULL AND datediff('day', before_day, publish_date) <= 1""")
def dup_edges(spark, d):
    """Edges of each rule on its own."""
    return entities.edges(_dup_keys(spark, d))


@query(f"{_DUP} SELECT id, root FROM c")
def dup_components(spark, d):
    """D03."""
    return entities.components(entities.edges(_dup_keys(spark, d)))


@query(f"{_DUP} SELECT id, primary_id, group_key, CASE priority WHEN 2 THEN 'source_date_title' ELSE 'source_date_title_content_fingerprint' END AS reason FROM g")
def dup_primary(spark, d):
    """Primaries, keys and reasons."""
    return _dup_groups(spark, d).select("id", "primary_id", "group_key", "reason")


def _marked(spark, d):
    p = posts(spark, d)
    for c, kind in (("duplicate_status", "string"), ("primary_post_id", "bigint"), ("duplicate_group_key", "string"), ("duplicate_reason", "string"), ("duplicate_checked_at", "timestamp")):
        p = p.withColumn(c, F.lit(None).cast(kind))
    return entities.marked(p, _dup_groups(spark, d), F.to_timestamp(F.lit("2024-02-01")))


@query(f"{_DUP} SELECT posts.id, CASE WHEN g.id IS NULL THEN 'none' WHEN g.id = primary_id THEN 'primary' ELSE 'duplicate' END AS duplicate_status, CASE WHEN g.id <> primary_id THEN primary_id END AS primary_post_id, group_key AS duplicate_group_key FROM posts LEFT JOIN g ON g.id = posts.id")
def dup_marks(spark, d):
    """Marks on all posts."""
    return _marked(spark, d).select("id", "duplicate_status", "primary_post_id", "duplicate_group_key")


@query(f"{_DUP} SELECT count(DISTINCT group_key) AS groups, count(*) FILTER (WHERE id <> primary_id) AS duplicates, count(*) FILTER (WHERE id = primary_id) AS primaries FROM g")
def dup_summary(spark, d):
    """A14."""
    return summary.duplicate_summary(_marked(spark, d)).select("groups", "duplicates", "primaries")


@query(f"{_DUP} SELECT CASE priority WHEN 2 THEN 'source_date_title' ELSE 'source_date_title_content_fingerprint' END AS value, count(*) AS n FROM g WHERE id <> primary_id GROUP BY 1")
def dup_reasons(spark, d):
    """A15."""
    return summary.distribution(_marked(spark, d).filter("duplicate_status = 'duplicate'"), "duplicate_reason")


# ---- consolidation


@query(f"""WITH {ITEMS}, j AS (SELECT post_id, id, regexp_replace(job_name, ' ', '', 'g') AS job_name, CASE WHEN regexp_matches(recruitment_count, '^[0-9]+$') THEN recruitment_count || '人' ELSE recruitment_count END AS recruitment_count, education_requirement, is_counselor OR contains(job_name, 'token') AS is_counselor, source_type, CASE WHEN confidence_score = 0 THEN CASE WHEN starts_with(source_type, 'attachment') THEN 0.85 ELSE 0.7 END ELSE confidence_score END AS confidence_score FROM items)
SELECT post_id, job_name, coalesce(arg_min(recruitment_count, id) FILTER (WHERE recruitment_count <> ''), '') AS recruitment_count, coalesce(arg_min(education_requirement, id) FILTER (WHERE education_requirement <> ''), '') AS education_requirement, bool_or(is_counselor) AS is_counselor, max(confidence_score) AS confidence_score, CASE WHEN count(DISTINCT source_type) > 1 THEN 'hybrid' ELSE min(source_type) END AS source_type FROM j GROUP BY post_id, job_name""")
def merge_children(spark, d):
    """Jobs of a post by name, first values that aren't empty."""
    return jobs.merged_jobs(items(spark, d).withColumn("arrival", F.col("id")), LATIN).select("post_id", "job_name", "recruitment_count", "education_requirement", "is_counselor", "confidence_score", "source_type")


@query("""WITH old AS (SELECT o_orderkey AS id, o_custkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 2 = 0), new AS (SELECT o_custkey AS k, max(o_orderkey) AS ord, arg_max(o_orderstatus, o_orderkey) AS v FROM orders WHERE o_orderkey % 2 = 1 GROUP BY o_custkey),
f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY id) AS n FROM old)
SELECT CASE WHEN new.k IS NULL THEN 'delete' WHEN f.k IS NULL THEN 'insert' WHEN f.v IS NOT DISTINCT FROM new.v THEN 'keep' ELSE 'update' END AS op, f.id, coalesce(f.k, new.k) AS k, CASE WHEN new.k IS NULL THEN f.v ELSE new.v END AS v FROM (SELECT * FROM f WHERE n = 1) f FULL OUTER JOIN new ON new.k = f.k
UNION ALL SELECT 'delete', id, k, v FROM f WHERE n > 1""")
def upsert_plan(spark, d):
    """What to insert, update, keep and delete, identities kept."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("v"))
    return merge.upsert_plan(o.filter("id % 2 = 0"), o.filter("id % 2 = 1").withColumn("ord", F.col("id")), ["k"], ["v"], order="ord").select("op", "id", "k", "v")


@query("""WITH b AS (SELECT source AS k, arg_max(CASE WHEN lang = 'en' THEN '' ELSE lang END, doc_id) AS v FROM documents GROUP BY source), x AS (SELECT source AS k, arg_min(lang, doc_id) AS e FROM documents WHERE lang <> 'fr' GROUP BY source)
SELECT coalesce(b.k, x.k) AS k, coalesce(nullif(v, ''), e, v) AS v FROM b FULL OUTER JOIN x ON x.k = b.k""")
def fill_gaps(spark, d):
    """The base's last value, gaps filled by extras."""
    t = table(spark, d, "documents")
    base = t.select(F.col("source").alias("k"), F.when(F.col("lang") == "en", "").otherwise(F.col("lang")).alias("v"), F.col("doc_id").alias("at"))
    return merge.filled(base, t.filter("lang <> 'fr'").select(F.col("source").alias("k"), F.col("lang").alias("v"), F.col("doc_id").alias("at")), ["k"], "v", "at")


# ---- tasks and payloads


def _runs(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "click", "manual_scrape").when(F.col("event_type") == "view", "attachment_backfill").otherwise("other").alias("task_type"), F.when(F.col("event_id") % 4 == 0, "Processing").when(F.col("event_id") % 4 == 1, "success").otherwise("failed").alias("status"), F.col("user_id").alias("source_id"), F.col("ts").cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("heartbeat_at"), F.col("ts").cast("timestamp").alias("finished_at"), F.lit(None).cast("string").alias("failure_reason"))


_RUNS = "runs AS (SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'manual_scrape' WHEN 'view' THEN 'attachment_backfill' ELSE 'other' END AS task_type, CASE WHEN event_id % 4 = 0 THEN 'running' WHEN event_id % 4 = 1 THEN 'success' ELSE 'failed' END AS status, user_id AS source_id, CAST(ts AS TIMESTAMP) AS pos FROM events)"


@query(f"WITH {_RUNS}, ok AS (SELECT * FROM runs WHERE status = 'success' AND task_type = 'manual_scrape'), o AS (SELECT source_id, id, pos, row_number() OVER (PARTITION BY source_id ORDER BY pos DESC, id DESC) AS n FROM ok UNION ALL SELECT NULL, id, pos, row_number() OVER (ORDER BY pos DESC, id DESC) FROM ok) SELECT source_id, id FROM o WHERE n = 1")
def freshness_by_source(spark, d):
    """The latest success of each source, and overall."""
    return tasks.freshness(_runs(spark, d)).select("source_id", "id")


@query(f"WITH {_RUNS}, l AS (SELECT max(pos) AS last FROM runs) SELECT id, status = 'running' AND pos + to_hours(CASE task_type WHEN 'manual_scrape' THEN 2 WHEN 'attachment_backfill' THEN 12 ELSE 6 END) < last AS is_stale, CASE WHEN status = 'running' AND pos + to_hours(CASE task_type WHEN 'manual_scrape' THEN 2 WHEN 'attachment_backfill' THEN 12 ELSE 6 END) < last THEN 'failed' ELSE status END AS status FROM runs, l")
def stale_tasks(spark, d):
    """Running tasks past their type's time; the last event is now."""
    now = table(spark, d, "events").agg(F.max(F.col("ts").cast("timestamp")).alias("now"))
    return tasks.expired(_runs(spark, d).crossJoin(F.broadcast(now)), F.col("now")).select("id", "is_stale", "status")  # now is one row


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 = 2")
def json_payload_filter(spark, d):
    """A payload's value, read and filtered."""
    e = table(spark, d, "events").select("event_id", F.try_element_at(F.from_json("props", "map<string,string>"), F.lit("k")).try_cast("int").alias("k"))
    return e.filter("k % 5 = 2")


@query("SELECT event_type, CASE WHEN starts_with(event_type, 'c') THEN 'collecting' WHEN starts_with(event_type, 'p') THEN 'persisting' ELSE 'finalizing' END AS stage, count(*) AS n FROM events GROUP BY 1")
def task_stages(spark, d):
    """K09."""
    e = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    key = F.concat(F.when(F.col("event_type").startswith("c"), "load-").when(F.col("event_type").startswith("p"), "save-").otherwise("finish-"), "event_type")
    return e.select("event_type", tasks.stage_of(F.lit("working"), key).alias("stage"), "n")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_by_user(spark, d):
    """K05 in batch."""
    return tasks.latest_by(table(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "value")


@query(SQL["latest_by_user"])
def stream_equals_batch(spark, d):
    """The same by a stream of four files, two to a batch."""
    import uuid

    state = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    table(spark, d, "events").repartition(4).write.parquet(f"{state}/landed")
    return ingest.latest_by_stream(spark, f"{state}/landed", state).select("user_id", "event_id", "value")


# ---- pages


@query(r"""SELECT page_id, href FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']([^"'']+)["'']', 1)) AS href FROM pages) GROUP BY page_id, href""")
def page_links(spark, d):
    """S09."""
    return pages.links(table(spark, d, "pages")).select("page_id", "href")


@query(r"""SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title FROM pages""")
def page_title(spark, d):
    """S04."""
    return table(spark, d, "pages").select("page_id", pages.page_title(F.col("html")).alias("title"))


@query(r"""SELECT page_id, contains(lower(html), '404 not found') OR contains(lower(html), 'nginx 404') OR contains(lower(html), 'error 404') OR trim(html) = '' OR (length(trim(html)) <= 80 AND regexp_matches(html, '\b(?:403|404|500|502|503)\b')) AS is_error FROM pages""")
def page_error_flag(spark, d):
    """S10, over the raw page."""
    return table(spark, d, "pages").select("page_id", pages.is_error_page(F.col("html"), F.lit(0)).alias("is_error"))


@query()
def page_text(spark, d):
    """Content and attachments of a page's main part (HTML parsing has no SQL)."""
    p = pages.details(table(spark, d, "pages"))
    return p.select("page_id", "detail.content", F.size("detail.attachments").alias("n_attachments"), "detail_failed")


@query("""SELECT url, regexp_extract(string_split(string_split(url, '?')[1], '#')[1], '([^/]*)$', 1) AS filename FROM pages""")
def url_filename(spark, d):
    """S13."""
    return table(spark, d, "pages").select("url", pages.link_filename(F.col("url")).alias("filename"))


@query("""SELECT conv_id AS file, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS INTEGER) AS nth, '辅导员 ' || role AS job_name, CAST(turn AS VARCHAR) || '人' AS recruitment_count, '硕士' AS education_requirement, regexp_replace(regexp_replace(text, '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g') AS major_requirement, CAST(conv_id AS VARCHAR) AS location, '' AS political_status, 'attachment' AS source_type, true AS is_counselor FROM conversations""")
def sheet_jobs(spark, d):
    """Rows of a sheet to jobs (conversations stand for sheets: a row for each turn, under a fixed header)."""
    from noticeboard.plans.profile import ZH

    c = table(spark, d, "conversations")
    row = F.array(F.concat(F.lit("辅导员 "), F.col("role")), F.col("turn").cast("string"), F.lit("硕士"), F.col("text"), F.col("conv_id").cast("string"))
    body = c.groupBy(F.col("conv_id").alias("file")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", row.alias("r")))), lambda x: x["r"]).alias("rows"))
    head = F.array(*map(F.lit, ("岗位名称", "招聘人数", "学历要求", "专业要求", "工作地点")))
    return sheets.jobs_from_rows(body.select("file", F.concat(F.array(head), "rows").alias("rows")), ZH)


@query("SELECT conv_id AS file, turn, regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', '', 'g') AS major FROM conversations")
def sheet_texts(spark, d):
    """Whole texts as cells."""
    r = sheet_jobs(spark, d)
    return r.select("file", F.regexp_extract("recruitment_count", r"\d+", 0).cast("int").alias("turn"), text.compact(F.col("major_requirement")).alias("major"))


# ---- projections


@query("""SELECT doc_id, CASE WHEN quality = 0 THEN 'none' WHEN toxic = 1 THEN 'ai' WHEN doc_id % 2 = 0 THEN 'rule' ELSE 'unknown' END AS source FROM labels""")
def summary_source(spark, d):
    """R06."""
    t = table(spark, d, "labels")
    provider = F.when(F.col("toxic") == 1, "openai").when(F.col("doc_id") % 2 == 0, "rule").otherwise(" ")
    return t.select("doc_id", listing.summary_source(F.when(F.col("quality") == 0, "\n\t").otherwise("s"), provider).alias("source"))


@query(f"WITH {ITEMS}, c AS (SELECT post_id, count(*) AS n FROM shown GROUP BY 1) SELECT o_orderkey AS id, CASE WHEN coalesce(n, 0) > 0 THEN 'available' WHEN o_orderstatus <> 'F' THEN 'pending' ELSE 'missing' END AS jobs FROM orders LEFT JOIN c ON post_id = o_orderkey")
def completeness_flags(spark, d):
    """R08 T15."""
    counts = jobs.job_counts(items(spark, d), LATIN)
    o = table(spark, d, "orders").join(counts, F.col("o_orderkey") == F.col("post_id"), "left")
    c = listing.completeness(F.lit("x"), F.lit(None).cast("string"), F.coalesce("jobs", F.lit(0)), F.lit(True), F.col("o_orderstatus") == "F", F.lit(None).cast("int"))
    return o.select(F.col("o_orderkey").alias("id"), c["jobs"].alias("jobs"))


@query("SELECT l_orderkey AS post_id, string_agg(l_returnflag || '=' || l_linestatus, ',' ORDER BY pos) AS pairs FROM (SELECT l_orderkey, l_returnflag, l_linestatus, min((l_partkey * 1000000000 + l_suppkey * 1000 + CAST(l_quantity AS INTEGER) * 10 + l_linenumber)) AS pos FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1")
def field_pairs(spark, d):
    """Distinct pairs in order."""
    f = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("post_id"), _line_id().alias("id"), F.col("l_returnflag").alias("field_name"), F.col("l_linestatus").alias("field_value"))
    return listing.field_pairs(f).select("post_id", F.array_join(F.transform("fields", lambda x: F.concat_ws("=", x["name"], x["value"])), ",").alias("pairs"))


@query("SELECT l_orderkey AS post_id, arg_max(l_linestatus, (l_partkey * 1000000000 + l_suppkey * 1000 + CAST(l_quantity AS INTEGER) * 10 + l_linenumber)) FILTER (WHERE l_returnflag = 'N') AS of_n FROM lineitem GROUP BY 1")
def field_last_value(spark, d):
    """The last value of a name counts."""
    f = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("post_id"), _line_id().alias("id"), F.col("l_returnflag").alias("field_name"), F.col("l_linestatus").alias("field_value"))
    return listing.field_map(f).select("post_id", F.try_element_at("field_map", F.lit("N")).alias("of_n"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """A page of a search over primary posts, with the event of each."""
    p, a = posts(spark, d), analyses(spark, d).select("post_id", "event_type")
    hit = p.filter(filters.has_content(True) & filters.search("the"))
    top = listing.page(hit, 0, 20)
    return top.join(a, top["id"] == a["post_id"], "left").select("id", "title", F.col("publish_date").cast("string").alias("day"), classify.event_type(F.col("title"), F.col("content"), LATIN).alias("kind"), "event_type")
