"""Summaries: each is one conditional aggregation over posts with their state, or one group count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeboard.functions.dates import ratio
from noticeboard.functions.text import integers, string_list

UNKNOWN = "未说明"


def public_summary(state: DataFrame, analyses: DataFrame, attachments: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """One row. state: filtered posts with jobs.with_state's columns."""
    a = analyses.select(F.col("post_id").alias("_a"), "analysis_status")
    t = attachments.select(F.col("post_id").alias("_t")).distinct()
    df = state.join(a, state["id"] == a["_a"], "left").join(t, state["id"] == t["_t"], "left")
    out = df.agg(
        F.count("*").alias("posts"),
        F.count_if("is_related").alias("related"),
        F.count_if(F.col("scope") == "dedicated").alias("dedicated"),
        F.count_if(F.col("scope") == "contains").alias("contains"),
        F.count_if(F.col("analysis_status") == "success").alias("analysed"),
        F.count_if(F.col("_t").isNotNull()).alias("attachment_posts"),
        F.count_if(F.col("jobs") > 0).alias("posts_with_jobs"),
        F.coalesce(F.sum("jobs"), F.lit(0)).alias("jobs"),
        F.count_if(F.col("publish_date") >= F.date_sub(now, days)).alias("new_in_days"),
    )
    return out.withColumn("attachment_ratio", ratio(F.col("attachment_posts"), F.col("posts")))


def scope_totals(state: DataFrame) -> DataFrame:
    """All scopes in one pass."""
    return state.agg(F.count("*").alias("all"), F.count_if("is_related").alias("any"), F.count_if(F.col("is_related") & (F.col("scope") == "dedicated")).alias("dedicated"), F.count_if(F.col("has_role_job") & (F.col("scope") == "contains")).alias("contains"))


def distribution(df: DataFrame, column: str, *, empty: str | None = None, without: tuple[str, ...] = ()) -> DataFrame:
    """Value, n: most frequent first, ties by value. empty: what stands for null and ''; else those don't count."""
    v = F.nullif(F.col(column), F.lit(""))
    out = df.select((F.coalesce(v, F.lit(empty)) if empty else v).alias("value")).filter("value is not null")
    out = out.filter(~F.col("value").isin(*without)) if without else out
    return out.groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def distributions(df: DataFrame, columns: list[str]) -> DataFrame:
    """Several in one pass by grouping sets: dimension, value, n."""
    named = df.select([F.nullif(F.col(c), F.lit("")).alias(c) for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in columns]))
    return named.select(pairs.alias("p")).select("p.*").filter("value is not null").groupBy("dimension", "value").agg(F.count("*").alias("n"))


def analysis_overview(posts: DataFrame, analyses: DataFrame, insights: DataFrame, attachments: DataFrame) -> DataFrame:
    """One row over primary posts."""
    a = analyses.select(F.col("post_id").alias("_a"), "analysis_status", "analysis_provider", "analyzed_at")
    i = insights.select(F.col("post_id").alias("_i"), "insight_status")
    t = attachments.select(F.col("post_id").alias("_t")).distinct()
    df = posts.join(a, posts["id"] == a["_a"], "left").join(i, posts["id"] == i["_i"], "left").join(t, posts["id"] == t["_t"], "left")
    ok, insight_ok = F.col("analysis_status") == "success", F.col("insight_status") == "success"
    out = df.agg(F.count("*").alias("total"), F.count_if(ok).alias("analysed"), F.count_if(F.col("analysis_status") == "failed").alias("failed"), F.count_if(F.col("analysis_status") == "skipped").alias("skipped"), F.count_if(ok & (F.col("analysis_provider") == "openai")).alias("by_model"), F.count_if(ok & (F.col("analysis_provider") == "rule")).alias("by_rule"), F.count_if(F.col("_t").isNotNull()).alias("with_attachments"), F.count_if(ok & insight_ok).alias("base_ready"), F.max("analyzed_at").alias("latest"))
    return out.withColumn("pending", F.greatest(F.col("total") - F.col("analysed"), F.lit(0)))


def insight_overview(posts: DataFrame, insights: DataFrame) -> DataFrame:
    """One row over primary posts."""
    df = posts.select("id").join(insights.drop("id").withColumnRenamed("post_id", "_i"), F.col("id") == F.col("_i"), "left")
    ok = F.col("insight_status") == "success"
    dated = (F.col("deadline_date").isNotNull() | F.col("deadline_text").isNotNull()) & (F.col("deadline_date").isNotNull() | (F.col("deadline_text") != ""))
    out = df.agg(F.count("*").alias("total"), F.count_if(ok).alias("success"), F.count_if(F.col("insight_status") == "failed").alias("failed"), F.count_if(F.col("insight_status") == "skipped").alias("skipped"), F.count_if(ok & (F.col("insight_provider") == "openai")).alias("by_model"), F.count_if(ok & (F.col("insight_provider") == "rule")).alias("by_rule"), F.count_if(ok & dated).alias("with_deadline"), F.count_if(ok & F.col("has_written_exam")).alias("with_exam"), F.count_if(ok & F.col("has_interview")).alias("with_interview"), F.count_if(ok & F.col("has_attachment_job_table")).alias("with_table"), F.max("analyzed_at").alias("latest"))
    return out.withColumn("pending", F.greatest(F.col("total") - F.col("success") - F.col("failed") - F.col("skipped"), F.lit(0)))


def city_distribution(insights: DataFrame, column: str = "city_list_json") -> DataFrame:
    """A10: each city of a row's JSON list counts once for each time it is listed."""
    return distribution(insights.select(F.explode(string_list(F.col(column))).alias("city")), "city")


def job_index_summary(state: DataFrame) -> DataFrame:
    """Over primary posts."""
    return state.agg(F.coalesce(F.sum("jobs"), F.lit(0)).alias("jobs"), F.coalesce(F.sum("role_jobs"), F.lit(0)).alias("role_jobs"), F.count_if(F.col("jobs") > 0).alias("posts_with_jobs"), F.count_if("pending_extraction").alias("pending"), F.count_if(F.col("scope") == "dedicated").alias("dedicated"), F.count_if(F.col("scope") == "contains").alias("contains"), F.count_if("has_ai_jobs").alias("ai_posts"), F.count_if("has_attachment_jobs").alias("attachment_posts"))


def duplicate_summary(posts: DataFrame) -> DataFrame:
    """A14."""
    s = F.coalesce("duplicate_status", F.lit("none"))
    return posts.agg(F.count_distinct(F.nullif("duplicate_group_key", F.lit(""))).alias("groups"), F.count_if(s == "duplicate").alias("duplicates"), F.count_if(s == "primary").alias("primaries"), F.count_if(F.col("duplicate_checked_at").isNull()).alias("unchecked"), F.max("duplicate_checked_at").alias("latest_check"))


def latest_groups(posts: DataFrame, n: int = 10) -> DataFrame:
    """The groups checked last, with their sizes, from one aggregation."""
    g = posts.filter("duplicate_group_key is not null and duplicate_group_key <> ''").groupBy("duplicate_group_key")
    out = g.agg(F.count("*").alias("total_posts"), (F.count("*") - 1).alias("duplicates"), F.max("duplicate_checked_at").alias("checked_at"), F.min(F.when(F.col("duplicate_status") == "primary", F.col("id"))).alias("primary_id"))
    return out.orderBy(F.col("checked_at").desc_nulls_last(), F.col("primary_id").desc_nulls_last()).limit(n)


def headcounts(jobs: DataFrame, fields: DataFrame, name: str = "招聘人数") -> DataFrame:
    """post_id, total, role_total: the sum of all integers of the jobs' count texts; where jobs have none, that of the field of this name."""
    add = lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda s, x: s + x)
    numbers = integers(F.col("recruitment_count"))
    j = jobs.select("post_id", add(numbers).alias("n"), (F.size(numbers) > 0).alias("any"), F.coalesce("is_counselor", F.lit(False)).alias("role")).filter("any")
    j = j.groupBy("post_id").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("role"), F.col("n"))).alias("role_total"))
    f = fields.filter(F.col("field_name") == name).groupBy("post_id").agg(F.max_by("field_value", "id").alias("v"))
    f = f.select(F.col("post_id").alias("_f"), F.when(F.size(integers(F.col("v"))) > 0, add(integers(F.col("v")))).alias("field_total"))
    both = j.join(f, j["post_id"] == f["_f"], "full_outer")
    return both.select(F.coalesce("post_id", "_f").alias("post_id"), F.coalesce("total", "field_total").alias("total"), F.when(F.col("total").isNull(), F.col("field_total")).otherwise(F.col("role_total")).alias("role_total")).filter("total is not null")


def headcount_text(c: Column) -> Column:
    """The sum where every part of the text has one integer and no range; else the text."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[；;]"), lambda x: F.trim(x)), lambda x: x != "")
    plain = F.forall(parts, lambda x: (F.size(F.regexp_extract_all(x, F.lit(r"(\d+)"), F.lit(1))) == 1) & ~x.rlike("[-~—至到以上下若干]"))
    total = F.aggregate(parts, F.lit(0).cast("bigint"), lambda s, x: s + F.coalesce(F.regexp_extract(x, r"\d+", 0).try_cast("bigint"), F.lit(0)))
    return F.when((F.size(parts) > 0) & plain, F.concat(total.cast("string"), F.lit("人"))).otherwise(c)
