"""List and detail projections, order and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeboard.functions.text import blank, formatted
from noticeboard.plans.profile import RuleProfile

HIDDEN_OF_NOTICES = ("岗位名称", "招聘人数", "学历要求", "专业要求", "工作地点")


def page(df: DataFrame, skip: int = 0, limit: int = 20, date: str = "publish_date", key: str = "id") -> DataFrame:
    """Newest first, ties by greater id, a page of it. Predicates come before; Spark keeps a top-k, no full sort."""
    return df.orderBy(F.col(date).desc_nulls_last(), F.col(key).desc()).offset(skip).limit(limit)


def field_pairs(fields: DataFrame) -> DataFrame:
    """Distinct (name, value) pairs of a post in order of first appearance."""
    first = fields.groupBy("post_id", "field_name", "field_value").agg(F.min("id").alias("id"))
    return first.groupBy("post_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "field_name", "field_value"))), lambda x: F.struct(x["field_name"].alias("name"), x["field_value"].alias("value"))).alias("fields"))


def field_map(fields: DataFrame) -> DataFrame:
    """Name -> last value."""
    last = fields.filter("field_name is not null and field_value is not null").groupBy("post_id", "field_name").agg(F.max_by("field_value", "id").alias("v"))
    return last.groupBy("post_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field_name", "v")))).alias("field_map"))


def shown_fields(fields: DataFrame, analyses: DataFrame, p: RuleProfile) -> DataFrame:
    """Of notices, the fields that their tables spoil are hidden."""
    a = analyses.select(F.col("post_id").alias("_a"), (F.col("event_type") == p.notice_event).alias("_notice"))
    return fields.join(a, fields["post_id"] == a["_a"], "left").filter(~(F.coalesce("_notice", F.lit(False)) & F.col("field_name").isin(*HIDDEN_OF_NOTICES))).drop("_a", "_notice")


def summary_source(summary: Column, provider: Column) -> Column:
    """R06."""
    return F.when(blank(summary), "none").when(provider == "openai", "ai").when(provider == "rule", "rule").when(blank(provider), "unknown").otherwise(provider)


def job_sources(jobs_in_order: Column) -> Column:
    """Distinct origins in display order."""
    return F.array_distinct(F.filter(F.transform(jobs_in_order, lambda j: j["source_type"]), lambda s: s.isNotNull() & (s != "")))


def completeness(content: Column, summary: Column, jobs: Column, pending: Column, is_notice: Column, attachments: Column) -> Column:
    """R08. attachments: how many, or null where they weren't read."""
    return F.struct(
        F.when(blank(content), "missing").otherwise("available").alias("content"),
        F.when(blank(summary), "missing").otherwise("available").alias("summary"),
        F.when(jobs > 0, "available").when(F.coalesce(pending, F.lit(False)) & ~F.coalesce(is_notice, F.lit(False)), "pending").otherwise("missing").alias("jobs"),
        F.when(attachments.isNull(), "unknown").when(attachments > 0, "available").otherwise("missing").alias("attachments"),
    )


def attachment_status(parsable: Column, downloaded: Column, parsed: Column) -> Column:
    """R10."""
    return F.when(~F.coalesce(downloaded, F.lit(False)), "待下载").when(F.coalesce(parsed, F.lit(False)), "已解析").when(F.coalesce(parsable, F.lit(False)), "待解析").otherwise("无需解析")


def redirected(posts: DataFrame) -> DataFrame:
    """Requested id, id served (a duplicate's primary, one hop, if it is there) and why."""
    served = posts.select(F.col("id").alias("_served"))
    dup = F.when(F.col("duplicate_status") == "duplicate", F.col("primary_post_id"))
    j = posts.withColumn("_to", dup).join(served, F.col("_to") == served["_served"], "left")
    moved = F.col("_served").isNotNull() & (F.col("_served") != F.col("id"))
    return j.select(F.col("id").alias("requested_id"), F.coalesce("_served", "id").alias("served_id"), F.when(moved, F.col("duplicate_reason")).alias("resolution_reason"), moved.alias("redirected"))


def rolled_up(rows: DataFrame, by: str, name: str, value: str, arrival: str, separator: str = "；") -> DataFrame:
    """Distinct values per field in order of first appearance, joined."""
    first = rows.filter(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(by, name, value).agg(F.min(arrival).alias("_at"))
    return first.groupBy(by, name).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", value))), lambda x: x[value]), separator).alias("joined"))


def first_by(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_n = 1").drop("_n")


def provenance(summary: Column, sources: Column, attachments: Column, resolution: Column) -> Column:
    """Where a record's parts come from."""
    return F.struct(summary.alias("summary_source"), sources.alias("job_sources"), attachments.alias("attachment_count"), resolution.alias("duplicate_resolution"))


def list_item(posts: DataFrame, sources: DataFrame, analyses: DataFrame, fields: DataFrame, jobs_in_order: DataFrame | None = None) -> DataFrame:
    """A list row with its source, analysis, fields, completeness and provenance nested.

    posts has jobs.with_state's columns where completeness is to know of jobs; jobs_in_order (jobs.displayable) gives
    the snapshot and the origins.
    """
    s = sources.select(F.col("id").alias("_s"), F.struct("id", "name", "province").alias("source"))
    a = analyses.select(F.col("post_id").alias("_a"), F.struct("event_type", "recruitment_stage", "tracking_priority", "summary").alias("analysis"), summary_source(F.col("summary"), F.col("analysis_provider")).alias("summary_source"))
    f = field_pairs(fields).withColumnRenamed("post_id", "_f")
    j = posts.join(s, posts["source_id"] == s["_s"], "left").join(a, posts["id"] == a["_a"], "left").join(f, posts["id"] == f["_f"], "left")
    if jobs_in_order is not None:
        g = jobs_in_order.groupBy(F.col("post_id").alias("_j")).agg(F.array_sort(F.collect_list(F.struct("position", "source_type", "job_name"))).alias("_jobs"))
        j = j.join(g, F.col("id") == F.col("_j"), "left").drop("_j")
    else:
        j = j.withColumn("_jobs", F.array().cast("array<struct<position:int,source_type:string,job_name:string>>"))
    none = F.lit(None).cast("int")
    shown = F.coalesce("_jobs", F.array().cast(j.schema["_jobs"].dataType))
    pending = F.col("pending_extraction") if "pending_extraction" in posts.columns else F.lit(False)
    out = j.withColumn("summary_source", F.coalesce("summary_source", F.lit("none"))).withColumn("job_snapshot", F.get(shown, F.lit(0))["job_name"])
    out = out.withColumn("record_completeness", completeness(F.col("content"), F.col("analysis.summary"), F.size(shown), pending, F.col("analysis.event_type") == notice_event(posts), none))
    out = out.withColumn("record_provenance", provenance(F.col("summary_source"), job_sources(shown), none, F.lit(None).cast("string")))
    return out.drop("_s", "_a", "_f", "_jobs")


def notice_event(posts: DataFrame) -> Column:
    """The event that a list's `notice_event` column names, if it has one."""
    return F.col("notice_event") if "notice_event" in posts.columns else F.lit(None).cast("string")


PARSABLE = ("pdf", "xls", "xlsx")


def shown_attachments(attachments: DataFrame, results: DataFrame) -> DataFrame:
    """Attachments with their status and how many fields their files gave. results: file, fields, parser, text_length, is_stale (sheets.stale), by attachments' local_path."""
    r = results.select(F.col("file").alias("_file"), "parser", "text_length", F.coalesce(F.size("fields"), F.lit(0)).alias("_fields"), F.coalesce("is_stale", F.lit(False)).alias("_stale"))
    j = attachments.join(r, attachments["local_path"] == r["_file"], "left")
    there = F.coalesce("is_downloaded", F.lit(False)) & F.coalesce(F.col("local_path") != "", F.lit(False))
    parsed, kind = F.col("_file").isNotNull() & ~F.col("_stale"), F.lower(F.coalesce("file_type", F.lit("")))
    fields = F.when(there & (parsed | kind.isin(*PARSABLE)), F.coalesce("_fields", F.lit(0))).otherwise(0)
    out = j.withColumns({"is_excel": kind.isin("xls", "xlsx"), "is_parseable": kind.isin(*PARSABLE), "parse_status": attachment_status(kind.isin(*PARSABLE), there, parsed), "parsed_fields_count": fields})
    return out.drop("_file", "_fields", "_stale")


def detail(posts: DataFrame, sources: DataFrame, analyses: DataFrame, fields: DataFrame, jobs_in_order: DataFrame, attachments: DataFrame, p: RuleProfile) -> DataFrame:
    """One row per post with everything nested: cleaned content, source, analysis, fields, all jobs to show in order, attachments with their status (shown_attachments), completeness and provenance.

    posts: with_state's columns. Children are aggregated by post once each and joined on the post's id.
    """
    s = sources.select(F.col("id").alias("_s"), F.struct("id", "name", "province").alias("source"))
    a = analyses.select(F.col("post_id").alias("_a"), F.struct("event_type", "recruitment_stage", "tracking_priority", "summary").alias("analysis"), summary_source(F.col("summary"), F.col("analysis_provider")).alias("_summary"), (F.col("event_type") == p.notice_event).alias("_notice"))
    f = field_pairs(shown_fields(fields, analyses, p)).withColumnRenamed("post_id", "_f")
    job = F.struct("position", "id", "job_name", "recruitment_count", "education_requirement", "major_requirement", "location", "political_status", "source_type", "is_counselor", "confidence_score")
    j = jobs_in_order.groupBy(F.col("post_id").alias("_j")).agg(F.array_sort(F.collect_list(job)).alias("job_items"))
    local = F.element_at(F.split(F.coalesce("local_path", F.lit("")), "/"), -1)
    file = F.struct("id", "filename", "file_url", "file_type", "file_size", "is_downloaded", F.nullif(local, F.lit("")).alias("local_filename"), "parse_status", "parsed_fields_count")
    t = attachments.groupBy(F.col("post_id").alias("_t")).agg(F.array_sort(F.collect_list(file)).alias("attachments"))
    df = posts.join(s, posts["source_id"] == s["_s"], "left").drop("_s")
    for child, key in ((a, "_a"), (f, "_f"), (j, "_j"), (t, "_t")):
        df = df.join(child, F.col("id") == F.col(key), "left").drop(key)
    for name in ("job_items", "attachments", "fields"):
        df = df.withColumn(name, F.coalesce(name, F.array().cast(df.schema[name].dataType)))
    done = completeness(F.col("content"), F.col("analysis.summary"), F.size("job_items"), F.col("pending_extraction"), F.coalesce("_notice", F.lit(False)), F.size("attachments"))
    came = provenance(F.coalesce("_summary", F.lit("none")), job_sources(F.col("job_items")), F.size("attachments"), F.lit(None).cast("string"))
    df = df.withColumn("record_completeness", done).withColumn("record_provenance", came).withColumn("job_snapshot", F.get("job_items", F.lit(0)))
    return df.withColumn("content", formatted(F.col("title"), F.coalesce("content", F.lit("")), p)).drop("_summary", "_notice")
