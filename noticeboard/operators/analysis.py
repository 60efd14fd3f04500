"""Analyses and insights of posts by rules, the same from a model's output, and the batch jobs that fill them in.

All is one projection over posts joined with one aggregate of each kind of child, so a batch job is a filter, a few
joins on post ids and a write. What depends on the day takes it as an argument.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeboard.functions import classify, dates
from noticeboard.functions.text import aliased, first_integer, flattened, parts, string_list, strip, truncated, truth
from noticeboard.operators import filters, summary
from noticeboard.operators.listing import field_map
from noticeboard.plans.profile import RuleProfile, Wording
from noticeboard.sources.registry import Extractor

#: fixed values: how long texts may be in results, and how many values lists hold
LENGTHS = {"political": 100, "deadline": 120, "evidence": 300, "deadline_evidence": 60, "education_evidence": 40}
MOST = 8
#: fixed values: words for yes and no in a model's output, of whether to track a post and of a post's facts
TRACK, NO_TRACK = ("true", "yes", "1", "是", "需要", "继续跟踪", "值得跟踪"), ("false", "no", "0", "否", "不需要", "无需跟踪", "不值得跟踪")
YES, NO = ("true", "yes", "1", "是", "有", "需要", "包含"), ("false", "no", "0", "否", "无", "不需要", "不包含")
#: fixed values: how much of each kind of child a model is shown
PREVIEW = {"jobs": 5, "fields": 8, "attachments": 3, "content": 4000, "field_value": 180, "attachment_value": 120}
JOB_LENGTHS = {"job_name": 80, "recruitment_count": 40, "education_requirement": 80, "major_requirement": 160, "location": 80, "political_status": 40}


def field(name: str) -> Column:
    """A field's value in `field_map`; '' if there is none."""
    return strip(F.coalesce(F.try_element_at("field_map", F.lit(name)), F.lit("")))


def said(template: str, value: Column) -> Column:
    """The template with the value in it; null where the value is empty."""
    before, after = template.split("{}")
    return F.when(value != "", F.concat(F.lit(before), value, F.lit(after)))


def distinct_texts(*values: Column) -> Column:
    """The values that aren't empty, each once, in order."""
    return F.array_distinct(F.filter(F.array(*[F.coalesce(v, F.lit("")) for v in values]), lambda x: x != ""))


def with_fields(posts: DataFrame, fields: DataFrame) -> DataFrame:
    """posts with `field_map`, name -> last value."""
    m = field_map(fields).withColumnRenamed("post_id", "_f")
    return posts.join(m, posts["id"] == m["_f"], "left").drop("_f")


def rule_analysis(posts: DataFrame, fields: DataFrame, attachments: DataFrame, p: RuleProfile) -> DataFrame:
    """An analysis of each post (id, title, content, is_counselor) by the profile's rules."""
    w = p.wording
    t = attachments.select(F.col("post_id").alias("_t")).distinct()
    df = with_fields(posts, fields).join(t, F.col("id") == F.col("_t"), "left")
    title, content, place = F.col("title"), F.coalesce("content", F.lit("")), field(w.place)
    df = df.select("id", "title", "field_map", F.coalesce("is_counselor", F.lit(False)).alias("role"), F.col("_t").isNotNull().alias("attached"), classify.event_type(title, content, p).alias("event_type"), classify.school(title).alias("school_name"), classify.city(place, title, content, p).alias("city"))
    track, event = F.col("event_type") != p.notice_event, F.col("event_type")
    parts_of = [said(w.of_event, event), said(w.of_school, F.col("school_name")), said(w.of_city, F.col("city")), said(w.of_headcount, field(w.headcount)), said(w.of_education, field(w.education)), said(w.of_signup, field(w.signup)), F.when(~track, w.of_notice)]
    tags = distinct_texts(event, F.when(F.col("role"), w.role_tag), field(w.education), field(w.political), F.when(F.col("attached"), w.attachment_tag))
    return df.select(
        F.col("id").alias("post_id"),
        F.lit("success").alias("analysis_status"),
        F.lit("rule").alias("analysis_provider"),
        "event_type",
        classify.stage(event, p).alias("recruitment_stage"),
        F.when(F.col("role") & track, "high").when(track, "medium").otherwise("low").alias("tracking_priority"),
        "school_name",
        "city",
        track.alias("should_track"),
        F.concat_ws("", *parts_of).alias("summary"),
        F.to_json(tags).alias("tags_json"),
        F.to_json(distinct_texts(F.col("school_name"), F.col("city"), field(w.place))).alias("entities_json"),
    )


def jobs_of_posts(jobs: DataFrame, w: Wording) -> DataFrame:
    """What insights need of a post's jobs, in one aggregate: _j, degrees, places, job_texts, politics, from_attachment."""
    payload = F.from_json("raw_payload_json", "map<string,string>")
    gender = F.coalesce(*[F.nullif(F.try_element_at(payload, F.lit(k)), F.lit("")) for k in w.payload_gender], F.lit(""))
    row = F.struct("id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("job_name", "education_requirement", "location", "political_status")], gender.alias("gender"))
    one = jobs.groupBy(F.col("post_id").alias("_j")).agg(F.array_sort(F.collect_list(row)).alias("rows"), F.bool_or(F.coalesce("source_type", F.lit("")).startswith("attachment")).alias("from_attachment"))
    each = lambda name: F.transform("rows", lambda r: r[name])
    return one.select("_j", "from_attachment", each("education_requirement").alias("degrees"), each("location").alias("places"), F.flatten(F.transform("rows", lambda r: F.array(r["job_name"], r["gender"]))).alias("job_texts"), each("political_status").alias("politics"))


def rule_insight(posts: DataFrame, fields: DataFrame, jobs: DataFrame, attachments: DataFrame, analyses: DataFrame, today: Column, p: RuleProfile) -> DataFrame:
    """The counted facts of each post (id, title, content). attachments: post_id, parsed_jobs (how many jobs its file gave)."""
    w = p.wording
    counts = summary.headcounts(jobs, fields, w.headcount).withColumnRenamed("post_id", "_h")
    tables = attachments.groupBy(F.col("post_id").alias("_t")).agg((F.max(F.coalesce("parsed_jobs", F.lit(0))) > 0).alias("has_table"))
    cities = analyses.select(F.col("post_id").alias("_a"), F.col("city").alias("analysis_city"))
    df = with_fields(posts.select("id", "title", "content"), fields)
    for child, key in ((jobs_of_posts(jobs, w), "_j"), (counts, "_h"), (tables, "_t"), (cities, "_a")):
        df = df.join(child, F.col("id") == F.col(key), "left").drop(key)
    none = F.array().cast("array<string>")
    title, content, text = F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")), lambda c: F.coalesce(c, none)
    deadline = F.coalesce(*[F.nullif(field(n), F.lit("")) for n in w.deadlines], F.lit(""))
    date = dates.deadline(deadline)
    role_total = F.col("role_total")
    evidence = [said(w.role_evidence, F.when(role_total > 0, role_total.cast("string"))), said(w.deadline_evidence, truncated(deadline, LENGTHS["deadline_evidence"])), said(w.education_evidence, truncated(field(w.education), LENGTHS["education_evidence"]))]
    found = classify.cities([field(w.place), F.col("analysis_city"), title, content, F.concat_ws("\n", text("places"))], p)
    political = F.coalesce(F.nullif(field(w.political), F.lit("")), F.get(F.filter(F.transform(text("politics"), lambda x: strip(x)), lambda x: x != ""), F.lit(0)), F.lit(""))
    both = F.concat_ws("\n", title, content)
    return df.select(
        F.col("id").alias("post_id"),
        F.lit("success").alias("insight_status"),
        F.lit("rule").alias("insight_provider"),
        F.col("total").cast("int").alias("recruitment_count_total"),
        role_total.cast("int").alias("counselor_recruitment_count"),
        classify.degree_floor(F.concat(F.array(field(w.education), title, content), text("degrees")), p).alias("degree_floor"),
        F.to_json(F.slice(found, 1, MOST)).alias("city_list_json"),
        classify.gender_restriction(F.concat_ws("\n", F.array(field(w.gender), title, content), text("job_texts"))).alias("gender_restriction"),
        truncated(political, LENGTHS["political"]).alias("political_status_required"),
        truncated(deadline, LENGTHS["deadline"]).alias("deadline_text"),
        date.alias("deadline_date"),
        dates.deadline_status(date, today, names=w.deadline_status).alias("deadline_status"),
        F.contains(both, F.lit(w.exam)).alias("has_written_exam"),
        F.contains(both, F.lit(w.interview)).alias("has_interview"),
        (F.coalesce("has_table", F.lit(False)) | F.coalesce("from_attachment", F.lit(False))).alias("has_attachment_job_table"),
        truncated(F.concat_ws("；", *evidence), LENGTHS["evidence"]).alias("evidence_summary"),
    )


def first_values(c: Column, n: int = MOST) -> Column:
    """F17 on a JSON list, object or text: its distinct texts, the first n."""
    return F.slice(F.array_distinct(flattened(c)), 1, n)


def normalised_analysis(df: DataFrame, p: RuleProfile) -> DataFrame:
    """C17: a model's analysis (columns as it gave them, texts or JSON; title) within the closed vocabularies."""
    events = tuple(dict.fromkeys([e for _, e, _ in p.event_rules] + [p.event_default]))
    event = strip(F.coalesce("event_type", F.lit("")))
    new = {
        "event_type": F.when(event.isin(*events), event).otherwise(p.event_default),
        "recruitment_stage": aliased(F.col("recruitment_stage"), p.stage_alias, p.event_default),
        "tracking_priority": aliased(F.col("tracking_priority"), p.priority_alias, "medium", lower=True),
        "should_track": truth(F.col("should_track"), TRACK, NO_TRACK, True),
        "tags_json": F.to_json(first_values(F.col("tags_json"))),
        "entities_json": F.to_json(first_values(F.col("entities_json"))),
        "school_name": F.coalesce(F.nullif(strip("school_name"), F.lit("")), classify.school(F.col("title"))),
        "city": strip(F.coalesce("city", F.lit(""))),
        "summary": strip(F.coalesce("summary", F.lit(""))),
    }
    return df.withColumns(new)


def normalised_insight(df: DataFrame, today: Column, p: RuleProfile) -> DataFrame:
    """C17: a model's insight within the closed vocabularies; a status that it leaves open comes from the date."""
    w = p.wording
    date = dates.deadline(F.coalesce(F.nullif(strip(F.coalesce(F.col("deadline_date").cast("string"), F.lit(""))), F.lit("")), F.col("deadline_text")))
    status = aliased(F.col("deadline_status"), p.deadline_alias, w.deadline_status[3], lower=True)
    cities = F.slice(F.array_distinct(F.flatten(F.transform(flattened(F.col("city_list_json")), lambda x: parts(x, 10_000)))), 1, MOST)
    flag = lambda c: truth(F.col(c), YES, NO)
    new = {
        "recruitment_count_total": first_integer(F.col("recruitment_count_total")).cast("int"),
        "counselor_recruitment_count": first_integer(F.col("counselor_recruitment_count")).cast("int"),
        "degree_floor": aliased(F.col("degree_floor"), p.degree_alias, w.unknown),
        "city_list_json": F.to_json(cities),
        "gender_restriction": aliased(F.col("gender_restriction"), p.gender_alias, w.unknown),
        "political_status_required": truncated(F.coalesce("political_status_required", F.lit("")), LENGTHS["political"]),
        "deadline_text": truncated(F.coalesce("deadline_text", F.lit("")), LENGTHS["deadline"]),
        "deadline_date": date,
        "deadline_status": F.when(status != w.deadline_status[3], status).otherwise(dates.deadline_status(date, today, names=w.deadline_status)),
        "has_written_exam": flag("has_written_exam"),
        "has_interview": flag("has_interview"),
        "has_attachment_job_table": flag("has_attachment_job_table"),
        "evidence_summary": truncated(F.coalesce("evidence_summary", F.lit("")), LENGTHS["evidence"]),
    }
    return df.withColumns(new)


def serialised_analysis(analyses: DataFrame) -> DataFrame:
    """post_id and `analysis` as an API shows it: JSON lists as arrays, times in ISO 8601."""
    plain = [c for c in analyses.columns if c not in ("id", "post_id", "tags_json", "entities_json", "analyzed_at")]
    return analyses.select("post_id", F.struct(*plain, string_list(F.col("tags_json")).alias("tags"), string_list(F.col("entities_json")).alias("entities"), F.date_format("analyzed_at", "yyyy-MM-dd'T'HH:mm:ss").alias("analyzed_at")).alias("analysis"))


def serialised_insight(insights: DataFrame) -> DataFrame:
    """post_id and `insight` as an API shows it; a date that is missing is ''."""
    plain = [c for c in insights.columns if c not in ("id", "post_id", "city_list_json", "deadline_date", "analyzed_at")]
    return insights.select("post_id", F.struct(*plain, string_list(F.col("city_list_json")).alias("city_list"), F.coalesce(F.date_format("deadline_date", "yyyy-MM-dd"), F.lit("")).alias("deadline_date"), F.date_format("analyzed_at", "yyyy-MM-dd'T'HH:mm:ss").alias("analyzed_at")).alias("insight"))


def payloads(posts: DataFrame, fields: DataFrame, jobs: DataFrame, attachments: DataFrame, p: RuleProfile) -> DataFrame:
    """Id, payload: the JSON that a model is given for a post, with few children and short texts.

    Jobs: the role first, then names that hold it, then by name; each name once.
    """
    cut = {c: truncated(F.coalesce(c, F.lit("")), n).alias(c) for c, n in JOB_LENGTHS.items()}
    role = F.coalesce("is_counselor", F.lit(False))
    order = F.struct(F.when(role, 0).otherwise(1), F.when(F.contains("job_name", F.lit(p.role)), 0).otherwise(1), F.col("job_name"))
    named = jobs.filter(strip(F.coalesce("job_name", F.lit(""))) != "").groupBy("post_id", cut["job_name"].alias("_name")).agg(F.min_by(F.struct(order.alias("_order"), *cut.values(), F.coalesce("source_type", F.lit("")).alias("source_type"), role.alias("is_counselor")), F.struct(order, "id")).alias("j"))
    of_jobs = named.groupBy(F.col("post_id").alias("_j")).agg(F.slice(F.transform(F.array_sort(F.collect_list("j")), lambda x: x.dropFields("_order")), 1, PREVIEW["jobs"]).alias("jobs"))
    value = truncated(F.col("field_value"), PREVIEW["field_value"])
    some = fields.filter((strip(F.coalesce("field_name", F.lit(""))) != "") & (strip(F.coalesce("field_value", F.lit(""))) != "")).select("post_id", "id", F.trim("field_name").alias("field_name"), value.alias("field_value"))
    of_fields = field_map(some).select(F.col("post_id").alias("_f"), F.col("field_map").alias("fields"))
    file = F.struct("id", "filename", "file_type", "file_size", F.coalesce("is_downloaded", F.lit(False)).alias("is_downloaded"))
    of_files = attachments.groupBy(F.col("post_id").alias("_t")).agg(F.transform(F.slice(F.array_sort(F.collect_list(file)), 1, PREVIEW["attachments"]), lambda x: x.dropFields("id")).alias("attachments"))
    df = posts
    for child, key in ((of_jobs, "_j"), (of_fields, "_f"), (of_files, "_t")):
        df = df.join(child, F.col("id") == F.col(key), "left").drop(key)
    return df.select("id", F.to_json(F.struct("title", truncated(F.coalesce("content", F.lit("")), PREVIEW["content"]).alias("content"), "fields", "jobs", "attachments")).alias("payload"))


def backfill(posts: DataFrame, analyses: DataFrame, insights: DataFrame, analyse: Extractor, gather: Extractor, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """Of the newest posts without a base, an analysis where there is none that succeeded, and an insight likewise. What is there already is used as it is."""
    chosen = filters.pending_base(posts, analyses, insights).orderBy(F.col("publish_date").desc_nulls_last(), F.col("id").desc()).limit(limit)
    lacking = lambda have, status: chosen.join(have.filter(F.col(status) == "success").select(F.col("post_id").alias("_p")), F.col("id") == F.col("_p"), "left_anti")
    return analyse(lacking(analyses, "analysis_status")), gather(lacking(insights, "insight_status"))


def model_run(posts: DataFrame, analyses: DataFrame, analyse: Extractor, *, reuse: bool = True) -> DataFrame:
    """Results of a model for posts, with `outcome`: reused where it has succeeded before, else success, fallback (another provider's result) or failed. A post the extractor leaves out has failed on its own and stops nothing."""
    done = analyses.filter("analysis_status = 'success' and analysis_provider = 'openai'")
    old = done.join(posts.select(F.col("id").alias("_p")), F.col("post_id") == F.col("_p"), "left_semi") if reuse else done.limit(0)
    todo = posts.join(old.select(F.col("post_id").alias("_o")), F.col("id") == F.col("_o"), "left_anti")
    new = analyse(todo)
    ok = F.col("analysis_status") == "success"
    new = new.withColumn("outcome", F.when(ok & (F.col("analysis_provider") == "openai"), "success").when(ok, "fallback").otherwise("failed"))
    lost = todo.join(new.select(F.col("post_id").alias("_n")), F.col("id") == F.col("_n"), "left_anti").select(F.col("id").alias("post_id"), F.lit("failed").alias("analysis_status"), F.lit("failed").alias("outcome"))
    return new.unionByName(old.withColumn("outcome", F.lit("reused")), allowMissingColumns=True).unionByName(lost, allowMissingColumns=True)


def run_counters(results: DataFrame, column: str = "outcome", names: tuple[str, ...] = ("success", "reused", "fallback", "failed")) -> DataFrame:
    """One row: how many rows a run scanned, and how many had each outcome."""
    return results.agg(F.count("*").alias("scanned"), *[F.count_if(F.col(column) == n).alias(n) for n in names])


def should_try_model(posts: DataFrame, fields: DataFrame, local_jobs: DataFrame, p: RuleProfile) -> DataFrame:
    """Id, try_model: the role in the post's texts or fields, jobs of its own, or its flag."""
    mentions = fields.filter(F.contains("field_value", F.lit(p.role)) | F.contains("field_name", F.lit(p.role))).select(F.col("post_id").alias("_m"))
    hit = mentions.unionByName(local_jobs.select(F.col("post_id").alias("_m"))).distinct()
    df = posts.join(hit, posts["id"] == hit["_m"], "left")
    text = F.concat_ws("\n", "title", "content")
    return df.select("id", (F.contains(text, F.lit(p.role)) | F.col("_m").isNotNull() | F.coalesce("is_counselor", F.lit(False))).alias("try_model"))

