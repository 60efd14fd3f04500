"""Child jobs of a post: what may be shown, in which order, and the state a post derives from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeboard.functions.classify import dedicated_title, mixed_role, occurrences
from noticeboard.functions.text import collapsed, compact, count_text, has_any, strip
from noticeboard.operators.listing import field_map
from noticeboard.operators.merge import upsert_plan
from noticeboard.plans.profile import RuleProfile
from noticeboard.schema import JOB_SOURCES, SCOPES

SEPARATORS = ("；", ";", "\n", "|")
PAYLOAD_KEYS = ("岗位名称", "招聘人数", "学历要求", "工作地点", "政治面貌")
VALUES = ("job_name", "recruitment_count", "education_requirement", "location", "political_status")
MERGED = ("recruitment_count", "education_requirement", "major_requirement", "location", "political_status")


def aggregate_looking(value: Column, p: RuleProfile) -> Column:
    """A value that reads like several joined."""
    v = collapsed(value)
    return (v != "") & (has_any(v, SEPARATORS) | (F.contains(v, F.lit("、")) & (occurrences(v, p.role) > 1)) | v.rlike(r"(?U)\d+人\s*[；;|]\s*\d+人"))


def noisy(p: RuleProfile) -> Column:
    """A job made from text fields that stands for several."""
    name = collapsed(F.col("job_name"))
    payload = F.from_json("raw_payload_json", "map<string,string>")
    values = [F.col(c) for c in VALUES] + [F.try_element_at(payload, F.lit(k)) for k in PAYLOAD_KEYS]
    joined = F.exists(F.transform(F.array(*[F.coalesce(v, F.lit("")) for v in values]), lambda v: aggregate_looking(v, p)), lambda x: x)
    marked = F.concat_ws(" ", *VALUES, "raw_payload_json").rlike(r"[；;|、\n]|\\[nu]")  # without any of these no value reads like several
    return F.when(strip(F.coalesce("source_type", F.lit(""))) == "field", (occurrences(name, p.role) > 1) | mixed_role(name, p) | F.when(marked, joined).otherwise(False)).otherwise(False)


def order(p: RuleProfile) -> list[Column]:
    """The seven keys of display order."""
    name = collapsed(F.col("job_name"))
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, JOB_SOURCES)), strip(F.coalesce("source_type", F.lit("")))), F.lit(0)), F.lit(10))
    specific = F.contains(name, F.lit(p.role)) & (F.length(name) > len(p.role))
    return [F.coalesce("sort_order", F.lit(9999)).asc(), rank.asc(), F.coalesce("is_counselor", F.lit(False)).desc(), specific.desc(), F.coalesce("confidence_score", F.lit(0.0)).desc(), F.length(name).desc(), F.coalesce("id", F.lit(0)).asc()]


def displayable(jobs: DataFrame, p: RuleProfile) -> DataFrame:
    """Jobs to show, with `position` from 1 in each post."""
    return jobs.filter(~F.coalesce(noisy(p), F.lit(False))).withColumn("position", F.row_number().over(Window.partitionBy("post_id").orderBy(*order(p))))


def snapshot(jobs: DataFrame, p: RuleProfile) -> DataFrame:
    """The first job to show of each post."""
    return displayable(jobs, p).filter("position = 1").drop("position")


def top_distinct(jobs: DataFrame, p: RuleProfile, n: int = 5) -> DataFrame:
    """The first n distinct names of each post: the role first, then names that hold it, then by name."""
    name = collapsed(F.col("job_name"))
    ranked = jobs.withColumn("name", name).filter("name <> ''").groupBy("post_id", "name").agg(F.max(F.coalesce("is_counselor", F.lit(False))).alias("is_role"))
    w = Window.partitionBy("post_id").orderBy(F.col("is_role").desc(), F.contains("name", F.lit(p.role)).desc(), F.col("name"))
    return ranked.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n)


def job_counts(jobs: DataFrame, p: RuleProfile) -> DataFrame:
    """A row per post that has jobs to show: how many, how many of the role, and whether from attachments or a model."""
    shown = jobs.filter(~F.coalesce(noisy(p), F.lit(False)))
    source = strip(F.coalesce("source_type", F.lit("")))
    return shown.groupBy("post_id").agg(F.count("*").alias("jobs"), F.count_if(F.coalesce("is_counselor", F.lit(False))).alias("role_jobs"), F.bool_or(source.isin("attachment", "attachment_pdf", "hybrid")).alias("has_attachment_jobs"), F.bool_or(source.isin("ai", "hybrid")).alias("has_ai_jobs"))


def with_state(posts: DataFrame, jobs: DataFrame, p: RuleProfile) -> DataFrame:
    """Posts with scope, has_role_job, is_related, and the state of their job index, as columns (so filters on them come before limits)."""
    counts = job_counts(jobs, p).withColumnRenamed("post_id", "_post")
    df = posts.join(counts, posts["id"] == counts["_post"], "left").drop("_post")
    scope = F.lower(strip(F.coalesce("counselor_scope", F.lit(""))))
    scope = F.when(scope.isin(*SCOPES), scope).otherwise("none")
    dedicated = dedicated_title(F.col("title"), p)
    has_job = F.coalesce("has_counselor_job", F.lit(False)) | (F.coalesce("role_jobs", F.lit(0)) > 0)
    final = F.when(scope != "none", scope).when(dedicated, "dedicated").when(has_job, "contains").otherwise("none")
    df = df.withColumn("scope", final).withColumn("_sure", (F.col("scope") != "none") | dedicated).withColumn("has_role_job", has_job | F.col("_sure"))
    df = df.withColumn("is_related", F.coalesce("is_counselor", F.lit(False)) | F.col("has_role_job")).drop("_sure")
    df = df.withColumn("jobs", F.coalesce("jobs", F.lit(0))).withColumn("role_jobs", F.coalesce("role_jobs", F.lit(0)))
    df = df.withColumn("has_attachment_jobs", F.coalesce("has_attachment_jobs", F.lit(False))).withColumn("has_ai_jobs", F.coalesce("has_ai_jobs", F.lit(False)))
    return df.withColumn("pending_extraction", F.col("is_related") & (F.col("jobs") == 0))


def flags(state: DataFrame) -> DataFrame:
    """The flags a post should carry, with confidence floors, and whether they differ from those it has."""
    c = F.coalesce("confidence_score", F.lit(0.0))
    new = F.when(F.col("scope") == "dedicated", F.greatest(c, F.lit(0.9))).when(F.col("scope") == "contains", F.greatest(c, F.lit(0.65)))
    out = state.withColumn("new_confidence", new)
    same = F.coalesce("is_counselor", F.lit(False)).eqNullSafe(F.col("is_related")) & F.col("counselor_scope").eqNullSafe(F.col("scope")) & F.coalesce("has_counselor_job", F.lit(False)).eqNullSafe(F.col("has_role_job"))
    return out.withColumn("changed", ~same)


def normalised_jobs(jobs: DataFrame, p: RuleProfile) -> DataFrame:
    """One shape for jobs of any origin; nameless ones go. A confidence of 0 counts as none."""
    name = compact(F.col("job_name"))
    default = F.when(F.col("source_type").startswith("attachment"), 0.85).otherwise(0.7)
    cols = {"job_name": name, "recruitment_count": count_text(F.col("recruitment_count"))} | {c: collapsed(F.col(c)) for c in MERGED[1:]}
    cols |= {"is_counselor": F.coalesce("is_counselor", F.lit(False)) | F.contains(name, F.lit(p.role)), "confidence_score": F.coalesce(F.nullif("confidence_score", F.lit(0.0)), default)}
    return jobs.withColumns(cols).filter("job_name <> ''")


def merged_jobs(jobs: DataFrame, p: RuleProfile, *, by: str = "post_id", arrival: str = "arrival") -> DataFrame:
    """One job per name and post: per field the first value that isn't empty, in order of arrival; several origins are hybrid.

    Where a specific job of the role exists, a bare one from text fields goes. One shuffle by (post, name), one by post.
    """
    j = normalised_jobs(jobs, p)
    first = lambda c: F.coalesce(F.min_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.col(arrival))), F.lit("")).alias(c)
    one = j.groupBy(by, "job_name").agg(*[first(c) for c in MERGED], F.max("is_counselor").alias("is_counselor"), F.max("confidence_score").alias("confidence_score"), F.when(F.count_distinct(F.nullif("source_type", F.lit(""))) > 1, "hybrid").otherwise(F.min_by("source_type", arrival)).alias("source_type"), F.min_by("raw_payload_json", F.when(F.col("raw_payload_json").isNotNull(), F.col(arrival))).alias("raw_payload_json"), F.min(arrival).alias(arrival))
    specific = F.col("is_counselor") & (F.col("job_name") != p.role) & F.contains("job_name", F.lit(p.role))
    has = F.max(specific).over(Window.partitionBy(by))
    return one.withColumn("_specific", has).filter(~(F.col("_specific") & (F.col("job_name") == p.role) & (F.col("source_type") == "field"))).drop("_specific")


def field_jobs(posts: DataFrame, fields: DataFrame, p: RuleProfile) -> DataFrame:
    """The one job that a post's text fields make, if its name holds the role. A title of several roles, or one with the role where no field names the job, names it anew."""
    w = p.wording
    m = field_map(fields).withColumnRenamed("post_id", "_f")
    df = posts.join(m, posts["id"] == m["_f"], "left")
    value = lambda n: collapsed(F.try_element_at("field_map", F.lit(n)))
    name = compact(F.try_element_at("field_map", F.lit(w.job)))
    known = lambda c: F.coalesce(*[F.when(F.contains(c, F.lit(n)), n) for n in p.job_names])
    said = known(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))))
    given = F.when(mixed_role(F.col("title"), p), F.coalesce(said, known(name))).when((name == "") & F.contains("title", F.lit(p.role)), said).otherwise(name)
    out = df.select(
        F.col("id").alias("post_id"),
        given.alias("job_name"),
        count_text(F.try_element_at("field_map", F.lit(w.headcount))).alias("recruitment_count"),
        value(w.education).alias("education_requirement"),
        value(w.major).alias("major_requirement"),
        value(w.place).alias("location"),
        value(w.political).alias("political_status"),
        F.lit("field").alias("source_type"),
        F.lit(True).alias("is_counselor"),
        F.lit(0.65).alias("confidence_score"),
        F.coalesce(F.to_json("field_map"), F.lit("{}")).alias("raw_payload_json"),
    )
    return out.filter(F.contains("job_name", F.lit(p.role))).filter(~F.coalesce(noisy(p), F.lit(False)))


COLUMNS = ("post_id", "job_name", *MERGED, "source_type", "is_counselor", "confidence_score", "raw_payload_json")


def arriving(jobs: DataFrame, place: int, order: Column) -> DataFrame:
    """jobs' common columns with `arrival`: after all of a lesser place, in their own order."""
    return jobs.select(*COLUMNS[:8], "is_counselor", F.col("confidence_score").cast("double").alias("confidence_score"), "raw_payload_json", F.struct(F.lit(place).alias("place"), order.cast("bigint").alias("at")).alias("arrival"))


def local_jobs(posts: DataFrame, fields: DataFrame, attachment_jobs: DataFrame, p: RuleProfile) -> DataFrame:
    """Jobs of the role from a post's attachments (attachment_jobs has an `id` for their order), then the one from its fields, merged."""
    from_files = arriving(normalised_jobs(attachment_jobs, p).filter("is_counselor"), 0, F.col("id"))
    return merged_jobs(from_files.unionByName(arriving(field_jobs(posts, fields, p), 1, F.lit(0))), p)


def rebuilt_jobs(posts: DataFrame, fields: DataFrame, attachment_jobs: DataFrame, existing: DataFrame, p: RuleProfile, model_jobs: DataFrame | None = None) -> DataFrame:
    """All of a post's jobs anew: local ones, then a model's. Without a model's run, those it gave before stay."""
    local = local_jobs(posts, fields, attachment_jobs, p)
    model = existing.filter(F.col("source_type").isin("ai", "hybrid")) if model_jobs is None else model_jobs
    model = model.join(posts.select(F.col("id").alias("_p")), F.col("post_id") == F.col("_p"), "left_semi")
    return merged_jobs(arriving(local, 0, F.col("arrival.place")).unionByName(arriving(model, 1, F.col("id"))), p)


def job_upserts(existing: DataFrame, rebuilt: DataFrame, posts: DataFrame) -> DataFrame:
    """The plan for the jobs of `posts`: a job's key is its post and its name without white space; empty values are null; sort_order is its place from 0."""
    values = ["job_name", *MERGED, "source_type", "is_counselor", "confidence_score", "raw_payload_json", "sort_order"]
    place = F.row_number().over(Window.partitionBy("post_id").orderBy("arrival", "job_name")) - 1
    new = rebuilt.withColumn("sort_order", place).withColumns({c: F.nullif(c, F.lit("")) for c in MERGED}).withColumn("name", compact(F.col("job_name")))
    mine = existing.join(posts.select(F.col("id").alias("_p")), F.col("post_id") == F.col("_p"), "left_semi").withColumn("name", compact(F.col("job_name")))
    return upsert_plan(mine, new, ["post_id", "name"], values, order="sort_order")


def needs_reindex(state: DataFrame, files: DataFrame, use_model: bool, all_posts: bool = False) -> DataFrame:
    """The posts of with_state's columns whose jobs want rebuilding: pending ones; with a model, related ones without its jobs; else those with a stale parsed file, or a parsed file's jobs that aren't indexed. files: post_id, stale, parsed_jobs, of parsable files."""
    if all_posts:
        return state
    if use_model:
        return state.filter(F.col("pending_extraction") | (F.col("is_related") & ~F.col("has_ai_jobs")))
    f = files.groupBy(F.col("post_id").alias("_f")).agg(F.bool_or("stale").alias("_stale"), F.bool_or(F.coalesce("parsed_jobs", F.lit(0)) > 0).alias("_jobs"))
    df = state.join(f, state["id"] == f["_f"], "left")
    return df.filter(F.col("pending_extraction") | F.coalesce("_stale", F.lit(False)) | (F.coalesce("_jobs", F.lit(False)) & ~F.col("has_attachment_jobs"))).drop("_f", "_stale", "_jobs")


def job_backfill(state: DataFrame, files: DataFrame, fields: DataFrame, attachment_jobs: DataFrame, existing: DataFrame, p: RuleProfile, *, limit: int = 100, model_jobs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The newest posts that want it, and the plan for their jobs."""
    chosen = needs_reindex(state, files, model_jobs is not None).orderBy(F.col("publish_date").desc_nulls_last(), F.col("id").desc()).limit(limit)
    return chosen, job_upserts(existing, rebuilt_jobs(chosen, fields, attachment_jobs, existing, p, model_jobs), chosen)


def serialised(jobs_in_order: DataFrame) -> DataFrame:
    """post_id, jobs: a post's jobs as an API shows them, in the order of `position`, payloads as maps."""
    payload = F.coalesce(F.from_json("raw_payload_json", "map<string,string>"), F.create_map().cast("map<string,string>"))
    row = F.struct("position", "id", "job_name", *MERGED, "source_type", "is_counselor", "confidence_score", payload.alias("raw_payload"))
    return jobs_in_order.groupBy("post_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "id", F.to_json(row).alias("j")))), lambda x: x["j"]).alias("jobs"))
