"""The predicates of list and summary queries, composed on a lazy DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeboard.functions.text import has_any, like_any
from noticeboard.plans.profile import RuleProfile
from noticeboard.schema import NOTICE_SAFE_SOURCES

#: fixed values: what a filter value stands for
EDUCATION = {"博士": ("博士", "博士研究生", "博士学位"), "硕士": ("硕士", "硕士研究生", "硕士学位", "研究生学历"), "本科": ("本科", "本科学历", "学士", "学士学位"), "专科": ("专科", "大专", "高职")}
UNLIMITED = ("男女不限", "性别不限", "不限性别")


def primary_only(df: DataFrame) -> DataFrame:
    """Without duplicates; null isn't one."""
    return df.filter(~F.col("duplicate_status").eqNullSafe("duplicate"))


def has_content(flag: bool) -> Column:
    """SQL trim, so spaces only."""
    full = F.col("content").isNotNull() & (F.trim("content") != "")
    return full if flag else ~full


def search(keyword: str, *, wildcards: bool = False) -> Column:
    """In title or content, ASCII case apart; % and _ act as wildcards on demand."""
    k = keyword.strip()
    return like_any(F.col("title"), (k,), wildcards=wildcards) | like_any(F.col("content"), (k,), wildcards=wildcards) if k else F.lit(True)


def guarded(children: DataFrame, analyses: DataFrame, condition: Column, notice: str, safe_sources: bool = False) -> DataFrame:
    """Ids of posts with a child that meets the condition, notices apart (three-valued: a null event fails)."""
    a = analyses.select(F.col("post_id").alias("_a"), F.col("event_type").alias("_event"), F.lit(True).alias("_there"))
    ok = F.col("_there").isNull() | (F.col("_event") != notice)
    ok = ok | F.col("source_type").isin(*NOTICE_SAFE_SOURCES) if safe_sources else ok
    hit = children.filter(condition)
    return hit.join(a, hit["post_id"] == a["_a"], "left").filter(ok).select("post_id").distinct()


def any_of(df: DataFrame, id_sets: list[DataFrame], condition: Column | None = None) -> DataFrame:
    """Rows whose id is in any of the sets or that meet the condition. The sets are united, then one existence join."""
    ids = id_sets[0]
    for s in id_sets[1:]:
        ids = ids.unionByName(s)
    ids = ids.distinct().select(F.col("post_id").alias("_hit"))
    if condition is None:
        return df.join(ids, df["id"] == ids["_hit"], "left_semi")
    return df.join(ids, df["id"] == ids["_hit"], "left").filter(F.col("_hit").isNotNull() | F.coalesce(condition, F.lit(False))).drop("_hit")


@dataclass(frozen=True)
class Filter:
    """What a list query asks for; None leaves a predicate out."""

    province: str | None = None
    search: str | None = None
    has_content: bool | None = None
    gender: str | None = None
    education: str | None = None
    location: str | None = None
    event_type: str | None = None
    is_related: bool | None = None
    scope: str | None = None
    has_role_job: bool | None = None
    wildcards: bool = False

    @staticmethod
    def of_scope(scope: str, **kw) -> Filter:
        """Any, dedicated, contains or all."""
        return Filter(**{"any": {"is_related": True}, "dedicated": {"scope": "dedicated", "is_related": True}, "contains": {"scope": "contains", "has_role_job": True}}.get(scope, {}), **kw)


@dataclass(frozen=True)
class Tables:
    """posts must have the columns of jobs.with_state where a filter asks for them."""

    posts: DataFrame
    post_fields: DataFrame
    post_jobs: DataFrame
    post_analyses: DataFrame
    sources: DataFrame


def apply(t: Tables, f: Filter, p: RuleProfile) -> DataFrame:
    """P01-P12 on posts. Children are read only where a filter needs them."""
    df = primary_only(t.posts)
    if f.province:
        s = t.sources.filter(F.col("province") == f.province).select(F.col("id").alias("_source"))
        df = df.join(s, df["source_id"] == s["_source"], "left_semi")
    if f.search and f.search.strip():
        df = df.filter(search(f.search, wildcards=f.wildcards))
    if f.has_content is not None:
        df = df.filter(has_content(f.has_content))
    fields = lambda name, cond: guarded(t.post_fields, t.post_analyses, (F.col("field_name") == name) & cond, p.notice_event)
    jobs = lambda cond: guarded(t.post_jobs, t.post_analyses, cond, p.notice_event, safe_sources=True)
    value, payload = F.col("field_value"), F.col("raw_payload_json")
    gender = (f.gender or "").strip()
    if gender in ("男", "女"):
        df = any_of(df, [fields("性别要求", value == gender), jobs(has_any(F.col("job_name"), (f"（{gender}）", f"({gender})")) | has_any(payload, (f'"性别要求": "{gender}"', f'"性别": "{gender}"')))])
    elif gender == "不限":
        df = any_of(df, [fields("性别要求", (value == "不限") | has_any(value, UNLIMITED)), jobs(has_any(payload, UNLIMITED))], has_any(F.col("title"), UNLIMITED) | has_any(F.col("content"), UNLIMITED))
    if education := (f.education or "").strip():
        words = EDUCATION.get(education, (education,))
        df = any_of(df, [fields("学历要求", like_any(value, words)), jobs(like_any(F.col("education_requirement"), words))])
    if place := (f.location or "").strip():
        df = any_of(df, [fields("工作地点", like_any(value, (place,))), jobs(like_any(F.col("location"), (place,)))])
    if f.event_type:
        a = t.post_analyses.filter(F.col("event_type") == f.event_type).select(F.col("post_id").alias("_a"))
        df = df.join(a, df["id"] == a["_a"], "left_semi")
    for column, wanted in (("is_related", f.is_related), ("scope", f.scope), ("has_role_job", f.has_role_job)):
        if wanted is not None:
            df = df.filter(F.col(column) == wanted)
    return df


def pending_base(posts: DataFrame, analyses: DataFrame, insights: DataFrame) -> DataFrame:
    """Analysis or insight missing or not successful."""
    a = analyses.select(F.col("post_id").alias("_a"), "analysis_status")
    i = insights.select(F.col("post_id").alias("_i"), "insight_status")
    df = posts.join(a, posts["id"] == a["_a"], "left").join(i, posts["id"] == i["_i"], "left")
    return df.filter((F.coalesce("analysis_status", F.lit("")) != "success") | (F.coalesce("insight_status", F.lit("")) != "success")).select(posts["*"])


def pending_model(posts: DataFrame, analyses: DataFrame, insights: DataFrame, ready: bool) -> DataFrame:
    """As SQL has it: of a row that is there, a null provider or status doesn't count as another one."""
    a = analyses.select(F.col("post_id").alias("_a"), "analysis_status", "analysis_provider")
    i = insights.select(F.col("post_id").alias("_i"), "insight_status", "insight_provider")
    df = posts.join(a, posts["id"] == a["_a"], "left").join(i, posts["id"] == i["_i"], "left")
    want = F.col("_a").isNull() | (F.col("analysis_status") != "success") | F.col("_i").isNull() | (F.col("insight_status") != "success")
    want = want | (F.col("analysis_provider") != "openai") | (F.col("insight_provider") != "openai") if ready else want
    return df.filter(want).select(posts["*"])


def needs_attachments(posts: DataFrame, attachments: DataFrame) -> DataFrame:
    """Posts without attachments, or with one that lacks a type or ends in .jsp."""
    odd = attachments.groupBy(F.col("post_id").alias("_p")).agg(F.bool_or(F.coalesce(F.trim("file_type"), F.lit("")).eqNullSafe("") | F.coalesce(F.contains(F.lower("filename"), F.lit(".jsp")), F.lit(False))).alias("_odd"))
    return posts.join(odd, posts["id"] == odd["_p"], "left").filter(F.coalesce("_odd", F.lit(True))).drop("_p", "_odd")
