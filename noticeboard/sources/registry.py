"""Connectors by name (S22), their readiness (S23) and the extractor protocol."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeboard.functions.text import normalised
from noticeboard.plans.profile import ZH, RuleProfile

CONNECTORS: dict[str, Callable[..., DataFrame]] = {}


class SourceError(Exception):
    """A source that is missing (404) or inactive (409), or whose connector isn't known."""

    def __init__(self, message: str, status: int):
        super().__init__(message)
        self.status = status


class Extractor(Protocol):
    """What turns posts into analysis rows; the rule extractor is one, a model behind a network another."""

    def __call__(self, posts: DataFrame) -> DataFrame: ...


def connector(name: str) -> Callable:
    """Register a function (spark, location, **options) -> records under a name."""

    def add(fn: Callable) -> Callable:
        CONNECTORS[name] = fn
        return fn

    return add


def read(spark: SparkSession, name: str | None, location: str, **options) -> DataFrame:
    if not (name or "").strip() or name not in CONNECTORS:
        raise SourceError(f"unknown connector: {name!r}", 400)
    return CONNECTORS[name](spark, location, **options)


def ready(source: dict | None) -> dict:
    if source is None:
        raise SourceError("no such source", 404)
    if not source.get("is_active"):
        raise SourceError("the source is inactive", 409)
    return source


#: fixed values: the profile that a source's connector class asks for; others have none
PROFILES: dict[str, RuleProfile] = {"JiangsuHRSSScraper": ZH}


def profile_of(scraper_class: str | None) -> RuleProfile | None:
    """By the connector's class."""
    return PROFILES.get((scraper_class or "").strip())


def by_profile(posts: DataFrame, sources: DataFrame, work: Callable[[DataFrame, RuleProfile | None], DataFrame]) -> DataFrame:
    """Work on posts with the profile of their source's class: a branch for each profile, and one for none. Sources are few; the join is on their ids."""
    s = sources.select(F.col("id").alias("_s"), F.trim(F.coalesce("scraper_class", F.lit(""))).alias("_class"))
    j = posts.join(s, posts["source_id"] == s["_s"], "left").drop("_s")
    known = F.coalesce(F.col("_class"), F.lit("")).isin(*PROFILES)
    out = work(j.filter(~known).drop("_class"), None)
    for name, p in PROFILES.items():
        out = out.unionByName(work(j.filter(F.col("_class") == name).drop("_class"), p))
    return out


def renormalised(posts: DataFrame, sources: DataFrame) -> DataFrame:
    """Posts with content whose content is normalised anew by their source's profile; `changed` tells where it differs."""
    full = posts.filter(F.trim(F.coalesce("content", F.lit(""))) != "")
    done = by_profile(full, sources, lambda df, p: df.withColumn("_new", normalised(F.col("content"), p)))
    return done.withColumn("changed", ~F.col("_new").eqNullSafe(F.col("content"))).withColumn("content", F.col("_new")).drop("_new")


#: fixed values: the schedule a new installation starts with
SCHEDULE = {"id": 1, "enabled": True, "interval_seconds": 7200, "default_max_pages": 5}


def seeded(sources: DataFrame, built_in: DataFrame, old_urls: dict[str, str] | None = None) -> DataFrame:
    """Sources with the built-in ones (by name) where they lack them, and old addresses replaced. Doing it again changes nothing."""
    url = F.col("base_url")
    for old, new in (old_urls or {}).items():
        url = F.when(F.col("base_url") == old, new).otherwise(url)
    have = sources.select(F.col("name").alias("_n"))
    new = built_in.join(have, built_in["name"] == have["_n"], "left_anti")
    return sources.withColumn("base_url", url).unionByName(new, allowMissingColumns=True)


def seeded_schedule(configs: DataFrame, sources: DataFrame) -> DataFrame:
    """The schedule, or the default one of the first active source; a row without a source gets that one."""
    first = sources.filter("is_active").agg(F.min("id").alias("_s"))
    row = configs.sparkSession.range(1).select(*[F.lit(v).alias(k) for k, v in SCHEDULE.items()])
    default = row.join(F.broadcast(configs.agg(F.count("*").alias("_n"))), F.col("_n") == 0).drop("_n")
    every = configs.unionByName(default, allowMissingColumns=True).select([F.col(c).cast(configs.schema[c].dataType) for c in configs.columns])
    return every.crossJoin(F.broadcast(first)).withColumn("default_source_id", F.coalesce("default_source_id", "_s")).drop("_s")  # one row


def with_fallback(first: Extractor, rules: Extractor, enabled: bool) -> Extractor:
    """The rules where the first is off or leaves a post out (its failures are rows it doesn't return)."""
    if not enabled:
        return rules

    def run(posts: DataFrame) -> DataFrame:
        got = first(posts)
        done = got.select(F.col("post_id").alias("_got"))
        return got.unionByName(rules(posts.join(done, F.col("id") == F.col("_got"), "left_anti")), allowMissingColumns=True)

    return run
