"""Task ledger, freshness and health, over a table of runs. What depends on the time takes it as an argument."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeboard.functions.text import aliased

#: fixed values: states, and hours after which a running task of a type is stale
STATUS_ALIAS = {"pending": "queued", "processing": "running"}
RUNNING = ("queued", "running", "cancel_requested")
STALE_HOURS = {"manual_scrape": 2, "scheduled_scrape": 2, "ai_analysis": 6, "job_extraction": 6, "ai_job_extraction": 6, "attachment_backfill": 12, "duplicate_backfill": 12, "maintenance_backfill": 12}
DEFAULT_STALE_HOURS = 6
SCRAPES = ("manual_scrape", "scheduled_scrape")
STAGE_KEYS = {
    "persisting": ("persist-posts", "persist-attachments", "write-groups", "analyze-posts", "extract-post-jobs"),
    "finalizing": ("count-remaining", "backfill-ready", "write-complete", "no-pending-posts", "no-posts-in-range"),
    "collecting": ("select-unchecked", "select-recheck-range", "start-backfill", "start-recheck-range", "load-candidates", "group-candidates", "compare-candidates", "reset-marks"),
}
STAGE_PREFIXES = (
    ("persisting", ("persist", "write", "save", "store")),
    ("finalizing", ("count", "finish", "final", "cancel", "cleanup", "no-posts", "no-pending")),
    ("collecting", ("select", "start", "load", "group", "compare", "collect", "crawl", "scrap", "fetch", "scan", "analy", "process", "reset")),
)
CANCELLABLE = ("attachment_backfill", "duplicate_backfill", "ai_analysis", "job_extraction", "ai_job_extraction", "manual_scrape")
INCREMENTAL = ("attachment_backfill", "duplicate_backfill", "ai_analysis", "job_extraction", "ai_job_extraction")
CONTENT_TYPES = (*STALE_HOURS,)


def status(c: Column) -> Column:
    """Canonical status."""
    v = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.coalesce(F.nullif(aliased(v, STATUS_ALIAS, ""), F.lit("")), v)


def expired(runs: DataFrame, now: Column, hours: dict[str, int] | None = None, default: int = DEFAULT_STALE_HOURS) -> DataFrame:
    """Running tasks that gave no sign (heartbeat, else start) within their type's time are failed."""
    limit = aliased(F.col("task_type"), {k: str(v) for k, v in (STALE_HOURS if hours is None else hours).items()}, str(default)).cast("int")
    seen = F.coalesce("heartbeat_at", "started_at")
    df = runs.withColumn("status", status(F.col("status")))
    stale = F.col("status").isin(*RUNNING) & (seen < F.timestamp_add("HOUR", -limit, now))
    df = df.withColumn("is_stale", F.coalesce(stale, F.lit(False)))
    return df.withColumn("failure_reason", F.when(F.col("is_stale"), "stale").otherwise(F.col("failure_reason"))).withColumn("finished_at", F.when(F.col("is_stale"), now).otherwise(F.col("finished_at"))).withColumn("status", F.when(F.col("is_stale"), "failed").otherwise(F.col("status")))


def blocked(runs: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """Running tasks that keep a new one of these types from starting."""
    return runs.filter(status(F.col("status")).isin(*RUNNING) & F.col("task_type").isin(*types))


def runtime_health(runs: DataFrame, now: Column) -> DataFrame:
    """How many run, how many are stale, the latest heartbeat and its age in whole seconds passed."""
    e = expired(runs, now).withColumn("was_running", F.col("status").isin(*RUNNING) | F.col("is_stale"))
    return e.agg(F.count_if("was_running").alias("running"), F.count_if("is_stale").alias("stale"), F.max(F.when(F.col("was_running"), F.coalesce("heartbeat_at", "started_at"))).alias("latest_heartbeat")).withColumn("age_seconds", F.timestamp_diff("SECOND", F.col("latest_heartbeat"), now))


def freshness(runs: DataFrame, types: tuple[str, ...] = SCRAPES) -> DataFrame:
    """Of each source, and overall (source null), the latest successful run; of ties the greater id."""
    ok = runs.filter((F.col("status") == "success") & F.col("task_type").isin(*types) & F.col("finished_at").isNotNull())
    last = F.max(F.struct("finished_at", "id")).alias("r")
    return ok.rollup("source_id").agg(last, F.grouping("source_id").alias("overall")).filter("overall = 1 or source_id is not null").select("source_id", F.col("r.id").alias("id"), F.col("r.finished_at").alias("finished_at"))


def freshness_health(finished_at: Column, now: Column, interval_seconds: int) -> Column:
    """K06."""
    age = F.timestamp_diff("SECOND", finished_at, now)
    return F.when(finished_at.isNull(), "no_success").when(age > max(2 * interval_seconds, 3600), "latest_success_too_old").otherwise("ok")


def health(ready: Column, scheduler: Column, fresh: Column, tasks: Column) -> Column:
    """K07."""
    return F.when(~ready, "error").when(~scheduler | ~fresh | ~tasks, "degraded").otherwise("ok")


def latest(runs: DataFrame, n: int = 50) -> DataFrame:
    """The ledger's view: the newest runs."""
    return runs.orderBy(F.col("started_at").desc_nulls_last(), F.col("id").desc()).limit(n)


def task_summary(runs: DataFrame) -> DataFrame:
    """K08."""
    return runs.agg(F.count("*").alias("total"), F.max_by("id", F.struct("started_at", "id")).alias("latest_id"), F.max_by("id", F.when(F.col("status") == "success", F.struct("finished_at", "id"))).alias("latest_success_id"), F.count_if(F.col("status").isin(*RUNNING)).alias("running"))


def stage_of(stage: Column, stage_key: Column) -> Column:
    """An explicit stage, a listed key, a known beginning (the key before the stage), else collecting; nothing is submitted."""
    s, k = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (stage, stage_key))
    exact = {w: target for target, words in STAGE_KEYS.items() for w in words}
    known = ("submitted", "collecting", "persisting", "finalizing")

    def of(t: Column) -> Column:
        out = F.when(t.isin(*known), t).when(t.isin(*exact), aliased(t, exact, ""))
        for target, words in STAGE_PREFIXES:
            out = out.when(t.rlike("^(?:" + "|".join(words) + ")"), target)
        return out

    return F.coalesce(F.when(s.isin(*known), s), of(k), of(s), F.when((s == "") & (k == ""), "submitted").otherwise("collecting"))


def folded(events: DataFrame, key: str = "id", at: str = "at") -> DataFrame:
    """Runs from their events: of each column the last value that isn't null; cancel_requested holds until a final status."""
    values = [c for c in events.columns if c not in (key, at, "status")]
    final = F.col("status").isin("success", "failed", "cancelled")
    st = F.coalesce(F.max_by("status", F.when(final, F.col(at))), F.when(F.bool_or(F.col("status") == "cancel_requested"), F.lit("cancel_requested")), F.max_by("status", F.when(F.col("status").isNotNull(), F.col(at))))
    return events.groupBy(key).agg(st.alias("status"), *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(at))).alias(c) for c in values])


def backlog(ready: Column, scheduler_on: Column, failed_at: Column, succeeded_at: Column, base: Column, model: Column) -> Column:
    """Unknown until the overview is there; a warning where the scheduler is off or the latest failure is newer than the latest success; attention while work waits (of a model: null where none runs)."""
    fresh = failed_at.isNotNull() & (succeeded_at.isNull() | (failed_at > succeeded_at))
    waiting = (F.coalesce(base, F.lit(0)) > 0) | (F.coalesce(model, F.lit(0)) > 0)
    return F.when(~F.coalesce(ready, F.lit(False)), "unknown").when(~F.coalesce(scheduler_on, F.lit(False)) | fresh, "warning").when(waiting, "attention").otherwise("healthy")


def actions(task_type: Column, st: Column, cancel_requested: Column) -> Column:
    """What an administrator may do with a run, as a list of keys."""
    some = lambda *keys: F.array(*map(F.lit, keys))
    s = status(st)
    more = task_type.isin(*INCREMENTAL)
    return (
        F.when(~task_type.isin(*CONTENT_TYPES), some())
        .when(task_type.isin(*CANCELLABLE) & s.isin("queued", "running") & ~F.coalesce(cancel_requested, F.lit(False)), some("cancel"))
        .when(s == "failed", some("retry"))
        .when((s == "cancelled") & more, some("retry", "incremental"))
        .when(s == "cancelled", some("retry"))
        .when((s == "success") & more, some("rerun", "incremental"))
        .when(s == "success", some("rerun"))
        .otherwise(some().cast("array<string>"))
    )


def admin_view(runs: DataFrame, now: Column, labels: dict[str, str] | None = None) -> DataFrame:
    """Runs as the administration shows them: label, canonical status, stage, allowed actions, duration, and whether the snapshot can be trusted."""
    e = expired(runs, now)
    stage_key = F.col("stage_key") if "stage_key" in runs.columns else F.col("phase") if "phase" in runs.columns else F.lit(None).cast("string")
    asked = F.col("cancel_requested_at").isNotNull() if "cancel_requested_at" in runs.columns else F.col("status") == "cancel_requested"
    return e.withColumns(
        {
            "label": aliased(F.col("task_type"), labels or {t: t.replace("_", " ") for t in CONTENT_TYPES}, "task"),
            "stage": stage_of(F.lit(None).cast("string"), stage_key),
            "actions": actions(F.col("task_type"), F.col("status"), asked),
            "duration_seconds": F.greatest(F.timestamp_diff("SECOND", F.col("started_at"), F.coalesce("finished_at", now)), F.lit(0)),
            "trusted": ~F.col("is_stale"),
        }
    )


def scheduler_health(config: DataFrame, sources: DataFrame, running: bool, next_run_at: Column) -> DataFrame:
    """One row: status, ready, enabled and the list of issues. config: scheduler_configs (of several rows the least id counts); none is an error."""
    c = config.agg(F.min_by(F.struct("enabled", "interval_seconds", "default_source_id", "default_max_pages"), "id").alias("c")).select(F.col("c").isNotNull().alias("there"), "c.*")
    s = sources.select(F.col("id").alias("_s"), F.coalesce("is_active", F.lit(False)).alias("_active"))
    df = c.join(s, c["default_source_id"] == s["_s"], "left")
    on, run = F.coalesce("enabled", F.lit(False)), F.lit(running)
    found = F.col("_s").isNotNull()
    issues = F.array_compact(
        F.array(
            F.when(~F.col("there"), "scheduler_config_missing"),
            F.when(F.col("there") & ~run, "scheduler_not_running"),
            F.when(F.col("there") & ~on, "scheduler_disabled"),
            F.when(F.col("there") & F.col("default_source_id").isNull(), "default_source_missing"),
            F.when(F.col("default_source_id").isNotNull() & ~found, "default_source_not_found"),
            F.when(found & ~F.col("_active"), "default_source_inactive"),
            F.when(on & next_run_at.isNull(), "scrape_job_not_scheduled"),
        )
    )
    ready = F.col("there") & (~on | (run & F.coalesce("_active", F.lit(False)) & next_run_at.isNotNull()))
    return df.select(F.when(~F.col("there"), "error").when(F.size(issues) == 0, "ok").otherwise("degraded").alias("status"), ready.alias("ready"), F.when(F.col("there"), on).alias("enabled"), "interval_seconds", "default_source_id", "default_max_pages", issues.alias("issues"))


def next_scheduled(config: DataFrame, sources: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: decision (run, not_ready, conflict), source_id, max_pages, and the run in the way. What is off, without an active source, or already scraping is skipped."""
    c = config.agg(F.min_by(F.struct("enabled", "default_source_id", "default_max_pages"), "id").alias("c")).select("c.*")
    s = sources.filter("is_active").select(F.col("id").alias("_s"))
    other = blocked(runs, SCRAPES).agg(F.min("id").alias("blocking_id"))
    df = c.join(s, c["default_source_id"] == s["_s"], "left").crossJoin(F.broadcast(other))  # one row each
    decision = F.when(~F.coalesce("enabled", F.lit(False)) | F.col("_s").isNull(), "not_ready").when(F.col("blocking_id").isNotNull(), "conflict").otherwise("run")
    return df.select(decision.alias("decision"), F.col("default_source_id").alias("source_id"), F.col("default_max_pages").alias("max_pages"), "blocking_id")


def outcome(failures: int, cancelled: bool) -> str:
    """The state a run ends in."""
    return "cancelled" if cancelled else "failed" if failures else "success"


def run_parts(parts: Iterable, work: Callable, cancelled: Callable[[], bool]) -> dict:
    """Work on parts one by one; a request to cancel holds before the next one, and what is done stays. A failing part is counted and the others go on."""
    done = failures = 0
    stopped = False
    for part in parts:
        if stopped := cancelled():
            break
        try:
            work(part)
            done += 1
        except Exception:  # noqa: BLE001  any failure of a part is its own
            failures += 1
    return {"done": done, "failures": failures, "status": outcome(failures, stopped)}


def stuck(runs: DataFrame, now: Column, minutes: int = 10) -> DataFrame:
    """Running, with a heartbeat at least so old."""
    return runs.filter(status(F.col("status")).isin("running") & (F.timestamp_diff("SECOND", F.coalesce("heartbeat_at", "started_at"), now) >= minutes * 60))


def latest_by(events: DataFrame, by: str, at: str, key: str) -> DataFrame:
    """The last row of each group by time, then key. An aggregate of rows, so groups shrink before they move."""
    last = F.max_by(F.struct(*events.columns), F.struct(at, key)).alias("_r")
    return events.groupBy(F.col(by).alias("_by")).agg(last).select("_r.*")
