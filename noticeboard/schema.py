"""Explicit table schemas and closed vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_DDL = {
    "sources": "id bigint, name string, province string, source_type string, base_url string, scraper_class string, is_active boolean",
    "posts": "id bigint, source_id bigint, title string, content string, publish_date timestamp, canonical_url string, original_url string, duplicate_status string, duplicate_group_key string, primary_post_id bigint, duplicate_reason string, duplicate_checked_at timestamp, is_counselor boolean, confidence_score double, counselor_scope string, has_counselor_job boolean, scraped_at timestamp, created_at timestamp, updated_at timestamp",
    "post_fields": "id bigint, post_id bigint, field_name string, field_value string",
    "attachments": "id bigint, post_id bigint, filename string, file_url string, file_type string, file_size bigint, is_downloaded boolean, local_path string",
    "post_jobs": "id bigint, post_id bigint, job_name string, recruitment_count string, education_requirement string, major_requirement string, location string, political_status string, source_type string, is_counselor boolean, confidence_score double, raw_payload_json string, sort_order int",
    "post_analyses": "id bigint, post_id bigint, analysis_status string, analysis_provider string, event_type string, recruitment_stage string, tracking_priority string, school_name string, city string, should_track boolean, summary string, tags_json string, entities_json string, analyzed_at timestamp",
    "post_insights": "id bigint, post_id bigint, insight_status string, insight_provider string, recruitment_count_total int, counselor_recruitment_count int, degree_floor string, city_list_json string, gender_restriction string, political_status_required string, deadline_text string, deadline_date date, deadline_status string, has_written_exam boolean, has_interview boolean, has_attachment_job_table boolean, evidence_summary string, analyzed_at timestamp",
    "task_runs": "id string, task_type string, status string, summary string, source_id bigint, phase string, progress int, started_at timestamp, heartbeat_at timestamp, finished_at timestamp, duration_ms bigint, failure_reason string, rerun_of_task_id string",
    "parse_results": "file string, file_type string, parser string, text_length int, fields array<struct<field_name:string,field_value:string>>, jobs array<map<string,string>>, sidecar_version int, source_size bigint, source_mtime timestamp",
    "scheduler_configs": "id bigint, enabled boolean, interval_seconds int, default_source_id bigint, default_max_pages int, updated_at timestamp",
}


class _Schemas(dict):
    """Parsed on first use, since parsing needs a session and importing must not."""

    def __missing__(self, name: str) -> StructType:
        self[name] = StructType.fromDDL(_DDL[name])
        return self[name]


SCHEMAS: dict[str, StructType] = _Schemas()

# The closed vocabularies.
DUPLICATE_STATUS = ("none", "primary", "duplicate")
DUPLICATE_REASONS = ("canonical_url", "original_url", "source_date_title", "source_date_title_content_fingerprint")
SCOPES = ("none", "dedicated", "contains")
JOB_SOURCES = ("hybrid", "attachment", "attachment_pdf", "ai", "field")
NOTICE_SAFE_SOURCES = ("attachment", "attachment_pdf", "ai", "hybrid")
STAGES = ("submitted", "collecting", "persisting", "finalizing")
DEFAULTS: dict[str, dict[str, object]] = {"posts": {"duplicate_status": "none", "is_counselor": False, "counselor_scope": "none", "has_counselor_job": False}}


def conform(df: DataFrame, name: str) -> DataFrame:
    """Df in the schema of a table. Columns it lacks come in as their default (or null); null counts as the default; others go."""
    defaults = DEFAULTS.get(name, {})
    out = []
    for f in SCHEMAS[name].fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        c = F.coalesce(c, F.lit(defaults[f.name])) if f.name in defaults else c
        out.append(c.cast(f.dataType).alias(f.name))
    return df.select(out)
