"""Attachments: file kinds, stale parse results, sheet rows to jobs. Readers of binary formats are pluggable."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeboard.functions.classify import fields
from noticeboard.functions.text import cell, compact, count_text, has_any, strip
from noticeboard.operators.filters import needs_attachments
from noticeboard.operators.merge import attachment_upserts
from noticeboard.plans.profile import RuleProfile
from noticeboard.sources.tables import ship

PARSER_VERSION = 2
#: fixed values: the roles whose rows are kept
TARGETS = ("专职辅导员", "辅导员", "学生辅导员", "思政辅导员")
Rows = list[list[str]]
READERS: dict[str, Callable[[bytes], Rows]] = {}


def reader(kind: str) -> Callable:
    """Register a function bytes -> rows for a file type."""

    def add(fn: Callable[[bytes], Rows]) -> Callable:
        READERS[kind] = fn
        return fn

    return add


@reader("xlsx")
def xlsx_rows(content: bytes) -> Rows:
    """All sheets' rows, by the standard library alone."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        strings = []
        if "xl/sharedStrings.xml" in names:
            strings = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        rows = []
        for sheet in sorted(n for n in names if n.startswith("xl/worksheets/") and n.endswith(".xml")):
            for row in ElementTree.fromstring(z.read(sheet)).iter(f"{{{ns['m']}}}row"):
                out: list[str] = []
                for c in row.findall("m:c", ns):
                    letters = "".join(x for x in c.get("r", "") if x.isalpha())
                    at = 0
                    for x in letters:
                        at = at * 26 + ord(x) - 64
                    out += [""] * (at - 1 - len(out)) if at else []
                    v = c.find("m:v", ns)
                    text = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t")) if c.get("t") == "inlineStr" else (v.text or "" if v is not None else "")
                    out.append(strings[int(text)] if c.get("t") == "s" and text else text)
                rows.append(out)
    return rows


@reader("csv")
def csv_rows(content: bytes) -> Rows:
    import csv

    return list(csv.reader(io.StringIO(content.decode("utf-8-sig", "replace"))))


def kind_by_content(content: Column) -> Column:
    """By magic bytes: OLE is xls, ZIP is a candidate for xlsx."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head == "D0CF11E0A1B11AE1", "xls").when(head.startswith("504B0304"), "xlsx").when(head.startswith("255044462D"), "pdf")


def resolved_kind(name: Column, declared: Column, content: Column) -> Column:
    """A suffix that says it, else the declared type, else the content."""
    suffix = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([A-Za-z0-9]+)$", 1))
    sure = F.when(suffix.isin("xls", "xlsx", "pdf", "doc", "docx", "zip", "rar", "csv"), suffix)
    by_content = kind_by_content(content)
    sheet = by_content.isin("xls", "xlsx") & sure.isin("xls", "xlsx")
    return F.coalesce(F.when(sheet, by_content), sure, F.nullif(F.lower(F.trim(declared)), F.lit("")), by_content)


def stale(files: DataFrame, results: DataFrame) -> DataFrame:
    """Files (path, length, modificationTime, file_type) whose parse result is missing or doesn't fit any more; each file once, and of several results of a path one that fits is enough."""
    good = results.filter((F.col("sidecar_version") == PARSER_VERSION) & F.col("fields").isNotNull() & F.col("jobs").isNotNull())
    r = good.select(F.col("file").alias("_f"), F.col("file_type").alias("_kind"), F.col("source_size").alias("_size"), F.col("source_mtime").alias("_time"))
    fits = (files["path"] == r["_f"]) & files["file_type"].eqNullSafe(r["_kind"]) & (files["length"] == r["_size"]) & (files["modificationTime"] == r["_time"])
    return files.join(r, fits, "left_anti")


def sheet_rows(files: DataFrame, readers: dict[str, Callable[[bytes], Rows]] | None = None) -> DataFrame:
    """File, rows of files (path, content, file_type); if a sheet's declared type fails, the other one is tried."""
    by = dict(READERS if readers is None else readers)

    ship(files.sparkSession)

    def parse(kind: pd.Series, content: pd.Series) -> pd.Series:
        def one(k: str | None, data: bytes | None):
            for t in [k, *({"xls", "xlsx"} - {k} if k in ("xls", "xlsx") else ())]:
                try:
                    if t in by and data is not None:
                        return [[str(x) if x is not None else "" for x in row] for row in by[t](data)]
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError):
                    continue
            return None

        return pd.Series([one(k, c) for k, c in zip(kind, content, strict=True)])

    return files.select(F.col("path").alias("file"), F.pandas_udf(parse, "array<array<string>>")("file_type", "content").alias("rows"))


def pdf_texts(files: DataFrame, read: Callable[[bytes], list[str]]) -> DataFrame:
    """File, text: the pages of PDF files (path, content) by a given reader of bytes, joined by blank lines; a file it can't read has no text."""
    ship(files.sparkSession)

    def parse(content: pd.Series) -> pd.Series:
        def one(data: bytes | None):
            try:
                return "\n\n".join(x.strip() for x in read(data) if x and x.strip()) if data is not None else None
            except (ValueError, KeyError, EOFError):
                return None

        return content.map(one)

    return files.select(F.col("path").alias("file"), F.pandas_udf(parse, "string")("content").alias("text"))


LEAST_TEXT = 20


def jobs_from_texts(texts: DataFrame, p: RuleProfile, *, key: str = "file") -> DataFrame:
    """At most one job for each text (key, text): the first target role it names, with the fields that the profile's rules find in texts of LEAST_TEXT characters or more."""
    t = texts.select(key, cell(F.coalesce("text", F.lit(""))).alias("text"))
    name = F.coalesce(*[F.when(F.contains("text", F.lit(w)), w) for w in TARGETS])
    found = fields(t.filter(F.length("text") >= LEAST_TEXT).select(F.col(key).alias("id"), F.lit("").alias("title"), F.col("text").alias("content")), p)
    m = found.groupBy(F.col("post_id").alias("_k")).agg(F.map_from_entries(F.collect_list(F.struct("field_name", "field_value"))).alias("field_map"))
    df = t.select(key, name.alias("job_name")).filter("job_name is not null")
    df = df.join(m, df[key] == m["_k"], "left")
    w = p.wording
    value = lambda n: F.coalesce(F.try_element_at("field_map", F.lit(n)), F.lit(""))
    return df.select(key, "job_name", count_text(value(w.headcount)).alias("recruitment_count"), value(w.education).alias("education_requirement"), value(w.major).alias("major_requirement"), value(w.place).alias("location"), value(w.political).alias("political_status"), F.lit("attachment_pdf").alias("source_type"), F.lit(True).alias("is_counselor"), F.coalesce(F.to_json("field_map"), F.lit("{}")).alias("raw_payload_json"))


def downloads(attachments: DataFrame, fetched: DataFrame, force: bool = False) -> DataFrame:
    """What a landing job does with each attachment: skip (there already, not forced), keep (the same bytes again) or write. fetched: id, content, and of the stored file old_sha1, or null."""
    f = fetched.select(F.col("id").alias("_f"), F.sha1("content").alias("new_sha1"), F.length("content").alias("new_size"), "old_sha1")
    j = attachments.join(f, attachments["id"] == f["_f"], "left")
    there = F.coalesce("is_downloaded", F.lit(False)) & F.col("old_sha1").isNotNull()
    op = F.when(there & F.lit(not force), "skip").when(F.col("new_sha1").isNull(), "failed").when(F.col("new_sha1") == F.col("old_sha1"), "keep").otherwise("write")
    return j.select(attachments["*"], op.alias("op"), F.when(op.isin("keep", "write"), F.col("new_size")).otherwise(F.col("file_size").cast("int")).alias("new_size"))


def attachment_backfill(posts: DataFrame, attachments: DataFrame, found: DataFrame, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """The newest posts that want their attachments looked for again (P18), and the plan for these from what their pages gave (found: post_id, file_url, filename, file_type, position)."""
    chosen = needs_attachments(posts, attachments).orderBy(F.col("publish_date").desc_nulls_last(), F.col("id").desc()).limit(limit)
    mine = found.join(chosen.select(F.col("id").alias("_c")), F.col("post_id") == F.col("_c"), "left_semi")
    return chosen, attachment_upserts(attachments, mine, chosen.select("id"), "position", replace=False)


def header_field(c: Column, p: RuleProfile) -> Column:
    """The first field one of whose aliases the cell holds."""
    v = compact(cell(c))
    return F.coalesce(*[F.when((v != "") & has_any(v, aliases), name) for name, aliases in p.header_alias.items()])


def jobs_from_rows(sheets: DataFrame, p: RuleProfile, *, key: str = "file") -> DataFrame:
    """One row per job of sheets (key, rows array<array<string>>), by expressions alone.

    The header is the first of the first ten rows with most fields; of a field the first column counts. Rows below it
    that hold a target role become jobs; without a name column the first cell with the role is the name.
    """
    cleaned = F.filter(F.transform("rows", lambda r: F.transform(r, lambda c: cell(F.coalesce(c, F.lit(""))))), lambda r: F.exists(r, lambda c: c != ""))
    d = sheets.select(key, cleaned.alias("rows"))
    names = F.transform(F.slice("rows", 1, 10), lambda r: F.transform(r, lambda c: F.coalesce(header_field(c, p), F.lit(""))))
    d = d.withColumn("names", names)
    scores = F.transform("names", lambda n: F.size(F.array_distinct(F.filter(n, lambda x: x != ""))))
    best = F.array_max(scores)
    d = d.withColumn("at", F.when(F.coalesce(best, F.lit(0)) > 0, F.array_position(scores, best)).otherwise(0).cast("int")).withColumn("head", F.when(F.col("at") > 0, F.get("names", F.col("at") - 1)))
    body = d.select(key, "head", F.posexplode(F.slice("rows", F.col("at") + 1, F.greatest(F.size("rows") - F.col("at"), F.lit(0)))).alias("nth", "row"))
    body = body.filter(F.exists("row", lambda c: has_any(c, TARGETS)))
    value = lambda name: F.coalesce(F.when(F.array_position("head", name) > 0, F.get("row", F.array_position("head", name).cast("int") - 1)), F.lit(""))
    role = F.get(F.filter("row", lambda c: has_any(c, TARGETS)), F.lit(0))
    named = F.coalesce(F.nullif(value("岗位名称"), F.lit("")), role)
    out = body.select(key, "nth", named.alias("job_name"), count_text(value("招聘人数")).alias("recruitment_count"), value("学历要求").alias("education_requirement"), value("专业要求").alias("major_requirement"), value("工作地点").alias("location"), F.lit("").alias("political_status"), F.lit("attachment").alias("source_type"))
    return out.withColumn("is_counselor", has_any(F.col("job_name"), TARGETS)).filter(strip(F.col("job_name")) != "")
