"""Filters, lists, jobs, summaries, consolidation, tasks and sources on small tables."""

import datetime as dt
import io
import zipfile

from pyspark.sql import functions as F

from noticeboard.operators import filters, jobs, listing, merge, summary, tasks
from noticeboard.plans.profile import ZH
from noticeboard.schema import SCHEMAS, conform
from noticeboard.sources import pages, registry, sheets


def rows(spark, name, *dicts):
    s = SCHEMAS[name]
    return spark.createDataFrame([tuple(d.get(f.name) for f in s.fields) for d in dicts], s)


def seed(spark):
    day = lambda n: dt.datetime(2026, 3, n)
    post = lambda i, title, content, n, **kw: {"id": i, "source_id": 1, "title": title, "content": content, "publish_date": day(n), "duplicate_status": "none", **kw}
    p = rows(
        spark,
        "posts",
        post(1, "甲大学2026年公开招聘专职辅导员公告", "正文", 1, counselor_scope="dedicated", is_counselor=True, duplicate_status="primary"),
        post(2, "乙公司通知", "", 2),
        post(3, "丙学院招聘辅导员、专任教师公告", "正文", 3, counselor_scope="contains"),
        post(4, "丁学院公开招聘辅导员公告", "性别不限", 4, counselor_scope="dedicated"),
        post(5, "戊学院拟聘用人员名单公示", "名单", 5, counselor_scope=" None "),
        post(99, "甲大学2026年公开招聘专职辅导员公告", "正文", 1, duplicate_status="duplicate", primary_post_id=1, duplicate_reason="source_date_title"),
    )
    f = rows(spark, "post_fields", *[{"id": n, "post_id": i, "field_name": k, "field_value": v} for n, (i, k, v) in enumerate([(1, "性别要求", "男"), (1, "学历要求", "硕士"), (1, "工作地点", "南京"), (3, "性别要求", "男"), (3, "学历要求", "硕士研究生"), (5, "学历要求", "硕士"), (5, "工作地点", "南京"), (5, "性别要求", "男"), (1, "学历要求", "硕士")])])
    job = lambda n, i, name, source, **kw: {"id": n, "post_id": i, "job_name": name, "source_type": source, **kw}
    j = rows(
        spark,
        "post_jobs",
        job(1, 1, "专职辅导员", "attachment", is_counselor=True, sort_order=1),
        job(2, 1, "辅导员、专任教师、辅导员", "field", is_counselor=True, sort_order=0, recruitment_count="2人；3人"),
        job(3, 3, "辅导员（男）", "ai", is_counselor=True, location="苏州"),
        job(4, 4, "辅导员", "attachment", is_counselor=True, raw_payload_json='{"性别要求": "男女不限"}'),
        job(5, 5, "名单", "field", education_requirement="硕士"),
    )
    a = rows(spark, "post_analyses", {"id": 1, "post_id": 1, "event_type": "招聘公告", "analysis_status": "success"}, {"id": 2, "post_id": 5, "event_type": "结果公示", "analysis_status": "success"})
    s = rows(spark, "sources", {"id": 1, "name": "s", "province": "江苏", "is_active": True})
    return filters.Tables(jobs.with_state(p, j, ZH), f, j, a, s)


def ids(df):
    return {r.id for r in df.collect()}


def test_filters(spark):
    t = seed(spark)
    want = {
        filters.Filter(): {1, 2, 3, 4, 5},
        filters.Filter(search="甲大学"): {1},
        filters.Filter(search=" 甲%公告 ", wildcards=True): {1},
        filters.Filter(search="甲%公告"): set(),
        filters.Filter(has_content=False): {2},
        filters.Filter(gender="男", has_content=True): {1, 3},
        filters.Filter(gender="不限"): {4},
        filters.Filter(gender="其他"): {1, 2, 3, 4, 5},
        filters.Filter(education="硕士"): {1, 3},
        filters.Filter(location="苏州"): {3},
        filters.Filter(location="南京"): {1},
        filters.Filter(event_type="招聘公告"): {1},
        filters.Filter(province="江苏", search="辅导员"): {1, 3, 4},
        filters.Filter(province="其他"): set(),
        filters.Filter.of_scope("dedicated"): {1, 4},
        filters.Filter.of_scope("contains"): {3},
        filters.Filter.of_scope("any"): {1, 3, 4},
        filters.Filter.of_scope("all"): {1, 2, 3, 4, 5},
    }
    for f, got in want.items():
        assert ids(filters.apply(t, f, ZH)) == got, f


def test_or_of_children_is_one_join(spark):
    t = seed(spark)
    plan = filters.apply(t, filters.Filter(gender="不限"), ZH)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and plan.count("Join") <= 6


def test_state_and_jobs(spark):
    t = seed(spark)
    s = {r.id: r for r in t.posts.collect()}
    assert (s[1].jobs, s[1].role_jobs, s[1].has_attachment_jobs) == (1, 1, True)
    assert s[5].scope == "none" and not s[5].is_related and s[2].scope == "none" and s[3].has_role_job
    assert [(r.post_id, r.id) for r in jobs.snapshot(t.post_jobs, ZH).orderBy("post_id").collect()] == [(1, 1), (3, 3), (4, 4), (5, 5)]
    legacy = rows(spark, "posts", {"id": 7, "title": "甲大学公开招聘专职辅导员公告"})
    r = jobs.flags(jobs.with_state(legacy, t.post_jobs, ZH)).first()
    assert r.scope == "dedicated" and r.is_related and r.pending_extraction and r.changed and r.new_confidence == 0.9


def test_merged_jobs(spark):
    j = rows(spark, "post_jobs", {"id": 1, "post_id": 1, "job_name": " 专职 辅导员", "source_type": "field", "recruitment_count": "", "confidence_score": 0.0}, {"id": 2, "post_id": 1, "job_name": "专职辅导员", "source_type": "attachment", "recruitment_count": "2", "location": "南京"}, {"id": 3, "post_id": 1, "job_name": "辅导员", "source_type": "field"}, {"id": 4, "post_id": 1, "job_name": " ", "source_type": "field"})
    got = jobs.merged_jobs(j.withColumn("arrival", F.col("id")), ZH).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.job_name, r.recruitment_count, r.location, r.source_type, r.is_counselor, r.confidence_score) == ("专职辅导员", "2人", "南京", "hybrid", True, 0.85)


def test_lists(spark):
    t = seed(spark)
    assert [r.id for r in listing.page(filters.apply(t, filters.Filter(), ZH), 1, 2).collect()] == [4, 3]
    d = {r.requested_id: r for r in listing.redirected(t.posts).collect()}
    assert d[99].served_id == 1 and d[99].resolution_reason == "source_date_title" and d[1].resolution_reason is None
    pairs = {r.post_id: [tuple(x) for x in r.fields] for r in listing.field_pairs(t.post_fields).collect()}
    assert pairs[1] == [("性别要求", "男"), ("学历要求", "硕士"), ("工作地点", "南京")]
    assert listing.shown_fields(t.post_fields, t.post_analyses, ZH).filter("post_id = 5").count() == 1
    assert listing.list_item(t.posts, t.sources, t.post_analyses, t.post_fields).count() == 6


def test_summaries(spark):
    t = seed(spark)
    none = rows(spark, "attachments", {"id": 1, "post_id": 1})
    p = filters.apply(t, filters.Filter(), ZH)
    r = summary.public_summary(p, t.post_analyses, none, F.to_date(F.lit("2026-03-12"))).first()
    assert (r.posts, r.related, r.dedicated, r.contains, r.analysed, r.attachment_posts, r.posts_with_jobs, r.jobs, r.attachment_ratio, r.new_in_days) == (5, 3, 2, 1, 2, 1, 4, 4, 0.2, 1)
    assert {(x.value, x.n) for x in summary.distribution(t.post_analyses, "event_type").collect()} == {("招聘公告", 1), ("结果公示", 1)}
    assert summary.job_index_summary(p).first().pending == 0
    assert summary.duplicate_summary(t.posts).first().duplicates == 1
    i = rows(spark, "post_insights", {"post_id": 1, "insight_status": "success", "insight_provider": "rule", "deadline_text": "x", "city_list_json": '["南京", " 南京", ""]'}, {"post_id": 2, "insight_status": "failed", "deadline_text": ""})
    o = summary.insight_overview(p, i).first()
    assert (o.total, o.success, o.failed, o.with_deadline, o.pending) == (5, 1, 1, 1, 3)
    assert [(x.value, x.n) for x in summary.city_distribution(i).collect()] == [("南京", 2)]
    h = rows(spark, "post_jobs", {"post_id": 1, "recruitment_count": "2人；3人", "is_counselor": True}, {"post_id": 1, "recruitment_count": "4"}, {"post_id": 2, "recruitment_count": "若干"})
    f = rows(spark, "post_fields", {"id": 1, "post_id": 2, "field_name": "招聘人数", "field_value": "7人"})
    assert {(r.post_id, r.total, r.role_total) for r in summary.headcounts(h, f).collect()} == {(1, 9, 5), (2, 7, 7)}
    assert [r.v for r in spark.createDataFrame([("2人；3人",), ("2-3人",), ("",)], "c string").select(summary.headcount_text(F.col("c")).alias("v")).collect()] == ["5人", "2-3人", ""]


def test_pending(spark):
    t = seed(spark)
    i = rows(spark, "post_insights", {"post_id": 1, "insight_status": "success", "insight_provider": None})
    a = t.post_analyses.withColumn("analysis_provider", F.lit(None).cast("string"))
    assert ids(filters.pending_base(t.posts, a, i)) == {2, 3, 4, 5, 99}
    assert 1 not in ids(filters.pending_model(t.posts, a, i, True))  # a null provider isn't another one
    att = rows(spark, "attachments", {"post_id": 1, "filename": "a.xls", "file_type": "xls"}, {"post_id": 2, "filename": "down.JSP", "file_type": "xls"}, {"post_id": 3, "filename": "a", "file_type": " "})
    assert ids(filters.needs_attachments(t.posts, att)) == {2, 3, 4, 5, 99}


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "z"), (4, "c", None)], "id bigint, k string, v string")
    new = spark.createDataFrame([("a", "x", 1), ("b", "q", 1), ("b", "r", 2), ("d", "n", 1), (None, "o", 1)], "k string, v string, at int")
    plan = {(r.op, r.id, r.k, r.v) for r in merge.upsert_plan(old, new, ["k"], ["v"], order="at").collect()}
    assert plan == {("keep", 1, "a", "x"), ("delete", 2, "a", "y"), ("update", 3, "b", "r"), ("delete", 4, "c", None), ("insert", None, "d", "n")}
    snap = merge.applied(merge.upsert_plan(old, new, ["k"], ["v"], order="at"), 100).collect()
    assert {r.k for r in snap} == {"a", "b", "d"} and len({r.id for r in snap}) == 3
    e = spark.createDataFrame([(1, "u1", "t", "2026", "o", "c"), (2, "u2", "t", "2026", "o", "c")], "id bigint, canonical_url string, title string, publish_date string, original_url string, content string")
    i = spark.createDataFrame([("u1", "t2", "", None, ""), ("u3", "n", "", "", "")], "canonical_url string, title string, publish_date string, original_url string, content string")
    got = {r.canonical_url: r for r in merge.upserted_posts(e, i).collect()}
    assert (got["u1"].op, got["u1"].reclassify, got["u1"].title, got["u1"].content) == ("update", True, "t2", "c")
    assert got["u2"].op == "keep" and got["u3"].op == "insert"
    r = rows(spark, "post_analyses", {"post_id": 1, "analysis_status": "success", "analysis_provider": "openai", "summary": "m"}, {"post_id": 2, "analysis_status": "failed", "analysis_provider": "openai", "summary": "m"})
    n = rows(spark, "post_analyses", *[{"post_id": k, "analysis_status": "success", "analysis_provider": "rule", "summary": "r"} for k in (1, 2, 3)])
    assert {x.post_id: x.summary for x in merge.upserted_results(r, n, "analysis_status", "analysis_provider").collect()} == {1: "m", 2: "r", 3: "r"}
    assert {x.summary for x in merge.upserted_results(r, n, "analysis_status", "analysis_provider", force=True).collect()} == {"r"}
    a = spark.createDataFrame([(1, "u", "n", "pdf"), (2, "u", "n", "pdf")], "post_id bigint, u string, n string, t string")
    b = spark.createDataFrame([(1, "u", "n", "pdf"), (2, "u", "n", "xls")], "post_id bigint, u string, n string, t string")
    assert [x.post_id for x in merge.metadata_changed(a, b, "post_id", "u", ["n", "t"]).collect()] == [2]


def test_tasks(spark):
    t = lambda h: dt.datetime(2026, 1, 1, h)
    r = rows(spark, "task_runs", {"id": "a", "task_type": "manual_scrape", "status": "processing", "started_at": t(1), "heartbeat_at": t(11)}, {"id": "b", "task_type": "manual_scrape", "status": "running", "started_at": t(9)}, {"id": "c", "task_type": "manual_scrape", "status": "success", "finished_at": t(5), "source_id": 1}, {"id": "d", "task_type": "manual_scrape", "status": "success", "finished_at": t(6), "source_id": 2}, {"id": "e", "task_type": "ai_analysis", "status": "success", "finished_at": t(10), "source_id": 1})
    now = F.to_timestamp(F.lit("2026-01-01 12:00:00"))
    e = {x.id: x for x in tasks.expired(r, now).collect()}
    assert e["a"].status == "running" and e["b"].status == "failed" and e["b"].is_stale and e["c"].status == "success"
    h = tasks.runtime_health(r, now).first()
    assert (h.running, h.stale, h.age_seconds) == (2, 1, 3600)
    assert {(x.source_id, x.id) for x in tasks.freshness(r).collect()} == {(1, "c"), (2, "d"), (None, "d")}
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    at = lambda h: F.to_timestamp(F.lit(f"2026-01-01 {h:02d}:00:00"))
    assert one(tasks.freshness_health(at(9), now, 3600)) == "latest_success_too_old" and one(tasks.freshness_health(at(11), now, 3600)) == "ok"
    stages = [("", "", "submitted"), ("x", "", "collecting"), ("persisting", "count-x", "persisting"), ("", "write-complete", "finalizing"), ("", "write-it", "persisting"), ("fetch", "", "collecting"), ("", "no-posts", "finalizing")]
    assert [one(tasks.stage_of(F.lit(s), F.lit(k))) for s, k, _ in stages] == [w for _, _, w in stages]
    assert one(tasks.health(F.lit(True), F.lit(True), F.lit(False), F.lit(True))) == "degraded"
    ev = spark.createDataFrame([("a", 1, "running", 10), ("a", 2, "cancel_requested", None), ("a", 3, "running", 30), ("b", 1, "cancel_requested", 1), ("b", 2, "success", None)], "id string, at int, status string, progress int")
    assert {x.id: (x.status, x.progress) for x in tasks.folded(ev).collect()} == {"a": ("cancel_requested", 30), "b": ("success", 1)}


def test_stale_to_the_microsecond(spark):
    seen = [dt.datetime(2026, 1, 1, 10), dt.datetime(2026, 1, 1, 9, 59, 59, 999_999)]
    r = rows(spark, "task_runs", *[{"id": str(k), "task_type": "manual_scrape", "status": "running", "started_at": t} for k, t in enumerate(seen)])
    now = F.to_timestamp(F.lit("2026-01-01 12:00:00"))
    assert {x.id: x.is_stale for x in tasks.expired(r, now).collect()} == {"0": False, "1": True}
    h = tasks.runtime_health(r.filter("id = '1'"), now).first()
    assert (h.running, h.stale, h.age_seconds) == (1, 1, 7200)


def test_pages(spark):
    html = """<html><head><title> A  page </title></head><body><p>outside</p><div class="x content"><p>一、岗位</p><table><tr><th>岗位</th><th>人数</th></tr><tr><td>甲</td><td>2</td></tr></table><script>no</script><p>时间：3月</p><p><a href="/f/%E8%A1%A8.xlsx">附件：表.xlsx</a></p></div><p>after</p></body></html>"""
    d = pages.detail(html, "https://e.org/x/y.html")
    assert d["content"] == "岗位 | 人数\n甲 | 2\n\n一、岗位\n\n时间：3月"
    assert d["attachments"] == [{"filename": "附件：表.xlsx", "file_url": "https://e.org/f/%E8%A1%A8.xlsx", "file_type": "xlsx"}]
    df = spark.createDataFrame([("u", html), ("v", "<html><title>404 Not Found</title><body></body></html>"), ("w", None)], "url string, html string")
    got = {r.url: r for r in pages.details(df).collect()}
    assert not got["u"].detail_failed and got["v"].detail_failed and got["w"].detail_failed
    listing_page = '<datastore><record><![CDATA[<a href="/1"><span class="list_title">T<b>1</b></span><i>2026-03-01</i></a>]]></record><record><![CDATA[<a href=""></a>]]></record></datastore>'
    r = pages.list_records(spark.createDataFrame([("p", listing_page)], "url string, html string"), F.to_timestamp(F.lit("2000-01-01"))).collect()
    assert [(x.href, x.title, x.publish_date) for x in r] == [("/1", "T1", dt.datetime(2026, 3, 1))]
    names = spark.createDataFrame([("https://e.org/d?file=a/b%20c.pdf",), ("https://e.org/x/%E8%A1%A8.xls?q=1#f",)], "u string").select(pages.link_filename(F.col("u")).alias("n"), pages.file_type(F.lit("n"), F.col("u")).alias("t"))
    assert [tuple(x) for x in names.collect()] == [("b c.pdf", "pdf"), ("表.xls", "xls")]


def test_stale_parse_results(spark):
    t = dt.datetime(2026, 1, 1)
    paths = ["none", "fits", "fits", "version", "kind", "size", "time", "fields", "jobs", "two", "both", None]
    files = spark.createDataFrame([(n, p, 10, t, "pdf") for n, p in enumerate(paths)], "n int, path string, length bigint, modificationTime timestamp, file_type string")
    good = {"file_type": "pdf", "sidecar_version": sheets.PARSER_VERSION, "source_size": 10, "source_mtime": t, "fields": [], "jobs": []}
    odd = {"version": {"sidecar_version": 1}, "kind": {"file_type": None}, "size": {"source_size": 9}, "time": {"source_mtime": None}, "fields": {"fields": None}, "jobs": {"jobs": None}}
    made = [("fits", good), (None, good), *[(p, good | o) for p, o in odd.items()], ("two", good | odd["size"]), ("two", good | odd["kind"]), ("both", good | odd["size"]), ("both", good)]
    results = spark.createDataFrame([(p, *r.values()) for p, r in made], "file string, file_type string, sidecar_version int, source_size bigint, source_mtime timestamp, fields array<string>, jobs array<string>")
    assert sorted(r.n for r in sheets.stale(files, results).collect()) == [0, 3, 4, 5, 6, 7, 8, 9, 11]


def test_sheets(spark):
    head = ["序号", "岗位名称", "招聘人数", "学历要求", "专业要求", "工作地点"]
    s = spark.createDataFrame([("f", [["标题", "", ""], head, ["1", "专职辅导员", "2", "硕士", "教育", "南京"], ["2", "教师", "1", "博士", "x", "y"]]), ("g", [["辅导员 甲"], [""]]), ("h", [])], "file string, rows array<array<string>>")
    got = {(r.file, r.job_name): r for r in sheets.jobs_from_rows(s, ZH).collect()}
    assert set(got) == {("f", "专职辅导员"), ("g", "辅导员 甲")}
    assert got[("f", "专职辅导员")].recruitment_count == "2人" and got[("f", "专职辅导员")].location == "南京"
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>a</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>7</v></c></row></sheetData></worksheet>')
    f = spark.createDataFrame([("p", bytearray(b.getvalue()), "xls"), ("q", bytearray(b"junk"), "xlsx")], "path string, content binary, file_type string")
    assert {r.file: r.rows for r in sheets.sheet_rows(f).collect()} == {"p": [["a", "", "7"]], "q": None}
    k = f.select("path", sheets.resolved_kind(F.lit("x.xls"), F.lit(""), F.col("content")).alias("k"))
    assert {r.path: r.k for r in k.collect()} == {"p": "xlsx", "q": "xls"}


def test_registry_and_schema(spark):
    import pytest

    with pytest.raises(registry.SourceError):
        registry.read(spark, " ", "x")
    with pytest.raises(registry.SourceError) as e:
        registry.ready({"is_active": False})
    assert e.value.status == 409
    r = conform(spark.createDataFrame([(1, None)], "id bigint, is_counselor boolean"), "posts").first()
    assert r.is_counselor is False and r.duplicate_status == "none" and r.title is None


def test_html_with_implied_end_tags():
    from noticeboard.sources.pages import detail

    text = lambda html: detail(html, "http://h/a")["content"]
    assert text('<div class="content"><div class="clear"><p>x</div><p>real text</p></div><p>footer</p>') == "real text"
    assert text('<div class="content"><ul><li>one<li>two</ul><p>a<p>b</div><p>footer') == "one\n\ntwo\n\na\n\nb"
    assert text('<div class="content"><table><tr><td>1<td>2<tr><td>3</table></div>footer') == "1 | 2\n3"
    assert text('<div class="content"><p>a</i></p></span>b<p>c</div></div><p>d') == "a\n\nc"
    assert text("<p>no container<div>loose</div>") == "no container"
    got = detail('<div id="Zoom"><p>see <a href="f.pdf">plan.pdf<p>end</div>', "http://h/a/b")
    assert got == {"content": "end", "attachments": [{"filename": "plan.pdf", "file_url": "http://h/a/f.pdf", "file_type": "pdf"}]}


def _tree(rng, depth=0):
    """HTML with every end tag, the same with those left out that may be, and the texts of its blocks."""
    full, short, blocks = "", "", []
    for _ in range(rng.randint(1, 3)):
        word, kind = f"w{rng.randrange(10**6)}", rng.choice("p li div".split() if depth < 3 else ["p"])
        if kind == "p":
            full, short, blocks = full + f"<p>{word}</p>", short + f"<p>{word}", [*blocks, word]
        elif kind == "li":
            full, short, blocks = full + f"<ul><li>{word}</li><li>{word}x</li></ul>", short + f"<ul><li>{word}<li>{word}x</ul>", [*blocks, word, f"{word}x"]
        else:
            a, b, c = _tree(rng, depth + 1)
            full, short, blocks = full + f"<div>{a}</div>", short + f"<div>{b}</div>", blocks + c
    return full, short, blocks


def test_html_with_and_without_end_tags_gives_the_tree_s_texts():
    import random

    from noticeboard.sources.pages import detail

    rng = random.Random(1)
    for _ in range(300):
        full, short, blocks = _tree(rng)
        for html in (full, short):
            assert detail(f'<body><p>before</p><div class="main-content">{html}</div><p>after</p></body>', "u")["content"] == "\n\n".join(blocks)


def test_notices_of_the_domain(spark):
    """Analyses, insights and jobs by the Chinese profile, on a notice with all of it."""
    from pyspark.sql import functions as F

    from noticeboard.operators import analysis, jobs
    from noticeboard.plans.profile import ZH

    posts = spark.createDataFrame([(1, "南京大学2026年公开招聘专职辅导员公告", "笔试和面试在南京举行", True), (2, "某校2025年拟聘用人员名单公示", "名单公示", True), (3, "招聘辅导员、专任教师公告", "无", False)], "id bigint, title string, content string, is_counselor boolean")
    fields = spark.createDataFrame([(1, 1, "招聘人数", "5人"), (2, 1, "学历要求", "硕士"), (3, 1, "报名时间", "2026年3月1日至3月9日"), (4, 1, "工作地点", "苏州市"), (5, 3, "岗位名称", "教师")], "id bigint, post_id bigint, field_name string, field_value string")
    files = spark.createDataFrame([(1, 2)], "post_id bigint, parsed_jobs int")
    none = spark.createDataFrame([], "id bigint, post_id bigint, job_name string, recruitment_count string, education_requirement string, major_requirement string, location string, political_status string, source_type string, is_counselor boolean, confidence_score double, raw_payload_json string")
    a = {r.post_id: r for r in analysis.rule_analysis(posts, fields, files, ZH).collect()}
    assert (a[1].event_type, a[1].recruitment_stage, a[1].school_name, a[1].city, a[1].tracking_priority) == ("招聘公告", "招聘启动", "南京大学", "苏州", "high")
    assert a[1].summary == "这条信息归类为招聘公告。单位是南京大学。地点偏向苏州。当前提取到招聘人数 5人。学历要求是硕士。报名时间是2026年3月1日至3月9日。"
    assert a[1].tags_json == '["招聘公告","辅导员相关","硕士","含附件"]' and a[1].entities_json == '["南京大学","苏州","苏州市"]'
    assert (a[2].event_type, a[2].should_track, a[2].tracking_priority) == ("结果公示", False, "low")
    i = {r.post_id: r for r in analysis.rule_insight(posts, fields, none, files, spark.createDataFrame([], "post_id bigint, city string"), F.to_date(F.lit("2026-02-27")), ZH).collect()}
    assert (i[1].recruitment_count_total, i[1].counselor_recruitment_count, i[1].degree_floor, i[1].deadline_status) == (5, 5, "硕士", "即将截止")
    assert i[1].has_written_exam and i[1].has_interview and i[1].has_attachment_job_table and i[1].city_list_json == '["苏州","南京"]'
    assert i[1].evidence_summary == "辅导员岗位约 5 人；报名节点：2026年3月1日至3月9日；学历：硕士" and i[2].deadline_status == "未说明"
    got = {r.post_id: r.job_name for r in jobs.field_jobs(posts, fields, ZH).collect()}
    assert got == {1: "专职辅导员", 3: "辅导员"}


def test_cancelled_and_failing_parts():
    from noticeboard.operators import tasks

    seen = []

    def work(x):
        if x == 2:
            raise ValueError(x)
        seen.append(x)

    assert tasks.run_parts([1, 2, 3], work, lambda: False) == {"done": 2, "failures": 1, "status": "failed"} and seen == [1, 3]
    assert tasks.run_parts([1, 2, 3], lambda x: seen.append(x), lambda: len(seen) >= 3)["status"] == "cancelled" and len(seen) == 3


def test_crawl_stops_and_raises(spark):
    import pytest

    from noticeboard.sources import pages

    page = lambda n: spark.range(n, n + 2)

    def fetch(n):
        if n == 4:
            raise OSError("gone")
        return page(n) if n != 6 else page(n).limit(0)

    got, n = pages.crawl(fetch, 9)
    assert n == 3 and got.count() == 6 and pages.crawl(fetch, 2)[1] == 2
    with pytest.raises(OSError):
        pages.crawl(lambda n: fetch(4), 3)


def test_rebuild_and_backfill_of_duplicates(spark):
    from pyspark.sql import functions as F

    from noticeboard.operators import entities

    rows = [(i, 1, f"t{i // 3}", "text", f"2024-01-0{1 + i % 2}", None, " ", "none", None, None, None, None) for i in range(9)]
    posts = spark.createDataFrame(rows, "id bigint, source_id bigint, title string, content string, publish_date string, canonical_url string, original_url string, duplicate_status string, duplicate_group_key string, primary_post_id bigint, duplicate_reason string, duplicate_checked_at timestamp").withColumn("publish_date", F.to_timestamp("publish_date"))
    members = posts.select("id", "source_id", F.lit(True).alias("has_content"), *[F.lit(0).alias(c) for c in ("n_attachments", "n_fields", "n_jobs", "analysis_score", "insight_score")], F.lit(None).cast("timestamp").alias("created_at"))
    now = F.to_timestamp(F.lit("2024-02-01"))
    whole = {r.id: (r.duplicate_status, r.primary_post_id) for r in entities.rebuilt(posts, members, now, full_fold=False).collect()}
    assert whole == {i: ("primary", None) if i % 3 == 0 else ("duplicate", i - i % 3) for i in range(9)}
    few = {r.id: r.duplicate_status for r in entities.rebuilt(posts, members, now, limit=4, full_fold=False).collect()}
    assert few == dict.fromkeys(range(9), "none") | {3: "primary", 5: "duplicate"}
    out, counts = entities.backfilled(posts, members, now, 3, full_fold=False)
    c = counts.first()
    assert c.selected == 3 and c.remaining_unchecked == out.filter("duplicate_checked_at is null").count() and c.groups >= 1
    plan = entities.edges(entities.keyed(posts, full_fold=False))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan  # the keys are read from their table; no text is read again


def test_history_is_normalised_by_the_source_s_profile(spark):
    from noticeboard.plans.profile import ZH
    from noticeboard.sources import registry

    assert registry.profile_of(" JiangsuHRSSScraper ") is ZH and registry.profile_of("Other") is None and registry.profile_of(None) is None
    sources = spark.createDataFrame([(1, "JiangsuHRSSScraper"), (2, "Other"), (3, None)], "id bigint, scraper_class string")
    text = "首页\n正文一\n\n\n\n打印本页\n正文二"
    posts = spark.createDataFrame([(10, 1, text), (11, 2, text), (12, 3, text), (13, 9, "plain"), (14, 1, " "), (15, 1, None)], "id bigint, source_id bigint, content string")
    got = {r.id: r for r in registry.renormalised(posts, sources).collect()}
    assert set(got) == {10, 11, 12, 13} and not got[13].changed and got[10].changed
    assert "首页" not in got[10].content and "打印本页" not in got[10].content and "正文二" in got[10].content
    assert "首页" in got[11].content and got[11].content == got[12].content


def test_a_batch_s_rows_drive_the_refresh(spark):
    from noticeboard.streaming import ingest

    posts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id bigint, canonical_url string")
    batch = spark.createDataFrame([("b",), ("b",), ("new",)], "canonical_url string")
    assert [r.id for r in ingest.touched(batch, posts, lambda p, ids: ids).collect()] == [2]


def test_pdf_texts_by_a_given_reader(spark):
    from noticeboard.sources import sheets

    def read(data):
        if data == b"bad":
            raise ValueError("no PDF")
        return data.decode().split("|")

    files = spark.createDataFrame([("a", bytearray(b"one| |two ")), ("b", bytearray(b"bad")), ("c", None)], "path string, content binary")
    assert {r.file: r.text for r in sheets.pdf_texts(files, read).collect()} == {"a": "one\n\ntwo", "b": None, "c": None}


def test_a_shared_folder_is_needed_off_local_mode():
    import types

    import pytest

    from noticeboard.sources import tables

    conf = types.SimpleNamespace(get=lambda *a: None)
    fake = lambda master: types.SimpleNamespace(conf=conf, sparkContext=types.SimpleNamespace(master=master, applicationId="x", _conf=conf))
    assert tables.shared_dir(fake("local[2]")).startswith("file:///tmp/")
    with pytest.raises(RuntimeError):
        tables.shared_dir(fake("spark://h:7077"))
