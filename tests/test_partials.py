"""Summaries put together from days' partials, and pages of a list kept in ranges, against the plain ones after random batches."""

import datetime as dt
import random
import re

from pyspark.sql import functions as F

from noticeboard.operators.keyset import KeysetPages
from noticeboard.operators.listing import page
from noticeboard.operators.partials import DailySummary

START = dt.date(2026, 1, 1)
ROW = "day date, kind string, post bigint, jobs int, at timestamp"


def summary(spark, root, **more):
    jobs = F.col("jobs")
    return DailySummary(spark, f"file://{root}", F.col("day"), ("kind",), counts={"big": jobs > 5}, sums={"total": (jobs, "bigint")}, latest={"latest": (F.col("at"), "timestamp")}, distinct={"posts": F.col("post"), "big_posts": F.when(jobs > 5, F.col("post"))}, buckets=8, **more)


def plain(rows, first, last, by):
    groups = {}
    for r in rows:
        if r[0] is not None and first <= r[0] <= last:
            groups.setdefault((r[1],) if by else (), []).append(r)
    if not by:
        groups.setdefault((), [])
    one = lambda g: (len(g), sum((r[3] or 0) > 5 for r in g), sum(r[3] for r in g if r[3] is not None) if any(r[3] is not None for r in g) else None, max((r[4] for r in g if r[4]), default=None), len({r[2] for r in g} - {None}), len({r[2] for r in g if (r[3] or 0) > 5} - {None}))
    return {k: one(g) for k, g in groups.items()}


def shown(df, by):
    return {(r["kind"],) if by else (): (r["n"], r["big"], r["total"], r["latest"], r["posts"], r["big_posts"]) for r in df.collect()}


def test_summary_of_any_range_equals_the_full_one(spark, tmp_path):
    rng = random.Random(3)
    ids = [-40000, -1, 0, 1, 32768, 32769, 70000, None, *range(2, 20)]
    make = lambda n: [(rng.choice([None, *[START + dt.timedelta(days=i) for i in range(12)]]), rng.choice(["a", "b", None, ""]), rng.choice(ids), rng.choice([None, 1, 3, 6, 9]), rng.choice([None, dt.datetime(2026, 2, rng.randint(1, 28))])) for _ in range(n)]
    s, rows = summary(spark, tmp_path), []
    empty = spark.createDataFrame([], ROW)
    s.add(0, empty)
    assert shown(s.summary("2026-01-01", "2026-12-31"), ()) == {(): (0, 0, None, None, 0, 0)} and s.summary("2026-01-01", "2026-12-31", ("kind",)).count() == 0
    for batch in (1, 2):
        new = make(60)
        rows += new
        for _ in range(batch):  # the second one comes twice
            s.add(batch, spark.createDataFrame(new, ROW))
    for i, j in ((0, 11), (3, 5), (4, 4), (20, 30), (5, 3)):
        first, last = START + dt.timedelta(days=i), START + dt.timedelta(days=j)
        for by in ((), ("kind",)):
            assert shown(s.summary(str(first), str(last), by), by) == plain(rows, first, last, by)
    day = START + dt.timedelta(days=4)
    rows = [r for r in rows if r[0] != day or r[2] == 1] + [(day, "new", 5, 9, None)]
    s.refresh(3, spark.createDataFrame([(day,), (None,)], "day date"), spark.createDataFrame(rows, ROW))
    assert shown(s.summary("2026-01-01", "2026-01-12", ("kind",)), True) == plain(rows, START, START + dt.timedelta(days=11), True)
    s.refresh(4, spark.createDataFrame([(day,)], "day date"), empty)  # all of a day's rows gone
    rows = [r for r in rows if r[0] != day]
    assert shown(s.summary("2026-01-01", "2026-01-12"), ()) == plain(rows, START, START + dt.timedelta(days=11), ())
    plan = s.summary("2026-01-03", "2026-01-03")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(day", plan)


POST = "id bigint, publish_date date, title string"


def test_pages_of_ranges_equal_offset_and_limit(spark, tmp_path):
    rng = random.Random(4)
    some_day = lambda: rng.choice([None, *[START + dt.timedelta(days=i) for i in range(6)]])
    now = {i: (i, some_day(), f"t{i}") for i in range(1, 121)}
    frame = lambda rows: spark.createDataFrame(rows, POST)
    k = KeysetPages(spark, f"file://{tmp_path}", POST, 8)
    k.build(frame(list(now.values())))
    k.build(frame(list(now.values())))  # again: a no-op
    again = KeysetPages(spark, f"file://{tmp_path}", POST, 8)
    assert again.total() == 120 and len(again.counts()) > 4

    def check():
        every = sorted(now.values(), key=lambda r: (r[1] is not None, r[1] or START, r[0]), reverse=True)
        assert again.total() == len(every)
        for skip, limit in ((0, 7), (33, 20), (len(every) - 5, 20), (500, 5)):
            assert [tuple(r) for r in again.page(skip, limit).collect()] == every[skip : skip + limit]
        assert [tuple(r) for r in page(frame(every), 33, 20).collect()] == every[33:53]
        for at in (0, 40, len(every) - 1):
            assert [tuple(r) for r in again.after(every[at][1], every[at][0], 9).collect()] == every[at + 1 : at + 10]
        rare = [r for r in every[11:] if r[0] % 17 == 0]
        assert [tuple(r) for r in again.after(every[10][1], every[10][0], 4, F.col("id") % 17 == 0).collect()] == rare[:4]

    check()
    moved = [(i, some_day(), f"moved {i}") for i in (3, 50, 51, 90)]
    dead = [now[i] for i in (1, 2, 77, 100)]
    new = [(i, some_day(), f"t{i}") for i in range(200, 215)]
    gone = frame([now[r[0]] for r in moved] + dead + [(999, START, "never was")])
    for _ in range(2):
        again.apply(1, frame(moved + new), gone)
    now |= {r[0]: r for r in moved + new}
    for r in dead:
        del now[r[0]]
    check()
    plan = again.page(60, 5)._jdf.queryExecution().executedPlan().toString()
    read = re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (?:IN \(([\d,]+)\)|= (\d+))", plan)
    assert read and len((read[1] or read[2]).split(",")) <= 2
    last = again.counts().index(max(again.counts()))
    whole = [r for r in now.values() if r[0] in {p.id for p in again.store.read("posts", [last]).collect()}]
    again.apply(2, None, frame(whole))  # a range that becomes empty
    for r in whole:
        del now[r[0]]
    check()


def test_pages_of_no_posts(spark, tmp_path):
    k = KeysetPages(spark, f"file://{tmp_path}", POST, 4)
    k.build(spark.createDataFrame([], POST))
    assert k.total() == 0 and k.page().count() == 0 and k.after(None, 5).count() == 0 and k.after(None, 5, where=F.lit(True)).count() == 0
    k.apply(1, spark.createDataFrame([(1, None, None)], POST))
    assert [r.id for r in k.page().collect()] == [1] and k.total() == 1
