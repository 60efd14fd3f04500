"""Incremental duplicates against a full rebuild, over random batches; what a batch reads and writes."""

import datetime as dt
import glob
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from noticeboard.operators import entities as en
from noticeboard.operators import incremental as inc
from noticeboard.sources.buckets import BucketStore

SCHEMA = "id bigint, source_id string, canonical string, original string, title_key string, day date, print string"
DAY = dt.date(2026, 3, 1)


def row(rng, i):
    return (i, rng.choice(["s", "t", None]) if rng.random() < 0.9 else "s", rng.choice([None, f"u{rng.randint(1, 30)}"]), rng.choice([None, None, f"o{rng.randint(1, 30)}"]), rng.choice([None, "t1", "t2", "t3", "t4"]), rng.choice([None, *[DAY + dt.timedelta(days=k) for k in range(8)]]), rng.choice([None, "p1", "p2", "p3"]))


@pytest.mark.parametrize("seed", [2])
def test_equals_the_full_rebuild(spark, tmp_path, seed):
    rng = random.Random(seed)
    index = inc.DuplicateIndex(spark, f"file://{tmp_path}/index", 8)
    now: dict[int, tuple] = {}
    for batch in range(4):
        rows = [row(rng, i) for i in rng.sample(range(60), 20 if not batch else rng.randint(1, 10))]
        gone = rng.sample(sorted(now), min(len(now), rng.randint(0, 4))) if batch else []
        rows = [r for r in rows if r[0] not in gone] + ([(r[0], *r[1:4], r[4], DAY, r[6]) for r in [now[i] for i in rng.sample(sorted(now), 2)] if r[0] not in gone] if batch else [])
        rows = list({r[0]: r for r in rows}.values())
        index.apply(batch, spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i,) for i in gone], "id bigint"))
        for i in gone:
            now.pop(i, None)
        now.update({r[0]: r for r in rows})
        every = spark.createDataFrame(list(now.values()), SCHEMA)
        want = {r.id: r.root for r in en.components(en.edges(every)).collect()}
        assert {r.id: r.root for r in index.components().collect()} == want
        assert {r.id: r.root for r in index.labels().collect()} == {i: want.get(i, i) for i in now}
        kept = {tuple(r) for r in index.store.read("rows").select(inc.KEYED).collect()}
        assert kept == set(now.values())
        keys = {(r.key, r.day) for r in inc.entries(every).collect()}
        assert {(r.key, r.day) for r in index.store.read("keys").collect()} == keys and index.store.read("keys").count() == len(keys)


def test_marks_of_a_batch_equal_marks_of_all(spark, tmp_path):
    rng = random.Random(7)
    rows = {i: row(rng, i) for i in range(50)}
    marks = "duplicate_status string, primary_post_id bigint, duplicate_group_key string, duplicate_reason string, duplicate_checked_at timestamp"
    posts = lambda rs: spark.createDataFrame([(r[0], r[1], *[None] * 5) for r in rs], f"id bigint, source_id string, {marks}")
    zero = [F.lit(0).alias(c) for c in ("n_attachments", "n_fields", "n_jobs", "analysis_score", "insight_score")]
    members = lambda p: p.select("id", "source_id", F.lit(True).alias("has_content"), F.lit(None).cast("timestamp").alias("created_at"), *zero)
    at = F.to_timestamp(F.lit("2026-03-09"))
    index = inc.DuplicateIndex(spark, f"file://{tmp_path}/index", 8)
    shown = lambda df: {(r.id, r.duplicate_status, r.primary_post_id, r.duplicate_group_key, r.duplicate_reason) for r in df.collect()}
    frame = lambda rs: spark.createDataFrame(list(rs), SCHEMA)
    full = lambda: en.marked(posts(rows.values()), en.groups(en.edges(frame(rows.values())), members(posts(rows.values()))), at)
    p = posts(rows.values())
    p = inc.refreshed(index, 0, p, frame(rows.values()), members(p), at)
    assert shown(p) == shown(full())
    old = {r.id: tuple(r) for r in p.collect()}
    changed = [row(rng, i) for i in (3, 4, 5, 70, 71)]
    rows.update({r[0]: r for r in changed})
    now = spark.createDataFrame([(*old.get(i, (i, r[1], *[None] * 5))[:1], r[1], *old.get(i, (i, r[1], *[None] * 5))[2:]) for i, r in rows.items()], p.schema)
    assert shown(inc.refreshed(index, 1, now, frame(changed), members(now), at)) == shown(full())


def files(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/*/bucket=*/*.parquet")}


def test_a_batch_reads_and_writes_its_buckets_only(spark, tmp_path):
    index = inc.DuplicateIndex(spark, f"file://{tmp_path}/index", 32)
    rows = [(i, "s", f"u{i // 2}", None, None, None, None) for i in range(400)]
    index.apply(0, spark.createDataFrame(rows, SCHEMA))
    before = files(f"{tmp_path}/index")
    ids = spark.createDataFrame([(7,)], "id bigint")
    found = index.store.lookup("labels", ids)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and [tuple(r) for r in found.collect()] == [(7, 6)]
    index.apply(1, spark.createDataFrame([(1000, "s", "u3", None, None, None, None)], SCHEMA))
    after = files(f"{tmp_path}/index")
    new = {f.split("/bucket=")[0].rsplit("/", 1)[1] + f.split("/bucket=")[1].split("/")[0] for f in after if f not in before}
    assert len(new) <= 3 and sum(f in after for f in before) >= len(before) - 3
    assert {r.id for r in index.components().filter("root = 6").collect()} == {6, 7, 1000}
    assert index.apply(1, spark.createDataFrame([(1000, "s", "other", None, None, None, None)], SCHEMA)).count() == 0
    assert files(f"{tmp_path}/index") == after


def test_a_batch_that_stopped_between_is_finished(spark, tmp_path, monkeypatch):
    store = BucketStore(spark, f"file://{tmp_path}/s", {"t": (["k"], "k bigint, v string"), "u": (["k"], "k bigint")}, 4)
    df = spark.createDataFrame([(i, f"v{i}") for i in range(20)], "k bigint, v string")
    store.commit(0, {"t": (None, df), "u": (None, df.select("k"))})
    real = BucketStore._mark
    monkeypatch.setattr(BucketStore, "_mark", lambda self, path, names: (_ for _ in ()).throw(RuntimeError("lost")) if path.endswith("done") else real(self, path, names))
    gone = spark.createDataFrame([(3,), (4,)], "k bigint")
    with pytest.raises(RuntimeError, match="lost"):
        store.commit(1, {"t": (gone, spark.createDataFrame([(3, "new")], "k bigint, v string"))})
    monkeypatch.undo()
    assert not store.done(1)
    store.commit(1, {"t": (gone, None)})  # what was written aside counts
    assert store.done(1) and {tuple(r) for r in store.read("t").filter("k in (3, 4)").collect()} == {(3, "new")} and store.read("t").count() == 19
    every = store.read("u")
    store.commit(2, {"u": (every, None)})
    assert store.read("u").count() == 0 and store.lookup("u", gone).count() == 0
