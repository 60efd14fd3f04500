"""Batches that write: rejected records, identity, untouched buckets, order of events, restarts."""

import datetime as dt
import glob
import os
import random

from pyspark.sql import functions as F

from noticeboard.operators.upserts import PostStore
from noticeboard.streaming import ingest
from noticeboard.streaming.state import LedgerState

POST = "canonical_url string, title string, publish_date string, original_url string, content string, fields array<struct<name:string,value:string>>, at int"


def posts(store):
    return {r.canonical_url: r for r in store.store.read("posts").collect()}


def fields(store):
    return {(r.post_url, r.field_name): (r.field_value, r.id) for r in store.store.read("fields").collect()}


def files(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/*/bucket=*/*.parquet")}


def test_upserts_write_what_they_can(spark, tmp_path):
    store = PostStore(spark, f"file://{tmp_path}/s", 16)
    frame = lambda *rows: spark.createDataFrame(rows, POST)
    first = [(f"u{i}", f"t{i}", "2026-01-02", None, "text", [("a", "1"), ("b", "2"), ("a", "3")], 0) for i in range(20)]
    got = store.apply(0, frame(*first, (None, "t", None, None, "c", None, 0), (" ", "t", None, None, "c", None, 0), ("u99", " ", None, None, None, None, 0)), "at").first()
    assert tuple(got) == (20, 0, 0, 3, 40, 0)
    before, had = posts(store), fields(store)
    assert len({r.id for r in before.values()}) == 20 and had["u3", "a"][0] == "3" and before["u3"].reclassify is not None
    old = files(f"{tmp_path}/s")
    batch = frame(("u3", "", None, None, "other", [("b", "2"), ("c", "9")], 2), ("u3", "newer", None, None, "", None, 1), ("u4", "t4", "2026-01-02", None, "text", [("b", "2")], 0), ("bad", None, None, None, None, None, 0), ("u50", "t", None, None, None, None, 0))
    got = store.apply(1, batch, "at", F.when(F.col("canonical_url") == "u50", "detail failed")).first()
    assert tuple(got) == (0, 1, 1, 2, 1, 2)
    now, has = posts(store), fields(store)
    assert now["u3"].title == "t3" and now["u3"].content == "other" and now["u3"].id == before["u3"].id and now["u3"].reclassify and now["u3"].batch == 1
    assert now["u4"] == before["u4"] and set(has) - set(had) == {("u3", "c")} and set(had) - set(has) == {("u3", "a"), ("u4", "a")} and has["u3", "b"] == had["u3", "b"]
    assert len({i for _, i in has.values()}) == len(has)
    assert {(r.canonical_url, r.problem, r.batch) for r in store.store.read("rejected").filter("batch = 1").collect()} == {("bad", "no title and no content", 1), ("u50", "detail failed", 1)}
    new = files(f"{tmp_path}/s")
    assert sum(f not in old for f in new) <= 6 and sum(f in new for f in old) >= len(old) - 6
    assert tuple(store.apply(1, frame(*first), "at").first()) == (0,) * 6 and files(f"{tmp_path}/s") == new
    store.apply(2, frame(("u51", "t", None, None, "c", None, 0)), "at")
    assert posts(store)["u51"].id not in {r.id for r in now.values()}
    assert tuple(store.apply(3, frame(*first[:0]), "at").first()) == (0,) * 6


def test_ledger_state_in_any_order(spark, tmp_path):
    rng = random.Random(5)
    start = dt.datetime(2026, 1, 1)
    events = [(rng.randint(1, 9), i, start + dt.timedelta(hours=rng.randint(0, 50)), rng.choice(["run", "done", "step", "cancel" if i % 9 == 0 else "step"])) for i in range(120)]
    rows = events + rng.sample(events, 30) + [(None, 900, start, "run"), (3, None, start, "run")]
    rng.shuffle(rows)
    schema = "key bigint, event bigint, at timestamp, kind string"
    want = {}
    for key in {e[0] for e in events}:
        mine = [e for e in events if e[0] == key]
        last = max(mine, key=lambda e: (e[2], e[1]))
        want[key] = (len(mine), min(e[2] for e in mine), last[2], last[1], "cancelled" if any(e[3] == "cancel" for e in mine) else last[3])
    fold = LedgerState(spark, f"file://{tmp_path}/s", ("cancel",), 8)
    for n, at in enumerate(range(0, len(rows), 40)):
        batch = spark.createDataFrame(rows[at : at + 40], schema)
        fold(batch, n)
        fold(batch, n)  # a batch that runs again
    assert {r.key: tuple(r)[1:] for r in fold.table().collect()} == want
    late = start + dt.timedelta(days=30)
    assert {r.status for r in fold.table(F.lit(late)).collect()} <= {"cancelled", "stale"}
    untouched = files(f"{tmp_path}/s")
    fold(spark.createDataFrame([(1, 5000, late, "done")], schema), 50)
    assert sum(f not in untouched for f in files(f"{tmp_path}/s")) <= 2
    assert fold.table().filter("key = 1").first().last_event == 5000


def test_ledger_goes_on_after_a_restart(spark, tmp_path):
    schema = "key bigint, event bigint, at timestamp, kind string"
    land = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    at = dt.datetime(2026, 1, 1)
    land((1, 1, at, "run"), (2, 2, at, "run"))
    df = spark.read.parquet(f"{tmp_path}/in")
    go = lambda: ingest.run(ingest.file_stream(spark, f"{tmp_path}/in", df.schema, glob="*.parquet"), LedgerState(spark, f"file://{tmp_path}/s", ("cancel",), 4), f"{tmp_path}/c").awaitTermination()
    go()
    land((1, 3, at + dt.timedelta(hours=1), "done"), (2, 4, at - dt.timedelta(hours=1), "late"), (1, 1, at, "run"))
    go()
    go()
    assert {(r.key, r.n, r.status) for r in LedgerState(spark, f"file://{tmp_path}/s", ("cancel",), 4).table().collect()} == {(1, 2, "done"), (2, 2, "run")}
