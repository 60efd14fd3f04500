"""Every registered query runs on the smallest tables and matches its SQL there."""

import datetime as dt
import os

import duckdb
import pytest

from noticeboard.plans import queries as q
from noticeboard.plans import records, upkeep  # noqa: F401  add their queries
from noticeboard.streaming import ingest

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def shown(rows):
    one = lambda v: "NULL" if v is None or v != v else repr(round(float(v), 9)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(one(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, duck, name):
    df = q.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = df.select(columns).collect()
    if name in q.SQL:
        want = duck.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({q.SQL[name]})").fetchall()
        assert shown(got) == shown(want)


def on_rows(spark, path, name, table, rows, schema):
    """What a query gives on a made table, and what its SQL does."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{table}.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/{table}.parquet/*.parquet')")
    df = q.QUERIES[name](spark, str(path))
    columns = sorted(df.columns)
    return shown(df.select(columns).collect()), shown(c.execute(f"SELECT {', '.join(columns)} FROM ({q.SQL[name]})").fetchall())


EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


@pytest.mark.parametrize("last", ["2024-01-19 23:59:59.5", "2024-01-20 00:00:00", "2024-01-20 00:00:00.5", "1969-12-31 23:59:59.5", None])
def test_runtime_health_within_a_second(spark, tmp_path, last):
    at = lambda t: t and dt.datetime.fromisoformat(t)
    limits = ["2024-01-19 21:59:59.999999", "2024-01-19 22:00:00", "2024-01-19 22:00:00.000001", "2024-01-19 21:59:59"] if last and last > "2024" else []
    rows = [(4 * k, at(t), k, "click", 0.0, "{}") for k, t in enumerate([*limits, last, None])]
    got, want = on_rows(spark, tmp_path, "runtime_health", "events", [*rows, (1, at("2024-02-01"), 9, "click", 0.0, "{}"), (None, at("2024-02-01"), 9, None, 0.0, "{}")], EVENTS)
    assert got == want


def test_stale_tasks_within_a_second(spark, tmp_path):
    at = lambda t: dt.datetime(2024, 1, 20, 12) - dt.timedelta(hours=2, microseconds=t)
    rows = [(4 * k, at(t), k, "click", 0.0, "{}") for k, t in enumerate((0, 1, -1, 999_999, 1_000_000))]
    got, want = on_rows(spark, tmp_path, "stale_tasks", "events", [*rows, (21, dt.datetime(2024, 1, 20, 12), 9, "click", 0.0, "{}")], EVENTS)
    assert got == want and sum("True" in r for r in got) == 3


def test_stale_files_of_shared_addresses(spark, tmp_path):
    ids = [*range(12), *range(12), 17, 23, -1, -5, -6, 2**62, None]
    rows = [(n, "u" if k % 3 else None if k % 2 else f"u{k}", "") for k, n in enumerate(ids)]
    got, want = on_rows(spark, tmp_path, "stale_files", "pages", rows, "page_id bigint, url string, html string")
    assert got == want and len(got) == 24


def test_flagship(spark):
    assert q.flagship(spark, DATA).count() == 20


def test_stream_in_several_batches_equals_batch(spark, tmp_path):
    e = spark.read.parquet(f"{DATA}/events.parquet")
    e.repartition(5).write.parquet(f"{tmp_path}/in")
    latest = ingest.Latest(spark, f"{tmp_path}/out", "user_id", "ts", "event_id")
    ingest.run(ingest.file_stream(spark, f"{tmp_path}/in", e.schema, files_per_batch=2), latest, f"{tmp_path}/c").awaitTermination()
    assert latest.version == 2 and latest.versions() == [0, 1, 2]
    again = ingest.Latest(spark, f"{tmp_path}/out", "user_id", "ts", "event_id", e.schema)
    assert again.version == 2 and again.table().count() == latest.table().count()
    assert ingest.Latest(spark, f"{tmp_path}/none", "user_id", "ts", "event_id", e.schema).table().count() == 0
    batch = ingest.latest_by(e, "user_id", "ts", "event_id")
    assert sorted(map(tuple, latest.table().select("user_id", "event_id").collect())) == sorted(map(tuple, batch.select("user_id", "event_id").collect()))


def test_sheet_cells_hold_whole_texts(spark):
    bare = lambda t: "".join((t or "").split())
    want = sorted((r.conv_id, bare(r.text)) for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect())
    got = sorted((r.file, bare(r.major_requirement)) for r in q.sheet_jobs(spark, DATA).collect())
    assert max(len(t) for _, t in want) > 20 and got == want
