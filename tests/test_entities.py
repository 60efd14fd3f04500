"""Duplicates against a plain pairwise version, on random tables."""

import datetime as dt
import random

from pyspark.sql import functions as F

from noticeboard.operators import entities as en
from noticeboard.schema import DUPLICATE_REASONS, SCHEMAS

DAY = dt.datetime(2026, 3, 1)


def rule(a, b):
    if a["source_id"] != b["source_id"]:
        return None
    for n, c in enumerate(("canonical_url", "original_url")):
        if (a[c] or "").strip() and (a[c] or "").strip() == (b[c] or "").strip():
            return n
    t = lambda x: "".join((x["title"] or "").split())
    if not t(a) or t(a) != t(b) or not a["publish_date"] or not b["publish_date"]:
        return None
    days = abs((a["publish_date"].date() - b["publish_date"].date()).days)
    same = "".join((a["content"] or "").split())
    if days == 0:
        return 2
    return 3 if days == 1 and same and same == "".join((b["content"] or "").split()) else None


def brute(posts):
    root = {p["id"]: p["id"] for p in posts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    edges = [(a["id"], b["id"], r) for i, a in enumerate(posts) for b in posts[:i] if (r := rule(a, b)) is not None]
    for a, b, _ in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    out = {}
    for p in posts:
        group = [q for q in posts if find(q["id"]) == find(p["id"])]
        if len(group) > 1:
            best = sorted(group, key=lambda q: (not (q["content"] or "").strip(), q["id"]))[0]
            reason = min(r for a, b, r in edges if find(a) == find(p["id"]))
            out[p["id"]] = (best["id"], DUPLICATE_REASONS[reason])
    return out


def random_posts(seed, n=60):
    rng = random.Random(seed)
    return [
        {"id": i, "source_id": rng.randint(1, 2), "title": rng.choice(["t 1", "t1", "t2", "", None]), "content": rng.choice(["x y", "xy", "z", "", None]), "publish_date": rng.choice([None, DAY, DAY + dt.timedelta(hours=20), DAY + dt.timedelta(days=1), DAY + dt.timedelta(days=2), DAY + dt.timedelta(days=9)]), "canonical_url": rng.choice([None, "", f"u{rng.randint(1, 40)}", f" u{rng.randint(1, 40)} "]), "original_url": rng.choice([None, " ", f"o{rng.randint(1, 60)}"])}
        for i in range(1, n + 1)
    ]


def frame(spark, posts):
    s = SCHEMAS["posts"]
    return spark.createDataFrame([tuple(p.get(f.name) for f in s.fields) for p in posts], s)


def members(spark, p):
    e = lambda ddl: spark.createDataFrame([], ddl)
    return en.members_of(p, e("post_id bigint"), e("post_id bigint"), e("post_id bigint"), spark.createDataFrame([], SCHEMAS["post_analyses"]), spark.createDataFrame([], SCHEMAS["post_insights"]))


def test_groups_against_pairs(spark):
    for seed in (1, 2):
        posts = random_posts(seed)
        p = frame(spark, posts)
        got = {r.id: (r.primary_id, r.reason) for r in en.groups(en.edges(en.keyed(p)), members(spark, p)).collect()}
        assert got == brute(posts)


def test_incremental_equals_full(spark):
    posts = random_posts(5, 40)
    p = frame(spark, posts)
    at = F.to_timestamp(F.lit("2026-04-01"))
    full = en.marked(p, en.groups(en.edges(en.keyed(p)), members(spark, p)), at)
    touched = p.filter("id > 25").select("id")
    part = en.refreshed(p, touched, members(spark, p), at)
    want = {r.id: (r.duplicate_status, r.primary_post_id, r.duplicate_reason) for r in full.collect()}
    got = {r.id: r for r in part.collect()}
    of = {i: g for i, (g, _) in brute(posts).items()}
    hit = {of[i] for i in range(26, 41) if i in of}
    for i, r in got.items():
        if i > 25 or of.get(i) in hit:
            assert (r.duplicate_status, r.primary_post_id, r.duplicate_reason) == want[i]
        else:
            assert r.duplicate_checked_at is None
    assert en.unchecked(part, 10).count() == min(10, sum(r.duplicate_checked_at is None for r in got.values()))


def test_edges_are_linear_in_a_hot_key(spark):
    p = frame(spark, [{"id": i, "source_id": 1, "title": "same", "publish_date": DAY, "content": "c"} for i in range(200)])
    assert en.edges(en.keyed(p, full_fold=False)).count() <= 2 * 200
