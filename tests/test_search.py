"""Search by index against the scan; roles in patterns."""

import random
import re

from pyspark.sql import functions as F

from noticeboard.functions import classify
from noticeboard.operators import filters
from noticeboard.operators.search import SearchIndex, pieces
from noticeboard.plans.profile import LATIN, ZH

WORDS = ["alpha", "Beta", "gamma", "Straße", "辅导员招聘", "公告", "50%", "a_b", "ÉTÉ", "x", "😀😀", "the", "the", "the"]


def made(rng, n):
    return [(i, rng.choice([None, "", " ".join(rng.choices(WORDS, k=3))]), rng.choice([None, " ".join(rng.choices(WORDS, k=rng.randint(0, 12))) + f" n{i}"])) for i in range(n)]


def test_finds_what_the_scan_finds(spark, tmp_path):
    rng = random.Random(3)
    rows = made(rng, 150)
    schema = "id bigint, title string, content string"
    index = SearchIndex(spark, f"file://{tmp_path}/s", share=0.2, buckets=8)
    index.add(0, spark.createDataFrame(rows[:90], schema))
    index.add(1, spark.createDataFrame(rows[90:], schema))
    index.add(1, spark.createDataFrame(rows[90:], schema))  # again
    changed = [(i, t, c) if i % 10 else (i, "delta", None) for i, t, c in rows if i % 7]
    index.add(2, spark.createDataFrame([r for r in changed if r[0] % 10 == 0], schema))
    posts = spark.createDataFrame(changed, schema)
    long = next(c for _, _, c in changed if c and len(c) > 40)[:40]
    for k in ["a", "al", "alp", "ALPHA", "beta gam", "straße", "辅导员", "导员招聘 ", "50%", "a_b", "été", "😀", "😀😀", "the", "delta", "n1", "n14", "nothing", long, " ", *[w for _, t, _ in changed[:5] if (w := (t or "")[2:9])]]:
        for wild in (False, True):
            want = {r.id for r in posts.filter(filters.search(k, wildcards=wild)).collect()}
            assert {r.id for r in index.search(posts, k, wildcards=wild).collect()} == want, (k, wild)
    assert index.rarest("the") == [] and index.rarest("no") == [] and index.rarest("beta gam")
    plan = index.postings(index.rarest("delta"))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and re.search(r"PushedFilters: \[[^\]]*gram", plan)


def test_pieces():
    assert pieces(" AB%cde_fgh%", True) == ["cde", "fgh"] and pieces("a%b") == ["a%b"] and pieces("ab") == []


def test_all_role_patterns_hold_the_role(spark):
    """Texts of the patterns' own words, without the role: no pattern matches, so the role's name may be asked for first."""
    rng = random.Random(1)
    for p in (ZH, LATIN):
        patterns = [*p.role_exclude, *p.body_include, *p.body_exclude]
        words = [w for x in patterns for w in re.findall(r"[\w一-鿿]+", x) if p.role not in w] + [" ", "的", "x"]
        texts = ["".join(rng.choices(words, k=rng.randint(1, 30))).replace(p.role, "") for _ in range(3000)]
        df = spark.createDataFrame([(t,) for t in texts if p.role not in t], "t string")
        assert df.filter(classify.matches_any(F.col("t"), patterns)).count() == 0 and df.count() > 2000
