
import pytest
from pyspark.sql import functions as F

from noticeboard.llm import fingerprint as fp
from tests.llm import cases


def shingles(t):
    ws = (t or "").lower().strip(" \t\n\x0b\f\r")
    import re

    ws = re.split(r"[ \t\n\x0b\f\r]+", ws) if ws else []
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


@pytest.mark.parametrize("fraction", [0.9999999, 0.25])
def test_edits_and_likeness(spark, fraction):
    rows = [r for r in cases.texts() if r[0] is not None]
    e = fp.edited_with_next(cases.table(spark, rows), fraction=fraction)
    e = e.select("id", "text", "n_chars", "edited", fp.likeness(fp.sketch(F.col("text"), fraction=fraction), fp.sketch(F.col("edited"), fraction=fraction)).alias("near"), fp.likeness(fp.sketch(F.col("text"), fraction=fraction), F.col("next_sketch")).alias("next"))
    got = e.collect()
    assert len(got) == len(rows)
    text = dict(rows)
    ids = sorted(text)
    for r in got:
        t, after = text[r.id] or "", text[ids[(ids.index(r.id) + 1) % len(ids)]] or ""
        m = len(t) // 4
        assert r.edited == t[: len(t) - m] + after[:m] and r.n_chars == len(t)
        for other, near in ((r.edited, r.near), (after, r.next)):
            a, b = shingles(t), shingles(other)
            want = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(near - want) < (0.01 if fraction > 0.5 else 0.2) or len(a | b) < 60


def test_null_ids_ties_and_empty(spark):
    rows = cases.texts()
    assert fp.edited_with_next(cases.table(spark, rows)).count() == len(rows)
    assert fp.edited_with_next(cases.empty(spark)).count() == 0
    got = fp.edited_with_next(cases.table(spark, [(None, "abcdefgh"), (1, "zz")])).filter("id is null").first()
    assert got.edited == "abcdef" and got.next_sketch == []


def test_merge_and_containment(spark):
    rows = [r for r in cases.texts() if r[1] and len(r[1]) > 400][:6]
    d = cases.table(spark, rows).select("text", fp.sketch(F.col("text")).alias("s"))
    a, b = d.collect()[:2]
    x = spark.createDataFrame([(a.s, b.s)], "a array<bigint>, b array<bigint>").select(fp.merged(F.col("a"), F.col("b")).alias("m"), "a")
    assert x.select(fp.containment(F.col("a"), F.col("m"))).first()[0] == 1.0


def test_plan_has_no_python(spark):
    e = fp.edited_with_next(cases.table(spark))
    plan = e._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
