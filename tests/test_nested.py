import json
import random

from pyspark.sql import functions as F

from noticeboard.functions.text import flattened


def flat(v):
    if v is None:
        return []
    if isinstance(v, dict):
        v = list(v.values())
    if isinstance(v, list):
        return [x for y in v for x in flat(y)]
    return [str(v).strip()] if str(v).strip() else []


def made(rng, depth):
    if depth == 0 or rng.random() < 0.2:
        return rng.choice(["a", " b ", "", 'q"uo\\te', "x, [y] {z: 1}", "ü ", "tab\tline\n", 7, -3, 0.5, True, False, None, "\\", "\\\\\"", "[1, 2]", "null", "true"])
    if rng.random() < 0.5:
        return [made(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice(["k", 'k"', "l,]", "\\"]) + str(i): made(rng, depth - 1) for i in range(rng.randint(0, 3))}


def test_flattened_at_any_depth(spark):
    rng = random.Random(1)
    values = [v for v in (made(rng, 10) for _ in range(400)) if isinstance(v, (list, dict))]
    deep = ["end"]
    for i in range(200):
        deep = [f"t{i}", deep] if i % 2 else {"k": f"t{i}", "l": deep}
    values += [deep, ["w" * 200_000, '"' * 20_000]]
    rows = [(i, json.dumps(v, ensure_ascii=i % 2 == 0)) for i, v in enumerate(values)]
    got = {r.i: r.f for r in spark.createDataFrame(rows, "i int, t string").select("i", flattened(F.col("t")).alias("f")).collect()}
    for i, v in enumerate(values):
        assert got[i] == flat(v), (rows[i], got[i])


def test_what_is_no_json_is_one_text(spark):
    rows = [("plain",), (" [not json ",), ("{",), (None,), ("  ",), ('"quoted"',), ("[]",), ("{}",)]
    got = [r.f for r in spark.createDataFrame(rows, "t string").select(flattened(F.col("t")).alias("f")).collect()]
    assert got == [["plain"], ["[not json"], ["{"], [], [], ['"quoted"'], [], []]
