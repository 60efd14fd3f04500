"""A small table with every awkward case: nulls, empty and very long texts, ties, repeated rows, clashing extra columns."""

from __future__ import annotations

import random

WORDS = [a + b + c for a in ("ka", "lo", "mi", "ne", "su", "ta") for b in ("r", "n", "st", "l") for c in ("a", "e", "o", "u")]
SCHEMA = "doc_id bigint, text string, id string, spans string, contamination int, score double, toxicity string, quality string, pii string, lines string, secrets string, gone int, spans_id int, start int, fingerprint string"


def prose(rng: random.Random, n: int) -> str:
    out = []
    for i in range(n):
        w = rng.choice(WORDS)
        out.append(w + rng.choice(["", "", "", "", "", ".", ".\n", ","]))
    return " ".join(out)


def texts(seed: int = 1) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    passage = prose(rng, 60)
    base = prose(rng, 300)
    words = base.split(" ")
    near = " ".join(words[:100] + ["changed"] + words[101:])
    rows: list[tuple[int | None, str | None]] = [(i, prose(rng, rng.choice([3, 20, 80, 200]))) for i in range(20)]
    rows += [(30, base), (31, base), (32, near), (33, None), (34, ""), (35, " \n\t "), (36, "one"), (37, "one two three four"), (38, prose(rng, 20_000)), (39, prose(rng, 40) + " " + passage + " " + prose(rng, 40)), (40, prose(rng, 30) + " " + passage + " " + prose(rng, 50)), (41, passage), (None, base), (None, None), (42, "tie"), (42, "tie"), (43, "ſtraße ÄÖ x\x85y \x1f z"), (44, "x" * 5000)]
    return rows


def table(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "a", "b", 1, 0.5, "c", "d", "e", "f", "g", 2, 3, 4, "h") for i, t in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
