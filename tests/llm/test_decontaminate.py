import random

import pytest

from noticeboard.llm import decontaminate as dc
from noticeboard.llm.common import merged, word_hashes
from tests.llm import cases


def brute(text, items):
    ws = dc.words(text)
    hit, found = set(), set()
    for name, item in items:
        iw = dc.words(item)
        size = min(10, len(iw))
        wins = {tuple(iw[i : i + size]) for i in range(len(iw) - size + 1)} if size else set()
        for i in range(len(ws) - size + 1) if size else ():
            if tuple(ws[i : i + size]) in wins:
                hit.update(range(i, i + size))
                found.add(name)
    return len(ws), len(hit), sorted(found)


def items(rng):
    rows = cases.texts()
    long = dict(rows)[30].split(" ")
    return [("1", " ".join(long[20:45])), ("2", "one two three"), ("3", ""), ("4", "tie"), ("5", cases.prose(rng, 15)), ("6", "a a a a a a a a a a a a")]


@pytest.mark.parametrize("block_words", [10**6, 20])
def test_against_brute_force(spark, block_words):
    its = items(random.Random(5))
    bench = spark.createDataFrame([(int(i), t, "x") for i, t in its] + [(9, None, "x")], "item_id bigint, text string, contamination string")
    rows = [*cases.texts(), (50, "a " * 40), (51, "One, TWO three!"), (52, cases.texts()[20][1].upper())]
    got = dc.contamination(cases.table(spark, rows), bench, block_words=block_words, name="found")
    assert got.count() == len(rows)
    out = {}
    for r in got.collect():
        out.setdefault((r.doc_id, r.text), (r.found.n_words, sum(s.end - s.start for s in r.found.spans), list(r.found["items"])))
    for i, t in rows:
        assert out[(i, t)] == brute(t, its), (i, t and t[:50])


def test_index_finds_every_window():
    rng = random.Random(3)
    for _ in range(200):
        items = [(str(n), " ".join(rng.choice("abc") for _ in range(rng.randint(0, 30)))) for n in range(4)]
        doc = " ".join([rng.choice("abcd") for _ in range(rng.randint(0, 60))] + [items[0][1]] + [rng.choice("abcd") for _ in range(5)])
        spans, found = dc.Index(items).find(word_hashes([doc], dc._TABLE)[0])
        assert (len(dc.words(doc)), sum(b - a for a, b in merged(spans)), sorted(found)) == brute(doc, items)


def test_empty_tables_and_kept_columns(spark):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    docs = cases.table(spark)
    assert dc.decontaminated(docs, bench).columns == docs.columns
    assert dc.decontaminated(docs, bench).count() == docs.count()
    assert dc.contamination(cases.empty(spark), bench).count() == 0
