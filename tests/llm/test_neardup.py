import random

from noticeboard.llm import neardup as nd
from noticeboard.llm.components import components
from tests.llm import cases


def brute(rows, percent):
    """The component of each id (rows of one id are linked), and the size of each row's set."""
    sets = []
    for i, t in rows:
        ws = (t or "").encode().lower().split()
        sets.append((i, {tuple(ws[j : j + 5]) for j in range(max(1, len(ws) - 4))} if ws else set()))
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (a, x) in enumerate(sets):
        for b, y in sets[:n]:
            both = len(x & y)
            if x and y and None not in (a, b) and 100 * both >= percent * (len(x) + len(y) - both):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) if i is not None else None for i in root}, [len(x) for _, x in sets]


def test_against_brute_force(spark):
    rng = random.Random(2)
    rows = cases.texts()
    base = cases.prose(rng, 120).split(" ")
    for i in range(100, 260):  # near copies of one template, of which many aren't near each other
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(len(copy))] = f"w{rng.random()}"
        rows.append((i, " ".join(copy)))
    for percent in (80, 85):
        want, size = brute(rows, percent)
        got = nd.near_duplicates(cases.table(spark, rows), percent=percent).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.component_id == want[r.doc_id], r
            assert r.kept == (r.doc_id is None or r.component_id == r.doc_id)
        key = lambda x: (x[0] is None, x[0] or 0, x[1])
        assert sorted([(r.doc_id, r.n_shingles) for r in got], key=key) == sorted([(i, n) for (i, _), n in zip(rows, size, strict=True)], key=key)


def test_rows_of_one_id_are_linked(spark):
    rng = random.Random(3)
    x, y, z = (cases.prose(rng, 40) for _ in range(3))
    rows = [(5, x), (7, x), (7, y), (7, y), (8, y), (9, z), (9, x), (10, z), (None, x)]
    got = [(r.doc_id, r.component_id, r.kept) for r in nd.near_duplicates(cases.table(spark, rows)).collect()]
    assert sorted(got[:0] + [g for g in got if g[0] is not None]) == sorted((i, 5, i == 5) for i, _ in rows if i is not None) and (None, None, True) in got


def test_groups_in_one_bucket(spark, monkeypatch):
    """Two templates of which many copies share buckets, with copies between them: nothing is lost where buckets are large."""
    rng = random.Random(12)
    a = cases.prose(rng, 100).split(" ")
    b = [*a[:70], *cases.prose(rng, 30).split(" ")]
    rows = []
    for n, base in enumerate((a, b)):
        for i in range(90):
            copy = list(base)
            copy[rng.randrange(len(copy))] = f"w{n}{i}"
            rows.append((1000 * n + i, " ".join(copy)))
    rows += [(5000 + i, " ".join([*a[: 70 + 3 * i], *b[70 + 3 * i :]])) for i in range(11)]
    for i in range(40):  # near a's template, not to each other; a few of them share their changes, some are shorter
        copy, at = list(a), rng.sample(range(0, 96, 5), rng.randint(3, 5))
        for j in at:
            copy[j] = f"x{i // 3 if i % 3 else i}{j}"
        rows.append((7000 + i, " ".join(copy[: 100 - i % 7])))
    want, _ = brute(rows, 80)
    assert len(set(want.values())) > 3
    for small, levels in ((20, 8), (6, 2)):
        monkeypatch.setattr(nd, "SMALL", small)
        monkeypatch.setattr(nd, "LEVELS", levels)
        assert {r.doc_id: r.component_id for r in nd.near_duplicates(cases.table(spark, rows), percent=80).collect()} == want


def test_oracle_and_brute_force_agree(spark, tmp_path):
    import duckdb

    rows = [r for r in cases.texts() if r[0] is not None and r[0] != 42]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want, size = brute(rows, 85)
    assert sorted(con.execute(nd.ORACLE).fetchall()) == sorted((i, n, want[i], want[i] == i) for (i, _), n in zip(rows, size, strict=True))


def test_stage_keeps_one_of_each_group(spark):
    docs = cases.table(spark)
    out = nd.deduplicated(docs, percent=80)
    ids = {r.doc_id for r in out.collect()}
    assert out.columns == docs.columns and 30 in ids and not ids & {31, 32} and {33, 34, 35, 36, 38, None} <= ids
    assert nd.deduplicated(cases.empty(spark)).count() == 0


def test_estimate(spark):
    import numpy as np
    from pyspark.sql import functions as F

    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[500:2500])
    m = nd._packed(nd.minima([a, b])).view(np.int64)
    got = spark.createDataFrame([(m[0].tolist(), m[1].tolist())], "a array<bigint>, b array<bigint>").select(nd.similarity("a", "b").alias("s")).first().s
    assert abs(got - 1500 / 2500) < 0.12
    assert spark.range(1).select(F.lit(1)).count() == 1


def test_components_of_path_star_and_pairs(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 200)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 160)) and got[201] == got[200] == 200
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
