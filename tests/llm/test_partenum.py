import random

import numpy as np
import pytest

from noticeboard.llm import partenum as pe
from noticeboard.llm import stars
from tests.llm import cases
from tests.llm.test_neardup import brute


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_similar_sets_share_a_signature(percent):
    """All sizes, as many differences as the threshold allows, on either side: no pair is missed."""
    rng = np.random.default_rng(percent)
    bands = pe.Bands(percent)
    for n in [*range(1, 80), 100, 127, 200, 333, 600, 1500]:
        for _ in range(12):
            pool = np.unique(rng.integers(0, 2**64, 3 * n + 50, dtype=np.uint64))
            rng.shuffle(pool)
            gone = rng.integers(0, n * (100 - percent) // 100 + 1)
            new = 0
            while 100 * (n - gone) >= percent * (n + new + 1):
                new += 1
            new = rng.integers(0, new + 1) if rng.random() < 0.5 else new
            x, y = np.sort(pool[:n]), np.sort(np.r_[pool[: n - gone], pool[n : n + new]])
            if len(y) and 100 * (n - gone) >= percent * (n + new):
                assert np.intersect1d(pe.signatures(x, bands), pe.signatures(y, bands)).size, (n, gone, new)


def test_unlike_sets_share_few_signatures():
    rng = np.random.default_rng(1)
    bands = pe.Bands(80)
    for n, most in ((30, 40), (200, 3), (1000, 3)):
        signs = [pe.signatures(np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)), bands) for _ in range(120)]
        shared = sum(len(np.intersect1d(a, b)) > 0 for i, a in enumerate(signs) for b in signs[:i])
        assert shared <= most * 5, (n, shared)
        assert np.mean([len(s) for s in signs]) < (0.75 * n if n > 100 else 3 * n)


def test_bands_hold_all_similar_sizes():
    bands = pe.Bands(80)
    for n in range(1, 1200):
        for m in range(n, 100 * n // 80 + 1):
            mine, other = dict(bands.instances(n)), dict(bands.instances(m))
            i = bands.of(m)
            assert i in mine and i in other and 2 * n - 2 * -(-80 * (n + m) // 180) <= mine[i] + (m - n)


def test_against_brute_force(spark):
    rng = random.Random(2)
    rows = cases.texts()
    base = cases.prose(rng, 120).split(" ")
    for i in range(100, 200):  # near copies of one template, of which many aren't near each other
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(len(copy))] = f"w{rng.random()}"
        rows.append((i, " ".join(copy)))
    for i in range(300, 380):  # short ones
        rows.append((i, " ".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))))
    for percent in (80,):
        want, size = brute(rows, percent)
        got = pe.similar(cases.table(spark, rows), percent=percent).collect()
        assert {r.doc_id: r.component_id for r in got} == want and len(got) == len(rows)
        key = lambda x: (x[0] is None, x[0] or 0, x[1])
        assert sorted([(r.doc_id, r.n_shingles) for r in got], key=key) == sorted([(i, n) for (i, _), n in zip(rows, size, strict=True)], key=key)


def test_rows_of_one_id_and_empty_tables(spark):
    rng = random.Random(3)
    x, y, z = (cases.prose(rng, 40) for _ in range(3))
    rows = [(5, x), (7, x), (7, y), (7, y), (8, y), (9, z), (9, x), (10, z), (None, x), (11, None), (12, "")]
    got = sorted(((r.doc_id, r.component_id) for r in pe.similar(cases.table(spark, rows)).collect()), key=str)
    assert got == sorted([(i, 5 if i and i < 11 else i) for i, _ in rows], key=str)
    assert pe.similar(cases.empty(spark)).count() == 0


def groups(rng):
    """Two templates with many copies, copies between them, copies that aren't near each other, and copies that vary in length."""
    a = cases.prose(rng, 100).split(" ")
    b = [*a[:70], *cases.prose(rng, 30).split(" ")]
    rows = []
    for n, base in enumerate((a, b)):
        for i in range(90):
            copy = list(base)
            copy[rng.randrange(len(copy))] = f"w{n}{i}"
            rows.append((1000 * n + i, " ".join(copy)))
    rows += [(5000 + i, " ".join([*a[: 70 + 3 * i], *b[70 + 3 * i :]])) for i in range(11)]
    for i in range(40):
        copy, at = list(a), rng.sample(range(0, 96, 5), rng.randint(3, 5))
        for j in at:
            copy[j] = f"x{i // 3 if i % 3 else i}{j}"
        rows.append((7000 + i, " ".join(copy[: 100 - i % 7])))
    c = cases.prose(rng, 160).split(" ")
    rows += [(8000 + i, " ".join(c[: 60 + i])) for i in range(100)]
    return rows


@pytest.mark.parametrize(("bucket", "few", "levels"), [(12, 64, 1), (2, 4, 4)])
def test_groups_in_one_bucket(spark, monkeypatch, bucket, few, levels):
    rows = groups(random.Random(12))
    want, _ = brute(rows, 80)
    assert len(set(want.values())) > 3
    monkeypatch.setattr(pe, "FEW", bucket)
    monkeypatch.setattr(stars, "FEW", few)
    monkeypatch.setattr(stars, "LEVELS", levels)
    assert {r.doc_id: r.component_id for r in pe.similar(cases.table(spark, rows)).collect()} == want


def copies(n, seed=9):
    """Near copies of a text, of two lengths, and texts near to it that are near to no other."""
    rng = random.Random(seed)
    base = cases.prose(rng, 150).split(" ")
    rows = []
    for i in range(n):
        copy = base[: rng.choice([140, 150])]
        for j in rng.sample(range(0, len(copy), 7), 8 if i % 50 == 0 else rng.randint(1, 2)):
            copy[j] = f"w{i}.{j}"
        rows.append((i, " ".join(copy)))
    return rows


def test_rows_that_meet_grow_with_the_group(spark, monkeypatch):
    """Twice as many copies: about twice as many rows meet, not four times."""
    met = []
    for name in ("meet", "confirmed"):
        real = getattr(stars, name)

        def seen(first, second, *rest, real=real, name=name):
            met[-1] += (first if name == "meet" else second).count()
            return real(first, second, *rest)

        monkeypatch.setattr(stars, name, seen)
    for n in (120, 240):
        met.append(0)
        rows = copies(n)
        got = {r.doc_id: r.component_id for r in pe.similar(cases.table(spark, rows)).collect()}
        if n == 120:
            assert got == brute(rows, 80)[0]
    assert met[1] < 2.6 * met[0], met


def test_copies_of_a_template_meet_few_pivots(spark, monkeypatch):
    """Copies of one text with few to many changed words, half of them near to no other: each meets three pivots at most, on average, not one for each bucket."""
    rng = random.Random(4)
    base = cases.prose(rng, 300).split(" ")
    rows = []
    for i in range(240):
        copy = base[: len(base) - rng.randint(0, 8)]
        for j in rng.sample(range(len(copy)), rng.randint(1, 30)):
            copy[j] = f"w{i}.{j}"
        rows.append((i, " ".join(copy)))
    met = []
    real = stars.meet
    monkeypatch.setattr(stars, "meet", lambda s, *rest: met.append(s.count()) or real(s, *rest))
    got = {r.doc_id: r.component_id for r in pe.similar(cases.table(spark, rows)).collect()}
    want = brute(rows, 80)[0]
    assert got == want and 20 < len(set(want.values())) < 220
    assert sum(met) < 3 * len(rows), met


def test_links_among_sets_smaller_than_the_pivot(spark):
    """Two subsets of the pivot, alike and neither like it, share no shingle that it lacks."""
    pool = np.sort(np.random.default_rng(5).integers(0, 2**64, 400, dtype=np.uint64))
    sets = {0: pool, **{i: pool[: 316 - 8 * i] for i in range(1, 6)}}
    made = spark.createDataFrame([(i, s.tobytes(), stars.counts(s)) for i, s in sets.items()], "id bigint, set binary, counts binary")
    often = spark.createDataFrame([(b, i, len(sets[i])) for b in range(20) for i in sets if i == 0 or b % 6 != i], "bucket bigint, id bigint, n bigint")
    got = stars.linked(often, made, spark.createDataFrame([], "a bigint, b bigint"), 80).collect()
    assert sorted((r.id, r.component) for r in got if r.id) == [(i, 1) for i in range(1, 6)]


@pytest.mark.parametrize("smaller", [0, 9])
def test_few_members_of_a_large_star_meet(spark, monkeypatch, smaller):
    """Copies of a template with one to three changed passages, mostly not linked with the pivot: all links are found, and a tenth of the pairs meet at most."""
    rng = np.random.default_rng(21)
    pool = rng.permutation(np.unique(rng.integers(0, 2**64, 3000, dtype=np.uint64)))
    base, new = pool[:146], iter(pool[146:])
    sets = {}
    for i in range(140):
        kept = np.ones(len(base), bool)
        for at in rng.choice(len(base) - 4, [1, 3, 3, 4][i % 4], replace=False):
            kept[at : at + 5] = False
        x = np.r_[base[kept][: len(base) - rng.integers(0, smaller + 1)], [next(new) for _ in range(int((~kept).sum()) - smaller // 9)]]
        sets[i] = np.sort(x.astype(np.uint64))
    made = spark.createDataFrame([(i, s.tobytes(), stars.counts(s)) for i, s in sets.items()], "id bigint, set binary, counts binary")
    often = spark.createDataFrame([(b, i, len(sets[i])) for b in range(20) for i in sets if i == 0 or b % 6 != i % 6], "bucket bigint, id bigint, n bigint")
    met = []
    real = stars.not_apart
    monkeypatch.setattr(stars, "not_apart", lambda pairs, *rest: met.append(pairs.count()) or real(pairs, *rest))
    monkeypatch.setattr(stars, "LEVELS", 0)
    got = {r.id: r.component for r in stars.linked(often, made, spark.createDataFrame([], "a bigint, b bigint"), 80).collect()}
    want = {i: i for i in sets}
    for i in sets:
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common) and want[i] != want[j]:
                old, least = max(want[i], want[j]), min(want[i], want[j])
                want = {x: least if y == old else y for x, y in want.items()}
    assert {i: got.get(i, i) for i in sets} == want and 10 < len(set(want.values())) < 130
    assert sum(met) < len(sets) * (len(sets) - 1) // 20, met


def test_similar_sets_share_as_many_signatures_as_said():
    rng = np.random.default_rng(8)
    bands = pe.Bands(80)
    for n in (90, 150, 333, 600, 1500):
        for _ in range(20):
            pool = np.unique(rng.integers(0, 2**64, 3 * n, dtype=np.uint64))
            rng.shuffle(pool)
            gone = rng.integers(0, n // 10 + 1)
            x, y = np.sort(pool[:n]), np.sort(np.r_[pool[: n - gone], pool[n : n + gone]])
            mine, other = (dict(zip([i for i, _ in bands.instances(len(s))], pe._by_instance(s, bands), strict=True)) for s in (x, y))
            for i in mine.keys() & other.keys():
                both = len(np.intersect1d(mine[i][0], other[i][0]))
                assert both >= max(mine[i][1], other[i][1]) and (n < 600 or mine[i][1] > n // 50), (n, i)


@pytest.mark.parametrize("rows", [1, 2, 7, 10_000])
def test_shared_signatures_over_several_batches(rows):
    import pyarrow as pa

    rng = np.random.default_rng(rows)
    at = np.sort(np.r_[rng.integers(0, 300, 200), np.full(30, 310), [320, 320, 330, 340, 340]])
    who = np.r_[rng.integers(0, 20, 200), np.arange(30), [1, 1, 2, 3, 4]]
    order = np.lexsort((who, at))
    at, who = at[order], who[order]
    batches = [pa.RecordBatch.from_arrays([pa.array(x[i : i + rows]) for x in (at, who, who % 3)], names=["signature", "short", "shares"]) for i in range(0, len(at), rows)]
    want: dict = {}
    for s in set(at.tolist()):
        mine = set(who[at == s].tolist())
        for x in mine if len(mine) > 1 else ():
            want[x, x % 3] = want.get((x, x % 3), 0) + 1
    got: dict = {}
    for r in (r for b in pe._read_and_counted(iter(batches)) for r in b.to_pylist() if r["large"] is None):
        got[r["a"], r["b"]] = got.get((r["a"], r["b"]), 0) + r["times"]
    assert got == want


def test_counts_keep_no_similar_sets_apart():
    rng = np.random.default_rng(6)
    read = stars.counts
    rejected = 0
    for n in [*range(1, 60, 3), 200, 550, 3000]:
        for _ in range(20):
            pool = np.unique(rng.integers(0, 2**64, 3 * n + 50, dtype=np.uint64))
            rng.shuffle(pool)
            x, z = np.sort(pool[:n]), np.sort(pool[n : 2 * n])
            gone = n // 5
            y = np.sort(pool[gone:n])
            assert 100 * (n - gone) < 80 * n or not stars.apart(read(x), read(y), 80) and not stars.apart(read(y), read(x), 80)
            rejected += n > 3 and stars.apart(read(x), read(z), 80)
    assert rejected > 300


@pytest.mark.parametrize("rows", [2, 3, 7, 10_000])
def test_buckets_over_several_batches(rows):
    import pyarrow as pa

    rng = np.random.default_rng(rows)
    at = np.sort(np.r_[rng.integers(0, 40, 150), np.full(30, 50), [60, 60, 61, 70, 70, 70]])
    who = np.arange(len(at)) % 140
    batches = [pa.RecordBatch.from_arrays([pa.array(at[i : i + rows]), pa.array(who[i : i + rows])], names=["signature", "short"]) for i in range(0, len(at), rows)]
    want = set()
    for s in set(at.tolist()):
        mine = who[at == s].tolist()
        want |= {(mine[0], x, True) for x in mine[1:]} if len(mine) > pe.FEW else {(x, y, False) for i, x in enumerate(mine) for y in mine[i + 1 :]}
    got = {tuple(r.values()) for b in pe._read_off(iter(batches)) for r in b.to_pylist()}
    assert got == {r for r in want if r[0] != r[1]} and any(r[2] for r in got)


def test_oracle_and_brute_force_agree(spark):
    import duckdb

    rows = [r for r in cases.texts() if r[0] is not None and r[0] != 42]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want, size = brute(rows, 80)
    assert sorted(con.execute(pe.ORACLE).fetchall()) == sorted((i, n, want[i]) for (i, _), n in zip(rows, size, strict=True))
