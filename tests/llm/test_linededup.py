from noticeboard.llm import linededup as ld
from tests.llm import cases


def repeats(texts, k=51):
    first, out = {}, set()
    for i, t in texts:
        ws = (t or "").lower().split()
        mine = {tuple(ws[j : j + k]) for j in range(len(ws) - k + 1)}
        if any(w in first for w in mine):
            out.add(i)
        for w in mine:
            first.setdefault(w, i)
    return out


def test_passages_and_copies(spark):
    rows = [r for r in cases.texts() if r[0] is not None]
    got = {r.doc_id: r for r in ld.cleaned(cases.table(spark, rows), name="out").collect()}
    before, after = repeats(sorted(rows, key=lambda r: r[0])), repeats([(i, got[i].out.text) for i in sorted(got)])
    assert before == {31, 32, 40, 41} and not after
    assert got[31].out.n_deleted == got[31].out.n_words == 300 and got[30].out.n_deleted == 0
    assert 60 <= got[40].out.n_deleted <= 62 and got[40].out.text.split() == [w for w in got[40].out.text.split() if w]
    for i, t in rows:
        if i not in before:
            assert got[i].out.text == t and got[i].out.n_deleted == 0


def test_align_finds_moved_and_repeated_blocks():
    import random

    rng = random.Random(4)
    a, b, c = (cases.prose(rng, 70) for _ in range(3))
    e, d = ld.read(f"{a} {b} {c}"), ld.read(f"x {c} y {a} z {a}")
    spans = ld.align(e, d)
    assert [(s // 10, t // 10) for s, t in spans] == [(0, 7), (7, 14)] or len(spans) >= 2
    assert ld.align(e, ld.read("nothing in common here at all")) == []
    shout = " ".join(f"W{i}!!" for i in range(80))
    assert ld.align(ld.read(f"{a} {shout}"), ld.read(f"{b} {shout}")) == [(70, 150)]


def test_text_without_spans():
    assert ld.without("a b c d", [(1, 3)]) == "a d"
    assert ld.without("a\nb c\nd", [(2, 4)]) == "a\nb"
    assert ld.without("a b", [(0, 2)]) == ""


def test_stage(spark):
    docs = cases.table(spark)
    out = ld.deduplicated(docs, length_col="contamination")
    ids = [r.doc_id for r in out.collect()]
    assert out.columns == docs.columns and 31 not in ids and 41 not in ids and {30, 32, 33, 34, None, 42} <= set(ids) and ids.count(42) == 2
    assert ld.deduplicated(cases.empty(spark)).count() == 0


def test_passages_at_any_place_in_text_without_sentences(spark):
    import random

    rng = random.Random(5)
    plain = lambda n: [rng.choice(cases.WORDS) for _ in range(n)]
    rows, want = [], {}
    for i in range(60):
        one = plain(rng.randint(80, 300))
        at = rng.randrange(len(one) - ld.PASSAGE + 1)
        before, after = plain(rng.randint(0, 90)), plain(rng.randint(0, 90))
        rows += [(i, " ".join(one)), (1000 + i, " ".join([*before, *one[at : at + ld.PASSAGE], *after]))]
        want[1000 + i] = " ".join(before + after)
    got = {r.doc_id: r.out for r in ld.cleaned(cases.table(spark, rows), name="out").collect()}
    assert ld.PASSAGE == 51 and not repeats([(i, got[i].text) for i in sorted(got)])
    assert all(abs(len(got[i].text.split()) - len(w.split())) <= 4 for i, w in want.items())  # words may match beyond the passage by chance
    assert all(got[i].text == t for i, t in rows if i < 1000)


def test_block_that_its_lines_first_holder_lacks(spark):
    import random

    rng = random.Random(6)
    sentence = lambda n: " ".join(rng.choice(cases.WORDS) for _ in range(n)) + "."
    for m in (60, 76):
        passage = " ".join(sentence(m // 6) for _ in range(6)).split()
        changed = [*passage[: m // 2], "changed", *passage[m // 2 + 1 :]]
        turned = " ".join(reversed(" ".join(passage).split(". ")))
        own = [sentence(30) for _ in range(3)]
        for held in (" ".join(changed), turned):
            rows = [(1, f"{own[0]} {held}"), (2, f"{own[1]} {' '.join(passage)}"), (3, f"{own[2]} {' '.join(passage)}")]
            got = {r.doc_id: r.out.text for r in ld.cleaned(cases.table(spark, rows), name="out").collect()}
            assert got[1] == rows[0][1] and got[2] == rows[1][1] and got[3] == own[2]


def test_every_copy_in_the_later_text_goes():
    import random

    rng = random.Random(4)
    a, b, c = (cases.prose(rng, 70) for _ in range(3))
    e = ld.read(f"{a} {b} {c}")
    assert ld.align(e, ld.read(f"x {c} y {a} z {a}")) == [(1, 71), (72, 142), (143, 213)]
    assert ld.align(e, ld.read(" ".join(f"x{i} {b}" for i in range(5)))) == [(71 * i + 1, 71 * i + 71) for i in range(5)]
    assert ld.align(ld.read("w " * 60), ld.read("w " * 200)) == [(0, 200)]


def test_patience_chain_and_blocks():
    import random

    assert ld.longest_chain([5, 1, 2, 9, 3, 4]) == [1, 2, 4, 5] and ld.longest_chain([]) == []
    rng = random.Random(3)
    a, b, c = (cases.prose(rng, 50) for _ in range(3))
    held = ld.Held(ld.read(f"{a} {b} {c}"))
    assert held.align(ld.read(f"x {c} y {a} {b}")) == [(1, 51, 100), (52, 152, 0)]  # the chain keeps a and b; c has moved
    for _ in range(200):  # every window of the later text that the earlier one has is in a block, and nothing else
        e, d = ([rng.choice("abcd") for _ in range(rng.randint(0, 60))] for _ in range(2))
        have = {tuple(e[i : i + 3]) for i in range(len(e) - 2)}
        want = {j for i in range(len(d) - 2) if tuple(d[i : i + 3]) in have for j in range(i, i + 3)}
        blocks = ld.Held(ld.read(" ".join(e)), 3).align(ld.read(" ".join(d)))
        assert {j for s, t, _ in blocks for j in range(s, t)} == want
        assert all(d[s:t] == e[y : y + t - s] for s, t, y in blocks)


def test_rows_of_one_id_lose_what_is_their_own(spark):
    import random

    rng = random.Random(9)
    t, u = cases.prose(rng, 150), cases.prose(rng, 150)
    got = sorted((r.doc_id, r.out.text) for r in ld.cleaned(cases.table(spark, [(1, t), (2, t), (2, u), (2, u)]), name="out").collect())
    assert got == sorted([(1, t), (2, ""), (2, u), (2, u)])


def test_passage_of_lines_whose_first_holder_has_them_apart(spark):
    import random

    rng = random.Random(10)
    lines = [" ".join(rng.choice(cases.WORDS) for _ in range(8)) + "\n" for _ in range(12)]
    own = [cases.prose(rng, 30) for _ in range(15)]
    apart = " ".join(f"{x} {y}" for x, y in zip(lines[::-1], own, strict=False))
    rows = [(1, apart), (2, f"{own[12]} {''.join(lines)}"), (3, f"{own[13]} {''.join(lines)}")]
    got = {r.doc_id: r.out for r in ld.cleaned(cases.table(spark, rows), name="out").collect()}
    assert got[1].n_deleted == got[2].n_deleted == 0 and got[3].n_deleted == 96 and got[3].text.split() == own[13].split()


def test_no_passage_is_left_twice_on_the_tables(spark):
    """Recall against all windows of PASSAGE words of the smallest table, and no text without a shared window of BLOCK_WORDS is touched."""
    import os

    import pytest

    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables here")
    docs = spark.read.parquet(path).select("doc_id", "text")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = {r.doc_id: r.lines for r in ld.cleaned(docs).collect()}
    assert repeats(rows) and not repeats(sorted((i, x.text) for i, x in got.items()))
    may = repeats(rows, ld.BLOCK_WORDS)
    assert all(got[i].text == t for i, t in rows if i not in may)
