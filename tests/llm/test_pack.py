import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from noticeboard.llm import pack
from tests.llm import cases

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_ids_are_the_tokenizers():
    whole, quick, rng = Tokenizer.from_file(PATH), pack.Encoder(PATH, remembered=50), random.Random(1)
    bits = ["  ", " ", "\n", "\n\n", "a", "the", " don't", "é", "12", ".", "\t", "x  y", "\xa0", "ª", "你好", "<|endoftext|>", "'ll", "\x85", "\x1f", "Ünï", "!!"]
    for _ in range(2000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(quick(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def check(rows, capacity):
    seq = defaultdict(list)
    for r in rows:
        assert 0 < r.length <= capacity
        seq[r.sequence_id].append((r.offset, r.length))
    for parts in seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(seq)


def test_round_trip(spark):
    rows = cases.texts()
    docs = cases.table(spark, rows)
    places = pack.packed(docs, capacity=256)
    got = places.collect()
    n, whole = check(got, 256), Tokenizer.from_file(PATH)
    ids = [(whole.encode(t or "", add_special_tokens=False).ids + [0]) for _, t in rows]
    assert sum(r.length for r in got) == sum(map(len, ids)) and n <= 1.02 * sum(map(len, ids)) / 256 + 2
    want = Counter((i, k, s, m, zlib.crc32(np.array(x[s : s + m], "<u4").tobytes())) for (i, _), x in zip(rows, ids, strict=True) for k, (s, m) in enumerate(pack.cut(len(x), 256)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want


def test_sequences_hold_the_ids(spark):
    rows = [(i, t) for i, t in cases.texts() if i is not None and i != 42]
    docs = cases.table(spark, rows)
    places = pack.packed(docs, capacity=128)
    seq = {r.sequence_id: list(r.ids) for r in pack.sequences(docs, places).collect()}
    whole = Tokenizer.from_file(PATH)
    text = dict(rows)
    for r in places.collect():
        ids = whole.encode(text[r.doc_id] or "", add_special_tokens=False).ids + [0]
        assert seq[r.sequence_id][r.offset : r.offset + r.length] == ids[r.start : r.start + r.length]


def test_plans():
    rng = random.Random(2)
    for capacity, sizes in ((100, range(1, 101)), (100, [40]), (100, [60, 40]), (64, [33, 20, 11])):
        counts = Counter(rng.choice(list(sizes)) for _ in range(3000))
        for small in (capacity // 3, capacity // 2 + 1):
            p = pack.Plan(dict(counts), capacity, small, 12)
            used, n = Counter(), Counter()
            for length, rank, k, base, offset in p.places:
                n[length] += k
                for i in range(k):
                    used[base + i] += length
            assert n == counts and len(used) == p.sequences and max(used.values()) <= capacity
        assert pack.best_plan(dict(counts), capacity).sequences <= 1.03 * sum(k * v for k, v in counts.items()) / capacity * (1.25 if len(counts) == 1 or 33 in counts else 1) + 1
    assert pack.best_plan({}, 100).sequences == 0


def test_cut_and_empty(spark):
    assert pack.cut(5, 4) == [(0, 1), (1, 4)] and pack.cut(8, 4) == [(0, 4), (4, 4)] and pack.cut(3, 4) == [(0, 3)]
    assert pack.packed(cases.empty(spark)).count() == 0
