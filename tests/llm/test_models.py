import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from noticeboard.llm import lm, quality, toxicity
from tests.llm import cases


def test_automaton_against_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    terms, rng = ["idiot", "worthless", "scum", "disgusting", "idiom"], random.Random(1)
    auto = toxicity.Automaton(terms, states=40)
    for _ in range(3000):
        w = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w) + 1)
            op = rng.random()
            if op < 0.4:
                w.insert(k, rng.choice("abdiost"))
            elif op < 0.7 and k < len(w):
                w.pop(k)
            elif k < len(w):
                w[k] = rng.choice("abdiost")
        w = "".join(w)
        ok = [(distance(w, t), i) for i, t in enumerate(terms) if distance(w, t) <= toxicity.edits_allowed(len(t))]
        got = auto.find(w)
        assert (got is None) == (not ok), w
        assert got is None or got[1] == min(ok)[0] == distance(w, terms[got[0]])


def test_stems_and_context():
    r = toxicity.Reader(["idiot", "worth*"], [3.0, 2.0])
    plain, quoted = r.features("you are an idiot and worthy"), r.features('he said "idiot" to them')
    assert plain[1] > 0 and plain[6] > 0 and quoted[1] == 0 and quoted[7] > 0
    plain, quoted = r.features("you idioot"), r.features('he said "idioot"')
    assert plain[4] > 0 and plain[9] == 0 and quoted[4] == 0 and quoted[9] > 0 and plain[1] == quoted[1] == plain[7] == quoted[7] == 0
    assert r.features(None) == r.features("")


def test_toxicity_learns_and_defines_all_cases(spark):
    rng = random.Random(2)
    rows = [(i, cases.prose(rng, 60) + (" grublo" * 3 if i % 5 == 0 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    model = toxicity.learn(cases.table(spark, rows), labels)
    assert "grublo" in model.terms
    s = {r.doc_id: r.tox for r in toxicity.scored(cases.table(spark, [*rows, *[(i + 1000 if i is not None else None, t) for i, t in cases.texts()], (5000, cases.prose(rng, 50) + " grublx grubblo")]), model, name="tox").collect()}
    assert all(0 <= x <= 1 for x in s.values()) and all(s[i] >= 0.5 for i in range(0, 400, 5)) and all(s[i] < 0.5 for i in range(1, 400, 5))
    assert s[5000] > s[1]
    counts = [(f"t{i}*", rng.randint(0, 60), rng.randint(0, 90)) for i in range(400)]

    def brute(a, b, x=200, y=900):
        odds, share = math.log((a + 0.5) / (x + 1)) - math.log((b + 0.5) / (y + 1)), (a + b) / (x + y)
        return odds, round((a - x * share) / math.sqrt(max(1e-9, x * share * (1 - share))), 9)

    want = sorted((-s, t) for t, a, b in counts for o, s in [brute(a, b)] if a >= 4 and o > 1.5 and s > 5)
    terms, strength = toxicity.lexicon(spark.createDataFrame(counts, "term string, a bigint, b bigint"), 200, 900, 50)
    assert terms == [*toxicity.SEED_TERMS, *[t for _, t in want[:50]]] and len(want) > 50 and len(strength) == len(terms)
    assert toxicity.learn(cases.table(spark, rows), labels.limit(0)).terms == list(toxicity.SEED_TERMS)
    kept = toxicity.without_toxic(cases.table(spark, rows), model)
    assert kept.count() == 320 and kept.columns == cases.empty(spark).columns
    assert toxicity.scored(cases.empty(spark), model).count() == 0


def test_scores_do_not_depend_on_ids(spark):
    model = toxicity.Model()
    got = toxicity.scored(cases.table(spark, [(1, "an idiot here"), (2, "an idiot here"), (None, "an idiot here")]), model).select("_toxicity").distinct().count()
    assert got == 1


def brute_base(rows):
    toks = [(i, (t or "").encode().lower().split() + [b" end"]) for i, t in rows]
    train = [ws for i, ws in toks if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for ws in train for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in toks], n, v


def folds():
    f = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7))
    return f == 2, f == 3


def test_lm_against_brute_force(spark):
    rows = cases.texts()
    got = lm.scores(cases.table(spark, rows), *folds(), chunk=500, key_range=300).collect()
    want, n, v = brute_base(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], round(r[4], 6))
    got = sorted([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got], key=key)
    for a, b in zip(got, sorted(want, key=key), strict=True):
        assert a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-6 * abs(b[4]) and a[5] < 0
    assert lm.scores(cases.empty(spark), *folds()).count() == 0


class BruteModel:
    """The model of the docstring, counted and taught token by token, with weights by expectation-maximisation on counts that aren't binned."""

    def __init__(self, rows, held_out, deleted):
        self.tokens = [(i, (t or "").encode().lower().split() + [b" end"]) for i, t in rows]
        train = [(i, ws) for i, ws in self.tokens if not held_out(i)]
        count = lambda texts: (Counter(w for ws in texts for w in ws), Counter(p for ws in texts for p in zip([b" start", *ws], ws, strict=False)), Counter(w for ws in texts for w in [b" start", *ws[:-1]]))
        self.one, self.two, self.context = count([ws for _, ws in train])
        self.n, self.v = sum(self.one.values()), len(self.one)
        one, two, context = count([ws for i, ws in train if not deleted(i)])
        n, cells = sum(one.values()), Counter()
        for _, ws in [x for x in train if deleted(x[0])]:
            for h, w in zip([b" start", *ws], ws, strict=False):
                cells[self.bucket(context[h]), two[h, w] / max(context[h], 1), one[w] / max(n, 1)] += 1
        prior = {b: [0.3, 0.6, 0.1] if b else [0.0, 0.9, 0.1] for b in range(lm.BUCKETS)}
        self.weights = prior
        for _ in range(200):
            new = {b: list(p) for b, p in prior.items()}
            for (b, p2, p1), k in cells.items():
                parts = [w * p for w, p in zip(self.weights[b], (p2, p1, 1 / (self.v + 1)), strict=True)]
                for j in range(3):
                    new[b][j] += k * parts[j] / sum(parts)
            new[0][0] = 0
            self.weights = {b: [x / sum(w) for x in w] for b, w in new.items()}

    @staticmethod
    def bucket(c):
        return min(math.ceil(math.log2(c + 1)), lm.BUCKETS - 1)

    def p(self, w, h):
        x, y, z = self.weights[self.bucket(self.context[h])]
        return x * self.two[h, w] / max(self.context[h], 1) + y * self.one[w] / self.n + z / (self.v + 1)


def test_lm_score_against_a_brute_model(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    follow = {w: rng.choices(words, k=4) for w in words}

    def text(n):
        out = [rng.choice(words)]
        while len(out) < n:
            out.append(rng.choice(follow[out[-1]]) if rng.random() < 0.8 else rng.choice(words))
        return " ".join(out)

    rows = [(i, text(rng.randint(1, 30))) for i in range(150)] + [(1000, ""), (1001, None), (1002, "unknown words w1"), (3, "w1 w1"), (3, "w1 w1"), (1003, text(3000))]
    held, deleted = (lambda i: i >= 1000 or i % 7 == 2), (lambda i: i % 7 == 3)
    brute = BruteModel(rows, held, deleted)
    got = sorted((r.doc_id, r.n_tokens, r.score) for r in lm.scores(cases.table(spark, rows), (F.col("doc_id") >= 1000) | (F.col("doc_id") % 7 == 2), F.col("doc_id") % 7 == 3, chunk=400, key_range=150).collect())
    want = sorted((i, len(ws), sum(math.log10(brute.p(w, h)) for h, w in zip([b" start", *ws], ws, strict=False))) for i, ws in brute.tokens)
    for a, b in zip(got, want, strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 0.01 * abs(b[2]) + 0.01
    for h in [b" start", *[w.encode() for w in words[:5]], b"unknown"]:  # a distribution: all known tokens and one unknown
        assert abs(sum(brute.p(w, h) for w in brute.one) + brute.p(b"?", h) - 1) < 1e-9


def test_lm_weights_from_a_histogram():
    h = [(5, lm.LEVELS - 5, lm.LEVELS - 20, 900), (5, 0, lm.LEVELS - 20, 100)]
    w = lm.learn_weights(h, 1000)
    assert np.allclose(w.sum(1), 1) and w[5, 0] > 0.7 and w[0, 0] == 0


def test_lm_weights_against_unbinned_counts():
    rng = np.random.default_rng(5)
    total, vocabulary, size, b = 5_000_000_000, 20_000_000, 4000, 24
    context = rng.integers(2**23, 2**24, size)
    two = np.where(rng.random(size) < 0.5, rng.integers(1, 40, size), 0)
    one = np.maximum(two, np.exp(rng.random(size) * np.log(1e6)).astype(np.int64))
    parts = np.stack([two / context, one / total, np.full(size, 1 / (vocabulary + 1))], 1)
    want = np.array([0.3, 0.6, 0.1])
    for _ in range(200):
        share = want * parts
        want = np.array([0.3, 0.6, 0.1]) + (share / share.sum(1, keepdims=True)).sum(0)
        want /= want.sum()
    cells = Counter(zip(lm._level(parts[:, 0]).tolist(), lm._level(parts[:, 1]).tolist(), strict=True))
    got = lm.learn_weights([(b, x, y, n) for (x, y), n in cells.items()], vocabulary)[b]
    assert np.abs(got - want).max() < 0.01
    assert np.allclose(lm._of_level(lm._level(parts[:, 1])), parts[:, 1], rtol=0.1)


def test_lm_byte_planes():
    a = np.array([0, 1, 2**40, 2**63], np.uint64)
    assert (lm.unsqueezed(lm.squeezed(a), np.uint64) == a).all() and len(lm.unsqueezed(lm.squeezed(a[:0]), np.uint64)) == 0


def test_quality_orders_grades(spark):
    rng = random.Random(4)
    bad, mid, good = ["spam%%%", "buy###"], ["so", "so"], ["fine", "good"]
    rows = [(i, cases.prose(rng, 30) + " " + " ".join(rng.choice((bad, mid, good)[i % 3]) for _ in range(15))) for i in range(300)]
    ratings = spark.createDataFrame([(i, i % 3) for i in range(240)] + [(None, 1), (1, None)], "doc_id bigint, grade int")
    model = quality.learn(cases.table(spark, rows), ratings)
    assert model.grades == [0, 1, 2] and model.thresholds[0] < model.thresholds[1]
    got = {r.doc_id: r.q for r in quality.graded(cases.table(spark, [*rows, *[(i + 1000 if i is not None else None, t) for i, t in cases.texts()]]), model, name="q").collect()}
    means = [np.mean([got[i].expected for i in range(240, 300) if i % 3 == g]) for g in range(3)]
    assert means[0] < 0.7 < means[1] < 1.4 < means[2]
    assert all(0 <= q.tail <= 1 and 0 <= q.expected <= 2 for q in got.values())
    fit = lambda *g: quality.fit(np.ones(len(g), int), np.ones(len(g)), np.ones(len(g), int), np.array(g, int))
    one = fit(2)
    assert quality.graded(cases.table(spark), one).select("_quality.expected").distinct().first()[0] == 2
    assert quality.graded(cases.empty(spark), fit()).count() == 0


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_toxicity_scores_against_brute_force(spark):
    """The features of the docstring, with edit distances to every term instead of the automaton."""
    import re

    terms, strength = ["grublo", "snivel*", "worthless"], [2.0, 1.5, 3.0]
    model = toxicity.Model(terms, strength, [-2.0, 1.1, 0.4, 0.2, 0.7, 0.5, 0.6, -0.4, 0.3, -0.6])
    word = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")

    def hit(raw):
        found = []
        for w in word.findall(raw.lower()):
            for n, t in enumerate(terms):
                if t.endswith("*"):
                    found += [(0, n)] * w.startswith(t[:-1])
                elif (d := _levenshtein(w, t)) <= toxicity.edits_allowed(len(t)):
                    found.append((d, n))
        return min(found, default=None)

    def score(text):
        raws = (text or "").split()
        exact = fuzzy = quoted = fuzzy_quoted = top = 0.0
        aimed, kinds, n_hits = 0, set(), 0
        for i, raw in enumerate(raws):
            if (h := hit(raw)) is None:
                continue
            n_hits += 1
            d, n = h
            near = {w for r in raws[max(0, i - 6) : i + 7] for w in word.findall(r.lower())}
            opened = any(r[0] in toxicity._QUOTES for r in raws[max(0, i - 6) : i]) and any(r.rstrip(".,;:!?")[-1:] in tuple(toxicity._QUOTES) for r in raws[i : i + 7])
            marked = raw[0] in toxicity._QUOTES or raw[-1] in toxicity._QUOTES or opened
            if marked or near & toxicity.REPORTING:
                quoted, fuzzy_quoted = (quoted, fuzzy_quoted + strength[n]) if d else (quoted + strength[n], fuzzy_quoted)
            elif d:
                fuzzy += strength[n]
            else:
                exact, top = exact + strength[n], max(top, strength[n])
                kinds.add(n)
            aimed += bool(near & toxicity.ADDRESS)
        k = len(raws)
        x = [1, math.log1p(exact), top, math.log1p(len(kinds)), math.log1p(fuzzy), math.log1p(100 * n_hits / (k + 20)), math.log1p(aimed), math.log1p(quoted), math.log1p(k) / 5, math.log1p(fuzzy_quoted)]
        return 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.weights, strict=True))))

    rng = random.Random(6)
    bits = ["grublo", "Grubblo", "grubl", "sniveling", '"worthless"', "worthles", "said", "you", "he", '"so', 'it"', "fine.", "don't", "—"]
    rows = [(i, " ".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))) for i in range(300)] + [(400, None), (401, "")]
    got = {r.doc_id: r.tox for r in toxicity.scored(cases.table(spark, rows), model, name="tox").collect()}
    assert all(abs(got[i] - score(t)) < 1e-9 for i, t in rows)


def test_quality_against_brute_force(spark):
    """Scores by one loop over features, and a fit whose loss nothing near it beats."""
    rng = random.Random(9)
    words = [(["spam", "buy"], ["so", "and"], ["fine", "good"])[g] for g in range(3)]
    rows = [(i, " ".join(rng.choice(words[i % 3] + ["the", "of"]) for _ in range(12))) for i in range(90)]
    model = quality.learn(cases.table(spark, rows), spark.createDataFrame([(i, i % 3) for i in range(90)], "doc_id bigint, grade int"))

    def tails(text, weights, thresholds):
        s = sum(v * float(weights[i]) for i, v in zip(*quality.features(text), strict=True))
        return [1 / (1 + math.exp(t - s)) for t in thresholds]

    got = {r.doc_id: r.q for r in quality.graded(cases.table(spark, [*rows, (500, None), (501, "")]), model, name="q").collect()}
    for i, t in [*rows, (500, None), (501, "")]:
        a = tails(t, model.weights, model.thresholds)
        assert abs(got[i].tail - a[0]) < 1e-5 and abs(got[i].expected - sum(a)) < 1e-5

    def loss(weights, thresholds):
        out = quality.RIDGE * float((weights**2).sum()) / 2 / len(rows)
        for i, t in rows:
            a = [1.0, *tails(t, weights, thresholds), 0.0]
            out -= math.log(max(a[i % 3] - a[i % 3 + 1], 1e-9)) / len(rows)
        return out

    best = loss(model.weights, model.thresholds)
    noise = np.random.default_rng(1)
    used = sorted({i for _, t in rows for i in quality.features(t)[0]})
    for _ in range(20):
        w = model.weights.copy()
        w[used] += noise.normal(0, 0.3, len(used)).astype(np.float32)
        assert loss(w, model.thresholds + noise.normal(0, 0.3, 2)) > best
