"""Toxicity: a lexicon's trie met with Levenshtein automata, and context windows that tell quotation from abuse.

The lexicon is learnt: words and word beginnings ("stems", marked by a trailing *) that labelled toxic documents have
many times more often than others. A word is run through the product of the lexicon's trie with the automaton of all
strings within ``edits`` of a term; the product's states are made when first needed and kept, so that a word costs one
lookup a letter and most words die after a few. Each hit is weighed by its window: in quotation marks or near words of
reporting it counts as quoted, misspelled or not, near second-person words as aimed at somebody; misspelled hits have sums
of their own, quoted and plain. A logistic model over these sums, fitted on other rows than the lexicon, gives the score.
Stems are met as they are, without edits.

Learning reads at most ``sample`` labelled rows (by hash of the id; equal texts count once). labels, lang, source and
doc_id are no inputs of a score. Of all candidate terms the `terms` of the strongest evidence are kept, ranked where they
are counted. Defined cases: a null or empty text has no words and gets the score of no hits; a row with a null id is scored
but not learnt from; a very long text is read whole, in one task; repeated rows and rows of one id get a score each;
without labelled rows the built-in terms and weights hold; other columns play no part.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeboard.llm.common import cache, crc_of_id, free_name, map_arrow, ship, table

SAMPLE, TERMS, WINDOW, LEAST = 12_000, 600, 6, 4
#: fixed values: a small starting lexicon
SEED_TERMS = ("trash", "pathetic", "idiot", "disgusting", "worthless", "clown", "stupid", "loser", "scum", "moron")
#: fixed values: words of reporting and of address, in four languages
REPORTING = frozenset("said says say wrote called calls word term quote quoted reported slur sagte schrieb nannte wort zitat dit écrit appelé mot cite dijo escribió llamó palabra cita".split())
ADDRESS = frozenset("you your youre du dein deine ihr euch tu ton ta vous votre tú tu vosotros usted".split())
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_QUOTES = "\"“”„«»‘’'"


def edits_allowed(length: int) -> int:
    return 0 if length < 5 else 1 if length < 9 else 2


class Automaton:
    """Terms under edits, determinised step by step. Reading a word gives (term number, edits) of the nearest term."""

    def __init__(self, terms: list[str], states: int = 60_000):
        self.terms, self.most = terms, states
        self.children: list[dict[str, int]] = [{}]
        self.whole, self.stem, self.budget = [-1], [-1], [0]
        for number, term in enumerate(terms):
            node, stem = 0, term.endswith("*")
            word = term.rstrip("*")
            allowed = 0 if stem else edits_allowed(len(word))
            for c in word:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.whole.append(-1)
                    self.stem.append(-1)
                    self.budget.append(0)
                node = self.children[node][c]
                self.budget[node] = max(self.budget[node], allowed)
            self.budget[0] = max(self.budget[0], allowed)
            if stem:
                self.stem[node] = number
            else:
                self.whole[node] = number
        self._reset()

    def _reset(self) -> None:
        self.next: list[dict[str, int]] = []
        self.sets: list[tuple] = []
        self.ends: list[tuple[int, int] | None] = []
        self.numbers: dict[tuple, int] = {}
        self.start = self._state({0: 0}, None)

    def _closed(self, at: dict[int, int]) -> dict[int, int]:
        """With what leaving out letters of the term reaches, at an edit each."""
        queue = list(at)
        while queue:
            node = queue.pop()
            edits = at[node] + 1
            for child in self.children[node].values():
                if edits <= self.budget[child] and edits < at.get(child, 99):
                    at[child] = edits
                    queue.append(child)
        return at

    def _state(self, at: dict[int, int], stem: int | None) -> int:
        at = self._closed(at)
        key = (tuple(sorted(at.items())), stem)
        if key not in self.numbers:
            self.numbers[key] = len(self.sets)
            self.sets.append(key)
            self.next.append({})
            best = min(((e, self.whole[n]) for n, e in at.items() if self.whole[n] >= 0 and e <= edits_allowed(len(self.terms[self.whole[n]]))), default=None)
            if stem is not None and (best is None or best[0] > 0):
                best = (0, stem)
            self.ends.append((best[1], best[0]) if best else None)
        return self.numbers[key]

    def _step(self, state: int, c: str) -> int:
        at, stem = self.sets[state]
        after: dict[int, int] = {}
        for node, edits in at:
            child = self.children[node].get(c)
            if child is not None and edits < after.get(child, 99):
                after[child] = edits
                if edits == 0 and self.stem[child] >= 0:
                    stem = self.stem[child]
            if edits < self.budget[node]:
                if edits + 1 < after.get(node, 99):
                    after[node] = edits + 1  # a letter too many
                for other, child in self.children[node].items():
                    if other != c and edits + 1 <= self.budget[child] and edits + 1 < after.get(child, 99):
                        after[child] = edits + 1
        new = -1 if not after and stem is None else self._state(after, stem)
        self.next[state][c] = new
        return new

    def find(self, word: str) -> tuple[int, int] | None:
        if len(self.sets) > self.most:
            self._reset()
        state = self.start
        for c in word:
            after = self.next[state].get(c)
            if after is None:
                after = self._step(state, c)
            if after < 0:
                return None
            state = after
        return self.ends[state]


@dataclass
class Model:
    terms: list[str] = field(default_factory=lambda: list(SEED_TERMS))
    strength: list[float] = field(default_factory=lambda: [3.0] * len(SEED_TERMS))
    weights: list[float] = field(default_factory=lambda: [-3.0, 1.0, 0.5, 0.3, 0.0, 1.0, 0.5, -0.5, 0.3, -0.5])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.weights), -30, 30)))


class Reader:
    """Features of a text under a lexicon. Remembers the verdict on the words seen."""

    def __init__(self, terms: list[str], strength: list[float], remembered: int = 400_000):
        self.automaton, self.strength, self.remembered = Automaton(terms), strength, remembered
        self.known: dict[str, tuple[int, int] | None] = {}

    def _hit(self, raw: str) -> tuple[int, int] | None:
        hit = None
        for m in _WORD.finditer(raw.lower()):
            found = self.automaton.find(m[0])
            if found and (hit is None or found[1] < hit[1]):
                hit = found
        if len(self.known) < self.remembered:
            self.known[raw] = hit
        return hit

    def features(self, text: str | None) -> list[float]:
        raws = text.split() if text else []
        known, hits = self.known, []
        for i, raw in enumerate(raws):
            hit = known[raw] if raw in known else self._hit(raw)
            if hit:
                hits.append((i, *hit))
        exact = fuzzy = quoted = fuzzy_quoted = aimed = top = 0.0
        kinds = set()
        for i, term, edits in hits:
            s = self.strength[term]
            near = raws[max(0, i - WINDOW) : i + WINDOW + 1]
            words = {m[0] for r in near for m in _WORD.finditer(r.lower())}
            reported = raws[i][0] in _QUOTES or raws[i][-1] in _QUOTES or self._inside(raws, i) or words & REPORTING
            if reported and edits:
                fuzzy_quoted += s
            elif reported:
                quoted += s
            elif edits:
                fuzzy += s
            else:
                exact += s
                kinds.add(term)
                top = max(top, s)
            aimed += bool(words & ADDRESS)
        n = len(raws)
        rate = 100 * len(hits) / (n + 20)
        return [1.0, math.log1p(exact), top, math.log1p(len(kinds)), math.log1p(fuzzy), math.log1p(rate), math.log1p(aimed), math.log1p(quoted), math.log1p(n) / 5, math.log1p(fuzzy_quoted)]

    @staticmethod
    def _inside(raws: list[str], i: int) -> bool:
        """Between an opening mark before and a closing one after, in the window."""
        before = [r for r in raws[max(0, i - WINDOW) : i] if r[0] in _QUOTES]
        after = [r for r in raws[i : i + WINDOW + 1] if r.rstrip(".,;:!?")[-1:] in tuple(_QUOTES)]
        return bool(before and after)


def units(text: str) -> set[str]:
    """Words of four letters and more, and their beginnings as stems."""
    out = set()
    for w in {m[0] for m in _WORD.finditer(text.lower())}:
        if len(w) >= 4:
            out.add(w)
            out.update(f"{w[:k]}*" for k in range(4, min(len(w), 9)))
    return out


def lexicon(tally: DataFrame, n_toxic: int, n_other: int, terms: int = TERMS) -> tuple[list[str], list[float]]:
    """The `terms` with the strongest evidence among tally's (term, a toxic texts, b other texts), and their log odds: in LEAST toxic texts or more, log odds over 1.5 and over five standard deviations, ranked by these."""
    a, b, n = F.col("a"), F.col("b"), max(1, n_toxic + n_other)
    odds = F.log((a + 0.5) / (n_toxic + 1)) - F.log((b + 0.5) / (n_other + 1))
    share = (a + b) / n
    sure = (a - n_toxic * share) / F.sqrt(F.greatest(F.lit(1e-9), n_toxic * share * (1 - share)))
    ranked = tally.filter(a >= LEAST).select("term", odds.alias("odds"), F.round(sure, 9).alias("sure")).filter("odds > 1.5 and sure > 5")
    rows = ranked.orderBy(F.desc("sure"), "term").limit(terms).collect()
    chosen = dict.fromkeys(SEED_TERMS, 2.0) | {r.term: r.odds for r in rows}
    return list(chosen), [min(6.0, o) for o in chosen.values()]


def fit(x: np.ndarray, y: np.ndarray, start: list[float], rounds: int = 60, ridge: float = 1.0) -> list[float]:
    """Logistic regression by Newton's method, drawn to `start` by the ridge."""
    w0 = np.array(start)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - y @ z + ridge * ((w - w0) ** 2).sum() / 2)

    w, now = w0, loss(w0)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * (w - w0))
        while (then := loss(w + step)) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w + step
        if now - then < 1e-6:
            break
        now = then
    return w.tolist()


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, terms: int = TERMS) -> Model:
    """A model from labelled rows: two thirds of the sample give the lexicon, one third the weights.

    `labels` has no more than `sample` rows taken (those of least hash); their ids and labels (at most that many) are
    broadcast, so that docs is not shuffled.
    """
    ship(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).dropna().groupBy("i").agg(F.max("y").alias("y"))
    n = known.count()
    if n > sample:
        known = known.filter(F.pmod(F.xxhash64("i"), F.lit(1_000_000)) < int(1e6 * sample / n))
    mine = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("text")).dropna().join(F.broadcast(known), "i").select("text", "y")
    mine = mine.groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("y").alias("y")).select("text", "y").persist()
    try:
        first = F.pmod(F.crc32(F.encode("text", "utf-8")), F.lit(3)) != 0
        counts = mine.filter(first).groupBy("y").count().collect()
        size = {r.y > 0: 0 for r in counts}
        for r in counts:
            size[r.y > 0] += r["count"]
        if not size.get(True) or not size.get(False):
            return Model()

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found: dict[str, list[int]] = {}
                for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    for u in units(text):
                        found.setdefault(u, [0, 0])[y <= 0] += 1
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array([v[0] for v in found.values()], pa.int64()), pa.array([v[1] for v in found.values()], pa.int64())], names=["term", "a", "b"])

        tally = mine.filter(first).mapInArrow(count, "term string, a bigint, b bigint").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        words, strength = lexicon(tally, size[True], size[False], terms)
        data = mine.filter(~first).mapInArrow(_featured(words, strength), "y int, x array<double>").toPandas()
    finally:
        mine.unpersist()
    if not len(data) or data.y.min() > 0 or data.y.max() <= 0:
        return Model(words, strength)
    return Model(words, strength, fit(np.array(data.x.tolist()), (data.y.to_numpy() > 0).astype(float), Model().weights))


def _featured(words: list[str], strength: list[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(words, strength)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(1).cast(pa.int32()), pa.array([reader.features(t) for t in b.column(0).to_pylist()], pa.list_(pa.float64()))], names=["y", "x"])

    return run


def reader(model: Model) -> Reader:
    key = zlib.crc32(repr((model.terms, model.strength)).encode())
    return cache(f"toxicity {key}", lambda: Reader(model.terms, model.strength))


def scored(docs: DataFrame, model: Model, *, text_col: str = "text", name: str = "toxicity") -> DataFrame:
    """docs with a column of scores from 0 to 1 (its name gets underscores in front until it is free). No shuffle."""
    name = free_name(docs, name)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> list:
        model = sent.value
        r = reader(model)
        x = np.array([r.features(t) for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()])
        return [pa.array(model.score(x))]

    return map_arrow(docs, run, f"`{name}` double", keep=True)


def op7(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = F.pmod(crc_of_id("doc_id"), F.lit(5))
    model = learn(docs, labels.filter(fold != 0))
    s = scored(docs.select("doc_id", "text"), model, name="score")
    return s.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """docs whose score is under the threshold; their columns are as they were."""
    s = scored(docs, model)
    return s.filter(F.col(f"`{s.columns[-1]}`") < threshold).select([F.col(f"`{c}`") for c in docs.columns])
