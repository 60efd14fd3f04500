"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w x) with thresholds in order and one set of weights for all grades, over hashed
features: each word, its ending and its shape, averaged over the text, and some steps of whole-text measures. The
model gives the expected grade and the tail probability P(grade >= t) by which texts are selected.

Fitting reads at most ``sample`` rated rows (of least hash of the id; their ids, at most that many, are broadcast, so
documents aren't shuffled); features go to the driver for that sample only. Scoring sends `2**BITS` weights along.

Defined cases: a null or empty text has the features of no words; with ratings of one grade only, that grade is
expected of all; without any, grade 0; a row with a null id is scored but not learnt from; a very long text is read whole, in one task;
repeated rows and rows of one id get a score each; other columns play no part.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeboard.llm.common import cache, crc_of_id, free_name, map_arrow, ship, table

SAMPLE, BITS, RIDGE, ROUNDS, SCALE = 8_000, 16, 1e-3, 250, 3.0


def _at(feature: str) -> int:
    return xxhash.xxh3_64_intdigest(feature.encode("utf-8", "surrogatepass")) >> (64 - BITS)


def _shape(word: str) -> str:
    """Upper, lower, digit and mark runs: "Word!!" is "Ulmm"."""
    out: list[str] = []
    for c in word:
        kind = "U" if c.isupper() else "l" if c.isalpha() else "d" if c.isdigit() else "m"
        if len(out) < 2 or out[-1] != kind or out[-2] != kind:
            out.append(kind)
    return "".join(out[:8])


def of_word(word: str) -> tuple[int, ...]:
    return _at(f"w{word.lower()}"), _at(f"e{word[-3:]}"), _at(f"s{_shape(word)}")


def of_text(text: str, words: list[str]) -> list[int]:
    """Steps of measures: length, share of distinct words, word length, lines, capitals, short words repeated at once."""
    n = len(words)
    measures = {"n": int(2 * math.log2(n + 1)), "d": round(12 * len(set(words)) / max(n, 1)), "l": round(2 * min(12, len(text) / max(n, 1))), "r": round(8 * math.log2(1 + text.count("\n") / max(n, 1))), "u": round(8 * sum(map(str.isupper, words)) / max(n, 1))}
    measures["t"] = round(8 * sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(n, 1))
    return [_at(f"{k}:{v}") for k, v in measures.items()]


def features(text: str | None) -> tuple[list[int], list[float]]:
    """Sparse features: places and values."""
    text = text or ""
    words = text.split()
    x: Counter[int] = Counter()
    for w, n in Counter(words).items():
        for i in of_word(w):
            x[i] += n * SCALE / len(words)
    for i in of_text(text, words):
        x[i] += 1.0
    return list(x), list(x.values())


@dataclass
class Model:
    grades: list[int]
    thresholds: np.ndarray
    weights: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """(texts, thresholds): P(grade > k-th)."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -30, 30)))


def fit(at: np.ndarray, value: np.ndarray, sizes: np.ndarray, grade: np.ndarray, rounds: int = ROUNDS, ridge: float = RIDGE) -> Model:
    """Maximum likelihood with a ridge, by Adam over the whole sample. Thresholds are a first one and positive steps.

    at, value: places and values of all rows' features, one row after another; sizes: how many each row has (none has 0).
    """
    grades = sorted(set(grade.tolist())) or [0]
    k, dims = len(grades) - 1, 1 << BITS
    if not k:
        return Model(grades, np.zeros(0), np.zeros(dims, np.float32))
    y = np.searchsorted(np.array(grades), grade)
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    above = np.array([(y > j).mean() for j in range(k)])
    cuts = -np.log(above / (1 - above))
    p = np.r_[np.zeros(dims), cuts[0], np.log(np.maximum(np.diff(cuts), 1e-2))]
    m, v = np.zeros_like(p), np.zeros_like(p)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, rounds + 1):
        w, theta = p[:dims], np.cumsum(np.r_[p[dims], np.exp(p[dims + 1 :])])
        s = np.add.reduceat(value * w[at], starts)
        low = np.c_[np.zeros(len(y)), sigmoid(theta[None, :] - s[:, None]), np.ones(len(y))]  # P(grade <= ...)
        slope = low * (1 - low)
        row = np.arange(len(y))
        share = np.maximum(low[row, y + 1] - low[row, y], 1e-9)
        d_score = (slope[row, y + 1] - slope[row, y]) / share / len(y)
        d_theta = np.zeros(k)
        np.subtract.at(d_theta, y[y < k], (slope[row, y + 1] / share / len(y))[y < k])
        np.add.at(d_theta, y[y > 0] - 1, (slope[row, y] / share / len(y))[y > 0])
        tail = np.cumsum(d_theta[::-1])[::-1]
        g = np.r_[np.bincount(at, value * d_score[doc], dims) + ridge * w / len(y), tail[0], tail[1:] * np.exp(p[dims + 1 :])]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(grades, np.cumsum(np.r_[p[dims], np.exp(p[dims + 1 :])]), p[:dims].astype(np.float32))


def learn(docs: DataFrame, ratings: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", sample: int = SAMPLE) -> Model:
    """A model from at most about `sample` rated rows (of several ratings of an id, the greatest)."""
    ship(docs.sparkSession)
    known = ratings.select(F.col(id_col).alias("i"), F.col(grade_col).cast("int").alias("g")).dropna().groupBy("i").agg(F.max("g").alias("g"))
    n = known.count()
    if n > sample:
        known = known.filter(F.pmod(F.xxhash64("i"), F.lit(1_000_000)) < int(1e6 * sample / n))
    mine = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("text")).join(F.broadcast(known), "i").select("text", "g")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([a for a, _ in x], pa.list_(pa.int32())), pa.array([v for _, v in x], pa.list_(pa.float32()))], names=["g", "a", "v"])

    rows = mine.mapInArrow(read, "g int, a array<int>, v array<float>").toArrow()
    at, value = (rows.column(c).combine_chunks() for c in ("a", "v"))
    return fit(at.flatten().to_numpy(), value.flatten().to_numpy(), at.value_lengths().to_numpy(), rows.column("g").to_numpy())


class _Weights(dict):
    """word -> the sum of its features' weights; the first 300,000 words are remembered."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        x = float(self.weights[list(of_word(word))].sum())
        if len(self) < 300_000:
            self[word] = x
        return x


def graded(docs: DataFrame, model: Model, *, text_col: str = "text", least: int | None = None, name: str = "quality") -> DataFrame:
    """docs with a column of the expected grade and P(grade >= least) (by default: the least grade but one). No shuffle."""
    name = free_name(docs, name)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    key = zlib.crc32(model.weights.tobytes() + model.thresholds.tobytes())

    def run(b: pa.RecordBatch) -> list:
        model = sent.value
        of = cache(f"quality {key}", lambda: _Weights(model.weights))
        s = []
        for text in b.column(b.schema.get_field_index(text_col)).to_pylist():
            text = text or ""
            words = text.split()
            s.append(SCALE * sum(map(of.__getitem__, words)) / max(len(words), 1) + float(model.weights[of_text(text, words)].sum()))
        tails = model.tails(np.array(s))
        grades = np.array(model.grades, float)
        expected = grades[0] + tails @ np.diff(grades)
        lowest = model.grades[min(1, len(model.grades) - 1)] if least is None else least
        over = sum(g < lowest for g in model.grades)
        tail = np.ones(len(s)) if not over else np.zeros(len(s)) if over > tails.shape[1] else tails[:, over - 1]
        return [[{"expected": float(e), "tail": float(t)} for e, t in zip(expected, tail, strict=True)]]

    return map_arrow(docs, run, f"`{name}` struct<expected:double,tail:double>", keep=True)


def ratings(labels: DataFrame, fold: Column) -> DataFrame:
    """Grades 0 (poor), 1 (good, but toxic), 2 (good) from the labels outside a fold."""
    return labels.filter(fold != 0).select("doc_id", F.when(F.col("quality") == 0, 0).otherwise(2 - F.coalesce(F.col("toxic"), F.lit(0))).alias("grade"))


def op10(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out (no label of these is used), expected_grade, p_good (P(grade >= 1)), keep (p_good >= 0.5)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.pmod(crc_of_id("doc_id"), F.lit(5))
    g = graded(docs, learn(docs, ratings(table(spark, sf_dir, "labels"), fold)))
    return g.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), F.col("quality.expected").alias("expected_grade"), F.col("quality.tail").alias("p_good"), (F.col("quality.tail") >= 0.5).alias("keep"))
