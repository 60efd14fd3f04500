"""Language-model scoring by deleted interpolation.

A bigram model: p(w | h) = l2 c(h w)/c(h) + l1 c(w)/N + l0 /(V + 1), where the weights depend on the bucket of c(h)
(powers of two) and are learnt by expectation-maximisation on held-out counts: one fold of the training documents is
deleted from the counts and predicted from the rest; then all training documents count. A text's first word follows
a start mark, and one end follows its last word. N counts words and ends, V their distinct ones; what is unknown has
the share of one more word. For each context the probabilities of all words and the unknown one sum to 1.

How it runs. One pass turns texts into chunks of some million tokens: a word list and token numbers, written to the
shared folder. Each chunk sends each distinct n-gram once, with its counts, to the range of the 56-bit hash it falls
in; there the counts of all chunks are added up and go back in the order in which they came. So a frequent n-gram is
no hot key, nothing grows on the driver, and a task holds one range or one chunk. The held-out tokens reach the
expectation-maximisation as a histogram over (bucket, c(h w)/c(h), c(w)/N), the latter two in log steps.

Defined cases: a null or empty text is the end alone; repeated rows count each; a row with a null id trains; an empty
table has no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeboard.llm.common import STEP, U, crc_of_id, mixed, ship, slices, space_words, stored, table

CHUNK, RANGE, BITS, BUCKETS, LEVELS = 1_200_000, 1_500_000, 56, 48, 256
END, START = U(xxhash.xxh3_64_intdigest(b" end ")), U(xxhash.xxh3_64_intdigest(b" start "))  # no words: they hold spaces


def squeezed(a: np.ndarray) -> bytes:
    """Integers as byte planes under zstandard."""
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()) if len(a) else b""


def unsqueezed(b: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    raw = zstandard.ZstdDecompressor().decompress(b) if b else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


class _Numbers(dict):
    """word -> its number in this chunk, in order of appearance; 0 is the end."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


class _Chunk:
    def __init__(self):
        self.numbers, self.parts, self.sizes, self.ids, self.held, self.tokens = _Numbers(), [], [], [], [], 0

    def add(self, i, text: str | None, held: bool) -> None:
        ws = space_words(text)
        a = np.zeros(len(ws) + 1, np.int32)
        a[:-1] = np.fromiter(map(self.numbers.__getitem__, ws), np.int32, len(ws))
        self.parts.append(a)
        self.sizes.append(len(a))
        self.ids.append(i)
        self.held.append(held)
        self.tokens += len(a)


CHUNK_FIELDS = "chunk bigint, held array<boolean>, sizes binary, tokens binary, words binary, n_tokens bigint, n_train bigint"


def chunks(docs: DataFrame, held_out: Column, deleted: Column, *, id_col: str, text_col: str, chunk: int = CHUNK) -> DataFrame:
    """Rows of about `chunk` tokens. Odd chunk numbers hold the deleted fold of the training documents, even ones the rest."""
    ship(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"), F.coalesce(deleted, F.lit(False)).alias("deleted"))
    kind = d.schema["id"].dataType.simpleString()
    names = ["ids", "chunk", "held", "sizes", "tokens", "words", "n_tokens", "n_train"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, count, base, id_type = [_Chunk(), _Chunk()], 0, TaskContext.get().partitionId() << 24, None

        def row(c: _Chunk, odd: int) -> pa.RecordBatch:
            words = np.array([int(END), *map(xxhash.xxh3_64_intdigest, c.numbers)], U)
            often = np.bincount(np.concatenate(c.parts), minlength=len(words))
            order = np.argsort(-often, kind="stable")  # small numbers for frequent words
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            sizes = np.array(c.sizes, np.int32)
            n_train = int(sizes[~np.array(c.held)].sum())
            values = [pa.array([c.ids], pa.list_(id_type)), pa.array([(base + count) * 2 + odd], pa.int64()), pa.array([c.held], pa.list_(pa.bool_())), *(pa.array([x], pa.binary()) for x in (squeezed(sizes), squeezed(place[np.concatenate(c.parts)]), squeezed(words[order]))), pa.array([c.tokens], pa.int64()), pa.array([n_train], pa.int64())]
            return pa.RecordBatch.from_arrays(values, names=names)

        for b in (part for whole in batches for part in slices(whole)):
            id_type = b.column(0).type
            for i, text, held, deleted in zip(*(c.to_pylist() for c in b.columns), strict=True):
                odd = int(deleted and not held)
                open_[odd].add(i, text, held)
                if open_[odd].tokens >= chunk:
                    yield row(open_[odd], odd)
                    open_[odd], count = _Chunk(), count + 1
        for odd, c in enumerate(open_):
            if c.tokens:
                yield row(c, odd)
                count += 1

    return d.mapInArrow(run, f"ids array<{kind}>, {CHUNK_FIELDS}")


class Opened:
    """A chunk's tokens, and its n-grams as sorted distinct 56-bit keys."""

    def __init__(self, sizes: bytes, tokens: bytes, words: bytes):
        self.sizes, self.tokens, words = unsqueezed(sizes, np.int32), unsqueezed(tokens, np.int32), unsqueezed(words, U)
        self.starts = np.r_[0, np.cumsum(self.sizes)[:-1]]
        now = words[self.tokens]
        before = np.empty_like(now)
        before[1:] = now[:-1]
        before[self.starts] = START
        self.one, self.one_of_word = np.unique(words >> U(64 - BITS), return_inverse=True)
        self.two, self.two_at = np.unique(mixed(before * STEP + mixed(now)) >> U(64 - BITS), return_inverse=True)


def _ranges(keys: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """Of n equal ranges of the key space those that sorted keys fall in: (range, where it begins, where it ends)."""
    width = -(-(1 << BITS) // n)
    at = keys // U(width)
    edges = np.r_[0, np.flatnonzero(at[1:] != at[:-1]) + 1, len(keys)] if len(keys) else np.zeros(1, np.int64)
    return list(zip(at[edges[:-1]].tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def grams_of_chunks(c: DataFrame, n_one: int, n_two: int) -> DataFrame:
    """chunk, bucket, keys, counts: distinct n-grams by range, with their counts in training documents. Buckets under n_one are of words."""
    odd_names = ["chunk", "bucket", "keys", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                o = Opened(r["sizes"], r["tokens"], r["words"])
                train = np.repeat(~np.array(r["held"], bool), o.sizes)
                one = np.bincount(o.one_of_word[o.tokens[train]], minlength=len(o.one))
                two = np.bincount(o.two_at[train], minlength=len(o.two))
                rows = []
                for first, n, keys, counts in ((0, n_one, o.one, one), (n_one, n_two, o.two, two)):
                    for k, a, b in _ranges(keys, n):
                        rows.append((r["chunk"], first + k, squeezed(np.diff(keys[a:b], prepend=U(0))), squeezed(counts[a:b].astype(np.uint32))))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=odd_names)

    return c.select("chunk", "held", "sizes", "tokens", "words").mapInArrow(run, "chunk bigint, bucket bigint, keys binary, counts binary")


def _add_up(t: pa.Table) -> pa.Table:
    """All chunks' rows of one range -> the same chunks' rows with the corpus' counts (all, deleted fold), and how many keys occur in training."""
    chunk = t.column("chunk").to_pylist()
    keys = [np.cumsum(unsqueezed(k, U), dtype=U) for k in t.column("keys").to_pylist()]
    counts = [unsqueezed(c, np.uint32).astype(np.int64) for c in t.column("counts").to_pylist()]
    sizes = [len(k) for k in keys]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    odd = np.repeat(np.array(chunk) % 2 == 1, sizes)
    counts = np.concatenate(counts)
    total = np.bincount(at, counts, len(distinct)).astype(np.int64)
    fold = np.bincount(at[odd], counts[odd], len(distinct)).astype(np.int64)
    ends = np.cumsum(sizes)
    backs = [(squeezed(total[a]), squeezed(fold[a])) for a in np.split(at, ends[:-1])]
    known = [int((total > 0).sum()), *[0] * (len(chunk) - 1)]
    return pa.table({"chunk": t.column("chunk"), "bucket": t.column("bucket"), "total": pa.array([b[0] for b in backs], pa.binary()), "fold": pa.array([b[1] for b in backs], pa.binary()), "known": pa.array(known, pa.int64())})


class Counted:
    """A chunk with the corpus' counts for each token: of it (one), of it after the one before (two), of that one (context)."""

    def __init__(self, row: dict, back: pa.Table, n_one: int, starts: tuple[int, int]):
        o = self.opened = Opened(row["sizes"], row["tokens"], row["words"])
        rows = sorted(back.select(["bucket", "total", "fold"]).to_pylist(), key=lambda r: r["bucket"])
        put = lambda field, two: np.concatenate([np.zeros(0, np.int64), *(unsqueezed(r[field], np.int64) for r in rows if (r["bucket"] >= n_one) == two)])
        self.total = self._spread(o, put("total", False), put("total", True), starts[0])
        self.fold = self._spread(o, put("fold", False), put("fold", True), starts[1])

    @staticmethod
    def _spread(o: Opened, one: np.ndarray, two: np.ndarray, starts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        now = one[o.one_of_word][o.tokens]
        context = np.empty_like(now)
        context[1:] = now[:-1]
        context[o.starts] = starts
        return now, two[o.two_at], context


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(context + 1.0)).astype(np.int64), BUCKETS - 1)


def _level(p: np.ndarray) -> np.ndarray:
    """0 for none, else log steps of a quarter of a power of two, down to 2^-63: under 1/N of any corpus."""
    return np.where(p > 0, np.clip(LEVELS - 1 + np.round(4 * np.log2(np.maximum(p, 1e-30))), 1, LEVELS - 1), 0).astype(np.int64)


def _of_level(level: np.ndarray) -> np.ndarray:
    return np.where(level > 0, 2.0 ** ((level - LEVELS + 1) / 4), 0.0)


def learn_weights(histogram: list[tuple[int, int, int, int]], vocabulary: int, rounds: int = 200) -> np.ndarray:
    """Weights (bucket, [two, one, none]) by expectation-maximisation over (bucket, level of two, level of one, tokens)."""
    weights = np.tile([0.3, 0.6, 0.1], (BUCKETS, 1))
    weights[0] = [0.0, 0.9, 0.1]
    if histogram:
        k, a, u, n = np.array(histogram, np.int64).T
        parts = np.stack([_of_level(a), _of_level(u), np.full(len(k), 1 / (vocabulary + 1))], 1)
        prior = weights.copy()
        for _ in range(rounds):
            share = weights[k] * parts
            share = share / share.sum(1, keepdims=True) * n[:, None]
            new = prior.copy()  # one token's worth, for buckets that have none
            for j in range(3):
                new[:, j] += np.bincount(k, share[:, j], BUCKETS)
            new[0, 0] = 0
            new /= new.sum(1, keepdims=True)
            if np.abs(new - weights).max() < 1e-7:
                break
            weights = new
    return weights


def scores(docs: DataFrame, held_out: Column, deleted: Column, *, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, key_range: int = RANGE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row for each document.

    held_out: documents that neither count nor teach. deleted: the fold of the others on which the weights are learnt.
    """
    spark = docs.sparkSession
    c = stored(chunks(docs, held_out, deleted, id_col=id_col, text_col=text_col, chunk=chunk), "chunks")
    docs_by = F.size(F.filter("held", lambda h: ~h))
    s = c.agg(F.sum("n_tokens").alias("all"), F.sum("n_train").alias("n"), F.sum(docs_by).alias("starts"), F.sum(F.when(F.col("chunk") % 2 == 1, F.col("n_train"))).alias("n_fold"), F.sum(F.when(F.col("chunk") % 2 == 1, docs_by)).alias("fold_starts")).first()
    n, n_fold, starts = s["n"] or 0, s["n_fold"] or 0, (s["starts"] or 0, s["fold_starts"] or 0)
    n_one = n_two = max(1, -(-(s["all"] or 0) // key_range))
    sent = grams_of_chunks(c, n_one, n_two)
    back = stored(sent.groupBy("bucket").applyInArrow(_add_up, "chunk bigint, bucket bigint, total binary, fold binary, known bigint"), "counts")
    v = back.filter(F.col("bucket") < n_one).agg(F.sum("known")).first()[0] or 0

    def tally(left: pa.Table, right: pa.Table) -> pa.Table:
        out = np.zeros((4, 0), np.int64)
        for row in left.to_pylist():
            x = Counted(row, right, n_one, starts)
            one, two, context = (a - b for a, b in zip(x.total, x.fold, strict=True))
            p2, p1 = two / np.maximum(context, 1), one / max(n - n_fold, 1)
            cells, count = np.unique((_bucket(context) * LEVELS + _level(p2)) * LEVELS + _level(p1), return_counts=True)
            out = np.concatenate([out, np.array([cells // LEVELS // LEVELS, cells // LEVELS % LEVELS, cells % LEVELS, count])], 1)
        return pa.table({"bucket": out[0], "two": out[1], "one": out[2], "n": out[3]})

    odd = F.col("chunk") % 2 == 1
    h = c.filter(odd).groupBy("chunk").cogroup(back.filter(odd).groupBy("chunk")).applyInArrow(tally, "bucket bigint, two bigint, one bigint, n bigint")
    h = h.groupBy("bucket", "two", "one").agg(F.sum("n").alias("n"))  # in bucket b no p2 is under 2^-b and no p1 under 1/N: some 8 b^2 log2(N) cells up to bucket b, 300,000 at 5 billion tokens
    weights = learn_weights([(r.bucket, r.two, r.one, r.n) for r in h.collect()], v)
    kind = docs.select(id_col).schema[0].dataType

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        for i, row in enumerate(left.to_pylist()):
            x = Counted(row, right, n_one, starts)
            one, two, context = x.total
            w = weights[_bucket(context)]
            p = w[:, 0] * two / np.maximum(context, 1) + w[:, 1] * one / max(n, 1) + w[:, 2] / (v + 1)
            by_doc = lambda y: np.add.reduceat(y, x.opened.starts)  # noqa: B023, E731
            ids = left.column("ids").combine_chunks()
            ids = ids.slice(i, 1).flatten()
            parts.append(pa.table({"doc_id": ids, "held_out": pa.array(row["held"], pa.bool_()), "n_tokens": x.opened.sizes.astype(np.int64), "n_known": by_doc((one > 0).astype(np.int64)), "train_tokens": np.full(len(ids), n), "base_score": by_doc(np.log10((one + 1) / (n + v + 1))), "score": by_doc(np.log10(p))}))
        return pa.concat_tables(parts) if parts else pa.table({"doc_id": pa.array([], left.schema.field("ids").type.value_type), "held_out": pa.array([], pa.bool_()), **{k: pa.array([], pa.int64()) for k in ("n_tokens", "n_known", "train_tokens")}, **{k: pa.array([], pa.float64()) for k in ("base_score", "score")}})

    return c.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(score, f"doc_id {kind.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op9(spark, sf_dir: str) -> DataFrame:
    fold = F.pmod(crc_of_id("doc_id"), F.lit(7))
    return scores(table(spark, sf_dir, "documents"), fold == 2, fold == 3)
