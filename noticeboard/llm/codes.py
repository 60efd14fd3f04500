"""Vector code compression: product quantisation with integer codebooks, assigned by partial-distance search.

A vector is cut into equal parts; a part's code is the number of the nearest entry in the codebook of its place. Codebooks
are taught by rounds: every part goes to its nearest entry, each entry moves to the floor of its parts' mean.

The search (`nearest`) goes through a codebook's dimensions by falling variance. After a few dimensions, in which all entries
still count, the entry that is nearest so far gets its complete distance; from then on every entry whose accumulated
distance strictly exceeds the best complete distance is dropped, and what is left is carried on as one list of (row,
entry) for the whole batch. Distances are integers, so ties are exact and go to the lower number.

Scale. A round is one pass over the vectors: tasks add up counts and sums by entry, Spark adds up the tasks' cells (parts x
entries x dimensions, which is also all that reaches the driver). The codes are written once; sums by label are joined with
them, labels of more than a thousandth of all rows (a thousand at most) by broadcast, so that no label is a hot key.

Defined cases: null vectors and those with null or non-finite entries get no row (see `vectors.kept`); a table of fewer
vectors than entries has as many entries as vectors; first entries are those of the smallest ids, of one id by the vector,
null ids last; a length that the parts don't divide is filled up with zeros; repeated rows each count; null labels are one
label; a sum of errors beyond a long is null; an empty table gives no rows; other columns are kept by `encode` and play no part.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeboard.llm.common import free_name, map_arrow, stored, table
from noticeboard.llm.vectors import SAFE, fitting, kept, matrix, scaled, sums

PARTS, ENTRIES, ROUNDS, HEAD, HOT = 4, 256, 4, 3, 1000


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of x: the number of the nearest entry (of equally near ones the lowest) and its squared distance."""
    if x.dtype != book.dtype:
        x, book = x.astype(object), book.astype(object)
    order = np.argsort(-book.astype(np.float64).var(axis=0), kind="stable")
    x, book = x[:, order], book[:, order]
    head = min(HEAD, x.shape[1])
    so_far = np.zeros((len(x), len(book)), x.dtype)
    for j in range(head):
        so_far += (x[:, j, None] - book[None, :, j]) ** 2
    guess = so_far.argmin(axis=1)
    best = ((x - book[guess]) ** 2).sum(axis=1)
    row, entry = np.nonzero((so_far <= best[:, None]).astype(bool))
    distance = so_far[row, entry]
    for j in range(head, x.shape[1]):
        distance = distance + (x[row, j] - book[entry, j]) ** 2
        left = (distance <= best[row]).astype(bool)
        if j + 1 == x.shape[1] or left.mean() < 0.8:
            row, entry, distance = row[left], entry[left], distance[left]
    starts = np.searchsorted(row, np.arange(len(x)))  # each row's guess is still there, so no row is without entries
    least = np.minimum.reduceat(distance, starts) if len(x) else distance
    hit = np.flatnonzero((distance == least[row]).astype(bool))
    first = hit[np.searchsorted(row[hit], np.arange(len(x)))]
    return entry[first], least


def cut(x: np.ndarray, parts: int = PARTS) -> list[np.ndarray]:
    """The vectors' parts, of one width; zeros fill up the last."""
    width = -(-x.shape[1] // parts)
    x = np.pad(x, ((0, 0), (0, parts * width - x.shape[1])))
    return [x[:, i * width : (i + 1) * width] for i in range(parts)]


def _integers(column: pa.Array, d: int, rows: int = 1024):
    """Batches of the vectors' integers."""
    for i in range(0, len(column), rows):
        yield fitting(scaled(matrix(column.slice(i, rows), d)))


def _round(df: DataFrame, vec_col: str, d: int, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round over the rows of df."""
    parts, (entries, width) = len(books), books[0].shape

    def add(state: np.ndarray, b: pa.RecordBatch) -> None:
        for x in _integers(b.column(0), d):
            for p, part in enumerate(cut(x, parts)):
                at = nearest(part, books[p])[0]
                total = np.zeros((entries, width + 1), part.dtype)
                np.add.at(total, at, np.c_[part, np.ones((len(part), 1), part.dtype)])
                state[p] += total

    got = sums(df, [vec_col], lambda: np.zeros((parts, entries, width + 1), object), add, exact=True)
    out = []
    for p, book in enumerate(books):
        new = book.astype(object)
        for e in range(entries):
            at = (p * entries + e) * (width + 1)
            if n := got.get(at + width):
                new[e] = [got.get(at + j, 0) // n for j in range(width)]
        out.append(_typed(new))
    return out


def _typed(book: np.ndarray) -> np.ndarray:
    return book.astype(np.int64) if not book.size or max(map(abs, book.ravel().tolist())) < SAFE else book.astype(object)


def learn(df: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks (entries x width) by part, from all kept vectors of df; none of an empty table."""
    df, d = kept(df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")), "vec")
    first = df.orderBy(F.col("id").asc_nulls_last(), "vec").limit(entries).select("vec").collect() if d else []
    if not first:
        return []
    books = [_typed(b) for b in cut(scaled(np.array([r["vec"] for r in first], np.float64)), parts)]
    for _ in range(rounds):
        books = _round(df, "vec", d, books)
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' integers by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


KIND = "struct<code:string,error:decimal(38,0)>"


def encode(df: DataFrame, books: list[np.ndarray], *, vec_col: str = "embedding", name: str = "code") -> DataFrame:
    """The kept rows of df with a column of their code (two hex digits a part) and its error (squared distance over all parts)."""
    df, d = kept(df, vec_col)
    name = free_name(df, name)
    parts = len(books)
    if not books:
        df = df.limit(0)

    def run(b: pa.RecordBatch) -> list:
        codes, errors = [], []
        for x in _integers(b.column(b.schema.get_field_index(vec_col)), d):
            error = np.zeros(len(x), object)
            code = np.zeros((len(x), parts), np.uint8)
            for p, part in enumerate(cut(x, parts)):
                at, distance = nearest(part, books[p])
                code[:, p] = at
                error = error + distance.astype(object)
            codes += [row.tobytes().hex() for row in code]
            errors += [Decimal(int(e)) if e < 10**38 else None for e in error]
        return [pa.StructArray.from_arrays([pa.array(codes, pa.string()), pa.array(errors, pa.decimal128(38, 0))], names=["code", "error"])]

    return map_arrow(df, run, f"`{name}` {KIND}", keep=True)


def with_label_errors(coded: DataFrame) -> DataFrame:
    """coded (label, error, ...) with label_error: the errors' sum over the rows of equal labels. Reads coded three times, so it should be a table."""
    total = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"), F.count("*").alias("rows"))
    total = stored(total, "label-errors")
    share = coded.count() / HOT
    same = coded["label"].eqNullSafe(total["of"])
    hot = F.broadcast(total.filter(F.col("rows") > share))
    rest = total.filter(F.col("rows") <= share).hint("merge")
    by_hot = coded.join(hot, same)
    others = coded.join(hot, same, "left_anti")
    return by_hot.unionByName(others.join(rest, others["label"].eqNullSafe(rest["of"]))).drop("of", "rows")


def op13(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = learn(vectors)
    coded = stored(encode(vectors, books).select("vec_id", "label", "code.code", "code.error"), "codes")
    out = with_label_errors(coded)
    return out.select("vec_id", "code", F.col("error").try_cast("bigint").alias("error"), F.col("label_error").try_cast("bigint").alias("label_error"), F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """The contract in SQL: four rounds, each an assignment of all parts to all entries, and one more."""
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""
a{r} AS (SELECT vec_id, p, arg_min(e, (s, e)) AS e, min(s) AS s FROM (
  SELECT v.vec_id, v.p, b.e, list_sum(list_transform(range(1, {{w}} + 1), lambda i: (v.x[i] - b.x[i]) * (v.x[i] - b.x[i])))::BIGINT AS s FROM parts v JOIN b{r} b ON b.p = v.p) GROUP BY vec_id, p)""")
        if r < ROUNDS:
            steps.append(f"""
m{r} AS (SELECT p, e, list(m ORDER BY i) AS x FROM (SELECT a.p, a.e, i, CAST(floor(sum(v.x[i])::DECIMAL(38, 6) / count(*)) AS BIGINT) AS m FROM a{r} a JOIN parts v ON v.vec_id = a.vec_id AND v.p = a.p, range(1, {{w}} + 1) t(i) GROUP BY a.p, a.e, i) GROUP BY p, e),
b{r + 1} AS (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN m{r} m ON m.p = b.p AND m.e = b.e)""")
    body = ",".join(steps).replace("{w}", "16")
    return f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
parts AS (SELECT vec_id, p, x[16 * p + 1:16 * p + 16] AS x FROM k, range(0, {PARTS}) t(p)),
b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM parts WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT {ENTRIES})),{body},
c AS (SELECT vec_id, string_agg(lower(lpad(to_hex(e), 2, '0')), '' ORDER BY p) AS code, CAST(sum(s) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id),
l AS (SELECT k.label, CAST(sum(c.error) AS BIGINT) AS label_error FROM k JOIN c ON c.vec_id = k.vec_id GROUP BY k.label),
h AS (SELECT sha256(string_agg(v, ',' ORDER BY p, e)) AS codebooks_sha256 FROM (SELECT p, e, array_to_string(x, ',') AS v FROM b{ROUNDS}))
SELECT c.vec_id, c.code, c.error, l.label_error, h.codebooks_sha256 FROM c JOIN k ON k.vec_id = c.vec_id JOIN l ON l.label IS NOT DISTINCT FROM k.label, h
"""


#: for vectors of 64 entries and distinct ids
ORACLE = _oracle()
