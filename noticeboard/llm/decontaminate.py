"""Benchmark decontamination by winnowing.

A window is ``span`` consecutive words of an item (an item of fewer words is one window). Of each window the least
hash of its k-grams is kept as fingerprint, on both sides, so every shared span of ``span`` words has a fingerprint
in common. Fingerprints are joined, and each hit is extended window by window over equal words; a word inside any
occurrence of a window counts as hit.

The benchmark's index goes to all tasks, as sorted arrays of hashes in blocks of at most ``block_words`` words each; the
documents are read once, against all blocks. A worker holds all of the index, about 60 bytes a benchmark word, so a
benchmark may have some ten million words; documents have no bound and are not shuffled. Windows are told apart by
64-bit hashes of 64-bit hashes of their words, and must meet in their fingerprint too.

Defined cases: null or empty texts have no words and no hits; items without words match nothing; items with a null
id take part under the id "null"; a document's row with a null id is searched like any other; repeated rows and rows of one id give a
result each; a very long text is read whole, in one task; other columns of either table play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeboard.llm.common import free_name, grams, map_arrow, merged, word_hashes

SPAN, K, BLOCK_WORDS = 10, 5, 2_000_000
#: bytes.translate: A-Z become a-z, bytes of words stay, all else becomes a space
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def _least(h: np.ndarray, size: int, k: int) -> np.ndarray:
    """The fingerprint of each window of `size` words: the least hash of its k-grams."""
    k = min(k, size)
    g, n = grams(h, k), len(h) - size + 1
    least = g[:n].copy()
    for j in range(1, size - k + 1):
        np.minimum(least, g[j : j + n], out=least)
    return least


class Index:
    """Windows of a block of items, by size: sorted fingerprints, and sorted windows with the items that have them."""

    def __init__(self, items: list[tuple[str, str | None]], span: int = SPAN, k: int = K):
        self.k, self.names = k, [name for name, _ in items]
        h, ends = word_hashes([text for _, text in items], _TABLE)
        by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
        for number, ws in enumerate(np.split(h, ends[:-1])):
            if len(ws):
                by_size.setdefault(min(span, len(ws)), []).append((number, ws))
        self.sizes = {}
        for size, of_size in by_size.items():
            prints = np.unique(np.concatenate([_least(ws, size, k) for _, ws in of_size]))
            windows = np.concatenate([grams(ws, size) for _, ws in of_size])
            owner = np.repeat([n for n, _ in of_size], [len(ws) - size + 1 for _, ws in of_size]).astype(np.int32)
            order = np.argsort(windows, kind="stable")
            self.sizes[size] = prints, windows[order], owner[order]

    def find(self, h: np.ndarray) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of hit words (start, end) and the items, for a text's word hashes."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        for size, (prints, windows, owner) in self.sizes.items():
            if len(h) < size:
                continue
            least = _least(h, size, self.k)
            met = prints[np.minimum(np.searchsorted(prints, least), len(prints) - 1)] == least
            if not met.any():
                continue
            at = np.flatnonzero(met)
            mine = grams(h, size)[at]
            first, last = np.searchsorted(windows, mine), np.searchsorted(windows, mine, "right")
            hit = first < last
            spans += [(i, i + size) for i in at[hit].tolist()]
            for a, b in set(zip(first[hit].tolist(), last[hit].tolist(), strict=True)):
                items |= {self.names[n] for n in owner[a:b]}
        return spans, items


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[str, str | None]]]:
    """Items in blocks of at most block_words words (or one item); the driver holds one block at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        n = len(words(row.t))
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append((row.i if row.i is not None else "null", row.t))
        size += n
    yield block


KIND = "struct<n_words:bigint,spans:array<struct<start:int,end:int>>,items:array<string>>"


def contamination(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN, k: int = K, block_words: int = BLOCK_WORDS, name: str = "contamination") -> DataFrame:
    """docs with a column of what was found: n_words, hit spans (word positions) and item ids (as strings, sorted).

    The column's name gets underscores in front until it is free. One pass over docs, without a shuffle.
    """
    name = free_name(docs, name)
    sc = docs.sparkSession.sparkContext
    indexes = [sc.broadcast(Index(block, span, k)) for block in _blocks(benchmark, item_col, item_text_col, block_words)]

    def match(batch: pa.RecordBatch) -> list:
        out = []
        texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
        for i in range(0, len(texts), 64):
            h, ends = word_hashes(texts[i : i + 64], _TABLE)
            for ws in np.split(h, ends[:-1]):
                found = [index.value.find(ws) for index in indexes]
                spans = merged([x for s, _ in found for x in s])
                out.append({"n_words": len(ws), "spans": [{"start": a, "end": b} for a, b in spans], "items": sorted({x for _, items in found for x in items})})
        return [out]

    return map_arrow(docs, match, f"`{name}` {KIND}", keep=True)


def op2(spark, sf_dir: str) -> DataFrame:
    """Contract digest of ``contamination`` for all documents."""
    from noticeboard.llm.common import table

    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    c = F.col("contamination")
    n_hit = F.aggregate(c["spans"], F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", c["n_words"].alias("n_words"), n_hit.alias("n_hit"), F.size(c["items"]).cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", c["items"]), 256).alias("items_sha256"), (F.size(c["spans"]) > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """docs without the rows that have a hit; their columns are as they were."""
    found = contamination(docs, benchmark, **kw)
    name = found.columns[-1]
    return found.filter(F.size(F.col(f"`{name}`.spans")) == 0).select([F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT DISTINCT doc_id, i, dw.size AS size, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON pos.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id
"""
