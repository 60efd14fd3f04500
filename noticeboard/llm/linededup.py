"""Line dedup: pairs of documents through shared units, patience alignment, deletion of the common blocks.

A unit is a window of `BLOCK_WORDS` consecutive words, as long as the least that is deleted. Of every `WINNOW`
neighbouring windows the one with the least hash is kept (at a text's ends also of fewer), so whatever the texts'
lines, script or punctuation, two texts that share `PASSAGE` = BLOCK_WORDS + WINNOW - 1 words in a row keep a unit in
common. Units stand in the place of rare lines: whole lines miss passages that start or end inside a line. A frequent unit is no
burden that a cutoff would have to take away, because a kept unit links each document that has it to the earliest one
only (its first holder). As the unit is itself a block to delete, its first holder always has that block, so no shared
passage of PASSAGE words stays whole.

Each pair is aligned in full (`align`): the windows that occur once in either text are its anchors, the longest chain
of anchors in the order of both texts (patience) gives the aligned blocks, and what both texts have beyond that chain,
moved or repeated, gives blocks too. The words of all blocks go from the later text (the greater id), so of a pair
every common run of BLOCK_WORDS words or more goes, to its last word. Of a passage whose units have different first
holders up to WINNOW - 1 words may stay at either end, where these first holders go on differently.

A document has as many partners as first holders of its units, so copies make a star, not all pairs. A first holder
of very many is dealt out in lots of about `LOT` partners. Each deleted word has an equal one in an earlier document, so of
every text the earliest copy stays.

Defined cases: null and empty texts stay as they are; a row with a null id stays as it is; rows of one id aren't
compared with each other, and each loses only what was found in its own text; a text of fewer than BLOCK_WORDS words
has no unit; a very long text is read whole, in one task; passages are those of the texts as they came, not such as arise where a
deletion joins two parts; other columns are kept by `deduplicated` and play no part.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeboard.llm.common import BASE, INVERSE, U, free_name, map_arrow, merged, mixed, powers, ship, stored, table, word_hashes, word_places

BLOCK_WORDS, WINNOW, LOT = 40, 12, 32
PASSAGE = BLOCK_WORDS + WINNOW - 1
_MOST = U(2**64 - 1)


def read(text: str | None) -> np.ndarray:
    return word_hashes([text])[0]


def windows(words: np.ndarray, k: int = BLOCK_WORDS) -> np.ndarray:
    """64-bit hashes of all runs of k words, in order."""
    n = len(words)
    if n < k:
        return np.zeros(0, U)
    sums = np.r_[U(0), np.cumsum(mixed(words) * powers(BASE, n), dtype=U)]
    return mixed((sums[k:] - sums[:-k]) * powers(INVERSE, n - k + 1))


def _sliding(least_or_most: np.ufunc, a: np.ndarray, n: int) -> np.ndarray:
    """The least (or most) of each n neighbours."""
    size = 1
    while 2 * size <= n:
        a = least_or_most(a[:-size], a[size:])
        size *= 2
    return least_or_most(a[: len(a) - n + size], a[n - size :]) if size < n else a


def units(words: np.ndarray, ends: np.ndarray, k: int = BLOCK_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """text, hash of each text's distinct units; ends: where the texts end."""
    h = windows(words, k)
    sizes = np.diff(np.r_[0, ends])
    inside = np.arange(k, k + len(h)) <= np.repeat(ends, sizes)[: len(h)]
    h[~inside] = _MOST
    margin = np.full(WINNOW - 1, _MOST)
    kept = inside & (_sliding(np.maximum, _sliding(np.minimum, np.r_[margin, h, margin], WINNOW), WINNOW) == h) if len(h) else inside
    doc, h = np.repeat(np.arange(len(ends)), sizes)[: len(h)][kept], h[kept]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])] if len(h) else np.zeros(0, bool)
    return doc[new], h[new]


class Held:
    """An earlier text's windows, to align later ones with."""

    def __init__(self, words: np.ndarray, block_words: int = BLOCK_WORDS):
        self.block_words = block_words
        self.values, self.first, self.counts = np.unique(windows(words, block_words), return_index=True, return_counts=True)

    def align(self, later: np.ndarray) -> list[tuple[int, int, int]]:
        """Common blocks (start, end in the later text, start in this one), in order of the later text: every window of it that this one has is in a block."""
        h = windows(later, self.block_words)
        if not len(h) or not len(self.values):
            return []
        at = np.minimum(np.searchsorted(self.values, h), len(self.values) - 1)
        places = np.flatnonzero(self.values[at] == h)
        to = at[places]
        anchor = (self.counts[to] == 1) & (np.bincount(to)[to] == 1)
        chained = np.zeros(len(places), bool)
        runs = _runs(places[anchor], self.first[to[anchor]])
        spots, ends = np.flatnonzero(anchor), np.cumsum([n for _, _, n in runs])
        for i in longest_chain([y for _, y, _ in runs]):
            chained[spots[ends[i] - runs[i][2] : ends[i]]] = True
        blocks = [r for part in (chained, ~chained) for r in _runs(places[part], self.first[to[part]])]
        return sorted((x, x + n + self.block_words - 1, y) for x, y, n in blocks)


def _runs(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int]]:
    """Neighbours on a diagonal, put together: (first x, first y, how many)."""
    if not len(x):
        return []
    edges = np.r_[0, np.flatnonzero((np.diff(x) != 1) | (np.diff(y) != 1)) + 1, len(x)]
    return list(zip(x[edges[:-1]].tolist(), y[edges[:-1]].tolist(), np.diff(edges).tolist(), strict=True))


def longest_chain(starts: list[int]) -> list[int]:
    """Patience: the numbers of a longest increasing sequence of distinct starts."""
    tops: list[int] = []
    who: list[int] = []
    before = [-1] * len(starts)
    for i, start in enumerate(starts):
        pile = bisect_left(tops, start)
        before[i] = who[pile - 1] if pile else -1
        tops[pile : pile + 1] = [start]
        who[pile : pile + 1] = [i]
    out, i = [], who[-1] if who else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(earlier: np.ndarray, later: np.ndarray, block_words: int = BLOCK_WORDS) -> list[tuple[int, int]]:
    """Spans of words (start, end) of `later` that lie in common blocks of block_words words or more."""
    return merged([(a, b) for a, b, _ in Held(earlier, block_words).align(later)])


def _pairs(docs: DataFrame, block_words: int) -> DataFrame:
    """id, row, first: rows of docs (id, row, text) and the first holders of their units."""
    kind = docs.schema["id"].dataType.simpleString()

    def kept(b: pa.RecordBatch) -> list:
        texts, out = b.column(2).to_pylist(), []
        for i in range(0, len(texts), 256):
            doc, h = units(*word_hashes(texts[i : i + 256]), block_words)
            out.append((h.view(np.int64), doc + i))
        h, doc = (np.concatenate(x) for x in zip(*out, strict=True))
        return [pa.array(h), b.column(0).take(pa.array(doc)), b.column(1).take(pa.array(doc))]

    rows = stored(map_arrow(docs.filter("id is not null and text is not null"), kept, f"unit bigint, id {kind}, row bigint"), "units")
    first = rows.groupBy("unit").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first != last").select("unit", "first")
    hits = rows.join(first.hint("merge"), "unit").filter("id != first")
    return stored(hits.select("id", "row", "first").distinct(), "pairs")


def _same(a: DataFrame, b: DataFrame, id_col: str, row_col: str):
    """Rows of one id and row. Only ids are keys, so that all joins of the texts can share one exchange of them."""
    return a[id_col].eqNullSafe(b["id"]) & (a[row_col].bitwiseXOR(b["row"]) == 0)


def repeated_blocks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", row_col: str, block_words: int = BLOCK_WORDS) -> DataFrame:
    """id, row, blocks (start, end, first holder, start there; in words): what to delete, for rows that have any. row_col tells rows of one id apart."""
    ship(docs.sparkSession)
    pairs = _pairs(docs.select(F.col(id_col).alias("id"), F.col(row_col).alias("row"), F.col(text_col).cast("string").alias("text")), block_words)
    kind = pairs.schema["id"].dataType.simpleString()
    lots = stored(pairs.groupBy("first").agg(F.ceil(F.count("*") / LOT).alias("lots")), "lots")
    later = pairs.join(lots.hint("merge"), "first").select("id", "row", "first", F.pmod(F.xxhash64("id", "row"), "lots").alias("lot"))
    holders = lots.select(F.col("first").alias("id"), F.lit(None).cast("bigint").alias("row"), "first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("lots") - 1)).alias("lot"))
    roles = stored(later.unionByName(holders), "roles")
    same = docs[id_col].eqNullSafe(roles["id"]) & (F.coalesce(roles["row"], docs[row_col]).bitwiseXOR(docs[row_col]) == 0)
    dealt = docs.join(roles.hint("merge"), same).select(roles["first"].alias("first"), roles["lot"].alias("lot"), roles["row"].isNull().alias("holds"), roles["id"].alias("id"), docs[row_col].alias("row"), docs[text_col].cast("string").alias("text"))

    def compare(t: pa.Table) -> pa.Table:
        holds = np.array(t.column("holds").to_pylist(), bool)
        h, ends = word_hashes(t.column("text").to_pylist())
        texts = np.split(h, ends[:-1])
        held = [Held(texts[i], block_words) for i in np.flatnonzero(holds)]
        out = [(i, *block) for i in np.flatnonzero(~holds).tolist() for e in held for block in e.align(texts[i])]
        at, start, end, there = (np.array(x, np.int64) for x in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 4
        mine = t.select(["id", "row", "first"]).take(pa.array(at))
        return pa.table({"id": mine.column("id"), "row": mine.column("row"), "start": start, "end": end, "first": mine.column("first"), "there": there})

    blocks = dealt.groupBy("first", "lot").applyInArrow(compare, f"id {kind}, row bigint, start bigint, end bigint, first {kind}, there bigint")
    return blocks.groupBy("id", "row").agg(F.array_sort(F.collect_set(F.struct("start", "end", "first", "there"))).alias("blocks"))


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and the white space after each span."""
    data = text.encode("utf-8", "surrogatepass")
    starts = word_places(data)[0].tolist()
    out, at = [], 0
    for a, b in merged(spans):
        b = min(b, len(starts))
        if a < b:
            out.append(data[at : starts[a]])
            at = starts[b] if b < len(starts) else len(data)
    kept = (b"".join(out) + data[at:]).decode("utf-8", "surrogatepass")
    return kept.rstrip(" \t\n\r\x0b\x0c") if out and at == len(data) else kept


KIND = "struct<text:string,n_words:bigint,n_deleted:bigint>"


def cleaned(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS, name: str = "lines") -> DataFrame:
    """docs with a column of the text that stays, its former words and how many of them were deleted.

    The texts move once, by id: to the pairs and to their blocks (two exchanges where docs has more columns than these).
    """
    row, got = free_name(docs, "row_hash"), free_name(docs, "blocks")
    docs = docs.withColumn(row, F.xxhash64(text_col))
    blocks = repeated_blocks(docs, id_col=id_col, text_col=text_col, row_col=row, block_words=block_words)
    both = docs.join(blocks.hint("merge"), _same(docs, blocks, id_col, row), "left").select(*(docs[f"`{c}`"] for c in docs.columns if c != row), blocks["blocks"].alias(got))
    name = free_name(both, name)

    def run(b: pa.RecordBatch) -> list:
        out = []
        for text, s in zip(b.column(b.schema.get_field_index(text_col)).to_pylist(), b.column(b.schema.get_field_index(got)).to_pylist(), strict=True):
            s = merged([(x["start"], x["end"]) for x in s or []])
            n = len(text.encode("utf-8", "surrogatepass").split()) if text else 0
            out.append({"text": without(text, s) if s else text, "n_words": n, "n_deleted": sum(e - a for a, e in s)})
        return [out]

    return map_arrow(both, run, f"`{name}` {KIND}", keep=True).drop(got)


def op1(spark, sf_dir: str) -> DataFrame:
    c = cleaned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return c.select("doc_id", "lines.n_words", "lines.n_deleted", "lines.text")


def deduplicated(docs: DataFrame, *, length_col: str | None = None, text_col: str = "text", **kw) -> DataFrame:
    """docs with repeated blocks deleted; rows of which nothing stays go. Other columns are as they were, but for length_col."""
    c = cleaned(docs, text_col=text_col, **kw)
    s = f"`{c.columns[-1]}`"
    c = c.filter((F.col(f"{s}.n_deleted") == 0) | (F.col(f"{s}.n_deleted") < F.col(f"{s}.n_words")))
    new = {text_col: F.col(f"{s}.text"), length_col: F.when(F.col(f"{s}.n_deleted") > 0, F.length(f"{s}.text").cast("bigint")).otherwise(F.col(f"`{length_col}`"))}
    return c.select([new[x].alias(x) if x in new else F.col(f"`{x}`") for x in docs.columns])
