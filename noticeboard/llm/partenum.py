"""N-gram Jaccard join by PartEnum signatures: exact, by partitions of the feature domain.

Sets whose Jaccard similarity is at least the threshold differ in few shingles: of sets of at most r shingles, in k = 2r (1 - t) /
(1 + t) at most. Sizes are cut into bands, so wide that similar sets lie in one band or in two neighbouring ones; an
instance serves the pairs whose larger set lies in its band, so a set takes part in two instances. In an instance the domain
of shingle hashes is cut into partitions, and a signature is a hash of what a set has in some of them:

* k = 0: one partition, as sets must be equal;
* k up to 4: few partitions, a signature for every choice of all but k of them (the k others may differ);
* k under 24: partitions of which one at least holds no more than one difference, each cut into four; a signature for every
  choice of three of the four;
* beyond: more than k partitions, of which one at least holds no difference; a signature each.

So similar sets share a signature, always; of partitions that stand alone they share all but k, so a set with fewer shared ones has no
similar set in that instance. Signatures of nothing (of empty partitions) would be shared by unlike sets;
a set leaves them out if it has enough others that k differences can't spoil them all.

Sets that share a signature are a bucket. In buckets of up to `FEW` sets all pairs are compared, first by how many shingles they
have in each part of the domain (these counts differ by no more than the sets do, so no link is lost), then by the full
sets. In larger ones `stars` finds the links by full sets, without the pairs of a group of copies.

Scale. Texts are read twice where they lie: for ids, keys and counts, and for signatures, of equal texts in a task only
once. The signatures (about 0.6 a shingle, 24 bytes each) move once and are sorted by signature and key, so that
pairs, stars and how many signatures a set shares are read off in one stream, whatever the bucket's size. Only the texts
of sets that come through the counts or are in large buckets move, once, by id. A class of equal sets of more than a thousandth of
all rows is joined by broadcast (a thousand at most).

Defined cases: texts without words have an empty set and are linked with nothing; texts of fewer words than a shingle
have one; rows of one id are linked with each other, and each has the size of its own set; a row with a null id is
linked with nothing, its component null; a very long text is read whole, in one task; an empty table gives no rows; other
columns play no part.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeboard.llm import stars
from noticeboard.llm.common import STEP, U, map_arrow, mixed, ship, stored, table
from noticeboard.llm.neardup import SHINGLE, _per_row, all_shingles

#: partitions for every choice of all but k of them; from which k on partitions stand alone, and how many more than k
CHOICES, SINGLE, MORE, FEW = {1: 3, 2: 5, 3: 6, 4: 7}, 24, 1.2, 12


class Bands:
    """The bands of sizes and their instances, for one threshold."""

    def __init__(self, percent: int):
        self.percent, self.low, self.high = percent, [1], [100 // percent]

    def of(self, n: int) -> int:
        while self.high[-1] < n:
            self.low.append(self.high[-1] + 1)
            self.high.append(100 * self.low[-1] // self.percent)
        return bisect_left(self.high, n)

    def instances(self, n: int) -> Iterator[tuple[int, int]]:
        """Number and k of the instances of a set of n shingles: its own band's, and the next one's if a set there can be similar."""
        i = self.of(n)
        self.of(self.high[i] + 1)
        yield i, self._most(i)
        if 100 * n >= self.percent * self.low[i + 1]:
            yield i + 1, self._most(i + 1)

    def _most(self, i: int) -> int:
        return 2 * (100 - self.percent) * self.high[i] // (100 + self.percent)


@lru_cache(None)
def _choices(k: int) -> np.ndarray:
    """(choices, partitions) of 0 and 1: all but k partitions."""
    n = CHOICES[k]
    return np.array([[int(j in c) for j in range(n)] for c in combinations(range(n), n - k)], U)


def _sums(s: np.ndarray, sums: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """What a set (sorted hashes) has in each of so many equal parts of the domain: the sum of its mixed hashes, and how many."""
    edges = (np.arange(1, parts, dtype=np.float64) * (2.0**64 / parts)).astype(U)
    at = np.r_[0, np.searchsorted(s, edges), len(s)]
    return np.diff(sums[at]), np.diff(at)


def _by_instance(s: np.ndarray, bands: Bands) -> Iterator[tuple[np.ndarray, int]]:
    """The signatures of a set of sorted distinct 64-bit hashes in each of its instances, and how many of them at least it shares with any similar set there."""
    sums = np.r_[U(0), np.cumsum(mixed(s), dtype=U)]
    for i, k in bands.instances(len(s)):
        shares = 1
        if k == 0:
            got, empty, need = sums[-1:], np.zeros(1, bool), 1
        elif k in CHOICES:
            part, _ = _sums(s, sums, CHOICES[k])
            got, empty, need = (_choices(k) * part).sum(axis=1, dtype=U), np.zeros(1, bool), 1
        elif k < SINGLE:
            part, size = (x.reshape(-1, 4) for x in _sums(s, sums, 4 * (k // 2 + 2)))
            got = (part.sum(axis=1, dtype=U)[:, None] - part).ravel()
            without = size.sum(axis=1)[:, None] == size
            empty, need = without.ravel(), len(size) if (~without.any(axis=1)).sum() <= k // 2 else 0
        else:
            got, size = _sums(s, sums, int(MORE * k) + 1)
            full = int((size > 0).sum())
            empty, need, shares = size == 0, len(size) if full <= k else 0, max(1, full - k)
        got = mixed(got ^ mixed((np.arange(len(got), dtype=U) + U(i << 32) + U(1)) * STEP))
        yield got if need else got[~empty], shares


def signatures(s: np.ndarray, bands: Bands) -> np.ndarray:
    """The signatures of a set; similar sets share one."""
    return np.concatenate([got for got, _ in _by_instance(s, bands)])


def _key(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _short(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def _named(docs: DataFrame, k: int) -> DataFrame:
    """id, n, key, short key and counts (null for an empty set), of every row."""

    def run(b: pa.RecordBatch) -> list:
        n, keys, parts = [], [], []
        for i in range(0, b.num_rows, 64):
            for s in all_shingles(b.column(1).slice(i, 64).to_pylist(), k):
                n.append(len(s))
                keys.append(_key(s) if len(s) else None)
                parts.append(stars.counts(s) if len(s) else None)
        return [b.column(0), n, keys, [x and _short(x) for x in keys], parts]

    return stored(map_arrow(docs, run, f"id {docs.schema['id'].dataType.simpleString()}, n bigint, key binary, short bigint, counts binary"), "named")


def _signed(docs: DataFrame, percent: int, k: int) -> DataFrame:
    """short, shares, signature of all sets, shares as by `_by_instance`; of equal sets in a task only the first one's."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        bands = Bands(percent)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                short, shares, signs = [], [], []
                for s in all_shingles(b.column(0).slice(i, 256).to_pylist(), k):
                    if len(s) and (x := _short(_key(s))) not in seen:
                        seen.add(x)
                        for got, least in _by_instance(s, bands):
                            short.append(x)
                            shares.append(least)
                            signs.append(got.view(np.int64))
                ends = np.cumsum([0, *map(len, signs)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(signs) if signs else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(short, pa.int64()), pa.array(shares, pa.int64()), lists], names=["short", "shares", "signatures"])

    rows = docs.filter("id is not null").select("text").mapInArrow(run, "short bigint, shares bigint, signatures array<bigint>")
    return rows.select("short", "shares", F.explode("signatures").alias("signature"))


def _read_off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (signature, short), sorted: a, b, whether the bucket is large. Of small buckets all pairs, of large ones each set with the first."""
    now, held, large = None, np.zeros(0, np.int64), False  # the bucket that the last batch ended in: its sets, or of a large one the first

    def rows(a: np.ndarray, b: np.ndarray, big: bool) -> np.ndarray:
        return np.c_[a, b, np.full(len(a), int(big))]

    def pairs(who: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        out = []
        for n in range(2, FEW + 1):
            at = starts[sizes == n]
            out += [rows(who[at + i], who[at + j], False) for i in range(n) for j in range(i + 1, n)] if len(at) else []
        return out

    for b in batches:
        if not b.num_rows:
            continue
        at, who = (b.column(i).to_numpy() for i in (0, 1))
        starts = np.r_[0, np.flatnonzero(at[1:] != at[:-1]) + 1]
        sizes = np.diff(np.r_[starts, len(at)])
        out = []
        if at[0] == now:
            mine = who[: sizes[0]]
            if not large and len(held) + len(mine) > FEW:
                out.append(rows(np.full(len(held) - 1, held[0]), held[1:], True))
                held, large = held[:1], True
            if large:
                out.append(rows(np.full(len(mine), held[0]), mine, True))
            else:
                held = np.r_[held, mine]
            starts, sizes = starts[1:], sizes[1:]
        if len(starts):
            out += pairs(held, np.zeros(1, np.int64), np.array([len(held)])) if now is not None and not large else []
            now, last, large = at[-1], who[starts[-1] :], sizes[-1] > FEW
            out += [rows(np.full(len(last) - 1, last[0]), last[1:], True)] if large else []
            held = last[:1] if large else last
            starts, sizes = starts[:-1], sizes[:-1]
            big = sizes > FEW
            first = np.repeat(who[starts[big]], sizes[big] - 1)
            places = np.concatenate([np.arange(s + 1, s + n) for s, n in zip(starts[big], sizes[big], strict=True)]) if big.any() else np.zeros(0, np.int64)
            out += [*pairs(who, starts, sizes), rows(first, who[places], True)]
        found = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
        found = np.unique(found[found[:, 0] != found[:, 1]], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(found[:, 2] == 1)], names=["a", "b", "large"])
    if now is not None and not large and len(held) > 1:
        found = np.unique(np.concatenate(pairs(held, np.zeros(1, np.int64), np.array([len(held)]))), axis=0)
        found = found[found[:, 0] != found[:, 1]]
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(np.zeros(len(found), bool))], names=["a", "b", "large"])


class _Shared:
    """Counts, batch by batch of (signature, short, shares), sorted, which sets have which signature in common with another one."""

    def __init__(self):
        self.last = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]  # the last row, and whether it has been counted

    def of(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """short, shares, and how many rows of these have turned out to be shared."""
        new = [*(b.column(i).to_numpy() for i in (0, 1, 2)), np.zeros(b.num_rows, bool)]
        at, who, shares, counted = (np.concatenate(x) for x in zip(self.last, new, strict=True))
        once = np.r_[True, (at[1:] != at[:-1]) | (who[1:] != who[:-1])][: len(at)]
        at, who, shares, counted = at[once], who[once], shares[once], counted[once]
        same = at[1:] == at[:-1]
        held = np.r_[same, False][: len(at)] | np.r_[False, same][: len(at)]
        self.last = [at[-1:], who[-1:], shares[-1:], (held | counted)[-1:]]
        now = held & ~counted
        order = np.lexsort((shares[now], who[now]))
        who, shares = who[now][order], shares[now][order]
        first = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (shares[1:] != shares[:-1])][: len(who)])
        return who[first], shares[first], np.diff(np.r_[first, len(who)])


def _read_and_counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What `_read_off` finds, with times 0, and as rows without large: a set, its shares, and how many of its signatures with these are shared."""
    names, shared, rows = ["a", "b", "large", "times"], _Shared(), []

    def passed() -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                who, shares, times = shared.of(b)
                rows.append(pa.RecordBatch.from_arrays([pa.array(who), pa.array(shares), pa.nulls(len(who), pa.bool_()), pa.array(times, pa.int64())], names=names))
            yield b

    for found in _read_off(passed()):
        yield pa.RecordBatch.from_arrays([*found.columns, pa.array(np.zeros(found.num_rows, np.int64))], names=names)
        yield from rows
        rows.clear()
    yield from rows


def _met(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """a, b (short keys), large: the pairs and stars of all buckets. And short: the sets that share as many signatures as similar ones do."""
    dealt = signed.repartition("signature").sortWithinPartitions("signature", "short")
    found = dealt.select("signature", "short", "shares").mapInArrow(_read_and_counted, "a bigint, b bigint, large boolean, times bigint")
    met = stored(found.groupBy("a", "b", "large").agg(F.sum("times").alias("times")).filter("large is not null or times >= b"), "met")
    return met.filter("large is not null").select("a", "b", "large"), met.filter("large is null").select(F.col("a").alias("short")).distinct()


def _sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """id (the key), set and counts of the rows of these ids. The texts move once, by id."""
    texts = docs.join(ids.hint("merge"), "id", "left_semi")

    def run(b: pa.RecordBatch) -> list:
        sets = [s for s in all_shingles(b.column(0).to_pylist(), k) if len(s)]
        return [[_key(s) for s in sets], [s.tobytes() for s in sets], [stars.counts(s) for s in sets]]

    return stored(map_arrow(texts.select("text"), run, "id binary, set binary, counts binary").dropDuplicates(["id"]), "sets")


def similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, k: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id: a row for each document; links are pairs of sets with 100 * |intersection| >= percent * |union|."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    named = _named(docs, k)
    full = named.filter("key is not null and id is not null")
    classes = stored(full.groupBy("key").agg(F.min("id").alias("id"), F.min("short").alias("short"), F.min("n").alias("n"), F.min("counts").alias("counts"), F.count("*").alias("rows")), "classes")
    several = full.groupBy("id").agg(F.min("key").alias("b"), F.max("key").alias("most")).filter("b != most").select("id", "b")
    of_one_id = full.join(several.hint("merge"), "id").filter("key != b").select(F.col("key").alias("a"), "b").distinct()

    met, able = _met(_signed(docs, percent, k))
    able = stored(classes.join(able.hint("merge"), "short", "left_semi"), "able")
    one, other = able.select(F.col("short").alias("a"), F.col("key").alias("ka"), F.col("counts").alias("x")), able.select(F.col("short").alias("b"), F.col("key").alias("kb"), F.col("counts").alias("y"))
    small = met.filter("not large").select("a", "b").join(one.hint("merge"), "a").join(other.hint("merge"), "b")
    near = stored(stars.not_apart(small.select(F.col("ka").alias("a"), F.col("kb").alias("b"), "x", "y"), percent), "near")
    large = met.filter("large").select("a", "b")
    large = large.unionByName(large.select("a", F.col("a").alias("b")).distinct()).join(able.select(F.col("short").alias("b"), "key", "n").hint("merge"), "b")
    large = stored(large.select(F.col("a").alias("bucket"), F.col("key").alias("id"), "n"), "buckets")
    keys = near.select("a").unionByName(near.select(F.col("b").alias("a"))).unionByName(large.select(F.col("id").alias("a"))).distinct()
    sets = _sets(docs, classes.join(keys.withColumnRenamed("a", "key").hint("merge"), "key", "left_semi").select("id"), k)
    links = stored(stars.confirmed(sets, near, percent).unionByName(of_one_id), "links")
    groups = stars.linked(large, sets, links, percent)

    to = stored(classes.join(groups.select(F.col("id").alias("key"), "component").hint("merge"), "key", "left").select("key", "id", "rows", F.coalesce("component", "key").alias("component")), "classes")
    least = to.groupBy("component").agg(F.min("id").alias("component_id"))
    labels = stored(to.join(least.hint("merge"), "component").select("key", "rows", "component_id"), "components")
    return _per_row(named.select("id", "n", "key"), labels).select("doc_id", "n_shingles", "component_id")


def op12(spark, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents"))


#: all shingles of all documents meet, which is right and dear: for small tables
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, least(a, min(b)) AS c FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.a = d.doc_id
"""
