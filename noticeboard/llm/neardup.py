"""Near-duplicates by b-bit MinHash, confirmed on full shingle sets.

Of a document's set of word shingles the minima under `SLOTS` hash functions are taken. Bands of whole minima give
candidates; of all minima only the low `BITS` bits are kept, packed into longs, and a candidate pair's similarity is
estimated from the count of equal ones, corrected for chance equality. Pairs whose estimate is not `SIGMAS` standard
deviations under the threshold are confirmed on full sets. Documents with equal sets are one class from the start.

Large groups. A bucket of up to `SMALL` classes is compared in full. In a larger one, every class is compared, by full
sets, with one pivot only: a class close to the majority of a sample's packed minima (which class it is matters for
speed, not for the result); buckets of one pivot count as one. Let x be a class that the pivot p isn't linked with. If
x is linked with a class y of at least p's size, then x and y share shingles that p lacks: |x & y| is at most |x & p|
and these, and |x & p| is too little. So only classes outside of the pivot's component, and the sharers of their
shingles that p lacks, are looked at again. As x and y must share m such shingles at least, it is enough to look at all
but the last m - 1 of them in the order of their hashes (a prefix filter). Each such shingle makes a smaller bucket, to which
the same is done (up to `FEW` times SMALL classes are compared in full there). A class y smaller than p is compared with those x whose |x & p| would be enough for it. So no link
that a bucket shows is lost, while neither a group of copies nor a group of texts that are near to a template, but not
to each other, costs all its pairs. What is still large after `LEVELS` such steps is compared in full.

Scale. Texts are read twice; the second time they move once, by id, to meet the ids of candidates, and only the
candidates' sets go further. All joins with sides that grow with the data are sort-merge joins, so the plan is the
same at every size. Only the classes with more than a thousandth of all rows (a thousand at most) are broadcast, so
that a group of equal texts is no hot key when each row gets its component.

Defined cases: texts without words have an empty set and are linked with nothing; texts of fewer words than a shingle
have one; rows of one id are linked with each other, and each has the size of its own set; a row with a null id is
linked with nothing and kept, its component null; a very long text is read whole, in one task; other columns play no
part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeboard.llm.common import U, free_name, grams, map_arrow, stored, table, word_hashes
from noticeboard.llm.components import components

SHINGLE, SLOTS, BITS, ROWS, BANDS, SMALL, SIGMAS, SAMPLE, HOT, LEVELS, SALTS, FEW = 5, 256, 4, 5, 24, 64, 4.0, 64, 1000, 8, 16, 4
LONGS = SLOTS * BITS // 64
_RNG = np.random.default_rng(20240501)
_A = (_RNG.integers(0, 2**32, SLOTS, dtype=np.uint32) | np.uint32(1)).astype(np.uint32)
_B = _RNG.integers(0, 2**32, SLOTS, dtype=np.uint32)
_BLOCK = 1 << 16


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    return _set(word_hashes([text])[0], k)


def _set(words: np.ndarray, k: int) -> np.ndarray:
    return np.unique(grams(words, min(k, len(words)))) if len(words) else words


def all_shingles(texts: list[str | None], k: int = SHINGLE) -> list[np.ndarray]:
    """`shingles` of each text; 64 texts are read at a time."""
    out: list[np.ndarray] = []
    for i in range(0, len(texts), 64):
        h, ends = word_hashes(texts[i : i + 64])
        out += [_set(words, k) for words in np.split(h, ends[:-1])]
    return out


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, SLOTS) least hashes; sets must not be empty."""
    out = np.empty((len(sets), SLOTS), np.uint32)
    i = 0
    while i < len(sets):
        j, size = i, 0
        while j < len(sets) and (j == i or size + len(sets[j]) <= _BLOCK):
            size += len(sets[j])
            j += 1
        x = (np.concatenate(sets[i:j]) >> U(32)).astype(np.uint32)
        starts = np.r_[0, np.cumsum([len(s) for s in sets[i : j - 1]])].astype(np.int64) if j > i + 1 else np.zeros(1, np.int64)
        h = np.empty_like(x)
        for s in range(SLOTS):
            np.multiply(x, _A[s], out=h)
            np.add(h, _B[s], out=h)
            out[i:j, s] = np.minimum.reduceat(h, starts)
        i = j
    return out


def _packed(m: np.ndarray) -> np.ndarray:
    """The low BITS bits of each minimum, in LONGS 64-bit numbers."""
    low = (m & np.uint32(2**BITS - 1)).astype(U).reshape(len(m), LONGS, 64 // BITS)
    return np.bitwise_or.reduce(low << (np.arange(64 // BITS, dtype=U) * U(BITS)), axis=2)


def _bands(m: np.ndarray) -> np.ndarray:
    h = np.zeros((len(m), BANDS), U)
    for r in range(ROWS):
        h = (h ^ m[:, r : ROWS * BANDS : ROWS]) * U(0x9E3779B97F4A7C15)
        h ^= h >> U(29)
    return h * U(0xBF58476D1CE4E5B9) + np.arange(BANDS, dtype=U)


def _signatures(k: int):
    def run(b: pa.RecordBatch) -> list:
        sets = all_shingles(b.column(1).to_pylist(), k)
        full = [i for i, s in enumerate(sets) if len(s)]
        m = minima([sets[i] for i in full]) if full else np.zeros((0, SLOTS), np.uint32)
        key, packed, bands = [None] * len(sets), [None] * len(sets), [None] * len(sets)
        p, w = _packed(m).view(np.int64), _bands(m).view(np.int64)
        for j, i in enumerate(full):
            key[i], packed[i], bands[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), p[j], w[j]
        return [b.column(0), [len(s) for s in sets], key, packed, bands]

    return run


def unequal(a: str, b: str) -> Column:
    """How many of two columns' packed minima differ."""
    ones = F.lit(0x1111111111111111)
    out = F.lit(0)
    for i in range(LONGS):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        any_bit = x.bitwiseOR(F.shiftright(x, 1)).bitwiseOR(F.shiftright(x, 2)).bitwiseOR(F.shiftright(x, 3))
        out = out + F.bit_count(any_bit.bitwiseAND(ones))
    return out


def similarity(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of two columns of packed minima: share of equal ones, corrected for chance."""
    chance = 2.0**-BITS
    return ((1 - unequal(a, b) / SLOTS) - chance) / (1 - chance)


def least_estimate(threshold: float) -> float:
    """What pairs of the threshold's similarity fall under only beyond SIGMAS standard deviations."""
    chance = 2.0**-BITS
    p = chance + (1 - chance) * threshold
    return threshold - SIGMAS * (p * (1 - p) / SLOTS) ** 0.5 / (1 - chance)


def _majority(pdf):
    """Of the sampled members of one bucket: each slot's most frequent value."""
    import pandas as pd

    x = np.array(pdf["sig"].tolist(), np.int64).view(U)
    out = np.zeros(LONGS, U)
    for s in range(SLOTS):
        v = (x[:, s // (64 // BITS)] >> U(s % (64 // BITS) * BITS)) & U(2**BITS - 1)
        out[s // (64 // BITS)] |= U(np.bincount(v.astype(np.int64)).argmax()) << U(s % (64 // BITS) * BITS)
    return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "mode": [out.view(np.int64).tolist()]})


def _sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """id, set: the distinct shingle sets of the rows of these ids. The texts move once, by id."""
    texts = docs.join(ids.distinct().hint("merge"), "id", "left_semi")
    made = map_arrow(texts.select("id", "text"), lambda b: [b.column(0), [x.tobytes() for x in all_shingles(b.column(1).to_pylist(), k)]], f"id {docs.schema['id'].dataType.simpleString()}, set binary")
    return stored(made.filter("length(set) > 0").distinct(), "sets")


def _confirmed(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those of which two sets have 100 * |intersection| >= percent * |union|."""
    kind = sets.schema["id"].dataType.simpleString()
    x, y = sets.select(F.col("id").alias("a"), F.col("set").alias("x")), sets.select(F.col("id").alias("b"), F.col("set").alias("y"))
    both = pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b").select("a", "b", "x", "y")

    def check(b: pa.RecordBatch) -> list:
        ok = []
        for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, U), np.frombuffer(y, U)
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(100 * both >= percent * (len(x) + len(y) - both))
        return [b.column(0), b.column(1), ok]

    return map_arrow(both, check, f"a {kind}, b {kind}, ok boolean").filter("ok").select("a", "b").distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, k: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each document."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    sig = stored(map_arrow(docs, _signatures(k), f"id {kind}, n bigint, key binary, sig array<bigint>, bands array<bigint>"), "signatures")
    full = sig.filter("key is not null and id is not null")
    classes = stored(full.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("rows")), "classes")
    reps = stored(full.join(classes.select("key", "id").hint("merge"), ["key", "id"]).dropDuplicates(["key", "id"]).select("id", "sig", "bands"), "representatives")
    several = full.groupBy("id").agg(F.min("key").alias("least"), F.max("key").alias("most")).filter("least != most").select("id")
    of_one_id = full.select("id", "key").join(several.hint("merge"), "id").join(classes.select("key", F.col("id").alias("b")).hint("merge"), "key").select(F.col("id").alias("a"), "b").filter("a != b").distinct()

    at = reps.select("id", F.explode("bands").alias("bucket"))
    sizes = at.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    shared = at.join(sizes.hint("merge"), "bucket")
    members = stored(shared.join(reps.select("id", "sig").hint("merge"), "id").select("bucket", "size", "id", "sig"), "members")
    near = stored(_close(members.filter(f"size <= {SMALL}"), percent), "pairs")
    large = members.filter(f"size > {SMALL}")
    sets = _sets(docs, near.select(F.col("a").alias("id")).unionByName(near.select(F.col("b").alias("id"))).unionByName(large.select("id")), k)
    links = stored(_confirmed(sets, near, percent).unionByName(of_one_id), "links")
    groups = _through_pivots(large.withColumn("apart", F.lit(True)), sets, links, percent)

    named = stored(classes.join(groups.hint("merge"), "id", "left").select("key", "rows", F.coalesce("component", "id").alias("component_id")), "components")
    return _per_row(sig.select("id", "n", "key"), named)


def _per_row(rows: DataFrame, named: DataFrame) -> DataFrame:
    """Each row with its class's component. Classes of over 1/HOT of all rows, HOT at most, are broadcast."""
    share = rows.count() / HOT
    hot = F.broadcast(named.filter(F.col("rows") > share).select("key", "component_id"))
    alone = "key is null or id is null"
    parts = [
        rows.filter(alone).withColumn("component_id", F.col("id")),
        rows.filter(f"not ({alone})").join(hot, "key").select("id", "n", "key", "component_id"),
        rows.filter(f"not ({alone})").join(hot, "key", "left_anti").join(named.filter(F.col("rows") <= share).select("key", "component_id").hint("merge"), "key").select("id", "n", "key", "component_id"),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _close(members: DataFrame, percent: int, also: str = "true") -> DataFrame:
    """a, b (a < b): pairs within each bucket of members (bucket, id, sig, ...) whose estimate isn't far under the threshold and for which `also` holds (the second one's columns end in _b)."""
    members = members.drop("size")
    other = members.select([F.col(c).alias(c if c == "bucket" else f"{c}_b") for c in members.columns])
    pairs = members.join(other.hint("merge"), "bucket").filter(F.col("id") < F.col("id_b")).filter(also).filter(similarity("sig", "sig_b") >= least_estimate(percent / 100))
    return pairs.select(F.col("id").alias("a"), F.col("id_b").alias("b")).distinct()


def _pivots(large: DataFrame) -> DataFrame:
    """bucket, pivot: of each bucket a class among those apart that is close to the majority of a sample of them."""
    large = large.filter("apart")
    sampled = large.filter(F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / SAMPLE)) == 0).select("bucket", "sig")
    modes = sampled.groupBy("bucket").applyInPandas(_majority, "bucket bigint, mode array<bigint>")
    closest = F.struct(F.coalesce(similarity("sig", "mode"), F.lit(0.0)).alias("s"), "id")
    scored = large.join(modes, "bucket", "left").select("bucket", F.pmod(F.xxhash64("id"), F.lit(64)).alias("part"), closest.alias("by"))
    return scored.groupBy("bucket", "part").agg(F.max("by").alias("by")).groupBy("bucket").agg(F.max("by").alias("by")).select("bucket", F.col("by.id").alias("pivot"))


def _with_pivots(large: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Each class of large with each pivot of its buckets: bucket (the pivot's), n, n_pivot, common (sizes of the sets and of what they share), linked, lacks (the shingles that the pivot lacks)."""
    kind = sets.schema["id"].dataType.simpleString()
    pivots = stored(_pivots(large), "pivots")
    rows = large.select("bucket", "id", "sig").join(pivots, "bucket").select(F.xxhash64("pivot").alias("bucket"), "pivot", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"), "id", "sig").dropDuplicates(["bucket", "id"])
    held = sets.select(F.col("id").alias("pivot"), F.col("set").alias("y")).join(pivots.select("pivot").distinct(), "pivot", "left_semi")
    held = held.select("pivot", "y", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt"))  # a pivot has SMALL classes at least, so this is little
    both = rows.join(sets.select("id", F.col("set").alias("x")).hint("merge"), "id").join(held, ["pivot", "salt"]).select("bucket", "id", "pivot", "sig", "x", "y")

    def meet(b: pa.RecordBatch) -> list:
        n, m, common, linked, lacks = [], [], [], [], []
        for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True):
            x, y = np.frombuffer(x, U), np.frombuffer(y, U)
            has = y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x
            n.append(len(x))
            m.append(len(y))
            common.append(int(has.sum()))
            linked.append(100 * common[-1] >= percent * (len(x) + len(y) - common[-1]))
            lacks.append(x[~has].view(np.int64))
        return [*b.columns[:4], n, m, common, linked, lacks]

    return stored(map_arrow(both, meet, f"bucket bigint, id {kind}, pivot {kind}, sig array<bigint>, n bigint, n_pivot bigint, common bigint, linked boolean, lacks array<bigint>"), "met")


def _of_smaller(met: DataFrame, percent: int) -> DataFrame:
    """a, b (a < b): what may be linked within the pivot's own shingles: classes apart, and smaller ones than the pivot of other components."""
    x = met.filter("apart").filter(f"least_n < n_pivot and (100 + {percent}) * common >= {percent} * (n + least_n)")
    y = met.filter("n < n_pivot").select("bucket", *[F.col(c).alias(f"{c}_b") for c in ("id", "sig", "n", "common", "label")])
    pairs = x.join(y.hint("merge"), "bucket").filter(f"label != label_b and (100 + {percent}) * least(common, common_b) >= {percent} * (n + n_b)").filter(similarity("sig", "sig_b") >= least_estimate(percent / 100))
    return pairs.select(F.least("id", "id_b").alias("a"), F.greatest("id", "id_b").alias("b")).distinct()


def _through_pivots(large: DataFrame, sets: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """The components of links and those of large buckets (bucket, size, id, sig, apart).

    Components are computed after the first step and at the end; in between, what is linked with a pivot has its label.
    """
    groups = None
    for level in range(LEVELS):
        if large.isEmpty():
            break
        met = _with_pivots(large, sets, percent)
        links = links.unionByName(met.filter("linked and id != pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")))
        if groups is None:
            groups = stored(components(links), "labels")
        label = lambda name, to: groups.select(F.col("id").alias(name), F.col("component").alias(to))  # noqa: B023, E731
        least_n = met.groupBy("bucket").agg(F.min("n").alias("least_n"))
        met = met.join(label("id", "label"), "id", "left").join(label("pivot", "main"), "pivot", "left").join(least_n, "bucket").withColumn("main", F.coalesce("main", "pivot"))
        met = met.withColumn("label", F.when(F.col("linked"), F.col("main")).otherwise(F.coalesce("label", "id"))).withColumn("apart", F.col("label") != F.col("main"))
        smaller = _of_smaller(met.select("bucket", "id", "sig", "n", "n_pivot", "least_n", "common", "label", "apart"), percent)
        shares = F.greatest(F.lit(1), F.expr(f"cast(({percent} * (n + least_n) + {99 + percent}) div {100 + percent} - common as int)"))  # with whomever it is linked
        at = met.select("bucket", "id", "sig", "label", "apart", F.explode(F.slice("lacks", F.lit(1), F.greatest(F.size("lacks") - shares + 1, F.lit(0)))).alias("shingle"))
        sizes = at.groupBy("bucket", "shingle").agg(F.count("*").alias("size"), F.max("apart").alias("any"), F.min("label").alias("one"), F.max("label").alias("other"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("who")).filter("any and one != other")
        alike = sizes.groupBy("bucket", "size", "who").agg(F.min("shingle").alias("shingle")).select("bucket", "shingle", "size")
        again = stored(at.join(alike, ["bucket", "shingle"]).select(F.xxhash64("bucket", "shingle").alias("bucket"), "size", "id", "sig", "apart", "label"), "again")
        small = again if level == LEVELS - 1 else again.filter(f"size <= {FEW * SMALL}")
        pairs = stored(_close(small, percent, "label != label_b and (apart or apart_b)").unionByName(smaller).distinct(), "pairs")
        if not pairs.isEmpty():
            links = links.unionByName(stored(_confirmed(sets, pairs, percent), "links"))
        large = again.filter(f"size > {FEW * SMALL}").drop("label")
        if level == 0 and pairs.isEmpty() and large.isEmpty():
            return groups
    return components(links)


def op3(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """docs without the rows that near-duplicate grouping does not keep; their columns are as they were. Of rows of one id all stay or all go."""
    key = free_name(docs, "gone")
    gone = stored(near_duplicates(docs, id_col=id_col, text_col=text_col, percent=percent).filter("not kept").select(F.col("doc_id").alias(key)).distinct(), "gone")
    return docs.join(gone.hint("merge"), docs[id_col] == gone[key], "left_anti")


#: all shingles of all documents meet, which is right and dear: for small tables
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, least(a, min(b)) AS c FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id, coalesce(m.c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.a = d.doc_id
"""
