"""Links among the members of buckets, without all pairs: buckets are gathered into stars of few pivots.

Nodes are sets of shingles; a star is a set that is in many buckets (its pivot) and all members of the buckets that are given to it. Every
member meets the pivot, and it alone. What remains are pairs of members that the pivot doesn't connect. Let x be
a member that isn't linked with the pivot p, and y one that x is linked with. If y isn't smaller than p, x and y have
more in common than x and p: they share shingles that p lacks. Smaller ones that could do with what both share with p are compared. So of groups in which some member lies outside of p's
component, all members go to buckets of the shingles that p lacks, and there the same is done. A pair needs m such shingles at
least, which its own size and what it shares with p tell, so all but the last m - 1 of them, in any order that holds for all,
are enough (a prefix filter). The order is by how often a shingle occurs, told from counts in `SLOTS` slots of the hashes, so
what many members share comes last and is mostly left out. Buckets of up to `FEW` members are compared in full, by pairs of different
components.

What is still larger after `LEVELS` steps is taken by all in which a member and the pivot differ, what it lacks of the pivot as
well as what the pivot lacks. Two members x and y have in common what both share with the pivot by size alone, common(x) + common(y) -
n(p), and one more for each shingle in which both differ from it. If x isn't linked with p, a link of x and y needs
one such shingle at least (if y has no more shingles than p, common(y) <= n(y) would else give x as much in common with p as a link takes;
if it has more, common(y) <= n(p) would). How many it needs follows from the sizes and from what both share with p, so two members
meet only where so many still come in both, in the order of how often a star's members differ there, counted exactly. What
most of them differ in comes last.

Copies of a text cost rows in proportion to their number. Texts that are near to a template and mostly not near to each other cost more:
those that differ from it in the same places meet, so their pairs grow with the square of a group, with a small factor.

A hot pivot's set is dealt out to as many salts as its members need; all joins of sets are sort-merge joins. Nothing but
the checksums of `components` reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeboard.llm.common import U, map_arrow, stored
from noticeboard.llm.components import components
from noticeboard.llm.vectors import sums

FEW, LEVELS, LOT, SLOTS = 64, 1, 256, 1 << 16


def shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of x's values y has; both sorted, y not empty."""
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x


def counts(s: np.ndarray) -> bytes:
    """How many of a set's hashes lie in each of so many parts of the domain that some two to four come to a part (no part counts beyond 255: then there is one part)."""
    parts = 1 << min(12, max(3, (len(s) // 4).bit_length()))
    n = np.bincount((s >> U(65 - parts.bit_length())).astype(np.int64), minlength=parts)
    return n.astype(np.uint8).tobytes() if n.max(initial=0) < 256 else b""


def apart(x: bytes, y: bytes, percent: int) -> bool:
    """Whether the counts of two sets differ by more than similar sets can. They differ by no more than the sets do, so no link is lost."""
    if len(x) < len(y):
        x, y = y, x
    if not y:
        return False
    a, b = np.frombuffer(x, np.uint8).reshape(len(y), -1).sum(axis=1, dtype=np.int64), np.frombuffer(y, np.uint8).astype(np.int64)
    return (100 + percent) * int(np.abs(a - b).sum()) > (100 - percent) * int(a.sum() + b.sum())


def not_apart(pairs: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b, counts x, y) those that their counts don't keep apart."""
    kind = pairs.schema["a"].dataType.simpleString()

    def run(b: pa.RecordBatch) -> list:
        return [b.column(0), b.column(1), [not apart(x, y, percent) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]]

    return map_arrow(pairs.select("a", "b", "x", "y"), run, f"a {kind}, b {kind}, near boolean").filter("near").select("a", "b")


def _slot(x: np.ndarray) -> np.ndarray:
    return (x >> U(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def frequencies(sets: DataFrame) -> np.ndarray:
    """How many shingles of all sets lie in each slot."""

    def add(state: np.ndarray, b: pa.RecordBatch) -> None:
        for x in b.column(0):
            state += np.bincount(_slot(np.frombuffer(x.as_buffer(), U)), minlength=SLOTS)

    got = sums(sets, ["set"], lambda: np.zeros(SLOTS), add, exact=False)
    return np.array([got.get(i, 0) for i in range(SLOTS)])


def gathered(buckets: DataFrame) -> DataFrame:
    """pivot, id, n: stars of few pivots, so that all members of a bucket (bucket, id, n) are in one star.

    A bucket's pivot is the one of its members that is in most buckets, to a tenth or so, and of these the smallest. Copies of a text
    so get the copy that is nearest to it, whatever parts of it the others have kept. A pivot that is in the star of a better one
    gives its members to that.
    """
    often = buckets.groupBy("id").agg(F.floor(8 * F.log2(F.count("*"))).alias("often"))
    rows = buckets.join(often.hint("merge"), "id")
    best = rows.groupBy("bucket").agg(F.max(F.struct("often", (-F.col("n")).alias("less"), "id")).alias("best"))
    rows = stored(rows.join(best.hint("merge"), "bucket").select("best", "id", "n").distinct(), "gathered")
    to = rows.groupBy("id").agg(F.max("best").alias("to")).select(F.col("id").alias("pivot"), F.col("to.id").alias("to"))
    rows = rows.select(F.col("best.id").alias("pivot"), "id", "n").join(to.hint("merge"), "pivot")
    return stored(rows.select(F.col("to").alias("pivot"), "id", "n").filter("id != pivot").distinct(), "gathered")


def meet(stars: DataFrame, sets: DataFrame, percent: int, often: np.ndarray | None) -> DataFrame:
    """stars (pivot, id, n) with n_pivot, common (how many shingles both have), linked, and lacks: the shingles that the pivot lacks and that a link beyond it needs (of groups of several members only).

    Without often, lacks has all shingles that one of both lacks.
    """
    kind = sets.schema["id"].dataType.simpleString()
    sizes = stored(stars.groupBy("pivot").agg(F.count("*").alias("size"), F.min("n").alias("least")), "sizes")
    lot = F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / LOT)).alias("lot")
    rows = stars.join(sizes.hint("merge"), "pivot").select("pivot", "id", lot, F.when(F.col("size") > 1, F.col("least")).alias("least"))
    rows = rows.join(sets.select("id", F.col("set").alias("x")).hint("merge"), "id")
    held = sizes.join(sets.select(F.col("id").alias("pivot"), F.col("set").alias("y")).hint("merge"), "pivot")
    held = held.select("pivot", "y", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("size") / LOT) - 1)).alias("lot"))
    both = rows.join(held.hint("merge"), ["pivot", "lot"]).select("pivot", "id", "least", "x", "y")

    def run(b: pa.RecordBatch) -> list:
        n, of_pivot, shares, linked, lacks = [], [], [], [], []
        for x, y, least in zip(b.column(3), b.column(4), b.column(2).to_pylist(), strict=True):
            x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
            has = shared(x, y)
            common = int(has.sum())
            n.append(len(x))
            of_pivot.append(len(y))
            shares.append(common)
            linked.append(100 * common >= percent * (len(x) + len(y) - common))
            if least is not None and often is None:
                lacks.append(np.r_[x[~has], y[~shared(y, x)]].view(np.int64))
            elif least is not None:
                beyond = x[~has]
                smallest_other = max(least, -(-percent * len(x) // 100))
                needed = max(1, -(-percent * (len(x) + smallest_other) // (100 + percent)) - common)  # with whomever it is linked
                order = np.lexsort((beyond, often[_slot(beyond)]))
                lacks.append(beyond[order[: max(0, len(beyond) - needed + 1)]].view(np.int64))
            else:
                lacks.append(None)
        return [*b.columns[:2], n, of_pivot, shares, linked, lacks]

    return stored(map_arrow(both, run, f"pivot {kind}, id {kind}, n bigint, n_pivot bigint, common bigint, linked boolean, lacks array<bigint>"), "met")


def confirmed(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those whose sets have 100 * |intersection| >= percent * |union|."""
    kind = sets.schema["id"].dataType.simpleString()
    x, y = sets.select(F.col("id").alias("a"), F.col("set").alias("x")), sets.select(F.col("id").alias("b"), F.col("set").alias("y"))
    both = pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b").select("a", "b", "x", "y")

    def check(b: pa.RecordBatch) -> list:
        ok = []
        for x, y in zip(b.column(2), b.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
            common = int(shared(x, y).sum())
            ok.append(100 * common >= percent * (len(x) + len(y) - common))
        return [b.column(0), b.column(1), ok]

    return map_arrow(both, check, f"a {kind}, b {kind}, ok boolean").filter("ok").select("a", "b").distinct()


def _labelled(met: DataFrame, groups: DataFrame) -> DataFrame:
    """pivot, id, n, n_pivot, common, label, apart (from the pivot's component): the stars whose members and pivot aren't all of one component; others can't hold a link of two."""
    label = lambda name, to: groups.select(F.col("id").alias(name), F.col("component").alias(to)).hint("merge")
    met = met.filter("lacks is not null").select("pivot", "id", "n", "n_pivot", "common").join(label("id", "label"), "id", "left").join(label("pivot", "main"), "pivot", "left")
    met = stored(met.withColumn("label", F.coalesce("label", "id")).withColumn("apart", F.col("label") != F.coalesce("main", "pivot")).drop("main"), "labelled")
    some = met.groupBy("pivot").agg(F.max("apart").alias("some")).filter("some").select("pivot")
    return met.join(some.hint("merge"), "pivot", "left_semi")


def _beyond_pivots(met: DataFrame, labelled: DataFrame) -> DataFrame:
    """bucket, size, id, n, label, apart: the buckets of the shingles that pivots lack, where they may hold a link of two components."""
    at = met.select("pivot", "id", "lacks").join(labelled.select("pivot", "id", "n", "label", "apart").hint("merge"), ["pivot", "id"])
    at = at.select("pivot", "id", "n", "label", "apart", F.explode("lacks").alias("shingle"))
    name = F.xxhash64("label")
    sizes = at.groupBy("pivot", "shingle").agg(F.count("*").alias("size"), F.max("apart").alias("any"), F.min(name).alias("one"), F.max(name).alias("other"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("who")).filter("any and one != other")
    alike = sizes.groupBy("pivot", "size", "who").agg(F.min("shingle").alias("shingle")).select("pivot", "shingle", "size")
    return stored(at.join(alike.hint("merge"), ["pivot", "shingle"]).select(F.xxhash64("pivot", "shingle").alias("bucket"), "size", "id", "n", "label", "apart"), "beyond")


def _of_smaller(labelled: DataFrame, percent: int) -> DataFrame:
    """a, b (a < b): what may be linked by the pivot's own shingles alone: members apart, and members smaller than the pivot of other components."""
    enough = lambda common, n: f"(100 + {percent}) * {common} >= {percent} * (n + {n})"
    least = labelled.groupBy("pivot").agg(F.min("n").alias("least"))
    x = labelled.filter("apart").join(least.hint("merge"), "pivot").filter(f"least < n_pivot and {enough('common', 'least')}").select("pivot", "id", "n", "common", "label")
    y = labelled.filter("n < n_pivot").select("pivot", *[F.col(c).alias(f"{c}_b") for c in ("id", "n", "common", "label")])
    pairs = x.join(y.hint("merge"), "pivot").filter(f"label != label_b and 100 * least(n, n_b) >= {percent} * greatest(n, n_b) and {enough('least(common, common_b)', 'n_b')}")
    return pairs.select(F.least("id", "id_b").alias("a"), F.greatest("id", "id_b").alias("b"))


def _pairs(buckets: DataFrame, percent: int) -> DataFrame:
    """a, b (a < b): pairs within buckets that may be linked, are of different components, and of which one is apart."""
    other = buckets.select("bucket", *[F.col(c).alias(f"{c}_b") for c in ("id", "n", "label", "apart")])
    pairs = buckets.join(other.hint("merge"), "bucket").filter(f"id < id_b and label != label_b and (apart or apart_b) and 100 * least(n, n_b) >= {percent} * greatest(n, n_b)")
    return pairs.select(F.col("id").alias("a"), F.col("id_b").alias("b"))


def _differing(met: DataFrame, labelled: DataFrame, percent: int) -> DataFrame:
    """a, b (a < b): pairs of a star that differ from the pivot (by lacks, whole) in as many of the same shingles as a link may need, are of different components, and of which one is apart."""
    most = labelled.groupBy("pivot").agg(F.min("n").alias("least"), F.max("common").alias("most"), F.max(F.when(F.col("apart"), F.col("common"))).alias("most_apart"))
    labelled = labelled.join(most.hint("merge"), "pivot").withColumn("most", F.when(F.col("apart"), F.col("most")).otherwise(F.col("most_apart")))  # what its other one has in common with the pivot, at most
    at = met.select("pivot", "id", "lacks").join(labelled.hint("merge"), ["pivot", "id"]).withColumn("shingle", F.explode("lacks"))
    name = F.xxhash64("label")
    sizes = at.groupBy("pivot", "shingle").agg(F.count("*").alias("size"), F.max("apart").alias("any"), F.min(name).alias("one"), F.max(name).alias("other")).filter("any and one != other")
    at = at.join(sizes.select("pivot", "shingle", "size").hint("merge"), ["pivot", "shingle"])
    rest = F.row_number().over(Window.partitionBy("pivot", "id").orderBy(F.desc("size"), "shingle"))  # itself and what comes after it
    enough = lambda rest, common, n: f"(100 + {percent}) * ({rest} + common + {common} - n_pivot) >= {percent} * (n + {n})"
    at = at.withColumn("rest", rest).filter(enough("rest", "most", f"greatest(least, {percent} * n / 100)"))
    at = stored(at.select("pivot", "shingle", "rest", "id", "n", "n_pivot", "common", "label", "apart"), "differing")
    other = at.select("pivot", "shingle", *[F.col(c).alias(f"{c}_b") for c in ("rest", "id", "n", "common", "label", "apart")])
    pairs = at.join(other.hint("merge"), ["pivot", "shingle"]).filter(f"id < id_b and label != label_b and (apart or apart_b) and 100 * least(n, n_b) >= {percent} * greatest(n, n_b)")
    return pairs.filter(enough("least(rest, rest_b)", "common_b", "n_b")).select(F.col("id").alias("a"), F.col("id_b").alias("b"))


def linked(buckets: DataFrame, sets: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """The components (id, component) of links (a, b) and of all links among the members of buckets (bucket, id, n).

    sets: id, set (sorted 64-bit hashes as bytes, not empty), counts.
    """
    often = None
    for level in range(LEVELS + 1):
        stars = gathered(buckets)
        if stars.isEmpty():
            return components(links)
        often = frequencies(sets) if often is None else often
        met = meet(stars, sets, percent, often if level < LEVELS else None)
        links = links.unionByName(met.filter("linked").select(F.col("id").alias("a"), F.col("pivot").alias("b")))
        groups = stored(components(links), "labels")
        labelled = _labelled(met, groups)
        if labelled.isEmpty():
            return groups
        if level < LEVELS:
            beyond = _beyond_pivots(met, labelled)
            pairs = _pairs(beyond.filter(f"size <= {FEW}"), percent).unionByName(_of_smaller(labelled, percent)).distinct()
        else:
            pairs = _differing(met, labelled, percent).distinct()
        x, y = sets.select(F.col("id").alias("a"), F.col("counts").alias("x")), sets.select(F.col("id").alias("b"), F.col("counts").alias("y"))
        pairs = stored(not_apart(pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b"), percent), "pairs")
        if level < LEVELS:
            buckets = beyond.filter(f"size > {FEW}").select("bucket", "id", "n")
            ids = buckets.select("id").unionByName(pairs.select(F.col("a").alias("id"))).unionByName(pairs.select(F.col("b").alias("id")))
            sets = stored(sets.join(ids.distinct().hint("merge"), "id", "left_semi"), "sets")  # all that is looked at from here on
        links = links.unionByName(stored(confirmed(sets, pairs, percent), "links"))
        if level == LEVELS:
            return components(links)
    raise AssertionError
