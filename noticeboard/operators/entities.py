"""Duplicates: edges by keys, components, primary election, marks, incremental refresh.

Every rule is an equality of keys (never all pairs). Rules that are equivalences link each row to the least id of its
key, so a key of n rows gives n - 1 edges; the rule that allows a day's distance links neighbours in date order, which
has the same components. A component's reason is the best one of its edges, and each pair's label is the best rule
that holds for it, so edges can come from each rule on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from noticeboard.functions.text import fingerprint, folded_title, key_url
from noticeboard.plans.profile import RuleProfile
from noticeboard.schema import DUPLICATE_REASONS
from noticeboard.sources.tables import discard, stored


def keyed(posts: DataFrame, profile: RuleProfile | None = None, full_fold: bool = True) -> DataFrame:
    """The keys that rules compare; blank ones are null and join nothing."""
    title = F.nullif(folded_title(F.col("title"), full_fold), F.lit(""))
    return posts.select("id", "source_id", key_url(F.col("canonical_url")).alias("canonical"), key_url(F.col("original_url")).alias("original"), title.alias("title_key"), F.to_date("publish_date").alias("day"), F.nullif(fingerprint(F.col("content"), profile), F.lit("")).alias("print"))


def edges(keys: DataFrame) -> DataFrame:
    """A, b (b < a), priority of the rule. The keys are computed once and written; they are narrow.

    Within a day's rule, a day's rows of one print link to the day's least id, and that one to the least id of the
    nearest day before, if that is a day off: the same components as all pairs of the rule, with one aggregated row a day.
    """
    keys = stored(keys, "keys")

    def star(rule: int, *cols: str) -> DataFrame:
        own = keys.dropna(subset=list(cols)).select("id", "source_id", *cols)
        least = own.groupBy("source_id", *cols).agg(F.min("id").alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n")
        return own.join(least, ["source_id", *cols]).filter("id <> b").select(F.col("id").alias("a"), "b", F.lit(rule).alias("priority"))

    key = ["source_id", "title_key", "print"]
    days = keys.dropna(subset=["title_key", "day", "print"]).groupBy(*key, "day").agg(F.min("id").alias("first"))
    w = Window.partitionBy(*key).orderBy("day")
    near = days.select("day", "first", F.lag("first").over(w).alias("before"), F.lag("day").over(w).alias("before_day"))
    near = near.filter("before is not null and datediff(day, before_day) <= 1").select(F.greatest("first", "before").alias("a"), F.least("first", "before").alias("b"), F.lit(3).alias("priority"))
    return star(0, "canonical").unionByName(star(1, "original")).unionByName(star(2, "title_key", "day")).unionByName(near)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Id, root (least id) for all ids in links (a, b). Large-star and small-star until nothing moves.

    Each round's links are a table; their number and checksum come along with the writing, and the round before is deleted.
    """
    e, last = _observed(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        top = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(top, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b")
        before = e
        e, now = _observed(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        discard(before)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def _observed(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The links as a table, with their number and checksum."""
    seen = Observation()
    sums = F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")
    out = stored(edges.observe(seen, *sums), "edges")
    return out, (seen.get["n"], seen.get["sum"])


def completeness(*values: Column) -> Column:
    """Over the named attributes of a child: 1 and one for each that is there (the caller gives null for no child)."""
    total = F.lit(1)
    for v in values:
        total = total + F.coalesce((v != "").cast("int"), F.lit(0))
    return total


def rank() -> Column:
    """The order in which the least is the primary, as one value, so that an aggregate needs no sort of a group. Columns: has_content, n_attachments, n_fields, n_jobs, analysis_score, insight_score, created_at, id."""
    down = [(-F.col(c).cast("bigint")).alias(c) for c in ("n_attachments", "n_fields", "n_jobs", "analysis_score", "insight_score")]
    return F.struct((~F.col("has_content")).alias("has_content"), *down, F.col("created_at").isNull().alias("undated"), "created_at", "id")


def groups(links: DataFrame, members: DataFrame) -> DataFrame:
    """Id, source_id, primary_id, group_key, reason for all rows of groups. members: ids with rank's columns."""
    roots = components(links)
    best = links.join(roots, links["a"] == roots["id"]).groupBy("root").agg(F.min("priority").alias("priority"))
    names = F.array(*map(F.lit, DUPLICATE_REASONS))
    m = members.join(roots, "id")
    elected = m.groupBy("root").agg(F.min_by("id", rank()).alias("primary_id"))
    out = m.select("id", "source_id", "root").join(elected, "root").join(best, "root")
    return out.select("id", "source_id", "primary_id", F.concat_ws(":", F.lit("duplicate"), F.col("source_id").cast("string"), F.col("primary_id").cast("string")).alias("group_key"), F.coalesce(F.get(names, F.col("priority")), F.lit("unknown")).alias("reason"))


def marked(posts: DataFrame, found: DataFrame, checked_at: Column, touched: DataFrame | None = None) -> DataFrame:
    """Posts with their marks. Members of groups get theirs; of the others, those touched (or all) are reset."""
    g = found.select(F.col("id").alias("_id"), F.col("primary_id").alias("_primary"), F.col("group_key").alias("_key"), F.col("reason").alias("_reason"))
    df = posts.join(g, posts["id"] == g["_id"], "left")
    if touched is None:
        hit = F.lit(True)
    else:
        t = touched.select(F.col("id").alias("_t")).distinct()
        df = df.join(t, posts["id"] == t["_t"], "left")
        hit = F.col("_t").isNotNull() | F.col("_id").isNotNull()
    new = {
        "duplicate_status": F.when(F.col("_id").isNull(), "none").when(F.col("_id") == F.col("_primary"), "primary").otherwise("duplicate"),
        "primary_post_id": F.when(F.col("_id") != F.col("_primary"), F.col("_primary")),
        "duplicate_group_key": F.col("_key"),
        "duplicate_reason": F.col("_reason"),
        "duplicate_checked_at": checked_at,
    }
    return df.select([F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else posts[c] for c in posts.columns])


def members_of(posts: DataFrame, attachments: DataFrame, fields: DataFrame, jobs: DataFrame, analyses: DataFrame, insights: DataFrame) -> DataFrame:
    """rank's columns: one aggregate per child."""
    count = lambda df, name: df.groupBy(F.col("post_id").alias("id")).agg(F.count("*").alias(name))
    a = analyses.select(F.col("post_id").alias("id"), completeness(*[F.col(c) for c in ("summary", "event_type", "recruitment_stage", "tracking_priority", "school_name", "city")]).alias("analysis_score"))
    i = insights.select(F.col("post_id").alias("id"), completeness(*[F.col(c) for c in ("insight_status", "degree_floor", "deadline_status", "evidence_summary")]).alias("insight_score"))
    df = posts.select("id", "source_id", "created_at", F.coalesce(~F.coalesce("content", F.lit("")).rlike(r"(?U)^\s*$"), F.lit(False)).alias("has_content"))
    for child in (count(attachments, "n_attachments"), count(fields, "n_fields"), count(jobs, "n_jobs"), a, i):
        df = df.join(child, "id", "left")
    return df.fillna(0, subset=["n_attachments", "n_fields", "n_jobs", "analysis_score", "insight_score"])


def candidates(posts: DataFrame, touched: DataFrame) -> DataFrame:
    """Rows that may belong to a group with touched ones: of their sources (rules never cross sources), or of their old groups."""
    t = posts.join(touched.select(F.col("id").alias("_t")).distinct(), posts["id"] == F.col("_t"), "left_semi")
    sources = t.select(F.col("source_id").alias("_s")).distinct()
    keys = t.filter("duplicate_group_key is not null").select(F.col("duplicate_group_key").alias("_k")).distinct()
    by_source = posts.join(sources, posts["source_id"] == sources["_s"], "left_semi")
    by_key = posts.join(keys, posts["duplicate_group_key"] == keys["_k"], "left_semi")
    return by_source.unionByName(by_key).dropDuplicates(["id"])


def refreshed(posts: DataFrame, touched: DataFrame, members: DataFrame, checked_at: Column, profile: RuleProfile | None = None, full_fold: bool = True) -> DataFrame:
    """Posts with marks as if all were recomputed for the groups of touched rows."""
    old = candidates(posts, touched)
    links = edges(keyed(old, profile, full_fold))
    found = groups(links, members)
    t = touched.select(F.col("id").alias("_t")).distinct()
    keep = found.join(t, found["id"] == t["_t"], "left_semi").select("group_key").distinct()
    found = stored(found.join(keep, "group_key", "left_semi"), "groups")
    involved = touched.select("id").unionByName(found.select("id"))
    old_keys = posts.join(involved.distinct().withColumnRenamed("id", "_i"), posts["id"] == F.col("_i"), "left_semi").filter("duplicate_group_key is not null").select(F.col("duplicate_group_key").alias("_k")).distinct()
    former = posts.join(old_keys, posts["duplicate_group_key"] == old_keys["_k"], "left_semi").select("id")
    return marked(posts, found, checked_at, involved.unionByName(former))


def unchecked(posts: DataFrame, limit: int) -> DataFrame:
    """The newest rows that were never checked."""
    return posts.filter("duplicate_checked_at is null").orderBy(F.col("publish_date").desc_nulls_last(), F.col("id").desc()).limit(limit)


def recent(posts: DataFrame, limit: int) -> DataFrame:
    """The newest rows, checked or not."""
    return posts.orderBy(F.col("publish_date").desc_nulls_last(), F.col("id").desc()).limit(limit)


def rebuilt(posts: DataFrame, members: DataFrame, checked_at: Column, limit: int | None = None, profile: RuleProfile | None = None, full_fold: bool = True) -> DataFrame:
    """The marks of all rows, or of the newest `limit`, made anew among these alone; other rows keep theirs."""
    chosen = posts if limit is None else stored(recent(posts, limit), "chosen")
    found = stored(groups(stored(edges(keyed(chosen, profile, full_fold)), "links"), members), "groups")
    return marked(posts, found, checked_at, None if limit is None else chosen.select("id"))


def backfilled(posts: DataFrame, members: DataFrame, checked_at: Column, limit: int, *, recheck: bool = False, profile: RuleProfile | None = None, full_fold: bool = True) -> tuple[DataFrame, DataFrame]:
    """Posts with the marks of the newest unchecked (or, to recheck, the newest) rows' groups, and one row of counts: selected, groups, duplicates, remaining_unchecked."""
    chosen = stored((recent if recheck else unchecked)(posts, limit).select("id"), "chosen")
    out = stored(refreshed(posts, chosen, members, checked_at, profile, full_fold), "marked")
    hit = out.join(chosen.select(F.col("id").alias("_c")), F.col("id") == F.col("_c"), "left")
    counts = hit.agg(F.count("_c").alias("selected"), F.count_distinct(F.when(F.col("_c").isNotNull(), F.col("duplicate_group_key"))).alias("groups"), F.count_if(F.col("_c").isNotNull() & (F.col("duplicate_status") == "duplicate")).alias("duplicates"), F.count_if(F.col("duplicate_checked_at").isNull()).alias("remaining_unchecked"))
    return out, counts
