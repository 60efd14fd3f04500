"""Field extractors and classifiers: ordered rules of a profile, as when/coalesce chains that stay in one projection."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeboard.functions.text import aliased, compact, has_any, matches_any, strip
from noticeboard.plans.profile import (
    AGE_MOST,
    AGE_MOST_BELOW,
    AGE_PATTERNS,
    BOTH_APART,
    DEGREE_RANK,
    GENDER_PATTERNS,
    GENDER_UNLIMITED,
    MAN,
    MAN_MARKED,
    MAN_ONLY,
    UNLIMITED,
    UNSAID,
    WOMAN,
    WOMAN_MARKED,
    WOMAN_ONLY,
    FieldRule,
    RuleProfile,
)


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """A pattern's first match; null if there is none."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def tidy_value(c: Column) -> Column:
    """Without leading marks and 位于."""
    return strip(F.regexp_replace(strip(F.regexp_replace(c, r"(?U)^[-\s、,，.:：]+", "")), "^位于", ""))


def field_value(text: Column, rule: FieldRule) -> Column:
    """The first pattern whose first match passes; a failing match goes on to the next pattern."""

    def one(pattern: str) -> Column:
        v = tidy_value(found(text, pattern))
        if rule.integer:
            v = v.try_cast("bigint").cast("string")
        if rule.suffix.startswith("-"):
            v = F.regexp_replace(v, f"{rule.suffix[1:]}$", "")
        elif rule.suffix:
            v = F.concat(v, F.lit(rule.suffix))
        ok = v.isNotNull()
        ok = ok & v.rlike(rule.keep) if rule.keep else ok
        ok = ok & ~v.rlike(rule.reject) if rule.reject else ok
        return F.when(ok, v)

    return F.coalesce(*map(one, rule.patterns))


def gender(text: Column) -> Column:
    """Unlimited words, then patterns by their value, then words anywhere."""
    compacted = F.regexp_replace(text, "[ \n]", "")

    def of_value(v: Column) -> Column:
        v = F.regexp_replace(tidy_value(v), " ", "")
        man, woman = F.contains(v, F.lit(MAN)), F.contains(v, F.lit(WOMAN))
        return F.when(has_any(v, GENDER_UNLIMITED) | (v == UNLIMITED), UNLIMITED).when(woman & ~man, WOMAN).when(man & ~woman, MAN)

    bare = F.regexp_replace(text, "\r", "")
    anywhere = F.when(has_any(compacted, GENDER_UNLIMITED), UNLIMITED)
    for words, value in ((MAN_MARKED, MAN), (WOMAN_MARKED, WOMAN), ((MAN,), MAN), ((WOMAN,), WOMAN)):
        anywhere = anywhere.when(has_any(compacted, words), value)
    return F.coalesce(F.when(has_any(bare, GENDER_UNLIMITED), UNLIMITED), *[of_value(found(bare, p)) for p in GENDER_PATTERNS], anywhere)


def education(text: Column, profile: RuleProfile) -> Column:
    """The highest level mentioned."""
    v = F.regexp_replace(text, "[ \n]", "")
    return F.coalesce(*[F.when(has_any(v, words), level) for level, words in profile.education_levels]) if profile.education_levels else F.lit(None).cast("string")


def age(text: Column) -> Column:
    """A range, an upper or a lower bound."""

    def formed(pattern: str, form: str) -> Column:
        parts = [F.regexp_extract(text, pattern, int(x)) if x in "12" else F.lit(x) for x in re.split(r"[{}]", form) if x]
        return F.when(text.rlike(pattern), F.concat(*parts))

    below = F.regexp_extract(text, AGE_MOST, 1).isin(*AGE_MOST_BELOW)
    most = F.when(below, formed(AGE_MOST, "{2}岁以下")).otherwise(formed(AGE_MOST, "{2}岁"))
    return F.coalesce(*[formed(p, form) for p, form in AGE_PATTERNS], most)


def political(text: Column, profile: RuleProfile) -> Column:
    """The first listed word that occurs."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(w)), w) for w in profile.political]) if profile.political else F.lit(None).cast("string")


def fields(posts: DataFrame, profile: RuleProfile, *, id_col: str = "id") -> DataFrame:
    """post_id, field_name, field_value for what the rules find in title and content."""
    text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit("")))
    values = {r.name: field_value(F.col("_text"), r) for r in profile.field_rules}
    values |= {"性别要求": gender(F.col("_text")), "学历要求": education(F.col("_text"), profile), "年龄要求": age(F.col("_text")), "政治面貌": political(F.col("_text"), profile)}
    pairs = F.array(*[F.struct(F.lit(k).alias("field_name"), v.alias("field_value")) for k, v in values.items()])
    out = posts.select(F.col(id_col).alias("post_id"), text.alias("_text")).select("post_id", F.explode(pairs).alias("f"))
    return out.select("post_id", "f.field_name", "f.field_value").filter("field_value is not null")


def with_role(c: Column, patterns: tuple[str, ...], p: RuleProfile) -> Column:
    """Whether c matches any of the patterns, all of which hold the role's name: only texts with the name are matched at all."""
    return F.contains(c, F.lit(p.role)) & matches_any(c, patterns)


def position(title: Column, content: Column, p: RuleProfile) -> Column:
    """struct(matched, confidence), title before body, in the order of the rules."""
    t, b = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(content, F.lit("")))
    out = lambda m, s: F.struct(F.lit(m).alias("matched"), F.lit(s).cast("double").alias("confidence"))
    return (
        F.when(with_role(t, p.role_exclude, p), out(False, 0.0))
        .when(F.contains(t, F.lit(p.dedicated_role)), out(True, 1.0))
        .when(F.contains(t, F.lit(p.role)), out(True, 0.8))
        .when(~F.contains(b, F.lit(p.role)), out(False, 0.0))
        .when(matches_any(b, p.role_exclude), out(False, 0.0))
        .when(matches_any(b, p.body_exclude), out(False, 0.0))
        .when(matches_any(b, p.body_include) & F.contains(b, F.lit(p.dedicated_role)), out(True, 0.8))
        .when(matches_any(b, p.body_include), out(True, 0.6))
        .otherwise(out(False, 0.0))
    )


def mixed_role(text: Column, p: RuleProfile) -> Column:
    """The role next to other ones."""
    v = strip(F.coalesce(text, F.lit("")))
    return F.contains(v, F.lit(p.role)) & matches_any(v, p.mixed_role)


def dedicated_title(title: Column, p: RuleProfile) -> Column:
    """A title about this role alone."""
    v = strip(F.coalesce(title, F.lit("")))
    return F.contains(v, F.lit(p.role)) & ~matches_any(F.lower(v), p.role_exclude) & ~mixed_role(v, p) & matches_any(v, p.dedicated_title)


def occurrences(text: Column, word: str) -> Column:
    """How often a word occurs, without overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("int")


def event_type(title: Column, content: Column, p: RuleProfile) -> Column:
    """The first rule that holds, title rules before body rules."""
    t, b = strip(F.coalesce(title, F.lit(""))), strip(F.coalesce(content, F.lit("")))
    test = {"title": lambda w: has_any(t, w), "body": lambda w: has_any(b, w), "title_not": lambda w: F.contains(t, F.lit(w[0])) & ~has_any(t, w[1:]), "title_all": lambda w: F.contains(t, F.lit(w[0])) & has_any(t, w[1:])}
    return F.coalesce(*[F.when(test[kind](words), event) for kind, event, words in p.event_rules], F.lit(p.event_default))


def stage(event: Column, p: RuleProfile) -> Column:
    """C11."""
    return aliased(event, p.stage_of_event, p.event_default) if p.stage_of_event else F.lit(p.event_default)


def cities(texts: list[Column], p: RuleProfile) -> Column:
    """C12, list: cities in the order of the texts, then of the list; each once."""
    held = lambda t: F.filter(F.array(*map(F.lit, p.cities)), lambda c: F.contains(F.coalesce(t, F.lit("")), c))
    per = [held(t) for t in texts]
    return F.array_distinct(F.flatten(F.array(*per)))


def city(location: Column, title: Column, content: Column, p: RuleProfile) -> Column:
    """The first listed city in the location, else in title, content and location together."""
    names = F.array(*map(F.lit, p.cities))
    whole = F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(content, F.lit("")), F.coalesce(location, F.lit("")))
    first = lambda t: F.get(F.filter(names, lambda c: F.contains(t, c)), F.lit(0))
    return F.coalesce(first(F.coalesce(location, F.lit(""))), first(whole), F.lit(""))


def gender_restriction(texts: Column) -> Column:
    """C13, over the joined texts: unlimited anywhere wins, then both, one, none."""
    man, woman = has_any(texts, MAN_ONLY), has_any(texts, WOMAN_ONLY)
    return F.when(F.contains(texts, F.lit(UNLIMITED)), UNLIMITED).when(man & woman, BOTH_APART).when(man, MAN).when(woman, WOMAN).otherwise(UNSAID)


def degree_floor(texts: Column, p: RuleProfile) -> Column:
    """C14, over an array of texts: the lowest level among exact aliases."""
    ranks = F.transform(texts, lambda t: aliased(t, {a: str(DEGREE_RANK[d]) for a, d in p.degree_alias.items()}, "9").cast("int"))
    return aliased(F.array_min(ranks).cast("string"), {str(v): k for k, v in DEGREE_RANK.items()}, UNSAID)


def school(title: Column) -> Column:
    """T05, school variant."""
    v = strip(F.coalesce(title, F.lit("")))
    name = F.regexp_extract(v, r"^(.+?)(?=\d{4}年)", 1)
    return F.when(name != "", F.regexp_replace(strip(name), r"^[：: ]+|[：: ]+$", "")).otherwise(F.left(v, F.lit(50)))


def all_of(*conditions: Column) -> Column:
    return reduce(and_, conditions)


def compacted_keyword(c: Column, word: str) -> Column:
    return F.contains(compact(c), F.lit(word))
