"""Scalar text functions: Column in, Column out, all built-in expressions unless stated."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeboard.plans.profile import RuleProfile

SPACE = r"(?U)\s+"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends (SQL trim takes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def compact(c: Column) -> Column:
    """without any white space; null is ''."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), SPACE, "")


def collapsed(c: Column) -> Column:
    """stripped, each run of white space one space; null is ''."""
    return F.regexp_replace(strip(F.coalesce(c.cast("string"), F.lit(""))), SPACE, " ")


def count_text(c: Column, unit: str = "人") -> Column:
    """collapsed; bare digits get the unit."""
    v = collapsed(c)
    return F.when(v.rlike(r"(?U)^\d+$"), F.concat(v, F.lit(unit))).otherwise(v)


def cell(c: Column) -> Column:
    """a cell's text."""
    return collapsed(F.translate(c, "\u00a0\u3000", "  "))


def filename(c: Column, default: str = "attachment") -> Column:
    """without characters that file systems refuse, without dots at the ends."""
    v = F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r'[\\/:*?"<>|\r\n\t]+', "_")
    return F.coalesce(F.nullif(F.regexp_replace(v, r"^[. ]+|[. ]+$", ""), F.lit("")), F.lit(default))


def truncated(c: Column, n: int, marker: str = "\n\n[内容已截断]") -> Column:
    """stripped; beyond n characters cut, with a marker."""
    v = strip(F.coalesce(c, F.lit("")))
    return F.when(F.length(v) > n, F.concat(F.left(v, F.lit(n)), F.lit(marker))).otherwise(v)


def nfkc(c: Column) -> Column:
    """Compatibility normal form, by Arrow batches; no built-in has it."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return F.pandas_udf(run, "string")(c)


def folded_title(c: Column, full: bool = True) -> Column:
    """a title for comparison. full: NFKC by pandas UDF; else full-width ASCII only, by translate."""
    wide = "".join(chr(0xFF01 + i) for i in range(94)) + "　"
    v = nfkc(F.coalesce(c, F.lit(""))) if full else F.translate(F.coalesce(c, F.lit("")), wide, "".join(chr(0x21 + i) for i in range(94)) + " ")
    return F.regexp_replace(F.translate(v, "（）：，", "():,"), SPACE, "")


def fingerprint(content: Column, profile: RuleProfile | None = None) -> Column:
    """SHA-1 of the normalised text without white space; '' for none."""
    v = compact(normalised(content, profile))
    return F.when(v == "", F.lit("")).otherwise(F.sha1(F.encode(v, "utf-8")))


def key_url(c: Column) -> Column:
    """a URL as a key; blank is null, so that it joins nothing."""
    return F.nullif(strip(F.coalesce(c, F.lit(""))), F.lit(""))


def integers(c: Column) -> Column:
    """all integers of a text, in order."""
    return F.transform(F.regexp_extract_all(F.coalesce(c.cast("string"), F.lit("")), F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("bigint"))


def first_integer(c: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(c.cast("string"), F.lit("")), r"\d+", 0), F.lit("")).cast("bigint")


def truth(c: Column, yes: tuple[str, ...], no: tuple[str, ...], default: bool | None = None) -> Column:
    """word lists to a boolean."""
    v = F.lower(strip(c.cast("string")))
    return F.when(v.isin(*yes), True).when(v.isin(*no), False).otherwise(F.lit(default).cast("boolean"))


def aliased(c: Column, aliases: dict[str, str], default: str, lower: bool = False) -> Column:
    """F16: an exact dictionary with a default. Small dictionaries are a literal map, no join."""
    v = strip(F.coalesce(c.cast("string"), F.lit("")))
    v = F.lower(v) if lower else v
    m = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(F.try_element_at(m, v), F.lit(default))


def parts(c: Column, most: int = 8, separators: str = r"(?U)[、,，/；;\s]+") -> Column:
    """split on separators, distinct in order, the first few."""
    return F.slice(F.array_distinct(F.filter(F.split(F.coalesce(c, F.lit("")), separators), lambda x: x != "")), 1, most)


def string_list(c: Column) -> Column:
    """a JSON list of strings, stripped, without empty ones; anything else is []."""
    got = F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
    return F.filter(F.transform(got, lambda x: strip(x)), lambda x: x.isNotNull() & (x != ""))


def flattened(c: Column) -> Column:
    """the texts in a JSON list or object, nested as deep as may be, in order, stripped, without empty ones; a text that is neither is one text.

    The values of valid JSON are read off as tokens in one pass, so no level costs a parse of its own. Escaped
    backslashes and quotes give way to control characters meanwhile, which JSON doesn't have in its strings. Texts in
    texts aren't opened; truth values are written True and False.
    """
    v = strip(F.coalesce(c, F.lit("")))
    bare = F.replace(F.replace(v, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))
    tokens = F.regexp_extract_all(bare, F.lit(r'"[^"]*"\s*:|("[^"]*"|[^\s\[\]{},:"]+)'), F.lit(1))
    spelled = F.transform(F.filter(tokens, lambda t: (t != "") & (t != "null")), lambda t: F.when(t == "true", F.lit('"True"')).when(t == "false", F.lit('"False"')).otherwise(t))
    listed = F.replace(F.replace(F.concat(F.lit("["), F.array_join(spelled, ","), F.lit("]")), F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))
    nested = (v.startswith("[") | v.startswith("{")) & F.try_parse_json(v).isNotNull()
    out = F.when(nested, F.from_json(listed, "array<string>")).otherwise(F.array(v))
    return F.filter(F.transform(out, lambda x: strip(x)), lambda x: x.isNotNull() & (x != ""))


def json_object(c: Column) -> Column:
    """the JSON object in a text: the text, what a fence holds, or first { to last }; null if none parses."""
    v = strip(c)
    fenced = F.regexp_extract(v, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    braced = F.regexp_extract(v, r"(?s)(\{.*\})", 1)
    ok = lambda x: F.when(F.get_json_object(x, "$").startswith("{"), x)
    return F.coalesce(ok(v), ok(fenced), ok(braced))


def has_any(c: Column, words) -> Column:
    """True if c holds any of the words, as they are."""
    words = [w for w in words if w]
    return reduce(or_, [F.contains(c, F.lit(w)) for w in words]) if words else F.lit(False)


def matches_any(c: Column, patterns) -> Column:
    return reduce(or_, [c.rlike(p) for p in patterns]) if patterns else F.lit(False)


def like_any(c: Column, words, *, wildcards: bool = False) -> Column:
    """Substring search, ASCII case apart. wildcards: % and _ in a word act as such."""
    words = [w for w in words if w]
    one = (lambda w: c.ilike(f"%{w}%")) if wildcards else (lambda w: F.contains(F.lower(c), F.lit(w.lower())))
    return reduce(or_, map(one, words)) if words else F.lit(False)


def is_noise(line: Column, profile: RuleProfile | None) -> Column:
    """A stripped line that is empty or, with a profile, listed or starting like listed ones."""
    out = line == ""
    if profile and profile.noise_texts:
        out = out | line.isin(*profile.noise_texts)
    for p in profile.noise_prefixes if profile else ():
        out = out | line.startswith(p)
    return out


#: fixed values: file suffixes, and marks before which a line begins
SUFFIXES = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".zip", ".rar")
_SUFFIX = "|".join(re.escape(s) for s in SUFFIXES)
BREAKS = (
    (r"(?<!\n\n)(附件[:：])", "\n\n$1"),
    (r"(?<!\n)((?:举报电话|咨询电话|监督电话|举报信箱|联系电话)[:：])", "\n$1"),
    (r"(?<!\n\n)([一二三四五六七八九十]+、)", "\n\n$1"),
    (r"(?<!\n)(（[一二三四五六七八九十]+）)", "\n$1"),
    (r"(?U)(?<!\d)(?<!\n)([1-9][0-9]?[.、])(?=[^\d])", "\n$1"),
    (r"([0-9-]{7,})([1-9])(?=\.[一-鿿])", "$1\n$2"),
    (rf"(?i)({_SUFFIX})(?=附件[:：]|[一-鿿A-Za-z])", "$1\n"),
)
FEW_LINES, SHORT_LINE, FRAGMENTED = 8, 6, 0.35


def lines_of(c: Column, profile: RuleProfile | None = None) -> Column:
    """The stripped lines of a text that aren't noise."""
    v = F.translate(F.coalesce(c, F.lit("")), "\r\u00a0\u3000", "\n  ")
    return F.filter(F.transform(F.split(v, "\n"), lambda x: strip(x)), lambda x: ~is_noise(x, profile))


def normalised(c: Column, profile: RuleProfile | None = None, breaks=BREAKS) -> Column:
    """Noise lines out, fragments joined, line breaks before marks, spaces and blank lines tidied."""
    return F.transform(F.array(lines_of(c, profile)), lambda ls: _rejoined(ls, profile, breaks))[0]


def _rejoined(lines: Column, profile: RuleProfile | None, breaks) -> Column:
    n, short = F.size(lines), F.size(F.filter(lines, lambda x: F.length(x) <= SHORT_LINE))
    joined = F.array_join(lines, "")
    for token in profile.inline_noise if profile else ():
        joined = F.replace(joined, F.lit(token), F.lit(""))
    v = F.when((n >= FEW_LINES) & (short / n > FRAGMENTED), joined).otherwise(F.array_join(lines, "\n\n"))
    for pattern, new in (*breaks, (r"[ \t]+", " "), (r"\n{3,}", "\n\n")):
        v = F.regexp_replace(v, pattern, new)
    return strip(v)


def publisher(title: Column) -> Column:
    """What stands before the first year of a title."""
    return strip(F.regexp_extract(F.coalesce(title, F.lit("")), r"^(.+?)(?=\d{4}年)", 1))


#: fixed values: headings that run into their text
HEADINGS = ("招聘计划", "报考条件", "报名", "网上确认", "网上打印准考证", "报名注意事项", "招聘办法", "资格复审", "考核方式", "考试科目、时间和实施办法", "体检、考察", "公示与聘用", "招聘政策咨询", "招聘工作监督", "招聘工作举报", "技术支持")
SUBHEADINGS = ("报名时间、地点、方式", "网上确认", "网上打印准考证", "报名注意事项", "资格复审", "考核方式")
_DATE = r"\d{4}年\d{1,2}月\d{1,2}日"
_FILE_AHEAD = rf"(?=[^\n]{{0,120}}(?:{_SUFFIX}))"


def with_headings(c: Column) -> Column:
    """A line break after numbered headings."""
    v = F.regexp_replace(c, rf"([一二三四五六七八九十]+、(?:{'|'.join(HEADINGS)}))[ \t]*(?=[一-鿿])", "$1\n")
    return F.regexp_replace(v, rf"(（[一二三四五六七八九十]+）(?:{'|'.join(SUBHEADINGS)}))[ \t]*(?=[一-鿿])", "$1\n")


def with_signature(c: Column, signer: Column) -> Column:
    """The publisher's signature before a date on lines of its own."""
    q = F.concat(F.lit(r"\Q"), signer, F.lit(r"\E"))
    pattern = lambda before, after: F.concat(F.lit(before), q, F.lit(after))
    date = rf")\s*(?={_DATE})"
    v = F.regexp_replace(c, pattern(r"([。；;）)])\s*(", date), F.lit("$1\n$2\n"))
    v = F.regexp_replace(v, pattern(r"((?:附件[:：]|[1-9][0-9]?[.、])[^\n]*?)(", date), F.lit("$1\n$2\n"))
    v = F.regexp_replace(v, pattern(r"(?<=\n|^)(", date), F.lit("$1\n"))
    return F.when((signer != "") & signer.isNotNull(), v).otherwise(c)


def cut_repeated_block(c: Column) -> Column:
    """A text whose beginning comes again (from a quarter of its length on) ends before that. By Arrow batches."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        head = [p.strip() for p in re.split(r"\n{2,}", text) if p.strip()]
        if len(head) < 2:
            return text
        sample, at = re.sub(r"\s+", "", head[0] + head[1])[:200], len(head[0])
        while (at := text.find(head[0], at)) >= 0:
            if at >= len(text) // 4 and re.sub(r"\s+", "", text[at : at + len(head[0]) + 160]).startswith(sample):
                return text[:at].rstrip()
            at += len(head[0])
        return text

    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return F.pandas_udf(run, "string")(c)


def without_lonely_x(c: Column) -> Column:
    """Without lines that are a single x."""
    return strip(F.array_join(F.filter(F.split(c, r"\r?\n"), lambda x: F.lower(strip(x)) != "x"), "\n"))


def formatted(title: Column, content: Column, profile: RuleProfile | None = None) -> Column:
    """The text as a detail page shows it."""
    lead = r"^[：: \n]+"
    v = normalised(content, profile)
    v = F.when(v.startswith(title), F.regexp_replace(F.substring(v, F.length(title) + 1, F.length(v)), lead, "")).otherwise(v)
    v = F.regexp_replace(F.regexp_replace(v, r"^发布日期[:：]\s*\d{4}-\d{2}-\d{2}", ""), lead, "")
    v = F.regexp_replace(F.regexp_replace(v, r"^来源[:：]\s*", ""), lead, "")
    v = with_signature(with_headings(v), publisher(title))
    v = F.regexp_replace(v, rf"(?i)({_DATE}){_FILE_AHEAD}", "$1\n")
    v = without_lonely_x(cut_repeated_block(v))
    for pattern, new in ((r"\n[ \t]+", "\n"), (r"[ \t]+\n", "\n"), (rf"(?i)({_DATE})\n{{2,}}{_FILE_AHEAD}", "$1\n"), (r"\n{3,}", "\n\n")):
        v = F.regexp_replace(v, pattern, new)
    return strip(v)


def clamped(c: Column, n: int = 120, marker: str = "…") -> Column:
    """at most n characters, the last of them a mark where more came."""
    v = strip(F.coalesce(c, F.lit("")))
    return F.when(F.length(v) > n, F.concat(strip(F.left(v, F.lit(max(0, n - 1)))), F.lit(marker))).otherwise(v)


def clauses(c: Column) -> Column:
    """the parts between ；and ; without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[；;]"), lambda x: strip(x)), lambda x: x != "")
