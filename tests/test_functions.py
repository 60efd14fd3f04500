"""Golden cases of the text functions, extractors and classifiers."""

import datetime as dt
import unicodedata

import pytest
from pyspark.sql import functions as F

from noticeboard.functions import classify, dates, text
from noticeboard.plans.profile import LATIN, ZH


def one(spark, column, **values):
    """The value of a column expression over one row of literals."""
    names = list(values)
    schema = ", ".join(f"`{n}` {'bigint' if isinstance(values[n], int) else 'string'}" for n in names) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("v")).first().v


C = F.col("c")


@pytest.mark.parametrize(
    ("column", "value", "want"),
    [
        (text.compact(C), " a　b c\n", "abc"),
        (text.compact(C), None, ""),
        (text.collapsed(C), "\t a \n\n b ", "a b"),
        (text.count_text(C), " 12 ", "12人"),
        (text.count_text(C), "1２", "1２人"),
        (text.count_text(C), "若干", "若干"),
        (text.cell(C), "　甲 乙 ", "甲 乙"),
        (text.filename(C), 'a/b:c*?"<>|d.', "a_b_c_d"),
        (text.filename(C), " . ", "attachment"),
        (text.truncated(C, 3), "abcdef", "abc\n\n[内容已截断]"),
        (text.truncated(C, 3), "abc", "abc"),
        (text.folded_title(C), " 甲（二）：２０２６，ok ", "甲(二):2026,ok"),
        (text.folded_title(C, full=False), " 甲（二）：２０２６，ok ", "甲(二):2026,ok"),
        (text.key_url(C), " \t", None),
        (text.integers(C), "3人；12人 and 007", [3, 12, 7]),
        (text.first_integer(C), "x42y7", 42),
        (text.first_integer(C), "x", None),
        (text.truth(C, ("yes", "是"), ("no",)), " YES ", True),
        (text.truth(C, ("yes",), ("no",)), "maybe", None),
        (text.aliased(C, ZH.degree_alias, "未说明"), "研究生", "硕士"),
        (text.aliased(C, ZH.degree_alias, "未说明"), "研究生以上", "未说明"),
        (text.parts(C), "南京、苏州,南京；无锡 常州", ["南京", "苏州", "无锡", "常州"]),
        (text.string_list(C), '["a", " b ", ""]', ["a", "b"]),
        (text.string_list(C), "not json", []),
        (text.json_object(C), 'so:\n```json\n{"a": 1}\n```', '{"a": 1}'),
        (text.json_object(C), 'x {"a": {"b": 2}} y', '{"a": {"b": 2}}'),
        (text.json_object(C), "nothing", None),
        (text.publisher(C), "某学院2026年公开招聘公告", "某学院"),
        (text.cut_repeated_block(C), "first part\n\nsecond part\n\nx\n\nfirst part\n\nsecond part\n\nmore", "first part\n\nsecond part\n\nx"),
        (text.without_lonely_x(C), "a\n x \nX\nb", "a\nb"),
        (dates.deadline(C), "报名至2026年3月9日止", dt.date(2026, 3, 9)),
        (dates.deadline(C), "2026/03/10", dt.date(2026, 3, 10)),
        (dates.deadline(C), "soon", None),
        (dates.progress(C), "140", 100),
        (dates.progress(C), "x", 0),
        (classify.gender(C), "性别要求：男\n专业：不限", "男"),
        (classify.gender(C), "岗位：专职辅导员（女）", "女"),
        (classify.gender(C), "性别不限\n专业：不限", "不限"),
        (classify.gender(C), "专业：不限", None),
        (classify.education(C, ZH), "本科及以上，博 士优先", "博士"),
        (classify.age(C), "年龄：35岁以下", "35岁以下"),
        (classify.age(C), "18-35周岁", "18-35岁"),
        (classify.age(C), "不超过40周岁", "40岁以下"),
        (classify.political(C, ZH), "须为中共党员", "中共党员"),
        (classify.gender_restriction(C), "限男 / 限女", "分岗限制"),
        (classify.gender_restriction(C), "专业不限，限女", "不限"),
        (classify.school(C), "某大学2026年公告", "某大学"),
    ],
)
def test_scalar(spark, column, value, want):
    assert one(spark, column, c=value) == want


@pytest.mark.parametrize(("name", "value", "want"), [("专业要求", "要求：\n- 思想教育专业", "思想教育"), ("专业要求", "专业：不限\n工科类专业", "工科类"), ("工作地点", "地点：位于某市，其他", "某市"), ("招聘人数", "共计招聘 05 名", "5人"), ("报名时间", "报名时间：2026年3月1日至2026年3月9日", "2026年3月1日至2026年3月9日")])
def test_field_rules(spark, name, value, want):
    rule = next(r for r in ZH.field_rules if r.name == name)
    assert one(spark, classify.field_value(C, rule), c=value) == want


@pytest.mark.parametrize(
    ("title", "body", "matched", "least"),
    [
        ("某校2026年招聘专职辅导员公告", "工作经历不含兼职辅导员", True, 1.0),
        ("某校招聘辅导员", "", True, 0.8),
        ("某校招聘兼职辅导员公告", "公开招聘专职辅导员", False, 0.0),
        ("某校招聘公告", "报考辅导员岗位须为党员", False, 0.0),
        ("某校招聘公告", "现面向社会公开招聘专职辅导员2名。", True, 0.8),
        ("某校招聘公告", "拟聘用心理辅导员", True, 0.6),
        ("某校招聘公告", "具备一年以上高校辅导员工作经历。", False, 0.0),
        (None, None, False, 0.0),
    ],
)
def test_position(spark, title, body, matched, least):
    r = one(spark, classify.position(F.col("t"), F.col("b"), ZH), t=title, b=body)
    assert (r.matched, r.confidence) == (matched, least)


@pytest.mark.parametrize(
    ("title", "body", "want"),
    [("某校专职辅导员拟聘用人员名单公示", "", "结果公示"), ("某校2026年招聘公告", "五、公示与聘用。笔试", "招聘公告"), ("某校资格复审通知", "", "资格审查"), ("某校通知", "笔试安排", "考试通知"), ("关于延期的公告", "", "补充公告"), ("某校通知", "无", "其他"), ("公示公告", "", "其他")],
)
def test_event(spark, title, body, want):
    assert one(spark, classify.event_type(F.col("t"), F.col("b"), ZH), t=title, b=body) == want
    assert one(spark, classify.stage(F.lit(want), ZH)) == ZH.stage_of_event[want]


def test_titles_and_places(spark):
    assert one(spark, classify.dedicated_title(C, ZH), c="某校公开招聘专职辅导员公告")
    assert not one(spark, classify.dedicated_title(C, ZH), c="某校公开招聘辅导员、专任教师公告")
    assert not one(spark, classify.dedicated_title(C, ZH), c="某校招聘教师公告")
    assert one(spark, classify.cities([F.col("a"), F.col("b")], ZH), a="苏州", b="南京与苏州") == ["苏州", "南京"]
    assert one(spark, classify.city(F.col("a"), F.col("b"), F.lit(None), ZH), a="", b="南京苏州") == "南京"
    assert one(spark, classify.degree_floor(F.array(F.col("a"), F.col("b")), ZH), a="博士", b="研究生") == "硕士"
    assert one(spark, classify.degree_floor(F.array(F.col("a")), ZH), a="硕士以上") == "未说明"


def test_normalised_joins_fragments_and_drops_noise(spark):
    broken = "当前位置：\n首页\n>\n点击查看原文件：\n按照\n202\n5\n年\n1\n月\n2\n日的公告\n关闭本页"
    assert one(spark, text.normalised(C, ZH), c=broken) == "按照2025年1月2日的公告"
    assert "首页" in one(spark, text.normalised(C), c=broken)
    assert one(spark, text.normalised(C), c="咨询由人事处负责。咨询电话：0517-1234567") == "咨询由人事处负责。\n咨询电话：0517-1234567"
    assert "\n2.某厅" in one(spark, text.normalised(C), c="举报1.某委电话：025-83620963、832682792.某厅信箱")
    assert one(spark, text.normalised(C), c="附件：1.表一2.表二甲.xls乙.xls").endswith("附件：\n1.表一\n2.表二甲.xls\n乙.xls")
    assert one(spark, text.normalised(C), c=None) == ""
    assert one(spark, text.fingerprint(C), c="一、岗位\n\n甲") == one(spark, text.fingerprint(C), c="一、岗位  甲") != one(spark, text.fingerprint(C), c="")


def test_formatted(spark):
    title = "某医院2026年招聘人员名单公示"
    content = f"{title}发布日期： 2026-03-17按照公告进行公示。\n\n附件：{title}某医院2026年3月17日\n\n附件：{title}.xls"
    got = one(spark, text.formatted(F.col("t"), F.col("c"), ZH), t=title, c=content)
    assert got.startswith("按照公告进行公示。") and "某医院\n2026年3月17日" in got
    assert "五、公示与聘用\n对公示" in one(spark, text.formatted(F.col("t"), F.col("c")), t="公告", c="五、公示与聘用对公示无异议")


def test_dates(spark):
    day = lambda n: F.date_add(F.to_date(F.lit("2026-03-01")), n)
    assert [one(spark, dates.deadline_status(day(n), day(0))) for n in (-1, 0, 3, 4)] == ["已截止", "即将截止", "即将截止", "报名中"]
    assert one(spark, dates.deadline_status(F.lit(None).cast("date"), day(0))) == "未说明"
    assert one(spark, dates.parsed(C, F.to_timestamp(F.lit("2000-01-01"))), c="2026年3月1日") == dt.datetime(2026, 3, 1)
    assert one(spark, dates.parsed(C, F.to_timestamp(F.lit("2000-01-01"))), c="?") == dt.datetime(2000, 1, 1)
    assert one(spark, dates.progress_between(10, 30, F.lit(1), F.lit(8))) == 12
    assert one(spark, dates.percent(F.lit(1), F.lit(8))) == "13%" and one(spark, dates.percent(F.lit(1), F.lit(0))) == "0%"
    assert one(spark, dates.ratio(F.lit(1), F.lit(3))) == 0.3333


def test_nfkc_is_pythons(spark):
    words = ["ﬁ", "①", "Ⅳ", "ｶﾞ", "é", None]
    got = [r.v for r in spark.createDataFrame([(w,) for w in words], "c string").select(text.nfkc(C).alias("v")).collect()]
    assert got == [w and unicodedata.normalize("NFKC", w) for w in words]


def test_latin_profile_has_no_domain():
    assert LATIN.role and not LATIN.field_rules
