"""Rule profiles: all keywords, patterns and aliases that the text operators use. Rules are data; operators hold none."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class FieldRule:
    """An extractor: patterns in order, each by its first match; group(s) make the value."""

    name: str
    patterns: tuple[str, ...]
    keep: str | None = None  # a value must match this, or the next pattern is tried
    reject: str | None = None
    suffix: str = ""
    integer: bool = False


@dataclass(frozen=True)
class Wording:
    """Names of fields, and the texts in which results are written; {} is where the value goes."""

    job: str = "job"
    headcount: str = "headcount"
    education: str = "education"
    major: str = "major"
    place: str = "place"
    political: str = "political"
    gender: str = "gender"
    signup: str = "signup"
    deadlines: tuple[str, ...] = ("deadline", "signup")
    payload_gender: tuple[str, ...] = ("gender",)
    exam: str = "exam"
    interview: str = "interview"
    role_tag: str = "role"
    attachment_tag: str = "attachments"
    of_event: str = "This is {}."
    of_school: str = "By {}."
    of_city: str = "Near {}."
    of_headcount: str = "Headcount {}."
    of_education: str = "Education {}."
    of_signup: str = "Signup {}."
    of_notice: str = "A result, for the archive."
    role_evidence: str = "role headcount {}"
    deadline_evidence: str = "signup: {}"
    education_evidence: str = "education: {}"
    unknown: str = "unknown"
    deadline_status: tuple[str, str, str, str] = ("over", "soon", "open", "unknown")


@dataclass(frozen=True)
class RuleProfile:
    noise_texts: tuple[str, ...] = ()
    noise_prefixes: tuple[str, ...] = ()
    inline_noise: tuple[str, ...] = ()
    role: str = ""
    dedicated_role: str = ""
    # what these match must hold the role's name
    role_exclude: tuple[str, ...] = ()
    body_include: tuple[str, ...] = ()
    body_exclude: tuple[str, ...] = ()
    mixed_role: tuple[str, ...] = ()
    dedicated_title: tuple[str, ...] = ()
    event_rules: tuple[tuple[str, str, tuple[str, ...]], ...] = ()  # (title|body|title_all|title_not, event, keywords)
    event_default: str = ""
    notice_event: str = ""
    stage_of_event: dict[str, str] = field(default_factory=dict)
    education_levels: tuple[tuple[str, tuple[str, ...]], ...] = ()
    political: tuple[str, ...] = ()
    cities: tuple[str, ...] = ()
    field_rules: tuple[FieldRule, ...] = ()
    degree_alias: dict[str, str] = field(default_factory=dict)
    priority_alias: dict[str, str] = field(default_factory=dict)
    stage_alias: dict[str, str] = field(default_factory=dict)
    gender_alias: dict[str, str] = field(default_factory=dict)
    deadline_alias: dict[str, str] = field(default_factory=dict)
    header_alias: dict[str, tuple[str, ...]] = field(default_factory=dict)
    job_names: tuple[str, ...] = ()  # names of the role, the most special first
    wording: Wording = Wording()


# Words and patterns of gender and age, which results have to agree on.
GENDER_UNLIMITED = ("男女不限", "性别不限", "不限性别")
GENDER_PATTERNS = (r"辅导员[（(](男|女)[)）]", r"(?U)(?:性别要求|性别)[：:]\s*([^\n，。；;]{1,12})", r"(?U)(?:仅限|限)\s*(男性|女性|男|女)")
MAN, WOMAN = "男", "女"
MAN_MARKED, WOMAN_MARKED = ("辅导员（男）", "辅导员(男)"), ("辅导员（女）", "辅导员(女)")
MAN_ONLY, WOMAN_ONLY = ("（男）", "(男)", "限男", "男性"), ("（女）", "(女)", "限女", "女性")
UNLIMITED, BOTH_APART, UNSAID = "不限", "分岗限制", "未说明"
AGE_PATTERNS = (
    (r"年龄[：:]\s*(\d{2})\s*[-至—]\s*(\d{2})\s*周?岁", "{1}-{2}岁"),
    (r"(\d{2})\s*[-至—]\s*(\d{2})\s*周?岁", "{1}-{2}岁"),
    (r"年龄[：:]\s*(\d{2})\s*周?岁(?:以下|及以下)", "{1}岁以下"),
    (r"(\d{2})\s*周?岁(?:以下|及以下)", "{1}岁以下"),
    (r"年龄[：:]\s*(\d{2})\s*周?岁(?:以上|及以上)", "{1}岁以上"),
    (r"(\d{2})\s*周?岁(?:以上|及以上)", "{1}岁以上"),
)
AGE_MOST = r"(?:年龄[：:]?\s*)?(不超过|不得超过|小于等于|不大于)\s*(\d{2})\s*周?岁"
AGE_MOST_BELOW = ("不超过", "不得超过")
DEGREE_RANK = {"专科": 1, "本科": 2, "硕士": 3, "博士": 4}

# The rules of Chinese recruitment notices, which results have to agree on.
ZH = RuleProfile(
    noise_texts=("当前位置：", "首页", "资讯中心", "省属事业单位招聘", "来源：", "发布日期：", "点击量：", "点击查看原文件：", "关闭本页", "打印本页", "小", "中", "大", ">", "[", "]", "关闭本页打印本页"),
    noise_prefixes=("当前位置：", "发布日期：", "来源：", "字体：["),
    inline_noise=("点击查看原文件：", "关闭本页打印本页"),
    role="辅导员",
    dedicated_role="专职辅导员",
    role_exclude=(r"(?U)(?:兼职|临时|实习)\s*辅导员", r"(?U)辅导员\s*(?:兼职|临时|实习)"),
    body_include=(r"(?:公开招聘|招聘|招录|招考).{0,10}(?:专职)?[一-鿿]{0,8}辅导员", r"(?:拟聘用|拟录用|聘用).{0,10}(?:专职)?[一-鿿]{0,8}辅导员", r"(?:专职)?[一-鿿]{0,8}辅导员.{0,10}(?:公告|招聘|招录|招考|拟聘用|拟录用)"),
    body_exclude=(r"(?:报考|应聘|符合|具备|从事|担任|须为|需有|具有).{0,12}(?:专职)?[一-鿿]{0,8}辅导员", r"(?:专职)?[一-鿿]{0,8}辅导员(?:岗位|岗|工作)?.{0,12}(?:须|需|应|限|条件|经历)"),
    mixed_role=(r"辅导员[、及和与].{0,20}(?:教师|专任|岗位|工作人员|人才|思政|心理)", r"(?:教师|专任|岗位|工作人员|人才|思政|心理).{0,20}[、及和与]辅导员"),
    dedicated_title=(r"(?:公开招聘|招聘|招录|招考).{0,12}(?:专职)?辅导员", r"(?:专职)?辅导员.{0,12}(?:公告|招聘|招录|招考|拟聘用|公示|名单)"),
    event_rules=(
        ("title", "结果公示", ("拟聘用", "聘用人员名单", "名单公示", "递补公示", "考察公示", "体检公示")),
        ("title_not", "结果公示", ("公示", "公告")),
        ("title", "资格审查", ("资格复审", "资格审核", "资格审查")),
        ("title", "考试通知", ("笔试", "面试", "准考证", "考试", "考核")),
        ("title", "补充公告", ("补充公告", "更正", "延期", "调整", "补报名", "重新发布")),
        ("title_all", "招聘公告", ("公告", "招聘", "招录", "辅导员", "报名")),
        ("title", "招聘公告", ("岗位表",)),
        ("body", "结果公示", ("拟聘用人员名单", "聘用人员名单", "名单公示")),
        ("body", "资格审查", ("资格复审", "资格审核", "资格审查")),
        ("body", "考试通知", ("笔试", "面试", "准考证", "考试", "考核")),
        ("body", "补充公告", ("补充公告", "更正", "延期", "调整", "补报名", "重新发布")),
        ("body", "招聘公告", ("招聘", "招录", "岗位表")),
    ),
    event_default="其他",
    notice_event="结果公示",
    stage_of_event={"招聘公告": "招聘启动", "考试通知": "考试考核", "资格审查": "资格审查", "结果公示": "结果公示", "补充公告": "信息变更", "其他": "其他"},
    education_levels=(("博士", ("博士",)), ("硕士", ("硕士", "研究生学历")), ("本科", ("本科", "学士")), ("专科", ("专科", "大专", "高职"))),
    political=("中共党员", "党员", "共产党员", "预备党员"),
    cities=("南京", "苏州", "无锡", "常州", "南通", "徐州", "盐城", "扬州", "镇江", "泰州", "淮安", "连云港", "宿迁"),
    field_rules=(
        FieldRule("专业要求", (r"(?U)专业[：:]\s*([^\n，。；;]{2,50})", r"(?U)专业要求[：:]\s*([^\n，。；;]{2,50})", r"([一-龥（）()、/]{2,40}专业)"), keep=r"(?s).{2,}", reject="不限|具备报考岗位要求|岗位要求|有关规定|经过考核|名单公示|公开招聘|拟聘用人员|招聘公告", suffix="-专业"),
        FieldRule("工作地点", (r"(?U)工作地点[：:]\s*([^\n，。；;]{2,30})", r"(?U)地点[：:]\s*([^\n，。；;]{2,30})", r"([一-龥]{2,10}市|[一-龥]{2,10}区|[一-龥]{2,10}县)"), keep=r"(?s).{2,}"),
        FieldRule("招聘人数", (r"(?U)招聘人?数量?[：:]\s*(\d+)\s*[人名]?", r"(?U)招聘\s*(\d+)\s*[人名]", r"(?U)(\d+)\s*[人名]", r"(?U)[共计]?\s*(\d+)\s*个?岗位"), suffix="人", integer=True),
        FieldRule("报名时间", (r"(?U)报名时间[：:]\s*(\d{4}[年\-/]\d{1,2}[月\-/]\d{1,2}日?\s*[-至—]\s*\d{4}[年\-/]\d{1,2}[月\-/]\d{1,2}日?)", r"(?U)报名时间[：:]\s*(\d{1,2}月\d{1,2}日\s*[-至—]\s*\d{1,2}月\d{1,2}日)", r"(?U)(\d{4}[年\-/]\d{1,2}[月\-/]\d{1,2}日?\s*[-至—]\s*\d{4}[年\-/]\d{1,2}[月\-/]\d{1,2}日?)\s*报名")),
    ),
    degree_alias={"博士": "博士", "博士研究生": "博士", "博士学位": "博士", "硕士": "硕士", "硕士研究生": "硕士", "研究生": "硕士", "研究生学历": "硕士", "本科": "本科", "本科学历": "本科", "学士": "本科", "专科": "专科", "大专": "专科", "高职": "专科"},
    priority_alias={"高": "high", "high": "high", "medium": "medium", "中": "medium", "普通": "medium", "一般": "medium", "low": "low", "低": "low"},
    stage_alias={"招聘启动": "招聘启动", "招聘启动中": "招聘启动", "公告发布": "招聘启动", "报名中": "招聘启动", "报名阶段": "招聘启动", "考试考核": "考试考核", "考试阶段": "考试考核", "笔试面试": "考试考核", "资格审查": "资格审查", "资格审核": "资格审查", "资格复审": "资格审查", "结果公示": "结果公示", "公示阶段": "结果公示", "拟聘用公示": "结果公示", "信息变更": "信息变更", "补充说明": "信息变更", "变更公告": "信息变更", "其他": "其他"},
    gender_alias={"男": "男", "男性": "男", "女": "女", "女性": "女", "不限": "不限", "男女不限": "不限", "性别不限": "不限", "男女分设": "分岗限制", "分岗限制": "分岗限制"},
    deadline_alias={"upcoming": "报名中", "未截止": "报名中", "进行中": "报名中", "报名中": "报名中", "closing_soon": "即将截止", "即将截止": "即将截止", "closed": "已截止", "已截止": "已截止", "截止": "已截止", "结束": "已截止"},
    header_alias={
        "岗位名称": ("岗位名称", "岗位", "招聘岗位", "岗位类别", "岗位名称及代码", "岗位代码及名称"),
        "招聘人数": ("招聘人数", "人数", "计划数", "需求人数", "招聘计划"),
        "学历要求": ("学历要求", "学历", "学位", "学历学位"),
        "专业要求": ("专业要求", "专业", "所学专业", "专业名称"),
        "工作地点": ("工作地点", "地点", "工作单位", "单位", "工作部门", "用人单位"),
    },
    job_names=("心理健康教育专职辅导员", "专职辅导员", "辅导员"),
    wording=Wording(
        job="岗位名称",
        headcount="招聘人数",
        education="学历要求",
        major="专业要求",
        place="工作地点",
        political="政治面貌",
        gender="性别要求",
        signup="报名时间",
        deadlines=("报名截止时间", "截止时间", "报名时间"),
        payload_gender=("性别要求", "性别"),
        exam="笔试",
        interview="面试",
        role_tag="辅导员相关",
        attachment_tag="含附件",
        of_event="这条信息归类为{}。",
        of_school="单位是{}。",
        of_city="地点偏向{}。",
        of_headcount="当前提取到招聘人数 {}。",
        of_education="学历要求是{}。",
        of_signup="报名时间是{}。",
        of_notice="这类信息更偏结果披露，适合归档，不一定需要持续盯。",
        role_evidence="辅导员岗位约 {} 人",
        deadline_evidence="报名节点：{}",
        education_evidence="学历：{}",
        unknown="未说明",
        deadline_status=("已截止", "即将截止", "报名中", "未说明"),
    ),
)

# A small profile in Latin script: the same operators on prose without this domain.
LATIN = RuleProfile(
    noise_texts=("All rights reserved.",),
    noise_prefixes=("Licensed under", "Released under"),
    role="token",
    dedicated_role="token =",
    role_exclude=(r"old\s+token",),
    body_include=(r"token = .{0,4}[0-9a-f]",),
    body_exclude=(r"without .{0,12}token",),
    event_rules=(("title", "licence", ("license", "rights reserved")), ("body", "contact", ("@mail",)), ("body", "secret", ("token", "password"))),
    event_default="other",
    notice_event="notice",
    cities=("the", "und", "que", "des"),
    job_names=("token keeper", "token"),
    mixed_role=(r"token,.{0,20}license",),
    dedicated_title=(r"call for .{0,12}token",),
    degree_alias={"de": "本科", "fr": "硕士", "es": "博士"},
    stage_of_event={"licence": "started", "contact": "running", "other": "other"},
    priority_alias={"1-URGENT": "high", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT_SPECIFIED": "low", "5-LOW": "low"},
)
