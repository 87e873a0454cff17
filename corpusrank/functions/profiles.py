"""Language profiles: the patterns, word lists and thresholds that the text operators take as parameters.

`ZH` has the fixed values for Chinese management books. `LATIN` has the same shape for space-separated
languages in Latin script. Patterns are Java regular expressions; NEXT stands where a cue must not be
followed by a word character.
"""

from __future__ import annotations

from dataclasses import dataclass, field

NEXT = r"(?![\p{L}\p{N}_])"


@dataclass(frozen=True)
class Profile:
    name: str
    script: str  # class of the characters that count as the profile's script
    sentence: str  # class of the characters that end a sentence
    separators: tuple[str, ...]  # of the recursive splitter, coarse to fine; "" is a single character
    chapter: str
    chapter_in_text: str
    section: str
    definition: str
    framework: str
    conclusion: str
    filter_definition: str
    filter_framework: str
    filter_conclusion: str
    lead_in: str
    case: str
    noise: str
    short_line: str  # what a line of two characters must be
    headers: tuple[str, ...]
    terms: tuple[str, ...]
    filter_terms: tuple[str, ...]
    stop_words: tuple[str, ...]
    question_types: dict[str, tuple[str, ...]]
    type_suffix: dict[str, str]
    comparison_tail: str
    comparison_split: str
    question_lead: str
    domain_words: tuple[str, ...]
    domain_suffix: str
    synonyms: dict[str, tuple[str, ...]] = field(default_factory=dict)
    dictionary: tuple[str, ...] = ()  # words that the tokenizer keeps whole
    query_instruction: str = ""  # what a model's encoder wants before a query
    paragraph: str = r"\n{2,}"
    distinct_share: float = 0.15  # least share of distinct characters in a chunk of over 20


# Fixed values -----------------------------------------------------------------------------------------------

#: Suffixes that mirror sites add to file names.
MIRROR_SITES = (
    r"\s*[-_]\s*z-library[^\s]*", r"\s*[-_]\s*z-lib[^\s]*", r"\s*[-_]\s*1lib[^\s]*", r"\s*[-_]\s*z\.library[^\s]*",
    r"\s*\(\s*z-library[^)]*\)", r"\s*\(\s*z-lib[^)]*\)", r"\s*\(\s*1lib[^)]*\)", r"\s*\(\s*etc\.[^)]*\)", r"\s*[-_]\s*etc[^_]*",
)
_ZH_CHAPTER = (
    r"^第[一二三四五六七八九十百千\d]+[章节讲]",
    r"^第[一二三四五六七八九十百千\d]+部分",
    r"^模块[一二三四五六七八九十\d]+",
    r"^(?i:Chapter\s+\d+)",
    r"^(?i:Part\s+\d+)",
)
_ZH_CHAPTER_IN_TEXT = (
    r"^第[一二三四五六七八九十百千\d]+[章节讲]",
    r"^第[一二三四五六七八九十百千\d]+部分",
    r"^模块[一二三四五六七八九十\d]+",
    r"^\d{1,2}\s",
    r"^(?i:Chapter\s+\d+)",
    r"^(?i:Part\s+\d+)",
    "^导读",
    "^前言",
    "^序言",
    "^绪论",
)
_ZH_SECTION = (r"^\d+\.\d+", "^[一二三四五六七八九十]、", r"^\(\d+\)", "^[（(][一二三四五六七八九十][）)]")
_ZH_DEFINITION = ("是指", "定义为?", "核心是", "本质是", "所谓", "指的是", "就是", "可以理解为", "被定义为")
_ZH_FRAMEWORK = (
    "包括以下(?:几个)?(?:方面|部分|要素|维度|层次|类型|阶段)",
    "主要(?:有|包括|分为|包含)",
    "分为" + NEXT,
    "包含" + NEXT + ".{0,5}(?:方面|部分|要素|类型|阶段)",
    "由" + NEXT + ".{2,8}组成",
    "由" + NEXT + ".{2,8}构成",
    "(?:三大|四大|五大|六大|七个|八个|九个|十个)" + NEXT,
    "几[个种类型]",
)
_ZH_CONCLUSION = ("因此[，,]?", "总之[，,]?", "综上(?:所述)?[，,]?", "可见[，,]?", "由此可见", "总的来说[，,]?", "一言以蔽之", "简而言之", "这表明", "这意味(?:着)?")
_ZH_FILTER_DEFINITION = ("是指", "定义为?", "核心是", "本质是", "所谓", "指的是", "就是")
_ZH_FILTER_FRAMEWORK = (
    "包括以下(?:几个)?(?:方面|部分|要素|维度|类型|阶段)",
    "主要(?:有|包括|分为|包含)",
    "分为" + NEXT,
    "由" + NEXT + ".{2,8}组成",
    "(?:三大|四大|五大|六大|七个|八个|九个|十个)" + NEXT,
)
_ZH_FILTER_CONCLUSION = ("因此[，,]?", "总之[，,]?", "综上(?:所述)?[，,]?", "可见[，,]?", "总的来说[，,]?")
_ZH_LEAD_IN = (r"^比如[，,]?\s", r"^例如[，,]?\s", "^举例来说", "^以.{1,8}为例", r"^如表\d", r"^如图\d", r"^见表\d", r"^见图\d", "^资料来源[：:]")
_ZH_CASE = (r"^比如[，,]?\s", r"^例如[，,]?\s", "^举例来说", r"^以.{1,8}为例", "^案例[：:]")
_ZH_NOISE = (
    r"ISBN[=\s]*[\d\-Xx]+", r"书\s*号[：:]\s*ISBN", r"SS号[=＝]\d+", r"出版日期[=＝]\d{4}", "出版社[=＝]", r"定价[：:]\s*[\d.]+元", r"字数[=＝]\d+",
    r"\[General\s+Information\]", r"版权所有[,，]\s*翻[印版]必究", "^未经.{0,10}允许[,，].{0,10}不得.{0,10}复制", r"Table\s+of\s+Contents", "^图书在版编目",
    r"^CIP\s*数据", "责任编辑[：:]", "^见习编辑[：:]", "^装帧设计[：:]", "^出版发行[：:]", "^客服热线[：:]", "^客服信箱[：:]", "^官方网址[：:]",
    r"^新浪微博\s*@", "^微信公众号[：:]", "^微信号[：:]", "^Http://", r"^邮编[：:]\s*\d{6}", r"^地址[：:]\s*[\x{4e00}-\x{9fff}]+\d+号",
    '本书由.{0,6}"[^"]*".{0,20}整理', "加小编微信或QQ[：:]", "小编也和结交一些喜欢读书", "关注小编个人微信公众号", "电子书下载网站",
    r"周读\s+网址[：:]", r"ireadweek\.com", "^版本图书馆", "^责任校对[：:]", "^封面设计[：:]", r"^版次[：:]\s*\d{4}", r"^印次[：:]\s*\d{4}", "^印张[：:]",
    "^开本[：:]", r"^书\s*名[：:]", r"^作\s*者[：:]", r"^译\s*者[：:]", r"^编\s*著[：:]", r"^著\s*者[：:]", r"^I\s*S\s*B\s*N", "^侵权必究",
    "^华章分社", "^华章数媒", "^华章电子书", "^全球范围内制作与发行", "^北京华章图文", "^北京奥维博世", "^机械工业出版社", "^古吴轩出版社",
    r"^ISBN\s*978", r"^\d{4}年\d{1,2}月.{0,5}版$", r"^\d{4}年\d{1,2}月.{0,5}次印刷$",
)
_ZH_HEADERS = ("中国人民大学出版社", "高等教育出版社", "清华大学出版社", "中信出版社", "北京大学出版社")
_ZH_TERMS = (
    "管理", "组织", "领导", "决策", "战略", "规划", "控制", "激励", "沟通", "协调", "授权", "目标", "绩效", "文化", "变革", "创新", "竞争", "营销", "人力资源", "财务", "运营", "供应链", "质量",
    "效率", "效能", "执行力", "团队", "协作", "流程", "标准化", "泰勒", "法约尔", "韦伯", "德鲁克", "马斯洛", "波特", "梅奥", "SWOT", "KPI", "OKR", "MBO", "TQM", "JIT", "MVP",
    "科学管理", "行为科学", "人际关系", "权变理论", "系统理论", "目标管理", "知识管理", "项目管理", "时间管理", "危机管理", "组织行为", "组织结构", "组织文化", "组织变革", "领导力", "领导风格", "领导理论", "竞争优势",
    "核心竞争力", "差异化", "成本领先", "市场细分", "目标市场", "市场定位", "4P", "营销组合", "需求层次", "双因素", "期望理论", "公平理论", "精益", "六西格玛", "敏捷", "迭代",
)
_ZH_FILTER_TERMS = (
    "管理", "组织", "领导", "决策", "战略", "规划", "控制", "激励", "沟通", "协调", "授权", "目标", "绩效", "文化", "变革", "创新", "竞争", "营销", "人力资源", "财务", "运营", "供应链", "质量",
    "效率", "效能", "执行力", "团队", "协作", "流程", "标准化", "泰勒", "法约尔", "韦伯", "德鲁克", "马斯洛", "波特", "梅奥", "SWOT", "KPI", "OKR", "MBO", "TQM", "JIT", "MVP",
    "科学管理", "行为科学", "权变理论", "系统理论", "目标管理", "知识管理", "项目管理", "时间管理", "危机管理", "组织行为", "组织结构", "组织文化", "组织变革", "领导力", "领导风格", "领导理论", "竞争优势",
    "核心竞争力", "差异化", "成本领先", "市场细分", "目标市场", "市场定位", "4P", "营销组合", "需求层次", "双因素", "期望理论", "公平理论", "精益", "六西格玛", "敏捷", "迭代",
)
_ZH_STOP = (
    "的", "了", "是", "在", "和", "与", "或", "吗", "呢", "吧", "啊", "什么", "怎么", "如何", "哪些", "哪个", "有", "这", "那", "就", "也", "都", "而", "及", "等", "着", "被", "把",
    "让", "给", "不", "从", "到", "对", "为", "以", "要", "会", "能", "可以", "一个", "一种", "这个", "那个", "我们", "他们", "进行", "通过", "主要", "包括", "其中", "方面", "之间",
    "所以", "因为", "但是", "还是", "然后", "以及", "不过", "如果", "虽然", "因此", "于是",
)
_ZH_DICTIONARY = (
    "科学管理", "行为科学", "人际关系学派", "权变理论", "系统理论", "目标管理", "知识管理", "项目管理", "时间管理", "危机管理", "8020法则", "关键跨越", "精益创业", "最小可行产品", "管理思想史", "管理学原理",
    "公共管理", "行政学", "雷恩", "贝德安", "任正非", "华为管理法", "科克", "柯林斯", "德鲁克", "彼得斯", "产品思维", "用户体验", "商业模式画布", "增长黑客", "数据驱动", "数字化转型",
)
_ZH_SYNONYMS = {
    "核心思想": ("管理理念", "管理原理", "管理基本原则", "管理学核心", "根本思想",),
    "核心": ("基本原理", "核心理念", "基础理论", "根本", "关键",),
    "思想": ("理论", "观点", "理念", "学说", "主张",),
    "战略": ("战略管理", "竞争策略", "战略规划", "战略思维",),
    "领导": ("领导力", "管理风格", "领导方式", "领导理论",),
    "领导力": ("领导", "管理风格", "领导方式", "领导理论", "领导行为", "影响力",),
    "组织": ("组织结构", "组织管理", "组织设计", "组织行为",),
    "人力": ("人力资源", "员工管理", "人事管理", "人才管理",),
    "营销": ("市场营销", "营销策略", "市场推广", "营销管理",),
    "财务": ("财务管理", "资金管理", "财务决策", "财务分析",),
    "运营": ("运营管理", "生产管理", "运作管理", "流程管理",),
    "沟通": ("管理沟通", "交流技巧", "信息传递", "协调",),
    "文化": ("组织文化", "企业文化", "价值观", "文化氛围",),
    "创新": ("创新管理", "变革管理", "组织变革", "持续创新",),
    "决策": ("管理决策", "决策理论", "决策过程", "决策方法",),
    "目标": ("组织目标", "目标管理", "战略目标", "绩效目标",),
    "管理": ("管理学", "管理理论", "管理方法", "管理实践", "经营管理",),
    "理论": ("学说", "原理", "方法论", "框架", "模型",),
    "分析": ("评估", "研究", "考察", "诊断",),
    "方法": ("方式", "手段", "途径", "工具", "技术",),
    "管理类": ("管理学", "管理学知识", "管理学科",),
    "霍桑": ("梅奥", "人际关系", "行为科学", "非正式组织",),
    "SWOT": ("优势劣势机会威胁", "战略分析", "态势分析",),
    "波特": ("五力模型", "竞争分析", "行业结构", "竞争战略",),
    "4P": ("营销组合", "产品价格渠道促销", "营销策略",),
    "精益": ("精益生产", "丰田", "JIT", "准时制", "消除浪费",),
    "法约尔": ("一般管理", "管理职能", "十四条", "管理原则",),
    "OKR": ("目标与关键结果", "关键结果", "目标管理", "OKR工作法",),
    "德鲁克": ("卓有成效", "知识工作者", "目标管理", "管理实践", "现代管理学",),
    "华为": ("任正非", "华为管理法", "狼性文化", "以奋斗者为本",),
    "小团队": ("小团队管理", "团队管理", "主管", "基层管理",),
    "基业长青": ("愿景", "核心价值观", "造钟", "高瞻远瞩", "长青企业", "持久成功", "卓越公司",),
    "8020": ("帕累托", "二八法则", "关键少数", "80/20", "高效管理", "科克", "效率法则",),
    "跨越": ("关键跨越", "新手主管", "管理者转型", "业务高手",),
    "效能": ("效率", "卓有成效", "时间管理", "要事优先",),
    "卓有成效": ("德鲁克", "管理者", "知识工作者", "时间管理", "决策", "有效性",),
    "执行力": ("管理思维", "团队执行", "落实", "行动力",),
    "泰勒": ("科学管理", "时间研究", "动作研究", "泰罗", "管理思想史", "雷恩",),
    "精益创业": ("精益", "创业管理", "MVP", "最小可行产品", "转型", "开发测量认知",),
    "创业": ("精益创业", "创业管理", "创新", "增长", "商业模式",),
    "管理思想史": ("管理学史", "管理理论演变", "泰罗", "法约尔", "人际关系学派", "雷恩", "贝德安",),
    "变革": ("组织变革", "变革管理", "创新管理", "持续改进",),
    "科学管理": ("泰勒制", "泰罗", "时间动作", "标准化", "工时定额", "管理思想史",),
    "公共管理": ("行政学", "公共行政", "官僚制", "韦伯", "新公共管理",),
    "竞争": ("竞争战略", "竞争优势", "竞争分析", "行业竞争",),
    "产品": ("产品思维", "产品管理", "产品设计", "用户体验",),
    "激励": ("动机", "需求", "奖励", "驱动力", "马斯洛",),
    "规划": ("战略规划", "计划", "目标设定", "长期规划",),
    "绩效": ("绩效考核", "绩效管理", "KPI", "评估",),
    "团队": ("团队管理", "团队建设", "协作", "团队合作",),
    "控制": ("管理控制", "监控", "反馈", "纠偏",),
    "计划": ("规划", "目标设定", "战略计划", "行动计划",),
    "组织行为": ("组织行为学", "个体行为", "群体行为", "组织文化",),
    "市场营销": ("营销管理", "市场分析", "消费者行为", "营销战略",),
    "人力资源": ("HRM", "员工管理", "招聘", "培训", "薪酬",),
    "知识管理": ("知识经济", "知识工作者", "学习型组织",),
    "质量管理": ("TQM", "六西格玛", "持续改进", "戴明",),
    "项目管理": ("项目规划", "项目执行", "项目控制", "PMBOK",),
    "管理者": ("卓有成效", "管理实践", "德鲁克", "主管", "领导",),
    "长青": ("基业长青", "持久", "可持续发展", "核心价值观",),
    "法則": ("法则", "8020", "帕累托", "二八",),
    "管理史": ("管理思想史", "管理学发展", "管理理论演变",),
}
_ZH_INSTRUCTION = "为这个句子生成表示以用于检索相关文章："
_ZH_TYPES = {
    "definition": ("是什么", "定义", "含义", "概念", "什么意思"),
    "comparison": ("区别", "差异", "比较", "vs", "versus", "异同", "不同"),
    "method": ("步骤", "方法", "流程", "如何", "怎么做", "怎样"),
    "cause": ("原因", "为什么", "因素", "影响", "导致"),
    "case": ("例子", "案例", "举例", "实例"),
}
_ZH_SUFFIX = {"definition": "概念 定义 含义", "comparison": "异同 对比分析 区别", "method": "步骤 流程 方法", "cause": "原因 因素 影响"}
_ZH_TAIL = "(有什么|有何|是什么|的异同|的核心差异|的主要区别|的适用条件有何不同|的核心差异是什么|的主要区别是什么)$"


def _any(parts, after: str = "") -> str:
    return "|".join(f"(?:{p}){after}" for p in parts)


ZH = Profile(
    name="zh",
    script=r"[\x{4e00}-\x{9fff}]",
    sentence="[。！？；]",
    separators=("\n\n", "\n", "。", "；", "！", "？", "……", "，", " ", ""),
    chapter=_any(_ZH_CHAPTER),
    chapter_in_text=_any(_ZH_CHAPTER_IN_TEXT),
    section=_any(_ZH_SECTION),
    definition=_any(_ZH_DEFINITION, NEXT),
    framework=_any(_ZH_FRAMEWORK),
    conclusion=_any(_ZH_CONCLUSION, NEXT),
    filter_definition=_any(_ZH_FILTER_DEFINITION, NEXT),
    filter_framework=_any(_ZH_FILTER_FRAMEWORK),
    filter_conclusion=_any(_ZH_FILTER_CONCLUSION, NEXT),
    lead_in=_any(_ZH_LEAD_IN),
    case=_any(_ZH_CASE),
    noise=f"(?i){_any(_ZH_NOISE)}",
    short_line=r"^[\x{4e00}-\x{9fff}]{2}$",
    headers=_ZH_HEADERS,
    terms=_ZH_TERMS,
    filter_terms=_ZH_FILTER_TERMS,
    stop_words=_ZH_STOP,
    question_types=_ZH_TYPES,
    type_suffix=_ZH_SUFFIX,
    comparison_tail=_ZH_TAIL,
    comparison_split="和|与|及|以及|、",
    question_lead="^(什么是|什么叫|如何|怎么)",
    domain_words=("管理", "理论", "方法"),
    domain_suffix="管理",
    synonyms=_ZH_SYNONYMS,
    dictionary=_ZH_DICTIONARY,
    query_instruction=_ZH_INSTRUCTION,
)

# Own values for Latin script --------------------------------------------------------------------------------

# Cue phrases first; the bare connectives after them stand for cues in texts of invented words.
_LATIN_DEFINITION = (
    r"(?i)(^|[^\p{L}])(is defined as|is called|refers to|means that|wird definiert als|bezeichnet|se define como|se refiere a|se llama|est défini comme|désigne|on appelle|that|dass|que|of) "
)
_LATIN_FRAMEWORK = (
    r"(?i)(^|[^\p{L}])(consists of|is divided into|includes the following|besteht aus|gliedert sich in|umfasst|se compone de|se divide en|comprend|se compose de|and|und|y|et) "
)
_LATIN_CONCLUSION = r"(?i)(^|[^\p{L}])(therefore|in conclusion|in short|this shows|daher|folglich|zusammenfassend|por lo tanto|en resumen|donc|en conclusion|en résumé|for|aber|para|pour) "

LATIN = Profile(
    name="latin",
    script=r"\p{L}",
    sentence="[.!?;]",
    separators=("\n\n", "\n", ". ", "; ", "! ", "? ", ", ", " ", ""),
    chapter=r"^\p{Lu}[^.!?|]{2,40}\.$",
    chapter_in_text=r"^\p{Lu}[^.!?|]{2,40}\.$",
    section=r"^\p{Lu}[^.!?]{2,60}\.$",
    definition=_LATIN_DEFINITION,
    framework=_LATIN_FRAMEWORK,
    conclusion=_LATIN_CONCLUSION,
    filter_definition=_LATIN_DEFINITION,
    filter_framework=_LATIN_FRAMEWORK,
    filter_conclusion=_LATIN_CONCLUSION,
    lead_in=r"^[\p{Ll}\d]",
    case=r"^[\p{Ll}\d]",
    noise=r"(?i)https?://|licen[cs]e|copyright|\|.*\|.*\||[$%&#*]{3}",
    short_line=r"^\p{Lu}{2}$",
    headers=(),
    terms=("the", "ing", "tion", "ver", "lich", "ment", "que", "ción", "los", "der", "und", "les"),
    filter_terms=("the", "ing", "tion", "ver", "lich", "ment", "que", "ción", "los", "der", "und", "les"),
    stop_words=("the", "of", "and", "to", "in", "that", "it", "is", "der", "die", "und", "das", "de", "la", "que", "el", "en", "y", "le", "les", "et", "des"),
    question_types={
        "definition": ("tion", "lich"), "comparison": ("than", "als"), "method": ("with", "mit"), "cause": ("for", "por"), "case": ("on", "un"),
    },
    type_suffix={"definition": "that of", "comparison": "than or", "method": "with by", "cause": "for as"},
    comparison_tail=r"( was| it)$",
    comparison_split=" and | und | y | et ",
    question_lead="^(the |der |la |le )",
    domain_words=("the", "und", "que", "les"),
    domain_suffix="the",
    synonyms={"the": ("der", "la"), "and": ("und", "et"), "with": ("mit",), "for": ("por", "pour")},
    paragraph=r"\n+",
    distinct_share=0.02,
)

PROFILES = {p.name: p for p in (ZH, LATIN)}
