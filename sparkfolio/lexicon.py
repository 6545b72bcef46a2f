"""Word lists, patterns and limits used by every operator.

Fixed values: the entries below decide results, so they are listed plainly and
are never generated, shuffled or encoded.
"""

# --- fixed values: question understanding ---------------------------------------------
FOCUS_STOP_WORDS = (
    "什么", "哪些", "哪个", "那个", "这个", "一下", "一些", "其中", "对于", "相关", "关于", "有关", "内容",
    "文档", "资料", "介绍", "说明", "总结", "概述", "一下子", "请问", "你好", "您好", "可以", "是否",
    "怎么", "如何", "为什么", "原因", "原理", "机制", "作用", "用途", "功能", "区别", "比较", "对比",
    "流程", "步骤", "实现", "定义", "概念", "方法", "情况", "一下吗", "一下呢",
    "补充要求", "详细", "具体", "展开", "继续", "细一点", "详细一点", "具体一点",
)
EXPLANATION_SIGNALS = ("原因", "因为", "导致", "所以", "由于", "为了", "通过", "原理", "机制")
COMPARE_SIGNALS = ("区别", "不同", "差异", "相比", "而", "则", "一方面", "另一方面")
COMPOSITION_SIGNALS = (
    "组成", "构成", "包括", "包含", "模块", "架构", "技术栈", "前后端", "配置", "条件", "环境", "硬件", "软件", "接口",
)
DEFINITION_SIGNALS = ("是一种", "是指", "作为", "选用", "采用", "负责", "用于", "核心", "模块")
PROCEDURE_SIGNALS = ("步骤", "流程", "首先", "然后", "最后", "实现", "方法", "过程")
MODULE_IMPLEMENTATION_SIGNALS = (
    "连接", "通信", "上传", "下发", "展示", "显示", "设定", "触发", "指令", "链路", "协议", "服务器", "app", "json",
)
USAGE_SIGNALS = ("用于", "作用", "用途", "负责", "实现", "控制", "采集", "识别", "管理")
EXPANSION_ONLY_EXTRA = ("原因", "机制", "原理", "定义", "方法", "步骤", "流程", "架构")
RELEVANCE_EXPANSION_ONLY = (
    "overview", "summary", "abstract", "摘要", "概述", "引言", "结论", "主要内容", "定义", "机制",
    "流程", "步骤", "模块", "接口", "作用", "用途", "功能",
)
DETAIL_SIGNALS = (
    "详细", "具体", "展开", "细说", "详述", "全面", "细一点", "详细一点", "具体一点", "展开讲", "展开说",
    "多说", "讲讲", "说说", "主要写什么", "主要内容", "主要讲", "从哪些方面",
)
SUPPLEMENTAL_REQUEST_SIGNALS = (
    "补充要求", "详细一点", "具体一点", "展开一点", "展开说", "展开讲", "细一点", "继续", "再说", "多说", "讲讲", "说说",
)
FOLLOW_UP_EXTRA = ("具体呢",)
ENGLISH_METADATA_SIGNALS = (
    "英文标题", "英文摘要", "英文关键词", "english title", "english abstract", "english keywords",
)
ENGLISH_METADATA_FIELDS = ("englishtitle", "englishabstract", "englishkeywords")
NEGATIVE_DIRECTIVES = ("不要", "别", "无需", "不用")
NO_KEYWORD_LEAD = ("不要直接抄英文摘要", "不要直接抄关键词", "不要抄英文摘要", "不要抄关键词")
SUMMARY_QUESTION = (
    "总结", "概述", "综述", "主要写什么", "主要写的是什么", "主要写的是啥", "主要内容", "主要讲",
    "论文主要写", "文章主要写", "文档主要写", "讲了什么", "说了什么",
)
COMPARE_QUESTION = ("区别", "对比", "比较")
EXPLAIN_QUESTION = ("为什么", "原因", "原理", "机制")
MODULE_QUESTION = ("模块", "功能模块", "有哪些功能", "系统功能")
MODULE_SUBJECT = ("模块", "功能", "接口", "链路", "通信")
MODULE_VERB = ("怎么", "如何", "实现", "流程", "设计")
COMPOSITION_QUESTION = (
    "组成", "构成", "包括哪些", "包含哪些", "由哪些", "有哪些部分", "有哪些模块", "硬件组成", "软件组成",
    "硬件条件", "软件条件", "系统配置", "部署环境", "实验环境", "运行环境", "实施条件", "技术栈", "总体架构",
    "架构和技术栈", "前后端分离", "采用了什么架构", "采用了哪些技术",
)
COMPOSITION_CONTEXT = (
    "硬件", "软件", "架构", "技术栈", "前后端", "模块", "组成", "构成", "配置", "条件", "环境", "接口", "参数", "依赖",
)
NON_COMPOSITION_ATTRIBUTES = ("效果", "性能", "表现", "体验", "评价", "口碑", "结论")
HOW_IS_IT = ("怎么样", "怎样的")
PROCEDURE_QUESTION = (
    "如何", "步骤", "流程", "怎么做", "怎么实现", "怎么控制", "怎么完成", "怎么处理", "怎么设计", "怎么搭建",
    "怎么部署", "怎么进行", "怎么安装", "怎么使用", "怎么办",
)
USAGE_QUESTION = ("作用", "用途", "功能", "有什么用")
DEFINITION_QUESTION = ("是什么", "指什么", "定义")
ACTIVE_SCOPE_PHRASES = ("这篇", "该文档", "文档里", "文中", "这个系统", "详细一点", "具体一点")
PAPER_QUESTION = ("论文", "文章", "文中", "本文", "这篇文档", "这篇研究", "这篇")
PAPER_SUMMARY = ("主要写了什么", "主要内容", "讲了什么")
PAPER_CONTRIBUTION = ("创新点", "创新", "贡献", "启示", "作用")
PAPER_LIMITATION = ("局限", "不足", "挑战", "问题", "反思", "未来")
PAPER_CHALLENGE = ("问题", "挑战", "局限", "不足")
PAPER_FUTURE = ("未来", "路径", "改进", "走向")
PAPER_SYSTEM = ("系统", "架构", "技术栈", "模块", "方法", "实现", "流程")
GENERIC_ENTITY_STOP_WORDS = (
    "系统", "模块", "功能模块", "这个系统", "该系统", "本文", "文中", "论文", "研究", "设计", "实现", "方法",
    "主要模块", "总体架构", "系统架构", "技术栈", "组成", "包括", "包含", "数据", "信息", "内容", "平台", "工具",
)

# Synonym groups added to retrieval terms. Each row is
# (intents that trigger it, substrings of the question that trigger it, added terms).
EXPANSION_RULES = (
    (("summary",), ("主要写了什么", "主要内容"),
     ("overview", "summary", "abstract", "摘要", "概述", "引言", "结论", "主要内容")),
    ((), ("创新点", "创新", "贡献"),
     ("创新点", "创新", "贡献", "提出", "改进", "优势")),
    ((), ("局限", "不足", "挑战", "问题", "启示", "未来", "反思"),
     ("局限", "不足", "挑战", "问题", "未来", "改进", "研究局限", "反思")),
    ((), ("架构", "技术栈", "总体设计", "前后端"),
     ("架构", "系统架构", "总体架构", "总体设计", "技术栈", "前后端分离", "后端", "前端", "数据库", "可视化", "模块", "接口")),
    ((), ("硬件",),
     ("硬件设计", "主控", "主控芯片", "传感器", "通信", "显示", "电源", "接口")),
    ((), ("软件", "运行环境", "部署环境"),
     ("软件设计", "运行环境", "部署环境", "依赖", "模块", "配置")),
    (("definition",), ("是什么", "指什么", "定义"),
     ("定义", "是指", "是一种", "作为", "用于", "负责", "核心")),
    (("explain",), ("为什么", "原理", "机制"),
     ("原因", "机制", "原理", "由于", "因为", "因此", "影响", "动态调节")),
    (("compare",), ("区别", "对比", "比较"),
     ("区别", "差异", "不同", "对比", "相比", "阶段")),
    (("procedure",), (),
     ("步骤", "流程", "策略", "机制", "算法", "反馈", "输入", "输出", "执行")),
    ((), MODULE_QUESTION,
     ("模块", "功能模块", "功能", "组成", "职责")),
    ((), ENGLISH_METADATA_SIGNALS,
     ("englishtitle", "englishabstract", "englishkeywords", "english")),
    (("module_implementation",), ("远程", "状态显示", "控制模块"),
     ("接口", "协议", "通信", "链路", "上传", "下发", "显示", "控制")),
    (("usage",), ("作用", "用途", "功能"),
     ("用于", "负责", "显示", "控制", "采集")),
)

# --- fixed values: chunk scoring ------------------------------------------------------------
PROCEDURE_SECTION_TERMS = (
    "控制", "调节", "补偿", "策略", "机制", "阶段", "执行", "算法", "传感器", "驱动", "检测", "采集", "设定", "阈值",
)
OVERVIEW_SECTION_TERMS = ("workflow", "overview", "概述", "总体")
PROCEDURE_QUALITY_SIGNALS = (
    "输入", "前提", "处理", "执行", "输出", "结果", "控制", "调节", "机制", "策略",
    "算法", "反馈", "误差", "驱动", "补偿", "判断", "计算", "生成", "监测", "模型",
)
SUMMARY_SUPPORT_SIGNALS = (
    "数据采集", "决策控制", "执行机构", "交互显示", "workflow", "架构", "模块", "结论", "测试", "感知", "决策", "执行",
)
SUMMARY_CONTEXT_SIGNALS = ("摘要", "概述", "overview", "结论", "架构")
ARCHITECTURE_SIGNALS = (
    "核心", "控制", "采集", "执行", "显示", "通信", "调度", "模块", "架构", "层", "接口", "数据", "状态", "参数",
)
SYSTEM_MODULE_SIGNALS = (
    "功能模块", "模块", "子系统", "功能", "组件", "组成", "接口", "服务",
    "管理", "展示", "分析", "处理", "检索", "抽取", "控制", "可视化",
)
COMPOSITION_STRUCTURE_SIGNALS = (
    "组成", "构成", "包括", "包含", "模块", "架构", "配置", "条件", "环境", "硬件", "软件", "接口", "依赖",
    "实验环境", "运行环境", "部署环境",
)
PROCEDURE_STRUCTURE_SIGNALS = (
    "感知", "决策", "执行", "交互", "流程", "步骤", "控制", "调节", "算法", "模块", "策略",
)
METHOD_SIGNALS = ("采用", "通过", "结合", "根据", "实时", "动态", "驱动", "调节", "控制", "监测", "反馈")
SUMMARY_SIGNALS = (
    "围绕", "面向", "针对", "提出", "设计", "实现", "构建", "搭建", "分析", "总结",
    "介绍", "包括", "主要", "核心", "模块", "架构", "方法", "流程", "结果", "结论",
)
SUMMARY_STRUCTURE_SIGNALS = (
    "摘要", "abstract", "overview", "architecture", "workflow", "概述", "总结", "引言", "简介",
    "系统", "总体设计", "架构", "设计", "方法", "实现", "结果", "结论", "模块", "测试", "评估", "创新",
)
SUMMARY_SUPPORT_SENTENCE_SIGNALS = (
    "目标", "问题", "系统", "架构", "模块", "方法", "算法", "机制", "策略", "控制",
    "流程", "执行", "驱动", "显示", "交互", "结果", "效果", "测试", "验证", "提升",
)
SUMMARY_LABEL_GROUPS = (
    ("目标", ("目标", "问题", "面向", "针对", "背景")),
    ("系统设计", ("系统", "架构", "模块", "组成", "层", "平台")),
    ("控制方法", ("方法", "算法", "模型", "机制", "策略", "控制", "流程")),
    ("模块流程", ("显示", "交互", "接口", "通信", "上传", "下发", "执行", "驱动")),
    ("效果", ("结果", "效果", "测试", "验证", "提升", "降低", "减少", "评估", "结论")),
)
PROCEDURE_INPUT = ("输入", "前提", "条件", "数据", "参数", "采集", "获取", "来源", "准备")
PROCEDURE_PROCESS = (
    "判断", "计算", "分析", "处理", "算法", "规则", "策略", "生成", "调节", "控制", "匹配", "根据", "结合",
)
PROCEDURE_ACTION = (
    "执行", "输出", "驱动", "调用", "写入", "发送", "上传", "下发", "展示", "显示", "保存", "触发", "连接",
)
PROCEDURE_RESULT = (
    "结果", "效果", "最终", "实现", "完成", "提升", "降低", "减少", "控制在", "验证", "测试", "稳定",
)
EXPLAIN_REASON = ("原因", "由于", "因为", "为了", "前提", "条件", "影响", "需要")
EXPLAIN_MECHANISM = ("机制", "通过", "结合", "根据", "动态", "调整", "处理", "策略", "模型", "规则")
EXPLAIN_IMPACT = ("结果", "影响", "因此", "从而", "避免", "提升", "降低", "减少", "效果", "稳定")
PROCEDURE_ANCHOR_TERMS = (
    "流程", "步骤", "阶段", "过程", "策略", "机制", "方法", "算法", "控制", "处理", "执行", "实现",
)
PROCEDURE_CHAPTER_SIGNALS = ("阶段", "策略", "机制", "补偿", "调节", "控制")
PARAMETER_SIGNALS = (
    "mhz", "kb", "sram", "flash", "adc", "i²c", "spi", "usart", "dma", "μa", "ma",
    "v", "fps", "bps", "ms", "l/min", "cortex", "risc", "flash", "oled", "wifi",
)
FRAGMENT_LIST_SIGNALS = ("包括", "包含", "由", "组成", "构成")
FRAGMENT_PREDICATE_SIGNALS = (
    "包括", "包含", "采用", "选用", "负责", "实现", "用于", "连接", "采集", "控制", "显示", "上传", "下发", "组成", "构成",
)
HEADING_SIGNALS = (
    "摘要", "引言", "绪论", "方法", "系统", "设计", "实现", "实验", "结果", "讨论", "结论", "模块", "架构", "流程",
)

# --- fixed values: answer checks --------------------------------------------------------------
REFUSAL_PHRASES = ("我不知道", "当前文档未覆盖", "未找到相关信息")
TEMPLATE_LEAK_PHRASES = ("problem:", "constraints:", "approach:", "nums =", "target =", "two numbers")
LONG_ANSWER_QUESTIONS = ("为什么", "如何", "怎么", "总结", "概述")
ENGLISH_FIELD_QUESTIONS = ("英文标题", "英文摘要", "英文关键词")
GENERIC_USAGE_PHRASES = (
    "作为核心", "发挥作用", "核心单片机", "主要作用", "主要作为", "在系统中发挥", "在智能系统设计中",
)
USAGE_BULLETS = ("1.", "2.", "①", "②", "•")
ABSTRACT_PHRASES = ("was designed", "system based on", "implemented", "is proposed", "is used")
MODULE_ANSWER_SHAPE = (
    "通过", "采用", "连接", "接口", "协议", "通信", "链路", "上传", "下发", "显示", "控制", "实现", "处理", "调用", "模块",
)
UNKNOWN_ANSWER_PHRASES = (
    "我不知道", "当前文档未覆盖", "未找到", "未提及", "未涉及", "没有写", "没有提到", "没有提及", "没有涉及",
)
UNKNOWN_EXPECTATION_PHRASES = ("我不知道", "未覆盖", "未提及")
DENIAL_PHRASES = (
    "未找到", "未提及", "未涉及", "没有写", "没有提到", "没有提及", "没有涉及", "无相关", "不包含",
)
WIRELESS_TOPIC = ("蓝牙", "bluetooth", "mesh")

# --- fixed values: structured sources --------------------------------------------------------
SUPPORTED_EXTENSIONS = (".md", ".txt", ".json")
IGNORED_PREFIXES = ("QA/",)
JSON_IGNORED_FIELDS = ("classificationnumber", "documentidentifier", "articlenumber", "doi")
JSON_PRIORITY_FIELDS = (
    "title", "titleen", "title_en", "documenttitle", "document_title", "name", "nameen", "name_en",
    "englishtitle", "english_title", "abstract", "abstracten", "abstract_en", "summary", "summaryen",
    "summary_en", "overview", "englishabstract", "english_abstract", "keywords", "keywordsen", "keywords_en",
    "englishkeywords", "english_keywords", "content", "architecture", "workflow",
)
JSON_ITEM_LABEL_FIELDS = (
    "title", "title_en", "titleen", "name", "name_en", "nameen", "label", "module", "section", "step",
    "stage", "type", "id",
)
JSON_TITLE_FIELDS = (
    "title", "title_en", "titleen", "documentTitle", "document_title", "name", "name_en", "nameen",
    "englishTitle", "english_title",
)
JSON_SUMMARY_FIELDS = (
    "abstract", "abstract_en", "abstracten", "summary", "summary_en", "summaryen", "overview",
    "englishAbstract", "english_abstract",
)
JSON_KEYWORD_FIELDS = ("keywords", "keywords_en", "keywordsen", "englishKeywords", "english_keywords")
JSON_METADATA_FIELDS = (
    "authors", "author", "authorinfo", "affiliation", "englishaffiliation", "funding", "references",
    "reference", "citations", "citation",
)
METADATA_PATH_TERMS = ("author", "affiliation", "funding", "acknowledgements", "article_info")
REFERENCE_PATH_TERMS = ("reference", "citation", "参考文献")
METADATA_SENTENCE_TERMS = ("关键词", "中图分类号", "文献标识码", "文章编号")
TITLE_MULTIPLIER = {
    "title": 1.35, "summary": 1.15, "abstract": 1.05, "intro": 0.8, "conclusion": 0.8, "keyword": 1.2,
    "metadata": 0.55, "reference": 0.1, "noise": 0.1,
}
STRUCTURE_MULTIPLIER = {
    "summary": 1.1, "abstract": 1.05, "intro": 0.75, "conclusion": 0.75, "body": 1.0, "": 1.0, "keyword": 0.9,
    "title": 0.7, "metadata": 0.15, "reference": 0.05, "noise": 0.05,
}

# --- fixed values: templates -----------------------------------------------------------------
STYLE_IDS = {
    "heading1": "Heading1", "heading2": "Heading2", "heading3": "Heading3", "heading4": "Heading4",
    "heading5": "Heading5", "heading6": "Heading6", "body": "Normal", "caption": "Caption",
    "footnote": "FootnoteText", "reference": "Reference", "abstract": "Abstract",
    "blockquote": "Blockquote", "list": "ListParagraph", "codeblock": "CodeBlock",
}
FRONT_MATTER_PREFIXES = (
    "摘要", "【摘要】", "Abstract", "内容提要", "关键词", "【关键词】", "Key words", "Keywords", "DOI",
    "中图分类号", "文献标识码", "文献标志码", "文章编号",
)
CAPTION_PREFIXES = ("表", "Table")
EAST_ASIA_FONTS = {
    "宋体": "SimSun", "新宋体": "NSimSun", "黑体": "SimHei", "楷体": "KaiTi", "楷体_GB2312": "KaiTi",
    "仿宋": "FangSong", "仿宋_GB2312": "FangSong", "隶书": "LiSu", "幼圆": "YouYuan",
    "微软雅黑": "Microsoft YaHei", "等线": "DengXian", "华文宋体": "STSong", "华文细黑": "STXihei",
    "华文楷体": "STKaiti", "华文仿宋": "STFangsong",
}
SERIF_EAST_ASIA_FONTS = (
    "宋体", "新宋体", "仿宋", "仿宋_GB2312", "楷体", "楷体_GB2312", "华文宋体", "华文楷体", "华文仿宋",
)
SANS_EAST_ASIA_FONTS = ("黑体", "隶书", "幼圆", "微软雅黑", "等线", "华文细黑")

# --- fixed values: patterns (Java dialect) ---------------------------------------------------
CJK = "[\\u4e00-\\u9fff]"
TOKEN = "[a-z0-9]+|[\\u4e00-\\u9fff]{2,}"
NOISE_CHARS = "\\s,，.。!！?？:：;；/+|、-"
BOUNDARY_NOISE = f"(?U)^[{NOISE_CHARS}]+|[{NOISE_CHARS}]+$"
LEADING_GREETING = (
    "(?iU)^(?:\\s*(?:你好|您好|嗨|哈喽|hello|hi|hey|请问|麻烦问一下|我想问一下|想请教一下|请教一下)"
    "\\s*[,，.。!！?？:：;；/+|、-]*)+"
)
CITATION = "\\[(?:\\d+|[^\\[\\]\\r\\n|]{1,160}\\s\\|\\s[^\\[\\]\\r\\n|]{1,160}\\s\\|\\sc\\d+)\\]"
BARE_CITATION = "(?i)\\[c(\\d+)\\]"
SENTENCE_SPLIT = "(?U)(?<=[。！？!?])(?:\\s+)?|(?<=\\.)\\s+"
REFERENCE_LINE = "(?iU)^(\\[?\\d+\\]?\\s*)?.{0,80}\\[J\\].*(\\d{4}|\\(\\d+\\)).*$"
HEADING_LINE = "(?U)^#{1,6}\\s"
TITLE_PHRASES = ("design of", "based on")  # fixed values: phrases of a title
HTML_TAG = "<[^>]+>"
MARKDOWN_IMAGE = "!\\[[^\\]]*\\]\\([^\\)]*\\)"
MARKDOWN_LINK = "\\[([^\\]]+)\\]\\([^\\)]*\\)"
METADATA_LINE = (
    "(?iU)^(关键词|key words|摘要|abstract|中图分类号|文献标识码|文章编号|doi|图\\d+|表\\d+|参考文献)[:：]?"
)
LEADING_OUTLINE = "(?U)^\\s*(?:\\d+(?:\\.\\d+)*\\s+)+"
TECHNICAL_ENTITY = (
    "(?<![A-Za-z0-9])(?:[A-Z][A-Za-z0-9]*(?:[-+./_][A-Za-z0-9]+)*(?:\\s+[A-Z][A-Za-z0-9+./_-]*){0,3}"
    "|[A-Za-z]+(?:[-+./_][A-Za-z0-9]+)+)(?![A-Za-z0-9])"
)
CHINESE_ENTITY = (
    "(?i)[\\u4e00-\\u9fffA-Za-z0-9+./_-]{2,24}(?:模块|系统|平台|框架|架构|数据库|接口|协议|算法|控制器|传感器|芯片|处理器"
    "|显示屏|屏幕|设备|组件|服务|工具|引擎|模型|网络|电源|电机|阀|终端|客户端|服务器|层|端)"
)
STRUCTURED_PREFIX = "(?iU)^(?:content|overview|summary|abstract|architecture|workflow)\\s*[:：]\\s*"
PLAIN_HEADING = (
    "(?U)^\\s*(?:第?[一二三四五六七八九十\\d]+[章节条部分]?|[一二三四五六七八九十\\d]+(?:\\.\\d+)*"
    "|附录|摘要|引言|结论|参考文献)(?:\\s|、|：|:)"
)

# --- fixed values: limits -----------------------------------------------------------------------
CHUNK_SIZE = 520
CHUNK_OVERLAP = 96
CANDIDATE_POOL = 48
CONTEXT_RADIUS = 1
MIN_SCORE = 0.18
BM25_K1 = 1.5
BM25_B = 0.75
MAX_EMBEDDING_TOKENS = 8192 - 256
