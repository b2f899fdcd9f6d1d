"""Word lists, patterns and enumerations, as Java regular expressions.

All of these are fixed values: results depend on them.  (?U) makes \\d and \\s Unicode classes, so full-width
digits and spaces match as well.
"""

# Words that name sections on a company's financing history (document pipeline, market batch).
SECTION_WORDS = ("发行人基本情况", "历史沿革", "股本演变", "历次增资", "股权转让", "股东变化", "股东情况", "公司设立", "发起人", "注册资本.*增加", "融资", "改制", "有限公司阶段", "股份公司阶段")
SECTION_WORDS_BATCH = ("发行人基本情况", "历史沿革", "股本演变", "历次增资", "股权转让", "股东变化", "股东情况", "公司设立", "发起人", "股本.*变化", "改制", "有限公司阶段", "股份公司阶段", "红筹架构", "VIE", "拆除", "搭建")
FALLBACK_WORDS = ("股本演变", "历次增资", "历史沿革", "股权转让", "增资")
SNIPPET_WORDS = ("发行人基本情况", "股本演变", "历次增资", "股权转让", "设立情况", "股东变化", "报告期内股本")

# Event types with their patterns, in the order of the tests (document pipeline, market batch).
EVENT_RULES = (
    ("增资", r"(?U)(?:第[一二三四五六七八九十\d]+次)?\s*增资"),
    ("股权转让", r"(?U)(?:第[一二三四五六七八九十\d]+次)?\s*股权转让"),
    ("吸收合并", r"吸收合并"),
    ("整体变更", r"(?U)整体变更(?:为|设立|成)\s*(?:股份有限公司|股份公司)"),
    ("设立", r"(?:有限公司|股份公司|股份有限公司)设立"),
    ("改制", r"改制"),
)
EVENT_RULES_BATCH = (
    ("增资", r"增资"),
    ("股权转让", r"股权转让|股份转让"),
    ("整体变更", r"整体变更|变更为.*股份"),
    ("吸收合并", r"吸收合并"),
    ("设立", r"(?U)(?:有限公司|股份公司|有限责任公司)\s*设立"),
    ("改制", r"改制"),
)

# Dates, amounts, prices and names in running text.
YEAR_MONTH = r"(?U)(\d{4})\s*年\s*(\d{1,2})\s*月"
DATE_TOKENS = (r"(?U)\d{4}\s*年\s*\d{1,2}\s*月", r"(?U)\d{4}\.\d{1,2}", r"(?U)\d{4}/\d{1,2}")
AMOUNT = r"(?U)(?:注册资本|出资额?|增资)\D*?(\d+[\d,.]*\s*万元)"
AMOUNTS_BATCH = (r"(?U)(?:注册资本|出资额?|增资[金额]?|投资额?|估值).{0,10}?(\d+[\d,.]*\s*万?\s*(?:元|人民币|美元|港元))", r"(?U)(\d+[\d,.]+\s*万?\s*(?:元|人民币))")
AMOUNT_TEN_THOUSAND = r"(?U)(\d+[\d,.]*)\s*万\s*元"
UNIT_PRICE = r"(?U)(\d+\.?\d*)\s*元\s*/\s*(?:股|注册资本)"
POST_CAPITAL = r"(?U)(?:增资后.*?股本|注册资本)[^\d]*?([\d,]+\.?\d*)\s*万"
POST_CAPITAL_VALUED = r"(?U)注册资本[^\d]*?([\d,]+\.?\d*)\s*万"
PARTY = r"([一-鿿]{2,10}(?:有限(?:责任)?公司|集团(?:有限)?公司|企业|合伙|创投|投资|资本))"
PARTY_BATCH = r"(?U)([一-鿿\w]{2,20}(?:有限(?:责任)?公司|集团(?:有限)?公司|企业|合伙|创投|投资|资本|基金|管理|控股))"
PARTY_AUTO = r"(?U)([一-鿿\w（）()]{2,30}(?:有限(?:责任)?公司|合伙|企业|基金|创投|投资|集团))"
TIMELINE_LINE = r"(?U)^(\d{4})\s*[年./]\s*(\d{1,2})\s*[月./]?\s*(\d{1,2})?\s*[日]?\s*[,，]?\s*(.+)"
TIMELINE_LOOSE_DATE = r"(?U)(\d{4})\s*[年.]\s*(\d{1,2})\s*[月]"
TIMELINE_WORDS = r"增资|股权转让|吸收合并|设立|整体变更"
TIMELINE_WORDS_BATCH = r"增资|股权转让|吸收合并|整体变更|设立|改制|注册资本|股东"

# Headings.
HEADING = r"^# (.+)$"
HEADING_ANY = r"(?U)^#+\s*(.+)"
HEADING_TEXT = r"(?U)^\s*(第[一二三四五六七八九十百\d]+[节章]\s*[^\n]{0,80})"
HEADING_PAGE = r"(?U)^## 第(\d+)页$"
TOC_SECTION = r"(?U)^#\s+(第[一二三四五六七八九十\d]+节.*)"
TOC_ITEM = r"(?U)^(#\s+(?:一、|二、|三、|四、|五、|六、).*)"
CORE_PATTERNS = (r"第[四4][节章][^\n]{0,30}发行人基本情况", r"发行人基本情况", r"股本演变|历次增资|历史沿革")
NEXT_SECTION = r"(?U)第[五六七八九十百\d]+[节章]"
PREVIOUS_SECTION = r"(?U)第[一二三四五六七八九十百\d]+[节章]"

# Contextual events (type, pattern, characters before and after that count as evidence, note, first only).
CONTEXT_EVENTS = (
    ("设立", r"(?U)(?:有限公司|股份公司|股份有限公司)\s*设立.*?(?:注册资本|出资).*?(\d{4})\s*年\s*(\d{1,2})\s*月", 200, 500, "自动提取（设立事件）", True),
    ("整体变更", r"(?U)整体变更.*?(\d{4})\s*年\s*(\d{1,2})\s*月.*?(?:净资产|折股|股本)", 300, 500, "自动提取（股改事件）", True),
    ("增资", r"(?U)(\d{4})\s*年\s*(\d{1,2})\s*月[^。]{0,100}?(?:增资|增加注册资本|新增注册资本)", 100, 300, "自动提取（增资事件）", False),
)
HOLDER_HEADERS = (("序号", "股东"), ("股东名称", "持股"), ("出资额", "出资比例"))
HOLDER_ROW = r"(?U)<tr><td[^>]*>(?:(\d+)\s*)?</td><td[^>]*>([一-鿿（）()a-zA-Z]+(?:有限(?:责任)?公司|集团|企业|合伙)?)</td><td[^>]*>([\d,.]+\s*万?\w*)</td><td[^>]*>([\d.]+%?)</td>"

# Announcements.
TITLE_INCLUDE = r"招股(说明|意向)?书"
TITLE_EXCLUDE_SHORT = ("摘要", "问询", "回复", "上市公告", "发行公告", "法律意见")
TITLE_EXCLUDE = ("提示性公告", "提示性", "上市公告书", "发行公告", "审核问询函", "问询回复", "问询函", "落实函", "审核中心意见", "反馈意见", "发行保荐书", "上市保荐书", "审计报告", "法律意见书", "律师工作报告", "附录", "附件", "摘要", "更正", "补充", "修改", "修订")
VERSIONS = ("申报稿", "上会稿", "注册稿", "正式稿")

# Enumerations and required keys of structured documents.
EVENT_CONTEXTS = ("增资", "股权转让", "整体变更", "吸收合并", "设立", "改制", "VIE搭建", "VIE拆除", "增资及股权转让", "其他")
PAYMENT_METHODS = ("货币", "土地使用权", "机器设备", "知识产权", "债权", "其他")
HOLDER_TYPES = ("控股股东", "实际控制人", "员工持股平台", "外部PE", "外部VC", "产业资本", "政府基金", "自然人", "原始创始人", "其他")
SUMMARY_PREFIXES = ("招股书显示", "招股书披露", "根据招股书", "据招股书")
SUMMARY_PHRASES = ("招股书显示", "招股书披露", "根据招股书", "据招股书", "招股书说明", "招股书记载", "公告显示", "报告期内")
EVENT_KEYS = ("event_order", "event_date", "date_type", "event_type", "disclosed_round", "inferred_round", "round_inference_basis", "total_investment_amount", "currency", "share_price", "pre_money_valuation", "post_money_valuation", "valuation_basis", "investors", "source_section", "source_page", "evidence_text", "confidence")
INVESTOR_KEYS = ("investor_original_name", "investor_short_name", "investor_type", "is_pevc", "investment_amount", "shares_acquired", "shareholding_ratio_after_event", "exit_status_before_ipo")
CRITICAL_KEYS = ("event_date", "event_type", "evidence_text", "confidence")
EVENT_SHORT_FACTS = r"(增资|股权转让|引入.*投资|融资|注册资本.*增加)"

# The profiler's dictionary (field, type, required, allowed values).
COMPANY_FIELDS = (
    ("company_name", "string", True, ()), ("stock_code", "string", True, ()), ("exchange", "string", True, ("上交所", "深交所", "北交所")), ("board", "string", True, ("主板", "创业板", "科创板", "北交所")),
    ("listing_date", "string", True, ()), ("prospectus_title", "string", True, ()), ("prospectus_url", "string", True, ()), ("prospectus_version", "string", True, ("正式稿", "申报稿", "上会稿")), ("prospectus_date", "string", True, ()),
)
EVENT_FIELDS = (
    ("event_order", "integer", True, ()), ("event_date", "string", True, ()), ("date_type", "string", True, ("工商变更日", "签约日", "股东大会日", "未说明")), ("event_type", "string", True, ("增资", "股权转让", "增资及股权转让", "其他")),
    ("disclosed_round", "string", True, ()), ("inferred_round", "string", True, ()), ("round_inference_basis", "string", True, ()), ("total_investment_amount", "number|null", False, ()), ("currency", "string", True, ("CNY", "USD", "HKD")),
    ("share_price", "number|null", False, ()), ("pre_money_valuation", "number|null", False, ()), ("post_money_valuation", "number|null", False, ()), ("valuation_basis", "string|null", False, ()),
    ("source_section", "string", True, ()), ("source_page", "string", True, ()), ("evidence_text", "string", True, ()), ("confidence", "string", True, ("high", "medium", "low")),
)
INVESTOR_FIELDS = (
    ("investor_original_name", "string", True, ()), ("investor_short_name", "string", True, ()), ("investor_type", "string", True, ("PE", "VC", "产业资本", "政府基金", "自然人", "员工持股平台", "其他")), ("is_pevc", "string", True, ("yes", "no", "uncertain")),
    ("investment_amount", "number|null", False, ()), ("shares_acquired", "number|null", False, ()), ("shareholding_ratio_after_event", "string|null", False, ()), ("exit_status_before_ipo", "string", True, ("未退出", "全部退出", "部分退出")),
)
PROCESSING_FIELDS = (
    ("download_status", "string", False, ("success", "failed", "pending")), ("parse_status", "string", False, ("success", "failed", "pending")), ("locate_status", "string", False, ("success", "failed", "pending")),
    ("extract_status", "string", False, ("success", "failed", "pending")), ("review_status", "string", False, ("checked", "unchecked")),
)

# Types of anomalies.
ANOMALY = {
    "missing": "缺失必填字段",
    "type": "类型错误",
    "value": "枚举值异常",
    "blank": "空字符串",
    "bad_date": "日期格式错误",
    "no_data": "数据缺失",
    "step": "处理未成功",
    "unreviewed": "未审核",
    "odd_date": "日期格式异常",
    "typo": "数据录入错误",
    "span": "日期跨度过大",
    "amounts": "金额不一致",
    "unsure": "低置信度",
    "no_structure": "缺少结构化数据",
    "no_events": "无融资事件",
    "no_date": "日期缺失",
    "no_parties": "参与者缺失",
}

# Texts of issues of logs and structured documents.
ISSUE = {
    "first_snapshot": "最早快照: ",
    "no_snapshot": "无股权存量记录",
    "event": "事件",
    "party": "投资人",
    "lacks": "缺少字段: ",
    "summary": " evidence_text 疑似概括性语言，应为原文片段",
    "bad_json": "JSON格式错误",
    "lacks_top": "缺失顶层字段: ",
    "old_form": "financing_events 在 company 对象内（旧格式），应提升到顶层",
    "lacks_critical": " 缺失关键字段: ",
    "odd_type": " 非标准事件类型: ",
    "bad_date": " 日期格式错误: ",
    "odd_date": " 日期异常: ",
    "phrase": " evidence_text 含概括性语言: ",
    "short": " evidence_text 过短",
    "bad_flag": " is_pevc 值非法: ",
    "span": "融资跨度异常: ",
    "no_file": "缺失文件",
}

# Names of rows and checks in the cross-check log.
CHECK = {
    "totals": "持股合计{}万股 vs 总股本{}万股",
    "share_totals": "总股本不一致",
    "capital_totals": "总出资额不一致",
    "shares_row": "[股本变化合计]",
    "shares": "认购合计{}万股 vs 股本变化{}万股",
    "capital_row": "[出资额变化合计]",
    "capital": "认购合计{}万股 vs 出资额变化{}万元",
    "held_row": " (认缴→存量)",
    "held": "认购数 vs 存量持股数",
    "price": "price×shares vs amount diff={}%",
    "review": " ←待复核",
}
