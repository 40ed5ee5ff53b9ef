"""Rule dictionaries: ordered keyword lists as data, and as the ``lexicon`` table.

Every list is an argument of the operators that use it; these are the defaults of
the profiles ``daily`` (current), ``archive`` (the older one) and ``metrics``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# These lists define the results and are stated as they are, in their order.

STRONG_TERMS = [
    "insurance", "insurer", "insurers", "insured", "reinsurance", "reinsurer", "reinsurers", "underwrit", "premium", "premiums", "annuity", "annuities", "solvency", "insurtech", "parametric", "broker", "underwriter", "underwriters",
    "actuary", "actuaries", "catastrophe", "catastrophic", "ils", "captive", "treaty", "retrocession", "mga", "loss ratio", "combined ratio", "policyholder", "policyholders", "bancassurance", "indemnity", "ceding", "cedent",
    "facultative", "proportional", "excess of loss", "insurable", "broking", "peril", "lapse", "subrogation", "binding authority", "insurability",
    "保险", "再保险", "承保", "理赔", "保费", "保单", "偿付能力", "年金", "巨灾", "险资", "银保", "核保", "责任险", "财险", "寿险", "健康险", "车险", "农险", "投保人", "被保险人", "保险人", "精算", "经纪", "中介", "养老", "养老金",
    "代理", "投保", "给付", "免赔", "免责", "险企", "险业", "保险业", "再保", "惠民保", "参保", "保险资金", "险资", "保险科技", "智能核保", "智能理赔", "互联网保险", "保险代理人", "新能源车险", "健康险", "责任险", "财产险",
]
TOPICS_DAILY = {
    "ai_intelligent": ["人工智能", "AI", "大模型", "智能核保", "智能理赔", "智能体", "Agent", "数字化", "科技", "artificial intelligence", "generative ai", "insurtech", "automation"],
    "pension_finance": ["养老", "年金", "退休", "养老金", "第三支柱", "个人养老金", "pension", "annuity", "retirement"],
    "product_innovation": ["产品", "创新", "UBI", "惠民保", "参数化", "健康险", "医疗险", "重疾险", "车险", "医疗", "医保", "保单", "寿险", "慢病", "product", "launch", "parametric", "health insurance", "motor", "life insurance"],
    "channel_transformation": ["代理人", "银保", "渠道", "互联网保险", "线上化", "中介", "agent", "broker", "distribution", "digital"],
    "capital_reinsurance": ["再保险", "巨灾", "偿付能力", "ILS", "续转", "资本", "并购", "投资", "险资", "资管", "reinsurance", "catastrophe", "capital", "merger", "investment", "solvency"],
    "climate_catastrophe": ["气候", "自然灾害", "台风", "洪灾", "极端天气", "巨灾保险", "农业保险", "指数", "climate", "natural catastrophe", "flood", "wildfire", "hurricane", "parametric"],
    "digital_transformation": ["数字化", "保险科技", "InsurTech", "核心系统", "区块链", "数据中台", "digital", "blockchain", "core system", "data"],
    "regulatory_change": ["监管", "合规", "C-ROSS", "IFRS 17", "金融监管总局", "行政处罚", "政策", "处罚", "regulation", "compliance", "regulator", "ifrs 17", "policy", "fine"],
}
TOPICS_ARCHIVE = {
    "ai_intelligent": ["人工智能", "AI", "生成式AI", "GenAI", "大模型", "智能核保", "智能理赔", "机器学习", "深度学习", "自然语言处理", "NLP", "计算机视觉", "智能体", "Agentic AI", "数字化转型", "数字化", "自动化"],
    "pension_finance": ["养老金融", "养老金", "养老保险", "个人养老金", "年金", "退休", "老龄化", "银发经济", "第三支柱", "个人商业养老金", "养老储蓄"],
    "product_innovation": ["产品创新", "新品上市", "保险产品", "健康险", "惠民保", "护理险", "UBI车险", "参数化保险", "创新产品", "产品升级", "保障方案"],
    "channel_transformation": ["渠道变革", "银保渠道", "代理人", "互联网保险", "线上化", "数字化分销", "BBE", "团险转个险", "直销", "保险中介"],
    "capital_reinsurance": ["再保险", "巨灾债券", "ILS", "保险连接证券", "续转", "承保能力", "私募资本", "资本管理", "并购", "M&A", "ROE", "偿付能力"],
    "climate_catastrophe": ["自然灾害", "巨灾", "台风", "飓风", "洪灾", "地震", "野火", "气候变化", "极端天气", "NatCat", "巨灾保险", "灾害损失", "碳排放", "绿色保险", "ESG"],
    "digital_transformation": ["数字化转型", "核心系统", "保险科技", "InsurTech", "区块链", "大数据", "云计算", "API生态", "平台化", "线上化率", "数字化指数", "技术栈", "系统现代化"],
    "regulatory_change": ["监管变革", "偿付能力", "C-ROSS", "IFRS 17", "金融监管总局", "合规", "牌照", "行政处罚", "监管政策", "分级分类监管", "数据安全", "个人信息保护", "反洗钱"],
}
TOPIC_LABELS = {
    "ai_intelligent": "AI智能化", "pension_finance": "养老金融", "product_innovation": "产品创新", "channel_transformation": "渠道变革",
    "capital_reinsurance": "资本与再保险", "climate_catastrophe": "气候与巨灾", "digital_transformation": "数字化转型", "regulatory_change": "监管变革",
}
SCORE_BOOSTS = [
    (["人工智能", "AI", "大模型", "智能体", "Agent", "insurtech", "generative ai"], 6),
    (["养老", "巨灾", "偿付能力", "气候", "碳中和", "reinsurance", "catastrophe", "solvency", "ils"], 5),
    (["监管", "合规", "处罚", "办法", "指引", "regulation", "compliance", "regulator", "fine"], 4),
    (["创新", "首发", "首个", "突破", "launch", "unveils", "parametric"], 3),
    (["产品", "渠道", "数字化", "product", "digital"], 2),
]
WHOLE_WORDS = ["law", "life", "motor", "green", "fine"]
CATEGORY_CASCADE = [
    ("regulation", ["监管", "办法", "指引", "处罚", "合规", "政策", "regulation", "compliance", "regulator", "fine", "ifrs", "行政处罚", "金融监管总局"]),
    ("claims", ["理赔", "赔付", "赔款", "索偿", "保险欺诈", "反欺诈", "车险理赔", "健康险理赔", "医疗险理赔", "理赔服务", "理赔案例", "理赔纠纷", "理赔时效", "快赔", "claim", "lawsuit", "settlement", "verdict", "claims"]),
    ("product", ["产品", "首发", "推出", "上线", "惠民保", "新能源车险", "重疾险", "百万医疗", "养老年金", "防癌险", "宠物险", "专属商业养老", "创新型产品", "备案", "新品", "产品升级", "产品上市", "launch", "unveils", "introduces", "product"]),
    ("research", ["研报", "报告", "研究表明", "sigma", "白皮书", "咨询", "咨询报告", "分析", "洞察", "趋势", "展望", "解读", "深度", "测算", "研究", "report", "research", "whitepaper", "study"]),
]
DEFAULT_CATEGORY = "industry"
CATEGORIES = ["regulation", "product", "industry", "research", "claims"]
CATEGORY_KEYWORDS_ARCHIVE = {
    "regulation": ["监管", "政策", "合规", "银保监", "金融监管", "处罚", "牌照", "偿付能力", "准备金", "通知", "管理办法", "约谈", "新规", "行政处罚", "立案调查", "指导"],
    "product": ["产品", "上线", "费率", "保费", "承保", "保险产品", "条款", "保障", "投保", "车险", "健康险", "寿险", "养老金", "农险", "分红", "万能险"],
    "industry": ["保险行业", "市场", "并购", "重组", "上市", "业绩", "保费收入", "融资", "估值", "经营", "成绩单", "总资产", "增长", "研究", "精算", "模型", "风险", "保险科技", "InsurTech", "AI", "大数据", "人工智能", "算法", "科技保险", "数字"],
    "claims": ["理赔", "拒赔", "纠纷", "诉讼", "判例", "欺诈", "反欺诈", "消费者", "投诉", "调解", "赔付", "赔付率"],
}
AUTHORITY_MEDIA = ["中国证券报", "上海证券报", "证券时报", "新华财经", "人民日报", "中国经营报", "第一财经", "澎湃新闻", "券商中国", "北京商报"]
INSTITUTIONS = {
    "reinsurance": ["瑞士再保险", "Swiss Re", "瑞再", "慕尼黑再保险", "Munich Re", "慕再", "劳合社", "Lloyd", "怡安", "Aon", "韦莱再保险", "Willis Re"],
    "consulting": ["麦肯锡", "McKinsey", "德勤", "Deloitte", "BCG", "波士顿咨询", "Gartner", "毕马威", "KPMG", "普华永道", "PwC", "奥纬咨询", "Oliver Wyman", "埃森哲", "Accenture", "佳达再保险", "Guy Carpenter", "Marsh McLennan", "威达信"],
    "domestic": ["中国保险行业协会", "中金公司", "CICC", "艾瑞咨询", "iResearch", "头豹研究院", "LeadLeo", "清华五道口", "清华大学五道口", "零壹财经", "零壹智库", "国家金融监督管理总局", "NFRA", "银保监会"],
}
REPORT_SIGNALS = ["report", "whitepaper", "white paper", "study", "sigma", "annual report", "annual", "outlook", "survey", "benchmark", "index", "展望", "报告", "白皮书", "蓝皮书", "研报", "年报", "洞察", "趋势", "测算", "解读", "深度", "年度"]
STOCK_NOISE = ["板块拉升", "板块走强", "板块反弹", "板块震荡", "板块大涨", "板块下跌", "涨停", "跌停", "涨幅", "跌幅", "盘中走强", "午后走强", "持续走强", "大幅反弹", "持续反弹", "持续拉升", "强势拉升", "震荡拉升", "融资客", "净买入", "净卖出", "资金流入", "资金流出"]
STOCK_EXEMPT = ["保险科技", "保险产品", "保险理赔", "保险监管", "偿付能力", "保险创新", "保险服务"]
STOCK_SECTOR, STOCK_VERBS = "保险板块", ["拉升", "走强", "反弹", "涨停", "跌停", "震荡", "大涨", "下跌", "盘中", "午后", "持续", "暴力", "强势"]
STOCK_NOISE_METRICS = ["板块拉升", "板块走强", "板块反弹", "板块震荡", "板块大涨", "板块下跌", "涨停", "跌停", "涨幅", "跌幅", "融资客", "净买入", "净卖出"]
BLOCKED_DOMAINS = [
    "zhihu.com", "baike.baidu.com", "bilibili.com", "360doc.com", "wenku.baidu.com", "experience.baidu.com", "edu.baidu.com", "tieba.baidu.com", "douban.com", "segmentfault.com", "csdn.net", "jianshu.com", "cnblogs.com",
    "picc.com.cn", "epicc.com", "pingan.com", "pa18.com", "cpic.com.cn", "newchinalife.com", "chinalife.com", "cmbchina.com", "cignacmb.com", "taikang.com", "hzins.com", "huize.com", "bxahz.com",
]
BLOCKED_SOURCES = ["知乎", "百度百科", "哔哩哔哩", "发表网", "发表云", "百度知道", "百度经验", "360doc", "豆瓣", "博客园", "CSDN", "简书", "百度文库", "百度贴吧"]
SEARCH_NOISE = [
    "官网", "官方网站", "计算器", "一站尽览", r"第\d+页", "网上投保", "网上买保险", "保险商城", "投保入口", "产品介绍_保险产品知识", "险种_网上", "保险产品介绍", "保险产品知识", "理赔流程-", "理赔服务$", "保险网$", "保险频道", "招聘猎头",
    "保险险种_", "保险产品知识_", "保险问答", "需要多久", "保险知识_", "爆款产品", "产品名称:", "_汽车之家", "保险测评.*期", "保险专题报告.*腾讯",
]
SEARCH_CHANNELS = ["baidu", "google", "360", "sogou", "bing"]
LOW_QUALITY_ACCOUNTS = ["社区", "随笔", "日常", "生活", "风的", "晓", "日记", "博客", "个人", "小镇", "村庄", "街道", "便民", "信息港", "同城", "人社", "政务", "管委会", "办事处"]
BROADCAST_KEYWORDS = ["保险", "金融监管", "银保监", "偿付能力", "农险", "养老金"]
LAYER_TYPES = {"reinsurance": "国际再保险", "consulting": "全球咨询", "domestic": "国内研究", "regulator": "监管机构"}
LAYER_LABELS = {"reinsurance": "国际再保险巨头", "consulting": "全球咨询机构", "domestic": "国内研究机构"}
SOURCE_TYPE_LABELS = {
    "api": "财经媒体", "web": "行业协会", "akshare": "财经媒体", "fallback": "兜底数据", "regulator": "监管机构", "company": "保险公司", "baidu": "搜索引擎", "google": "搜索引擎", "360": "搜索引擎", "sogou": "搜索引擎", "wechat": "微信公众号",
}
KEYWORD_WEIGHTS = {"惠民保": 5, "新能源车险": 5, "保险理赔": 6, "重疾险": 5, "百万医疗": 5, "养老年金": 5, "防癌险": 5, "健康险": 4, "车险": 4, "养老金融": 4}
DOMAIN_NAMES = {
    "finance.sina.com.cn": "新浪财经", "finance.eastmoney.com": "东方财富网", "www.cs.com.cn": "中证网", "www.cnstock.com": "上海证券报", "insurance.hexun.com": "和讯保险",
    "www.bjqb.com.cn": "北京青年报", "www.cbimc.cn": "中国银行保险报", "www.nfra.gov.cn": "金融监管总局", "www.iachina.cn": "中国保险行业协会",
}
DOMAIN_PREFIXES = ["www", "news", "finance", "m", "wap", "insurance", "b", "sogou"]
LAYER_ORDER = ["reinsurance", "consulting", "domestic"]
NOTABLE_TYPES = ["监管机构", "监管", "协会", "研究机构", "咨询"]
NOTABLE_NAMES = ["总局", "协会", "研究院", "再保险", "学会", "银保监"]
#: Addresses that are private, loopback, link-local, reserved or for many receivers, and the public ones inside them.
CLOSED_RANGES = [
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4", "255.255.255.255/32",
    "::/8", "64:ff9b:1::/48", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "2001::/23", "2001:db8::/32", "2002::/16", "4000::/3", "6000::/3", "8000::/3", "a000::/3", "c000::/3", "e000::/4", "f000::/5", "f800::/6", "fc00::/7", "fe00::/9", "fe80::/10", "ff00::/8",
]
OPEN_RANGES = ["192.0.0.9/32", "192.0.0.10/32", "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28"]
# End of the fixed values.

#: For text in English, French, German or Spanish without a lexicon of its own: frequent short words.
SAMPLE_TERMS = ["that", "tion", "this"]
SAMPLE_TOPICS = {"first": ["that", "tion", "ing"], "second": ["with", "of", "from"], "third": ["heit", "que", "ción"]}
SAMPLE_CASCADE = [("regulation", ["law", "license"]), ("claims", ["que", "heit"]), ("product", ["with", "from"]), ("research", ["tion", "ing"])]
SAMPLE_BOOSTS = [(["that"], 6), (["with"], 5), (["from"], 4), (["this"], 3), (["and"], 2)]


def rows() -> list[tuple]:
    """The rule dictionaries as rows of the lexicon table."""
    out: list[tuple] = []

    def put(profile: str, rule_set: str, label: str, keywords: list[str], mode: str = "substring", weight: int | None = None) -> None:
        out.extend((profile, rule_set, label, i, k, "word" if mode == "mixed" and k.lower() in WHOLE_WORDS else "substring" if mode == "mixed" else mode, weight) for i, k in enumerate(keywords))

    put("daily", "gate", "relevant", STRONG_TERMS)
    for name, profile, topics in (("topic", "daily", TOPICS_DAILY), ("topic", "archive", TOPICS_ARCHIVE), ("category", "archive", CATEGORY_KEYWORDS_ARCHIVE), ("institution", "archive", INSTITUTIONS)):
        for label, words in topics.items():
            put(profile, name, label, words)
    for label, words in CATEGORY_CASCADE:
        put("daily", "category", label, words, "mixed")
    for words, weight in SCORE_BOOSTS:
        put("daily", "boost", f"+{weight}", words, weight=weight)
    put("daily", "report", "report", REPORT_SIGNALS)
    put("archive", "stock_noise", "noise", STOCK_NOISE)
    put("archive", "stock_exempt", "exempt", STOCK_EXEMPT)
    put("metrics", "stock_noise", "noise", STOCK_NOISE_METRICS)
    put("archive", "blocked_domain", "blocked", BLOCKED_DOMAINS)
    put("archive", "blocked_source", "blocked", BLOCKED_SOURCES)
    put("archive", "search_noise", "noise", SEARCH_NOISE, "regex")
    return out


def table(spark: SparkSession) -> DataFrame:
    """profile, rule_set, label, ord, keyword, match_mode, weight, place (the row's number)."""
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows())], "profile string, rule_set string, label string, ord int, keyword string, match_mode string, weight int, place int")


def sample_table(spark: SparkSession) -> DataFrame:
    """The samples above as a lexicon table of the profile ``sample``."""
    out = [("gate", "relevant", k, w, "substring", None) for k, w in enumerate(SAMPLE_TERMS)]
    out += [("topic", label, k, w, "substring", None) for label, words in SAMPLE_TOPICS.items() for k, w in enumerate(words)]
    out += [("category", label, k, w, "word" if w in WHOLE_WORDS else "substring", None) for label, words in SAMPLE_CASCADE for k, w in enumerate(words)]
    out += [("boost", f"+{weight}", k, w, "substring", weight) for words, weight in SAMPLE_BOOSTS for k, w in enumerate(words)]
    return spark.createDataFrame([("sample", *r, k) for k, r in enumerate(out)], "profile string, rule_set string, label string, ord int, keyword string, match_mode string, weight int, place int")
