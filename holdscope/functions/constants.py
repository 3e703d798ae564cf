"""Labels, code tables and word lists that results depend on."""

# Unknown industry bucket.
UNKNOWN_INDUSTRY = "未知行业"

ASSET_CLASS_LABELS = {
    "stock": "股票",
    "bond": "债券",
    "fund": "基金",
    "cash": "现金 / 存款",
    "deposit": "银行存款",
    "derivative": "衍生品",
    "other": "其他",
}

MARKET_LABELS = {
    "SH": "上海",
    "SZ": "深圳",
    "BJ": "北京",
    "HK": "港股",
    "US": "美股",
    "CN_INTERBANK": "银行间",
    "OTC": "场外",
    "UNKNOWN": "未识别",
}

REGION_LABELS = {"domestic": "A股", "us": "美股", "hk": "港股", "commodity": "大宗商品"}

PRODUCT_TYPE_LABELS = {
    "equity": "股票型 / 权益类",
    "mixed": "混合型",
    "fixed_income": "债券型 / 固定收益",
    "index": "指数型",
    "money_market": "货币型 / 现金管理",
    "qdii": "QDII",
    "fof": "FOF / 养老",
    "commodity": "商品型",
    "other": "其他",
}

BREAKDOWN_LABELS = {
    "SH": "上海A股",
    "SZ": "深圳A股",
    "BJ": "北交所",
    "HK": "港股",
    "US": "美股",
    "UNKNOWN": "未识别",
}

VOLUME_UNITS = {"lot": "手", "share": "股", "contract": "张"}

# Asset classes shown by the market view unless the caller asks for others.
DEFAULT_MARKET_CLASSES = ("index", "commodity")

# Market code prefixes, tested in this order.
MARKET_PREFIXES = (
    ("SH", ("60", "68", "51", "52", "53")),
    ("SZ", ("00", "30", "39", "12", "08")),
    ("BJ", ("8", "4", "43")),
)

# Preference when one code exists on several markets.
MARKET_PRIORITY = ("SH", "SZ", "BJ", "HK")

# Overlay bundles per dominant market.
INDEX_BUNDLES = {
    "domestic": ("SH000300", "SH000001", "SZ399006"),
    "hk": ("HSI",),
    "us": ("NDX", "SPX", "DJIA"),
    "commodity": ("GOLD", "BRENT_OIL"),
}
BASELINE_INDEX = "SH000300"

# Kline source prefix, trading region and currency by market.
KLINE_PREFIX = {"SH": "1", "SZ": "0", "HK": "128", "BJ": "1"}

EXCHANGE_MARKETS = {"上海证券交易所": "SH", "深圳证券交易所": "SZ", "北京证券交易所": "BJ"}
EXCHANGE_HINTS = (("上海", "SH"), ("深圳", "SZ"), ("北京", "BJ"))
SUPPORTED_INDEXES = {"000300": "沪深300", "000906": "中证800"}

# symbol, name, region, class, kline id, live symbol, currency, volume unit
MARKET_SYMBOLS = (
    ("SH000001", "上证指数", "domestic", "index", "1.000001", "sh000001", "CNY", "lot"),
    ("SZ399001", "深证成指", "domestic", "index", "0.399001", "sz399001", "CNY", "lot"),
    ("SZ399006", "创业板指", "domestic", "index", "0.399006", "sz399006", "CNY", "lot"),
    ("SH000300", "沪深300", "domestic", "index", "1.000300", "sh000300", "CNY", "lot"),
    ("SH000016", "上证50", "domestic", "index", "1.000016", "sh000016", "CNY", "lot"),
    ("SH000905", "中证500", "domestic", "index", "1.000905", "sh000905", "CNY", "lot"),
    ("SH000852", "中证1000", "domestic", "index", "1.000852", "sh000852", "CNY", "lot"),
    ("HSI", "恒生指数", "hk", "index", "100.HSI", "rt_hkHSI", "HKD", "share"),
    ("HSCEI", "恒生中国企业指数", "hk", "index", "100.HSCEI", "rt_hkHSCEI", "HKD", "share"),
    ("DJIA", "道琼斯工业指数", "us", "index", "100.DJIA", "gb_dji", "USD", "share"),
    ("NDX", "纳斯达克指数", "us", "index", "100.NDX", "gb_ixic", "USD", "share"),
    ("SPX", "标普500指数", "us", "index", "100.SPX", "gb_inx", "USD", "share"),
    ("BRENT_OIL", "布伦特原油", "commodity", "commodity", None, "hf_CL", "USD", "contract"),
    ("GOLD", "纽约黄金", "commodity", "commodity", None, "hf_GC", "USD", "contract"),
)
MARKET_SYMBOL_SCHEMA = (
    "symbol_code STRING, symbol_name STRING, market_region STRING, asset_class STRING, "
    "kline_id STRING, live_symbol STRING, currency STRING, volume_unit STRING"
)

# Risk label -> standard level.
RISK_LEVELS = {
    "R1": "L1",
    "低风险": "L1",
    "PR1": "L1",
    "低风险(R1)": "L1",
    "极低风险": "L1",
    "保守型(1R)": "L1",
    "二星级": "L2",
    "R2": "L2",
    "中低风险": "L2",
    "PR2": "L2",
    "中低风险(R2)": "L2",
    "较低风险": "L2",
    "稳健型(2R)": "L2",
    "三星级": "L3",
    "R3": "L3",
    "中风险": "L3",
    "PR3": "L3",
    "中风险(R3)": "L3",
    "中等风险": "L3",
    "平衡型(3R)": "L3",
    "四星级": "L4",
    "R4": "L4",
    "中高风险": "L4",
    "PR4": "L4",
    "中高风险(R4)": "L4",
    "较高风险": "L4",
    "增长型(4R)": "L4",
    "五星级": "L5",
    "R5": "L5",
    "高风险": "L5",
    "PR5": "L5",
    "高风险(R5)": "L5",
    "进取型(5R)": "L5",
}

# Product type rules by source: (type, words in the name, words in the raw type, words in the
# upper-cased name). The first rule with any hit wins; no hit is "other".
TYPE_RULES = {
    "fund": (
        ("money_market", ("货币", "余额宝", "现金"), (), ()),
        ("qdii", (), (), ("QDII",)),
        ("fof", (), (), ("FOF",)),
        ("index", ("指数", "联接"), (), ("ETF",)),
        ("fixed_income", ("债", "纯债", "短债", "固收"), (), ()),
        ("mixed", ("混合", "偏股", "灵活配置"), (), ()),
        ("equity", ("股票", "权益"), (), ()),
    ),
    "BOC": (
        ("money_market", ("现金", "天天", "日日开"), (), ()),
        ("fixed_income", ("固收", "债", "稳富"), (), ()),
        ("mixed", ("混合", "混"), (), ()),
        ("equity", ("权益", "股票", "智富"), (), ()),
        ("index", ("指数",), (), ("ETF",)),
        ("qdii", ("全球",), (), ("QDII",)),
        ("commodity", ("商品", "衍生"), (), ()),
    ),
    "JX": (
        ("money_market", ("货币", "现金"), (), ()),
        ("fixed_income", ("债", "固收"), (), ()),
        ("mixed", ("混合",), (), ()),
        ("equity", ("权益", "股票"), (), ()),
    ),
    "CEB": (
        ("fof", ("养老",), (), ()),
        ("fixed_income", ("固收", "债", "丰利"), (), ()),
        ("mixed", ("混合", "混"), (), ()),
        ("equity", ("权益", "股票"), (), ()),
        ("money_market", ("现金", "天天"), (), ()),
    ),
    "CITIC": (
        ("money_market", ("现金",), ("货币", "每日购"), ()),
        ("fixed_income", ("债",), ("固收",), ()),
        ("mixed", (), ("混合", "混"), ()),
        ("equity", (), ("权益", "股票"), ()),
        ("index", (), ("指数",), ("ETF",)),
        ("qdii", (), (), ("QDII",)),
        ("commodity", (), ("商品", "衍生"), ()),
    ),
    "ZY": (
        ("money_market", ("货币",), ("现金",), ()),
        ("fixed_income", ("债", "封闭"), ("固收",), ()),
        ("mixed", ("混",), ("混合",), ()),
        ("equity", ("股票",), ("权益",), ()),
        ("index", (), ("指数",), ("ETF",)),
        ("qdii", (), (), ("QDII",)),
    ),
    "SPD": (
        ("money_market", ("现金", "天天"), ("货币",), ()),
        ("fixed_income", (), ("固收", "债"), ()),
        ("mixed", (), ("混合", "混"), ()),
        ("equity", (), ("权益", "股票"), ()),
        ("index", (), ("指数",), ("ETF",)),
        ("qdii", (), (), ("QDII",)),
        ("commodity", (), ("商品", "衍生"), ()),
    ),
}

# Raw type codes that decide the type before any word rule.
TYPE_CODES = {
    "JX": {"001": "fixed_income", "002": "equity", "003": "mixed", "004": "commodity", "005": "money_market"},
}

# Risk words by source, tested in this order on the trimmed upper-cased text; no hit is R3.
# "低" also matches inside "中低", so medium-low text ends in R1.
RISK_RULES = {
    "BOC": (("R1", ("R1", "低")), ("R2", ("R2", "中低")), ("R4", ("R4", "中高")), ("R5", ("R5", "高"))),
    "CEB": (
        ("R1", ("R1", "一级", "低")),
        ("R2", ("R2", "二级", "中低")),
        ("R4", ("R4", "四级", "中高")),
        ("R5", ("R5", "五级", "高")),
    ),
    "CITIC": (("R1", ("R1", "PR1")), ("R2", ("R2", "PR2")), ("R4", ("R4", "PR4")), ("R5", ("R5", "PR5"))),
    "ZY": (("R1", ("R1", "低")), ("R2", ("R2", "中低")), ("R4", ("R4", "中高")), ("R5", ("R5", "高"))),
    "SPD": (
        ("R1", ("R1", "低")),
        ("R2", ("R2", "中低", "较低")),
        ("R4", ("R4", "中高", "较高")),
        ("R5", ("R5", "高")),
    ),
}

# Feed constants: source -> (institution type, name, custodian).
INSTITUTIONS = {
    "GF": ("fund_company", "广发基金", None),
    "YFD": ("fund_company", "易方达基金", None),
    "HTF": ("fund_company", "汇添富基金", None),
    "ChinaAMC": ("fund_company", "华夏基金", None),
    "BOC": ("bank_wm", "中银理财", "中国银行"),
    "JX": ("bank_wm", "建信理财", "中国建设银行"),
    "CEB": ("bank_wm", "光大理财", "中国光大银行"),
    "CITIC": ("bank_wm", "信银理财", "中信银行"),
    "ZY": ("bank_wm", "招银理财", "招商银行"),
    "SPD": ("bank_wm", "浦银理财", "上海浦东发展银行"),
}

# Trailing marks dropped from an industry name, first match wins.
INDUSTRY_SUFFIXES = ("Ⅱ", "III", "II", "I", "1", "2", "3")
REPORT_INDUSTRY_SUFFIXES = ("Ⅱ", "III", "II", "I")
BANK_INDUSTRIES = ("银行Ⅱ", "银行")
BANK_LABEL = "银行业"

# Share-class letters at the end of a product name.
SHARE_CLASS = r"\s?[ABCEH]$"

# Fields of a kline row, in order.
KLINE_FIELDS = (
    "date", "open", "close", "high", "low", "volume", "amount",
    "amplitude", "change_pct", "change_amount", "turnover",
)

# Advice lines of the collection report.
ADVICE = {
    "nav": "%d 个产品仍无净值记录，建议排查对应机构采集器或补充数据源。",
    "holding": "%d 个产品仍无持仓数据，可扩展债券持仓、资产配置及银行理财持仓采集。",
    "symbols": "最新行情日缺少 %d 个品种，建议检查 market_quote 采集或补充数据源。",
    "tasks": "本次有 %d 个任务失败，建议查看 collection_log 详情。",
    "fine": "本次采集整体正常，建议持续监控数据质量并定期复核。",
}

STALE_MESSAGE = "marked stale by runner startup"
