"""Word lists, patterns, formats and limits that results depend on."""

# --- fixed values: white space as Python's str.strip / \s see it (RE2 and Java syntax) ---
WS = (
    r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
WS_CHARS = (
    "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# --- fixed values: number literals accepted as numeric, underscores between digits allowed ---
FLOAT_LITERAL = (
    r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?\z"
)
FLOAT_WORDS = [sign + word for sign in ("", "+", "-") for word in ("nan", "inf", "infinity")]
MAX_EXACT_INTEGER = 2 ** 53

# --- fixed values: column names that mark identifiers ---
IDENTIFIER_NAME = (
    r"(?i)(order\s*id|sku|seller\s*sku|编号|单号|订单号|序号|邮编|手机|电话|账号|"
    r"id$|code|no\.?$|number|工号|货号|条码)"
)

# --- fixed values: provenance columns of a typed table ---
SOURCE_COLUMNS = [
    "__document_id", "__user_id", "__filename", "__sheet_name", "__row_index", "__range",
]

# --- fixed values: business term -> column, business term -> stored value ---
COLUMN_ALIASES = {
    "物流商": "Shipping Provider Name",
    "物流": "Shipping Provider Name",
    "快递": "Shipping Provider Name",
    "销量": "Quantity",
    "数量": "Quantity",
    "sku": "SKU ID",
    "运费": "Original Shipping Fee",
    "运费金额": "Original Shipping Fee",
    "原始运费": "Original Shipping Fee",
    "折后运费": "Shipping Fee After Discount",
    "订单": "Order ID",
    "订单号": "Order ID",
    "订单金额": "Order Amount",
    "订单价格": "Order Amount",
    "总价": "Order Amount",
    "成交金额": "Order Amount",
    "商品单价": "SKU Unit Original Price",
    "SKU单价": "SKU Unit Original Price",
    "原始单价": "SKU Unit Original Price",
    "单位价格": "SKU Unit Original Price",
}
VALUE_ALIASES = {"金眼": "golden eye", "金眼物流": "golden eye"}

# --- fixed values: limits ---
MAX_HEADER_ROWS = 4
ROW_GROUP_SIZE = 8
SUMMARY_DESCRIBED_COLUMNS = 12
MAX_DISPLAY_NAME = 40
ENUM_MAX_VALUES = 30
RESULT_ROW_CAP = 2000
MAX_SOURCES = 50
MAX_CITATIONS = 5
MAX_DOCUMENT_CHUNKS = 3000
CONTEXT_PAGE_CHARS = 24000
HISTORY_MESSAGES = 10
EMBED_BATCH = 20
CACHE_TTL_SECONDS = 3600
CACHE_MAX_ENTRIES = 1024
COLLECTION_NAME_MAX = 63
LEGACY_COLLECTION = "ai_assistant_docs"
COLLECTION_PREFIX = "ai_assistant_docs__"
LIMITER_WINDOW_SECONDS = 300
LIMITER_MAX_FAILURES = 5
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
SPLIT_SEPARATORS = ["\n\n", "\n", "。", "！", "？", "；", "，", " ", ""]
SENTENCE_ENDS = ".!?。！？"

# --- fixed values: upload rules ---
MAX_UPLOAD_BYTES = 10 * 1024 * 1024
TABLE_EXTENSIONS = ["xlsx", "xls", "csv", "tsv"]
TEXT_EXTENSIONS = ["txt", "md", "log", "json", "xml", "yaml", "yml"]
ALLOWED_MIME = {
    ".pdf": ["application/pdf"],
    ".txt": ["text/plain"],
    ".docx": ["application/vnd.openxmlformats-officedocument.wordprocessingml.document"],
    ".md": ["text/markdown", "text/plain", "text/x-markdown"],
    ".xlsx": [
        "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
        "application/octet-stream",
    ],
    ".xls": ["application/vnd.ms-excel", "application/octet-stream"],
    ".csv": ["text/csv", "text/plain", "application/octet-stream"],
    ".tsv": ["text/tab-separated-values", "text/plain", "application/octet-stream"],
}
ANY_MIME = "application/octet-stream"

# --- fixed values: words and patterns of table questions ---
ENUM_PHRASES = [
    "列出所有", "全部列出", "都列出来", "全部提取", "每一行", "每一", "所有订单", "所有记录",
    "全部记录", "所有行", "全部行", "完整列表", "全量列出", "全量提取", "逐行列出", "逐行列举",
]
ENUM_NOUNS = ["SKU", "订单", "记录", "行", "数据", "表", "商品", "列表", "内容", "项", "明细"]
ENUM_BARE = ["全部", "所有", "完整"]
ENUM_BARE_WINDOW = 8
ENUM_FULL = ["全部", "所有", "每个", "每一", "完整", "都", "全表", "整表", "全量"]
ENUM_VERBS = [
    "列出", "列举", "枚举", "提取", "显示", "展示", "给我", "输出", "整理", "汇总", "导出", "列出来",
]
LOOKUP_WORDS = [
    "查", "找", "定位", "对应", "匹配", "为", "=", "的variation", "的 variation", "是什么",
    "在哪里", "在哪",
]
LOOKUP_QUOTED = r"[\"']([0-9A-Za-z_\-]{4,})[\"']"
LOOKUP_ORDER_IDS = [
    r"(?i)Order\s*ID\s*(?:为|=|:|：)?\s*([0-9A-Za-z_\-]{4,})",
    r"(?i)订单号\s*(?:为|=)?\s*([0-9A-Za-z_\-]{4,})",
    r"(?i)订单\s*(?:ID|id)?\s*(?:为|=)?\s*([0-9A-Za-z_\-]{4,})",
]
LOOKUP_DIGITS = r"(\d{6,})"
RANGE_PATTERN = r"第\s*(\d+)\s*(?:[到~至\-—]|~)\s*(\d+)\s*(?:条|行|个)?"
FIRST_N_PATTERN = r"前\s*(\d+)\s*(?:条|行|个)"
LAST_N_PATTERN = r"(?:最后|后)\s*(\d+)\s*(?:条|行|个)"
LOOKUP_KEY_MARK = r"\s*(?:为|=|:|：|等于|是)\s"

SCHEMA_PATTERN = r"(?i)字段|列名|列数|多少列|几列|表头|数据类型|类型是什么|结构|schema|表结构"
MEANING_PATTERN = r"(?i)是什么意思|含义|指的是|怎么理解|业务上.{0,6}意思|属于什么|是什么类型"
MEANING_STRONG_PATTERN = r"是什么意思|含义|指的是|怎么理解|业务上.{0,6}意思"
LOCATE_PATTERN = r"(?i)在哪里|相关的数据|主要记录|关于|描述一下"
COUNT_PATTERN = (
    r"(?i)多少个|多少条|多少单|多少行|总数|总和|合计|总计|平均|均值|最高|最低|"
    r"最大|最小|排名|分别有?多少|每个.+分别|卖了多少|卖得最多|卖得最好|销量|"
    r"TOP|前\s*\d+\s*个|大于|超过|不低于|不少于|少于|小于|等于"
)
DEFAULT_COUNT_PATTERN = (
    r"(?i)(订单|记录|行数|SKU).{0,6}多少|多少.{0,6}(订单|记录|行数|SKU)|"
    r"多少个\s*SKU|多少\s*SKU|多少\s*订单"
)
FEW_COUNT_PATTERN = r"(?i)几[单条个笔行列种项件份页块批](?!意思)"
CROSS_DOCUMENT_PATTERN = (
    r"(?i)所有(文件|文档|Excel|表格|表)|全部(文件|文档|Excel|表格)|加起来|跨(文件|文档|表)"
)
EXPLICIT_MEASURE_PATTERN = (
    r"(?i)总和|平均|最高|最低|最大|最小|排名|销量|大于|超过|每个.+分别|TOP|前\s*\d+\s*个"
)
SORT_TOPN_PATTERN = r"(?i)排序|降序|升序|从高到低|从低到高|最高|最低|最大|最小|排名前|Top\s*\d+"

# --- fixed values: words of error texts ---
QUOTA_TEXT = ["quota", "free tier", "free quota", "billing"]
QUOTA_CODES = ["insufficient_quota", "allocationquota"]
AUTH_TEXT = ["authentication", "unauthorized", "api key", "permission", "forbidden"]
BILLING_TEXT = ["billing", "insufficient", "quota", "api key", "unauthorized", "401", "403"]
CLIENT_MODULES = ["httpx", "openai", "requests"]
VALIDATION_TEXT = [
    "校验", "白名单", "不允许", "禁止", "非法", "unauthorized table", "security",
]
ZERO_WORDS = ["0", "没有", "未找到", "无", "不存在"]
