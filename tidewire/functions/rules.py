"""Fixed values that results depend on, and the rule set used by the engine's own queries.

The keyword rules are data: pass any other ``Rules`` to the operators.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# labels
UNCLASSIFIED = "未分类"
GENERAL = "综合"
OTHER_GROUP = "其他"
TYPE_LABEL = {"rss": "RSS", "api": "API", "scraper": "HTTP"}
SEVERITY = {"政府与CERT": "high", "安全厂商": "medium", "安全媒体": "medium", "国内信源": "medium", "AI厂商": "low", "开发者社区": "low"}
SEVERITY_ORDER = {"high": 0, "medium": 1, "low": 2}
REASONS = {"failed": "抓取失败", "no_items": "无匹配条目", "disabled": "自动禁用（连续%d次失败）", "failing": "连续%d次抓取失败"}

# One of these at a title's start is dropped
TITLE_PREFIXES = ("cve alert: ", "alert: ", "news: ", "update: ", "critical: ", "high: ", "medium: ", "low: ")

# Content types by patterns anywhere in the text, in order
BROAD_TYPES = {
    "研究报告/白皮书": ["白皮书", "研究报告", "whitepaper", "white paper", "研究", "research paper", "技术报告"],
    "漏洞披露": ["cve-", "漏洞披露", "vulnerability disclosure", "0-day", "advisory", "安全公告", "漏洞预警"],
    "攻击活动报告": ["apt", "攻击活动", "threat actor", "threat group", "入侵", "intrusion", "campaign", "攻击链"],
    "工具发布": ["工具", "tool", "发布", "release", "开源项目"],
    "行业分析": ["市场", "market", "报告", "analysis", "趋势", "gartner", "forrester", "行业"],
    "法规/标准发布": ["法规", "regulation", "标准", "standard", "法律", "法案", "合规", "compliance", "nist", "iso"],
}

# Tags that end a block
BLOCK_TAGS = ("p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "td", "th", "blockquote", "pre", "dl", "dt", "dd")

# Entities decoded by hand, in order
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"))

# Lines that are noise
NOISE_LINES = (
    r"(?i)^Copyright\s+(?:©\s*)?\d{4}",
    r"(?i)^All\s+(?:rights\s+)?reserved\.?\s*",
    r"(?i)^Privacy\s+(?:Policy|Statement)",
    r"(?i)^Terms\s+of\s+(?:Service|Use)",
    r"(?i)^Contact\s+Us$",
    r"(?i)^Follow\s+us\s+on\s",
    r"(?i)^Subscribe\s+to\s+(?:our\s+)?newsletter",
    r"^阅读原文$",
    r"^(返回|查看|阅读) (原文|全部|更多)",
    r"^(分享|收藏|点赞|评论|转发)",
)

# Sentences that say nothing (matched in lower case)
EMPTY_SENTENCES = (
    r"^(copyright|©|all rights reserved|登录|注册|订阅|点击)",
    r"(subscribe|newsletter|sign up|follow us|@)",
    r"^(home|about|contact|privacy)",
    r"^(is a|is an|是一位|是一名|are a|is the)",
    r"(skip this ad|you can skip|广告)",
    r"(linkedin\.com|twitter\.com|facebook\.com)",
    r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}",
)

# fmt: off
# Stop words
STOP_WORDS = (
    "的", "了", "在", "是", "我", "有", "和", "就", "不", "人", "都", "一", "一个", "上", "也", "很", "到", "说", "要", "去", "你", "会", "着", "没有", "看", "好", "自己", "这",
    "他", "她", "它", "们", "那", "里", "为", "与", "及", "等", "或", "但", "而", "从", "被", "把", "对", "以", "之", "所", "其", "中", "将", "并", "个", "两", "多", "少", "只",
    "已", "还", "又", "再", "能", "可", "该", "此", "每", "某", "各", "几", "哪", "何", "让", "使", "用", "做", "成", "如", "比", "向", "同", "跟", "a", "an", "the", "is",
    "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "can", "could", "may", "might", "shall",
    "should", "to", "of", "in", "for", "on", "with", "at", "by", "from", "as", "into", "through", "during", "before", "after", "about", "this",
    "that", "these", "those", "it", "its", "they", "them", "their", "we", "our", "you", "your", "he", "she", "his", "her",
)

# Selectors of elements that aren't an article's text
BOILERPLATE = (
    "nav", "footer", "header", "aside", ".nav", ".navbar", ".navigation", ".menu", ".topbar", ".header-bar", ".top-nav", ".footer", ".foot",
    ".bottom-bar", ".footer-content", ".site-footer", ".sidebar", ".side-bar", ".aside", ".sidepanel", ".right-rail", ".left-rail", ".ad", ".ads",
    ".advertisement", ".advert", ".banner", ".banner-ad", ".sponsored", ".social-share", ".share-buttons", ".social-media", ".social-links",
    ".comments", ".comment", "#comments", ".comment-section", ".comment-list", ".comment-form", ".related-posts", ".related-articles",
    ".recommendations", ".suggestions", ".popular-posts", ".trending", ".most-read", ".must-read", ".you-may-like", ".newsletter", ".subscribe",
    ".signup", ".mailing-list", ".email-signup", ".cookie", ".cookie-banner", ".cookie-consent", ".gdpr", ".notice-consent", ".popup", ".modal",
    ".overlay", ".lightbox", ".dialog", ".breadcrumb", ".breadcrumbs", ".pagination", ".page-nav", ".page-navigation", ".skip-link",
    ".visually-hidden", ".sr-only", ".screen-reader", ".hidden", ".copyright", ".legal", ".disclaimer", ".terms", ".privacy", ".search-box",
    ".search-form", ".search-bar", ".widget", ".widget-area", ".widget-title", ".author-bio", ".author-info", ".byline", ".tag-cloud", ".post-tags",
    ".category-list", ".post-navigation", ".prev-post", ".next-post", "#sidebar", "#nav", "#navigation", "#footer", "#comments", "script", "style",
    "noscript",
)
# fmt: on


@dataclass(frozen=True)
class Keyword:
    tier: str
    text: str
    categories: tuple[str, ...] = ()
    content_types: tuple[str, ...] = ()
    type: str = "normal"


@dataclass(frozen=True)
class Ambiguity:
    exclude: tuple[str, ...] = ()
    prefix: tuple[str, ...] = ()
    standalone: bool = True


@dataclass(frozen=True)
class Rules:
    keywords: tuple[Keyword, ...]
    ambiguity: dict[str, Ambiguity] = field(default_factory=dict)
    negative: tuple[str, ...] = ()
    demoted_sites: tuple[str, ...] = ()
    site_penalty: int = -20
    weights: dict[str, float] = field(default_factory=lambda: {"strong": 30.0, "medium": 15.0, "weak": 5.0})
    multipliers: dict[str, float] = field(default_factory=lambda: {"title": 2.0, "lead": 1.0, "body": 0.5, "tail": 0.8})
    ratios: dict[str, tuple[float, float]] = field(default_factory=lambda: {"A": (1.0, 1.0), "B": (0.6, 0.3), "C": (0.5, 0.2), "D": (0.0, 0.0)})
    lead_chars: int = 200
    tail_from_chars: int = 400
    accept: int = 50
    review: int = 45
    drop_below: int = 30
    medium_needs_strong: bool = False


CATEGORY_ORDER = ("Alpha", "Beta", "Gamma", "Delta")

#: Words that do occur in the test tables, spread over tiers, categories and special cases.
SAMPLE = Rules(
    keywords=(
        Keyword("strong", "License", ("Alpha", "Beta"), ("工具发布",)),
        Keyword("strong", "idiot", ("Gamma",)),
        Keyword("strong", "trash"),
        Keyword("strong", "anble", ("Delta",), ("行业分析",)),
        Keyword("medium", "this", ("Alpha",), (), "core"),
        Keyword("medium", "with", ("Beta",), ("行业分析",)),
        Keyword("medium", "by", ("Beta", "Gamma"), ("法规/标准发布",)),
        Keyword("medium", "und", ("Gamma",)),
        Keyword("medium", "rights reserved"),
        Keyword("weak", "que", ("Delta",)),
        Keyword("weak", "la", ("Alpha", "Delta"), ("漏洞披露",)),
        Keyword("weak", "than", ("Beta",)),
        Keyword("weak", "été", ("Gamma",)),
        Keyword("weak", "thinanea"),
    ),
    ambiguity={
        "with": Ambiguity(exclude=("hesh", "moron")),
        "la": Ambiguity(prefix=("les", "der", "el")),
        "by": Ambiguity(standalone=False),
    },
    negative=("stupid", "scum", "clown"),
    demoted_sites=("src3", "src7"),
)

# What user agents of mobile devices hold
MOBILE_AGENTS = ("mobile", "android", "iphone", "ipad", "phone", "ipod", "opera mini", "blackberry", "webos", "iemobile")

# What a scraper's rules are where a source doesn't state them
SCRAPER_DEFAULTS = {
    "article_selector": "article",
    "title_selector": "h2 a, h3 a, .entry-title a",
    "summary_selector": "p, .summary, .excerpt, .description",
    "date_selector": "time, .date, .published, .post-date",
    "link_selector": "",
    "link_base": "",
}
