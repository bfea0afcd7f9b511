"""Fixed values.

Word lists and lookup tables that results depend on.  They are data, kept in
their natural order, one table per name.
"""

# File types a crawl never follows.
SKIPPED_FILE_EXTENSIONS = (
    ".png", ".jpg", ".jpeg", ".gif", ".css", ".js", ".ico", ".svg", ".tiff", ".zip", ".exe",
    ".dmg", ".mp4", ".mp3", ".wav", ".pptx", ".xlsx", ".avi", ".flv", ".woff", ".ttf", ".woff2",
    ".webp", ".inc",
)

# Schemes that are not web pages.
NON_WEB_PROTOCOLS = ("mailto:", "tel:", "telnet:", "ftp:", "ftps:", "ssh:", "file:")

# Sites treated as social media or contact links.
SOCIAL_SITES = (
    "facebook.com", "twitter.com", "linkedin.com", "instagram.com", "pinterest.com",
    "github.com", "calendly.com", "discord.gg", "discord.com",
)

# Office document paths and content types.
DOCUMENT_EXTENSIONS = ("docx", "odt", "rtf", "xlsx", "xls")
DOCUMENT_CONTENT_TYPES = (
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "application/vnd.ms-excel",
    "application/msword",
    "application/rtf",
    "text/rtf",
    "application/vnd.oasis.opendocument.text",
)

# Hosts that serve advertising.
ADSERVER_DOMAINS = (
    "doubleclick.net", "adservice.google.com", "googlesyndication.com", "googletagservices.com",
    "googletagmanager.com", "google-analytics.com", "adsystem.com", "adservice.com", "adnxs.com",
    "ads-twitter.com", "facebook.net", "fbcdn.net", "amazon-adsystem.com",
)

# Page regions that are not main content, as selectors.
BOILERPLATE_SELECTORS = (
    "header", "footer", "nav", "aside", ".header", ".top", ".navbar", "#header", ".footer",
    ".bottom", "#footer", ".sidebar", ".side", ".aside", "#sidebar", ".modal", ".popup", "#modal",
    ".overlay", ".ad", ".ads", ".advert", "#ad", ".lang-selector", ".language",
    "#language-selector", ".social", ".social-media", ".social-links", "#social", ".menu",
    ".navigation", "#nav", ".breadcrumbs", "#breadcrumbs", ".share", "#share", ".widget",
    "#widget", ".cookie", "#cookie", ".fc-decoration",
)

# Markers that keep a region although it matches the list above.
FORCE_KEEP_SELECTORS = (
    "#main", ".swoogo-cols", ".swoogo-text", ".swoogo-table-div", ".swoogo-space",
    ".swoogo-alert", ".swoogo-sponsors", ".swoogo-title", ".swoogo-tabs", ".swoogo-logo",
    ".swoogo-image", ".swoogo-button", ".swoogo-agenda",
)

# Elements dropped before any content selection.
NEVER_CONTENT_TAGS = ("head", "meta", "noscript", "style", "script")

# Typed metadata fields: output name -> (meta attribute, key).
TYPED_META = {
    "ogTitle": ("property", "og:title"),
    "ogDescription": ("property", "og:description"),
    "ogUrl": ("property", "og:url"),
    "ogImage": ("property", "og:image"),
    "ogAudio": ("property", "og:audio"),
    "ogDeterminer": ("property", "og:determiner"),
    "ogLocale": ("property", "og:locale"),
    "ogSiteName": ("property", "og:site_name"),
    "ogVideo": ("property", "og:video"),
    "articleSection": ("name", "article:section"),
    "articleTag": ("name", "article:tag"),
    "publishedTime": ("property", "article:published_time"),
    "modifiedTime": ("property", "article:modified_time"),
    "dcTermsKeywords": ("name", "dcterms.keywords"),
    "dcDescription": ("name", "dc.description"),
    "dcSubject": ("name", "dc.subject"),
    "dcTermsSubject": ("name", "dcterms.subject"),
    "dcTermsAudience": ("name", "dcterms.audience"),
    "dcType": ("name", "dc.type"),
    "dcTermsType": ("name", "dcterms.type"),
    "dcDate": ("name", "dc.date"),
    "dcDateCreated": ("name", "dc.date.created"),
    "dcTermsCreated": ("name", "dcterms.created"),
}

# English words that carry no search meaning.
ENGLISH_STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "shall", "can", "need", "must",
    "how", "to", "what", "which", "who", "whom", "when",
    "where", "why", "for", "and", "or", "but", "in", "on", "at", "of",
    "with", "by", "from", "as", "into", "through", "during", "before",
    "after", "above", "below", "between", "out", "off", "over", "under",
    "again", "further", "then", "once",
    "best", "good", "better", "great", "top", "most", "more", "very",
    "really", "some", "any", "each", "every", "all", "both", "few",
    "its", "it's", "my", "your", "his", "her", "our", "their",
    "i", "me", "you", "he", "she", "it", "we", "they", "this", "that",
    "these", "those", "not", "no", "nor", "so", "if", "just", "about",
)

# Chinese particles dropped from a query, and whole words that are not keywords.
CHINESE_FILLERS = "的了吗呢吧啊哦哈呀嘛么诶嗯哪哎唉哇喔额呵吧嗒吧唧"
CHINESE_STOP_WORDS = (
    "如何", "为什么", "为啥", "怎么", "怎样", "是什么", "哪些", "哪个", "什么", "可以", "能够",
    "应该", "需要", "比较", "哪个好", "怎么样", "是不是", "有没有", "哪里", "哪儿", "多久",
    "多少", "几个", "是否",
)

# Query wording -> time range, in order of preference.
TIME_RANGE_PATTERNS = (
    ("day", "今日|今天|today|latest|最新|当前|current|实时"),
    ("month", "最近|recent|本周|this week|本月|this month"),
    ("year", "今年|this year|年度"),
)

# Query wording -> query type, in order of preference.
QUERY_TYPE_PATTERNS = (
    ("troubleshoot", "fix|error|issue|bug|problem|troubleshoot|debug|报错|解决|修复|排查|异常|失败|cannot|can't|unable"),
    ("comparison", "vs|versus|compare|对比|比较|difference|区别|哪个好|选哪个"),
    ("factual", "what is|是什么|define|定义|概念|含义|meaning"),
    ("howto", "how to|how do|教程|指南|guide|tutorial|入门|实践|步骤|怎么做|如何做|怎么实现"),
    ("news", "新闻|news|最新报道|breaking|快讯|today's"),
    ("research", "论文|paper|arxiv|研究|学术|scholar|doi|journal|conference"),
)

# Search back ends per query language.
LANGUAGE_ROUTES = {
    "zh": "baidu,sogou,360search,bing",
    "en": "google,bing,duckduckgo,brave",
    "mixed": "baidu,sogou,360search,bing,google,duckduckgo,brave",
}

# Text added to a query by type.
QUERY_SUFFIXES = {
    "troubleshoot": " site:stackoverflow.com OR site:github.com OR site:segmentfault.com OR site:juejin.cn OR site:csdn.net OR site:zhihu.com OR site:v2ex.com",
    "comparison": " comparison review vs",
    "howto": " 教程 guide tutorial",
    "news": " 最新 news",
    "research": " paper research",
}
DEFINITION_PATTERN = "是什么|what is|define|定义"
DEFINITION_SUFFIX = " 全称 介绍 概念"
