"""Default lists and limits. Every operator takes its own; these are only what it starts from."""

from __future__ import annotations

# Categories in catalogue order with the keywords that point to them.
CATCH_ALL = "其他AI相关"
CATEGORY_KEYWORDS: dict[str, list[str]] = {
    "AI在金融领域应用": ["金融", "银行", "证券", "保险", "投研", "风控", "反欺诈", "量化", "财富管理", "fintech", "banking", "finance", "insurance", "trading"],
    "Agent与智能体": ["agent", "智能体", "multi-agent", "工具调用", "workflow", "mcp"],
    "多模态技术": ["多模态", "视觉", "图像", "视频", "语音", "数字人", "vision", "image", "video", "speech"],
    "AI基础设施": ["gpu", "芯片", "算力", "推理服务", "分布式训练", "数据库", "向量库", "inference", "serving", "cuda", "存储"],
    "安全与伦理": ["安全", "合规", "监管", "对齐", "隐私", "版权", "攻击", "security", "safety", "alignment"],
    "开源生态": ["开源", "open source", "github", "社区", "许可证", "生态"],
    "生成式AI应用": ["copilot", "代码生成", "内容生成", "企业应用", "rag", "知识库", "应用", "产品化"],
    "大模型基础技术": ["大模型", "llm", "模型", "训练", "微调", "蒸馏", "moe", "attention", "上下文", "推理优化"],
    "行业动态": ["融资", "并购", "发布", "政策", "市场", "厂商", "投资", "acquisition", "launch"],
}
# Terms that show relevance.
RELEVANCE_TERMS = ["ai", "人工智能", "大模型", "模型", "llm", "agent", "智能体", "机器学习", "深度学习", "生成式", "推理", "训练", "多模态", "rag", "copilot"]
# Fixed values: (domain, largest relevance, terms), the first that matches counts.
DOMAIN_CAPS: list[tuple[str, float, list[str]]] = [
    ("computer_vision", 1.0, ["computer vision", "agentic vision", "visual intelligence", "vision model", "vision agent", "视觉", "计算机视觉", "图像", "影像", "视频", "多模态视觉"]),
    ("consumer_device", 1.0, ["consumer electronics", "smartphone", "ai phone", "wearable", "personal device", "keyboard", "peripheral", "consumer device", "消费电子", "智能手机", "ai手机", "可穿戴", "个人终端", "端侧终端", "键盘", "外设", "迷你键盘", "可编程硬件"]),
    ("hardware", 2.0, ["gpu", "cuda", "risc-v", "ai chip", "hardware", "server hardware", "芯片", "硬件", "算力硬件", "硬件融资", "服务器硬件", "纯gpu"]),
]
# Part of a label, and the category it stands for, in order.
CATEGORY_SYNONYMS = [
    ("大语言模型", "大模型基础技术"), ("LLM", "大模型基础技术"), ("AI Agent", "Agent与智能体"), ("智能体", "Agent与智能体"), ("多模态", "多模态技术"), ("部署与推理", "AI基础设施"),
    ("数据与评测", "AI基础设施"), ("安全与对齐", "安全与伦理"), ("开源", "开源生态"), ("金融AI", "AI在金融领域应用"), ("金融应用", "AI在金融领域应用"),
]
# Verticals that never count as finance.
OTHER_VERTICALS = ["医学", "医疗", "化学", "物理", "科学", "科研", "教育", "制造", "政务"]
# Names under which a model answers each score.
SCORE_KEYS = {
    "tech_depth": ["tech_depth", "score_tech_depth", "技术深度"],
    "engineering": ["engineering", "score_engineering", "工程参考价值"],
    "org_relevance": ["org_relevance", "score_org_relevance", "组织相关性"],
    "trend": ["trend", "score_trend", "趋势重要性"],
    "timeliness": ["timeliness", "score_timeliness", "时效性"],
}
# Relevance is taken down to one of these.
ANCHORS = [0.0, 1.0, 2.0, 3.0, 6.0, 7.0, 8.0, 9.0, 10.0]
# Fixed values: (age in days up to, timeliness); older than the last is 0.
TIMELINESS = [(0, 10.0), (2, 9.0), (4, 8.0), (7, 7.0), (14, 6.0), (21, 5.0), (30, 4.0), (60, 3.0), (90, 2.0), (180, 1.0)]
# Weights of the rank score.
RANK_WEIGHTS = {"org_relevance": "0.35", "trend": "0.30", "engineering": "0.20", "tech_depth": "0.10", "timeliness": "0.05"}
# Query parameters that only track.
TRACKING_KEYS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "spm"]
# Hints of listing pages, segments and endings that no article has.
LISTING_HINTS = ["ai", "ml", "news", "blog", "research", "technology", "tech", "article", "fintech", "finance", "policy", "security", "agent", "model", "product"]
NON_ARTICLE_SEGMENTS = ["about", "contact", "login", "register", "search", "tag", "tags", "author", "category", "categories", "topic", "topics", "video", "live", "events"]
INDEX_NAMES = ["index", "home", "latest", "archive", "archives"]
ASSET_ENDINGS = [".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".css", ".js", ".pdf", ".zip", ".rar", ".xml", ".json", ".ico", ".woff", ".woff2"]
BLOCKED_PATHS = ["/tag/", "/tags/", "/category/", "/categories/", "/topic/", "/topics/", "/author/", "/about", "/login", "/register", "/search", "/video", "/live"]
BLOCKED_ENDINGS = [".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".css", ".js", ".pdf", ".zip", ".rar"]
BLOCKED_TITLES = ["首页", "更多", "登录", "注册", "关于我们", "加入我们", "联系我们"]
# Opinions are no events.
OPINION_TERMS = ["观点", "评论", "访谈", "人物言论", "争议", "社论", "解读"]

CANDIDATE_LIMIT, INITIAL_LIMIT, REFILL_LIMIT = 100, 50, 10
SIMILARITY = 0.34
