"""Settings as frozen groups, passed explicitly. The defaults, patterns and word lists below define results."""

from __future__ import annotations

from dataclasses import dataclass, field

WHITESPACE = r"[\t\n\v\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SECTION_STARTS = (
    r"第[一二三四五六七八九十百零〇\d]+条",
    r"第[一二三四五六七八九十百零〇\d]+章",
    r"第[一二三四五六七八九十百零〇\d]+节",
    r"\d+\.\d+\.\d+",
    r"\d+\.\d+(?!\d)",
    r"[一二三四五六七八九十]+、",
)
TITLES = (r"第[一二三四五六七八九十百零〇\d]+[章节条]", r"\d+\.\d+\.\d+", r"[一二三四五六七八九十]+、")
SENTENCE = r"[^。；！？;]*[。；！？;]|[^。；！？;]+$"
CAPTION = r"(?m)^\s*(图|表)\s*\d+([-.．]\d+)*"
PAGE_NUMBER_LINE = r"^\s*\d{1,4}\s*$"
FRAGMENT = r"\|\s*[一-鿿]\s*\|\s*[一-鿿]\s*\|"
MODAL_WORDS = ("应当", "不得", "严禁", "不应", "必须", "不少于", "不大于")
QUERY_INSTRUCTION = "为这个句子生成表示以用于检索相关文章："
SUPPORTED = ("txt", "md", "pdf", "docx", "doc", "xlsx", "xls")
MODES = ("vector", "bm25", "hybrid", "hybrid_rerank")
NUMBER_RUN = "[〇零一二两三四五六七八九十百千万亿壹贰叁肆伍陆柒捌玖]{1,8}"
UNIT_GATE = "人日年月个次分米mM%倍元级层跨度步道种台套处项条款段根组件张块号天周旬小时"
#: One Han character or one run of Latin letters and digits is a token.
TOKEN = r"[a-z0-9]+|[一-鿿]"


@dataclass(frozen=True)
class Quality:
    min_cjk_ratio: float = 0.40
    readable_ratio: float = 0.50
    min_chars_per_page: int = 150
    garbage_ratio: float = 0.7
    garbage_min_cells: int = 8
    sample_pages: int = 6
    table_mb: float = 30
    table_pages: int = 120


@dataclass(frozen=True)
class Chunking:
    size: int = 450
    overlap: int = 80
    table_max: int = 900


@dataclass(frozen=True)
class Retrieval:
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25
    top_k: int = 20
    rrf_k: int = 60
    pool: int = 30
    final: int = 5
    deep: int = 100


@dataclass(frozen=True)
class Limits:
    per_window: int = 20
    window_s: int = 60
    ttl_answer_s: int = 3600
    ttl_retrieval_s: int = 1800
    min_interval_s: float = 3.0


@dataclass(frozen=True)
class Settings:
    quality: Quality = field(default_factory=Quality)
    chunking: Chunking = field(default_factory=Chunking)
    retrieval: Retrieval = field(default_factory=Retrieval)
    limits: Limits = field(default_factory=Limits)
    cache_prefix: str = "strataq"


DEFAULT = Settings()
