"""Tokenisers, classifiers and other scalar text functions, as built-in expressions.

All take a column (or its name) and give a column.  Null input gives null unless
said otherwise; empty text gives an empty array or the rule's default.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = r"[\x{4e00}-\x{9fff}]"
#: White space as Unicode has it, for trimming and splitting.
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# Stop words and cue words of the text rules.
COMPOSER_STOP = ["怎么", "如何", "为什么", "什么", "呢", "吗", "的", "了", "和", "或", "是"]
GENERATOR_STOP = [*COMPOSER_STOP, "在"]
MATCH_STOP = ["的", "了", "是", "在", "和", "与", "或", "也", "都", "很", "一", "个", "这", "那", "有", "到", "对", "为", "以", "及"]
PROBLEM_KINDS = {"business_planning": ["商业", "business", "plan", "计划", "策略"], "product_optimization": ["产品", "product", "优化", "design"], "marketing_strategy": ["营销", "marketing", "推广", "宣传"]}
DOMAINS = {"business": ["商业", "business", "plan", "计划", "策略", "strategy"], "product": ["产品", "product", "feature", "特征", "功能"], "marketing": ["营销", "marketing", "推广", "宣传", "用户"], "technical": ["技术", "开发", "代码", "系统"]}
EXPERTISE = {"psychology": ["心理学", "用户", "行为", "motivation"], "data_analysis": ["数据", "分析", "统计", "metrics"], "finance": ["预算", "成本", "ROI", "财务"], "distribution": ["渠道", "发行", "delivery"], "product": ["产品", "特征", "功能"]}
POSITIVE = ["很好", "太好", "不错", "非常好", "完美", "棒", "对的", "准确", "有用", "great", "perfect", "correct", "useful", "good job", "excellent", "awesome", "well done", "nice work"]
NEGATIVE = ["不对", "错误", "缺少", "没有", "漏掉", "不够", "差", "wrong", "missing", "incorrect", "bad", "fail", "error", "怎么不", "为什么不", "应该", "需要加", "还差", "不全"]
ASPECTS = {"步骤": ["步骤", "流程", "顺序", "step", "process"], "内容": ["内容", "描述", "说明", "detail", "content", "description"], "数量": ["太少", "太多", "数量", "count"], "方向": ["方向", "思路", "角度", "approach", "direction"], "数据": ["数据", "分析", "统计", "data", "analysis"], "格式": ["格式", "排版", "结构", "format", "structure"]}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def equals(word: str):
    """A test of array elements for use in ``filter`` and ``exists``."""
    return lambda x: x == F.lit(word)


def holds(part: str):
    return lambda x: F.lower(x).contains(part)


def strip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), f"^{SPACE}+|{SPACE}+$", "")


def contains_any(c: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def first_kind(c: Column, kinds: dict[str, list[str]], default: str) -> Column:
    """The first kind one of whose words is contained."""
    out = None
    for kind, words in kinds.items():
        cond = contains_any(c, words)
        out = F.when(cond, kind) if out is None else out.when(cond, kind)
    return out.otherwise(default)


def search_tokens(c: Column | str) -> Column:
    """Words in lower case; a part that holds any Han character falls apart into all its characters."""
    parts = F.split(F.lower(col(c)), r"[^\p{L}\p{N}_]+")
    return F.filter(F.flatten(F.transform(parts, lambda p: F.when(p.rlike(HAN), F.split(p, "")).otherwise(F.array(p)))), lambda x: x != "")


def dedup_tokens(c: Column | str) -> Column:
    """Words of at least two characters after punctuation is blanked; Han runs stay whole."""
    plain = F.regexp_replace(F.lower(strip(c)), r"[^\p{L}\p{N}_\s\x{3000}\x{a0}]", " ")
    return F.filter(F.split(plain, f"{SPACE}+"), lambda x: F.length(x) > 1)


def blank_tokens(c: Column | str) -> Column:
    """Lower case, split at blanks; punctuation and single characters stay."""
    return F.filter(F.split(F.lower(strip(c)), f"{SPACE}+"), lambda x: x != "")


def keywords(c: Column | str, stop: Sequence[str] = COMPOSER_STOP, most: int = 5) -> Column:
    """The first words of at least two characters that aren't stop words; case is kept."""
    parts = F.split(strip(c), f"{SPACE}+")
    return F.slice(F.filter(parts, lambda x: (F.length(x) > 1) & ~x.isin(*stop)), 1, most)


def match_keywords(c: Column | str) -> Column:
    """With Han characters: their single characters and pairs without stop characters, once each; else words of three or more letters, repeats kept."""
    low = F.lower(col(c))
    han = F.regexp_replace(low, r"[^\x{4e00}-\x{9fff}]", "")
    n = F.length(han)
    ones = F.filter(F.split(han, ""), lambda x: x != "")
    twos = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(han, i, 2))).otherwise(F.array().cast("array<string>"))
    words = F.filter(F.split(strip(F.translate(low, ",.", "  ")), f"{SPACE}+"), lambda x: F.length(x) > 2)
    return F.when(n > 0, F.array_except(F.array_distinct(F.concat(ones, twos)), F.array(*map(F.lit, MATCH_STOP)))).otherwise(words)


def step_tokens(c: Column | str) -> Column:
    """The first five words of at least two characters, Chinese commas and stops taken as blanks."""
    return F.slice(F.filter(F.split(F.translate(col(c), "，。", "  "), f"{SPACE}+"), lambda x: F.length(x) > 1), 1, 5)


def normal_space(c: Column | str) -> Column:
    """Lower case, blanks at the ends gone, runs of blanks one space: equality for exact duplicates."""
    return F.regexp_replace(F.lower(strip(c)), f"{SPACE}+", " ")


def sentences(c: Column | str) -> Column:
    """Sentences of more than five characters, trimmed."""
    return F.filter(F.transform(F.split(col(c), r"[。；.!?\n]"), strip), lambda x: F.length(x) > 5)


def problem_kind(c: Column | str) -> Column:
    return first_kind(F.lower(col(c)), PROBLEM_KINDS, "problem_solving")


def expertise(c: Column | str) -> Column:
    """Fields whose words are contained in the lower-case text, in order (a word with capitals never is)."""
    low = F.lower(col(c))
    return F.array_compact(F.array(*[F.when(contains_any(low, words), F.lit(kind)) for kind, words in EXPERTISE.items()]))


def domain(c: Column | str) -> Column:
    x = F.concat_ws(" ", F.lower(col(c)), F.lower(F.array_join(keywords(c, GENERATOR_STOP), " ")))
    return first_kind(x, DOMAINS, "general")


def complexity(c: Column | str) -> Column:
    n = F.length(col(c))
    return F.when(n < 50, "low").when(n < 200, "medium").otherwise("high")


def clarity(c: Column | str) -> Column:
    n = F.length(col(c))
    return F.when(n < 50, 0.4).when(n < 200, 0.7).otherwise(0.9)


def aspects_of(c: Column | str) -> Column:
    """Up to three parts of a problem, 30 characters each; the problem's start if there is none."""
    x = col(c)
    parts = F.slice(F.concat(F.split(x, "。"), F.split(x, r"\?")), 1, 3)
    cut = F.filter(F.transform(parts, lambda s: F.substring(strip(s), 1, 30)), lambda s: s != "")
    return F.when(F.size(cut) > 0, cut).otherwise(F.array(F.substring(x, 1, 30)))


def sentiment(c: Column | str) -> Column:
    """positive, negative or neutral by which kind of phrase is contained more."""
    low = F.lower(col(c))
    count = lambda words: sum((F.when(low.contains(w), 1).otherwise(0) for w in words), F.lit(0))
    pos, neg = count(POSITIVE), count(NEGATIVE)
    return F.when(neg > pos, "negative").when(pos > neg, "positive").otherwise("neutral")


def aspect(c: Column | str) -> Column:
    return first_kind(F.lower(col(c)), ASPECTS, "general")


def title_of(prefix: Column, i: Column, chunk: Column) -> Column:
    """A chunk's title: prefix, number and the chunk cut to 57 characters and dots if over 60."""
    short = F.when(F.length(chunk) > 60, F.concat(F.substring(chunk, 1, 57), F.lit("..."))).otherwise(chunk)
    return F.concat(prefix, F.lit(" "), i.cast("string"), F.lit(": "), short)
