"""Question decomposition and intent routing by rules, as column expressions (no join, no shuffle)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions import text as T

#: What parts questions, joins their parts, and ends a topic.
PART_MARKS = "[？?；;。]"
JOINERS = "，|,|并且|以及|同时|另外|还有"
CONTEXT = "^((?:根据|依据).{1,30}?[，,])(.+)$"
TOPIC = "(?i)^(.{1,30}?(?:这个|该|本|根据|依据)?(?:PRD|文档|需求|文件))"


@dataclass(frozen=True)
class Intent:
    name: str
    title: str
    dependency: str
    temperature: float
    keywords: tuple[str, ...]


#: The intents, how far each depends on documents, its sampling temperature and its words.
INTENTS = (
    Intent("qa", "知识问答", "strict", 0.0, ("什么", "多少", "是否", "有没有", "要求", "规定", "支持", "包含")),
    Intent("extract", "信息抽取", "strict", 0.0, ("抽取", "提取", "字段", "列出", "名称", "指标", "参数")),
    Intent("compare", "对比分析", "strict", 0.1, ("对比", "比较", "区别", "差异", "相同", "不同")),
    Intent("summary", "文档总结", "strict", 0.2, ("总结", "概括", "归纳", "梳理", "摘要")),
    Intent("reason_analysis", "原因分析", "semi_strict", 0.3, ("原因", "为什么", "分析", "影响", "风险")),
    Intent("plan_generation", "方案生成", "semi_strict", 0.5, ("方案", "计划", "步骤", "建议", "怎么做", "如何实现")),
    Intent("tool_call", "工具调用", "strict", 0.0, ("调用", "查询", "检索", "运行", "执行", "工具")),
    Intent("clarification", "澄清反问", "open", 0.3, ("什么意思", "不清楚", "怎么理解", "需要哪些信息", "澄清")),
    Intent("privacy_rejection", "文档防泄露拒答", "strict", 0.0, ("泄露", "密钥", "密码", "隐私", "身份证", "手机号", "全部原文")),
    Intent("context_followup", "多轮追问", "depends", 0.2, ("继续", "上面", "刚才", "这个", "它", "前面")),
    Intent("chat", "普通闲聊", "open", 0.7, ("你好", "谢谢", "你是谁", "聊天", "讲个笑话")),
)
DEFAULT_INTENT = "qa"
#: Patterns that add to an intent's score.
BONUSES = (
    ("extract", "(抽取|提取|字段|列出).{0,12}[:：]", 3),
    ("compare", "(对比|比较).*(和|与|及|以及)", 3),
    ("summary", "(总结|概括|摘要|归纳)", 2),
    ("reason_analysis", "(原因|为什么|为何)", 2),
    ("plan_generation", "(方案|计划|建议|步骤|怎么做|如何)", 2),
    ("privacy_rejection", "(泄露|密码|密钥|身份证|隐私|手机号|全部原文)", 4),
    ("context_followup", "(继续|上面|刚才|前面|这个|它)", 1),
)


def _peel(text: Column) -> Column:
    return F.regexp_replace(text, "^[ ，,]+|[ ，,]+$", "")


def rule_parts(question: Column) -> Column:
    """Parts of a question by marks and joiners, with its context or topic put before the parts that lack it."""

    def parts(piece: Column, context: Column) -> Column:
        subs = F.split(piece, JOINERS)
        named = F.regexp_extract(piece, TOPIC, 1)
        topic = F.when(named != "", named).when(F.contains(piece, F.lit("，")), F.get(F.split(piece, "，"), 0)).otherwise(F.lit(""))
        kept = F.filter(F.transform(subs, _peel), lambda s: s != "")
        lacks = lambda s: (topic != "") & ~F.startswith(s, topic) & (F.length(s) < 16)
        whole = F.transform(kept, lambda s: F.when(context != "", F.concat(context, s)).when(lacks(s), F.concat(topic, s)).otherwise(s))
        return F.when(F.size(subs) == 1, F.array(piece)).otherwise(whole)

    def split(q: Column) -> Column:
        context = F.regexp_extract(q["stripped"], CONTEXT, 1)
        body = F.when(context != "", F.regexp_extract(q["stripped"], CONTEXT, 2)).otherwise(q["asked"])
        pieces = F.filter(F.transform(F.split(body, rf"(?U){PART_MARKS}\s*"), _peel), lambda p: p != "")
        return T.bound(context, lambda c: F.flatten(F.transform(pieces, lambda piece: parts(piece, c))))

    return T.bound(F.struct(T.strip(question).alias("stripped"), question.alias("asked")), split)


def clean_parts(parts: Column, question: Column, most: int = 4) -> Column:
    """Distinct, trimmed parts in order, at most so many; the question itself if none is left."""
    trimmed = F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(p, rf"(?U){T.BLANK}+", " "), "^[ ，,。？?]+|[ ，,。？?]+$", ""))
    kept = F.slice(F.array_distinct(F.filter(trimmed, lambda p: p != "")), 1, most)
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(question))


def decompose(question: Column, enabled: bool = True, most: int = 4) -> Column:
    q = T.strip(F.coalesce(question, F.lit("")))
    whole = clean_parts(rule_parts(q), q, most) if enabled else F.array(q)
    return F.when(q == "", F.array().cast("array<string>")).otherwise(whole)


def intent_scores(question: Column) -> Column:
    """Array of (intent, score) with a positive score."""
    low = F.lower(T.strip(question))
    rows = []
    for p in INTENTS:
        hits = sum((F.contains(low, F.lit(k)).cast("int") for k in p.keywords[1:]), F.contains(low, F.lit(p.keywords[0])).cast("int"))
        for name, pattern, more in BONUSES:
            if name == p.name:
                hits = hits + F.when(low.rlike(pattern), F.lit(more)).otherwise(F.lit(0))
        rows.append(F.struct((-hits).alias("order"), F.lit(p.name).alias("intent")))
    return F.filter(F.array(*rows), lambda r: r["order"] < 0)


def rule_intent(question: Column) -> Column:
    """The intent of the highest score, ties by name; blank asks for clarification, no score gives null."""
    best = F.array_min(intent_scores(question))["intent"]
    return F.when(T.strip(F.coalesce(question, F.lit(""))) == "", F.lit("clarification")).otherwise(best)


def said_intent(answer: Column) -> Column:
    """The intent that a model's answer states as a JSON object, alone or among other words; null if it isn't a known one."""
    inner = F.regexp_extract(answer, r"(?s)(\{.*\})", 1)
    said = T.strip(F.coalesce(F.get_json_object(answer, "$.intent"), F.get_json_object(inner, "$.intent")))
    return F.when(said.isin([p.name for p in INTENTS]), said)


def profile_columns(intent: Column) -> dict[str, Column]:
    """Temperature and document dependency of an intent, the default's if unknown."""
    known = F.when(intent.isin([p.name for p in INTENTS]), intent).otherwise(F.lit(DEFAULT_INTENT))
    pick = lambda of: F.element_at(F.create_map(*[F.lit(x) for p in INTENTS for x in (p.name, of(p))]), known)
    return {"intent_temperature": pick(lambda p: p.temperature), "document_dependency": pick(lambda p: p.dependency)}


def exploded_parts(queries: DataFrame, query_key: str, text: str = "text", most: int = 4) -> DataFrame:
    """query_key, part (from 1), part_text, n_parts; a question of one part is searched as it was asked."""
    rows = queries.select(query_key, F.col(text).alias("_q"), decompose(F.col(text), most=most).alias("_p"))
    parts = F.when(F.size("_p") <= 1, F.array("_q")).otherwise(F.col("_p"))
    out = rows.select(query_key, F.greatest(F.size("_p"), F.lit(1)).alias("n_parts"), F.posexplode(parts).alias("part", "part_text"))
    return out.withColumn("part", F.col("part") + 1)
