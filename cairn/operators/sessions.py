"""Session logs: summaries, context, pending items, and statements worth saving.

The log is append-only rows (event_id, session_id, event_ts, event_type, content).
Order within a session is (event_ts, event_id), rows without a time last.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .records import TASK_TYPES


@dataclass(frozen=True)
class Rule:
    regex: str
    destination: str
    category: str
    confidence: float
    reason: str
    tags: tuple[str, ...]


# Rules for statements worth saving, in order.
RULES = (
    Rule(r"(我比较喜欢|我很喜欢|我喜欢|我爱|我偏好|我倾向).{2,}", "ltm", "preference", 0.85, "检测到用户偏好表达", ("偏好",)),
    Rule(r"(I\s+(like|prefer|love|enjoy))\s+.{4,}", "ltm", "preference", 0.85, "检测到用户偏好表达（英文）", ("偏好",)),
    Rule(r"(不喜欢|讨厌|我不想|我不喜欢).{2,}", "ltm", "preference", 0.80, "检测到用户负向偏好", ("偏好", "负向")),
    Rule(r"(hate|don'?t\s+like|dislike)\s+.{4,}", "ltm", "preference", 0.80, "检测到用户负向偏好（英文）", ("偏好", "负向")),
    Rule(r"(我的目标|我想要|我计划|我打算|我希望|我要).{3,}", "ltm", "goal", 0.82, "检测到用户目标/计划", ("目标",)),
    Rule(r"(My goal|I want to|I plan to|I aim)\s+.{4,}", "ltm", "goal", 0.82, "检测到用户目标/计划（英文）", ("目标",)),
    Rule(r"(我叫|我的名字是|我是)[A-Za-z一-鿿]{2,}", "ltm", "profile", 0.90, "检测到用户身份信息", ("个人信息",)),
    Rule(r"(I'm|I am|My name is)\s+[A-Za-z一-鿿]{2,}", "ltm", "profile", 0.90, "检测到用户身份信息（英文）", ("个人信息",)),
    Rule(r"(我住在|我在|我来自|我工作在).{3,}", "ltm", "profile", 0.85, "检测到用户地理/工作信息", ("个人信息",)),
    Rule(r"(I live in|I'm from|I work at)\s+.{3,}", "ltm", "profile", 0.85, "检测到用户地理/工作信息（英文）", ("个人信息",)),
    Rule(r"(我每天|我通常|我习惯|我一般|我经常).{3,}", "ltm", "habit", 0.78, "检测到用户习惯描述", ("习惯",)),
    Rule(r"(I usually|I always|I tend to|I often)\s+.{4,}", "ltm", "habit", 0.78, "检测到用户习惯描述（英文）", ("习惯",)),
    Rule(r"(是指|是一种|的意思是).{5,}", "kb", "technical", 0.75, "检测到概念定义或解释", ("知识", "定义")),
    Rule(r"(defined as|means that|refers to|is a)\s+.{10,}", "kb", "technical", 0.75, "检测到概念定义或解释（英文）", ("知识", "定义")),
    Rule(r"(研究表明|数据显示|事实上|实际上|根据.*表明).{5,}", "kb", "reference", 0.72, "检测到事实性陈述", ("事实",)),
    Rule(r"(according to|studies show|in fact|the truth is)\s+.{10,}", "kb", "reference", 0.72, "检测到事实性陈述（英文）", ("事实",)),
    Rule(r"(步骤|第一步|首先).{5,}", "kb", "technical", 0.70, "检测到操作步骤描述", ("操作", "指南")),
    Rule(r"(how to|step\s+\d|first.*then)\s+.{10,}", "kb", "technical", 0.70, "检测到操作步骤描述（英文）", ("操作", "指南")),
)
#: Event types that a user wrote, and the longest part of an event that is looked at.
WRITTEN = ("user_message", "user_input", "message", "")
LOOKED_AT, SHORTEST = 300, 8


def task_type(c: Column) -> Column:
    return F.when(c.isin(*TASK_TYPES), c).otherwise("general")


def summary(events: DataFrame) -> DataFrame:
    """(session_id, events, started, ended, seconds, event_types): one row for each session; sessions without a time have null seconds."""
    d = events.groupBy("session_id").agg(F.count("*").alias("events"), F.min("event_ts").alias("started"), F.max("event_ts").alias("ended"), F.array_sort(F.collect_set("event_type")).alias("event_types"))
    seconds = (F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / 1_000_000
    return d.withColumn("seconds", F.floor(seconds).cast("long"))


def active(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """(session_id, task_type, events, pending) of active sessions."""
    counts = events.groupBy("session_id").agg(F.count("*").alias("events"))
    s = sessions.where("is_active").select("session_id", task_type(F.col("task_type")).alias("task_type"), F.coalesce(F.size("pending_saves"), F.lit(0)).alias("pending"))
    s = s.withColumn("pending", F.greatest("pending", F.lit(0)))
    return s.join(counts, "session_id", "left").select("session_id", "task_type", F.coalesce("events", F.lit(0)).alias("events"), "pending")


def latest_context(updates: DataFrame) -> DataFrame:
    """(session_id, key, value): the last value of each key from updates (session_id, key, value, ts)."""
    return updates.groupBy("session_id", "key").agg(F.max_by("value", "ts").alias("value"))


def pending(sessions: DataFrame) -> DataFrame:
    """One row for each pending item, with the defaults of a queue."""
    d = sessions.select("session_id", F.explode("pending_saves").alias("p")).select("session_id", "p.*")
    return d.withColumn("destination", F.coalesce("destination", F.lit("ltm")))


def flushed(items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pending items as rows for the memories, rows for the knowledge base (title from the content) and rejects with their error."""
    from .records import KB_CATEGORIES, LTM_CATEGORIES

    blank = F.coalesce(tx.strip("content"), F.lit("")) == ""
    to_kb = F.col("destination") == "kb"
    known = F.when(to_kb, F.col("category").isin(*KB_CATEGORIES)).otherwise(F.col("category").isin(*LTM_CATEGORIES))
    d = items.withColumn("error", F.when(blank, "content is empty").when(~F.coalesce(known, F.lit(False)), "unknown category"))
    good = d.where("error is null").drop("error")
    return good.where(~to_kb), good.where(to_kb).withColumn("title", F.substring("content", 1, 60)), d.where("error is not null")


def _snippet(text: str, a: int, b: int) -> str:
    start = max(0, a - 10)
    out = text[start : b + 80].strip()
    if start and not text[start - 1].isspace() and (gap := out.find(" ")) > 0:
        out = out[gap:].strip()
    return out[:LOOKED_AT]


def _compiled() -> list[tuple[re.Pattern, Rule]]:
    return [(re.compile(r.regex, re.IGNORECASE | re.DOTALL), r) for r in RULES]


def suggestions_in(texts: list[str], seen: set[str], threshold: float, compiled: list[tuple[re.Pattern, Rule]]) -> list[tuple[int, Rule, str]]:
    """(text number, rule, snippet): for each destination the first rule of an event whose snippet is new."""
    out = []
    for i, t in enumerate(texts):
        part = t[:LOOKED_AT]
        for destination in ("ltm", "kb"):
            for regex, rule in compiled:
                if rule.destination != destination or not (m := regex.search(part)):
                    continue
                snippet = _snippet(part, m.start(), m.end())
                mark = snippet[:60].lower()
                if mark in seen:
                    continue
                if rule.confidence >= threshold:
                    out.append((i, rule, snippet))
                    seen.add(mark)
                break
    return out


SUGGESTION = "session_id string, event_id long, destination string, category string, confidence double, reason string, tags array<string>, content string"


def written_events(events: DataFrame) -> DataFrame:
    """Events that a user wrote, of at least 8 characters without blanks at the ends; a missing type counts as empty."""
    d = events.withColumn("content", tx.strip("content"))
    return d.where(F.coalesce("event_type", F.lit("")).isin(*WRITTEN) & (F.length("content") >= SHORTEST))


def first_rule(events: DataFrame, written: bool = True) -> DataFrame:
    """(event_id, session_id, ltm_category, kb_category): the first matching rule of each event by itself, as JVM expressions."""
    d = written_events(events) if written else events.where(F.length("content") >= SHORTEST)
    part = F.substring("content", 1, LOOKED_AT)
    picks = {}
    for destination in ("ltm", "kb"):
        pick = None
        for r in RULES:
            if r.destination == destination:
                cond = part.rlike("(?ius)" + r.regex.replace("\\u4e00-\\u9fff", r"\x{4e00}-\x{9fff}"))
                pick = F.when(cond, r.category) if pick is None else pick.when(cond, r.category)
        picks[destination] = pick
    return d.select("event_id", "session_id", picks["ltm"].alias("ltm_category"), picks["kb"].alias("kb_category")).where("ltm_category is not null or kb_category is not null")


def suggestions(events: DataFrame, threshold: float = 0.70) -> DataFrame:
    """Statements worth saving of each session, an ordered fold: a snippet that came before sends an event to its next rule.

    Only events that match any rule leave the JVM.  The fold needs what was seen
    before in the session, so a session is one group; its state is bounded by the
    distinct snippets, and rows stream through in order.
    """
    hits = first_rule(events).select("event_id")
    rows = written_events(events).join(hits, "event_id", "left_semi").select("session_id", "event_id", "event_ts", F.substring("content", 1, LOOKED_AT).alias("content"))
    ordered = rows.repartition("session_id").sortWithinPartitions("session_id", F.col("event_ts").asc_nulls_last(), "event_id")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled, session, seen = _compiled(), object(), set()
        for b in batches:
            out = []
            for sid, eid, t in zip(b["session_id"], b["event_id"], b["content"]):
                if sid != session:
                    session, seen = sid, set()
                for _, r, s in suggestions_in([t], seen, threshold, compiled):
                    out.append((sid, eid, r.destination, r.category, r.confidence, r.reason, list(r.tags), s))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in SUGGESTION.split(", ")])

    return ordered.mapInPandas(fold, SUGGESTION)
