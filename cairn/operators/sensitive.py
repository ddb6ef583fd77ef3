"""Secrets in text: detection, spans, redaction by a set of patterns.

Every pattern is tried on the whole text.  Flags are JVM expressions; spans need
positions and a rule for overlaps, so they come from an Arrow function.
Null and empty texts are not sensitive and stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


@dataclass(frozen=True)
class Pattern:
    name: str
    category: str
    regex: str
    template: str


# Patterns of secrets, their categories and the text that takes their place.
PATTERNS = (
    Pattern("openai_api_key", "api_key", r"\bsk-[a-zA-Z0-9]{20,}\b", "[API_KEY:sk-***]"),
    Pattern("generic_api_key", "api_key", r"(?i)(?:api[_\-]?key|access[_\-]?key|secret[_\-]?key)\s*[:=]\s*([a-zA-Z0-9._\-]{16,})", "[API_KEY:***]"),
    Pattern("bearer_token", "access_token", r"(?i)Bearer\s+[a-zA-Z0-9._\-]{20,}", "[TOKEN:Bearer ***]"),
    Pattern("password_assignment", "password", r"(?i)(?:password|passwd|密码|口令)\s*[:：=]\s*(\S{4,})", "[PASSWORD:***]"),
    Pattern("chinese_national_id", "national_id", r"\b[1-9]\d{5}(?:18|19|20)\d{2}(?:0[1-9]|1[0-2])\d{2}\d{3}[\dXx]\b", "[ID:***]"),
    Pattern("bank_card", "bank_card", r"(?<!\d)\d{16,19}(?!\d)", "[BANK_CARD:****]"),
    Pattern("pem_private_key", "private_key", r"-----BEGIN\s+(?:RSA\s+|EC\s+|OPENSSH\s+)?PRIVATE KEY-----", "[PRIVATE_KEY:***]"),
)

SPAN = "array<struct<start int, end int, name string, category string, template string>>"


def jvm(regex: str) -> str:
    """A pattern for the JVM that takes blanks, digits, words and case as Unicode has them, as the spans' patterns do."""
    blank = tx.SPACE[1:-1]
    return "(?U)" + regex.replace(r"\S", f"[^{blank}]").replace(r"\s", f"[{blank}]").replace(r"\d", r"\p{Nd}")


def is_sensitive(c: Column | str, patterns: Sequence[Pattern] = PATTERNS) -> Column:
    """Whether any pattern matches; false for null."""
    x = F.col(c) if isinstance(c, str) else c
    out = F.lit(False)
    for p in patterns:
        out = out | F.coalesce(x.rlike(jvm(p.regex)), F.lit(False))
    return out


def categories(c: Column | str, patterns: Sequence[Pattern] = PATTERNS) -> Column:
    """Distinct categories found, in pattern order."""
    x = F.col(c) if isinstance(c, str) else c
    return F.array_distinct(F.array_compact(F.array(*[F.when(x.rlike(jvm(p.regex)), F.lit(p.category)) for p in patterns])))


def _spans_of(text: str, compiled: list[tuple[re.Pattern, Pattern]]) -> list[tuple[int, int, Pattern]]:
    found = [(m.start(), m.end(), p) for r, p in compiled for m in r.finditer(text)]
    kept: list[tuple[int, int, Pattern]] = []
    for s in sorted(found, key=lambda x: (x[0], x[0] - x[1])):
        if not kept or s[0] >= kept[-1][1]:
            kept.append(s)
    return kept


def scanned(df: DataFrame, text: str, patterns: Sequence[Pattern] = PATTERNS) -> DataFrame:
    """``df`` with is_sensitive, categories, items (spans that don't overlap, the earliest and longest first) and redacted."""
    hit = is_sensitive(text, patterns)

    @F.pandas_udf(f"struct<items: {SPAN.replace(' int', ': int').replace(' string', ': string')}, redacted: string>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compiled = [(re.compile(p.regex), p) for p in patterns]
        for s in batches:
            items, texts = [], []
            for t in s:
                spans = _spans_of(t, compiled) if t else []
                out, at = [], 0
                for a, b, p in spans:
                    out += [t[at:a], p.template]
                    at = b
                items.append([{"start": a, "end": b, "name": p.name, "category": p.category, "template": p.template} for a, b, p in spans])
                texts.append("".join(out) + t[at:] if t is not None else None)
            yield pd.DataFrame({"items": items, "redacted": texts})

    # only texts that match anything leave the JVM
    d = df.withColumn("is_sensitive", hit).withColumn("categories", categories(text, patterns))
    d = d.withColumn("_scan", scan(F.when(F.col("is_sensitive"), F.col(text))))
    empty = F.array().cast(SPAN.replace("struct<start int, end int, name string, category string, template string>", "struct<start:int,end:int,name:string,category:string,template:string>"))
    return d.withColumn("items", F.when(F.col("is_sensitive"), F.col("_scan.items")).otherwise(empty)).withColumn("redacted", F.when(F.col("is_sensitive"), F.col("_scan.redacted")).otherwise(F.col(text))).drop("_scan")
