"""Search: BM25 and keyword scoring, fusion of result lists, relevance of skills.

A query is a parameter, so its terms are literals of the plan: documents are
scored in one pass without a join.  BM25 needs the number of documents, their
mean length, how many hold each query term, and, for the floor of negative
weights, the mean weight over the vocabulary; these come from aggregations over
the filtered pool (statistics follow the filter) and are joined as one row.
Null text counts as empty.  Blank queries list the newest rows instead.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import blocks, records

K1, B, EPSILON = 1.5, 0.75, 0.25


def query_tokens(query: str) -> list[str]:
    """The search tokens of a literal query, as ``functions.text.search_tokens`` makes them of a column."""
    out: list[str] = []
    for part in re.split(r"[^\w]+", query.lower()):
        out += list(part) if any("一" <= c <= "鿿" for c in part) else [part] if part else []
    return out


def corpus(*columns: str) -> Column:
    """The searched text: columns and tags joined by blanks."""
    return F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in columns[:-1]), F.coalesce(F.array_join("tags", " "), F.lit("")), F.coalesce(columns[-1], F.lit("")))


def pool_statistics(docs: DataFrame, terms: list[str]) -> DataFrame:
    """One row: documents, mean length, document counts of ``terms`` and the mean term weight of the vocabulary."""
    counts = F.array(*[F.sum(F.array_contains("_tokens", t).cast("int")) for t in terms]) if terms else F.array().cast("array<bigint>")
    base = docs.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), counts.alias("_df"))
    df = docs.select(F.explode(F.array_distinct("_tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    # a mean over distinct counts: the vocabulary shrinks to as many rows as there are different counts
    of_counts = df.groupBy("df").agg(F.count("*").alias("terms"))
    n = docs.agg(F.count("*").alias("_n2"))
    weight = F.log(F.col("_n2") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    mean = of_counts.crossJoin(F.broadcast(n)).agg((F.sum(F.col("terms") * weight) / F.sum("terms")).alias("_mean"))
    return base.crossJoin(F.broadcast(mean))


def bm25(pool: DataFrame, text: Column, query: str) -> DataFrame:
    """``pool`` with ``score``: Okapi BM25 of ``text`` for ``query`` (repeated query terms count again)."""
    terms = query_tokens(query)
    distinct = list(dict.fromkeys(terms))
    docs = pool.withColumn("_tokens", tx.search_tokens(text)).withColumn("_len", F.size("_tokens"))
    stats = pool_statistics(docs, distinct)
    joined = docs.crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for t in terms:
        i = distinct.index(t)
        df = F.col("_df")[i]
        raw = F.log(F.col("_n") - df + 0.5) - F.log(df + 0.5)
        idf = F.when(df > 0, F.when(raw < 0, EPSILON * F.col("_mean")).otherwise(raw)).otherwise(0.0)
        tf = F.size(F.filter("_tokens", tx.equals(t)))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))
    return joined.withColumn("score", score).drop("_tokens", "_len", "_n", "_avg", "_df", "_mean")


def top(df: DataFrame, k: int, score: str = "score") -> DataFrame:
    return df.where(F.col(score) > 0).orderBy(F.col(score).desc(), "id").limit(k)


def recalled(queries: DataFrame, entries: DataFrame, k: int = 20) -> DataFrame:
    """(keyword, top): for each of many short queries (keyword) its best ``k`` memories as ``search_ltm`` gives them one by one, structs of falling score (``loss``, its negative) and id.

    BM25 over the whole pool, and 0.5 where a query token lies inside the tags.  The
    statistics of the pool are two numbers; queries carry their weights, and meet
    the memories block by block.  A null or blank query, and one without tokens, has
    no rows; scores are compared to nine digits.
    """
    docs = entries.select("id", tx.search_tokens(corpus("content", "category")).alias("tokens"), _tags().alias("tags"))
    n, avg = docs.agg(F.count("*"), F.avg(F.size("tokens"))).first()
    asked = queries.where("keyword is not null").select("keyword").distinct()
    n_asked = asked.count()
    df = docs.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    log_idf = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    mean = df.groupBy("df").agg(F.count("*").alias("terms")).agg(F.sum(F.col("terms") * log_idf) / F.sum("terms")).first()[0]
    idf = df.select("token", F.when(log_idf < 0, F.lit(EPSILON) * F.lit(mean)).otherwise(log_idf).alias("idf"))
    tokens = asked.select("keyword", F.explode(tx.search_tokens("keyword")).alias("token")).groupBy("keyword", "token").agg(F.count("*").alias("times"))
    weighed = tokens.join(idf, "token", "left").groupBy("keyword").agg(F.sort_array(F.collect_list(F.struct("token", (F.col("times") * F.coalesce("idf", F.lit(0.0))).alias("weight")))).alias("t"))
    weighed = weighed.select("keyword", F.col("t.token").alias("tokens"), F.col("t.weight").alias("weights"))
    texts, parts = blocks.grid(docs, n, weighed, n_asked, "id", "keyword")
    found = blocks.paired(texts, parts, lambda t, q: _best_of_block(t, q, avg, k), "keyword string, top array<struct<loss: double, id: string>>")
    return blocks.best(found, "keyword", k)


def _best_of_block(texts: pa.Table, queries: pa.Table, avg: float, k: int) -> pa.Table:
    """(keyword, top): the best ``k`` texts (id, tokens, tags) of a block for each query (keyword, tokens, weights)."""
    schema = pa.schema([("keyword", pa.string()), ("top", pa.list_(pa.struct([("loss", pa.float64()), ("id", pa.string())])))])
    n = texts.num_rows
    if not n or not queries.num_rows:
        return schema.empty_table()
    texts = texts.sort_by("id")  # places are in the order of ids
    values, at = blocks.lists(texts["tokens"])
    asked, begin = blocks.lists(queries["tokens"])
    terms = pc.unique(asked)
    codes = pc.fill_null(pc.index_in(values, value_set=terms), -1).to_numpy(zero_copy_only=False)
    size = np.diff(at)
    keys = (codes.astype(np.int64) * n + np.repeat(np.arange(n), size))[codes >= 0]
    keys, tf = np.unique(keys, return_counts=True)
    code, row = np.divmod(keys, n)
    weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[row] / (avg or 1.0)))
    held = blocks.Postings(code, row, weight, len(terms), n)
    tagged = blocks.Postings(*inside([t.split(" ") for t in texts["tags"].to_pylist()], terms.to_pylist()), len(terms), n)
    of_query = pc.index_in(asked, value_set=terms).to_numpy(zero_copy_only=False)
    weights = blocks.lists(queries["weights"])[0].to_numpy(zero_copy_only=False)
    has = np.diff(held.at) + np.diff(tagged.at) > 0
    score, tags = blocks.room(n), blocks.room(n)
    names, places, losses, sizes = [], [], [], []
    for q in range(queries.num_rows):
        a, b = begin[q], begin[q + 1]
        mine = of_query[a:b]
        if not has[mine].any():
            continue
        score[:] = 0
        in_tags = False
        for c, w in zip(mine.tolist(), weights[a:b].tolist()):
            if w:
                held.add(score, c, w)
            if tagged.at[c + 1] > tagged.at[c]:
                if not in_tags:
                    tags[:] = 0
                    in_tags = True
                tagged.add(tags, c)
        if in_tags:
            score[tags > 0] += 0.5
        got = blocks.reaching(score, k)
        value = np.round(score[got], 9)
        best = np.argsort(-value, kind="stable")[:k]
        best = best[value[best] > 0]
        names.append(q)
        sizes.append(len(best))
        places.append(got[best])
        losses.append(-value[best])
    if not names:
        return schema.empty_table()
    ids = texts["id"].combine_chunks().take(pa.array(np.concatenate(places)))
    structs = pa.StructArray.from_arrays([pa.array(np.concatenate(losses)), ids], ["loss", "id"])
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
    return pa.table([queries["keyword"].combine_chunks().take(pa.array(names)), pa.ListArray.from_arrays(offsets, structs)], schema=schema)


def inside(texts: list[list[str]], terms: list[str], dtype=np.float64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, rows, ones): which terms lie inside the words of which texts; terms hold no blanks, so one lies within one word."""
    code, sizes = {t: i for i, t in enumerate(terms)}, sorted({*map(len, terms)} - {0})
    words: dict[str, list[int]] = {}
    codes, rows = [], []
    for r, text in enumerate(texts):
        mine: set[int] = set()
        for w in set(text):
            if w not in words:
                words[w] = list({code[s] for m in sizes if m <= len(w) for i in range(len(w) - m + 1) if (s := w[i : i + m]) in code})
            mine.update(words[w])
        codes.extend(mine)
        rows.extend([r] * len(mine))
    return np.array(codes, np.int64), np.array(rows, np.int64), np.ones(len(codes), dtype)


def _any_in(c: Column, terms: list[str]) -> Column:
    return tx.contains_any(c, terms) if terms else F.lit(False)


def _tags() -> Column:
    return F.lower(F.coalesce(F.array_join("tags", " "), F.lit("")))


def search_ltm(entries: DataFrame, query: str, category: str | None = None, k: int = 20, method: str = "bm25") -> DataFrame:
    """Best memories for a query; a query term inside the tags adds 0.5."""
    pool = entries.where(F.col("category") == category) if category else entries
    if not query.strip():
        return records.latest(pool)
    if method == "keyword":
        return top(keyword_score(pool, query, {"content": 3, "tags": 2, "category": 1}), k)
    scored = bm25(pool, corpus("content", "category"), query)
    return top(scored.withColumn("score", F.col("score") + F.when(_any_in(_tags(), query_tokens(query)), 0.5).otherwise(0.0)), k)


def search_kb(entries: DataFrame, query: str, category: str | None = None, confirmed: bool = False, k: int = 5, method: str = "bm25") -> DataFrame:
    """Best knowledge-base entries for a query; a query term inside the title adds 1."""
    if not query.strip():
        return records.latest(entries.where(F.col("category") == category) if category else entries, limit=k)
    pool = records.confirmed_only(entries, confirmed)
    pool = pool.where(F.col("category") == category) if category else pool
    if method == "keyword":
        return top(keyword_score(pool, query, {"title": 4, "content": 3, "tags": 2, "category": 1}), k)
    scored = bm25(pool, corpus("title", "content", "category"), query)
    title = F.lower(F.coalesce("title", F.lit("")))
    return top(scored.withColumn("score", F.col("score") + F.when(_any_in(title, query_tokens(query)), 1.0).otherwise(0.0)), k)


def keyword_score(pool: DataFrame, query: str, points: dict[str, int]) -> DataFrame:
    """``score``: points of every field that contains a query term, summed over terms."""
    score = F.lit(0)
    for t in query_tokens(query):
        for field, n in points.items():
            hit = F.exists("tags", tx.holds(t)) if field == "tags" else F.lower(field).contains(t)
            score = score + F.when(F.coalesce(hit, F.lit(False)), n).otherwise(0)
    return pool.withColumn("score", score)


def ranked(df: DataFrame, score: str, name: str) -> DataFrame:
    """Position of each row of a short result list by falling score, from 0."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(F.col(score).desc(), "id")) - 1)


def fused_two_way(keyword: DataFrame, vector: DataFrame, k: int) -> DataFrame:
    """Keyword results (id, score) by position (0.8 less 0.1 a place) with vector results (id, score): mean where both have the id."""
    kw = ranked(keyword, "score", "_i").select("id", (0.8 - 0.1 * F.col("_i")).alias("_kw"))
    vec = vector.orderBy(F.col("score").desc(), "id").limit(2 * k).select("id", F.col("score").alias("_vec"))
    both = F.col("_kw").isNotNull() & F.col("_vec").isNotNull()
    out = kw.join(vec, "id", "full_outer").select("id", F.when(both, (F.col("_kw") + F.col("_vec")) / 2).otherwise(F.coalesce("_kw", "_vec")).alias("score"), F.when(both, "both").when(F.col("_kw").isNotNull(), "keyword").otherwise("vector").alias("source"))
    return out.orderBy(F.col("score").desc(), "id").limit(k)


def fused_three_way(ltm: DataFrame, kb: DataFrame, vector: DataFrame, k: int) -> DataFrame:
    """Memories (0.9 less 0.05 a place) and knowledge (0.8 less 0.05 a place) one after the other, with vector results (id, score) averaged in by id."""
    a = ranked(ltm, "score", "_i").select("id", (0.9 - 0.05 * F.col("_i")).alias("_s"), F.lit("ltm").alias("_src"))
    b = ranked(kb, "score", "_i").select("id", (0.8 - 0.05 * F.col("_i")).alias("_s"), F.lit("kb").alias("_src"))
    v = vector.select("id", F.col("score").alias("_v"))
    out = a.unionByName(b).join(v, "id", "full_outer")
    score = F.when(F.col("_s").isNotNull() & F.col("_v").isNotNull(), (F.col("_s") + F.col("_v")) / 2).otherwise(F.coalesce("_s", "_v"))
    source = F.when(F.col("_s").isNotNull() & F.col("_v").isNotNull(), F.concat("_src", F.lit("+vector"))).otherwise(F.coalesce("_src", F.lit("vector")))
    return out.select("id", score.alias("score"), source.alias("source")).orderBy(F.col("score").desc(), "id", "source").limit(k)


def keyword_share(keywords: Column, text: Column) -> Column:
    """Share of keywords contained in a text."""
    return F.size(F.filter(keywords, lambda k: text.contains(k))) / F.greatest(F.size(keywords), F.lit(1))


def skill_entries(kb: DataFrame, query: str, k: int = 5) -> DataFrame:
    """Knowledge-base entries that describe a procedure, scored by the query in title (2) and content (1)."""
    # Words that mark a procedure.
    tags, title, content = ["skill", "流程", "步骤", "方法"], ["skill", "技能", "流程"], ["skill", "步骤", "方法"]
    t, c = F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("content", F.lit("")))
    by_tag = F.coalesce(F.arrays_overlap("tags", F.array(*map(F.lit, tags))), F.lit(False))
    by_title, by_content = tx.contains_any(t, title), tx.contains_any(c, content)
    q = query.lower()
    d = kb.where(by_tag | by_title | by_content).withColumn("skill_confidence", F.when(~by_tag & ~by_title, 0.5))
    d = d.withColumn("score", F.when(t.contains(q), 2).otherwise(0) + F.when(c.contains(q), 1).otherwise(0))
    return d.orderBy(F.col("score").desc(), "id").limit(k)
