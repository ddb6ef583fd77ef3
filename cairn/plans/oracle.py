"""SQL of the queries, for DuckDB over the same tables: an independent statement of each result."""

from __future__ import annotations

from ..functions import text as tx
from ..operators import ranking, records, search, sensitive, sessions, skills

WORDS = "cache index memory session cache"
HAN = "我喜欢 缓存"
VECTOR = "i prefer a manual memory"
PROCEDURE = "step"
AS_OF = "2026-01-01 00:00:00"

SP = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SP}+|{SP}+$', '', 'g')"


def label(x: str) -> str:
    return f"lower({strip(x)})"


def tokens(x: str) -> str:
    return rf"list_filter(flatten(list_transform(string_split_regex(lower({x}), '[^\p{{L}}\p{{N}}_]+'), lambda p: CASE WHEN regexp_matches(p, '[\x{{4e00}}-\x{{9fff}}]') THEN string_split(p, '') ELSE [p] END)), lambda t: t <> '')"


def dedup_tokens(x: str) -> str:
    return rf"list_filter(string_split_regex(regexp_replace(lower({strip(x)}), '[^\p{{L}}\p{{N}}_\s\x{{3000}}\x{{a0}}]', ' ', 'g'), '{SP}+'), lambda t: length(t) > 1)"


def any_of(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")" if words else "false"


def first_kind(x: str, kinds: dict[str, list[str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_of(x, v)} THEN {q(k)}" for k, v in kinds.items()) + f" ELSE {q(default)} END"


LTM = f"ltm AS (SELECT DISTINCT id, content, {label('category')} AS category, source, tags, created_at, updated_at, is_sensitive FROM ltm_entries)"
KB = f"kb AS (SELECT DISTINCT id, title, content, {label('category')} AS category, tags, source, {label('confidence')} AS confidence, confirmed, created_at, updated_at FROM kb_entries)"
ITEMS = f"items AS (SELECT DISTINCT item_id, batch_no, session_id, content, {label('category')} AS category, confidence, tags, suggested_at FROM save_suggestions)"
EVENTS = "ev AS (SELECT DISTINCT event_id, session_id, event_ts, event_type, content FROM session_events)"
STM = "stm AS (SELECT DISTINCT ON (session_id) * FROM stm_sessions)"
PROBLEMS = f"{KB}, problems AS (SELECT id AS problem_id, title AS problem FROM kb WHERE title IS NOT NULL)"
PENDING = f"{STM}, pend AS (SELECT session_id, unnest(pending_saves) AS p FROM stm), pending AS (SELECT session_id, p.content AS content, {label('p.category')} AS category, coalesce(p.destination, 'ltm') AS destination FROM pend)"


def bm25(pool: str, text: str, query: str, name: str = "scored") -> str:
    """CTEs that score the rows of ``pool`` (with id) into ``name`` (id, score)."""
    terms = search.query_tokens(query)
    values = ", ".join(f"({q(t)})" for t in terms)
    return f"""{name}_d AS (SELECT id, {tokens(text)} AS toks FROM {pool}),
{name}_tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(toks) AS term FROM {name}_d) GROUP BY ALL),
{name}_n AS (SELECT count(*) AS n, avg(len(toks)) AS av FROM {name}_d),
{name}_df AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS w FROM {name}_tf, {name}_n GROUP BY term, n),
{name}_idf AS (SELECT term, CASE WHEN w < 0 THEN 0.25 * (SELECT avg(w) FROM {name}_df) ELSE w END AS idf FROM {name}_df),
{name} AS (SELECT d.id, coalesce(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d.toks) / av))), 0) AS score
  FROM {name}_d d CROSS JOIN {name}_n LEFT JOIN (SELECT t.id, t.term, t.tf, i.idf FROM {name}_tf t JOIN {name}_idf i USING (term) JOIN (VALUES {values}) AS qq(term) USING (term)) h ON h.id = d.id GROUP BY d.id)"""


def corpus(*columns: str) -> str:
    *head, last = columns
    return " || ' ' || ".join([*(f"coalesce({c}, '')" for c in head), "coalesce(array_to_string(tags, ' '), '')", f"coalesce({last}, '')"])


def boosted(pool: str, scored: str, field: str, plus: float, query: str) -> str:
    return f"SELECT id, s.score + CASE WHEN {any_of(field, search.query_tokens(query))} THEN {plus} ELSE 0 END AS score FROM {scored} s JOIN {pool} USING (id)"


TAGS = "lower(coalesce(array_to_string(tags, ' '), ''))"
TITLE = "lower(coalesce(title, ''))"


def keyword(points: dict[str, int]) -> str:
    parts = []
    for t in search.query_tokens(WORDS):
        for f, n in points.items():
            hit = f"len(list_filter(tags, lambda x: contains(lower(x), {q(t)}))) > 0" if f == "tags" else f"contains(lower({f}), {q(t)})"
            parts.append(f"CASE WHEN {hit} THEN {n} ELSE 0 END")
    return " + ".join(parts)


def ltm_search(name: str, query: str, k: int) -> str:
    return f"{bm25('ltm', corpus('content', 'category'), query, name + '_s')}, {name} AS (SELECT * FROM ({boosted('ltm', name + '_s', TAGS, 0.5, query)}) WHERE score > 0 ORDER BY score DESC, id LIMIT {k})"


def kb_search(name: str, query: str, k: int, pool: str = "kb") -> str:
    return f"{bm25(pool, corpus('title', 'content', 'category'), query, name + '_s')}, {name} AS (SELECT * FROM ({boosted(pool, name + '_s', TITLE, 1.0, query)}) WHERE score > 0 ORDER BY score DESC, id LIMIT {k})"


def blank_tokens(x: str) -> str:
    return f"list_filter(string_split_regex(lower({strip(x)}), '{SP}+'), lambda t: t <> '')"


TF = f"tok AS (SELECT id, unnest({blank_tokens('content')}) AS term FROM ltm), cnt AS (SELECT id, term, count(*) AS n FROM tok GROUP BY ALL), nrm AS (SELECT id, sqrt(sum(n * n)) AS norm FROM cnt GROUP BY id)"


def vector_search(name: str, k: int) -> str:
    words = VECTOR.lower().split()
    w = {x: words.count(x) for x in words}
    length = sum(v * v for v in w.values()) ** 0.5
    case = "CASE term " + " ".join(f"WHEN {q(t)} THEN {n}" for t, n in w.items()) + " ELSE 0 END"
    return f"{TF}, {name} AS (SELECT * FROM (SELECT id, sum(n * {case}) / (any_value(norm) * {length!r}) AS score FROM cnt JOIN nrm USING (id) GROUP BY id) WHERE score >= 0.1 ORDER BY score DESC, id LIMIT {k})"


def pairs(value: str, size: str, count: str) -> str:
    return f"""WITH {ITEMS}, {LTM},
a AS (SELECT id, term, {count} AS n FROM (SELECT item_id AS id, unnest({dedup_tokens('content')}) AS term FROM items) GROUP BY ALL),
b AS (SELECT id, term, {count} AS n FROM (SELECT id, unnest({dedup_tokens('content')}) AS term FROM ltm) GROUP BY ALL),
na AS (SELECT id, {size} AS na FROM a GROUP BY id), nb AS (SELECT id AS match_id, {size} AS nb FROM b GROUP BY id),
c AS (SELECT a.id, b.id AS match_id, sum(a.n * b.n) AS common FROM a JOIN b USING (term) GROUP BY ALL),
pairs AS (SELECT id, match_id, {value} AS similarity FROM c JOIN na USING (id) JOIN nb USING (match_id))"""


COSINE = pairs("least(1.0, common / (na * nb))", "sqrt(sum(n * n))", "count(*)")
JACCARD = pairs("common / (na + nb - common)", "sum(n)", "1")


def rule(destination: str) -> str:
    whens = " ".join(f"WHEN regexp_matches(part, {q('(?is)' + r.regex)}) THEN {q(r.category)}" for r in sessions.RULES if r.destination == destination)
    return f"CASE {whens} END"


def re2(p: sensitive.Pattern) -> str:
    return r"(^|[^0-9])[0-9]{16,19}([^0-9]|$)" if p.name == "bank_card" else p.regex


def keywords(x: str, stop: list[str]) -> str:
    return f"list_filter(string_split_regex({strip(x)}, '{SP}+'), lambda t: length(t) > 1 AND t NOT IN ({', '.join(map(q, stop))}))[1:5]"


def sql() -> dict[str, str]:
    length_case = lambda *v: f"CASE WHEN length(problem) < 50 THEN {v[0]} WHEN length(problem) < 200 THEN {v[1]} ELSE {v[2]} END"
    weight = f"""CASE WHEN category = 'credential' OR contains(c, '密码') OR contains(c, '密钥') THEN 4 WHEN category IN ('preference', 'decision') THEN 3
WHEN category = 'goal' OR contains(c, '我的名字是') OR contains(c, '我叫') THEN 3 WHEN category IN ('project', 'technical') THEN 2 WHEN category IN ('chat', 'general') THEN 1 ELSE 2 END"""
    GATHERED = f"""{PROBLEMS}, {LTM}, ks AS (SELECT problem_id, unnest({keywords('problem', tx.COMPOSER_STOP)}) AS keyword FROM problems),
asked AS (SELECT keyword, token, count(*) AS times FROM (SELECT keyword, unnest({tokens('keyword')}) AS token FROM (SELECT DISTINCT keyword FROM ks)) GROUP BY ALL),
dc AS (SELECT id, len(tk) AS len, tk FROM (SELECT id, {tokens(corpus('content', 'category'))} AS tk FROM ltm)), hl AS (SELECT id, len, token, count(*) AS tf FROM (SELECT id, len, unnest(tk) AS token FROM dc) GROUP BY ALL),
dfs AS (SELECT token, count(*) AS df FROM hl GROUP BY token), pool AS (SELECT count(*) AS n, avg(len) AS a FROM dc), li AS (SELECT token, ln(n - df + 0.5) - ln(df + 0.5) AS wt FROM dfs, pool), mw AS (SELECT avg(wt) AS m FROM li),
bt AS (SELECT keyword, id, sum(times * (CASE WHEN wt < 0 THEN {search.EPSILON} * m ELSE wt END) * tf * {search.K1 + 1} / (tf + {search.K1} * ({1 - search.B} + {search.B} * len / a))) AS score FROM asked JOIN hl USING (token) JOIN li USING (token), mw, pool GROUP BY ALL),
tg AS (SELECT DISTINCT keyword, id, 0.5 AS score FROM asked, ltm WHERE contains(lower(array_to_string(tags, ' ')), token)),
rc AS (SELECT keyword, id, round(sum(score), 9) AS score FROM (SELECT * FROM bt UNION ALL SELECT * FROM tg) GROUP BY ALL),
rk AS (SELECT keyword, id FROM (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY score DESC, id) AS r FROM rc WHERE score > 0) WHERE r <= 20),
gr AS (SELECT problem_id, id, keyword, least(1.0, CASE WHEN contains(content, keyword) THEN 0.4 ELSE 0 END + CASE WHEN len(list_filter(tags, lambda t: contains(t, keyword))) > 0 THEN 0.3 ELSE 0 END + CASE WHEN category IN ('discussion', 'insight', 'method') THEN 0.2 ELSE 0 END + 0.1) AS relevance FROM ks JOIN rk USING (keyword) JOIN ltm USING (id)),
gathered AS (SELECT problem_id, id, keyword, relevance FROM (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY relevance DESC, id, keyword) AS r FROM gr) WHERE r <= 10)"""
    weights = f"w AS (SELECT id, created_at, {weight} AS weight FROM (SELECT id, created_at, coalesce(category, '') AS category, coalesce(content, '') AS c FROM ltm))"
    days = f"floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(created_at)) / 86400000000.0)"
    recency = f"CASE WHEN created_at IS NULL THEN 0.3 WHEN {days} <= 7 THEN 1.0 WHEN {days} <= 30 THEN 0.5 * (1 - ({days} - 7) / 23) ELSE 0.1 END"
    domain = first_kind("x", tx.DOMAINS, "general")
    sentiment = lambda words: " + ".join(f"CASE WHEN contains(t, {q(x)}) THEN 1 ELSE 0 END" for x in words)
    known = lambda c: ", ".join(map(q, c))
    blank = f"coalesce({strip('content')}, '') = ''"
    para = f"list_filter(list_transform(string_split_regex(body, '\\n{{2,}}'), lambda p: {strip('p')}), lambda p: length(p) >= 100)"
    normal = lambda x: f"regexp_replace(lower({strip(x)}), '{SP}+', ' ', 'g')"
    han = "regexp_replace(low, '[^\\x{4e00}-\\x{9fff}]', '', 'g')"
    stop = "[" + ", ".join(map(q, tx.MATCH_STOP)) + "]"
    drafts = " ".join(f"WHEN {q(d)} THEN {{'t': {q(t)}, 's': {q('|'.join(skills.TEMPLATES[t][1]))}, 'c': {round(0.7 + 0.2 * v, 6)}}}" for d, (t, v) in skills.BEST_TEMPLATE.items())
    return {
        "kb_bm25_top10": f"WITH {KB}, {kb_search('hit', WORDS, 10)} SELECT id, title, round(hit.score, 6) AS score FROM hit JOIN kb USING (id)",
        "kb_bm25_by_category": f"WITH {KB}, pool AS (SELECT * FROM kb WHERE category = 'technical' AND confirmed), {kb_search('hit', WORDS, 10, 'pool')} SELECT id, round(score, 6) AS score FROM hit",
        "ltm_bm25_top20": f"WITH {LTM}, {ltm_search('hit', HAN, 20)} SELECT id, round(score, 6) AS score FROM hit",
        "ltm_bm25_scores": f"WITH {LTM}, {bm25('ltm', corpus('content', 'category'), WORDS)} SELECT id, round(score, 6) AS score FROM scored",
        "kb_keyword_top10": f"WITH {KB} SELECT id, score FROM (SELECT id, {keyword({'title': 4, 'content': 3, 'tags': 2, 'category': 1})} AS score FROM kb) WHERE score > 0 ORDER BY score DESC, id LIMIT 10",
        "ltm_keyword_top20": f"WITH {LTM} SELECT id, score FROM (SELECT id, {keyword({'content': 3, 'tags': 2, 'category': 1})} AS score FROM ltm) WHERE score > 0 ORDER BY score DESC, id LIMIT 20",
        "ltm_blank_query": f"WITH {LTM} SELECT id, created_at FROM ltm ORDER BY created_at DESC NULLS LAST, id LIMIT 100",
        "skill_entries_top5": f"""WITH {KB}, c AS (SELECT *, len(list_intersect(tags, ['skill', '流程', '步骤', '方法'])) > 0 AS bt, {any_of("lower(coalesce(title, ''))", ['skill', '技能', '流程'])} AS bi, {any_of("lower(coalesce(content, ''))", ['skill', '步骤', '方法'])} AS bc FROM kb)
SELECT id, CASE WHEN contains(lower(coalesce(title, '')), {q(PROCEDURE)}) THEN 2 ELSE 0 END + CASE WHEN contains(lower(coalesce(content, '')), {q(PROCEDURE)}) THEN 1 ELSE 0 END AS score, CASE WHEN NOT coalesce(bt, false) AND NOT bi THEN 0.5 END AS skill_confidence
FROM c WHERE coalesce(bt, false) OR bi OR bc ORDER BY score DESC, id LIMIT 5""",
        "tf_vectors": f"WITH {LTM}, {TF} SELECT id, term, round(n / norm, 6) AS tf FROM cnt JOIN nrm USING (id)",
        "tf_cosine_top10": f"WITH {LTM}, {vector_search('hit', 10)} SELECT id, round(score, 6) AS score FROM hit",
        "embedding_cosine_top10": "WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), qq AS (SELECT v AS w FROM e ORDER BY id LIMIT 1) SELECT id, round(greatest(0, least(1, list_dot_product(v, w) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(w, w))))), 6) AS score FROM e, qq ORDER BY score DESC, id LIMIT 10",
        "hybrid_two_way": f"""WITH {LTM}, {ltm_search('hit', VECTOR, 20)}, {vector_search('vec', 20)}, kw AS (SELECT id, 0.8 - 0.1 * (row_number() OVER (ORDER BY score DESC, id) - 1) AS k FROM hit)
SELECT id, round(CASE WHEN k IS NOT NULL AND v.score IS NOT NULL THEN (k + v.score) / 2 ELSE coalesce(k, v.score) END, 6) AS score, CASE WHEN k IS NOT NULL AND v.score IS NOT NULL THEN 'both' WHEN k IS NOT NULL THEN 'keyword' ELSE 'vector' END AS source
FROM kw FULL JOIN vec v USING (id) ORDER BY CASE WHEN k IS NOT NULL AND v.score IS NOT NULL THEN (k + v.score) / 2 ELSE coalesce(k, v.score) END DESC, id LIMIT 10""",
        "hybrid_three_way": f"""WITH {LTM}, {KB}, {ltm_search('hl', VECTOR, 10)}, {kb_search('hk', VECTOR, 10)}, {vector_search('vec', 10)},
l AS (SELECT id, 0.9 - 0.05 * (row_number() OVER (ORDER BY score DESC, id) - 1) AS s, 'ltm' AS src FROM hl UNION ALL SELECT id, 0.8 - 0.05 * (row_number() OVER (ORDER BY score DESC, id) - 1), 'kb' FROM hk),
j AS (SELECT id, CASE WHEN s IS NOT NULL AND v.score IS NOT NULL THEN (s + v.score) / 2 ELSE coalesce(s, v.score) END AS score, CASE WHEN s IS NOT NULL AND v.score IS NOT NULL THEN src || '+vector' ELSE coalesce(src, 'vector') END AS source FROM l FULL JOIN vec v USING (id))
SELECT id, round(score, 6) AS score, source FROM j ORDER BY j.score DESC, id, source LIMIT 20""",
        "exact_dedup_groups": f"SELECT min(doc_id) AS first, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY {normal('text')} HAVING count(*) > 1",
        "exact_dedup_firsts": f"SELECT min(doc_id) AS id FROM documents WHERE text IS NOT NULL GROUP BY {normal('text')} UNION ALL SELECT doc_id FROM documents WHERE text IS NULL",
        "duplicate_items": f"{JACCARD}, hit AS (SELECT DISTINCT id FROM pairs WHERE similarity >= 0.85) SELECT item_id AS id, hit.id IS NOT NULL AS is_duplicate FROM (SELECT DISTINCT item_id FROM save_suggestions WHERE content IS NOT NULL) LEFT JOIN hit ON hit.id = item_id",
        "jaccard_items_vs_ltm": f"{JACCARD} SELECT id, match_id, round(similarity, 6) AS similarity FROM pairs WHERE similarity >= 0.85",
        "cosine_items_vs_ltm": f"{COSINE} SELECT id, match_id, round(similarity, 6) AS similarity FROM pairs WHERE similarity >= 0.85",
        "suggested_actions": f"{COSINE}, best AS (SELECT id, max(similarity) AS m FROM pairs GROUP BY id) SELECT CASE WHEN m >= 0.95 THEN 'skip' WHEN m >= 0.85 THEN 'merge' ELSE 'save' END AS action, count(*) AS items FROM items LEFT JOIN best ON best.id = item_id WHERE content IS NOT NULL GROUP BY 1",
        "added_distinct": f"""WITH {LTM}, {ITEMS}, s AS (SELECT {normal('content')} AS n, arg_min(id, (created_at, id)) AS held FROM ltm WHERE content IS NOT NULL GROUP BY 1),
i AS (SELECT item_id, {normal('content')} AS n, suggested_at FROM items WHERE content IS NOT NULL), f AS (SELECT *, first(item_id) OVER (PARTITION BY n ORDER BY suggested_at, item_id) AS fst FROM i)
SELECT item_id AS id, coalesce(held, fst) AS held_by FROM f LEFT JOIN s USING (n)""",
        "sensitive_flags": f"WITH {LTM} SELECT id, coalesce({' OR '.join(f'regexp_matches(content, {q(re2(p))})' for p in sensitive.PATTERNS)}, false) AS sensitive, array_to_string(list_filter([{', '.join(f'CASE WHEN regexp_matches(content, {q(re2(p))}) THEN {q(p.category)} END' for p in sensitive.PATTERNS if p.name != 'generic_api_key')}], lambda x: x IS NOT NULL), ',') AS categories FROM ltm",
        "kb_index": f"WITH {KB} SELECT id, title, category, array_to_string(tags, ',') AS tags, confidence, confirmed, created_at, updated_at FROM kb",
        "ltm_latest": f"WITH {LTM} SELECT id, category, created_at FROM ltm ORDER BY created_at DESC NULLS LAST, id LIMIT 100",
        "kb_confirmed": f"WITH {KB} SELECT category, count(*) AS entries FROM kb WHERE confirmed GROUP BY category",
        "ltm_checked": f"WITH {LTM}, c AS (SELECT CASE WHEN {blank} THEN 'content is empty' WHEN category IS NULL OR category NOT IN ({known(records.LTM_CATEGORIES)}) THEN 'unknown category' END AS error FROM ltm) SELECT error IS NULL AS valid, error, count(*) AS entries FROM c GROUP BY ALL",
        "kb_checked": f"WITH {KB}, c AS (SELECT CASE WHEN coalesce({strip('title')}, '') = '' THEN 'title is empty' WHEN {blank} THEN 'content is empty' WHEN category IS NULL OR category NOT IN ({known(records.KB_CATEGORIES)}) THEN 'unknown category' WHEN confidence IS NULL OR confidence NOT IN ({known(records.CONFIDENCE)}) THEN 'unknown confidence' END AS error FROM kb) SELECT error IS NULL AS valid, error, count(*) AS entries FROM c GROUP BY ALL",
        "ltm_updated": f"WITH {LTM} SELECT id, CASE WHEN category = 'habit' THEN coalesce(content || ' (checked)', content) ELSE content END AS content, source, CASE WHEN category = 'habit' THEN TIMESTAMP '{AS_OF}' ELSE updated_at END AS updated_at FROM ltm",
        "ltm_deleted": f"WITH {LTM} SELECT category, count(*) AS entries FROM ltm WHERE NOT coalesce(is_sensitive, false) GROUP BY category",
        "ltm_upserted": f"WITH {LTM}, {ITEMS}, u AS (SELECT CASE WHEN category = 'goal' OR category IS NULL THEN 'other' ELSE category END AS category FROM ltm UNION ALL SELECT category FROM items) SELECT category, count(*) AS entries FROM u GROUP BY category",
        "ltm_migrated": f"WITH {LTM}, {ITEMS}, u AS (SELECT category FROM ltm UNION ALL SELECT coalesce(category, 'other') FROM items) SELECT category, count(*) AS entries FROM u GROUP BY category",
        "shard_names": r"SELECT regexp_replace(category, '[^\p{L}\p{N}_-]', '_', 'g') AS shard, count(*) AS rows FROM ltm_entries GROUP BY 1",
        "kb_paragraphs": f"""WITH {KB}, b AS (SELECT id, {strip("replace(content, chr(13) || chr(10), chr(10))")} AS body FROM kb), c AS (SELECT id, CASE WHEN len({para}) > 0 THEN {para} ELSE [body] END AS ch FROM b WHERE coalesce(body, '') <> ''),
x AS (SELECT id, unnest(range(1, len(ch) + 1))::INTEGER AS chunk_no, unnest(ch) AS chunk FROM c)
SELECT id, chunk_no, 'part ' || chunk_no || ': ' || CASE WHEN length(chunk) > 60 THEN substring(chunk, 1, 57) || '...' ELSE chunk END AS title, length(chunk) AS chars FROM x""",
        "ltm_profile": f"WITH {LTM}, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY created_at DESC NULLS LAST, id DESC) AS r FROM ltm) SELECT category, count(*) AS entries, string_agg(id, ',' ORDER BY r DESC) FILTER (r <= 5) AS recent FROM r GROUP BY category",
        "store_status": f"WITH {LTM}, {KB}, {STM} SELECT 'ltm_total' AS metric, count(*) AS value FROM ltm UNION ALL SELECT 'ltm_sensitive', count(*) FILTER (is_sensitive) FROM ltm UNION ALL SELECT 'kb:' || coalesce(category, 'none'), count(*) FROM kb GROUP BY category UNION ALL SELECT 'active_sessions', count(*) FILTER (is_active) FROM stm",
        "suggestion_coverage": f"""WITH {ITEMS}, g AS (SELECT session_id, count(*) AS results, avg(CASE WHEN coalesce(confidence, 0) >= 0.6 THEN 1.0 ELSE 0.0 END) AS coverage,
least(1.0, (len(list_distinct(flatten(list(coalesce(tags, []))))) + count(DISTINCT category)) / (2.0 * count(*))) AS diversity, avg(coalesce(confidence, 0)) AS mean_relevance FROM items GROUP BY session_id)
SELECT session_id, results, round(coverage, 6) AS coverage, round(diversity, 6) AS diversity, round(mean_relevance, 6) AS mean_relevance, round(0.6 * coverage + 0.4 * diversity, 6) AS composability, round(0.6 * coverage + 0.4 * diversity, 6) >= 0.65 AS can_compose FROM g""",
        "event_statistics": "SELECT event_type, count(value) AS n, round(sum(value), 6) AS total, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY event_type",
        "weight_statistics": f"WITH {LTM}, {weights} SELECT r.weight::INTEGER AS weight, count(w.id) AS entries, (SELECT count(*) FROM w) AS all_entries, (SELECT round(avg(weight), 6) FROM w) AS mean FROM range(1, 6) r(weight) LEFT JOIN w ON w.weight = r.weight GROUP BY r.weight",
        "ranked_by_weight": f"WITH {LTM}, {weights} SELECT id, weight, CASE weight {' '.join(f'WHEN {k} THEN {q(v)}' for k, v in ranking.NAMES.items())} END AS weight_name, round({recency}, 6) AS time_score, round(0.7 * (weight / 5.0) + 0.3 * ({recency}), 6) AS rank_score FROM w",
        "session_summaries": f"WITH {EVENTS} SELECT session_id, count(*) AS events, min(event_ts) AS started, max(event_ts) AS ended, coalesce(string_agg(DISTINCT event_type, ',' ORDER BY event_type), '') AS event_types, floor((epoch_us(max(event_ts)) - epoch_us(min(event_ts))) / 1000000.0)::BIGINT AS seconds FROM ev GROUP BY session_id",
        "active_sessions": f"WITH {STM}, {EVENTS}, c AS (SELECT session_id, count(*) AS events FROM ev GROUP BY session_id) SELECT session_id, CASE WHEN task_type IN ({known(records.TASK_TYPES)}) THEN task_type ELSE 'general' END AS task_type, coalesce(c.events, 0) AS events, coalesce(len(pending_saves), 0)::INTEGER AS pending FROM stm LEFT JOIN c USING (session_id) WHERE is_active",
        "session_context": f"WITH {STM}, e AS (SELECT session_id, unnest(map_entries(context)) AS kv FROM stm) SELECT session_id, kv.key AS key, kv.value AS value FROM e",
        "pending_items": f"WITH {PENDING} SELECT destination, count(*) AS items, count(DISTINCT session_id) AS sessions FROM pending GROUP BY destination",
        "flush_results": f"WITH {PENDING}, t AS (SELECT category, CASE WHEN {blank} THEN 'reject' WHEN destination = 'kb' THEN CASE WHEN category IN ({known(records.KB_CATEGORIES)}) THEN 'kb' ELSE 'reject' END WHEN category IN ({known(records.LTM_CATEGORIES)}) THEN 'ltm' ELSE 'reject' END AS target FROM pending) SELECT target, category, count(*) AS items FROM t GROUP BY ALL",
        "trigger_first_rule": f"WITH {EVENTS}, p AS (SELECT event_id, session_id, substring(content, 1, 300) AS part FROM ev WHERE length(content) >= 8), r AS (SELECT event_id, session_id, {rule('ltm')} AS ltm_category, {rule('kb')} AS kb_category FROM p) SELECT * FROM r WHERE ltm_category IS NOT NULL OR kb_category IS NOT NULL",
        "hourly_event_types": "SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, count(*) AS events FROM events GROUP BY ALL",
        "problem_analysis": f"""WITH {PROBLEMS}, k AS (SELECT *, lower(problem) AS low, {keywords('problem', tx.GENERATOR_STOP)} AS g FROM problems), m AS (SELECT *, low || ' ' || lower(array_to_string(g, ' ')) AS x FROM k)
SELECT problem_id, array_to_string({keywords('problem', tx.COMPOSER_STOP)}, '|') AS keywords, {first_kind('low', tx.PROBLEM_KINDS, 'problem_solving')} AS kind,
array_to_string(list_filter([{', '.join(f'CASE WHEN {any_of("low", v)} THEN {q(k)} END' for k, v in tx.EXPERTISE.items())}], lambda e: e IS NOT NULL), '|') AS expertise, {domain} AS domain, {length_case("'low'", "'medium'", "'high'")} AS complexity, {length_case(0.4, 0.7, 0.9)}::DOUBLE AS clarity FROM m""",
        "match_keywords": f"""WITH {PROBLEMS}, l AS (SELECT problem_id, lower(problem) AS low FROM problems), h AS (SELECT *, {han} AS han FROM l)
SELECT problem_id, array_to_string(list_sort(CASE WHEN length(han) > 0 THEN list_filter(list_distinct(list_concat(string_split(han, ''), list_transform(range(1, length(han)), lambda i: substring(han, i, 2)))), lambda t: NOT list_contains({stop}, t)) ELSE list_filter(string_split_regex({strip("translate(low, ',.', '  ')")}, '{SP}+'), lambda t: length(t) > 2) END), '|') AS keywords FROM h""",
        "dedup_token_counts": f"WITH {LTM} SELECT id, len({dedup_tokens('content')})::INTEGER AS tokens, len(list_distinct({tokens('content')}))::INTEGER AS terms, len(list_filter(list_transform(string_split_regex(content, '[。；.!?\\n]'), lambda t: {strip('t')}), lambda t: length(t) > 5))::INTEGER AS sentences FROM ltm WHERE content IS NOT NULL",
        "feedback_signals": f"WITH d AS (SELECT lower(text) AS t FROM documents WHERE text IS NOT NULL), n AS (SELECT t, {sentiment(tx.POSITIVE)} AS p, {sentiment(tx.NEGATIVE)} AS n FROM d) SELECT CASE WHEN n > p THEN 'negative' WHEN p > n THEN 'positive' ELSE 'neutral' END AS sentiment, {first_kind('t', tx.ASPECTS, 'general')} AS aspect, count(*) AS texts FROM n GROUP BY ALL",
        "problem_parts": f"WITH {PROBLEMS}, c AS (SELECT *, list_filter(list_transform(list_concat(string_split(problem, '。'), string_split(problem, '?'))[1:3], lambda t: substring({strip('t')}, 1, 30)), lambda t: t <> '') AS parts FROM problems) SELECT problem_id, array_to_string(CASE WHEN len(parts) > 0 THEN parts ELSE [substring(problem, 1, 30)] END, '|') AS parts FROM c",
        "generation_gate": f"WITH {PROBLEMS}, f AS (SELECT *, round(0.6 * {length_case(0.4, 0.7, 0.9)} + 0.4 * CASE WHEN length(problem) % 2 = 0 THEN 0.7 ELSE 0.3 END, 6)::DOUBLE AS feasibility FROM problems) SELECT problem_id, feasibility, length(problem) >= 10 AND feasibility >= 0.5 AS can_generate FROM f",
        "skill_drafts": f"""WITH {PROBLEMS}, k AS (SELECT *, {keywords('problem', tx.GENERATOR_STOP)} AS g FROM problems), m AS (SELECT *, lower(problem) || ' ' || lower(array_to_string(g, ' ')) AS x FROM k), dd AS (SELECT *, {domain} AS domain FROM m), t AS (SELECT *, CASE domain {drafts} END AS pick FROM dd)
SELECT problem_id, domain, array_to_string(g[1:2], ' ') || ' 解决方案' AS name, '用于解决: ' || substring(problem, 1, 100) || '...' AS description, pick.t AS template, pick.s AS steps, pick.c::DOUBLE AS confidence, pick.c < 0.80 AS needs_verification FROM t""",
        "items_per_source": "SELECT source, count(*) AS items FROM (SELECT DISTINCT ON (item_id) item_id, source FROM save_suggestions) GROUP BY source",
        "gathered_memories": f"""WITH {GATHERED} SELECT problem_id, id, keyword, round(relevance, 6)::DOUBLE AS relevance FROM gathered""",
        "composition_plans": f"""WITH {GATHERED}, fw(kind, step_no, step) AS (VALUES {', '.join(f"({q(kd)}, {i + 1}, {q(st)})" for kd, v in skills.FRAMEWORKS.items() for i, st in enumerate(v))}),
kd AS (SELECT problem_id, {first_kind('lower(problem)', tx.PROBLEM_KINDS, 'problem_solving')} AS kind FROM problems), st AS (SELECT problem_id, step_no, step FROM kd JOIN fw USING (kind)),
fit AS (SELECT problem_id, step_no, id, relevance, relevance * CASE WHEN contains(content, step) THEN 0.8 WHEN len(list_filter(string_split(step, ' '), lambda w: w <> '' AND contains(content, w))) > 0 THEN 0.5 ELSE 0 END AS fit FROM st JOIN gathered USING (problem_id) JOIN (SELECT id, content FROM ltm) USING (id)),
best AS (SELECT problem_id, step_no, arg_min(relevance, (-fit, id)) AS relevance FROM fit WHERE fit > 0.3 GROUP BY ALL),
pl AS (SELECT problem_id, step_no, best.problem_id IS NOT NULL AS own, coalesce(relevance, 0.5) AS relevance FROM st LEFT JOIN best USING (problem_id, step_no))
SELECT problem_id, count(*) AS steps, count(*) FILTER (own) AS from_memory, round(least(1.0, 0.6 * avg(relevance) + 0.4 * avg(own::INT)), 6)::DOUBLE AS quality FROM pl GROUP BY problem_id""",
    }
