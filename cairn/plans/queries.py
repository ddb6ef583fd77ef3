"""Queries over the project tables: one for each operator of the core, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import dedup, ranking, records, search, sensitive, sessions, skills, summaries, vectors
from ..sources.stores import table
from . import oracle

#: The searches that the queries run, and the moment that stands for now.
WORDS, HAN, VECTOR, PROCEDURE = oracle.WORDS, oracle.HAN, oracle.VECTOR, oracle.PROCEDURE


def as_of():
    return F.lit(oracle.AS_OF).cast("timestamp_ntz")


def ltm(s: SparkSession, d: str) -> DataFrame:
    """Memories, once each, with categories in one spelling."""
    return records.once(table(s, d, "ltm_entries")).withColumn("category", records.clean_label("category"))


def kb(s: SparkSession, d: str) -> DataFrame:
    return records.once(table(s, d, "kb_entries")).withColumn("category", records.clean_label("category")).withColumn("confidence", records.clean_label("confidence"))


def events(s: SparkSession, d: str) -> DataFrame:
    return records.once(table(s, d, "session_events"), "event_id")


def stm(s: SparkSession, d: str) -> DataFrame:
    return records.once(table(s, d, "stm_sessions"), "session_id")


def items(s: SparkSession, d: str) -> DataFrame:
    return records.once(table(s, d, "save_suggestions"), "item_id").withColumn("category", records.clean_label("category"))


def problems(s: SparkSession, d: str) -> DataFrame:
    """Titles as problem statements."""
    return kb(s, d).where("title is not null").select(F.col("id").alias("problem_id"), F.col("title").alias("problem"))


def _six(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# search


def kb_bm25_top10(s, d):
    return _six(search.search_kb(kb(s, d), WORDS, k=10), "score").select("id", "title", "score")


def kb_bm25_by_category(s, d):
    return _six(search.search_kb(kb(s, d), WORDS, category="technical", confirmed=True, k=10), "score").select("id", "score")


def ltm_bm25_top20(s, d):
    return _six(search.search_ltm(ltm(s, d), HAN), "score").select("id", "score")


def ltm_bm25_scores(s, d):
    """Every memory's score, not only the best."""
    return _six(search.bm25(ltm(s, d), search.corpus("content", "category"), WORDS), "score").select("id", "score")


def kb_keyword_top10(s, d):
    return search.search_kb(kb(s, d), WORDS, k=10, method="keyword").select("id", "score")


def ltm_keyword_top20(s, d):
    return search.search_ltm(ltm(s, d), WORDS, method="keyword").select("id", "score")


def ltm_blank_query(s, d):
    return search.search_ltm(ltm(s, d), "  ").select("id", "created_at")


def skill_entries_top5(s, d):
    return search.skill_entries(kb(s, d), PROCEDURE).select("id", "score", "skill_confidence")


def tf_vectors(s, d):
    return _six(vectors.term_frequencies(ltm(s, d), "content"), "tf")


def tf_cosine_top10(s, d):
    return _six(vectors.search_terms(ltm(s, d), "content", VECTOR, 10), "score")


def embedding_cosine_top10(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    query = e.groupBy().agg(F.min_by("embedding", "id").alias("query"))
    return _six(vectors.search_dense(e, "embedding", query, 10), "score")


def hybrid_two_way(s, d):
    m = ltm(s, d)
    return _six(search.fused_two_way(search.search_ltm(m, VECTOR, k=20), vectors.search_terms(m, "content", VECTOR, 20), 10), "score")


def hybrid_three_way(s, d):
    m = ltm(s, d)
    return _six(search.fused_three_way(search.search_ltm(m, VECTOR, k=10), search.search_kb(kb(s, d), VECTOR, k=10), vectors.search_terms(m, "content", VECTOR, 10), 20), "score")


# duplicates


def exact_dedup_groups(s, d):
    return dedup.exact_groups(table(s, d, "documents").withColumnRenamed("doc_id", "id"), "text").select("first", "copies")


def exact_dedup_firsts(s, d):
    return dedup.firsts(table(s, d, "documents").select(F.col("doc_id").alias("id"), "text"), "text").select("id")


def _pairs(s, d, method):
    new = items(s, d).where("content is not null").select(F.col("item_id").alias("id"), F.col("content").alias("text"))
    old = ltm(s, d).where("content is not null").select("id", F.col("content").alias("text"))
    return _six(dedup.matches(new, old, 0.85, method), "similarity")


def _texts(s, d):
    """Items and memories (id, text) as the tables have them."""
    new = table(s, d, "save_suggestions").where("content is not null").select(F.col("item_id").alias("id"), F.col("content").alias("text"))
    return new, table(s, d, "ltm_entries").where("content is not null").select("id", F.col("content").alias("text"))


def jaccard_items_vs_ltm(s, d):
    return _pairs(s, d, "jaccard")


def cosine_items_vs_ltm(s, d):
    # see suggested_actions
    new, old = _texts(s, d)
    return _six(dedup.matches(new, old, 0.85, "cosine"), "similarity")


def edit_titles(s, d):
    t = kb(s, d).where("title is not null").select("id", F.col("title").alias("text"))
    return _six(dedup.matches_within(t, 0.9), "similarity")


def duplicate_items(s, d):
    new = items(s, d).where("content is not null").select(F.col("item_id").alias("id"), F.col("content").alias("text"))
    old = ltm(s, d).where("content is not null").select("id", F.col("content").alias("text"))
    return dedup.is_duplicate(new, old, 0.85, "jaccard")


def items_per_source(s, d):
    return summaries.per_source(items(s, d))


def adaptation_strategies(s, d):
    p = problems(s, d)
    found = skills.gathered(skills.supported(p, table(s, d, "ltm_entries")), ltm(s, d))
    out = skills.adaptation(p, skills.composed(p, found))
    return out.select("problem_id", "framework", F.array_join("customizations", "|").alias("customizations"), F.array_join("warnings", "|").alias("warnings"), "confidence")


def suggested_actions(s, d):
    # rows that came again are one by id and text, and a text counts once: neither side is shuffled for that
    new, old = _texts(s, d)
    return dedup.suggested_action(new, old).groupBy("action").agg(F.count("*").alias("items"))


def merged_titles(s, d):
    t = kb(s, d).where("content is not null").withColumn("grp", tx.normal_space("title"))
    return dedup.merged(t.where("grp is not null"), "grp", "content")


def added_distinct(s, d):
    store = ltm(s, d).select("id", "content", "created_at")
    new = items(s, d).where("content is not null").select(F.col("item_id").alias("id"), "content", F.col("suggested_at").alias("created_at"))
    return records.add_distinct(store, new)[1].select("id", "held_by")


# secrets


def sensitive_flags(s, d):
    m = ltm(s, d)
    return m.select("id", sensitive.is_sensitive("content").alias("sensitive"), F.array_join(sensitive.categories("content"), ",").alias("categories"))


def sensitive_redacted(s, d):
    return sensitive.scanned(ltm(s, d).select("id", "content"), "content").select("id", "is_sensitive", "redacted")


# records


def kb_index(s, d):
    return records.index(kb(s, d)).withColumn("tags", F.array_join("tags", ","))


def ltm_latest(s, d):
    return records.latest(ltm(s, d)).select("id", "category", "created_at")


def kb_confirmed(s, d):
    return records.confirmed_only(kb(s, d)).groupBy("category").agg(F.count("*").alias("entries"))


def ltm_checked(s, d):
    return records.checked_ltm(ltm(s, d)).groupBy("valid", "error").agg(F.count("*").alias("entries"))


def kb_checked(s, d):
    return records.checked_kb(kb(s, d)).groupBy("valid", "error").agg(F.count("*").alias("entries"))


def ltm_updated(s, d):
    m = ltm(s, d)
    changes = m.where("category = 'habit'").select("id", F.concat("content", F.lit(" (checked)")).alias("content"), F.lit(None).cast("string").alias("source"))
    return records.updated(m, changes, ["content", "source"], as_of()).select("id", "content", "source", "updated_at")


def ltm_deleted(s, d):
    m = ltm(s, d)
    return records.deleted(m, m.where("is_sensitive"), confirm=True).groupBy("category").agg(F.count("*").alias("entries"))


def ltm_upserted(s, d):
    m = ltm(s, d).select("id", "content", "category")
    new = items(s, d).select(F.col("item_id").alias("id"), "content", "category").unionByName(m.where("category = 'goal' or category is null").withColumn("category", F.lit("other")))
    return records.upserted(m, new).groupBy("category").agg(F.count("*").alias("entries"))


def ltm_migrated(s, d):
    m = ltm(s, d).select("id", "content", "category")
    legacy = items(s, d).select(F.col("item_id").alias("id"), "content", "category").unionByName(m)
    return records.migrated(m, legacy).groupBy("category").agg(F.count("*").alias("entries"))


def shard_names(s, d):
    return table(s, d, "ltm_entries").select(records.shard_name("category").alias("shard")).groupBy("shard").agg(F.count("*").alias("rows"))


def kb_paragraphs(s, d):
    return records.paragraphs(kb(s, d).select("id", "content"), "content").select("id", "chunk_no", tx.title_of(F.lit("part"), F.col("chunk_no"), F.col("chunk")).alias("title"), F.length("chunk").alias("chars"))


# summaries and ranking


def ltm_profile(s, d):
    return summaries.profile(ltm(s, d)).withColumn("recent", F.array_join("recent", ","))


def store_status(s, d):
    return summaries.status(ltm(s, d), kb(s, d), stm(s, d))


def suggestion_coverage(s, d):
    return _six(summaries.coverage(items(s, d).withColumn("relevance", F.coalesce("confidence", F.lit(0.0))), ["session_id"]), "coverage", "diversity", "mean_relevance", "composability").withColumn("can_compose", F.col("composability") >= 0.65)


def event_statistics(s, d):
    return _six(summaries.run_statistics(table(s, d, "events"), "value", ["event_type"]), "total", "mean")


def weights(s, d):
    m = ltm(s, d)
    return m.select(F.col("id").alias("entry_id"), ranking.suggested_weight(F.col("content"), F.coalesce("category", F.lit(""))).alias("weight"))


def weight_statistics(s, d):
    return ranking.weight_statistics(weights(s, d))


def ranked_by_weight(s, d):
    return _six(ranking.ranked(ltm(s, d), weights(s, d), as_of()), "time_score", "rank_score").select("id", "weight", "weight_name", "time_score", "rank_score")


# sessions


def session_summaries(s, d):
    return sessions.summary(events(s, d)).withColumn("event_types", F.array_join("event_types", ","))


def active_sessions(s, d):
    return sessions.active(stm(s, d), events(s, d))


def session_context(s, d):
    c = stm(s, d).select("session_id", F.col("started_at").alias("ts"), F.explode("context").alias("key", "value"))
    return sessions.latest_context(c)


def pending_items(s, d):
    return sessions.pending(stm(s, d)).groupBy("destination").agg(F.count("*").alias("items"), F.count_distinct("session_id").alias("sessions"))


def flush_results(s, d):
    p = sessions.pending(stm(s, d)).withColumn("category", records.clean_label("category"))
    a, b, r = sessions.flushed(p)
    n = lambda df, k: df.groupBy("category").agg(F.count("*").alias("items")).select(F.lit(k).alias("target"), "category", "items")
    return n(a, "ltm").unionByName(n(b, "kb")).unionByName(n(r, "reject"))


def trigger_first_rule(s, d):
    return sessions.first_rule(events(s, d), written=False)


def trigger_session_fold(s, d):
    return sessions.suggestions(events(s, d).withColumn("event_type", F.lit("message")))


def hourly_event_types(s, d):
    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("events"))
    return g.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "events")


# texts and skills


def problem_analysis(s, d):
    a = skills.analysed(problems(s, d))
    return a.select("problem_id", F.array_join("keywords", "|").alias("keywords"), "kind", F.array_join("expertise", "|").alias("expertise"), "domain", "complexity", "clarity")


def match_keywords(s, d):
    return problems(s, d).select("problem_id", F.array_join(F.array_sort(tx.match_keywords("problem")), "|").alias("keywords"))


def dedup_token_counts(s, d):
    return ltm(s, d).where("content is not null").select("id", F.size(tx.dedup_tokens("content")).alias("tokens"), F.size(F.array_distinct(tx.search_tokens("content"))).alias("terms"), F.size(tx.sentences("content")).alias("sentences"))


def feedback_signals(s, d):
    t = table(s, d, "documents").where("text is not null")
    return t.select(tx.sentiment("text").alias("sentiment"), tx.aspect("text").alias("aspect")).groupBy("sentiment", "aspect").agg(F.count("*").alias("texts"))


def problem_parts(s, d):
    return problems(s, d).select("problem_id", F.array_join(tx.aspects_of("problem"), "|").alias("parts"))


def generation_gate(s, d):
    return skills.generation_gate(problems(s, d), F.length("problem") % 2 == 0).select("problem_id", "feasibility", "can_generate")


def skill_drafts(s, d):
    return skills.drafts(problems(s, d)).withColumn("steps", F.array_join("steps", "|"))


def gathered_memories(s, d):
    return _six(skills.recalled(problems(s, d), ltm(s, d)), "relevance").select("problem_id", "id", "keyword", "relevance")


def composition_plans(s, d):
    p = problems(s, d)
    return _six(skills.composition_quality(skills.composed(p, skills.gathered(p, ltm(s, d)))), "quality")


def matched_skills(s, d):
    k = kb(s, d)
    p = items(s, d).where("content is not null").select(F.col("item_id").alias("problem_id"), F.col("content").alias("problem"))
    t = k.select(F.col("id").alias("skill_id"), F.concat_ws(" ", "title", F.array_join("tags", " "), F.substring("content", 1, 200)).alias("text"))
    return _six(skills.matched(p, t), "relevance")


def _skills(s, d):
    lines = F.slice(F.filter(F.transform(F.split("content", "\n"), tx.strip), lambda x: (x != "") & ~x.startswith("#")), 1, 5)
    steps = F.transform(lines, lambda x, i: F.struct(F.concat(F.lit("步骤 "), (i + 1).cast("string")).alias("name"), x.alias("description"), F.lit("记忆").alias("source"), F.lit(None).cast("string").alias("customization")))
    none = F.array().cast("array<string>")
    return kb(s, d).where("content is not null").select(F.col("id").alias("skill_id"), F.col("title").alias("problem"), F.substring("content", 1, 120).alias("description"), F.lit(None).cast("string").alias("rationale"), F.lit("manual").alias("type"), F.lit(0.75).alias("confidence"), F.lit(False).alias("needs_verification"), F.col("tags").alias("references"), none.alias("base_skills"), none.alias("potential_issues"), none.alias("checklist"), steps.alias("steps"))


def skill_quality(s, d):
    q = skills.quality(_skills(s, d))
    return _six(q, *skills.WEIGHTS)


def skill_runs(s, d):
    return skills.executed(_skills(s, d).withColumn("problem", F.coalesce("problem", F.lit("")))).select("skill_id", "success", "steps_completed", "total_steps", F.array_join("outputs", "\n").alias("outputs"))


NAMES = (
    "kb_bm25_top10 kb_bm25_by_category ltm_bm25_top20 ltm_bm25_scores kb_keyword_top10 ltm_keyword_top20 ltm_blank_query skill_entries_top5 tf_vectors tf_cosine_top10 embedding_cosine_top10 hybrid_two_way hybrid_three_way "
    "exact_dedup_groups exact_dedup_firsts jaccard_items_vs_ltm cosine_items_vs_ltm edit_titles duplicate_items items_per_source adaptation_strategies suggested_actions merged_titles added_distinct sensitive_flags sensitive_redacted "
    "kb_index ltm_latest kb_confirmed ltm_checked kb_checked ltm_updated ltm_deleted ltm_upserted ltm_migrated shard_names kb_paragraphs ltm_profile store_status suggestion_coverage event_statistics weight_statistics ranked_by_weight "
    "session_summaries active_sessions session_context pending_items flush_results trigger_first_rule trigger_session_fold hourly_event_types "
    "problem_analysis match_keywords dedup_token_counts feedback_signals problem_parts generation_gate skill_drafts gathered_memories composition_plans matched_skills skill_quality skill_runs"
).split()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: globals()[n] for n in NAMES}


def oracle_sql() -> dict[str, str]:
    return oracle.sql()
