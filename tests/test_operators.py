"""Core operators on small hand-made rows: edges, ties, nulls, empty tables."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cairn.operators import crypto, dedup, ranking, records, search, sensitive, sessions, skills, summaries, vectors

T0 = datetime(2025, 1, 1)
ENTRY = "id string, content string, category string, tags array<string>, created_at timestamp_ntz, updated_at timestamp_ntz, source string"


def entries(spark, *rows):
    return spark.createDataFrame([(i, c, k, t, T0 + timedelta(days=n), T0, "s") for n, (i, c, k, t) in enumerate(rows)], ENTRY)


def okapi(corpus, query):
    n = len(corpus)
    df = {}
    for d in corpus:
        for t in set(d):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: 0.25 * mean if v < 0 else v for t, v in idf.items()}
    avg = sum(map(len, corpus)) / n
    return [sum(idf.get(q, 0) * d.count(q) * 2.5 / (d.count(q) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for q in query) for d in corpus]


@pytest.mark.parametrize("texts", [["a b"], ["a b", "b c"], ["a b c", "b c d", "b b x y", "q"]])
def test_bm25_is_okapi(spark, texts):
    d = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, t string")
    got = [r["score"] for r in search.bm25(d, F.col("t"), "b a b zz").orderBy("id").collect()]
    want = okapi([t.split() for t in texts], ["b", "a", "b", "zz"])
    assert all(abs(x - y) < 1e-9 for x, y in zip(got, want))


def test_search_blank_and_empty(spark):
    e = entries(spark, ("b", "x", "other", []), ("a", "y", "habit", None))
    assert [r["id"] for r in search.search_ltm(e, " ").collect()] == ["a", "b"]
    assert search.search_ltm(e.limit(0), "x").count() == 0
    assert [r["id"] for r in search.search_ltm(e, "x", method="keyword").collect()] == ["b"]


def test_fusion_positions_go_negative(spark):
    kw = spark.createDataFrame([(f"k{i:02d}", 100.0 - i) for i in range(11)], "id string, score double")
    vec = spark.createDataFrame([("k00", 0.5), ("v", 0.4)], "id string, score double")
    got = {r["id"]: (round(r["score"], 6), r["source"]) for r in search.fused_two_way(kw, vec, 20).collect()}
    assert got["k00"] == (0.65, "both") and got["v"] == (0.4, "vector") and got["k10"] == (-0.2, "keyword")


def test_vector_search(spark):
    e = spark.createDataFrame([("1", "a a b"), ("2", "c"), ("3", None), ("4", "")], "id string, content string")
    got = vectors.search_terms(e, "content", "a b", 5).collect()
    assert [r["id"] for r in got] == ["1"] and abs(got[0]["score"] - 3 / (5**0.5 * 2**0.5)) < 1e-9


def test_add_distinct(spark):
    s = spark.createDataFrame([("1", "Hello  World", T0)], "id string, content string, created_at timestamp_ntz")
    n = spark.createDataFrame([("2", "hello world", T0), ("3", "new", T0), ("4", " NEW ", T0)], "id string, content string, created_at timestamp_ntz")
    kept, placed = records.add_distinct(s, n)
    assert [r["id"] for r in kept.collect()] == ["3"]
    assert {r["id"]: r["held_by"] for r in placed.collect()} == {"2": "1", "3": "3", "4": "3"}


def test_update_delete_migrate(spark):
    e = entries(spark, ("1", "a", "habit", []), ("2", "b", "other", []))
    c = spark.createDataFrame([("1", "z", None)], "id string, content string, source string")
    got = {r["id"]: (r["content"], r["source"], r["updated_at"]) for r in records.updated(e, c, ["content", "source"], F.lit("2025-06-01 00:00:00").cast("timestamp_ntz")).collect()}
    assert got == {"1": ("z", "s", datetime(2025, 6, 1)), "2": ("b", "s", T0)}
    with pytest.raises(ValueError):
        records.deleted(e, c)
    assert [r["id"] for r in records.deleted(e, c, True).collect()] == ["2"]
    assert records.migrated(e, e.withColumn("category", F.lit(None).cast("string"))).count() == 2


def test_paragraphs(spark):
    long = "x" * 100
    d = spark.createDataFrame([("1", f"{long}\n\nshort\r\n\r\n{long}y"), ("2", "a\n\nb"), ("3", " "), ("4", None)], "id string, content string")
    got = [(r["id"], r["chunk_no"], r["chunk"]) for r in records.paragraphs(d, "content").orderBy("id", "chunk_no").collect()]
    assert got == [("1", 1, long), ("1", 2, long + "y"), ("2", 1, "a\n\nb")]


@pytest.mark.parametrize("method", dedup.METHODS)
def test_matches_are_brute_force(spark, method):
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]
    texts = [" ".join(words[(i * j) % 8] for j in range(1, 7)) for i in range(12)] + ["", None, "alpha beta gamma delta eps zeta", "alpha beta gamma delta eps eta"]
    d = spark.createDataFrame([(f"{i:02d}", t) for i, t in enumerate(texts)], "id string, text string")
    got = {(r["id"], r["match_id"]): round(r["similarity"], 9) for r in dedup.matches(d, d, 0.7, method).collect()}
    a, b = d.alias("a"), d.alias("b")
    full = a.crossJoin(b).select(F.col("a.id").alias("i"), F.col("b.id").alias("j"), dedup.similarity(method, F.col("a.text"), F.col("b.text")).alias("s")).where("s >= 0.7 - 1e-12")
    assert got == {(r["i"], r["j"]): round(r["s"], 9) for r in full.collect()}


def test_suggested_action_and_merge(spark):
    old = spark.createDataFrame([("o", "one two three four five six seven")], "id string, text string")
    new = spark.createDataFrame([("a", "one two three four five six seven"), ("b", "one two three four five six eight"), ("c", "other words")], "id string, text string")
    assert {r["id"]: r["action"] for r in dedup.suggested_action(new, old).collect()} == {"a": "skip", "b": "merge", "c": "save"}
    g = spark.createDataFrame([("1", "g", "long sentence here. another one now"), ("2", "g", "another one now")], "id string, grp string, text string")
    assert dedup.merged(g, "grp", "text").first()["merged"] == "another one now。long sentence here。"


SECRETS = {
    "sk-" + "a" * 20: "[API_KEY:sk-***]",
    "api_key = " + "k" * 16: "[API_KEY:***]",
    "Bearer " + "t" * 20: "[TOKEN:Bearer ***]",
    "密码：abcd": "[PASSWORD:***]",
    "11010519491231002X": "[ID:***]",
    "110105194912310021": "[ID:***]",
    "1234567890123456": "[BANK_CARD:****]",
    "-----BEGIN RSA PRIVATE KEY-----": "[PRIVATE_KEY:***]",
    "123456789012345": "123456789012345",
    "12345678901234567890": "12345678901234567890",
    "password=" + "sk-" + "a" * 20: "[PASSWORD:***]",
}


def test_redaction(spark):
    d = spark.createDataFrame([(str(i), f"x {k} y") for i, k in enumerate(SECRETS)] + [("n", None), ("e", "")], "id string, t string")
    got = {r["id"]: (r["redacted"], r["is_sensitive"]) for r in sensitive.scanned(d, "t").collect()}
    for i, (k, v) in enumerate(SECRETS.items()):
        assert got[str(i)] == (f"x {v} y", k != v), k
    assert got["n"] == (None, False) and got["e"] == ("", False)


def test_encryption_round_trip(spark):
    d = spark.createDataFrame([("1", "secret 中"), ("2", None)], "id string, t string")
    e = crypto.encrypted(d, "t", "pass", iterations=10)
    assert "t" not in e.columns and crypto.keys(e).columns == ["id"]
    e = spark.createDataFrame(e.collect(), e.schema)
    assert {r["id"]: r["plaintext"] for r in crypto.decrypted(e, "pass", iterations=10).collect()} == {"1": "secret 中", "2": None}
    assert crypto.decrypted(e, "wrong", iterations=10).where("plaintext is not null").count() == 0


def test_ranking(spark):
    as_of = datetime(2025, 2, 1)
    ages = [0, 7, 8, 30, 31, -5]
    d = spark.createDataFrame([(str(a), as_of - timedelta(days=a)) for a in ages] + [("none", None)], "id string, created_at timestamp_ntz")
    w = spark.createDataFrame([("8", 5)], "entry_id string, weight int")
    got = {r["id"]: (r["weight"], round(r["time_score"], 6)) for r in ranking.ranked(d, w, F.lit(as_of).cast("timestamp_ntz")).collect()}
    assert got == {"0": (2, 1.0), "7": (2, 1.0), "8": (5, round(0.5 * (1 - 1 / 23), 6)), "30": (2, 0.0), "31": (2, 0.1), "-5": (2, 1.0), "none": (2, 0.3)}
    bad = spark.createDataFrame([("a", 9), ("b", 3)], "entry_id string, weight int")
    assert ranking.set_weights(w, bad).collect() == w.collect()
    assert ranking.set_weights(w, bad.where("weight = 3")).count() == 2
    assert ranking.weight_statistics(w.limit(0)).count() == 0


def test_session_fold_falls_through(spark):
    rows = [(1, "s", T0, "message", "I like green tea"), (2, "s", T0, "message", "I like green tea"), (3, "s", T0, "system", "I like green tea"), (4, "s", T0, "message", "short"), (5, "t", None, None, "x" * 400), (6, "t", T0, "message", "I like tea and my name is Bob Smith")]
    e = spark.createDataFrame(rows, "event_id long, session_id string, event_ts timestamp_ntz, event_type string, content string")
    got = [(r["event_id"], r["category"], r["content"]) for r in sessions.suggestions(e).orderBy("event_id", "destination").collect()]
    assert got == [(1, "preference", "I like green tea"), (6, "preference", "I like tea and my name is Bob Smith")]
    assert sessions.suggestions(e.limit(0)).count() == 0


def test_session_fold_in_a_stream(spark, tmp_path):
    from cairn.streaming import sessions as st

    rows = [(1, "s", T0, "message", "I like green tea"), (2, "s", T0, "message", "I like green tea")]
    e = spark.createDataFrame(rows, "event_id long, session_id string, event_ts timestamp, event_type string, content string")
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = st.suggestions(stream).writeStream.format("memory").queryName("said").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    assert [r["event_id"] for r in spark.table("said").collect()] == [1]
    counts = st.windowed_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    assert counts.awaitTermination(90)
    assert spark.table("counts").first()["events"] == 2


def test_flush(spark):
    i = spark.createDataFrame([("s", "c", "habit", "ltm"), ("s", "k", "technical", "kb"), ("s", "g", "goal", "ltm"), ("s", " ", "habit", "ltm"), ("s", "k", None, "kb")], "session_id string, content string, category string, destination string")
    ltm, kb, rejects = sessions.flushed(i)
    assert ltm.count() == 1 and kb.first()["title"] == "k" and sorted(r["error"] for r in rejects.collect()) == ["content is empty", "unknown category", "unknown category"]


STEP = "array<struct<name string, description string, source string, customization string>>".replace(" string", ": string")


def skill(spark, steps, **k):
    base = {"skill_id": "s", "description": "a description of some length", "rationale": "because it is so", "type": "manual", "confidence": 0.9, "needs_verification": False, "references": ["a", "b", "c"], "base_skills": ["x", "y"], "potential_issues": ["i"], "checklist": ["c"], "problem": "p q"} | k
    schema = f"skill_id string, description string, rationale string, type string, confidence double, needs_verification boolean, references array<string>, base_skills array<string>, potential_issues array<string>, checklist array<string>, problem string, steps {STEP}"
    return spark.createDataFrame([(*base.values(), steps)], schema)


def test_quality(spark):
    steps = [("分析", "d" * 40, "框架", None), ("设计", "d" * 5, "框架", None)]
    r = skills.quality(skill(spark, steps)).first()
    assert round(r["completeness"], 6) == round(0.3 * 0.4 + 0.4 * 0.5 + 0.3 * 0.25, 6)
    assert round(r["clarity"], 6) == round(0.3 + 0.4 * 0.5 + 0.3 * 1.0, 6)
    assert round(r["feasibility"], 6) == round(0.4 * 0.5 + 0.3 + 0.27, 6)
    assert (r["evidence_support"], r["generalizability"], round(r["novelty"], 6), r["risk_mitigation"]) == (1.0, 1.0, 0.6, 0.7)
    none = skills.quality(skill(spark, [])).first()
    assert (none["completeness"], none["clarity"], none["feasibility"]) == (0.0, 0.0, 0.0)


def test_execution(spark):
    ok = skills.executed(skill(spark, [("a", "first", "框架", "c"), ("b", "second", "自动生成", None)])).first()
    assert ok["success"] and ok["outputs"] == ["first\n调整点：c", "[自动生成] second\n基于前序步骤：first\n调整点：c"]
    bad = skills.executed(skill(spark, [("a", "first", "框架", None), ("b", "second", "?", None), ("c", "third", "框架", None)])).first()
    assert (bad["success"], bad["steps_completed"], bad["total_steps"], bad["outputs"]) == (False, 1, 3, None)


def test_versions(spark):
    d = spark.createDataFrame([("1.0",), ("2.9.3",), ("1.0-beta",), ("x",)], "v string")
    assert [r[0] for r in d.select(skills.next_version(F.col("v"))).collect()][:2] == ["1.1", "2.10"]


def test_match_is_brute_force(spark):
    p = spark.createDataFrame([("1", "cache index search"), ("2", "缓存索引"), ("3", "zz")], "problem_id string, problem string")
    s = spark.createDataFrame([("a", "an INDEX over caches"), ("b", "索引与缓存"), ("c", "")], "skill_id string, text string")
    assert {r["problem_id"]: (r["skill_id"], round(r["relevance"], 6)) for r in skills.matched(p, s).collect()} == {"1": ("a", 0.666667), "2": ("b", round(6 / 7, 6))}


def test_coverage(spark):
    d = spark.createDataFrame([("g", 0.9, ["a", "b"], "x"), ("g", 0.1, None, "y")], "grp string, relevance double, tags array<string>, category string")
    r = summaries.coverage(d, ["grp"]).first()
    assert (r["coverage"], r["diversity"], r["can_compose"]) == (0.5, 1.0, True)


def test_advice_and_cascade(spark):
    r = skills.advised(skills.quality(skill(spark, []))).first()
    assert len(r["recommendations"]) == 3 and r["action"] == "collect_feedback"
    good = skills.advised(skills.quality(skill(spark, [("分析", "d" * 40, "框架", None), ("评估验证总结反馈", "d" * 40, "框架", None)]))).first()
    assert good["recommendations"] == [skills.ALL_WELL] and good["status"] == "ready_for_use"
    p = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "problem_id string")
    plans = spark.createDataFrame([("1", True), ("2", True), ("3", False)], "problem_id string, can_compose boolean")
    made = spark.createDataFrame([("3", 0.72, True), ("4", 0.6, False)], "problem_id string, overall double, approved boolean")
    got = {r["problem_id"]: tuple(r)[1:] for r in skills.solved(p, p.where("problem_id = '1'"), plans, made).collect()}
    assert got == {"1": (1, 0.95, "success", False), "2": (2, 0.80, "success", False), "3": (3, 0.72, "partial", True), "4": (0, 0.0, "failed", False)}


def test_generation_sources(spark):
    a = spark.createDataFrame([("m", 0.1)], "id string, score double")
    b = spark.createDataFrame([("k", 9.0), ("l", 8.0)], "id string, score double")
    assert [r["id"] for r in skills.generation_sources(a, b, 2).collect()] == ["m", "k"]


def test_matched_skills_take_whole_problems(spark, small):
    from cairn.plans import queries as q

    p = q.items(spark, small).where("content is not null").select(F.col("item_id").alias("problem_id"), F.col("content").alias("problem"))
    t = q.kb(spark, small).select(F.col("id").alias("skill_id"), F.concat_ws(" ", "title", F.array_join("tags", " "), F.substring("content", 1, 200)).alias("text"))
    want = {(r["problem_id"], r["skill_id"], round(r["relevance"], 6)) for r in skills.matched(p, t).collect()}
    assert {tuple(r) for r in q.matched_skills(spark, small).select("problem_id", "skill_id", "relevance").collect()} == want


def test_secrets_with_blanks_and_digits_of_other_kinds(spark):
    from cairn.operators import sensitive

    rows = [(1, "password\u3000:\u3000hunter22"), (2, "卡号 １２３４５６７８９０１２３４５６"), (3, "nothing here"), (4, None), (5, "")]
    got = {r["id"]: r for r in sensitive.scanned(spark.createDataFrame(rows, "id int, text string"), "text").collect()}
    assert [got[i]["is_sensitive"] for i in (1, 2, 3, 4, 5)] == [True, True, False, False, False]
    assert got[1]["redacted"] == "[PASSWORD:***]" and got[2]["redacted"] == "卡号 [BANK_CARD:****]" and got[4]["redacted"] is None


def test_keywords_are_searches_of_their_own(spark):
    from cairn.operators import skills

    memories = spark.createDataFrame([("a", "市场分析与竞争分析的笔记", ["x"], "insight"), ("b", "marketing notes", [], "chat"), ("c", "something else", ["improvement"], None), ("d", None, None, None)], "id string, content string, tags array<string>, category string")
    problems = spark.createDataFrame([("p", "市场分析 竞争分析"), ("q", "improve marketing, plan"), ("r", ""), ("s", None)], "problem_id string, problem string")
    got = {(r["problem_id"], r["id"]) for r in skills.gathered(problems, memories).collect()}
    assert ("p", "a") in got and ("q", "b") in got and ("q", "c") in got and {p for p, _ in got} == {"p", "q"}


def test_deletion_needs_the_passphrase(spark):
    import pytest
    from pyspark.sql import functions as F

    from cairn.operators import crypto

    d = crypto.encrypted(spark.createDataFrame([("1", "one"), ("2", "two")], "id string, content string"), "content", "right", iterations=10)
    d = spark.createDataFrame(d.collect(), d.schema)
    assert [r["id"] for r in crypto.deleted(d, "right", F.col("id") == "1", iterations=10).collect()] == ["2"]
    with pytest.raises(Exception, match="wrong passphrase"):
        crypto.deleted(d, "wrong", F.col("id") == "1", iterations=10).collect()


def test_is_duplicate(spark):
    from cairn.operators import dedup

    old = spark.createDataFrame([("o", "alpha beta gamma delta epsilon")], "id string, text string")
    new = spark.createDataFrame([("1", "alpha beta gamma delta epsilon"), ("2", "something quite different here"), ("3", None)], "id string, text string")
    assert {r["id"]: r["is_duplicate"] for r in dedup.is_duplicate(new, old, 0.85, "jaccard").collect()} == {"1": True, "2": False, "3": False}


def test_keywords_meet_memories_block_by_block(spark, monkeypatch):
    from cairn.operators import blocks, search

    monkeypatch.setattr(blocks, "TEXTS", 7)
    monkeypatch.setattr(blocks, "QUERIES", 3)
    rows = [(f"m{i:02}", None if i == 3 else f"缓存 索引 word{i % 5} " + "alpha " * (i % 4), [] if i % 3 else [f"tag{i % 5}", "缓存"], "habit" if i % 2 else None) for i in range(40)]
    memories = spark.createDataFrame(rows, "id string, content string, tags array<string>, category string")
    words = ["缓存", "索引缓存", "word1", "word2 alpha", "tag", "a", "ag3", "nothing", "...", "habit"]
    found = search.recalled(spark.createDataFrame([(w,) for w in [*words, "tag", None, " "]], "keyword string"), memories, 5)
    # pairs of keywords and memories are never rows
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()
    got = {r["keyword"]: [(x["id"], round(-x["loss"], 6)) for x in r["top"]] for r in found.collect()}
    for w in words:
        want = search.search_ltm(memories, w, k=40).withColumn("score", F.round("score", 9)).orderBy(F.col("score").desc(), "id").limit(5).collect()
        assert got.get(w, []) == [(r["id"], round(r["score"], 6)) for r in want], w
    assert {*got} <= {*words}


def test_problems_meet_skills_block_by_block(spark, monkeypatch):
    from cairn.functions import text as tx
    from cairn.operators import blocks

    monkeypatch.setattr(blocks, "TEXTS", 5)
    monkeypatch.setattr(blocks, "QUERIES", 4)
    words = ["cache", "index", "search", "缓存", "索引", "report", "(plan)", "cat"]
    text = lambda i, n: " ".join(words[(i * 3 + j * (1 + i % 2)) % len(words)] for j in range(n))
    p = spark.createDataFrame([(f"p{i:02}", text(i, 2 + i % 4)) for i in range(24)] + [("none", None), ("dup", "cat cat index")], "problem_id string, problem string")
    s = spark.createDataFrame([(f"s{i:02}", None if i == 4 else text(i + 1, 1 + i % 5).upper() + "　x") for i in range(30)], "skill_id string, text string")
    found = skills.matched(p, s)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()
    all_ = p.select("problem_id", tx.match_keywords("problem").alias("k")).crossJoin(s).where("size(k) > 0").select("problem_id", "skill_id", (F.size(F.filter("k", lambda k: F.lower("text").contains(k))) / F.size("k")).alias("v")).where("v >= 0.4").collect()
    want = {}
    for r in sorted(all_, key=lambda r: (r["problem_id"], -r["v"], r["skill_id"])):
        want.setdefault(r["problem_id"], (r["skill_id"], r["v"]))
    assert want and {r["problem_id"]: (r["skill_id"], r["relevance"]) for r in found.collect()} == want


def test_contents_meet_steps_before_problems(spark):
    p = spark.createDataFrame([("p", "营销 推广"), ("q", "plain words")], "problem_id string, problem string")
    found = spark.createDataFrame([("p", "a", "渠道选择与预算分配", 0.5), ("p", "b", "渠道选择", 0.7), ("p", "c", "预算分配", 0.3), ("q", "a", "渠道选择与预算分配", 0.5)], "problem_id string, id string, content string, relevance double")
    plan = skills.composed(p, found)
    assert "BroadcastNestedLoopJoin" in plan._jdf.queryExecution().executedPlan().toString()
    own = {(r["problem_id"], r["step"]): (r["source"], r["relevance"]) for r in plan.collect() if r["source"] != "framework"}
    assert own == {("p", "渠道选择"): ("b", 0.7), ("p", "预算分配"): ("a", 0.5)} and plan.count() == 10


def test_adaptation_of_gathered_plans(spark):
    memories = spark.createDataFrame([(x, f"营销 {x}", ["营销"], "insight") for x in ("目标定位", "渠道选择", "内容制定", "预算分配")], "id string, content string, tags array<string>, category string")
    p = spark.createDataFrame([("p", "营销 推广"), ("q", "plain words")], "problem_id string, problem string")
    out = skills.adaptation(p, skills.composed(p, skills.gathered(p, memories)))
    assert "FlatMapCoGroupsInArrow" in out._jdf.queryExecution().executedPlan().toString()
    got = {r["problem_id"]: (r["framework"], len(r["warnings"]), r["confidence"]) for r in out.collect()}
    assert got == {"p": ("marketing_strategy", 0, 0.75), "q": ("problem_solving", 1, 0.6)}


def test_only_supported_problems_ask_memories(spark):
    memories = spark.createDataFrame([("a", "营销 渠道选择", ["营销"], "insight"), ("b", "营销 only beta here", ["x"], None), ("c", None, None, None)], "id string, content string, tags array<string>, category string")
    p = spark.createDataFrame([("p", "营销 推广"), ("q", "plain words"), ("r", "产品 beta"), ("s", None)], "problem_id string, problem string")
    assert [r["problem_id"] for r in skills.supported(p, memories).collect()] == ["p"]
    own = spark.createDataFrame([("product_optimization", 1, "alpha beta"), ("problem_solving", 1, "gamma")], "kind string, step_no int, step string")
    assert [r["problem_id"] for r in skills.supported(p, memories, own).collect()] == ["r"]
    for f in (None, own):
        rows = lambda asked: sorted(map(str, skills.adaptation(p, skills.composed(p, skills.gathered(asked, memories), f)).collect()))  # noqa: E731, B023
        assert rows(skills.supported(p, memories, f)) == rows(p)


def _alike(spark):
    words = [f"w{i:02}" for i in range(40)]
    old = [(f"o{i:02}", " ".join(words[(i * 7 + j * j) % 40] for j in range(9))) for i in range(30)]
    new = [(f"n{i:02}", old[i % 30][1] + (f" w{i:02} w{i + 1:02}" if i % 3 else "")) for i in range(38)] + [("none", None), ("x", "!")]
    df = lambda rows: spark.createDataFrame(rows, "id string, text string")
    return df(new), df(old)


@pytest.mark.parametrize("method", ["cosine", "jaccard"])
def test_only_prefixes_are_shuffled(spark, method):
    new, old = _alike(spark)
    found = dedup.matches(new, old, 0.85, method)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") >= 3
    x, y = new.alias("x"), old.alias("y")
    want = x.crossJoin(y).select("x.id", "y.id", F.round(dedup.similarity(method, F.col("x.text"), F.col("y.text")), 9).alias("s")).where("s >= 0.85").collect()
    assert want and {tuple(r) for r in found.select("id", "match_id", F.round("similarity", 9)).collect()} == {tuple(r) for r in want}


def test_actions_come_from_prefixes(spark):
    new, old = _alike(spark)
    found = dedup.suggested_action(new, old)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    best = {r["id"]: r["s"] for r in new.alias("x").crossJoin(old.alias("y")).where("x.text is not null").groupBy("x.id").agg(F.max(F.round(dedup.similarity("cosine", F.col("x.text"), F.col("y.text")), 9)).alias("s")).collect()}
    act = lambda s: "skip" if s >= 0.95 else "merge" if s >= 0.85 else "save"
    assert {r["id"]: r["action"] for r in found.collect()} == {"none": "save"} | {k: act(v) for k, v in best.items()}


def test_actions_shuffle_neither_texts_nor_pairs(spark, monkeypatch):
    import random

    rng = random.Random(5)
    words = [f"w{i:02}" for i in range(60)] + ["the"] * 25
    line = lambda n: [rng.choice(words) for _ in range(n)]
    old = [line(rng.randint(1, 40)) for _ in range(300)]
    changed = [[rng.choice(words) if rng.random() < 0.08 else w for w in rng.choice(old)] for _ in range(200)]
    new = [*changed, *old[:20], *(line(rng.randint(1, 40)) for _ in range(40)), ["the"] * 70_000, ["!"], old[0]]
    df = lambda rows: spark.createDataFrame([(f"{i:03}", " ".join(t)) for i, t in enumerate(rows)] + [("none", None)], "id string, text string")
    a, b = df(new), df([*old, ["the"] * 5, old[0]])
    # several blocks of either side, long and short posting lists
    for name, value in (("BLOCK", 128), ("LONG", 4), ("WORTH", 50), ("EXPANDED", 1_000), ("MEASURED", 64)):
        monkeypatch.setattr(dedup, name, value)
    found = dedup.suggested_action(a, b)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and not any("Exchange" in above and "text#" in above for above in plan.split("\n"))
    best = {f"{i:03}": max(dedup._token_similarity([w for w in t if len(w) > 1], u, "cosine") for u in [*old, ["the"] * 5]) for i, t in enumerate(new)}
    act = lambda s: "skip" if s >= 0.95 else "merge" if s >= 0.85 else "save"
    want = {k: (act(v), round(v, 9) if v >= 0.85 else 0.0) for k, v in best.items()} | {"none": ("save", 0.0)}
    assert {r["id"]: (r["action"], round(r["similarity"], 9)) for r in found.collect()} == want
    assert {a for a, _ in want.values()} == {"skip", "merge", "save"}


def test_edit_distance_is_measured_on_near_pairs_only(spark):
    texts = ["abcdefghijklmnopqrst", "abcdefghijXlmnopqrst", "bcdefghijklmnopqrstu", "klmnopqrstabcdefghij", "缓存索引缓存索引", "缓存索引缓存索", "a", "a", "ab", "", "aaaaaaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaaaaab"]
    d = spark.createDataFrame([(f"{i:02}", t) for i, t in enumerate(texts)], "id string, text string")
    found = dedup.matches(d, d, 0.85, "levenshtein")
    assert "bit_count" in found._jdf.queryExecution().executedPlan().toString()
    x, y = d.alias("x"), d.alias("y")
    want = x.crossJoin(y).select("x.id", "y.id", dedup.similarity("levenshtein", F.col("x.text"), F.col("y.text")).alias("s")).where("s >= 0.85").collect()
    assert {tuple(r) for r in found.select("id", "match_id", "similarity").collect()} == {tuple(r) for r in want}


def test_edit_distance_meets_in_pairs_of_blocks(spark, monkeypatch):
    import random

    rng = random.Random(7)
    line = lambda n: "".join(rng.choice("abcdefgh 缓存索引😀") for _ in range(n))
    old = [line(rng.randint(1, 60)) for _ in range(120)] + [line(900), "a", "b", "", None]
    changed = ["".join(rng.choice("xyz") if rng.random() < 0.06 else c for c in rng.choice(old[:121])) for _ in range(120)]
    rows = [(f"{i:03}", t) for i, t in enumerate([*old, *changed, *old[:15], changed[0], old[120][3:] + "xyz"])] + [("000", old[5]), (None, old[6])]
    d = spark.createDataFrame(rows, "id string, text string")
    monkeypatch.setattr(dedup, "BLOCK", 60)
    found = dedup.matches_within(d, 0.8)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and not any("Exchange" in above and "_band" in above for above in plan.split("\n"))
    x, y = d.alias("x"), d.alias("y")
    want = x.join(y, F.col("x.id") < F.col("y.id")).select("x.id", "y.id", dedup.similarity("levenshtein", F.col("x.text"), F.col("y.text")).alias("s")).where("s >= 0.8").collect()
    assert len(want) > 60 and sorted(map(tuple, found.collect())) == sorted(map(tuple, want))
    a, b = d.where("id < '100'"), d.where("id >= '100'")
    want = a.alias("x").crossJoin(b.alias("y")).select("x.id", "y.id", dedup.similarity("levenshtein", F.col("x.text"), F.col("y.text")).alias("s")).where("s >= 0.8").collect()
    assert want and sorted(map(tuple, dedup.matches(a, b, 0.8, "levenshtein").collect())) == sorted(map(tuple, want))


def test_cosine_pairs_come_from_pairs_of_blocks(spark, monkeypatch):
    import random

    rng = random.Random(11)
    words = [f"w{i:02}" for i in range(60)] + ["the"] * 25
    line = lambda n: [rng.choice(words) for _ in range(n)]
    old = [line(rng.randint(1, 40)) for _ in range(200)] + [["the"] * 5]
    new = [*([rng.choice(words) if rng.random() < 0.08 else w for w in rng.choice(old)] for _ in range(120)), *old[:20], ["!"], ["the"] * 70_000]
    df = lambda texts: spark.createDataFrame([(f"{i:03}", " ".join(t)) for i, t in enumerate(texts)] + [("none", None)], "id string, text string")
    a, b = df(new), df([*old, *old[:9]])
    a, b = a.unionByName(a.limit(30)), b.unionByName(b.limit(30))  # rows that came again
    for name, value in (("BLOCK", 64), ("LONG", 4), ("WORTH", 50), ("EXPANDED", 1_000), ("MEASURED", 64)):
        monkeypatch.setattr(dedup, name, value)
    found = dedup.matches(a, b, 0.85, "cosine")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and not any("Exchange" in above and "term#" in above for above in plan.split("\n"))
    value = lambda t, u: dedup._token_similarity([w for w in t if len(w) > 1], u, "cosine")
    want = sorted((f"{i:03}", f"{j:03}", round(s, 9)) for i, t in enumerate(new) for j, u in enumerate([*old, *old[:9]]) if (s := value(t, u)) >= 0.85 - 1e-12)
    assert len(want) > 100 and sorted((r["id"], r["match_id"], round(r["similarity"], 9)) for r in found.collect()) == want
