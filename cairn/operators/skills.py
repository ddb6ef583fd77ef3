"""Procedures ("skills"): matching problems to stored ones, composing steps from memories, generating drafts, scoring them.

Problems are rows (problem_id, problem); frameworks and templates are small fixed
tables.  Everything is array expressions and joins with those tables; memories
meet the keywords of problems block by block (``search.recalled``), and bring their
contents when the best are known.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from . import blocks, search

# Frameworks with their steps.
FRAMEWORKS = {
    "business_planning": ["市场分析", "竞争分析", "资源评估", "风险评估", "计划制定"],
    "product_optimization": ["需求分析", "用户研究", "设计迭代", "测试验证", "发布"],
    "marketing_strategy": ["目标定位", "渠道选择", "内容制定", "预算分配", "效果评估"],
    "problem_solving": ["问题定义", "原因分析", "方案设计", "方案评估", "执行计划"],
}
# Templates of drafts with their names, steps and match by domain.
TEMPLATES = {
    "analysis": ("分析框架", ["定义范围", "收集数据", "分析模式", "识别机会", "总结洞察"]),
    "planning": ("规划框架", ["设定目标", "分析现状", "识别差距", "制定策略", "执行计划"]),
    "optimization": ("优化框架", ["识别瓶颈", "评估改进选项", "优先级排序", "实施改进", "验证效果"]),
    "research": ("研究框架", ["明确研究问题", "设计研究方法", "收集证据", "分析数据", "得出结论"]),
    "design": ("设计框架", ["理解需求", "概念设计", "详细设计", "原型测试", "迭代改进"]),
}
BEST_TEMPLATE = {"general": ("analysis", 0.8), "business": ("planning", 0.9), "product": ("optimization", 0.9), "marketing": ("analysis", 0.6), "technical": ("analysis", 0.6)}
MATCH_AT = 0.40
#: Weights of the quality dimensions.
WEIGHTS = {"completeness": 0.20, "clarity": 0.15, "feasibility": 0.20, "evidence_support": 0.20, "generalizability": 0.10, "novelty": 0.05, "risk_mitigation": 0.10}


def analysed(problems: DataFrame) -> DataFrame:
    """``problems`` with keywords, kind, expertise, domain, complexity and clarity."""
    p = F.col("problem")
    return problems.select("*", tx.keywords(p).alias("keywords"), tx.problem_kind(p).alias("kind"), tx.expertise(p).alias("expertise"), tx.domain(p).alias("domain"), tx.complexity(p).alias("complexity"), tx.clarity(p).alias("clarity"))


def matched(problems: DataFrame, skills: DataFrame) -> DataFrame:
    """(problem_id, skill_id, relevance): the best skill (skill_id, text) of each problem by its share of keywords, from 0.40 on.

    Problems bring their keywords and skills their texts block by block; within a
    block each distinct word of the texts tells which keywords lie in it (keywords hold
    no blanks), and a problem adds up the skills under its keywords.  Pairs are never rows.
    """
    p = problems.select("problem_id", tx.match_keywords("problem").alias("keywords")).where(F.size("keywords") > 0)
    s = skills.where("text is not null").select("skill_id", F.lower("text").alias("text"))
    texts, parts = blocks.grid(s, s.count(), p, p.count(), "skill_id", "problem_id")
    kind = {"p": p.schema["problem_id"].dataType.simpleString(), "s": s.schema["skill_id"].dataType.simpleString()}
    found = blocks.paired(texts, parts, _best_skill, f"problem_id {kind['p']}, loss double, skill_id {kind['s']}")
    return found.groupBy("problem_id").agg(F.min_by("skill_id", F.struct("loss", "skill_id")).alias("skill_id"), (-F.min("loss")).alias("relevance"))


def _best_skill(skills: pa.Table, problems: pa.Table) -> pa.Table:
    """(problem_id, loss, skill_id): the best skill (skill_id, text) of a block for each problem (problem_id, keywords), if it reaches MATCH_AT."""
    skills = skills.sort_by("skill_id")  # the first of the best has the lowest id
    n = skills.num_rows
    asked, begin = blocks.lists(problems["keywords"])
    terms = pc.unique(asked)
    held = blocks.Postings(*search.inside([t.split() for t in skills["text"].to_pylist()], terms.to_pylist(), np.int16), len(terms), n)
    some = np.diff(held.at) > 0
    of_problem = pc.index_in(asked, value_set=terms).to_numpy(zero_copy_only=False)
    count = blocks.room(n, np.int16)
    rows, losses, places = [], [], []
    for q in range(problems.num_rows):
        mine = of_problem[begin[q] : begin[q + 1]]
        known = mine[some[mine]]
        if not len(known) or len(known) / len(mine) < MATCH_AT:
            continue
        count[:] = 0
        for c in known.tolist():
            held.add(count, c)
        place = int(count.argmax())
        share = int(count[place]) / len(mine)
        if share >= MATCH_AT:
            rows.append(q)
            losses.append(-share)
            places.append(place)
    return pa.table([problems["problem_id"].take(pa.array(rows, pa.int64())), pa.array(losses, pa.float64()), skills["skill_id"].take(pa.array(places, pa.int64()))], names=["problem_id", "loss", "skill_id"])


def item_relevance(content: Column, tags: Column, category: Column, keyword: Column) -> Column:
    """0.4 for the keyword in the content, 0.3 in a tag, 0.2 for a discursive category, 0.1 always."""
    in_tags = F.coalesce(F.exists(tags, lambda t: t.contains(keyword)), F.lit(False))
    return F.least(F.lit(1.0), F.when(F.coalesce(content.contains(keyword), F.lit(False)), 0.4).otherwise(0.0) + F.when(in_tags, 0.3).otherwise(0.0) + F.when(F.coalesce(category.isin("discussion", "insight", "method"), F.lit(False)), 0.2).otherwise(0.0) + 0.1)


def recalled(problems: DataFrame, memories: DataFrame, k: int = 10, each: int = 20) -> DataFrame:
    """(problem_id, id, keyword, relevance): memories recalled by each keyword of a problem, the best ``k`` for each problem.

    A keyword is a search of its own: its best ``each`` memories by BM25 and tags.
    Problems without keywords and null problems have no rows; ties go to the lower id
    and keyword.  Each keyword brings its list of at most ``k`` memories, so lists meet
    problems, not rows.
    """
    keys = problems.select("problem_id", F.explode(tx.keywords("problem")).alias("keyword"))
    best = search.recalled(keys.select("keyword"), memories, each)
    found = best.select("keyword", F.explode("top.id").alias("id"))
    scored = found.join(memories.select("id", "content", "tags", "category"), "id").select("keyword", "id", item_relevance(F.col("content"), F.col("tags"), F.col("category"), F.col("keyword")).alias("relevance"))
    lists = scored.groupBy("keyword").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("relevance")).alias("loss"), "id", "keyword"))), 1, k).alias("top"))
    top = blocks.best(keys.join(lists, "keyword").select("problem_id", "top"), "problem_id", k)
    return top.select("problem_id", F.explode("top").alias("x")).select("problem_id", "x.id", "x.keyword", (-F.col("x.loss")).alias("relevance"))


def gathered(problems: DataFrame, memories: DataFrame, k: int = 10, each: int = 20) -> DataFrame:
    """(problem_id, id, keyword, content, tags, category, relevance): ``recalled`` with what the memories hold."""
    about = memories.select("id", "content", "tags", "category")
    return recalled(problems, memories, k, each).join(about, "id").select("problem_id", "id", "keyword", "content", "tags", "category", "relevance")


def framework_steps(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, i + 1, s) for k, v in FRAMEWORKS.items() for i, s in enumerate(v)], "kind string, step_no int, step string")


def supported(problems: DataFrame, memories: DataFrame, frameworks: DataFrame | None = None) -> DataFrame:
    """The problems whose framework has a step that some memory (content) speaks of: no other can get a step from a memory (see ``composed``)."""
    known = framework_steps(problems.sparkSession) if frameworks is None else frameworks
    words = F.filter(F.split("step", tx.SPACE + "+"), lambda w: w != "")
    few = known.select("kind", "step", words.alias("words")).distinct()
    told = F.col("content").contains(F.col("step")) | F.exists("words", lambda w: F.col("content").contains(w))
    kinds = memories.select("content").join(F.broadcast(few), told).select(F.col("kind").alias("_kind")).distinct()
    return problems.withColumn("_kind", tx.problem_kind("problem")).join(F.broadcast(kinds), "_kind", "left_semi").drop("_kind")


def composed(problems: DataFrame, found: DataFrame, frameworks: DataFrame | None = None) -> DataFrame:
    """(problem_id, step_no, step, source, relevance): each framework step with the memory that fits it best, or the framework itself."""
    known = framework_steps(problems.sparkSession) if frameworks is None else frameworks
    steps = problems.select("problem_id", tx.problem_kind("problem").alias("kind")).join(F.broadcast(known), "kind")
    some = F.exists("words", lambda w: F.col("content").contains(w))
    fit = F.when(F.col("content").contains(F.col("step")), 0.8).when(some, 0.5).otherwise(0.0) * F.col("relevance")
    # contents meet the few steps of the frameworks where they are; only what fits goes on to problems
    few = known.select("step", F.filter(F.split("step", tx.SPACE + "+"), lambda w: w != "").alias("words")).distinct()
    near = found.select("problem_id", "id", "content", "relevance").where(0.8 * F.col("relevance") > 0.3)
    fits = near.crossJoin(F.broadcast(few)).withColumn("fit", fit).where("fit > 0.3").select("problem_id", "id", "step", "relevance", "fit")
    pairs = steps.join(fits, ["problem_id", "step"])
    best = pairs.groupBy("problem_id", "step_no").agg(F.min_by(F.struct("id", "relevance"), F.struct(-F.col("fit"), F.col("id"))).alias("b"))
    d = steps.join(best, ["problem_id", "step_no"], "left")
    return d.select("problem_id", "step_no", "step", F.coalesce("b.id", F.lit("framework")).alias("source"), F.coalesce("b.relevance", F.lit(0.5)).alias("relevance"))


def adaptation(problems: DataFrame, plan: DataFrame) -> DataFrame:
    """(problem_id, framework, customizations, warnings, confidence): how a composed plan has to be adapted to its problem.

    A complex problem gets checks, each field of expertise an analysis, and a plan of
    which more than half is framework a warning; the first and last cost confidence.
    """
    counts = plan.groupBy("problem_id").agg(F.count("*").alias("_n"), F.count_if(F.col("source") == "framework").alias("_f"))
    d = analysed(problems).join(counts, "problem_id")
    hard, thin = F.coalesce(F.col("complexity") == "high", F.lit(False)), F.col("_f") > F.col("_n") / 2
    fields = F.transform(F.coalesce("expertise", F.array().cast("array<string>")), lambda x: F.concat(F.lit("加强 "), x, F.lit(" 分析")))
    none = F.array().cast("array<string>")
    return d.select("problem_id", F.col("kind").alias("framework"), F.concat(F.when(hard, F.array(F.lit("增加验证步骤"))).otherwise(none), fields).alias("customizations"), F.when(thin, F.array(F.lit("超过50%的步骤来自框架模板，质量可能不够高"))).otherwise(none).alias("warnings"), F.round(0.75 - F.when(hard, 0.1).otherwise(0.0) - F.when(thin, 0.15).otherwise(0.0), 6).alias("confidence"))


def composition_quality(plan: DataFrame) -> DataFrame:
    """(problem_id, steps, from_memory, quality): 0.6 of the mean relevance and 0.4 of the share of steps from memories."""
    own = F.avg(F.when(F.col("source") != "framework", 1.0).otherwise(0.0))
    return plan.groupBy("problem_id").agg(F.count("*").alias("steps"), F.count_if(F.col("source") != "framework").alias("from_memory"), F.least(F.lit(1.0), 0.6 * F.avg("relevance") + 0.4 * own).alias("quality"))


def generation_gate(problems: DataFrame, has_context: Column) -> DataFrame:
    """``problems`` with feasibility and can_generate: at least 10 characters and 0.5."""
    f = 0.6 * tx.clarity("problem") + 0.4 * F.when(has_context, 0.7).otherwise(0.3)
    return problems.withColumn("feasibility", F.round(f, 6)).withColumn("can_generate", F.coalesce((F.length("problem") >= 10) & (F.round(f, 6) >= 0.5), F.lit(False)))


def drafts(problems: DataFrame) -> DataFrame:
    """Draft of each problem from the template that fits its domain best: name, description, template, steps, confidence, needs_verification."""
    d = problems.withColumn("domain", tx.domain("problem"))
    pick = None
    for dom, (t, score) in BEST_TEMPLATE.items():
        name, steps = TEMPLATES[t]
        value = F.struct(F.lit(t).alias("template"), F.lit(name).alias("template_name"), F.array(*map(F.lit, steps)).alias("steps"), F.lit(round(0.70 + 0.20 * score, 6)).alias("confidence"))
        pick = F.when(F.col("domain") == dom, value) if pick is None else pick.when(F.col("domain") == dom, value)
    d = d.withColumn("_t", pick)
    keys = F.array_join(F.slice(tx.keywords("problem", tx.GENERATOR_STOP), 1, 2), " ")
    return d.select("problem_id", "domain", F.concat(keys, F.lit(" 解决方案")).alias("name"), F.concat(F.lit("用于解决: "), F.substring("problem", 1, 100), F.lit("...")).alias("description"), "_t.template", "_t.steps", "_t.confidence", (F.col("_t.confidence") < 0.80).alias("needs_verification"))


def _mentions(word: str):
    return lambda s: _has(s["name"], [word]) | _has(s["description"], [word])


def _has(c: Column, words: Sequence[str]) -> Column:
    return tx.contains_any(F.coalesce(c, F.lit("")), words)


def quality(skills: DataFrame) -> DataFrame:
    """Quality dimensions, overall score, approval and level of skills.

    Columns taken: skill_id, description, rationale, type, confidence,
    needs_verification, references, base_skills, potential_issues and checklist
    (arrays), steps (array of struct name, description).
    """
    # Words that the dimensions look for.
    key, verbs, generic, specific = ["分析", "验证", "总结", "反馈"], ["分析", "评估", "计算", "确定", "验证", "执行"], ["分析", "评估", "设计", "规划", "验证", "改进"], ["本公司", "我们的", "这个项目", "该产品"]
    follows = {"分析": ["评估", "设计", "计划"], "规划": ["执行", "实施", "验证"], "验证": ["总结", "反馈", "改进"]}
    n = F.greatest(F.coalesce(F.size("steps"), F.lit(0)), F.lit(0))
    share = lambda cond: F.size(F.filter("steps", cond)) / n
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    text_len = lambda c: F.coalesce(F.length(c), F.lit(0))
    auto, unchecked = F.coalesce(F.col("type") == "auto-generated", F.lit(False)), F.coalesce("needs_verification", F.lit(False))
    covered = sum((F.when(F.exists("steps", _mentions(k)), 0.25).otherwise(0.0) for k in key), F.lit(0.0))
    pairs = F.zip_with(F.slice("steps", 1, F.greatest(n - 1, F.lit(1))), F.slice("steps", 2, F.greatest(n - 1, F.lit(1))), lambda a, b: _follows(a, b, follows))
    logic = F.when(n < 2, 0.8).otherwise(F.size(F.filter(pairs, lambda x: x)) / F.greatest(n - 1, F.lit(1)))
    dims = {
        "completeness": F.when(n == 0, 0.0).otherwise(0.3 * F.least(n / 5, F.lit(1.0)) + 0.4 * share(lambda s: text_len(s["description"]) > 10) + 0.3 * covered),
        "clarity": F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), F.when(text_len("description") > 20, 0.3).otherwise(0.0) + 0.4 * share(lambda s: _has(s["name"], verbs) | (text_len(s["name"]) > 3)) + 0.3 * logic)),
        "feasibility": F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), 0.4 * share(lambda s: text_len(s["description"]) > 30) + F.when(auto & unchecked, 0.2).otherwise(0.3) + 0.3 * F.coalesce("confidence", F.lit(0.5)))),
        "evidence_support": F.least(F.lit(1.0), 0.4 * F.least(size("references") / 3, F.lit(1.0)) + 0.3 * F.least(size("base_skills") / 2, F.lit(1.0)) + F.when(text_len("rationale") > 10, 0.3).otherwise(0.0)),
        "generalizability": F.least(F.lit(1.0), F.greatest(1.0 - 0.2 * sum((F.when(_has(F.col("description"), [t]), 1).otherwise(0) for t in specific), F.lit(0)), F.lit(0.3)) + F.when(n > 0, 0.5 * share(lambda s: _has(s["name"], generic))).otherwise(0.0)),
        "novelty": F.least(F.lit(1.0), F.when(auto, 0.6).when(F.col("type") == "composed", 0.5).otherwise(0.3) + F.when(size("base_skills") >= 2, 0.3).otherwise(0.0)),
        "risk_mitigation": F.when(size("potential_issues") > 0, 0.3).otherwise(0.0) + F.when(size("checklist") > 0, 0.4).otherwise(0.0) + F.when(unchecked, 0.3).otherwise(0.0),
    }
    d = skills.select("skill_id", "type", *(v.alias(k) for k, v in dims.items()))
    d = d.withColumn("overall", F.round(sum((F.col(k) * v for k, v in WEIGHTS.items()), F.lit(0.0)), 6))
    high = F.when(F.col("type") == "manual", 0.75).when(F.col("type") == "composed", 0.80).otherwise(0.85)
    medium = F.when(F.col("type") == "manual", 0.0).when(F.col("type") == "composed", 0.65).otherwise(0.70)
    return d.withColumn("approved", F.col("overall") >= 0.70).withColumn("level", F.when(F.col("overall") >= high, "high").when(F.col("overall") >= medium, "medium").otherwise("low"))


def _follows(a: Column, b: Column, follows: dict[str, list[str]]) -> Column:
    out = F.lit(False)
    for word, later in follows.items():
        out = out | (_has(a["name"], [word]) & _has(b["name"], later))
    return out


def executed(skills: DataFrame) -> DataFrame:
    """(skill_id, problem, success, steps_completed, total_steps, outputs): steps run in order, each on the outputs before it.

    A fold over the array of steps (name, description, source, customization); an
    unknown source stops the run without output.
    """
    start = F.struct(F.lit(True).alias("ok"), F.array().cast("array<string>").alias("outputs"))

    def step(acc: Column, s: Column) -> Column:
        outs = acc["outputs"]
        custom = lambda label: F.when(F.coalesce(F.length(s["customization"]), F.lit(0)) > 0, F.concat(F.lit(label), s["customization"])).otherwise("")
        context = F.substring(F.array_join(F.filter(outs, lambda o: o != ""), " | "), 1, 200)
        framework = F.concat(s["description"], custom("\n调整点："), F.when(context != "", F.concat(F.lit("\n基于上下文："), context)).otherwise(""))
        tokens = tx.step_tokens(F.col("problem"))
        applied = F.when(F.size(tokens) > 0, F.concat(F.lit("\n应用到「"), F.array_join(tokens, "、"), F.lit("」： 根据已有经验，"), s["description"])).otherwise("")
        memory = F.concat(s["description"], applied, custom("\n个性化调整："))
        prior = F.array_join(F.transform(F.filter(outs, lambda o: o != ""), lambda o: F.substring(o, 1, 80)), " → ")
        made = F.concat(F.lit("[自动生成] "), s["description"], custom("\n策略："), F.when(F.size(outs) > 0, F.concat(F.lit("\n基于前序步骤："), prior)).otherwise(""))
        out = F.when(s["source"] == "框架", framework).when(s["source"] == "记忆", memory).when(s["source"] == "自动生成", made)
        go = acc["ok"] & out.isNotNull()
        return F.struct(go.alias("ok"), F.when(go, F.concat(outs, F.array(out))).otherwise(outs).alias("outputs"))

    d = skills.withColumn("_r", F.aggregate("steps", start, step))
    done = F.size("_r.outputs")
    return d.select("skill_id", "problem", F.col("_r.ok").alias("success"), done.alias("steps_completed"), F.size("steps").alias("total_steps"), F.when(F.col("_r.ok"), F.col("_r.outputs")).alias("outputs"))


def next_version(version: Column) -> Column:
    """The version with its minor number up by one; null if it isn't two numbers."""
    parts = F.split(version, r"\.")
    return F.concat_ws(".", F.try_element_at(parts, F.lit(1)).try_cast("int").cast("string"), (F.try_element_at(parts, F.lit(2)).try_cast("int") + 1).cast("string"))


def with_feedback(skills: DataFrame, feedback: DataFrame) -> DataFrame:
    """Skills (skill_id, version) with feedback (skill_id, feedback): sentiment, aspect, suggestion and the version after it."""
    f = feedback.select("skill_id", tx.sentiment("feedback").alias("sentiment"), tx.aspect("feedback").alias("aspect"), F.substring(tx.strip("feedback"), 1, 200).alias("suggestion"))
    return skills.join(f, "skill_id").withColumn("new_version", next_version(F.col("version")))


# What is advised where a dimension is under its bound.
ADVICE = [
    ("completeness", 0.6, "增加或细化步骤，确保过程完整"),
    ("clarity", 0.6, "提高步骤描述的清晰度，使用更具体的语言"),
    ("feasibility", 0.6, "提供更多执行细节，确保 Skill 可实际操作"),
    ("evidence_support", 0.5, "添加更多 LTM 参考或基础 Skill"),
    ("novelty", 0.3, "尝试新的组合或视角来提高创新性"),
    ("risk_mitigation", 0.5, "识别并列出潜在风险，创建验证清单"),
]
ALL_WELL = "Skill 质量良好，可以使用"


def advised(scored: DataFrame) -> DataFrame:
    """``quality`` rows with recommendations, status and action."""
    found = F.array_compact(F.array(*[F.when(F.col(d) < F.lit(bound), F.lit(text)) for d, bound, text in ADVICE]))
    d = scored.withColumn("recommendations", F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(ALL_WELL))))
    return d.withColumn("status", F.when(F.col("approved"), "ready_for_use").otherwise("needs_improvement")).withColumn("action", F.when(F.col("approved"), "save_to_kb").otherwise("collect_feedback"))


def solved(problems: DataFrame, match: DataFrame, plans: DataFrame, made: DataFrame) -> DataFrame:
    """(problem_id, layer, confidence, status, needs_feedback): the first of a matched skill, a composed plan and an approved draft.

    ``match`` (problem_id), ``plans`` (problem_id, can_compose) and ``made``
    (problem_id, overall, approved) are results of the operators above.
    """
    m = match.select("problem_id", F.lit(True).alias("_m"))
    p = plans.where("can_compose").select("problem_id", F.lit(True).alias("_p"))
    g = made.where("approved").select("problem_id", F.col("overall").alias("_g"))
    d = problems.select("problem_id").join(m, "problem_id", "left").join(p, "problem_id", "left").join(g, "problem_id", "left")
    layer = F.when(F.col("_m"), 1).when(F.col("_p"), 2).when(F.col("_g").isNotNull(), 3).otherwise(0)
    d = d.withColumn("layer", layer)
    d = d.withColumn("confidence", F.when(F.col("layer") == 1, 0.95).when(F.col("layer") == 2, 0.80).when(F.col("layer") == 3, F.col("_g")).otherwise(0.0))
    status = F.when(F.col("layer") == 0, "failed").when((F.col("layer") == 3) & (F.col("confidence") < 0.75), "partial").otherwise("success")
    return d.select("problem_id", "layer", "confidence", status.alias("status"), ((F.col("layer") == 3) & (F.col("confidence") < 0.85)).alias("needs_feedback"))


def generation_sources(memories: DataFrame, entries: DataFrame, limit: int) -> DataFrame:
    """(id, source, relevance): memories before knowledge entries (id, score), cut at ``limit``; a memory's relevance is the word high."""
    a = memories.select("id", F.lit("ltm").alias("source"), F.lit("high").alias("relevance"), F.lit(0).alias("_o"), F.col("score").alias("_s"))
    b = entries.select("id", F.lit("kb").alias("source"), F.col("score").cast("string").alias("relevance"), F.lit(1).alias("_o"), F.col("score").alias("_s"))
    return a.unionByName(b).orderBy("_o", F.col("_s").desc(), "id").limit(limit).select("id", "source", "relevance")
