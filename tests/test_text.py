"""Text functions against plain Python."""

import re

from pyspark.sql import functions as F

from cairn.functions import similarity as sim
from cairn.functions import text as tx
from cairn.operators.search import query_tokens

TEXTS = ["我喜欢Python3编程, hello_world café", "á é x", "²³ ½ ①", "İstanbul ß", "　ideographic　space　", "", "  ", "a,b.c; d", "x" * 5000]


def col(spark, expr, texts=TEXTS):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_search_tokens_match_the_literal_query(spark):
    got = col(spark, tx.search_tokens("t"), ["我Python", "Cache INDEX, cache", "", "a_b-c"])
    assert got == [["我", "p", "y", "t", "h", "o", "n"], ["cache", "index", "cache"], [], ["a_b", "c"]]
    assert [query_tokens(t) for t in ["我Python", "Cache INDEX, cache", "", "a_b-c"]] == got


def test_null_stays_null(spark):
    df = spark.createDataFrame([(None,)], "t string")
    r = df.select(tx.search_tokens("t").alias("a"), tx.dedup_tokens("t").alias("b"), tx.normal_space("t").alias("c"), tx.sentences("t").alias("d")).first()
    assert list(r) == [None] * 4


def test_dedup_tokens(spark):
    assert col(spark, tx.dedup_tokens("t"), ["Hello, World! a 我喜欢 x"]) == [["hello", "world", "我喜欢"]]


def test_match_keywords(spark):
    got = col(spark, F.array_sort(tx.match_keywords("t")), ["我的缓存", "the big, cache. of it", "的"])
    assert got == [sorted(["我", "缓", "存", "我的", "的缓", "缓存"]), sorted(["the", "big", "cache"]), []]


def test_sentences_and_space(spark):
    assert col(spark, tx.sentences("t"), ["one two three. no! 这是一个长句子。short"]) == [["one two three", "这是一个长句子"]]
    assert col(spark, tx.normal_space("t"), ["  A \n B　C "]) == ["a b c"]


def test_problem_rules(spark):
    assert col(spark, tx.problem_kind("t"), ["my business", "优化", "推广 x", "else"]) == ["business_planning", "product_optimization", "marketing_strategy", "problem_solving"]
    assert col(spark, tx.complexity("t"), ["a" * 49, "a" * 50, "a" * 199, "a" * 200]) == ["low", "medium", "medium", "high"]
    assert col(spark, tx.sentiment("t"), ["great work", "wrong and bad", "plain"]) == ["positive", "negative", "neutral"]
    assert col(spark, tx.expertise("t"), ["用户数据 ROI"]) == [["psychology", "data_analysis"]]
    assert col(spark, tx.aspects_of("t"), ["一。二?三", "abc"]) == [["一", "二?三", "一。二"], ["abc", "abc"]]


def test_similarities(spark):
    df = spark.createDataFrame([(["a", "a", "b"], ["a", "c"], "kitten", "sitting", [1.0, 0.0], [1.0, 1.0, 0.0])], "a array<string>, b array<string>, x string, y string, u array<double>, v array<double>")
    r = df.select(sim.token_cosine(F.col("a"), F.col("b")), sim.jaccard(F.col("a"), F.col("b")), sim.edit_similarity(F.col("x"), F.col("y")), sim.dense_cosine(F.col("u"), F.col("v"))).first()
    assert abs(r[0] - 2 / (5**0.5 * 2**0.5)) < 1e-12 and abs(r[1] - 1 / 3) < 1e-12 and abs(r[2] - 4 / 7) < 1e-12 and abs(r[3] - 2**-0.5) < 1e-12
    e = df.select(sim.token_cosine(F.array().cast("array<string>"), F.col("b")), sim.edit_similarity(F.lit(""), F.lit("")), sim.dense_cosine(F.array().cast("array<double>"), F.col("v"))).first()
    assert list(e) == [0.0, 0.0, 0.0]


def test_space_class_is_pythons(spark):
    chars = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    got = col(spark, tx.strip("t"), [c + "x" + c for c in chars])
    assert got == ["x"] * len(chars)
    assert re.match(r"\s", " ")
