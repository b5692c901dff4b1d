import pytest
from pyspark.sql import functions as F

from lodestrata.operators import memory as M


def talk(spark, *texts, role="user"):
    data = [("c", 0, "system", "system rules")] + [("c", i, role, t) for i, t in enumerate(texts, 1)]
    return M.normal_messages(spark.createDataFrame(data, "k string, i int, r string, t string"), "k", "i", "r", "t")


def texts(df):
    return [x.content for x in df.orderBy("conv", "ord").collect()]


def test_last_two(spark):
    assert texts(M.sliding_window(talk(spark, "m0", "m1", "m2"), 2)) == ["system rules", "m1", "m2"]
    with pytest.raises(ValueError):
        M.sliding_window(talk(spark), 0)


def test_system_first(spark):
    df = spark.createDataFrame([("c", 1, "user", "a"), ("c", 2, "system", "s"), ("c", 3, "user", "b"), ("c", 4, None, None)], "conv string, pos int, role string, content string")
    m = M.normal_messages(df, "conv", "pos", "role", "content")
    assert [(x.role, x.content) for x in M.sliding_window(m, 2).orderBy("ord").collect()] == [("system", "s"), ("user", "b"), ("assistant", "")]
    assert texts(M.keep_all(m)) == ["a", "s", "b", ""]


def test_budget(spark):
    one = lambda c: F.lit(1)
    assert texts(M.token_budget(talk(spark, "a", "b", "c"), 3, tokens=one)) == ["system rules", "b", "c"]
    assert texts(M.token_budget(talk(spark, "a", "b"), 1, tokens=one)) == ["system rules"]
    # A short message behind a long one doesn't jump the queue; the newest stays even if it is too long.
    assert texts(M.token_budget(talk(spark, "x", "y" * 400, "z"), 20)) == ["system rules", "z"]
    assert texts(M.token_budget(talk(spark, "x", "y" * 400), 20)) == ["system rules", "y" * 400]


def test_summary(spark):
    out = texts(M.checkpoint_summary(talk(spark, "m1", "m2", "m3", "m4", "m5"), 2, 2))
    assert out == ["system rules", "Summary of 3 messages: m1 / m2 / m3", "m4", "m5"]
    assert len(texts(M.checkpoint_summary(talk(spark, "m1", "m2", "m3"), 2, 2))) == 4
    assert len(texts(M.checkpoint_summary(talk(spark, *"abcdef"), 0, 2))) == 7
    with pytest.raises(ValueError):
        M.checkpoint_summary(talk(spark), -1, 1)
    d = spark.createDataFrame([(5, None), (5, 4), (6, 4), (1, 0)], "n int, last int")
    assert [r[0] for r in d.select(M.next_checkpoint(F.col("n"), F.col("last"), 2)).collect()] == [True, False, True, False]


def test_factory(spark):
    m = talk(spark, "a", "b", "c")
    assert texts(M.strategy("Sliding-Window", most=1)(m)) == ["system rules", "c"]
    assert texts(M.strategy({"name": "window", "most": 1})(m)) == ["system rules", "c"]
    assert texts(M.strategy(None)(m)) == ["system rules", "a", "b", "c"]
    assert texts(M.strategy(M.sliding_window, most=2)(m)) == ["system rules", "b", "c"]
    with pytest.raises(ValueError):
        M.strategy("nonsense")


def test_rendering(spark, rows):
    assert rows(M.rendered_history(talk(spark, "a", "b", "c"), 2)) == [("c", "1. user: b\n2. user: c")]
    t = spark.createDataFrame([("c", 1, "q1", "a1"), ("c", 2, "q2", "a2")], "conv string, pos int, question string, answer string")
    assert rows(M.prompt_pairs(t, 1)) == [("c", 1, "user", "q2"), ("c", 2, "assistant", "a2")]
    got = M.pre_model_messages(talk(spark, "a", "b"), "window", most=1).first().llm_input_messages
    assert [tuple(x) for x in got] == [("system", "system rules"), ("user", "b")]


def test_empty(spark):
    none = talk(spark).where("false")
    for fn in (M.keep_all, M.sliding_window, lambda d: M.token_budget(d, 5), lambda d: M.checkpoint_summary(d, 1, 1)):
        assert fn(none).collect() == []
