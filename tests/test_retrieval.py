import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.operators import retrieval as R

VEC = "vec_id bigint, embedding array<float>, label int"


def vectors(spark, n=80, d=6):
    x = np.random.default_rng(4).normal(size=(n, d)).astype(np.float32)
    x[7] = x[3]
    data = [(i, x[i].tolist(), i % 3) for i in range(n)]
    return x, spark.createDataFrame([*data, (900, None, 1), (901, [], 1), (902, [1.0], 1)], VEC)


def test_nearest(spark):
    x, v = vectors(spark)
    q = v.where("vec_id < 7").select(F.col("vec_id").alias("query_id"), "embedding")
    for block in (2, 100):
        got = {}
        for r in R.nearest(v, q, 4, block).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        d = ((x[:7, None, :].astype(float) - x[None, :, :]) ** 2).sum(2)
        assert got == {i: sorted(range(80), key=lambda j: (d[i, j], j))[:4] for i in range(7)}


def test_filter_after_cut(spark):
    _, v = vectors(spark)
    q = v.where("vec_id = 1").select(F.col("vec_id").alias("query_id"), "embedding")
    late, early = R.search(v, q, 5, {"label": "2"}).collect(), R.search(v, q, 5, {"label": "2"}, prefilter=True).collect()
    assert len(early) == 5 and len(late) <= 5 and {x.vec_id for x in late} <= {x.vec_id for x in early}
    assert R.nearest(v, q.where("false"), 3).collect() == [] and R.nearest(v.where("false"), q, 3).collect() == []


def test_rerank(spark, rows):
    hits = spark.createDataFrame([(1, v, r) for r, v in enumerate("abcd", 1)], "query_id int, vec_id string, rank int")
    s = spark.createDataFrame([(1, "c", 0.9), (1, "c", 0.1), (1, "zz", 5.0), (1, "d", 0.95)], "query_id int, vec_id string, score double")
    assert [x[1] for x in sorted(rows(R.rerank(hits, s, 3)), key=lambda t: t[3])] == ["d", "c", "a"]


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab# .\n1;。é", max_size=400), st.integers(20, 60), st.integers(0, 30), st.integers(0, 19))
def test_split_covers(text, most, window, overlap):
    spans = R.split_spans(text, most, window, overlap)
    assert all(0 < e - s <= most + window for s, e, _ in spans)
    at = 0
    for (s, e, _), nxt in zip(spans, [*spans[1:], None]):
        assert s <= at <= e
        at = max(at, e)
        assert nxt is None or nxt[0] > s
    assert not text or at == len(text)


def test_split_reasons():
    text = "x" * 95 + "\n# far\n" + "y" * 60 + "\n# near\n" + "z" * 200
    far, near = R.split_spans(text, 150, 80, 10)[0], R.split_spans(text, 150, 80, 10, nearest_heading=True)[0]
    assert text[far[1] :].startswith("# far") and text[near[1] :].startswith("# near") and far[2] == near[2] == "heading"
    assert R.split_spans("a" * 50, 20, 5, 2)[0] == (0, 20, "cut")
    assert R.split_spans("", 20) == []


def test_split_texts(spark, rows):
    df = spark.createDataFrame([(1, "a\nb\n" * 300), (2, ""), (3, None), (4, " \n ")], "id int, t string")
    got = R.split_texts(df, "id", "t", 200, 50, 20).orderBy("id", "chunk").collect()
    assert {x.id for x in got} == {1} and got[0].start_line == 1 and [x.chunk for x in got] == list(range(len(got)))


def test_headings(spark):
    df = spark.createDataFrame([("intro\n# A\nx\n\n  ## B\ny\n",), ("no",), ("",)], "t string")
    assert [r[0] for r in df.select(R.heading_paragraphs(F.col("t"))).collect()] == [["# A\nx", "## B\ny"], [], []]


def test_batches(spark, rows):
    df = spark.createDataFrame([(i,) for i in (5, 200_001, 1, 100_000, 7)], "id bigint")
    assert rows(R.embedding_batches(df, "id", 2), "id", "batch") == [(1, 0), (100_000, 1), (200_001, 2), (5, 0), (7, 1)]
