import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import splitting as S


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab ;}{.,\n\t。é😀(", max_size=600), st.integers(2, 60), st.data())
def test_spans(text, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    spans = S.piece_spans(text, limit, overlap)
    if not text:
        assert spans == []
        return
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(0 < e - s <= limit for s, e in spans)
    assert all(b[0] == a[1] - overlap and b[1] > a[1] for a, b in zip(spans, spans[1:]))
    # Wherever a blank lies within reach, the piece doesn't end within a word.
    for s, e in spans[:-1]:
        if any(c.isspace() for c in text[s + overlap : s + limit - 1]):
            assert not (text[e - 1].isalnum() and text[e].isalnum())


def test_kinds_of_boundaries():
    para = "x" * 60 + "\n\n" + "y" * 30 + "\n" + "z" * 60
    assert S.piece_spans(para, 100, 10)[0] == (0, 62)
    assert S.piece_spans("a; " * 60, 100, 10)[0] == (0, 99)
    assert S.piece_spans("x" * 250, 100, 10) == [(0, 100), (90, 190), (180, 250)]
    assert S.piece_spans("x" * 100, 100, 10) == [(0, 100)]
    with pytest.raises(ValueError):
        S.piece_spans("x", 10, 10)


def test_split_oversized(spark):
    long = "word " * 500
    df = spark.createDataFrame([(1, long, "c"), (1, long, "c"), (2, "short", "c"), (3, None, "c"), (4, "", "c"), (5, "é" * 2001, "c"), (6, "x" * 2000, "c"), (None, long, "c")], "id bigint, t string, piece string")
    got = {}
    for x in S.split_oversized(df, "id", "t").collect():
        got.setdefault(x.id, []).append((x.piece_no, x.start, x.end, x.piece))
    assert set(got) == {1, 5, None}
    for i, text in ((1, long), (5, "é" * 2001), (None, long)):
        ps = sorted(got[i])
        assert [p[0] for p in ps] == list(range(1, len(ps) + 1)) and all(p[3] == text[p[1] : p[2]] for p in ps)
        joined = ps[0][3] + "".join(p[3][200:] for p in ps[1:])
        assert joined == text and all(b[3].startswith(a[3][-200:]) for a, b in zip(ps, ps[1:]))
    small = S.split_oversized(df, "id", "t", keep_small=True).where("id in (2, 4)").collect()
    assert [(x.id, x.piece) for x in small] == [(2, "short")]
    assert S.split_oversized(df.where("false"), "id", "t").collect() == []


def test_very_long(spark):
    text = "".join(f"line {i};\n" for i in range(60_000))
    spans = S.piece_spans(text)
    assert all(text[e - 1] == "\n" for _, e in spans) and spans[-1][1] == len(text)
