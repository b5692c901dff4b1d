import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import encoding as E

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def own():
    return E._encoder(E.default_vocabulary(), E.PATTERN)


def ids(own, texts):
    offsets, flat = own[0].encode(texts, own[1])
    return [flat[a:b].tolist() for a, b in zip(offsets, offsets[1:])]


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(max_size=60) | st.text(alphabet="ab_ \n\t'é漢ing0129tion;->{}s", max_size=80), max_size=8))
def test_same_as_library(library, own, texts):
    assert ids(own, texts) == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_odd_texts(library, own):
    texts = ["", "<|endoftext|>", " " * 3000, "a" * 4000, "é" * 900, "it's we'll I'd 'tis", "\r\n\x0b\x0c\x1c\x85\xa0 x", "👩‍💻🦀", "\x00\x01", "x = 0x1F;\n\n\n    y"]
    assert ids(own, texts) == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert ids(own, [None]) == [[]]


def test_bound_of_words(library, monkeypatch):
    monkeypatch.setattr(E, "MOST_WORDS", 3)
    e = E.TrieEncoder.from_file(E.default_vocabulary())
    split = E._encoder(E.default_vocabulary(), E.PATTERN)[1]
    for text in ("one two three four five", "six seven one two", "one"):
        assert ids((e, split), [text]) == [library.encode(text, add_special_tokens=False).ids]


def test_corpus(spark, library):
    data = [(1, "hello world"), (2, ""), (3, None), (4, "x" * 70_000), (1, "hello world"), (None, "a")]
    df = spark.createDataFrame([(*d, [1]) for d in data], "doc_id bigint, text string, ids array<int>")
    got = sorted(((x.doc_id, x.ids) for x in E.encode_corpus(df).collect()), key=lambda t: (t[0] is None, t[0], t[1]))
    want = [(i, [] if not t else library.encode(t, add_special_tokens=False).ids) for i, t in data]
    assert got == sorted(want, key=lambda t: (t[0] is None, t[0], t[1]))
    assert E.encode_corpus(df.where("false")).collect() == []
    assert dict(E.encode_corpus(df).dtypes) == {"doc_id": "bigint", "ids": "array<int>"}
