import random
import re

import numpy as np
import pytest

from lodestrata.llm import truncation as T

DOC = "doc_id bigint, source string, text string, state string"

WHOLE = [
    "One sentence.", "Was it?", "完成了。", 'He said "yes."', "int f(void)\n{\n    return 1;\n}\n", "#endif /* A_H */", "/* end of a.c */", "```c\nint a\n```", "| a | b |\n|---|---|\n| x | 1 |", "x\n\nLe mask disparaît.", "// Frees it.",
    '#include "a.h"',
]
CUT = [
    "The block is fr�", "It works. The next one is", "int f(void)\n{\n    return", "/* Once the", "static uint8_t rol", "size_t *x(int a, co", "```c\nint a;", "| a | b |\n|---|---|\n| x | 1", "| a | b |\n|---|---|\n| x |", "x. y...", "One. Two [truncated]", "Because of this,",
    "    memcpy(a, b", "/// Each list keeps 9", "  --> src/a.rs:3:4", "其中 3 个。我们",
]


@pytest.mark.parametrize("text", WHOLE)
def test_whole(text):
    assert T.ending(text)[0] == "whole"


@pytest.mark.parametrize("text", CUT)
def test_cut(text):
    assert T.ending(text)[0] == "cut"


@pytest.mark.parametrize("text", ["user: thanks, works now", "- region count: 23", "The old code us", "exit code 0", "user: and so on...", "See https://a.example/b_c"])
def test_open(text):
    assert T.ending("First line.\n" + text)[0] == "open"


@pytest.mark.parametrize("text", ["", " ", "\n　", "\ufeff", "..."])
def test_blank(text):
    assert T.ending(text)[0] == "blank"


def test_head_keys():
    a = [f"w{i}" for i in range(200)]
    other = [f"v{i}" for i in range(200)]
    keys = T.head_keys(*T.shingle_codes([a, a[:60], other, ["x"], a[30:]]))
    # Beginnings of 1, 2, 4, 16 and 64 shingles, and the whole; those of equal beginnings are equal.
    assert [len(k) for k in keys] == [6, 5, 6, 2, 6]
    assert all((x == y).all() for x, y in zip(keys[0][:4], keys[1][:4]))
    assert not any(np.isin(x, y).any() for x, y in zip(keys[0], keys[2]))
    assert np.isin(keys[0][-1], keys[4][-1]).any() and not np.isin(keys[0][4], keys[4][4]).any()
    assert [len(x) for x in keys[0]] == [1, 1, T.BANDS, T.BANDS, T.BANDS, T.BANDS]
    assert T.head_keys(*T.shingle_codes([])) == []


LONG = " ".join(f"The {w} {i} holds {i * 7} of them." for i, w in enumerate(["list", "queue", "table", "arena"] * 20)) + "\nA line\nmore of it"


@pytest.mark.parametrize(
    "short,want",
    [
        (LONG[:500], "cut"), (LONG[:501], "cut"), (LONG[:502], "cut"), (LONG[:800] + " [truncated]", "cut"), (LONG[: LONG.index("\nmore")], "whole"), (LONG, "same"), ("queue " + LONG[3:700], "cut"),
        (LONG[:300] + " and something else that goes on for a while", None), (LONG[:100] + " other", None), ("a b c", None), (LONG[:90].replace("holds", "kept") + " " + LONG[90:900], "cut"),
    ],
)
def test_alignment(short, want):
    assert T.alignment(short, LONG) == want


def test_repeated_end_is_placed_by_the_offset():
    head = " ".join(f"w{i}" for i in range(80))
    line = "the same five words again here"
    long = f"{head} {line} and on it goes {' '.join(f'x{i}' for i in range(60))}\n{line}\n"
    assert T.alignment(f"{head} {line}", long) == "cut"


def test_open_forms():
    rows = [("whole", "stop", 900, 40), ("cut", "broken off", 50, 500), ("cut", "indented", 45, 480), ("cut", "connector", 300, 60), ("whole", "statement", 5, 400), ("open", "phrase", 100, 100)]
    assert T.open_forms(rows) == {"broken off", "indented", "statement"} and T.open_forms([(s, f, n * 10, m * 10) for s, f, n, m in rows]) == {"broken off", "indented", "statement"}
    assert T.open_forms([]) == set()


def corpus():
    r = random.Random(1)
    nouns, verbs = ["list", "queue", "table", "buffer", "arena", "region"], ["holds", "frees", "scans", "merges", "copies"]

    def sentence():
        return f"The {r.choice(nouns)} {r.choice(verbs)} the {r.choice(nouns)} number {r.randint(1, 99)} before the {r.choice(nouns)} is used."

    ends = ["thanks, works now", "same here", "ok closing this", "will do"]
    docs, cut = [], set()
    for i in range(240):
        body = "\n".join(" ".join(sentence() for _ in range(3)) + f"\n- {r.choice(nouns)} count: {r.randint(1, 99)}" for _ in range(6))
        kind = i % 6
        if kind == 0:
            text = body + "\nuser: " + r.choice(ends)
        elif kind == 1:
            text = body + "\nThe end of it."
        elif kind == 2:
            text = body + f"\n- {r.choice(nouns)} count: {r.randint(1, 99)}"
        elif kind == 3:
            text = body + "\nuser: The " + r.choice(nouns) + " " + r.choice(verbs) + " the"
            cut.add(i)
        elif kind == 4:
            text = body + "\n- " + r.choice(nouns) + " cou"
            cut.add(i)
        else:
            text = body + "\n" + sentence() + " The " + r.choice(nouns)[:3]
            cut.add(i)
        docs.append((i, "src", text, None))
    return docs, cut


def test_documents(spark):
    docs, cut = corpus()
    full = docs[1][2] + " The table then merges all of it."
    docs += [(900, "b", full, None), (901, "b", full[: len(docs[1][2]) + 14], None), (902, "b", None, None), (903, "b", " ", None), (904, None, docs[3][2], None), (905, "b", "", None), (None, "b", "It is", None), (3, "src", docs[3][2], None)]
    cut |= {901, 904}
    df = spark.createDataFrame(docs, DOC)
    res = T.truncated_documents(df).collect()
    got = {x.doc_id: x.by for x in res}
    assert len(res) == len(got)
    assert set(got) == cut
    assert got[901] == "copy" and got[3] == "words" and got[5] == "form"
    rep = {x.source: (x.documents, x.cut) for x in T.truncation_report(df, T.truncated_documents(df)).collect()}
    assert rep["src"] == (240, 120) and rep[None] == (1, 1) and rep["b"] == (2, 1)


def test_empty(spark):
    none = spark.createDataFrame([], DOC)
    assert T.truncated_documents(none).collect() == []
    assert T.truncation_report(none, T.truncated_documents(none)).collect() == []


def test_every_longer_copy_of_a_bucket(spark):
    docs, cut = corpus()
    body = docs[1][2]
    short, full = body + "\n- table count: 42", body + "\n- table count: 42 in each of the runs."
    # Longer near-copies that differ at the cut, and copies with appendices, which are less than 0.8 alike.
    docs += [(910 + i, "b", body + f"\nOther remarks of reader number {i} stand here, and they are much longer than the end of the full copy.", None) for i in range(4)]
    docs += [(930 + i, "b", full + " " + " ".join(f"appendix{i}x{k}" for k in range(150)) + ".", None) for i in range(20)]
    docs += [(900, "b", full, None), (901, "b", short, None), (902, "b", short, None)]
    got = {x.doc_id: x.by for x in T.truncated_documents(spark.createDataFrame(docs, DOC)).collect()}
    assert set(got) == cut | {901, 902}
    assert got[901] == got[902] == "copy"


def test_cut_within_the_last_word(spark):
    docs, cut = corpus()
    body = docs[1][2]
    docs += [(900, "b", body + "\n- region count: 2345", None), (901, "b", body + "\n- region count: 23", None), (902, "b", body + "\n- region count: 23 [truncated]", None)]
    got = {x.doc_id: x.by for x in T.truncated_documents(spark.createDataFrame(docs, DOC)).collect()}
    assert set(got) == cut | {901, 902}
    assert got[901] == got[902] == "copy"


def test_copies_at_any_length(spark):
    """Cuts of texts whose full copy, with some words changed, is there: nearly all are shown by it, however much is lost."""
    docs, _ = corpus()
    r = random.Random(5)
    nouns = [f"n{i}" for i in range(400)]
    planted, shares = {}, [0.3, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.9, 0.95]
    for i in range(90):
        words = [r.choice(nouns) for _ in range(150)]
        copy = list(words)
        for k in range(0, 150, 75):
            copy[k + r.randrange(60)] = "other"
        text = " ".join(words)
        at = int(len(text) * shares[i % 9])
        while text[at - 1] == " " or text[at] == " ":
            at += 1
        docs += [(2000 + i, "x", " ".join(copy) + ".", None), (3000 + i, "x", text[:at], None)]
        planted[3000 + i] = shares[i % 9]
    got = {x.doc_id: x.by for x in T.truncated_documents(spark.createDataFrame(docs, DOC)).collect()}
    by_copy = [i for i in planted if got.get(i) == "copy"]
    assert len(by_copy) >= 0.9 * len(planted)
    assert not any(2000 <= i < 3000 for i in got)


def test_one_copy_for_many(spark):
    """A text that a third of all documents begin like: each is held against it, and the last ones against the rest of the bucket."""
    docs, _ = corpus()
    head = " ".join(f"h{i}" for i in range(40))
    docs += [(5000, "x", head + " " + " ".join(f"z{i}" for i in range(300)) + ".", None), (5001, "x", head + " one two three four five six seven eightfold.", None)]
    docs += [(5002, "x", head + " one two three four five six seven eight", None), (5003, "x", head + " one two three four five six seven eight" + " [truncated]", None)]
    docs += [(6000 + i, "x", " ".join(f"h{k}" for k in range(20 + i % 18)) + " h" + str(20 + i % 18)[:1], None) for i in range(120)]
    got = {x.doc_id: x.by for x in T.truncated_documents(spark.createDataFrame(docs, DOC)).collect()}
    assert got[5002] == got[5003] == "copy"
    assert all(got[6000 + i] == "copy" for i in range(120))


@pytest.mark.parametrize("d", [1, 2, 4, 5, 6, 10, 11, 99, 100, 333])
def test_rarest(d):
    """However the texts differ: what has 0.8 of all shingles has as many of the rarest as is asked for, and no more need be."""
    codes = np.arange(d, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    slots = np.zeros(1 << T.SLOT_BITS, dtype=np.uint16)
    slots[T._slot(codes[: d // 2])] = 9
    keys, least = T.rarest(np.concatenate([codes, codes[:3]]), slots)
    missing = max(m for m in range(d) if d - m >= T.SIMILARITY * d)
    assert len(set(keys.tolist())) == len(keys) == missing + least and least >= 1
    assert set(codes[d // 2 :].tolist()) <= set(keys.tolist()) or set(keys.tolist()) <= set(codes[d // 2 :].tolist())


def test_every_pair_at_the_threshold(spark, monkeypatch):
    """Copies changed all over, the last words included, so that few bands and not the last shingle are shared: the texts shown by a copy are those that all pairs show."""
    docs, _ = corpus()
    r = random.Random(7)
    near = []
    for i in range(80):
        words = [f"n{r.randrange(3000)}" for _ in range(130)]
        copy = list(words)
        for k in (2, *r.sample(range(8, 90, 6), 2), 97):
            copy[k] = f"o{i}x{k}"
        near += [(2000 + i, "x", " ".join(copy) + ".", None), (3000 + i, "x", " ".join(words[:100]), None), (4000 + i, "x", " ".join(words[:60]) + "\n" + " ".join(words[60:100]) + "\n" + "And so on.", None)]
    every = docs + near
    texts = {i: t for i, _, t, _ in every}
    sizes = {i: len(T.bare_of(t, T.ending(t)[0])) for i, t in texts.items()}
    want = {i for i, t in texts.items() if T.ending(t)[0] != "whole" and any(sizes[j] > sizes[i] and T.alignment(t, x) == "cut" for j, x in texts.items())}
    assert {3000 + i for i in range(80)} <= want
    for most in (T.MOST_KEYS, 0):
        monkeypatch.setattr(T, "MOST_KEYS", most)
        got = {x.doc_id for x in T.truncated_documents(spark.createDataFrame(every, DOC)).collect() if x.by == "copy"}
        assert got == want


def test_word_codes(monkeypatch):
    """The words are those of the pattern, equal codes are equal words, wherever they stand."""
    texts = ["", "int f_1(void);", "其中 3 个。我们ab中c", "Größe d’été\n\u4dc0x\u4dc1", "a" * 50, "x ", " y", "\U0001d400b ٣", "ab ba aab aba baa", "word " * 40 + "end"]
    pattern = re.compile(r"[㐀-鿿]|[^\W㐀-鿿]+")
    words = [pattern.findall(t) for t in texts]
    for part in (T._PART, 1, 8):
        monkeypatch.setattr(T, "_PART", part)
        codes = T.word_codes(texts)
        assert [len(c) for c in codes] == [len(w) for w in words]
        assert all((c == T.string_codes(w)).all() for c, w in zip(codes, words))
        met = {w: c for ws, cs in zip(words, codes) for w, c in zip(ws, cs.tolist())}
        assert len(set(met.values())) == len(met)
    assert T.word_codes([]) == [] and len(T.string_codes([])) == 0


def test_marks_leave_out_no_key_asked_for():
    r = np.random.default_rng(3)
    keys, sizes = r.integers(0, 2**64, 5000, dtype=np.uint64), r.integers(1, 90_000, 5000)
    marks = T._Marks(5000, [(keys[:2000], sizes[:2000]), (keys[2000:], sizes[2000:])])
    assert len(marks.met(keys, sizes + 1)) == 5000
    # What is no longer than those that ask is left out, nearly always, and so is what nothing asks for.
    short = sizes < 0xFFFE
    assert len(marks.met(keys[short], sizes[short])) < 0.1 * short.sum()
    other = r.integers(0, 2**64, 50_000, dtype=np.uint64)
    assert len(marks.met(other, np.full(50_000, 90_000))) < 0.03 * 50_000
    assert len(T._Marks(0, []).met(keys, sizes)) == 0


def test_only_what_is_asked_for_is_shuffled(spark):
    """Rows written to shuffles, as Spark counts them."""
    docs, cut = corpus()
    docs += [(1000 + i, "x", docs[1][2] + f"\nNumber {i} of the many: " + " ".join(f"m{i}x{k}" for k in range(80)) + ".", None) for i in range(1200)]
    sc = spark.sparkContext

    def stages() -> dict[int, int]:
        found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return {x.stageId(): x.shuffleWriteRecords() for x in map(found.apply, range(found.size()))}

    before = max(stages(), default=-1)
    got = {x.doc_id for x in T.truncated_documents(spark.createDataFrame(docs, DOC)).collect()}
    assert got == cut
    written = sum(n for i, n in stages().items() if i > before)
    assert 0 < written < 50_000
