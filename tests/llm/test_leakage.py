import random
import re

import pytest

from lodestrata.llm import leakage as L

ITEM = " ".join(f"w{i}" for i in range(40))
DOC = "doc_id bigint, text string, item_id string, words string"
IT = "item_id bigint, text string, doc_id string"


def words(a, n):
    return [f"w{i}" for i in range(a, a + n)]


@pytest.mark.parametrize(
    "text",
    [
        " ".join(words(3, 12)), " ".join(words(3, 12)).upper(), "// " + "\n// ".join(" ".join(words(i, 4)) for i in (3, 7, 11)), "> " + "\n> ".join(" ".join(words(i, 3)) for i in range(3, 15, 3)),
        "  7 | " + " ".join(words(3, 6)) + "\n  8 | " + " ".join(words(9, 6)), '{"p": "' + "\\n".join(words(3, 12)) + '"}', "<pre>" + "&lt;".join(words(3, 12)) + "</pre>", "**" + "** _".join(words(3, 12)),
        " ".join(w[0] + "\u00ad" + w[1:] if i % 2 else w[0] + "\u200b" + w[1:] for i, w in enumerate(words(3, 12))), "，".join(words(3, 12)), " ".join(words(3, 12)).translate({i: i + 0xFEE0 for i in range(0x21, 0x7F)}), "; ".join(words(3, 12)) + " <b>" ,
    ],
)
def test_forms(text):
    assert " ".join(words(3, 12)) in " ".join(L.normal_words("before\n" + text + " after"))


def test_parted_words():
    assert L.normal_words("sne-\nrgtrask a -\nb x - y") == ["snergtrask", "a", "b", "x", "y"]
    assert L.normal_words("a << 3 | b\n3 | c\n") == ["a", "3", "b", "3", "c"]
    assert L.normal_words("&mut Vec<u8> &notify") == ["mut", "vec", "u8", "notify"]
    assert L.normal_words(None) == L.normal_words("") == L.normal_words("___ --") == []


def brute(docs, items, n=12):
    out = {}
    for d, t in docs:
        for i, s in items:
            a, b = L.normal_words(t), L.normal_words(s)
            if d is None or i is None:
                continue
            grams = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)}
            if any(tuple(a[k : k + n]) in grams for k in range(len(a) - n + 1)):
                out[d, i] = 1
    return set(out)


@pytest.mark.parametrize("block", [60, 10_000])
def test_random(spark, block):
    r = random.Random(2)
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([0, 5, 11, 12, 13, 40])))) for i in range(12)]
    items += [(20, None), (21, ""), (22, items[5][1]), (23, "a b c " + " ".join(items[3][1].split()[:20]))]
    docs = []
    for d in range(120):
        parts = []
        for _ in range(r.randint(0, 3)):
            src = r.choice(items)[1] or "x"
            ws = src.split()
            a = r.randint(0, len(ws))
            parts.append(" ".join(ws[a : a + r.choice([8, 11, 12, 13, 30])]))
            parts.append(" ".join(r.choice(["u", "v", *vocab]) for _ in range(r.randint(0, 4))))
        docs.append((d, " ".join(parts)))
    docs += [(500, None), (501, ""), (502, docs[3][1]), (None, items[9][1]), (503, "zz " * 20_000 + (items[9][1] or ""))]
    got = L.leaked_items(spark.createDataFrame([(*d, None, None) for d in [*docs, docs[7]]], DOC), spark.createDataFrame([(*i, None) for i in [*items, items[0]]], IT), block_words=block)
    pairs = [(x.doc_id, x.item_id) for x in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == brute(docs, items)


def test_longest_and_report(spark):
    docs = spark.createDataFrame([(1, " ".join(words(0, 13)) + " x " + " ".join(words(5, 20))), (2, " ".join(words(2, 12)))], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, ITEM)], "item_id bigint, text string")
    leaks = L.leaked_items(docs, items)
    assert sorted(map(tuple, leaks.collect())) == [(1, 7, 20), (2, 7, 12)]
    assert list(map(tuple, L.leak_report(leaks).collect())) == [(7, 2, 20)]
    assert L.leaked_items(docs.where("false"), items).collect() == [] and L.leaked_items(docs, items.where("false")).collect() == []
    with pytest.raises(ValueError):
        L.leaked_items(docs, items, passage=3)


def test_codes():
    import numpy as np

    a = np.arange(30)
    c = L.shingle_codes(a)
    assert len(c) == 26 and len(set(c.tolist())) == 26 and L.shingle_codes(a[7:12])[0] == c[7] and len(L.shingle_codes(a[:4])) == 0
    assert re.fullmatch(r"\w+", "x")
