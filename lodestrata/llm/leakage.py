"""Evaluation texts leaking into training text.

Method: prefix-filtered set join on word shingles. Texts are brought to a common form (case, punctuation, line layout,
encoding and markup don't count) and cut into shingles of five words. A passage of 12 words holds 8 shingles, all of which
a document must share, so one of them is prefix enough: the rarest of the window, by its count in the whole corpus.
Runs of fewer than 8 shared shingles in a row fall to the positional bound before anything is joined, texts of
fewer than 12 words to the length bound. Candidates (document, item, offset) are verified word by word over the item.

Scale: the evaluation set is the stated query set. It is taken in blocks of a bounded number of words; a block's
shingles go to every task, and one scan of the corpus per block gives both the counts of all shared shingles, summed
up within each partition, and the runs with their codes. Only those runs, a sliver of the corpus, are kept, in the shared checkpoint folder.
What is joined by shingle is narrow (run, place, code); the words of a run come back once for each (item, offset) that is left.
Nothing is paired within the corpus.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.session import checkpointed, ship

PASSAGE, SHINGLE = 12, 5
BLOCK_WORDS = 500_000

# Names of markup elements.
_ELEMENTS = "pre|code|b|i|em|strong|span|div|p|br|a|tt|u|li|ul|ol|td|tr|th|table|tbody|h[1-6]|font|kbd|samp|sub|sup|small|blockquote|mark|s|del|ins|q|cite|var|hr|body|html|section|article|details|summary"
_MARKUP = re.compile(rf"</?(?:{_ELEMENTS})\b[^<>]*/?>", re.I)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_ESCAPE = re.compile(r"""\\(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|([nrtbfv"'/\\]))""")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNSEEN = re.compile("[\u00ad\u034f\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufe00-\ufe0f\ufeff]|(?<=\\w)\ufffd(?=\\w)")
_HYPHEN = re.compile(r"(?<=[^\W\d_])[-\u2010\u2011][ \t]*\r?\n[\s>*#/|;%!:+\-]*(?=[^\W\d_])")
_NUMBERED = re.compile(r"^[^\w\n]*(\d{1,8})(?:[^\w\n]*[|:\])>.\u2502\t]|(?=\s))", re.M)
_WORD = re.compile(r"[^\W_]+")


def _unescaped(m: re.Match) -> str:
    if m.group(1) or m.group(2):
        return chr(int(m.group(1) or m.group(2), 16))
    c = m.group(3)
    return c if c in "\"'/\\" else "\n" if c in "nr" else " "


def _entity(m: re.Match) -> str:
    return html.unescape(m.group())


def _percent(m: re.Match) -> str:
    return bytes.fromhex(m.group().replace("%", "")).decode("utf-8", "replace")


def _without_line_numbers(text: str) -> str:
    """Numbers at the starts of lines go where the line before or after has the neighbouring number."""
    marks = list(_NUMBERED.finditer(text))
    if len(marks) < 2:
        return text
    numbers, out, at = [int(m.group(1)) for m in marks], [], 0
    for k, m in enumerate(marks):
        after = k > 0 and numbers[k] == numbers[k - 1] + 1 and text.count("\n", marks[k - 1].end(), m.start()) <= 2
        before = k + 1 < len(marks) and numbers[k] + 1 == numbers[k + 1] and text.count("\n", m.end(), marks[k + 1].start()) <= 2
        if after or before:
            out.append(text[at : m.start()])
            at = m.end()
    return "".join(out) + text[at:]


def normal_words(text: str | None) -> list[str]:
    """The words of a text in common form: runs of letters or digits, without regard to case, punctuation, layout of lines
    (quote, comment and list signs, line numbers, words parted at line ends), encoding (escapes, entities, invisible
    signs, compatibility forms) and markup."""
    if not text:
        return []
    plain = text.isascii()
    if not plain:
        text = _UNSEEN.sub("", text)
    if "<" in text:
        text = _MARKUP.sub(" ", text)
    if "&" in text:
        text = _ENTITY.sub(_entity, _ENTITY.sub(_entity, text))
    if "\\" in text:
        text = _ESCAPE.sub(_unescaped, text)
    if text.count("%20") > 2:
        text = _PERCENT.sub(_percent, text)
    if not (plain and text.isascii()):
        text = unicodedata.normalize("NFKC", _UNSEEN.sub("", text))
    if "-\n" in text or "\u2010" in text or "- " in text or "-\r" in text or "\u2011" in text or "-\t" in text:
        text = _HYPHEN.sub("", text)
    return _WORD.findall(_without_line_numbers(text).casefold())


_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


def shingle_codes(ids: np.ndarray) -> np.ndarray:
    """A 64-bit code of each five ids in a row, for ids below 2**31."""
    n = len(ids) - SHINGLE + 1
    if n < 1:
        return np.zeros(0, dtype=np.int64)
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    code = np.zeros(n, dtype=np.uint64)
    for k in range(SHINGLE):
        code = (code ^ x[k : k + n]) * _MULTIPLIERS[k]
        code ^= code >> np.uint64(29)
    return code.view(np.int64)


def _shared_runs(ids: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a row of word ids (-1 for foreign words): the shared shingles' codes, and starts and lengths (in shingles) of the runs."""
    own = shingle_codes(ids)
    if not len(own):
        return own, own, own
    bad = np.concatenate([[0], np.cumsum(ids < 0)])
    inside = np.flatnonzero(bad[SHINGLE:] == bad[:-SHINGLE])
    if not len(inside):
        return own[:0], inside, inside
    c = own[inside]
    at = np.searchsorted(codes, c)
    at[at == len(codes)] = 0
    hits = inside[codes[at] == c]
    if not len(hits):
        return own[:0], hits, hits
    cuts = np.flatnonzero(np.diff(hits) != 1) + 1
    starts = hits[np.concatenate([[0], cuts])]
    lengths = np.diff(np.concatenate([[0], cuts, [len(hits)]]))
    return own[hits], starts, lengths


def _scan_block(docs: DataFrame, vocabulary: dict[str, int], codes: np.ndarray, passage: int) -> DataFrame:
    """Rows of (code, seen) with the counts of shared shingles per partition, and of (doc_id, run_id, run, codes) with the ids of a run of words and its shingles."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, codes))
    least = passage - SHINGLE + 1

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab, known = shared.value
        get, seen = vocab.get, Counter()
        next_id = TaskContext.get().partitionId() << 40
        for b in batches:
            words = [normal_words(t) for t in b["text"]]
            ids = np.fromiter((get(w, -1) for ws in words for w in [*ws, ""]), dtype=np.int64)
            ends = np.cumsum([len(ws) + 1 for ws in words]) if words else np.zeros(0, dtype=np.int64)
            hit_codes, starts, lengths = _shared_runs(ids, known)
            for c, n in zip(*np.unique(hit_codes, return_counts=True)):
                seen[int(c)] += int(n)
            long = np.flatnonzero(lengths >= least)
            doc = np.searchsorted(ends, starts[long], side="right")
            at = np.cumsum(lengths) - lengths
            runs = [ids[s : s + n + SHINGLE - 1].tolist() for s, n in zip(starts[long], lengths[long])]
            own = [hit_codes[a : a + n].tolist() for a, n in zip(at[long], lengths[long])]
            run_ids = np.arange(next_id, next_id + len(runs))
            next_id += len(runs)
            yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy()[doc] if len(runs) else pd.Series([], dtype="int64"), "run_id": run_ids, "run": pd.Series(runs, dtype=object), "codes": pd.Series(own, dtype=object), "code": None, "seen": None})
        if seen:
            yield pd.DataFrame({"doc_id": None, "run_id": None, "run": None, "codes": None, "code": list(seen), "seen": list(seen.values())})

    return docs.mapInPandas(scan, "doc_id bigint, run_id bigint, run array<int>, codes array<bigint>, code bigint, seen bigint")


def _verified(candidates: DataFrame, passage: int) -> DataFrame:
    """(doc_id, item_id, words): the longest stretch of equal words along each candidate offset, where it reaches the passage's length."""

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, item, run, words, shift in zip(b["doc_id"], b["item_id"], b["run"], b["words"], b["shift"]):
                run, words = np.asarray(run), np.asarray(words)
                lo, hi = max(0, shift), min(len(run), len(words) + shift)
                equal = np.concatenate([[0], run[lo:hi] == words[lo - shift : hi - shift], [0]]).astype(np.int8)
                edges = np.flatnonzero(np.diff(equal))
                longest = int((edges[1::2] - edges[::2]).max()) if len(edges) else 0
                if longest >= passage:
                    rows.append((doc, item, longest))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "words"])

    return candidates.mapInPandas(verify, "doc_id bigint, item_id bigint, words int")


def leaked_items(documents: DataFrame, items: DataFrame, passage: int = PASSAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, words): the documents that hold at least ``passage`` words of an item's text in a row, and the longest such stretch.

    Copies of a document count by themselves, a passage common to several items counts for each. Null, empty and
    short texts on either side leak nothing. Rows with equal (doc_id, item_id) come out once. Rows without id can't be
    reported and are left out. Empty tables give no rows; other columns are ignored.
    """
    if passage < SHINGLE:
        raise ValueError(f"passages have at least {SHINGLE} words")
    spark = documents.sparkSession
    ship(spark)
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & (F.length("text") >= 2 * passage - 1))
    its = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where(F.col("item_id").isNotNull() & (F.length("text") >= 2 * passage - 1))
    size = its.agg(F.sum(F.length("text")), F.max(F.length("text"))).first()
    blocks = int((size[0] or 0) // 2 // block_words) + 1
    out = None
    for k in range(blocks):
        rows = its.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()
        vocabulary: dict[str, int] = {}
        texts = [(r["item_id"], [vocabulary.setdefault(w, len(vocabulary)) for w in normal_words(r["text"])]) for r in rows]
        texts = [(i, ws) for i, ws in texts if len(ws) >= passage]
        shingles = [(i, p, int(c)) for i, ws in texts for p, c in enumerate(shingle_codes(np.asarray(ws)))]
        codes = np.unique(np.asarray([c for _, _, c in shingles], dtype=np.int64))
        if not len(codes):
            continue
        scanned = checkpointed(_scan_block(docs, vocabulary, codes, passage))
        counts = scanned.where("code is not null").groupBy("code").agg(F.sum("seen").alias("seen"))
        runs = scanned.where("doc_id is not null")

        listed = spark.createDataFrame(pd.DataFrame(shingles, columns=["item_id", "pos", "code"]), "item_id bigint, pos int, code bigint")
        window = Window.partitionBy("item_id").orderBy("pos").rowsBetween(0, passage - SHINGLE)
        rare = listed.join(counts, "code", "left").withColumn("rarest", F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "code", "pos")).over(window))
        ends = F.max("pos").over(Window.partitionBy("item_id"))
        prefixes = rare.withColumn("last", ends).where(F.col("pos") <= F.col("last") - (passage - SHINGLE)).select("item_id", F.col("rarest.pos").alias("pos"), F.col("rarest.code").alias("code")).distinct()

        probes = runs.select("run_id", F.posexplode("codes").alias("at", "code"))
        met = probes.join(prefixes, "code").select("run_id", "item_id", (F.col("at") - F.col("pos")).alias("shift")).distinct().join(runs.select("run_id", "doc_id", "run"), "run_id")
        words = spark.createDataFrame(texts, "item_id bigint, words array<int>")
        part = _verified(met.join(words, "item_id").select("doc_id", "item_id", "run", "words", "shift"), passage)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint, words int")
    return out.groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))


def leak_report(leaks: DataFrame) -> DataFrame:
    """(item_id, documents, longest): how often each item leaked."""
    return leaks.groupBy("item_id").agg(F.count("*").alias("documents"), F.max("words").alias("longest"))
