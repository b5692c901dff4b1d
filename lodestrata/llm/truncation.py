"""Texts cut off by field limits or in transfer.

Method: near-copies are found through min-hash banding, verified, and aligned; the copy whose alignment ends early, within
a word or sentence of the longer one, is flagged. Records without such a copy are scored by the terminality of their closing words.

Near-copies. A cut text may be a small part of its full copy, so its set of shingles need not be like the copy's; but both
begin alike. Min-hashes are therefore taken of the first 1, 2, 4, 16, 64, 256, ... shingles, and of all. A text asks with
the largest beginning that it fills and with its whole; every text answers with all of its beginnings. What a pair must share is
a band of one of these; it is verified by containment of the shorter in the longer (0.8 of its five-word shingles), and aligned by the place
of the last shingle in common.

Closing words. How a text ends is read in one pass: its form (a broken character, an open comment, half a statement, half a sentence
behind whole ones, a table row, a full stop, a closing brace, a phrase ...). Whether a form closes texts is counted in the corpus:
each text is also cut at one place drawn from its own hash, and a form is no close if texts end with it about as often as such cuts do. Phrases
without a full stop ("thanks, works now", "- region count: 23", "The old code us") are one form, which is told apart by words: how
often, over the whole corpus, a line closes after these words and how often it goes on.

Scale: one pass gives a narrow row per document (keys of bands, closing words), and counts of words and forms summed up within each
partition; both are kept once in the shared checkpoint folder. Exact copies are one class. Of each bucket and octave of length one longest
member is tried first: a map-side aggregate, so a bucket that holds a third of all texts costs one row per task. Bands are met by chance,
so texts that this doesn't show to be cut are then held against every other longer text that can have 0.8 of their shingles: of d shingles
d / 5 at most may be missing, so one that has enough of all has some of any d / 5 + 1. Each text asks with its rarest ones, by
a table of counts of bounded size, which decides about the cost but not about what is found. Keys of bands, shingles and contexts are only shuffled where something
asks for them, and those of texts where something shorter does: what is asked for is counted, and up to a bound told to every task as a table.

Words are taken apart in arrays of characters, many texts at once; lines that come again are counted once and weighed.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from lodestrata.operators.skew import heavy_keys
from lodestrata.session import checkpointed, ship

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 4, 3
#: Beginnings, in shingles, of which min-hashes are taken; of the first two there is but one key.
HEADS = [1, 2, *(4**k for k in range(1, 16))]
SALTS = 32
#: Ids up to this number, some 8 MB, are sent to every task rather than moving all texts.
MOST_SENT = 1_000_000
#: Keys asked for up to this number are told to every task as a table of bits, 8 or more for each, and one of sizes; with more, all keys are joined.
MOST_KEYS = 16_000_000
#: A table of counts of shingles: slots, and rows that it is passed on in. How many of the rarest shingles must be shared, if a text has as many.
SLOT_BITS, SLOT_ROWS, SHARED = 20, 64, 6
CLOSE_SHARE = 0.5
#: A share is taken as settled where it is this many standard errors away from one half.
SETTLED = 1.5
#: Shares of all words, or of all texts, below which a closing word is a rare one; at or above which a word is a frequent one.
RARE_WORD, RARE_END, FREQUENT = 1e-7, 3e-4, 6e-5
END_SHARE, END_BOUND, FINAL_SHARE = 0.003, 0.015, 0.02
#: The weight of what a form looks like against the counts, in texts.
PRIOR = 2

_TOKEN = re.compile(r"[㐀-鿿]|[^\W㐀-鿿]+|\+(?=\d)|[^\w\s]")
_STOP = re.compile(r"[.!?。！？｡؟।]+[\"'”’»）)\]`*_]*$")
_MARK = re.compile(r"(?:\.{3,}|…+|\[(?:\.{3}|…)\]|[\[(<{（【]\s*(?:\.{3}|…)?\s*(?:message |text |output |content )?(?:truncated|cut(?: off)?|clipped|snip(?:ped)?|more|continued|cont\.?|gekürzt|abgeschnitten|tronqué|suite|省略|截断|已截断|未完|未完待续)[^\])>}）】\n]{0,40}[\])>}）】])\s*$", re.I)
_END_SIGNS = " \t\r.!?;:,)]}>|\"'`*。！？；："
_FRONT_SIGNS = "([{<&\"'`*_"
_SIGNS = _END_SIGNS + _FRONT_SIGNS
_NO_PHRASE_FRONT = frozenset([" ", "\t", "|", ""])
_MARK_ENDS = ".…)]}>）】"
_BEHIND_STOP = re.compile(r"(?:[.!?][\"'”’»)\]`*_]*\s+(?=\S)|[。！？]\s*(?=\S))")
_COMMENT_END = re.compile(r"\*/\s*$")
_LINE_COMMENT = re.compile(r"^\s*//[/!]*\s*(.*)$")
_DIRECTIVE = re.compile(r"^#\s*(?:endif|else)\b|^#\s*(?:include\s*(?:\"[^\"]+\"|<[^>]+>)|define\s+\w+.*|undef\s+\w+)$")
_CODE_HEAD = re.compile(
    r"^(?:(?:static|extern|inline|const|unsigned|signed|struct|union|enum|typedef|void|int|char|long|short|float|double|bool|size_t|u?int\d+_t|pub(?:\(\w+\))?|fn|impl|mod|use|let|match|trait|type|unsafe|async)\b"
    r"|[A-Za-z_]\w*[ *&]+[A-Za-z_]\w*\(|#\s*(?:include|define|if|ifdef|ifndef|elif|undef|pragma|end|els)|#!?\[)"
)
_ROLE = re.compile(r"^(?:[^\W\d]{2,12}(?: \d{1,4})?): (?=\S)")
_ITEM = re.compile(r"^(?:[-*•]|\d{1,3}[.)])\s+")
_HEADING = re.compile(r"^#{1,6}\s+\S")
_CAMEL = re.compile(r"[a-z]\w*[A-Z]|[A-Z][a-z]+[A-Z]")


_FENCE = re.compile(r"^\s*```", re.M)
_HOST = re.compile(r"[A-Za-z][\w+.-]*://[^\s/]+")


def _tokens(line: str) -> list[str]:
    return _TOKEN.findall(_HOST.sub("URL", line) if "://" in line else line)


def _class(token: str) -> str:
    """Numbers count alike, and so do identifiers; other words stand for themselves."""
    if token.isdigit():
        return "9"
    if ("_" in token.strip("_") and len(token) > 2) or _CAMEL.search(token):
        return "ID"
    return token.lower()


def _kind(line: str) -> str:
    if _ITEM.match(line):
        return "item"
    if "://" in line:
        return "link"
    if _ROLE.match(line):
        return "turn"
    if _HEADING.match(line):
        return "heading"
    return "plain"


def closing(line: str) -> tuple[str, str, str, str]:
    """(kind of line, classes of the last token but two and but one, last token) of a phrase; a number is '9'."""
    ts = _tokens(line)[-3:]
    before = ["", "", *map(_class, ts[:-1])][-2:]
    return _kind(line), before[0], before[1], ("9" if ts[-1].isdigit() else ts[-1]) if ts else ""


def is_phrase(line: str) -> bool:
    """A line of words that is no code and holds no whole sentence ahead of its end."""
    if not line or line[0] in " \t|" or line[-1] in ";{}|`" or _CODE_HEAD.match(line) or line.startswith(("/*", "//", "*")):
        return False
    return not _BEHIND_STOP.search(_ROLE.sub("", _ITEM.sub("", line)))


def ending(text: str) -> tuple[str, str, str]:
    """(state, last line, form): how a text ends. The state says what the form looks like: blank, whole, cut or open.

    A mark of cutting at the end is passed over: what stands before it, if that is no phrase, is broken off.
    """
    bare = text.rstrip().rstrip("\ufeff\u200b\x00").rstrip()
    if not re.search(r"\w", bare):
        return "blank", "", "blank"
    if "\r" in bare:
        bare = bare.replace("\r\n", "\n").replace("\r", "\n")
    line = bare[bare.rfind("\n") + 1 :]
    if bare[-1] == "\ufffd":
        return "cut", line, "broken character"
    if "```" in bare and len(_FENCE.findall(bare)) % 2:
        return "cut", line, "open fence"
    if line.strip().startswith("```"):
        return "whole", line, "fence"
    mark = _MARK.search(line)
    if mark:
        rest = line[: mark.start()].rstrip()
        return ("open", line, "phrase") if rest and is_phrase(rest) else ("cut", line, "broken off")
    if bare.rfind("/*") > bare.rfind("*/") and "\n" not in bare[bare.rfind("/*") :].replace("\n *", "").replace("\n  ", ""):
        return "cut", line, "open comment"
    if _COMMENT_END.search(line) or _DIRECTIVE.match(line) or re.match(r"^\}[\s;),]*(?:\w+\s*;)?$", line):
        return "whole", line, "closed block"
    comment = _LINE_COMMENT.match(line)
    if comment:
        return ("whole", line, "line comment") if _STOP.search(comment.group(1)) else ("cut", line, "open line comment")
    if line.startswith("|"):
        cells = [x.count("|") for x in bare.rsplit("\n", 3)[-3:] if x.startswith("|")]
        return ("whole", line, "table row") if line.endswith("|") and len(line) > 1 and len(set(cells)) == 1 else ("cut", line, "open table row")
    if line[0] in " \t":
        s = line.strip()
        return ("whole", line, "indented stop") if _STOP.search(s) and " " in s and not re.search(r"[/\\:]\S*\.$", s) else ("cut", line, "indented")
    if _CODE_HEAD.match(line) and not _STOP.search(line):
        whole = line.endswith(";") or (line.endswith("}") and line.count("{") == line.count("}"))
        natural = re.match(r"^(?:let|use|match|type|trait|static|long|short|double|unsafe|signed|unsigned|enum|union)\b", line) and not re.search(r"[(){}=*<>&\[\]_;]", line)
        if not natural:
            return ("whole", line, "statement") if whole else ("cut", line, "open statement")
    if _STOP.search(line):
        last = line.rsplit(" ", 1)[-1]
        return ("cut", line, "path") if re.search(r"(?:[/\\]|::)\S*\.$", last) and not last.startswith("http") else ("whole", line, "stop")
    if re.search(r"[,:;(\[{=+&<，、：；（《-]$|-->?$", line) and not line.endswith("};"):
        return ("whole", line, "statement") if line.endswith(";") and re.search(r"[()=]", line) else ("cut", line, "connector")
    return ("open", line, "phrase") if is_phrase(line) else ("cut", line, "broken off")


def drawn_cut(text: str, code: int) -> str:
    """The text cut at a place that its hash draws; where that is within the bytes of a character, a broken one is left at times."""
    n = len(text.rstrip())
    if n < 2:
        return ""
    at = 1 + (code & 0xFFFFFFFFFFFF) % (n - 1)
    return text[:at] + ("\ufffd" if ord(text[at]) > 127 and code >> 48 & 1 else "")


_POINTS, _FACTOR = 0x110000, 0x9E3779B97F4A7C15
#: Characters of texts that are taken apart at once.
_PART = 1 << 18


@functools.cache
def _kinds() -> np.ndarray:
    """By character: 0 outside words, 1 within, 2 a word of its own, as CJK characters are."""
    kinds = np.zeros(_POINTS, dtype=np.uint8)
    for m in re.finditer(r"\w+", "".join(map(chr, range(_POINTS)))):
        kinds[m.start() : m.end()] = 1
    kinds[0x3400:0xA000] = 2
    return kinds


@functools.cache
def _values() -> np.ndarray:
    return np.random.default_rng(20240301).integers(1, 2**64, size=_POINTS, dtype=np.uint64)


@functools.cache
def _powers(width: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0, 1, ... of the factor and of its inverse."""
    n = 1 << width
    return tuple(np.cumprod(np.array([1, *[0] * (n - 1)], dtype=np.uint64) + np.where(np.arange(n) > 0, np.uint64(f), np.uint64(0)), dtype=np.uint64) for f in (_FACTOR, pow(_FACTOR, -1, 1 << 64)))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), dtype=np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _places(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end: runs of word characters; CJK characters stand alone."""
    kind = _kinds()[points]
    begins, ends = kind != 0, kind != 0
    within = (kind[1:] == 1) & (kind[:-1] == 1)
    begins[1:] &= ~within
    ends[:-1] &= ~within
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def _spelt(points: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit codes of the strings between these places: polynomials of their characters' values, mixed."""
    if len(points) > 4 * _PART and len(begins):
        points, begins, ends = points[begins[0] : ends[-1]], begins - begins[0], ends - begins[0]
        if half := len(begins) // 2:
            at = begins[half]
            return np.concatenate([_spelt(points[:at], begins[:half], ends[:half]), _spelt(points[at:], begins[half:] - at, ends[half:] - at)])
    n = len(points)
    powers, inverse = _powers(max(_PART.bit_length(), n.bit_length()))
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_values()[points] * powers[:n], out=sums[1:])
    x = (sums[ends] - sums[begins]) * inverse[begins]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(29))


def _parts(texts: list[str]) -> Iterator[list[str]]:
    part, chars = [], 0
    for t in texts:
        part.append(t)
        chars += len(t) + 1
        if chars >= _PART:
            yield part
            part, chars = [], 0
    if part:
        yield part


def word_codes(texts: list[str]) -> list[np.ndarray]:
    """The codes of the words of each text."""
    out = []
    for part in _parts(texts):
        points = _points("\n".join(part))
        begins, ends = _places(points)
        out += np.split(_spelt(points, begins, ends), np.searchsorted(begins, np.cumsum([len(t) + 1 for t in part])[:-1]))
    return out


def string_codes(strings: list[str]) -> np.ndarray:
    """The code of each string, which is that of the word if it is one."""
    out = [np.zeros(0, dtype=np.uint64)]
    for part in _parts(strings):
        ends = np.cumsum([len(x) for x in part])
        out.append(_spelt(_points("".join(part)), np.append(0, ends[:-1]), ends))
    return np.concatenate(out)


def codes_of_words(texts: list[list[str]]) -> list[np.ndarray]:
    return [string_codes(ws) for ws in texts]


def shingle_codes(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, starts): the 64-bit codes of five words in a row of each list of words, one after the other; a shorter list is one shingle."""
    return shingles_of(codes_of_words(texts))


def shingles_of(coded: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``shingle_codes`` of lists of words that are codes already."""
    sizes = np.array([max(len(ws), SHINGLE) for ws in coded], dtype=np.int64)
    words = np.zeros(int(sizes.sum()), dtype=np.uint64)
    begins = np.cumsum(sizes) - sizes
    for at, ws in zip(begins, coded):
        words[at : at + len(ws)] = ws
    n = len(words) - SHINGLE + 1
    if n < 1:
        return words[:0], begins
    x = np.zeros(n, dtype=np.uint64)
    for k in range(SHINGLE):
        x = (x ^ words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(31)
    counts = sizes - SHINGLE + 1
    starts = np.cumsum(counts) - counts
    inside = np.arange(int(counts.sum())) + np.repeat(begins - starts, counts)
    return x[inside], starts


_MIX = np.random.default_rng(20240229).integers(1, 2**63, size=BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_EDGES = np.array([0, *HEADS], dtype=np.int64)


def head_keys(codes: np.ndarray, starts: np.ndarray) -> list[list[np.ndarray]]:
    """Per text the keys of the bands of its beginnings, shortest first, and last those of the whole; the codes are used up."""
    n = len(starts)
    if not n:
        return []
    sizes = np.diff(np.append(starts, len(codes)))
    filled = np.searchsorted(_EDGES, sizes, side="left")  # segments between edges that hold a shingle of the text
    text_of = np.repeat(np.arange(n), filled)
    col = np.arange(len(text_of)) - np.repeat(np.cumsum(filled) - filled, filled)
    cuts = starts[text_of] + _EDGES[col]
    width = int(filled.max())
    keys = np.zeros((BANDS, n, width), dtype=np.uint64)
    codes ^= codes >> np.uint64(32)
    for k in range(BANDS * ROWS):
        y = codes * _MIX[k]
        y ^= y >> np.uint64(29)
        least = np.full((n, width), np.iinfo(np.uint64).max, dtype=np.uint64)
        least[text_of, col] = np.minimum.reduceat(y, cuts)
        key = keys[k // ROWS]
        key ^= np.minimum.accumulate(least, axis=1)
        key *= np.uint64(0xC2B2AE3D27D4EB4F)
        key ^= key >> np.uint64(31)
    band, head = np.arange(BANDS, dtype=np.uint64)[:, None, None], np.arange(1, width + 1, dtype=np.uint64)[None, None, :]
    whole = (keys ^ band) * np.uint64(0x9E3779B97F4A7C15)
    whole = (whole ^ (whole >> np.uint64(32))).view(np.int64)
    keys = (keys ^ band ^ (head << np.uint64(8))) * np.uint64(0x9E3779B97F4A7C15)
    keys = (keys ^ (keys >> np.uint64(32))).view(np.int64)
    full = np.searchsorted(_EDGES[1:], sizes, side="right")  # beginnings that the text fills
    out = []
    for i in range(n):
        own = [keys[: 1 if j < 2 else BANDS, i, j] for j in range(int(full[i]))]
        out.append([*own, whole[:, i, int(filled[i]) - 1]])
    return out


def _slot(codes: np.ndarray) -> np.ndarray:
    return (codes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


_PROFILE = pa.schema(
    [
        ("doc_id", pa.int64()), ("source", pa.string()), ("copy_of", pa.int64()), ("n_chars", pa.int32()), ("state", pa.string()), ("form", pa.string()), ("kind", pa.string()),
        ("prev2", pa.string()), ("prev", pa.string()), ("last", pa.string()), ("answers", pa.list_(pa.int64())), ("asks", pa.list_(pa.int64())), ("word", pa.int64()), ("closed", pa.int64()), ("went_on", pa.int64()),
    ]
)
_PROFILE_DDL = "doc_id bigint, source string, copy_of bigint, n_chars int, state string, form string, kind string, prev2 string, prev string, last string, answers array<bigint>, asks array<bigint>, word bigint, closed bigint, went_on bigint"
_CHUNK = 20_000


def _batch(**columns: list) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _PROFILE], schema=_PROFILE)


_CONTEXT = ["kind", "prev2", "prev", "last"]


class _Classes(dict):
    """Classes of tokens, remembered by the worker within a bound."""

    def __missing__(self, token: str) -> str:
        if len(self) > 200_000:
            self.clear()
        self[token] = c = _class(token)
        return c


_CLASSES = _Classes()


class _Votes:
    """What a partition's texts say about closing words, summed up."""

    def __init__(self) -> None:
        self.words, self.times = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.lines: Counter = Counter()
        self.last_lines: Counter = Counter()
        self.chars = 0
        self.ends: Counter = Counter()
        self.shut: Counter = Counter()
        self.on: Counter = Counter()
        self.forms: Counter = Counter()
        self.drawn: Counter = Counter()
        self.slots = np.zeros(1 << SLOT_BITS, dtype=np.uint32)

    def count(self, codes: list[np.ndarray]) -> None:
        """All words but the last of each text, by their codes."""
        own, times = np.unique(np.concatenate([self.words[:0], *(c[:-1] for c in codes)]), return_counts=True)
        self.words, at = np.unique(np.concatenate([self.words, own]), return_inverse=True)
        self.times = np.bincount(at, weights=np.concatenate([self.times, times]), minlength=len(self.words)).astype(np.int64)

    def read(self, text: str) -> None:
        """Lines are kept up to a number of characters, as many come again."""
        *lines, last = text.split("\n")
        self.lines.update(lines)
        self.last_lines[last] += 1
        self.chars += len(text)
        if self.chars > 16_000_000:
            self.tally()

    def tally(self) -> None:
        on, shut, classes = self.on, self.shut, _CLASSES.__getitem__
        for line, n in self.lines.items():
            if line:
                self.ends[line[line.rfind(" ") + 1 :].strip(_SIGNS)] += n
        self.lines.update(self.last_lines)
        for line, n in self.lines.items():
            if line[:1] in _NO_PHRASE_FRONT:
                continue
            line = line.rstrip()
            if line and line[-1] in _MARK_ENDS and not (line[-1] == "." and line[-3:] != "..."):
                mark = _MARK.search(line)
                line = line[: mark.start()].rstrip() if mark else line
            if not is_phrase(line):
                continue
            ts = _tokens(line)
            cs = list(map(classes, ts))
            *keys, last = zip(repeat(_kind(line)), ["", "", *cs], ["", *cs], ["9" if c == "9" else t for c, t in zip(cs, ts)])
            if n == 1:
                on.update(keys)
            else:
                for key in keys:
                    on[key] += n
            if not _STOP.search(line):
                shut[last] += n
        self.lines, self.last_lines, self.chars = Counter(), Counter(), 0

    def batches(self) -> Iterator[pa.RecordBatch]:
        self.tally()
        closed = np.zeros(len(self.words), dtype=np.int64)
        ends, times = string_codes(list(self.ends)), np.array(list(self.ends.values()), dtype=np.int64)
        at = np.searchsorted(self.words, ends)
        known = (np.append(self.words, np.uint64(0))[at] == ends) & (at < len(self.words))
        closed[at[known]] = times[known]
        for k in range(0, len(self.words), _CHUNK):
            part = self.words[k : k + _CHUNK].view(np.int64)
            yield _batch(state=["word"] * len(part), word=part, went_on=self.times[k : k + _CHUNK], closed=closed[k : k + _CHUNK])
        keys = list(self.shut.keys() | self.on.keys())
        for k in range(0, len(keys), _CHUNK):
            part = keys[k : k + _CHUNK]
            context = {name: list(column) for name, column in zip(_CONTEXT, zip(*part))}
            yield _batch(state=["phrase"] * len(part), closed=[self.shut[key] for key in part], went_on=[self.on[key] for key in part], **context)
        slots = np.minimum(self.slots, 0xFFFF).astype(np.uint16).view(np.int64).reshape(SLOT_ROWS, -1)
        held = np.flatnonzero(slots.any(axis=1))
        yield _batch(state=["slots"] * len(held), word=held.tolist(), answers=list(slots[held]))
        forms = list(self.forms.keys() | self.drawn.keys())
        yield _batch(state=["form"] * len(forms), kind=[f[0] for f in forms], form=[f[1] for f in forms], closed=[self.forms[f] for f in forms], went_on=[self.drawn[f] for f in forms])
        self.__init__()


def bare_of(text: str, state: str) -> str:
    """The text without blanks and marks at its end, where it isn't whole: a copy may be longer by part of a word alone."""
    bare = text.rstrip()
    return bare if state == "whole" else bare[:-200] + _MARK.sub("", bare[-200:]).rstrip()


def _profiles(docs: DataFrame) -> DataFrame:
    """Rows of five kinds, told apart by doc_id and state, from one pass over the texts.

    A row per non-blank document; with state 'word', how often a word (its code in ``word``) stands in a partition's texts but for
    their last words (in ``went_on``), and at ends of lines; with state 'slots', a part (numbered in ``word``) of the counts of shingles by slot; with state 'phrase', how often a line closes after a context or goes on; with state
    'form', how many texts end in a form (in ``closed``) and how many when cut at a drawn place.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes = _Votes()
        for b in batches:
            out: dict[str, list] = {f: [] for f in ("doc_id", "source", "copy_of", "n_chars", "state", "form", "kind", "prev2", "prev", "last")}
            bares = []
            for i, s, t in zip(*(c.to_pylist() for c in b.columns)):
                state, line, form = ending(t)
                if state == "blank":
                    continue
                code = xxhash.xxh3_64_intdigest(t)
                bare = bare_of(t, state)
                bares.append(bare)
                votes.read(t)
                votes.forms[state, form] += 1
                cut_state, _, cut_form = ending(drawn_cut(t, code))
                if cut_state != "blank":
                    votes.drawn[cut_state, cut_form] += 1
                shut = closing(_MARK.sub("", line).rstrip() or line) if state == "open" else ("", "", "", "")
                for f, v in zip(out, (i, s, code - (1 << 63), len(bare), state, form, *shut)):
                    out[f].append(v)
            coded = word_codes(bares)
            votes.count(coded)
            codes, starts = shingles_of(coded)
            votes.slots += np.bincount(_slot(codes), minlength=len(votes.slots)).astype(np.uint32)
            answers, asks = [], []
            for keys, ws, state in zip(head_keys(codes, starts), coded, out["state"]):
                answers.append(np.concatenate(keys).tolist())
                # Beginnings that don't reach the last word; a text of up to five words asks nothing.
                m = len(ws) - SHINGLE
                own = int(np.searchsorted(_EDGES[1:], m, side="right"))
                asking = state != "whole" and own
                asks.append([*keys[own - 1].tolist(), *keys[-1].tolist()] if asking else None)
            yield _batch(**out, answers=answers, asks=asks, word=string_codes(out["last"]).view(np.int64))
            if len(votes.words) + len(votes.on) > 400_000:
                yield from votes.batches()
        yield from votes.batches()

    return docs.select("doc_id", "source", "text").mapInArrow(read, _PROFILE_DDL)


def _keys(kind: Column, prev2: Column, prev: Column, last: Column) -> list[Column]:
    """The contexts whose counts are asked for: all of it; without the last token; without the last but two; of the last but two; the word alone."""
    return [F.xxhash64(F.lit(0), kind, prev2, prev, last), F.xxhash64(F.lit(1), kind, prev2, prev), F.xxhash64(F.lit(2), kind, prev, last), F.xxhash64(F.lit(3), kind, prev2)]


def _levels() -> list[Column]:
    """All keys that a closing asks for: its contexts, the beginnings of words, the word."""
    return [*_keys(*map(F.col, _CONTEXT)), F.xxhash64(F.lit(4), "kind", "prev", F.substring("last", 1, _STEM)), F.xxhash64(F.lit(5), "word")]


_BIT_FACTORS = np.array([1, 0x9E3779B97F4A7C15], dtype=np.uint64)


class _Marks:
    """What keys are asked for: two bits for each, and by other bits of the keys the least size of those that ask."""

    def __init__(self, n: int, asked: Iterable[tuple[np.ndarray, np.ndarray]]) -> None:
        """asked: n keys and the sizes that ask for them, in parts."""
        bits, slots = max(16, (8 * n).bit_length()), min(24, max(16, n.bit_length()))
        self.shift, self.slot_shift = np.uint64(64 - bits), np.uint64(64 - slots)
        marked, self.least = np.zeros(1 << bits, dtype=bool), np.full(1 << slots, 0xFFFF, dtype=np.uint16)
        for keys, sizes in asked:
            for k in range(len(_BIT_FACTORS)):
                marked[self._bits(keys, k)] = True
            np.minimum.at(self.least, self._slots(keys), np.minimum(sizes, 0xFFFE).astype(np.uint16))
        self.marked = np.packbits(marked)

    def _bits(self, keys: np.ndarray, k: int) -> np.ndarray:
        return ((keys * _BIT_FACTORS[k]) >> self.shift).astype(np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0xC2B2AE3D27D4EB4F)) >> self.slot_shift).astype(np.int64)

    def met(self, keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Places of the keys that may be asked for by something of a smaller size; no other is."""
        hit = np.arange(len(keys))
        for k in range(len(_BIT_FACTORS)):
            at = self._bits(keys[hit], k)
            hit = hit[(self.marked[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)]
        return hit[np.minimum(sizes[hit], 0xFFFF) > self.least[self._slots(keys[hit])]]


def _marks(asked: DataFrame) -> Broadcast | None:
    """The marks of rows (key, size) for every task, or none beyond MOST_KEYS rows, which are counted."""
    n = asked.count()
    if n > MOST_KEYS:
        return None
    parts = ((b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()) for b in asked.toArrow().to_batches())
    return asked.sparkSession.sparkContext.broadcast(_Marks(n, parts))


def _met(df: DataFrame, keys: Column, size: Column, values: list[str], marks: Broadcast | None) -> DataFrame:
    """(key, *values): a row for each key in the arrays, without those that nothing of a smaller size asks for, as far as marks tell."""
    if marks is None:
        return df.select(F.explode(keys).alias("key"), *values)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).flatten().to_numpy().view(np.uint64)
            row = np.repeat(np.arange(b.num_rows), b.column(0).value_lengths().fill_null(0).to_numpy())
            hit = marks.value.met(own, b.column(1).to_numpy()[row])
            row = pa.array(row[hit])
            yield pa.RecordBatch.from_arrays([pa.array(own[hit].view(np.int64)), *(c.take(row) for c in b.columns[2:])], names=["key", *values])

    return df.select(keys.alias("keys"), size.alias("of"), *values).mapInArrow(kept, S.StructType([S.StructField("key", S.LongType()), *df.select(*values).schema.fields]))


_STEM = 40


def _sent(df: DataFrame) -> DataFrame:
    """Up to MOST_SENT rows, which are counted, for every task; more as they are."""
    df = checkpointed(df)
    return F.broadcast(df) if df.limit(MOST_SENT + 1).count() <= MOST_SENT else df


def _counts(profile: DataFrame, asked: DataFrame) -> DataFrame:
    """(key, closed, went_on): the counts of every context that shares its last token but one with one asked for, of its words, and of the beginnings of words after that token."""
    votes = profile.where("doc_id is null and state = 'phrase'").join(_sent(asked.select("kind", "prev").distinct().withColumn("met", F.lit(True))), ["kind", "prev"], "left")
    last, n = F.col("last"), F.least(F.length("last") - 1, F.lit(_STEM))
    stems = F.when((n > 0) & ~last.rlike(r"^\W"), F.transform(F.sequence(F.lit(1), n), lambda k: F.xxhash64(F.lit(4), F.col("kind"), F.col("prev"), F.substring(last, F.lit(1), k)))).otherwise(F.array().cast("array<bigint>"))
    *near, far = _keys(*map(F.col, _CONTEXT))
    keys = F.when(F.col("met"), F.concat(F.array(*near, far), stems)).otherwise(F.array(far))
    words = profile.where("doc_id is null and state = 'word'").select(F.array(F.xxhash64(F.lit(5), "word")).alias("keys"), "closed", "went_on")
    marks = _marks(asked.select(F.explode(F.array(*_levels())).alias("key"), F.lit(0).alias("size")))
    keyed = _met(votes.select(keys.alias("keys"), "closed", "went_on").unionByName(words), F.col("keys"), F.lit(1), ["closed", "went_on"], marks)
    return keyed.groupBy("key").agg(F.sum("closed").alias("closed"), F.sum("went_on").alias("went_on"))


def _verdicts(asked: DataFrame, counts: DataFrame, all_words: int, all_texts: int) -> DataFrame:
    """(kind, prev2, prev, last, shuts): whether a line may close with these words.

    asked: (kind, prev2, prev, last, texts, word), the closings in question, how many distinct texts end with the last word, and its code.

    A frequent word that next to never ends a line, nor often a text, doesn't close one ("the", "of"). Half a word doesn't, either: a word
    met next to nowhere but at the ends of a few texts, or one that, after the same word, is more often the beginning of a longer
    one. Otherwise the closings after these tokens are held against all their occurrences; where these don't settle it, those after the
    two tokens before the last, of the last two, or after the last but two are counted instead. All bounds are shares of
    the corpus or errors of a share, so a text is judged alike at every size.
    """
    keys = _levels()
    each = asked.select(*_CONTEXT, "texts", F.posexplode(F.array(*keys)).alias("level", "key")).join(counts, "key", "left")
    sums = [F.coalesce(F.max(F.when(F.col("level") == i, F.col(c))), F.lit(0)).alias(f"{c}{i}") for i in range(len(keys)) for c in ("closed", "went_on")]
    s = each.groupBy(*_CONTEXT, "texts").agg(*sums)
    times, ends = F.col("went_on5"), F.col("closed5")
    own = F.col("closed2") + F.col("went_on2")
    # A word beyond the stems' length is one of those that its stem counts.
    longer = F.col("closed4") + F.col("went_on4") - F.when(F.length("last") > _STEM, own).otherwise(0)
    few = F.col("texts") < max(3, RARE_END * all_texts)
    strange = (times <= RARE_WORD * all_words) & few & (F.col("last") != "9") & F.col("last").rlike(r"\w")
    half = longer > F.col("closed2")
    # CJK signs are no words, so they are left to the other tests.
    rare_end = (ends < END_SHARE * times) & (ends + 2 * F.sqrt(ends) + 3 <= END_BOUND * times) & (F.col("texts") < FINAL_SHARE * times)
    dangling = F.col("last").rlike(r"^[A-Za-z\u00c0-\u024f]+$") & (times >= FREQUENT * all_words) & rare_end

    def settled(i: int) -> Column:
        c, n = F.col(f"closed{i}"), F.col(f"closed{i}") + F.col(f"went_on{i}")
        return F.abs(2 * c - n) > SETTLED * F.sqrt(n)

    def share(i: int) -> Column:
        return F.col(f"closed{i}") >= CLOSE_SHARE * (F.col(f"closed{i}") + F.col(f"went_on{i}"))

    shuts = F.when(strange | half | dangling, False)
    for i in (0, 1, 2):
        shuts = shuts.when(settled(i), share(i))
    return s.select(*_CONTEXT, shuts.otherwise(settled(3) & share(3)).alias("shuts"))


def open_forms(rows: list[tuple[str, str, int, int]]) -> set[str]:
    """The forms that close no texts, from rows of (state, form, texts that end so, drawn cuts that end so).

    The share of cut texts follows from the forms that look cut; a form is no close if more than half of the texts that end so would be
    expected from drawn cuts at that share. What a form looks like counts as two texts.
    """
    looks_cut = [r for r in rows if r[0] == "cut"]
    rate = (sum(r[2] for r in looks_cut) + 1) / (sum(r[3] for r in looks_cut) + 1)
    return {form for state, form, ends, drawn in rows if state in ("cut", "whole") and rate * drawn + PRIOR * (state == "cut") > 0.5 * (ends + PRIOR)}


class _Long:
    """Where the words of a longer text are, and its shingles in order of their codes."""

    def __init__(self, text: str) -> None:
        points = _points(text)
        self.text, (self.begins, self.ends) = text, _places(points)
        codes = shingles_of([_spelt(points, self.begins, self.ends)])[0]
        self.order = np.argsort(codes, kind="stable")
        self.ranked = codes[self.order]

    def word(self, at: int) -> str:
        return self.text[self.begins[at] : self.ends[at]]


def unmarked(text: str) -> str:
    return _MARK.sub("", text.rstrip()).rstrip()


class _Short:
    """A shorter text without its mark, its last word and the shingles of its whole words."""

    def __init__(self, text: str) -> None:
        self.bare = unmarked(text)
        points = _points(self.bare)
        begins, ends = _places(points)
        self.words = len(begins)
        self.last = self.bare[begins[-1] : ends[-1]] if self.words else ""
        self.codes = shingles_of([_spelt(points, begins, ends)[:-1]])[0] if self.words > SHINGLE else np.zeros(0, dtype=np.uint64)
        self.distinct = len(np.unique(self.codes))


class _Kept(dict):
    """What was worked out of texts last, up to a number of characters. Pairs come ordered by the longer text, and few texts ask."""

    def __init__(self, make: type, most_chars: int) -> None:
        self.make, self.most_chars, self.chars = make, most_chars, 0

    def __missing__(self, text: str):
        self.chars += len(text)
        if self.chars > self.most_chars:
            self.clear()
            self.chars = len(text)
        self[text] = made = self.make(text)
        return made


_LONGS, _SHORTS = _Kept(_Long, 200_000), _Kept(_Short, 4_000_000)


def alignment(short: str, long: str) -> str | None:
    """What the longer text shows of the shorter one's end: 'cut', 'whole' (a line ends there) or 'same' (the longer one ends, too).

    None if less than SIMILARITY of the shorter text's shingles are in the longer one, or if its end isn't there.
    """
    asking = _SHORTS[short]
    s, last, x = asking.bare, asking.last, asking.codes
    if not len(x):
        return None
    y = _LONGS[long]
    lo, hi = np.searchsorted(y.ranked, x, side="left"), np.searchsorted(y.ranked, x, side="right")
    shared = np.flatnonzero(hi > lo)
    if not len(shared) or shared[-1] < len(x) - 1 - SHINGLE or len(np.unique(x[shared])) < SIMILARITY * asking.distinct:
        return None
    p = int(shared[-1])
    once = shared[(hi - lo)[shared] == 1][-64:]
    shift = float(np.median(y.order[lo[once]] - once)) if len(once) else 0.0
    places = y.order[lo[p] : hi[p]]
    q = int(places[np.argmin(np.abs(places - p - shift))])
    at = q + asking.words - 1 - p
    if at >= len(y.begins):
        return "same" if at == len(y.begins) else None
    if y.word(at) != last:
        return "cut" if y.word(at).startswith(last) else None
    rest, behind = long[y.ends[at] :], s[s.rfind(last) + len(last) :]
    rest = rest[len(behind) :] if rest.startswith(behind) else rest
    if not rest.strip():
        return "same"
    return "whole" if re.match(r"[ \t]*\r?\n", rest) else "cut"


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the distinct ids. Up to MOST_SENT ids, which are counted, go to the texts; more are joined."""
    return docs.select("doc_id", "text").join(_sent(ids), "doc_id", "left_semi").dropDuplicates(["doc_id"])


def _aligned(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(short_id, cut, whole): whether some pair (short_id, long_id) shows that the text was cut, or that a line ends where it does.

    A text that many others are held against is dealt out in salted rows, so no task gets all of them.
    """
    heavy = list(heavy_keys(pairs, "long_id", 2_000))
    salt = F.when(F.col("long_id").isin(*heavy), F.pmod(F.xxhash64("short_id"), F.lit(SALTS)).cast("int")).otherwise(0) if heavy else F.lit(0)
    texts = checkpointed(_texts_of(docs, pairs.select(F.col("short_id").alias("doc_id")).union(pairs.select("long_id")).distinct()))
    dealt = F.explode(F.when(F.col("doc_id").isin(*heavy), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))) if heavy else F.lit(0)
    longs = texts.select(F.col("doc_id").alias("long_id"), F.col("text").alias("long"), dealt.alias("salt"))
    shorts = texts.select(F.col("doc_id").alias("short_id"), F.col("text").alias("short"))
    # In order of the longer text, which is then taken apart once.
    pairs = pairs.withColumn("salt", salt).repartition("long_id", "salt").sortWithinPartitions("long_id")
    met = pairs.join(shorts, "short_id").join(longs, ["long_id", "salt"]).select("short_id", "short", "long")

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(i, alignment(s, t)) for i, s, t in zip(b["short_id"], b["short"], b["long"])]
            yield pd.DataFrame([f for f in found if f[1] in ("cut", "whole")], columns=["short_id", "shown"])

    shown = met.mapInPandas(align, "short_id bigint, shown string")
    return shown.groupBy("short_id").agg(F.max(F.col("shown") == "cut").alias("cut"), F.max(F.col("shown") == "whole").alias("whole"))


def rarest(codes: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, int]:
    """The rarest of the distinct shingles of a text, and how many of them a text has at least that has SIMILARITY of all."""
    own = np.unique(codes)
    missing = len(own) - math.ceil(SIMILARITY * len(own))
    most = min(len(own), missing + SHARED)
    return own[np.argsort(slots[_slot(own)], kind="stable")[:most]], most - missing


def _slots(profile: DataFrame) -> np.ndarray:
    """The counts of shingles by slot, of all partitions, up to 65,535 each: 2 MB, whatever the corpus."""

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1, dtype=np.uint32)
        for x in part["answers"]:
            total = np.minimum(total + np.asarray(x, dtype=np.int64).view(np.uint16).astype(np.uint32), 0xFFFF)
        return pd.DataFrame({"word": part["word"].iloc[:1], "answers": [total.astype(np.uint16).view(np.int64)]})

    table = np.zeros((SLOT_ROWS, (1 << SLOT_BITS) // SLOT_ROWS), dtype=np.uint16)
    for r in profile.where("doc_id is null and state = 'slots'").select("word", "answers").groupBy("word").applyInPandas(add, "word bigint, answers array<bigint>").collect():
        table[r[0]] = np.array(r[1], dtype=np.int64).view(np.uint16)
    return table.ravel()


def _holding(left: DataFrame, rows: DataFrame, docs: DataFrame, slots: np.ndarray) -> DataFrame:
    """(short_id, long_id): for texts (short_id, size) every longer one that has enough of their rarest shingles to have SIMILARITY of all."""
    sc = docs.sparkSession.sparkContext
    counts = sc.broadcast(slots)

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # As in _Short; asking texts have more than SHINGLE words, but for a mark, and then no pair is aligned.
            codes, starts = shingles_of([c[:-1] for c in word_codes([unmarked(t) for t in b.column(1).to_pylist()])])
            found = [rarest(own, counts.value) for own in np.split(codes, starts[1:])] if len(starts) else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f[1] for f in found], pa.int32()), pa.array([f[0].view(np.int64) for f in found], pa.list_(pa.int64()))], names=["short_id", "least", "keys"])

    texts = docs.select("doc_id", "text").join(_sent(left.select(F.col("short_id").alias("doc_id"))), "doc_id", "left_semi")
    asked = checkpointed(texts.mapInArrow(keys_of, "short_id bigint, least int, keys array<bigint>").dropDuplicates(["short_id"]).join(left, "short_id"))
    counts.destroy()
    keyed = asked.select("short_id", "size", "least", F.explode("keys").alias("key"))
    marks = _marks(keyed.select("key", "size"))

    def held_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            codes, starts = shingles_of(word_codes(texts))
            each = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(codes))))
            # As long as in the profile, or longer by a mark.
            chars = np.array([len(t.rstrip()) for t in texts], dtype=np.int32)
            if marks is not None:
                hit = marks.value.met(codes, chars[each])
                codes, each = codes[hit], each[hit]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(each)), pa.array(chars[each]), pa.array(codes.view(np.int64))], names=["long_id", "chars", "key"])

    # A key that a longer text has twice counts twice; pairs are verified where they are aligned.
    held = docs.select("doc_id", "text").mapInArrow(held_by, "long_id bigint, chars int, key bigint")
    met = held.join(keyed, "key").where("short_id <> long_id and chars > size")
    pairs = checkpointed(met.groupBy("short_id", "long_id").agg(F.count("*").alias("n"), F.first("least").alias("least")).where("n >= least").select("short_id", "long_id"))
    if marks is not None:
        marks.destroy()
    lengths = rows.select(F.col("doc_id").alias("long_id"), "n_chars").join(_sent(pairs.select("long_id").distinct()), "long_id", "left_semi").groupBy("long_id").agg(F.max("n_chars").alias("n_chars"))
    return pairs.join(lengths, "long_id").join(left, "short_id").where("n_chars > size").select("short_id", "long_id")


def _shown(rows: DataFrame, docs: DataFrame, slots: np.ndarray) -> DataFrame:
    """(copy_of, cut, whole) of the texts without a whole ending for which a longer near-copy shows what follows."""
    asking = checkpointed(rows.where("asks is not null").dropDuplicates(["copy_of"]).select("copy_of", F.col("doc_id").alias("short_id"), F.col("n_chars").alias("size"), "asks"))
    keyed = asking.select("short_id", "size", F.explode("asks").alias("key"))
    marks = _marks(keyed.select("key", "size"))
    members = _met(rows, F.col("answers"), F.col("n_chars"), ["doc_id", "n_chars"], marks)

    # First the longest member of each octave of length, which a map-side aggregate finds.
    octave = F.length(F.bin("n_chars"))
    firsts = members.groupBy("key", octave.alias("octave")).agg(
        F.max("n_chars").alias("most"), F.max_by("doc_id", "n_chars").alias("long_id")
    )
    met = keyed.join(firsts, "key").where("most > size")
    first = checkpointed(met.select("short_id", "long_id").distinct())
    if marks is not None:
        marks.destroy()
    shown = checkpointed(_aligned(first, docs))

    # Then, for those that none of these shows to be cut, every other longer text that can be a near-copy.
    left = asking.join(shown.where("cut").select("short_id"), "short_id", "left_anti").select("short_id", "size")
    more = checkpointed(_holding(left, rows, docs, slots).join(first, ["short_id", "long_id"], "left_anti"))
    if not more.isEmpty():
        shown = shown.unionByName(_aligned(more, docs)).groupBy("short_id").agg(F.max("cut").alias("cut"), F.max("whole").alias("whole"))
    return asking.select("copy_of", "short_id").join(shown, "short_id").select("copy_of", "cut", "whole")


def truncated_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, source, by): the documents whose text stops because the rest of a longer text is missing.

    ``by`` says what showed it: 'copy' (a longer near-copy), 'form' (the terminality of the text's closing form) or 'words' (that of its closing words).
    Null, empty and blank texts are no cases, nor are complete texts without a full stop. Copies of a cut text are cases, too. Rows
    with a null doc_id are left out, equal doc_ids come out once. An empty table gives no rows; other columns are ignored.
    """
    ship(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), "text").where("doc_id is not null and text is not null and text <> ''")
    profile = checkpointed(_profiles(docs))
    rows = profile.where("doc_id is not null").drop("closed", "went_on")
    shown = _shown(rows, docs, _slots(profile))

    # Terminality: counts of the whole corpus. There are some twenty forms, whatever the corpus.
    totals = profile.where("doc_id is null").groupBy("state", F.when(F.col("state") == "form", F.col("kind")).alias("looks"), "form").agg(F.sum("closed"), F.sum("went_on")).collect()
    no_close = open_forms([(r[1], r[2], r[3], r[4]) for r in totals if r[0] == "form"])
    all_words, all_texts = sum(r[4] for r in totals if r[0] == "word"), sum(r[3] for r in totals if r[0] == "form")
    open_ = rows.where("state = 'open'")
    ends = open_.groupBy("last").agg(F.countDistinct("copy_of").alias("texts"), F.first("word").alias("word"))
    closings = checkpointed(open_.select(*_CONTEXT).distinct().join(ends, "last"))
    verdict = _verdicts(closings, _counts(profile, closings), all_words, all_texts)

    ended = F.col("form").isin(*no_close) if no_close else F.lit(False)
    judged = rows.select("doc_id", "source", "copy_of", "state", ended.alias("ended"), *_CONTEXT).where("state <> 'whole' or ended").join(shown, "copy_of", "left").join(verdict, _CONTEXT, "left")
    by = F.when(F.col("cut"), "copy").when(F.col("ended"), "form").when(F.col("whole"), None).when(~F.coalesce("shuts", F.lit(False)), "words")
    return judged.select("doc_id", "source", by.alias("by")).where("by is not null").dropDuplicates(["doc_id"])


def truncation_report(documents: DataFrame, cut: DataFrame) -> DataFrame:
    """(source, documents, cut, share): how often each source truncates, among its non-blank texts; a null source is one of its own."""
    every = documents.where(F.col("doc_id").isNotNull() & F.col("text").rlike(r"\w")).groupBy("source").agg(F.countDistinct("doc_id").alias("documents"))
    hit = cut.groupBy(F.col("source").alias("s")).agg(F.count("*").alias("cut"))
    joined = every.join(hit, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "documents", F.coalesce("cut", F.lit(0)).alias("cut"))
    return joined.withColumn("share", F.col("cut") / F.col("documents"))
