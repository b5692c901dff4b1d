"""Encoding of the whole corpus with a public byte-pair tokenizer.

Method: prefix-sharing trie traversal. The distinct words of a batch are visited in byte order, which is the
depth-first order of their trie; a stack holds, for each byte of the current path, the last token of the encoding of
the prefix that ends there. A new word keeps the states of the prefix it shares with the word before it and adds only
those of its own bytes. The last token at a place is the one token ending there that may follow the last token of the
prefix before it; whether two tokens may stand side by side (their joint bytes encode to just these two) is worked out
once for each pair. Walking back over last tokens gives the ids.

Scale: no shuffle. Each Python worker keeps the words it has met, within a bound, so a word is encoded once per worker.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import ship

#: Fixed value: how the tokenizer cuts a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The same cut for texts of ASCII characters only, which is all that the faster standard matcher is asked for.
ASCII_PATTERN = r" ?[A-Za-z]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"

MOST_WORDS = 400_000
CHUNK_CHARS = 2_000_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class TrieEncoder:
    """Words to ids under a table of ranked byte strings, which are the ids, too."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.tails = {b[i:] for b in ranks for i in range(len(b))}
        self.pairs: dict[tuple[int, int], bool] = {}
        self._forget()

    def _forget(self) -> None:
        """Buffers that grow in place: numpy looks at them without a copy."""
        self.words, self.flat, self.starts = {}, array("i"), array("q", [0])

    @classmethod
    def from_file(cls, path: str) -> TrieEncoder:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def merge(self, word: bytes) -> list[int]:
        """The ids of a byte string by its definition: join the pair of least rank until none is left."""
        parts = [word[i : i + 1] for i in range(len(word))]
        rank = self.ranks.get
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: rank(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when their bytes stand side by side."""
        known = self.pairs.get((left, right))
        if known is None:
            known = self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
            self.pairs[left, right] = known
        return known

    def last_token(self, word: bytes, end: int, states: list[int]) -> int:
        """The last token of the encoding of ``word[:end]``, given those of all shorter prefixes (``states[i]`` for i bytes)."""
        ranks, tails = self.ranks, self.tails
        chosen = -1
        for n in range(1, min(end, self.longest) + 1):
            tail = word[end - n : end]
            if tail not in tails:
                break
            token = ranks.get(tail)
            if token is None:
                continue
            if n == end:
                if n == 1 or self.merge(tail) == [token]:
                    return token
            elif chosen < 0 and self.fits(states[end - n], token):
                chosen = token
        if chosen < 0:
            raise ValueError("the vocabulary lacks a byte")
        return chosen

    def learn(self, words: list[str]) -> None:
        """Encode new words in trie order; their ids go to the flat table."""
        coded = sorted((w.encode(), w) for w in words)
        before, states = b"", [-1]
        for b, w in coded:
            shared = 0
            for x, y in zip(before, b):
                if x != y:
                    break
                shared += 1
            del states[shared + 1 :]
            for end in range(shared + 1, len(b) + 1):
                states.append(self.last_token(b, end, states))
            ids, end = [], len(b)
            while end:
                ids.append(states[end])
                end -= len(self.bytes_of[states[end]])
            self.words[w] = len(self.starts) - 1
            self.flat.extend(reversed(ids))
            self.starts.append(len(self.flat))
            before = b

    def encode(self, texts: list[str | None], split) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the texts, as one flat array; null and empty texts have no ids."""
        per_text = [split(t) if t else [] for t in texts]
        counts = np.fromiter(map(len, per_text), dtype=np.int64, count=len(per_text))
        if len(self.words) > MOST_WORDS:
            self._forget()
        if len(self.pairs) > 2 * MOST_WORDS:
            self.pairs = {}
        fresh = set()
        for ws in per_text:
            fresh.update(ws)
        fresh.difference_update(self.words)
        if fresh:
            self.learn(list(fresh))
        known = self.words
        codes = np.fromiter((known[w] for ws in per_text for w in ws), dtype=np.int64, count=int(counts.sum()))
        starts, flat = np.frombuffer(self.starts, dtype=np.int64), np.frombuffer(self.flat, dtype=np.int32) if self.flat else np.zeros(0, dtype=np.int32)
        sizes = starts[codes + 1] - starts[codes]
        ends = np.cumsum(sizes)
        take = np.repeat(starts[codes] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
        word_ends = np.concatenate([[0], ends])
        offsets = word_ends[np.concatenate([[0], np.cumsum(counts)])]
        return offsets.astype(np.int64), flat[take]


_ENCODERS: dict[tuple[str, str], tuple[TrieEncoder, object]] = {}


def _encoder(path: str, pattern: str) -> tuple[TrieEncoder, object]:
    if (path, pattern) not in _ENCODERS:
        import regex

        whole = regex.compile(pattern).findall
        if pattern == PATTERN:
            plain = re.compile(ASCII_PATTERN, re.ASCII).findall
            split = lambda t: plain(t) if t.isascii() else whole(t)
        else:
            split = whole
        _ENCODERS[path, pattern] = TrieEncoder.from_file(path), split
    return _ENCODERS[path, pattern]


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """(id, ids): the token ids of each text, without special tokens, whose spellings are ordinary text.

    A null or empty text has an empty list. Rows come out as often as they come in, null ids included; an empty
    table gives no rows and other columns are ignored. ``vocabulary`` is the path of a file of ranked byte strings
    that every executor can read.
    """
    ship(df.sparkSession)
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, split = _encoder(path, pattern)
        for b in batches:
            at, sizes = 0, np.cumsum(np.nan_to_num(pc.utf8_length(b.column(1)).to_numpy(zero_copy_only=False).astype(float)))
            while at < b.num_rows:
                base = sizes[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(sizes, base + CHUNK_CHARS, side="right")))
                offsets, ids = encoder.encode(b.column(1).slice(at, to - at).to_pylist(), split)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, type=pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), lists], names=["id", "ids"])
                at = to

    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)
