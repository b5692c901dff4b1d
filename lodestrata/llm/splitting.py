"""Splitting oversized texts at natural boundaries.

Method: one scan gives the offsets of all boundaries of a text as sorted arrays, one per kind of boundary;
each cut is a binary search for the last boundary under the limit, the next piece starts a fixed overlap
before the cut, and a text without any boundary in reach is cut hard at the limit.

Scale: texts under the limit never leave the scan. The oversized ones are shuffled once by id, which drops repeated rows (a
map-side aggregate takes those of one task together first); each text is then split by the task that has it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import ship

LIMIT, OVERLAP = 2000, 200

#: Kinds of boundaries, best first: the end of a paragraph, of a line, of a statement or sentence, of a word.
_BOUNDARIES = [
    re.compile(r"\n[ \t\r]*\n\s*"),
    re.compile(r"\r\n|\n|\r| "),
    re.compile(r"[;{}](?=\s)\s*|[.!?](?=\s)\s*|[。！？；]|\*/\s*"),
    re.compile(r"\s+|,\s*|[，、]"),
    re.compile(r"(?<=\w)(?=\W)|(?<=\W)(?=\w)"),
]


def boundaries(text: str) -> list[np.ndarray]:
    """The sorted offsets after which the text may be cut, one array per kind."""
    return [np.fromiter((m.end() for m in p.finditer(text)), dtype=np.int64) for p in _BOUNDARIES]


def piece_spans(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of each piece: at most ``limit`` characters, each after the first repeating the last ``overlap`` ones.

    A better kind of boundary is taken if it lies in the second half of what the piece may hold; failing that, the last
    boundary of the best kind that lies behind the overlap; failing that, the cut is hard. A text that fits is one
    piece, an empty text none.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    n = len(text)
    if n <= limit:
        return [(0, n)] if n else []
    marks, spans, start = boundaries(text), [], 0
    while n - start > limit:
        end = 0
        for least in (start + max(limit // 2, overlap), start + overlap):
            for m in marks:
                i = int(np.searchsorted(m, start + limit, side="right")) - 1
                if i >= 0 and m[i] > least:
                    end = int(m[i])
                    break
            if end:
                break
        end = end or start + limit
        spans.append((start, end))
        start = end - overlap
    spans.append((start, n))
    return spans


def split_oversized(df: DataFrame, id_col: str, text_col: str, limit: int = LIMIT, overlap: int = OVERLAP, keep_small: bool = False) -> DataFrame:
    """(id, piece_no, start, end, piece): the pieces of each text, numbered from 1; offsets count code points.

    Only texts longer than ``limit`` come out unless ``keep_small``, with which a shorter non-empty text is one piece;
    null and empty texts give none. Repeated rows of an id come out once, split by the first of its texts in text order.
    Rows without an id are kept under a null id, once per text. Other columns of ``df`` are ignored.
    """
    ship(df.sparkSession)
    size = F.length(text_col)
    df = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(size > (0 if keep_small else limit))
    # Rows without an id are told apart by a digest.
    first = df.groupBy("id", F.when(F.col("id").isNull(), F.xxhash64("text")).alias("h")).agg(F.min("text").alias("text"))

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, s, e, t[s:e]) for i, t in zip(b["id"], b["text"]) for k, (s, e) in enumerate(piece_spans(t, limit, overlap), 1)]
            yield pd.DataFrame(rows, columns=["id", "piece_no", "start", "end", "piece"])

    kind = df.schema["id"].dataType.simpleString()
    return first.select("id", "text").mapInPandas(pieces, f"id {kind}, piece_no int, start int, end int, piece string").withColumnRenamed("id", id_col)
