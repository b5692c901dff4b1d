"""Retrieval: text splitting for a knowledge base, exact vector top-k, metadata filters, reranking."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.predicates import metadata_filter
from lodestrata.session import ship

QUERY_BLOCK = 2_000
#: Numbers that a worker holds at once while it takes differences.
DIFFERENCES = 4_000_000


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, vec_id, dist, rank): the k vectors with the least squared distance to each query, ties by id. Exact.

    vectors: (vec_id, embedding), queries: (query_id, embedding). The queries are taken in blocks of a bounded size; each block meets
    all vectors in one pass, in which every partition keeps its own k best per query, so only those are shuffled. Null and empty
    vectors, and those of another dimension than the query, are no candidates.
    """
    spark = vectors.sparkSession
    n = queries.where("query_id is not null and size(embedding) > 0").select("query_id", "embedding").distinct()
    total = n.count()
    blocks = -(-total // block)
    out = None
    for b in range(blocks):
        rows = n.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()
        dims = {len(r["embedding"]) for r in rows}
        for dim in sorted(dims):
            own = [r for r in rows if len(r["embedding"]) == dim]
            shared = spark.sparkContext.broadcast((np.array([r["query_id"] for r in own]), np.array([r["embedding"] for r in own], dtype=np.float64)))
            part = _nearest_block(vectors.where(F.size("embedding") == dim), shared, k)
            out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "query_id bigint, vec_id bigint, dist double, rank int")
    w = Window.partitionBy("query_id").orderBy("dist", "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _nearest_block(vectors: DataFrame, shared, k: int) -> DataFrame:
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = shared.value
        best_d, best_i = np.full((len(ids), 0), np.inf), np.zeros((len(ids), 0), dtype=np.int64)
        for b in batches:
            if not len(b):
                continue
            v = np.stack(b["embedding"].to_numpy()).astype(np.float64)
            vid = b["vec_id"].to_numpy(dtype=np.int64)
            d = np.empty((len(ids), len(v)))
            step = max(1, DIFFERENCES // v.size)
            for a in range(0, len(ids), step):
                d[a : a + step] = ((q[a : a + step, None, :] - v[None, :, :]) ** 2).sum(axis=2)
            d, i = np.concatenate([best_d, d], axis=1), np.concatenate([best_i, np.broadcast_to(vid, (len(ids), len(vid)))], axis=1)
            order = np.lexsort((i, d), axis=1)[:, :k]
            best_d, best_i = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
        m = best_d.shape[1]
        yield pd.DataFrame({"query_id": np.repeat(ids, m).astype(np.int64), "vec_id": best_i.ravel(), "dist": best_d.ravel()})

    ship(vectors.sparkSession)
    return vectors.select("vec_id", "embedding").mapInPandas(search, "query_id bigint, vec_id bigint, dist double")


def search(vectors: DataFrame, queries: DataFrame, top_k: int, conditions: dict[str, str] | None = None, prefilter: bool = False) -> DataFrame:
    """(query_id, vec_id, rank): the nearest ``3 * top_k`` vectors, of those the ones that meet the conditions, of those the first ``top_k`` [T5].

    The filter comes after the cut, so fewer than top_k may be left; with ``prefilter`` it comes first.
    """
    conditions = conditions or {}
    pool = metadata_filter(vectors, conditions) if prefilter else vectors
    hits = nearest(pool, queries, top_k if prefilter else 3 * top_k)
    if not prefilter and conditions:
        meta = metadata_filter(vectors, conditions).select("vec_id")
        hits = hits.join(meta, "vec_id", "left_semi")
    w = Window.partitionBy("query_id").orderBy("dist", "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k).select("query_id", "vec_id", "rank")


def rerank(hits: DataFrame, scores: DataFrame, limit: int) -> DataFrame:
    """(query_id, vec_id, rank, new_rank): hits by score, best first; unknown and repeated scores are ignored, hits without a score follow in their order [T7]."""
    s = scores.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), "rank")
    return hits.join(s, ["query_id", "vec_id"], "left").withColumn("new_rank", F.row_number().over(w)).where(F.col("new_rank") <= limit).select("query_id", "vec_id", "rank", "new_rank")


def embedding_batches(df: DataFrame, id_col: str, size: int = 10) -> DataFrame:
    """df with ``batch``: rows in id order, ``size`` to a batch [B11]. Ranks are counted per block of ids and offset by the blocks below."""
    width = 100_000
    blocks = df.withColumn("_block", F.floor(F.col(id_col) / width))
    counts = blocks.groupBy("_block").agg(F.count("*").alias("_n"))
    base = counts.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    k = F.row_number().over(Window.partitionBy("_block").orderBy(id_col)) - 1
    return blocks.withColumn("_k", k).join(base, "_block").withColumn("batch", F.floor((F.col("_base") + F.col("_k")) / size)).drop("_block", "_base", "_k")


_HEADING = re.compile(r"(?:^|\n)(#+) ")
_NUMBERED = re.compile(r"\n(\d+)\.")


def split_spans(text: str, most: int = 1000, window: int = 200, overlap: int = 100, nearest_heading: bool = False) -> list[tuple[int, int, str]]:
    """(start, end, reason) of the pieces of a text [B12].

    A piece ends, within ``window`` characters of ``most``, at a heading (fewest signs first), ahead of a numbered line
    (least number first), behind a blank line, behind a sentence end, statement end or blank; else it is cut at ``most``. Among equal
    headings the one farthest from ``most`` is taken, as published; ``nearest_heading`` takes the nearest. The next
    piece starts ``overlap`` characters earlier, but never at or before the start of the one ahead.
    """
    spans, start, n = [], 0, len(text)
    sign = 1 if nearest_heading else -1
    while start < n:
        if n - start <= most:
            spans.append((start, n, "end"))
            break
        piece = text[start : start + most + window]
        left, right = max(0, most - window), min(len(piece), most + window)
        end, reason = 0, ""
        for pattern, name in ((_HEADING, "heading"), (_NUMBERED, "number")):
            found = []
            for m in pattern.finditer(piece):
                pos = m.start(1)
                if left < pos <= right:
                    found.append((len(m.group(1)) if name == "heading" else int(m.group(1)), sign * abs(pos - most), pos))
            if found:
                end, reason = min(found)[2], name
                break
        if not end:
            at = piece.rfind("\n\n", max(left - 1, 0), min(right, len(piece) - 1))
            if at > 0 and at + 2 > left:
                end, reason = at + 2, "blank line"
        if not end:
            for i in range(min(right, len(piece) - 1), left, -1):
                if piece[i - 1] in "。.};\n ":
                    end, reason = i, "mark"
                    break
        if not end:
            end, reason = most, "cut"
        spans.append((start, start + end, reason))
        start = max(start + end - overlap, start + 1)
    return spans


def split_texts(df: DataFrame, id_col: str, text_col: str, most: int = 1000, window: int = 200, overlap: int = 100) -> DataFrame:
    """(id, chunk, start, end, start_line, end_line, reason, content): the trimmed, non-empty pieces with offsets and lines [B12, B14].

    Lines come from the offsets, so a piece that occurs twice in a text is placed right.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t in zip(b["id"], b["text"]):
                k = 0
                for s, e, why in split_spans(t, most, window, overlap):
                    piece = t[s:e].strip()
                    if piece:
                        rows.append((i, k, s, e, t.count("\n", 0, s) + 1, t.count("\n", 0, e) + 1, why, piece))
                        k += 1
            yield pd.DataFrame(rows, columns=["id", "chunk", "start", "end", "start_line", "end_line", "reason", "content"])

    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null and text <> ''")
    kind = src.schema["id"].dataType.simpleString()
    ship(src.sparkSession)
    return src.mapInPandas(run, f"id {kind}, chunk int, start int, end int, start_line int, end_line int, reason string, content string").withColumnRenamed("id", id_col)


def heading_paragraphs(text: Column) -> Column:
    """The parts of a text that begin with a heading line (one whose trimmed text starts with ``#``), as an array [B13]."""
    lines = F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")
    none = F.array().cast("array<string>")

    def add(acc: Column, line: Column) -> Column:
        opens = F.trim(line).startswith("#") | (F.size(acc) == 0)
        last = F.element_at(acc, -1)
        return F.when(opens, F.concat(acc, F.array(line))).otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(last, F.lit("\n"), line))))

    parts = F.aggregate(lines, none, add)
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p.startswith("#"))


def experience_hits(vectors: DataFrame, queries: DataFrame, n: int, text: str, most_chars: int = 800) -> DataFrame:
    """(query_id, rank, text): the first n non-blank texts among the 2n nearest, cut to a length [H10]."""
    hits = nearest(vectors, queries, 2 * n).join(vectors.select("vec_id", F.col(text).alias("text")), "vec_id").where(F.trim("text") != "")
    w = Window.partitionBy("query_id").orderBy("dist", "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("query_id", "rank", F.substring("text", 1, most_chars).alias("text"))
