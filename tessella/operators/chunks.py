"""Documents in chunks: cut, merged with neighbours, put together again."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Most tokens of a chunk, and how far behind and ahead a sentence end is looked for.
MOST_TOKENS, LOOK_BACK, LOOK_AHEAD = 5000, 200, 800
SENTENCE_ENDS = "。！？!?；;"
INTERNAL_KEYS = ("chunk_index", "chunk_total", "parent_id", "chunk_type", "chunk_id")


def token_windows(tokens: list, size: int) -> list[list]:
    return [tokens[i : i + size] for i in range(0, len(tokens), size)]


def cut_text(text: str, most: int = MOST_TOKENS, back: int = LOOK_BACK, ahead: int = LOOK_AHEAD) -> list[str]:
    """Whole if it has at most ``most`` tokens; else windows of ``most`` characters that end with a sentence."""
    if len(text.split()) <= most and len(text) / 4 <= most:
        return [text.strip()] if text.strip() else []
    out, start = [], 0
    while start < len(text):
        end = min(start + most, len(text))
        if end < len(text):
            at = next((i for i in range(max(start + 1, end - back), min(len(text), end + ahead)) if text[i] in SENTENCE_ENDS and i + 1 >= end), None)
            end = at + 1 if at is not None else min(len(text), end + ahead)
        piece = text[start:end].strip()
        if piece:
            out.append(piece)
        start = end
    return out


def chunked(docs: DataFrame, most: int = MOST_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """chunk_id, parent_id, chunk_index, chunk_total, chunk_type, text."""

    @F.pandas_udf("array<string>")
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            yield series.fillna("").map(lambda t: cut_text(t, most))

    parts = docs.select(F.col(id_col).cast("string").alias("parent_id"), cut(F.col(text_col)).alias("parts"))
    return parts.select(
        "parent_id", F.size("parts").alias("chunk_total"), F.posexplode("parts").alias("chunk_index", "text")
    ).select(
        F.concat("parent_id", F.lit("-"), F.col("chunk_index").cast("string")).alias("chunk_id"), "parent_id", "chunk_index", "chunk_total",
        F.lit("text").alias("chunk_type"), "text",
    )


def with_neighbours(chunks: DataFrame, around: int = 1) -> DataFrame:
    """``context``: each chunk's text with the chunks before and after it; JSON chunks get all of their document."""
    near = Window.partitionBy("parent_id").orderBy("chunk_index").rowsBetween(-around, around)
    whole = Window.partitionBy("parent_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    join = lambda w: F.array_join(F.collect_list("text").over(w), "\n")
    return chunks.withColumn("context", F.when(F.col("chunk_type") == "json", join(whole)).otherwise(join(near)))


def reassembled(chunks: DataFrame) -> DataFrame:
    """parent_id and the whole text, chunks joined by line breaks in order of their index."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "text")))
    return chunks.groupBy("parent_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"), F.count(F.lit(1)).alias("n_chunks"))


def max_pooled(scores: DataFrame) -> DataFrame:
    """A document's score is its best chunk's, 0 without any."""
    return scores.groupBy("qid", "parent_id").agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("score"))


def mean_pooled(vectors: DataFrame) -> DataFrame:
    """The mean of the chunk vectors of each parent."""
    each = vectors.select("parent_id", F.posexplode("embedding").alias("i", "x"))
    means = each.groupBy("parent_id", "i").agg(F.avg("x").alias("x"))
    return means.groupBy("parent_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("embedding"))
