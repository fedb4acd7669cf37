"""Rendezvous hashing of stable record keys over weighted shards.

Each (key, shard) pair gets a pseudo-random number u in (0, 1) from the MD5 digest of both; a key goes to the shard
with the largest ln(u) / weight.  Adding a shard moves rows only into it, in proportion to its weight, and a shard's
changed weight moves rows only into or out of that shard.

Defined cases: a null key hashes as the empty string; a null text has no bytes and the checksum of the empty text;
repeated rows share a shard and get different slots; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.shared import documents

#: 52 bits of the digest fill a double exactly.
HEX_DIGITS, SCALE = 13, float(2**52)


def shard_scores(key: Column, weights: Sequence[float]) -> list[Column]:
    """One score per shard; the largest wins."""
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("weights must be positive")
    text = F.coalesce(key.cast("string"), F.lit(""))
    scores = []
    for shard, weight in enumerate(weights):
        digits = F.substring(F.md5(F.concat(text, F.lit(f":{shard}"))), 1, HEX_DIGITS)
        u = (F.conv(digits, 16, 10).cast("bigint").cast("double") + 0.5) / F.lit(SCALE)
        scores.append(F.log(u) / F.lit(float(weight)))
    return scores


def rendezvous(docs: DataFrame, key_col: str, weights: Sequence[float], added: Sequence[float] = ()) -> DataFrame:
    """``docs`` with ``shard`` over ``weights`` and, if shards are ``added``, ``grown_shard`` over both."""
    scores = F.array(*shard_scores(F.col(key_col), [*weights, *added]))
    out = docs.withColumn("_scores", scores)
    first = F.slice("_scores", 1, len(weights))
    out = out.withColumn("shard", (F.array_position(first, F.array_max(first)) - 1).cast("int"))
    grown = F.lit(None).cast("int")
    if added:
        grown = (F.array_position("_scores", F.array_max("_scores")) - 1).cast("int")
    return out.withColumn("grown_shard", grown).drop("_scores")


def slots(docs: DataFrame, order: Sequence[str], rows_per_bucket: int = 50_000) -> DataFrame:
    """``docs`` with ``slot``: 0, 1, ... within each shard.

    A shard is dealt into hashed buckets that are numbered apart; a bucket's first slot is the number of rows in the
    buckets before it.  The number of buckets follows the number of rows, so no task holds a whole shard.
    """
    buckets = max(1, -(-docs.count() // rows_per_bucket))
    docs = docs.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = docs.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("shard", "_bucket").orderBy(*order)
    return (
        docs.withColumn("_rank", F.row_number().over(within))
        .join(starts, ["shard", "_bucket"])
        .withColumn("slot", F.col("_start") + F.col("_rank") - 1)
        .drop("_bucket", "_rank", "_start")
    )


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents over 40 shards of equal weight, keyed by doc_id; ``grown_shard`` is the shard among 41."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents(spark, sf_dir).select(
        "doc_id",
        (F.octet_length(text).cast("bigint") + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    dealt = rendezvous(rows, "doc_id", [1.0] * 40, added=[1.0])
    return slots(dealt, ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
