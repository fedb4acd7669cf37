"""Connected components by alternating large and small stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import discard, shared_folder, spool


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long) -> node, root for every node on an edge; root is the component's smallest node.

    Each round moves every node's larger neighbours, then the smaller ones, to its smallest neighbour; in the end
    each component is a star round its smallest node.  A round is written to the shared folder before the next reads
    it, so that neither lineage nor plans grow, and removed after that.  Loops and repeated edges are allowed; no edges
    give no rows.
    """
    spark = edges.sparkSession
    path = shared_folder(spark, "cc")
    stars = spool(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "cc", path
    )
    state = _state(stars)
    while state[0]:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        before, path = path, shared_folder(spark, "cc")
        stars = spool(small, "cc", path)
        discard(spark, before)
        last, state = state, _state(stars)
        if last == state:
            break
    nodes = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(stars: DataFrame) -> tuple:
    """Equal for equal sets of edges."""
    row = stars.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h"),
        F.sum(F.xxhash64("v", "u").cast("decimal(20,0)")).alias("k"),
    ).first()
    return row["n"], row["h"], row["k"]
