"""Mixing sources to target weights by systematic sampling.

The documents of a source stand in order of size, largest first.  Their expected copies are summed in that order, one
random offset is added to the sums, and a document is emitted once for each integer boundary that its stretch of the
sum crosses.  A document's expected copies are what its source still needs over what is left of it, in words, at the
start of its size class: documents of more than 1/4, 1/16, 1/64 and 1/256 of the target, and the rest.  That is
target / source size on average, and what chance gives too much or too little of the largest documents, the smaller
ones make up for, so the words taken come near the target at the first and only offset.

A document's place is located by the counts of the (source, size, bucket) cells before it, so a source that holds a
third of all rows is ranked in many tasks; the number of hashed buckets follows the number of rows, so no cell grows
with the input.

Defined cases: a null text has size 0; a text of any length counts whole; a null source is a source of its own, last
in order; sources without words have target 0; documents of one size stand in order of their ids (null first), which
decides ties; repeated rows are drawn one by one; extra columns are kept by ``mixed_documents``; an empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.shared import documents, small, spool, stored_rows

#: Size classes begin at the documents of more than 1 / so much of their source's target.
CLASSES = (4, 16, 64, 256)
#: Rows to each hashed bucket of all cells together.
BUCKET_ROWS = 1_000_000


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(flat == "", F.lit(0)).otherwise(
        F.length(flat) - F.length(F.translate(flat, " ", "")) + 1
    ).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, cap: int = 3) -> DataFrame:
    """source, source_size -> target: ``share`` of all words by weight, at most ``cap`` times a source's size.

    Filling by weight with the excess reshared until nothing is above its cap means target = min(weight * level, cap *
    size) for one common level.  Sources ordered by cap / weight are full up to some point; the level is what is left
    over the weights that are left.  One row per source, ranked in one task: their number is small beside the documents'.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    kinds = F.array(*[F.lit(w) for w in weights])
    x = (
        sizes.withColumn("_i", F.row_number().over(by_name))
        .withColumn("_w", F.element_at(kinds, F.pmod(F.col("_i") - 1, F.lit(len(weights))) + 1).cast("bigint"))
        .withColumn("_cap", F.col("source_size") * cap)
    )
    fill = Window.orderBy((F.col("_cap") / F.col("_w")), "_i")
    x = (
        x.withColumn("_all", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("_cap_before", F.coalesce(F.sum("_cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_w_left", F.sum("_w").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("_level", (F.col("_all") * F.lit(share) - F.col("_cap_before")) / F.col("_w_left"))
        .withColumn("_open", F.col("_level") * F.col("_w") <= F.col("_cap"))
        # the level at the first source that is not full holds for all after it
        .withColumn("_common", F.min(F.when(F.col("_open"), F.struct(F.col("_cap") / F.col("_w"), "_i", "_level"))).over(Window.partitionBy()))
        .withColumn("_common", F.col("_common._level"))
    )
    target = F.when(F.col("_common").isNull(), F.col("_cap").cast("double")).otherwise(
        F.least(F.col("_common") * F.col("_w"), F.col("_cap").cast("double"))
    )
    return x.select("source", "source_size", target.alias("target"))


def ranked_rows(sized: DataFrame, targets: DataFrame, id_col: str) -> DataFrame:
    """``sized`` (with ``source`` and ``size``) and source_size, target, ``_class`` and ``_rank`` in it, from 1."""
    buckets = -(-sized.count() // BUCKET_ROWS) or 1
    x = sized.join(small(targets.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    within = sum(((F.col("size") * c <= F.col("target")).cast("int") for c in CLASSES[1:]), (F.col("size") * CLASSES[0] <= F.col("target")).cast("int"))
    x = x.withColumn("_class", within).withColumn("_bucket", F.pmod(F.xxhash64(id_col), F.lit(buckets)))
    cells = x.groupBy("source", "_class", "size", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("source", "_class").orderBy(F.desc("size"), "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    starts = starts.select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("_bucket").alias("_b"), "_start")
    place = Window.partitionBy("source", "size", "_bucket").orderBy(id_col)
    same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")) & (F.col("_bucket") == F.col("_b"))
    return (
        x.withColumn("_rank", F.row_number().over(place))
        .join(starts, same)
        .withColumn("_rank", F.col("_start") + F.col("_rank"))
        .drop("_s", "_z", "_b", "_bucket", "_start")
    )


def crossed(begin: Column, rate: Column, rank: Column) -> Column:
    """Integer boundaries in the stretch of one document; ``begin``: the sum before the first one of its class."""
    return (F.floor(begin + rate * rank) - F.floor(begin + rate * (rank - 1))).cast("int")


def systematic_copies(sized: DataFrame, targets: DataFrame, id_col: str = "doc_id", seed: str = "mix") -> DataFrame:
    """``sized`` (with ``source`` and ``size``) and source_size, target and ``copies``, by systematic sampling."""
    ranked = spool(ranked_rows(sized, targets, id_col), "mix-ranks")
    digits = F.substring(F.md5(F.concat(F.coalesce(F.col("source"), F.lit("")), F.lit(":" + seed))), 1, 8)
    offset = F.conv(digits, 16, 10).cast("bigint").cast("double") / F.lit(float(2**32))
    zero = F.lit(0).cast("bigint")
    state = targets.select(F.col("source").alias("_s"), "target", offset.alias("_begin"), zero.alias("_taken"), F.col("source_size").alias("_left"))
    rates = None
    for k in range(len(CLASSES) + 1):
        rate = F.least(F.greatest((F.col("target") - F.col("_taken")) / F.col("_left"), F.lit(0.0)), F.lit(3.0))
        state = spool(state.withColumn("_rate", F.when(F.col("_left") > 0, rate).otherwise(F.lit(0.0))), "mix-state")
        own = state.select("_s", F.lit(k).alias("_k"), "_begin", "_rate")
        rates = own if rates is None else rates.unionByName(own)
        taken = (
            ranked.where(F.col("_class") == k)
            .join(small(state.select("_s", "_begin", "_rate")), F.col("source").eqNullSafe(F.col("_s")))
            .groupBy(F.col("source").alias("_t"))
            .agg(
                F.sum(F.col("size") * crossed(F.col("_begin"), F.col("_rate"), F.col("_rank"))).alias("_more"),
                F.sum("size").alias("_words"),
                F.count(F.lit(1)).alias("_n"),
            )
        )
        after = F.col("_begin") + F.col("_rate") * F.coalesce("_n", zero)
        state = state.join(taken, F.col("_s").eqNullSafe(F.col("_t")), "left").select(
            "_s",
            "target",
            (after - F.floor(after)).alias("_begin"),
            (F.col("_taken") + F.coalesce("_more", zero)).alias("_taken"),
            (F.col("_left") - F.coalesce("_words", zero)).alias("_left"),
        )
    mine = F.col("source").eqNullSafe(F.col("_s")) & (F.col("_class") == F.col("_k"))
    copies = crossed(F.col("_begin"), F.col("_rate"), F.col("_rank")).alias("copies")
    return ranked.join(small(rates), mine).select(*sized.columns, "source_size", "target", copies)


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", more: tuple[str, ...] = ()) -> DataFrame:
    """id, source, size, source_size, target and copies of every document, and its columns ``more``."""
    sized = docs.select(F.col(id_col).alias(id_col), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), *more)
    sized = spool(sized, "mix-sizes")  # texts are read once
    targets = spool(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-targets")
    return systematic_copies(sized, targets, id_col)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", stored: bool = False) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it was drawn, with all its columns.

    ``stored``: ``docs`` is what ``spark.read.parquet`` gives, one row for each row of its files.
    """
    rows = stored_rows(docs, stored)
    file, row = F.xxhash64("_locator.file"), F.col("_locator.row")
    drawn = mixed_rows(rows.withColumns({"_file": file, "_row": row}), id_col, more=("_file", "_row")).where("copies > 0")
    drawn = drawn.select("_file", "_row", F.col("copies").alias("_copies"))
    return (
        rows.join(drawn, (file == F.col("_file")) & (row == F.col("_row")))
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
        .select(*docs.columns)
    )


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    rows = mixed_rows(documents(spark, sf_dir))
    return rows.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("bigint").alias("taken")
    )


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1 AS w,
         row_number() OVER (ORDER BY source NULLS LAST) AS i FROM sizes
), f AS (
  SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS total,
         CAST(coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / CAST(w AS DOUBLE), i
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS cap_before,
         CAST(sum(w) OVER (ORDER BY 3 * source_size / CAST(w AS DOUBLE), i
              ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS w_left
  FROM w
), lev AS (
  SELECT *, (total - cap_before) / w_left AS level FROM f
), common AS (
  SELECT first(level ORDER BY 3 * source_size / CAST(w AS DOUBLE), i) AS level FROM lev WHERE level * w <= 3 * source_size
), t AS (
  SELECT source, source_size, CAST(least(coalesce(common.level * w, 3 * source_size), 3 * source_size) AS DOUBLE) AS target
  FROM lev LEFT JOIN common ON true
), r AS (
  SELECT d.doc_id, d.source, d.size, CAST(size * 4 <= target AS INTEGER) + CAST(size * 16 <= target AS INTEGER)
           + CAST(size * 64 <= target AS INTEGER) + CAST(size * 256 <= target AS INTEGER) AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), x AS (
  SELECT *, row_number() OVER (PARTITION BY source, k ORDER BY size DESC, doc_id) AS rank FROM r
), b0 AS (
  SELECT source, target, CAST(CAST('0x' || substr(md5(concat(source, ':mix')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296 AS begin,
         CAST(0 AS BIGINT) AS taken, source_size AS rest FROM t
), """ + ", ".join(
    f"""r{k} AS (
  SELECT *, {k} AS k, CASE WHEN rest > 0 THEN least(greatest((target - taken) / CAST(rest AS DOUBLE), 0), 3) ELSE 0 END AS rate FROM b{k}
), g{k} AS (
  SELECT x.source, count(*) AS n, CAST(sum(size) AS BIGINT) AS words,
         CAST(sum(size * (floor(begin + rate * rank) - floor(begin + rate * (rank - 1)))) AS BIGINT) AS more
  FROM x JOIN r{k} ON x.source IS NOT DISTINCT FROM r{k}.source AND x.k = r{k}.k GROUP BY 1
), b{k + 1} AS (
  SELECT r{k}.source, target, begin + rate * coalesce(n, 0) - floor(begin + rate * coalesce(n, 0)) AS begin,
         taken + coalesce(more, 0) AS taken, rest - coalesce(words, 0) AS rest
  FROM r{k} LEFT JOIN g{k} ON r{k}.source IS NOT DISTINCT FROM g{k}.source
)"""
    for k in range(len(CLASSES) + 1)
) + """, rates AS (""" + " UNION ALL ".join(f"SELECT source, k, begin, rate FROM r{k}" for k in range(len(CLASSES) + 1)) + """)
SELECT x.doc_id, x.size, t.source_size, t.target,
       CAST(x.size * (floor(begin + rate * rank) - floor(begin + rate * (rank - 1))) AS BIGINT) AS taken
FROM x JOIN rates ON x.source IS NOT DISTINCT FROM rates.source AND x.k = rates.k
JOIN t ON x.source IS NOT DISTINCT FROM t.source
"""
