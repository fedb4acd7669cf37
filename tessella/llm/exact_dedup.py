"""Exact deduplication as a stream with keyed state on disk.

Every row is reduced to (digest of its whole text, identifier, locator); the locator names the file and the row in it
where the text stands.  These narrow rows are the source of a Structured Streaming aggregation whose state (RocksDB,
one entry per digest, no watermark and so no expiry) holds the number of rows and the largest (identifier, locator)
seen.  Rows that share a digest are hits: their bytes are fetched by locator and compared in full, and a digest that
two different texts share is split by text.

Defined cases: a null text counts as the empty text; null identifiers are smaller than all others; of repeated rows
with the same identifier and text exactly one is kept; a text of any length is digested and compared whole; extra
columns are not read by ``exact_dedup`` and kept by ``deduplicated``; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import discard, documents, shared_folder, spool, stored_rows

#: The state is on disk; its files take no space before it is filled, as a state is small beside its number of parts.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def whole(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def update_state(rows_path: str, schema, state_path: str, out_path: str, spark) -> DataFrame:
    """Run the stream over all files of ``rows_path`` not yet seen by the state in ``state_path``; all groups so far.

    The same state path may be used again after files were added: only those are read, and their rows meet the
    entries of earlier runs.
    """
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        counted = (
            spark.readStream.schema(schema)
            .parquet(rows_path)
            .groupBy("digest")
            .agg(F.max(F.struct("id", "locator")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
        )

        def put(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out_path}/run={number}")

        counted.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", state_path).trigger(
            availableNow=True
        ).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    keep = "struct<id: {}, locator: {}>".format(schema["id"].dataType.simpleString(), schema["locator"].dataType.simpleString())
    # an entry's count and largest row only grow, so its latest version is the largest
    return (
        spark.read.schema(f"digest binary, keep {keep}, group_size bigint, run bigint")
        .option("mergeSchema", "false")
        .parquet(out_path)
        .groupBy("digest")
        .agg(F.max("keep").alias("keep"), F.max("group_size").alias("group_size"))
    )


def found_rows(base: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """``base`` (id, text, locator) -> id, locator, digest, keep_id, group_size, kept."""
    spark = base.sparkSession
    rows_path, state_path, groups_path, latest_path = (shared_folder(spark, f"dedup-{x}") for x in ("rows", "state", "groups", "latest"))
    rows = spool(base.select("id", "locator", digest(F.col("text")).alias("digest")), "dedup-rows", rows_path)
    # a written table, so that a digest of very many rows can be split when rows and groups are joined
    groups = spool(update_state(rows_path, rows.schema, state_path, groups_path, spark), "dedup-latest", latest_path)
    found = spool(rows.join(groups, "digest").select("id", "locator", "digest", "keep", "group_size"), "dedup-found")
    discard(spark, rows_path, state_path, groups_path, latest_path)

    # full bytes on hits, fetched by locator; copies collapse before they move on, so a hot group stays small
    hits = found.where("group_size > 1").select("locator", F.col("digest").alias("hit"))
    texts = base.select("locator", "text").join(hits, "locator").groupBy("hit", "text").agg(F.lit(1))
    clashes = spool(texts.groupBy("hit").count().where("count > 1").select(F.col("hit").alias("digest")), "dedup-clashes")
    kept = (F.col("locator") == F.col("keep.locator")).alias("kept")
    plain = found.select("id", "locator", "digest", F.col("keep.id").alias("keep_id"), "group_size", kept)
    if clashes.isEmpty():
        return plain
    # different texts under one digest: group those rows by text itself
    split = found.join(clashes, "digest", "left_semi").select("id", "locator", "digest").join(base.select("locator", "text"), "locator")
    by_text = split.groupBy("digest", "text").agg(F.max(F.struct("id", "locator")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    apart = split.join(by_text, ["digest", "text"]).select("id", "locator", "digest", F.col("keep.id").alias("keep_id"), "group_size", kept)
    return plain.join(clashes, "digest", "left_anti").select(*plain.columns).unionByName(apart)


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    stored: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: id, digest (binary), keep_id, group_size, kept.

    Of rows with equal texts the one with the largest id is kept.  ``stored``: ``docs`` is what ``spark.read.parquet``
    gives, one row for each row of its files, so that its own files are the content store.
    """
    base = stored_rows(docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text")), stored)
    found = found_rows(base.withColumnRenamed("_locator", "locator"), digest)
    return found.select("id", "digest", "keep_id", "group_size", "kept")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stored: bool = False) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; of rows equal in id and text any one stays."""
    rows = stored_rows(docs, stored)
    base = rows.select(F.col(id_col).alias("id"), whole(text_col).alias("text"), F.col("_locator").alias("locator"))
    kept = found_rows(base, sha256).where("kept").select(F.col("locator").alias("_kept"))
    return rows.join(kept, F.col("_locator") == F.col("_kept"), "left_semi").select(*docs.columns)


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir), stored=True).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


OP10_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
