"""Text functions over all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import text as tx
from tessella.queries.base import query, table

CLEAN = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'https?://\S+|www\.\S+', '', 'g'), '\S+@\S+', '', 'g'), '[{}\[\]"\\=#]', ' ', 'g'), '\s+', ' ', 'g'))"""
TOKENS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '')"
FLAT = f"replace({CLEAN}, ' ', '')"
MIXED = r"list_distinct(regexp_extract_all(lower(text), '[A-Za-z0-9_]+|[一-鿿]'))"


@query("txt_clean", f"SELECT doc_id, md5({CLEAN}) AS cleaned FROM documents")
def txt_clean(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.clean_text(F.col("text"))).alias("cleaned"))


@query("txt_tokens", f"SELECT doc_id, CAST(len({TOKENS}) AS BIGINT) AS n, {TOKENS}[1] AS first_token, md5(array_to_string({TOKENS}, ' ')) AS joined FROM documents")
def txt_tokens(spark, sf_dir):
    t = tx.tokenize(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("bigint").alias("n"), F.get(t, F.lit(0)).alias("first_token"), F.md5(F.array_join(t, " ")).alias("joined"))


@query("txt_ngrams", f"SELECT gram, COUNT(*) AS n FROM (SELECT unnest(list_transform(range(1, greatest(length(flat), 2)), lambda i: array_slice(flat, CAST(i AS BIGINT), CAST(i + 1 AS BIGINT)))) AS gram FROM (SELECT {FLAT} AS flat FROM documents) WHERE length(flat) > 0) GROUP BY 1")
def txt_ngrams(spark, sf_dir):
    grams = table(spark, sf_dir, "documents").select(F.explode(tx.char_ngrams(F.col("text"))).alias("gram"))
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


@query("txt_jaccard", f"WITH d AS (SELECT doc_id, {MIXED} AS t FROM documents), q AS (SELECT list_distinct(regexp_extract_all(lower('the of and in to with'), '[a-z]+')) AS q) SELECT doc_id, round(CASE WHEN len(t) = 0 THEN 0 ELSE len(list_intersect(t, q)) / CAST(len(list_distinct(list_concat(t, q))) AS DOUBLE) END, 9) AS similarity FROM d, q")
def txt_jaccard(spark, sf_dir):
    asked = tx.mixed_tokens(F.lit("the of and in to with"))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(tx.jaccard(tx.mixed_tokens(F.col("text")), asked), 9).alias("similarity"))


@query("txt_core_hits", "SELECT doc_id, CAST(contains(lower(text), 'idiot') AS INTEGER) + CAST(contains(lower(text), 'licensed') AS INTEGER) + CAST(contains(lower(text), 'token') AS INTEGER) AS hits FROM documents")
def txt_core_hits(spark, sf_dir):
    core = tx.core_tokens(F.array(F.lit("Idiot the licensed"), F.lit("TOKEN a idiot")), light=("the",))
    return table(spark, sf_dir, "documents").select("doc_id", tx.core_hits(F.col("text"), core).alias("hits"))


@query("txt_hash_redact", "SELECT doc_id, substr(sha256(text), 1, 12) AS hashed FROM documents")
def txt_hash_redact(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.redacted(F.col("text")).alias("hashed"))


@query("txt_json_merge", """SELECT event_id, json_extract_string(props, '$.k') AS k, event_type AS kind FROM events""")
def txt_json_merge(spark, sf_dir):
    """Metadata merged into JSON text: absent keys are added, present ones stay."""
    merged = tx.merged_json(F.create_map(F.lit("k"), F.lit("metadata never wins"), F.lit("kind"), F.col("event_type")), F.col("props"))
    x = table(spark, sf_dir, "events").select("event_id", merged.alias("j"))
    return x.select("event_id", F.get_json_object("j", "$.k").alias("k"), F.get_json_object("j", "$.kind").alias("kind"))


@query("txt_preview_page", "SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 20 + 1 AS INTEGER) AS page FROM documents QUALIFY page = 3")
def txt_preview_page(spark, sf_dir):
    """The third page of twenty documents, by id."""
    docs = table(spark, sf_dir, "documents").orderBy("doc_id").offset(40).limit(20)
    return docs.select("doc_id", tx.preview(F.col("text")).alias("preview"), F.lit(3).alias("page"))


@query("txt_identifier", "SELECT n_nationkey, CASE WHEN x = '' OR regexp_matches(x, '^[0-9]') THEN 't_' || x ELSE x END AS identifier FROM (SELECT n_nationkey, lower(regexp_replace(regexp_replace(n_name || '  (' || n_regionkey || ')', '[^A-Za-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g')) AS x FROM nation)")
def txt_identifier(spark, sf_dir):
    name = F.concat("n_name", F.lit("  ("), "n_regionkey", F.lit(")"))
    return table(spark, sf_dir, "nation").select("n_nationkey", tx.identifier(name).alias("identifier"))


@query("txt_squeeze_exact", r"SELECT trim(regexp_replace(text, '\s+', ' ', 'g')) AS question, COUNT(*) AS n, MIN(doc_id) AS first_id FROM documents GROUP BY 1 HAVING COUNT(*) > 1")
def txt_squeeze_exact(spark, sf_dir):
    """Texts that are the same but for white space."""
    docs = table(spark, sf_dir, "documents").groupBy(tx.squeeze(F.col("text")).alias("question"))
    return docs.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("txt_uuid5")
def txt_uuid5(spark, sf_dir):
    """Stable version-5 ids; tested against Python's uuid."""
    return table(spark, sf_dir, "benchmark").select("item_id", tx.stable_uuid(F.col("text")).alias("uuid"))


@query("ret_simhash_pairs")
def ret_simhash_pairs(spark, sf_dir):
    """SimHash similarity of each benchmark item with the item after it."""
    x = table(spark, sf_dir, "benchmark").withColumn("bits", tx.simhash_bits(F.col("text")))
    # benchmark items are numbered without gaps, so the next item is a join by number
    y = x.select((F.col("item_id") - 1).alias("item_id"), F.col("bits").alias("other"))
    return x.join(y, "item_id").select("item_id", F.round(tx.simhash_similarity(F.col("bits"), F.col("other")), 6).alias("similarity"))


