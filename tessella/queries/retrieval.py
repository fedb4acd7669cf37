"""Hybrid retrieval over all documents and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import text as tx
from tessella.functions import vector as vx
from tessella.operators import chunks, search
from tessella.operators import retrieval as rt
from tessella.operators.where import where_column
from tessella.queries.base import query, table

#: The query set of the text searches, which grows with its table: every twentieth benchmark item, its whole text.
TOKENS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '')"
ASKED_SQL = "(SELECT CAST(item_id AS VARCHAR) AS qid, text AS query FROM benchmark WHERE item_id % 20 = 0) q"
QUERY_TOKENS = TOKENS.replace("text", "query")
BM25_SQL = f"""
w AS MATERIALIZED (SELECT doc_id, {TOKENS} AS ts FROM documents),
p AS (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM w),
t AS (SELECT doc_id, dl, term, count(*) AS tf FROM p GROUP BY ALL),
s AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM w),
i AS (SELECT term, ln(s.n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM t, s GROUP BY term, s.n),
e AS (SELECT 0.25 * avg(raw) AS floor FROM i),
idf AS (SELECT term, CASE WHEN raw < 0 THEN e.floor ELSE raw END AS idf FROM i, e),
qt AS (SELECT qid, unnest({QUERY_TOKENS}) AS term FROM {ASKED_SQL}),
qc AS (SELECT qid, term, count(*) AS qtf FROM qt GROUP BY ALL),
bm AS (SELECT qid, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / s.avgdl))) AS score
       FROM qc JOIN idf USING (term) JOIN t USING (term), s GROUP BY qid, doc_id HAVING score > 0)"""
CLEAN_FLAT = r"""replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, 'https?://\S+|www\.\S+', '', 'g'), '\S+@\S+', '', 'g'), '[{{}}\[\]"\\=#]', ' ', 'g'), '\s+', ' ', 'g')), ' ', '')"""
NGRAM_SQL = f"""
qf AS (SELECT qid, {CLEAN_FLAT.format(c="query")} AS f FROM {ASKED_SQL}),
qg AS (SELECT DISTINCT qid, unnest(list_transform(range(1, greatest(length(f), 2)), lambda i: substr(f, CAST(i AS BIGINT), 2))) AS gram FROM qf),
qn AS (SELECT qid, count(*) AS wanted FROM qg GROUP BY qid),
d AS (SELECT doc_id, {CLEAN_FLAT.format(c="text")} AS f FROM documents),
ng AS (SELECT qg.qid, d.doc_id, count(*) / CAST(any_value(wanted) AS DOUBLE) AS score FROM qg JOIN qn USING (qid) JOIN d ON contains(d.f, qg.gram)
       GROUP BY qg.qid, d.doc_id HAVING count(*) >= least(2, any_value(wanted)))"""
SUB_SQL = f"""
sb AS (SELECT qid, doc_id, 0.7 / (1 + (instr(lower(text), lower(query)) - 1) / CAST(length(text) AS DOUBLE)) + 0.3 * length(query) / length(text) AS score
       FROM documents, {ASKED_SQL} WHERE instr(lower(text), lower(query)) > 0)"""


def top(name: str, k: int) -> str:
    return f"SELECT qid, doc_id, round(score, 6) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM {name}) WHERE rank <= {k}"


def asked(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").cast("string").alias("qid"), F.col("text").alias("query"))


def ranked(df, k):
    return rt.top_k(df, k).select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")


def bm25(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return rt.bm25_scores(rt.bm25_index(docs), asked(spark, sf_dir)).withColumn("score", F.round("score", 9))


@query("ret_bm25_topk", f"WITH {BM25_SQL}, r AS (SELECT qid, doc_id, round(score, 9) AS score FROM bm) {top('r', 10)}")
def ret_bm25_topk(spark, sf_dir):
    return ranked(bm25(spark, sf_dir), 10)


@query("ret_batch_queries", f"WITH {BM25_SQL} SELECT qid, CAST(count(*) AS BIGINT) AS found, round(max(score), 6) AS best FROM bm GROUP BY qid")
def ret_batch_queries(spark, sf_dir):
    """A block of queries against all documents in one join."""
    return bm25(spark, sf_dir).groupBy("qid").agg(F.count(F.lit(1)).alias("found"), F.round(F.max("score"), 6).alias("best"))


@query("ret_ngram_topk", f"WITH {NGRAM_SQL} {top('ng', 10)}")
def ret_ngram_topk(spark, sf_dir):
    return ranked(rt.ngram_scores(rt.ngram_index(table(spark, sf_dir, "documents")), asked(spark, sf_dir)), 10)


#: Whole documents as queries: every twentieth, in all documents that hold it.
SUB_DOCS_SQL = SUB_SQL.replace(ASKED_SQL, "(SELECT CAST(doc_id AS VARCHAR) AS qid, trim(text) AS query FROM documents WHERE doc_id % 20 = 0 AND trim(text) <> '') q").replace(
    "SELECT qid, doc_id, 0.7", "SELECT qid, d.doc_id, 0.7").replace("FROM documents, ", "FROM documents d, ")


@query("ret_substring_topk", f"WITH {SUB_DOCS_SQL} {top('sb', 10)}")
def ret_substring_topk(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    wanted = docs.where("doc_id % 20 = 0").select(F.col("doc_id").cast("string").alias("qid"), F.col("text").alias("query"))
    # queries of one text have one list
    same = F.trim("query").alias("_text")
    first = wanted.groupBy(same).agg(F.min("qid").alias("qid"), F.min("query").alias("query"))
    copies = wanted.join(first.select("_text", F.col("qid").alias("_first")), F.trim("query") == F.col("_text")).select(F.col("qid").alias("_qid"), "_first")
    found = ranked(rt.substring_scores(docs, first.select("qid", "query")), 10)
    return found.join(copies, F.col("qid") == F.col("_first")).select(F.col("_qid").alias("qid"), "doc_id", "score", "rank")


#: The query set of the vector searches: every twentieth vector.
VEC_SQL = """
v AS (SELECT CAST(a.vec_id AS VARCHAR) AS qid, b.vec_id AS doc_id,
      {score} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)"""
L2 = "1 - list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (CAST(p[1] AS DOUBLE) - p[2]) * (CAST(p[1] AS DOUBLE) - p[2])))"
COS = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: CAST(p[1] AS DOUBLE) * p[2])) / (sqrt(list_sum(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform(b.embedding, lambda x: CAST(x AS DOUBLE) * x))))"


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def asked_vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").cast("string").alias("qid"), "embedding")


def nearest(spark, sf_dir, metric):
    found = rt.vector_top_k(vectors(spark, sf_dir), asked_vectors(spark, sf_dir), 8, metric)
    return found.select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("ret_vector_topk", f"WITH {VEC_SQL.format(score=L2)} {top('v', 8)}")
def ret_vector_topk(spark, sf_dir):
    return nearest(spark, sf_dir, "l2sq")


@query("ret_vector_all_topk", f"WITH {VEC_SQL.format(score=L2)} {top('v', 8)}")
def ret_vector_all_topk(spark, sf_dir):
    return nearest(spark, sf_dir, "l2sq")


@query("ret_vector_all_cosine", f"WITH {VEC_SQL.format(score=COS)} {top('v', 8)}")
def ret_vector_all_cosine(spark, sf_dir):
    return nearest(spark, sf_dir, "cosine")


@query("ret_vector_cosine", f"WITH {VEC_SQL.format(score=COS)} {top('v', 8)}")
def ret_vector_cosine(spark, sf_dir):
    return nearest(spark, sf_dir, "cosine")


@query("ret_label_centroids", "SELECT label, CAST(i AS INTEGER) AS i, round(avg(CAST(x AS DOUBLE)), 6) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY 1, 2")
def ret_label_centroids(spark, sf_dir):
    """Mean-pooled vectors, each label's embeddings standing for the chunks of one document."""
    pooled = chunks.mean_pooled(table(spark, sf_dir, "embeddings").select(F.col("label").alias("parent_id"), F.col("embedding").cast("array<double>").alias("embedding")))
    return pooled.select(F.col("parent_id").alias("label"), F.posexplode("embedding").alias("i", "x")).select("label", "i", F.round("x", 6).alias("x"))


def corpus(spark, sf_dir):
    """Documents, with the vector of the same number where there is one."""
    return search.Corpus(table(spark, sf_dir, "documents"), vectors(spark, sf_dir), light=("the",))


def fused_lists(spark, sf_dir, mode):
    c, q = corpus(spark, sf_dir), asked(spark, sf_dir)
    channels = search.recall(c, q, 20, mode, asked_vectors(spark, sf_dir))
    core = q.select("qid", tx.core_tokens(F.array("query"), light=c.light).alias("core"))
    return rt.fused(rt.merge_channels(channels), c.docs.select("doc_id", "text"), core, mode)


CORE_SQL = f"c AS (SELECT qid, list_filter(list_distinct({QUERY_TOKENS.replace('query', 'lower(query)')}), lambda w: length(w) >= 2 AND w <> 'the') AS core FROM {ASKED_SQL})"


def _mm(c: str) -> str:
    return f"CASE WHEN max({c}) OVER w = min({c}) OVER w THEN 0 ELSE ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) END"


def _top20(name: str) -> str:
    return f"(SELECT qid, doc_id, score FROM {name} QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) <= 20)"


def fusion_sql(weights: str, channels: dict[str, str], keep: str) -> str:
    """Candidates of some channels (name -> rows), min-max scores sm, b, g, s of all four, penalties, and what is kept."""
    union = " UNION ALL ".join("SELECT qid, doc_id, " + ", ".join("score" if n == c else "NULL" for n in ("sv", "bm", "ng", "sb")) + f" FROM {_top20(rows)}" for c, rows in channels.items())
    more = (f", {NGRAM_SQL}" if "ng" in channels else "") + (f", {SUB_SQL}" if "sb" in channels else "")
    return f"""
WITH {BM25_SQL}{more}, {CORE_SQL}, {VEC_SQL.format(score=L2)}, b9 AS (SELECT qid, doc_id, score FROM bm),
vq AS (SELECT v.* FROM v JOIN c USING (qid)),
m AS (SELECT qid, doc_id, max(sv) AS sv, max(bm) AS bm, max(ng) AS ng, max(sb) AS sb FROM ({union}) x(qid, doc_id, sv, bm, ng, sb) GROUP BY qid, doc_id),
z AS (SELECT qid, doc_id, sv AS sv0, greatest(coalesce(sv, 0), 0) AS sv, coalesce(bm, 0) AS bm, coalesce(ng, 0) AS ng, coalesce(sb, 0) AS sb FROM m),
n AS (SELECT *, {_mm('sv')} AS sm, {_mm('bm')} AS b, {_mm('ng')} AS g, {_mm('sb')} AS s FROM z WINDOW w AS (PARTITION BY qid)),
h AS (SELECT n.*, text, len(core) AS asked, len(list_filter(core, lambda x: contains(lower(text), x))) AS hits FROM n JOIN documents USING (doc_id) JOIN c USING (qid)),
f AS (SELECT *, greatest(0, least(1, {weights} - CASE WHEN asked > 0 AND hits < 2 THEN 0.12 WHEN hits < asked THEN 0.05 ELSE 0 END)) AS raw FROM h),
fu AS (SELECT qid, doc_id, text, sm, b, s, g, CASE WHEN asked > 0 AND hits < 2 THEN least(raw, 0.2) ELSE raw END AS score, CAST(hits AS INTEGER) AS hits FROM f WHERE {keep}),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, hits DESC, s DESC, b DESC, sm DESC, g DESC, doc_id) AS rank FROM fu)"""


KEYWORD_SQL = fusion_sql("0.2 * sm + 0.25 * b + 0.35 * s + 0.2 * g", {"sv": "vq", "bm": "b9", "ng": "ng", "sb": "sb"}, "coalesce(sv0, 0) > 0 OR bm > 0 OR sb > 0")
BALANCED_SQL = fusion_sql("0.6 * sm + 0.4 * b", {"sv": "vq", "bm": "b9"}, "asked = 0 OR (hits >= 2 AND coalesce(sv0, 0) > 0)")
SEMANTIC_SQL = fusion_sql("0.8 * sm + 0.2 * b", {"sv": "vq", "bm": "b9"}, "true")
FUSED_SQL = " SELECT qid, doc_id, round(score, 6) AS score, hits FROM rk"
TAIL_SQL = """,
t1 AS (SELECT *, count(*) OVER p AS n, max(score) OVER p AS best, lag(score) OVER (PARTITION BY qid ORDER BY rank) AS before FROM rk WINDOW p AS (PARTITION BY qid)),
t2 AS (SELECT *, count(*) FILTER (score >= 0.75 * best) OVER (PARTITION BY qid) AS near,
      min(CASE WHEN rank >= 3 AND before > 0 AND (before - score) / before >= 0.3 THEN rank END) OVER (PARTITION BY qid) AS cut FROM t1)
SELECT qid, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM t2
WHERE n <= 3 OR best <= 0 OR CASE WHEN near >= 3 THEN score >= 0.75 * best ELSE cut IS NULL OR rank < cut END"""


@query("ret_fusion_keyword", KEYWORD_SQL + FUSED_SQL)
def ret_fusion_keyword(spark, sf_dir):
    return fused_lists(spark, sf_dir, "keyword").select("qid", "doc_id", F.round("score", 6).alias("score"), "hits")


@query("ret_fusion_balanced", BALANCED_SQL + FUSED_SQL)
def ret_fusion_balanced(spark, sf_dir):
    return fused_lists(spark, sf_dir, "balanced").select("qid", "doc_id", F.round("score", 6).alias("score"), "hits")


@query("ret_tail_cut", KEYWORD_SQL + TAIL_SQL)
def ret_tail_cut(spark, sf_dir):
    """Fused lists without their tails."""
    return rt.tail_cut(fused_lists(spark, sf_dir, "keyword")).select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(
    "ret_hybrid_search",
    SEMANTIC_SQL.replace("<= 20)", "<= 10)")
    + " SELECT qid, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid, trim(text) ORDER BY rank) AS first FROM rk WHERE score >= 0.2 AND rank <= 10) WHERE first = 1",
)
def ret_hybrid_search(spark, sf_dir):
    """Search from end to end; benchmark texts are long, so vectors weigh most."""
    found = search.hybrid_search(corpus(spark, sf_dir), asked(spark, sf_dir), k=10, threshold=0.2, asked=asked_vectors(spark, sf_dir))
    return found.select("qid", "doc_id", F.round("score", 6).alias("score"))


@query(
    "ret_hybrid_where",
    f"WITH {BM25_SQL}, w50 AS (SELECT qid, doc_id, score FROM bm QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) <= 50) "
    "SELECT w50.qid, w50.doc_id, round(w50.score, 6) AS score FROM w50 JOIN documents USING (doc_id) WHERE lang = 'en' AND n_chars >= 100",
)
def ret_hybrid_where(spark, sf_dir):
    """Of the fifty best by words, those that meet a condition."""
    where = {"lang": "en", "n_chars": {"$gte": 100}}
    return search.recall(corpus(spark, sf_dir), asked(spark, sf_dir), 50, "balanced", where=where)["bm25"].select("qid", "doc_id", F.round("score", 6).alias("score"))


@query(
    "ret_source_tags",
    f"WITH {BM25_SQL}, {VEC_SQL.format(score=L2)}, q AS (SELECT qid FROM {ASKED_SQL}), a AS (SELECT qid, doc_id FROM {_top20('bm')}), b AS (SELECT qid, doc_id FROM {_top20('v')} JOIN q USING (qid)) "
    "SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'keyword' WHEN a.doc_id IS NULL THEN 'semantic' ELSE 'hybrid' END AS source "
    "FROM a FULL JOIN b ON a.qid = b.qid AND a.doc_id = b.doc_id",
)
def ret_source_tags(spark, sf_dir):
    """Which channels found a candidate."""
    merged = rt.merge_channels(search.recall(corpus(spark, sf_dir), asked(spark, sf_dir), 20, "balanced", asked_vectors(spark, sf_dir)))
    return merged.select("qid", "doc_id", rt.source_tag().alias("source"))


@query("ret_text_similarity")
def ret_text_similarity(spark, sf_dir):
    """Every twentieth benchmark item against the next one; tested against a plain loop."""
    items = table(spark, sf_dir, "benchmark").join(vectors(spark, sf_dir).withColumnRenamed("doc_id", "item_id"), "item_id")
    a = items.where("item_id % 20 = 0").select("item_id", F.col("text").alias("a"), F.col("embedding").alias("u"))
    b = items.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("b"), F.col("embedding").alias("v"))
    same = search.text_similarity(F.col("a"), F.col("b"), F.col("u"), F.col("v"))
    return a.join(b, "item_id").select("item_id", same.alias("x")).select("item_id", *[F.round(f"x.{c}", 6).alias(c) for c in ("semantic", "semhash", "combined")], F.size("x.same_words").alias("same_words"))


@query("ret_dedup", "SELECT qid, doc_id FROM (SELECT lang AS qid, doc_id, row_number() OVER (PARTITION BY lang, trim(text) ORDER BY doc_id) AS i FROM documents) WHERE i = 1")
def ret_dedup(spark, sf_dir):
    """Per language, the first of each text."""
    x = table(spark, sf_dir, "documents").select(F.col("lang").alias("qid"), "doc_id", "text", F.col("doc_id").alias("rank"))
    return rt.dedup_results(x).select("qid", "doc_id")


@query("ret_where_filter", "SELECT doc_id FROM documents WHERE (lang = 'de' OR n_chars > 4000) AND source NOT IN ('src1', 'src2') AND n_chars >= 100")
def ret_where_filter(spark, sf_dir):
    condition = {"$or": [{"lang": "de"}, {"n_chars": {"$gt": 4000}}], "source": {"$nin": ["src1", "src2"]}, "n_chars": {"$gte": 100}}
    return table(spark, sf_dir, "documents").where(where_column(condition)).select("doc_id")


@query(
    "ret_chunks",
    r"SELECT CAST(doc_id AS VARCHAR) AS parent_id, length(text) / 4 > 5000 OR len(regexp_extract_all(text, '\S+')) > 5000 AS cut, "
    r"md5(regexp_replace(text, '\s+', '', 'g')) AS text FROM documents WHERE trim(text) <> ''",
)
def ret_chunks(spark, sf_dir):
    """Every document comes back from chunking and reassembly, white space at the cuts aside; only long ones are cut."""
    whole = chunks.reassembled(chunks.chunked(table(spark, sf_dir, "documents")))
    return whole.select("parent_id", (F.col("n_chunks") > 1).alias("cut"), F.md5(F.regexp_replace("text", r"\s+", "")).alias("text"))


@query("ret_chunks_all")
def ret_chunks_all(spark, sf_dir):
    """Every document cut into chunks and put together again; tested against a plain loop."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    whole = chunks.reassembled(chunks.chunked(docs))
    every = docs.select(F.col("doc_id").cast("string").alias("_id")).distinct().join(whole, F.col("_id").eqNullSafe(F.col("parent_id")), "left")
    return every.select(F.col("_id").alias("parent_id"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.md5(F.coalesce("text", F.lit(""))).alias("text"))


@query("ret_conversation_context", "SELECT conv_id, turn, array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), chr(10)) AS context FROM conversations")
def ret_conversation_context(spark, sf_dir):
    """Each turn with its neighbours, turns standing for the chunks of a conversation."""
    x = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("parent_id"), F.col("turn").alias("chunk_index"), F.lit("text").alias("chunk_type"), "text")
    return chunks.with_neighbours(x).select(F.col("parent_id").alias("conv_id"), F.col("chunk_index").alias("turn"), "context")


@query("ret_mode", f"SELECT doc_id, CASE WHEN len({TOKENS}) <= 2 THEN 'keyword' WHEN len({TOKENS}) <= 8 THEN 'balanced' ELSE 'semantic' END AS mode FROM documents")
def ret_mode(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", rt.mode_column(F.size(tx.tokenize(F.col("text")))).alias("mode"))


@query("ret_vector_norms", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS norm FROM embeddings")
def ret_vector_norms(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vx.norm(F.col("embedding")), 6).alias("norm"))
