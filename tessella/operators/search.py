"""Hybrid search from end to end: recall by every channel, fusion, rerank, threshold, chunks, first of each text.

A batch of queries is one table.  Each query is searched in the mode that its number of tokens calls for, so a batch
runs as up to three branches, one for each mode, whose lists are put together at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as tx
from tessella.functions import vector as vx
from tessella.operators import retrieval as rt
from tessella.operators.where import where_column

Rerank = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Corpus:
    """doc_id and text of all documents; doc_id and embedding of those with a vector; an index built before, if any."""

    docs: DataFrame
    vectors: DataFrame | None = None
    bm25: rt.Bm25Index | None = None
    ngrams: DataFrame | None = None
    synonyms: Mapping[str, str] = field(default_factory=dict)
    light: Sequence[str] = ()


def variants(queries: DataFrame, synonyms: Mapping[str, str]) -> DataFrame:
    """qid, query and ``variant``, which numbers the query and its forms with synonyms."""
    return queries.select("qid", F.posexplode(tx.expand_synonyms_column(F.col("query"), synonyms)).alias("variant", "query"))


def over_variants(score: Callable[[DataFrame], DataFrame], forms: DataFrame) -> DataFrame:
    """Scores of all forms of the queries at once; a document keeps its best."""
    if "variant" not in forms.columns:
        return score(forms)
    numbered = forms.select(F.concat_ws("#", "variant", "qid").alias("qid"), "query")
    found = score(numbered).withColumn("qid", F.expr("substring(qid, instr(qid, '#') + 1)"))
    return rt.best_of_variants(found)


def recall(corpus: Corpus, queries: DataFrame, k: int, mode: str, asked: DataFrame | None = None, where: dict | None = None) -> dict[str, DataFrame]:
    """The k best documents of every channel that the mode uses; ``where`` keeps those of them that meet a condition.

    ``asked``: qid, embedding of the queries that have a vector.
    """
    forms = variants(queries, corpus.synonyms) if corpus.synonyms else queries.select("qid", "query")
    channels = {}
    if corpus.vectors is not None and asked is not None:
        channels["semantic"] = rt.vector_top_k(corpus.vectors, asked.join(queries.select("qid"), "qid", "left_semi"), k)
    index = corpus.bm25 or rt.bm25_index(corpus.docs)
    channels["bm25"] = rt.top_k(over_variants(lambda q: rt.bm25_scores(index, q), forms), k)
    if mode == "keyword":
        grams = corpus.ngrams if corpus.ngrams is not None else rt.ngram_index(corpus.docs)
        channels["ngram"] = rt.top_k(over_variants(lambda q: rt.ngram_scores(grams, q), forms), k)
        channels["substring"] = rt.top_k(over_variants(lambda q: rt.substring_scores(corpus.docs, q), forms), k)
    if where:
        fits = corpus.docs.where(where_column(where)).select("doc_id")
        channels = {name: c.join(fits, "doc_id", "left_semi") for name, c in channels.items()}
    return channels


def search_mode(corpus: Corpus, queries: DataFrame, mode: str, k: int, threshold: float, asked: DataFrame | None, where: dict | None, rerank: Rerank | None) -> DataFrame:
    """The lists of queries that are all searched in one mode: qid, doc_id, text, score, source, hits, rank."""
    merged = rt.merge_channels(recall(corpus, queries, k, mode, asked, where))
    forms = F.array_distinct(F.concat(F.array("query"), tx.expand_synonyms_column(F.col("query"), corpus.synonyms)))
    core = queries.select("qid", tx.core_tokens(forms, corpus.light).alias("core"))
    ranked = rt.fused(merged, corpus.docs.select("doc_id", "text"), core, mode)
    if rerank:
        ranked = rt.top_k(rerank(ranked).drop("rank"), 1 << 30)
    if mode == "keyword":
        # a query that no keyword channel answers has a tail of vectors only
        silent = ranked.groupBy("qid").agg(F.bool_and(F.col("source") == "semantic").alias("_silent"))
        tagged = ranked.join(silent, "qid")
        ranked = rt.tail_cut(tagged.where("_silent")).unionByName(tagged.where("not _silent")).drop("_silent")
    return rt.dedup_results(rt.above(ranked, threshold).where(F.col("rank") <= k))


def hybrid_search(
    corpus: Corpus,
    queries: DataFrame,
    k: int = 10,
    threshold: float = 0.5,
    asked: DataFrame | None = None,
    where: dict | None = None,
    rerank: Rerank | None = None,
    modes: Sequence[str] = ("keyword", "balanced", "semantic"),
) -> DataFrame:
    """qid, doc_id, text, score, source, hits, rank of the best documents for every query (qid, query).

    ``rerank`` may give the candidates of a query new scores.  Texts are those of the documents now, not of the index.
    """
    counted = queries.withColumn("_mode", rt.mode_column(F.size(tx.tokenize(F.col("query")))))
    corpus = replace(corpus, bm25=corpus.bm25 or rt.bm25_index(corpus.docs))  # once for all modes
    found = None
    for mode in modes:
        own = search_mode(corpus, counted.where(F.col("_mode") == mode).drop("_mode"), mode, k, threshold, asked, where, rerank)
        found = own if found is None else found.unionByName(own)
    return found


def text_similarity(a_text: Column, b_text: Column, a_vector: Column, b_vector: Column) -> Column:
    """semantic, semhash, combined and same_words of two texts; the longer the second text, the more weight on vectors."""
    semantic, semhash = vx.cosine(a_vector, b_vector), tx.simhash_similarity(tx.simhash_bits(a_text), tx.simhash_bits(b_text))
    mode = rt.mode_column(F.size(tx.tokenize(b_text)))
    alpha = F.element_at(F.create_map(*[F.lit(x) for pair in rt.ALPHAS.items() for x in pair]), mode)
    blank = (F.trim(F.coalesce(a_text, F.lit(""))) == "") | (F.trim(F.coalesce(b_text, F.lit(""))) == "")
    zero = lambda x: F.when(blank, F.lit(0.0)).otherwise(F.coalesce(x, F.lit(0.0)))
    return F.struct(
        zero(semantic).alias("semantic"),
        zero(semhash).alias("semhash"),
        zero(alpha * F.coalesce(semantic, F.lit(0.0)) + (1 - alpha) * semhash).alias("combined"),
        tx.same_tokens(F.array_distinct(tx.tokenize(a_text)), F.array_distinct(tx.tokenize(b_text))).alias("same_words"),
    )


def similar_samples(samples: DataFrame, asked: DataFrame, kind: str, k: int = 10, most: float | None = 0.45) -> DataFrame:
    """The training samples of a kind nearest to each question: qid, id, question, content, distance, rank.

    ``samples``: id, kind, question, content, embedding; ``asked``: qid, question, embedding.  SQL samples farther than
    ``most`` (squared distance) are left out unless they answer the very same question.
    """
    own = samples.where(F.col("kind") == kind)
    found = rt.vector_top_k(own.select(F.col("id").alias("doc_id"), "embedding"), asked.select("qid", "embedding"), k)
    rows = found.select("qid", F.col("doc_id").alias("id"), (1 - F.col("score")).alias("distance"), "rank").join(own.select("id", "question", "content"), "id")
    if kind == "sql" and most is not None:
        rows = rows.join(asked.select("qid", F.col("question").alias("_asked")), "qid")
        same = tx.squeeze(F.col("question")) == tx.squeeze(F.col("_asked"))
        rows = rows.where(same | (F.col("distance") <= most))
    return rows.select("qid", "id", "question", "content", "distance", "rank")
