import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import text as tx
from tessella.functions import vector as vx
from tessella.operators import chunks
from tessella.operators import retrieval as rt
from tessella.operators.where import where_column

TEXTS = {1: "red fox red", 2: "blue fox", 3: "green bird sings loud", 4: "red red red bird", 5: "", 6: None, 7: "天气很好 今天"}
QUERIES = [("a", "red fox"), ("b", "bird bird"), ("c", "nothing")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(QUERIES, "qid string, query string")


def tokens(text):
    return list(text) if text and "天" in text else (text or "").split()


def test_bm25_against_a_plain_loop(spark, docs, queries, tmp_path):
    lists = {d: [t for t in tokens(x) if t.strip()] for d, x in TEXTS.items()}
    n, avgdl = len(lists), sum(map(len, lists.values())) / len(lists)
    df = Counter(t for own in lists.values() for t in set(own))
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: 0.25 * mean if v < 0 else v for t, v in idf.items()}
    want = {}
    for q, text in QUERIES:
        for d, own in lists.items():
            tf = Counter(own)
            s = sum(idf[t] * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(own) / avgdl)) for t in text.split() if t in tf)
            if s > 0:
                want[q, d] = s
    index = rt.bm25_index(docs)
    index.save(str(tmp_path / "index"))
    for each in (index, rt.Bm25Index.load(spark, str(tmp_path / "index"))):
        got = {(r["qid"], r["doc_id"]): r["score"] for r in rt.bm25_scores(each, queries).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_ngrams_and_substrings(docs, queries):
    got = {(r["qid"], r["doc_id"]): r["score"] for r in rt.ngram_scores(rt.ngram_index(docs), queries).collect()}
    grams = lambda s: {s[i : i + 2] for i in range(len(s) - 1)}
    want = {}
    for q, text in QUERIES:
        own = grams(text.replace(" ", ""))
        for d, t in TEXTS.items():
            hits = len(own & grams((t or "").replace(" ", "")))
            if hits >= min(2, len(own)):
                want[q, d] = hits / len(own)
    assert got == pytest.approx(want)
    got = {(r["qid"], r["doc_id"]): r["score"] for r in rt.substring_scores(docs, docs.sparkSession.createDataFrame([("x", "FOX"), ("y", "zebra"), ("z", " ")], "qid string, query string")).collect()}
    assert got == pytest.approx({("x", 1): 0.7 / (1 + 4 / 11) + 0.3 * 3 / 11, ("x", 2): 0.7 / (1 + 5 / 8) + 0.3 * 3 / 8})


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 0.0])], "doc_id long, embedding array<double>")
    l2 = {r["doc_id"]: r["score"] for r in rt.vector_scores(v, [("q", [1.0, 0.0])]).collect()}
    assert l2 == pytest.approx({1: 1.0, 2: 1 - (0.16 + 0.64), 3: 0.0})
    cos = {r["doc_id"]: r["score"] for r in rt.vector_scores(v, [("q", [1.0, 0.0])], "cosine").collect()}
    assert cos[1] == pytest.approx(1.0) and cos[2] == pytest.approx(0.6)
    row = v.where("doc_id = 2").select(vx.norm(F.col("embedding")).alias("n"), vx.clamp(F.lit(1.5)).alias("c"), vx.min_max(F.lit(2.0), F.lit(2.0), F.lit(2.0)).alias("m")).first()
    assert (row["n"], row["c"], row["m"]) == (pytest.approx(1.0), 1.0, 0.0)


def plain_tail_cut(scores):
    if len(scores) <= 3 or scores[0] <= 0:
        return scores
    near = [s for s in scores if s >= 0.75 * scores[0]]
    if len(near) >= 3:
        return near
    for i in range(2, len(scores)):
        if scores[i - 1] > 0 and (scores[i - 1] - scores[i]) / scores[i - 1] >= 0.3:
            return scores[:i]
    return scores


def test_tail_cut_against_a_plain_loop(spark):
    rng = np.random.default_rng(2)
    lists = {f"q{i}": sorted((float(round(x, 3)) for x in rng.beta(1, 2, int(rng.integers(1, 12)))), reverse=True) for i in range(60)}
    lists["zero"] = [0.0] * 5
    ranked = spark.createDataFrame([(q, i, s, i + 1) for q, own in lists.items() for i, s in enumerate(own)], "qid string, doc_id int, score double, rank int")
    got = {}
    for r in rt.tail_cut(ranked).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["score"])
    assert got == {q: plain_tail_cut(own) for q, own in lists.items()}


def test_merge_tags_dedup_and_threshold(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "qid string, doc_id long, score double")
    merged = rt.merge_channels({"semantic": rows(("q", 1, 0.9), ("q", 2, 0.5)), "bm25": rows(("q", 1, 3.0), ("q", 3, 1.0)), "ngram": rows(("q", 4, 0.2))})
    tags = {r["doc_id"]: r["t"] for r in merged.withColumn("t", rt.source_tag()).collect()}
    assert tags == {1: "hybrid", 2: "semantic", 3: "keyword", 4: "ngram"}
    norms = {r["doc_id"]: (r["semantic_norm"], r["bm25_norm"]) for r in rt.normalised_channels(merged).collect()}
    assert norms[1] == (1.0, 1.0) and norms[4] == (0.0, 0.0)
    ranked = spark.createDataFrame([("q", 1, " a ", 0.9, 1), ("q", 2, "a", 0.8, 2), ("q", 1, "b", 0.7, 3), ("q", 3, "c", 0.4, 4)], "qid string, doc_id long, text string, score double, rank int")
    assert [r["doc_id"] for r in rt.above(rt.dedup_results(ranked)).orderBy("rank").collect()] == [1]
    counts = rt.source_counts(ranked.where("rank < 3"), ranked.where("rank > 1 and rank < 5 and doc_id > 1")).first()
    assert (counts["both"], counts["only_a"], counts["only_b"]) == (1, 1, 1)
    with pytest.raises(ValueError):
        rt.merge_channels({})


def test_the_best_by_words_alone_has_the_whole_weight_of_words(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "qid string, doc_id long, score double")
    merged = rt.merge_channels({"semantic": rows(("q", 1, 0.9), ("q", 2, 0.5)), "bm25": rows(("q", 3, 3.0), ("q", 2, 1.0))})
    texts = spark.createDataFrame([(i, f"text {i}") for i in (1, 2, 3)], "doc_id long, text string")
    core = spark.createDataFrame([("q", [])], "qid string, core array<string>")
    for mode, least in (("semantic", 0.2), ("balanced", 0.4)):
        kept = rt.above(rt.fused(merged, texts, core, mode), least).collect()
        assert {r["doc_id"]: r["score"] for r in kept}[3] == least


def test_where_conditions(spark):
    df = spark.createDataFrame([(1, "de", 5), (2, "en", 9), (3, None, 7)], "id int, lang string, n int")
    ids = lambda c: [r["id"] for r in df.where(where_column(c)).orderBy("id").collect()]
    assert ids({}) == [1, 2, 3] and ids({"lang": "de"}) == [1] and ids({"n": {"$gte": 7, "$lt": 9}}) == [3]
    assert ids({"$or": [{"lang": {"$in": ["en"]}}, {"n": {"$eq": 5}}]}) == [1, 2] and ids({"lang": {"$ne": "de"}}) == [2]
    assert ids({"$and": [{"n": {"$gt": 1}}, {"lang": {"$nin": ["de"]}}]}) == [2]
    for bad in ({"$not": []}, {"n": {"$like": 1}}, {"$or": []}):
        with pytest.raises(ValueError):
            where_column(bad)


def test_chunks_come_together_again(spark):
    long = "。".join(f"第{i}句话说一些事情" for i in range(3000))
    docs = spark.createDataFrame([(1, long), (2, "short text"), (3, ""), (4, None)], "doc_id long, text string")
    parts = chunks.chunked(docs, most=500)
    by = {r["parent_id"]: r for r in chunks.reassembled(parts).collect()}
    assert set(by) == {"1", "2"} and by["2"]["text"] == "short text" and by["1"]["n_chunks"] > 10
    assert by["1"]["text"].replace("\n", "") == long
    context = chunks.with_neighbours(parts.where("parent_id = '2'")).first()["context"]
    assert context == "short text"
    pooled = chunks.mean_pooled(spark.createDataFrame([("p", [1.0, 3.0]), ("p", [3.0, 5.0])], "parent_id string, embedding array<double>")).first()
    assert pooled["embedding"] == [2.0, 4.0]


def test_text_functions(spark):
    df = spark.createDataFrame([("See http://x.y/z or a@b.c  {now} ok",), ("今天天气很好",), (None,)], "t string")
    got = [r[0] for r in df.select(tx.clean_text(F.col("t"))).collect()]
    assert got == ["See or now ok", "今天天气很好", None]
    assert [r[0] for r in df.select(tx.mostly_cjk(F.col("t"))).collect()] == [False, True, False]
    assert tx.expand_synonyms("buy car", {"car": "auto", "buy car": "purchase"}) == ["buy car", "purchase"]
    row = spark.range(1).select(
        tx.identifier(F.lit("9 Big-Table!")).alias("i"), tx.preview(F.lit("x" * 201)).alias("p"), tx.redacted(F.lit(None).cast("string")).alias("r"),
        tx.simhash_similarity(tx.simhash_bits(F.lit("the quick brown fox")), tx.simhash_bits(F.lit("the quick brown fox"))).alias("s"),
        tx.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"))).alias("j"),
    ).first()
    assert row["i"] == "t_9_big_table" and row["p"] == "x" * 200 + "..." and row["r"] == "none" and row["s"] == 1.0 and abs(row["j"] - 1 / 3) < 1e-12


def test_stable_uuid_is_version_five(spark):
    import hashlib
    import uuid

    got = spark.createDataFrame([("a",), ("ü",)], "t string").select(tx.stable_uuid(F.col("t"))).collect()
    assert [r[0] for r in got] == [str(uuid.uuid5(uuid.UUID(int=0), hashlib.sha256(t.encode()).hexdigest())) for t in ("a", "ü")]
