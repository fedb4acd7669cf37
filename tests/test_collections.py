"""Collections, the metadata store, search pieces that SQL cannot show."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tessella.functions import text as tx
from tessella.operators import search
from tessella.operators.collection import Collections, json_chunks
from tessella.operators.store import MetadataStore


def embed(texts):
    return [[float(len(t)), 1.0] for t in texts]


def plain_simhash(text):
    import hashlib
    import re

    flat = re.sub(r"[^\w一-鿿]+", "", text.lower(), flags=re.ASCII)
    grams = [flat[i : i + 4] for i in range(max(len(flat) - 3, 1))]
    values = [int(hashlib.md5(g.encode()).hexdigest()[16:], 16) for g in grams]
    return [int(2 * sum(v >> k & 1 for v in values) > len(values)) for k in range(63, -1, -1)]


def test_simhash_bits_by_a_plain_loop(spark):
    texts = ["The quick brown fox", "abc", "a", "Words, words; words! 123"]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", tx.simhash_bits(F.col("text")).alias("b")).collect()
    assert {r["text"]: r["b"] for r in got} == {t: plain_simhash(t) for t in texts}


def test_text_similarity(spark):
    a, b = "red fox jumps over the lazy dog today", "red fox jumps over a lazy cat"
    row = spark.createDataFrame([(a, b, [1.0, 2.0], [2.0, 1.0]), (a, " ", [1.0], [1.0])], "a string, b string, u array<double>, v array<double>")
    first, blank = [r["x"] for r in row.select(search.text_similarity(F.col("a"), F.col("b"), F.col("u"), F.col("v")).alias("x")).collect()]
    same = 1 - sum(x != y for x, y in zip(plain_simhash(a), plain_simhash(b))) / 64
    assert math.isclose(first["semantic"], 0.8) and math.isclose(first["semhash"], same)
    assert math.isclose(first["combined"], 0.6 * 0.8 + 0.4 * same)
    assert first["same_words"] == ["fox", "jumps", "lazy", "over", "red"]
    assert (blank["semantic"], blank["semhash"], blank["combined"]) == (0.0, 0.0, 0.0)


def test_json_objects_are_cut_at_their_first_long_field(spark):
    long = "Ein Satz mit Worten. " * 1500 + "Ende!"
    rows = [(1, json.dumps({"a": "short", "b": long})), (2, json.dumps({"a": "short"}))]
    got = json_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r["text"] for r in got if r["parent_id"] == "2"] == [rows[1][1]]
    parts = sorted((r["chunk_index"], r["text"]) for r in got if r["parent_id"] == "1")
    assert len(parts) > 3 and "".join(t.replace(" ", "") for _, t in parts) == long.replace(" ", "")
    assert {r["chunk_type"] for r in got} == {"json"}


def test_a_collection_keeps_the_latest_of_each_document(spark, tmp_path):
    store = Collections(spark, str(tmp_path), embed)
    assert store.listed().count() == 0 and store.page("x").count() == 0
    store.add("x", spark.createDataFrame([(1, "one", 5), (2, "two", None), (3, None, 1)], "k long, name string, n long"), "k", ["name"], ["n", "missing"])
    store.add("x", spark.createDataFrame([(2, "second", 7)], "k long, name string, n long"), "k", ["name"], ["n"])
    rows = {r["parent_id"]: (r["text"], r["meta"], r["embedding"]) for r in store.of("x").collect()}
    assert rows == {"1": ("one", {"n": "5"}, [3.0, 1.0]), "2": ("second", {"n": "7"}, [6.0, 1.0])}
    assert store.detail("x", "2-0").first()["text"] == "second"
    with pytest.raises(ValueError):
        store.page("x", 0)


def test_similar_samples(spark):
    samples = spark.createDataFrame(
        [("a-sql", "sql", "how many", "SELECT 1", [0.0, 0.0]), ("b-sql", "sql", "far", "SELECT 2", [5.0, 0.0]), ("c-sql", "sql", "what  now", "SELECT 3", [9.0, 9.0]), ("d-ddl", "ddl", None, "CREATE", [0.0, 0.1])],
        "id string, kind string, question string, content string, embedding array<double>",
    )
    asked = spark.createDataFrame([("q", "what now", [0.1, 0.0])], "qid string, question string, embedding array<double>")
    assert {r["id"] for r in search.similar_samples(samples, asked, "sql").collect()} == {"a-sql", "c-sql"}
    assert {r["id"] for r in search.similar_samples(samples, asked, "sql", most=None).collect()} == {"a-sql", "b-sql", "c-sql"}
    assert {r["content"] for r in search.similar_samples(samples, asked, "ddl").collect()} == {"CREATE"}


def test_search_in_every_mode_with_synonyms_and_rerank(spark):
    docs = spark.createDataFrame([(1, "red fox runs"), (2, "crimson fox sleeps"), (3, "blue whale"), (4, "red fox runs")], "doc_id long, text string")
    queries = spark.createDataFrame([("s", "scarlet fox"), ("m", "red fox runs in the wood")], "qid string, query string")
    corpus = search.Corpus(docs, synonyms={"scarlet": "crimson"}, light=("the", "in"))
    rows = search.hybrid_search(corpus, queries, threshold=0.0).collect()
    short = sorted((r["rank"], r["doc_id"]) for r in rows if r["qid"] == "s")
    assert short[0][1] == 2 and len({r["text"] for r in rows if r["qid"] == "s"}) == len(short)
    turned = search.hybrid_search(corpus, queries.where("qid = 's'"), threshold=0.0, rerank=lambda x: x.withColumn("score", 1.0 / F.col("doc_id")))
    assert turned.orderBy("rank").first()["doc_id"] == 1


def test_sync_jobs_record_errors(spark, tmp_path):
    store = MetadataStore(spark, str(tmp_path))
    assert store.jobs().count() == 0 and store.listed("column").count() == 0
    store.put_connection("d", "mysql", "jdbc:x")
    assert store.listed("connection", enabled=True).first()["dataset_id"] == "d"

    def fails():
        raise ConnectionError("no route")

    with pytest.raises(ConnectionError):
        store.sync("d", fails)
    frame = spark.createDataFrame([(1, "a")], "k long, v string")
    assert store.sync("d", lambda: {"t": frame, "u": frame}, {"t": "k"}, [("u", "k", "t", "k")]) == {"table_count": 2, "column_count": 4, "relation_count": 1}
    assert [(r["status"], r["error"]) for r in store.jobs("d").collect()] == [("success", None), ("error", "no route")]
    assert [(r["table_name"], r["column_name"]) for r in store.listed("column", "d").collect()] == [("t", "k"), ("t", "v"), ("u", "k"), ("u", "v")]
