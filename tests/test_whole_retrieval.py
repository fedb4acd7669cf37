"""Retrieval queries over every document and every asked vector."""

import hashlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessella.operators import retrieval as rt
from tessella.queries import registry

SF = "/root/testdata/sf0.001"


def plain_chunks(text):
    text = text or ""
    if len(text.split()) <= 5000 and len(text) <= 20000:
        return [text.strip()] if text.strip() else []
    out, start = [], 0
    while start < len(text):
        end = start + 5000
        if end < len(text):
            while end - 1 < len(text) and end < start + 5801 and text[end - 1] not in "。！？!?；;":
                end += 1
            end = min(len(text), end, start + 5800)
        out.append(text[start:end].strip())
        start = end
    return [x for x in out if x]


def test_every_document_comes_back(spark, tmp_path):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    rows += [(10**6, "Ein Satz mit einigen Worten! " * 1500), (10**6 + 1, "word " * 9000), (10**6 + 2, ""), (10**6 + 3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["parent_id"]: (r["n_chunks"], r["text"]) for r in registry.queries()["ret_chunks_all"](spark, str(tmp_path)).collect()}
    want = {str(i): (len(p := plain_chunks(t)), hashlib.md5("\n".join(p).encode()).hexdigest()) for i, t in rows}
    assert got == want and max(n for n, _ in got.values()) > 5


@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
def test_blocks_of_queries_agree_with_single_scores(spark, metric, monkeypatch):
    monkeypatch.setattr(rt, "BLOCK", 7)
    rows = [(i, [float((i * j * 37 + i) % 11 - 5) for j in range(1, 5)]) for i in range(60)] + [(60, [0.0] * 4), (61, None)]
    v = spark.createDataFrame(rows, "doc_id long, embedding array<double>")
    asked = [(str(i), e) for i, e in rows if i % 3 == 0 and e is not None]
    want = {(r["qid"], r["rank"]): (r["doc_id"], round(r["score"], 9)) for r in rt.top_k(rt.vector_scores(v.where("doc_id < 61"), asked, metric).withColumn("score", __import__("pyspark").sql.functions.round("score", 9)), 5).collect()}
    found = rt.vector_top_k(v, spark.createDataFrame(asked, "qid string, embedding array<double>"), 5, metric).collect()
    assert {(r["qid"], r["rank"]): round(r["score"], 9) for r in found} == {x: s for x, (_, s) in want.items()}
    assert len(found) == 5 * len(asked)


def test_the_query_set_is_every_twentieth_vector(spark):
    ids = pq.read_table(f"{SF}/embeddings.parquet")["vec_id"].to_pylist()
    asked = {r["qid"] for r in registry.queries()["ret_vector_all_topk"](spark, SF).collect()}
    assert asked == {str(i) for i in ids if i % 20 == 0}


def test_long_queries_are_looked_up_and_short_ones_scanned(spark):
    long = "Über die Brücke, und noch einmal über die lange Brücke am Fluss entlang"
    rows = [(1, f"vorn {long} hinten"), (2, long.upper()), (3, "die lange"), (4, None), (5, long[:-1]), (None, f"{long}!"), (7, "x" * 60), (8, "x" * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    queries = spark.createDataFrame([("a", f" {long} "), ("b", "LANGE"), ("c", "x" * 50), ("d", " ")], "qid string, query string")
    got = sorted(((r["qid"], r["doc_id"]) for r in rt.substring_scores(docs, queries).collect()), key=str)
    want = sorted(((q, d) for q, x in (("a", long), ("b", "lange"), ("c", "x" * 50)) for d, t in rows if x.lower() in (t or "").lower()), key=str)
    assert got == want and {d for q, d in got if q == "a"} == {1, 2, None}
    assert not len(rt.fingerprints("LANGE")) and set(rt.fingerprints(long)) <= set(rt.fingerprints(f"vorn {long} hinten"))


def test_short_queries_are_found_in_one_pass(spark):
    words = ["ab", "a", "Über", "die Brücke", "ß", "12345678", "123456789", "2345678", "nowhere", "Fluss entlang am Ufer", "İstanbul"]
    rows = [(i, f"{'é' * i}{w} und {words[(i * 3 + 1) % len(words)]} 0123456789 AB".strip()) for i, w in enumerate(words)] + [(50, None), (51, ""), (None, "ab")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame([(f"q{i}", w) for i, w in enumerate([*words, *words[:3]])], "qid string, query string")
    plain = docs.crossJoin(queries).select("qid", "doc_id", rt.substring_score(F.col("text"), F.col("query")).alias("score")).where("score is not null")
    found = rt.substring_scores(docs, queries)
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert key(found) == key(plain) and len(key(plain)) > 60
    assert "crossjoin" not in (plan := found._jdf.queryExecution().toString().lower()) and "nestedloop" not in plan


def test_a_task_holds_one_block_of_queries(spark, monkeypatch):
    monkeypatch.setattr(rt, "BLOCK", 4)
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "doc_id long, embedding array<double>")
    q = spark.createDataFrame([(f"q{i}", [float(i), 1.0]) for i in range(0, 40, 2)], "qid string, embedding array<double>")
    found = rt.vector_top_k(v, q, 3)
    assert {(r["qid"], r["doc_id"]) for r in found.where("rank = 1").collect()} == {(f"q{i}", i) for i in range(0, 40, 2)}
    assert "CartesianProduct" in found._jdf.queryExecution().toString()


def test_copies_of_a_text_score_alike(spark):
    texts = [" ".join(f"w{(i * j) % 17}" for j in range(1, 40 + i)) for i in range(20)]
    rows = [(i, texts[i % 20]) for i in range(200)] + [(i, f"other{i}") for i in range(200, 800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = rt.bm25_scores(rt.bm25_index(docs.repartition(7)), spark.createDataFrame([("q", " ".join(f"w{i}" for i in range(17)))], "qid string, query string"))
    scores = {}
    for r in found.collect():
        scores.setdefault(texts[r["doc_id"] % 20], set()).add(r["score"])
    assert scores and all(len(s) == 1 for s in scores.values())
