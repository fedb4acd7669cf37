import itertools

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import line_quality
from tests.llm.fixtures import PARAGRAPH, awkward, empty
from tests.llm.test_exact_and_near import brute_components
from tests.llm.test_line_quality import brute_figures

SF = "/root/testdata/sf0.001"


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def key(rows):
    return sorted((tuple(r) for r in rows), key=str)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "ngram_join", "mixing", "packing"]


def test_quality_keeps_what_the_rules_and_the_field_keep(spark, docs):
    got = stage("quality_rules")(spark, docs, SF)
    assert got.schema == docs.schema
    field = line_quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = [r for r in docs.collect() if line_quality.judged(r["text"], field)[-1]]
    assert key(got.collect()) == key(want) and len(want) > 100
    for r in want:
        n, _, _, _, repeats = brute_figures(r["text"])
        assert n >= 50 and 100 * repeats <= 50 * n


def test_exact_dedup_keeps_the_largest_id_of_each_text(spark, docs):
    got = stage("exact_dedup")(spark, docs, SF)
    assert got.schema == docs.schema
    best = {}
    for r in docs.collect():
        t = r["text"] or ""
        if t not in best or r["doc_id"] > best[t]["doc_id"]:
            best[t] = r
    assert key(got.collect()) == key(best.values())


def test_ngram_join_keeps_the_smallest_id_of_each_group(spark, docs):
    got = stage("ngram_join")(spark, docs, SF)
    rows = docs.collect()
    least = {d: c for d, _, c in brute_components([(r["doc_id"], r["text"]) for r in rows], 5, 80)}
    want = [r for r in rows if least[r["doc_id"]] == r["doc_id"]]
    assert got.schema == docs.schema and key(got.collect()) == key(want)


def test_mixing_repeats_whole_documents(spark, docs):
    got = stage("mixing")(spark, docs, SF)
    assert got.schema == docs.schema
    rows = {tuple(r) for r in docs.collect()}
    times = {}
    for r in got.collect():
        assert tuple(r) in rows
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert max(times.values()) <= 3


def test_run_packs_every_token_of_what_is_left_once(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by_sequence.values():
        ends = list(itertools.accumulate((n for _, n in sorted(pieces)), initial=0))
        assert [o for o, _ in sorted(pieces)] == ends[:-1] and ends[-1] <= 4096
    by_doc = {}
    for r in rows:
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"]))
    for (_, tokens), pieces in by_doc.items():
        starts = {}
        for s, n in pieces:
            starts[s] = starts.get(s, 0) + n
        assert sum(n for _, n in pieces) % tokens == 0 and starts.get(0)


def test_stages_on_awkward_rows_and_on_nothing(spark, tmp_path):
    spark.createDataFrame([(9, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, f in corpus_pipeline.STAGES:
        own = f(spark, awkward(spark), str(tmp_path))
        assert f(spark, empty(spark), str(tmp_path)).count() == 0, name
        if name != "packing":
            assert own.columns == awkward(spark).columns
        rows = own.collect()
        if name == "exact_dedup":
            texts = [r["text"] or "" for r in rows]
            assert len(set(texts)) == len(texts)
        if name == "ngram_join":
            assert PARAGRAPH in {r["text"] for r in rows} and F is not None
