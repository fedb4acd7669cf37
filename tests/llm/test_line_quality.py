import itertools
import re
import string

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tessella.llm import line_quality as lq
from tests.llm.fixtures import awkward, awkward_rows, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_figures(text):
    words = WORD.findall(text or "")
    at, repeat = {}, set()
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    for places in at.values():
        if len(places) > 1:
            repeat.update(i + k for i in places for k in range(3))
    seen, double = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            double += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), double, len(repeat))


def test_figures_of_the_whole_table(spark):
    path = "/root/testdata/sf0.001"
    table = pq.read_table(f"{path}/documents.parquet")
    texts = dict(zip(table["doc_id"].to_pylist(), table["text"].to_pylist()))
    rows = lq.op4_line_quality(spark, path).collect()
    assert len(rows) == len(texts)
    for r in rows:
        figures = brute_figures(texts[r["doc_id"]])
        assert tuple(r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == figures
        assert r["base_failed"] == (figures[0] < 50 or 100 * figures[4] > 50 * figures[0])
        assert not (r["base_failed"] and r["kept"])


def test_awkward_rows(spark):
    rows = sorted(((r[0], *brute_figures(r[1])) for r in awkward_rows()), key=str)
    got = sorted((tuple(r)[:6] for r in lq.figures(awkward(spark), lq.LineField()).collect()), key=str)
    assert got == rows
    assert lq.figures(empty(spark), lq.LineField()).count() == 0
    kept = lq.kept_documents(awkward(spark), lq.LineField())
    assert kept.schema == awkward(spark).schema
    assert {r["doc_id"] for r in kept.collect()} == {7, 8, 9, 10}


def test_training_without_labels_keeps_all_that_pass(spark):
    assert not lq.train(awkward(spark), None).weights.any()
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert not lq.train(awkward(spark), none).weights.any()
    assert not lq.train(empty(spark), spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")).weights.any()


def test_viterbi_is_the_best_of_all_labellings():
    rng = np.random.default_rng(4)
    for _ in range(60):
        field = lq.LineField(rng.normal(size=(lq.FEATURES, lq.BINS, 2)), rng.normal(size=(2, 2)) * 2)
        n = int(rng.integers(1, 8))
        features = rng.integers(0, lq.BINS, (n, lq.FEATURES))
        e = field.emissions(features)

        def score(y):
            return sum(e[i, y[i]] for i in range(n)) + sum(field.moves[y[i - 1], y[i]] for i in range(1, n))

        assert abs(score(field.viterbi(features)) - max(map(score, itertools.product((0, 1), repeat=n)))) < 1e-9


def test_posteriors_are_the_shares_of_all_labellings():
    rng = np.random.default_rng(9)
    field = lq.LineField(rng.normal(size=(lq.FEATURES, lq.BINS, 2)), rng.normal(size=(2, 2)))
    sizes = [1, 5, 3, 7, 2]
    features = rng.integers(0, lq.BINS, (sum(sizes), lq.FEATURES))
    starts = np.zeros(len(features), dtype=bool)
    starts[np.cumsum([0, *sizes[:-1]])] = True
    one, two = field.posteriors(field.emissions(features), starts, max(sizes))
    at = 0
    for n in sizes:
        e = field.emissions(features[at : at + n])
        each = {y: np.exp(sum(e[i, y[i]] for i in range(n)) + sum(field.moves[y[i - 1], y[i]] for i in range(1, n))) for y in itertools.product((0, 1), repeat=n)}
        total = sum(each.values())
        for i in range(n):
            assert abs(one[at + i, 1] - sum(v for y, v in each.items() if y[i]) / total) < 1e-9
            if i:
                assert abs(two[at + i, 1, 0] - sum(v for y, v in each.items() if y[i - 1] and not y[i]) / total) < 1e-9
        at += n


def test_relabelling_keeps_to_the_documents_side():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(1, 12))
        boiler, words = rng.random(n), rng.integers(1, 30, n)
        for quality in (0, 1):
            labels = lq.allowed_labels(boiler, words, quality)
            assert (words[labels == 0].sum() >= lq.CONTENT_SHARE * words.sum()) == bool(quality)


def lines_of(text, quality):
    _, features, words = lq.measured(text)
    return features.astype(np.int64), words, quality


def test_labels_of_lines_vary_within_a_text():
    prose = [f"A plain sentence number {w} that says something in calm words." for w in string.ascii_lowercase]
    junk = [f"BUY NOW {w.upper()} !!! $$$ 99 % | | | <<<" for w in string.ascii_lowercase]
    texts = [lines_of("\n".join(prose[i : i + 12]), 1) for i in range(10)] + [lines_of("\n".join(prose[i : i + 9] + junk[:2]), 1) for i in range(10)]
    texts += [lines_of("\n".join(junk[i : i + 12]), 0) for i in range(10)] + [lines_of("\n".join(prose[:2] + junk[i : i + 9]), 0) for i in range(10)]
    field = lq.LineField().fit_documents(texts)
    good = lines_of("\n".join(prose[12:24] + junk[20:24]), 1)[0]
    assert field.viterbi(good).tolist() == [0] * 12 + [1] * 4
    bad = lines_of("\n".join(junk[12:24] + prose[:4]), 0)[0]
    assert field.viterbi(bad).tolist() == [1] * 12 + [0] * 4


def test_lines_of_the_table_get_both_labels_within_texts(spark):
    path = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    rows = lq.figures(docs, lq.train(docs, spark.read.parquet(f"{path}/labels.parquet"))).collect()
    mixed = sum(0 < r["content_share"] < 1 for r in rows)
    assert mixed >= 0.02 * len(rows), mixed


def test_verdict_agrees_with_labels_that_training_never_saw(spark):
    path = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    out = lq.figures(docs, lq.train(docs, labels.where(~fold)))
    seen = out.join(labels.where(fold), F.col("id") == F.col("doc_id")).where("not base_failed").select("kept", "quality").collect()
    right = sum(r["kept"] == (r["quality"] == 1) for r in seen)
    assert len(seen) > 40 and right >= 0.9 * len(seen), (right, len(seen))
