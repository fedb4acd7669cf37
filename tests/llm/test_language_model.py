import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq

from tessella.llm import language_model as lm
from tests.llm.fixtures import awkward, awkward_rows, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")
END = object()


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows):
    """id, held_out, n_tokens, n_known, train_tokens and base_score of every (id, text)."""
    out_of = lambda doc: doc is None or zlib.crc32(str(doc).encode()) % 5 == 1
    counts = Counter(w for doc, text in rows if not out_of(doc) for w in [*words_of(text), END])
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for doc, text in rows:
        own = [*words_of(text), END]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in own)
        out.append((doc, out_of(doc), len(own), sum(counts[w] > 0 for w in own), total, base))
    return out


def compare(rows, expected):
    key = lambda r: (str(r[0]), r[2], round(r[5], 3))
    assert len(rows) == len(expected)
    for got, want in zip(sorted(rows, key=key), sorted(expected, key=key)):
        assert tuple(got[:5]) == want[:5]
        assert abs(got[5] - want[5]) <= 1e-6 * max(1, abs(want[5]))


def test_whole_table_and_held_out_likelihood(spark):
    table = pq.read_table("/root/testdata/sf0.01/documents.parquet")
    rows = list(zip(table["doc_id"].to_pylist(), table["text"].to_pylist()))
    got = [tuple(r) for r in lm.op8_language_model(spark, "/root/testdata/sf0.01").collect()]
    compare(got, brute(rows))
    held = [r for r in got if r[1]]
    assert all(r[6] < 0 for r in got)
    assert sum(r[6] for r in held) > 0.97 * sum(r[5] for r in held), "the model should beat single-word counts on held-out texts"


def test_awkward_rows(spark):
    docs = awkward(spark)
    model, counts = lm.train(docs)
    got = [tuple(r) for r in lm.scored(docs, model, counts).collect()]
    expected = brute([(r[0], r[1]) for r in awkward_rows()])
    compare([(r[0], None, *r[1:]) for r in got], [(e[0], None, *e[2:]) for e in expected])
    assert all(math.isfinite(r[5]) for r in got)


def test_empty_tables_and_no_training_rows(spark):
    model, counts = lm.train(empty(spark))
    assert lm.scored(empty(spark), model, counts).count() == 0
    row = lm.scored(awkward(spark), model, counts).where("id = 11").first()
    assert row["n_known"] == 0 and row["train_tokens"] == 0 and math.isfinite(row["score"])


def small_model(units, theta):
    none = np.empty(0, np.int64)
    return lm.Model(1, 1, 1, none, none, units, theta, np.ones(units.classes), np.ones(units.classes))


def test_probabilities_of_units_sum_to_one():
    rng = np.random.default_rng(3)
    units = lm.Units(np.arange(1000, 1030), 9)
    unigram = rng.dirichlet(np.ones(units.number))
    theta = lm.Parameters(rng.normal(0, 0.5, len(lm.Parameters.first(unigram).theta)).astype(np.float32), units.number)
    model = small_model(units, theta)
    before = rng.integers(0, units.number, 5)
    each = [10.0 ** model.log10_units(np.append(before, u), np.zeros(1, np.int64))[-1] for u in range(units.number)]
    assert abs(sum(each) - 1) < 1e-5


def test_scores_are_those_of_the_formula():
    rng = np.random.default_rng(4)
    units = lm.Units(np.arange(1000, 1010), 4)
    theta = lm.Parameters(rng.normal(0, 0.4, len(lm.Parameters.first(np.ones(units.number)).theta)).astype(np.float32), units.number)
    lines = [rng.integers(0, units.number, n) for n in (1, 2, 5, 9)]
    got = small_model(units, theta).log10_units(np.concatenate(lines), np.cumsum([0, 1, 2, 5]))
    want = []
    for line in lines:
        for t, unit in enumerate(line):
            hidden = sum(theta.r[line[t - 1 - i] if t - 1 - i >= 0 else 0].astype(float) @ theta.c[i].astype(float) for i in range(lm.CONTEXT))
            z = theta.q.astype(float) @ hidden + theta.b
            want.append((z[unit] - np.log(np.exp(z).sum())) / math.log(10))
    assert np.allclose(got, want, atol=1e-4)


def test_training_learns_what_follows_two_words_back():
    rng = np.random.default_rng(8)
    n = 30
    truth = rng.dirichlet(np.full(n, 0.1), size=n)  # the next unit depends on the last but one
    line = [1, 2]
    for _ in range(60_000):
        line.append(int(rng.choice(n, p=truth[line[-2]])))
    line = np.array(line)
    unigram = np.bincount(line, minlength=n) + 0.5
    unigram = unigram / unigram.sum()
    model = lm.NoiseContrast(lm.Parameters.first(unigram), unigram, seed=1)
    context = lm.contexts(line, np.zeros(1, np.int64))
    for _ in range(6):
        order = rng.permutation(len(line))
        for at in range(0, len(order), lm.STEP):
            model.step(context[:, order[at : at + lm.STEP]], line[order[at : at + lm.STEP]])
    fresh = [1, 2]
    for _ in range(5000):
        fresh.append(int(rng.choice(n, p=truth[fresh[-2]])))
    fresh = np.array(fresh)
    score = small_model(lm.Units(np.arange(5000, 5000 + n - 2), 1), model.p).log10_units(fresh, np.zeros(1, np.int64))[2:].mean()
    plain = np.log10(unigram[fresh[2:]]).mean()
    best = np.log10(truth[fresh[:-2], fresh[2:]]).mean()
    assert score > plain and best - score < 0.35 * (best - plain), (best, score, plain)


def test_parameters_of_tasks_are_averaged_by_tokens():
    a, b = np.full(4, 1.0, np.float32), np.full(4, 5.0, np.float32)
    total, mean = lm.averaged([(3, 30, b.tobytes()), (1, 10, a.tobytes())])
    assert total == 40 and np.allclose(mean, 4.0)


def test_every_token_is_a_training_position(monkeypatch):
    import pyarrow as pa

    seen = []
    monkeypatch.setattr(lm.NoiseContrast, "step", lambda self, context, target: seen.append((context.copy(), target.copy())))
    units = lm.Units(np.empty(0, np.int64), 4)
    unigram = np.full(units.number, 1 / units.number)
    texts = ["a b c d e f", "", None, "x y " * 5000]
    batch = pa.record_batch({"text": texts, "part": pa.array([0] * 4, pa.int64())})
    (out,) = lm._trained(units, lm.Parameters.first(unigram), unigram, 0)(iter([batch]))
    want = [np.append(units.of(lm.WordKeys().of(t)), 0) for t in texts]
    assert out.column("tokens").to_pylist() == [sum(map(len, want))] and sum(len(t) for _, t in seen) == sum(map(len, want))
    assert Counter(np.concatenate([t for _, t in seen]).tolist()) == Counter(np.concatenate(want).tolist())


def test_texts_are_split_as_words_are_defined(monkeypatch):
    import pyarrow as pa

    texts = [None, "", " ", "  A b\tc\x0bD\x0ce\rf\nG ", "a\xa0b \x1c\x1d x y İIÄ", "one", "b b " * 300, None, "\n\n", "end"]
    texts += [r[1] for r in awkward_rows()]
    want = [[int(k) for k in lm.WordKeys().of(t)] for t in texts]
    for size, kind in ((1, pa.string()), (40, pa.large_string()), (1 << 20, pa.string())):
        monkeypatch.setattr(lm, "SLICE", size)
        got = []
        for words in lm.split(pa.array(["left out", *texts], kind).slice(1), lm.WordKeys()):
            assert len(words.keys) <= len(set(words.keys[words.places].tolist())) + 1  # distinct words, perhaps the empty one
            got += [part.tolist() for part in np.split(words.keys[words.places], np.cumsum(words.lengths)[:-1])]
        assert got == want
    assert list(lm.split(pa.array([], pa.string()), lm.WordKeys())) == []


def scored_by_formula(theta, line):
    r, c, q, b = (x.astype(float) for x in (theta.r, theta.c, theta.q, theta.b))
    out = []
    for t, unit in enumerate(line):
        z = q @ sum(r[line[t - 1 - i] if t - 1 - i >= 0 else 0] @ c[i] for i in range(lm.CONTEXT)) + b
        out.append((z[unit] - z.max() - np.log(np.exp(z - z.max()).sum())) / math.log(10))
    return out


def test_a_context_is_normalised_once_and_shifted_only_if_need_be(monkeypatch):
    rng = np.random.default_rng(6)
    units = lm.Units(np.arange(1000, 1040), 9)
    powers = []
    for name in ("exp", "exp2"):
        monkeypatch.setattr(np, name, lambda z, *a, f=getattr(np, name), **b: (powers.append(np.size(z)), f(z, *a, **b))[1])
    for wide, plain in ((1.0, True), (6.0, False)):
        theta = lm.Parameters(rng.normal(0, 0.3, len(lm.Parameters.first(np.ones(units.number)).theta)).astype(np.float32), units.number)
        theta.r[:] *= wide
        theta.q[:] *= wide
        model = small_model(units, theta)
        assert model.plain == plain
        line = np.tile(rng.integers(0, units.number, 30), 50)
        powers.clear()
        got = model.log10_units(line, np.zeros(1, np.int64))
        assert sum(powers) == 33 * units.number  # 3 contexts at the start, 30 that come again and again
        assert np.allclose(got, scored_by_formula(theta, line.tolist()), rtol=1e-4, atol=1e-4)


def test_a_step_follows_the_gradient_of_the_formula():
    rng = np.random.default_rng(7)
    unigram = rng.dirichlet(np.ones(20))
    model = lm.NoiseContrast(lm.Parameters.first(unigram), unigram, seed=2)
    context, target = rng.integers(0, 20, (lm.CONTEXT, 60)), rng.integers(0, 20, 60)
    draws = np.random.default_rng(2).random(lm.NOISE)
    noise = np.minimum(np.searchsorted(np.cumsum(unigram), draws * np.cumsum(unigram)[-1], side="right"), 19)
    before = lm.Parameters(model.p.theta.astype(float), 20)
    grad = lm.Parameters(np.zeros_like(before.theta), 20)
    for t in range(60):
        hidden = sum(before.r[context[i, t]] @ before.c[i] for i in range(lm.CONTEXT))
        for unit, label in ((target[t], 1.0), *((u, 0.0) for u in noise)):
            miss = label - 1 / (1 + math.exp(-(hidden @ before.q[unit] + before.b[unit] - math.log(lm.NOISE * unigram[unit]))))
            grad.q[unit] += miss * hidden
            grad.b[unit] += miss
            for i in range(lm.CONTEXT):
                grad.r[context[i, t]] += miss * (before.c[i] @ before.q[unit])
                grad.c[i] += miss * np.outer(before.r[context[i, t]], before.q[unit])
    g = grad.theta / math.sqrt(60)
    model.step(context, target)
    assert np.allclose(model.p.theta, before.theta + model.rate * g / np.sqrt(1 + g * g), atol=1e-4)
