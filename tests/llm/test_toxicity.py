import math
import random
import re
import zlib

from pyspark.sql import functions as F

from tessella.llm import toxicity as tx
from tests.llm.fixtures import awkward, awkward_rows, empty

SF = "/root/testdata/sf0.01"


def auc(rows):
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_held_out_rows(spark):
    got = tx.op7_toxicity(spark, SF)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(y for _, y in held) >= 5
    assert auc(held) > 0.85, auc(held)
    right = sum((s >= 0.5) == bool(y) for s, y in held)
    assert right >= 0.93 * len(held), (right, len(held))


def test_training_ignores_held_out_labels_and_is_repeatable(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(tx.learnable(F.col("doc_id")), F.col("toxic")).otherwise(1 - F.col("toxic")))
    a, b = tx.train(docs, labels), tx.train(docs.repartition(5), turned)
    assert (a.lexicon, a.weights, a.bias) == (b.lexicon, b.weights, b.bias)


def cascade_paths(symbols):
    """(weights taken) of every accepted path, machine after machine, nothing composed."""
    lines = [(tuple(symbols), ())]
    for machine in tx.CASCADE:
        found = []
        for line, names in lines:
            paths = [(0, (), names)]
            for symbol in line:
                paths = [(b, wrote + (out,), taken + w) for state, wrote, taken in paths for a, reads, out, w, b in machine.arcs if (a, reads) == (state, symbol)]
            found += [(wrote, taken) for state, wrote, taken in paths if state in machine.finals]
        lines = found
    return [names for _, names in lines]


def worth(names, weights):
    return sum(weights[tx.WEIGHTS.index(n)] * tx.SIGNS[tx.WEIGHTS.index(n)] for n in names)


def brute_score(grammar, text):
    """Clauses by split, words by a dictionary, paths by enumeration; only clauses with few matches."""
    low = (text or "").lower()
    needed = {e.rpartition("#")[0]: int(e.rpartition("#")[2]) for e in grammar.lexicon}
    count = {}
    forms = lambda w: {f"={w}", *(f"{w[:k]}-" for k in range(1, len(w)))}
    letters = re.compile(r"[^\W\d_]+")
    for w in letters.findall(low):
        for f in forms(w) & needed.keys():
            count[f] = count.get(f, 0) + 1
    live = {f for f, n in count.items() if n >= needed[f]}

    def kind(token):
        first = letters.match(token)
        if first and forms(first.group()) & live:
            return "insult"
        if first and first.group() in tx.THREATS:
            return "threat"
        plain = token.replace("’", "'")
        if plain in tx.REPORTS or plain in list('"“«„'):
            return "report"
        return next((k for k, words in (("negator", tx.NEGATORS), ("object", tx.OBJECTS), ("target", tx.TARGETS)) if plain in words), "other")

    best = []
    for clause in re.split(r"[.!?;:\n]+", low):
        symbols = [kind(t) for t in re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[\"“«„]", clause)]
        if "insult" in symbols or "threat" in symbols:
            best.append(max(worth(p, grammar.weights) for p in cascade_paths(symbols)))
    best.sort(reverse=True)
    x = grammar.bias + sum(share * b for share, b in zip(tx.MORE_CLAUSES, best))
    return 1 / (1 + math.exp(-x))


def test_the_composed_machine_agrees_with_all_paths_through_the_cascade():
    rng = random.Random(3)
    for _ in range(150):
        weights = tuple(rng.uniform(0.1, 4) for _ in tx.WEIGHTS)
        g = tx.Grammar((), weights)
        symbols = [rng.choice(tx.CLASSES) for _ in range(rng.randint(1, 8))]
        value, taken = g.best_path(symbols)
        assert abs(value - max(worth(p, weights) for p in cascade_paths(symbols))) < 1e-9
        assert abs(value - float(taken @ (tx.SIGNS * weights))) < 1e-9


def test_clauses_are_scored_and_not_words():
    g = tx.Grammar(("=zorg#1",))
    assert g.score("You are a zorg") == g.score("a zorg you are") > g.score("what a zorg") > g.score("she said he is a zorg") > g.score("") == g.score(None)
    assert g.score("what a zorg") > g.score("you are not a zorg") > g.score("")
    assert g.score("I will hurt you") > 0.5 > g.score("I will not hurt you") == g.score("rain can hurt crops") == g.score("you hurt. crops") == g.score("")
    assert g.score("ich werde dich töten") > 0.5
    assert g.score("you know. zorg") == g.score("zorg") and g.score("zorgs are here") == g.score("")
    assert g.score("don’t be a zorg") == g.score("don't be a zorg") < g.score("be a zorg")


def test_learned_weights_keep_their_order(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    g = tx.train(docs, labels)
    insult, targeted, negated, reported, threat = g.weights
    assert targeted > 0 and 0 < negated <= insult and 0 < reported <= insult and threat + g.bias > 0
    assert g.score("you are an idiot") > g.score("an idiot") > g.score("not an idiot") and g.score("I will kill you") > 0.5


def test_whole_table_equals_brute_force(spark):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    g = tx.train(docs, spark.read.parquet(f"{path}/labels.parquet"))
    got = {r["doc_id"]: r["score"] for r in tx.op7_toxicity(spark, path).collect()}
    for r in docs.collect():
        if len(g.clauses(r["text"])) < 40:
            assert abs(got[r["doc_id"]] - brute_score(g, r["text"])) < 1e-9, r["doc_id"]


def test_an_entry_may_ask_for_several_occurrences():
    g = tx.Grammar(("=zorg#2",))
    assert g.score("a zorg") == g.score("") < g.score("a zorg and a zorg")


def test_awkward_rows(spark):
    g = tx.Grammar(("=fox#1",))
    got = sorted((tuple(r) for r in tx.scored(awkward(spark), g).collect()), key=str)
    assert got == sorted(((r[0], g.score(r[1])) for r in awkward_rows()), key=str)
    assert tx.scored(empty(spark), g).count() == 0
    labels = spark.createDataFrame([(1, 1, 1), (None, 1, 1), (9, 0, None)], "doc_id long, quality int, toxic int")
    tx.train(awkward(spark), labels)
    assert tx.train(empty(spark), labels).lexicon == ()
    assert tx.train(awkward(spark), labels.limit(0)).lexicon == ()
