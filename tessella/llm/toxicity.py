"""Toxicity by a weighted finite-state pattern grammar over clauses.

A text is cut into clauses and a clause into words, which a lexicon turns into classes: insult, threat, target,
negator, report or other.  Five small transducers, written down as arcs (state, reads, writes, weights, next state),
read these classes one after the other:

* negation: a negator opens a window of three words, in which insults and threats are marked as negated;
* report:   a verb of speech or a quotation mark marks what follows in its clause as reported;
* target:   marks an insult as targeted if its clause addresses or names a person anywhere, and a threat if its
            target follows (or is an object pronoun before it); a mark whose target is still to come is a debt, and a
            path that ends in debt is not accepted;
* insult:   gives a weight to insults, however marked;
* threat:   gives a weight to targeted threats, others pass for nothing.

Their composition is one machine.  A clause scores the weight of its best path, so no word counts by itself: weights
are those of the insult, of a targeted one on top, of negation and report (which take away), and of the threat.  A
text's evidence is its best clause and a quarter of the next two; a logistic function gives the score.

The lexicon of insults (whole words, and stems at the start of a word, each with the number of times a text has to
hold it, 1 to 3) and the weights are learned from labelled rows whose crc32(id) modulo 5 is not 0; of these at most
``TRAIN_TOXIC`` toxic and ``TRAIN_CLEAN`` other ones, the first by a hash of the identifier.  Weights are fitted in
numpy under an order that holds whatever the sample shows: a targeted insult above a plain one, a plain one above a
negated or reported one, none of them below nothing, and a targeted threat above even odds.

Only clauses that hold an insult or threat word are read by the machine, as all others score nothing; an Aho-Corasick
automaton over the whole text finds them, to its end.

Defined cases: null and empty texts match nothing and get the base score; a text of any length is read whole; repeated
rows get equal scores; rows with a null id count as held out of training; extra columns are not read; an empty table
gives no rows.  Without labels the lexicon of insults is empty and threats alone score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice, takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import documents

TRAIN_TOXIC, TRAIN_CLEAN, FOLDS = 3000, 9000, 5
STEM_LENGTHS = (4, 5, 6, 7)
#: An entry may ask for so many occurrences in a text.
MOST_TIMES = 3
#: Weight of the second and third clause beside the first.
MORE_CLAUSES = (1.0, 0.25, 0.25)

# Fixed word lists of the grammar, for English, German, French and Spanish.
THREATS = "kill hurt destroy beat burn shoot stab töten umbringen schlagen tuer frapper matar golpear".split()
TARGETS = "you your yours he she they him her them these those du dein ihr sie tu ton vous votre ils elles tú usted ustedes ellos ellas".split()
OBJECTS = "dich dir euch toi te os".split()
NEGATORS = "not no never neither nor isn't aren't wasn't don't doesn't won't nicht kein keine nie pas jamais aucun nunca jamás".split()
REPORTS = "said says say called calls claims wrote sagte sagt dit disait appelle dijo dice llamó".split()

_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[\"“«„]")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_CLAUSE_END = re.compile(r"[.!?;:\n]+")
_NEGATION_WINDOW = 3

# --- transducers ----------------------------------------------------------------------------------------------------

#: What arcs weigh, and the signs with which the weights enter a score.
WEIGHTS = ("insult", "targeted", "negated", "reported", "threat")
SIGNS = np.array([1.0, 1.0, -1.0, -1.0, 1.0])
#: Weights before anything is learned.
USUAL = (3.0, 1.0, 2.0, 1.5, 4.5)
CLASSES = ("other", "insult", "threat", "target", "object", "negator", "report")


@dataclass(frozen=True)
class Transducer:
    """``arcs``: (state, reads, writes, names of weights, next state); state 0 is the start."""

    arcs: tuple[tuple[int, str, str, tuple[str, ...], int], ...]
    finals: frozenset[int]

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this one writes is read by ``other``; states are pairs that the start can reach."""
        number, arcs, todo = {(0, 0): 0}, [], [(0, 0)]
        while todo:
            here = todo.pop()
            for a, reads, middle, w, b in self.arcs:
                for c, taken, writes, v, d in other.arcs:
                    if (a, c) == here and middle == taken:
                        if (b, d) not in number:
                            number[b, d] = len(number)
                            todo.append((b, d))
                        arcs.append((number[here], reads, writes, w + v, number[b, d]))
        return Transducer(tuple(arcs), frozenset(n for (x, y), n in number.items() if x in self.finals and y in other.finals))


def passing(states: dict[int, int], symbols) -> list:
    """Arcs that write what they read and weigh nothing."""
    return [(a, s, s, (), b) for a, b in states.items() for s in symbols]


def negation() -> Transducer:
    window = {k: max(k - 1, 0) for k in range(_NEGATION_WINDOW + 1)}
    arcs = passing(window, ("other", "target", "object", "report")) + passing({0: 0}, ("insult", "threat"))
    arcs += [(k, "negator", "other", (), _NEGATION_WINDOW) for k in window]
    arcs += [(k, "insult", "insult negated", ("negated",), window[k]) for k in window if k]
    arcs += [(k, "threat", "other", (), window[k]) for k in window if k]
    return Transducer(tuple(arcs), frozenset(window))


def report() -> Transducer:
    arcs = passing({0: 0, 1: 1}, ("other", "target", "object", "insult negated")) + passing({0: 0}, ("insult", "threat"))
    arcs += [(k, "report", "other", (), 1) for k in (0, 1)]
    arcs += [(1, "insult", "insult reported", ("reported",), 1), (1, "threat", "other", (), 1)]
    return Transducer(tuple(arcs), frozenset((0, 1)))


def target() -> Transducer:
    none, seen, debt, before = 0, 1, 2, 3  # before: an object pronoun has been seen
    arcs = passing({k: k for k in range(4)}, ("other", "insult", "insult negated", "insult reported"))
    arcs += [(a, "target", "other", (), b) for a, b in ((none, seen), (seen, seen), (debt, seen), (before, before))]
    arcs += [(a, "object", "other", (), before) for a in range(4)]
    arcs += [(a, "insult", "insult targeted", ("targeted",), b) for a, b in ((none, debt), (seen, seen), (debt, debt), (before, before))]
    arcs += [(a, "threat", "other", (), a) for a in range(4)]
    arcs += [(a, "threat", "threat targeted", (), debt) for a in range(4)] + [(before, "threat", "threat targeted", (), before)]
    return Transducer(tuple(arcs), frozenset((none, seen, before)))


def insult() -> Transducer:
    kinds = ("insult", "insult negated", "insult reported", "insult targeted")
    return Transducer(tuple(passing({0: 0}, ("other", "threat targeted")) + [(0, k, "match", ("insult",), 0) for k in kinds]), frozenset((0,)))


def threat() -> Transducer:
    return Transducer(tuple(passing({0: 0}, ("other", "match")) + [(0, "threat targeted", "match", ("threat",), 0)]), frozenset((0,)))


CASCADE = (negation(), report(), target(), insult(), threat())
MACHINE = CASCADE[0].then(CASCADE[1]).then(CASCADE[2]).then(CASCADE[3]).then(CASCADE[4])


def learnable(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) != 0


def forms(word: str) -> list[str]:
    """What a word could match: itself ("=word") and its stems ("stem-")."""
    return [f"={word}", *(f"{word[:k]}-" for k in STEM_LENGTHS if len(word) > k)]


def candidate_entries(text: str | None) -> set[str]:
    """The entries "form#k" that a text satisfies."""
    counts: dict[str, int] = {}
    for word in _WORD.findall((text or "").lower()):
        if len(word) >= 3:
            for form in forms(word):
                counts[form] = counts.get(form, 0) + 1
    return {f"{form}#{k}" for form, n in counts.items() for k in range(1, min(n, MOST_TIMES) + 1)}


class Grammar:
    def __init__(self, lexicon: tuple[str, ...] = (), weights: tuple[float, ...] = USUAL, bias: float = -3.0):
        self.lexicon, self.weights, self.bias = tuple(lexicon), tuple(weights), bias
        self._words = None
        # arcs by state and symbol: (next state, weight, weights by name)
        self.arcs: dict[tuple[int, str], list] = {}
        for state, reads, _, names, then in MACHINE.arcs:
            counts = np.array([names.count(w) for w in WEIGHTS], dtype=float)
            self.arcs.setdefault((state, reads), []).append((then, float(counts @ (SIGNS * self.weights)), counts))

    def __reduce__(self):
        return Grammar, (self.lexicon, self.weights, self.bias)

    @property
    def words(self):
        """The automaton over all forms; a form's payload is (form, length, needed number or 0 for a threat)."""
        if self._words is None:
            import ahocorasick

            needed = {e.rpartition("#")[0]: int(e.rpartition("#")[2]) for e in self.lexicon}
            found: dict[str, list] = {}
            for form, k in needed.items():
                found.setdefault(form.strip("=-"), []).append((form, k))
            for w in THREATS:
                found.setdefault(w, []).append((f"={w}", 0))
            self._words = ahocorasick.Automaton()
            for bare, kinds in found.items():
                self._words.add_word(bare, (len(bare), kinds))
            self._words.make_automaton()
        return self._words

    def best_path(self, symbols: list[str]) -> tuple[float, np.ndarray]:
        """Weight of the best path over a clause, and how often it takes each of ``WEIGHTS``."""
        best = {0: (0.0, np.zeros(len(WEIGHTS)))}
        for symbol in symbols:
            after: dict[int, tuple[float, np.ndarray]] = {}
            for state, (value, taken) in best.items():
                for then, weight, counts in self.arcs.get((state, symbol), ()):
                    if then not in after or value + weight > after[then][0]:
                        after[then] = (value + weight, taken + counts if weight else taken)
            best = after
        return max((x for state, x in best.items() if state in MACHINE.finals), key=lambda x: x[0])

    def matches(self, low: str) -> dict[int, str]:
        """Place of each insult and threat word in a lower-case text."""
        found: dict[str, list[int]] = {}
        needed: dict[str, int] = {}
        for end, (size, kinds) in self.words.iter(low):
            start = end - size + 1
            if start and low[start - 1].isalpha():
                continue
            more = end + 1 < len(low) and low[end + 1].isalpha()
            for form, k in kinds:
                if more == (form[-1] == "-"):
                    found.setdefault(form, []).append(start)
                    needed[form] = k
        at: dict[int, str] = {}
        for form, places in found.items():
            if len(places) >= needed[form]:
                at.update((p, "insult" if needed[form] else "threat") for p in places if at.get(p) != "insult")
        return at

    def clauses(self, text: str | None) -> list[tuple[float, np.ndarray]]:
        """The best path of every clause that holds an insult or threat word."""
        if not text:
            return []
        low = text.lower()
        at = self.matches(low)
        done, out, places = -1, [], sorted(at)
        for i, place in enumerate(places):
            if place < done:
                continue
            start = max(low.rfind(c, 0, place) for c in ".!?;:\n") + 1
            stop = _CLAUSE_END.search(low, place)
            done = stop.start() if stop else len(low)
            own = {p - start: at[p] for p in takewhile(lambda p: p < done, islice(places, i, None))}  # noqa: B023
            out.append(self.best_path(symbols_of(low[start:done], own)))
        return out

    def evidence(self, text: str | None) -> np.ndarray:
        """``WEIGHTS`` taken by the best clause and, less, by the next two."""
        best = sorted(self.clauses(text), key=lambda x: -x[0])[: len(MORE_CLAUSES)]
        return sum((share * taken for share, (_, taken) in zip(MORE_CLAUSES, best)), np.zeros(len(WEIGHTS)))

    def score(self, text: str | None) -> float:
        x = float(self.evidence(text) @ (SIGNS * self.weights)) + self.bias
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


_KIND = {w: kind for kind, words in (("report", [*REPORTS, *"\"“«„"]), ("negator", NEGATORS), ("object", OBJECTS), ("target", TARGETS)) for w in words}


def symbols_of(clause: str, matches: dict[int, str]) -> list[str]:
    """The classes of a lower-case clause's words; ``matches``: place of each insult or threat word."""
    return [matches.get(m.start()) or _KIND.get(m.group().replace("’", "'"), "other") for m in _TOKEN.finditer(clause)]


def precise(toxic, clean):
    """Entries that the lexicon may take: nine toxic rows or more to each other one."""
    return toxic >= 9 * clean


def choose_lexicon(rows: list[tuple[int, list[str]]], least: int) -> list[str]:
    """Greedy cover of the toxic rows by precise entries, the most telling first; one entry for each form."""
    toxic: dict[str, set[int]] = {}
    clean: dict[str, int] = {}
    for i, (label, found) in enumerate(rows):
        for e in found:
            if label:
                toxic.setdefault(e, set()).add(i)
            else:
                clean[e] = clean.get(e, 0) + 1
    pool = {e: s for e, s in toxic.items() if len(s) >= least and precise(len(s), clean.get(e, 0))}
    gain = {e: len(s) - 5 * clean.get(e, 0) for e, s in pool.items()}
    chosen: dict[str, str] = {}
    covered: set[int] = set()
    # single words of a large following are taken even where others cover their rows already
    for e in sorted(pool, key=lambda e: (-gain[e], e.rpartition("#")[2], "-" in e, len(e), e)):
        form, new = e.rpartition("#")[0], len(pool[e] - covered)
        if form not in chosen and (new >= least or (form[0] == "=" and not clean.get(e) and len(pool[e]) >= 4 * least)):
            chosen[form] = e
            covered |= pool[e]
    return list(chosen.values())


def in_order(theta: np.ndarray) -> np.ndarray:
    """The nearest weights and bias (last) that keep the order of the grammar."""
    insult, targeted, negated, reported, threat, bias = theta
    insult = max(insult, 0.5)
    return np.array(
        [insult, max(targeted, 0.5), np.clip(negated, 0.3 * insult, insult), np.clip(reported, 0.3 * insult, insult), max(threat, 0.7 - bias), bias]
    )


def fit_weights(x: np.ndarray, y: np.ndarray, rounds: int = 600, rate: float = 0.05, decay: float = 0.02) -> tuple[np.ndarray, float]:
    """Logistic weights by projected gradient steps (Adam), drawn to the usual ones where the sample says little."""
    z = np.hstack((x * SIGNS, np.ones((len(x), 1))))
    usual = np.array([*USUAL, -3.0])
    theta, m, v = usual.copy(), np.zeros(len(usual)), np.zeros(len(usual))
    hold = np.array([decay] * len(WEIGHTS) + [0.0])
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
        grad = z.T @ (p - y) + hold * (theta - usual)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = in_order(theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8))
    return theta[:-1], float(theta[-1])


def _entry_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, list[int]] = {}

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array([c[1] for c in counts.values()], pa.int64()), pa.array([c[0] for c in counts.values()], pa.int64())],
            names=["entry", "toxic", "clean"],
        )
        counts.clear()
        return out

    for batch in batches:
        for text, label in zip(batch.column("text"), batch.column("toxic").to_pylist()):
            for e in candidate_entries(text.as_py()):
                counts.setdefault(e, [0, 0])[label] += 1
            if len(counts) > 400_000:
                yield flush()
    yield flush()


def _matches(wanted: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(candidate_entries(t.as_py()) & wanted) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.string()))], names=["toxic", "found"])

    return run


def _evidence(grammar: Grammar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [grammar.evidence(t.as_py()).tolist() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(rows, pa.list_(pa.float64()))], names=["toxic", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Grammar:
    from tessella.llm.shared import spool

    own = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).where(
        F.col("_id").isNotNull() & F.col("toxic").isin(0, 1) & learnable(F.col("_id"))
    )
    first = [F.xxhash64("_id"), F.col("_id")]
    picked = own.where("toxic = 1").orderBy(*first).limit(TRAIN_TOXIC).unionByName(own.where("toxic = 0").orderBy(*first).limit(TRAIN_CLEAN))
    sample = spool(
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
        .join(F.broadcast(picked), "_id")  # at most TRAIN_TOXIC + TRAIN_CLEAN rows
        .select("text", "toxic"),
        "tox-sample",
    )
    n_toxic = sample.where("toxic = 1").count()
    if not n_toxic:
        return Grammar()
    least = max(3, round(0.01 * n_toxic))
    tried = (
        sample.mapInArrow(_entry_counts, "entry string, toxic bigint, clean bigint")
        .groupBy("entry")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where((F.col("toxic") >= least) & precise(F.col("toxic"), F.col("clean")))
        .collect()
    )
    rows = sample.mapInArrow(_matches(frozenset(r["entry"] for r in tried)), "toxic int, found array<string>").collect()
    lexicon = choose_lexicon(sorted((r["toxic"], r["found"]) for r in rows), least)
    found = sorted((r["toxic"], r["x"]) for r in sample.mapInArrow(_evidence(Grammar(lexicon)), "toxic int, x array<double>").collect())
    weights, bias = fit_weights(np.array([x for _, x in found]), np.array([t for t, _ in found], dtype=float))
    return Grammar(lexicon, tuple(weights.tolist()), bias)


def scored(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every row."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [grammar.score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores, pa.float64())], names=["id", "score"])

    return base.mapInArrow(run, f"id {base.schema['id'].dataType.simpleString()}, score double")


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    grammar = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, grammar).select(
        F.col("id").alias("doc_id"),
        F.coalesce(~learnable(F.col("id")), F.lit(True)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
