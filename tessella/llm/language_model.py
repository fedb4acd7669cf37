"""Log-bilinear language model trained with noise-contrastive estimation.

Tokens are words and one end token per text.  The model predicts units: the end, the most frequent words, and classes
of all other words by their last two bytes; how many words and classes follows the counted vocabulary up to
``MOST_WORDS`` and ``MOST_CLASSES``, which bounds memory.  The context is the ``CONTEXT`` units before (ends before
the first token).  With r_i the vector of the i-th unit before and C_i the matrix of that position,
P(unit | context) is proportional to exp((r_1 C_1 + r_2 C_2 + ...) . q + b), and a word has the probability of its unit
times its share (c + 0.5) / (C + 0.5 (V + 1)) in its class of C tokens and V words, so that the words known and one
unknown word per class share all probability.

Training is noise-contrastive: data units are told from ``NOISE`` units drawn from the unigram distribution.  Tasks
read all training texts in ``ROUNDS`` rounds, a part of the texts in each; from every token, they step along the
gradient in numpy (AdaGrad) from the parameters of the round before and return theirs, which are averaged by tokens, in
groups first.  So what is learned from grows with the corpus, and a task and the driver hold parameters of
one size.  Word counts are summed in tasks first and then by a shuffle.

Scoring normalises every token over all units: one matrix product for a block of contexts by all units gives the
scores, and their sums of exponentials the log-probabilities.  A sum depends on the context only, so tokens of one slice
of texts that share their context share its row.  Counts of the ``COMMON`` most frequent words go to all tasks (a fixed
bound); rarer words of a text are joined with the count table by a shuffle.  Words are identified by 54 bits of their
hash and their class.

Texts are split in slices of ``SLICE`` bytes, or one text if it is longer, by Arrow; only the distinct words of a slice
are hashed and looked up.

Defined cases: a null text counts as empty and has the end token only; a text of any length is read whole, in blocks;
words of equal counts are ordered by their keys; repeated rows are scored row by row; rows with a null id are held
out; extra columns are not read; an empty table gives no rows, and without training texts all units are alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import documents, spool
from tessella.llm.words import lower_words

MOST_WORDS, MOST_CLASSES, COMMON, FOLDS = 255, 256, 200_000, 5
CONTEXT, SIZE, NOISE, ROUNDS = 3, 24, 24, 2
#: Tokens to a training task at least, positions to a step, and contexts to a block of scoring.
TASK_TOKENS, STEP, BLOCK = 1_000_000, 512, 1024
#: Bytes of text that are split at once.
SLICE = 8 << 20
#: Parameters of tasks are averaged in so many groups, then on the driver.
GROUPS = 64
_LOW = 1023


class WordKeys(dict):
    """Last two bytes of a word -> its class; gives words 64-bit keys whose ten low bits are the class."""

    def __missing__(self, ending: bytes) -> int:
        value = self[ending] = xxhash.xxh3_64_intdigest(ending) & _LOW
        return value

    def keys(self, words: list[bytes]) -> np.ndarray:
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words)).view(np.int64)
        classes = np.fromiter(map(self.__getitem__, [w[-2:] for w in words]), dtype=np.int64, count=len(words))
        return hashes & ~_LOW | classes

    def of(self, text: str | None) -> np.ndarray:
        return self.keys(lower_words(text))


class Words(NamedTuple):
    """Words of texts in a row: keys of the distinct ones, the place of each word in ``keys``, and words of each text."""

    keys: np.ndarray
    places: np.ndarray
    lengths: np.ndarray

    def lines(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Units (given by key) of all texts, each with an end; where each text starts; and which tokens are words."""
        after = np.cumsum(self.lengths + 1)
        word = np.ones(len(self.places) + len(self.lengths), dtype=bool)
        word[after - 1] = False
        line = np.zeros(len(word), dtype=np.int64)
        line[word] = unit[self.places]
        return line, after - self.lengths - 1, word


def split(texts: pa.Array, keys: WordKeys) -> Iterator[Words]:
    """The words of ``lower_words`` of all texts, slice by slice."""
    texts = pc.fill_null(texts, "")
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE, side="right")))
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(at, end - at)))
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        known = coded.dictionary.cast(pa.binary())
        _, bounds, data = known.buffers()
        bounds = np.frombuffer(bounds, dtype=np.int32, count=known.offset + len(known) + 1)[known.offset :].tolist()
        data = data.to_pybytes() if data else b""
        words = [data[a:b] for a, b in zip(bounds, bounds[1:])]
        places = coded.indices.to_numpy()
        # white space at the ends of a text gives empty words
        real = np.fromiter(map(len, words), dtype=bool, count=len(words))[places]
        before = np.concatenate(([0], np.cumsum(real)))
        yield Words(keys.keys(words), places[real], np.diff(before[offsets]))
        at = end


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 1, F.lit(True))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys = WordKeys()
    for batch in batches:
        for words in split(batch.column("text"), keys):
            count = np.bincount(words.places, minlength=len(words.keys))
            found = count > 0
            yield pa.RecordBatch.from_arrays([pa.array(words.keys[found]), pa.array(count[found].astype(np.int64))], names=["key", "c"])


class Units:
    """Maps keys to units: 0 the end, then the most frequent words, then classes."""

    def __init__(self, top: np.ndarray, classes: int):
        self.order = np.argsort(top)
        self.top, self.classes = top[self.order], classes
        self.number = 1 + len(top) + classes

    def of(self, keys: np.ndarray) -> np.ndarray:
        unit = 1 + len(self.top) + (keys & _LOW) % self.classes
        if len(self.top):
            at = np.minimum(np.searchsorted(self.top, keys), len(self.top) - 1)
            known = self.top[at] == keys
            unit[known] = 1 + self.order[at[known]]
        return unit


class Parameters:
    """r, q (units x size), C (positions x size x size) and b (units), as one vector of 32-bit numbers."""

    def __init__(self, theta: np.ndarray, units: int):
        self.theta, self.units = theta, units
        n, k = units * SIZE, CONTEXT * SIZE * SIZE
        self.r, self.q = theta[:n].reshape(units, SIZE), theta[n : 2 * n].reshape(units, SIZE)
        self.c, self.b = theta[2 * n : 2 * n + k].reshape(CONTEXT, SIZE, SIZE), theta[2 * n + k :]

    @staticmethod
    def first(unigram: np.ndarray, seed: int = 5) -> Parameters:
        rng, units = np.random.default_rng(seed), len(unigram)
        around = lambda *shape: rng.normal(0, 0.1, shape).ravel()
        eye = np.concatenate([np.eye(SIZE).ravel() / (i + 1) for i in range(CONTEXT)])
        return Parameters(np.concatenate((around(units, SIZE), around(units, SIZE), eye, np.log(unigram))).astype(np.float32), units)


def contexts(units: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The CONTEXT units before each token (last one first) of texts in a row; ends before a text's first token."""
    place = np.arange(len(units)) - np.repeat(starts, np.diff(np.append(starts, len(units))))
    out = np.zeros((CONTEXT, len(units)), dtype=np.int64)
    for i in range(CONTEXT):
        out[i, i + 1 :] = units[: max(0, len(units) - i - 1)]
        out[i, place <= i] = 0
    return out


def share_of_data(scores: np.ndarray) -> np.ndarray:
    """The logistic function, in place."""
    np.clip(scores, -30, 30, out=scores)
    np.exp(np.negative(scores, out=scores), out=scores)
    scores += 1
    return np.reciprocal(scores, out=scores)


class NoiseContrast:
    """Gradient steps on data against drawn noise."""

    def __init__(self, start: Parameters, unigram: np.ndarray, seed: int, rate: float = 0.15):
        self.p = Parameters(start.theta.copy(), start.units)
        self.shift = np.log(NOISE * unigram).astype(np.float32)
        self.cumulated = np.cumsum(unigram)
        self.rng, self.rate = np.random.default_rng(seed), rate
        self.squares = np.full(len(start.theta), 1.0, dtype=np.float32)
        self.cells = np.arange(2 * start.units * SIZE).reshape(2 * start.units, SIZE)

    def step(self, context: np.ndarray, target: np.ndarray) -> None:
        p, n = self.p, len(target)
        noise = np.minimum(np.searchsorted(self.cumulated, self.rng.random(NOISE) * self.cumulated[-1], side="right"), p.units - 1)
        near = context.T.ravel()
        before = p.r.take(near, axis=0).reshape(n, CONTEXT * SIZE)
        turned = p.c.reshape(CONTEXT * SIZE, SIZE)
        hidden = before @ turned
        ahead, q = p.q.take(target, axis=0), p.q.take(noise, axis=0)
        own = share_of_data(np.einsum("ij,ij->i", hidden, ahead) + (p.b - self.shift)[target])
        drawn = share_of_data(hidden @ q.T + (p.b - self.shift)[noise])
        up, down = 1 - own, np.negative(drawn, out=drawn)  # ascent in the scores of data and noise
        back = up[:, None] * ahead + down @ q
        # r and q stand first in theta: rows of both are summed by unit at once
        rows = np.concatenate(((back @ turned.T).reshape(-1, SIZE), up[:, None] * hidden, down.T @ hidden))
        cells = self.cells.take(np.concatenate((near, target + p.units, noise + p.units)), axis=0)
        g = np.zeros_like(p.theta)
        grad = Parameters(g, p.units)
        g[: self.cells.size] = np.bincount(cells.ravel(), weights=rows.ravel(), minlength=self.cells.size)
        grad.c += (before.T @ back).reshape(grad.c.shape)
        grad.b += np.bincount(target, weights=up, minlength=p.units).astype(np.float32)
        np.add.at(grad.b, noise, down.sum(axis=0))
        g *= 1 / math.sqrt(n)
        self.squares += g * g
        g /= np.sqrt(self.squares)
        g *= self.rate
        p.theta += g


def _trained(units: Units, start: Parameters, unigram: np.ndarray, turn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, model, tokens, part = WordKeys(), None, 0, 0
        context, target = np.empty((CONTEXT, 0), np.int64), np.empty(0, np.int64)
        for batch in batches:
            if model is None and batch.num_rows:
                part = batch.column("part")[0].as_py()
                model = NoiseContrast(start, unigram, seed=1009 * part + turn)
            for words in split(batch.column("text"), keys):
                line, starts, _ = words.lines(units.of(words.keys))
                ends = len(target) + starts + words.lengths + 1
                context, target = np.concatenate((context, contexts(line, starts)), axis=1), np.concatenate((target, line))
                tokens, at = tokens + len(line), 0
                # whole texts of 16 steps at least are mixed
                while (i := int(np.searchsorted(ends, at + 16 * STEP))) < len(ends):
                    order = at + model.rng.permutation(ends[i] - at)
                    for k in range(0, len(order), STEP):
                        model.step(context.take(order[k : k + STEP], axis=1), target[order[k : k + STEP]])
                    at = ends[i]
                context, target = context[:, at:].copy(), target[at:].copy()
        for at in range(0, len(target), STEP):
            model.step(context[:, at : at + STEP], target[at : at + STEP])
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([tokens], pa.int64()), pa.array([model.p.theta.tobytes()], pa.binary())], names=["part", "tokens", "theta"])

    return run


def averaged(rows: list[tuple[int, int, bytes]]) -> tuple[int, np.ndarray]:
    """Tokens and the mean of parameters (part, tokens, bytes), weighted by tokens, in order of the parts."""
    rows = sorted(rows)
    total = sum(n for _, n, _ in rows)
    return total, sum(np.frombuffer(x, dtype=np.float32).astype(np.float64) * (n / total) for _, n, x in rows)


def _group_mean(table: pa.Table) -> pa.Table:
    rows = list(zip(*(table.column(c).to_pylist() for c in ("part", "tokens", "theta"))))
    total, mean = averaged(rows)
    return pa.table({"part": pa.array([min(r[0] for r in rows)], pa.int64()), "tokens": pa.array([total], pa.int64()), "theta": pa.array([mean.astype(np.float32).tobytes()], pa.binary())})


def train_nce(texts: DataFrame, units: Units, unigram: np.ndarray, tokens: int) -> Parameters:
    """Parameters after ``ROUNDS`` rounds over ``texts`` (text), each text in one of them."""
    theta = Parameters.first(unigram)
    kind = "part bigint, tokens bigint, theta binary"
    # a small corpus has few tasks, as each needs enough tokens to learn from
    rows = texts.select("text", F.pmod(F.xxhash64("text", F.lit(7)), F.lit(ROUNDS)).alias("turn")).coalesce(max(1, tokens // (TASK_TOKENS * ROUNDS)))
    for turn in range(ROUNDS):
        own = rows.where(F.col("turn") == turn).select("text", F.spark_partition_id().cast("bigint").alias("part"))
        parts = own.mapInArrow(_trained(units, theta, unigram, turn), kind)
        means = parts.withColumn("group", F.col("part") % GROUPS).groupBy("group").applyInArrow(_group_mean, kind).collect()
        if means:
            theta = Parameters(averaged([tuple(r) for r in means])[1].astype(np.float32), units.number)
    return theta


class Model:
    def __init__(self, tokens: int, distinct: int, docs: int, common: np.ndarray, counts: np.ndarray, units: Units, theta: Parameters, class_tokens: np.ndarray, class_words: np.ndarray):
        self.tokens, self.distinct, self.docs = tokens, distinct, docs
        self.common, self.counts, self.units = common, counts, units
        self.forward = [theta.r @ theta.c[i] for i in range(CONTEXT)]
        # the bias is one more dimension, whose hidden value is 1; scores are logarithms to base 2
        self.forward = [np.hstack((f, np.full((len(f), 1), float(i == 0), np.float32))) for i, f in enumerate(self.forward)]
        self.q = np.ascontiguousarray(np.vstack((theta.q.T, theta.b)) / math.log(2)).astype(np.float32)
        # within these bounds of each unit's scores no sum of powers overflows or vanishes, and none needs a shift
        own = [f @ self.q for f in self.forward]
        self.plain = bool(sum(z.max(axis=0) for z in own).max() < 100 and sum(z.min(axis=0) for z in own).max() > -100)
        # log10 of what shares of a unit are divided by; single words and the end have share 1
        self.below = np.zeros(units.number)
        self.below[units.number - units.classes :] = np.log10(class_tokens + 0.5 * (class_words + 1))

    def log10_units(self, line: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Normalised log10 P(unit | context) of each token of texts in a row."""
        context, out = contexts(line, starts), np.empty(len(line))
        code = np.zeros(len(line), dtype=np.int64)
        for own in context:
            code = code * self.units.number + own
        order = np.argsort(code)
        code = code[order]
        first = np.flatnonzero(np.diff(code, prepend=-1))  # of each distinct context
        after = np.append(first, len(order))[1:]
        ones, space = np.ones(self.units.number, np.float32), np.empty((BLOCK, self.units.number), np.float32)
        for at in range(0, len(first), BLOCK):
            own = context[:, order[first[at : at + BLOCK]]]
            hidden = self.forward[0].take(own[0], axis=0)
            for i in range(1, CONTEXT):
                hidden += self.forward[i].take(own[i], axis=0)
            z = np.matmul(hidden, self.q, out=space[: len(hidden)])
            if not self.plain:
                z -= z.max(axis=1, keepdims=True)
            tokens = order[first[at] : after[at : at + BLOCK][-1]]
            row = np.repeat(np.arange(len(z)), after[at : at + BLOCK] - first[at : at + BLOCK])
            score = z.ravel().take(row * self.units.number + line[tokens]).astype(np.float64)
            out[tokens] = score - np.log2((np.exp2(z, out=z) @ ones).astype(np.float64))[row]
        return out * math.log10(2)

    def facts(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit, whether its count is at hand, and log10 of (count + 0.5) or 0, of each key."""
        known, logs = np.zeros(len(keys), dtype=bool), np.zeros(len(keys))
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, keys), len(self.common) - 1)
            known = self.common[at] == keys
            logs[known] = np.log10(self.counts[at[known]] + 0.5)
        return self.units.of(keys), known, logs

    def parts(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: n_tokens, known common tokens, base and model score without rare words, and number of rare words; and the keys of these."""
        unit, known, logs = self.facts(words.keys)
        line, starts, word = words.lines(unit)
        n = words.lengths + 1
        of_texts = lambda values: np.add.reduceat(values, starts)
        at_hand, log = np.zeros(len(line), dtype=np.int64), np.zeros(len(line))
        at_hand[word], log[word] = known[words.places], logs[words.places]
        found = of_texts(at_hand)
        base = of_texts(log) + math.log10(self.docs + 0.5) - n * math.log10(self.tokens + 0.5 * (self.distinct + 1))
        log[line < self.units.number - self.units.classes] = 0
        score = of_texts(self.log10_units(line, starts) + log - self.below[line])
        return n, found + (self.docs > 0), base, score, words.lengths - found, words.keys[words.places[~known[words.places]]]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model and the table of all word counts (key, c)."""
    own = docs.where(~held_out(F.col(id_col))).select(F.col(text_col).cast("string").alias("text"))
    counts = spool(
        own.mapInArrow(_word_counts, "key bigint, c bigint").groupBy("key").agg(F.sum("c").alias("c")), "lm-counts"
    )
    n_docs = own.count()
    words, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    common = counts.orderBy(F.desc("c"), "key").limit(COMMON).toArrow()
    key, c = (np.asarray(common.column(i).to_numpy()) for i in (0, 1))
    # one word in eight stands alone, and a class takes about thirty, until both bounds are reached
    top, classes = key[: min(MOST_WORDS, distinct // 8)], max(1, min(MOST_CLASSES, distinct // 32))
    units = Units(top, classes)
    kind = F.pmod(F.col("key").bitwiseAND(F.lit(_LOW)), F.lit(classes))
    class_tokens, class_words = np.zeros(classes), np.zeros(classes)
    for row in counts.groupBy(kind.alias("k")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():
        class_tokens[row["k"]], class_words[row["k"]] = row["c"], row["v"]
    np.subtract.at(class_tokens, (top & _LOW) % classes, c[: len(top)])
    np.subtract.at(class_words, (top & _LOW) % classes, 1)
    unigram = np.concatenate(([n_docs], c[: len(top)], class_tokens)) + 0.5
    unigram /= unigram.sum()
    theta = train_nce(own, units, unigram, words + n_docs)
    order = np.argsort(key)
    return Model(words + n_docs, distinct + (n_docs > 0), n_docs, key[order], c[order], units, theta, class_tokens, class_words), counts


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, own = WordKeys(), model.value
        for batch in batches:
            parts = [own.parts(words) for words in split(batch.column("text"), keys)]
            if not parts:
                continue
            n, known, base, score, rare, flat = (np.concatenate(x) for x in zip(*parts))
            offsets = np.concatenate(([0], np.cumsum(rare))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("rid"),
                    batch.column("id"),
                    pa.array(n, pa.int64()),
                    pa.array(known, pa.int64()),
                    pa.array(base, pa.float64()),
                    pa.array(score, pa.float64()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                ],
                names=["rid", "id", "n_tokens", "known", "base", "score", "rare"],
            )

    return run


def scored(docs: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score and score of every row."""
    base = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")
    )
    kind = base.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most COMMON counts, and parameters of one size
    rows = spool(
        base.mapInArrow(_scored(shared), f"rid bigint, id {kind}, n_tokens bigint, known bigint, base double, score double, rare array<bigint>"),
        "lm-rows",
    )
    rare = rows.select("rid", F.explode("rare").alias("key")).groupBy("rid", "key").agg(F.count(F.lit(1)).alias("tf"))
    log = F.log10(F.coalesce("c", F.lit(0)) + 0.5)
    found = (
        rare.join(counts, "key", "left")
        .groupBy("rid")
        .agg(F.sum(F.col("tf") * log).alias("logs"), F.sum(F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0)).alias("more"))
    )
    logs = F.coalesce("logs", F.lit(0.0))
    return rows.join(found, "rid", "left").select(
        "id",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(int(model.tokens)).cast("bigint").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"),
        (F.col("score") + logs).alias("score"),
    )


def op8_language_model(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model, counts = train(docs)
    return scored(docs, model, counts).select(
        F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
