"""Quality rules over lines: a linear-chain conditional random field labels every line as content or boilerplate.

A line is described by a few binned properties (length, letter case, signs, separators, repetition, ending ...).  The
field has a weight for each bin and label and one for each pair of neighbouring labels; Viterbi decoding gives the
most probable labels of a whole text at once, and the share of its words that stand in content lines decides whether
the document stays.

Training is by maximum likelihood in numpy on a sample of at most ``TRAIN_DOCS`` labelled documents, the first by a
hash of the identifier, that have ``TRAIN_LINES`` lines together at most (a document enters whole or not at all).  A
document's label says only on which side its content share lies, so the labels of its lines are latent.  They start
as the document's label, seen by single lines without neighbours; then the field's posterior relabels every line, as
far as the document's own label allows, and the field with its moves is fitted anew, a few times.  So a good document
may hold boilerplate lines and a bad one content lines, and the moves are learned from both.  Without labels nothing
is boilerplate.

Defined cases: a null or empty text has no words and fails the base rules; a text of any length is labelled line by
line to its end; ties between labels go to content; repeated rows and identifiers are judged row by row; extra columns
are carried by ``kept_documents``; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import documents, spool

#: Most documents in the training sample, and most lines that they have together.
TRAIN_DOCS, TRAIN_LINES = 3000, 200_000
#: Documents with less than this share of their words in content lines are rejected.
CONTENT_SHARE = 0.5
MIN_WORDS, REPEAT_PCT = 50, 50

_SPACE = b" \t\n\r\x0b\x0c"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = b"0123456789"
_SIGNS = b"#*$%&|<>"
BINS, FEATURES = 8, 10


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=n)
    k = len(seen)
    pairs = ids[:-1] * k + ids[1:]
    if k >= 2_000_000:
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * k + ids[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(ranked), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    starts = order[twice]
    covered = np.zeros(n, dtype=bool)
    for i in range(3):
        covered[starts + i] = True
    return int(covered.sum())


def _cut(value: float, bounds: tuple) -> int:
    for i, bound in enumerate(bounds):
        if value < bound:
            return i
    return len(bounds)


def line_features(line: bytes, words: list[bytes], repeated: bool) -> tuple[int, ...]:
    n, size = len(words), max(1, len(line))
    upper = len(line) - len(line.translate(None, _UPPER))
    lower = len(line) - len(line.translate(None, _LOWER))
    signs = len(line) - len(line.translate(None, _SIGNS))
    bars = line.count(b"|")
    last = line.rstrip(_SPACE)[-1:]
    return (
        _cut(n, (2, 4, 8, 16, 32, 64, 128)),
        _cut(upper / max(1, upper + lower), (0.02, 0.1, 0.3, 0.6, 0.9)),
        _cut((signs - bars) / n, (0.02, 0.2, 0.7, 1.5)),
        _cut(bars / n, (0.02, 0.15, 0.35)),
        _cut(line.count(b"!!") / n, (0.02, 0.3)),
        _cut((len(line) - len(line.translate(None, _DIGIT))) / size, (0.01, 0.1, 0.3)),
        _cut(len(set(words)) / n, (0.2, 0.4, 0.6, 0.8)) if n >= 8 else 5,
        _cut(size / n, (3, 5, 7, 9, 12, 20)),
        0 if last in (b".", b"!", b"?") else 1 if last.isalnum() else 2,
        int(repeated),
    )


def measured(text: str | None) -> tuple[tuple[int, int, int, int, int], np.ndarray, np.ndarray]:
    """Base figures (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words); features and words of each line."""
    if not text:
        return (0, 0, 0, 0, 0), np.empty((0, FEATURES), np.int8), np.empty(0, np.int64)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    seen, features, counts, doubles = set(), [], [], 0
    for line in raw.split(b"\n"):
        own = line.split()
        if own:
            repeated = line in seen
            seen.add(line)
            doubles += repeated
            features.append(line_features(line, own, repeated))
            counts.append(len(own))
    base = (
        len(words),
        len(text) - (len(raw) - len(raw.translate(None, _SPACE))),
        len(raw) - len(raw.translate(None, _SIGNS)),
        doubles,
        repeated_words(words),
    )
    return base, np.array(features, dtype=np.int8).reshape(-1, FEATURES), np.array(counts, dtype=np.int64)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix products of many 2 x 2 matrices (last axis), each scaled to a largest entry of 1."""
    c = a[:, 0, None] * b[None, 0] + a[:, 1, None] * b[None, 1]
    return c / c.max(axis=(0, 1))


class LineField:
    """A linear-chain conditional random field over labels 0 (content) and 1 (boilerplate)."""

    def __init__(self, weights: np.ndarray | None = None, moves: np.ndarray | None = None):
        self.weights = np.zeros((FEATURES, BINS, 2)) if weights is None else weights
        self.moves = np.zeros((2, 2)) if moves is None else moves

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return self.weights[np.arange(FEATURES), features].sum(axis=1)

    def viterbi(self, features: np.ndarray) -> np.ndarray:
        """The most probable labels of the lines of one text; ties go to content."""
        gain = self.emissions(features).tolist()
        (a, b), (c, d) = self.moves.tolist()
        back, s0, s1 = [], 0.0, 0.0
        for i, (e0, e1) in enumerate(gain):
            if not i:
                s0, s1 = e0, e1
                continue
            from0, from1 = s1 + c > s0 + a, s1 + d > s0 + b
            back.append((from0, from1))
            s0, s1 = (s1 + c if from0 else s0 + a) + e0, (s1 + d if from1 else s0 + b) + e1
        label = int(s1 > s0)
        labels = [label]
        for step in reversed(back):
            label = int(step[label])
            labels.append(label)
        return np.array(labels[::-1] if gain else [], dtype=np.int8)

    def posteriors(self, e: np.ndarray, starts: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
        """Of lines of many texts in a row (``starts``: first lines): P(label), and P(label before, label), by line.

        Forward and backward messages are products of 2 x 2 matrices, taken for all lines at once by doubling; a first
        line's matrix has equal rows, so nothing passes from one text to the next.
        """
        n = len(e)
        own = np.exp(e - e.max(axis=1, keepdims=True)).T
        step = np.exp(self.moves)[:, :, None] * own
        ends = np.append(starts[1:], True)
        ahead, back = np.where(starts, own, step), np.ones((2, 2, n))
        back[:, :, :-1] = np.where(ends[:-1], 1.0, step[:, :, 1:])
        d = 1
        while d < longest:
            ahead[:, :, d:] = _products(ahead[:, :, :-d], ahead[:, :, d:])
            back[:, :, :-d] = _products(back[:, :, :-d], back[:, :, d:])
            d *= 2
        alpha, beta = ahead[0], back[:, 0]
        one = alpha * beta
        two = np.zeros((2, 2, n))
        two[:, :, 1:] = alpha[:, None, :-1] * step[:, :, 1:] * beta[None, :, 1:] * ~starts[1:]
        return (one / one.sum(axis=0)).T, (two / np.maximum(two.sum(axis=(0, 1)), 1e-300)).transpose(2, 0, 1)

    def fit(self, features: np.ndarray, labels: np.ndarray, starts: np.ndarray, chained: bool = True, rounds: int = 80, rate: float = 0.15, decay: float = 1e-3) -> LineField:
        """Adam on the mean log-likelihood of the labels of lines in a row; without ``chained`` the moves stay."""
        n = len(features)
        if not n:
            return self
        longest = int(np.diff(np.append(np.flatnonzero(starts), n)).max())
        size = self.weights.size
        theta = np.concatenate((self.weights.ravel(), self.moves.ravel()))
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        true = np.zeros((2, 2))
        inner = np.flatnonzero(~starts)
        np.add.at(true, (labels[inner - 1], labels[inner]), 1)
        for step in range(1, rounds + 1):
            self.weights, self.moves = theta[:size].reshape(self.weights.shape), theta[size:].reshape(2, 2)
            one, two = self.posteriors(self.emissions(features), starts, longest if chained else 1)
            one[np.arange(n), labels] -= 1
            w_grad = np.empty_like(self.weights)
            for f in range(FEATURES):
                for label in (0, 1):
                    w_grad[f, :, label] = np.bincount(features[:, f], weights=one[:, label], minlength=BINS)
            m_grad = (two.sum(axis=0) - true) * chained
            grad = np.concatenate((w_grad.ravel(), m_grad.ravel())) / n + decay * theta
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.weights, self.moves = theta[:size].reshape(self.weights.shape), theta[size:].reshape(2, 2)
        return self

    def fit_documents(self, texts: list[tuple[np.ndarray, np.ndarray, int]], relabelled: int = 3) -> LineField:
        """Fit on (features, words of each line, quality) of whole documents; the lines' labels are latent."""
        texts = [t for t in texts if len(t[0])]
        if not texts or len({t[2] for t in texts}) < 2:
            return self
        features = np.concatenate([t[0] for t in texts])
        sizes = np.array([len(t[0]) for t in texts])
        first = np.cumsum(sizes) - sizes
        starts = np.zeros(len(features), dtype=bool)
        starts[first] = True
        labels = np.repeat([1 - t[2] for t in texts], sizes)
        self.fit(features, labels, starts, chained=False)
        for _ in range(relabelled):
            boiler = self.posteriors(self.emissions(features), starts, int(sizes.max()))[0][:, 1]
            labels = np.concatenate([allowed_labels(boiler[a : a + k], words, quality) for a, k, (_, words, quality) in zip(first, sizes, texts)])
            self.fit(features, labels, starts)
        return self


def allowed_labels(boiler: np.ndarray, words: np.ndarray, quality: int) -> np.ndarray:
    """Labels by posterior; the most doubtful ones turn until the content share lies on the side of ``quality``."""
    labels = (boiler > 0.5).astype(np.int64)
    content, half = int(words[labels == 0].sum()), CONTENT_SHARE * int(words.sum())
    for i in np.argsort(boiler if quality else -boiler, kind="stable"):
        if (content >= half) == bool(quality):
            break
        if labels[i] == quality:
            labels[i] = 1 - quality
            content += int(words[i]) if quality else -int(words[i])
    return labels


def _sampled_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measured(t.as_py())[1:] for t in batch.column("text")]
        lines = [f.tobytes() for f, _ in rows], [w.astype(np.int32).tobytes() for _, w in rows]
        n = pa.array([len(f) for f, _ in rows], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("quality"), n, *(pa.array(x, pa.binary()) for x in lines)], names=["place", "quality", "n", "lines", "words"])


def train(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text") -> LineField:
    """Fit on at most ``TRAIN_DOCS`` labelled rows of ``docs``; only their binned lines come to the driver."""
    if labels is None:
        return LineField()
    place = F.xxhash64("_id")
    picked = (
        labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("quality"))
        .where("_id is not null and quality in (0, 1)")
        .orderBy(place, "_id")
        .limit(TRAIN_DOCS)
        .withColumn("place", place)
    )
    sample = spool(
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
        .join(F.broadcast(picked), "_id")  # at most TRAIN_DOCS rows
        .select("place", "quality", "text")
        .mapInArrow(_sampled_lines, "place bigint, quality int, n bigint, lines binary, words binary"),
        "quality-sample",
    )
    sizes = sorted((r["place"], r["n"]) for r in sample.groupBy("place").agg(F.sum("n").alias("n")).collect())
    total, taken = 0, []
    for place, n in sizes:
        if total + n <= TRAIN_LINES:
            total += n
            taken.append(place)
    texts = []
    for r in sample.where(F.col("place").isin(taken)).collect():
        features = np.frombuffer(bytes(r["lines"]), dtype=np.int8).reshape(-1, FEATURES).astype(np.int64)
        texts.append((features, np.frombuffer(bytes(r["words"]), dtype=np.int32), r["quality"]))
    texts.sort(key=lambda t: (t[0].tobytes(), t[1].tobytes(), t[2]))
    return LineField().fit_documents(texts)


def judged(text: str | None, field: LineField) -> tuple[int, int, int, int, int, bool, float, bool]:
    base, features, counts = measured(text)
    failed = base[0] < MIN_WORDS or 100 * base[4] > REPEAT_PCT * base[0]
    if not len(features):
        return (*base, failed, 0.0, False)
    share = float(counts[field.viterbi(features.astype(np.int64)) == 0].sum() / counts.sum())
    return (*base, failed, share, not failed and share >= CONTENT_SHARE)


FIGURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, content_share double, kept boolean"


def _judge(weights: np.ndarray, moves: np.ndarray, text_at: int):
    names = [x.split()[0] for x in FIGURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = LineField(weights, moves)
        for batch in batches:
            rows = list(zip(*(judged(t.as_py(), field) for t in batch.column(text_at)))) or [()] * len(names)
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            out = [pa.array(list(v), k) for v, k in zip(rows, kinds)]
            # figures travel as one struct beside the columns handed in, whatever those are called
            figures = pa.StructArray.from_arrays(out, names=names)
            keep = [batch.column(i) for i in range(batch.num_columns) if i != text_at]
            yield pa.RecordBatch.from_arrays([*keep, figures], names=[*(f"c{i}" for i in range(len(keep))), "quality"])

    return run


def figures(docs: DataFrame, field: LineField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the figures and verdict of every row."""
    base = docs.select(F.col(id_col).alias("c0"), F.col(text_col).cast("string").alias("text"))
    kind = base.schema["c0"].dataType.simpleString()
    out = base.mapInArrow(_judge(field.weights, field.moves, 1), f"c0 {kind}, quality struct<{FIGURES.replace(' ', ':').replace(',:', ',')}>")
    return out.select(F.col("c0").alias("id"), "quality.*")


def kept_documents(docs: DataFrame, field: LineField, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LineField(field.weights, field.moves)
        for batch in batches:
            at = batch.schema.names.index(text_col)
            yield batch.filter(pa.array([judged(t.as_py(), own)[-1] for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_line_quality(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    field = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return figures(docs, field).withColumnRenamed("id", "doc_id")
