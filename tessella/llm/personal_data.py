"""Personal data by base patterns and a semi-Markov conditional random field.

The base patterns find e-mail addresses, IP addresses, payment cards and phone numbers.  The field adds spans that no
pattern can decide alone: card numbers that fail the check digit, numbers and addresses written in other ways, and
secrets (keys and tokens).  It scores whole candidate segments of up to ``MOST_TOKENS`` tokens by features of the
span as a unit (shape, digits, signs, check digit, entropy, words before it) and a dynamic program chooses the
boundaries and types of all segments of a stretch together.

Tokens are runs without white space.  The program runs over stretches: every token with a digit or an @, every other
token that the field by itself, after the words before it, would come near to call an entity, and ``MOST_TOKENS``
tokens on both sides of each.  No segment with such a token reaches farther; at its edges a stretch goes on with
"other".  That is the answer of a run over the whole text unless the field takes two or more tokens for an entity of
which none stands out.  A stretch is decoded in one piece however long it is, and a text is read to its end.

Weights are learned in numpy by gradient ascent on the log-likelihood (forward-backward over segments) from written
examples: sentences made from a rule with a fixed seed, with entities in many forms and numbers that are none.

Defined cases: a null text counts as empty and has no spans; a text of any length is read to its end; of
segmentations of equal score the one with shorter segments and earlier labels stays; repeated rows and rows without an
id get results of their own; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import documents

#: In the order of the output.
KINDS = ("email", "ip", "card", "phone", "secret")
LABELS = ("other", *KINDS)
#: Bounded entities: most tokens and characters of a segment.
MOST_TOKENS, MOST_CHARS = 6, 160

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S+")
_TRIGGER = re.compile(r"[0-9@]")
#: A token stands out if an entity alone scores higher than "other" or less than so much lower.
DOUBT = 2.0
_NOT_DIGIT = re.compile(r"[^0-9]+")
_TRIM = " .,;:!?\"'()[]{}<>|#*$%&“”«»"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by the patterns: leftmost, non-overlapping within a kind, failing matches dropped."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:  # every e-mail match has its first @ right after a run of local characters
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        match = _EMAIL.match(text, start) if start < at else None
        if match:
            out.append((0, start, match.end()))
            free = match.end()
        at = text.find("@", max(free, at + 1))
    for m in _IP.finditer(text):
        # a part of many digits cannot be an octet unless it is padded with zeros
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((3, *m.span()))
    return sorted(out)


# --- features of a whole span -------------------------------------------------------------------------------------

_HINTS = {
    "mail": frozenset("mail email e-mail contact write reach".split()),
    "phone": frozenset("phone tel telephone call mobile fax cell".split()),
    "card": frozenset("card visa mastercard amex credit payment account".split()),
    "ip": frozenset("ip host server address login".split()),
    "secret": frozenset("token key secret password passwd api_key apikey api-key access_key auth bearer".split()),
}
_HINT_WORDS = frozenset().union(*_HINTS.values(), ("=", ":", ":="))
FEATURE_BITS = 12
N_FEATURES = 1 << FEATURE_BITS


def _bin(n: int) -> int:
    return n if n < 5 else 5 + (n > 8) + (n > 12) + (n > 15) + (n > 16) + (n > 19) + (n > 30) + (n > 38)


def _slot(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=4).digest(), "little") % N_FEATURES


class _Slots(dict):
    def __missing__(self, name: str) -> int:
        value = self[name] = _slot(name)
        return value


_SLOTS = _Slots()


def span_features(text: str, start: int, end: int, tokens: int, before: list[str]) -> list[int]:
    """Hashed features of text[start:end], a segment of ``tokens`` tokens, given up to three words before it."""
    span = text[start:end]
    core = span.strip(_TRIM + "+") if tokens == 1 else span.strip(" .,;:!?\"'|#*$%&")
    digits = sum(c.isdigit() for c in core)
    letters = sum(c.isalpha() for c in core)
    hexes = bool(core) and all(c in "0123456789abcdefABCDEF" for c in core)
    names = [
        f"n{tokens}",
        f"d{_bin(digits)}",
        f"l{_bin(letters)}",
        f"n{tokens}d{_bin(digits)}l{min(letters, 1)}",
        f"dots{min(core.count('.'), 4)}d{min(digits, 13)}l{min(letters, 1)}",
        f"at{core.count('@')}dot{'.' in core.rpartition('@')[2]}n{tokens}",
        f"plus{span.lstrip(_TRIM)[:1] == '+'}d{_bin(digits)}",
        f"paren{'(' in span}dash{min(span.count('-'), 2)}d{_bin(digits)}",
        f"ends{text[start:start + 1] in _TRIM}{core[:1].isdigit()}{core[-1:].isdigit()}",
        f"only{digits == len(core)}d{_bin(digits)}n{tokens}",
    ]
    if hexes:
        names.append(f"hex{_bin(len(core))}mixed{bool(digits and letters)}")
    elif letters and digits and core.isalnum():
        names.append(f"alnum{_bin(len(core))}")
    if 13 <= digits <= 19 and not letters:
        names.append(f"luhn{luhn(_NOT_DIGIT.sub('', core))}")
        names.append("groups" + "-".join(str(len(g)) for g in re.split(r"[ -]+", core)[:6]))
    parts = core.split(".")
    if len(parts) == 4 and all(p.isdecimal() for p in parts):  # not "²", which is a digit but no number
        names.append(f"octets{all(len(p) <= 3 and int(p) < 256 for p in parts)}")
    for kind, words in _HINTS.items():
        for far, word in enumerate(reversed(before)):
            if word in words:
                names.append(f"after-{kind}{far}")
    if before and before[-1] in ("=", ":", ":="):
        names.append(f"assigned{hexes}")
    if tokens > 1:
        names.append("inner" + "".join("d" if t[:1].isdigit() else "(" if t[:1] in "(+" else "@" if "@" in t else "a" for t in span.split()))
    return [_SLOTS[n] for n in names]


class SegmentField:
    """Semi-Markov field: segment weights per label, and weights for neighbouring labels."""

    def __init__(self, weights: np.ndarray | None = None, moves: np.ndarray | None = None):
        k = len(LABELS)
        self.weights = np.zeros((N_FEATURES, k)) if weights is None else weights
        self.moves = np.zeros((k, k)) if moves is None else moves
        self._usual: set[int] | None = None

    def segments(self, text: str, tokens: list[tuple[int, int]], before: list[str]) -> list[list[tuple[int, list[int]]]]:
        """For each token: (number of tokens, features) of the candidate segments that end with it."""
        words = before + _words(text, tokens)
        return [self.ending(text, tokens, words, len(before), j) for j in range(len(tokens))]

    def ending(self, text: str, tokens: list[tuple[int, int]], words: list[str], skip: int, j: int) -> list[tuple[int, list[int]]]:
        """The segments that end with token ``j``; ``words`` has ``skip`` words more, before those of the tokens."""
        own = []
        for n in range(1, min(MOST_TOKENS, j + 1) + 1):
            i = j - n + 1
            if n > 1 and tokens[j][1] - tokens[i][0] > MOST_CHARS:
                break
            at = skip + i
            own.append((n, span_features(text, tokens[i][0], tokens[j][1], n, words[max(0, at - 3) : at])))
        return own

    def scores(self, segments) -> list[list[tuple[int, np.ndarray]]]:
        return [self.row(own) for own in segments]

    def row(self, own: list[tuple[int, list[int]]]) -> list[tuple[int, np.ndarray]]:
        row = []
        for n, f in own:
            s = self.weights[f].sum(axis=0)
            if n > 1:
                s[0] = -np.inf  # other tokens stand alone
            row.append((n, s))
        return row

    def stands_out(self, text: str, start: int, end: int, before: list[str]) -> bool:
        """Whether one token between others comes near to being an entity."""
        s, m = self.weights[span_features(text, start, end, 1, before)].sum(axis=0), self.moves
        return (s + m[0] + m[:, 0])[1:].max() + DOUBT > s[0] + 2 * m[0, 0]

    def usual(self) -> set[int]:
        """Lengths (40 for longer) at which no word of letters only, with whatever signs round it, stands out without a hint."""
        if self._usual is None:
            forms = [(lead, c, tail) for lead in ("", ",", "(") for c in "az" for tail in ("", "(")]
            self._usual = {n for n in range(1, 41) if not any(self.stands_out(t, 0, len(t), []) for t in (a + c * n + b for a, c, b in forms))}
        return self._usual

    def viterbi(self, text: str, tokens: list[tuple[int, int]], before: list[str], inner: tuple[bool, bool] = (False, False)) -> list[tuple[int, int, int]]:
        """(label, first token, token after the last) of the best segmentation, entities only.

        ``inner``: whether an "other" token comes before and after the tokens.  Features and scores are held for
        the last tokens only, and two bytes for each token and label."""
        k, words = len(LABELS), before + _words(text, tokens)
        best: list = [None]
        back = np.zeros((len(tokens) + 1, k, 2), np.int8)
        for j in range(len(tokens)):
            value = np.full(k, -np.inf)
            for n, s in self.row(self.ending(text, tokens, words, len(before), j)):
                prior = best[-n]
                if prior is None:
                    total, came = s + self.moves[0] if inner[0] else s, np.zeros(k, int)
                else:
                    through = prior[:, None] + self.moves
                    came = through.argmax(axis=0)
                    total = s + through.max(axis=0)
                better = total > value
                value[better] = total[better]
                back[j + 1, better, 0], back[j + 1, better, 1] = n, came[better]
            best = [*best[-MOST_TOKENS + 1 :], value]
        out, j, y = [], len(tokens), int((best[-1] + self.moves[:, 0] * inner[1]).argmax()) if tokens else 0
        while j:
            n, came = map(int, back[j, y])
            if y:
                out.append((y, j - n, j))
            j, y = j - n, came
        return out[::-1]

    def gradient(self, segments, truth: list[tuple[int, int, int]], grad_w: np.ndarray, grad_m: np.ndarray) -> float:
        """Adds expected minus true features and moves; the log-likelihood of ``truth`` (label, first, after)."""
        scores, k = self.scores(segments), len(LABELS)
        n = len(scores)
        alpha = [np.full(k, -np.inf) for _ in range(n + 1)]
        into = {}
        for j, row in enumerate(scores):
            for length, s in row:
                i = j + 1 - length
                start = np.zeros(k) if not i else _lse(alpha[i][:, None] + self.moves)
                into[j, length] = start
                alpha[j + 1] = np.logaddexp(alpha[j + 1], start + s)
        beta = [np.full(k, -np.inf) for _ in range(n)] + [np.zeros(k)]
        after = [np.full(k, -np.inf) for _ in range(n)]  # segments that begin at i, by their label
        for i in range(n - 1, -1, -1):
            for j in range(i, min(n, i + MOST_TOKENS)):
                for length, s in scores[j]:
                    if length == j - i + 1:
                        after[i] = np.logaddexp(after[i], s + beta[j + 1])
            if i:
                beta[i] = _lse((self.moves + after[i][None, :]).T)
        total = _lse(alpha[n][:, None])[0]
        for j, row in enumerate(scores):
            for (length, s), (_, f) in zip(row, segments[j]):
                p = np.exp(into[j, length] + s + beta[j + 1] - total)
                np.add.at(grad_w, f, p)
        for i in range(1, n):
            grad_m += np.exp(alpha[i][:, None] + self.moves + after[i][None, :] - total)
        gold, last = 0.0, None
        for y, a, b in truth:
            s, f = next((s, f) for (length, s), (_, f) in zip(scores[b - 1], segments[b - 1]) if length == b - a)
            gold += s[y] + (self.moves[last, y] if last is not None else 0.0)
            for x in f:
                grad_w[x, y] -= 1
            if last is not None:
                grad_m[last, y] -= 1
            last = y
        return gold - total

    def fit(self, examples: list[tuple[str, list[tuple[int, int, int]]]], rounds: int = 8, rate: float = 0.3, decay: float = 1e-3, seed: int = 3) -> SegmentField:
        """AdaGrad over small batches of (text, truth by tokens)."""
        ready, self._usual = [], None
        for text, truth in examples:
            tokens = [m.span() for m in _TOKEN.finditer(text)]
            ready.append((self.segments(text, tokens, []), truth))
        squares_w, squares_m = np.full_like(self.weights, 1e-6), np.full_like(self.moves, 1e-6)
        order = random.Random(seed)
        for _ in range(rounds):
            order.shuffle(ready)
            for at in range(0, len(ready), 16):
                batch = ready[at : at + 16]
                grad_w, grad_m = np.zeros_like(self.weights), np.zeros_like(self.moves)
                for segments, truth in batch:
                    self.gradient(segments, truth, grad_w, grad_m)
                grad_w, grad_m = grad_w / len(batch) + decay * self.weights, grad_m / len(batch) + decay * self.moves
                squares_w += grad_w**2
                squares_m += grad_m**2
                self.weights -= rate * grad_w / np.sqrt(squares_w)
                self.moves -= rate * grad_m / np.sqrt(squares_m)
        return self


def _words(text: str, tokens: list[tuple[int, int]]) -> list[str]:
    return [text[a:b].strip(_TRIM).lower() or text[a:b] for a, b in tokens]


def _lse(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=0)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - safe).sum(axis=0)) + safe


# --- written examples ---------------------------------------------------------------------------------------------


def written_examples(count: int, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Texts of a few tokens with their true segmentation, from a fixed rule."""
    r = random.Random(seed)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    letters = lambda a, b: "".join(r.choice("abcdefghijklmnopqrstuvwxyzéèäöüñ" if r.random() < 0.3 else "etaoinshrdlu") for _ in range(r.randint(a, b)))
    alphas = lambda a, b: "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(r.randint(a, b)))
    octet = lambda: str(r.randint(0, 255))
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))

    def email():
        host = ".".join([letters(2, 8).encode("ascii", "ignore").decode() or "mail", r.choice(["com", "org", "example.com", "de", "co.uk", "net"])])
        name = r.choice([letters(2, 9), f"{letters(2, 6)}.{digits(2)}", f"{letters(1, 5)}.{letters(2, 8)}", f"{letters(2, 6)}_{digits(1)}"]).encode("ascii", "ignore").decode() or "a1"
        return r.choice([f"{name}@{host}", f"{name}@{host}", f"{name} @ {host}", f"{name}@{letters(3, 8).encode('ascii', 'ignore').decode() or 'host'}"])

    def ip():
        return ".".join(octet() for _ in range(4)) + (f":{r.randint(80, 9999)}" if r.random() < 0.15 else "")

    def card():
        n = r.choice([16, 16, 16, 16, 15, 13, 19])
        d = digits(n)
        if r.random() < 0.4:
            return " ".join(d[i : i + 4] for i in range(0, n, 4)) if r.random() < 0.6 else "-".join(d[i : i + 4] for i in range(0, n, 4))
        return d

    def phone():
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice([f"+{r.randint(1, 99)} ({a}) {b}-{c}", f"+{r.randint(1, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{digits(11)}", f"({a}) 555-{c}", f"+1 ({a}) 555-{c}"])

    def secret():
        return f'"{hexes(40)}"' if r.random() < 0.6 else r.choice([hexes(32), hexes(64), f"sk-{hexes(24)}", f'"{hexes(40).upper()}"', alphas(24, 40), f'"{alphas(24, 40)}"'])

    def number():
        return r.choice(
            [
                digits(r.randint(1, 4)),
                str(r.randint(1900, 2030)),
                f"{r.randint(0, 9)}.{r.randint(0, 9)}",
                f"{r.randint(0, 99)}.{digits(2)}",
                f"{r.randint(1, 12)}:{r.randint(10, 59)}",
                f"20{digits(2)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}",
                f"v{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}",
                f"{digits(3)},{digits(3)}",
                f"{letters(2, 5)}{digits(2)}",
                f"#{digits(r.randint(2, 7))}",
                f"@{letters(3, 8)}",
                digits(r.randint(5, 9)),
                f"{r.randint(1, 99)}%",
                f"{digits(2)}-{digits(2)}",
                f"{r.randint(0, 300)}.{r.randint(0, 300)}.{r.randint(0, 9)}",
            ]
        )

    make = {"email": email, "ip": ip, "card": card, "phone": phone, "secret": secret}
    hints = {"email": ["mail", "contact"], "ip": ["host", "ip"], "card": ["card", "visa"], "phone": ["call", "tel"], "secret": ["token =", "key =", "secret :", "password ="]}
    tail = ["", "", "", ".", ",", "!!", "***", "$$$", "%%%", "&&&", "###", " |"]
    out = []
    for _ in range(count):
        pieces: list[tuple[int, str]] = []
        for _ in range(r.randint(1, 3)):
            for _ in range(r.randint(0, 3)):
                pieces.append((0, (letters(1, 9) if r.random() < 0.75 else number()) + r.choice(tail)))
            if r.random() < 0.75:
                kind = r.choice(KINDS)
                if r.random() < (0.9 if kind == "secret" else 0.2):
                    pieces.append((0, r.choice(hints[kind])))
                text = make[kind]() + r.choice(tail)
                pieces.append((LABELS.index(kind), text.upper() if r.random() < 0.08 else text))
            else:
                pieces.append((0, number() + r.choice(tail)))
        truth, text, at = [], "", 0
        for label, piece in pieces:
            if not piece.strip():
                continue
            n = len(piece.split())
            if label and piece.endswith(" |"):
                truth.append((label, at, at + n - 1))
                truth.append((0, at + n - 1, at + n))
            elif label:
                truth.append((label, at, at + n))
            else:
                truth += [(0, at + i, at + i + 1) for i in range(n)]
            text, at = f"{text} {piece}".strip(), at + n
        if truth and all(b - a <= MOST_TOKENS for _, a, b in truth):
            out.append((text, truth))
    return out


def trained(examples: int = 1200, seed: int = 11) -> SegmentField:
    return SegmentField().fit(written_examples(examples, seed))


# --- whole texts --------------------------------------------------------------------------------------------------


def stretches(text: str, field: SegmentField) -> Iterator[tuple[list[tuple[int, int]], list[str], tuple[bool, bool]]]:
    """Tokens that stand out with ``MOST_TOKENS`` tokens on both sides, the three words before, whether text goes on."""
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    usual, first, after, hint = field.usual(), 0, 0, 0
    for k, (start, end) in enumerate(tokens):
        token = text[start:end]
        core = token.strip(_TRIM)
        if _TRIGGER.search(token):
            out = True
        elif not hint and core.isalpha() and min(len(core), 40) in usual:
            out = False
        else:
            out = field.stands_out(text, start, end, _words(text, tokens[max(0, k - 3) : k]))
        hint = 3 if (core.lower() or token) in _HINT_WORDS else max(hint - 1, 0)
        if out:
            low = max(0, k - MOST_TOKENS)
            if low > after or not after:
                if after:
                    yield tokens[first:after], _words(text, tokens[max(0, first - 3) : first]), (first > 0, True)
                first = low
            after = min(len(tokens), k + MOST_TOKENS + 1)
    if after:
        yield tokens[first:after], _words(text, tokens[max(0, first - 3) : first]), (first > 0, after < len(tokens))


def field_spans(text: str, field: SegmentField) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the field's entities, without the signs round them."""
    out = []
    for tokens, before, inner in stretches(text, field):
        for label, a, b in field.viterbi(text, tokens, before, inner):
            start, end = tokens[a][0], tokens[b - 1][1]
            while end > start and text[end - 1] in _TRIM:
                end -= 1
            while start < end and text[start] in _TRIM and not (label == 4 and text[start] == "("):
                start += 1
            if start < end:
                out.append((label - 1, start, end))
    return out


def all_spans(text: str | None, field: SegmentField) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans; base spans and those of the field that overlap none of them, in order of kind and place."""
    if not text:
        return [], []
    base = base_spans(text)
    taken = sorted((s, e) for _, s, e in base)
    added, i = [], 0
    for kind, start, end in sorted(field_spans(text, field), key=lambda x: x[1]):
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        if i == len(taken) or taken[i][0] >= end:
            added.append((kind, start, end))
    return base, sorted(base + added)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def _found(field: SegmentField):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = [], [], []
            for text in batch.column("text"):
                base, every = all_spans(text.as_py(), field)
                counts.append([sum(k == kind for k, _, _ in base) for kind in range(4)])
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(every))
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *columns, pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                names=["id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    return run


def personal_data(docs: DataFrame, field: SegmentField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    return base.mapInArrow(
        _found(field), f"id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"
    )


def op6_personal_data(spark, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir), trained()).withColumnRenamed("id", "doc_id")
