import hashlib
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from tessella.llm import personal_data as pd
from tests.llm.fixtures import awkward, awkward_rows, empty

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(text):
    return re.sub("[^0-9]", "", text)


def brute_base(text):
    text, out = text or "", []
    out += [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m.group())) <= 19 and pd.luhn(digits(m.group()))]
    out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15]
    return sorted(out)


@pytest.fixture(scope="module")
def field():
    return pd.trained(examples=500)


def check_rows(rows, texts):
    for r in rows:
        base = brute_base(texts[r[0]])
        assert [r[1 + k] for k in range(4)] == [sum(x[0] == k for x in base) for k in range(4)]
        assert r[5] == hashlib.sha256(",".join(f"{pd.KINDS[k]}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        spans = [s.split(":") for s in r[6].split(",") if s]
        assert {f"{pd.KINDS[k]}:{a}:{b}" for k, a, b in base} <= {":".join(s) for s in spans}
        order = [(pd.KINDS.index(k), int(a), int(b)) for k, a, b in spans]
        assert order == sorted(order) and all(0 <= a < b <= len(texts[r[0]] or "") for _, a, b in order)


def test_whole_table(spark, field):
    table = pq.read_table("/root/testdata/sf0.001/documents.parquet")
    texts = dict(zip(table["doc_id"].to_pylist(), table["text"].to_pylist()))
    rows = pd.personal_data(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), field).collect()
    assert len(rows) == len(texts)
    check_rows(rows, texts)


def test_awkward_rows(spark, field):
    rows = pd.personal_data(awkward(spark), field).collect()
    assert len(rows) == len(awkward_rows())
    texts = {r[0]: r[1] for r in awkward_rows() if r[0] not in (2, None)}
    check_rows([r for r in rows if r[0] in texts], texts)
    # repeated ids and rows without one, row by row
    want = sorted((str(r[0]), pd.written(pd.all_spans(r[1], field)[1])) for r in awkward_rows())
    assert sorted((str(r[0]), r[6]) for r in rows) == want
    assert pd.personal_data(empty(spark), field).count() == 0


def test_base_spans_against_the_patterns():
    rng = np.random.default_rng(5)
    parts = ["a@b.co", "x.y+z@host", "@", "a@b@c.de.", "1.2.3.4", "256.1.1.1", "1.2.3.4.5", "0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+12", "++49 30 1234567", "word", "12", "é@ü.de", "ab..@x.y.z-", "-", " ", "\n", "1" * 25]
    for _ in range(3000):
        text = "".join(str(parts[i]) + ("" if rng.random() < 0.4 else " ") for i in rng.integers(0, len(parts), rng.integers(1, 9)))
        assert pd.base_spans(text) == brute_base(text), text


def test_viterbi_is_the_best_segmentation():
    rng = np.random.default_rng(6)
    text = "call 12 34 56 key @ab 7"
    tokens = [m.span() for m in re.finditer(r"\S+", text)]
    field = pd.SegmentField(rng.normal(size=(pd.N_FEATURES, len(pd.LABELS))), rng.normal(size=(len(pd.LABELS),) * 2))
    scores = field.scores(field.segments(text, tokens, []))

    def best(end, label):
        """Best score of tokens before ``end`` whose last segment has ``label``."""
        top = -np.inf
        for n, s in scores[end - 1]:
            begin = end - n
            before = 0.0 if not begin else max(best(begin, y) + field.moves[y, label] for y in range(len(pd.LABELS)))
            top = max(top, before + s[label])
        return top

    def value(found):
        inside, segments, at = {a: (y, b) for y, a, b in found}, [], 0
        while at < len(tokens):
            y, b = inside.get(at, (0, at + 1))
            segments.append((y, at, b))
            at = b
        total, last = 0.0, None
        for y, a, b in segments:
            total += next(s for n, s in scores[b - 1] if n == b - a)[y] + (field.moves[last, y] if last is not None else 0.0)
            last = y
        return total

    limited = len(tokens)
    assert abs(value(field.viterbi(text, tokens, [])) - max(best(limited, y) for y in range(len(pd.LABELS)))) < 1e-9


def test_held_out_written_examples(field):
    right = wrong = missed = 0
    for text, truth in pd.written_examples(300, seed=99):
        tokens = [m.span() for m in re.finditer(r"\S+", text)]
        gold = {t for t in truth if t[0]}
        got = set(field.viterbi(text, tokens, []))
        right, wrong, missed = right + len(got & gold), wrong + len(got - gold), missed + len(gold - got)
    assert right / (right + wrong) > 0.9 and right / (right + missed) > 0.9, (right, wrong, missed)


def test_the_field_finds_what_no_pattern_finds(field):
    text = "my phone is (555) 123-4567 and the token = \"" + "0a1b2c3d4e" * 4 + "\" was leaked"
    base, every = pd.all_spans(text, field)
    assert not [x for x in base if x[0] in (3, 4)]
    found = {(pd.KINDS[k], text[a:b]) for k, a, b in every}
    assert ("phone", "(555) 123-4567") in found and ("secret", "0a1b2c3d4e" * 4) in found
    assert pd.all_spans("In 1998 about 12 of 300 people paid 4.50 for version v1.2.3 of it.", field)[1] == []


def test_held_out_written_examples_in_whole_texts(field):
    """Through all_spans, each example within a longer text of words."""
    found = missed = spaced = spaced_found = 0
    for text, truth in pd.written_examples(300, seed=98):
        whole = f"{'plain words of prose ' * 9}{text} {'more words of prose ' * 9}"
        at, tokens = whole.index(text), [m.span() for m in re.finditer(r"\S+", text)]
        every = pd.all_spans(whole, field)[1]
        for label, a, b in (t for t in truth if t[0]):
            start, end = at + tokens[a][0], at + tokens[b - 1][1]
            hit = any(k == label - 1 and s < end and e > start for k, s, e in every)
            found, missed = found + hit, missed + (not hit)
            if label == 1 and b - a == 3:
                tight = any(k == 0 and s == start and whole[s:e] == whole[start:end].rstrip(pd._TRIM) for k, s, e in every)
                spaced, spaced_found = spaced + 1, spaced_found + tight
    assert found / (found + missed) > 0.9 and spaced > 20 and spaced_found / spaced > 0.8, (found, missed, spaced, spaced_found)


def test_spans_are_those_of_a_run_over_the_whole_text(field):
    rng = np.random.default_rng(8)
    examples = [t for t, _ in pd.written_examples(200, seed=97)]
    words = "the key of a letter token = and contact host: it (so) mail * - write".split()
    for _ in range(40):
        parts = [examples[rng.integers(200)] if rng.random() < 0.15 else words[rng.integers(len(words))] for _ in range(120)]
        text = " ".join(parts)
        tokens = [m.span() for m in re.finditer(r"\S+", text)]
        full = field.viterbi(text, tokens, [])
        own = []
        for part, before, inner in pd.stretches(text, field):
            shift = tokens.index(part[0])
            own += [(y, a + shift, b + shift) for y, a, b in field.viterbi(text, part, before, inner)]
        assert own == full


def test_a_span_across_the_400th_number_of_a_run(field):
    for n in range(390, 400):
        text = " ".join(["12"] * n + ["(555) 123-4567", "and", "bob @ example.com", "7"] + ["12"] * 50)
        found = {(pd.KINDS[k], text[a:b]) for k, a, b in pd.all_spans(text, field)[1]}
        assert ("phone", "(555) 123-4567") in found and ("email", "bob @ example.com") in found


def test_digits_that_are_no_numbers(field):
    for text in ("host 1.2.3.² end", "①②③④ 1.2.3.④", "4.٣.2.1 call ٠١٢٣٤٥٦٧٨٩"):
        assert pd.all_spans(text, field)[0] == []


def test_base_spans_of_the_table_found_by_the_field_alone(field):
    """With the patterns out of the way, the field finds what they find."""
    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    found = total = 0
    for text in rows:
        spans = pd.base_spans(text or "")
        if not spans or len(text) > 20_000:
            continue
        own = pd.field_spans(text, field)
        for kind, start, end in spans:
            total += 1
            found += any(k == kind and s < end and e > start for k, s, e in own)
    assert total >= 5 and found >= 0.95 * total, (found, total)


def test_a_secret_of_letters_only(field):
    secret = "QwErTyUiOpAsDfGhJkLzXcVbNmQw"
    text = f"{'plain words of prose ' * 9}token = {secret} and more"
    assert ("secret", secret) in {(pd.KINDS[k], text[a:b]) for k, a, b in pd.all_spans(text, field)[1]}
