import random
import re
from collections import defaultdict

import pyarrow.parquet as pq

from tessella.llm import line_templates
from tests.llm.fixtures import awkward, awkward_rows, empty

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def brute(rows, min_docs=10, constant_pct=60):
    """id, number of lines, number of dropped lines and rest of every (id, text)."""
    leaves = defaultdict(lambda: defaultdict(set))
    for doc, text in rows:
        for line in (text or "").split("\n"):
            words = [w for w in SPACE.split(line) if w]
            if words:
                lead = tuple("<*>" if re.search("[0-9]", w) else w for w in words[:2])
                leaves[len(words), lead][line].add((doc, text))
    gone = set()
    for (n, _), lines in leaves.items():
        count = defaultdict(int)
        for line, docs in lines.items():
            for place, word in enumerate(w for w in SPACE.split(line) if w):
                count[place, word] += len(docs)
        templates = defaultdict(list)
        for line in lines:
            shape = tuple((p, w) for p, w in enumerate(w for w in SPACE.split(line) if w) if count[p, w] >= min_docs)
            if len(shape) * 100 >= n * constant_pct:
                templates[shape].append(line)
        for own in templates.values():
            if len(set().union(*(lines[x] for x in own))) >= min_docs:
                gone.update(own)
    out = []
    for doc, text in rows:
        lines = [] if text is None else text.split("\n")
        stay = [x for x in lines if x not in gone]
        out.append((doc, len(lines), len(lines) - len(stay), None if text is None else "\n".join(stay)))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_whole_table_equals_brute_force(spark):
    table = pq.read_table("/root/testdata/sf0.001/documents.parquet")
    rows = list(zip(table["doc_id"].to_pylist(), table["text"].to_pylist()))
    assert got(line_templates.op2_line_templates(spark, "/root/testdata/sf0.001").select("doc_id", "n_lines", "n_dropped", "text")) == brute(rows)


def test_variable_fields_fall_together_and_other_lines_stay(spark):
    r = random.Random(2)
    rows = []
    for i in range(60):
        own = " ".join(f"w{r.randrange(10**6)}" for _ in range(9))
        page = f"Page {i} of {r.randrange(100)} printed on 2024-01-{i % 28 + 1:02d} by the archive office"
        rows.append((i, f"{own}\n\n{page}\n{own} again"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = got(line_templates.without_recurring_lines(docs))
    assert out == brute(rows)
    assert all(n == 4 and dropped == 1 and "Page" not in text for _, n, dropped, text in out)


def test_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in awkward_rows()]
    for least in (2, 3):
        assert got(line_templates.without_recurring_lines(awkward(spark), min_docs=least)) == brute(rows, least)
    assert line_templates.without_recurring_lines(empty(spark)).count() == 0


def test_a_line_of_a_third_of_all_rows(spark):
    rows = [(i, f"the same closing line of many pages\nbody {i} {i * 7} {i * 13} x" if i % 3 == 0 else f"text {i} alone {i * 11}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(line_templates.without_recurring_lines(docs)) == brute(rows)


def brute_long(rows, long_tokens=20):
    """Dropped lines by both supports."""
    few = brute_gone(rows, 2, 60, long_tokens)
    gone = brute_gone(rows, 10, 60, 0) | few
    out = []
    for doc, text in rows:
        lines = [] if text is None else text.split("\n")
        stay = [x for x in lines if x not in gone]
        out.append((doc, len(lines), len(lines) - len(stay), None if text is None else "\n".join(stay)))
    return sorted(out, key=str)


def brute_gone(rows, min_docs, constant_pct, least):
    leaves, gone = defaultdict(lambda: defaultdict(set)), set()
    for doc, text in rows:
        for line in (text or "").split("\n"):
            words = tuple(w for w in SPACE.split(line) if w)
            if words:
                leaves[len(words), tuple("<*>" if re.search("[0-9]", w) else w for w in words[:2])][line].add((doc, text))
    for (n, _), lines in leaves.items():
        count, templates = defaultdict(int), defaultdict(list)
        own = {line: [w for w in SPACE.split(line) if w] for line in lines}
        for line, docs in lines.items():
            for place, word in enumerate(own[line]):
                count[place, word] += len(docs)
        for line, words in own.items():
            shape = tuple(x for x in enumerate(words) if count[x] >= min_docs)
            if len(shape) * 100 >= n * constant_pct and len(shape) >= least:
                templates[shape].append(line)
        for group in templates.values():
            if len(set().union(*(lines[x] for x in group))) >= min_docs:
                gone.update(group)
    return gone


def test_long_lines_of_two_documents_are_dropped_and_short_ones_stay(spark):
    r = random.Random(4)
    word = lambda: f"w{r.randrange(10**6)}"
    shared = [" ".join(word() for _ in range(n)) for n in (19, 20, 63)]
    rows = []
    for i in range(30):
        page = f"This is {word()} copy {word()} " + " ".join(f"licence{k}" for k in range(25))
        rows.append((i, "\n".join([*shared[:3], page, f"own {word()}"] if i < 2 else [" ".join(word() for _ in range(30)), page if i < 5 else word()])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = got(line_templates.without_recurring_lines(docs, long_tokens=20))
    assert out == brute_long(rows)
    rest = {i: text for i, _, _, text in out}
    assert shared[0] in rest[0] and shared[1] not in rest[0] and shared[2] not in rest[1] and not any("licence1" in t for t in rest.values())
    assert all(i in rest and (i < 5 or n == 0) for i, _, n, _ in out)


def test_long_lines_on_the_whole_table_and_awkward_rows(spark):
    table = pq.read_table("/root/testdata/sf0.001/documents.parquet")
    rows = list(zip(table["doc_id"].to_pylist(), table["text"].to_pylist()))
    assert got(line_templates.op2_long_line_templates(spark, "/root/testdata/sf0.001").select("doc_id", "n_lines", "n_dropped", "text")) == brute_long(rows)
    rows = [(r[0], r[1]) for r in awkward_rows()]
    assert got(line_templates.without_recurring_lines(awkward(spark), long_tokens=5)) == brute_long(rows, 5)
