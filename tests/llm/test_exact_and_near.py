import hashlib
import re
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tessella.llm import exact_dedup, ngram_join
from tessella.llm.components import connected_components
from tessella.llm.shared import spool
from tests.llm.fixtures import awkward, awkward_rows, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def gram_set(text, n):
    words = WORD.findall(lower(text))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute_components(rows, n, pct):
    sets = [gram_set(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_gram = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            by_gram[g].append(i)
    pairs = {(a, b) for at in by_gram.values() for a in at for b in at if a < b}
    for a, b in pairs:
        inter = len(sets[a] & sets[b])
        if 100 * inter >= pct * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    least = {}
    for i, (doc, _) in enumerate(rows):
        r = find(i)
        if doc is not None:
            least[r] = min(doc, least.get(r, doc))
    return sorted(((doc, len(sets[i]), least.get(find(i))) for i, (doc, _) in enumerate(rows)), key=str)


def test_exact_dedup_against_brute_force(spark):
    rows = [(r[0], r[1] or "") for r in awkward_rows()]
    groups = defaultdict(list)
    for doc, text in rows:
        groups[text].append(doc)
    got = exact_dedup.exact_dedup(awkward(spark)).collect()
    assert len(got) == len(rows)
    by_text = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = defaultdict(int)
    for r in got:
        ids = by_text[bytes(r["digest"]).hex()]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == max((i for i in ids if i is not None), default=None)
        kept[bytes(r["digest"]).hex()] += r["kept"]
        assert not r["kept"] or r["id"] == r["keep_id"]
    assert set(kept.values()) == {1} and set(kept) == set(by_text)


def test_exact_dedup_splits_texts_that_share_a_digest(spark):
    weak = lambda text: F.substring(F.sha2(text, 256), 1, 1).cast("binary")
    docs = spark.createDataFrame([(i, f"text {i % 40}") for i in range(120)], "doc_id long, text string")
    got = exact_dedup.exact_dedup(docs, digest=weak).collect()
    assert len(got) == 120
    assert all(r["group_size"] == 3 and r["keep_id"] == r["id"] % 40 + 80 and r["kept"] == (r["id"] >= 80) for r in got)


def test_exact_dedup_state_goes_on_with_new_files(spark, tmp_path):
    path, state, out = (str(tmp_path / x) for x in ("rows", "state", "out"))
    rows = lambda a, b: spark.range(a, b).select(F.col("id"), F.sha2((F.col("id") % 5).cast("string"), 256).cast("binary").alias("digest"), F.col("id").alias("locator"))
    rows(0, 10).write.parquet(path)
    schema = spark.read.parquet(path).schema
    first = exact_dedup.update_state(path, schema, state, out, spark).collect()
    assert {r["group_size"] for r in first} == {2}
    rows(10, 15).write.mode("append").parquet(path)
    again = exact_dedup.update_state(path, schema, state, out, spark).collect()
    assert sorted((r["group_size"], r["keep"]["id"]) for r in again) == [(3, i) for i in range(10, 15)]


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_ngram_components_on_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in awkward_rows()]
    for n, pct in ((3, 90), (5, 80), (1, 50)):
        got = [(r["id"], r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(awkward(spark), n, pct).collect()]
        assert sorted(got, key=str) == brute_components(rows, n, pct)
    assert ngram_join.ngram_components(empty(spark)).count() == 0


def test_ngram_components_with_many_close_variants_in_small_blocks(spark):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in rng.integers(0, 500, 80)]
    rows = []
    for i in range(150):
        words = list(base if i % 3 else base[:60])
        for at in rng.integers(0, len(words), rng.integers(0, 5)):
            words[at] = f"x{rng.integers(0, 50)}"
        rows.append((1000 - i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for n, pct in ((3, 90), (5, 80)):
        got = [tuple(r) for r in ngram_join.ngram_components(docs, n, pct, block_rows=32).collect()]
        assert sorted(got, key=str) == brute_components(rows, n, pct)


def test_a_crowd_of_near_copies_is_settled_by_heads_and_rest(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 800, 120)]
    rows = []
    for i in range(260):
        words = list(base)
        for at in rng.integers(0, len(words), int(rng.integers(0, 4 if i % 13 else 9))):
            words[at] = f"x{rng.integers(0, 90)}"
        rows.append((5000 - i, " ".join(words)))
    rows += [(i, " ".join([*base[:40], *(f"y{i}z{k % 7}" for k in range(80))])) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for n, pct, kw in ((5, 80, {"block_rows": 24}), (3, 90, {"block_grams": 3000}), (5, 80, {"block_rows": 16, "block_grams": 2500})):
        got = [tuple(r) for r in ngram_join.ngram_components(docs, n, pct, **kw).collect()]
        assert sorted(got, key=str) == brute_components(rows, n, pct), (n, pct, kw)


def test_near_duplicates_go_by_row_and_not_by_id(spark):
    words = [f"word{i}" for i in range(60)]
    copy, other = " ".join([*words[:-1], "changed"]), " ".join(f"other{i}" for i in range(60))
    rows = [(1, " ".join(words)), (5, copy), (5, other), (None, copy + " tail"), (None, copy + " tail"), (None, "alone here"), (7, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in ngram_join.near_duplicates_removed(docs).collect()]
    assert sorted(got, key=str) == sorted([rows[0], rows[2], rows[5], rows[6], rows[7]], key=str)


def test_block_signatures_never_lose_a_pair():
    rng = np.random.default_rng(7)
    for pct in (50, 80, 90):
        for _ in range(1500):
            n = int(rng.integers(1, 60))
            a = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)
            drop, add = rng.integers(0, 6, 2)
            b = np.concatenate((a[drop:], rng.integers(0, 2**63, add, dtype=np.uint64)))
            a, b = np.unique(a), np.unique(b)
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= pct * (len(a) + len(b) - both) and not np.array_equal(a, b):
                x, y = ngram_join.block_signatures(a, pct), ngram_join.block_signatures(b, pct)
                assert len(np.intersect1d(x, y)), (pct, len(a), len(b), both)


def test_whole_table_equals_brute_force(spark):
    table = pq.read_table("/root/testdata/sf0.001/documents.parquet")
    rows = list(zip(table["doc_id"].to_pylist(), table["text"].to_pylist()))
    got = [tuple(r) for r in ngram_join.op9_ngram_join(spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got, key=str) == brute_components(rows, 3, 90)


def test_connected_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges if e[0] != e[1] for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    assert got == label
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_parities_never_show_too_many_differences():
    rng = np.random.default_rng(12)
    for _ in range(500):
        a = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 900)), dtype=np.uint64))
        keep = a[: len(a) - int(rng.integers(0, len(a)))]
        b = np.unique(np.concatenate((keep, rng.integers(0, 2**63, int(rng.integers(0, 60)), dtype=np.uint64))))
        differ = sum((x ^ y).bit_count() if x ^ y >= 0 else ((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(ngram_join.parities(a), ngram_join.parities(b)))
        assert differ <= len(np.setxor1d(a, b))


def test_a_spooled_table_leaves_no_shuffle_files(spark):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("|")
        return {x for x in found.split("|") if "/shuffle_" in x}

    before = files()
    counts = spool(spark.range(5000).groupBy((F.col("id") % 7).alias("k")).count(), "left")
    until = time.monotonic() + 5
    while files() - before and time.monotonic() < until:
        time.sleep(0.1)
    assert not files() - before and counts.count() == 7


def test_signatures_are_given_once_for_the_copies_of_a_set():
    batch = pa.record_batch({"id": [1, 2, 3], "file": [0] * 3, "row": [0, 1, 2], "text": ["a b c d", "x y z w v", "A b c d"]})
    (out,) = ngram_join._incidence(3, 50, None)(iter([batch]))
    sigs = out.column("sigs").to_pylist()
    assert sigs[0] and sigs[1] and not sigs[2]


def test_similar_sets_share_as_many_prefix_signatures_as_said():
    rng = np.random.default_rng(4)
    none = (np.empty(0, np.uint64), np.empty(0, np.int32))
    for n in (1, 3, 15, 16, 40, 128, 500, 3000):
        for pct in (5, 60, 80, 90):
            for _ in range(20):
                gone = rng.integers(0, n * (100 - pct) // 100 + 1)
                more = rng.integers(0, max(1, (n - gone) * 100 // pct - n + 1))
                a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
                b = np.unique(np.concatenate((a[rng.permutation(len(a))[gone:]], rng.integers(0, 1 << 63, more).astype(np.uint64))))
                inter = len(np.intersect1d(a, b))
                if 100 * inter >= pct * (len(a) + len(b) - inter):
                    both = np.intersect1d(ngram_join.prefix_signatures(a, pct, *none), ngram_join.prefix_signatures(b, pct, *none))
                    assert len(both) >= ngram_join.common(min(len(a), len(b)), pct) >= 1


def test_long_texts_that_share_phrases_by_chance_are_no_candidates(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [[f"w{i}x{j}" for j in range(2500)] for i in range(44)]
    for i in range(24):  # every two share a phrase of their own
        for j in range(i):
            phrase = [f"p{i}q{j}r{k}" for k in range(5)]
            for x, y in ((i, j), (j, i)):
                texts[x][60 * y : 60 * y + 5] = phrase
    for i in range(44):  # and all share some
        for k in range(4):
            texts[i][2000 + 20 * k : 2005 + 20 * k] = [f"all{k}s{x}" for x in range(5)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    near = [list(t) for t in texts[:6]]
    for t in near:
        for at in rng.integers(0, 2500, 20):
            t[at] = "changed"
    rows += [(100 + i, " ".join(t)) for i, t in enumerate(near)]
    seen = []
    links = ngram_join.product_links
    monkeypatch.setattr(ngram_join, "product_links", lambda base, tiled, n, pct: seen.append(tiled.count()) or links(base, tiled, n, pct))
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 5, 80).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_components(rows, 5, 80)
    assert sum(seen) <= 2 * 6
