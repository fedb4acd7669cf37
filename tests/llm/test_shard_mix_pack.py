import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tessella.llm import mixing, packing, sharding
from tests.llm.fixtures import awkward, awkward_rows, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def winner(key, weights):
    def score(shard):
        u = (int(hashlib.md5(f"{key}:{shard}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return math.log(u) / weights[shard]

    return max(range(len(weights)), key=score)


def check_shards(spark, directory, expect):
    got = sharding.op1_sharding(spark, directory).collect()
    assert len(got) == len(expect)
    slots, moved = defaultdict(list), 0
    for r in got:
        text = expect[r["doc_id"]] or ""
        assert r["size"] == len(text.encode()) + 16 and r["text_crc32"] == zlib.crc32(text.encode())
        assert r["shard"] == winner(r["doc_id"], [1.0] * 40)
        assert r["grown_shard"] == winner(r["doc_id"], [1.0] * 41)
        assert r["grown_shard"] in (r["shard"], 40)
        moved += r["grown_shard"] != r["shard"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return moved


def test_sharding_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    moved = check_shards(spark, "/root/testdata/sf0.01", {r[0]: r[1] for r in rows})
    assert 5 <= moved <= 60  # 1000 / 41 expected


def test_rendezvous_weights_and_growth(spark):
    weights = [1.0, 2.0, 0.5]
    got = sharding.rendezvous(spark.range(4000).withColumnRenamed("id", "k"), "k", weights, [1.5]).collect()
    count = defaultdict(int)
    for r in got:
        assert r["shard"] == winner(r["k"], weights) and r["grown_shard"] in (r["shard"], 3)
        count[r["shard"]] += 1
    assert abs(count[1] / count[0] - 2) < 0.3 and abs(count[2] / count[0] - 0.5) < 0.12


def test_sharding_awkward_rows(spark, tmp_path):
    awkward(spark).write.parquet(str(tmp_path / "documents.parquet"))
    got = sharding.op1_sharding(spark, str(tmp_path)).collect()
    assert len(got) == len(awkward_rows())
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert min(r["size"] for r in got) == 16
    many = spark.range(500).select((F.col("id") % 3).alias("shard"), "id")
    got = sharding.slots(many, ["id"], rows_per_bucket=17).collect()
    assert sorted((r["shard"], r["slot"]) for r in got) == sorted((s, i) for s in range(3) for i in range(500 // 3 + (s < 2)))
    empty(spark).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert sharding.op1_sharding(spark, str(tmp_path / "none")).count() == 0


def water_fill(sizes, weights, cap):
    left, target = dict(sizes), {s: 0.0 for s in sizes}
    spare, open_ = float(sum(sizes.values())), set(sizes)
    while spare > 1e-6 and open_:
        per = spare / sum(weights[s] for s in open_)
        spare = 0.0
        for s in list(open_):
            target[s] += per * weights[s]
            if target[s] >= cap * left[s]:
                spare += target[s] - cap * left[s]
                target[s] = cap * left[s]
                open_.discard(s)
    return target


def test_mixing_targets_by_repeated_resharing(spark):
    rng = np.random.default_rng(5)
    for trial in range(4):
        sizes = {f"s{i:02d}": int(rng.integers(0, 10 ** rng.integers(1, 6))) for i in range(9)}
        rows = [*sizes.items(), (None, 40)]
        weights = {s: i % 3 + 1 for i, s in enumerate([*sorted(sizes), None])}
        want = water_fill(dict(rows), weights, 3)
        got = mixing.source_targets(spark.createDataFrame(rows, "source string, source_size long")).collect()
        for r in got:
            assert abs(r["target"] - want[r["source"]]) <= 1e-6 * max(1, want[r["source"]])


def test_mixing_awkward_rows(spark):
    rows = awkward_rows()
    got = mixing.mixed_rows(awkward(spark)).collect()
    assert sorted(map(str, ((r["doc_id"], r["size"], r["source"]) for r in got))) == sorted(
        str((r[0], len(WORD.findall(r[1] or "")), r[3])) for r in rows
    )
    assert all(0 <= r["copies"] <= 3 for r in got)
    mixed = mixing.mixed_documents(awkward(spark))
    assert mixed.columns == awkward(spark).columns
    assert mixed.count() == sum(r["copies"] for r in got)
    assert mixing.mixed_documents(empty(spark)).count() == 0 and mixing.mixed_rows(empty(spark)).count() == 0


def test_mixing_comes_near_its_targets_and_repeats(spark):
    first = mixing.op3_mixing(spark, "/root/testdata/sf0.01").collect()
    assert sorted(first) == sorted(mixing.op3_mixing(spark, "/root/testdata/sf0.01").collect())
    sources = {r["doc_id"]: r["source"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source").collect()}
    taken, target = defaultdict(int), {}
    for r in first:
        taken[sources[r["doc_id"]]] += r["taken"]
        target[sources[r["doc_id"]]] = r["target"]
        assert r["taken"] <= 3 * r["size"]
    assert max(abs(taken[s] / target[s] - 1) for s in target) < 0.02


def test_mixing_by_a_plain_walk_along_the_sum(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source", "text").collect()
    got = {r["doc_id"]: r for r in mixing.op3_mixing(spark, "/root/testdata/sf0.01").collect()}
    by_source = defaultdict(list)
    for r in rows:
        by_source[r["source"]].append((len(WORD.findall(r["text"] or "")), r["doc_id"]))
    for source, own in by_source.items():
        target, left, taken = got[own[0][1]]["target"], sum(z for z, _ in own), 0
        at = int(hashlib.md5(f"{source or ''}:mix".encode()).hexdigest()[:8], 16) / 2**32
        own.sort(key=lambda x: (-x[0], x[1]))
        for low, high in zip((0, *mixing.CLASSES), (*mixing.CLASSES, None)):
            part = [(z, d) for z, d in own if (not low or z * low <= target) and (high is None or z * high > target)]
            rate = min(3.0, max(0.0, (target - taken) / left)) if left else 0.0
            for i, (z, d) in enumerate(part, 1):
                copies = math.floor(at + rate * i) - math.floor(at + rate * (i - 1))
                assert got[d]["taken"] == z * copies, (source, d)
            taken, left = taken + sum(got[d]["taken"] for _, d in part), left - sum(z for z, _ in part)
            at = (at + rate * len(part)) % 1.0


def check_packing(pieces, ids_of, capacity):
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in pieces:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        docs[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    assert set(docs) == set(ids_of)
    for doc, parts in docs.items():
        at, ids = 0, ids_of[doc]
        for start, length, crc, total in sorted(parts):
            assert start == at and total == len(ids)
            assert crc == zlib.crc32(np.array(ids[start : start + length], dtype="<u4").tobytes())
            at += length
        assert at == len(ids)
    return len(sequences)


def test_packing_whole_table(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    ids = {r[0]: [*tokenizer.encode(r[1], add_special_tokens=False).ids, 2] for r in rows}
    pieces = packing.op5_packing(spark, "/root/testdata/sf0.01").collect()
    n = check_packing(pieces, ids, 4096)
    total = sum(map(len, ids.values()))
    assert n <= -(-total // 4096) + 1
    small = packing.packed(spark.createDataFrame(rows), capacity=256, group_bytes=200_000).withColumnRenamed("id", "doc_id").collect()
    assert check_packing(small, ids, 256) * 256 < total * 1.01


def test_packing_awkward_rows(spark):
    got = packing.packed(awkward(spark)).collect()
    assert sum(r["length"] for r in got if r["start"] == 0 and r["id"] in (4, 5, 6)) == 3
    assert sum(1 for r in got if r["start"] == 0) == len(awkward_rows())
    assert packing.packed(empty(spark)).count() == 0
    words = packing.WordIds(packing.default_tokenizer(), limit=3)
    for text in ("a ́b Σας ΌΣΟΣ", "<|endoftext|> a <|ENDOFTEXT|>!!", "it's I'LL. 'S!! 12345.. 日本語*** é.** ÀÉ|| İ!! ß#", "a\x1cb\xa0d"):
        whole = words.tokenizer.encode(text, add_special_tokens=False).ids
        assert words.of(text) == np.array(whole, dtype="<u4").tobytes()


def test_pack_balances_cost():
    lengths = np.sort(np.random.default_rng(2).integers(1, 9000, 300))[::-1]
    pieces, sequences = packing.pack(lengths)
    assert sequences == len({p[3] for p in pieces}) == -(-int(lengths.sum()) // 4096)
