"""N-gram Jaccard self-join: a blocked sparse product of the document by n-gram incidence matrix.

1. Every text becomes its set of word n-grams (64-bit hashes).  Texts with the same set form a class; only one member
   of a class is compared with others.
2. Candidates.  The hash range is cut into column blocks, as many as two sets of the sizes in question may differ in,
   plus two.  Sets as similar as asked for then agree on the whole of at least two blocks, so equal content of a
   block that is not empty finds every pair; a set with two or more empty blocks also gives its prefix of smallest
   hashes (prefix filtering), which covers what empty blocks could hide.  Sizes fall into levels so that similar sets
   lie in one level or in neighbouring ones, and size-derived bounds give the number of blocks of each level.
   For long n-grams, which texts hardly share by chance, prefix filtering alone needs fewer rows: similar sets share
   some of their first n-grams under any common order, ``common`` of them by the length of the prefix, where sets that
   meet by chance share one or two, however many documents there are.  The order puts n-grams last, and the more frequent the
   later, that a sample of one document in ``SAMPLE_EVERY`` finds twice or more (shared passages), so that passages do
   not make candidates; the sample affects only how many candidates there are, never the result.
3. Sets that share signatures of up to ``PAIRS_UP_TO`` sets are paired if these are half of what similar sets share at
   least (one signature with blocks), if their sizes allow the similarity, and if the parities of their n-grams over ``PARITY_BITS`` hashed cells do: each cell whose parity differs takes an n-gram that
   only one of them has, and similar sets have few of those.  The pairs are dealt into row blocks: each goes to its
   member with more partners, and members with the same smallest partner share a block, so close copies lie together;
   a large block is a grid of tiles by both members.
4. Similar sets that are no such pair share the other half, so each has that many more frequent signatures.  Sets with
   as many give a star for each, within windows of two levels, never all pairs, and what the stars connect is a row
   block.  A block too large for one product falls into windows of two levels, and a window too
   large still is settled in two steps.  First a few of its sets, the heads, are multiplied with all the others, dealt
   into parts; in a group of near copies that links nearly all to one component.  Pairs within the largest component
   of a window need no more work.  Then the rest, dealt into parts, meets itself and the parts of that component.  So
   the texts of a group of many near copies move a few times, whatever their number.
5. Each tile is multiplied with its transpose, column chunk by column chunk, which accumulates the overlap counts of
   its pairs; pairs whose sizes or counts are below the bound are discarded.  A product takes up to ``block_rows`` sets
   and ``block_grams`` n-grams, and gives a spanning forest of its links, as all that components need.

No pair at or above the threshold is lost.  Defined cases: a null or empty text has no n-gram and links with nothing;
a text of any length gives its whole set; null or repeated identifiers are allowed, as rows are told apart by file and
place in it (a component's id is its smallest identifier that is not null); repeated rows are one class; extra columns
are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.components import connected_components
from tessella.llm.shared import discard, documents, shared_folder, small, spool, stored_rows
from tessella.llm.words import WordHashes, lower_words, mixed, shingles

#: A signature of up to so many sets gives their pairs, a more frequent one stars.
PAIRS_UP_TO = 32
_FALLBACK = 77
#: From this length of n-grams on, prefixes find the candidates.
PREFIX_FROM = 5
#: One document in so many is sampled for n-grams that are shared, documents of the sample that make one shared, most
#: of them used (the most frequent, 8 bytes each).
SAMPLE_EVERY, SHARED_BY, MOST_SHARED = 8, 2, 400_000
PARITY_BITS = 512
#: Hashes of sets that a task remembers.
SEEN = 200_000
#: Sets of a large window that are multiplied with all the others first, to each part.
HEADS = 32


def levels(pct: int, most: int) -> list[int]:
    """First size of each level: sizes whose ratio is at least pct % lie in one level or in neighbouring ones."""
    starts = [1]
    while starts[-1] <= most:
        starts.append(starts[-1] * 100 // pct + 1)
    return starts


def block_signatures(grams: np.ndarray, pct: int) -> np.ndarray:
    """Signatures (int64) of a sorted set; two sets of Jaccard similarity >= pct % that differ share one at least."""
    n = len(grams)
    starts = levels(pct, n)
    own = len(starts) - 2
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(mixed(grams, 3), out=sums[1:])
    out, fallback = [], False
    for level in {own, max(own - 1, 0)}:
        differ = (starts[level + 1] - 1) * (100 - pct) // pct
        if not differ:
            continue  # only equal sets are as similar
        blocks = differ + 2
        bounds = np.arange(blocks + 1, dtype=np.float64) * (2.0**64 / blocks)
        cuts = np.searchsorted(grams, bounds[1:-1].astype(np.uint64))
        cuts = np.concatenate(([0], cuts, [n]))
        content = sums[cuts[1:]] - sums[cuts[:-1]]
        filled = np.flatnonzero(cuts[1:] > cuts[:-1])
        out.append(mixed(content[filled] + mixed(filled.astype(np.uint64), 100 + level), 5))
        fallback |= blocks - len(filled) >= 2
    if fallback:
        out.append(mixed(grams[: n - -(-pct * n // 100) + 1], _FALLBACK))
    return np.unique(np.concatenate(out)).view(np.int64) if out else np.empty(0, np.int64)


def common(n: int, pct: int) -> int:
    """Prefix signatures that a set of ``n`` n-grams shares at least with a similar one that is no smaller; never falls with n."""
    return min(1 + min(n // 16, 7) + n // 128, -(-pct * n // 100))


def common_column(n: Column, pct: int) -> Column:
    return F.least(1 + F.least(F.floor(n / 16), F.lit(7)) + F.floor(n / 128), F.ceil(pct * n / 100))


def prefix_signatures(grams: np.ndarray, pct: int, shared: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The first n-grams of a sorted set, those in ``shared`` (sorted) last and by ``place``.

    Similar sets have as many in common as ``common`` gives for the smaller one: at least ``pct`` % of a set's n-grams
    are in both, and all but the last of these that lie behind the prefix are its own.
    """
    n = len(grams)
    if len(shared):
        at = np.minimum(np.searchsorted(shared, grams), len(shared) - 1)
        known = shared[at] == grams
        grams = np.concatenate((grams[~known], grams[known][np.argsort(place[at[known]])]))
    return mixed(grams[: n - -(-pct * n // 100) + common(n, pct)], _FALLBACK).view(np.int64)


def set_hash(grams: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    both = [int(np.sum(mixed(grams, salt), dtype=np.uint64)) ^ len(grams) for salt in (11, 13)]
    return tuple(x - (1 << 64) if x >> 63 else x for x in both)


def parities(grams: np.ndarray) -> list[int]:
    """Whether the n-grams of a set in each of PARITY_BITS hashed cells are odd in number, 64 cells to an integer."""
    cells = (mixed(grams, 21) % np.uint64(PARITY_BITS)).astype(np.int64)
    odd = (np.bincount(cells, minlength=PARITY_BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).tolist()


def _sample_counts(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingles(hashes.of(lower_words(t.as_py())), n) for t in batch.column("text")]
            gram, count = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.empty(0, np.uint64), np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(count.astype(np.int64))], names=["gram", "c"])

    return run


def shared_grams(base: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of n-grams that at least SHARED_BY documents of the sample hold; the place of each by rising count."""
    sample = base.where(F.pmod(F.xxhash64("file", "row"), F.lit(SAMPLE_EVERY)) == 0).select("text")
    found = (
        sample.mapInArrow(_sample_counts(n), "gram bigint, c bigint")
        .groupBy("gram")
        .agg(F.sum("c").alias("c"))
        .where(F.col("c") >= SHARED_BY)
        .orderBy(F.desc("c"), "gram")
        .limit(MOST_SHARED)
        .toArrow()
    )
    grams = np.asarray(found.column(0).to_numpy()).astype(np.int64).view(np.uint64)
    order = np.argsort(grams)
    return grams[order], (len(grams) - 1 - order).astype(np.int32)  # most frequent first, so the last comes first


def _incidence(n: int, pct: int, shared: tuple[np.ndarray, np.ndarray] | None):
    def signatures(grams: np.ndarray) -> np.ndarray:
        if not len(grams):
            return np.empty(0, np.int64)
        return block_signatures(grams, pct) if shared is None else prefix_signatures(grams, pct, *shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        for batch in batches:
            sizes, level, s0, s1, odd, sigs = [], [], [], [], [], []
            for text in batch.column("text"):
                grams = shingles(hashes.of(lower_words(text.as_py())), n)
                sizes.append(len(grams))
                level.append(len(levels(pct, len(grams))) - 2)
                a, b = set_hash(grams)
                s0.append(a)
                s1.append(b)
                odd.append(parities(grams))
                # signatures stand for the class, so the next copies of a set need not give them again
                sigs.append(np.empty(0, np.int64) if (a, b) in seen else signatures(grams))
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add((a, b))
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in sigs]))).astype(np.int32)
            flat = np.concatenate(sigs) if sigs else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("file"),
                    batch.column("row"),
                    pa.array(sizes, pa.int64()),
                    pa.array(level, pa.int32()),
                    pa.array(s0, pa.int64()),
                    pa.array(s1, pa.int64()),
                    pa.array(odd, pa.list_(pa.int64())),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                ],
                names=["id", "file", "row", "n", "level", "s0", "s1", "odd", "sigs"],
            )

    return run


def overlap_links(sets: list[np.ndarray], pct: int, columns: int = 4096) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``sets``, from the product of their incidence matrix with its transpose."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    row = np.repeat(np.arange(m), sizes)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    row, column = row[shared], column[shared]
    overlap = np.zeros((m, m), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    used = np.concatenate(([0], np.flatnonzero(np.diff(column)) + 1)) if len(column) else np.empty(0, np.int64)
    dense = np.zeros(len(column), dtype=np.int64)
    dense[used[1:]] = 1
    dense = np.cumsum(dense)
    for first in range(0, len(used), columns):
        lo, hi = np.searchsorted(dense, (first, first + columns))
        block = np.zeros((m, min(columns, len(used) - first)), dtype=np.float32)
        block[row[lo:hi], dense[lo:hi] - first] = 1
        overlap += block @ block.T
    inter = np.rint(overlap).astype(np.int64)
    linked = np.triu(100 * inter >= pct * (sizes[:, None] + sizes[None, :] - inter), 1)
    parent = list(range(m))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    forest = []
    for i, j in zip(*np.nonzero(linked)):
        a, b = find(int(i)), find(int(j))
        if a != b:
            parent[max(a, b)] = min(a, b)
            forest.append((int(i), int(j)))
    return forest


def _products(n: int, pct: int):
    def run(table: pa.Table) -> pa.Table:
        hashes = WordHashes()
        sets: dict[int, np.ndarray] = {}
        for text, node, s0, s1 in zip(*(table.column(c) for c in ("text", "node", "s0", "s1"))):
            node = node.as_py()
            if node not in sets:
                grams = shingles(hashes.of(lower_words(text.as_py())), n)
                if set_hash(grams) == (s0.as_py(), s1.as_py()):  # else two files share the hash of their path
                    sets[node] = grams
        nodes = sorted(sets)
        links = overlap_links([sets[x] for x in nodes], pct) if len(nodes) > 1 else []
        return pa.table(
            {"a": pa.array([nodes[i] for i, _ in links], pa.int64()), "b": pa.array([nodes[j] for _, j in links], pa.int64())}
        )

    return run


def similar_parities(pairs: DataFrame, classes: DataFrame, pct: int) -> DataFrame:
    """Those of the pairs (a, b, na, nb) whose parities do not show that too many n-grams differ.

    Of sets with na and nb n-grams at least pct % similar, at most (100 - pct) / (100 + pct) of na + nb are in one only.
    """
    of = lambda x: classes.select(F.col("s0").alias(x), F.col("odd").alias(f"odd_{x}"))
    cells = [F.bit_count(F.col("odd_a")[i].bitwiseXOR(F.col("odd_b")[i])) for i in range(PARITY_BITS // 64)]
    differ = sum(cells[1:], cells[0])
    few = differ * (100 + pct) <= (F.col("na") + F.col("nb")) * (100 - pct)
    return pairs.join(of("a"), "a").join(of("b"), "b").where(few).select("a", "b", "na", "nb")


def parted(members: DataFrame, group: list[str], block_rows: int, block_grams: int) -> DataFrame:
    """``members`` with ``parts``, the number of parts of their group, and ``part``, their own."""
    half = lambda total, most: F.ceil(total / F.lit(most / 2))
    sizes = members.groupBy(*group).agg(
        F.greatest(half(F.count(F.lit(1)), block_rows), half(F.sum("n"), block_grams)).cast("int").alias("parts")
    )
    return members.join(small(spool(sizes, "ngram-parts")), group).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))


def meetings(part: Column, parts: Column) -> Column:
    """The tiles of a part so that every two parts of a group meet in one; up to two parts share a single tile."""
    others = F.filter(F.sequence(F.lit(0), parts - 1), lambda x: x != part)
    tiles = F.transform(others, lambda x: F.concat_ws(":", F.least(x, part), F.greatest(x, part)))
    return F.when(parts <= 2, F.array(F.lit("0"))).otherwise(tiles)


def product_links(base: DataFrame, tiled: DataFrame, n: int, pct: int) -> DataFrame:
    """Links (a, b) among the sets that share a tile; ``tiled``: file, row, node, s0, s1, block, window, tile."""
    texts = base.select("file", "row", "text").join(small(spool(tiled, "ngram-tiles")), ["file", "row"])
    return (
        texts.select("text", "node", "s0", "s1", "block", "window", "tile")
        .groupBy("block", "window", "tile")
        .applyInArrow(_products(n, pct), "a bigint, b bigint")
    )


def pair_links(base: DataFrame, pairs: DataFrame, classes: DataFrame, n: int, pct: int, block_rows: int, block_grams: int) -> DataFrame:
    """Links (a, b) among the pairs (a, b, na, nb) of set hashes."""
    both = pairs.select(F.col("a").alias("s0"), F.col("b").alias("by")).unionByName(pairs.select(F.col("b").alias("s0"), F.col("a").alias("by")))
    near = both.groupBy("s0").agg(F.count(F.lit(1)).alias("degree"), F.least(F.min("by"), F.col("s0")).alias("block"))
    near = spool(near, "ngram-near")
    of = lambda x: near.select(F.col("s0").alias(x), F.struct("degree", F.col("s0").alias("s0"), "block").alias(f"{x}_near"))
    edges = pairs.join(of("a"), "a").join(of("b"), "b")
    ends = [F.struct(F.col(f"{x}_near").alias("near"), F.col(f"n{x}").alias("n")) for x in "ab"]
    edges = edges.select(F.greatest(*ends).alias("head"), F.least(*ends).alias("other"))
    edges = spool(
        edges.select(
            F.col("head.near.block").alias("block"), F.col("head.near.s0").alias("head"), F.col("head.n").alias("head_n"),
            F.col("other.near.s0").alias("other"), F.col("other.n").alias("other_n"),
        ),
        "ngram-edges",
    )
    side = lambda x: edges.select("block", F.lit(x).alias("side"), F.col(x).alias("s0"), F.col(f"{x}_n").alias("n")).distinct()
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(block_rows / 2)), F.ceil(F.sum("n") / F.lit(block_grams / 2)))
    grid = side("head").unionByName(side("other")).groupBy("block", "side").agg(parts.cast("int").alias("parts"))
    grid = grid.groupBy("block").agg(*[F.max(F.when(F.col("side") == x, F.col("parts"))).alias(f"{x}_parts") for x in ("head", "other")])
    large = spool(grid.where("head_parts > 1 or other_parts > 1"), "ngram-grid")
    edges = edges.join(small(large), "block", "left")
    at = [F.pmod(F.xxhash64(x), F.coalesce(f"{x}_parts", F.lit(1))) for x in ("head", "other")]
    edges = edges.withColumn("tile", F.concat_ws(":", *at))
    tiles = edges.select("block", "tile", F.explode(F.array("head", "other")).alias("_s0")).distinct()
    tiled = tiles.join(classes, F.col("s0") == F.col("_s0")).select("file", "row", "node", "s0", "s1", "block", F.lit(-1).alias("window"), "tile")
    return product_links(base, tiled, n, pct)


def block_links(base: DataFrame, members: DataFrame, n: int, pct: int, block_rows: int, block_grams: int) -> DataFrame:
    """Links (a, b) that connect what is similar within each block of ``members``."""
    row = ["file", "row", "node", "s0", "s1", "block"]
    large = members.groupBy("block").agg((F.count(F.lit(1)) > block_rows).alias("many"), (F.sum("n") > block_grams).alias("much")).where("many or much")
    large = small(spool(large.select("block"), "ngram-large"))
    first = members.join(large, "block", "left_anti").select(*row, F.lit(-2).alias("window"), F.lit("0").alias("tile"))
    windows = members.join(large, "block").withColumn("window", F.explode(F.array("level", F.col("level") - 1)))
    windows = spool(parted(windows, ["block", "window"], block_rows, block_grams), "ngram-windows")
    # windows of one or two parts are multiplied whole
    first = first.unionByName(windows.where("parts <= 2").select(*row, "window", F.lit("0").alias("tile")))
    crowd = windows.where("parts > 2")
    if crowd.isEmpty():
        return product_links(base, first, n, pct)
    # heads: some of each part, as many of each window at most, go to all parts of the window
    drawn = F.pmod(F.xxhash64("node", F.lit(1)), F.ceil(F.lit(block_rows / 2) / F.lit(HEADS)) * F.col("parts")) == 0
    each = F.when(drawn, F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: x.cast("string"))).otherwise(F.array(F.col("part").cast("string")))
    heads = crowd.select(*row, "window", F.explode(each).alias("tile"))
    found = spool(product_links(base, first.unionByName(heads), n, pct), "ngram-links")
    # the largest component of each window is settled within
    roots = connected_components(found)
    crowd = crowd.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    counted = crowd.groupBy("block", "window", "root").agg(F.count(F.lit(1)).alias("c"))
    settled = counted.groupBy("block", "window").agg(F.max(F.struct("c", "root")).alias("most"), F.sum("c").alias("all"))
    settled = small(spool(settled.where("most.c < all").select("block", "window", F.col("most.root").alias("settled")), "ngram-settled"))
    crowd = crowd.join(settled, ["block", "window"]).withColumn("rest", (F.col("root") != F.col("settled")).cast("int"))
    crowd = spool(parted(crowd.drop("parts", "part"), ["block", "window", "rest"], block_rows, block_grams), "ngram-rest")
    sides = crowd.groupBy("block", "window").agg(*[F.max(F.when(F.col("rest") == k, F.col("parts"))).alias(x) for k, x in ((1, "rests"), (0, "others"))])
    crowd = crowd.join(small(spool(sides, "ngram-sides")), ["block", "window"])
    across = lambda count, name: F.transform(F.sequence(F.lit(0), F.col(count) - 1), name)
    part = F.col("part").cast("string")
    of_rest = F.concat(meetings(F.col("part"), F.col("parts")), across("others", lambda x: F.concat_ws("x", part, x)))
    of_other = across("rests", lambda x: F.concat_ws("x", x, part))
    second = crowd.select(*row, "window", F.explode(F.when(F.col("rest") == 1, of_rest).otherwise(of_other)).alias("tile"))
    return found.unionByName(product_links(base, second, n, pct))


def row_components(
    docs: DataFrame,
    n: int,
    pct: int,
    id_col: str,
    text_col: str = "text",
    block_rows: int = 1024,
    block_grams: int = 1_000_000,
    stored: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (id, file, row, n, s0, s1), classes (s0, s1, root) of the rows with an n-gram, and ``docs`` with _locator.

    Links are pairs with Jaccard similarity >= pct %; rows of a component have one root.
    """
    docs = stored_rows(docs, stored)
    base = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64("_locator.file").alias("file"),
        F.col("_locator.row").alias("row"),
        F.col(text_col).cast("string").alias("text"),
    )
    spark, kind = docs.sparkSession, base.schema["id"].dataType.simpleString()
    wide = shared_folder(spark, "ngram-rows")
    shared = shared_grams(base, n) if n >= PREFIX_FROM else None
    rows = spool(
        base.mapInArrow(
            _incidence(n, pct, shared),
            f"id {kind}, file bigint, row bigint, n bigint, level int, s0 bigint, s1 bigint, odd array<bigint>, sigs array<bigint>",
        ),
        "ngram-rows",
        wide,
    )

    classes = rows.where("n > 0").groupBy("s0", "s1").agg(F.min(F.struct("file", "row", "n", "level", "odd")).alias("first"))
    classes = spool(classes.select("s0", "s1", F.monotonically_increasing_id().alias("node"), "first.*"), "ngram-classes")

    # sets that share a signature; s0 stands for the class, which at worst makes one more candidate
    paths = [shared_folder(spark, f"ngram-{x}") for x in ("multi", "pairs", "centres")]
    # one shuffle by signature serves the distinct rows and their count, at any size
    found = rows.select(F.explode("sigs").alias("sig"), "s0", "n", "level").repartition("sig").distinct()
    multi = found.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("sig"))).where("c > 1")
    multi = spool(multi.select("sig", "c", "s0", "n", "level"), "ngram-multi", paths[0])
    # signatures are most of a row and have done their part
    rows = spool(rows.select("id", "file", "row", "n", "s0", "s1"), "ngram-narrow")
    discard(spark, wide)
    # a small group gives its pairs within the size bound; a large one is a star in each window of two levels
    least = lambda n: F.lit(1) if shared is None else common_column(n, pct)
    left, right = (multi.where(F.col("c") <= PAIRS_UP_TO).select("sig", F.col("s0").alias(x), F.col("n").alias(f"n{x}")) for x in "ab")
    pairs = left.join(right, "sig").where((F.col("a") < F.col("b")) & (100 * F.least("na", "nb") >= pct * F.greatest("na", "nb")))
    pairs = pairs.groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("both"))
    pairs = pairs.where(2 * F.col("both") >= least(F.least("na", "nb"))).select("a", "b", "na", "nb")
    pairs = spool(similar_parities(pairs, classes, pct), "ngram-pairs", paths[1])
    # what is no pair shares less than half in small groups, so both sets have more than the rest in large ones; a similar
    # set may be smaller and share less
    frequent = multi.where(F.col("c") > PAIRS_UP_TO).withColumn("many", F.count(F.lit(1)).over(Window.partitionBy("s0", "n")))
    frequent = frequent.where(2 * F.col("many") > least(F.ceil(pct * F.col("n") / 100)))
    windows = frequent.select("sig", "s0", F.explode(F.array("level", F.col("level") - 1)).alias("level"))
    centres = spool(windows.groupBy("sig", "level").agg(F.min("s0").alias("centre")), "ngram-centres", paths[2])
    stars = windows.join(small(centres), ["sig", "level"]).where("s0 <> centre")
    links = spool(pair_links(base, pairs, classes, n, pct, block_rows, block_grams), "ngram-pair-links")
    blocks = connected_components(stars.select(F.col("centre").alias("a"), F.col("s0").alias("b")).distinct())
    members = spool(
        classes.join(small(blocks.withColumnRenamed("node", "_s0")), F.col("s0") == F.col("_s0")).select(
            "file", "row", "node", "s0", "s1", "n", "level", F.col("root").alias("block")
        ),
        "ngram-members",
    )
    discard(spark, *paths)
    if not members.isEmpty():
        links = links.unionByName(block_links(base, members, n, pct, block_rows, block_grams))
    roots = connected_components(links).withColumnRenamed("node", "_n")
    found = classes.join(roots, F.col("node") == F.col("_n"), "left").select("s0", "s1", F.coalesce("root", "node").alias("root"))
    return rows, spool(found, "ngram-roots"), docs


def ngram_components(
    docs: DataFrame,
    n: int = 5,
    pct: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_rows: int = 1024,
    block_grams: int = 1_000_000,
    stored: bool = False,
) -> DataFrame:
    """id, n_shingles, component_id of every row of ``docs``; links are pairs with Jaccard similarity >= pct %.

    ``stored``: ``docs`` is what ``spark.read.parquet`` gives, one row for each row of its files.
    """
    rows, classes, _ = row_components(docs, n, pct, id_col, text_col, block_rows, block_grams, stored)
    held = rows.where("n > 0").join(classes, ["s0", "s1"])
    least = spool(held.groupBy("root").agg(F.min("id").alias("component_id")), "ngram-least")
    ids = spool(classes.join(least, "root").select("s0", "s1", "component_id"), "ngram-ids")
    alone = rows.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    linked = rows.where("n > 0").join(ids, ["s0", "s1"]).select("id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(alone)


def near_duplicates_removed(docs: DataFrame, n: int = 5, pct: int = 80, id_col: str = "doc_id", stored: bool = False) -> DataFrame:
    """The rows of ``docs`` without near copies: one row of each component stays, that with the smallest id.

    Rows are told apart by their place in the files, so a row that shares the id of a near copy stays, and rows without
    an id, which come after all others, are near copies as well.  Rows without words all stay.
    """
    rows, classes, docs = row_components(docs, n, pct, id_col, stored=stored)
    held = rows.where("n > 0").join(classes, ["s0", "s1"]).select("root", F.struct(F.col("id").isNull().alias("none"), "id", "file", "row").alias("own"))
    keep = spool(held.groupBy("root").agg(F.min("own").alias("keep"), F.count(F.lit(1)).alias("c")).where("c > 1").select("root", "keep"), "ngram-keep")
    gone = held.join(keep, "root").where("own <> keep").select(F.col("own.file").alias("_file"), F.col("own.row").alias("_row"))
    gone = small(spool(gone, "ngram-gone"))
    here = (F.xxhash64("_locator.file") == F.col("_file")) & (F.col("_locator.row") == F.col("_row"))
    return docs.join(gone, here, "left_anti").drop("_locator")


def op9_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_components(documents(spark, sf_dir), n=3, pct=90, stored=True).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS g
  FROM w
), g AS (SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM s),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id
  WHERE a.n * 10 >= b.n * 9 AND b.n * 10 >= a.n * 9
  GROUP BY 1, 2
  HAVING 100 * count(*) >= 90 * (max(a.n) + max(b.n) - count(*))
), e AS (SELECT x, y FROM pairs UNION SELECT y, x FROM pairs),
r AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, min(r.y) AS component_id
FROM s JOIN r ON s.doc_id = r.x GROUP BY 1, 2
"""
