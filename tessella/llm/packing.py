"""Cost-balanced packing of documents into training sequences.

A document's cost in a sequence is linear in its tokens plus quadratic for attention within it.  Documents, longest
first, go to the sequence with the lowest cost so far that still has room; a document longer than a sequence first
fills whole sequences and goes on with its rest, and one that fits nowhere is cut over the sequences with the most
room.  As there are only as many sequences as the tokens need, less than one sequence is padding in each group.

Documents are dealt into groups by a hash; a group is packed in one task and holds about ``group_bytes`` of text, so
the number of groups follows the input and the work of one task does not.

Defined cases: a null or empty text is the end token alone; repeated rows are packed one by one; a null id is
carried; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import documents

CAPACITY, END = 4096, 2
#: Attention over so many tokens costs as much as all the rest for one token.
QUADRATIC = 1 / 2048


class WordIds(dict):
    """word -> its token ids as little-endian uint32.

    The tokenizer drops white space and never joins across it, so the ids of a text are those of its words in turn.
    It also lowers case and starts a new piece where signs follow a letter, so A-Z are lowered and signs set apart in
    the whole text first, which leaves far fewer different words.  Texts with special tokens, which are found before
    anything else, go without.  About ``limit`` to twice as many words are remembered.
    """

    SIGNS = re.compile(rb"(?<=[a-z0-9])(?=[*$%&#.,!;:?|])")

    def __init__(self, path: str, limit: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.limit, self.older = limit, {}

    def __missing__(self, word: bytes) -> bytes:
        value = self[word] = self.encoded(word)
        return value

    def encoded(self, word: bytes) -> bytes:
        ids = self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def learn(self, words: set[bytes]) -> None:
        """Encode all new words; those of letters only in one call, as each of them is one piece with one end."""
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        known = words & self.older.keys()
        self.update((w, self.older[w]) for w in known)
        letters = [w for w in words - known if w.decode("utf-8", "replace").isalpha()]
        ids = np.array(self.tokenizer.encode(b" ".join(letters).decode("utf-8", "replace"), add_special_tokens=False).ids, dtype="<u4")
        after = (np.flatnonzero(self.ends[ids]) + 1).tolist() if len(ids) else []
        if len(after) == len(letters):
            raw = ids.tobytes()
            self.update((w, raw[4 * i : 4 * j]) for w, i, j in zip(letters, [0, *after], after))

    def of_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text."""
        split = []
        for text in texts:
            raw = text.encode("utf-8", "replace") if text else b""
            if b"<|" not in raw:
                raw = self.SIGNS.sub(b" ", raw.lower())
            split.append(raw.split())
        self.learn(set().union(*split) - self.keys())
        return [b"".join(map(self.__getitem__, words)) for words in split]

    def of(self, text: str | None) -> bytes:
        return self.of_all([text])[0]


#: One per worker process and path; what a worker has learned serves its later tasks too.
_WORDS: dict[str, WordIds] = {}


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int]], int]:
    """(document, start, length, sequence) of every piece, in the order of offsets; the number of sequences.

    ``lengths`` in descending order.
    """
    pieces, sequences = [], 0
    rests = []
    for doc, length in enumerate(lengths.tolist()):
        start = 0
        while length - start >= capacity:
            pieces.append((doc, start, capacity, sequences))
            sequences, start = sequences + 1, start + capacity
        if start < length:
            rests.append((doc, start, length - start))
    rests.sort(key=lambda x: (-x[2], x[0]))
    first = sequences
    sequences += -(-sum(x[2] for x in rests) // capacity)
    room = np.full(sequences - first, capacity, dtype=np.int64)
    cost = np.zeros(sequences - first)
    for doc, start, length in rests:
        at = int(np.where(room >= length, cost, np.inf).argmin())
        while length:
            if room[at] < length:
                at = int(room.argmax())
            take = min(length, int(room[at]))
            pieces.append((doc, start, take, first + at))
            room[at] -= take
            cost[at] += take + take * take * QUADRATIC
            start, length = start + take, length - take
    return pieces, sequences


def _tokenize(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _WORDS:
            _WORDS[path] = WordIds(path)
        words = _WORDS[path]
        end = np.array([END], dtype="<u4").tobytes()
        for batch in batches:
            step = 128  # ids take more room than text; hand them on in small batches
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids = pa.array([x + end for x in words.of_all(part.column("text").to_pylist())], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("bin"), ids], names=["id", "bin", "ids"])

    return run


def _pack_group(capacity: int, id_type: pa.DataType):
    def run(table: pa.Table) -> pa.Table:
        group = table.column("bin")[0].as_py()
        rows = [(len(i) // 4, doc, i) for doc, i in zip(table.column("id").to_pylist(), table.column("ids").to_pylist())]
        rows.sort(key=lambda r: (-r[0], r[1] is None, r[1] if r[1] is not None else 0, zlib.crc32(r[2])))
        pieces, _ = pack(np.array([r[0] for r in rows], dtype=np.int64), capacity)
        used: dict[int, int] = {}
        out = {k: [] for k in ("id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
        for doc, start, length, sequence in pieces:
            total, name, ids = rows[doc]
            offset = used.get(sequence, 0)
            used[sequence] = offset + length
            crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)])
            for k, v in zip(out, (name, start, length, crc, total, (group << 24) + sequence, offset)):
                out[k].append(v)
        return pa.table({k: pa.array(v, id_type if k == "id" else pa.int64()) for k, v in out.items()})

    return run


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def packed(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    group_bytes: int = 8 << 20,
) -> DataFrame:
    """id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    from pyspark.sql.pandas.types import to_arrow_type

    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = base.agg(F.sum(F.octet_length("text").cast("bigint") + 8)).first()[0] or 0
    groups = max(1, round(total / group_bytes))
    kind = base.schema["id"].dataType
    dealt = base.withColumn("bin", F.pmod(F.xxhash64("id", F.crc32(F.col("text").cast("binary"))), F.lit(groups)).cast("bigint"))
    tokens = dealt.select("id", "bin", "text").mapInArrow(
        _tokenize(tokenizer_path or default_tokenizer()), f"id {kind.simpleString()}, bin bigint, ids binary"
    )
    return tokens.groupBy("bin").applyInArrow(
        _pack_group(capacity, to_arrow_type(kind)),
        f"id {kind.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    )


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
