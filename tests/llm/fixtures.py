"""Small tables that hold every awkward case at once."""

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use inside
        T.StructField("id", T.StringType()),
        T.StructField("size", T.StringType()),
        T.StructField("digest", T.StringType()),
        T.StructField("_n", T.StringType()),
        T.StructField("shard", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("bin", T.StringType()),
        T.StructField("kept", T.StringType()),
    ]
)

LONG = " ".join(f"w{i % 977}x{i}" for i in range(40_000))
PARAGRAPH = " ".join(f"alpha{i} beta{i % 7} gamma{i % 5}" for i in range(40))


def awkward_rows() -> list[tuple]:
    texts = {
        1: "the quick brown fox jumps over the lazy dog",
        2: "the quick brown fox jumps over the lazy dog",
        3: "The Quick brown fox jumps over the lazy DOG",
        4: None,
        5: "",
        6: " \t\n\r ",
        7: LONG,
        8: LONG + " tail",
        9: PARAGRAPH,
        10: PARAGRAPH + " more",
        11: "one",
        12: "two words",
        13: "é ü ß 日本語 text\x0bwith\x0codd\x1cspaces and more 👍",
        15: "host 1.2.3.² end ①②③④ and 4.٣.2.1 with ½",
        14: "a line\na line\na line\n\n  \nanother",
    }
    rows = [(i, t, "en" if i % 2 else None, None if i % 4 == 0 else f"s{i % 3}", len(t) if t else None) for i, t in texts.items()]
    rows += [rows[0], rows[0], (None, "no id", "en", "s1", 5), (None, None, None, None, None), (2, "same id, other text", "en", "s2", 19)]
    return [(*r, "x", "y", None, "z", "9", "t", "b", "k") for r in rows]


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
