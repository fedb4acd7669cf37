"""Line deduplication by a log-template tree.

A line goes down a tree of fixed depth: by its number of tokens, then by its leading tokens, where a token with a
digit counts as a variable.  At a leaf, a token is constant at its position if at least ``min_docs`` (document, line)
pairs of the leaf have it there; every other position is a variable field, and the constants with their positions
are the line's template.  A template that is constant in at least ``constant_pct`` % of its positions and stands in
at least ``min_docs`` documents recurs, and all its lines are dropped.  With ``long_tokens``, two copies are enough
for long lines: the same is done with ``long_docs`` in the place of ``min_docs``, and templates of at least
``long_tokens`` constants recur too.  Lines that differ only in names, numbers or
dates thus fall together, while lines that merely start alike do not.

Rows are narrow keys until a leaf is known to recur; equal lines are counted once; counts are taken before any join.
Lines are identified by 96 bits of hashes.  Only DataFrame functions are used.

Defined cases: a null text stays null, an empty one empty; blank lines are never dropped; repeated rows count as one
document; null identifiers are allowed; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import documents, spool

#: A side of up to so many rows (about 24 bytes each) is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000
SPACE = r"[\x20\x09-\x0D]+"


def tokens(line: Column) -> Column:
    return F.filter(F.split(line, SPACE), lambda t: t != "")


def small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _masked(token: Column) -> Column:
    return F.when(token.rlike("[0-9]"), F.lit("<*>")).otherwise(token)


def line_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, t (hash of the text), at (line number), line."""
    text = F.col(text_col).cast("string")
    return docs.where(text.isNotNull()).select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("t"), F.posexplode(F.split(text, "\n")).alias("at", "line")
    )


def recurring_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 2, min_docs: int = 10, constant_pct: int = 60,
    long_tokens: int | None = None, long_docs: int = 2,
) -> DataFrame:
    """id, t, at of every line whose template recurs."""
    keys = [F.xxhash64("line").alias("k1"), F.hash("line").alias("k2")]
    lead = [F.when(F.col("n") > i, _masked(F.col("words")[i])) for i in range(depth)]
    lines = spool(
        line_rows(docs, id_col, text_col)
        .withColumn("words", tokens(F.col("line")))
        .withColumn("n", F.size("words"))
        .where("n > 0")
        .select("id", "t", "at", "n", F.xxhash64("n", *lead).alias("leaf"), *keys),
        "template-lines",
    )
    recurring = _recurring(docs, lines, id_col, text_col, min_docs, constant_pct, 0)
    if long_tokens is not None:
        long = lines.where(F.col("n") >= long_tokens)
        recurring = recurring.union(_recurring(docs, long, id_col, text_col, long_docs, constant_pct, long_tokens)).distinct()
    return lines.join(small(recurring), ["leaf", "k1", "k2"], "left_semi").select("id", "t", "at")


def _recurring(docs: DataFrame, lines: DataFrame, id_col: str, text_col: str, min_docs: int, constant_pct: int, least: int) -> DataFrame:
    """leaf, k1, k2 of the lines whose template of at least ``least`` constants stands in ``min_docs`` documents."""
    keys = [F.xxhash64("line").alias("k1"), F.hash("line").alias("k2")]
    pairs = lines.select("id", "t", "leaf", "k1", "k2").distinct()
    distinct = pairs.groupBy("leaf", "k1", "k2").agg(F.count(F.lit(1)).alias("docs"))
    leaves = distinct.groupBy("leaf").agg(F.sum("docs").alias("_all")).where(F.col("_all") >= min_docs).select("leaf")
    candidates = spool(distinct.join(leaves, "leaf"), "template-candidates")

    # the text of one line of each candidate
    texts = (
        line_rows(docs, id_col, text_col)
        .select("line", *keys)
        .join(small(candidates), ["k1", "k2"])
        .groupBy("leaf", "k1", "k2", "docs")
        .agg(F.first("line").alias("line"))
    )
    placed = spool(
        texts.select("leaf", "k1", "k2", "docs", F.posexplode(tokens(F.col("line"))).alias("place", "token")).select(
            "leaf", "k1", "k2", "docs", "place", F.xxhash64("token").alias("token")
        ),
        "template-tokens",
    )
    constants = (
        placed.groupBy("leaf", "place", "token")
        .agg(F.sum("docs").alias("_n"))
        .where(F.col("_n") >= min_docs)
        .select("leaf", "place", "token", F.lit(True).alias("constant"))
    )
    templates = (
        placed.join(constants, ["leaf", "place", "token"], "left")
        .groupBy("leaf", "k1", "k2")
        .agg(
            F.count("constant").alias("fixed"),
            F.count(F.lit(1)).alias("n"),
            F.sum(F.when(F.col("constant"), F.xxhash64("place", "token").bitwiseAND(F.lit(2**62 - 1)).cast("decimal(38,0)"))).alias("shape"),
        )
        .where((F.col("fixed") * 100 >= F.col("n") * constant_pct) & (F.col("fixed") >= least))
        .select("leaf", "k1", "k2", "fixed", "shape")
    )
    templates = spool(templates, "templates")
    template = ["leaf", "fixed", "shape"]
    spread = (
        pairs.join(templates, ["leaf", "k1", "k2"])
        .select("id", "t", *template)
        .distinct()
        .groupBy(*template)
        .agg(F.count(F.lit(1)).alias("_docs"))
        .where(F.col("_docs") >= min_docs)
        .select(*template)
    )
    return spool(templates.join(spread, template, "left_semi").select("leaf", "k1", "k2"), "templates-recurring")


def without_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, n_lines, n_dropped and the text without the dropped lines, of every row."""
    dropped = (
        recurring_lines(docs, id_col, text_col, **options)
        .groupBy(F.col("id").alias("_id"), F.col("t").alias("_t"))
        .agg(F.collect_set("at").alias("gone"))
    )
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_t"))
    lines = F.split(F.col("text"), "\n")
    # array_except hashes, so a text of many lines costs no more than its length
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    kept = F.array_join(F.transform(stay, lambda i: F.element_at(F.col("_lines"), i + 1)), "\n")
    return (
        base.join(dropped, same, "left")
        .withColumn("_lines", F.when(F.col("gone").isNotNull(), lines))
        .select(
            "id",
            F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("bigint").alias("n_lines"),
            F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_dropped"),
            F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"),
        )
    )


def op2_line_templates(spark, sf_dir: str) -> DataFrame:
    return without_recurring_lines(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


#: Lines with so many constant tokens do not recur by chance; two documents that share one are enough.
LONG_TOKENS = 20


def op2_long_line_templates(spark, sf_dir: str) -> DataFrame:
    return without_recurring_lines(documents(spark, sf_dir), long_tokens=LONG_TOKENS).withColumnRenamed("id", "doc_id")


OP2_SQL = r"""
WITH l AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents WHERE text IS NOT NULL
), w AS (
  SELECT doc_id, text, line, pos, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS words FROM l
), f AS (
  SELECT *, len(words) AS n,
         CASE WHEN regexp_matches(words[1], '[0-9]') THEN '<*>' ELSE words[1] END AS t1,
         CASE WHEN regexp_matches(words[2], '[0-9]') THEN '<*>' ELSE words[2] END AS t2
  FROM w WHERE len(words) > 0
), d AS (
  SELECT n, t1, t2, line, any_value(words) AS words, count(DISTINCT (doc_id, text)) AS docs FROM f GROUP BY n, t1, t2, line
), p AS (
  SELECT n, t1, t2, line, docs, unnest(words) AS token, generate_subscripts(words, 1) AS place FROM d
), c AS (
  SELECT n, t1, t2, place, token FROM p GROUP BY ALL HAVING sum(docs) >= 10
), t AS (
  SELECT p.n, p.t1, p.t2, p.line, count(c.token) AS fixed,
         list((p.place, p.token) ORDER BY p.place) FILTER (c.token IS NOT NULL) AS shape
  FROM p LEFT JOIN c ON p.n = c.n AND p.t1 IS NOT DISTINCT FROM c.t1 AND p.t2 IS NOT DISTINCT FROM c.t2
       AND p.place = c.place AND p.token = c.token
  GROUP BY p.n, p.t1, p.t2, p.line HAVING count(c.token) * 100 >= p.n * 60
), s AS (
  SELECT t.n, t.t1, t.t2, t.shape FROM f JOIN t ON f.n = t.n AND f.t1 IS NOT DISTINCT FROM t.t1
       AND f.t2 IS NOT DISTINCT FROM t.t2 AND f.line = t.line
  GROUP BY t.n, t.t1, t.t2, t.shape HAVING count(DISTINCT (f.doc_id, f.text)) >= 10
), gone AS (
  SELECT DISTINCT t.line FROM t JOIN s ON t.n = s.n AND t.t1 IS NOT DISTINCT FROM s.t1 AND t.t2 IS NOT DISTINCT FROM s.t2 AND t.shape = s.shape
), r AS (
  SELECT l.doc_id, l.text, count(*) AS n_lines, count(gone.line) AS n_dropped,
         string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (gone.line IS NULL) AS rest
  FROM l LEFT JOIN gone ON l.line = gone.line GROUP BY l.doc_id, l.text
)
SELECT documents.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped,
       CASE WHEN documents.text IS NULL THEN NULL ELSE coalesce(rest, '') END AS text
FROM documents LEFT JOIN r ON documents.doc_id = r.doc_id
"""
