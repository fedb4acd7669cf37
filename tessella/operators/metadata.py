"""Metadata of data sets: schema sync, keys by profile, draft catalogs, value mappings, training samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import text as tx

CONNECTION = "dataset_id string, dialect string, url string, enabled boolean, updated_at timestamp_ntz"
TABLE = "dataset_id string, table_name string, comment string"
COLUMN = (
    "dataset_id string, table_name string, column_name string, data_type string, nullable boolean, ordinal int, "
    "is_primary boolean, is_foreign boolean, comment string, sample_values array<string>"
)
RELATION = "dataset_id string, source_table string, source_column string, target_table string, target_column string"
MAPPING = (
    "dataset_id string, table_name string, column_name string, nl_term string, db_value string, match_mode string, source string, enabled boolean"
)
JOB = "job_id bigint, dataset_id string, status string, started_at timestamp_ntz, finished_at timestamp_ntz, error string"
# Operators offered for each kind of dimension, in their order.
KIND_OPERATORS = {"time": ["between", "gte", "lte"], "number": ["eq", "in", "gte", "lte", "between"], "categorical": ["eq", "in"]}
TRAINING_SUFFIXES = {"sql": "-sql", "ddl": "-ddl", "documentation": "-doc"}


# Fixed parts of type names that make a column one of times or of numbers.
TIME_TYPES, NUMBER_TYPES = "date|time|year", "int|decimal|numeric|float|double|real"


def column_kind(data_type):
    """Time, number or categorical by the type's name; time is tested first."""
    low = F.lower(data_type)
    return F.when(low.rlike(TIME_TYPES), "time").when(low.rlike(NUMBER_TYPES), "number").otherwise("categorical")


def columns_of(spark: SparkSession, dataset_id: str, tables: dict[str, DataFrame], primary: dict[str, str] | None = None, foreign: list[tuple[str, str, str, str]] = ()) -> DataFrame:
    """Rows of ``COLUMN`` from the schemas alone; keys as declared."""
    primary = primary or {}
    links = {(t, c) for t, c, _, _ in foreign}
    rows = [
        (dataset_id, name, f.name, f.dataType.simpleString(), f.nullable, i + 1, primary.get(name) == f.name, (name, f.name) in links, None, None)
        for name, df in sorted(tables.items())
        for i, f in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(rows, COLUMN)


def unique_columns(df: DataFrame) -> list[str]:
    """Columns without nulls whose values are all distinct.

    One pass sketches every column; those whose sketch is far from the number of rows are out, the others are counted
    exactly together in a second pass.
    """
    scalar = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("int", "bigint", "string", "smallint")]
    if not scalar:
        return []
    first = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(F.col(f"`{c}`")).alias(f"v{i}") for i, c in enumerate(scalar)],
        *[F.approx_count_distinct(F.col(f"`{c}`"), 0.02).alias(f"d{i}") for i, c in enumerate(scalar)],
    ).first()
    likely = [c for i, c in enumerate(scalar) if first["n"] and first[f"v{i}"] == first["n"] and first[f"d{i}"] >= 0.8 * first["n"]]
    if not likely:
        return []
    exact = df.agg(*[F.count_distinct(F.col(f"`{c}`")).alias(f"e{i}") for i, c in enumerate(likely)]).first()
    return [c for i, c in enumerate(likely) if exact[f"e{i}"] == first["n"]]


def included(child: DataFrame, column: str, parent: DataFrame, key: str) -> bool:
    """Every value of ``column`` that is not null occurs in ``key``."""
    values = child.where(F.col(column).isNotNull()).select(F.col(column).alias("v")).distinct()
    return values.join(parent.select(F.col(key).alias("v")), "v", "left_anti").isEmpty()


def sample_values(df: DataFrame, column: str, k: int = 5) -> DataFrame:
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def draft_dimensions(columns: DataFrame) -> DataFrame:
    """A dimension for every column that is no primary key; keys that would collide carry their table's name."""
    own = columns.where(~F.col("is_primary")).withColumn("key", tx.identifier(F.col("column_name")))
    same = Window.partitionBy("dataset_id", "key")
    kind = column_kind(F.col("data_type"))
    ops = F.when(kind == "time", F.array(*map(F.lit, KIND_OPERATORS["time"]))).when(kind == "number", F.array(*map(F.lit, KIND_OPERATORS["number"]))).otherwise(F.array(*map(F.lit, KIND_OPERATORS["categorical"])))
    return own.withColumn("n", F.count(F.lit(1)).over(same)).select(
        "dataset_id",
        F.when(F.col("n") > 1, F.concat(tx.identifier(F.col("table_name")), F.lit("_"), F.col("key"))).otherwise(F.col("key")).alias("dimension_key"),
        "table_name", "column_name", kind.alias("kind"), F.array_join(ops, ",").alias("operators"),
    )


def draft_metrics(columns: DataFrame) -> DataFrame:
    """A row count for every table and a sum for every numeric column that is no key."""
    table = tx.identifier(F.col("table_name"))
    counts = columns.groupBy("dataset_id", "table_name").agg(
        F.min_by("column_name", F.struct(~F.col("is_primary"), F.col("ordinal"))).alias("field")
    ).select("dataset_id", F.concat(table, F.lit("_count")).alias("metric_key"), "table_name", "field", F.lit("count").alias("aggregation"))
    sums = columns.where(~F.col("is_primary") & ~F.col("is_foreign") & (column_kind(F.col("data_type")) == "number")).select(
        "dataset_id", F.concat(table, F.lit("_"), tx.identifier(F.col("column_name")), F.lit("_sum")).alias("metric_key"), "table_name", F.col("column_name").alias("field"), F.lit("sum").alias("aggregation")
    )
    return counts.unionByName(sums)


def draft_catalog(columns: DataFrame, relations: list[tuple[str, str, str, str]], version: str) -> dict:
    """A catalog to be read over by people; metadata of one data set, collected (columns, not rows of tables)."""
    rows = columns.orderBy("table_name", "ordinal").collect()
    if not rows:
        raise ValueError("no columns")
    dataset = rows[0]["dataset_id"]
    dims, metrics = draft_dimensions(columns).orderBy("table_name", "dimension_key").collect(), draft_metrics(columns).orderBy("table_name", "metric_key").collect()
    name = lambda t, c: f"{t}__{c}"
    entities = {}
    for r in rows:
        if r["is_foreign"]:
            entities[name(r["table_name"], r["column_name"])] = {"key": name(r["table_name"], r["column_name"]), "table_key": r["table_name"], "field": r["column_name"], "entity_type": "foreign"}
        if r["is_primary"]:  # a primary key wins over a foreign one
            entities[name(r["table_name"], r["column_name"])] = {"key": name(r["table_name"], r["column_name"]), "table_key": r["table_name"], "field": r["column_name"], "entity_type": "primary"}
    links = [
        {"left_entity_key": name(t, c), "right_entity_key": name(u, d), "join_type": "left"}
        for t, c, u, d in relations
        if name(t, c) in entities and name(u, d) in entities
    ]
    tables = sorted({r["table_name"] for r in rows})
    aliases = {("dimension", d["dimension_key"], d["column_name"]) for d in dims} | {("metric", m["metric_key"], m["metric_key"]) for m in metrics}
    return {
        "catalog_version": f"draft-{version}",
        "dataset_id": dataset,
        "tables": [{"key": t, "label": t, "physical_table": t} for t in tables],
        "entities": list(entities.values()),
        "relationships": links,
        "dimensions": [{"key": d["dimension_key"], "label": d["column_name"], "table_key": d["table_name"], "field": d["column_name"], "kind": d["kind"], "operators": d["operators"].split(",")} for d in dims],
        "metrics": [{"key": m["metric_key"], "label": m["metric_key"], "table_key": m["table_name"], "field": m["field"], "aggregation": m["aggregation"]} for m in metrics],
        "metric_versions": [],
        "aliases": [{"alias": a, "target_type": t, "key": k} for t, k, a in sorted(aliases)],
    }


# --- values -------------------------------------------------------------------------------------------------------


def physical_mappings(mappings: DataFrame, dimensions: DataFrame, tables: DataFrame) -> DataFrame:
    """Rows of ``MAPPING`` with the dimension_key of their physical table and column.

    ``dimensions``: dimension_key, table_key, field; ``tables``: table_key, physical_table.
    """
    named = dimensions.join(tables, "table_key").select("dimension_key", F.col("physical_table").alias("table_name"), F.col("field").alias("column_name"))
    return mappings.join(named, ["table_name", "column_name"])


def value_candidates(questions: DataFrame, mappings: DataFrame, samples: DataFrame, block: int = 256) -> DataFrame:
    """Filters that questions (qid, question) name by value: mapped terms score 1.0, sampled values 0.8.

    ``mappings`` are rows of ``MAPPING`` with dimension_key; ``samples``: dimension_key, value.  The terms go in blocks of
    ``block``; a question meets a block as one row and keeps the terms it holds, so no pairs of both sides are made.
    """
    terms = mappings.where("enabled").select("dimension_key", "nl_term", "db_value", F.lit(1.0).alias("score")).unionByName(
        samples.select("dimension_key", F.col("value").alias("nl_term"), F.col("value").alias("db_value"), F.lit(0.8).alias("score"))
    )
    terms = terms.where("nl_term <> ''").withColumn("_block", F.floor(F.monotonically_increasing_id() / block))
    blocks = terms.groupBy("_block").agg(F.collect_list(F.struct("dimension_key", "nl_term", "db_value", "score")).alias("terms"))
    held = F.filter("terms", lambda t: F.contains(F.col("question"), t["nl_term"]) | F.contains(F.col("question"), t["db_value"]))
    found = questions.crossJoin(blocks).select("qid", F.inline(held))
    return found.groupBy("qid", "dimension_key", "db_value").agg(F.max("score").alias("score"), F.min("nl_term").alias("nl_term"))


# --- training samples ---------------------------------------------------------------------------------------------


def training_rows(samples: DataFrame) -> DataFrame:
    """Samples (kind, question, content) with stable ids; SQL without a question and empty contents are dropped.

    Contents in Base64 are decoded.
    """
    samples = samples.withColumn("content", tx.decoded(F.col("content")))
    text = F.coalesce(F.col("question"), F.lit("")), F.col("content")
    kept = samples.where(F.col("kind").isin(*TRAINING_SUFFIXES) & (F.trim("content") != "")).where(
        (F.col("kind") != "sql") | (F.trim(F.coalesce("question", F.lit(""))) != "")
    )
    suffix = F.when(F.col("kind") == "documentation", "-doc").otherwise(F.concat(F.lit("-"), F.col("kind")))
    return kept.select(F.concat(tx.stable_uuid(F.concat_ws("\n", *text)), suffix).alias("id"), "kind", "question", "content").dropDuplicates(["id"])


def without_training(rows: DataFrame, ids: list[str]) -> DataFrame:
    """Remove by id; "-documentation" is accepted for "-doc"."""
    gone = [i.removesuffix("umentation") if i.endswith("-documentation") else i for i in ids]
    return rows.where(~F.col("id").isin(gone)) if gone else rows


def exact_sql(rows: DataFrame, question: str) -> DataFrame:
    """Trained SQL of the same question, white space aside."""
    return rows.where((F.col("kind") == "sql") & (tx.squeeze(F.col("question")) == " ".join(question.split())))


def near_sql(scored: DataFrame, question: str, most: float | None = 0.45) -> DataFrame:
    """Few-shot SQL by distance; the same question always stays."""
    exact = tx.squeeze(F.col("question")) == " ".join(question.split())
    return scored if most is None else scored.where(exact | (F.col("distance") <= most))


def information_plan(columns: DataFrame) -> DataFrame:
    """One Markdown document per table of an information schema."""
    line = F.concat(F.lit("| "), F.col("column_name"), F.lit(" | "), F.col("data_type"), F.lit(" |"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line")))), lambda x: x["line"])
    return columns.groupBy("dataset_id", "table_name").agg(F.array_join(lines, "\n").alias("body")).select(
        "dataset_id", "table_name", F.concat(F.lit("Columns of "), F.col("table_name"), F.lit(":\n"), F.col("body")).alias("document")
    )
