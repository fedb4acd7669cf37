"""Route events: append-only JSON lines, one folder per day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "timestamp timestamp, route string, status string, dataset_id string, request_id string, question_hash string, "
    "catalog_load_ms bigint, semantic_agent_ms bigint, semantic_parse_ms bigint, sql_build_ms bigint, run_sql_ms bigint, "
    "total_ms bigint, sql_hash string, row_count bigint, error_type string, error_message string"
)


def read_events(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(path, recursiveFileLookup=True)


def stream_events(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").json(path)


def newest_first(events: DataFrame, limit: int, route: str | None = None, dataset_id: str | None = None) -> DataFrame:
    """The latest events, of one route or dataset if given; ties by request id."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    if route is not None:
        events = events.where(F.col("route") == route)
    if dataset_id is not None:
        events = events.where(F.col("dataset_id") == dataset_id)
    return events.orderBy(F.desc("timestamp"), F.desc("request_id")).limit(limit)


def hashed(text: str):
    """Redaction: the first twelve hex digits of SHA-256, "none" for null."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.substring(F.sha2(column, 256), 1, 12), F.lit("none"))
