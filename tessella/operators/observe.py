"""Summaries of route events, batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _mean(column: str) -> Column:
    """Mean of the values present, cut to a whole number; 0 without any."""
    return F.coalesce(F.avg(column).cast("bigint"), F.lit(0))


def route_summary(events: DataFrame, by: tuple[str, ...] = ("route",)) -> DataFrame:
    status = F.col("status")
    return events.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(status == "success").alias("success"),
        F.count_if(status == "error").alias("error"),
        F.count_if(status == "clarification").alias("clarification"),
        _mean("total_ms").alias("avg_total_ms"),
        _mean("run_sql_ms").alias("avg_run_sql_ms"),
    )


def task_summary(tasks: DataFrame) -> DataFrame:
    """Counts by status, by type and over all, in one pass."""
    counted = tasks.groupingSets([("status",), ("type",), ()], "status", "type").agg(
        F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n")
    )
    kind = F.when(F.col("g") == 1, "status").when(F.col("g") == 2, "type").otherwise("total")
    return counted.select(kind.alias("kind"), F.coalesce("status", "type", F.lit("")).alias("value"), "n")
