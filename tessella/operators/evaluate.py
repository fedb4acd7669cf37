"""Execution accuracy: results against results, and counters over evaluation cases."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.plans.model import Draft, Filter

CASE = "id string, level string, category string, status string, ok boolean, ex boolean, signature string, run int"


def load_cases(path: str | Path) -> list[dict]:
    """JSON lines; blank lines and lines that begin with # are skipped; an error names its line."""
    out = []
    for number, line in enumerate(Path(path).read_text(encoding="utf-8").splitlines(), 1):
        if line.strip() and not line.lstrip().startswith("#"):
            try:
                out.append(json.loads(line))
            except json.JSONDecodeError as error:
                raise ValueError(f"{path}, line {number}: {error}") from error
    return out


def same_rows(got: DataFrame, golden: DataFrame) -> bool:
    """Equal bags of rows on the golden columns, in any order."""
    columns = golden.columns
    if any(c not in got.columns for c in columns):
        return False
    a = got.select(*[F.col(f"`{c}`").cast("string") for c in columns])
    b = golden.select(*[F.col(f"`{c}`").cast("string") for c in columns])
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def bag_difference(got: DataFrame, golden: DataFrame) -> DataFrame:
    """Rows in one bag only, with the side they are on."""
    columns = golden.columns
    a, b = got.select(*columns), golden.select(*columns)
    return a.exceptAll(b).withColumn("side", F.lit("got")).unionByName(b.exceptAll(a).withColumn("side", F.lit("golden")))


def matches(case: dict, draft: Draft, status: str) -> list[str]:
    """What a draft misses of a case's expectations; empty if nothing."""
    wrong = []
    if case.get("expect_status", "ready") != status:
        wrong.append("status")
    if case.get("expect_metric_key") and case["expect_metric_key"] != draft.metric_key:
        wrong.append("metric")
    if case.get("expect_metric_keys") and set(case["expect_metric_keys"]) != set(draft.metric_keys):
        wrong.append("metrics")
    if "expect_group_by" in case:
        fixed = {f.dimension_key for f in draft.filters if f.operator == "eq"}
        want, have = set(case["expect_group_by"]), set(draft.group_by_dimension_keys)
        if want - have or have - want - fixed:
            wrong.append("group_by")
    have = {_canonical(f) for f in draft.filters}
    if any(_canonical(Filter(**f)) not in have for f in case.get("expect_filters", [])):
        wrong.append("filters")
    return wrong


def _canonical(f: Filter) -> str:
    return json.dumps([f.dimension_key, f.operator, f.value], sort_keys=True, default=str, ensure_ascii=False)


def counters(cases: DataFrame) -> DataFrame:
    """Overall, per level and per category, in one pass over rows of ``CASE``."""
    counted = cases.groupingSets([(), ("level",), ("category",)], "level", "category").agg(
        F.grouping_id().alias("g"),
        F.count(F.lit(1)).alias("total"),
        F.count_if("ok").alias("ok"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.count_if(F.col("status") == "ready").alias("ready"),
        F.count_if(F.col("status") == "clarification").alias("clarification"),
        F.count_if(F.col("status") == "error").alias("error"),
        F.count_if(F.col("ex").isNotNull()).alias("ex_total"),
        F.count_if(F.coalesce("ex", F.lit(False))).alias("ex_ok"),
    )
    scope = F.when(F.col("g") == 3, "overall").when(F.col("g") == 1, "level").otherwise("category")
    return counted.select(scope.alias("scope"), F.coalesce("level", "category", F.lit("")).alias("name"), "total", "ok", "failed", "ready", "clarification", "error", "ex_total", "ex_ok")


def consistency(cases: DataFrame) -> DataFrame:
    """Share of cases whose runs all gave one signature; 1 without cases."""
    per_case = cases.groupBy("id").agg(F.countDistinct("signature").alias("kinds"), F.count(F.lit(1)).alias("runs"))
    n, stable = F.count(F.lit(1)), F.count_if(F.col("kinds") <= 1)
    return per_case.agg(
        n.alias("cases"), stable.alias("stable"), F.when(n == 0, 1.0).otherwise(stable / n).alias("stability_rate"), F.coalesce(F.max("kinds"), F.lit(0)).alias("most_kinds")
    )


def vote(candidates: DataFrame) -> DataFrame:
    """The winning signature per question: most votes, then the earliest candidate."""
    counted = candidates.groupBy("qid", "signature").agg(F.count(F.lit(1)).alias("votes"), F.min("position").alias("first"))
    best = F.min_by(F.struct("signature", "votes", "first"), F.struct(-F.col("votes"), F.col("first")))
    return counted.groupBy("qid").agg(best.alias("b")).select("qid", "b.signature", "b.votes", "b.first")


def case_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, CASE)


def top_sample(result: DataFrame, metric: str, n: int) -> DataFrame:
    """The rows of a grouped result with the largest values of a metric, for cases without golden SQL."""
    return result.orderBy(F.desc(metric), *[c for c in result.columns if c != metric]).limit(n)


def history_sample(history: DataFrame, databases: list[str] | None = None, schemas: list[str] | None = None, k: int = 10, seed: int = 0) -> DataFrame:
    """At most ``k`` statements (query_text, rows_produced) with more than one row that name a database and a schema."""
    found = history.where("rows_produced > 1")
    for names in (databases, schemas):
        if names is not None:
            low = F.lower("query_text")
            named = [F.contains(low, F.lit(n.lower())) for n in names]
            found = found.where(F.array_max(F.array(*named)) if named else F.lit(False))
    return found.orderBy(F.xxhash64("query_text", F.lit(seed)), "query_text").limit(k)
