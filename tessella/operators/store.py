"""A metadata store in Parquet: connections, tables, columns, relations and sync jobs of data sets.

Every kind is a table partitioned by dataset_id, so a sync replaces one data set and leaves the others; jobs are only
appended to, and a job's last entry is its state.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators import metadata as md
from tessella.sources import sinks

JOB = f"{md.JOB}, table_count bigint, column_count bigint, relation_count bigint"
KINDS = {"connection": md.CONNECTION, "table": md.TABLE, "column": md.COLUMN, "relation": md.RELATION, "mapping": md.MAPPING, "job": JOB}
#: Order of listings.
ORDER = {
    "connection": ("dataset_id",),
    "table": ("dataset_id", "table_name"),
    "column": ("dataset_id", "table_name", "ordinal"),
    "relation": ("dataset_id", "source_table", "source_column"),
    "mapping": ("dataset_id", "table_name", "column_name", "nl_term"),
}


class MetadataStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def rows(self, kind: str) -> DataFrame:
        """All rows of a kind; columns that an older store lacks are null, a kind that was never written is empty."""
        try:
            return self.spark.read.schema(KINDS[kind]).parquet(f"{self.root}/{kind}")
        except AnalysisException:
            return self.spark.createDataFrame([], KINDS[kind])

    def listed(self, kind: str, dataset_id: str | None = None, **equal) -> DataFrame:
        """The rows of a data set in their order, of given values only."""
        found = self.rows(kind)
        for name, value in {"dataset_id": dataset_id, **equal}.items():
            if value is not None:
                found = found.where(F.col(name) == value)
        return found.orderBy(*ORDER[kind])

    def replace(self, kind: str, new: DataFrame) -> None:
        """Replace all rows of the data sets in ``new``."""
        sinks.replace_rows(new, f"{self.root}/{kind}", "dataset_id")

    def put_connection(self, dataset_id: str, dialect: str, url: str, enabled: bool = True) -> None:
        row = self.spark.createDataFrame([(dataset_id, dialect, url, enabled)], "dataset_id string, dialect string, url string, enabled boolean")
        self.replace("connection", row.withColumn("updated_at", F.current_timestamp().cast("timestamp_ntz")))

    def _log(self, job_id: int, dataset_id: str, status: str, counts: tuple[int, int, int] = (0, 0, 0), error: str | None = None) -> None:
        row = self.spark.createDataFrame([(job_id, dataset_id, status, error, *counts)], "job_id bigint, dataset_id string, status string, error string, table_count bigint, column_count bigint, relation_count bigint")
        now = F.current_timestamp().cast("timestamp_ntz")
        started = F.when(F.lit(status == "running"), now)
        row.withColumn("started_at", started).withColumn("finished_at", F.when(F.lit(status != "running"), now)).write.mode("append").partitionBy("dataset_id").parquet(f"{self.root}/job")

    def jobs(self, dataset_id: str | None = None) -> DataFrame:
        """The state of every job, the latest first."""
        found = self.rows("job")
        if dataset_id is not None:
            found = found.where(F.col("dataset_id") == dataset_id)
        last = Window.partitionBy("dataset_id", "job_id").orderBy(F.col("finished_at").isNull())
        whole = Window.partitionBy("dataset_id", "job_id")
        state = found.withColumn("started_at", F.min("started_at").over(whole)).withColumn("_i", F.row_number().over(last)).where("_i = 1")
        return state.drop("_i").orderBy(F.desc("job_id"))

    def sync(self, dataset_id: str, tables: Callable[[], dict[str, DataFrame]], primary: dict[str, str] | None = None, foreign: list[tuple[str, str, str, str]] = ()) -> dict[str, int]:
        """Read the schemas of a data set's tables into the store as one job; an error is recorded and raised again."""
        job = time.time_ns()
        self._log(job, dataset_id, "running")
        try:
            found = tables()
            columns = md.columns_of(self.spark, dataset_id, found, primary, foreign)
            self.replace("table", self.spark.createDataFrame([(dataset_id, t, None) for t in sorted(found)], md.TABLE))
            self.replace("column", columns)
            if foreign:
                self.replace("relation", self.spark.createDataFrame([(dataset_id, *link) for link in foreign], md.RELATION))
            counts = (len(found), sum(len(df.columns) for df in found.values()), len(foreign))
        except Exception as error:
            self._log(job, dataset_id, "error", error=str(error))
            raise
        self._log(job, dataset_id, "success", counts)
        return dict(zip(("table_count", "column_count", "relation_count"), counts))
