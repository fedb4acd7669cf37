"""Data sets: where tables come from and the columns derived at reading."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting that a query's shuffle files are removed when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
TPCH_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, which all machines share; a temporary one only in a local process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tessella-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_once(df: DataFrame, path: str) -> None:
    """``df`` as Parquet; the shuffle files of this job go when it ends, as later steps read the table."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: what several later steps use is computed once, and a lost executor loses none."""
    path = shared_path(df.sparkSession, name)
    write_once(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parquet_tables(spark: SparkSession, directory: str) -> Callable[[str], DataFrame]:
    """Physical name -> DataFrame over ``directory/<name>.parquet``; nothing is read before it is needed."""
    return lambda name: derived(spark.read.parquet(f"{directory}/{name}.parquet"), name)


def view_tables(spark: SparkSession) -> Callable[[str], DataFrame]:
    """Physical name -> table or view of the session's catalog."""
    return lambda name: derived(spark.table(name), name)


def derived(df: DataFrame, name: str) -> DataFrame:
    """Measures are columns, as a metric aggregates one field; money as exact decimals, so sums do not depend on order."""
    if name == "lineitem" and {"l_extendedprice", "l_discount", "l_shipdate", "l_returnflag", "l_quantity"} <= set(df.columns):
        money = F.col("l_extendedprice").cast("decimal(18,4)")
        return df.withColumns(
            {
                "revenue": (money * (1 - F.col("l_discount").cast("decimal(6,4)"))).cast("decimal(20,6)"),
                "quantity": F.col("l_quantity").cast("decimal(18,4)"),
                "ship_month": F.date_format("l_shipdate", "yyyyMM"),
                "is_returned": F.col("l_returnflag") == "R",
            }
        )
    if name == "orders" and {"o_totalprice", "o_orderdate"} <= set(df.columns):
        return df.withColumns(
            {
                "total_price": F.col("o_totalprice").cast("decimal(18,4)"),
                "order_month": F.date_format("o_orderdate", "yyyyMM").cast("int"),
            }
        )
    return df


def register_views(spark: SparkSession, directory: str, names: tuple[str, ...] = TPCH_TABLES) -> None:
    """Temporary views over the Parquet tables, for SQL pass-through."""
    for name in names:
        spark.read.parquet(f"{directory}/{name}.parquet").createOrReplaceTempView(name)
