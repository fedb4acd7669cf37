"""Governed drafts over the test catalog."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tessella.engine import Engine
from tessella.plans.catalog import load_catalog
from tessella.plans.compiler import Compiler
from tessella.plans.model import Draft, Filter, TimeRange
from tessella.queries.base import plain, query
from tessella.sources.tables import parquet_tables


def ask(spark, sf_dir: str, **draft):
    return plain(Compiler(load_catalog("tpch"), parquet_tables(spark, sf_dir)).compile(Draft(**draft)).frame)


def orders_in(start: str, end: str) -> TimeRange:
    return TimeRange("order_date", start, end)


PRICE = "CAST(o_totalprice AS DECIMAL(18,4))"
REVENUE = "CAST(CAST(l_extendedprice AS DECIMAL(18,4)) * (1 - CAST(l_discount AS DECIMAL(6,4))) AS DECIMAL(20,6))"
O96 = "o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1996-12-31'"
CUST = "orders LEFT JOIN customer ON o_custkey = c_custkey"
NATION = f"{CUST} LEFT JOIN nation ON c_nationkey = n_nationkey"
Y96 = dict(time_range=orders_in("1996-01-01", "1996-12-31"))


@query("flagship", f"SELECT n_name AS customer_nation, CAST(SUM({PRICE}) AS DOUBLE) AS metric_value FROM {NATION} WHERE {O96} AND n_name IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 2")
def flagship(spark, sf_dir):
    return ask(spark, sf_dir, metric_key="order_value", group_by_dimension_keys=["customer_nation"], order_by_metric="desc", limit=2, **Y96)


def add(name: str, sql: str, **draft) -> None:
    query(name, sql)(lambda spark, sf_dir: ask(spark, sf_dir, **draft))


# aggregates
add("sem_sum", f"SELECT CAST(SUM({PRICE}) AS DOUBLE) AS metric_value FROM orders WHERE {O96}", metric_key="order_value", **Y96)
add("sem_sum_of_nothing", f"SELECT CAST(SUM({PRICE}) AS DOUBLE) AS metric_value FROM orders WHERE o_orderdate > TIMESTAMP '2100-01-01'", metric_key="order_value", time_range=orders_in("2100-01-01", "2100-12-31"))
add("sem_count", "SELECT COUNT(*) AS metric_value FROM orders", metric_key="order_count")
add("sem_count_distinct", "SELECT COUNT(DISTINCT o_custkey) AS metric_value FROM orders", metric_key="buyer_count")
query("sem_avg", f"SELECT o_orderstatus AS order_status, ROUND(CAST(SUM({PRICE}) AS DOUBLE) / COUNT(*), 4) AS metric_value FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 1")(
    lambda spark, sf_dir: ask(spark, sf_dir, metric_key="average_order", group_by_dimension_keys=["order_status"]).withColumn("metric_value", F.round("metric_value", 4))
)
add("sem_min", "SELECT o_orderpriority AS order_priority, MIN(o_totalprice) AS metric_value FROM orders GROUP BY 1", metric_key="smallest_order", group_by_dimension_keys=["order_priority"])
add("sem_max", "SELECT o_orderpriority AS order_priority, MAX(o_totalprice) AS metric_value FROM orders GROUP BY 1", metric_key="largest_order", group_by_dimension_keys=["order_priority"])
add(
    "sem_multi_metric",
    "SELECT l_returnflag AS return_flag, COUNT(*) AS line_count, CAST(SUM(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS quantity FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1",
    metric_keys=["line_count", "quantity"], group_by_dimension_keys=["return_flag"],
)

# filters
add("flt_eq", "SELECT COUNT(*) AS metric_value FROM orders WHERE o_orderpriority = '1-URGENT'", metric_key="order_count", filters=[Filter("order_priority", "eq", "1-URGENT")])
add("flt_in", "SELECT COUNT(*) AS metric_value FROM lineitem WHERE l_returnflag IN ('A', 'R')", metric_key="line_count", filters=[Filter("return_flag", "in", ["A", "R"])])
add("flt_gte", "SELECT COUNT(*) AS metric_value FROM lineitem WHERE l_quantity >= 40", metric_key="line_count", filters=[Filter("quantity_sold", "gte", "40")])
add("flt_lte", "SELECT COUNT(*) AS metric_value FROM lineitem WHERE l_quantity <= 7.5", metric_key="line_count", filters=[Filter("quantity_sold", "lte", 7.5)])
add("flt_between", "SELECT COUNT(*) AS metric_value FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size BETWEEN 5 AND 10", metric_key="line_count", filters=[Filter("part_size", "between", [5, "10"])])
add("flt_null_never_matches", "SELECT COUNT(*) AS metric_value FROM orders WHERE o_orderstatus = NULL", metric_key="order_count", filters=[Filter("order_status", "eq", None)])
add("flt_boolean", "SELECT COUNT(*) AS metric_value FROM lineitem WHERE l_returnflag = 'R'", metric_key="line_count", filters=[Filter("returned", "eq", 1)])
add("flt_month_key", "SELECT COUNT(*) AS metric_value FROM orders WHERE CAST(strftime(o_orderdate, '%Y%m') AS INTEGER) BETWEEN 199601 AND 199606", metric_key="order_count", filters=[Filter("order_month", "between", ["199601", "199606"])])
add("flt_metric_version", f"SELECT CAST(SUM({REVENUE}) AS DOUBLE) AS metric_value FROM lineitem WHERE l_returnflag IN ('N', 'A') AND l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate <= TIMESTAMP '1996-12-31'", metric_key="revenue", metric_version_key="net_of_returns", time_range=TimeRange("ship_date", "1996-01-01", "1996-12-31"))
add("flt_time_range", f"SELECT o_orderstatus AS order_status, CAST(SUM({PRICE}) AS DOUBLE) AS metric_value FROM orders WHERE o_orderdate >= TIMESTAMP '1997-03-01' AND o_orderdate <= TIMESTAMP '1997-03-31' AND o_orderstatus IS NOT NULL GROUP BY 1", metric_key="order_value", group_by_dimension_keys=["order_status"], time_range=orders_in("1997-03-01", "1997-03-31"))
add("flt_end_of_day", f"SELECT CAST(SUM({PRICE}) AS DOUBLE) AS metric_value FROM orders WHERE o_orderdate >= TIMESTAMP '1997-03-01' AND o_orderdate <= TIMESTAMP '1997-03-31 23:59:59'", metric_key="order_value", time_range=orders_in("1997-03-01", "1997-03-31T23:59:59"))

# joins
add("join_one_hop", f"SELECT c_mktsegment AS market_segment, COUNT(*) AS metric_value FROM {CUST} WHERE c_mktsegment IS NOT NULL GROUP BY 1", metric_key="order_count", group_by_dimension_keys=["market_segment"])
add("join_inner", "SELECT p_brand AS brand, COUNT(*) AS metric_value FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand IS NOT NULL GROUP BY 1", metric_key="line_count", group_by_dimension_keys=["brand"])
add("join_three_hop", f"SELECT r_name AS customer_region, CAST(SUM({PRICE}) AS DOUBLE) AS metric_value FROM {NATION} LEFT JOIN region ON n_regionkey = r_regionkey WHERE {O96} AND r_name IS NOT NULL GROUP BY 1", metric_key="order_value", group_by_dimension_keys=["customer_region"], **Y96)
add(
    "join_role_playing",
    "SELECT cn.n_name AS customer_nation, sn.n_name AS supplier_nation, COUNT(*) AS metric_value FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey "
    "LEFT JOIN nation cn ON c_nationkey = cn.n_nationkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation sn ON s_nationkey = sn.n_nationkey WHERE cn.n_name IS NOT NULL AND sn.n_name IS NOT NULL GROUP BY 1, 2",
    metric_key="line_count", group_by_dimension_keys=["customer_nation", "supplier_nation"],
)
add(
    "join_shared_prefix",
    f"SELECT c_mktsegment AS market_segment, n_name AS customer_nation, COUNT(*) AS metric_value FROM {NATION} LEFT JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND c_mktsegment IS NOT NULL AND n_name IS NOT NULL GROUP BY 1, 2",
    metric_key="order_count", group_by_dimension_keys=["market_segment", "customer_nation"], filters=[Filter("customer_region", "eq", "ASIA")],
)

# groups, trends, ranks
add("grp_single", "SELECT l_linestatus AS line_status, COUNT(*) AS metric_value FROM lineitem WHERE l_linestatus IS NOT NULL GROUP BY 1", metric_key="line_count", group_by_dimension_keys=["line_status"])
add("grp_multi_dim", "SELECT l_returnflag AS return_flag, l_linestatus AS line_status, CAST(SUM(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS metric_value FROM lineitem WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY 1, 2", metric_key="quantity", group_by_dimension_keys=["return_flag", "line_status"])
add("trend_month", f"SELECT strftime(l_shipdate, '%Y%m') AS ship_month, CAST(SUM({REVENUE}) AS DOUBLE) AS metric_value FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate <= TIMESTAMP '1997-12-31' GROUP BY 1", metric_key="revenue", analysis_type="trend", group_by_dimension_keys=["ship_month"], time_range=TimeRange("ship_date", "1996-01-01", "1997-12-31"))
add("top_n_desc", "SELECT p_brand AS brand, CAST(SUM(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS metric_value FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5", metric_key="quantity", group_by_dimension_keys=["brand"], order_by_metric="desc", limit=5)
add("bottom_n_asc", "SELECT p_brand AS brand, CAST(SUM(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS metric_value FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand IS NOT NULL GROUP BY 1 ORDER BY 2 ASC, 1 LIMIT 5", metric_key="quantity", group_by_dimension_keys=["brand"], order_by_metric="asc", limit=5)


@query("grp_null_excluded", "SELECT CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderstatus END AS order_status, COUNT(*) AS metric_value FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1")
def grp_null_excluded(spark, sf_dir):
    """A group key that is null is no group."""
    tables = parquet_tables(spark, sf_dir)

    def holed(name):
        df = tables(name)
        return df.withColumn("o_orderstatus", F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus"))) if name == "orders" else df

    return plain(Compiler(load_catalog("tpch"), holed).compile(Draft(metric_key="order_count", group_by_dimension_keys=["order_status"])).frame)


@query("ask_question", f"SELECT n_name AS customer_nation, CAST(SUM({PRICE}) AS DOUBLE) AS metric_value FROM {NATION} WHERE {O96} AND n_name IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def ask_question(spark, sf_dir):
    """A question in words, through parser, repair and compiler."""
    engine = Engine(spark, "tpch", parquet_tables(spark, sf_dir))
    return plain(engine.ask("top 3 order value by nation in 1996", date(2024, 5, 1)).frame)
