"""Read-only SQL, streams and ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.plans import guard
from tessella.queries.base import query, table
from tessella.sources import retail
from tessella.sources.tables import register_views, shared_path
from tessella.streaming import events as streams

SQL = {
    "pt_window": "SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer",
    "pt_rollup": "SELECT n_regionkey, n_name, COUNT(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_name)",
    "pt_grouping_sets": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    "pt_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier",
    "pt_except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey AS k FROM supplier",
    "pt_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier",
    "pt_cte": "WITH big AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) >= 5) SELECT c_mktsegment, COUNT(*) AS n FROM big JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
    "pt_semi_anti": "SELECT COUNT(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "pt_case_like": "SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS size_class, COUNT(*) AS n FROM part WHERE p_name LIKE '%a%' OR p_brand IS NULL GROUP BY 1",
    "pt_scalar_subquery": "SELECT COUNT(*) AS n FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders)",
}


def _run(sql: str):
    def run(spark, sf_dir):
        register_views(spark, sf_dir)
        return guard.run_sql(spark, sql)

    return run


for _name, _sql in SQL.items():
    query(_name, _sql)(_run(_sql))


@query("str_event_window", "SELECT date_trunc('day', ts) AS window_start, event_type, COUNT(*) AS n, CAST(SUM(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS total FROM events GROUP BY 1, 2")
def str_event_window(spark, sf_dir):
    """Daily counts by a stream that reads all there is and stops."""
    path = f"{sf_dir}/events.parquet"
    # a stream reads folders and globs, so a table of one file is named by a glob
    source = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")
    folder = shared_path(spark, "events")
    return streams.run_once(spark, streams.windowed_counts(source), f"events_{folder[-32:]}", folder)


@query("evt_batch_window", "SELECT date_trunc('day', ts) AS window_start, event_type, COUNT(*) AS n, CAST(SUM(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS total FROM events GROUP BY 1, 2")
def evt_batch_window(spark, sf_dir):
    return streams.windowed_counts(table(spark, sf_dir, "events"))


@query(
    "evt_sessions",
    "WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS b FROM events), "
    "g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM s) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM g GROUP BY user_id, g",
)
def evt_sessions(spark, sf_dir):
    return streams.session_counts(table(spark, sf_dir, "events"))


RAW = [
    ("536365", "85123A", " WHITE HOLDER ", "6", "12/1/2010 8:26", "2.55", "17850.0", "United Kingdom"),
    ("C536379", "D", "Discount", "-1", "2010-12-01 09:41:00", "27.5", "14527", "United Kingdom"),
    ("536366", "22633", None, "6.0", "2010-12-01T08:28:00", "1.85", "", "France"),
    ("536367", "84879", "BIRD", "x", "12/1/2010 8:34", "1.69", "13047", "Germany"),
    ("536368", "22960", "JAM", "6", "yesterday", "4.25", "13047", "Germany"),
    (" ", "22912", "NO NUMBER", "3", "12/1/2010 8:34", "4.95", "13047", "Germany"),
    ("536369", "21756", "BATH", "3", "2011/2/3 8:35", "5.95", "13047", "EIRE"),
    ("536370", "21754", "HOME", "3", "2011-02-03", "n/a", "13047", "EIRE"),
]


@query(
    "ing_normalise_rows",
    """SELECT * FROM (VALUES
    ('536365', '85123A', 'WHITE HOLDER', 6, '2010-12-01T08:26:00', '2010-12-01', '2010-12', 2.55::DOUBLE, '17850', 'United Kingdom', 15.3::DOUBLE, 0),
    ('C536379', 'D', 'Discount', -1, '2010-12-01T09:41:00', '2010-12-01', '2010-12', 27.5, '14527', 'United Kingdom', -27.5, 1),
    ('536366', '22633', '', 6, '2010-12-01T08:28:00', '2010-12-01', '2010-12', 1.85, NULL, 'France', 11.1, 0),
    ('536369', '21756', 'BATH', 3, '2011-02-03T08:35:00', '2011-02-03', '2011-02', 5.95, '13047', 'EIRE', 17.85, 0))
    t(invoice_no, stock_code, description, quantity, invoice_datetime, invoice_date, invoice_month, unit_price, customer_id, country, revenue, is_cancellation)""",
)
def ing_normalise_rows(spark, sf_dir):
    return retail.normalised(spark.createDataFrame(RAW, ", ".join(f"{c} string" for c in retail.RAW)))[0]


@query("ing_bad_rows", "SELECT * FROM (VALUES ('536367', 'quantity'), ('536368', 'date'), (' ', 'no invoice number'), ('536370', 'unit price')) t(InvoiceNo, reason)")
def ing_bad_rows(spark, sf_dir):
    return retail.normalised(spark.createDataFrame(RAW, ", ".join(f"{c} string" for c in retail.RAW)))[1].select("InvoiceNo", "reason")


@query("evt_json_props", "SELECT event_type, CAST(SUM(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1")
def evt_json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("total"))
