"""Metadata, values, votes, events and evaluation counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import evaluate, metadata as md, observe
from tessella.queries.base import query, table
from tessella.sources import events as ev
from tessella.sources import sinks

FOREIGN = [("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey")]
PRIMARY = {"orders": "o_orderkey", "customer": "c_custkey", "nation": "n_nationkey"}


def columns(spark, sf_dir):
    return md.columns_of(spark, "tpch", {n: table(spark, sf_dir, n) for n in ("orders", "customer", "nation")}, PRIMARY, FOREIGN)


COLUMNS_SQL = """(SELECT * FROM (VALUES
 ('customer','c_custkey','bigint',1,true,false),('customer','c_name','string',2,false,false),('customer','c_nationkey','int',3,false,true),
 ('customer','c_acctbal','double',4,false,false),('customer','c_mktsegment','string',5,false,false),
 ('nation','n_nationkey','int',1,true,false),('nation','n_name','string',2,false,false),('nation','n_regionkey','int',3,false,false),
 ('orders','o_orderkey','bigint',1,true,false),('orders','o_custkey','bigint',2,false,true),('orders','o_orderstatus','string',3,false,false),
 ('orders','o_totalprice','double',4,false,false),('orders','o_orderdate','timestamp_ntz',5,false,false),('orders','o_orderpriority','string',6,false,false))
 t(table_name, column_name, data_type, ordinal, is_primary, is_foreign))"""


@query("meta_columns", f"SELECT table_name, column_name, data_type, CAST(ordinal AS INTEGER) AS ordinal, is_primary, is_foreign FROM {COLUMNS_SQL}")
def meta_columns(spark, sf_dir):
    return columns(spark, sf_dir).select("table_name", "column_name", "data_type", "ordinal", "is_primary", "is_foreign")


@query("meta_draft_dimensions", f"SELECT column_name AS dimension_key, CASE WHEN data_type LIKE '%time%' THEN 'time' WHEN data_type IN ('int','bigint','double') THEN 'number' ELSE 'categorical' END AS kind FROM {COLUMNS_SQL} WHERE NOT is_primary")
def meta_draft_dimensions(spark, sf_dir):
    return md.draft_dimensions(columns(spark, sf_dir)).select("dimension_key", "kind")


@query("meta_draft_metrics", f"SELECT table_name || '_count' AS metric_key, 'count' AS aggregation FROM {COLUMNS_SQL} GROUP BY table_name UNION ALL SELECT table_name || '_' || column_name || '_sum', 'sum' FROM {COLUMNS_SQL} WHERE NOT is_primary AND NOT is_foreign AND data_type IN ('int','bigint','double')")
def meta_draft_metrics(spark, sf_dir):
    return md.draft_metrics(columns(spark, sf_dir)).select("metric_key", "aggregation")


@query("meta_information_plan", f"SELECT table_name, 'Columns of ' || table_name || ':' || chr(10) || string_agg('| ' || column_name || ' | ' || data_type || ' |', chr(10) ORDER BY ordinal) AS document FROM {COLUMNS_SQL} GROUP BY table_name")
def meta_information_plan(spark, sf_dir):
    return md.information_plan(columns(spark, sf_dir)).select("table_name", "document")


@query("meta_key_profile", "SELECT 'n_nationkey' AS unique_column, (SELECT count(*) = 0 FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)) AS customer_included UNION ALL SELECT 'n_name', (SELECT count(*) = 0 FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation))")
def meta_key_profile(spark, sf_dir):
    """Inferred keys: unique columns of nation, and whether customers' nations are all there."""
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    inside = md.included(customer, "c_nationkey", nation, "n_nationkey")
    return spark.createDataFrame([(c, inside) for c in md.unique_columns(nation)], "unique_column string, customer_included boolean")


@query("meta_sample_values", "SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def meta_sample_values(spark, sf_dir):
    return md.sample_values(table(spark, sf_dir, "orders"), "o_orderpriority", 3)


MAPPINGS = [("nation", "usa", "UNITED STATES", True), ("nation", "germany", "GERMANY", True), ("nation", "france", "FRANCE", False), ("segment", "cars", "AUTOMOBILE", True)]
QUESTIONS = [("a", "revenue of germany and usa"), ("b", "orders for cars in FRANCE"), ("c", "nothing"), ("d", "urgent 1-URGENT orders of cars")]


@query(
    "meta_value_candidates",
    """WITH q AS (SELECT * FROM (VALUES ('a','revenue of germany and usa'),('b','orders for cars in FRANCE'),('c','nothing'),('d','urgent 1-URGENT orders of cars')) t(qid, question)),
    m AS (SELECT * FROM (VALUES ('nation','usa','UNITED STATES',1.0),('nation','germany','GERMANY',1.0),('segment','cars','AUTOMOBILE',1.0)) t(dimension_key, nl_term, db_value, score)
          UNION ALL SELECT DISTINCT 'order_priority', o_orderpriority, o_orderpriority, 0.8 FROM orders)
    SELECT qid, dimension_key, db_value, CAST(max(score) AS DOUBLE) AS score FROM q JOIN m ON contains(question, nl_term) OR contains(question, db_value) GROUP BY 1, 2, 3""",
)
def meta_value_candidates(spark, sf_dir):
    mappings = spark.createDataFrame(MAPPINGS, "dimension_key string, nl_term string, db_value string, enabled boolean")
    samples = table(spark, sf_dir, "orders").select(F.lit("order_priority").alias("dimension_key"), F.col("o_orderpriority").alias("value")).distinct()
    return md.value_candidates(spark.createDataFrame(QUESTIONS, "qid string, question string"), mappings, samples).select("qid", "dimension_key", "db_value", "score")


@query("training_union", "SELECT kind, count(*) AS n FROM (SELECT 'documentation' AS kind, text AS content FROM benchmark UNION SELECT 'ddl', name FROM (VALUES ('CREATE TABLE a (x INT)'), ('CREATE TABLE b (y INT)')) t(name) UNION SELECT 'sql', 'SELECT 1') GROUP BY kind")
def training_union(spark, sf_dir):
    """Three kinds of samples in one table, stable ids, invalid ones dropped."""
    docs = table(spark, sf_dir, "benchmark").select(F.lit("documentation").alias("kind"), F.lit(None).cast("string").alias("question"), F.col("text").alias("content"))
    more = spark.createDataFrame(
        [("ddl", None, "CREATE TABLE a (x INT)"), ("ddl", None, "CREATE TABLE b (y INT)"), ("sql", "one?", "SELECT 1"), ("sql", None, "SELECT 2"), ("ddl", None, " ")],
        docs.schema,
    )
    return md.training_rows(docs.unionByName(more)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("upsert_connection", "SELECT n_nationkey AS k, CASE WHEN n_nationkey < 5 THEN 'new' ELSE n_name END AS v FROM nation UNION ALL SELECT 100, 'added'")
def upsert_connection(spark, sf_dir):
    old = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    new = spark.range(5).select(F.col("id").cast("int").alias("k"), F.lit("new").alias("v")).unionByName(spark.createDataFrame([(100, "added")], "k int, v string"))
    return sinks.upsert(old, new, ["k"])


def route_events(spark, sf_dir):
    """The events table as route events: its type is the route, its value decides status and times."""
    e, v = table(spark, sf_dir, "events"), F.col("value")
    return e.select(
        F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type").alias("route"),
        F.when(F.col("event_id") % 7 == 0, "error").when(F.col("event_id") % 11 == 0, "clarification").otherwise("success").alias("status"),
        F.lit("d").alias("dataset_id"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("request_id"),
        F.floor(v).cast("bigint").alias("total_ms"), F.when(F.col("event_id") % 3 != 0, F.floor(v / 2).cast("bigint")).alias("run_sql_ms"),
    )


@query(
    "obs_route_summary",
    """SELECT event_type AS route, count(*) AS total, count(*) FILTER (event_id % 7 <> 0 AND event_id % 11 <> 0) AS success, count(*) FILTER (event_id % 7 = 0) AS error,
    count(*) FILTER (event_id % 7 <> 0 AND event_id % 11 = 0) AS clarification, CAST(trunc(sum(CAST(floor(value) AS BIGINT)) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS avg_total_ms,
    CAST(trunc(sum(CAST(floor(value / 2) AS BIGINT)) FILTER (event_id % 3 <> 0) / CAST(count(*) FILTER (event_id % 3 <> 0) AS DOUBLE)) AS BIGINT) AS avg_run_sql_ms FROM events GROUP BY 1""",
)
def obs_route_summary(spark, sf_dir):
    return observe.route_summary(route_events(spark, sf_dir))


@query("obs_recent", "SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS request_id, event_type AS route FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, request_id DESC LIMIT 10")
def obs_recent(spark, sf_dir):
    return ev.newest_first(route_events(spark, sf_dir), 10, route="purchase").select("request_id", "route")


@query("obs_tasks", "SELECT kind, value, count(*) AS n FROM (SELECT 'status' AS kind, o_orderstatus AS value FROM orders UNION ALL SELECT 'type', o_orderpriority FROM orders UNION ALL SELECT 'total', '' FROM orders) GROUP BY 1, 2")
def obs_tasks(spark, sf_dir):
    tasks = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("type"))
    return observe.task_summary(tasks)


def cases(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select(
        k.cast("string").alias("id"), F.concat(F.lit("L"), (k % 4 + 1).cast("string")).alias("level"), F.col("o_orderpriority").alias("category"),
        F.when(k % 5 == 0, "clarification").when(k % 13 == 0, "error").otherwise("ready").alias("status"), (k % 6 != 0).alias("ok"),
        F.when(k % 2 == 0, k % 10 != 0).alias("ex"), F.col("o_orderstatus").alias("signature"), F.lit(0).alias("run"),
    )


@query(
    "eval_counters",
    """WITH c AS (SELECT 'L' || (o_orderkey % 4 + 1) AS level, o_orderpriority AS category, o_orderkey AS k FROM orders),
    s AS (SELECT 'overall' AS scope, '' AS name, k FROM c UNION ALL SELECT 'level', level, k FROM c UNION ALL SELECT 'category', category, k FROM c)
    SELECT scope, name, count(*) AS total, count(*) FILTER (k % 6 <> 0) AS ok, count(*) FILTER (k % 6 = 0) AS failed, count(*) FILTER (k % 5 <> 0 AND k % 13 <> 0) AS ready,
    count(*) FILTER (k % 5 = 0) AS clarification, count(*) FILTER (k % 5 <> 0 AND k % 13 = 0) AS error, count(*) FILTER (k % 2 = 0) AS ex_total, count(*) FILTER (k % 2 = 0 AND k % 10 <> 0) AS ex_ok FROM s GROUP BY 1, 2""",
)
def eval_counters(spark, sf_dir):
    return evaluate.counters(cases(spark, sf_dir))


@query("eval_consistency", "WITH c AS (SELECT o_custkey, count(DISTINCT o_orderstatus) AS kinds FROM orders GROUP BY 1) SELECT count(*) AS cases, count(*) FILTER (kinds <= 1) AS stable, count(*) FILTER (kinds <= 1) / CAST(count(*) AS DOUBLE) AS stability_rate, max(kinds) AS most_kinds FROM c")
def eval_consistency(spark, sf_dir):
    return evaluate.consistency(table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("id"), F.col("o_orderstatus").alias("signature")))


@query("vote_signature", "WITH v AS (SELECT o_custkey AS qid, o_orderstatus AS signature, count(*) AS votes, min(o_orderkey) AS first FROM orders GROUP BY 1, 2) SELECT qid, signature, votes, first FROM v QUALIFY row_number() OVER (PARTITION BY qid ORDER BY votes DESC, first) = 1")
def vote_signature(spark, sf_dir):
    x = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("qid"), F.col("o_orderstatus").alias("signature"), F.col("o_orderkey").alias("position"))
    return evaluate.vote(x)


@query("eval_bag_difference", "SELECT k, v, 'got' AS side FROM (SELECT c_nationkey % 7 AS k, c_mktsegment AS v FROM customer EXCEPT ALL SELECT c_nationkey % 5, c_mktsegment FROM customer) UNION ALL SELECT k, v, 'golden' FROM (SELECT c_nationkey % 5 AS k, c_mktsegment AS v FROM customer EXCEPT ALL SELECT c_nationkey % 7, c_mktsegment FROM customer)")
def eval_bag_difference(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    side = lambda m: c.select((F.col("c_nationkey") % m).alias("k"), F.col("c_mktsegment").alias("v"))
    return evaluate.bag_difference(side(7), side(5))
