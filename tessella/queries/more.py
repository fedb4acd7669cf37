"""Pieces of the library that the other queries do not show: text, dates, drafts, sinks, scores, the metadata store."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tessella.functions import dates, extract
from tessella.functions import text as tx
from tessella.operators import chunks, evaluate
from tessella.operators import metadata as md
from tessella.operators import retrieval as rt
from tessella.operators.collection import Collections
from tessella.operators.store import MetadataStore
from tessella.plans import guard, repair
from tessella.queries.base import query, table
from tessella.queries.metadata import COLUMNS_SQL, FOREIGN, PRIMARY
from tessella.sources import sinks
from tessella.sources.tables import register_views, shared_path, written


@query("txt_mostly_cjk", "SELECT doc_id, CASE WHEN length(text) = 0 THEN false ELSE len(regexp_extract_all(text, '[一-鿿]')) / CAST(length(text) AS DOUBLE) > 0.3 END AS cjk FROM documents")
def txt_mostly_cjk(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.mostly_cjk(F.col("text")).alias("cjk"))


@query("txt_synonyms", "SELECT p_partkey, CASE WHEN replace(replace(p_name, 'widget', 'gadget'), 'PROMO', 'OFFER') = p_name THEN p_name ELSE p_name || '|' || replace(replace(p_name, 'widget', 'gadget'), 'PROMO', 'OFFER') END AS forms FROM (SELECT p_partkey, trim(p_name || ' ' || p_type) AS p_name FROM part)")
def txt_synonyms(spark, sf_dir):
    forms = tx.expand_synonyms_column(F.concat_ws(" ", "p_name", "p_type"), {"PROMO": "OFFER", "widget": "gadget"})
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(forms, "|").alias("forms"))


@query("txt_item_name", "SELECT event_id, 'x' || coalesce(json_extract_string(props, '$.k'), '') AS name FROM events")
def txt_item_name(spark, sf_dir):
    """The name of a JSON item; brackets round it go."""
    named = F.regexp_replace("props", r'"k":\s*"?([0-9a-z]*)"?', '"k": "【$1】"')
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("x"), tx.item_name(named, ("name", "k"))).alias("name"))


@query("txt_same_tokens", "SELECT doc_id, array_to_string(list_sort(list_filter(list_value('and', 'in', 'of', 'the', 'to'), lambda w: list_contains(regexp_extract_all(lower(text), '[a-z0-9_]+|[一-鿿]'), w))), ' ') AS same FROM documents")
def txt_same_tokens(spark, sf_dir):
    asked = tx.mixed_tokens(F.lit("the of and in to"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tx.same_tokens(tx.mixed_tokens(F.col("text")), asked), " ").alias("same"))


@query("txt_fields_json", "SELECT n_nationkey, n_name AS a, CAST(n_regionkey AS VARCHAR) AS b FROM nation")
def txt_fields_json(spark, sf_dir):
    made = table(spark, sf_dir, "nation").select("n_nationkey", tx.chosen_fields_json(["n_name", "n_regionkey"]).alias("j"))
    return made.select("n_nationkey", F.get_json_object("j", "$.n_name").alias("a"), F.get_json_object("j", "$.n_regionkey").alias("b"))


@query("txt_token_estimate", "SELECT doc_id, length(text) / CAST(4 AS DOUBLE) AS tokens, md5(text || 'salt')[1:8] AS short FROM documents")
def txt_token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"), tx.md5_short(F.col("text"), 8, "salt").alias("short"))


REPLIES = [
    (1, "Here:\n```sql\nSELECT 1;\n```", "SELECT 1;"),
    (2, "first SELECT a FROM t; then SELECT b FROM t;", "SELECT b FROM t;"),
    (3, "no statement", "no statement"),
    (4, "```sql\nselect 2\n```", "select 2"),
]


@query("txt_statement", "SELECT * FROM (VALUES (1, 'SELECT 1;'), (2, 'SELECT b FROM t;'), (3, 'no statement'), (4, 'select 2')) t(id, sql)")
def txt_statement(spark, sf_dir):
    return spark.createDataFrame([(i, r) for i, r, _ in REPLIES], "id int, reply string").select("id", extract.statement(F.col("reply")).alias("sql"))


TODAY = date(2024, 5, 15)
PERIODS = ["sales this year", "orders this month", "last 7 days", "last quarter", "本年销售", "近30天", "上季度", "nothing"]


@query(
    "dt_periods",
    """SELECT * FROM (VALUES ('sales this year', '2024-01-01', '2024-12-31'), ('orders this month', '2024-05-01', '2024-05-31'),
    ('last 7 days', '2024-05-09', '2024-05-15'), ('last quarter', '2024-01-01', '2024-03-31'), ('本年销售', '2024-01-01', '2024-12-31'),
    ('近30天', '2024-04-16', '2024-05-15'), ('上季度', '2024-01-01', '2024-03-31'), ('nothing', NULL, NULL)) t(question, first, last)""",
)
def dt_periods(spark, sf_dir):
    rows = [(q, *(d.isoformat() for d in found)) if (found := dates.period(q, TODAY)) else (q, None, None) for q in PERIODS]
    return spark.createDataFrame(rows, "question string, first string, last string")


@query(
    "dt_moments",
    "SELECT event_id, strftime(CAST(ts AS TIMESTAMP) - INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%SZ') AS utc, strftime(CAST(ts AS TIMESTAMP) + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS local, "
    "strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS day, strftime(date_trunc('day', ts) + INTERVAL 86399 SECOND, '%Y-%m-%d %H:%M:%S') AS day_end FROM events",
)
def dt_moments(spark, sf_dir):
    ts, show = F.col("ts"), lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return table(spark, sf_dir, "events").select(
        "event_id", dates.to_utc_text(ts).alias("utc"), dates.to_local_text(ts).alias("local"), show(dates.day_start(ts)).alias("day"), show(dates.day_end(ts)).alias("day_end")
    )


@query("dt_coerced", "SELECT * FROM (VALUES ('0', '1970-01-01 00:00:00'), ('1700000000', '2023-11-14 22:13:20'), ('1700000000000', '2023-11-14 22:13:20'), ('2024-05-01T10:00:00Z', '2024-05-01 10:00:00'), ('soon', NULL)) t(given, moment)")
def dt_coerced(spark, sf_dir):
    given = spark.createDataFrame([(x,) for x in ("0", "1700000000", "1700000000000", "2024-05-01T10:00:00Z", "soon")], "given string")
    return given.select("given", F.date_format(dates.moment_of(F.col("given")), "yyyy-MM-dd HH:mm:ss").alias("moment"))


RANKED = ["top 5 nations", "销量最高的3个国家", "倒数十名", "后 2 名", "前十二", "lowest 4", "bottom", "20个最低", "nations"]


@query("sem_ranks", "SELECT * FROM (VALUES ('top 5 nations', 5, 'desc'), ('销量最高的3个国家', NULL, 'desc'), ('倒数十名', 10, 'asc'), ('后 2 名', 2, 'asc'), ('前十二', 12, 'desc'), ('lowest 4', 4, 'asc'), ('bottom', NULL, 'asc'), ('20个最低', 20, 'asc'), ('nations', NULL, NULL)) t(question, n, direction)")
def sem_ranks(spark, sf_dir):
    return spark.createDataFrame([(q, repair.rank_limit(q), repair.rank_direction(q)) for q in RANKED], "question string, n int, direction string")


@query("sem_operators", "SELECT * FROM (VALUES ('=', 'eq'), ('==', 'eq'), ('>', 'gte'), ('>=', 'gte'), ('<', 'lte'), ('<=', 'lte'), ('IN', 'in'), ('between', 'between')) t(given, operator)")
def sem_operators(spark, sf_dir):
    return spark.createDataFrame([(x, repair.normal_operator(x)) for x in ("=", "==", ">", ">=", "<", "<=", "IN", "between")], "given string, operator string")


@query("snk_json_records", "SELECT count(*) AS n, sum(r_regionkey) AS keys, string_agg(r_name, ',' ORDER BY r_regionkey) AS names FROM region")
def snk_json_records(spark, sf_dir):
    records = sinks.json_records(table(spark, sf_dir, "region"))
    back = records.select(F.from_json("record", "r_regionkey int, r_name string").alias("r")).select("r.*")
    names = F.transform(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name"))), lambda x: x["r_name"])
    return back.agg(F.count(F.lit(1)).alias("n"), F.sum("r_regionkey").alias("keys"), F.array_join(names, ",").alias("names"))


@query("snk_chart_choice", "SELECT * FROM (VALUES ('one number', 'bar'), ('two numbers', 'scatter'), ('few names', 'pie'), ('many names', 'line')) t(shape, kind)")
def snk_chart_choice(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    shapes = {"one number": nation.select("n_name", "n_regionkey"), "two numbers": nation.select("n_nationkey", "n_regionkey"), "few names": table(spark, sf_dir, "region").select("r_name"), "many names": nation.select("n_name")}
    return spark.createDataFrame([(k, sinks.chart_choice(df)["kind"]) for k, df in shapes.items()], "shape string, kind string")


@query("snk_delete_rows", "SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def snk_delete_rows(spark, sf_dir):
    gone = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    return sinks.delete_rows(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), gone, ["s_nationkey"]).select("s_suppkey")


@query("grd_verdicts", "SELECT * FROM (VALUES ('SELECT 1', true), ('DROP TABLE nation', false), ('SELECT 1; SELECT 2', false), ('WITH a AS (SELECT 1) SELECT * FROM a', true), ('INSERT INTO nation SELECT * FROM nation', false)) t(sql, ok)")
def grd_verdicts(spark, sf_dir):
    given = ["SELECT 1", "DROP TABLE nation", "SELECT 1; SELECT 2", "WITH a AS (SELECT 1) SELECT * FROM a", "INSERT INTO nation SELECT * FROM nation"]
    return spark.createDataFrame([(x, guard.is_read_only(spark, x)) for x in given], "sql string, ok boolean")


@query("grd_run_all", "SELECT r_name FROM region")
def grd_run_all(spark, sf_dir):
    """Several statements: all are checked first, and the last one with rows is the result."""
    register_views(spark, sf_dir, ("region", "nation"))
    return guard.run_all(spark, ["SELECT n_name FROM nation", "SELECT r_name FROM region", "SELECT r_name FROM region WHERE r_regionkey < 0"])


@query("ret_best_of_variants", "SELECT CAST(l_suppkey % 7 AS VARCHAR) AS qid, l_partkey AS doc_id, max(l_quantity) AS score FROM lineitem GROUP BY 1, 2")
def ret_best_of_variants(spark, sf_dir):
    hits = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 7).cast("string").alias("qid"), F.col("l_partkey").alias("doc_id"), F.col("l_quantity").alias("score"))
    return rt.best_of_variants(hits)


@query("ret_max_pooled", "SELECT CAST(turn % 2 AS VARCHAR) AS qid, conv_id AS parent_id, CAST(max(length(text)) AS DOUBLE) AS score FROM conversations GROUP BY 1, 2")
def ret_max_pooled(spark, sf_dir):
    """A conversation scores as its best turn."""
    turns = table(spark, sf_dir, "conversations").select((F.col("turn") % 2).cast("string").alias("qid"), F.col("conv_id").alias("parent_id"), F.length("text").cast("double").alias("score"))
    return chunks.max_pooled(turns)


@query("meta_operators", f"SELECT column_name AS dimension_key, CASE WHEN data_type LIKE '%time%' THEN 'between,gte,lte' WHEN data_type IN ('int','bigint','double') THEN 'eq,in,gte,lte,between' ELSE 'eq,in' END AS operators FROM {COLUMNS_SQL} WHERE NOT is_primary")
def meta_operators(spark, sf_dir):
    columns = md.columns_of(spark, "tpch", {n: table(spark, sf_dir, n) for n in ("orders", "customer", "nation")}, PRIMARY, FOREIGN)
    return md.draft_dimensions(columns).select("dimension_key", "operators")


@query("meta_sync", f"SELECT table_name, column_name, CAST(ordinal AS INTEGER) AS ordinal, is_foreign, 'success' AS status, CAST(14 AS BIGINT) AS synced FROM {COLUMNS_SQL}")
def meta_sync(spark, sf_dir):
    """A sync of three tables into a store, its job, and the listing of columns."""
    store = MetadataStore(spark, shared_path(spark, "store"))
    store.sync("tpch", lambda: {n: table(spark, sf_dir, n) for n in ("orders", "customer", "nation")}, PRIMARY, FOREIGN)
    job = store.jobs("tpch").select("dataset_id", "status", F.col("column_count").alias("synced"))
    return written(store.listed("column", "tpch").join(job, "dataset_id").select("table_name", "column_name", "ordinal", "is_foreign", "status", "synced"), "sync")


@query("meta_physical_mappings", "SELECT * FROM (VALUES ('nation', 'usa', 'UNITED STATES')) t(dimension_key, nl_term, db_value)")
def meta_physical_mappings(spark, sf_dir):
    """Mapped values find their dimension by physical table and column."""
    mappings = spark.createDataFrame([("nation", "n_name", "usa", "UNITED STATES"), ("nation", "n_comment", "x", "y"), ("region", "n_name", "eu", "EUROPE")], "table_name string, column_name string, nl_term string, db_value string")
    dimensions = spark.createDataFrame([("nation", "t_nation", "n_name"), ("segment", "t_customer", "c_mktsegment")], "dimension_key string, table_key string, field string")
    tables = spark.createDataFrame([("t_nation", "nation"), ("t_customer", "customer")], "table_key string, physical_table string")
    return md.physical_mappings(mappings, dimensions, tables).select("dimension_key", "nl_term", "db_value")


def lengths(texts: list[str]) -> list[list[float]]:
    """A stand-in for an embedding service: length and number of vowels."""
    return [[float(len(t)), float(sum(c in "AEIOUaeiou" for c in t))] for t in texts]


@query("col_page", "SELECT CAST(p_partkey AS VARCHAR) || '-0' AS chunk_id, p_name AS preview, p_brand AS brand FROM part ORDER BY 1 LIMIT 10 OFFSET 10")
def col_page(spark, sf_dir):
    """Parts vectorised by name with their brand as metadata; the second page."""
    store = Collections(spark, shared_path(spark, "collections"), lengths)
    store.add("parts", table(spark, sf_dir, "part"), "p_partkey", ["p_name"], ["p_brand"])
    return written(store.page("parts", 2, 10).select("chunk_id", "preview", F.col("meta")["p_brand"].alias("brand")), "page")


@query(
    "col_listed",
    "SELECT 'nations' AS collection, count(*) - 5 AS documents, count(*) - 5 AS chunks, CAST(sum(length(n_name)) FILTER (n_nationkey >= 5) AS DOUBLE) AS lengths FROM nation "
    "UNION ALL SELECT 'regions', count(*), count(*), CAST(sum(length(r_name)) AS DOUBLE) FROM region",
)
def col_listed(spark, sf_dir):
    """Two collections after an addition, a repeated addition and a removal."""
    store, nation = Collections(spark, shared_path(spark, "collections"), lengths), table(spark, sf_dir, "nation")
    store.add("nations", nation, "n_nationkey", ["n_name"])
    store.add("nations", nation.where("n_nationkey < 9"), "n_nationkey", ["n_name"])
    store.remove("nations", nation.where("n_nationkey < 5").select(F.col("n_nationkey").cast("string").alias("parent_id")))
    store.add("regions", table(spark, sf_dir, "region"), "r_regionkey", ["r_name"])
    sums = store.rows().groupBy("collection").agg(F.sum(F.col("embedding")[0]).alias("lengths"))
    return written(store.listed().join(sums, "collection"), "listed")


@query("col_whole", "SELECT CAST(n_nationkey AS VARCHAR) AS qid, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region, 'x' AS extra FROM nation")
def col_whole(spark, sf_dir):
    """Results with whole texts; metadata goes into JSON texts where it adds a key."""
    store = Collections(spark, shared_path(spark, "collections"), lengths)
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey", F.lit("x").alias("extra"))
    store.add("nations", rows, "n_nationkey", ["n_name", "n_regionkey"], ["extra"])
    results = rows.select(F.col("n_nationkey").cast("string").alias("qid"), F.concat("n_nationkey", F.lit("-0")).alias("doc_id"))
    found = store.whole("nations", results)
    at = lambda k: F.get_json_object("text", f"$.{k}")
    return written(found.select("qid", at("n_name").alias("name"), at("n_regionkey").alias("region"), at("extra").alias("extra")), "whole")


@query("txt_model_name", "SELECT * FROM (VALUES ('My  Model_v1!', 'my-model-v1'), ('plain_name_', 'plain_name'), ('A--B', 'a-b'), ('-x y-', 'x-y')) t(given, name)")
def txt_model_name(spark, sf_dir):
    given = spark.createDataFrame([("My  Model_v1!",), ("plain_name_",), ("A--B",), ("-x y-",)], "given string")
    return given.select("given", tx.model_name(F.col("given")).alias("name"))


@query("txt_base64", "SELECT n_nationkey, n_name AS decoded FROM nation")
def txt_base64(spark, sf_dir):
    half = F.when(F.col("n_nationkey") % 2 == 0, F.base64(F.col("n_name").cast("binary"))).otherwise(F.concat("n_name", F.lit("")))
    return table(spark, sf_dir, "nation").select("n_nationkey", tx.decoded(half).alias("decoded"))


@query("eval_top_sample", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def eval_top_sample(spark, sf_dir):
    return evaluate.top_sample(table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")), "n", 20)


@query("hist_filtered", "SELECT count(*) AS n FROM part WHERE p_size > 1 AND contains(lower(p_name), 'widget') AND (contains(lower(p_name), 'cold') OR contains(lower(p_name), 'small'))")
def hist_filtered(spark, sf_dir):
    """Statements of a history that name a database and one of two schemas."""
    history = table(spark, sf_dir, "part").select(F.col("p_name").alias("query_text"), F.col("p_size").alias("rows_produced"))
    return evaluate.history_sample(history, ["WIDGET"], ["cold", "Small"], k=1 << 30).agg(F.count(F.lit(1)).alias("n"))
