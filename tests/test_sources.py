from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessella.operators import observe
from tessella.sources import connectors, events, retail, sinks, tables
from tessella.streaming import events as streaming

CSV = """InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country
536365,85123A, CREAM HANGER ,6,12/1/2010 8:26,2.55,17850.0,United Kingdom
C536379,D,Discount,-1,2010-12-01 09:41:00,27.5,14527,United Kingdom
536380,22961,JAM \u20ac5,2.0,2010-12-01,1.45,,France
536381,1,bad quantity,many,12/1/2010 8:26,1,1,France
536382,1,bad date,1,yesterday,1,1,France
,1,no number,1,12/1/2010 8:26,1,1,France
536383,2,Caf\xe9,1,2010/12/3 9:05,x,1,France
"""


def test_retail_lines(spark, tmp_path):
    path = tmp_path / "lines.csv"
    path.write_bytes(CSV.encode("cp1252"))
    good, bad = retail.normalised(retail.read_csv(spark, str(path)))
    rows = {r["invoice_no"]: r for r in good.collect()}
    assert set(rows) == {"536365", "C536379", "536380"} and len(good.columns) == 12
    a = rows["536365"]
    assert (a["description"], a["quantity"], a["invoice_datetime"], a["invoice_month"], a["customer_id"], a["revenue"], a["is_cancellation"]) == ("CREAM HANGER", 6, "2010-12-01T08:26:00", "2010-12", "17850", 15.3, 0)
    assert rows["536380"]["description"] == "JAM \u20ac5"
    assert rows["C536379"]["is_cancellation"] == 1 and rows["536380"]["customer_id"] is None and rows["536380"]["invoice_date"] == "2010-12-01"
    assert sorted(r["reason"] for r in bad.collect()) == ["date", "no invoice number", "quantity", "unit price"]


def test_connectors():
    o = connectors.jdbc_options("mysql", sql="select 1", host="h", database="d", user="u", password="p")
    assert o["url"] == "jdbc:mysql://h:3306/d" and o["query"] == "select 1" and o["connectTimeout"] == "10000" and o["user"] == "u"
    assert connectors.jdbc_options("oracle", sql="select 1;", host="h", database="d")["query"] == "select 1"
    assert "USE ROLE r" in connectors.jdbc_options("snowflake", table="t", host="h", database="d", role="r")["sessionInitStatement"]
    for bad in (dict(name="nothing", sql="x"), dict(name="mysql", sql="x", table="y"), dict(name="mysql", sql="x", host="h")):
        with pytest.raises(ValueError):
            connectors.jdbc_options(**bad)
    assert connectors.configured({"SQLITE_DB_PATH": "/x"}) == ("sqlite", {"path": "/x"}) and connectors.configured({}) is None
    full = {f"MYSQL_{k}": k for k in ("HOST", "PORT", "USER", "PASSWORD", "DATABASE")}
    assert connectors.configured(full)[0] == "mysql"


def test_a_missing_driver_is_said(spark):
    with pytest.raises(connectors.DependencyError, match="sqlite-jdbc"):
        connectors.read_jdbc(spark, "sqlite", sql="select 1", path="/nowhere")


def route_events(spark):
    rows = [(datetime(2024, 1, d, h), "ask", s, "tpch", f"r{d}{h}", ms, None if s == "error" else ms // 2) for d, h, s, ms in ((1, 1, "success", 10), (1, 2, "error", 21), (2, 3, "clarification", 30))]
    return spark.createDataFrame(rows, "timestamp timestamp, route string, status string, dataset_id string, request_id string, total_ms bigint, run_sql_ms bigint")


def test_events_are_appended_read_and_streamed(spark, tmp_path):
    path = str(tmp_path / "events")
    sinks.append_events(route_events(spark), path)
    back = events.read_events(spark, path)
    assert [r["request_id"] for r in events.newest_first(back, 2).collect()] == ["r23", "r12"]
    assert events.newest_first(back, 5, route="other").count() == 0
    r = observe.route_summary(back).first()
    assert (r["total"], r["success"], r["error"], r["clarification"], r["avg_total_ms"], r["avg_run_sql_ms"]) == (3, 1, 1, 1, 20, 10)
    stream = observe.route_summary(events.stream_events(spark, path))
    got = streaming.run_once(spark, stream, "route_stream", str(tmp_path / "state"))
    assert got.collect() == observe.route_summary(back).collect()
    rolled = streaming.run_once(spark, streaming.rolling_summary(events.stream_events(spark, path)), "rolled", str(tmp_path / "state2"))
    assert rolled.count() == 3
    with pytest.raises(ValueError):
        events.newest_first(back, 0)


def test_windows_of_a_stream_equal_those_of_a_table(spark):
    path = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{path}/events.parquet")
    import tempfile

    stream = spark.readStream.schema(table.schema).parquet(f"{path}/events.parquet*")
    got = streaming.run_once(spark, streaming.windowed_counts(stream), "windows", tempfile.mkdtemp())
    assert sorted(map(str, got.collect())) == sorted(map(str, streaming.windowed_counts(table).collect()))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.5, None), (2, "b", 2.5, "ü")], "id int, name string, x double, note string")
    assert [r[0] for r in sinks.json_records(df).orderBy("record").collect()][0] == '{"id":1,"name":"a","x":1.5,"note":null}'
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2
    assert sinks.chart_choice(df)["kind"] == "scatter" and sinks.chart_choice(df.select("name", "x")) == {"kind": "bar", "x": "name", "y": "x"}
    assert sinks.chart_choice(df.select("name")) == {"kind": "pie", "names": "name"} and sinks.should_chart(df) and not sinks.should_chart(df.select("name"))
    new = spark.createDataFrame([(2, "c", 0.0, None), (3, "d", 1.0, None)], df.schema)
    assert sorted((r["id"], r["name"]) for r in sinks.upsert(df, new, ["id"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert [r["id"] for r in sinks.delete_rows(df, new, ["id"]).collect()] == [1]
    path = str(tmp_path / "parts")
    sinks.replace_rows(df.withColumn("dataset", F.lit("p")).unionByName(df.withColumn("dataset", F.lit("q"))), path, "dataset")
    sinks.replace_rows(new.withColumn("dataset", F.lit("p")), path, "dataset")
    assert sorted((r["dataset"], r["id"]) for r in spark.read.parquet(path).collect()) == [("p", 2), ("p", 3), ("q", 1), ("q", 2)]
    assert sinks.write_draft_catalog({"dataset_id": "x"}, str(tmp_path / "drafts")).endswith("x.json")


def test_views_and_derived_columns(spark):
    tables.register_views(spark, "/root/testdata/sf0.001", ("orders",))
    assert dict(tables.view_tables(spark)("orders").dtypes)["order_month"] == "int"
