from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import types as T

from tessella.plans.catalog import list_catalogs, load_catalog, summarize
from tessella.plans.compiler import Compiler, quoted, render_sql, sql_literal, typed_value
from tessella.plans.model import Draft, Filter, SemanticError, TimeRange, catalog_from, draft_from
from tessella.plans.planner import join_edges, plan_draft


def tables(**more):
    return {
        "catalog_version": "1",
        "dataset_id": "shop",
        "tables": [{"key": k, "label": k, "physical_table": k} for k in ("sales", "customers", "cities")],
        "entities": [
            {"key": "sale_customer", "table_key": "sales", "field": "customer id", "entity_type": "foreign"},
            {"key": "customer", "table_key": "customers", "field": "id", "entity_type": "primary"},
            {"key": "customer_city", "table_key": "customers", "field": "city_id", "entity_type": "foreign"},
            {"key": "city", "table_key": "cities", "field": "id", "entity_type": "primary"},
        ],
        "relationships": [
            {"left_entity_key": "sale_customer", "right_entity_key": "customer"},
            {"left_entity_key": "customer_city", "right_entity_key": "city"},
        ],
        "metrics": [
            {"key": "amount", "label": "amount", "table_key": "sales", "field": "Sales Amount", "aggregation": "sum"},
            {"key": "sale_count", "label": "sale count", "table_key": "sales", "field": "id", "aggregation": "count"},
            {"key": "customer_count", "label": "customer count", "table_key": "customers", "field": "id", "aggregation": "count"},
        ],
        "dimensions": [
            {"key": "city", "label": "city", "table_key": "cities", "field": "name"},
            {"key": "level", "label": "level", "table_key": "customers", "field": "level", "operators": ["eq"]},
            {"key": "day", "label": "day", "table_key": "sales", "field": "day", "kind": "time"},
            {"key": "paid", "label": "paid", "table_key": "sales", "field": "paid"},
        ],
        "metric_versions": [{"key": "paid_only", "label": "paid only", "metric_key": "amount", "filters": [{"dimension_key": "paid", "operator": "eq", "value": True}]}],
        "aliases": [{"alias": "turnover", "target_type": "metric", "key": "amount"}],
    } | more


@pytest.fixture(scope="module")
def shop(spark):
    frames = {
        "sales": spark.createDataFrame(
            [(1, 1, 10.0, "2024-01-01", True), (2, 1, 5.0, "2024-01-31 23:00:00", False), (3, 2, 7.0, "2024-02-01", True), (4, None, 1.0, "2024-01-02", True), (5, 99, 2.0, "2024-01-03", None)],
            ["id", "customer id", "Sales Amount", "day", "paid"],
        ),
        "customers": spark.createDataFrame([(1, 1, "gold"), (2, 2, "silver"), (3, None, None)], ["id", "city_id", "level"]),
        "cities": spark.createDataFrame([(1, "Aachen"), (2, "Bonn")], ["id", "name"]),
    }
    return Compiler(catalog_from(tables()), frames.__getitem__)


def rows(shop, **draft):
    return [tuple(r) for r in shop.compile(Draft(**draft)).frame.collect()]


def test_groups_exclude_null_and_dangling_keys(shop):
    assert rows(shop, metric_key="amount", group_by_dimension_keys=["city"]) == [("Aachen", 15.0), ("Bonn", 7.0)]
    assert rows(shop, metric_key="amount") == [(25.0,)]
    assert rows(shop, metric_key="sale_count", filters=[Filter("city", "eq", "Bonn")]) == [(1,)]


def test_ranking_ties_versions_and_several_metrics(shop):
    assert rows(shop, metric_keys=["amount", "sale_count"], group_by_dimension_keys=["level"], order_by_metric="asc") == [("silver", 7.0, 1), ("gold", 15.0, 2)]
    assert rows(shop, metric_key="amount", metric_version_key="paid_only") == [(18.0,)]
    assert rows(shop, metric_key="amount", group_by_dimension_keys=["city"], order_by_metric="desc", limit=1) == [("Aachen", 15.0)]
    assert rows(shop, metric_key="amount", filters=[Filter("paid", "eq", None)]) == [(None,)]


def test_text_days_compare_as_text(shop):
    january = TimeRange("day", "2024-01-01", "2024-01-31")
    assert rows(shop, metric_key="sale_count", time_range=january) == [(3,)]


def test_sql_text_and_audit(shop):
    done = shop.compile(Draft(metric_key="amount", group_by_dimension_keys=["city"], filters=[Filter("level", "in", ["gold", "it's"]), Filter("city", "eq", "Aachen")], limit=3))
    assert "t0.`Sales Amount`" in done.sql and "LEFT JOIN customers AS t1 ON t0.`customer id` = t1.id" in done.sql and done.sql.endswith("LIMIT 3")
    assert [p[0] for p in done.parameters] == ["city", "level"]
    assert render_sql(done.plan) == done.sql and quoted("a`b") == "`a``b`" and sql_literal("it's") == "'it\\'s'"


def test_rendered_sql_gives_the_same_rows(spark, shop):
    for name in ("sales", "customers", "cities"):
        shop.tables(name).createOrReplaceTempView(name)
    for draft in (Draft(metric_key="amount", group_by_dimension_keys=["city"], order_by_metric="desc"), Draft(metric_key="sale_count", filters=[Filter("level", "in", ["gold", "silver"])])):
        done = shop.compile(draft)
        assert done.frame.collect() == spark.sql(done.sql).collect()


@pytest.mark.parametrize(
    ("draft", "message"),
    [
        (dict(metric_key="nothing"), "not defined"),
        (dict(), "names no metric"),
        (dict(metric_keys=["amount", "customer_count"]), "different tables"),
        (dict(metric_keys=["amount", "sale_count"], metric_version_key="paid_only"), "cannot share"),
        (dict(metric_key="customer_count", group_by_dimension_keys=["day"]), "fan-out"),
        (dict(metric_key="sale_count", metric_version_key="paid_only"), "belongs to metric"),
        (dict(metric_key="amount", filters=[Filter("city", "like", "x")]), "not supported"),
        (dict(metric_key="amount", filters=[Filter("city", "in", [])]), "not empty"),
        (dict(metric_key="amount", filters=[Filter("city", "between", [1])]), "two values"),
        (dict(metric_key="amount", group_by_dimension_keys=["nowhere"]), "not defined"),
    ],
)
def test_drafts_that_cannot_be_honoured(shop, draft, message):
    with pytest.raises(SemanticError, match=message):
        shop.compile(Draft(**draft))


def test_strict_operators_and_undeclared_paths():
    catalog = catalog_from(tables())
    with pytest.raises(SemanticError, match="does not allow"):
        plan_draft(catalog, Draft(metric_key="amount", filters=[Filter("level", "in", ["a"])]), strict_operators=True)
    lonely = catalog_from(tables(relationships=[{"left_entity_key": "sale_customer", "right_entity_key": "customer", "allowed": False}]))
    assert join_edges(lonely) == ([], [])
    with pytest.raises(SemanticError, match="no declared relationship"):
        plan_draft(lonely, Draft(metric_key="amount", group_by_dimension_keys=["level"]))


@pytest.mark.parametrize(
    "change",
    [
        dict(tables=[]),
        dict(entities=[{"key": "e", "table_key": "nowhere", "field": "x", "entity_type": "primary"}], relationships=[]),
        dict(relationships=[{"left_entity_key": "customer", "right_entity_key": "customer"}]),
        dict(relationships=[{"left_entity_key": "sale_customer", "right_entity_key": "customer", "join_type": "cross"}]),
        dict(aliases=[{"alias": "x", "target_type": "metric", "key": "nothing"}]),
        dict(aliases=[{"alias": "x", "target_type": "table", "key": "sales"}]),
        dict(metric_versions=[{"key": "v", "label": "v", "metric_key": "nothing"}]),
        dict(dimensions=[{"key": "city", "label": "c", "table_key": "nowhere", "field": "f"}], metric_versions=[]),
    ],
)
def test_catalogs_that_do_not_hold_together(change):
    with pytest.raises(SemanticError):
        catalog_from(tables(**change))


def test_drafts_and_shipped_catalogs():
    d = draft_from({"metric_keys": ["a", "b"], "filters": [{"dimension_key": "x", "operator": "eq", "value": 1}]})
    assert d.metric_key == "a" and d.filters == [Filter("x", "eq", 1)]
    for bad in (dict(limit=0), dict(limit=1001), dict(order_by_metric="up")):
        with pytest.raises(SemanticError):
            Draft(**bad)
    assert "tpch" in list_catalogs() and summarize(load_catalog("tpch"))


def test_values_take_the_type_of_their_column():
    assert typed_value("12", T.LongType(), "x") == 12 and typed_value("1.5", T.LongType(), "x") == 1.5
    assert typed_value(1, T.BooleanType(), "x") is True and typed_value(True, T.IntegerType(), "x") == 1
    assert typed_value("2.50", T.DecimalType(9, 2), "x") == Decimal("2.50")
    assert typed_value("2024-01-31", T.DateType(), "x") == date(2024, 1, 31)
    assert typed_value("2024-01-31T23:59:59", T.TimestampNTZType(), "x") == datetime(2024, 1, 31, 23, 59, 59)
    assert typed_value(None, T.LongType(), "x") is None
    with pytest.raises(SemanticError):
        typed_value("twelve", T.LongType(), "x")


def test_filters_reach_the_scan(spark):
    from tessella.sources.tables import parquet_tables

    done = Compiler(load_catalog("tpch"), parquet_tables(spark, "/root/testdata/sf0.001")).compile(
        Draft(metric_key="order_count", filters=[Filter("order_priority", "eq", "1-URGENT")])
    )
    plan = done.frame._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderpriority,1-URGENT)" in plan and "o_totalprice" not in plan.split("ReadSchema")[1][:80]
