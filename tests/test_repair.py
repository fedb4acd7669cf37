from datetime import date

import pytest

from tessella.engine import Config, Engine
from tessella.functions import dates
from tessella.plans import repair as rp
from tessella.plans.catalog import load_catalog
from tessella.plans.model import Draft, Filter, SemanticError, TimeRange
from tessella.sources.tables import parquet_tables

TODAY = date(2024, 5, 15)


@pytest.fixture(scope="module")
def catalog():
    return load_catalog("tpch")


@pytest.mark.parametrize(
    ("question", "first", "last"),
    [
        ("orders this year", date(2024, 1, 1), date(2024, 12, 31)), ("本月订单", date(2024, 5, 1), date(2024, 5, 31)), ("最近7天", date(2024, 5, 9), TODAY),
        ("last 30 days", date(2024, 4, 16), TODAY), ("上季度", date(2024, 1, 1), date(2024, 3, 31)),
    ],
)
def test_periods(question, first, last):
    assert dates.period(question, TODAY) == (first, last)


def test_quarter_before_the_first_and_years():
    assert dates.period("last quarter", date(2024, 2, 1)) == (date(2023, 10, 1), date(2023, 12, 31))
    assert dates.explicit_year("in 1996年") == 1996 and dates.explicit_year("part 21996") is None and dates.period("orders", TODAY) is None
    assert dates.bounds(date(2024, 1, 1), date(2024, 1, 31), "yyyymm") == ("202401", "202401")
    assert dates.bounds(date(2024, 1, 1), date(2024, 1, 31), "iso_datetime")[1] == "2024-01-31T23:59:59"


def test_ranks_and_numerals():
    assert [rp.number_of(t) for t in ("12", "十", "十二", "二十", "九十九", "两", "x")] == [12, 10, 12, 20, 99, 2, None]
    assert rp.rank_limit("top 5 brands") == 5 and rp.rank_limit("前十名") == 10 and rp.rank_limit("brands") is None
    assert rp.rank_direction("bottom 3") == "asc" and rp.rank_direction("最高的") == "desc" and rp.rank_direction("all") is None


def test_operators():
    assert [rp.normal_operator(o) for o in ("=", "==", ">", ">=", "<", "<=", "IN")] == ["eq", "eq", "gte", "gte", "lte", "lte", "in"]
    with pytest.raises(SemanticError):
        rp.normal_operator("!=")


def test_repair_fills_period_groups_and_rank(catalog):
    d = rp.repair(Draft(metric_key="order_value", analysis_type="group_by"), "top 3 order value by nation in 1996", catalog, TODAY)
    assert d.time_range == TimeRange("order_date", "1996-01-01", "1996-12-31")
    assert d.group_by_dimension_keys == ["customer_nation"] and d.limit == 3 and d.order_by_metric == "desc"


def test_repair_of_values(catalog):
    plugin = (rp.ValueMapping("order_priority", "eq", {"urgent ones": "1-URGENT"}), rp.ValueMapping("order_status", "eq", {"open": "O"}))
    d = rp.repair(Draft(metric_key="order_count", filters=[Filter("market_segment", "eq", "O")]), "how many urgent ones", catalog, TODAY, plugin)
    assert d.filters == [Filter("order_priority", "eq", "1-URGENT")]
    d = rp.repair(Draft(metric_key="order_count", filters=[Filter("part_size", ">", "12")]), "x", catalog, TODAY, values=[rp.ValueCandidate("market_segment", "BUILDING", 0.9, "building")])
    assert d.filters == [Filter("part_size", "gte", 12), Filter("market_segment", "eq", "BUILDING")]


def test_vote_and_few_shot():
    a, b = Draft(metric_key="a"), Draft(metric_key="b")
    assert rp.vote([b, a, Draft(metric_key="a")]) == [a, b] and rp.vote([b, a]) == [b, a]
    examples = [{"question": "orders by nation", "semantic_query": {"metric_key": "a"}}, {"question": "parts", "semantic_query": {}, "dataset_id": "other"}]
    assert rp.few_shot(examples, "orders per nation", "tpch") == examples[:1] and rp.draft_of(examples[0]).metric_key == "a"


def test_engine_asks_clarifies_and_remembers(spark):
    engine = Engine(spark, "tpch", parquet_tables(spark, "/root/testdata/sf0.001"), config=Config(retries=1))
    a = engine.ask("order count by segment", TODAY)
    assert a.status == "ready" and a.frame.columns == ["market_segment", "metric_value"] and engine.history() == [a.request_id]
    b = engine.ask("revenue by nation", TODAY)
    assert b.status == "clarification" and b.options and b.options[0]["target_type"] == "time_range"
    assert engine.ask("what is the weather", TODAY).status == "clarification"
    got = engine.observed().collect()
    assert got[0]["total"] == 3 and got[0]["success"] == 1 and got[0]["clarification"] == 2
    engine.forget(a.request_id)
    with pytest.raises(KeyError):
        engine.answer(a.request_id)
    cases = [{"id": "1", "question": "order count", "expect_metric_key": "order_count", "expected_sql": "select 1500L as metric_value"}, {"id": "2", "question": "revenue", "expect_status": "clarification"}]
    overall = engine.evaluate(cases, TODAY).where("scope = 'overall'").first()
    assert (overall["total"], overall["ok"], overall["ex_total"], overall["ex_ok"]) == (2, 2, 1, 1)
    for bad in (dict(candidates=0), dict(retries=6)):
        with pytest.raises(ValueError):
            Config(**bad)
