import pytest

from tessella.plans import guard

GOOD = ["select 1", "WITH a AS (SELECT 1 AS x) SELECT * FROM a;", "-- why\nselect x from values (1), (2) t(x) where x in (select 1)", "(select 1) union all (select 2)", "select sum(x) over (order by x) from values (1) t(x)"]
BAD = [
    "", "drop table x", "insert into t select 1", "select 1; select 2", "create table t as select 1", "with a as (select 1) insert into t select * from a", "show tables",
    "set x = 1", "select reflect('java.lang.System', 'exit', 1)", "select java_method('java.lang.Math', 'abs', -1)", "explain select 1", "selec 1",
]


@pytest.mark.parametrize("sql", GOOD)
def test_reads_pass(spark, sql):
    assert guard.is_read_only(spark, sql) and guard.run_sql(spark, sql).count() >= 1


@pytest.mark.parametrize("sql", BAD)
def test_all_else_is_refused(spark, sql):
    with pytest.raises(guard.GuardError):
        guard.check(spark, sql)


def test_dry_run_and_several_statements(spark):
    assert guard.dry_run(spark, "select 1 as x") == "struct<x:int>"
    assert guard.run_all(spark, ["select 1 as x", "select 2 as x where false"]).collect()[0]["x"] == 1
    with pytest.raises(guard.GuardError):
        guard.run_all(spark, ["select 1", "drop table x"])
