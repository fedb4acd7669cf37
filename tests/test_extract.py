from pyspark.sql import functions as F

from tessella.functions import extract


def run(spark, f, *texts):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", f(F.col("t")).alias("x")).orderBy("i").select("x").collect()]


def test_statements(spark):
    got = run(
        spark, extract.statement, "Use SELECT 1; or SELECT\n2; select 3;", "with a as (select 1) select * from a; done", "CREATE TABLE t AS SELECT 1; SELECT 2;",
        "so:\n```sql\nSELECT 1\n```\nend", "```\n x \n```", "no code", None,
    )
    assert got == ["select 3;", "with a as (select 1) select * from a;", "CREATE TABLE t AS SELECT 1;", "SELECT 1", "x", "no code", None]


def test_first_query(spark):
    got = run(spark, extract.first_query, "it is select a\\_b from t; and more", "```sql\nselect 1\n```", "select 1", "nothing", None)
    assert got == ["select a_b from t;", "select 1\n", "select 1", "nothing", None]


def test_python_code(spark):
    assert run(spark, extract.python_code, "x\n```python\nfig = 1\n```", "```\ny\n```", " plain ", None) == ["fig = 1", "y", "plain", None]
