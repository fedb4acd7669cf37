"""Read-only Spark SQL: a statement is parsed, never run, until it is known to be one SELECT.

Spark's own parser gives the unresolved plan.  Every node of it, subqueries included, must be of a kind that only
reads; commands and inserts hide under query roots otherwise.  Functions that reach into the JVM are refused by name.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

# Fixed list: kinds of plan nodes that read only.
READ_NODES = frozenset(
    """Project Filter Aggregate Join Sort GlobalLimit LocalLimit Offset Tail Union Intersect Except Distinct Deduplicate
    SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedWith CTERelationDef CTERelationRef WithCTE
    UnresolvedRelation UnresolvedInlineTable UnresolvedTableValuedFunction UnresolvedHaving OneRowRelation
    WithWindowDefinition Window Generate Pivot UnresolvedPivot Unpivot LateralJoin LocalRelation Range Sample
    GroupingSets Expand UnresolvedHint ResolvedHint UnresolvedTVFAliases UnresolvedOrdinal View NamedParametersQuery
    UnresolvedSubqueryPlan RepartitionByExpression Repartition""".split()
)
BANNED_FUNCTIONS = frozenset({"reflect", "java_method", "try_reflect", "read_files", "input_file_block_start"})


class GuardError(ValueError):
    """The text is not one read-only query."""


def _nodes(plan) -> Iterable[str]:
    """Class names of all nodes of a JVM plan, those inside expressions included."""
    stack = [plan]
    while stack:
        node = stack.pop()
        yield node.getClass().getSimpleName()
        for kind in (node.children(), node.innerChildren(), node.subqueries()):
            it = kind.iterator()
            while it.hasNext():
                stack.append(it.next())


def parsed(spark: SparkSession, sql: str):
    try:
        return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException as error:
        raise GuardError(f"not one statement that can be parsed: {str(error).splitlines()[0]}") from error


def check(spark: SparkSession, sql: str) -> str:
    """``sql`` without its last semicolon if it is one read-only query; GuardError otherwise."""
    text = sql.strip()
    if not text:
        raise GuardError("empty statement")
    bare = re.sub(r"^(\s|\(|--[^\n]*\n|/\*.*?\*/)*", "", text, flags=re.S)
    if not re.match(r"(select|with)\b", bare, flags=re.I):
        raise GuardError("only SELECT and WITH are allowed")
    plan = parsed(spark, text)
    for name in _nodes(plan):
        if name.rstrip("$") not in READ_NODES:
            raise GuardError(f"{name} is not allowed in a read-only query")
    tree = plan.toString()
    for name in BANNED_FUNCTIONS:
        if re.search(rf"(?<![\w.]){name}\s*\(", text, flags=re.I) or f"'{name}(" in tree.lower():
            raise GuardError(f"function {name} is not allowed")
    return text.rstrip().rstrip(";")


def is_read_only(spark: SparkSession, sql: str) -> bool:
    try:
        check(spark, sql)
    except GuardError:
        return False
    return True


def run_sql(spark: SparkSession, sql: str) -> DataFrame:
    return spark.sql(check(spark, sql))


def dry_run(spark: SparkSession, sql: str) -> str:
    """The analysed plan's schema as text; raises if a table or column does not exist, and runs nothing."""
    return run_sql(spark, sql).schema.simpleString()


def run_all(spark: SparkSession, statements: list[str]) -> DataFrame | None:
    """All statements are checked before any runs; the last result with rows, or the last one."""
    checked = [check(spark, s) for s in statements]
    last = None
    for sql in checked:
        frame = spark.sql(sql)
        if last is None or not frame.isEmpty():
            last = frame
    return last
