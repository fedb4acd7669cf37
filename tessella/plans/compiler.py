"""A plan as one lazy DataFrame, and the same as Spark SQL text for people to read."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal, InvalidOperation
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.plans.model import Catalog, Dimension, Draft, Filter, Metric, SemanticError
from tessella.plans.planner import Plan, plan_draft

Tables = Callable[[str], DataFrame]

_AGGREGATES = {
    "count": lambda c: F.count(F.lit(1)),  # rows, whatever the field
    "count_distinct": F.countDistinct,
    "sum": F.sum,
    "avg": F.avg,
    "min": F.min,
    "max": F.max,
}
_BARE = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")


@dataclass(frozen=True)
class Compiled:
    """The frame to run and what an audit wants to know about it."""

    plan: Plan
    frame: DataFrame
    sql: str
    parameters: tuple[tuple[str, str, Any], ...]


def quoted(name: str) -> str:
    return name if _BARE.match(name) else "`" + name.replace("`", "``") + "`"


def typed_value(value: Any, kind: T.DataType, what: str) -> Any:
    """``value`` as Python data of the column's type: the literal is converted, never the column."""
    if value is None:
        return None
    try:
        if isinstance(kind, T.BooleanType):
            if isinstance(value, bool):
                return value
            text = str(value).strip().lower()
            if text in ("true", "1", "1.0", "false", "0", "0.0"):
                return text in ("true", "1", "1.0")
            raise ValueError(text)
        if isinstance(value, bool):
            value = int(value)
        if isinstance(kind, T.StringType):
            return str(value)
        if isinstance(kind, T.IntegralType):
            number = Decimal(str(value).strip())
            return int(number) if number == number.to_integral_value() else float(number)
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            return float(value)
        if isinstance(kind, T.DecimalType):
            return Decimal(str(value).strip())
        if isinstance(kind, T.DateType):
            if isinstance(value, (date, datetime)):
                return value
            text = str(value).strip()
            return date.fromisoformat(text) if len(text) == 10 else datetime.fromisoformat(text)
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return value if isinstance(value, (date, datetime)) else datetime.fromisoformat(str(value).strip())
    except (ValueError, InvalidOperation) as error:
        raise SemanticError(f"{what}: {value!r} is not a value of type {kind.simpleString()}") from error
    return value


def literal(value: Any, kind: T.DataType, what: str) -> Column:
    value = typed_value(value, kind, what)
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, T.TimestampNTZType) or isinstance(kind, T.DateType) and isinstance(value, datetime):
        return F.lit(str(value)).cast("timestamp_ntz")
    if isinstance(value, float) and isinstance(kind, T.IntegralType) or isinstance(value, int) and isinstance(kind, T.IntegralType) and abs(value) >= 2**31:
        return F.lit(value)
    return F.lit(value) if isinstance(kind, T.DateType) else F.lit(value).cast(kind)


def predicate(column: Column, kind: T.DataType, f: Filter) -> Column:
    what = f"filter on {f.dimension_key}"
    if f.operator == "in":
        return column.isin([literal(v, kind, what) for v in f.value])
    if f.operator == "between":
        low, high = (literal(v, kind, what) for v in f.value)
        return (column >= low) & (column <= high)
    value = literal(f.value, kind, what)
    return {"eq": column == value, "gte": column >= value, "lte": column <= value}[f.operator]


class Compiler:
    """Compiles drafts over the tables that ``tables`` gives by physical name."""

    def __init__(self, catalog: Catalog, tables: Tables, strict_operators: bool = False):
        self.catalog, self.tables, self.strict_operators = catalog, tables, strict_operators

    def compile(self, draft: Draft) -> Compiled:
        plan = plan_draft(self.catalog, draft, self.strict_operators)
        frames = {k: self.tables(self.catalog.table(k).physical_table) for k in plan.aliases}
        aliases = plan.aliases

        def kind(table_key: str, field: str) -> T.DataType:
            for f in frames[table_key].schema.fields:
                if f.name.lower() == field.lower():
                    return f.dataType
            raise SemanticError(f"table {table_key} has no column {field}")

        def column(table_key: str, field: str) -> Column:
            kind(table_key, field)
            return F.col(f"{aliases[table_key]}.`{field.replace('`', '``')}`")

        frame = frames[plan.anchor].alias(aliases[plan.anchor])
        for e in plan.joins:
            other = frames[e.target].alias(aliases[e.target])
            frame = frame.join(other, column(e.source, e.source_field) == column(e.target, e.target_field), e.join_type)
        conditions = []
        if plan.time_range:
            d = plan.time_dimension
            for op, bound in (("gte", plan.time_range.start), ("lte", plan.time_range.end)):
                conditions.append(predicate(column(d.table_key, d.field), kind(d.table_key, d.field), Filter(d.key, op, bound)))
        conditions += [predicate(column(d.table_key, d.field), kind(d.table_key, d.field), f) for d, f in plan.filters]
        conditions += [column(d.table_key, d.field).isNotNull() for d in plan.groups]
        for c in conditions:
            frame = frame.where(c)
        values = [
            _AGGREGATES[m.aggregation](column(m.table_key, m.field) if m.aggregation != "count" else None).alias(plan.metric_name(m))
            for m in plan.metrics
        ]
        if plan.groups:
            frame = frame.groupBy(*[column(d.table_key, d.field).alias(d.key) for d in plan.groups]).agg(*values)
        else:
            frame = frame.agg(*values)
        order = [F.col(f"`{d.key}`").asc() for d in plan.groups]
        if draft.order_by_metric:
            first = F.col(f"`{plan.metric_name(plan.metrics[0])}`")
            order.insert(0, first.desc() if draft.order_by_metric.lower() == "desc" else first.asc())
        if order and (plan.groups or draft.order_by_metric):
            frame = frame.orderBy(*order)
        if draft.limit is not None:
            frame = frame.limit(int(draft.limit))
        return Compiled(plan, frame, render_sql(plan), audit(plan))


def audit(plan: Plan) -> tuple[tuple[str, str, Any], ...]:
    out = []
    if plan.time_range:
        out += [(plan.time_dimension.key, "gte", plan.time_range.start), (plan.time_dimension.key, "lte", plan.time_range.end)]
    return (*out, *((d.key, f.operator, f.value) for d, f in plan.filters))


def sql_literal(value: Any) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float, Decimal)):
        return str(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def render_sql(plan: Plan) -> str:
    """Spark SQL text of the plan (for audit and display; the frame itself is built from columns)."""
    catalog, aliases = plan.catalog, plan.aliases
    several = len(aliases) > 1

    def column(table_key: str, field: str) -> str:
        return (f"{aliases[table_key]}." if several else "") + quoted(field)

    def value(d: Dimension, f: Filter) -> str:
        c = column(d.table_key, d.field)
        if f.operator == "in":
            return f"{c} IN ({', '.join(map(sql_literal, f.value))})"
        if f.operator == "between":
            return f"{c} BETWEEN {sql_literal(f.value[0])} AND {sql_literal(f.value[1])}"
        return f"{c} {dict(eq='=', gte='>=', lte='<=')[f.operator]} {sql_literal(f.value)}"

    def aggregate(m: Metric) -> str:
        c = column(m.table_key, m.field)
        body = {"count": "COUNT(*)", "count_distinct": f"COUNT(DISTINCT {c})"}.get(m.aggregation, f"{m.aggregation.upper()}({c})")
        return f"{body} AS {quoted(plan.metric_name(m))}"

    select = [f"{column(d.table_key, d.field)} AS {quoted(d.key)}" for d in plan.groups] + [aggregate(m) for m in plan.metrics]
    lines = [f"SELECT {', '.join(select)}", f"FROM {quoted(catalog.table(plan.anchor).physical_table)}" + (f" AS {aliases[plan.anchor]}" if several else "")]
    for e in plan.joins:
        lines.append(
            f"{e.join_type.upper()} JOIN {quoted(catalog.table(e.target).physical_table)} AS {aliases[e.target]} "
            f"ON {column(e.source, e.source_field)} = {column(e.target, e.target_field)}"
        )
    where = []
    if plan.time_range:
        d = plan.time_dimension
        where += [value(d, Filter(d.key, "gte", plan.time_range.start)), value(d, Filter(d.key, "lte", plan.time_range.end))]
    where += [value(d, f) for d, f in plan.filters]
    where += [f"{column(d.table_key, d.field)} IS NOT NULL" for d in plan.groups]
    if where:
        lines.append("WHERE " + " AND ".join(where))
    groups = [column(d.table_key, d.field) for d in plan.groups]
    if groups:
        lines.append("GROUP BY " + ", ".join(groups))
    order = list(groups)
    if plan.draft.order_by_metric:
        order.insert(0, f"{quoted(plan.metric_name(plan.metrics[0]))} {plan.draft.order_by_metric.upper()}")
    if order:
        lines.append("ORDER BY " + ", ".join(order))
    if plan.draft.limit is not None:
        lines.append(f"LIMIT {plan.draft.limit}")
    return "\n".join(lines)
