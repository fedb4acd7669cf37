"""Which tables a draft needs and how declared keys join them.

Only edges from a foreign to a primary key are followed: they keep the number of rows, so a metric is never counted
twice.  This knowledge is not in the tables, which is why it is applied before Catalyst sees a plan.
"""

from __future__ import annotations

import json
from collections import deque
from dataclasses import dataclass

from tessella.plans.model import Catalog, Dimension, Draft, Filter, Metric, SemanticError, TimeRange, ordered_distinct

AGGREGATIONS = ("count", "count_distinct", "sum", "avg", "min", "max")
OPERATORS = ("eq", "in", "gte", "lte", "between")


@dataclass(frozen=True)
class Edge:
    source: str
    target: str
    source_field: str
    target_field: str
    join_type: str


@dataclass(frozen=True)
class Plan:
    catalog: Catalog
    draft: Draft
    metrics: tuple[Metric, ...]
    anchor: str
    joins: tuple[Edge, ...]
    time_range: TimeRange | None
    time_dimension: Dimension | None
    filters: tuple[tuple[Dimension, Filter], ...]
    groups: tuple[Dimension, ...]

    @property
    def aliases(self) -> dict[str, str]:
        """Table key -> t0, t1, ... in the order of joining."""
        return {k: f"t{i}" for i, k in enumerate([self.anchor, *(e.target for e in self.joins)])}

    def metric_name(self, metric: Metric) -> str:
        return metric.key if len(self.metrics) > 1 else "metric_value"


def join_edges(catalog: Catalog) -> tuple[list[Edge], list[Edge]]:
    """Edges that keep rows (foreign to primary), and their reverses, which may multiply them."""
    keep, multiply = [], []
    for r in catalog.relationships:
        left, right = catalog.entity(r.left_entity_key), catalog.entity(r.right_entity_key)
        if not r.allowed or {left.entity_type, right.entity_type} != {"foreign", "primary"}:
            continue
        fk, pk = (left, right) if left.entity_type == "foreign" else (right, left)
        keep.append(Edge(fk.table_key, pk.table_key, fk.field, pk.field, r.join_type.lower()))
        multiply.append(Edge(pk.table_key, fk.table_key, pk.field, fk.field, r.join_type.lower()))
    return keep, multiply


def paths_from(start: str, edges: list[Edge]) -> dict[str, list[Edge]]:
    """Shortest path to every reachable table; of equally short ones the first by the order of ``edges``."""
    found: dict[str, list[Edge]] = {start: []}
    queue = deque([start])
    while queue:
        here = queue.popleft()
        for e in edges:
            if e.source == here and e.target not in found:
                found[e.target] = [*found[here], e]
                queue.append(e.target)
    return found


def plan_joins(catalog: Catalog, anchor: str, targets: set[str]) -> list[Edge]:
    keep, multiply = join_edges(catalog)
    paths = paths_from(anchor, keep)
    anywhere = paths_from(anchor, keep + multiply)
    joins: list[Edge] = []
    for target in sorted(targets - {anchor}):
        if target not in paths:
            if target in anywhere:
                raise SemanticError(f"fan-out: {target} can only be reached from {anchor} by multiplying its rows")
            raise SemanticError(f"no declared relationship leads from {anchor} to {target}")
        joins += [e for e in paths[target] if e not in joins]
    return joins


def filter_order(f: Filter) -> str:
    return json.dumps([f.dimension_key, f.operator, f.value], ensure_ascii=False, sort_keys=True, default=str)


def check_filter(f: Filter) -> None:
    if f.operator not in OPERATORS:
        raise SemanticError(f"filter operator {f.operator} is not supported")
    if f.operator == "in" and not (isinstance(f.value, (list, tuple)) and f.value):
        raise SemanticError(f"filter on {f.dimension_key}: in needs a list that is not empty")
    if f.operator == "between" and not (isinstance(f.value, (list, tuple)) and len(f.value) == 2):
        raise SemanticError(f"filter on {f.dimension_key}: between needs two values")


def plan_draft(catalog: Catalog, draft: Draft, strict_operators: bool = False) -> Plan:
    """All checks, in a fixed order, then the joins."""
    keys = ordered_distinct(draft.metric_keys)
    metrics = [catalog.metric(k) for k in keys]
    for key, metric in zip(keys, metrics):
        if metric is None:
            raise SemanticError(f"metric {key} is not defined")
    if not metrics:
        raise SemanticError("the draft names no metric")
    if len(metrics) > 1 and draft.metric_version_key:
        raise SemanticError("several metrics cannot share a metric version")
    if len({m.table_key for m in metrics}) > 1:
        raise SemanticError("metrics of different tables cannot be asked together")

    first = metrics[0]
    time_dimension = None
    if first.default_time_dimension_key and draft.time_range is None:
        raise SemanticError(f"metric {first.key} needs a time range")
    if draft.time_range is not None:
        time_dimension = catalog.dimension(draft.time_range.dimension_key)
        if time_dimension is None:
            raise SemanticError(f"time dimension {draft.time_range.dimension_key} is not defined")
    if catalog.table(first.table_key) is None:
        raise SemanticError(f"table {first.table_key} is not defined")

    filters = list(draft.filters)
    if draft.metric_version_key:
        version = catalog.version(draft.metric_version_key)
        if version is None:
            raise SemanticError(f"metric version {draft.metric_version_key} is not defined")
        if version.metric_key != first.key:
            raise SemanticError(f"metric version {version.key} belongs to metric {version.metric_key}")
        if first.allowed_version_keys and version.key not in first.allowed_version_keys:
            raise SemanticError(f"metric {first.key} does not allow version {version.key}")
        filters = [*version.filters, *filters]
    filters.sort(key=filter_order)
    resolved = []
    for f in filters:
        dimension = catalog.dimension(f.dimension_key)
        if dimension is None:
            raise SemanticError(f"filter dimension {f.dimension_key} is not defined")
        resolved.append((dimension, f))

    groups = []
    for key in draft.group_by_dimension_keys:
        dimension = catalog.dimension(key)
        if dimension is None:
            raise SemanticError(f"group dimension {key} is not defined")
        for m in metrics:
            if m.supported_dimension_keys and key not in m.supported_dimension_keys:
                raise SemanticError(f"metric {m.key} does not support dimension {key}")
        groups.append(dimension)

    needed = {d.table_key for d, _ in resolved} | {d.table_key for d in groups}
    if time_dimension is not None:
        needed.add(time_dimension.table_key)
    joins = plan_joins(catalog, first.table_key, needed)
    for dimension, f in resolved:
        check_filter(f)
        if strict_operators and dimension.operators and f.operator not in dimension.operators:
            raise SemanticError(f"dimension {dimension.key} does not allow operator {f.operator}")
    for m in metrics:
        if m.aggregation not in AGGREGATIONS:
            raise SemanticError(f"aggregation {m.aggregation} is not supported")
    if draft.order_by_metric is not None and draft.order_by_metric.lower() not in ("asc", "desc"):
        raise SemanticError(f"order {draft.order_by_metric} is not asc or desc")
    return Plan(catalog, draft, tuple(metrics), first.table_key, tuple(joins), draft.time_range, time_dimension, tuple(resolved), tuple(groups))
