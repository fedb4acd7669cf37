"""The semantic model (what can be asked) and the query draft (what is asked)."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any, get_type_hints


class SemanticError(ValueError):
    """A catalog or draft that cannot be honoured; the message says why."""


@dataclass(frozen=True)
class Table:
    key: str
    label: str
    physical_table: str
    description: str | None = None
    default_time_dimension_key: str | None = None


@dataclass(frozen=True)
class Entity:
    key: str
    table_key: str
    field: str
    entity_type: str


@dataclass(frozen=True)
class Relationship:
    left_entity_key: str
    right_entity_key: str
    join_type: str = "left"
    allowed: bool = True


@dataclass(frozen=True)
class Dimension:
    key: str
    label: str
    table_key: str
    field: str
    kind: str = "categorical"
    operators: tuple[str, ...] = ()
    time_format: str | None = None


@dataclass(frozen=True)
class Metric:
    key: str
    label: str
    table_key: str
    field: str
    aggregation: str
    supported_dimension_keys: tuple[str, ...] = ()
    default_time_dimension_key: str | None = None
    allowed_version_keys: tuple[str, ...] = ()


@dataclass(frozen=True)
class Filter:
    dimension_key: str
    operator: str
    value: Any


@dataclass(frozen=True)
class MetricVersion:
    key: str
    label: str
    metric_key: str
    filters: tuple[Filter, ...] = ()


@dataclass(frozen=True)
class Alias:
    alias: str
    target_type: str
    key: str


@dataclass(frozen=True)
class TimeRange:
    dimension_key: str
    start: str
    end: str


@dataclass(frozen=True)
class Catalog:
    catalog_version: str
    dataset_id: str
    tables: tuple[Table, ...]
    entities: tuple[Entity, ...] = ()
    relationships: tuple[Relationship, ...] = ()
    metrics: tuple[Metric, ...] = ()
    dimensions: tuple[Dimension, ...] = ()
    metric_versions: tuple[MetricVersion, ...] = ()
    aliases: tuple[Alias, ...] = ()

    def __post_init__(self) -> None:
        for name in ("tables", "entities", "metrics", "dimensions", "metric_versions"):
            # of equal keys the last one counts
            object.__setattr__(self, f"_{name}", {x.key: x for x in getattr(self, name)})
        self._validate()

    def table(self, key: str) -> Table | None:
        return self._tables.get(key)

    def entity(self, key: str) -> Entity | None:
        return self._entities.get(key)

    def metric(self, key: str) -> Metric | None:
        return self._metrics.get(key)

    def dimension(self, key: str) -> Dimension | None:
        return self._dimensions.get(key)

    def version(self, key: str) -> MetricVersion | None:
        return self._metric_versions.get(key)

    def _validate(self) -> None:
        def need(found: bool, message: str) -> None:
            if not found:
                raise SemanticError(message)

        need(bool(self.tables), "the catalog has no tables")
        for e in self.entities:
            need(e.table_key in self._tables, f"entity {e.key}: unknown table {e.table_key}")
            need(e.entity_type in ("primary", "foreign"), f"entity {e.key}: entity_type must be primary or foreign")
        for r in self.relationships:
            ends = [self.entity(k) for k in (r.left_entity_key, r.right_entity_key)]
            need(ends[0] is not None, f"relationship: unknown left entity {r.left_entity_key}")
            need(ends[1] is not None, f"relationship: unknown right entity {r.right_entity_key}")
            need(r.left_entity_key != r.right_entity_key, f"relationship: {r.left_entity_key} with itself")
            need(ends[0].table_key != ends[1].table_key, f"relationship: both ends on table {ends[0].table_key}")
            need(r.join_type.lower() in ("left", "inner"), f"relationship: join_type {r.join_type} is not left or inner")
        for m in self.metrics:
            need(m.table_key in self._tables, f"metric {m.key}: unknown table {m.table_key}")
            if m.default_time_dimension_key:
                self._time_dimension(m.default_time_dimension_key, f"metric {m.key}")
            for d in m.supported_dimension_keys:
                need(d in self._dimensions, f"metric {m.key}: unknown dimension {d}")
            for v in m.allowed_version_keys:
                need(v in self._metric_versions, f"metric {m.key}: unknown version {v}")
                need(self._metric_versions[v].metric_key == m.key, f"metric {m.key}: version {v} belongs to another metric")
        for d in self.dimensions:
            need(d.table_key in self._tables, f"dimension {d.key}: unknown table {d.table_key}")
        for t in self.tables:
            if t.default_time_dimension_key:
                d = self._time_dimension(t.default_time_dimension_key, f"table {t.key}")
                need(d.table_key == t.key, f"table {t.key}: its time dimension is on table {d.table_key}")
        for v in self.metric_versions:
            need(v.metric_key in self._metrics, f"version {v.key}: unknown metric {v.metric_key}")
            for f in v.filters:
                need(f.dimension_key in self._dimensions, f"version {v.key}: unknown dimension {f.dimension_key}")
        targets = {"metric": self._metrics, "dimension": self._dimensions, "metric_version": self._metric_versions}
        for a in self.aliases:
            need(a.target_type in targets, f"alias {a.alias}: unsupported target_type {a.target_type}")
            need(a.key in targets[a.target_type], f"alias {a.alias}: unknown {a.target_type} {a.key}")

    def _time_dimension(self, key: str, owner: str) -> Dimension:
        d = self.dimension(key)
        if d is None:
            raise SemanticError(f"{owner}: unknown time dimension {key}")
        if d.kind != "time":
            raise SemanticError(f"{owner}: dimension {key} is not of kind time")
        return d


MAX_LIMIT = 1000


@dataclass
class Draft:
    """A structured question; ``metric_keys`` always holds ``metric_key``."""

    metric_key: str = ""
    metric_keys: list[str] = field(default_factory=list)
    analysis_type: str = "summary"
    group_by_dimension_keys: list[str] = field(default_factory=list)
    filters: list[Filter] = field(default_factory=list)
    time_range: TimeRange | None = None
    metric_version_key: str | None = None
    order_by_metric: str | None = None
    limit: int | None = None
    needs_clarification: bool = False
    clarification_question: str | None = None

    def __post_init__(self) -> None:
        self.metric_keys = list(self.metric_keys)
        if not self.metric_key and self.metric_keys:
            self.metric_key = self.metric_keys[0]
        if self.metric_key and self.metric_key not in self.metric_keys:
            self.metric_keys.insert(0, self.metric_key)
        if self.order_by_metric is not None and str(self.order_by_metric).lower() not in ("asc", "desc"):
            raise SemanticError(f"order_by_metric must be asc or desc, not {self.order_by_metric}")
        if self.limit is not None and not 1 <= int(self.limit) <= MAX_LIMIT:
            raise SemanticError(f"limit must be 1 to {MAX_LIMIT}, not {self.limit}")


def _load(kind: type, data: Any) -> Any:
    if not is_dataclass(kind) or not isinstance(data, dict):
        return data
    hints = get_type_hints(kind)
    parts = {
        "tables": Table, "entities": Entity, "relationships": Relationship, "metrics": Metric,
        "dimensions": Dimension, "metric_versions": MetricVersion, "aliases": Alias, "filters": Filter, "time_range": TimeRange,
    }
    values = {}
    for f in fields(kind):
        if f.name not in data:
            continue
        value = data[f.name]
        if f.name in parts and isinstance(value, list):
            value = [_load(parts[f.name], x) for x in value]
        elif f.name in parts and isinstance(value, dict):
            value = _load(parts[f.name], value)
        if isinstance(value, list) and str(hints[f.name]).startswith("tuple"):
            value = tuple(value)
        values[f.name] = value
    try:
        return kind(**values)
    except TypeError as error:
        raise SemanticError(f"{kind.__name__}: {error}") from error


def catalog_from(data: dict) -> Catalog:
    return _load(Catalog, data)


def draft_from(data: dict) -> Draft:
    return _load(Draft, data)


def ordered_distinct(values: Iterable[str]) -> list[str]:
    return list(dict.fromkeys(values))
