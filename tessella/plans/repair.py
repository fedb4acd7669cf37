"""Drafts put right before they are compiled: periods, groups, ranking, values, operators.

Small data on the driver: a question, a draft and a catalog.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace
from datetime import date
from pathlib import Path
from typing import Any, Protocol

from tessella.functions import dates
from tessella.plans.model import Catalog, Draft, Filter, Metric, SemanticError, TimeRange, draft_from
from tessella.plans.planner import filter_order

# Fixed words that make a metric's name a measure.
ENGLISH_MEASURES = frozenset(
    "count amount total sum avg average mean min max distinct number qty quantity volume rate ratio sales revenue profit".split()
)
CHINESE_MEASURES = ("金额", "总额", "总数", "数量", "销量", "销售额", "笔数", "均值", "平均", "最大", "最小", "占比", "比例", "率")
MEASURE_ENDINGS = ("数", "量", "额", "率")
# Fixed forms in which a question asks for groups; {} is the dimension.
GROUP_FORMS = ("各{}", "每个{}", "按{}", "分{}", "每{}", "和{}", "及{}", "、{}", "{}维度", "{}排名")
ENGLISH_GROUP_FORMS = ("by {}", "per {}", "each {}", "every {}", "for each {}")
# Numerals, words that name an end of a ranking, and units that may follow a number.
NUMERALS = {"零": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
TEN = "十"
MOST_WORDS = ("最高", "最多", "最大", "highest", "most", "largest")
LEAST_WORDS = ("最低", "最少", "最小", "lowest", "least", "smallest")
FRONT_WORDS, BACK_WORDS = ("前", "top"), ("后", "倒数", "bottom")
NEEDS_NUMBER = ("前", "后")
UNITS = "名个条位"
MOST_RANKS = 1000

ROLES = {w: role for role, words in (("most", MOST_WORDS), ("least", LEAST_WORDS), ("front", FRONT_WORDS), ("back", BACK_WORDS)) for w in words}
_MARK = re.compile("|".join([*sorted(ROLES, key=len, reverse=True), "[0-9]+", f"[{''.join(NUMERALS)}{TEN}]+"]))


@dataclass(frozen=True)
class Mark:
    """A number or a word of ranking in a question; ``gap``: the text between it and the mark before."""

    word: str
    role: str
    number: int | None
    gap: str


def number_of(text: str) -> int | None:
    """Digits or a Chinese numeral up to 99."""
    text = text.strip()
    if text.isdecimal():
        return int(text)
    total, ones = 0, None
    for sign in text:
        if sign == TEN and not total:
            total, ones = 10 * (1 if ones is None else ones), None
        elif sign in NUMERALS and ones is None:
            ones = NUMERALS[sign]
        else:
            return None
    return total + (ones or 0) if text else None


def marks(question: str) -> list[Mark]:
    """The numbers and ranking words of a question, in order."""
    low, out, end = question.lower(), [], 0
    for found in _MARK.finditer(low):
        word = found.group()
        role = ROLES.get(word, "number")
        out.append(Mark(word, role, number_of(word) if role == "number" else None, low[end : found.start()]))
        end = found.end()
    return out


def ranks(question: str) -> list[tuple[str, int]]:
    """(role, number) of every ranking word with a number next to it: those before numbers first, ends before extremes."""
    seen = marks(question)
    pairs = list(zip(seen, seen[1:]))
    before = [(a.role, b.number) for a, b in pairs if a.role != "number" and b.number is not None and not b.gap.strip()]
    after = [(b.role, a.number) for a, b in pairs if a.number is not None and b.role in ("most", "least") and not b.gap.strip().strip(UNITS)]
    return sorted(before, key=lambda x: x[0] in ("most", "least")) + after


def rank_limit(question: str) -> int | None:
    return next((n for role, n in ranks(question) if 1 <= n <= MOST_RANKS), None)


def rank_direction(question: str) -> str | None:
    counted = {role for role, _ in ranks(question)}
    roles = {m.role for m in marks(question) if m.word not in NEEDS_NUMBER} | counted
    if roles & {"least", "back"}:
        return "asc"
    return "desc" if roles & {"most", "front"} else None


def measure_term(term: str) -> bool:
    low = term.strip().lower()
    if ENGLISH_MEASURES & set(re.split(r"[^a-z0-9]+", low)):
        return True
    return any(w in low for w in CHINESE_MEASURES) or low.endswith(MEASURE_ENDINGS)


def terms_of(catalog: Catalog, target_type: str) -> dict[str, set[str]]:
    """Key -> its labels and aliases."""
    items = {"metric": catalog.metrics, "dimension": catalog.dimensions, "metric_version": catalog.metric_versions}[target_type]
    out = {i.key: {i.label, i.key} for i in items}
    for a in catalog.aliases:
        if a.target_type == target_type:
            out[a.key].add(a.alias)
    return {k: {t for t in v if t} for k, v in out.items()}


def spans(question: str, term: str) -> list[tuple[int, int]]:
    """All occurrences, overlapping ones too; case aside."""
    low, term = question.lower(), term.lower()
    return [(m.start(), m.start() + len(term)) for m in re.finditer(f"(?={re.escape(term)})", low)] if term else []


def named_metrics(question: str, catalog: Catalog) -> set[str]:
    """Metrics a question names; a name inside a longer name of another metric does not count."""
    places = sorted((start, -end, key) for key, terms in terms_of(catalog, "metric").items() for t in filter(measure_term, terms) for start, end in spans(question, t))
    named: set[str] = set()
    wider: list[tuple[int, int, str]] = []  # what has begun, from left to right and the longest first
    for start, minus_end, key in places:
        end = -minus_end
        if all(other == key or last < end or (first, last) == (start, end) for first, last, other in wider):
            named.add(key)
        wider.append((start, end, key))
    return named


# Signs of comparison by the name of the operator that stands for them; strictness is lost.
SIGNS = {"eq": ("=", "=="), "gte": (">", ">="), "lte": ("<", "<=")}
REFUSED = ("<>", "!=")
_NAMED_SIGNS = {sign: name for name, signs in SIGNS.items() for sign in signs}


def normal_operator(operator: str) -> str:
    """The name of an operator given by name or sign."""
    op = operator.strip().lower()
    sign = "".join(c for c in op if c in "<>=!")
    if sign in REFUSED:
        raise SemanticError(f"operator {operator} is not supported")
    return _NAMED_SIGNS.get(sign, op)


@dataclass(frozen=True)
class ValueMapping:
    dimension_key: str
    operator: str
    terms: dict[str, Any]


def load_plugin(path: str | Path) -> tuple[ValueMapping, ...]:
    data = json.loads(Path(path).read_text(encoding="utf-8"))
    return tuple(ValueMapping(m["dimension_key"], m.get("operator", "eq"), m["terms"]) for m in data.get("value_mappings", []))


@dataclass(frozen=True)
class ValueCandidate:
    dimension_key: str
    db_value: Any
    score: float = 1.0
    term: str = ""


def repair(
    draft: Draft,
    question: str,
    catalog: Catalog,
    today: date,
    plugin: Sequence[ValueMapping] = (),
    values: Iterable[ValueCandidate] = (),
) -> Draft:
    """A new draft; the steps run in a fixed order, as later ones build on earlier ones."""
    d = replace(draft, filters=list(draft.filters), group_by_dimension_keys=list(draft.group_by_dimension_keys), metric_keys=list(draft.metric_keys))
    metric = catalog.metric(d.metric_key)
    asked = named_metrics(question, catalog)
    if len(asked) > 1 and not asked <= set(d.metric_keys):
        d.needs_clarification = True
        d.clarification_question = d.clarification_question or "Which measure is meant: " + ", ".join(sorted(asked)) + "?"
    _period(d, question, catalog, metric, today)
    _month_trend(d, question, catalog, metric)
    _groups(d, question, catalog, metric)
    if d.group_by_dimension_keys:
        d.limit = d.limit if d.limit is not None else rank_limit(question)
        d.order_by_metric = d.order_by_metric or rank_direction(question)
    d.filters = [replace(f, operator=normal_operator(f.operator)) for f in d.filters]
    _plugin_values(d, question, metric, plugin)
    _prune(d, metric, plugin)
    _retrieved_values(d, metric, list(values))
    if d.time_range:
        dim = catalog.dimension(d.time_range.dimension_key)
        d.time_range = replace(d.time_range, end=dates.end_of_day(d.time_range.end, dim.time_format if dim else None))
    d.filters = [replace(f, value=_number(f.value)) if (x := catalog.dimension(f.dimension_key)) and x.kind == "number" else f for f in d.filters]
    return d


def _supported(metric: Metric | None, key: str) -> bool:
    return metric is None or not metric.supported_dimension_keys or key in metric.supported_dimension_keys


def _period(d: Draft, question: str, catalog: Catalog, metric: Metric | None, today: date) -> None:
    key = metric.default_time_dimension_key if metric else None
    dim = catalog.dimension(key) if key else None
    if dim is None:
        return
    year = dates.explicit_year(question)
    found = (date(year, 1, 1), date(year, 12, 31)) if year else dates.period(question, today)
    if found and (d.time_range is None or year):
        d.time_range = TimeRange(key, *dates.bounds(*found, dim.time_format))


def _month_trend(d: Draft, question: str, catalog: Catalog, metric: Metric | None) -> None:
    if d.analysis_type != "trend" or d.group_by_dimension_keys or not re.search(r"月|month", question, re.I):
        return
    for dim in catalog.dimensions:
        if dim.kind == "time" and re.search(r"月|month", f"{dim.key} {dim.label} {dim.field}", re.I) and _supported(metric, dim.key) and (metric is None or dim.table_key == metric.table_key):
            d.group_by_dimension_keys = [dim.key]
            return


def _groups(d: Draft, question: str, catalog: Catalog, metric: Metric | None) -> None:
    if d.group_by_dimension_keys or metric is None or d.analysis_type not in ("group_by", "trend"):
        return
    terms, low = terms_of(catalog, "dimension"), question.lower()
    keys = metric.supported_dimension_keys or tuple(x.key for x in catalog.dimensions)
    d.group_by_dimension_keys = [
        k for k in keys if any(f.format(t.lower()) in low for t in terms.get(k, ()) for f in (*GROUP_FORMS, *ENGLISH_GROUP_FORMS))
    ]


def _plugin_values(d: Draft, question: str, metric: Metric | None, plugin: Sequence[ValueMapping]) -> None:
    """Database values for aliases: on filters that are there, and for the longest aliases in the question."""
    meanings: dict[str, dict[str, tuple[str, Any]]] = {}
    for m in plugin:
        for alias, value in m.terms.items():
            meanings.setdefault(alias, {})[m.dimension_key] = (m.operator, value)
    for i, f in enumerate(d.filters):
        if isinstance(f.value, str) and f.dimension_key in meanings.get(f.value, {}):
            d.filters[i] = replace(f, value=meanings[f.value][f.dimension_key][1])
    taken: list[tuple[int, int]] = []
    for alias in sorted(meanings, key=lambda a: (-len(a), a)):
        free = [s for s in spans(question, alias) if not any(s[0] < b and a < s[1] for a, b in taken)]
        if not free:
            continue
        taken += free
        fits = [(k, v) for k, v in meanings[alias].items() if _supported(metric, k)]
        if len(fits) == 1 and all(f.dimension_key != fits[0][0] for f in d.filters):
            key, (operator, value) = fits[0]
            d.filters.append(Filter(key, operator, value))


def _prune(d: Draft, metric: Metric | None, plugin: Sequence[ValueMapping]) -> None:
    """Filters on dimensions the metric does not know, and those whose value belongs to other dimensions, go."""
    owners: dict[str, set[str]] = {}
    for m in plugin:
        for value in m.terms.values():
            owners.setdefault(str(value), set()).add(m.dimension_key)
    d.filters = [
        f for f in d.filters if _supported(metric, f.dimension_key) and not (isinstance(f.value, str) and f.value in owners and f.dimension_key not in owners[f.value])
    ]


def _retrieved_values(d: Draft, metric: Metric | None, values: list[ValueCandidate]) -> None:
    for v in sorted(values, key=lambda v: (-v.score, v.dimension_key, v.term)):
        at = next((i for i, f in enumerate(d.filters) if f.dimension_key == v.dimension_key), None)
        if at is not None:
            f = d.filters[at]
            if f.operator == "eq" and f.value in (v.term, str(v.db_value)):
                d.filters[at] = replace(f, value=v.db_value)
        elif _supported(metric, v.dimension_key):
            d.filters.append(Filter(v.dimension_key, "eq", v.db_value))


def _number(value: Any) -> Any:
    if isinstance(value, (list, tuple)):
        return [_number(v) for v in value]
    if isinstance(value, str):
        text = value.strip()
        if re.fullmatch(r"[+-]?\d+", text):
            return int(text)
        if re.fullmatch(r"[+-]?\d*\.\d+", text):
            return float(text)
    return value


# --- candidates ---------------------------------------------------------------------------------------------------


def signature(draft: Draft) -> str:
    """Equal for drafts that mean the same."""
    return json.dumps(
        [
            draft.metric_keys, draft.group_by_dimension_keys, sorted(map(filter_order, draft.filters)),
            [draft.time_range.dimension_key, draft.time_range.start, draft.time_range.end] if draft.time_range else None,
            draft.metric_version_key, draft.order_by_metric, draft.limit, draft.needs_clarification,
        ],
        ensure_ascii=False, default=str,
    )


def vote(drafts: Sequence[Draft]) -> list[Draft]:
    """One draft per meaning: most votes first, then the earliest."""
    votes = Counter(map(signature, drafts))
    first = {s: i for i, s in reversed(list(enumerate(map(signature, drafts))))}
    return [drafts[first[s]] for s in sorted(votes, key=lambda s: (-votes[s], first[s]))]


def clarification_options(question: str, catalog: Catalog, draft: Draft) -> list[dict]:
    asked = named_metrics(question, catalog)
    if len(asked) > 1:
        return [{"target_type": "metric", "key": m.key, "label": m.label, "value": {"metric_key": m.key}} for m in catalog.metrics if m.key in asked]
    metric = catalog.metric(draft.metric_key)
    if metric is None or not metric.default_time_dimension_key or draft.time_range is not None:
        return []
    key = metric.default_time_dimension_key
    presets = (("current_year", "this year"), ("current_month", "this month"), ("custom_range", "another period"))
    return [{"target_type": "time_range", "key": k, "label": label, "value": {"preset": k, "dimension_key": key}} for k, label in presets]


# --- parsing ------------------------------------------------------------------------------------------------------


class Parser(Protocol):
    """Turns a question into candidate drafts; a language model can stand behind it."""

    def __call__(self, question: str, catalog: Catalog, examples: list[dict]) -> list[Draft]: ...


def rule_parser(question: str, catalog: Catalog, examples: list[dict] | None = None) -> list[Draft]:
    """Without a model: the longest metric name, versions by alias, kind of analysis by wording."""
    low = question.lower()
    names = [(len(t), k) for k, terms in terms_of(catalog, "metric").items() for t in terms if t.lower() in low]
    if not names:
        return [Draft(needs_clarification=True, clarification_question="Which measure is meant?")]
    named = named_metrics(question, catalog)
    key = max(names, key=lambda x: (x[0], x[1] in named, x[1]))[1]
    versions = [k for k, terms in terms_of(catalog, "metric_version").items() if catalog.version(k).metric_key == key and any(t.lower() in low for t in terms)]
    grouped = any(f.format(t.lower()) in low for terms in terms_of(catalog, "dimension").values() for t in terms for f in (*GROUP_FORMS, *ENGLISH_GROUP_FORMS))
    kind = "trend" if re.search(r"趋势|trend|月度|monthly", low) else "group_by" if grouped or rank_limit(question) else "summary"
    draft = Draft(metric_key=key, analysis_type=kind, metric_version_key=versions[0] if versions else None)
    if kind == "group_by" and not grouped:  # "top 3 nations"
        dims = [(len(t), k) for k, terms in terms_of(catalog, "dimension").items() for t in terms if t.lower() in low]
        draft.group_by_dimension_keys = [max(dims)[1]] if dims else []
    return [draft]


# --- examples -----------------------------------------------------------------------------------------------------

_MIXED = re.compile(r"[A-Za-z0-9_]+|[一-鿿]")


def few_shot(examples: list[dict], question: str, dataset_id: str | None = None, k: int = 3) -> list[dict]:
    """The k nearest examples by token overlap, then by question."""
    asked = set(_MIXED.findall(question.lower()))

    def near(e: dict) -> float:
        own = set(_MIXED.findall(e["question"].lower()))
        return len(asked & own) / len(asked | own) if asked and own else 0.0

    fits = [e for e in examples if dataset_id is None or e.get("dataset_id") in (None, dataset_id)]
    return sorted(fits, key=lambda e: (-near(e), e["question"]))[: max(0, k)]


def written_examples(examples: list[dict]) -> str:
    return "\n".join(json.dumps({"question": e["question"], "semantic_query": e["semantic_query"]}, ensure_ascii=False, sort_keys=True) for e in examples)


def draft_of(example: dict) -> Draft:
    return draft_from(example["semantic_query"])


FeedbackRun = Callable[[Draft], bool]


def first_with_rows(candidates: Sequence[Draft], has_rows: FeedbackRun, retries: int) -> Draft | None:
    """The first of 1 + ``retries`` candidates whose result has rows."""
    return next((d for d in candidates[: 1 + retries] if has_rows(d)), None)
