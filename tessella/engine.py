"""One object for everything a user of the engine asks for."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from tessella.operators import evaluate, observe
from tessella.plans import guard, repair
from tessella.plans.catalog import load_catalog, summarize
from tessella.plans.compiler import Compiled, Compiler, Tables
from tessella.plans.model import Catalog, Draft, SemanticError
from tessella.sources import sinks


@dataclass(frozen=True)
class Config:
    candidates: int = 1
    retries: int = 0
    few_shot: int = 3
    strict_operators: bool = False

    def __post_init__(self) -> None:
        if not 1 <= self.candidates <= 8:
            raise ValueError("candidates must be 1 to 8")
        if not 0 <= self.retries <= 5:
            raise ValueError("retries must be 0 to 5")


@dataclass
class Answer:
    status: str
    request_id: str
    draft: Draft | None = None
    compiled: Compiled | None = None
    message: str | None = None
    options: list[dict] = field(default_factory=list)
    timings_ms: dict[str, int] = field(default_factory=dict)

    @property
    def frame(self) -> DataFrame | None:
        return self.compiled.frame if self.compiled else None


class Engine:
    """Questions, drafts and read-only SQL over one data set.

    ``parser`` turns a question into drafts (by rules if none is given); results stay lazy DataFrames.
    """

    def __init__(
        self,
        spark: SparkSession,
        catalog: Catalog | str,
        tables: Tables,
        parser: repair.Parser = repair.rule_parser,
        plugin: tuple[repair.ValueMapping, ...] = (),
        values: Callable[[str], list[repair.ValueCandidate]] = lambda question: [],
        examples: list[dict] | None = None,
        config: Config | None = None,
    ):
        self.spark = spark
        self.catalog = load_catalog(catalog) if isinstance(catalog, str) else catalog
        self.config = config or Config()
        self.compiler = Compiler(self.catalog, tables, self.config.strict_operators)
        self.parser, self.plugin, self.values, self.examples = parser, plugin, values, examples or []
        self.answers: dict[str, Answer] = {}
        self.events: list[dict] = []

    def compile(self, draft: Draft) -> Compiled:
        return self.compiler.compile(draft)

    def ask(self, question: str, today: date | None = None) -> Answer:
        """Parse, repair, vote, compile; an empty grouped result tries the next candidate."""
        begun, at = time.monotonic(), {}
        answer = Answer("error", sinks.new_id())
        try:
            examples = repair.few_shot(self.examples, question, self.catalog.dataset_id, self.config.few_shot)
            drafts = self.parser(question, self.catalog, examples)[: self.config.candidates]
            at["parse"] = time.monotonic()
            fixed = [repair.repair(d, question, self.catalog, today or date.today(), self.plugin, self.values(question)) for d in drafts]
            ranked = repair.vote(fixed)
            at["repair"] = time.monotonic()
            self._choose(answer, question, ranked)
        except SemanticError as error:
            answer.status, answer.message = "clarification", str(error)
        answer.timings_ms = {k: round((v - begun) * 1000) for k, v in at.items()} | {"total": round((time.monotonic() - begun) * 1000)}
        self.answers[answer.request_id] = answer
        self._event(answer, question)
        return answer

    def _choose(self, answer: Answer, question: str, ranked: list[Draft]) -> None:
        if not ranked:
            raise SemanticError("the question could not be read")
        first = ranked[0]
        answer.draft = first
        metric = self.catalog.metric(first.metric_key)
        missing_time = metric is not None and metric.default_time_dimension_key and first.time_range is None
        if first.needs_clarification or missing_time:
            answer.status = "clarification"
            answer.message = first.clarification_question or "Which period is meant?"
            answer.options = repair.clarification_options(question, self.catalog, first)
            return
        tried: dict[int, Compiled] = {}

        def has_rows(d: Draft) -> bool:
            tried[id(d)] = self.compile(d)
            # a global aggregate always has its one row
            return not d.group_by_dimension_keys or not tried[id(d)].frame.isEmpty()

        ready = [d for d in ranked if not d.needs_clarification]
        found = ready[0] if not self.config.retries else repair.first_with_rows(ready, has_rows, self.config.retries)
        if found is None:
            answer.status, answer.message = "clarification", "No rows for any reading of the question."
            return
        answer.draft, answer.compiled, answer.status = found, tried.get(id(found)) or self.compile(found), "ready"

    def _event(self, answer: Answer, question: str) -> None:
        import hashlib

        short = lambda s: hashlib.sha256(s.encode()).hexdigest()[:12] if s else "none"
        self.events.append(
            {
                "timestamp": datetime.now(timezone.utc), "route": "ask", "status": {"ready": "success"}.get(answer.status, answer.status),
                "dataset_id": self.catalog.dataset_id, "request_id": answer.request_id, "question_hash": short(question),
                "total_ms": answer.timings_ms.get("total"), "sql_hash": short(answer.compiled.sql if answer.compiled else ""),
            }
        )

    def answer(self, request_id: str) -> Answer:
        if request_id not in self.answers:
            raise KeyError(f"no answer {request_id}")
        return self.answers[request_id]

    def history(self) -> list[str]:
        """Requests that have a result."""
        return [k for k, a in self.answers.items() if a.compiled]

    def forget(self, request_id: str) -> None:
        self.answers.pop(request_id, None)

    def run_sql(self, sql: str) -> DataFrame:
        return guard.run_sql(self.spark, sql)

    def dry_run(self, sql: str) -> str:
        return guard.dry_run(self.spark, sql)

    def run_all(self, statements: list[str]) -> DataFrame | None:
        return guard.run_all(self.spark, statements)

    def summary(self) -> dict:
        return summarize(self.catalog)

    def observed(self) -> DataFrame:
        """Route summary of this engine's own events."""
        from tessella.sources.events import SCHEMA

        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return observe.route_summary(self.spark.createDataFrame([tuple(e.get(n) for n in names) for e in self.events], SCHEMA))

    def evaluate(self, cases: list[dict], today: date) -> DataFrame:
        """Counters over evaluation cases; golden SQL is compared by result."""
        rows = []
        for run, case in enumerate(cases):
            a = self.ask(case["question"], today)
            wrong = evaluate.matches(case, a.draft or Draft(), a.status)
            ex = None
            if case.get("expected_sql") and a.compiled:
                ex = evaluate.same_rows(a.frame, self.run_sql(case["expected_sql"]))
            rows.append((case["id"], case.get("level"), case.get("category"), a.status, not wrong and ex is not False, ex, repair.signature(a.draft) if a.draft else "", run))
        return evaluate.counters(evaluate.case_frame(self.spark, rows))
