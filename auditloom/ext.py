"""User extensions: analyzers, rules and signals."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from auditloom.operators.findings import FINDING_COLUMNS, union_findings
from auditloom.plans.lineage import cut_counted
from auditloom.rules.formula import Rule


@dataclass
class Analyzer:
    """A named function from files to findings; ``applies_if`` selects the files it sees."""

    name: str
    version: str
    fn: Callable[[DataFrame], DataFrame]
    applies_if: Column | None = None
    capabilities: tuple[str, ...] = ()


@dataclass
class Registry:
    analyzers: dict[str, Analyzer] = field(default_factory=dict)
    rules: list[Rule] = field(default_factory=list)
    signals: list[Column] = field(default_factory=list)
    #: analyzer name -> message of analyzers whose plan could not be built in the last run
    failed: dict[str, str] = field(default_factory=dict)

    def register_analyzer(self, name: str, fn: Callable[[DataFrame], DataFrame], applies_if: Column | None = None,
                          version: str = "1", capabilities: Iterable[str] = ()) -> None:
        self.analyzers[name] = Analyzer(name, version, fn, applies_if, tuple(capabilities))

    def register_rule(self, rule: Rule) -> None:
        if any(r.id == rule.id for r in self.rules):
            raise ValueError(f"rule {rule.id} exists")
        self.rules.append(rule)

    def register_signal(self, signal: Column) -> None:
        """A column that is null or a struct (threat_type, confidence, details)."""
        self.signals.append(signal)

    def run(self, files: DataFrame, capability: str | None = None, min_severity: int = 1, max_findings: int | None = None) -> DataFrame:
        """Findings of all applicable analyzers on the common schema.

        An analyzer whose plan does not resolve is left out and noted in ``failed``; the others run.
        """
        self.failed.clear()
        parts = []
        for a in self.analyzers.values():
            if capability and capability not in a.capabilities:
                continue
            try:
                seen = files if a.applies_if is None else files.where(a.applies_if)
                out = a.fn(seen).withColumn("engine", F.lit(a.name))
                out.schema  # resolves the plan here, where a failure can be isolated
                parts.append(out)
            except (PySparkException, ValueError, TypeError, KeyError) as e:
                self.failed[a.name] = str(e)
        if not parts:
            empty = ", ".join(f"{c} {t}" for c, t in FINDING_COLUMNS.items())
            return files.sparkSession.createDataFrame([], empty)
        out = union_findings(*parts).where(F.col("severity") >= min_severity)
        if max_findings is None:
            return out
        rest = [c for c in FINDING_COLUMNS if c not in ("severity", "confidence")]
        return out.orderBy(F.desc("severity"), F.desc("confidence"), *rest).limit(max_findings)

    def run_isolated(self, files: DataFrame, capability: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(findings, outcomes): every analyzer as a job of its own, so that one which fails while it runs ends alone.

        A result is written to the shared folder and read from there, so nothing runs twice.  ``outcomes`` has a row for each
        applicable analyzer: engine, version, findings, error (null if there was none).  What a failed analyzer had found is left out.
        """
        spark = files.sparkSession
        parts, outcomes = [], []
        for a in self.analyzers.values():
            if capability and capability not in a.capabilities:
                continue
            try:
                seen = files if a.applies_if is None else files.where(a.applies_if)
                out, n = cut_counted(union_findings(a.fn(seen).withColumn("engine", F.lit(a.name))))
                parts.append(out)
                outcomes.append((a.name, a.version, n, None))
            except (PySparkException, Py4JJavaError, ValueError, TypeError, KeyError) as e:
                outcomes.append((a.name, a.version, 0, str(e)))
        types = ", ".join(f"{c} {t}" for c, t in FINDING_COLUMNS.items())
        found = union_findings(spark.createDataFrame([], types), *parts)
        return found, spark.createDataFrame(outcomes, "engine string, version string, findings long, error string")
