"""The whole job: profile, detect, decide, clean, validate, gate, score and report."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from plumbline.operators import (
    cleaning, detect, drift, governance, policy, readiness, relationships, scoring, validation)
from plumbline.operators.columns import ROW_ID
from plumbline.operators.facts import Facts, build_facts
from plumbline.storage import materialise


@dataclass
class QualityReport:
    """Result tables of one run; frames are lazy unless they were needed on the way."""

    run_id: str
    before: Facts
    after: Facts
    cleanings: list[cleaning.Cleaning]
    tables: dict[str, DataFrame]


def analyze(
    frames: Mapping[str, DataFrame], as_of: str | None = None,
    required: dict[str, Iterable[str]] | None = None,
    protected: dict[str, Iterable[str]] | None = None,
    near_duplicate_search: bool = True,
) -> tuple[Facts, DataFrame]:
    """Profile a catalogue and decide about every issue."""
    facts = build_facts(frames, as_of)
    issues = detect.detect_issues(facts, required, near_duplicate_search)
    return facts, materialise(policy.decide(issues, protected))


def run_quality_job(
    frames: Mapping[str, DataFrame], run_id: str, as_of: str | None = None,
    required: dict[str, Iterable[str]] | None = None,
    protected: dict[str, Iterable[str]] | None = None,
    platforms: list[str] | None = None,
    near_duplicate_search: bool = True,
    history: DataFrame | None = None,
    skip_mixed_currency: bool = False,
    markers_are_missing: bool = False,
) -> QualityReport:
    """Run every stage over a catalogue of datasets with ``_row_id`` columns."""
    before, decisions = analyze(frames, as_of, required, protected, near_duplicate_search)
    cleanings = [
        cleaning.apply_cleaning(before, d, decisions, skip_mixed_currency) for d in before.frames]
    for c in cleanings:
        c.cleaned = materialise(c.cleaned)
    return report_on(before, decisions, cleanings, run_id, as_of, required, protected, platforms,
                     near_duplicate_search, history, markers_are_missing)


def report_on(
    before: Facts, decisions: DataFrame, cleanings: list[cleaning.Cleaning], run_id: str,
    as_of: str | None = None, required: dict[str, Iterable[str]] | None = None,
    protected: dict[str, Iterable[str]] | None = None,
    platforms: list[str] | None = None,
    near_duplicate_search: bool = True,
    history: DataFrame | None = None,
    markers_are_missing: bool = False,
) -> QualityReport:
    """The reports of a run whose datasets are profiled and cleaned."""
    after, after_issues = analyze(
        {c.dataset: c.cleaned for c in cleanings}, as_of, required, protected,
        near_duplicate_search)

    checks = materialise(validation.validate(after))
    published = validation.gate(before, after, checks, markers_are_missing)
    links = materialise(relationships.relationship_checks(before.frames))
    readiness_before = readiness.readiness_checks(before, decisions, packs=platforms)
    readiness_after = readiness.readiness_checks(after, after_issues, packs=platforms)
    scores = {
        "before": scoring.quality_score(
            before, decisions,
            readiness.overall_readiness(readiness.score_packs(readiness_before))),
        "after": scoring.quality_score(
            after, after_issues,
            readiness.overall_readiness(readiness.score_packs(readiness_after)),
            validation.overall_status(checks)),
    }
    linked = readiness.readiness_checks(before, decisions, links, platforms)
    changes = None
    for c in cleanings:
        changes = c.changes if changes is None else changes.unionByName(c.changes)
    # the log is an output of its own and several reports read it
    changes = materialise(changes)
    audit = governance.audit_rows(decisions, changes, run_id)
    lineage = governance.lineage(before, cleanings, decisions)
    stored = drift.profile_history(before, run_id)
    known = stored if history is None else history.select(*drift.HISTORY_COLUMNS).unionByName(stored)
    findings = drift.drift_findings(known)
    tables = {
        "column_profile": before.profile, "dataset_profile": before.datasets,
        "decisions": decisions, "issues_after": after_issues, "changes": changes,
        "audit": audit, "cleaning_log": governance.cleaning_rows(audit),
        "validation": checks, "gate": published,
        "readiness": readiness.refresh_readiness(linked, readiness_after),
        "relationships": relationships.relationship_findings(before.frames),
        "quality_before": scores["before"], "quality_after": scores["after"],
        "before_after": scoring.before_after(
            scoring.snapshot_metrics(before, decisions, scores["before"], "before"),
            scoring.snapshot_metrics(after, after_issues, scores["after"], "after")),
        "lineage": lineage,
        "dictionary": governance.data_dictionary(after, lineage, cleanings, decisions),
        "history": stored, "drift": findings,
        "drift_summary": drift.drift_summary(known, findings).where(F.col("run_id") == run_id),
    }
    return QualityReport(run_id, before, after, cleanings, tables)


def run_totals(report: QualityReport) -> DataFrame:
    """(run quality score, readiness, status) over all datasets of the run."""
    parts = [
        report.tables["quality_after"].agg(
            F.expr("cast(bround(avg(quality_score)) AS int) AS quality_score")),
        readiness.run_readiness(readiness.score_packs(report.tables["readiness"])),
        report.tables["gate"].agg(F.expr(
            "CASE WHEN bool_and(published) THEN 'cleaned' ELSE 'rollback' END AS status")),
    ]
    # three single rows
    scores, ready, status = (p.withColumn("run_id", F.lit(report.run_id)) for p in parts)
    return scores.join(F.broadcast(ready), "run_id").join(F.broadcast(status), "run_id")


__all__ = ["ROW_ID", "QualityReport", "analyze", "run_quality_job", "run_totals"]
