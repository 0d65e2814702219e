"""One failing dataset must not stop the others, in any stage.

Stages run as jobs over a whole catalogue, so an error does not name its dataset. A stage that
fails is run again on halves of its catalogue until the failing datasets are alone; all others then
go through it together. Without a failure nothing runs twice; with f failures among n datasets a
stage runs about 2 f log2(n) times more, on ever smaller parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

from plumbline.operators import cleaning
from plumbline.operators.facts import Facts
from plumbline.plans.quality_job import QualityReport, analyze, report_on
from plumbline.storage import local_table, materialise

STATUS_SCHEMA = "dataset string, stage string, status string, reason string"
_Result = TypeVar("_Result")


def _reason(error: Exception) -> str:
    lines = str(error).strip().splitlines()
    return lines[0] if lines else type(error).__name__


def failing(names: list[str], attempt: Callable[[list[str]], object], error: Exception) -> dict[str, str]:
    """The datasets for which ``attempt`` fails alone, with reasons; it failed for all ``names``."""
    if len(names) == 1:
        return {names[0]: _reason(error)}
    found: dict[str, str] = {}
    middle = len(names) // 2
    for half in (names[:middle], names[middle:]):
        try:
            attempt(half)
        except Exception as inner:
            found |= failing(half, attempt, inner)
    return found


def isolated(
    names: Iterable[str], attempt: Callable[[list[str]], _Result],
) -> tuple[_Result | None, dict[str, str]]:
    """The result of ``attempt`` for all datasets that do not fail, and reasons for the others.

    ``attempt`` takes names and must run its jobs before it returns. If the remaining datasets
    fail together although none fails alone, that error is raised.
    """
    left, failures = list(names), {}
    while left:
        try:
            return attempt(left), failures
        except Exception as error:
            bad = failing(left, attempt, error)
            if not bad:
                raise
            failures |= bad
            left = [n for n in left if n not in bad]
    return None, failures


class RunStatus:
    """Where each dataset of a run has got to."""

    def __init__(self, spark: SparkSession, names: Iterable[str]):
        self.spark = spark
        self.rows = {n: {"dataset": n, "stage": "load", "status": "ok", "reason": None} for n in names}

    def passed(self, stage: str, names: Iterable[str]) -> None:
        for n in names:
            self.rows[n]["stage"] = stage

    def failed(self, stage: str, failures: Mapping[str, str]) -> None:
        for n, reason in failures.items():
            self.rows[n] = {"dataset": n, "stage": stage, "status": "failed", "reason": reason}

    def table(self) -> DataFrame:
        return local_table(self.spark, list(self.rows.values()), STATUS_SCHEMA)


def _clean(before: Facts, decisions: DataFrame, name: str, skip_mixed_currency: bool) -> cleaning.Cleaning:
    done = cleaning.apply_cleaning(before, name, decisions, skip_mixed_currency)
    done.cleaned = materialise(done.cleaned)
    return done


def run_isolated(
    frames: Mapping[str, DataFrame], run_id: str, load_failures: Mapping[str, str] | None = None,
    as_of: str | None = None, required: dict[str, Iterable[str]] | None = None,
    protected: dict[str, Iterable[str]] | None = None, near_duplicate_search: bool = True,
    skip_mixed_currency: bool = False, **report_options,
) -> tuple[QualityReport | None, DataFrame]:
    """The whole job for all datasets that get through it, and (dataset, stage, status, reason).

    ``stage`` is the one a dataset failed in (load, analyze, clean, report), or the last one. A
    dataset that fails late is left out of the report altogether: no table shows half of it.
    """
    spark = next(iter(frames.values())).sparkSession
    status = RunStatus(spark, [*frames, *(load_failures or {})])
    status.failed("load", load_failures or {})

    def analyzed(names: list[str]) -> tuple[Facts, DataFrame]:
        return analyze({n: frames[n] for n in names}, as_of, required, protected, near_duplicate_search)

    found, failures = isolated(frames, analyzed)
    status.failed("analyze", failures)
    names = [n for n in frames if n not in failures]
    status.passed("analyze", names)

    cleanings: dict[str, cleaning.Cleaning] = {}
    if found:
        failures = {}
        for n in names:                            # one job each, so an error names its dataset
            try:
                cleanings[n] = _clean(*found, n, skip_mixed_currency)
            except Exception as error:
                failures[n] = _reason(error)
        status.failed("clean", failures)
        names = [n for n in names if n not in failures]
        status.passed("clean", names)

    def reported(part: list[str]) -> QualityReport:
        before, decisions = found if list(found[0].frames) == part else analyzed(part)
        report = report_on(
            before, decisions, [cleanings[n] for n in part], run_id, as_of, required, protected,
            near_duplicate_search=near_duplicate_search, **report_options)
        # reports are lazy: whatever fails has to fail here
        report.tables = {k: materialise(t) for k, t in report.tables.items()}
        return report

    report, failures = isolated(names, reported)
    status.failed("report", failures)
    status.passed("report", [n for n in names if n not in failures])
    return report, status.table()
