"""A dataset that fails in any stage leaves the others alone."""

import pytest

from plumbline.operators import cleaning
from plumbline.operators.columns import ROW_ID
from plumbline.plans import isolation


def test_halves_are_tried_until_the_failing_are_alone():
    tried = []

    def attempt(names):
        tried.append(list(names))
        if {"c", "h"} & set(names):
            raise ValueError("first line\nsecond line")
        return sorted(names)

    found, failures = isolation.isolated("abcdefgh", attempt)
    assert found == list("abdefg") and failures == {"c": "first line", "h": "first line"}
    assert tried[0] == list("abcdefgh") and tried[-1] == list("abdefg") and len(tried) <= 12


def test_nothing_runs_twice_without_a_failure():
    tried = []
    assert isolation.isolated("abc", lambda names: tried.append(names) or "done") == ("done", {})
    assert len(tried) == 1


def test_all_may_fail_and_joint_failures_are_raised():
    def attempt(names):
        raise ValueError("")

    assert isolation.isolated("ab", attempt) == (None, {"a": "ValueError", "b": "ValueError"})

    def jointly(names):
        if len(names) > 1:
            raise ValueError("only together")

    with pytest.raises(ValueError, match="only together"):
        isolation.isolated("ab", jointly)


@pytest.fixture(scope="module")
def frames(spark):
    rows = spark.range(30).selectExpr(f"id AS {ROW_ID}", "id", "concat('n', id % 7, ' ') AS name")
    return {"good.csv": rows, "late.csv": rows,
            "bad.csv": rows.selectExpr("*", "1 DIV (id - 3) AS broken"),
            "other.csv": rows.selectExpr("*", "id * 2 AS twice")}


def test_a_run_reports_what_went_through(frames, monkeypatch):
    plain = cleaning.apply_cleaning

    def apply(facts, name, *rest):
        if name == "late.csv":
            raise RuntimeError("cannot clean")
        return plain(facts, name, *rest)

    monkeypatch.setattr(isolation.cleaning, "apply_cleaning", apply)
    report, status = isolation.run_isolated(
        frames, "r1", {"lost.xml": "no such file"}, "2024-01-01", platforms=["sql"])
    found = {r.dataset: (r.stage, r.status, r.reason) for r in status.collect()}
    assert found["lost.xml"] == ("load", "failed", "no such file")
    assert found["late.csv"] == ("clean", "failed", "cannot clean")
    assert found["bad.csv"][:2] == ("analyze", "failed") and "DIVIDE_BY_ZERO" in found["bad.csv"][2]
    assert found["good.csv"] == found["other.csv"] == ("report", "ok", None)
    for name in ("quality_after", "gate", "dataset_profile"):
        assert {r.dataset for r in report.tables[name].collect()} == {"good.csv", "other.csv"}
