"""Quality score and before/after metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.operators.facts import Facts

# Integrity points per validation status, points lost per useless column.
INTEGRITY = {"pass": 100.0, "warning": 80.0, "fail": 40.0}
COLUMN_PENALTY = 10.0

DIMENSIONS = [
    "completeness", "validity", "consistency", "uniqueness", "integrity", "schema_quality",
    "analytics_readiness",
]
METRICS = [
    "row_count", "column_count", "missing_values", "duplicate_rows", "duplicate_ids",
    "invalid_values", "invalid_dates", "outliers", "quality_score", "analytics_readiness",
]


def _affected(*issue_types: str) -> str:
    listed = ", ".join(f"'{t}'" for t in issue_types)
    return (f"coalesce(sum(CASE WHEN issue_type IN ({listed}) THEN affected_count END), 0)")


def _dataset_facts(facts: Facts, issues: DataFrame) -> DataFrame:
    columns = facts.profile.groupBy("dataset").agg(*map(F.expr, [
        "avg(missing_percentage) AS mean_missing", "sum(missing_count) AS missing_values",
        "coalesce(sum(CASE WHEN inferred_type = 'id' THEN value_count - unique_count END), 0)"
        " AS duplicate_ids"]))
    counted = issues.groupBy("dataset").agg(*map(F.expr, [
        f"{_affected('impossible_value', 'invalid_date', 'mixed_data_types')} AS not_valid",
        f"{_affected('category_inconsistency', 'whitespace_formatting')} AS not_consistent",
        f"{_affected('impossible_value', 'negative_value', 'mixed_data_types')} AS invalid_values",
        f"{_affected('invalid_date')} AS invalid_dates", f"{_affected('outlier')} AS outliers"]))
    joined = facts.datasets.join(F.broadcast(columns), "dataset", "left").join(
        F.broadcast(counted), "dataset", "left")
    return joined.na.fill(0, [
        "missing_values", "duplicate_ids", "not_valid", "not_consistent", "invalid_values",
        "invalid_dates", "outliers"])


def quality_score(
    facts: Facts, issues: DataFrame, readiness: DataFrame, status: DataFrame | None = None,
) -> DataFrame:
    """Seven dimensions per dataset and their mean.

    ``readiness`` has (dataset, analytics_readiness); ``status`` has the validation outcome
    (dataset, overall_status) and is absent before validation.
    """
    wide = _dataset_facts(facts, issues).join(F.broadcast(readiness), "dataset", "left")
    points = "100.0D"
    if status is not None:
        wide = wide.join(F.broadcast(status.select("dataset", "overall_status")), "dataset", "left")
        cases = " ".join(f"WHEN '{s}' THEN {p}D" for s, p in INTEGRITY.items())
        points = f"CASE overall_status {cases} ELSE 100.0D END"

    def share(n: str) -> str:
        return f"least(1.0D, coalesce(try_divide({n}, row_count), 0.0D))"

    shaped = {
        "completeness": "greatest(0.0D, 100.0D - coalesce(mean_missing, 0.0D))",
        "validity": f"100.0D - 100.0D * {share('not_valid')}",
        "consistency": f"100.0D - 100.0D * {share('not_consistent')}",
        "uniqueness": "greatest(0.0D, 100.0D"
                      " - coalesce(try_divide(duplicate_row_count, row_count), 0.0D) * 100.0D"
                      " - coalesce(try_divide(duplicate_ids, row_count), 0.0D) * 100.0D)",
        "integrity": points,
        "schema_quality": "greatest(0.0D, 100.0D - "
                          f"{COLUMN_PENALTY}D * (size(constant_columns) + empty_column_count))",
        "analytics_readiness": "cast(analytics_readiness AS double)",
    }
    scored = wide.selectExpr("dataset", *(f"bround({e}, 2) AS {d}" for d, e in shaped.items()))
    total = " + ".join(DIMENSIONS)
    return scored.selectExpr(
        "dataset", *DIMENSIONS,
        f"cast(bround(({total}) / {len(DIMENSIONS)}) AS int) AS quality_score")


def snapshot_metrics(
    facts: Facts, issues: DataFrame, scores: DataFrame, stage: str,
) -> DataFrame:
    """(dataset, stage, metric, value) in long form."""
    wide = _dataset_facts(facts, issues).join(
        F.broadcast(scores.select("dataset", "quality_score", "analytics_readiness")),
        "dataset", "left").withColumnRenamed("duplicate_row_count", "duplicate_rows")
    rows = ", ".join(
        f"named_struct('metric', '{m}', 'value', cast({m} AS double))" for m in METRICS)
    return wide.selectExpr("dataset", f"'{stage}' AS stage", f"inline(array({rows}))")


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """(dataset, metric, before, after, change)."""
    pivoted = before.unionByName(after).groupBy("dataset", "metric").pivot(
        "stage", ["before", "after"]).agg(F.first("value"))
    return pivoted.selectExpr("*", "after - before AS change")
