"""Drift between versions of a dataset, from their stored profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from plumbline.functions import text
from plumbline.operators.facts import Facts

# How much change counts as drift.
VOLUME_CHANGE = 0.2
MISSING_POINTS = 10.0
DISTRIBUTION_CHANGE = 0.2

HISTORY_COLUMNS = [
    "dataset", "run_id", "column", "inferred_type", "row_count", "missing_percentage", "mean",
    "std", "categories",
]
_FINDING = ["dataset", "run_id", "compared_against", "drift_type", "column", "severity",
            "previous", "current"]


def profile_history(facts: Facts, run_id: str) -> DataFrame:
    """The part of a profile that later versions are compared with."""
    return facts.profile.selectExpr(
        "dataset", f"{text.literal(run_id)} AS run_id", "column", "inferred_type", "row_count",
        "missing_percentage", "mean", "std",
        "transform(categorical_extra.top_categories, x -> x.value) AS categories")


def previous_runs(history: DataFrame) -> DataFrame:
    """(dataset, run_id, compared_against): each run and the one before it, if any."""
    runs = history.select("dataset", "run_id").distinct()
    return runs.withColumn("compared_against", F.lag("run_id").over(
        Window.partitionBy("dataset").orderBy("run_id")))


def latest_before(history: DataFrame, run_id: str) -> DataFrame:
    """The profile rows of each dataset's newest run other than ``run_id``."""
    earlier = history.where(F.col("run_id") != run_id)
    newest = earlier.groupBy("dataset").agg(F.max("run_id").alias("run_id"))
    return earlier.join(F.broadcast(newest), ["dataset", "run_id"], "left_semi")


def drift_findings(history: DataFrame) -> DataFrame:
    """Every difference between each run and its predecessor, for all datasets at once."""
    runs = previous_runs(history).where("compared_against IS NOT NULL")
    now = history.join(F.broadcast(runs), ["dataset", "run_id"])
    then = history.withColumnRenamed("run_id", "compared_against").join(
        F.broadcast(runs), ["dataset", "compared_against"])
    keys = ["dataset", "run_id", "compared_against"]
    a, b = now.alias("c"), then.alias("p")
    both = a.join(b, [*keys, "column"], "full_outer").select(
        *keys, "column",
        *(F.col(f"{side}.{n}").alias(f"{new}_{n}") for side, new in (("c", "now"), ("p", "was"))
          for n in HISTORY_COLUMNS[3:]))

    def whole(condition: str, kind: str, severity: str) -> DataFrame:
        return both.where(condition).groupBy(*keys).agg(*map(F.expr, [
            f"'{kind}' AS drift_type", "cast(null AS string) AS column",
            f"'{severity}' AS severity", "cast(null AS string) AS previous",
            "array_join(sort_array(collect_list(column)), ', ') AS current"])).select(*_FINDING)

    new = whole("was_inferred_type IS NULL", "schema_drift_new_columns", "medium")
    removed = whole("now_inferred_type IS NULL", "schema_drift_removed_columns", "high")
    volume = (
        both.groupBy(*keys).agg(F.expr("max(now_row_count) AS n"), F.expr("max(was_row_count) AS o"))
        .where(f"o > 0 AND abs(n - o) / o > {VOLUME_CHANGE}D")
        .selectExpr(*keys, "'volume_drift' AS drift_type", "cast(null AS string) AS column",
                    "'medium' AS severity", "cast(o AS string) AS previous",
                    "cast(n AS string) AS current"))

    def shift(n: str) -> str:
        return (f"was_{n} != 0 AND abs(now_{n} - was_{n}) / nullif(abs(was_{n}), 0)"
                f" > {DISTRIBUTION_CHANGE}D")

    gained = "array_except(now_categories, was_categories)"
    lost = "array_except(was_categories, now_categories)"
    per_column = [
        ("schema_drift_type_change", "medium", "now_inferred_type != was_inferred_type",
         "was_inferred_type", "now_inferred_type"),
        ("missingness_drift", "high",
         f"now_missing_percentage - was_missing_percentage > {MISSING_POINTS}D",
         "cast(was_missing_percentage AS string)", "cast(now_missing_percentage AS string)"),
        ("category_drift", "low", f"size({gained}) > 0 OR size({lost}) > 0",
         f"array_join(sort_array({lost}), ', ')", f"array_join(sort_array({gained}), ', ')"),
        ("distribution_drift_mean", "medium", shift("mean"),
         "cast(round(was_mean, 4) AS string)", "cast(round(now_mean, 4) AS string)"),
        ("distribution_drift_std", "low", shift("std"),
         "cast(round(was_std, 4) AS string)", "cast(round(now_std, 4) AS string)"),
    ]
    rows = ", ".join(
        f"named_struct('drift_type', '{kind}', 'severity', '{severity}',"
        f" 'found', coalesce({condition}, false), 'previous', {was}, 'current', {current})"
        for kind, severity, condition, was, current in per_column)
    columns = (
        both.where("now_inferred_type IS NOT NULL AND was_inferred_type IS NOT NULL")
        .selectExpr(*keys, "column", f"inline(array({rows}))").where("found").select(*_FINDING))
    return new.unionByName(removed).unionByName(volume.select(*_FINDING)).unionByName(columns)


def drift_summary(history: DataFrame, findings: DataFrame) -> DataFrame:
    """(dataset, run_id, compared_against, finding_count, overall_status)."""
    counted = findings.groupBy("dataset", "run_id").agg(F.expr("count(*) AS finding_count"))
    return previous_runs(history).join(F.broadcast(counted), ["dataset", "run_id"], "left").selectExpr(
        "dataset", "run_id", "compared_against", "coalesce(finding_count, 0) AS finding_count",
        "CASE WHEN compared_against IS NULL THEN 'no_history' WHEN finding_count IS NULL"
        " THEN 'no_drift' ELSE 'drift_detected' END AS overall_status")
