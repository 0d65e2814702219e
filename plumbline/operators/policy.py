"""What may be done about an issue, and how sure that is."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.functions import text
from plumbline.storage import local_table

# Confidence and cleaning order per issue type; None means never applied.
POLICY = [
    ("empty_column", "HIGH", 0, "Drop the column"),
    ("duplicate_rows", "HIGH", 1, "Keep the first of identical rows"),
    ("whitespace_formatting", "HIGH", 2, "Trim and collapse whitespace"),
    ("missing_value_placeholder", "MEDIUM", 3, "Turn placeholders into missing values"),
    ("category_inconsistency", "MEDIUM", 4, "Use one spelling per category"),
    ("invalid_date", "MEDIUM", 5, "Turn impossible dates into missing values, others into ISO"),
    ("currency_value", "HIGH", 6, "Keep the number, drop currency formatting"),
    ("duplicate_id", "LOW", None, "Flag for review"),
    ("mixed_data_types", "LOW", None, "Flag for review"),
    ("future_date", "LOW", None, "Flag for review"),
    ("ambiguous_date", "LOW", None, "Flag for review"),
    ("ambiguous_date_format", "LOW", None, "Flag for review"),
    ("impossible_value", "LOW", None, "Flag for review"),
    ("negative_value", "LOW", None, "Flag for review"),
    ("outlier", "LOW", None, "Flag for review"),
    ("constant_column", "LOW", None, "Flag as a candidate to drop"),
    ("high_cardinality", "LOW", None, "Flag for review"),
    ("missing_required_column", "LOW", None, "Flag for review"),
    ("invalid_email", "LOW", None, "Flag for review"),
    ("currency_inconsistency", "LOW", None, "Flag for review"),
    ("near_duplicate", "LOW", None, "Flag for review"),
]


def policy_table(spark: SparkSession) -> DataFrame:
    rows = [{"issue_type": t, "confidence": c, "act_order": o, "action": a}
            for t, c, o, a in POLICY]
    return local_table(
        spark, rows, "issue_type string, confidence string, act_order int, action string")


def decide(
    issues: DataFrame, protected: dict[str, Iterable[str]] | None = None,
) -> DataFrame:
    """Add confidence, action, act_order and status to every issue.

    Status is apply, skipped_protected or flagged_for_review. Unknown issue types are
    flagged. Protected columns match without case and outer blanks.
    """
    spark = issues.sparkSession
    shielded = local_table(
        spark, [{"dataset": d, "name": n, "is_protected": True}
                for d, names in (protected or {}).items() for n in set(names)],
        "dataset string, name string, is_protected boolean").withColumn(
        "name", F.expr(f"lower({text.strip('name')})")).distinct()
    return (
        issues.join(F.broadcast(policy_table(spark)), "issue_type", "left")
        .withColumn("name", F.expr(f"lower({text.strip('column')})"))
        .join(F.broadcast(shielded), ["dataset", "name"], "left")
        .selectExpr(
            "dataset", "column", "issue_type", "severity", "affected_count", "description",
            "coalesce(confidence, 'LOW') AS confidence",
            "coalesce(action, 'Flag for review') AS action", "act_order",
            "CASE WHEN act_order IS NOT NULL AND is_protected THEN 'skipped_protected'"
            " WHEN act_order IS NOT NULL AND confidence != 'LOW' THEN 'apply'"
            " ELSE 'flagged_for_review' END AS status"))


def skip_counters(decisions: DataFrame) -> DataFrame:
    """Per dataset: issues left alone for low confidence, and for protected columns."""
    return decisions.groupBy("dataset").agg(*map(F.expr, [
        "count_if(status = 'flagged_for_review') AS skipped_low_confidence",
        "count_if(status = 'skipped_protected') AS skipped_protected_columns"]))
