"""Audit rows, lineage and the data dictionary of cleaned datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from plumbline.functions import text
from plumbline.operators.cleaning import Cleaning, POST_NORMALISATION
from plumbline.operators.columns import ROW_ID
from plumbline.operators.facts import Facts
from plumbline.operators.readiness import column_roles, field_roles
from plumbline.storage import local_table

# Fixed value: issues with at least this many changes get one summary row.
ROW_DETAIL_LIMIT = 50

# Platform -> dictionary column.
DICTIONARY_LABELS = {
    "power_bi": "power_bi_role", "tableau": "tableau_role", "alteryx": "alteryx_role",
    "excel": "excel_relevance", "looker": "looker_role", "looker_studio": "looker_studio_role",
    "qlik": "qlik_role", "sql": "sql_role", "python": "python_role", "r": "r_role",
}


def _same_issue(a: str, b: str) -> str:
    return (f"{a}.dataset = {b}.dataset AND {a}.issue_type = {b}.issue_type"
            f" AND {a}.column <=> {b}.column")


def audit_rows(decisions: DataFrame, changes: DataFrame, run_id: str) -> DataFrame:
    """One row per change of an applied issue, one summary row where there are many, and one
    row per issue that was withheld or flagged.

    Counting and picking the first change happen in a grouped aggregate, so large change sets
    never travel; only issues with few changes are joined back to their rows.
    """
    entry = changes.selectExpr(
        "*", f"CASE WHEN issue_type = '{POST_NORMALISATION}' THEN 'duplicate_rows'"
        " ELSE issue_type END AS issue", "issue_type AS rule")
    keys = ["dataset", "issue", "column", "rule"]
    sums = entry.groupBy(*keys).agg(*map(F.expr, [
        "count(*) AS changed",
        f"min_by(struct(original_value, new_value), coalesce({ROW_ID}, -1)) AS first_change"]))
    few = sums.where(f"changed < {ROW_DETAIL_LIMIT}").select(
        "dataset", "issue", "column", "rule").alias("f")
    match = F.expr(
        "e.dataset = f.dataset AND e.issue = f.issue AND e.column <=> f.column AND e.rule = f.rule")
    # at most one row per issue type and column
    details = entry.alias("e").join(F.broadcast(few), match, "left_semi").selectExpr(
        "dataset", "issue", "column", "rule", f"cast({ROW_ID} AS string) AS row_reference",
        "original_value", "new_value")
    summary = sums.where(f"changed >= {ROW_DETAIL_LIMIT}").selectExpr(
        "dataset", "issue", "column", "rule",
        "concat(changed, ' rows (aggregated)') AS row_reference",
        "first_change.original_value AS original_value", "first_change.new_value AS new_value")
    logged = details.unionByName(summary).withColumnRenamed("issue", "issue_type")

    applied = decisions.where("status = 'apply'")
    done = (
        applied.alias("d").join(logged.alias("l"), F.expr(_same_issue("d", "l")), "left")
        .selectExpr("d.dataset", "d.column", "l.row_reference", "d.issue_type",
                    "l.original_value", "l.new_value", "d.action",
                    "coalesce(l.rule, d.issue_type) AS rule", "d.description AS reason",
                    "d.confidence", "d.severity", "'applied' AS status"))
    # copies that only appeared through normalisation are logged even without such an issue
    late = (
        logged.where(f"rule = '{POST_NORMALISATION}'").alias("l")
        .join(applied.alias("d"), F.expr(_same_issue("l", "d")), "left_anti")
        .selectExpr("dataset", "column", "row_reference", "issue_type", "original_value",
                    "new_value", "'Drop rows that became identical' AS action", "rule",
                    "'Rows became identical through normalisation' AS reason",
                    "'HIGH' AS confidence", "'high' AS severity", "'applied' AS status"))
    held = decisions.where("status != 'apply'").selectExpr(
        "dataset", "column", "cast(null AS string) AS row_reference", "issue_type",
        "cast(null AS string) AS original_value", "cast(null AS string) AS new_value",
        "CASE WHEN status = 'skipped_protected' THEN 'Skipped: column is protected'"
        " ELSE 'Flag for manual review' END AS action", "issue_type AS rule",
        "description AS reason",
        "CASE WHEN status = 'skipped_protected' THEN confidence ELSE 'LOW' END AS confidence",
        "severity", "status")
    return done.unionByName(late).unionByName(held).selectExpr(f"{text.literal(run_id)} AS run_id", "*")


def cleaning_rows(audit: DataFrame) -> DataFrame:
    return audit.where("status = 'applied'")


def lineage(facts: Facts, cleanings: list[Cleaning], decisions: DataFrame) -> DataFrame:
    """What happened to each source column, numbered in source order per dataset."""
    rows = [
        {"dataset": c.dataset, "column": column, "issue_type": issue, "step": n}
        for c in cleanings for n, (issue, column) in enumerate(c.steps) if column is not None]
    steps = local_table(
        facts.spark, rows, "dataset string, column string, issue_type string, step int")
    applied = (
        steps.alias("s").join(F.broadcast(decisions.alias("d")), F.expr(_same_issue("s", "d")))
        .selectExpr("s.dataset", "s.column", "s.issue_type", "step", "action", "confidence"))
    columns = facts.profile.select("dataset", "position", "column")
    joined = columns.join(F.broadcast(applied), ["dataset", "column"], "left")
    drops = Window.partitionBy("dataset", "column")
    number = Window.partitionBy("dataset").orderBy("position", "step")
    return (
        joined.withColumn("dropped", F.max(F.expr("issue_type <=> 'empty_column'")).over(drops))
        .where("NOT dropped OR issue_type = 'empty_column'")
        .withColumn("place", F.row_number().over(number))
        .selectExpr(
            "format_string('lineage_%03d', place) AS lineage_id",
            "dataset AS source_dataset", "column AS source_column",
            "CASE WHEN NOT dropped THEN column END AS output_column",
            "CASE WHEN dropped THEN 'dropped_empty_column' WHEN issue_type IS NULL"
            " THEN 'unchanged' ELSE action END AS transformation",
            "issue_type AS rule", "confidence"))


def data_dictionary(
    cleaned: Facts, lineage_rows: DataFrame, cleanings: list[Cleaning], decisions: DataFrame,
) -> DataFrame:
    """One row per column of the cleaned datasets."""
    actions = local_table(cleaned.spark, [
        {"dataset": c.dataset, "column": column, "issue_type": issue}
        for c in cleanings for issue, column in c.steps if column is not None],
        "dataset string, column string, issue_type string")
    taken = (
        actions.alias("a").join(F.broadcast(decisions.alias("d")), F.expr(_same_issue("a", "d")))
        .selectExpr("a.dataset", "a.column", "action").groupBy("dataset", "column")
        .agg(F.expr("array_join(sort_array(collect_set(action)), ', ') AS cleaning_actions")))
    first = lineage_rows.groupBy(
        F.expr("source_dataset AS dataset"), F.expr("source_column AS column")).agg(
        F.min("lineage_id").alias("lineage_id"))
    labels = (
        field_roles(cleaned, list(DICTIONARY_LABELS))
        .groupBy("dataset", "column").pivot("platform", list(DICTIONARY_LABELS))
        .agg(F.first("label")).withColumnsRenamed(DICTIONARY_LABELS))
    roles = column_roles(cleaned).selectExpr("dataset", "column", "label AS semantic_role")
    key = ["dataset", "column"]
    return (
        cleaned.profile.join(F.broadcast(roles), key, "left")
        .join(F.broadcast(taken), key, "left").join(F.broadcast(first), key, "left")
        .join(F.broadcast(labels), key, "left")
        .selectExpr(
            "dataset", "clean_name AS column_name", "column AS original_name",
            "inferred_type AS data_type", "semantic_role",
            "concat(initcap(inferred_type), ' column, ', CASE WHEN missing_percentage > 0 THEN"
            " concat(format_string('%.1f', missing_percentage), '% missing') ELSE"
            " 'no missing values' END, '.') AS description",
            "missing_count > 0 AS nullable", "unique_count", "missing_count",
            "missing_percentage", "min", "max", "mean", "median",
            "array_join(example_values, '; ') AS example_values", "cleaning_actions",
            "lineage_id", *DICTIONARY_LABELS.values()))
