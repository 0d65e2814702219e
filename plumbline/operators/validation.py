"""Validation of a dataset and the gate that decides whether it is published."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.functions import dates, numbers
from plumbline.functions.text import column as quoted, literal
from plumbline.operators.columns import first_named
from plumbline.operators.facts import Facts

# Tolerances of the checks.
TOLERANCE = 1e-6
FAIL_SHARE = 0.5
STATUS_ORDER = ["pass", "warning", "fail"]

BUSINESS_RULES = [
    "end_date_before_start_date", "total_not_equal_subtotal_plus_tax",
    "revenue_not_equal_quantity_times_price",
]


def _number(df: DataFrame, name: str) -> str:
    c = quoted(name)
    if df.schema[name].dataType.typeName() == "string":
        return f"({numbers.to_number(c)})"
    return f"cast({c} AS double)"


def _moment(df: DataFrame, name: str, into: str, convention: str | None) -> tuple[DataFrame, str]:
    """A date or text column as a timestamp: ISO with its time, else any readable date."""
    c = quoted(name)
    if df.schema[name].dataType.typeName() != "string":
        return df, f"try_cast({c} AS timestamp)"
    df = dates.add_reading(df, name, into)
    known = literal(convention) if convention else "cast(null AS string)"
    return df, (f"coalesce(try_cast({c} AS timestamp),"
                f" try_cast({dates.resolve(into, known)}.iso AS timestamp))")


def business_rules(
    dataset: str, df: DataFrame, conventions: dict[str, str | None] | None = None) -> DataFrame:
    """Violations and unverifiable rows of each rule, in one pass without a shuffle of rows.

    Columns are found by name; a rule whose columns are absent counts nothing. Text that is
    no number or no date makes a row unverifiable; ``conventions`` tells how a column's
    ambiguous dates are read.
    """
    names = [c for c in df.columns if not c.startswith("_row_id")]
    tests = {}
    start, end = first_named(names, "start_date"), first_named(names, "end_date")
    if start and end:
        known = conventions or {}
        df, a = _moment(df, start, "_start_reading", known.get(start))
        df, b = _moment(df, end, "_end_reading", known.get(end))
        tests[BUSINESS_RULES[0]] = (f"{b} < {a}", f"{a} IS NULL OR {b} IS NULL")
    for rule, parts, combine in (
        (BUSINESS_RULES[1], ("subtotal", "tax", "total"), "+"),
        (BUSINESS_RULES[2], ("quantity", "unit_price", "revenue"), "*"),
    ):
        found = [first_named(names, p) for p in parts]
        if all(found):
            x, y, z = (_number(df, c) for c in found)
            tests[rule] = (f"abs({x} {combine} {y} - {z}) > {TOLERANCE}D",
                           f"{x} IS NULL OR {y} IS NULL OR {z} IS NULL")
    counts = []
    for i, rule in enumerate(BUSINESS_RULES):
        bad, unknown = tests.get(rule, ("false", "false"))
        counts += [f"count_if({bad}) AS bad{i}", f"count_if({unknown}) AS unknown{i}"]
    rows = ", ".join(
        f"named_struct('rule', '{rule}', 'violations', bad{i}, 'unverifiable', unknown{i})"
        for i, rule in enumerate(BUSINESS_RULES))
    return df.agg(F.expr("count(*) AS rows"), *map(F.expr, counts)).selectExpr(
        f"{literal(dataset)} AS dataset", "rows", f"inline(array({rows}))")


def validate(facts: Facts) -> DataFrame:
    """(dataset, check_name, status, detail): every check of every dataset."""
    rules = None
    for dataset, df in facts.frames.items():
        one = business_rules(
            dataset, df, {c["column"]: c["date_convention"] for c in facts.of(dataset)})
        rules = one if rules is None else rules.unionByName(one)
    broken = rules.groupBy("dataset").agg(*map(F.expr, [
        "sum(violations) AS violations", "sum(unverifiable) AS unverifiable"]))
    columns = facts.profile.groupBy("dataset").agg(*map(F.expr, [
        "count(*) - count(DISTINCT column) AS duplicate_names",
        "count_if(empty) AS fully_empty",
        "count_if(missing_count * 2 > row_count) AS mostly_empty",
        "coalesce(sum(CASE WHEN inferred_type = 'id' THEN value_count - unique_count END), 0)"
        " AS repeated_ids",
        "count_if(kind IN ('integer', 'float', 'decimal') AND range_low IS NOT NULL"
        " AND out_of_range > 0) AS out_of_range_columns",
        "count_if(coalesce(numeric_extra.outlier_count, 0) > 0) AS outlier_columns"]))
    table = facts.datasets.join(F.broadcast(columns), "dataset").join(
        F.broadcast(broken), "dataset", "left")
    checks = [
        ("row_integrity", "CASE WHEN row_count = 0 THEN 'fail' ELSE 'pass' END", "row_count"),
        ("column_integrity",
         "CASE WHEN column_count = 0 OR duplicate_names > 0 THEN 'fail' ELSE 'pass' END",
         "column_count"),
        ("missingness", "CASE WHEN fully_empty > 0 THEN 'fail' WHEN mostly_empty > 0"
         " THEN 'warning' ELSE 'pass' END", "mostly_empty"),
        ("duplicates", "CASE WHEN duplicate_row_count > 0 THEN 'fail' ELSE 'pass' END",
         "duplicate_row_count"),
        ("id_uniqueness", "CASE WHEN repeated_ids > 0 THEN 'fail' ELSE 'pass' END",
         "repeated_ids"),
        ("business_rules", "CASE WHEN coalesce(violations, 0) = 0 THEN 'pass'"
         f" WHEN violations / greatest(row_count, 1) > {FAIL_SHARE}D THEN 'fail'"
         " ELSE 'warning' END", "coalesce(violations, 0)"),
        ("invalid_values", "CASE WHEN out_of_range_columns > 0 THEN 'warning' ELSE 'pass' END",
         "out_of_range_columns"),
        ("outlier_behavior", "CASE WHEN outlier_columns > 0 THEN 'warning' ELSE 'pass' END",
         "outlier_columns"),
        ("schema_integrity", "CASE WHEN column_count < 2 THEN 'warning' ELSE 'pass' END",
         "column_count"),
    ]
    rows = ", ".join(
        f"named_struct('position', {i}, 'check_name', '{n}', 'status', {s}, 'detail',"
        f" cast({d} AS bigint))" for i, (n, s, d) in enumerate(checks))
    return (
        table.selectExpr("dataset", "row_count", "duplicate_names", f"inline(array({rows}))")
        # without rows or with repeated names there is nothing further to check
        .where("position < 2 OR (row_count > 0 AND duplicate_names = 0)")
        .select("dataset", "check_name", "status", "detail"))


def overall_status(checks: DataFrame) -> DataFrame:
    rank = "array_position(array('pass', 'warning', 'fail'), status)"
    return checks.groupBy("dataset").agg(F.expr(f"max_by(status, {rank}) AS overall_status"))


def data_loss(before: Facts, after: Facts, markers_are_missing: bool = False) -> DataFrame:
    """Date columns whose missing or invalid cells became more.

    With ``markers_are_missing`` a recognised marker such as 'N/A' already counts as missing
    before cleaning.
    """
    marked = "n_date_missing" if markers_are_missing else "0"
    bad = f"missing_count + date_extra.invalid_count + CASE WHEN kind = 'text' THEN {marked} ELSE 0 END"
    old = before.profile.where("date_extra IS NOT NULL AND row_count > 0").selectExpr(
        "dataset", "column", f"{bad} AS bad_before")
    new = after.profile.where("date_extra IS NOT NULL").selectExpr(
        "dataset", "column", f"{bad} AS bad_after")
    return old.join(F.broadcast(new), ["dataset", "column"]).where("bad_after > bad_before")


def gate(before: Facts, after: Facts, checks: DataFrame,
         markers_are_missing: bool = False) -> DataFrame:
    """(dataset, overall_status, lossy_columns, published)."""
    losses = data_loss(before, after, markers_are_missing).groupBy("dataset").agg(
        F.expr("count(*) AS lossy_columns"))
    return overall_status(checks).join(F.broadcast(losses), "dataset", "left").selectExpr(
        "dataset", "overall_status", "coalesce(lossy_columns, 0) AS lossy_columns",
        "overall_status != 'fail' AND lossy_columns IS NULL AS published")
