"""Cleaning: the fixes the policy allows, as one projection and one shuffle.

The order is fixed (drop empty columns, drop copies, whitespace, placeholders, categories,
dates, amounts, drop rows that became copies). Value fixes only look at their own cell, so
they fuse into one projection per table; and rows equal before normalisation are equal after
it, so both removals of copies give the same rows as one removal at the end. The change log
replays the steps separately and is only computed when it is read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from plumbline.functions import dates, numbers, text
from plumbline.operators.columns import ROW_ID, data_columns
from plumbline.operators.facts import Facts, row_fingerprint
from plumbline.storage import local_table

VALUE_STEPS = [
    "whitespace_formatting", "missing_value_placeholder", "category_inconsistency",
    "invalid_date", "currency_value",
]
POST_NORMALISATION = "duplicate_rows_post_normalization"
CHANGE_COLUMNS = [
    "dataset", ROW_ID, "column", "issue_type", "original_value", "new_value"]


@dataclass
class Cleaning:
    """A cleaned dataset and what was done to it; both are lazy."""

    dataset: str
    before: DataFrame
    cleaned: DataFrame
    steps: list[tuple[str, str | None]]
    dropped: list[str]
    _unique: DataFrame = field(repr=False)
    _normalised: DataFrame = field(repr=False)
    _trail: list[tuple[str, str, str, str]] = field(repr=False)

    @property
    def changes(self) -> DataFrame:
        """One row per changed cell, removed row and dropped column, by raw row id."""
        spark = self.before.sparkSession
        schema = (f"dataset string, {ROW_ID} bigint, column string, issue_type string, "
                  "original_value string, new_value string")
        result = local_table(spark, [
            {"dataset": self.dataset, "column": c, "issue_type": "empty_column",
             "original_value": c} for c in self.dropped], schema)
        if self._trail:
            steps = ", ".join(
                f"named_struct('column', {text.literal(c)}, 'issue_type', '{issue}',"
                f" 'original_value', {old}, 'new_value', {new})"
                for c, issue, old, new in self._trail)
            result = result.unionByName(
                self._normalised.selectExpr(ROW_ID, f"inline(array({steps}))")
                .where("NOT original_value <=> new_value")
                .withColumn("dataset", F.lit(self.dataset)))
        if ("duplicate_rows", None) in self.steps:
            result = result.unionByName(self._removed(
                self.before, self._unique, "duplicate_rows", "<duplicate row>"))
        if self._trail:
            result = result.unionByName(self._removed(
                self._normalised, self.cleaned, POST_NORMALISATION,
                "<duplicate row (post-normalization)>"))
        return result.select(*CHANGE_COLUMNS)

    def _removed(self, before, after, issue, label) -> DataFrame:
        gone = before.select(ROW_ID).join(after.select(ROW_ID), ROW_ID, "left_anti")
        return gone.selectExpr(
            f"{text.literal(self.dataset)} AS dataset", ROW_ID, "cast(null AS string) AS column",
            f"'{issue}' AS issue_type", f"'{label}' AS original_value",
            "cast(null AS string) AS new_value")


def drop_copies(df: DataFrame) -> DataFrame:
    """Keep the first of identical rows (missing equals missing).

    The lowest row id is found by a grouped minimum, so copies collapse before the shuffle and
    no group is ever sorted or held in one task.
    """
    columns = data_columns(df)
    maps = {c for c in columns if "map<" in df.schema[c].dataType.simpleString()}
    keys = [F.expr(f"to_json({text.column(c)})").alias(f"__key_{i}") if c in maps
            else F.col(text.column(c)) for i, c in enumerate(columns)]
    kept = df.groupBy(*keys).agg(
        F.min(ROW_ID).alias(ROW_ID), *(F.first(text.column(c)).alias(c) for c in maps))
    return kept.select(*(text.column(c) for c in df.columns))


def whitespace_fix(c: str) -> str:
    return text.collapse_whitespace(c)


def placeholder_fix(c: str) -> str:
    return f"CASE WHEN NOT {text.is_placeholder(c)} THEN {c} END"


def _literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spelling_fix(c: str, replacements: dict[str, str]) -> str:
    if not replacements:
        return c
    cases = " ".join(f"WHEN {_literal(a)} THEN {_literal(b)}" for a, b in replacements.items())
    return f"CASE {c} {cases} ELSE {c} END"


def date_fix(df: DataFrame, source: str, into: str, convention: str | None) -> DataFrame:
    """Invalid dates become missing, readable ones ISO; ambiguous cells stay as they are."""
    known = f"'{convention}'" if convention else "cast(null AS string)"
    kept = [text.column(n) for n in df.columns]
    read = dates.add_reading(df, source, f"{into}_read").selectExpr(
        "*", f"{dates.resolve(f'{into}_read', known)} AS {into}_done")
    return read.selectExpr(*kept, f"""CASE {into}_done.status WHEN 'invalid' THEN null
        WHEN 'parsed' THEN CASE WHEN {into}_done.iso = {text.strip(text.column(source))}
            THEN {text.column(source)} ELSE {into}_done.iso END
        ELSE {text.column(source)} END AS {into}""")


def currency_fix(df: DataFrame, source: str, into: str) -> DataFrame:
    """Readable amounts become plain number text; everything else stays as it is."""
    c = text.column(source)
    kept = [text.column(n) for n in df.columns]
    return numbers.add_currency(df, source, f"{into}_read").selectExpr(
        *kept, f"""CASE WHEN {into}_read.confidence = 'HIGH' AND {into}_read.text != {text.strip(c)}
        THEN {into}_read.text ELSE {c} END AS {into}""")


def canonical_spellings(
    df: DataFrame, groups: dict[str, list[list[str]]], earlier: dict[str, str],
    without_copies: bool,
) -> dict[str, dict[str, str]]:
    """Per column: spelling -> the most frequent spelling of its group (ties: sorted first).

    Counted after the earlier fixes and over distinct rows where copies get removed. Rows
    travel as fingerprints, and only the few spellings in question reach the driver.
    """
    if not groups:
        return {}
    cells = ", ".join(
        f"named_struct('column', {text.literal(c)}, 'value', {earlier[c]})" for c in groups)
    rows = df
    if without_copies:
        needed = [text.column(c) for c in groups]
        rows = df.selectExpr(*needed, *row_fingerprint(df)).distinct()
    spelled = {v for column_groups in groups.values() for g in column_groups for v in g}
    counts: dict[str, dict[str, int]] = {}
    for r in (rows.selectExpr(f"inline(array({cells}))").where(F.col("value").isin(list(spelled)))
              .groupBy("column", "value").count().collect()):
        counts.setdefault(r.column, {})[r.value] = r["count"]
    result = {}
    for c, column_groups in groups.items():
        replacements = {}
        for group in column_groups:
            present = [v for v in group if v in counts.get(c, {})]
            if present:
                best = max(present, key=lambda v: counts[c][v])
                replacements.update({v: best for v in present if v != best})
        result[c] = replacements
    return result


def apply_cleaning(
    facts: Facts, dataset: str, decisions: DataFrame, skip_mixed_currency: bool = False,
) -> Cleaning:
    """Apply every decided fix to one dataset."""
    df = facts.frames[dataset]
    decided = decisions.where(F.col("dataset") == dataset).select(
        "issue_type", "column", "status", "act_order").collect()
    mixed = {r.column for r in decided if r.issue_type == "currency_inconsistency"}
    steps = [
        (r.issue_type, r.column)
        for r in sorted((r for r in decided if r.status == "apply"), key=lambda r: r.act_order)
        if not (skip_mixed_currency and r.issue_type == "currency_value" and r.column in mixed)]
    profile = {c["column"]: c for c in facts.of(dataset)}
    dropped = [c for issue, c in steps if issue == "empty_column"]
    removes_copies = ("duplicate_rows", None) in steps

    base = df.drop(*dropped)
    by_issue = {issue: [c for i, c in steps if i == issue and c not in dropped]
                for issue in VALUE_STEPS}
    simple = {c: text.column(c) for cs in by_issue.values() for c in cs}
    for c in by_issue["whitespace_formatting"]:
        simple[c] = whitespace_fix(simple[c])
    for c in by_issue["missing_value_placeholder"]:
        simple[c] = placeholder_fix(simple[c])
    spellings = canonical_spellings(
        df, {c: profile[c]["categorical_extra"]["potential_inconsistencies"]
             for c in by_issue["category_inconsistency"]}, simple, removes_copies)

    def normalise(frame: DataFrame) -> tuple[DataFrame, list]:
        """Add one column per value step; returns the frame and the trail of steps."""
        current = {c: c for c in data_columns(frame)}
        trail = []
        for issue in VALUE_STEPS:
            added = {}
            for c in by_issue[issue]:
                old, new = current[c], f"__v{profile[c]['position']}_{VALUE_STEPS.index(issue)}"
                if issue == "whitespace_formatting":
                    added[new] = whitespace_fix(text.column(old))
                elif issue == "missing_value_placeholder":
                    added[new] = placeholder_fix(text.column(old))
                elif issue == "category_inconsistency":
                    added[new] = spelling_fix(text.column(old), spellings[c])
                elif issue == "invalid_date":
                    frame = date_fix(frame, old, new, profile[c]["date_convention"])
                else:
                    frame = currency_fix(frame, old, new)
                trail.append((c, issue, text.column(old), new))
                current[c] = new
            if added:
                frame = frame.selectExpr("*", *(f"{e} AS {n}" for n, e in added.items()))
        return frame, trail

    def final(frame: DataFrame, trail: list) -> DataFrame:
        last = {c: new for c, _, _, new in trail}
        return frame.selectExpr(ROW_ID, *(
            f"{last.get(c, text.column(c))} AS {text.column(c)}" for c in data_columns(base)))

    cleaned = final(*normalise(base))
    if removes_copies or any(by_issue.values()):
        cleaned = drop_copies(cleaned)
    unique = drop_copies(base) if removes_copies else base
    normalised, trail = normalise(unique)
    return Cleaning(dataset, df, cleaned, steps, dropped, unique, normalised, trail)


def cleaning_log(cleaning: Cleaning, decisions: DataFrame) -> DataFrame:
    """One row per applied step with the number of changes it made."""
    spark = cleaning.before.sparkSession
    steps = local_table(spark, [
        {"dataset": cleaning.dataset, "issue_type": i, "column": c, "step": n}
        for n, (i, c) in enumerate(cleaning.steps)],
        "dataset string, issue_type string, column string, step int")
    counted = cleaning.changes.groupBy("dataset", "issue_type", "column").agg(
        F.expr("count(*) AS changed"))
    decided = decisions.select("dataset", "issue_type", "column", "confidence", "action")
    same = (F.col("s.dataset") == F.col("o.dataset")) & (
        F.col("s.issue_type") == F.col("o.issue_type")) & F.col("s.column").eqNullSafe(F.col("o.column"))
    applied = (
        steps.alias("s").join(F.broadcast(decided.alias("o")), same).selectExpr("s.*", "confidence", "action")
        .alias("s").join(F.broadcast(counted.alias("o")), same, "left")
        .selectExpr("s.dataset", "s.step", "s.issue_type", "s.column", "confidence", "action",
                    "s.issue_type AS rule", "coalesce(changed, 0) AS affected_count"))
    late = counted.where(F.col("issue_type") == POST_NORMALISATION).selectExpr(
        "dataset", f"{len(cleaning.steps)} AS step", "'duplicate_rows' AS issue_type", "column",
        "'HIGH' AS confidence", "'Drop rows that became identical' AS action",
        f"'{POST_NORMALISATION}' AS rule", "changed AS affected_count")
    return applied.unionByName(late)
