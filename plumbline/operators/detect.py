"""Issue detection: rules over the profile, one row per issue found.

Detectors read profile tables (a row per column), so they cost nothing next to the profile
itself; only examples go back to the value-frequency table.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window, functions as F

from plumbline.functions import text
from plumbline.operators.columns import first_named
from plumbline.operators.facts import Facts
from plumbline.operators.frequencies import signal
from plumbline.operators.neardup import near_duplicates, pair_evidence
from plumbline.storage import local_table

ISSUE_SCHEMA = (
    "dataset string, column string, issue_type string, severity string, "
    "affected_count bigint, description string"
)
EVIDENCE_SCHEMA = (
    "dataset string, row_a bigint, row_b bigint, similarity double, matching_fields array<string>, "
    "conflicting_fields array<string>, confidence string, recommended_action string"
)
EXAMPLES = 5

_TEXT = "kind = 'text'"
_FREE_TEXT = f"{_TEXT} AND inferred_type IN ('string', 'categorical')"
_RATIO = "try_divide(n_numeric_like, value_count)"
_MONEY = f"{_TEXT} AND value_count > 0 AND (is_money OR try_divide(n_money_hint, value_count) > 0.2D)"
_GROUPS = "categorical_extra.potential_inconsistencies"
_CURRENCIES = (
    "filter(array(" + ", ".join(
        f"CASE WHEN {signal(code, 'seen')} THEN '{code}' END" for code in ("EUR", "GBP", "INR", "USD"))
    + "), x -> x IS NOT NULL)"
)
_Q = "numeric_extra"
_IQR = f"({_Q}.q75 - {_Q}.q25)"
_EXTREME = f"(min < {_Q}.q25 - 3 * {_IQR} OR max > {_Q}.q75 + 3 * {_IQR})"
_SLASHES = {k: signal(f"slash_{k}", "seen") for k in ("day_first", "month_first", "either")}

# (issue type, severity, condition, affected count, description); the column name is
# {column}, the affected count {n}
RULES = [
    ("missing_value_placeholder", "'medium'",
     f"{_TEXT} AND n_placeholder > 0 AND n_placeholder < value_count", "n_placeholder",
     "Column '{column}': {n} value(s) look like placeholders for missing data"),
    ("duplicate_id", "'critical'",
     "inferred_type = 'id' AND value_count > unique_count", "value_count - unique_count",
     "Identifier '{column}': {n} repeated value(s)"),
    ("mixed_data_types", "'medium'",
     f"{_FREE_TEXT} AND {_RATIO} >= 0.7D AND n_numeric_like < value_count",
     "value_count - n_numeric_like",
     "Column '{column}' is mostly numeric but {n} value(s) are not"),
    ("category_inconsistency", "'low'", f"size({_GROUPS}) > 0",
     f"size(flatten({_GROUPS}))",
     "Column '{column}': {n} spellings of the same categories"),
    ("whitespace_formatting", "'low'",
     f"{_TEXT} AND inferred_type != 'id' AND n_whitespace > 0", "n_whitespace",
     "Column '{column}': {n} value(s) with stray whitespace"),
    ("invalid_date", "'high'", "date_extra.invalid_count > 0", "date_extra.invalid_count",
     "Column '{column}': {n} value(s) are not dates"),
    ("future_date", "'medium'", "date_extra.future_count > 0", "date_extra.future_count",
     "Column '{column}': {n} date(s) lie in the future"),
    ("ambiguous_date", "'medium'", "date_extra.ambiguous_count > 0",
     "date_extra.ambiguous_count",
     "Column '{column}': {n} date(s) can be read as DD/MM or MM/DD"),
    ("ambiguous_date_format", "'high'",
     f"{_TEXT} AND date_extra IS NOT NULL AND (({_SLASHES['day_first']} AND "
     f"{_SLASHES['month_first']}) OR (({_SLASHES['day_first']} OR {_SLASHES['month_first']}) "
     f"AND {_SLASHES['either']}))", "0",
     "Column '{column}' mixes date formats"),
    ("impossible_value", "'high'", "range_low IS NOT NULL AND out_of_range > 0", "out_of_range",
     "Column '{column}': {n} value(s) outside the plausible range"),
    ("negative_value", "'medium'", "is_countable AND negative_values > 0", "negative_values",
     "Column '{column}': {n} negative value(s)"),
    ("outlier", f"CASE WHEN {_EXTREME} THEN 'high' ELSE 'medium' END",
     f"{_Q}.outlier_count > 0", f"{_Q}.outlier_count",
     "Column '{column}': {n} statistical outlier(s)"),
    ("constant_column", "'low'", "constant", "row_count",
     "Column '{column}' holds one value in every row"),
    ("empty_column", "'medium'", "empty", "row_count", "Column '{column}' is empty"),
    ("high_cardinality", "'low'",
     "inferred_type = 'string' AND unique_percentage > 95 AND row_count > 10", "unique_count",
     "Column '{column}': {n} distinct values, nearly one per row"),
    ("invalid_email", "'high'",
     f"is_email AND CASE WHEN {_TEXT} THEN n_bad_email ELSE value_count END > 0",
     f"CASE WHEN {_TEXT} THEN n_bad_email ELSE value_count END",
     "Column '{column}': {n} malformed e-mail address(es)"),
    ("currency_value", "'low'", f"{_MONEY} AND money_values > 0", "money_values",
     "Column '{column}': {n} formatted amount(s)"),
    ("currency_inconsistency", "'high'", f"{_MONEY} AND size({_CURRENCIES}) > 1",
     "value_count", "Column '{column}' mixes currencies"),
]


def _sentence(template: str, affected: str) -> str:
    text = template.replace("'", "\\'")
    before, _, rest = text.partition("{column}")
    middle, _, after = rest.partition("{n}")
    if "{n}" not in text:
        return f"concat('{before}', column, '{rest}')"
    return f"concat('{before}', column, '{middle}', cast({affected} AS string), '{after}')"


def column_issues(facts: Facts) -> DataFrame:
    rules = ", ".join(
        f"named_struct('issue_type', '{name}', 'severity', {severity},"
        f" 'found', coalesce({condition}, false), 'affected_count', cast({affected} AS bigint),"
        f" 'description', {_sentence(description, affected)})"
        for name, severity, condition, affected, description in RULES)
    return (
        facts.profile.selectExpr("dataset", "column", f"inline(array({rules}))")
        .where("found").select("dataset", "column", "issue_type", "severity",
                               "affected_count", "description"))


def duplicate_row_issues(facts: Facts) -> DataFrame:
    return facts.datasets.where("duplicate_row_count > 0").selectExpr(
        "dataset", "cast(null AS string) AS column", "'duplicate_rows' AS issue_type",
        "'high' AS severity", "duplicate_row_count AS affected_count",
        "concat(duplicate_row_count, ' exact duplicate row(s)') AS description")


def missing_required(facts: Facts, required: dict[str, Iterable[str]]) -> DataFrame:
    """Required columns that a dataset lacks; names match without case and outer blanks."""
    wanted = local_table(
        facts.spark,
        [{"dataset": d, "required": r} for d, names in required.items() for r in names],
        "dataset string, required string")
    present = facts.profile.selectExpr("dataset", f"lower({text.strip('column')}) AS name")
    missing = wanted.withColumn("name", F.expr(f"lower({text.strip('required')})")).join(
        F.broadcast(present), ["dataset", "name"], "left_anti")
    return missing.groupBy("dataset").agg(*map(F.expr, [
        "cast(null AS string) AS column", "'missing_required_column' AS issue_type",
        "'high' AS severity", "count(*) AS affected_count",
        "concat('Required column(s) missing: ', array_join(sort_array(collect_list(required)), ', '))"
        " AS description"]))


def contact_columns(names: list[str]) -> tuple[str | None, str | None, str | None]:
    """First name, e-mail and phone columns, or Nones when records cannot be matched."""
    person, email, phone = (first_named(names, r) for r in ("person", "email", "phone"))
    return (person, email, phone) if person and (email or phone) else (None, None, None)


def near_duplicate_issues(facts: Facts) -> DataFrame:
    """One issue per dataset with matching record pairs (the pairs are counted, not listed)."""
    found = None
    for dataset, df in facts.frames.items():
        person, email, phone = contact_columns([c["column"] for c in facts.of(dataset)])
        if person is None:
            continue
        pairs = near_duplicates(df, person, email, phone).selectExpr("pair_count").groupBy().agg(
            F.expr("coalesce(sum(pair_count), 0) AS affected_count")).where("affected_count > 0")
        issue = pairs.selectExpr(
            f"{text.literal(dataset)} AS dataset", "cast(null AS string) AS column",
            "'near_duplicate' AS issue_type", "'medium' AS severity", "affected_count",
            "concat(affected_count, ' pair(s) of similar records') AS description")
        found = issue if found is None else found.unionByName(issue)
    return found if found is not None else local_table(facts.spark, [], ISSUE_SCHEMA)


def near_duplicate_evidence(facts: Facts) -> DataFrame:
    """The records behind the near-duplicate issues: rows, similarity, fields that agree or
    differ, confidence and action, per dataset."""
    found = None
    for dataset, df in facts.frames.items():
        person, email, phone = contact_columns([c["column"] for c in facts.of(dataset)])
        if person is None:
            continue
        one = pair_evidence(df, person, email, phone).selectExpr(f"{text.literal(dataset)} AS dataset", "*")
        found = one if found is None else found.unionByName(one)
    return found if found is not None else local_table(facts.spark, [], EVIDENCE_SCHEMA)


def detect_issues(
    facts: Facts, required: dict[str, Iterable[str]] | None = None,
    near_duplicate_search: bool = True,
) -> DataFrame:
    """Every issue of every dataset."""
    issues = column_issues(facts).unionByName(duplicate_row_issues(facts))
    if required:
        issues = issues.unionByName(missing_required(facts, required))
    if near_duplicate_search and any(
            contact_columns([c["column"] for c in facts.of(d)])[0] for d in facts.frames):
        issues = issues.unionByName(near_duplicate_issues(facts))
    return issues


def issue_examples(facts: Facts) -> DataFrame:
    """(dataset, column, issue_type, examples): a few offending values per issue.

    Placeholders, mixed types and e-mails list the smallest values, the others the first
    ones in row order.
    """
    by_value, by_row = "coalesce(txt, cast(num AS string))", "first_row"
    tests = [
        ("missing_value_placeholder", signal("placeholder"), by_value),
        ("mixed_data_types", f"NOT {signal('numeric_like')}", by_value),
        ("invalid_email", signal("bad_email"), by_value),
        ("impossible_value", "num < range_low OR num > range_high", by_row),
        ("negative_value", "num < 0", by_row),
        ("currency_value", f"{signal('money')} AND NOT {signal('numeric_like')}", by_row),
    ]
    ranges = facts.profile.select("cid", "dataset", "column", "range_low", "range_high")
    flagged = column_issues(facts).join(F.broadcast(ranges), ["dataset", "column"]).select(
        "cid", "dataset", "column", "issue_type", "range_low", "range_high")
    offending = " ".join(f"WHEN '{n}' THEN {t}" for n, t, _ in tests)
    sorted_by_value = ", ".join(f"'{n}'" for n, _, o in tests if o == by_value)
    candidates = (
        facts.freq.join(F.broadcast(flagged), "cid")
        .where(f"CASE issue_type {offending} ELSE false END")
        .selectExpr("dataset", "column", "issue_type", f"{by_value} AS value",
                    f"CASE WHEN issue_type IN ({sorted_by_value}) THEN {by_value} END AS sort_text",
                    "first_row"))
    place = Window.partitionBy("dataset", "column", "issue_type").orderBy("sort_text", "first_row")
    return (
        candidates.withColumn("place", F.row_number().over(place)).where(f"place <= {EXAMPLES}")
        .groupBy("dataset", "column", "issue_type")
        .agg(F.expr("transform(sort_array(collect_list(struct(place, value))), x -> x.value)"
                    " AS examples")))
