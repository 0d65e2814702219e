"""Readiness of datasets for analytics platforms: rule packs over facts tables.

A pack is a list of checks, each a CASE over one wide row of facts per dataset. New packs are
added with ``register_pack``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.operators.facts import Facts
from plumbline.storage import local_table

# Scoring of a pack.
FAIL_PENALTY, WARNING_PENALTY = 15, 5
EXCEL_ROWS = 1_048_576
LONG_TEXT = 200

ROLE = (
    "CASE WHEN inferred_type = 'id' THEN 'primary_key'"
    " WHEN inferred_type IN ('date', 'datetime') THEN 'date_dimension'"
    " WHEN inferred_type IN ('integer', 'float') THEN 'measure'"
    " ELSE 'dimension_attribute' END"
)
ROLE_LABELS = {
    "primary_key": "Identifier", "date_dimension": "Date", "measure": "Measure",
    "dimension_attribute": "Dimension",
}

# Checks that depend on a link to another dataset use the status found there.
FOREIGN_KEYS = ("foreign_key_relationships", None)


def _warn(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 'warning' ELSE 'pass' END"


def _fail(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 'fail' ELSE 'pass' END"


def _need(condition: str, otherwise: str = "warning") -> str:
    return f"CASE WHEN {condition} THEN 'pass' ELSE '{otherwise}' END"


_MIXED = _warn("mixed_data_types > 0")
_DATES = _warn("invalid_dates > 0")
_CARDINALITY = _warn("high_cardinality > 0")
_COPIES = _warn("duplicate_rows > 0")
_MEASURES, _ATTRIBUTES = _need("measures > 0"), _need("attributes > 0")
_OUTLIERS = _warn("outlier > 0")
_KEYS = _need("keys > 0", "not_applicable")
_SPARSE = _warn("mean_missing > 5.0D")
_KINDS = [
    ("numeric_columns", _need("measures > 0", "not_applicable")),
    ("categorical_columns", _need("attributes > 0", "not_applicable")),
    ("datetime_columns", _need("date_columns > 0", "not_applicable")),
]

PACKS: dict[str, list[tuple[str, str | None]]] = {
    "power_bi": [
        ("mixed_data_types", _MIXED), ("date_validity", _DATES),
        ("duplicate_keys", _fail("repeated_keys > 0")),
        ("high_cardinality_fields", _CARDINALITY),
        ("date_dimension_present", _need("date_columns > 0")),
        ("measures_identified", _MEASURES), ("dimension_attributes_identified", _ATTRIBUTES),
        ("currency_percentage_representation", "'pass'"), FOREIGN_KEYS, ("table_role", "'pass'"),
    ],
    "sql": [
        ("primary_key_candidates", _need("keys > 0")),
        ("foreign_key_candidates", _need("links > 0", "not_applicable")),
        ("duplicates", _fail("duplicate_id > 0")), ("nullability", _fail("keys_missing > 0")),
        ("data_types", _MIXED), FOREIGN_KEYS, ("multi_value_cells", _warn("multi_value > 0")),
        ("normalization_concerns", _warn("near_constant > 0")),
    ],
    "tableau": [
        ("potential_measures", _MEASURES), ("potential_dimensions", _ATTRIBUTES),
        ("potential_date_field", _need("date_columns > 0")),
        ("potential_geographic_field", _need("geographic > 0", "not_applicable")),
        ("data_type_consistency", _MIXED), ("duplicate_records", _COPIES),
        ("high_cardinality_fields", _CARDINALITY),
        ("aggregation_safety", _warn("near_unique_measures > 0")),
    ],
    "alteryx": [
        ("schema_stability", _warn("constant_column > 0 OR empty_columns > 0")),
        ("field_naming", _warn("special_names > 0")), ("numeric_parsing", _MIXED),
        ("date_parsing", _warn("invalid_date + future_date + ambiguous_date_format > 0")),
        ("text_normalization", _warn("whitespace_formatting > 0")),
        ("join_keys", "CASE WHEN duplicate_id > 0 THEN 'fail' WHEN keys > 0 THEN 'pass'"
                      " ELSE 'warning' END"),
    ],
    "excel": [
        ("single_header_row", _fail("duplicate_names > 0 OR unnamed_headers > 0")),
        ("blank_rows_columns", _warn("empty_row_count > 0 OR empty_column_count > 0")),
        ("mixed_types", _MIXED), ("date_values", _DATES),
        ("long_text_fields", _warn("long_text > 0")), ("duplicate_rows", _COPIES),
        ("data_volume", _fail(f"row_count > {EXCEL_ROWS}")),
    ],
    "looker": [
        ("potential_measures", _MEASURES), ("potential_dimensions", _ATTRIBUTES),
        ("potential_keys", _need("keys > 0")), ("grain_concern", _COPIES),
        ("relationship_concern", None), ("naming_consistency", _warn("not_snake_case > 0")),
        ("high_cardinality_fields", _CARDINALITY),
    ],
    "looker_studio": [
        ("connector_friendly_headers", _warn("unsafe_names > 0")),
        ("primitive_data_types", _MIXED),
        ("date_fields", "CASE WHEN invalid_dates > 0 THEN 'warning' WHEN date_columns > 0"
                        " THEN 'pass' ELSE 'not_applicable' END"),
        ("numeric_fields", _MEASURES), ("categorical_fields", _ATTRIBUTES),
        ("missing_values", _warn("mean_missing > 10.0D")), ("aggregation_usability", _MEASURES),
    ],
    "qlik": [
        ("key_consistency", _fail("duplicate_id > 0")),
        ("field_naming", _need("links = 0 OR keys > 0")), FOREIGN_KEYS,
        ("synthetic_key_risk", _warn("links >= 2 AND near_unique_links > 0")),
        ("circular_relationship_risk", "'not_applicable'"),
        ("duplicate_fields", _fail("duplicate_names > 0")),
    ],
    "python": [
        *_KINDS, ("missing_values", _SPARSE), ("outliers", _OUTLIERS),
        ("duplicate_records", _COPIES), ("identifiers", _KEYS),
        ("constant_columns", _warn("constant_column > 0")),
        ("high_cardinality_fields", _CARDINALITY),
        ("possible_target_variable", _need("targets > 0", "not_applicable")),
        ("possible_feature_variables", "'pass'"),
    ],
    "r": [
        *_KINDS, ("missingness", _SPARSE), ("duplicates", _COPIES), ("outliers", _OUTLIERS),
        ("identifiers", _KEYS), ("high_cardinality_fields", _CARDINALITY),
    ],
}
_ISSUES = [
    "mixed_data_types", "high_cardinality", "duplicate_id", "duplicate_rows", "outlier",
    "constant_column", "invalid_date", "future_date", "ambiguous_date_format",
    "whitespace_formatting",
]

_KEY = f"{ROLE} = 'primary_key'"
_LINK = f"is_link AND NOT {_KEY}"
# Label of a column in each pack; the first that applies.
FIELD_LABELS: dict[str, list[tuple[str, str]]] = {
    "power_bi": [(_KEY, "'Key'"), ("true", ROLE)],
    "sql": [(_LINK, "'Foreign Key Candidate'"), (_KEY, "'Primary Key Candidate'"),
            (f"{ROLE} = 'measure'", "'Fact Candidate'"),
            (f"{ROLE} = 'dimension_attribute'", "'Dimension Candidate'")],
    "tableau": [("is_geographic", "'Potential Geographic Field'"),
                (f"{ROLE} = 'date_dimension'", "'Potential Date Field'"),
                (f"{ROLE} = 'dimension_attribute'", "'Potential Dimension'"),
                (f"{ROLE} = 'measure'", "'Potential Measure'")],
    "alteryx": [(_KEY, "'Join Key'")],
    "excel": [("column RLIKE '^Unnamed:|^\\\\s*$'", "'Header Problem'"),
              (f"text_extra IS NOT NULL AND longest_example > {LONG_TEXT}", "'Long Text'")],
    "looker": [(_KEY, "'Potential Key'"), (f"{ROLE} = 'measure'", "'Potential Measure'"),
               (f"{ROLE} = 'dimension_attribute'", "'Potential Dimension'")],
    "looker_studio": [(f"{ROLE} = 'date_dimension'", "'Date Dimension'"),
                      (f"{ROLE} = 'dimension_attribute'", "'Dimension'"),
                      (f"{ROLE} = 'measure'", "'Metric'")],
    "qlik": [(_KEY, "'Key Candidate'")],
    "python": [("is_target", "'Target Candidate'"), (_KEY, "'Identifier'")],
    "r": [(f"{ROLE} = 'dimension_attribute'", "'Factor Candidate'"), (_KEY, "'Identifier'")],
}


def register_pack(name: str, checks: list[tuple[str, str | None]],
                  labels: list[tuple[str, str]] | None = None) -> None:
    """Add a pack: (check name, SQL over the readiness facts giving its status)."""
    PACKS[name] = checks
    FIELD_LABELS[name] = labels or []


def column_roles(facts: Facts) -> DataFrame:
    labels = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ROLE_LABELS.items())
    return facts.profile.selectExpr(
        "dataset", "position", "column", "inferred_type", f"{ROLE} AS role").selectExpr(
        "*", f"CASE role {labels} END AS label")


def table_roles(facts: Facts) -> DataFrame:
    counted = column_roles(facts).groupBy("dataset").agg(*map(F.expr, [
        "count_if(role = 'measure') AS measures",
        "count_if(role IN ('dimension_attribute', 'primary_key')) AS attributes"]))
    return counted.selectExpr(
        "dataset", "measures", "attributes",
        "CASE WHEN measures + attributes = 0 THEN 'unclassified'"
        " WHEN measures > attributes THEN 'fact' ELSE 'dimension' END AS table_role")


def readiness_facts(facts: Facts, issues: DataFrame) -> DataFrame:
    """One wide row per dataset, all that the packs look at."""
    copies = "count(*) - count(DISTINCT column)"
    columns = facts.profile.groupBy("dataset").agg(*map(F.expr, [
        f"count_if({_KEY}) AS keys", f"count_if({_LINK}) AS links",
        f"count_if({ROLE} = 'measure') AS measures",
        f"count_if({ROLE} = 'dimension_attribute') AS attributes",
        f"count_if({ROLE} = 'date_dimension') AS date_columns",
        f"count_if({_KEY} AND value_count > unique_count) AS repeated_keys",
        f"count_if({_KEY} AND missing_count > 0) AS keys_missing",
        f"count_if(NOT ({_KEY}) AND NOT is_link AND try_divide(n_multi_value, value_count) > 0.5D)"
        " AS multi_value",
        "count_if(near_constant) AS near_constant",
        f"count_if({ROLE} = 'measure' AND unique_percentage >= 95) AS near_unique_measures",
        f"count_if({_LINK} AND unique_percentage >= 90) AS near_unique_links",
        "coalesce(sum(date_extra.invalid_count), 0) AS invalid_dates",
        "count_if(is_geographic) AS geographic", "count_if(is_target) AS targets",
        "count_if(missing_count = row_count AND row_count > 0) AS empty_columns",
        "count_if(column RLIKE '[^A-Za-z0-9_]') AS special_names",
        "count_if(NOT column RLIKE '^[a-z0-9_]+$') AS not_snake_case",
        "count_if(NOT column RLIKE '^[A-Za-z0-9_ ]+$') AS unsafe_names",
        "count_if(column RLIKE '^Unnamed:|^\\\\s*$') AS unnamed_headers",
        f"{copies} AS duplicate_names", "avg(missing_percentage) AS mean_missing",
        f"count_if(text_extra IS NOT NULL AND longest_example > {LONG_TEXT}) AS long_text"]))
    counted = issues.groupBy("dataset").agg(*map(F.expr, [
        f"count_if(issue_type = '{i}') AS {i}" for i in _ISSUES]))
    wide = facts.datasets.join(F.broadcast(columns), "dataset", "left").join(
        F.broadcast(counted), "dataset", "left")
    return wide.na.fill(0, _ISSUES)


def readiness_checks(
    facts: Facts, issues: DataFrame, relationships: DataFrame | None = None,
    packs: list[str] | None = None,
) -> DataFrame:
    """(dataset, platform, check_name, status) of the selected packs."""
    chosen = packs or list(PACKS)
    unknown = sorted(set(chosen) - set(PACKS))
    if unknown:
        raise ValueError(f"Unknown platform(s): {unknown}. Known: {sorted(PACKS)}")
    wide = readiness_facts(facts, issues)
    if relationships is not None:
        wide = wide.join(F.broadcast(
            relationships.withColumnRenamed("status", "link_status")), "dataset", "left")
    else:
        wide = wide.withColumn("link_status", F.lit(None).cast("string"))
    rows = ", ".join(
        f"named_struct('platform', '{pack}', 'position', {i}, 'check_name', '{check}',"
        f" 'status', {'link_status' if status is None else status})"
        for pack in chosen for i, (check, status) in enumerate(PACKS[pack]))
    return wide.selectExpr("dataset", f"inline(array({rows}))").where("status IS NOT NULL")


def score_packs(checks: DataFrame) -> DataFrame:
    """(dataset, platform, score, status) from checks."""
    counted = checks.groupBy("dataset", "platform").agg(*map(F.expr, [
        "count_if(status = 'fail') AS fails", "count_if(status = 'warning') AS warnings"]))
    return counted.selectExpr(
        "dataset", "platform",
        f"greatest(0, 100 - {FAIL_PENALTY} * fails - {WARNING_PENALTY} * warnings) AS score",
        "CASE WHEN fails > 1 THEN 'NOT_READY' WHEN fails = 1 THEN 'NEEDS_CLEANING'"
        " WHEN warnings > 0 THEN 'READY_WITH_WARNINGS' ELSE 'READY' END AS status")


def overall_readiness(scores: DataFrame) -> DataFrame:
    return scores.groupBy("dataset").agg(
        F.expr("cast(bround(avg(score)) AS int) AS analytics_readiness"))


def field_roles(facts: Facts, packs: list[str] | None = None) -> DataFrame:
    """(dataset, column, platform, label)."""
    rows = ", ".join(
        f"named_struct('platform', '{pack}', 'label', CASE "
        + " ".join(f"WHEN {condition} THEN {label}" for condition, label in FIELD_LABELS[pack])
        + " END)" for pack in (packs or list(PACKS)) if FIELD_LABELS.get(pack))
    return facts.profile.selectExpr(
        "dataset", "position", "column", f"inline(array({rows}))").where("label IS NOT NULL")


def refresh_readiness(earlier: DataFrame, after: DataFrame) -> DataFrame:
    """Replace the checks of cleaned datasets, carrying their foreign-key checks over.

    Other datasets keep their earlier checks.
    """
    renewed = F.broadcast(after.select("dataset", "platform").distinct())
    kept = earlier.join(renewed, ["dataset", "platform"], "left_anti")
    carried = earlier.where("check_name = 'foreign_key_relationships'").join(
        renewed, ["dataset", "platform"], "left_semi")
    fresh = after.where("check_name != 'foreign_key_relationships'")
    return kept.unionByName(fresh).unionByName(carried)


def run_readiness(scores: DataFrame) -> DataFrame:
    """Mean readiness over the datasets of a run."""
    return overall_readiness(scores).agg(
        F.expr("cast(bround(avg(analytics_readiness)) AS int) AS analytics_readiness"))

