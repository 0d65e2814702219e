"""The DuckDB statement of every registered query that SQL can express."""

from __future__ import annotations

from plumbline.plans import inputs
from plumbline.plans.oracles import (
    AS_OF, POLICY, TABLES, TYPE, WITH, bad_email, collapse, column_facts, convention,
    copies, currency, date_iso, date_status, issue_query, issues_cte, money_high, strip,
    typed_facts)
from plumbline.plans.queries import DETECTORS, PROFILED, SCORED, TYPED


def _typed(select: str, *datasets: str) -> str:
    return f"{WITH},\n{typed_facts(*datasets)}\n{select}"


_ROLE = ("CASE WHEN typ = 'id' THEN 'primary_key' WHEN typ IN ('date', 'datetime') THEN 'date_dimension'"
         " WHEN typ IN ('integer', 'float') THEN 'measure' ELSE 'dimension_attribute' END")
_LABEL = ("CASE WHEN typ = 'id' THEN 'Identifier' WHEN typ IN ('date', 'datetime') THEN 'Date'"
          " WHEN typ IN ('integer', 'float') THEN 'Measure' ELSE 'Dimension' END")
_UPCT = "CASE WHEN nn > 0 THEN round_even(nd * 100.0::DOUBLE / nn, 4) ELSE 0 END"
_MPCT = "CASE WHEN n > 0 THEN round_even((n - nn) * 100.0::DOUBLE / n, 4) ELSE 0 END"


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def _categorical(*datasets: str) -> list[tuple[str, str]]:
    known = {"orders": ["o_orderstatus", "o_orderpriority"], "part": ["p_brand", "p_type"],
             "documents": ["lang", "source"], "dirty_orders": ["qty_text", "priority", "const_flag"]}
    return [(d, c) for d in datasets for c in known[d]]


_FIRST = {"orders": "o_orderkey", "part": "p_partkey", "documents": "doc_id"}


def _top_categories() -> str:
    # p_name has few distinct words in some scales; the type decides
    parts = [f"""SELECT '{d}' AS dataset, '{c}' AS "column", (row_number() OVER (ORDER BY count(*) DESC,
  min({_FIRST[d]})) - 1)::INT AS place, {c} AS value, count(*) AS n FROM {d} GROUP BY {c}"""
             for d, c in _categorical("orders", "part", "documents") + [("part", "p_name")]]
    few = _typed("SELECT dataset, col FROM typed WHERE typ = 'categorical'", "orders", "part", "documents")
    return (f"SELECT r.* FROM ({_union(parts)}) r JOIN ({few}) k"
            " ON r.dataset = k.dataset AND r.\"column\" = k.col WHERE place < 5")


def _rare_categories() -> str:
    parts = [f"""SELECT '{d}' AS dataset, '{c}' AS "column", {c} AS value, count(*) AS n FROM {d}
GROUP BY {c} HAVING count(*) = 1 OR count(*) <= 0.01::DOUBLE * (SELECT count({c}) FROM {d})"""
             for d, c in _categorical("dirty_orders", "documents")]
    return f"{WITH}\n{_union(parts)}"


def _examples() -> str:
    parts = [f"""SELECT '{d}' AS dataset, '{c}' AS "column", (row_number() OVER (ORDER BY min({k})) - 1)::INT
  AS place, {c} AS value FROM {d} WHERE {c} IS NOT NULL GROUP BY {c} QUALIFY place < 5"""
             for d, c, k in (("orders", "o_orderstatus", "o_orderkey"),
                             ("orders", "o_orderpriority", "o_orderkey"),
                             ("documents", "text", "doc_id"), ("documents", "lang", "doc_id"),
                             ("documents", "source", "doc_id"))]
    return _union(parts)


def _date_profile() -> str:
    c = "order_date_text"
    conv = convention("dirty_orders", c)
    iso, status = date_iso(c, "conv"), date_status(c, "conv")
    stamp = "%Y-%m-%dT%H:%M:%S"
    native = _union([f"""SELECT '{d}', '{v}', strftime(min({v}), '{stamp}'), strftime(max({v}), '{stamp}'),
  0::BIGINT, count(*) FILTER ({v}::TIMESTAMP > TIMESTAMP '{AS_OF}'), 0::BIGINT FROM {d}"""
                     for d, v in (("orders", "o_orderdate"), ("events", "ts"))])
    return f"""{WITH},
d AS (SELECT {c}, {conv} AS conv FROM dirty_orders WHERE {c} IS NOT NULL),
r AS (SELECT {iso} AS iso, {status} AS status FROM d)
SELECT 'dirty_orders' AS dataset, '{c}' AS "column", concat(min(iso), 'T00:00:00') AS min,
  concat(max(iso), 'T00:00:00') AS max, count(*) FILTER (status = 'invalid') AS invalid_count,
  count(*) FILTER (status = 'parsed' AND iso > '{AS_OF}') AS future_count,
  count(*) FILTER (status = 'ambiguous') AS ambiguous_count FROM r
UNION ALL {native}"""


def _spelling_variants() -> str:
    parts = [f"""SELECT '{d}' AS dataset, '{c}' AS "column", lower({collapse(c)}) AS key,
  count(DISTINCT {c}) AS spellings, count(*) AS cells FROM {d} WHERE {c} IS NOT NULL
GROUP BY lower({collapse(c)}) HAVING count(DISTINCT {c}) > 1"""
             for d, c in (("dirty_customer", "segment"), ("dirty_customer", "full_name"),
                          ("dirty_orders", "priority"))]
    return f"{WITH}\n{_union(parts)}"


def _dataset_counts() -> str:
    parts = [f"""SELECT '{n}' AS dataset, (SELECT count(*) FROM {t}) AS row_count,
  (SELECT count(*) FROM {t}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {t})) AS duplicate_row_count,
  0::BIGINT AS empty_row_count"""
             for n, t in (("dirty_orders", "dirty_orders"), ("lineitem", "lineitem"),
                          ("conversations", "conversations"),
                          ("texts", "(SELECT text, lang, source, n_chars FROM documents)"))]
    return f"{WITH}\n{_union(parts)}"


def _email() -> str:
    a = "address"
    domain = f"split_part(trim({a}), '@', 2)"
    return f"""{WITH},
a AS (SELECT email AS address FROM dirty_customer UNION ALL
  SELECT t FROM (SELECT unnest(regexp_split_to_array(text, '[ \\n]+')) AS t FROM documents) WHERE contains(t, '@')),
g AS (SELECT address, count(*) AS n FROM a GROUP BY address),
r AS (SELECT address, n, CASE WHEN {a} IS NULL OR {strip(a)} = '' THEN 'empty'
  WHEN regexp_matches({strip(a)}, '[ \t]') THEN 'whitespace'
  WHEN length({a}) - length(replace({a}, '@', '')) <> 1 THEN 'at_sign_count'
  WHEN NOT {bad_email(a)} THEN 'valid' WHEN trim({a}) LIKE '@%' THEN 'missing_local_part'
  WHEN {domain} = '' THEN 'missing_domain' WHEN NOT contains({domain}, '.') THEN 'no_top_level_domain'
  ELSE 'pattern' END AS reason FROM g)
SELECT address, n, CASE WHEN reason = 'valid' THEN lower({strip(a)}) END AS normalized,
  reason = 'valid' AS is_valid, reason FROM r"""


def _columns_of_all() -> str:
    names = {
        **{t: [c for c, _ in cs] for t, cs in TABLES.items() if not t.startswith("dirty")},
        "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
        "nation": ["n_nationkey", "n_name", "n_regionkey"], "region": ["r_regionkey", "r_name"],
        "labels": ["doc_id", "quality", "toxic"], "benchmark": ["item_id", "text"],
        "embeddings": ["vec_id", "embedding", "label"]}
    rows = ", ".join(f"('{t}', {i}, '{c}')" for t, cs in names.items() for i, c in enumerate(cs))
    return f"""WITH c(dataset, pos, col) AS (VALUES {rows}),
k AS (SELECT dataset, col, count(*) AS copies FROM c GROUP BY ALL)
SELECT dataset, sum(copies)::BIGINT AS column_count, count(*) FILTER (copies > 1) AS duplicate_names,
  count(*) FILTER (col LIKE 'Unnamed:%' OR trim(col) = '') AS unnamed_headers,
  CASE WHEN bool_or(copies > 1 OR col LIKE 'Unnamed:%' OR trim(col) = '') THEN 'fail' ELSE 'pass' END AS status
FROM k GROUP BY dataset"""


def _clean_names() -> str:
    rows = ", ".join(
        f"('{t}', '{ {'o_orderdate': ' Order Date (UTC) ', 'ts': '%%'}.get(c, c) }')"
        for t in ("orders", "events") for c, _ in TABLES[t])
    return f"""WITH c(dataset, col) AS (VALUES {rows})
SELECT dataset, col AS "column", coalesce(nullif(lower(trim(regexp_replace(trim(col), '[^0-9a-zA-Z]+', '_', 'g'),
  '_')), ''), 'column') AS clean_name FROM c"""


def _decisions(select: str) -> str:
    names = ("dirty_orders", "dirty_customer")
    return f"""{WITH},
{typed_facts(*names)},
{issues_cte(*names)},
{POLICY},
d AS (SELECT i.*, coalesce(confidence, 'LOW') AS confidence, act_order,
  CASE WHEN act_order IS NOT NULL AND dataset = 'dirty_orders' AND "column" = 'priority' THEN 'skipped_protected'
    WHEN act_order IS NOT NULL THEN 'apply' ELSE 'flagged_for_review' END AS status
  FROM issues i LEFT JOIN policy p ON i.issue_type = p.issue_type)
{select}"""


def _amount_text(c: str) -> str:
    """The number of a readable amount (whole numbers in this data) as plain text."""
    digits = rf"regexp_extract({c}, '([\d,]+)', 1)"
    negative = f"({c} LIKE '(%')"
    return f"concat(CASE WHEN {negative} THEN '-' ELSE '' END, (replace({digits}, ',', '')::BIGINT)::VARCHAR, '.0')"


# The fixes in order, one column per step.
_ORDER_STEPS = f"""s1 AS MATERIALIZED (SELECT DISTINCT * EXCLUDE (empty_note) FROM dirty_orders),
s2 AS MATERIALIZED (SELECT *, CASE WHEN lower(trim(order_date_text)) <> 'n/a' THEN order_date_text END AS date1,
  CASE WHEN lower(trim(amount_text)) <> 'not available' THEN amount_text END AS amount1,
  {collapse('priority')} AS priority1 FROM s1),
s3 AS MATERIALIZED (SELECT *, CASE WHEN lower(priority1) <> 'unknown' THEN priority1 END AS priority2 FROM s2),
counts AS MATERIALIZED (SELECT priority2 AS v, count(*) AS k FROM s3 WHERE priority2 IN
  (SELECT DISTINCT priority FROM dirty_orders) GROUP BY priority2),
best AS MATERIALIZED (SELECT v, first_value(v) OVER (PARTITION BY lower(v) ORDER BY k DESC, v) AS b FROM counts),
s4 AS MATERIALIZED (SELECT s3.*, coalesce(best.b, priority2) AS priority3,
  {convention('s3', 'date1')} AS conv FROM s3 LEFT JOIN best ON best.v = priority2),
s5 AS MATERIALIZED (SELECT *, CASE {date_status('date1', 'conv')} WHEN 'invalid' THEN NULL
  WHEN 'parsed' THEN {date_iso('date1', 'conv')} ELSE date1 END AS date2,
  CASE WHEN amount1 IS NOT NULL AND {money_high('amount1')} THEN {_amount_text('amount1')} ELSE amount1 END
  AS amount2 FROM s4)"""
_CLEAN_ORDERS = """SELECT DISTINCT order_id, customer_id, date2 AS order_date_text, amount2 AS amount_text,
  qty_text, priority3 AS priority, age, quantity, subtotal, tax, total, const_flag FROM s5"""

_CUSTOMER_STEPS = f"""t1 AS MATERIALIZED (SELECT *, {collapse('full_name')} AS name1,
  CASE WHEN lower(segment) <> 'n/a' THEN segment END AS segment1 FROM dirty_customer),
tcounts AS MATERIALIZED (SELECT segment1 AS v, count(*) AS k FROM t1 WHERE segment1 IS NOT NULL GROUP BY segment1),
tbest AS MATERIALIZED (SELECT v, first_value(v) OVER (PARTITION BY lower(v) ORDER BY k DESC, v) AS b FROM tcounts),
t2 AS MATERIALIZED (SELECT t1.*, coalesce(tbest.b, segment1) AS segment2 FROM t1 LEFT JOIN tbest ON tbest.v = segment1)"""
_CLEAN_CUSTOMERS = """SELECT DISTINCT customer_id, name1 AS full_name, email, phone, segment2 AS segment,
  zip_code, balance FROM t2"""


def _change(column: str, issue: str, old: str, new: str, source: str) -> str:
    return (f"SELECT '{column}' AS \"column\", '{issue}' AS issue_type, {old} AS original_value,"
            f" {new} AS new_value, count(*) AS n FROM {source} WHERE {old} IS DISTINCT FROM {new} GROUP BY ALL")


_ORDER_CHANGES = _union([
    "SELECT 'empty_note' AS \"column\", 'empty_column' AS issue_type, 'empty_note' AS original_value,"
    " NULL::VARCHAR AS new_value, 1::BIGINT AS n",
    "SELECT NULL, 'duplicate_rows', '<duplicate row>', NULL,"
    " (SELECT count(*) FROM dirty_orders) - (SELECT count(*) FROM s1)",
    _change("priority", "whitespace_formatting", "priority", "priority1", "s5"),
    _change("order_date_text", "missing_value_placeholder", "order_date_text", "date1", "s5"),
    _change("amount_text", "missing_value_placeholder", "amount_text", "amount1", "s5"),
    _change("priority", "missing_value_placeholder", "priority1", "priority2", "s5"),
    _change("priority", "category_inconsistency", "priority2", "priority3", "s5"),
    _change("order_date_text", "invalid_date", "date1", "date2", "s5"),
    _change("amount_text", "currency_value", "amount1", "amount2", "s5"),
    "SELECT NULL, 'duplicate_rows_post_normalization', '<duplicate row (post-normalization)>', NULL, k FROM"
    f" (SELECT (SELECT count(*) FROM s5) - (SELECT count(*) FROM ({_CLEAN_ORDERS})) AS k) WHERE k > 0",
])
_CUSTOMER_CHANGES = _union([
    _change("full_name", "whitespace_formatting", "full_name", "name1", "t2"),
    _change("segment", "missing_value_placeholder", "segment", "segment1", "t2"),
    _change("segment", "category_inconsistency", "segment1", "segment2", "t2"),
    "SELECT NULL, 'duplicate_rows_post_normalization', '<duplicate row (post-normalization)>', NULL, k FROM"
    f" (SELECT (SELECT count(*) FROM t2) - (SELECT count(*) FROM ({_CLEAN_CUSTOMERS})) AS k) WHERE k > 0",
])
_ORDER_COLUMNS = [c for c in TABLES["dirty_orders"] if c[0] != "empty_note"]


def _cleaning_log() -> str:
    return f"""{WITH},
{_ORDER_STEPS},
changes AS MATERIALIZED ({_ORDER_CHANGES}),
applied("column", issue_type, confidence) AS (VALUES ('empty_note', 'empty_column', 'HIGH'),
  (NULL, 'duplicate_rows', 'HIGH'), ('priority', 'whitespace_formatting', 'HIGH'),
  ('order_date_text', 'missing_value_placeholder', 'MEDIUM'),
  ('amount_text', 'missing_value_placeholder', 'MEDIUM'),
  ('priority', 'missing_value_placeholder', 'MEDIUM'), ('priority', 'category_inconsistency', 'MEDIUM'),
  ('order_date_text', 'invalid_date', 'MEDIUM'), ('amount_text', 'currency_value', 'HIGH'))
SELECT a.issue_type, a."column", a.confidence, a.issue_type AS rule, coalesce(sum(c.n), 0)::BIGINT AS affected_count
FROM applied a LEFT JOIN changes c ON a.issue_type = c.issue_type AND a."column" IS NOT DISTINCT FROM c."column"
GROUP BY ALL
UNION ALL SELECT 'duplicate_rows', "column", 'HIGH', issue_type, n FROM changes
WHERE issue_type = 'duplicate_rows_post_normalization'"""


def _audit_counts() -> str:
    """Audit rows per issue of the customer table."""
    return f"""{typed_facts('dirty_customer')},
{issues_cte('dirty_customer')},
{_CUSTOMER_STEPS},
changes AS MATERIALIZED ({_CUSTOMER_CHANGES}),
sums AS (SELECT issue_type, "column", sum(n)::BIGINT AS n FROM changes GROUP BY ALL),
audited AS (SELECT i."column", i.issue_type, CASE WHEN i.issue_type IN ('whitespace_formatting',
    'missing_value_placeholder', 'category_inconsistency') THEN 'applied' ELSE 'flagged_for_review' END AS status,
  CASE i.issue_type WHEN 'whitespace_formatting' THEN 'HIGH' WHEN 'missing_value_placeholder' THEN 'MEDIUM'
    WHEN 'category_inconsistency' THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
  CASE WHEN s.n < 50 THEN s.n ELSE 1 END AS audit_rows, (coalesce(s.n, 0) >= 50)::BIGINT AS aggregated_rows
  FROM issues i LEFT JOIN sums s ON i.issue_type = s.issue_type AND i."column" = s."column"
  UNION ALL SELECT NULL, 'duplicate_rows', 'applied', 'HIGH', CASE WHEN n < 50 THEN n ELSE 1 END, (n >= 50)::BIGINT
  FROM sums WHERE issue_type = 'duplicate_rows_post_normalization')"""


_RULES = {
    "dirty_orders": ("count(*) FILTER (abs(subtotal + tax - total) > 1e-6)", "count(*) FILTER (total IS NULL)"),
}


def _checks(names: tuple[str, ...], sources: dict[str, str] | None = None) -> str:
    """CTE ``checks`` on top of ``typed``: the nine validation checks per dataset."""
    parts = []
    for d in names:
        t = (sources or {}).get(d, d)
        violations = f"(SELECT {_RULES[d][0]} FROM {t})" if d in _RULES else "0::BIGINT"
        parts.append(f"""SELECT '{d}' AS dataset, max(n) AS rows, count(*) AS cols,
  count(*) FILTER (nn = 0) AS fully, count(*) FILTER (2 * (n - nn) > n) AS mostly,
  (SELECT dups FROM ({copies(d, t)})) AS dups,
  coalesce(sum(CASE WHEN typ = 'id' THEN nn - nd END), 0)::BIGINT AS ids, {violations} AS bad,
  count(*) FILTER (kind IN ('int', 'float') AND rlow IS NOT NULL AND noor > 0) AS oor,
  count(*) FILTER (typ IN ('integer', 'float') AND nout > 0) AS outs FROM typed WHERE dataset = '{d}'""")
    checks = [
        ("row_integrity", "CASE WHEN rows = 0 THEN 'fail' ELSE 'pass' END", "rows"),
        ("column_integrity", "'pass'", "cols"),
        ("missingness", "CASE WHEN fully > 0 THEN 'fail' WHEN mostly > 0 THEN 'warning' ELSE 'pass' END", "mostly"),
        ("duplicates", "CASE WHEN dups > 0 THEN 'fail' ELSE 'pass' END", "dups"),
        ("id_uniqueness", "CASE WHEN ids > 0 THEN 'fail' ELSE 'pass' END", "ids"),
        ("business_rules", "CASE WHEN bad = 0 THEN 'pass' WHEN bad > 0.5 * rows THEN 'fail' ELSE 'warning' END", "bad"),
        ("invalid_values", "CASE WHEN oor > 0 THEN 'warning' ELSE 'pass' END", "oor"),
        ("outlier_behavior", "CASE WHEN outs > 0 THEN 'warning' ELSE 'pass' END", "outs"),
        ("schema_integrity", "CASE WHEN cols < 2 THEN 'warning' ELSE 'pass' END", "cols")]
    rows = _union([f"SELECT dataset, '{n}' AS check_name, {s} AS status, {v}::BIGINT AS detail FROM cf"
                   for n, s, v in checks])
    return f"cf AS ({_union(parts)}),\nchecks AS ({rows})"


_OVERALL = ("SELECT dataset, CASE WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_or(status = 'warning')"
            " THEN 'warning' ELSE 'pass' END AS overall_status FROM {checks} GROUP BY dataset")


def _warn(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 'warning' ELSE 'pass' END"


def _fail(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 'fail' ELSE 'pass' END"


def _have(condition: str, otherwise: str = "warning") -> str:
    return f"CASE WHEN {condition} THEN 'pass' ELSE '{otherwise}' END"


_NA = "not_applicable"
PACK_CHECKS = {
    "power_bi": {
        "mixed_data_types": _warn("mixed > 0"), "date_validity": _warn("dinv > 0"),
        "duplicate_keys": _fail("dupid > 0"), "high_cardinality_fields": _warn("hicard > 0"),
        "date_dimension_present": _have("dates > 0"), "measures_identified": _have("measures > 0"),
        "dimension_attributes_identified": _have("dims > 0"),
        "currency_percentage_representation": "'pass'", "table_role": "'pass'"},
    "sql": {
        "primary_key_candidates": _have("ids > 0"), "foreign_key_candidates": _have("links > 0", _NA),
        "duplicates": _fail("dupid > 0"), "nullability": _fail("idnull > 0"),
        "data_types": _warn("mixed > 0"), "multi_value_cells": _warn("multi > 0"),
        "normalization_concerns": _warn("nearconst > 0")},
    "tableau": {
        "potential_measures": _have("measures > 0"), "potential_dimensions": _have("dims > 0"),
        "potential_date_field": _have("dates > 0"), "potential_geographic_field": _have("geo > 0", _NA),
        "data_type_consistency": _warn("mixed > 0"), "duplicate_records": _warn("duprows > 0"),
        "high_cardinality_fields": _warn("hicard > 0"), "aggregation_safety": _warn("nearuniq > 0")},
    "alteryx": {
        "schema_stability": _warn("const > 0 OR empties > 0"), "field_naming": _warn("badnames > 0"),
        "numeric_parsing": _warn("mixed > 0"), "date_parsing": _warn("dateissues > 0"),
        "text_normalization": _warn("wsissues > 0"),
        "join_keys": "CASE WHEN dupid > 0 THEN 'fail' WHEN ids > 0 THEN 'pass' ELSE 'warning' END"},
    "excel": {
        "single_header_row": "'pass'", "blank_rows_columns": _warn("empties > 0"),
        "mixed_types": _warn("mixed > 0"), "date_values": _warn("dinv > 0"),
        "long_text_fields": "'pass'", "duplicate_rows": _warn("duprows > 0"),
        "data_volume": _fail("rows > 1048576")},
    "looker": {
        "potential_measures": _have("measures > 0"), "potential_dimensions": _have("dims > 0"),
        "potential_keys": _have("ids > 0"), "grain_concern": _warn("duprows > 0"),
        "naming_consistency": _warn("badnames > 0"), "high_cardinality_fields": _warn("hicard > 0")},
    "looker_studio": {
        "connector_friendly_headers": _warn("badnames > 0"), "primitive_data_types": _warn("mixed > 0"),
        "date_fields": "CASE WHEN dinv > 0 THEN 'warning' WHEN dates > 0 THEN 'pass' ELSE 'not_applicable' END",
        "numeric_fields": _have("measures > 0"), "categorical_fields": _have("dims > 0"),
        "missing_values": _warn("meanmiss > 10"), "aggregation_usability": _have("measures > 0")},
    "qlik": {
        "key_consistency": _fail("dupid > 0"), "field_naming": _have("links = 0 OR ids > 0"),
        "synthetic_key_risk": _warn("links >= 2 AND uniqlinks > 0"),
        "circular_relationship_risk": f"'{_NA}'", "duplicate_fields": "'pass'"},
    "python": {
        "numeric_columns": _have("measures > 0", _NA), "categorical_columns": _have("dims > 0", _NA),
        "datetime_columns": _have("dates > 0", _NA), "missing_values": _warn("meanmiss > 5"),
        "outliers": _warn("outissues > 0"), "duplicate_records": _warn("duprows > 0"),
        "identifiers": _have("ids > 0", _NA), "constant_columns": _warn("const > 0"),
        "high_cardinality_fields": _warn("hicard > 0"),
        "possible_target_variable": _have("targets > 0", _NA), "possible_feature_variables": "'pass'"},
    "r": {
        "numeric_columns": _have("measures > 0", _NA), "categorical_columns": _have("dims > 0", _NA),
        "datetime_columns": _have("dates > 0", _NA), "missingness": _warn("meanmiss > 5"),
        "duplicates": _warn("duprows > 0"), "outliers": _warn("outissues > 0"),
        "identifiers": _have("ids > 0", _NA), "high_cardinality_fields": _warn("hicard > 0")},
}


def _wide(names: tuple[str, ...], sources: dict[str, str] | None = None, suffix: str = "",
          typed: str = "typed", issues: str = "issues") -> str:
    """CTE ``wide``: what the packs look at, one row per dataset."""
    dups = _union([copies(d, (sources or {}).get(d)) for d in names])

    def n_issues(*types: str) -> str:
        listed = ", ".join(f"'{t}'" for t in types)
        return f"(SELECT count(*) FROM {issues} i WHERE i.dataset = t.dataset AND issue_type IN ({listed}))"
    return f"""dups{suffix} AS ({dups}),
wide{suffix} AS (SELECT dataset, max(n) AS rows, count(*) AS cols,
  count(*) FILTER (typ = 'id') AS ids, count(*) FILTER (link_name AND typ <> 'id') AS links,
  count(*) FILTER (typ IN ('integer', 'float')) AS measures,
  count(*) FILTER (typ IN ('string', 'categorical')) AS dims,
  count(*) FILTER (typ IN ('date', 'datetime')) AS dates,
  count(*) FILTER (typ = 'id' AND nn < n) AS idnull,
  count(*) FILTER (typ <> 'id' AND NOT link_name AND nmulti > 0.5 * nn) AS multi,
  count(*) FILTER (nn > 0 AND NOT (nd = 1 AND nn = n) AND topc >= 0.95 * nn) AS nearconst,
  count(*) FILTER (typ IN ('integer', 'float') AND {_UPCT} >= 95) AS nearuniq,
  count(*) FILTER (link_name AND typ <> 'id' AND {_UPCT} >= 90) AS uniqlinks,
  sum(dinvalid) AS dinv, count(*) FILTER (geo_name) AS geo, count(*) FILTER (target_name) AS targets,
  count(*) FILTER (nn = 0) AS empties, count(*) FILTER (nd = 1 AND nn = n) AS const,
  count(*) FILTER (NOT regexp_matches(col, '^[a-z0-9_]+$')) AS badnames, avg({_MPCT}) AS meanmiss,
  sum(n - nn)::BIGINT AS missing, coalesce(sum(CASE WHEN typ = 'id' THEN nn - nd END), 0)::BIGINT AS dupids,
  {n_issues('mixed_data_types')} AS mixed, {n_issues('duplicate_id')} AS dupid,
  {n_issues('high_cardinality')} AS hicard, {n_issues('duplicate_rows')} AS duprows,
  {n_issues('outlier')} AS outissues, {n_issues('whitespace_formatting')} AS wsissues,
  {n_issues('invalid_date', 'future_date', 'ambiguous_date_format')} AS dateissues,
  (SELECT dups FROM dups{suffix} u WHERE u.dataset = t.dataset) AS dups
  FROM {typed} t GROUP BY dataset)"""


def _pack_rows(packs: list[str], wide: str = "wide") -> str:
    return _union([f"SELECT dataset, '{p}' AS platform, '{c}' AS check_name, {e} AS status FROM {wide}"
                   for p in packs for c, e in PACK_CHECKS[p].items()])


_SCORE = """SELECT dataset, platform,
  greatest(0, 100 - 15 * count(*) FILTER (status = 'fail') - 5 * count(*) FILTER (status = 'warning')) AS score,
  CASE WHEN count(*) FILTER (status = 'fail') > 1 THEN 'NOT_READY' WHEN bool_or(status = 'fail') THEN 'NEEDS_CLEANING'
    WHEN bool_or(status = 'warning') THEN 'READY_WITH_WARNINGS' ELSE 'READY' END AS status
FROM {checks} GROUP BY dataset, platform"""
_READY = ("dirty_orders", "dirty_customer", "orders", "part", "events")


def _readiness(select: str, names: tuple[str, ...] = _READY) -> str:
    return (f"{WITH},\n{typed_facts(*names)},\n{issues_cte(*names)},\n{_wide(names)}\n{select}")


def _quality(wide: str, issues: str, ready: str, integrity: str = "100") -> str:
    def affected(*types: str) -> str:
        listed = ", ".join(f"'{t}'" for t in types)
        return (f"least(1, (SELECT coalesce(sum(affected_count), 0) FROM {issues} i WHERE i.dataset = w.dataset"
                f" AND issue_type IN ({listed})) / rows)")
    dims = {
        "completeness": "greatest(0, 100 - meanmiss)",
        "validity": f"100 - 100 * {affected('impossible_value', 'invalid_date', 'mixed_data_types')}",
        "consistency": f"100 - 100 * {affected('category_inconsistency', 'whitespace_formatting')}",
        "uniqueness": "greatest(0, 100 - dups * 100.0 / rows - dupids * 100.0 / rows)",
        "integrity": integrity, "schema_quality": "greatest(0, 100 - 10 * (const + empties))",
        "analytics_readiness": "(SELECT round_even(avg(score), 0) FROM "
                               f"{ready} r WHERE r.dataset = w.dataset)"}
    listed = ", ".join(f"round_even(({e})::DOUBLE, 2) AS {d}" for d, e in dims.items())
    return (f"SELECT *, round_even(({' + '.join(dims)}) / 7, 0)::INT AS quality_score FROM"
            f" (SELECT dataset, {listed} FROM {wide} w)")


def _quality_query(validated: bool) -> str:
    checks = f",\n{_checks(SCORED)},\nstat AS ({_OVERALL.format(checks='checks')})" if validated else ""
    integrity = ("(SELECT CASE overall_status WHEN 'pass' THEN 100 WHEN 'warning' THEN 80 ELSE 40 END"
                 " FROM stat s WHERE s.dataset = w.dataset)") if validated else "100"
    return _readiness(f""",packs AS ({_pack_rows(list(PACK_CHECKS))}),
scores AS ({_SCORE.format(checks='packs')}){checks}
{_quality('wide', 'issues', 'scores', integrity)}""", SCORED)


def _clean_stage() -> str:
    """CTEs for the raw and the cleaned order table, each with facts, issues and packs."""
    name = ("dirty_orders",)
    after = {"dirty_orders": "cleaned"}
    raw = column_facts("dirty_orders")
    new = column_facts("dirty_orders", "cleaned", _ORDER_COLUMNS)
    packs = list(PACK_CHECKS)
    issues_after = issues_cte(*name, sources=after).replace("FROM typed", "FROM typed2").replace(
        "issues AS", "issues2 AS", 1)
    return f"""{WITH},
{_ORDER_STEPS},
cleaned AS ({_CLEAN_ORDERS}),
raw AS ({raw}), typed AS (SELECT *, {TYPE} AS typ FROM raw),
raw2 AS ({new}), typed2 AS (SELECT *, {TYPE} AS typ FROM raw2),
{issues_cte(*name)},
{issues_after},
{_wide(name)},
{_wide(name, after, '2', 'typed2', 'issues2')},
scores AS ({_SCORE.format(checks='(' + _pack_rows(packs) + ')')}),
scores2 AS ({_SCORE.format(checks='(' + _pack_rows(packs, 'wide2') + ')')}),
{_checks(name, after).replace('FROM typed', 'FROM typed2')},
stat AS ({_OVERALL.format(checks='checks')})"""


def _before_after() -> str:
    integrity = ("(SELECT CASE overall_status WHEN 'pass' THEN 100 WHEN 'warning' THEN 80 ELSE 40 END"
                 " FROM stat s WHERE s.dataset = w.dataset)")

    def metrics(wide, issues, quality):
        def total(*types):
            listed = ", ".join(f"'{t}'" for t in types)
            return (f"(SELECT coalesce(sum(affected_count), 0) FROM {issues} WHERE issue_type IN ({listed}))")
        values = {
            "row_count": "rows", "column_count": "cols", "missing_values": "missing",
            "duplicate_rows": "dups", "duplicate_ids": "dupids",
            "invalid_values": total("impossible_value", "negative_value", "mixed_data_types"),
            "invalid_dates": total("invalid_date"), "outliers": total("outlier"),
            "quality_score": f"(SELECT quality_score FROM ({quality}))",
            "analytics_readiness": f"(SELECT analytics_readiness FROM ({quality}))"}
        return _union([f"SELECT dataset, '{m}' AS metric, ({e})::DOUBLE AS v FROM {wide}"
                       for m, e in values.items()])
    old = metrics("wide", "issues", _quality("wide", "issues", "scores"))
    new = metrics("wide2", "issues2", _quality("wide2", "issues2", "scores2", integrity))
    return f"""{_clean_stage()},
o AS ({old}), n AS ({new})
SELECT o.dataset, o.metric, o.v AS before, n.v AS after, n.v - o.v AS change
FROM o JOIN n ON o.metric = n.metric"""


def _gate() -> str:
    return f"""{_clean_stage()},
loss AS (SELECT count(*) AS k FROM typed b JOIN typed2 a ON a.col = b.col
  WHERE b.typ IN ('date', 'datetime') AND a.typ IN ('date', 'datetime')
  AND a.n - a.nn + a.dinvalid > b.n - b.nn + b.dinvalid)
SELECT dataset, overall_status, k AS lossy_columns, overall_status <> 'fail' AND k = 0 AS published
FROM stat, loss"""


_LINEAGE = """lin(pos, step, col, rule, confidence) AS (VALUES
  (2, 3, 'order_date_text', 'missing_value_placeholder', 'MEDIUM'), (2, 7, 'order_date_text', 'invalid_date', 'MEDIUM'),
  (3, 4, 'amount_text', 'missing_value_placeholder', 'MEDIUM'), (3, 8, 'amount_text', 'currency_value', 'HIGH'),
  (5, 2, 'priority', 'whitespace_formatting', 'HIGH'), (5, 5, 'priority', 'missing_value_placeholder', 'MEDIUM'),
  (5, 6, 'priority', 'category_inconsistency', 'MEDIUM'), (12, 0, 'empty_note', 'empty_column', 'HIGH'))"""


def _lineage_rows() -> str:
    names = ", ".join(f"({i}, '{c}')" for i, (c, _) in enumerate(TABLES["dirty_orders"]))
    return f"""SELECT format('lineage_{{:03d}}', row_number() OVER (ORDER BY c.pos, l.step)) AS lineage_id,
  'dirty_orders' AS source_dataset, c.col AS source_column,
  CASE WHEN c.col <> 'empty_note' THEN c.col END AS output_column, l.rule, l.confidence
FROM (VALUES {names}) c(pos, col) LEFT JOIN lin l ON l.col = c.col"""


def _field_label(pack: str) -> str:
    return {
        "power_bi": f"CASE WHEN typ = 'id' THEN 'Key' ELSE {_ROLE} END",
        "sql": "CASE WHEN link_name AND typ <> 'id' THEN 'Foreign Key Candidate' WHEN typ = 'id' THEN"
               " 'Primary Key Candidate' WHEN typ IN ('integer', 'float') THEN 'Fact Candidate'"
               " WHEN typ IN ('string', 'categorical') THEN 'Dimension Candidate' END",
        "tableau": "CASE WHEN geo_name THEN 'Potential Geographic Field' WHEN typ IN ('date', 'datetime') THEN"
                   " 'Potential Date Field' WHEN typ IN ('string', 'categorical') THEN 'Potential Dimension'"
                   " WHEN typ IN ('integer', 'float') THEN 'Potential Measure' END",
        "alteryx": "CASE WHEN typ = 'id' THEN 'Join Key' END", "excel": "NULL::VARCHAR",
        "looker": "CASE WHEN typ = 'id' THEN 'Potential Key' WHEN typ IN ('integer', 'float') THEN"
                  " 'Potential Measure' WHEN typ IN ('string', 'categorical') THEN 'Potential Dimension' END",
        "looker_studio": "CASE WHEN typ IN ('date', 'datetime') THEN 'Date Dimension' WHEN typ IN ('string',"
                         " 'categorical') THEN 'Dimension' WHEN typ IN ('integer', 'float') THEN 'Metric' END",
        "qlik": "CASE WHEN typ = 'id' THEN 'Key Candidate' END",
        "python": "CASE WHEN target_name THEN 'Target Candidate' WHEN typ = 'id' THEN 'Identifier' END",
        "r": "CASE WHEN typ IN ('string', 'categorical') THEN 'Factor Candidate' WHEN typ = 'id' THEN"
             " 'Identifier' END"}[pack]


def _dictionary() -> str:
    return f"""{_clean_stage()},
{_LINEAGE},
lineage AS ({_lineage_rows()})
SELECT dataset, lower(col) AS column_name, col AS original_name, typ AS data_type, {_LABEL} AS semantic_role,
  n - nn > 0 AS nullable, nd AS unique_count, n - nn AS missing_count, {_MPCT} AS missing_percentage,
  vmin AS min, vmax AS max, round_even(vmean, 4) AS mean, q2 AS median,
  (SELECT min(lineage_id) FROM lineage WHERE source_column = col) AS lineage_id,
  {_field_label('power_bi')} AS power_bi_role, {_field_label('sql')} AS sql_role,
  {_field_label('tableau')} AS tableau_role, {_field_label('python')} AS python_role,
  {_field_label('r')} AS r_role
FROM typed2"""


def _linked(select: str) -> str:
    return f"""WITH o AS ({inputs.LINKED_ORDERS}), c AS ({inputs.LINKED_CUSTOMERS}),
orphans AS (SELECT DISTINCT customer_id FROM o WHERE customer_id NOT IN (SELECT customer_id FROM c)){select}"""


def _linked_scores() -> str:
    columns = {"orders.csv": [("order_id", "int"), ("customer_id", "int"), ("amount", "float")],
               "customers.csv": [("customer_id", "int"), ("name", "text")]}
    sources = {"orders.csv": "o", "customers.csv": "c"}
    names = tuple(columns)
    packs = ["power_bi", "sql", "qlik", "looker"]
    # the refresh carries no relationship check of the looker pack, whose check has another name
    carried = packs[:3]
    links = _union([f"""SELECT '{d}' AS dataset, '{p}' AS platform, 'foreign_key_relationships' AS check_name,
  {"CASE WHEN (SELECT count(*) FROM orphans) > 0 THEN 'warning' ELSE 'pass' END" if d == 'orders.csv' else "'pass'"} AS status"""
                    for d in names for p in carried])
    return _linked(f""",
{typed_facts(*names, sources=sources, columns=columns)},
{issues_cte(*names, sources=sources)},
{_wide(names, sources)}
{_SCORE.format(checks='(' + _pack_rows(packs) + ' UNION ALL ' + links + ')')}""")


def _pairs(table: str, key: str) -> str:
    """Equal-contact groups by comparing record pairs of equal contacts one by one."""
    digits = r"nullif(regexp_replace(phone, '\D+', '', 'g'), '')"
    others = [c for c, _ in TABLES.get(table, [])] or ["contact_id", "full_name", "email", "phone"]
    whole = f"md5(concat_ws('|', {', '.join(f'coalesce({c}::VARCHAR, chr(1))' for c in others)}))"
    return f"""r AS (SELECT row_number() OVER () AS rid, lower(trim(full_name)) AS name,
  nullif(lower(trim(email)), '') AS email, {digits} AS phone, {whole} AS whole FROM {table}),
b AS (SELECT *, coalesce('email:' || substr(email, 1, 3), 'phone:' || right(phone, 6)) AS block FROM r),
e AS (SELECT 'email' AS kind, a.block, a.email AS key, count(*) AS pair_count FROM b a JOIN b c
  ON a.block = c.block AND a.email = c.email AND a.rid < c.rid AND a.whole <> c.whole GROUP BY ALL),
p AS (SELECT 'phone' AS kind, a.block, a.phone AS key, count(*) AS pair_count FROM b a JOIN b c
  ON a.block = c.block AND a.phone = c.phone AND a.rid < c.rid AND a.whole <> c.whole
  AND coalesce(a.email <> c.email, true) GROUP BY ALL),
m AS (SELECT 'name' AS kind, a.block, a.name AS key, count(*) AS pair_count FROM b a JOIN b c
  ON a.block = c.block AND a.name = c.name AND a.name <> '' AND a.rid < c.rid
  AND coalesce(a.email <> c.email, true) AND coalesce(a.phone <> c.phone, true) GROUP BY ALL)
SELECT g.*, (SELECT count(*) FROM b WHERE b.block = g.block AND
  CASE g.kind WHEN 'email' THEN b.email WHEN 'phone' THEN b.phone ELSE b.name END = g.key) AS record_count
FROM (SELECT * FROM e UNION ALL SELECT * FROM p UNION ALL SELECT * FROM m) g"""


_RUNS = list(inputs.ORDER_VERSIONS)
_VERSION_COLUMNS = {
    "1997": [("o_orderkey", "int"), ("o_custkey", "int"), ("o_totalprice", "float"),
             ("o_orderstatus", "text"), ("o_orderpriority", "text")],
    "1998": [("o_orderkey", "int"), ("o_custkey", "int"), ("o_totalprice", "float"),
             ("o_orderstatus", "text"), ("channel", "text")],
    "1999": [("o_orderkey", "int"), ("o_custkey", "text"), ("o_totalprice", "float"),
             ("o_orderstatus", "text"), ("channel", "text")],
}


def _history() -> str:
    versions = ",\n".join(f"v{r} AS ({sql})" for r, sql in inputs.ORDER_VERSIONS.items())
    facts = _union([f"SELECT '{r}' AS run_id, x.* FROM ({column_facts('orders', f'v{r}', _VERSION_COLUMNS[r])}) x"
                    for r in _RUNS])
    cats = _union([f"""SELECT '{r}' AS run_id, '{c}' AS col, list(v ORDER BY v) AS cats FROM (SELECT {c} AS v
  FROM v{r} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, min(o_orderkey) LIMIT 5)"""
                   for r in _RUNS for c, k in _VERSION_COLUMNS[r] if k == "text" and c != "o_custkey"])
    return f"""WITH {versions},
raw AS ({facts}), typed AS (SELECT *, {TYPE} AS typ FROM raw), cats AS ({cats}),
h AS (SELECT t.run_id, t.col, typ, n, {_MPCT} AS miss, vmean, vstd,
  CASE WHEN typ = 'categorical' THEN cats END AS cats FROM typed t LEFT JOIN cats c
  ON c.run_id = t.run_id AND c.col = t.col),
prev(run_id, old) AS (VALUES ('1998', '1997'), ('1999', '1998')),
f AS (SELECT p.run_id, p.old, coalesce(c.col, o.col) AS col, c.typ AS t1, o.typ AS t0, c.miss AS m1, o.miss AS m0,
  c.vmean AS a1, o.vmean AS a0, c.vstd AS s1, o.vstd AS s0, c.cats AS c1, o.cats AS c0
  FROM prev p JOIN (SELECT DISTINCT run_id AS r, col FROM h) k ON k.r IN (p.run_id, p.old)
  LEFT JOIN h c ON c.run_id = p.run_id AND c.col = k.col LEFT JOIN h o ON o.run_id = p.old AND o.col = k.col
  GROUP BY ALL),
gained AS (SELECT run_id, old, col, list_sort(list_filter(c1, lambda x: NOT list_contains(c0, x))) AS up,
  list_sort(list_filter(c0, lambda x: NOT list_contains(c1, x))) AS down FROM f WHERE c1 IS NOT NULL AND c0 IS NOT NULL),
findings AS (
SELECT 'orders' AS dataset, run_id, old AS compared_against, 'schema_drift_new_columns' AS drift_type,
  NULL AS "column", 'medium' AS severity, NULL AS previous, string_agg(col, ', ' ORDER BY col) AS current
  FROM f WHERE t0 IS NULL GROUP BY run_id, old
UNION ALL SELECT 'orders', run_id, old, 'schema_drift_removed_columns', NULL, 'high', NULL,
  string_agg(col, ', ' ORDER BY col) FROM f WHERE t1 IS NULL GROUP BY run_id, old
UNION ALL SELECT 'orders', run_id, old, 'schema_drift_type_change', col, 'medium', t0, t1 FROM f WHERE t0 <> t1
UNION ALL SELECT DISTINCT 'orders', p.run_id, p.old, 'volume_drift', NULL, 'medium', o.n::VARCHAR, c.n::VARCHAR
  FROM prev p JOIN h c ON c.run_id = p.run_id JOIN h o ON o.run_id = p.old
  WHERE o.n > 0 AND abs(c.n - o.n) / o.n > 0.2
UNION ALL SELECT 'orders', run_id, old, 'missingness_drift', col, 'high', m0::VARCHAR, m1::VARCHAR FROM f
  WHERE m1 - m0 > 10
UNION ALL SELECT 'orders', run_id, old, 'category_drift', col, 'low', array_to_string(down, ', '),
  array_to_string(up, ', ') FROM gained WHERE len(up) > 0 OR len(down) > 0
UNION ALL SELECT 'orders', run_id, old, 'distribution_drift_mean', col, 'medium',
  round_even(round(a0, 4), 2)::VARCHAR, round_even(round(a1, 4), 2)::VARCHAR FROM f WHERE a0 <> 0 AND abs(a1 - a0) / abs(a0) > 0.2
UNION ALL SELECT 'orders', run_id, old, 'distribution_drift_std', col, 'low',
  round_even(round(s0, 4), 2)::VARCHAR, round_even(round(s1, 4), 2)::VARCHAR FROM f WHERE s0 <> 0 AND abs(s1 - s0) / abs(s0) > 0.2)"""


def _close_names() -> str:
    """All pairs of names of a block, by brute force."""
    return f"""WITH contacts AS ({inputs.CONTACTS}), keyed AS (
    SELECT lower(trim(full_name)) AS name, lower(trim(email)) AS e,
           regexp_replace(phone, '[^0-9]', '', 'g') AS p FROM contacts
), names AS (
    SELECT DISTINCT CASE WHEN e <> '' THEN 'email:' || e[1:3] ELSE 'phone:' || right(p, 6) END AS block, name
    FROM keyed WHERE name <> '' AND (e <> '' OR p <> '')
)
SELECT a.block, a.name AS name_a, b.name AS name_b
FROM names a JOIN names b ON a.block = b.block AND a.name < b.name
WHERE 2 * levenshtein(a.name, b.name)
      <= length(a.name) + length(b.name) - 2 * ceil(0.41 * (length(a.name) + length(b.name)) - 1e-9)"""


def statements() -> dict[str, str]:
    return {
        "numeric_profile": _typed("""
SELECT dataset, col AS "column", n AS row_count, n - nn AS missing_count, nd AS unique_count,
  vmin AS min, vmax AS max, round_even(vmean, 4) AS mean, round_even(q2, 4) AS median,
  round_even(vstd, 4) AS std, vmode AS mode, nzero AS zero_count, nneg AS negative_count,
  CASE WHEN typ <> 'id' THEN round_even(q1, 4) END AS q25,
  CASE WHEN typ <> 'id' THEN round_even(q3, 4) END AS q75,
  CASE WHEN typ <> 'id' THEN nout END AS outlier_count
FROM typed WHERE kind IN ('int', 'float')""", *PROFILED),
        "missing_and_unique": _typed(
            f"SELECT dataset, col AS \"column\", n - nn AS missing_count, {_MPCT} AS missing_percentage,"
            f" nd AS unique_count, {_UPCT} AS unique_percentage FROM typed", *TYPED),
        "example_values": _examples(), "top_categories": _top_categories(),
        "rare_categories": _rare_categories(),
        "text_profile": _typed("""
SELECT dataset, col AS "column", nws AS whitespace_issue_count, nblank AS empty_string_count,
  ngroups AS case_variation_count, nuni AS unicode_issue_count
FROM typed WHERE typ = 'string' AND kind = 'text' AND nn > 0""", "dirty_customer", "documents", "part"),
        "date_profile": _date_profile(),
        "infer_types": _typed(
            f"SELECT dataset, col AS \"column\", typ AS inferred_type, {_ROLE} AS role, {_LABEL} AS label"
            " FROM typed", *TYPED),
        "table_roles": _typed("""
SELECT dataset, measures, attributes, CASE WHEN measures + attributes = 0 THEN 'unclassified'
  WHEN measures > attributes THEN 'fact' ELSE 'dimension' END AS table_role
FROM (SELECT dataset, count(*) FILTER (typ IN ('integer', 'float')) AS measures,
  count(*) FILTER (typ IN ('id', 'string', 'categorical')) AS attributes FROM typed GROUP BY dataset)""", *TYPED),
        "constant_columns": _typed("""
SELECT dataset, col AS "column", nd = 1 AND nn = n AS constant,
  nn > 0 AND NOT (nd = 1 AND nn = n) AND topc >= 0.95 * nn AS near_constant, nn = 0 AS empty
FROM typed""", "dirty_orders", "documents"),
        "dataset_counts": _dataset_counts(), "spelling_variants": _spelling_variants(),
        "multi_value_cells": _typed("""
SELECT dataset, col AS "column", nmulti AS cells, nmulti > 0.5 * nn AS multi_value
FROM typed WHERE kind = 'text' AND nn > 0""", "part", "dirty_orders", "documents", "events"),
        "date_parse": f"""{WITH},
d AS (SELECT order_date_text, {convention('dirty_orders', 'order_date_text')} AS conv FROM dirty_orders)
SELECT order_date_text, {date_status('order_date_text', 'conv')} AS status,
  {date_iso('order_date_text', 'conv')} AS iso, count(*) AS n FROM d GROUP BY ALL""",
        "currency_parse": f"""{WITH}
SELECT order_id, amount_text, CASE WHEN {money_high('amount_text')} THEN
    {_amount_text('amount_text')}::DOUBLE END AS value,
  {currency('amount_text')} AS currency,
  CASE WHEN lower(trim(amount_text)) = 'not available' THEN 'MISSING'
    WHEN {money_high('amount_text')} THEN 'HIGH' ELSE 'INVALID' END AS confidence FROM dirty_orders""",
        "email_validate": _email(),
        "contact_keys": rf"""{WITH}
SELECT {collapse('full_name')} AS name, regexp_replace(phone, '\D+', '', 'g') AS phone,
  coalesce('email:' || substr(lower(trim(email)), 1, 3),
    'phone:' || right(regexp_replace(phone, '\D+', '', 'g'), 6)) AS block FROM dirty_customer""",
        "coerce_numbers": rf"""{WITH}
SELECT qty_text, count(*) AS n, try_cast(qty_text AS DOUBLE) AS number,
  regexp_matches(qty_text, '^-?\d+(\.\d+)?$') AS numeric_like FROM dirty_orders GROUP BY qty_text""",
        "placeholder_cells": f"""{WITH}
SELECT segment, count(*) AS n, lower(trim(segment)) = 'n/a' AS is_placeholder,
  lower({collapse('segment')}) AS spelling_key,
  CASE WHEN lower(trim(segment)) <> 'n/a' THEN segment END AS cleaned FROM dirty_customer GROUP BY segment""",
        "header_checks": """SELECT * FROM (VALUES
  ('supplier', 4, 0, 1, 'fail', (SELECT count(*) FROM supplier)),
  ('part', 4, 0, 0, 'pass', (SELECT count(*) FROM part)),
  ('nation', 4, 1, 2, 'fail', (SELECT count(*) FROM nation)))
  t(dataset, column_count, duplicate_names, unnamed_headers, status, row_count)""",
        "clean_names": """SELECT t.* FROM (VALUES
  ('supplier', 'Supplier Key', 'supplier_key', (SELECT count(s_suppkey) FROM supplier)),
  ('supplier', 'Unnamed: 1', 'unnamed_1', (SELECT count(s_name) FROM supplier)),
  ('supplier', 'nation-key', 'nation_key', (SELECT count(s_nationkey) FROM supplier)),
  ('supplier', 'Nation-Key.1', 'nation_key_1', (SELECT count(s_acctbal) FROM supplier)),
  ('part', ' Part Key ', 'part_key', (SELECT count(p_partkey) FROM part)),
  ('part', 'Brand (UTF-8)', 'brand_utf_8', (SELECT count(p_brand) FROM part)),
  ('part', '%%', 'column', (SELECT count(p_type) FROM part)),
  ('part', 'size', 'size', (SELECT count(p_size) FROM part)),
  ('nation', 'key', 'key', (SELECT count(n_nationkey) FROM nation)),
  ('nation', 'key.1', 'key_1', (SELECT count(n_name) FROM nation)),
  ('nation', 'Unnamed: 2', 'unnamed_2', (SELECT count(n_regionkey) FROM nation)),
  ('nation', 'Unnamed: 3', 'unnamed_3', (SELECT count(n_name) FROM nation)))
  t(dataset, "column", clean_name, filled)""",
        "scan_quoted_csv": """SELECT doc_id, '9' || lpad(doc_id::VARCHAR, 24, '0') AS wide_id,
  md5('say "' || doc_id || '", ' || text || chr(10) || ',"') AS text_md5, lang FROM documents""",
        "scan_blank_cells": """SELECT count(*) AS row_count,
  count(*) FILTER (p_partkey % 4 = 3) AS brands, count(*) FILTER (p_partkey % 5 <> 0) AS sizes,
  sum(p_size) FILTER (p_partkey % 5 <> 0)::BIGINT AS size_sum FROM part""",
        "odd_headers": """SELECT 'o''brien.csv' AS dataset, c AS "column", n AS affected_count, s AS status,
  CASE WHEN s = 'apply' THEN n END AS changed FROM (VALUES
  ('owner''s note', (SELECT count(*) FROM customer WHERE c_custkey % 3 = 0), 'apply'),
  ('ssn' || chr(9), (SELECT count(*) FROM customer WHERE c_custkey % 4 = 0), 'skipped_protected'),
  ('a.b', (SELECT count(*) FROM customer WHERE c_custkey % 5 = 0), 'apply')) t(c, n, s)""",
        "long_cells": """WITH k AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'Long' WHEN o_orderkey % 7 < 3
  THEN 'long' ELSE 'other' END || repeat('x', 300) AS v, min(o_orderkey) AS first, count(*) AS n
  FROM orders GROUP BY 1)
SELECT 'day' AS "column", 'date' AS inferred_type, count(DISTINCT o_orderkey % 50) AS unique_count,
  0::BIGINT AS invalid_dates,
  strftime(min(DATE '2024-01-01' + (o_orderkey % 50)::INT), '%Y-%m-%dT%H:%M:%S') AS first_date,
  0::BIGINT AS money_values, NULL::VARCHAR AS top_values, NULL::INT AS spelling_groups FROM orders
UNION ALL SELECT 'amount', 'string', count(*), NULL, NULL, count(*), NULL, NULL FROM orders
UNION ALL SELECT 'kind', 'categorical', count(*), NULL, NULL, 0,
  string_agg(md5(v), '|' ORDER BY n DESC, first), 1 FROM k""",
        **{name: issue_query(*names, types=types) for name, (names, types) in DETECTORS.items()},
        "all_issues": issue_query(*SCORED),
        "issue_examples": f"{WITH}\n" + _union([
            f"""SELECT '{d}' AS dataset, '{c}' AS "column", '{issue}' AS issue_type,
  string_agg(v, '|' ORDER BY v) AS examples FROM (SELECT DISTINCT {c} AS v FROM {d} WHERE {condition}
  ORDER BY v LIMIT 5) HAVING count(*) > 0"""
            for d, c, issue, condition in (
                ("dirty_customer", "segment", "missing_value_placeholder", "lower(trim(segment)) = 'n/a'"),
                ("dirty_customer", "email", "invalid_email", bad_email("email")),
                ("dirty_orders", "order_date_text", "missing_value_placeholder",
                 "lower(trim(order_date_text)) = 'n/a'"),
                ("dirty_orders", "amount_text", "missing_value_placeholder",
                 "lower(trim(amount_text)) = 'not available'"),
                ("dirty_orders", "priority", "missing_value_placeholder", "lower(trim(priority)) = 'unknown'"),
                ("dirty_orders", "qty_text", "mixed_data_types",
                 r"NOT regexp_matches(qty_text, '^-?\d+(\.\d+)?$')"))]),
        "required_columns": """SELECT * FROM (VALUES
  ('dirty_orders', 'missing_required_column', 1::BIGINT, 'Required column(s) missing: ship_date'),
  ('dirty_customer', 'missing_required_column', 2::BIGINT, 'Required column(s) missing: country, iban'))
  t(dataset, issue_type, affected_count, description)""",
        "decisions": _decisions(
            'SELECT dataset, "column", issue_type, confidence, act_order, status FROM d'),
        "skip_counters": _decisions("""
SELECT dataset, count(*) FILTER (status = 'flagged_for_review') AS skipped_low_confidence,
  count(*) FILTER (status = 'skipped_protected') AS skipped_protected_columns FROM d GROUP BY dataset"""),
        "cleaned_orders": f"{WITH},\n{_ORDER_STEPS}\n{_CLEAN_ORDERS}",
        "cleaned_customers": f"{WITH},\n{_CUSTOMER_STEPS}\n{_CLEAN_CUSTOMERS}",
        "sink_roundtrip": f"{WITH},\n{_CUSTOMER_STEPS}\n{_CLEAN_CUSTOMERS}",
        "change_log_orders": f"{WITH},\n{_ORDER_STEPS}\n{_ORDER_CHANGES}",
        "change_log_customers": f"{WITH},\n{_CUSTOMER_STEPS}\n{_CUSTOMER_CHANGES}",
        "cleaning_log": _cleaning_log(),
        "audit_rows": f"{WITH},\n{_audit_counts()}\nSELECT * FROM audited",
        "log_append": f"""{WITH},
{_audit_counts()}
SELECT run_id, issue_type, status, sum(audit_rows)::BIGINT AS audit_rows
FROM audited, (VALUES ('r1'), ('r2')) r(run_id) GROUP BY ALL""",
        "validation_checks": f"{WITH},\n{typed_facts(*SCORED)},\n{_checks(SCORED)}\nSELECT * FROM checks",
        "business_rules": f"""{WITH}, c AS (SELECT count(*) AS rows,
  {_RULES['dirty_orders'][0]} AS bad, {_RULES['dirty_orders'][1]} AS unknown FROM dirty_orders)
SELECT 'dirty_orders' AS dataset, rows, rule, CASE WHEN i = 1 THEN bad ELSE 0 END AS violations,
  CASE WHEN i = 1 THEN unknown ELSE 0 END AS unverifiable FROM c, (VALUES (0, 'end_date_before_start_date'),
  (1, 'total_not_equal_subtotal_plus_tax'), (2, 'revenue_not_equal_quantity_times_price')) r(i, rule)""",
        "publish_gate": _gate(), "quality_score": _quality_query(False),
        "validated_score": _quality_query(True), "before_after": _before_after(),
        **{f"readiness_{p}": _readiness(_pack_rows([p])) for p in PACK_CHECKS},
        "readiness_scores": _readiness(
            _SCORE.format(checks="(" + _pack_rows(list(PACK_CHECKS)) + ")")),
        "field_roles": _typed(
            "SELECT * FROM (" + _union([
                f"SELECT dataset, col AS \"column\", '{p}' AS platform, {_field_label(p)} AS label FROM typed"
                for p in PACK_CHECKS]) + ") WHERE label IS NOT NULL", "dirty_orders", "dirty_customer"),
        "orphan_keys": _linked("""
SELECT 'orders.csv' AS dataset, 'customer_id' AS "column", 'customers.csv' AS "references",
  (SELECT count(*) FROM orphans) AS orphan_count, (SELECT string_agg(k, '|' ORDER BY k) FROM
  (SELECT customer_id::VARCHAR AS k FROM orphans ORDER BY k LIMIT 5)) AS orphan_examples"""),
        "relationship_readiness": _linked_scores(),
        "near_duplicate_groups": f"{WITH},\n{_pairs('dirty_customer', 'customer_id')}",
        "cleaning_rows": f"""{WITH},\n{_audit_counts()}
SELECT 'r1' AS run_id, "column", issue_type, confidence, audit_rows AS log_rows
FROM audited WHERE status = 'applied'""",
        "isolated_run": """SELECT dataset, stage, status, row_count, scored, NOT scored AS explained
FROM (SELECT 'nation.parquet' AS dataset, 'report' AS stage, 'ok' AS status, count(*) AS row_count,
             true AS scored FROM nation
      UNION ALL SELECT 'customer.parquet', 'report', 'ok', count(*), true FROM customer
      UNION ALL VALUES ('part.parquet', 'analyze', 'failed', NULL, false),
                       ('supplier.parquet', 'analyze', 'failed', NULL, false),
                       ('damaged.parquet', 'load', 'failed', NULL, false),
                       ('gone.csv', 'load', 'failed', NULL, false))""",
        "close_names": _close_names(),
        "near_duplicate_contacts": f"WITH contacts AS ({inputs.CONTACTS}),\n{_pairs('contacts', 'contact_id')}",
        "lineage": f"WITH {_LINEAGE}\n{_lineage_rows()}",
        "data_dictionary": _dictionary(),
        "drift_findings": f"{_history()}\nSELECT * FROM findings",
        "drift_summary": f"""{_history()}
SELECT 'orders' AS dataset, r.run_id, p.old AS compared_against, (SELECT count(*) FROM findings f
  WHERE f.run_id = r.run_id) AS finding_count, CASE WHEN p.old IS NULL THEN 'no_history'
  WHEN EXISTS (SELECT 1 FROM findings f WHERE f.run_id = r.run_id) THEN 'drift_detected' ELSE 'no_drift' END
  AS overall_status FROM (VALUES ('1997'), ('1998'), ('1999')) r(run_id) LEFT JOIN prev p ON p.run_id = r.run_id""",
        "history_latest": f"""{_history()}
SELECT 'orders' AS dataset, run_id, col AS "column", typ AS inferred_type, n AS row_count FROM h
WHERE run_id = '1998'""",
        "scan_csv": "SELECT p_partkey, p_name, p_brand, p_type, p_size::BIGINT AS p_size, p_retailprice FROM part",
        "scan_ragged_csv": """SELECT count(*) FILTER (p_partkey % 10 <> 3) AS row_count,
  count(*) FILTER (p_partkey % 10 NOT IN (3, 4)) AS with_type,
  sum(p_partkey) FILTER (p_partkey % 10 <> 3)::BIGINT AS key_sum,
  count(*) FILTER (p_partkey % 10 = 3) AS skipped_rows FROM part""",
        "scan_json": "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation",
        "scan_xml": "SELECT p_partkey, p_name, p_brand, p_type, p_size::BIGINT AS p_size, p_retailprice FROM part",
        "scan_foreign_xml": """SELECT p_partkey::BIGINT AS key, p_name AS name, NULL::BIGINT AS v FROM part
UNION ALL SELECT NULL, NULL, 1 FROM range(2)""",
        "scan_feather": "SELECT * FROM part",
        "scan_folder": """SELECT * FROM (VALUES
  ('nation.parquet', 'parquet', 'loaded', (SELECT count(*) FROM nation)),
  ('region.json', 'json', 'loaded', (SELECT count(*) FROM region)),
  ('supplier.csv', 'csv', 'loaded', (SELECT count(*) FROM supplier)),
  ('notes.docx', NULL, 'failed', NULL), ('gone.parquet', 'parquet', 'failed', NULL))
  t(dataset, format, status, row_count)""",
        "row_id_scan": "SELECT count(*) AS row_count, count(*) AS ids, 5::BIGINT AS files FROM orders",
        "table_fingerprint": "SELECT count(*) AS row_count, true AS order_free FROM orders",
    }
