"""DuckDB statements that compute the same results as the registered queries."""

from __future__ import annotations

import re

from plumbline.plans.inputs import DIRTY_CUSTOMER, DIRTY_ORDERS

AS_OF = "1998-06-01"

WITH = f"WITH dirty_orders AS ({DIRTY_ORDERS}),\ndirty_customer AS ({DIRTY_CUSTOMER})"

# dataset -> [(column, kind)]
TABLES = {
    "orders": [("o_orderkey", "int"), ("o_custkey", "int"), ("o_orderstatus", "text"),
               ("o_totalprice", "float"), ("o_orderdate", "time"), ("o_orderpriority", "text")],
    "customer": [("c_custkey", "int"), ("c_name", "text"), ("c_nationkey", "int"),
                 ("c_acctbal", "float"), ("c_mktsegment", "text")],
    "part": [("p_partkey", "int"), ("p_name", "text"), ("p_brand", "text"), ("p_type", "text"),
             ("p_size", "int"), ("p_retailprice", "float")],
    "lineitem": [("l_orderkey", "int"), ("l_partkey", "int"), ("l_suppkey", "int"),
                 ("l_linenumber", "int"), ("l_quantity", "float"), ("l_extendedprice", "float"),
                 ("l_discount", "float"), ("l_tax", "float"), ("l_returnflag", "text"),
                 ("l_linestatus", "text"), ("l_shipdate", "time")],
    "events": [("event_id", "int"), ("ts", "time"), ("user_id", "int"), ("event_type", "text"),
               ("value", "float"), ("props", "text")],
    "documents": [("doc_id", "int"), ("text", "text"), ("lang", "text"), ("source", "text"),
                  ("n_chars", "int")],
    "pages": [("page_id", "int"), ("url", "text"), ("html", "text")],
    "conversations": [("conv_id", "int"), ("turn", "int"), ("role", "text"), ("text", "text")],
    "dirty_orders": [("order_id", "int"), ("customer_id", "int"), ("order_date_text", "text"),
                     ("amount_text", "text"), ("qty_text", "text"), ("priority", "text"),
                     ("age", "int"), ("quantity", "int"), ("subtotal", "float"), ("tax", "float"),
                     ("total", "float"), ("const_flag", "text"), ("empty_note", "text")],
    "dirty_customer": [("customer_id", "int"), ("full_name", "text"), ("email", "text"),
                       ("phone", "text"), ("segment", "text"), ("zip_code", "text"),
                       ("balance", "float")],
}
NUMBERS = ("int", "float")

_WS = (r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}"
       r"\x{205f}\x{3000}]")
_PLACEHOLDER = ("'na','n/a','n.a.','null','none','-','--','?','unknown','not available',"
                "'blank','empty',''")
_MONEY = (r"^\s*([₹$€£])?\s*(RS\.?|INR|USD|EUR|GBP)?\s*(\()?\s*([+-])?\s*"
          r"([\d,]+(?:\.\d+)?)\s*(\))?\s*(INR|USD|EUR|GBP)?\s*$")
_EMAIL = r"^[A-Za-z0-9!#$%&''*+/=?^_`{|}~.-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+$"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


def collapse(c: str) -> str:
    return strip(f"regexp_replace({c}, '{_WS}+', ' ', 'g')")


def money_high(c: str) -> str:
    number = f"replace(regexp_extract(trim({c}), '{_MONEY}', 5, 'i'), ',', '')"
    return (f"(regexp_matches(trim({c}), '{_MONEY}', 'i') AND {number} <> ''"
            f" AND lower(trim({c})) NOT IN ('not available','unavailable','unknown','n/a','na',"
            "'null','none','-','--',''))")


def currency(c: str) -> str:
    def g(i):
        return f"regexp_extract(trim({c}), '{_MONEY}', {i}, 'i')"
    return (f"CASE WHEN {money_high(c)} THEN coalesce(CASE {g(1)} WHEN '₹' THEN 'INR' WHEN '$' THEN 'USD'"
            f" WHEN '€' THEN 'EUR' WHEN '£' THEN 'GBP' END, CASE WHEN rtrim(upper(concat({g(2)}, CASE WHEN"
            f" {g(2)} = '' THEN {g(7)} ELSE '' END)), '.') = 'RS' THEN 'INR' ELSE"
            f" nullif(upper(concat({g(2)}, CASE WHEN {g(2)} = '' THEN {g(7)} ELSE '' END)), '') END) END")


def bad_email(c: str) -> str:
    return (f"(NOT regexp_matches(lower(trim({c})), '{_EMAIL}') OR contains(trim({c}), ' ')"
            f" OR length(trim({c})) - length(replace(trim({c}), '@', '')) <> 1)")


def _numeric_date(c: str, i: int) -> str:
    return rf"try_cast(regexp_extract(trim({c}), '^(\d{{1,2}})[/\-.](\d{{1,2}})[/\-.](\d{{2,4}})$', {i}) AS INT)"


def date_iso(c: str, convention: str = "''") -> str:
    """ISO text of a readable date: year first, 'Jan 7, 2026', or numeric."""
    a, b, y = (_numeric_date(c, i) for i in (1, 2, 3))
    year = f"CASE WHEN {y} < 70 THEN {y} + 2000 WHEN {y} < 100 THEN {y} + 1900 ELSE {y} END"

    def build(m, d):
        return (f"CASE WHEN {year} BETWEEN 1900 AND 2100 THEN try_cast(concat(({year})::VARCHAR, '-',"
                f" lpad({m}::VARCHAR, 2, '0'), '-', lpad({d}::VARCHAR, 2, '0')) AS DATE) END")
    return rf"""strftime(CASE
        WHEN regexp_matches(trim({c}), '^\d{{4}}-\d{{1,2}}-\d{{1,2}}$') THEN try_strptime(trim({c}), '%Y-%m-%d')
        WHEN regexp_matches(trim({c}), '^[A-Za-z]{{3}} \d{{1,2}}, \d{{4}}$') THEN try_strptime(trim({c}), '%b %d, %Y')
        WHEN {a} > 12 AND {b} <= 12 THEN {build(b, a)}::TIMESTAMP
        WHEN {b} > 12 AND {a} <= 12 THEN {build(a, b)}::TIMESTAMP
        WHEN {a} <= 12 AND {b} <= 12 AND {convention} = 'DD/MM' THEN {build(b, a)}::TIMESTAMP
        WHEN {a} <= 12 AND {b} <= 12 AND {convention} = 'MM/DD' THEN {build(a, b)}::TIMESTAMP
        END, '%Y-%m-%d')"""


_DATE_MISSING = ("'','na','n/a','null','none','unknown','not available','-','--','nan','nat'")


def date_status(c: str, convention: str = "''") -> str:
    a, b = (_numeric_date(c, i) for i in (1, 2))
    return (f"CASE WHEN {c} IS NULL OR lower(trim({c})) IN ({_DATE_MISSING}) THEN 'missing'"
            f" WHEN {date_iso(c, convention)} IS NOT NULL THEN 'parsed'"
            f" WHEN {a} <= 12 AND {b} <= 12 THEN 'ambiguous' ELSE 'invalid' END")


def convention(table: str, c: str) -> str:
    a, b = (_numeric_date(c, i) for i in (1, 2))
    return (f"(SELECT CASE WHEN bool_or({a} > 12 AND {b} <= 12) AND NOT bool_or({b} > 12 AND {a} <= 12)"
            f" THEN 'DD/MM' WHEN bool_or({b} > 12 AND {a} <= 12) AND NOT bool_or({a} > 12 AND {b} <= 12)"
            f" THEN 'MM/DD' ELSE '' END FROM {table} WHERE {c} IS NOT NULL)")


_DATE_LIKE = (r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}"
              r"|(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{1,2},?\s+\d{4}")
DATE_COLUMNS = {"order_date_text"}
_RANGES = [("age", 0, 120), ("percent|pct", 0, 100), ("rating", 1, 5)]
_MONEY_NAME = "amount|price|revenue|cost|salary|fee|amt|total|subtotal|tax"


def column_facts(dataset: str, source: str | None = None, columns=None) -> str:
    """UNION ALL of one row of statistics per column."""
    t = source or dataset
    rows = []
    for position, (c, kind) in enumerate(columns or TABLES[dataset]):
        text, num, time = kind == "text", kind in NUMBERS, kind == "time"
        low, high = next(((lo, hi) for p, lo, hi in _RANGES if re.search(p, c, re.I)), (None, None))
        v = f'"{c}"'
        d = f"{v}::DOUBLE" if num else "NULL::DOUBLE"
        q = [f"quantile_cont({d}, {p})" for p in (0.25, 0.5, 0.75)]
        fences = (f"(SELECT quantile_cont({d}, 0.25) - 1.5 * (quantile_cont({d}, 0.75) - quantile_cont({d}, 0.25)) AS lo,"
                  f" quantile_cont({d}, 0.75) + 1.5 * (quantile_cont({d}, 0.75) - quantile_cont({d}, 0.25)) AS hi FROM {t})")
        dated = c in DATE_COLUMNS
        conv = convention(t, v) if dated else "''"

        def count(condition, on=True):
            return f"count(*) FILTER ({condition})" if on else "0::BIGINT"

        def scalar(expression, on=True):
            return f"(SELECT {expression} FROM {t})" if on else "0::BIGINT"

        is_id = bool(re.search(r"(^|_)id$|^id(_|$)", c.lower()))
        a, b = _numeric_date(v, 1), _numeric_date(v, 2)
        slashed = rf"regexp_matches(trim({v}), '^\d{{1,2}}/\d{{1,2}}/(\d{{2}}|\d{{4}})$')"
        rows.append(f"""SELECT '{dataset}' AS dataset, {position} AS pos, '{c}' AS col, '{kind}' AS kind,
  {is_id} AS named_id, count(*) AS n, count({v}) AS nn, count(DISTINCT {v}) AS nd,
  coalesce((SELECT max(k) FROM (SELECT count(*) AS k FROM {t} WHERE {v} IS NOT NULL GROUP BY {v})), 0) AS topc,
  {f'min({d})' if num else 'NULL::DOUBLE'} AS vmin, {f'max({d})' if num else 'NULL::DOUBLE'} AS vmax,
  {f'avg({d})' if num else 'NULL::DOUBLE'} AS vmean, {f'stddev_samp({d})' if num else 'NULL::DOUBLE'} AS vstd,
  {f'(SELECT {d} FROM {t} WHERE {v} IS NOT NULL GROUP BY {v} ORDER BY count(*) DESC, {v} LIMIT 1)' if num else 'NULL::DOUBLE'} AS vmode,
  {q[0] if num else 'NULL::DOUBLE'} AS q1, {q[1] if num else 'NULL::DOUBLE'} AS q2, {q[2] if num else 'NULL::DOUBLE'} AS q3,
  {f'(SELECT count(*) FROM {t}, {fences} f WHERE {d} < f.lo OR {d} > f.hi)' if num else '0::BIGINT'} AS nout,
  {count(f'{v} = 0', num)} AS nzero, {count(f'{v} < 0', num)} AS nneg, {count(f'{d} % 1 <> 0', num)} AS nfrac,
  {count(f'{v}::TIMESTAMP <> {v}::DATE::TIMESTAMP', time)} AS ntimed,
  {count(f"{v}::TIMESTAMP > TIMESTAMP '{AS_OF}'", time)} AS nfuture_time,
  {count(f'{v} < {low} OR {v} > {high}', num and low is not None)} AS noor,
  {count(f"regexp_matches({v}, '^{_WS}|{_WS}$|{_WS}{{2}}')", text)} AS nws,
  {count(f"{strip(v)} = ''", text)} AS nblank,
  {count(rf"regexp_matches({v}, '[\x00-\x08\x0b-\x1f\x7f]|[^\x00-\x7f]')", text)} AS nuni,
  {count(f"lower({strip(v)}) IN ({_PLACEHOLDER})", text)} AS nph,
  {count(rf"regexp_matches({strip(v)}, '^-?\d+(\.\d+)?$')", text)} AS nlike,
  {count(f"regexp_matches({v}, '[,;|]')", text)} AS nmulti,
  {count(bad_email(v), text and 'email' in c)} AS nmail,
  {count(rf"regexp_matches({v}, '[₹$€£]|INR|USD|EUR|GBP|,\d{{3}}', 'i')", text)} AS nhint,
  {count(rf"{money_high(v)} AND NOT regexp_matches(trim({v}), '^-?\d+(\.\d+)?$')", text)} AS nmoney,
  {scalar(f'count(DISTINCT {currency(v)})', text)} AS ncur,
  {count(f"{date_status(v)} IN ('parsed', 'ambiguous')", text and dated)} AS ndate,
  {count(f"{v} IS NOT NULL AND {date_status(v, conv)} = 'invalid'", dated)} AS dinvalid,
  {count(f"{v} IS NOT NULL AND {date_status(v, conv)} = 'ambiguous'", dated)} AS dambiguous,
  {count(f"{v} IS NOT NULL AND {date_status(v, conv)} = 'parsed' AND {date_iso(v, conv)} > '{AS_OF}'", dated)} AS dfuture,
  {f'bool_or({slashed} AND {a} > 12)' if dated else 'false'} AS sdm,
  {f'bool_or({slashed} AND {a} <= 12 AND {b} > 12)' if dated else 'false'} AS smd,
  {f'bool_or({slashed} AND {a} <= 12 AND {b} <= 12)' if dated else 'false'} AS samb,
  {scalar(f"count(*) FROM (SELECT lower({collapse(v)}) AS k FROM {t} WHERE {v} IS NOT NULL GROUP BY 1 HAVING count(DISTINCT {v}) > 1)", False) if not text else f"(SELECT count(*) FROM (SELECT lower({collapse(v)}) AS k FROM {t} WHERE {v} IS NOT NULL GROUP BY 1 HAVING count(DISTINCT {v}) > 1))"} AS ngroups,
  {f"(SELECT coalesce(sum(s), 0)::BIGINT FROM (SELECT count(DISTINCT {v}) AS s FROM {t} WHERE {v} IS NOT NULL GROUP BY lower({collapse(v)}) HAVING count(DISTINCT {v}) > 1))" if text else '0::BIGINT'} AS nspell,
  {low if low is not None else 'NULL'}::DOUBLE AS rlow,
  {bool(re.search(_MONEY_NAME, c, re.I))} AS money_name, {bool(re.search('email', c, re.I))} AS mail_name,
  {bool(re.search('quantity|count', c, re.I))} AS count_name, {c.lower().endswith('_id')} AS link_name,
  {bool(re.search('country|state|city|region|zip|postal|latitude|longitude', c, re.I))} AS geo_name,
  {bool(re.search('target|label|outcome|churn|default|class|y$', c, re.I))} AS target_name
FROM {t}""")
    return "\nUNION ALL\n".join(rows)


TYPE = """CASE WHEN nn = 0 THEN 'string'
 WHEN kind = 'time' THEN CASE WHEN ntimed > 0 THEN 'datetime' ELSE 'date' END
 WHEN kind IN ('int', 'float') THEN CASE WHEN nfrac > 0 THEN 'float'
   WHEN named_id AND nd >= 0.9 * nn THEN 'id' ELSE 'integer' END
 WHEN 2 * ndate > nn THEN 'date' WHEN named_id AND nd >= 0.9 * nn THEN 'id'
 WHEN 2 * nd <= nn AND nd <= 50 THEN 'categorical' ELSE 'string' END"""


def typed_facts(*datasets: str, sources: dict[str, str] | None = None, columns=None) -> str:
    """CTEs ending in ``typed``: column facts with the semantic type."""
    facts = "\nUNION ALL\n".join(
        column_facts(d, (sources or {}).get(d), (columns or {}).get(d)) for d in datasets)
    return f"raw AS ({facts}),\ntyped AS (SELECT *, {TYPE} AS typ FROM raw)"


_M = "kind = 'text' AND nn > 0 AND (money_name OR nhint > 0.2 * nn)"
ISSUE_RULES = [
    ("missing_value_placeholder", "'medium'", "kind = 'text' AND nph > 0 AND nph < nn", "nph"),
    ("duplicate_id", "'critical'", "typ = 'id' AND nn > nd", "nn - nd"),
    ("mixed_data_types", "'medium'", "kind = 'text' AND typ IN ('string', 'categorical') AND nn > 0"
     " AND nlike >= 0.7 * nn AND nlike < nn", "nn - nlike"),
    ("category_inconsistency", "'low'", "typ = 'categorical' AND nspell > 0", "nspell"),
    ("whitespace_formatting", "'low'", "kind = 'text' AND typ <> 'id' AND nws > 0", "nws"),
    ("invalid_date", "'high'", "typ = 'date' AND dinvalid > 0", "dinvalid"),
    ("future_date", "'medium'", "typ IN ('date', 'datetime') AND dfuture + nfuture_time > 0",
     "dfuture + nfuture_time"),
    ("ambiguous_date", "'medium'", "typ = 'date' AND dambiguous > 0", "dambiguous"),
    ("ambiguous_date_format", "'high'",
     "typ = 'date' AND ((sdm AND smd) OR ((sdm OR smd) AND samb))", "0"),
    ("impossible_value", "'high'", "rlow IS NOT NULL AND noor > 0", "noor"),
    ("negative_value", "'medium'", "count_name AND nneg > 0", "nneg"),
    ("outlier", "CASE WHEN vmin < q1 - 3 * (q3 - q1) OR vmax > q3 + 3 * (q3 - q1) THEN 'high' ELSE 'medium' END",
     "typ IN ('integer', 'float') AND nout > 0", "nout"),
    ("constant_column", "'low'", "nd = 1 AND nn = n", "n"),
    ("empty_column", "'medium'", "nn = 0", "n"),
    ("high_cardinality", "'low'",
     "typ = 'string' AND nn > 0 AND round_even(nd * 100.0 / nn, 4) > 95 AND n > 10", "nd"),
    ("invalid_email", "'high'", "mail_name AND nmail > 0", "nmail"),
    ("currency_value", "'low'", f"{_M} AND nmoney > 0", "nmoney"),
    ("currency_inconsistency", "'high'", f"{_M} AND ncur > 1", "nn"),
]


def copies(dataset: str, source: str | None = None) -> str:
    t = source or dataset
    return (f"SELECT '{dataset}' AS dataset, (SELECT count(*) FROM {t}) AS row_count,"
            f" (SELECT count(*) FROM {t}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {t})) AS dups")


def issues_cte(*datasets: str, sources: dict[str, str] | None = None) -> str:
    """CTE ``issues`` on top of ``typed``."""
    rows = [f"SELECT dataset, col AS \"column\", '{name}' AS issue_type, {severity} AS severity,"
            f" ({affected})::BIGINT AS affected_count FROM typed WHERE {condition}"
            for name, severity, condition, affected in ISSUE_RULES]
    for d in datasets:
        rows.append(f"SELECT dataset, NULL, 'duplicate_rows', 'high', dups FROM"
                    f" ({copies(d, (sources or {}).get(d))}) WHERE dups > 0")
    return "issues AS (" + "\nUNION ALL\n".join(rows) + ")"


POLICY = """policy(issue_type, confidence, act_order) AS (VALUES
 ('empty_column', 'HIGH', 0), ('duplicate_rows', 'HIGH', 1), ('whitespace_formatting', 'HIGH', 2),
 ('missing_value_placeholder', 'MEDIUM', 3), ('category_inconsistency', 'MEDIUM', 4),
 ('invalid_date', 'MEDIUM', 5), ('currency_value', 'HIGH', 6))"""


def issue_query(*datasets: str, types: list[str] | None = None) -> str:
    where = ""
    if types:
        where = " WHERE issue_type IN (" + ", ".join(f"'{t}'" for t in types) + ")"
    return f"{WITH},\n{typed_facts(*datasets)},\n{issues_cte(*datasets)}\nSELECT * FROM issues{where}"
