"""Numeric coercion, currency parsing and report rounding, as SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.text import column as quoted, one_of_lowered, raw, strip

# Currency symbols, their codes, and the tokens meaning "no amount".
CURRENCY_SYMBOLS = {"₹": "INR", "$": "USD", "€": "EUR", "£": "GBP"}
CURRENCY_MISSING = [
    "not available", "unavailable", "unknown", "n/a", "na", "null", "none",
    "-", "--", "",
]
# Fixed value: [symbol] [code] [(] [sign] number [)] [code]
CURRENCY_PATTERN = (
    r"(?i)^([₹$€£])?\s*(RS\.?|INR|USD|EUR|GBP)?\s*(\()?\s*([+-])?\s*"
    r"([\d,]+(?:\.\d+)?)\s*(?:\))?\s*(INR|USD|EUR|GBP)?$"
)

_THOUSANDS = r",\d{3}"
_COERCIBLE = r"(?i)^[+-]?(?:\d+\.?\d*(?:e[+-]?\d+)?|\.\d+(?:e[+-]?\d+)?|inf|infinity)$"


def has_currency_hint(c: str, lowered: str) -> str:
    """Whether a text holds a hint of money: a symbol, a code in any case, a thousands group.

    ``lowered`` is the text in lower case, its white space in any form.
    """
    # looking for fixed texts is far cheaper than a pattern of alternatives
    held = [f"contains({c}, '{s}')" for s in CURRENCY_SYMBOLS] + [
        f"contains({lowered}, '{code.lower()}')" for code in CURRENCY_SYMBOLS.values()]
    return f"({' OR '.join(held)} OR {c} RLIKE {raw(_THOUSANDS)})"


def to_number(c: str, stripped: bool = False) -> str:
    """Text to double, NULL where the whole text is not a number.

    The pattern guard comes first: a bare cast would also accept suffixes such as '1d'.
    """
    text = c if stripped else strip(c)
    return f"CASE WHEN {text} RLIKE {raw(_COERCIBLE)} THEN try_cast({text} AS double) END"


def finite_or_null(c: str) -> str:
    return f"CASE WHEN NOT isnan({c}) AND abs({c}) < double('Infinity') THEN {c} END"


def half_even(c: Column, digits: int = 0) -> Column:
    # adding 0.0 turns -0.0 into 0.0
    return F.bround(c, digits) + F.lit(0.0)


def add_currency(df: DataFrame, column: str, into: str, stripped: bool = False) -> DataFrame:
    """Add struct(value, text, currency, confidence); confidence is HIGH, MISSING or INVALID.

    ``text`` is the number as a cleaned cell holds it: no separators, at least one decimal.
    ``stripped`` says that the column has no white space around its texts.
    """
    c = quoted(column)
    t, parts, missing, digits, high, negative = (
        f"{into}__{n}" for n in ("raw", "parts", "missing", "digits", "high", "negative"))
    by_symbol = " ".join(f"WHEN '{s}' THEN '{code}'" for s, code in CURRENCY_SYMBOLS.items())
    marker = f"upper(coalesce(nullif({parts}[1], ''), nullif({parts}[5], '')))"
    decimal = f"CASE WHEN contains({digits}, '.') THEN {digits} ELSE concat({digits}, '.0') END"
    plain = (f"regexp_replace(regexp_replace({decimal}, {raw(r'^0+(?=[0-9])')}, ''),"
             f" {raw(r'([.][0-9]+?)0+$')}, '$1')")
    keep = [quoted(n) for n in df.columns]
    return (
        df.selectExpr("*", f"{c if stripped else strip(c)} AS {t}")
        # symbol|code|paren|sign|number|suffix; the separator cannot occur in a match
        .selectExpr("*", f"""CASE WHEN {t} RLIKE {raw(CURRENCY_PATTERN)} THEN split(regexp_replace(
            {t}, {raw(CURRENCY_PATTERN)}, '$1|$2|$3|$4|$5|$6'), '[|]') END AS {parts}""",
                    f"({c} IS NULL OR {one_of_lowered(t, CURRENCY_MISSING)}) AS {missing}")
        .selectExpr("*", f"replace({parts}[4], ',', '') AS {digits}",
                    f"({parts}[3] = '-' OR {parts}[2] = '(') AS {negative}")
        .selectExpr("*", f"coalesce({digits} != '', false) AS {high}")
        .selectExpr(*keep, f"""named_struct(
            'value', CASE WHEN {high} THEN
                CASE WHEN {negative} THEN -1 ELSE 1 END * try_cast({digits} AS double) END,
            'text', CASE WHEN {high} THEN
                concat(CASE WHEN {negative} THEN '-' ELSE '' END, {plain}) END,
            'currency', CASE WHEN {high} THEN coalesce(
                CASE {parts}[0] {by_symbol} END,
                CASE WHEN {marker} IN ('RS', 'RS.') THEN 'INR' ELSE {marker} END) END,
            'confidence', CASE
                WHEN {missing} THEN 'MISSING'
                WHEN {high} THEN 'HIGH' ELSE 'INVALID' END) AS {into}"""))
