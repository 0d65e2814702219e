"""Date recognition on text cells.

Parsing is split in two so that one scan serves every column convention:
``add_reading`` looks at a single cell and keeps both readings of a numeric date whose parts
could each be a month; ``resolve`` picks one once the column's convention is known.

The reading is built in a few projections instead of one deep expression, so that every
intermediate text is computed once and the generated code stays small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.functions.text import column as quoted, one_of_lowered, raw, spelling_key, strip

# Markers meaning "no date supplied".
DATE_MISSING = [
    "", "na", "n/a", "null", "none", "unknown", "not available", "-", "--", "nan", "nat",
]
MIN_YEAR, MAX_YEAR = 1900, 2100
# Bytes: more than the markers and all shapes of dates take, in any case.
_LONGEST = 64

# Month names and the accepted shapes of dates.
_MONTH = (
    "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?"
    "|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
)
_MONTH_STARTS = "janfebmaraprmayjunjulaugsepoctnovdec"
_YEAR_FIRST = r"^(\d{4})([/\-.])(\d{1,2})\2(\d{1,2})$"
_YEAR_FIRST_MIXED = r"^(\d{4})[/\-.](\d{1,2})[/\-.](\d{1,2})$"
_MONTH_FIRST = rf"^({_MONTH}) (\d{{1,2}}),? (\d{{4}})$"
_DAY_FIRST = rf"^(\d{{1,2}})([ -])({_MONTH})\2(\d{{4}})$"
_NUMERIC = r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{2,4})$"
_SLASHED = r"^\d{1,2}/\d{1,2}/(?:\d{2}|\d{4})$"
_ISO_TIME = (
    r"^(\d{4}-\d{2}-\d{2})[Tt ](?:[01]\d|2[0-3])(?::?[0-5]\d(?::?[0-5]\d(?:\.\d+)?)?)?"
    r" ?(?:[Zz]|[+-]\d{2}(?::?\d{2})?)?$"
)
# Fixed value: what "looks like a date" means when a text column's type is inferred.
DATE_LIKE = (
    r"(?i)\d{4}[-/.]\d{1,2}[-/.]\d{1,2}"
    r"|\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}"
    r"|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{1,2},?\s+\d{4}"
    r"|\d{1,2}\s+(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*,?\s+\d{4}"
)


def full_year(ymd: str) -> str:
    """Spell out two-digit years of a y-m-d text: below 70 is 20yy, the others 19yy."""
    recent = f"regexp_replace({ymd}, {raw(r'^0{0,2}([0-6][0-9])-')}, '20$1-')"
    return f"regexp_replace({recent}, {raw(r'^0{0,2}([7-9][0-9])-')}, '19$1-')"


def bounded_date(ymd: str) -> str:
    """A calendar date between 1900 and 2100 from a y-m-d text, or NULL."""
    date = f"try_cast({full_year(ymd)} AS date)"
    return f"CASE WHEN year({date}) BETWEEN {MIN_YEAR} AND {MAX_YEAR} THEN {date} END"


def add_reading(
    df: DataFrame, column: str, into: str, stripped: bool = False, words_column: str | None = None,
) -> DataFrame:
    """Add struct(status, iso, day_first, month_first, format, evidence, slash).

    ``status`` is parsed, missing, invalid or ambiguous. For an ambiguous cell ``day_first``
    and ``month_first`` hold the two possible dates (NULL where not a calendar date).
    ``evidence`` names the convention this cell proves for its column, ``slash`` how a
    slash-separated date can be read. ``stripped`` says that the column has no white space around
    its texts, ``words_column`` names one with their spelling keys, where there is one.
    """
    c = quoted(column)
    text, words, shape, named, a, b, exact, dm, md, date, either = (
        f"{into}__{n}" for n in (
            "text", "words", "shape", "named", "a", "b", "exact", "dm", "md", "date", "either"))
    month_number = (
        f"cast((instr('{_MONTH_STARTS}', substring({named}, 1, 3)) + 2) / 3 AS int)")
    month_first = raw(_MONTH_FIRST)
    keep = [quoted(n) for n in df.columns]
    code = f"CASE WHEN length(substring_index({named}, ' ', 1)) = 3 THEN 'b' ELSE 'B' END"
    gap = f"regexp_extract({words}, '[ -]', 0)"
    separator = f"regexp_extract({text}, {raw(_YEAR_FIRST)}, 2)"
    bare, key = c if stripped else strip(c), quoted(words_column) if words_column else spelling_key(c)
    return (
        df.selectExpr("*", f"{bare} AS {text}", f"{key} AS {words}")
        # only a time with a long fraction is longer than this; other long texts are no dates
        .withColumns({
            text: F.expr(f"CASE WHEN octet_length({text}) <= {_LONGEST} OR substring({text}, 5, 1) = '-'"
                         f" THEN {text} WHEN {text} IS NOT NULL THEN 'long' END"),
            words: F.expr(f"CASE WHEN octet_length({words}) <= {_LONGEST} THEN {words} END")})
        .selectExpr("*", f"""CASE
            WHEN {text} RLIKE {raw(_YEAR_FIRST)} THEN 'year'
            WHEN {text} RLIKE {raw(_YEAR_FIRST_MIXED)} THEN 'mixed'
            WHEN {text} RLIKE {raw(_NUMERIC)} THEN 'numeric'
            WHEN {words} RLIKE {month_first} THEN 'month'
            WHEN {words} RLIKE {raw(_DAY_FIRST)} THEN 'day'
            WHEN {text} RLIKE {raw(_ISO_TIME)} THEN 'time' END AS {shape}""")
        .selectExpr(
            "*",
            f"""CASE {shape} WHEN 'month' THEN {words} WHEN 'day' THEN
                regexp_replace({words}, {raw(_DAY_FIRST)}, '$3 $1 $4') END AS {named}""",
            f"""CASE WHEN {shape} = 'numeric' THEN
                cast(regexp_extract({text}, {raw(_NUMERIC)}, 1) AS int) END AS {a}""",
            f"""CASE WHEN {shape} = 'numeric' THEN
                cast(regexp_extract({text}, {raw(_NUMERIC)}, 2) AS int) END AS {b}""",
            f"""CASE {shape}
                WHEN 'numeric' THEN regexp_replace({text}, {raw(_NUMERIC)}, '$3-$2-$1')
                WHEN 'year' THEN regexp_replace({text}, {raw(_YEAR_FIRST_MIXED)}, '$1-$2-$3')
                WHEN 'mixed' THEN regexp_replace({text}, {raw(_YEAR_FIRST_MIXED)}, '$1-$2-$3')
                END AS {dm}""",
            f"""CASE WHEN {shape} = 'numeric' THEN
                regexp_replace({text}, {raw(_NUMERIC)}, '$3-$1-$2') END AS {md}""")
        .selectExpr(
            "*",
            f"""CASE
                WHEN {shape} = 'year' THEN {dm}
                WHEN {named} IS NOT NULL THEN concat_ws('-',
                    regexp_extract({named}, {month_first}, 3), {month_number},
                    regexp_extract({named}, {month_first}, 2))
                WHEN {shape} = 'time' THEN substring({text}, 1, 10) END AS {exact}_text""",
            f"{bounded_date(dm)} AS {dm}_date", f"{bounded_date(md)} AS {md}_date",
            f"coalesce({a} <= 12 AND {b} <= 12, false) AS {either}")
        .selectExpr("*", f"""CASE WHEN NOT startswith({exact}_text, '0000') THEN
            try_cast({exact}_text AS date) END AS {exact}""")
        .selectExpr("*", f"""CASE
            WHEN {shape} = 'numeric' THEN CASE
                WHEN {a} > 12 AND {b} <= 12 THEN {dm}_date
                WHEN {b} > 12 AND {a} <= 12 THEN {md}_date END
            ELSE coalesce({exact}, {dm}_date) END AS {date}""")
        .selectExpr(*keep, f"""named_struct(
            'status', CASE
                WHEN {c} IS NULL OR {one_of_lowered(text, DATE_MISSING)} THEN 'missing'
                WHEN {either} THEN 'ambiguous'
                WHEN {date} IS NOT NULL THEN 'parsed' ELSE 'invalid' END,
            'iso', cast({date} AS string),
            'day_first', CASE WHEN {either} THEN cast({dm}_date AS string) END,
            'month_first', CASE WHEN {either} THEN cast({md}_date AS string) END,
            'format', CASE WHEN {date} IS NOT NULL THEN CASE
                WHEN {shape} = 'year' AND {exact} IS NOT NULL THEN
                    concat('%Y', {separator}, '%m', {separator}, '%d')
                WHEN {shape} IN ('year', 'mixed') THEN 'YYYY-M-D'
                WHEN {shape} = 'month' THEN concat('%', {code}, ' %d',
                    CASE WHEN contains({words}, ',') THEN ',' ELSE '' END, ' %Y')
                WHEN {shape} = 'day' THEN concat('%d', {gap}, '%', {code}, {gap}, '%Y')
                WHEN {shape} = 'numeric' THEN
                    CASE WHEN {a} > 12 THEN 'DD/MM/YYYY' ELSE 'MM/DD/YYYY' END
                ELSE 'iso_datetime' END END,
            'evidence', CASE
                WHEN {a} > 12 AND {b} <= 12 THEN 'DD/MM'
                WHEN {b} > 12 AND {a} <= 12 THEN 'MM/DD' END,
            'slash', CASE WHEN {text} RLIKE {raw(_SLASHED)} THEN CASE
                WHEN {a} > 12 THEN 'DD/MM' WHEN {b} > 12 THEN 'MM/DD' ELSE 'either' END END
            ) AS {into}"""))


def resolve(reading: str, convention: str) -> str:
    """struct(status, iso, format, convention, confidence) given a column convention."""
    status = f"{reading}.status"
    chosen = (
        f"CASE WHEN {status} = 'ambiguous' THEN CASE {convention}"
        f" WHEN 'DD/MM' THEN {reading}.day_first WHEN 'MM/DD' THEN {reading}.month_first END END")
    return f"""named_struct(
        'status', CASE WHEN {chosen} IS NOT NULL THEN 'parsed' ELSE {status} END,
        'iso', coalesce({chosen}, {reading}.iso),
        'format', CASE WHEN {chosen} IS NOT NULL THEN concat({convention}, '/YYYY')
            ELSE {reading}.format END,
        'convention', CASE WHEN {chosen} IS NOT NULL THEN {convention}
            WHEN {status} = 'parsed' THEN {reading}.evidence END,
        'confidence', CASE WHEN {chosen} IS NOT NULL THEN 'MEDIUM'
            WHEN {status} = 'parsed' THEN 'HIGH' WHEN {status} = 'ambiguous' THEN 'LOW'
            ELSE upper({status}) END)"""


def convention_of(day_first_seen: bool, month_first_seen: bool) -> str | None:
    """Column convention from the two kinds of evidence; None when absent or contradictory."""
    if day_first_seen == month_first_seen:
        return None
    return "DD/MM" if day_first_seen else "MM/DD"
