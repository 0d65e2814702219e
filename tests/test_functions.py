import pytest
from pyspark.sql import functions as F

from plumbline.functions import dates, numbers, text
from plumbline.functions.similarity import character_tokens, leading_tokens


def evaluate(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in df.selectExpr("i", f"{expression} AS x").orderBy("i").collect()]


def test_whitespace_is_unicode_aware(spark):
    values = ["a b", " a", "a ", "a  b", "a\tb", " a", "a  b", "a\n", None, ""]
    got = evaluate(spark, values, text.has_whitespace_issue("t"))
    assert got == [False, True, True, True, False, True, True, True, None, False]
    got = evaluate(spark, values, text.collapse_whitespace("t"))
    assert got == [None if v is None else " ".join(v.split()) for v in values]


def test_placeholders_and_spelling_keys(spark):
    values = ["N/A", " null ", "--", "?", "", "  ", "n.a.", "Not Available", "nan", "real", None]
    assert evaluate(spark, values, text.is_placeholder("t")) == [True] * 8 + [False, False, None]
    assert evaluate(spark, ["  New   York ", "NEW york"], text.spelling_key("t")) == ["new york"] * 2


def test_unicode_issue(spark):
    values = ["plain", "tab\tline\n", "café", "bell\x07", "\x7f", "日本"]
    assert evaluate(spark, values, text.has_unicode_issue("t")) == [False, False, True, True, True, True]


def test_column_names(spark):
    values = [" Order Date (UTC) ", "%%", "a__b", "_x_", "A1"]
    assert evaluate(spark, values, text.clean_column_name("t")) == [
        "order_date_utc", "column", "a_b", "x", "a1"]


def test_emails(spark):
    cases = {
        "a@b.co": "valid", " A@B.Co ": "valid", "kiran@": "missing_domain", "@x.com": "missing_local_part",
        "two@@x.com": "at_sign_count", "none": "at_sign_count", "a b@x.com": "whitespace",
        "a@b": "no_top_level_domain", "a@b..co": "pattern", "": "empty", None: "empty"}
    assert evaluate(spark, list(cases), text.email_problem("t")) == list(cases.values())
    valid = evaluate(spark, [" A@B.Co ", "kiran@"], text.validate_email("t"))
    assert [v.normalized for v in valid] == ["a@b.co", None]


def test_block_keys(spark):
    df = spark.createDataFrame(
        [("Ann@x.org", "1"), (None, "+1 (555) 000-1234"), (" ", "12"), (None, None)], "e string, p string")
    keyed = df.selectExpr(f"{text.email_key('e')} AS e", f"{text.phone_key('p')} AS p")
    assert [r.b for r in keyed.selectExpr(f"{text.block_key('e', 'p')} AS b").collect()] == [
        "email:ann", "phone:001234", "phone:12", None]


def test_number_coercion(spark):
    values = ["1", " 2.5 ", "1e3", "-.5", "1d", "abc", "inf", "1,000", "", None]
    got = evaluate(spark, values, numbers.to_number("t"))
    assert got == [1.0, 2.5, 1000.0, -0.5, None, None, float("inf"), None, None, None]


CURRENCY = [
    ("$1,234", 1234.0, "1234.0", "USD", "HIGH"), ("₹4,500", 4500.0, "4500.0", "INR", "HIGH"),
    ("2,499 INR", 2499.0, "2499.0", "INR", "HIGH"), ("Rs. 500", 500.0, "500.0", "INR", "HIGH"),
    ("(500)", -500.0, "-500.0", None, "HIGH"), ("$-5", -5.0, "-5.0", "USD", "HIGH"),
    ("-$5", None, None, None, "INVALID"), ("free", None, None, None, "INVALID"),
    (",", None, None, None, "INVALID"), ("not available", None, None, None, "MISSING"),
    ("007.50", 7.5, "7.5", None, "HIGH"), ("10 eur", 10.0, "10.0", "EUR", "HIGH"),
    ("ten thousand", None, None, None, "INVALID"), (None, None, None, None, "MISSING"),
]


def test_currency(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CURRENCY)], "i int, t string")
    rows = numbers.add_currency(df, "t", "m").orderBy("i").collect()
    assert [tuple(r.m) for r in rows] == [c[1:] for c in CURRENCY]


DATES = [
    ("2024-01-05", "parsed", "2024-01-05"), ("2024/1/5", "parsed", "2024-01-05"),
    ("2024.13.01", "invalid", None), ("0050-1-5", "parsed", "0050-01-05"),
    ("0000-01-05", "parsed", "2000-01-05"), ("2024-1/5", "parsed", "2024-01-05"),
    ("Jan 7 2026", "parsed", "2026-01-07"), ("january  7, 2026", "parsed", "2026-01-07"),
    ("7-feb-2024", "parsed", "2024-02-07"), ("30 Feb 2024", "invalid", None),
    ("29/02/2024", "parsed", "2024-02-29"), ("29/02/2023", "invalid", None),
    ("02/13/2024", "parsed", "2024-02-13"), ("13/13/2024", "invalid", None),
    ("05/06/24", "ambiguous", None), ("00/05/2024", "ambiguous", None),
    ("14/1/69", "parsed", "2069-01-14"), ("14/1/70", "parsed", "1970-01-14"),
    ("2024-01-05T10:00:00Z", "parsed", "2024-01-05"), ("2024-01-05 25:00", "invalid", None),
    ("today", "invalid", None), ("N/A", "missing", None), ("garbage", "invalid", None),
    (None, "missing", None),
]


def test_dates(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(DATES)], "i int, t string")
    rows = dates.add_reading(df, "t", "d").orderBy("i").collect()
    assert [(r.t, r.d.status, r.d.iso) for r in rows] == DATES


@pytest.mark.parametrize("convention,iso", [("DD/MM", "2024-06-05"), ("MM/DD", "2024-05-06"), (None, None)])
def test_ambiguous_dates_follow_the_column(spark, convention, iso):
    df = dates.add_reading(spark.createDataFrame([("05/06/2024",)], "t string"), "t", "d")
    known = f"'{convention}'" if convention else "cast(null AS string)"
    got = df.selectExpr(f"{dates.resolve('d', known)} AS r").first().r
    assert got.iso == iso
    assert got.status == ("parsed" if iso else "ambiguous")


def test_contradicting_conventions_prove_nothing():
    assert dates.convention_of(True, True) is None
    assert dates.convention_of(False, False) is None
    assert dates.convention_of(True, False) == "DD/MM"


def test_half_even_rounding(spark):
    got = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.2,)], "v double").select(
        numbers.half_even(F.col("v")).alias("x")).collect()
    assert [r.x for r in got] == [0.0, 2.0, 2.0, 0.0]
    assert str(got[3].x) == "0.0"


def test_character_tokens(spark):
    tokens = evaluate(spark, ["anna", "x"], character_tokens("t"))
    assert sorted(tokens[0]) == ["a1", "a2", "n1", "n2"]
    short = evaluate(spark, ["anna"], leading_tokens(character_tokens("t")))
    assert short[0] == tokens[0][:2]


def test_finite_or_null(spark):
    df = spark.createDataFrame([(1.0,), (float("inf"),), (float("nan"),), (None,)], "v double")
    assert [r.x for r in df.selectExpr(f"{numbers.finite_or_null('v')} AS x").collect()] == [
        1.0, None, None, None]


def test_years_of_two_and_three_digits(spark):
    df = spark.createDataFrame([("13/01/65",), ("13/01/065",), ("13/01/070",), ("13/01/265",)], "t string")
    read = dates.add_reading(df, "t", "r").selectExpr("r.iso AS iso").collect()
    assert [r.iso for r in read] == ["2065-01-13", "2065-01-13", "1970-01-13", None]


def test_amounts_of_any_length(spark):
    long = "1." + "5" + "0" * 900
    df = spark.createDataFrame([(long,), ("$1.500",), ("2.000",), ("7",)], "t string")
    found = numbers.add_currency(df, "t", "m").selectExpr("m.text AS x").collect()
    assert [r.x for r in found] == ["1.5", "1.5", "2.0", "7.0"]


def test_names_as_literals(spark):
    for name in ["o'brien", "a\\b", "tab\t", 'q"', "`", "line\n", "\\'"]:
        assert spark.sql(f"SELECT {text.literal(name)} AS x").first().x == name
