"""What the profile does per cell and per character, and that cheaper forms say the same."""

import io
import re
from contextlib import redirect_stdout

import pytest

from plumbline.functions import dates, numbers, text
from plumbline.operators import facts, frequencies
from plumbline.operators.columns import describe_columns

TEXTS = [
    None, "", " ", "a", "a b", "a  b", "İNR 5", "5 inr", "e\u212Aur", "xGbP", "1,234", "1,23", "cost £5",
    "UN\u212ANOWN", "n/a", "Not Available", "Jan" + " " * 200 + "5,\u2003 2024",
    "7 \nMarch\u00a02020" + "\t" * 90, "2024-02-03T04:05:06." + "1" * 200 + "Z",
    "2024-02-30", "5/6/2024", "2024-" + "x" * 500, "“quoted” text" + "\u2009" * 3,
    "word and word " * 300, "Ärger\nund  mehr " * 200, "x" * 63 + "\u3000" + "y", "tab\there", "bell\x07",
    *(f"a{c}b" for c in text.WHITESPACE), *(f"a {c}b{c}" for c in text.WHITESPACE),
    *(f"a{chr(i)}" for i in [*range(1, 33), 127, 128, 160]),
]


def explained(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "i long, t string").cache()


def test_white_space_in_every_form(texts):
    rows = texts.where("t IS NOT NULL").selectExpr(
        "t", f"{text.collapse_whitespace('t')} AS one", f"{text.has_whitespace_issue('t')} AS issue",
        f"{text.has_unicode_issue('t')} AS odd").collect()
    for r in rows:
        assert r.one == " ".join(r.t.split()), r.t
        assert r.issue == (r.t.strip() != r.t or re.search(r"\s\s", r.t) is not None), r.t
        assert r.odd == (re.search(r"[^\x00-\x7f]|[\x00-\x08\x0b-\x1f\x7f]", r.t) is not None), r.t


def test_money_hints_follow_the_pattern(texts):
    pattern = r"(?i)[₹$€£]|INR|USD|EUR|GBP|,\d{3}"
    assert texts.where(f"NOT ({numbers.has_currency_hint('t', 'lower(t)')} <=> "
                       f"(t RLIKE {text.raw(pattern)}))").count() == 0


def test_long_dates_and_markers_are_read(texts):
    read = {r.t: r.d for r in dates.add_reading(texts, "t", "d").collect()}
    iso = {t: d.iso for t, d in read.items() if d.iso}
    assert iso == {TEXTS[16]: "2024-01-05", TEXTS[17]: "2020-03-07", TEXTS[18]: "2024-02-03"}
    missing = {t for t, d in read.items() if d.status == "missing"}
    assert {None, "", " ", "n/a", "Not Available", "UN\u212ANOWN"} <= missing
    assert read["5/6/2024"].status == "ambiguous" and read["2024-" + "x" * 500].status == "invalid"


def test_classified_texts_equal_the_single_tests(texts):
    df = texts.selectExpr("i AS _row_id", "t")
    found = frequencies.value_frequencies({"d": df}, describe_columns("d", df))
    tests = {"whitespace": text.has_whitespace_issue("txt"), "blank": text.is_blank("txt"),
             "placeholder": text.is_placeholder("txt"), "numeric_like": text.is_numeric_like("txt"),
             "unicode": text.has_unicode_issue("txt")}
    wrong = " OR ".join(f"({frequencies.signal(n)}) != {t}" for n, t in tests.items())
    assert found.where(wrong).count() == 0
    assert found.where(f"coalesce(skey, txt) != {text.spelling_key('txt')}").count() == 0


def test_a_text_is_mapped_once_and_lowered_once_when_long(texts):
    plan = explained(frequencies._classify(texts.selectExpr("0 AS cid", "t AS txt", "1L AS cnt", "i AS first_row")))
    assert plan.count("translate(") == 1
    # besides the spelling key only short texts are lowered
    bounded = len(re.findall(r"octet_length\(\w+#\d+L?\) <= \d+\) AND lower\(", plan))
    assert plan.count("lower(trim(") == 1 and bounded >= 2


def test_cells_are_expanded_without_objects_and_rows_hashed_without_texts(spark):
    df = spark.range(50).selectExpr("id AS _row_id", "id % 7 AS n", "double(id % 3) AS x",
                                    "CASE WHEN id % 5 > 0 THEN string(id % 4) END AS t")
    infos = describe_columns("d", df)
    found = frequencies.cells({"d": df}, infos, [0, 1, 2])
    plan = explained(found)
    assert "Expand" in plan and "Generate" not in plan
    counts = {r.cid: r["count"] for r in found.groupBy("cid").count().collect()}
    assert counts == {0: 50, 1: 50, 2: 40}
    assert "concat(" not in explained(facts.row_counts({"d": df}))


def test_missing_places_of_wide_rows_keep_rows_apart(spark):
    # more columns than a word has bits; one cell moves through all places
    df = spark.range(131).selectExpr(
        "id AS _row_id", *(f"CASE WHEN id = {i} THEN 1 END AS c{i}" for i in range(130)))
    row = facts.row_counts({"w": df}).first()
    assert (row.row_count, row.duplicate_row_count, row.empty_row_count) == (131, 0, 1)


def test_variations_are_counted_without_shuffling_texts(spark):
    rows = [(i, t) for i, t in enumerate(["Aa bb", "aa  bb", "AA BB", "cc", "dd", "DD", "dd " * 500])]
    df = spark.createDataFrame(rows, "_row_id long, t string")
    infos = describe_columns("d", df)
    freq = frequencies.value_frequencies({"d": df}, infos)
    assert facts.case_variations(freq, [0]) == {0: 2}
    shown = facts.build_facts({"d": df}).columns[0]
    assert shown["inferred_type"] == "string" and shown["text_extra"]["case_variation_count"] == 2
