import random
from datetime import date, datetime
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators.columns import ROW_ID
from plumbline.operators.facts import build_facts, column_statistics
from plumbline.operators.quantiles import exact_quantiles
from plumbline.sources.readers import nan_to_null


def profile_of(facts, column):
    return next(c for c in facts.columns if c["column"] == column)


@pytest.fixture(scope="module")
def mixed(spark):
    long = "word " * 100
    rows = [
        # id, amount, flag, day, at, price, city, joined, notes, tags, nothing
        (1, 1.0, True, date(2024, 1, 1), datetime(2024, 1, 1, 5), Decimal("1.10"), "Paris", "13/01/2024", long, [1], None),
        (2, float("nan"), False, date(2024, 1, 2), datetime(2024, 1, 2), Decimal("1.1"), "paris", "02/03/2024", "b", [2], None),
        (3, 2.5, None, None, None, None, " Paris", "nonsense", long, None, None),
        (4, 100.0, True, date(2024, 1, 1), None, Decimal("3.00"), "Rome", "14/05/2024", long.upper(), [1], None),
        (4, 100.0, True, date(2024, 1, 1), None, Decimal("3.00"), "Rome", "14/05/2024", long.upper(), [1], None),
        (6, -0.0, True, None, None, None, "Rome", "2024-07-01", None, None, None),
        (7, 0.0, True, None, None, None, "Rome", "N/A", "é  x", None, None),
        (8, None, True, None, None, None, "Rome", "2030-01-01", "", None, None),
    ]
    schema = ("some_id long, amount double, flag boolean, day date, at timestamp_ntz, price decimal(9,2), "
              "city string, joined string, notes string, tags array<int>, nothing string")
    df = nan_to_null(spark.createDataFrame(rows, schema)).withColumn(ROW_ID, F.monotonically_increasing_id())
    return build_facts({"t": df}, as_of="2024-06-01")


def test_types(mixed):
    types = {c["column"]: c["inferred_type"] for c in mixed.columns}
    assert types == {
        "some_id": "integer", "amount": "float", "flag": "boolean", "day": "date", "at": "datetime",
        "price": "float", "city": "categorical", "joined": "date", "notes": "string",
        "tags": "string", "nothing": "string"}


def test_nan_is_missing_and_zeros_are_one_value(mixed):
    amount = profile_of(mixed, "amount")
    assert (amount["missing_count"], amount["unique_count"], amount["zero_count"]) == (2, 4, 2)
    values = pd.Series([1.0, 2.5, 100.0, 100.0, 0.0, 0.0])
    assert amount["mean"] == pytest.approx(values.mean())
    assert amount["std"] == pytest.approx(values.std())
    assert amount["median"] == values.median()
    assert amount["mode"] == 0.0
    assert amount["numeric_extra"]["q25"] == pytest.approx(values.quantile(0.25))


def test_dates_follow_the_proven_convention(mixed):
    joined = profile_of(mixed, "joined")
    assert joined["date_convention"] == "DD/MM"
    assert joined["date_extra"] == {
        "min": "2024-01-13T00:00:00", "max": "2030-01-01T00:00:00", "invalid_count": 1,
        "future_count": 2, "ambiguous_count": 0}


def test_long_texts_are_judged_whole(mixed):
    notes = profile_of(mixed, "notes")
    assert notes["unique_count"] == 5
    assert notes["text_extra"] == {
        "whitespace_issue_count": 5, "empty_string_count": 1, "case_variation_count": 1,
        "unicode_issue_count": 1}
    assert notes["example_values"][0] == "word " * 100
    assert notes["longest_example"] == 500


def test_categories_and_spellings(mixed):
    city = profile_of(mixed, "city")["categorical_extra"]
    assert city["top_categories"][0] == {"value": "Rome", "count": 5}
    assert city["potential_inconsistencies"] == [[" Paris", "Paris", "paris"]]
    assert {c["value"] for c in city["rare_categories"]} == {" Paris", "Paris", "paris"}


def test_other_kinds(mixed):
    assert profile_of(mixed, "price")["unique_count"] == 2
    assert profile_of(mixed, "flag")["example_values"] == ["True", "False"]
    assert profile_of(mixed, "day")["example_values"] == ["2024-01-01", "2024-01-02"]
    assert profile_of(mixed, "tags")["unique_count"] is None
    assert profile_of(mixed, "nothing")["empty"]


def test_dataset_counts(mixed):
    table = mixed.tables[0]
    assert (table["row_count"], table["duplicate_row_count"], table["empty_column_count"]) == (8, 1, 1)


def test_missing_cells_keep_rows_apart(spark):
    rows = [("a", None), (None, "a"), ("a", None), (None, None), (None, None)]
    df = spark.createDataFrame(rows, "x string, y string").withColumn(ROW_ID, F.monotonically_increasing_id())
    table = build_facts({"t": df}).tables[0]
    assert (table["duplicate_row_count"], table["empty_row_count"]) == (2, 2)


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, name string, v double").withColumn(
        ROW_ID, F.monotonically_increasing_id())
    facts = build_facts({"t": df})
    assert facts.tables[0]["row_count"] == 0
    assert all(c["inferred_type"] == "string" and c["missing_count"] == 0 for c in facts.columns)
    assert facts.profile.count() == 3


def test_wide_table(spark):
    df = spark.range(20).selectExpr(f"id AS {ROW_ID}", *(f"id * {i} AS col_{i}" for i in range(120)))
    facts = build_facts({"wide": df})
    assert len(facts.columns) == 120
    assert profile_of(facts, "col_119")["max"] == 19 * 119


def test_infinite_values_are_kept(spark):
    values = [float("inf"), -float("inf"), 1.0, 1e300, -2.3e-8]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"{ROW_ID} long, v double")
    v = profile_of(build_facts({"t": df}), "v")
    assert (v["min"], v["max"], v["missing_count"]) == (-float("inf"), float("inf"), 0)


def test_partitioning_does_not_matter(spark):
    random.seed(1)
    rows = [(i, random.choice("abcde") * random.randint(1, 3), random.random()) for i in range(300)]
    df = spark.createDataFrame(rows, f"{ROW_ID} long, word string, v double")
    one, many = build_facts({"t": df.coalesce(1)}), build_facts({"t": df.repartition(7)})
    for a, b in zip(one.columns, many.columns):
        for key in a:
            same = a[key] == pytest.approx(b[key]) if isinstance(a[key], float) else a[key] == b[key]
            assert same, key


@pytest.mark.parametrize("limit", [3, 100, 100_000])
def test_quantiles_by_narrowing(spark, limit):
    rng = np.random.default_rng(5)
    series = {
        0: np.round(rng.lognormal(0, 3, 4000), 3),
        1: np.concatenate([np.zeros(1500), rng.normal(0, 1, 1500), [1e300, -1e300]]),
        2: rng.integers(-5, 5, 1000).astype(float), 3: np.array([7.0])}
    rows, extents = [], {}
    for cid, values in series.items():
        distinct, counts = np.unique(values, return_counts=True)
        rows += [(cid, float(v), int(c)) for v, c in zip(distinct, counts)]
        extents[cid] = (len(values), len(distinct), float(values.min()), float(values.max()))
    df = spark.createDataFrame(rows, "cid int, v double, cnt long")
    got = exact_quantiles(df, extents, direct_limit=limit)
    for cid, values in series.items():
        assert got[cid] == pytest.approx(list(np.quantile(values, [0.25, 0.5, 0.75])), rel=1e-12)


def test_padding_costs_no_trim_per_character_and_numbers_are_not_classified(spark):
    import io
    from contextlib import redirect_stdout

    from plumbline.functions.text import strip

    rows = [(i, f"{i % 7},{i}" + " " * 300, i, float(i % 3)) for i in range(50)] + [
        (50, " \t7,1　 ", 50, None), (51, "\x1f2024-02-01\n", 51, 2.0), (52, "   ", 52, 1.0)]
    df = spark.createDataFrame(rows, "_row_id long, t string, n long, x double")
    known = build_facts({"d": df})
    by_name = {c["column"]: c for c in known.columns}
    assert (by_name["n"]["mode"], by_name["x"]["mode"]) == (0.0, 1.0)      # 18 ones, 17 twos and zeros
    assert by_name["t"]["n_blank"] == 1 and by_name["t"]["n_whitespace"] == 53
    assert by_name["t"]["n_date_parsed"] == 1 and by_name["t"]["n_unicode"] == 3
    got = df.selectExpr(f"{strip('t')} AS s", "t").collect()
    assert all(r.s == r.t.strip() for r in got)
    plan = io.StringIO()
    with redirect_stdout(plan):
        column_statistics(known.freq, known.infos).explain()
    assert "SortAggregate" not in plan.getvalue()
