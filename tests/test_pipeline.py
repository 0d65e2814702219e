"""Detection, cleaning, validation and reports over one small messy catalogue."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import cleaning, detect, drift, policy, readiness, relationships, validation
from plumbline.operators.columns import ROW_ID
from plumbline.operators.facts import build_facts
from plumbline.plans.quality_job import run_quality_job, run_totals

CUSTOMERS = [
    (1, "Ann  Lee ", "a@x.org", "+1 555 0001", "Gold", "13/01/2024", "$1,500", 34),
    (2, "Bob Ray", "bob@", "+1 555 0002", "gold", "31/02/2024", "2000", 35),
    (3, "Cid Fox", "c@x.org", "+1 555 0003", "Gold", "2024-03-05", "free", 130),
    (3, "Cid Fox", "c@x.org", "+1 555 0003", "Gold", "2024-03-05", "free", 130),
    (5, "Eve Orr", "e@x.org", "+1 555 0005", "N/A", "05/06/2024", "$3", 31),
    (6, " Eve Orr", "e@x.org", "+1 555 0005", "Gold", "Jan 7, 2024", "4", 31),
    (7, "Gus Poe", "g@x.org", "+1 555 0007", "Silver", "20/05/2024", "5", 33),
    (8, "Hal Kay", "h@x.org", "+1 555 0008", "Silver", "21/05/2024", "6", 32),
    (9, "Ida May", "i@x.org", "+1 555 0009", "Silver", "22/05/2024", "7", 32),
    (9, "Ida  May", "i@x.org", "+1 555 0009", "Silver", "22/05/2024", "7", 32),
    (11, "Kit Moe", "k@x.org", "+1 555 0011", "Silver", "23/05/2024", "8", 36),
]
CUSTOMER_SCHEMA = ("customer_id long, name string, email string, phone string, tier string, "
                   "joined string, amount string, age long")
ORDERS = [(1, 1, 10.0), (2, 3, 11.0), (3, 999, 12.0), (4, 999, 9.0)]


@pytest.fixture(scope="module")
def catalogue(spark):
    customers = spark.createDataFrame(CUSTOMERS, CUSTOMER_SCHEMA).withColumn("note", F.lit(None).cast("string"))
    orders = spark.createDataFrame(ORDERS, "order_id long, customer_id long, total double")
    return {"customers.csv": customers.coalesce(1).withColumn(ROW_ID, F.monotonically_increasing_id()),
            "orders.csv": orders.coalesce(1).withColumn(ROW_ID, F.monotonically_increasing_id())}


@pytest.fixture(scope="module")
def facts(catalogue):
    return build_facts(catalogue, "2024-06-01")


@pytest.fixture(scope="module")
def issues(facts):
    found = detect.detect_issues(facts, {"orders.csv": ["Order_ID", "ship_date"]})
    return {(r.dataset, r.column, r.issue_type): r.affected_count for r in found.collect()}


def test_issues(issues):
    c = "customers.csv"
    expected = {
        (c, None, "duplicate_rows"): 1, (c, "name", "whitespace_formatting"): 3,
        (c, "email", "invalid_email"): 1, (c, "tier", "missing_value_placeholder"): 1,
        (c, "tier", "category_inconsistency"): 2, (c, "joined", "invalid_date"): 1,
        (c, "joined", "ambiguous_date_format"): 0, (c, "amount", "currency_value"): 2,
        (c, "age", "impossible_value"): 2, (c, "age", "outlier"): 2, (c, "note", "empty_column"): 11,
        (c, None, "near_duplicate"): 2, ("orders.csv", None, "missing_required_column"): 1,
    }
    for key, count in expected.items():
        assert issues.get(key) == count, key


def test_every_issue_type_has_a_policy():
    known = {t for t, *_ in policy.POLICY}
    produced = {r[0] for r in detect.RULES} | {"duplicate_rows", "missing_required_column", "near_duplicate"}
    assert produced <= known


def _clean(facts, protected=None, dataset="customers.csv", **options):
    found = detect.detect_issues(facts, near_duplicate_search=False)
    decided = policy.decide(found, {dataset: protected} if protected else None)
    return cleaning.apply_cleaning(facts, dataset, decided, **options)


def test_cleaning(facts):
    done = _clean(facts)
    rows = {r[ROW_ID]: r for r in done.cleaned.collect()}
    assert sorted(rows) == [0, 1, 2, 4, 5, 6, 7, 8, 10]
    assert "note" not in done.cleaned.columns
    assert [rows[i].name for i in (0, 5, 8)] == ["Ann Lee", "Eve Orr", "Ida May"]
    assert rows[1].joined is None and rows[1].email == "bob@"
    assert [rows[i].joined for i in (0, 2, 4, 5)] == ["2024-01-13", "2024-03-05", "2024-06-05", "2024-01-07"]
    assert rows[1].tier == "Gold" and rows[4].tier is None
    assert [rows[i].amount for i in (0, 1, 2)] == ["1500.0", "2000.0", "free"]
    assert rows[2].age == 130


def test_change_log_uses_raw_row_ids(facts):
    changes = {(r[ROW_ID], r.column, r.issue_type): (r.original_value, r.new_value)
               for r in _clean(facts).changes.collect()}
    assert changes[3, None, "duplicate_rows"] == ("<duplicate row>", None)
    assert (9, None, "duplicate_rows_post_normalization") in changes
    assert changes[5, "name", "whitespace_formatting"] == (" Eve Orr", "Eve Orr")
    assert changes[1, "tier", "category_inconsistency"] == ("gold", "Gold")
    assert changes[None, "note", "empty_column"] == ("note", None)
    assert not any(k[1] == "age" for k in changes)


def test_protected_columns_stay_as_they_are(facts, catalogue):
    done = _clean(facts, protected=[" NAME", "Amount"])
    raw = {r[ROW_ID]: (r.name, r.amount) for r in catalogue["customers.csv"].collect()}
    for r in done.cleaned.collect():
        assert (r.name, r.amount) == raw[r[ROW_ID]]


def test_cleaning_twice_changes_nothing_more(facts):
    first = _clean(facts).cleaned
    again = build_facts({"customers.csv": first}, "2024-06-01")
    second = _clean(again).cleaned
    assert sorted(map(str, first.collect())) == sorted(map(str, second.collect()))


def test_validation(spark, facts):
    checks = {(r.dataset, r.check_name): r.status for r in validation.validate(facts).collect()}
    assert checks["customers.csv", "duplicates"] == "fail"
    assert checks["customers.csv", "missingness"] == "fail"
    assert checks["customers.csv", "invalid_values"] == "warning"
    assert checks["orders.csv", "duplicates"] == "pass"
    rows = [(1.0, 0.1, 1.1), (1.0, 0.2, 9.0), (1.0, None, 2.0)]
    df = spark.createDataFrame(rows, "subtotal double, tax double, total double")
    rule = validation.business_rules("t", df).where("rule LIKE 'total%'").first()
    assert (rule.violations, rule.unverifiable) == (1, 1)


def test_dates_and_amounts_as_text_are_checked(spark):
    df = spark.createDataFrame(
        [("2024-01-02", "2024-01-01", "2", "5", "10"), ("2024-01-01", "x", "2", "abc", "10"),
         ("2024-01-01", "2024-01-02", "2", "5", "11")],
        "start_date string, end_date string, quantity string, unit_price string, revenue string")
    found = {r.rule: (r.violations, r.unverifiable) for r in validation.business_rules("t", df).collect()}
    assert found["end_date_before_start_date"] == (1, 1)
    assert found["revenue_not_equal_quantity_times_price"] == (1, 1)


def test_orphans(catalogue):
    finding = relationships.relationship_findings(catalogue).collect()
    assert [(f.dataset, f.column, f.references, f.orphan_count, f.orphan_examples) for f in finding] == [
        ("orders.csv", "customer_id", "customers.csv", 1, ["999"])]
    lone = relationships.relationship_checks({"orders.csv": catalogue["orders.csv"]}).first()
    assert lone.status == "not_applicable"


def test_readiness_scores_add_up(spark):
    checks = spark.createDataFrame(
        [("d", "p", "a", "fail"), ("d", "p", "b", "warning"), ("d", "p", "c", "pass"),
         ("d", "q", "a", "fail"), ("d", "q", "b", "fail"), ("d", "r", "a", "not_applicable")],
        "dataset string, platform string, check_name string, status string")
    scores = {r.platform: (r.score, r.status) for r in readiness.score_packs(checks).collect()}
    assert scores == {"p": (80, "NEEDS_CLEANING"), "q": (70, "NOT_READY"), "r": (100, "READY")}


def test_unknown_pack_is_an_error(facts, spark):
    with pytest.raises(ValueError, match="nonsense"):
        readiness.readiness_checks(facts, detect.column_issues(facts), packs=["nonsense"])


def test_refresh_keeps_foreign_key_checks(spark):
    schema = "dataset string, platform string, check_name string, status string"
    earlier = spark.createDataFrame(
        [("a", "sql", "foreign_key_relationships", "warning"), ("a", "sql", "duplicates", "fail"),
         ("b", "sql", "duplicates", "fail")], schema)
    after = spark.createDataFrame([("a", "sql", "duplicates", "pass")], schema)
    got = {tuple(r) for r in readiness.refresh_readiness(earlier, after).collect()}
    assert got == {("a", "sql", "foreign_key_relationships", "warning"), ("a", "sql", "duplicates", "pass"),
                   ("b", "sql", "duplicates", "fail")}


def test_drift(spark):
    old = spark.range(20).selectExpr("id AS _row_id", "id AS amount", "'x' AS region", "id AS value")
    new = spark.range(40).selectExpr("id AS _row_id", "id * 3 AS amount", "concat('v', id) AS value", "1 AS extra")
    history = drift.profile_history(build_facts({"d": old}), "r1").unionByName(
        drift.profile_history(build_facts({"d": new}), "r2"))
    found = drift.drift_findings(history)
    kinds = {(r.drift_type, r.column) for r in found.collect()}
    assert {("schema_drift_new_columns", None), ("schema_drift_removed_columns", None), ("volume_drift", None),
            ("schema_drift_type_change", "value"), ("distribution_drift_mean", "amount"),
            ("distribution_drift_std", "amount")} <= kinds
    summary = {r.run_id: r.overall_status for r in drift.drift_summary(history, found).collect()}
    assert summary == {"r1": "no_history", "r2": "drift_detected"}


def test_whole_job(catalogue):
    report = run_quality_job(catalogue, "run1", "2024-06-01", protected={"customers.csv": ["phone"]})
    tables = report.tables
    assert {r.dataset: r.published for r in tables["gate"].collect()} == {
        "customers.csv": True, "orders.csv": True}
    audit = tables["audit"].where("dataset = 'customers.csv'").collect()
    assert {r.status for r in audit} == {"applied", "flagged_for_review"}
    assert sum(r.issue_type == "duplicate_rows" for r in audit) == 2
    lineage = tables["lineage"].where("source_dataset = 'customers.csv'").orderBy("lineage_id").collect()
    assert lineage[0].lineage_id == "lineage_001" and lineage[0].transformation == "unchanged"
    assert lineage[-1].transformation == "dropped_empty_column"
    dictionary = tables["dictionary"].where("dataset = 'customers.csv'").collect()
    assert len(dictionary) == 8
    changed = {r.metric: r.change for r in tables["before_after"].where("dataset = 'customers.csv'").collect()}
    assert changed["row_count"] == -2 and changed["duplicate_rows"] == -1 and changed["column_count"] == -1
    assert tables["readiness"].where(
        "check_name = 'foreign_key_relationships' AND status = 'warning'").count() == 3
    assert report.after.of("customers.csv")[0]["inferred_type"] == "id"
    assert run_totals(report).first().status == "cleaned"


def test_rules_read_any_date(spark):
    df = spark.createDataFrame(
        [("25/03/2024", "13/02/2024"), ("Jan 5, 2024", "2024-01-04"), ("2024-01-01 10:00:00", "2024-01-01 09:00:00"),
         ("05/06/2024", "01/01/2025"), ("x", "2024-01-01")], "start_date string, end_date string")
    rules = {r.rule: (r.violations, r.unverifiable) for r in validation.business_rules("it's", df).collect()}
    assert rules["end_date_before_start_date"] == (3, 2)
    known = {"start_date": "DD/MM", "end_date": "DD/MM"}
    rules = {r.rule: (r.violations, r.unverifiable)
             for r in validation.business_rules("it's", df, known).collect()}
    assert rules["end_date_before_start_date"] == (3, 1)


def test_infinite_values_are_no_figures(spark):
    rows = [(i, v) for i, v in enumerate([1.0, 2.0, float("inf"), 4.0])]
    found = build_facts({"t": spark.createDataFrame(rows, f"{ROW_ID} long, value double")}, "2024-01-01")
    column = found.profile.first()
    assert (column["min"], column["max"], column["mean"], column["std"]) == (1.0, None, None, None)
