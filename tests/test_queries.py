import pytest

import __spark_entry__ as entry_module
from check_oracles import compare

SF = "/root/testdata/sf0.001"
FAST = ["currency_parse", "date_parse", "email_validate", "contact_keys", "dataset_counts", "header_checks",
        "business_rules", "orphan_keys", "near_duplicate_groups", "all_issues", "cleaned_customers",
        "scan_csv", "scan_folder", "text_profile", "clean_names", "scan_quoted_csv", "scan_blank_cells",
        "odd_headers", "long_cells"]


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, name):
    line = compare(spark, SF, name, entry_module.oracle_sql()[name])
    assert line.startswith("ok"), line


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_statement_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
