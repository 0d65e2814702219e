"""Registered queries: each runs library operators over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.functions import dates, numbers, text
from plumbline.functions.similarity import fewest_matches
from plumbline.operators import (
    cleaning, columns, detect, drift, governance, neardup, policy, readiness, relationships,
    scoring, validation)
from plumbline.operators.columns import ROW_ID, describe_columns
from plumbline.operators.facts import Facts, build_facts, row_counts, spelling_groups
from plumbline.plans import inputs, isolation
from plumbline.plans.oracles import AS_OF
from plumbline.sources import readers, sinks
from plumbline.storage import checkpoint_dir, materialise

KEYS = {
    "orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey",
    "documents": "doc_id", "events": "event_id", "pages": "page_id", "supplier": "s_suppkey",
    "nation": "n_nationkey", "region": "r_regionkey", "labels": "doc_id",
    "benchmark": "item_id", "embeddings": "vec_id",
}
DERIVED = {"dirty_orders": ("orders", inputs.DIRTY_ORDERS),
           "dirty_customer": ("customer", inputs.DIRTY_CUSTOMER),
           "contacts": ("customer", inputs.CONTACTS)}
PROTECTED = {"dirty_orders": ["PRIORITY "]}
REQUIRED = {"dirty_orders": ["Age ", "ship_date"], "dirty_customer": ["EMAIL", "iban", "country"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given or derived table with its ``_row_id``."""
    if name in DERIVED:
        base, sql = DERIVED[name]
        spark.read.parquet(f"{sf_dir}/{base}.parquet").createOrReplaceTempView(base)
        return spark.sql(sql).withColumn(ROW_ID, F.monotonically_increasing_id())
    return readers.read_parquet(spark, f"{sf_dir}/{name}.parquet", KEYS.get(name))


def frames(spark, sf_dir, *names) -> dict[str, DataFrame]:
    return {n: table(spark, sf_dir, n) for n in names}


def facts(spark, sf_dir, *names) -> Facts:
    return build_facts(frames(spark, sf_dir, *names), AS_OF)


# profiles

def numeric_profile(spark, sf_dir, *names):
    return facts(spark, sf_dir, *names).profile.where("min IS NOT NULL").selectExpr(
        "dataset", "column", "row_count", "missing_count", "unique_count", "min", "max",
        "bround(mean, 4) AS mean", "bround(median, 4) AS median", "bround(std, 4) AS std", "mode",
        "zero_count", "negative_count", "bround(numeric_extra.q25, 4) AS q25",
        "bround(numeric_extra.q75, 4) AS q75", "numeric_extra.outlier_count AS outlier_count")


def missing_and_unique(spark, sf_dir, *names):
    return facts(spark, sf_dir, *names).profile.selectExpr(
        "dataset", "column", "missing_count", "missing_percentage", "unique_count",
        "unique_percentage")


def example_values(spark, sf_dir):
    return facts(spark, sf_dir, "orders", "documents").profile.where(
        "kind = 'text'").selectExpr(
        "dataset", "column", "posexplode(example_values) AS (place, value)")


def top_categories(spark, sf_dir):
    return facts(spark, sf_dir, "orders", "part", "documents").profile.selectExpr(
        "dataset", "column", "posexplode(categorical_extra.top_categories) AS (place, item)"
    ).selectExpr("dataset", "column", "place", "item.value AS value", "item.count AS n")


def rare_categories(spark, sf_dir):
    return facts(spark, sf_dir, "dirty_orders", "documents").profile.selectExpr(
        "dataset", "column", "explode(categorical_extra.rare_categories) AS item").selectExpr(
        "dataset", "column", "item.value AS value", "item.count AS n")


def text_profile(spark, sf_dir):
    return facts(spark, sf_dir, "dirty_customer", "documents", "part").profile.where(
        "text_extra IS NOT NULL").selectExpr("dataset", "column", "text_extra.*")


def date_profile(spark, sf_dir):
    return facts(spark, sf_dir, "dirty_orders", "orders", "events").profile.where(
        "date_extra IS NOT NULL").selectExpr("dataset", "column", "date_extra.*")


def infer_types(spark, sf_dir, *names):
    return readiness.column_roles(facts(spark, sf_dir, *names)).select(
        "dataset", "column", "inferred_type", "role", "label")


def table_roles(spark, sf_dir, *names):
    return readiness.table_roles(facts(spark, sf_dir, *names))


def constant_columns(spark, sf_dir):
    return facts(spark, sf_dir, "dirty_orders", "documents").profile.select(
        "dataset", "column", "constant", "near_constant", "empty")


def dataset_counts(spark, sf_dir):
    found = frames(spark, sf_dir, "dirty_orders", "lineitem", "conversations")
    found["texts"] = table(spark, sf_dir, "documents").drop("doc_id")
    return row_counts(found)


def spelling_variants(spark, sf_dir):
    known = facts(spark, sf_dir, "dirty_customer", "dirty_orders")
    ids = [c["cid"] for c in known.columns if c["column"] in ("segment", "priority", "full_name")]
    named = known.profile.select("cid", "dataset", "column")
    return spelling_groups(known.freq, ids).join(F.broadcast(named), "cid").select(
        "dataset", "column", "key", "spellings", "cells")


def multi_value_cells(spark, sf_dir, *names):
    return facts(spark, sf_dir, *names).profile.where("kind = 'text' AND value_count > 0").selectExpr(
        "dataset", "column", "n_multi_value AS cells",
        "try_divide(n_multi_value, value_count) > 0.5D AS multi_value")


# scalar expressions

def date_parse(spark, sf_dir):
    """Every date text of the table, read under the convention its column proves."""
    rows = table(spark, sf_dir, "dirty_orders")
    read = dates.add_reading(rows, "order_date_text", "reading")
    # two flags decide the convention of the whole column
    proof = read.agg(F.expr("coalesce(bool_or(reading.evidence = 'DD/MM'), false)").alias("dm"),
                     F.expr("coalesce(bool_or(reading.evidence = 'MM/DD'), false)").alias("md")).first()
    known = dates.convention_of(proof.dm, proof.md)
    convention = f"'{known}'" if known else "cast(null AS string)"
    resolved = read.selectExpr("order_date_text", f"{dates.resolve('reading', convention)} AS r")
    return resolved.groupBy("order_date_text", F.expr("r.status AS status"),
                            F.expr("r.iso AS iso")).agg(F.expr("count(*) AS n"))


def currency_parse(spark, sf_dir):
    rows = numbers.add_currency(table(spark, sf_dir, "dirty_orders"), "amount_text", "money")
    return rows.selectExpr("order_id", "amount_text", "money.value AS value",
                           "money.currency AS currency", "money.confidence AS confidence")


def email_validate(spark, sf_dir):
    known = table(spark, sf_dir, "dirty_customer").selectExpr("email AS address")
    tokens = table(spark, sf_dir, "documents").selectExpr(
        "explode(split(text, '[ \\n]+')) AS address").where("contains(address, '@')")
    return known.unionByName(tokens).groupBy("address").agg(F.expr("count(*) AS n")).selectExpr(
        "address", "n", f"{text.validate_email('address')} AS v").selectExpr(
        "address", "n", "v.normalized AS normalized", "v.is_valid AS is_valid", "v.reason AS reason")


def contact_keys(spark, sf_dir):
    keyed = table(spark, sf_dir, "dirty_customer").selectExpr(
        f"{text.email_key('email')} AS e", f"{text.phone_key('phone')} AS p",
        f"{text.collapse_whitespace('full_name')} AS name")
    return keyed.selectExpr("name", "p AS phone", f"{text.block_key('e', 'p')} AS block")


def coerce_numbers(spark, sf_dir):
    rows = table(spark, sf_dir, "dirty_orders")
    return rows.groupBy("qty_text").agg(F.expr("count(*) AS n")).selectExpr(
        "qty_text", "n", f"{numbers.to_number('qty_text')} AS number",
        f"{text.is_numeric_like('qty_text')} AS numeric_like")


def placeholder_cells(spark, sf_dir):
    rows = table(spark, sf_dir, "dirty_customer")
    return rows.groupBy("segment").agg(F.expr("count(*) AS n")).selectExpr(
        "segment", "n", f"{text.is_placeholder('segment')} AS is_placeholder",
        f"{text.spelling_key('segment')} AS spelling_key",
        f"{cleaning.placeholder_fix('segment')} AS cleaned")


#: Files written from given tables under headers as people write them: blank, repeated, odd.
MESSY_HEADERS = {
    "supplier": (["Supplier Key", "", "nation-key", "Nation-Key"],
                 ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]),
    "part": ([" Part Key ", "Brand (UTF-8)", "%%", "size"],
             ["p_partkey", "p_brand", "p_type", "p_size"]),
    "nation": (["key", "key", "", ""], ["n_nationkey", "n_name", "n_regionkey", "n_name"]),
}


def _write_under(header: str, lines: DataFrame, path: str) -> None:
    """Write texts as lines, one file per partition, each under the header line."""
    def write(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_pydict({"value": [header]})
        for batch in batches:                      # the lines may be declared as never null
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["value"])

    lines.mapInArrow(write, "value string").write.text(path)


def _messy_file(spark, sf_dir, name: str) -> str:
    """The rows of a given table under a header line of its own."""
    headers, columns = MESSY_HEADERS[name]
    path = f"{_folder(spark)}/{name}.csv"
    cells = ", ".join(f"cast({c} AS string)" for c in columns)
    lines = spark.read.parquet(f"{sf_dir}/{name}.parquet").selectExpr(f"concat_ws(',', {cells}) AS value")
    _write_under(",".join(headers), lines, path)
    return path


def header_checks(spark, sf_dir):
    """Header problems of messy files, with the rows read under those headers."""
    found = None
    for name in MESSY_HEADERS:
        path = _messy_file(spark, sf_dir, name)
        rows = readers.read_delimited(spark, path)[0].agg(
            F.lit(name).alias("dataset"), F.count("*").alias("row_count"))
        one = columns.header_checks(readers.raw_headers(spark, path, name)).join(rows, "dataset")
        found = one if found is None else found.unionByName(one)
    return found


def clean_names(spark, sf_dir):
    """Every column of messy files: the reader's name, its clean form and its filled cells."""
    found = None
    for name in MESSY_HEADERS:
        data = readers.read_delimited(spark, _messy_file(spark, sf_dir, name))[0].drop(ROW_ID)
        cells = ", ".join(
            f"named_struct('column', {text.literal(c)}, 'clean_name', {text.literal(columns.clean_name(c))},"
            f" 'filled', n{i})" for i, c in enumerate(data.columns))
        one = data.agg(*(F.expr(f"count({text.column(c)})").alias(f"n{i}")
                         for i, c in enumerate(data.columns))).selectExpr(
            f"'{name}' AS dataset", f"inline(array({cells}))")
        found = one if found is None else found.unionByName(one)
    return found


# issues and policy

def issues(spark, sf_dir, *names, types=None):
    found = detect.detect_issues(facts(spark, sf_dir, *names), near_duplicate_search=False)
    found = found.select("dataset", "column", "issue_type", "severity", "affected_count")
    return found.where(F.col("issue_type").isin(types)) if types else found


def issue_examples(spark, sf_dir):
    return detect.issue_examples(facts(spark, sf_dir, "dirty_customer", "dirty_orders")).where(
        "issue_type IN ('missing_value_placeholder', 'mixed_data_types', 'invalid_email')").selectExpr(
        "dataset", "column", "issue_type", "array_join(examples, '|') AS examples")


def required_columns(spark, sf_dir):
    return detect.missing_required(facts(spark, sf_dir, "dirty_orders", "dirty_customer"), REQUIRED).select(
        "dataset", "issue_type", "affected_count", "description")


def _decided(spark, sf_dir, *names, protected=None):
    known = facts(spark, sf_dir, *names)
    return known, materialise(policy.decide(
        detect.detect_issues(known, near_duplicate_search=False), protected))


def decisions(spark, sf_dir):
    return _decided(spark, sf_dir, "dirty_orders", "dirty_customer", protected=PROTECTED)[1].select(
        "dataset", "column", "issue_type", "confidence", "act_order", "status")


def skip_counters(spark, sf_dir):
    return policy.skip_counters(
        _decided(spark, sf_dir, "dirty_orders", "dirty_customer", protected=PROTECTED)[1])


# cleaning

def _cleaned(spark, sf_dir, name, **options):
    known, decided = _decided(spark, sf_dir, name)
    return known, decided, cleaning.apply_cleaning(known, name, decided, **options)


def cleaned_rows(spark, sf_dir, name):
    return _cleaned(spark, sf_dir, name)[2].cleaned.drop(ROW_ID)


def change_log(spark, sf_dir, name):
    changes = _cleaned(spark, sf_dir, name)[2].changes
    return changes.groupBy("column", "issue_type", "original_value", "new_value").agg(
        F.expr("count(*) AS n"))


def cleaning_log(spark, sf_dir):
    _, decided, done = _cleaned(spark, sf_dir, "dirty_orders")
    return cleaning.cleaning_log(done, decided).select(
        "issue_type", "column", "confidence", "rule", "affected_count")


def audit(spark, sf_dir):
    _, decided, done = _cleaned(spark, sf_dir, "dirty_customer")
    rows = governance.audit_rows(decided, done.changes, "r1")
    return rows.groupBy("column", "issue_type", "status", "confidence").agg(
        F.expr("count(*) AS audit_rows"),
        F.expr("count_if(row_reference LIKE '%aggregated%') AS aggregated_rows"))


def cleaning_rows(spark, sf_dir):
    """The changes that were made, as the cleaning log of a run lists them."""
    _, decided, done = _cleaned(spark, sf_dir, "dirty_customer")
    rows = governance.cleaning_rows(governance.audit_rows(decided, done.changes, "r1"))
    return rows.groupBy("run_id", "column", "issue_type", "confidence").agg(F.expr("count(*) AS log_rows"))


# validation, scores

def validation_checks(spark, sf_dir, *names):
    return validation.validate(facts(spark, sf_dir, *names))


def business_rules(spark, sf_dir):
    return validation.business_rules("dirty_orders", table(spark, sf_dir, "dirty_orders"))


def _stages(spark, sf_dir, name):
    before, decided, done = _cleaned(spark, sf_dir, name)
    after = build_facts({name: materialise(done.cleaned)}, AS_OF)
    return before, decided, done, after


def publish_gate(spark, sf_dir, name):
    before, _, _, after = _stages(spark, sf_dir, name)
    return validation.gate(before, after, validation.validate(after))


def _scores(known, found, status=None):
    ready = readiness.overall_readiness(readiness.score_packs(readiness.readiness_checks(known, found)))
    return scoring.quality_score(known, found, ready, status)


def quality_score(spark, sf_dir, *names):
    known = facts(spark, sf_dir, *names)
    return _scores(known, detect.detect_issues(known, near_duplicate_search=False))


def validated_score(spark, sf_dir, *names):
    known = facts(spark, sf_dir, *names)
    return _scores(known, detect.detect_issues(known, near_duplicate_search=False),
                   validation.overall_status(validation.validate(known)))


def before_after(spark, sf_dir, name):
    before, decided, _, after = _stages(spark, sf_dir, name)
    after_issues = materialise(detect.detect_issues(after, near_duplicate_search=False))
    old = _scores(before, decided)
    new = _scores(after, after_issues, validation.overall_status(validation.validate(after)))
    return scoring.before_after(
        scoring.snapshot_metrics(before, decided, old, "before"),
        scoring.snapshot_metrics(after, after_issues, new, "after"))


def readiness_pack(spark, sf_dir, pack):
    known = facts(spark, sf_dir, "dirty_orders", "dirty_customer", "orders", "part", "events")
    return readiness.readiness_checks(
        known, detect.detect_issues(known, near_duplicate_search=False), packs=[pack]).select(
        "dataset", "platform", "check_name", "status")


def readiness_scores(spark, sf_dir):
    known = facts(spark, sf_dir, "dirty_orders", "dirty_customer", "orders", "part", "events")
    return readiness.score_packs(readiness.readiness_checks(
        known, detect.detect_issues(known, near_duplicate_search=False)))


def field_roles(spark, sf_dir):
    return readiness.field_roles(facts(spark, sf_dir, "dirty_orders", "dirty_customer")).select(
        "dataset", "column", "platform", "label")


def _linked(spark, sf_dir):
    for base in ("orders", "customer"):
        spark.read.parquet(f"{sf_dir}/{base}.parquet").createOrReplaceTempView(base)
    return {
        "orders.csv": spark.sql(inputs.LINKED_ORDERS).withColumn(ROW_ID, F.col("order_id")),
        "customers.csv": spark.sql(inputs.LINKED_CUSTOMERS).withColumn(ROW_ID, F.col("customer_id"))}


def orphan_keys(spark, sf_dir):
    return relationships.relationship_findings(_linked(spark, sf_dir)).selectExpr(
        "dataset", "column", "references", "orphan_count",
        "array_join(orphan_examples, '|') AS orphan_examples")


def relationship_readiness(spark, sf_dir):
    linked = _linked(spark, sf_dir)
    known = build_facts(linked, AS_OF)
    found = detect.detect_issues(known, near_duplicate_search=False)
    earlier = readiness.readiness_checks(
        known, found, relationships.relationship_checks(linked),
        ["power_bi", "sql", "qlik", "looker"])
    after = readiness.readiness_checks(known, found, packs=["power_bi", "sql", "qlik", "looker"])
    return readiness.score_packs(readiness.refresh_readiness(earlier, after))


# near duplicates

def near_duplicate_groups(spark, sf_dir, name, person, email, phone):
    found = neardup.contacts(table(spark, sf_dir, name), person, email, phone)
    return neardup.equal_groups(found).select("kind", "block", "key", "record_count", "pair_count")


def similar_names(spark, sf_dir):
    found = neardup.contacts(table(spark, sf_dir, "contacts"), "full_name", "email", "phone")
    return neardup.similar_names(found).drop("first_row_a", "first_row_b")


def close_names(spark, sf_dir):
    """Names of a block within half the edits that a similar name may have: pairs that the
    segment index must not miss, in a form that SQL can state."""
    found = neardup.contacts(table(spark, sf_dir, "contacts"), "full_name", "email", "phone")
    names = found.where("name != ''").groupBy("block", "name").agg(
        F.min("first_row").alias("first_row"))
    spare = f"length(name_a) + length(name_b) - 2 * {fewest_matches('length(name_a)', 'length(name_b)')}"
    pairs = neardup.candidates(names).where(f"2 * levenshtein(name_a, name_b) <= {spare}")
    return pairs.selectExpr("block", "least(name_a, name_b) AS name_a", "greatest(name_a, name_b) AS name_b")


def near_duplicate_pairs(spark, sf_dir):
    """What agrees and what differs in near-duplicate records, by number of records."""
    spark.read.parquet(f"{sf_dir}/customer.parquet").createOrReplaceTempView("customer")
    rows = spark.sql(inputs.CONTACTS).withColumn(ROW_ID, F.col("contact_id"))
    return detect.near_duplicate_evidence(build_facts({"contacts": rows}, AS_OF)).selectExpr(
        "row_a", "row_b", "similarity", "array_join(matching_fields, '|') AS matching",
        "array_join(conflicting_fields, '|') AS conflicting", "confidence", "recommended_action")


def near_duplicate_issue(spark, sf_dir):
    known = build_facts(frames(spark, sf_dir, "contacts"), AS_OF)
    return detect.near_duplicate_issues(known)


# governance

def lineage(spark, sf_dir, name):
    known, decided, done = _cleaned(spark, sf_dir, name)
    return governance.lineage(known, [done], decided).select(
        "lineage_id", "source_dataset", "source_column", "output_column", "rule", "confidence")


def data_dictionary(spark, sf_dir, name):
    before, decided, done, after = _stages(spark, sf_dir, name)
    rows = governance.data_dictionary(
        after, governance.lineage(before, [done], decided), [done], decided)
    return rows.selectExpr(
        "dataset", "column_name", "original_name", "data_type", "semantic_role", "nullable",
        "unique_count", "missing_count", "missing_percentage", "min", "max",
        "bround(mean, 4) AS mean", "median", "lineage_id", "power_bi_role", "sql_role",
        "tableau_role", "python_role", "r_role")


def _history(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceTempView("orders")
    runs = None
    for run_id, sql in inputs.ORDER_VERSIONS.items():
        version = spark.sql(sql).withColumn(ROW_ID, F.col("o_orderkey"))
        one = drift.profile_history(build_facts({"orders": version}, AS_OF), run_id)
        runs = one if runs is None else runs.unionByName(one)
    return runs


def drift_findings(spark, sf_dir):
    return drift.drift_findings(_history(spark, sf_dir)).selectExpr(
        "dataset", "run_id", "compared_against", "drift_type", "column", "severity",
        "CASE WHEN drift_type LIKE 'distribution%' THEN cast(bround(double(previous), 2) AS string)"
        " ELSE previous END AS previous",
        "CASE WHEN drift_type LIKE 'distribution%' THEN cast(bround(double(current), 2) AS string)"
        " ELSE current END AS current")


def drift_summary(spark, sf_dir):
    history = _history(spark, sf_dir)
    return drift.drift_summary(history, drift.drift_findings(history))


def _folder(spark) -> str:
    """A new place in the shared folder; the writers create it."""
    return f"{checkpoint_dir(spark)}/plumbline-{uuid.uuid4().hex}"


def history_latest(spark, sf_dir):
    path = f"{_folder(spark)}/history"
    history = materialise(_history(spark, sf_dir))
    for _ in range(2):                             # a run that is written again is stored once
        sinks.write_history(history, path)
    return drift.latest_before(sinks.read_history(spark, path), "1999").select(
        "dataset", "run_id", "column", "inferred_type", "row_count")


# sources and sinks

def scan_csv(spark, sf_dir):
    path = f"{_folder(spark)}/part.csv"
    source = spark.read.parquet(f"{sf_dir}/part.parquet")
    source.write.option("header", True).csv(path)
    return readers.read_delimited(spark, path)[0].drop(ROW_ID)


def scan_quoted_csv(spark, sf_dir):
    """Whole texts with quotes, commas and line ends, and identifiers beyond 64 bits."""
    path = f"{_folder(spark)}/documents.csv"
    spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(
        "doc_id", "concat('9', lpad(doc_id, 24, '0')) AS wide_id",
        "concat('say \"', doc_id, '\", ', text, '\n,\"') AS Text", "lang AS text_2").write.options(
        header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False).csv(path)
    return readers.read_delimited(spark, path, split_bytes=256 << 10)[0].selectExpr(
        "doc_id", "cast(wide_id AS string) AS wide_id", "md5(Text) AS text_md5", "text_2 AS lang")


def scan_blank_cells(spark, sf_dir):
    """Blank cells of a delimited file are missing, whatever blanks they hold."""
    path = f"{_folder(spark)}/blank.csv"
    spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(
        "p_partkey", "CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '   ' WHEN 2 THEN '\t'"
        " ELSE p_brand END AS brand", "IF(p_partkey % 5 = 0, NULL, p_size) AS size").write.options(
        header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return readers.read_delimited(spark, path)[0].agg(*map(F.expr, [
        "count(*) AS row_count", "count(brand) AS brands", "count(size) AS sizes",
        "sum(size) AS size_sum"]))


ODD_HEADERS = """SELECT c_custkey AS id,
  CASE WHEN c_custkey % 3 = 0 THEN concat(' ', c_name) ELSE c_name END AS `owner's note`,
  CASE WHEN c_custkey % 4 = 0 THEN concat(c_name, '  ') ELSE c_name END AS `ssn\t`,
  CASE WHEN c_custkey % 5 = 0 THEN concat('  ', c_name) ELSE c_name END AS `a.b` FROM customer"""


def odd_headers(spark, sf_dir):
    """Decisions and changed cells where names hold an apostrophe, a tab and a dot."""
    spark.read.parquet(f"{sf_dir}/customer.parquet").createOrReplaceTempView("customer")
    name = "o'brien.csv"
    known = build_facts({name: spark.sql(ODD_HEADERS).withColumn(ROW_ID, F.col("id"))}, AS_OF)
    decided = materialise(policy.decide(
        detect.detect_issues(known, near_duplicate_search=False), {name: [" SSN"]}))
    changes = cleaning.apply_cleaning(known, name, decided).changes.where(
        "issue_type = 'whitespace_formatting'").groupBy("dataset", "column").agg(
        F.count("*").alias("changed"))
    return decided.where("issue_type = 'whitespace_formatting'").join(
        changes, ["dataset", "column"], "left").select(
        "dataset", "column", "affected_count", "status", "changed")


def long_cells(spark, sf_dir):
    """Profile of cells beyond any short limit: padded dates, amounts and category spellings."""
    spark.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceTempView("orders")
    rows = spark.sql(LONG_CELLS).withColumn(ROW_ID, F.col("id"))
    known = build_facts({"long": rows}, AS_OF)
    listed = "array_join(transform(categorical_extra.top_categories, x -> md5(x.value)), '|')"
    return known.profile.where("column != 'id'").selectExpr(
        "column", "inferred_type", "unique_count", "date_extra.invalid_count AS invalid_dates",
        "date_extra.min AS first_date", "money_values", f"{listed} AS top_values",
        "size(categorical_extra.potential_inconsistencies) AS spelling_groups")


LONG_CELLS = """SELECT o_orderkey AS id,
  concat(cast(date_add(DATE '2024-01-01', cast(o_orderkey % 50 AS int)) AS string), repeat(' ', 300)) AS day,
  concat(CASE WHEN o_orderkey % 2 = 0 THEN '$' ELSE 'EUR ' END, o_orderkey, repeat(' ', 300)) AS amount,
  concat(CASE o_orderkey % 7 WHEN 0 THEN 'Long' WHEN 1 THEN 'long' WHEN 2 THEN 'long' ELSE 'other' END,
         repeat('x', 300)) AS kind FROM orders"""


def scan_ragged_csv(spark, sf_dir):
    """Rows with an extra field are left out and counted, short rows are padded."""
    path = f"{_folder(spark)}/ragged.csv"
    lines = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(
        "CASE WHEN p_partkey % 10 = 3 THEN concat_ws(',', p_partkey, p_brand, p_type, 'extra')"
        " WHEN p_partkey % 10 = 4 THEN concat_ws(',', p_partkey, p_brand)"
        " ELSE concat_ws(',', p_partkey, p_brand, p_type) END AS value")
    _write_under("p_partkey,p_brand,p_type", lines.repartition(3), path)
    data, skipped = readers.read_delimited(spark, path)
    return data.agg(*map(F.expr, [
        "count(*) AS row_count", "count(p_type) AS with_type", "sum(p_partkey) AS key_sum"])
    ).withColumn("skipped_rows", F.lit(skipped.first().skipped_rows))


def scan_json(spark, sf_dir):
    path = f"{_folder(spark)}/nation.json"
    spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr(
        "n_nationkey", "named_struct('name', n_name, 'region', named_struct('key', n_regionkey)) AS n"
    ).write.json(path)
    df = readers.read_json(spark, path, lines=True)
    return df.selectExpr("n_nationkey", "`n.name` AS n_name", "`n.region.key` AS n_regionkey")


def scan_xml(spark, sf_dir):
    path = f"{_folder(spark)}/part.xml"
    spark.read.parquet(f"{sf_dir}/part.parquet").write.format("xml").option(
        "rowTag", "part").option("rootTag", "parts").save(path)
    return readers.read_xml(spark, path, "part").drop(ROW_ID)


def scan_foreign_xml(spark, sf_dir):
    """Files under a foreign tag that begin with another element, read without a tag."""
    path = f"{_folder(spark)}/foreign.xml"

    def write(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_pydict({"value": ["<export><info><v>1</v></info>"]})
        yield from batches
        yield pa.RecordBatch.from_pydict({"value": ["</export>"]})

    cell = "replace(replace(p_name, '&', '&amp;'), '<', '&lt;')"
    spark.read.parquet(f"{sf_dir}/part.parquet").repartition(2).selectExpr(
        f"concat('<rec><key>', p_partkey, '</key><name>', {cell}, '</name></rec>') AS value"
    ).mapInArrow(write, "value string").write.text(path)
    return readers.read_xml(spark, path).select("key", "name", "v")


def scan_feather(spark, sf_dir):
    """Feather files written by tasks, one per partition, and read back by their footers."""
    import os

    path = _folder(spark)
    # tasks write plain files, so the shared folder has to be mounted on every machine
    mounted = path.removeprefix("file:")
    source = spark.read.parquet(f"{sf_dir}/part.parquet")

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        writer = None
        for batch in batches:
            if writer is None:
                os.makedirs(mounted, exist_ok=True)
                name = os.path.join(mounted, f"part-{TaskContext.get().partitionId()}.feather")
                writer = pa.ipc.new_file(name, batch.schema)
            writer.write_batch(batch)
        if writer is not None:
            writer.close()
        yield pa.RecordBatch.from_pydict({"files": pa.array([int(writer is not None)], pa.int64())})

    source.repartition(4).mapInArrow(write, "files bigint").write.format("noop").mode("overwrite").save()
    return readers.read_feather(spark, path).drop(ROW_ID)


def scan_folder(spark, sf_dir):
    base = _folder(spark)
    for name, kind in (("nation", "parquet"), ("region", "json"), ("supplier", "csv")):
        writer = spark.read.parquet(f"{sf_dir}/{name}.parquet").write
        if kind == "csv":
            writer = writer.option("header", True)
        getattr(writer, kind)(f"{base}/{name}.{kind}")
    paths = [f"{base}/nation.parquet", f"{base}/region.json", f"{base}/supplier.csv",
             f"{base}/notes.docx", f"{base}/gone.parquet"]
    found, status = readers.read_folder(spark, paths)
    counts = None
    for name, df in found.items():
        one = df.agg(F.expr("count(*) AS row_count")).withColumn("dataset", F.lit(name))
        counts = one if counts is None else counts.unionByName(one)
    return status.join(counts, "dataset", "left").select("dataset", "format", "status", "row_count")


#: Columns that fail when they are computed, as damaged data does.
FAILING = {"part": "cast(p_name AS int) AS p_number", "supplier": "1 DIV (s_suppkey - 3) AS s_share"}


def isolated_run(spark, sf_dir):
    """Where each dataset of a run gets to: damaged files, failing columns, sound tables."""
    base = _folder(spark)
    spark.read.parquet(f"{sf_dir}/region.parquet").write.json(f"{base}/damaged.parquet")
    paths = [f"{base}/damaged.parquet", f"{base}/gone.csv"]
    for name in ("nation", "customer", "part", "supplier"):
        paths.append(f"{sf_dir}/{name}.parquet")
    found, loaded = readers.read_folder(spark, paths)
    for name, column in FAILING.items():
        found[f"{name}.parquet"] = found[f"{name}.parquet"].selectExpr("*", column)
    # a row per path
    broken = {r.dataset: r.reason for r in loaded.where("status = 'failed'").collect()}
    report, status = isolation.run_isolated(
        found, "r1", broken, AS_OF, near_duplicate_search=False, platforms=["sql"])
    scored = report.tables["quality_after"].select("dataset", F.lit(True).alias("scored"))
    rows = report.tables["dataset_profile"].select("dataset", "row_count")
    return status.join(rows, "dataset", "left").join(scored, "dataset", "left").selectExpr(
        "dataset", "stage", "status", "row_count", "coalesce(scored, false) AS scored",
        "reason IS NOT NULL AS explained")


def row_id_scan(spark, sf_dir):
    """Rows of several files numbered by file and position."""
    path = f"{_folder(spark)}/parts"
    spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey").repartition(
        5, "o_orderkey").write.parquet(path)
    numbered = readers.read_parquet(spark, path)
    return numbered.agg(*map(F.expr, [
        "count(*) AS row_count", f"count(DISTINCT {ROW_ID}) AS ids",
        f"count(DISTINCT shiftright({ROW_ID}, 40)) AS files"]))


def sink_roundtrip(spark, sf_dir):
    done = _cleaned(spark, sf_dir, "dirty_customer")[2]
    path = f"{_folder(spark)}/cleaned"
    sinks.write_cleaned(done.cleaned, path, published=True)
    return spark.read.parquet(path)


def log_append(spark, sf_dir):
    _, decided, done = _cleaned(spark, sf_dir, "dirty_customer")
    path = f"{_folder(spark)}/audit"
    for run in ("r1", "r2", "r1"):                 # a run that is written again is stored once
        sinks.write_log(governance.audit_rows(decided, done.changes, run), path)
    return spark.read.parquet(path).groupBy("run_id", "issue_type", "status").agg(
        F.expr("count(*) AS audit_rows"))


def table_fingerprint(spark, sf_dir):
    plain = table(spark, sf_dir, "orders")
    a = sinks.table_fingerprint(plain)
    b = sinks.table_fingerprint(plain.repartition(7)).withColumnRenamed("checksum", "other")
    return a.join(b, "row_count").selectExpr("row_count", "checksum = other AS order_free")


def file_fingerprint(spark, sf_dir):
    return sinks.file_fingerprints(spark, f"{sf_dir}/nation.parquet").selectExpr(
        "substring_index(path, '/', -1) AS file", "sha256")


DETECTORS = {
    "placeholder_issues": (("dirty_orders", "dirty_customer"), ["missing_value_placeholder"]),
    "duplicate_issues": (("dirty_orders", "dirty_customer", "conversations"),
                         ["duplicate_rows", "duplicate_id"]),
    "mixed_type_issues": (("dirty_orders", "part"), ["mixed_data_types"]),
    "category_issues": (("dirty_orders", "dirty_customer"), ["category_inconsistency"]),
    "whitespace_issues": (("dirty_customer", "dirty_orders", "documents"), ["whitespace_formatting"]),
    "date_issues": (("dirty_orders", "orders", "events"),
                    ["invalid_date", "future_date", "ambiguous_date", "ambiguous_date_format"]),
    "range_issues": (("pages", "lineitem", "dirty_orders"), ["impossible_value", "negative_value"]),
    "outlier_issues": (("lineitem", "events", "documents"), ["outlier"]),
    "schema_issues": (("dirty_orders", "part", "customer"),
                      ["constant_column", "empty_column", "high_cardinality"]),
    "email_issues": (("dirty_customer", "customer"), ["invalid_email"]),
    "currency_issues": (("dirty_orders", "documents", "pages"),
                        ["currency_value", "currency_inconsistency"]),
}
PROFILED = ("lineitem", "orders", "part")
TYPED = ("orders", "part", "events", "documents", "customer", "dirty_orders", "dirty_customer")
SCORED = ("dirty_orders", "dirty_customer", "lineitem")


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def on(function, *args, **options):
        return lambda spark, sf_dir: function(spark, sf_dir, *args, **options)

    return {
        "numeric_profile": on(numeric_profile, *PROFILED),
        "missing_and_unique": on(missing_and_unique, *TYPED),
        "example_values": example_values, "top_categories": top_categories,
        "rare_categories": rare_categories, "text_profile": text_profile,
        "date_profile": date_profile, "infer_types": on(infer_types, *TYPED),
        "table_roles": on(table_roles, *TYPED), "constant_columns": constant_columns,
        "dataset_counts": dataset_counts, "spelling_variants": spelling_variants,
        "multi_value_cells": on(multi_value_cells, "part", "dirty_orders", "documents", "events"),
        "date_parse": date_parse, "currency_parse": currency_parse,
        "email_validate": email_validate, "contact_keys": contact_keys,
        "coerce_numbers": coerce_numbers, "placeholder_cells": placeholder_cells,
        "header_checks": header_checks, "clean_names": clean_names,
        **{n: on(issues, *names, types=types) for n, (names, types) in DETECTORS.items()},
        "all_issues": on(issues, *SCORED), "issue_examples": issue_examples,
        "required_columns": required_columns, "decisions": decisions,
        "skip_counters": skip_counters,
        "cleaned_orders": on(cleaned_rows, "dirty_orders"),
        "cleaned_customers": on(cleaned_rows, "dirty_customer"),
        "change_log_orders": on(change_log, "dirty_orders"),
        "change_log_customers": on(change_log, "dirty_customer"),
        "cleaning_log": cleaning_log, "audit_rows": audit, "cleaning_rows": cleaning_rows,
        "scan_quoted_csv": scan_quoted_csv, "scan_blank_cells": scan_blank_cells,
        "odd_headers": odd_headers, "long_cells": long_cells,
        "validation_checks": on(validation_checks, *SCORED), "business_rules": business_rules,
        "publish_gate": on(publish_gate, "dirty_orders"),
        "quality_score": on(quality_score, *SCORED),
        "validated_score": on(validated_score, *SCORED),
        "before_after": on(before_after, "dirty_orders"),
        **{f"readiness_{p}": on(readiness_pack, p) for p in readiness.PACKS},
        "readiness_scores": readiness_scores, "field_roles": field_roles,
        "orphan_keys": orphan_keys, "relationship_readiness": relationship_readiness,
        "near_duplicate_groups": on(
            near_duplicate_groups, "dirty_customer", "full_name", "email", "phone"),
        "near_duplicate_contacts": on(
            near_duplicate_groups, "contacts", "full_name", "email", "phone"),
        "similar_names": similar_names, "near_duplicate_issue": near_duplicate_issue,
        "close_names": close_names, "near_duplicate_pairs": near_duplicate_pairs,
        "lineage": on(lineage, "dirty_orders"), "data_dictionary": on(data_dictionary, "dirty_orders"),
        "drift_findings": drift_findings, "drift_summary": drift_summary,
        "history_latest": history_latest,
        "scan_csv": scan_csv, "scan_ragged_csv": scan_ragged_csv, "scan_json": scan_json,
        "scan_xml": scan_xml, "scan_foreign_xml": scan_foreign_xml, "scan_feather": scan_feather, "scan_folder": scan_folder,
        "isolated_run": isolated_run,
        "row_id_scan": row_id_scan, "sink_roundtrip": sink_roundtrip, "log_append": log_append,
        "table_fingerprint": table_fingerprint, "file_fingerprint": file_fingerprint,
    }
