"""The column catalogue: what each column is physically, and what its name implies."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plumbline.storage import local_table

ROW_ID = "_row_id"

# Name patterns (all case-insensitive, found anywhere unless anchored).
NAME_PATTERNS = {
    "email": "email",
    "phone": "phone|mobile|contact_number",
    "person": "name",
    "money": "amount|price|revenue|cost|salary|fee|amt|total|subtotal|tax",
    "countable": "quantity|count",
    "identifier": "(^|_)id$|^id(_|$)",
    "link": "_id$",
    "geographic": r"country|state|city|region|zip|postal|latitude|longitude|\blat\b|\blng\b|\bgeo\b",
    "target": "target|label|outcome|churn|default|class|y$",
    "currency_label": "price|amount|revenue|cost|total|subtotal|tax",
    "percent_label": "percent|pct|rate",
    "subtotal": "subtotal",
    "tax": "^tax$|_tax$",
    "total": "^total$|_total$",
    "quantity": "quantity",
    "unit_price": "unit_?price|^price$",
    "revenue": "revenue|^amount$",
    "start_date": "start_?date",
    "end_date": "end_?date",
}
# Plausible ranges by name; the first pattern found in a name applies.
RANGE_RULES = [("age", 0.0, 120.0), ("percent|pct", 0.0, 100.0), ("rating", 1.0, 5.0)]


def name_matches(name: str, rule: str) -> bool:
    return re.search(NAME_PATTERNS[rule], name, re.IGNORECASE) is not None


def first_named(names: list[str], rule: str) -> str | None:
    return next((n for n in names if name_matches(n, rule)), None)


def plausible_range(name: str) -> tuple[float, float] | None:
    return next(((lo, hi) for p, lo, hi in RANGE_RULES if re.search(p, name, re.IGNORECASE)), None)


@dataclass(frozen=True)
class ColumnInfo:
    dataset: str
    position: int
    name: str
    data_type: T.DataType

    @property
    def kind(self) -> str:
        t = self.data_type
        if isinstance(t, (T.StringType, T.VarcharType, T.CharType)):
            return "text"
        if isinstance(t, T.BooleanType):
            return "boolean"
        if isinstance(t, T.IntegralType):
            return "integer"
        if isinstance(t, (T.FractionalType)):
            return "decimal" if isinstance(t, T.DecimalType) else "float"
        if isinstance(t, T.DateType):
            return "date"
        if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            return "timestamp"
        return "nested"


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ROW_ID]


def describe_columns(dataset: str, df: DataFrame) -> list[ColumnInfo]:
    fields = [f for f in df.schema.fields if f.name != ROW_ID]
    return [ColumnInfo(dataset, i, f.name, f.dataType) for i, f in enumerate(fields)]


def clean_name(name: str) -> str:
    """snake_case form of a header."""
    return re.sub("[^0-9a-zA-Z]+", "_", name.strip()).strip("_").lower() or "column"


_FLAGS = [f"is_{rule}" for rule in NAME_PATTERNS]
COLUMN_SCHEMA = (
    "cid int, dataset string, position int, column string, clean_name string, dtype string, "
    "kind string, range_low double, range_high double, "
    + ", ".join(f"{flag} boolean" for flag in _FLAGS)
)


def column_rows(infos: list[ColumnInfo]) -> list[dict]:
    """One record per column of the catalogue; the size is the width of the schemas."""
    rows = []
    for cid, info in enumerate(infos):
        low, high = plausible_range(info.name) or (None, None)
        rows.append({
            "cid": cid, "dataset": info.dataset, "position": info.position,
            "column": info.name, "clean_name": clean_name(info.name),
            "dtype": info.data_type.simpleString(), "kind": info.kind,
            "range_low": low, "range_high": high,
            **{f"is_{rule}": name_matches(info.name, rule) for rule in NAME_PATTERNS}})
    return rows


def column_table(spark: SparkSession, infos: list[ColumnInfo]) -> DataFrame:
    return local_table(spark, column_rows(infos), COLUMN_SCHEMA)


def header_checks(columns: DataFrame) -> DataFrame:
    """Duplicate and unnamed headers per dataset, from (dataset, position, column) rows."""
    counted = columns.groupBy("dataset", "column").agg(F.count(F.lit(1)).alias("copies"))
    bad = counted.withColumn(
        "problem",
        F.when(F.col("column").rlike(r"^Unnamed:|^\s*$"), "unnamed")
        .when(F.col("copies") > 1, "duplicate"))
    return bad.groupBy("dataset").agg(
        F.sum("copies").alias("column_count"),
        F.count_if(F.col("problem") == "duplicate").alias("duplicate_names"),
        F.coalesce(F.sum(F.when(F.col("problem") == "unnamed", F.col("copies"))), F.lit(0))
        .alias("unnamed_headers"),
        F.when(F.count("problem") > 0, "fail").otherwise("pass").alias("status"))

