"""Sinks and stored history.

With ``write_log`` and ``write_history`` a run owns the partition folders that carry its identifier:
writing it again replaces them and leaves all other runs alone, so a repeated or resumed run is
stored once. Spark commits the new folders only when all tasks are done.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plumbline.functions.text import column as quoted
from plumbline.operators.columns import ROW_ID, data_columns
from plumbline.sources.arrow_files import hash_files


def write_cleaned(cleaned: DataFrame, path: str, published: bool, file_format: str = "parquet") -> bool:
    """Write a cleaned dataset if the gate lets it through; the raw input is never touched."""
    if not published:
        return False
    writer = cleaned.drop(ROW_ID).write.mode("overwrite").format(file_format)
    if file_format == "csv":
        writer = writer.option("header", True)
    writer.save(path)
    return True


def _write_runs(rows: DataFrame, path: str, *partitions: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        *partitions).parquet(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Append audit, cleaning or drift rows to what their runs hold already."""
    rows.write.mode("append").partitionBy("run_id").parquet(path)


def write_log(rows: DataFrame, path: str) -> None:
    """Store all audit, cleaning or drift rows of runs, one partition folder per run."""
    _write_runs(rows, path, "run_id")


def dataset_key(name: str) -> str:
    """The name under which versions of a dataset are kept."""
    stem = name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    return re.sub("[^0-9a-zA-Z]+", "_", stem).strip("_").lower() or "dataset"


def key_of(dataset: str) -> str:
    """SQL for ``dataset_key``."""
    stem = f"regexp_replace(regexp_replace({dataset}, '^.*/', ''), '[.][^.]*$', '')"
    key = f"lower(regexp_replace(regexp_replace({stem}, '[^0-9a-zA-Z]+', '_'), '^_|_$', ''))"
    return f"CASE WHEN {key} = '' THEN 'dataset' ELSE {key} END"


def write_history(history: DataFrame, path: str) -> None:
    """Store the profile rows of runs under the key of their dataset, so that reading one dataset
    prunes the others."""
    _write_runs(history.withColumn("dataset_key", F.expr(key_of("dataset"))), path, "dataset_key", "run_id")


def read_history(spark: SparkSession, path: str, dataset: str | None = None) -> DataFrame:
    """Stored profile rows, of all datasets or of one and its renamed versions."""
    reader = spark.read.option("basePath", path)
    # keys and run identifiers that look like numbers are texts
    schema = T.StructType([
        T.StructField(f.name, T.StringType()) if f.name in ("run_id", "dataset_key") else f
        for f in reader.parquet(path).schema.fields])
    found = reader.schema(schema).parquet(path)
    if dataset is not None:
        found = found.where(F.col("dataset_key") == dataset_key(dataset))
    return found.drop("dataset_key")


def table_fingerprint(df: DataFrame) -> DataFrame:
    """(row_count, checksum): content hash that does not depend on row order or partitions."""
    columns = data_columns(df)
    missing = "concat(" + ", ".join(f"int({quoted(c)} IS NULL)" for c in columns) + ")"
    hashed = f"xxhash64({missing}, {', '.join(map(quoted, columns))})"
    return df.selectExpr(f"{hashed} AS h").agg(
        F.expr("count(*) AS row_count"),
        F.expr("sha2(concat_ws('-', count(*), bit_xor(h), sum(cast(h AS decimal(38,0)))), 256)"
               " AS checksum"))


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of whole files of any size."""
    return hash_files(spark, path)
