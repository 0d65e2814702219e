"""Cutting lineage through storage that survives the loss of an executor."""

from __future__ import annotations

import re
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_schema

_METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only in local mode without one."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is None:
        current = spark.conf.get("spark.checkpoint.dir", None)
        if current is None:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            current = tempfile.mkdtemp(prefix="plumbline-")
        context.setCheckpointDir(current)
    return current


def materialise(df: DataFrame) -> DataFrame:
    """Write a result to the shared folder once and read it from there afterwards.

    As a Parquet table its readers prune columns and push filters down, and a lost executor
    costs a re-read instead of a recomputation.
    """
    return materialise_union([df])


def materialise_union(parts: list[DataFrame]) -> DataFrame:
    """Write frames of one schema by jobs of their own, side by side, and read them as one table."""
    spark = parts[0].sparkSession
    root = checkpoint_dir(spark)
    paths = [f"{root}/plumbline-{uuid.uuid4().hex}" for _ in parts]
    with ThreadPoolExecutor(max_workers=len(parts)) as pool:
        list(pool.map(lambda one: one[0].write.parquet(one[1]), zip(parts, paths)))
    return spark.read.schema(parts[0].schema).parquet(*paths)


def prefer_compiled_methods(spark: SparkSession) -> None:
    """Keep generated methods small enough for the JIT compiler.

    Classifying a value takes many expressions; fused into one method they exceed what the
    JVM compiles and run interpreted. Beyond this size Spark uses split projections instead.
    A limit the user has set is left alone.
    """
    if spark.conf.get(_METHOD_LIMIT) == "65535":
        spark.conf.set(_METHOD_LIMIT, "8000")


def local_table(spark: SparkSession, rows: list[dict], schema: str | T.StructType) -> DataFrame:
    """A table the driver already holds, as a local relation of the plan.

    Only for tables whose size follows the schemas (a row per column, check or dataset),
    never the data.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    table = pa.Table.from_pylist(rows, schema=to_arrow_schema(schema))
    return spark.createDataFrame(table, schema=schema)
