"""Exact quantiles of weighted values without sorting a whole column in one task.

Each wanted rank sits in a value range. While the range still holds many distinct values it
is cut into equal-width buckets, counted with map-side aggregation, and replaced by the one
bucket that holds the rank. Only a bounded remainder is ever ordered.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from plumbline.storage import local_table

BUCKETS = 4096
# A range with at most this many distinct values is ordered directly.
DIRECT_LIMIT = 250_000
_LARGEST = 1.7976931348623157e308

_RANGE_SCHEMA = "cid int, rank long, low double, high double, base long"


def _clamped(c):
    return F.greatest(F.least(c, F.lit(_LARGEST)), F.lit(-_LARGEST))


def _tables(values: DataFrame, ranges: list[tuple]) -> tuple[DataFrame, DataFrame]:
    """The distinct ranges to read, and the wanted ranks; a few rows per column."""
    spark = values.sparkSession
    names = ("cid", "rank", "low", "high", "base")
    windows = [dict(zip(("cid", "low", "high"), w)) for w in {(r[0], r[2], r[3]) for r in ranges}]
    return (
        F.broadcast(local_table(spark, windows, "cid int, low double, high double")),
        F.broadcast(local_table(spark, [dict(zip(names, r)) for r in ranges], _RANGE_SCHEMA)))


def _narrow(values: DataFrame, ranges: list[tuple]) -> list:
    windows, wanted = _tables(values, ranges)
    v, low, high = (_clamped(F.col(n)) for n in ("v", "low", "high"))
    position = (v * 0.5 - low * 0.5) / (high * 0.5 - low * 0.5)
    bucket = F.least(F.floor(position * BUCKETS), F.lit(BUCKETS - 1))
    counted = (
        values.join(windows, "cid")
        .where(F.col("v").between(F.col("low"), F.col("high")))
        .groupBy("cid", "low", "high", bucket.alias("bucket"))
        .agg(F.sum("cnt").alias("cnt"), F.count(F.lit(1)).alias("distinct_values"),
             F.min("v").alias("new_low"), F.max("v").alias("new_high")))
    running = Window.partitionBy("cid", "low", "high").orderBy("bucket")
    return (
        counted.withColumn("upto", F.sum("cnt").over(running))
        .join(wanted, ["cid", "low", "high"])
        .withColumn("before", F.col("base") + F.col("upto") - F.col("cnt"))
        .where((F.col("rank") >= F.col("before"))
               & (F.col("rank") < F.col("before") + F.col("cnt")))
        .select("cid", "rank", "new_low", "new_high", "before", "distinct_values")
        .collect())


def _select(values: DataFrame, ranges: list[tuple]) -> dict[tuple[int, int], float]:
    """Order statistics from ranges that are small enough to be ordered."""
    windows, wanted = _tables(values, ranges)
    running = Window.partitionBy("cid", "low", "high").orderBy("v")
    rows = (
        values.join(windows, "cid")
        .where(F.col("v").between(F.col("low"), F.col("high")))
        .withColumn("upto", F.sum("cnt").over(running))
        .join(wanted, ["cid", "low", "high"])
        .where((F.col("rank") >= F.col("base") + F.col("upto") - F.col("cnt"))
               & (F.col("rank") < F.col("base") + F.col("upto")))
        .select("cid", "rank", "v").collect())
    return {(r.cid, r.rank): r.v for r in rows}


def exact_quantiles(
    values: DataFrame,
    extents: dict[int, tuple[int, int, float, float]],
    probabilities: tuple[float, ...] = (0.25, 0.5, 0.75),
    direct_limit: int = DIRECT_LIMIT,
) -> dict[int, list[float]]:
    """Linearly interpolated quantiles per column.

    ``values`` has (cid, v, cnt) with one row per distinct value; ``extents`` gives each
    column's (row count, distinct values, minimum, maximum).
    """
    ready, open_ranges = [], []
    for cid, (rows, distinct, low, high) in extents.items():
        ranks = {r for p in probabilities
                 for r in (math.floor((rows - 1) * p), math.ceil((rows - 1) * p))}
        target = ready if distinct <= direct_limit else open_ranges
        target.extend((cid, rank, low, high, 0) for rank in sorted(ranks))
    while open_ranges:
        narrowed = _narrow(values, open_ranges)
        open_ranges = []
        for r in narrowed:
            done = r.distinct_values <= direct_limit or r.new_low == r.new_high
            (ready if done else open_ranges).append(
                (r.cid, r.rank, r.new_low, r.new_high, r.before))
    found = _select(values, ready) if ready else {}
    result = {}
    for cid, (rows, *_rest) in extents.items():
        quantiles = []
        for p in probabilities:
            at = (rows - 1) * p
            below, above = found[cid, math.floor(at)], found[cid, math.ceil(at)]
            share = at - math.floor(at)
            quantiles.append(below if share == 0 else below + (above - below) * share)
        result[cid] = quantiles
    return result
