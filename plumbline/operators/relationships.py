"""Foreign keys found by name, and the keys that point nowhere."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from plumbline.functions import text
from plumbline.functions.text import column as quoted
from plumbline.operators.columns import data_columns
from plumbline.storage import local_table

FINDING_SCHEMA = (
    "dataset string, column string, references string, orphan_count bigint, "
    "orphan_examples array<string>"
)
EXAMPLES = 5


def _singular(name: str) -> str:
    return name[:-1] if name.endswith("s") else name


def _subject(dataset: str) -> str:
    return _singular(dataset.rsplit("/", 1)[-1].split(".")[0].lower())


def find_links(frames: Mapping[str, DataFrame]) -> list[tuple[str, str, str]]:
    """(dataset, column, referenced dataset): 'x_id' refers to the dataset called 'x' or 'xs'."""
    links = []
    for dataset, df in frames.items():
        for c in data_columns(df):
            named = re.fullmatch("(?i)(.+)_id", c)
            if not named or named[1].lower() == _subject(dataset):
                continue
            target = next((o for o, other in frames.items()
                           if o != dataset and _subject(o) == named[1].lower()
                           and c in data_columns(other)), None)
            if target:
                links.append((dataset, c, target))
    return links


def orphan_keys(child: DataFrame, parent: DataFrame, column: str) -> DataFrame:
    """Distinct keys of ``child`` that ``parent`` lacks.

    Both sides are reduced to distinct keys first, so a key that fills a third of the rows
    crosses the shuffle once per task. Keys of different types compare as text.
    """
    c = quoted(column)
    same = child.schema[column].dataType == parent.schema[column].dataType
    key = c if same else f"cast({c} AS string)"
    left = child.selectExpr(f"{key} AS key").where("key IS NOT NULL").distinct()
    right = parent.selectExpr(f"{key} AS key").where("key IS NOT NULL").distinct()
    return left.join(right, "key", "left_anti")


def relationship_findings(
    frames: Mapping[str, DataFrame], links: list[tuple[str, str, str]] | None = None,
) -> DataFrame:
    """One row per link with orphans; links may be given instead of found by name."""
    links = find_links(frames) if links is None else links
    result = None
    for dataset, column, target in links:
        orphans = orphan_keys(frames[dataset], frames[target], column).selectExpr(
            "cast(key AS string) AS key")
        # a bounded top list: the ordered limit keeps a few rows per task
        first = orphans.orderBy("key").limit(EXAMPLES).agg(
            F.expr(f"{text.literal(dataset)} AS dataset"),
            F.expr("sort_array(collect_list(key)) AS orphan_examples"))
        counted = orphans.agg(F.expr(f"{text.literal(dataset)} AS dataset"), F.expr("count(*) AS orphan_count"))
        finding = counted.where("orphan_count > 0").join(F.broadcast(first), "dataset").selectExpr(
            "dataset", f"{text.literal(column)} AS column", f"{text.literal(target)} AS references",
            "orphan_count", "orphan_examples")
        result = finding if result is None else result.unionByName(finding)
    if result is None:
        spark = next(iter(frames.values())).sparkSession
        return local_table(spark, [], FINDING_SCHEMA)
    return result


def relationship_checks(
    frames: Mapping[str, DataFrame], links: list[tuple[str, str, str]] | None = None,
) -> DataFrame:
    """(dataset, status): warning where keys are orphaned, not_applicable for a lone dataset."""
    spark = next(iter(frames.values())).sparkSession
    names = local_table(spark, [{"dataset": d} for d in frames], "dataset string")
    if len(frames) < 2:
        return names.selectExpr("dataset", "'not_applicable' AS status")
    broken = relationship_findings(frames, links).select("dataset").distinct().withColumn(
        "broken", F.lit(True))
    return names.join(F.broadcast(broken), "dataset", "left").selectExpr(
        "dataset", "CASE WHEN broken THEN 'warning' ELSE 'pass' END AS status")
