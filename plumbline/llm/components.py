"""Connected components by alternating large and small stars, as joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.storage import materialise


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the smallest of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    return edges.join(least.select("u", F.least("u", "least").alias("least")), "u")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, its smallest connected node, for all nodes of ``edges`` (a, b).

    Every round hangs nodes under smaller ones until each component is a star. A node of any
    degree is a map-side minimum and a join that Spark may split; each round is written to the
    shared folder, so a lost executor costs no earlier round.
    """
    links = materialise(
        edges.selectExpr("greatest(a, b) AS u", "least(a, b) AS v").where("u <> v").distinct())
    while True:
        both = links.unionByName(links.selectExpr("v AS u", "u AS v"))
        large = _with_least(both).where("v > u").selectExpr("v AS u", "least AS v")
        large = materialise(large.where("u <> v").distinct())
        small = _with_least(large)
        small = materialise(
            small.selectExpr("v AS u", "least AS v")
            .unionByName(small.selectExpr("u", "least AS v")).where("u <> v").distinct())
        # a star: every node hangs under one node that hangs under none
        open_nodes = (small.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
                      or small.join(small.select(F.col("v").alias("u")), "u", "left_semi")
                      .limit(1).count())
        links = small
        if not open_nodes:
            break
    leaves = links.selectExpr("u AS node", "v AS component")
    return leaves.unionByName(links.selectExpr("v AS node", "v AS component").distinct())
