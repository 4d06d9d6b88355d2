"""Connected components of a table of links by contraction, a few narrow joins per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumisweep.llm.common import settle


def components(links: DataFrame) -> DataFrame:
    """``id, component`` (the smallest id reachable) of every id in ``links`` (``a, b``).

    Each round gives every node to its smallest neighbour, if that is smaller than itself, and
    replaces the nodes in the links; a node that is larger than a neighbour is gone after
    it, so the rounds grow with the logarithm of a component, not with its length.
    A hub's links meet in joins, which split a skewed key, and in combined minima.
    """
    edges = settle(links.where("a <> b").selectExpr("least(a, b) a", "greatest(a, b) b")
                   .distinct())
    label = None
    while edges.limit(1).count():
        both = edges.unionByName(edges.selectExpr("b a", "a b"))
        step = settle(both.groupBy("a").agg(F.min("b").alias("_low"))
                      .selectExpr("a", "least(a, _low) to"))
        if label is None:
            label = step.selectExpr("a id", "to component")
        else:
            label = (label.join(step, label["component"] == step["a"], "left")
                     .selectExpr("id", "coalesce(to, component) component"))
        label = settle(label)
        low = step.selectExpr("a", "to ta")
        high = step.selectExpr("a b", "to tb")
        edges = settle(edges.join(low, "a").join(high, "b").where("ta <> tb")
                       .selectExpr("least(ta, tb) a", "greatest(ta, tb) b").distinct())
    if label is None:
        return links.selectExpr("a id", "a component").where("id <> id")
    return label
