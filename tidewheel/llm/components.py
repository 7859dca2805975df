"""Connected components of a distributed edge list, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v), both long; root is the component's smallest node.

    Contraction: each node points to its smallest neighbour if that is smaller, pointers are
    followed to their end by doubling, and edges are rewritten to where their ends point.  A component
    with edges at least halves its nodes in a round, so rounds and doublings grow with logarithms.  A node of high degree is only ever an aggregation
    key or the many side of a join on unique rows.  An empty edge list gives no rows.
    """
    edges = cut(edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    nodes = edges.select("u").union(edges.select("v")).distinct().select(F.col("u").alias("node"), F.col("u").alias("root"))
    labels = cut(nodes)
    while not edges.isEmpty():
        both = edges.union(edges.select("v", "u"))
        p = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("p"))
        p = cut(p)
        while True:  # pointers double their reach until all are at a node that points to itself
            further = p.join(p.select(F.col("u").alias("p"), F.col("p").alias("pp")), "p", "left")
            pp = cut(further.select("u", F.coalesce("pp", "p").alias("p"), (F.col("pp") != F.col("p")).alias("moved")))
            p = pp.select("u", "p")
            if pp.filter("moved").isEmpty():
                break
        pp = p
        labels = cut(
            labels.join(pp.withColumnRenamed("u", "root"), "root", "left").select("node", F.coalesce("p", "root").alias("root"))
        )
        e = edges.join(pp, "u").select(F.col("p").alias("a"), "v")
        e = e.join(pp.select(F.col("u").alias("v"), F.col("p").alias("b")), "v").select("a", "b").filter("a <> b")
        edges = cut(e.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    return labels
