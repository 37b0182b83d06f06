"""Colocation clusters: connected components of the tables that procedures use together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.sources.shared import discard, staged


def connected(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) of every node with an edge; a component goes by its smallest name.

    In a round each node points at its least neighbour if that is less than itself, pointers
    are followed to their roots by doubling, and edges between different roots remain. The
    roots at least halve, so the rounds grow with the logarithm of the nodes, whatever
    the diameter. Each round is written to the shared folder; only the result stays there.
    """
    kept: list[DataFrame] = []

    def step(df: DataFrame, name: str) -> DataFrame:
        kept.append(staged(df, name))
        return kept[-1]

    pairs = edges.select(F.col(left).alias("a"), F.col(right).alias("b"))
    rest, labels = step(pairs.union(pairs.select("b", "a")).distinct(), "edges"), None
    while True:
        roots, settled = step(rest.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")), "parents"), False
        while not settled:
            for _ in range(2):
                roots = roots.join(roots.select(F.col("a").alias("p"), F.col("p").alias("q")), "p").select("a", F.col("p").alias("was"), F.col("q").alias("p"))
            roots = step(roots.select("a", "p", (F.col("p") != F.col("was")).alias("moved")), "roots")
            settled, roots = roots.where("moved").isEmpty(), roots.drop("moved")
        root_of = lambda name: roots.select(F.col("a").alias(name), F.col("p").alias(f"{name}_root"))
        if labels is None:
            labels = roots.select(F.col("a").alias("node"), F.col("p").alias("component"))
        else:
            labels = labels.join(root_of("component"), "component", "left").select("node", F.coalesce("component_root", "component").alias("component"))
        ends = rest.join(root_of("a"), "a").join(root_of("b"), "b").where("a_root != b_root")
        rest = step(ends.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct(), "edges")
        if rest.isEmpty():
            out = staged(labels, "components")
            for table in kept:
                discard(table)
            return out


def numbered_clusters(uses: DataFrame, system: str, table: str) -> DataFrame:
    """(table, cluster): components numbered from 0 by the name of their most used table."""
    found = connected(uses.select(F.concat(F.lit("s:"), system).alias("s"), F.concat(F.lit("t:"), table).alias("t")), "s", "t")
    tables = found.where("node LIKE 't:%'").select(F.substring("node", 3, 1 << 20).alias("table"), "component")
    refs = uses.groupBy(F.col(table).alias("table")).agg(F.countDistinct(system).alias("refs"))
    hubs = tables.join(refs, "table").groupBy("component").agg(F.min_by("table", F.struct(-F.col("refs"), F.col("table"))).alias("hub"))
    numbers = hubs.select("component", (F.row_number().over(W.orderBy("hub")) - 1).alias("cluster"))
    return tables.join(numbers, "component").select("table", "cluster")
