"""Connected components of a distributed graph by contraction.

Each round hooks every node to its least neighbour, if that is less, replaces the links' ends by it and drops links that
became loops; the graph shrinks until none is left, and the rounds' steps are composed. Node names are expected to be
hashes, as here: in a random order a round removes a constant share of the nodes of any graph, so rounds grow with the
logarithm of its size. Every round is grouped minima and joins, written into the shared folder: neither links nor
components meet in one task or on the driver, and a lost executor costs one round at most."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.shared import materialize


def _links(e: DataFrame, folder: str | None) -> DataFrame:
    high, low = F.greatest("a", "b"), F.least("a", "b")
    return materialize(e.where("a <> b").select(high.alias("a"), low.alias("b")).distinct(), "links", folder)


def components(links: DataFrame, folder: str | None = None) -> DataFrame:
    """links (a, b) -> node, root, a row for each node with links; equal roots mean one component.

    folder: where the rounds' tables go, instead of folders of their own."""
    e = _links(links, folder)
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    first = True
    while e.take(1):
        both = e.select(F.col("a").alias("node"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("node"), F.col("a").alias("v")))
        step = materialize(both.groupBy("node").agg(F.min("v").alias("v")).select("node", F.least("node", "v").alias("root")), "step", folder)
        if first:
            roots, first = step, False
        else:
            onward = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
            roots = materialize(roots.join(onward, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots", folder)
        ends = step.select(F.col("node").alias("a"), F.col("root").alias("pa")), step.select(F.col("node").alias("b"), F.col("root").alias("pb"))
        e = _links(e.join(ends[0], "a").join(ends[1], "b").select(F.col("pa").alias("a"), F.col("pb").alias("b")), folder)
    return roots
