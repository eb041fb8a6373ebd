"""Connected components by randomised contraction, with written tables between rounds.

In each round every node chooses the first of itself and its neighbours in an order by hash; all nodes that chose the same
one become one node, and only links between different ones stay. The order changes every second round. Whatever the graph
and its numbering, a new order leaves at most about three quarters of the nodes that still have links, so the number of
rounds follows the logarithm of the number of nodes. (The second round with the same order takes a star of any size
together: in the first its centre has joined the first of all its leaves.)

Choices are minima, which combine before the shuffle. A node or a component that holds many rows is a hot key of the joins;
``join_hot`` deals with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterank.llm.common import join_hot, stage


def contractions(links: DataFrame) -> list[DataFrame]:
    """The rounds: (node, chosen, times) of all nodes that still had links; ``times`` are a node's links."""
    edges = stage(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        place = lambda node: F.struct(F.xxhash64(node, F.lit(len(rounds) // 2)), F.col(node))  # noqa: E731, B023
        near = edges.groupBy("a").agg(F.min(place("b")).alias("near"), F.count(F.lit(1)).alias("times"))
        chosen = F.when(place("a") < F.col("near"), F.col("a")).otherwise(F.col("near.b")).alias("chosen")
        chosen = stage(near.select(F.col("a").alias("node"), chosen, "times"), "chosen")
        rounds.append(chosen)
        for end in ("a", "b"):  # every link is there in both directions, so a node is as frequent at both ends
            edges = join_hot(edges, chosen.withColumnRenamed("node", end), end).drop(end).withColumnRenamed("chosen", f"new_{end}")
        edges = edges.select(F.col("new_a").alias("a"), F.col("new_b").alias("b"))
        edges = stage(edges.where("a <> b").distinct(), "links")
    return rounds


def _followed(chosen: DataFrame, onward: DataFrame) -> DataFrame:
    """(node, chosen) with each choice replaced by what ``onward`` (node, chosen) says of it, where it says something."""
    times = chosen.groupBy("chosen").agg(F.count(F.lit(1)).alias("times"))
    last = times.join(onward.select(F.col("node").alias("chosen"), F.col("chosen").alias("last")), "chosen", "left")
    last = stage(last.select("chosen", F.coalesce("last", "chosen").alias("last"), "times"), "chosen")
    return stage(join_hot(chosen.select("node", "chosen"), last, "chosen").select("node", F.col("last").alias("chosen")), "chosen")


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of ``links`` (a, b: long): the label is the smallest node that it reaches."""
    rounds = contractions(links)
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("label")).where("false")
    found = rounds[-1].select("node", "chosen")
    for chosen in reversed(rounds[:-1]):
        found = _followed(chosen, found)
    smallest = found.groupBy("chosen").agg(F.min("node").alias("label"), F.count(F.lit(1)).alias("times"))
    return stage(join_hot(found, stage(smallest, "labels"), "chosen").select("node", "label"), "labels")
