"""Connected components of a table of links, by contraction. Links and labels stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.frames import materialise


def components(links: DataFrame) -> DataFrame:
    """`node, root` for every node of `links` (`a, b`, both long); the root is the smallest node of the component.

    Each round every node points at its smallest neighbour or itself, pointers are followed to their ends, and links between
    the ends remain for the next round; the number of roots at least halves wherever a link is left. Every table is
    written, so a lost executor costs a read.
    """
    edges = materialise(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialise(both.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("root")))
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("from"), F.least("a", "b").alias("to"))
        pointers = _followed(materialise(step))
        moved = labels.join(pointers, F.col("root") == F.col("from"), "left").select("node", F.coalesce("to", "root").alias("root"))
        labels = materialise(moved)
        ends = edges.join(pointers.select(F.col("from").alias("a"), F.col("to").alias("x")), "a").join(pointers.select(F.col("from").alias("b"), F.col("to").alias("y")), "b")
        edges = materialise(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct())
        if edges.isEmpty():
            return labels


def _followed(pointers: DataFrame) -> DataFrame:
    """Pointers go to smaller nodes only, so doubling their length reaches the ends in a logarithmic number of rounds."""
    while True:
        further = pointers.select(F.col("from").alias("to"), F.col("to").alias("end"))
        after = materialise(pointers.join(further, "to", "left").select("from", F.coalesce("end", "to").alias("to"), (F.col("end") < F.col("to")).alias("moved")))
        if after.where("moved").isEmpty():
            return after.select("from", "to")
        pointers = after.select("from", "to")
