"""Connected components of a link table, by contraction; nothing of the graph is held by one process."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelab.sources.scratch import save_table


def connected_components(links: DataFrame) -> DataFrame:
    """``node`` and ``label`` for every node of the undirected links ``a``, ``b`` (long); a label is one of its nodes.

    Each round every node points to the neighbour, or itself, of least random priority, and links are mapped to what
    their ends point to. Only local minima survive, so the graph shrinks by a constant factor even along a chain, and a
    star is gone after two rounds. Each round starts from a written table, so lineage stays short. Null ends are left
    out, self links are dropped; an empty table gives no rows.
    """
    every = links.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")
    loops = every.select(F.col("a").alias("node")).union(every.select(F.col("b").alias("node"))).distinct()
    loops = save_table(loops, "nodes")
    current = save_table(every.where("a <> b").distinct(), "links")
    maps = []
    while not current.isEmpty():
        both = current.union(current.select("b", "a"))
        best = both.groupBy("a").agg(F.min_by("b", F.xxhash64("b")).alias("b"))
        own = F.xxhash64("a") < F.xxhash64("b")
        parents = best.select(F.col("a").alias("node"), F.when(own, F.col("a")).otherwise(F.col("b")).alias("parent"))
        parents = save_table(parents, "parents")
        maps.append(parents)
        of = lambda end: parents.select(F.col("node").alias(end), F.col("parent").alias(f"to_{end}"))  # noqa: B023, E731
        moved = current.join(of("a"), "a").join(of("b"), "b").where("to_a <> to_b")
        ends = moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        current = save_table(ends.distinct(), "links")

    def follow(found: DataFrame, step: DataFrame) -> DataFrame:
        step = step.select(F.col("node").alias("label"), "parent")
        return found.join(step, "label", "left").select("node", F.coalesce("parent", "label").alias("label"))

    return reduce(follow, maps, loops.select("node", F.col("node").alias("label")))
