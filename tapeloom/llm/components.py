"""Connected components of a link table by hooking and pointer jumping, a written table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.plans.stage import written


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``; both ids are evenly spread integers.

    In each round every node points to its smallest neighbour, pointers are followed once more,
    and the links are redrawn between the nodes pointed to. Ids that are hashes make the paths
    of pointers short, whatever the shape of a component. Links only shrink; nothing is collected.
    """
    links = written(links.filter("a <> b").distinct(), "links")
    found = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.least("a", F.min("b")).alias("to"))
        then = near.select(F.col("a").alias("to"), F.col("to").alias("__then"))
        hooks = written(near.join(then, "to").select("a", F.col("__then").alias("to")), "hooks")
        if found is None:
            found = hooks.select(F.col("a").alias("node"), F.col("to").alias("root"))
        else:
            moved = found.join(hooks, found["root"] == hooks["a"], "left")
            found = written(moved.select("node", F.coalesce("to", "root").alias("root")), "roots")
        at_a = hooks.select("a", F.col("to").alias("__a"))
        at_b = hooks.select(F.col("a").alias("b"), F.col("to").alias("__b"))
        redrawn = links.join(at_a, "a").join(at_b, "b").filter("__a <> __b")
        links = written(redrawn.select(F.col("__a").alias("a"), F.col("__b").alias("b")).distinct(), "links")
    if found is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found
