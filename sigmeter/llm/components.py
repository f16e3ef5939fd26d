"""Connected components of an edge table, as a loop of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialise


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b); comp is the smallest node of its component.

    Each round hooks every node to its smallest neighbour, follows that pointer twice, and contracts
    the edges. A star takes one round; a chain about the logarithm of its length. What a round leaves is
    written to the shared folder, so a lost executor repeats one round at most.
    """
    left = materialise(edges.filter("a <> b").select("a", "b").distinct(), "cc-edges")
    nodes = materialise(left.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("comp", F.col("node")), "cc-nodes")
    for _ in range(rounds):
        if left.isEmpty():
            return nodes
        both = left.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        hook = both.groupBy(F.col("e.a").alias("v")).agg(F.min("e.b").alias("low")).select("v", F.least("v", "low").alias("p"))
        hook = materialise(hook, "cc-hooks")
        jump = hook.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        for _ in range(2):
            hook = hook.join(jump, "p", "left").select("v", F.coalesce("pp", "p").alias("p"))
        hook = materialise(hook, "cc-jumps")
        nodes = materialise(nodes.join(hook, nodes["comp"] == hook["v"], "left").select("node", F.coalesce("p", "comp").alias("comp")), "cc-nodes")
        at_a, at_b = (hook.select(F.col("v").alias(c), F.col("p").alias(f"p{c}")) for c in "ab")
        left = left.join(at_a, "a").join(at_b, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b")).filter("a <> b")
        left = materialise(left.distinct(), "cc-edges")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
