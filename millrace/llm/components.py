"""Connected components by contraction: every node takes the smallest of itself and its neighbours, edges move to what their ends took.

Ids are first sent through a bijection of 64-bit numbers, so that "smallest" is random with respect to the shape of a component; a star ends in
two rounds, a chain in about the logarithm of its length. Only a minimum for each node is shuffled, combined before it travels, so a hub costs
no more than another node. Each round's smaller table is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.storage import materialize


def _scatter(x: Column) -> Column:
    """A bijection of 64-bit numbers by shifts and exclusive or, so nothing can overflow."""
    for left, right in ((13, 7), (17, 9)):
        x = x.bitwiseXOR(F.shiftleft(x, left))
        x = x.bitwiseXOR(F.shiftrightunsigned(x, right))
    return x


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that occurs in edges (two columns of 64-bit ids); root is the component's member of smallest scattered id."""
    spread = edges.select(_scatter(F.col(a)).alias("x"), _scatter(F.col(b)).alias("y"), F.col(a).alias("a"), F.col(b).alias("b"))
    names = spread.select(F.explode(F.array(F.struct(F.col("x").alias("p"), F.col("a").alias("node")), F.struct(F.col("y").alias("p"), F.col("b").alias("node")))).alias("n")).select("n.*").distinct()
    names = materialize(names)
    live = materialize(spread.select("x", "y").filter("x <> y").distinct())
    steps = []
    while not live.isEmpty():
        both = live.select(F.explode(F.array(F.struct("x", F.col("y").alias("o")), F.struct(F.col("y").alias("x"), F.col("x").alias("o")))).alias("e")).select("e.*")
        step = materialize(both.groupBy("x").agg(F.min("o").alias("o")).select("x", F.least("x", "o").alias("m")))
        steps.append(step)
        moved = live.join(step.select("x", F.col("m").alias("mx")), "x").join(step.select(F.col("x").alias("y"), F.col("m").alias("my")), "y")
        live = materialize(moved.select(F.least("mx", "my").alias("x"), F.greatest("mx", "my").alias("y")).filter("x <> y").distinct())
    root = None
    for step in reversed(steps):
        if root is None:
            root = step.select("x", F.col("m").alias("root"))
        else:
            root = materialize(step.join(root.select(F.col("x").alias("m"), "root"), "m", "left").select("x", F.coalesce("root", "m").alias("root")))
    if root is None:
        return names.select("node", F.col("node").alias("root"))
    rooted = names.join(root.select(F.col("x").alias("p"), "root"), "p", "left").select("node", F.coalesce("root", "p").alias("p"))
    return rooted.join(names.select("p", F.col("node").alias("root")), "p").select("node", "root")
