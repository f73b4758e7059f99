"""Connected components by hooking and pointer jumping.

Every node points to a node of its component with a smaller or equal number. In a round, nodes and the
nodes they point to are hooked to the least grandparent of their neighbours, and pointers are shortened to
the grandparent. Chains halve each round, so the rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.operators.common import stored


def components(edges: DataFrame) -> tuple[DataFrame, int]:
    """node, component for the edges (a, b: numbers, in one direction each), and the number of rounds.

    A component is named by its least node. Each round is a table in the work folder, so nothing
    is computed twice and a lost executor costs one round at most.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    parents, rounds = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("parent")), "parents"), 0
    while True:
        rounds += 1
        above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        far = stored(parents.join(above, "parent"), "grandparents")
        near = both.join(far.select(F.col("node").alias("b"), "grand"), "b").groupBy(F.col("a").alias("node")).agg(F.min("grand").alias("near"))
        known = far.join(near, "node")
        offers = known.select(F.explode(F.array(
            F.struct("node", F.least("parent", "grand", "near").alias("to")), F.struct(F.col("parent").alias("node"), F.col("near").alias("to")),
        )).alias("o")).select("o.*")
        # the old pointer comes along, so that a round without a change is seen
        offers = offers.select("node", "to", F.lit(None).cast("long").alias("old")).unionByName(parents.select("node", F.col("parent").alias("to"), F.col("parent").alias("old")))
        now = stored(offers.groupBy("node").agg(F.min("to").alias("parent"), F.min("old").alias("old")), "parents")
        if now.filter("parent <> old").isEmpty():
            return now.select("node", F.col("parent").alias("component")), rounds
        parents = now.select("node", "parent")
