"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import drop_table, table

MAX_STEPS = 60
#: Parts that a node's edges are dealt into when they meet what is known of the node.
PARTS = 16


def _meet(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges joined to rows (n, m) of their node a. Nodes are repeated for each part, so that the edges of one node are dealt over parts."""
    dealt = edges.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(PARTS)).cast("int"))
    each = nodes.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return dealt.join(each.hint("merge"), (dealt["a"] == each["n"]) & (dealt["part"] == each["part"])).select("a", "b", "m")


def components(edges: DataFrame) -> DataFrame:
    """edges: columns a, b (bigint, a <> b). Returns node, root: the smallest node of the node's component.

    Nodes without an edge are not returned; nulls are not allowed; repeated edges do not matter. Each step is a
    grouping by node with a minimum, which is combined before the shuffle, and a merge join of that minimum to the
    edges, dealt by node and part, so that a node of many edges is in many tasks; neighbourhoods are never gathered. Many steps of broadcasts would fill the driver,
    which frees them only when it collects garbage. Each step's edges are a table, removed when the next one is there.
    """
    e = table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    for _ in range(MAX_STEPS):
        # large star: larger neighbours of each node hang onto the smallest of its neighbourhood
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.col("n")).alias("m"))
        large = _meet(both, low).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: smaller neighbours and the node itself hang onto the smallest
        low2 = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        joined = _meet(large, low2)
        small = joined.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a <> b").distinct()
        new = table(small)
        drop_table(e)
        # settled: every node has one edge, and to a node that has none
        tops = new.select(F.col("b").alias("t")).distinct()
        nodes = new.select("a")
        if new.groupBy("a").agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty() and nodes.join(tops.hint("merge"), F.col("a") == F.col("t"), "left_semi").isEmpty():
            e = new
            break
        e = new
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
