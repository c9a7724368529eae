"""Small directed graphs (curricula, dependencies) as nodes and edges: reach, levels, cycles, chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.session import cut


def ancestors(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, ancestor): everything that a node depends on. edges has node and needs; cycles end, for known pairs aren't followed again.

    Ways are doubled in each round (what a node reaches is joined to what that reaches), so ways of 2^rounds edges are
    followed; a graph that isn't done after ``rounds`` raises.
    """
    known = cut(edges.select("node", F.col("needs").alias("ancestor")).where("node IS NOT NULL AND ancestor IS NOT NULL").distinct())
    n = known.count()
    for _ in range(rounds):
        further = known.join(known.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("far")), "ancestor").select("node", F.col("far").alias("ancestor"))
        known = cut(known.unionByName(further).distinct())
        last, n = n, known.count()
        if n == last:
            return known
    raise RuntimeError(f"ways are longer than {rounds} rounds reach")


def descendants(edges: DataFrame) -> DataFrame:
    """(node, descendant): everything that depends on a node."""
    return ancestors(edges).select(F.col("ancestor").alias("node"), F.col("node").alias("descendant"))


def children(edges: DataFrame) -> DataFrame:
    """(node, child): what depends on a node at once."""
    return edges.where("needs IS NOT NULL AND node IS NOT NULL").select(F.col("needs").alias("node"), F.col("node").alias("child")).distinct()


def levels(nodes: DataFrame, edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """(node, level): the longest way from a node without needs; null for nodes on a cycle or above one (peeling). Needs that are no
    nodes don't count. A graph of more than ``rounds`` levels raises."""
    state = cut(nodes.select("node", F.lit(None).cast("int").alias("level")).distinct())
    edges = cut(edges.select("node", "needs").join(state.select(F.col("node").alias("needs")), "needs", "left_semi").distinct())
    for i in range(rounds):
        open_ = edges.join(state.where("level IS NOT NULL").select(F.col("node").alias("needs")), "needs", "left_anti").select("node").distinct()
        free = state.where("level IS NULL").join(open_, "node", "left_anti").select("node")
        if free.isEmpty():
            return state
        state = cut(state.join(free.withColumn("_free", F.lit(True)), "node", "left").select("node", F.when(F.col("_free"), i).otherwise(F.col("level")).alias("level")))
    raise RuntimeError(f"more than {rounds} levels")


def graph_issues(nodes: DataFrame, edges: DataFrame, rank: str) -> DataFrame:
    """(node, code, other): needs that are no nodes, needs of a higher rank than their node, nodes that nothing needs and that need
    nothing, and nodes on a cycle. nodes has node and rank."""
    known = nodes.select(F.col("node").alias("needs"), F.col(rank).alias("_needed"))
    x = edges.select("node", "needs").where("needs IS NOT NULL").join(known, "needs", "left").join(nodes.select("node", F.col(rank).alias("_own")), "node", "left")
    unknown = x.where("_needed IS NULL").select("node", F.lit("unknown_dependency").alias("code"), F.col("needs").alias("other"))
    forward = x.where("_needed > _own").select("node", F.lit("forward_dependency").alias("code"), F.col("needs").alias("other"))
    linked = edges.where("needs IS NOT NULL").select(F.explode(F.array("node", "needs")).alias("node")).distinct()
    none = F.lit(None).cast("string")
    orphan = nodes.select("node").join(linked, "node", "left_anti").select("node", F.lit("orphan").alias("code"), none.alias("other"))
    cycle = ancestors(edges).where("node = ancestor").select("node", F.lit("cycle").alias("code"), none.alias("other"))
    return unknown.unionByName(forward).unionByName(orphan).unionByName(cycle).distinct()


def ready(nodes: DataFrame, edges: DataFrame, started: DataFrame) -> DataFrame:
    """Nodes not yet started of which all needs are started; those without needs are ready."""
    waiting = edges.where("needs IS NOT NULL").join(started.select(F.col("node").alias("needs")), "needs", "left_anti").select("node")
    return nodes.select("node").distinct().join(started, "node", "left_anti").join(waiting, "node", "left_anti")


def ladder_gaps(df: DataFrame, by: str, grade: str) -> DataFrame:
    """Rows whose grade isn't one above the last of their ladder, with that last grade."""
    w = Window.partitionBy(by).orderBy(grade)
    return df.withColumn("before", F.lag(grade).over(w)).where(F.col("before").isNotNull() & (F.col(grade) > F.col("before") + 1))
