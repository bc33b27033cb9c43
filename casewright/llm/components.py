"""Connected components by contraction: each round merges nodes into a neighbour, until no edge is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import written


#: Rows of two numbers that a task of a round takes. Rounds run over ever fewer edges, and a table of few rows in as many
#: parts as the shuffle has costs a file, a task and its log for each.
ROWS_A_TASK = 500_000


def _cut(rows: DataFrame) -> DataFrame:
    return written(rows, "components")


def _tasks(rows: int) -> int:
    return 1 + rows // ROWS_A_TASK


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the undirected ``edges`` (``a, b`` long): equal roots, same component.

    A node goes to the neighbour that comes first in an order drawn anew each round, or stays if it comes before all
    of them. At least the neighbours of the nodes that stay vanish, so edges die out in about log n rounds, for long
    chains too. Neighbours are combined before the shuffle; no neighbourhood is gathered anywhere. Self-loops and
    repeated edges do no harm; without edges the result is empty.

    Rounds are cut by written tables: with checkpoints, what Spark infers of a column passes on, and planning takes
    five times as long from round to round. The joins are merged: a round's small table would be built into a hash
    table at the driver, and the driver would hold those of many rounds until it collects them. A round has tasks for
    the edges that are left in it, however many parts the session's shuffles have.
    """
    left = _cut(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots, turn, edges_left = None, 0, left.count()
    for_nodes = _tasks(2 * edges_left)
    while edges_left:
        few = _tasks(edges_left)
        order = lambda node: F.xxhash64(F.lit(turn), node)  # noqa: B023, E731  used within the round
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(2 * few)
        near = both.groupBy("a").agg(F.min_by("b", order(F.col("b"))).alias("_first"))
        parents = _cut(
            near.select(
                F.col("a").alias("_node"),
                F.when(order(F.col("_first")) < order(F.col("a")), F.col("_first")).otherwise(F.col("a")).alias("_to"),
            ).coalesce(_tasks(2 * edges_left))
        )
        known = parents.select(F.col("_node").alias("node"), F.col("_node").alias("root")) if roots is None else roots
        moved = known.join(parents.hint("merge"), F.col("root") == F.col("_node"), "left")
        roots = _cut(moved.select("node", F.coalesce("_to", "root").alias("root")).coalesce(for_nodes))
        ends = left.coalesce(few).join(parents.hint("merge"), F.col("a") == F.col("_node")).select(F.col("_to").alias("a"), "b")
        ends = ends.coalesce(few).join(parents.hint("merge"), F.col("b") == F.col("_node")).select("a", F.col("_to").alias("b"))
        ends = ends.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        left = _cut(ends.coalesce(few).distinct().coalesce(few))
        edges_left = left.count()
        turn += 1
    if roots is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots


def joined_components(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, root`` of the graph behind ``roots``, made by ``connected_components``, with further ``edges`` in it.

    Only the edges between components are contracted, their ends replaced by the roots of what they lie in.
    """
    few, for_nodes = _tasks(edges.count()), _tasks(roots.count())
    for end in "ab":
        known = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root")).hint("merge")
        edges = edges.join(known, F.col(end) == F.col("_node"), "left").withColumn(end, F.coalesce("_root", end)).drop("_node", "_root").coalesce(few)
    further = connected_components(edges.select("a", "b"))
    onward = further.select(F.col("node").alias("_node"), F.col("root").alias("_root")).hint("merge")
    moved = roots.join(onward, F.col("root") == F.col("_node"), "left").select("node", F.coalesce("_root", "root").alias("root"))
    new = further.join(roots.select("node").hint("merge"), "node", "left_anti")
    return _cut(moved.coalesce(for_nodes).unionByName(new.coalesce(few)))
