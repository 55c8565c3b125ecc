"""Graph operators on edge tables (owner, src, dst); an owner is one graph, nodes of different owners never meet.

Node tables keep isolated nodes.  Iterations run on the driver, one job per step, and write their state to the shared
checkpoint folder between steps; they stop when a step changes nothing.  Edges are written there once, before the first
step, so that no step computes them again.  Components and chains of single dependencies are followed by doubling, so that
their number of steps grows with the logarithm of a path's length; labels along directed edges need up to the longest
shortest path of what is left when such chains are gone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.session import cut_step


def quotient_edges(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """Edges between the groups of their ends; edges inside a group and ends without one are dropped.

    `assignment`: (owner, node, grp), one group per node.
    """
    a = assignment.select("owner", F.col("node").alias("src"), F.col("grp").alias("gs"))
    b = assignment.select("owner", F.col("node").alias("dst"), F.col("grp").alias("gd"))
    return edges.join(a, ["owner", "src"]).join(b, ["owner", "dst"]).filter("gs <> gd").select("owner", F.col("gs").alias("src"), F.col("gd").alias("dst")).distinct()


def reverse_edges(edges: DataFrame) -> DataFrame:
    return edges.select("owner", F.col("dst").alias("src"), F.col("src").alias("dst"))


def reach(edges: DataFrame, start: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(owner, node, depth): nodes reachable from `start` (owner, node) with their least distance; start has depth 0."""
    frontier = cut_step(start.select("owner", "node").distinct().withColumn("depth", F.lit(0)))
    seen, depth = frontier, 0
    step = cut_step(edges.select("owner", F.col("src").alias("node"), "dst"))
    while max_depth is None or depth < max_depth:
        depth += 1
        nxt = frontier.join(step, ["owner", "node"]).select("owner", F.col("dst").alias("node")).distinct()
        frontier = cut_step(nxt.join(seen.select("owner", "node"), ["owner", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def min_label(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(owner, node, label): the least node that reaches each node along `edges`, itself included.

    A node takes the least label of its predecessors, then the label of that label: who reaches it reaches the node too.
    The number of steps is at most that of the longest shortest path.
    """
    state = cut_step(nodes.select("owner", "node", F.col("node").alias("label")).distinct())
    step = cut_step(edges.select("owner", F.col("src").alias("node"), "dst"))
    while True:
        sent = state.join(step, ["owner", "node"]).groupBy("owner", F.col("dst").alias("node")).agg(F.min("label").alias("offer"))
        near = state.join(sent, ["owner", "node"], "left").select("owner", "node", "label", F.least("label", "offer").alias("near"))
        jump = near.select("owner", F.col("node").alias("near"), F.col("near").alias("far"))
        new = near.join(jump, ["owner", "near"], "left").select("owner", "node", F.least("near", "far").alias("new"), "label")
        new = cut_step(new.select("owner", "node", F.col("new").alias("label"), (F.col("new") < F.col("label")).alias("moved")))
        state = new.select("owner", "node", "label")
        if new.filter("moved").isEmpty():
            return state


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(owner, node, label): undirected components named by their least node.

    Labels are joined as trees: a node that sees a lesser label offers it to its own label too, so that all who bear that label
    move at once, and every label jumps to its label.
    """
    state = cut_step(nodes.select("owner", "node", F.col("node").alias("label")).distinct())
    step = cut_step(edges.select("owner", F.col("src").alias("node"), "dst").unionByName(edges.select("owner", F.col("dst").alias("node"), F.col("src").alias("dst"))).distinct())
    while True:
        sent = state.join(step, ["owner", "node"]).groupBy("owner", F.col("dst").alias("node")).agg(F.min("label").alias("offer"))
        near = state.join(sent, ["owner", "node"], "left")
        hook = near.groupBy("owner", F.col("label").alias("node")).agg(F.min("offer").alias("hook"))
        near = near.join(hook, ["owner", "node"], "left").select("owner", "node", "label", F.least("label", "offer", "hook").alias("near"))
        jump = near.select("owner", F.col("node").alias("near"), F.col("near").alias("far"))
        new = near.join(jump, ["owner", "near"], "left").select("owner", "node", F.least("near", "far").alias("new"), "label")
        new = cut_step(new.select("owner", "node", F.col("new").alias("label"), (F.col("new") < F.col("label")).alias("moved")))
        state = new.select("owner", "node", "label")
        if new.filter("moved").isEmpty():
            return state


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(owner, node, scc): strongly connected components named by their least node.

    Where the least node that reaches a node is also the least that it reaches, the node belongs to that node's component.
    The nodes of a component agree in both labels, so edges between others are dropped and the rest is labelled again.
    Nodes without an edge in or out of what is left are components of their own.
    """
    left = cut_step(nodes.select("owner", "node").distinct())
    arcs = cut_step(edges.select("owner", "src", "dst").filter("src <> dst").distinct())
    # what leads to a node without dependencies along a chain is on no cycle, however long the chain is
    inner = cut_step(arcs.select("owner", F.col("src").alias("base")).distinct())
    loose = _chains(arcs, inner).join(inner, ["owner", "base"], "left_anti").select("owner", "node")
    alone = left.join(loose, ["owner", "node"], "left_semi").select("owner", "node", F.col("node").alias("scc"))
    done = cut_step(alone)
    held = cut_step(left.join(loose, ["owner", "node"], "left_anti"))
    arcs = cut_step(arcs.join(held.select("owner", F.col("node").alias("src")), ["owner", "src"], "left_semi"))
    left = held
    while not left.isEmpty():
        both = cut_step(arcs.select("owner", F.col("src").alias("node")).intersect(arcs.select("owner", F.col("dst").alias("node"))))
        part = left.join(both, ["owner", "node"], "left_anti").select("owner", "node", F.col("node").alias("scc"))
        if not both.isEmpty():
            keep = lambda c: both.select("owner", F.col("node").alias(c))  # noqa: B023, E731
            arcs = cut_step(arcs.join(keep("src"), ["owner", "src"], "left_semi").join(keep("dst"), ["owner", "dst"], "left_semi"))
            ahead, behind = min_label(both, arcs), min_label(both, reverse_edges(arcs))
            labels = cut_step(ahead.withColumnRenamed("label", "a").join(behind.withColumnRenamed("label", "b"), ["owner", "node"]))
            part = part.unionByName(labels.filter("a = b").select("owner", "node", F.col("a").alias("scc")))
            rest = labels.filter("a <> b")
            end = lambda c: rest.select("owner", F.col("node").alias(c), F.col("a").alias(f"{c}_a"), F.col("b").alias(f"{c}_b"))  # noqa: B023, E731
            arcs = arcs.join(end("src"), ["owner", "src"]).join(end("dst"), ["owner", "dst"]).filter("src_a = dst_a AND src_b = dst_b").select("owner", "src", "dst")
            arcs = cut_step(arcs)
            left = cut_step(rest.select("owner", "node"))
        else:
            left = left.limit(0)
        part = cut_step(part)
        done = done.unionByName(part)
    return done


def _chains(arcs: DataFrame, inner: DataFrame | None = None) -> DataFrame:
    """(owner, node, base, far): the node with none or several dependencies that each node of one dependency leads to, and how
    many steps away it is.

    On a cycle there is none: with `inner` (owner, base), the nodes that have dependencies, the doubling ends when a round leads no
    further node to one without; as long as a chain goes on, every round does.
    """
    one = arcs.groupBy("owner", F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.first("dst").alias("base")).filter("n = 1")
    state = cut_step(one.select("owner", "node", "base", F.lit(1).alias("far")))
    while True:
        nxt = state.select("owner", F.col("node").alias("base"), F.col("base").alias("base2"), F.col("far").alias("far2"))
        j = state.join(nxt, ["owner", "base"], "left")
        new = j.select("owner", "node", F.coalesce("base2", "base").alias("base"), (F.col("far") + F.coalesce("far2", F.lit(0))).alias("far"), F.col("base2").isNotNull().alias("moved"))
        if inner is not None:
            new = new.join(inner.withColumn("on", F.lit(True)), ["owner", "base"], "left").withColumn("moved", F.col("moved") & F.col("on").isNull()).drop("on")
        new = cut_step(new)
        state = new.select("owner", "node", "base", "far")
        if new.filter("moved").isEmpty():
            return state


def waves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(owner, node, scc, wave): components in the order their dependencies allow; a wave is one more than the greatest
    wave among the components it depends on, 0 without any.

    Components of one dependency are one wave after it; such chains are followed first, so that a step is needed only for
    each component of several dependencies on the longest path.
    """
    scc = cut_step(strong_components(nodes, edges))
    arcs = cut_step(quotient_edges(edges, scc.select("owner", "node", F.col("scc").alias("grp"))))
    chain = _chains(arcs)
    ends = chain.select("owner", F.col("node").alias("dst"), "base", "far")
    several = arcs.join(chain.select("owner", F.col("node").alias("src")), ["owner", "src"], "left_anti")
    step = several.join(ends, ["owner", "dst"], "left").select("owner", "src", F.coalesce("base", "dst").alias("dst"), (F.coalesce("far", F.lit(0)) + 1).alias("far"))
    step = cut_step(step.groupBy("owner", "src", "dst").agg(F.max("far").alias("far")))
    every = scc.select("owner", F.col("scc").alias("node")).distinct()
    level = cut_step(every.join(chain, ["owner", "node"], "left_anti").withColumn("wave", F.lit(0)).withColumn("moved", F.lit(True)))
    while True:
        pushed = (
            step.join(level.filter("moved").select("owner", F.col("node").alias("dst"), "wave"), ["owner", "dst"])
            .groupBy("owner", F.col("src").alias("node")).agg(F.max(F.col("wave") + F.col("far")).alias("offer"))
        )
        more = F.coalesce(F.col("offer") > F.col("wave"), F.lit(False))
        level = cut_step(level.join(pushed, ["owner", "node"], "left").select("owner", "node", F.when(more, F.col("offer")).otherwise(F.col("wave")).alias("wave"), more.alias("moved")))
        if level.filter("moved").isEmpty():
            break
    based = chain.join(level.select("owner", F.col("node").alias("base"), "wave"), ["owner", "base"]).select("owner", "node", (F.col("wave") + F.col("far")).alias("wave"))
    all_ = level.select("owner", "node", "wave").unionByName(based)
    return scc.join(all_.select("owner", F.col("node").alias("scc"), "wave"), ["owner", "scc"]).select("owner", "node", "scc", "wave")
