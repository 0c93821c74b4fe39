"""Reachability as DataFrame rounds: closures by frontiers, strongly connected parts by colours.

Rounds work on tables in the shared folder, so plans stay short, a lost executor costs a read, and neither the number of
rows nor of rounds has a limit. No row carries a path.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio_spark.session import spooled

#: Tables of one set that are read together before they are written as one.
TABLES = 16


def _ends(edges: DataFrame) -> DataFrame:
    """edges (u, v) without those whose start nothing leads to or whose end leads nowhere, again and again: they are on no cycle."""
    n = edges.count()
    while n:
        kept = edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
        edges = spooled(kept.join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u", "v"), "core")
        n, before = edges.count(), n
        if n == before:
            break
    return edges


def strong_parts(edges: DataFrame) -> DataFrame:
    """node, part: the strongly connected part of each node of edges (u, v) that is on a cycle of two nodes and more.

    A node's colour is the greatest node that leads to it. From a node of its own colour, walking back inside the colour
    gives its part; parts are taken out and the rest is coloured again.
    """
    core = _ends(spooled(edges.where("u <> v").select("u", "v").distinct(), "core"))
    found: list[DataFrame] = []
    while core.limit(1).count():
        nodes = core.select(F.col("u").alias("node")).union(core.select("v")).distinct()
        colours, changed = spooled(nodes.withColumn("colour", F.col("node")), "colours"), 1
        while changed:
            told = core.join(colours, F.col("u") == F.col("node")).groupBy(F.col("v").alias("node")).agg(F.max("colour").alias("told"))
            new = colours.join(told, "node", "left").select("node", F.greatest("colour", F.coalesce("told", "colour")).alias("colour"), (F.col("told") > F.col("colour")).alias("new"))
            new = spooled(new, "colours")
            changed, colours = new.where("new").limit(1).count(), new.drop("new")
        # edges inside a colour, walked back from its greatest node
        inside = core.join(colours.select(F.col("node").alias("u"), F.col("colour").alias("cu")), "u").join(colours.select(F.col("node").alias("v"), F.col("colour").alias("cv")), "v")
        inside = spooled(inside.where("cu = cv").select("u", "v", F.col("cu").alias("part")), "inside")
        front = spooled(colours.where("node = colour").select("node", F.col("colour").alias("part")), "part")
        part = [front]
        while front.limit(1).count():
            back = inside.join(front.select(F.col("node").alias("v")), "v").select(F.col("u").alias("node"), "part").distinct()
            front = spooled(back.join(reduce(DataFrame.union, part), ["node"], "left_anti"), "part")
            part = [spooled(reduce(DataFrame.union, part), "part")] if len(part) >= TABLES else part
            part.append(front)
        members = spooled(reduce(DataFrame.union, part), "parts")
        found.append(members)
        gone = members.select("node")
        core = core.join(gone.withColumnRenamed("node", "u"), "u", "left_anti").join(gone.withColumnRenamed("node", "v"), "v", "left_anti").select("u", "v")
        core = _ends(spooled(core, "core"))
    if not found:
        return edges.limit(0).select(F.col("u").alias("node"), F.col("v").alias("part"))
    return reduce(DataFrame.union, found)


def closure(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """Root, node, depth, issue: what each root (node of roots) leads to over edges (node, parent), each once, at its least depth.

    A parent that is no node of edges is `unknown_parent`. A node that is met again is left out, but for one that is met
    over an edge that lies on a cycle: that is a `cycle`, at the least depth where it was met so. Roots that are no nodes
    have no rows. Rounds are semi-naive: each goes on from the pairs of (root, node) that the last one added.
    """
    known = spooled(edges.select("node").where("node is not null").distinct(), "known")
    steps = spooled(edges.where("node is not null and parent is not null").select("node", "parent").distinct(), "steps")
    start = roots.select("node").distinct().join(known, "node", "left_semi")
    front = spooled(start.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("issue")), "front")
    found, met, depth = [front], [], 0
    while front.limit(1).count():
        depth += 1
        walked = front.where("issue is null").select("root", F.col("node").alias("via")).join(steps.select(F.col("node").alias("via"), F.col("parent").alias("node")), "via")
        walked = spooled(walked.select("root", "via", "node"), "walked")
        seen = reduce(DataFrame.union, found).select("root", "node")
        again = walked.join(seen, ["root", "node"], "left_semi").select("root", "via", "node", F.lit(depth).alias("depth"))
        met.append(spooled(again, "met"))
        fresh = walked.select("root", "node").distinct().join(seen, ["root", "node"], "left_anti")
        there = known.select(F.col("node").alias("__known"))
        issue = F.when(F.col("__known").isNull(), "unknown_parent")
        front = fresh.join(there, F.col("node") == F.col("__known"), "left").select("root", "node", F.lit(depth).alias("depth"), issue.alias("issue"))
        front = spooled(front, "front")
        if len(found) >= TABLES:
            found, met = [spooled(reduce(DataFrame.union, found), "found")], [spooled(reduce(DataFrame.union, met), "met")]
        found.append(front)
    out = reduce(DataFrame.union, found)
    again = reduce(DataFrame.union, met).where("node is not null") if met else None
    if again is None or not again.limit(1).count():
        return out
    parts = spooled(strong_parts(steps.select(F.col("node").alias("u"), F.col("parent").alias("v"))), "parts")
    own = again.where("via = node").select("root", "node", "depth")
    both = again.join(parts.select(F.col("node").alias("via"), F.col("part").alias("p")), "via").join(parts, "node").where("p = part").select("root", "node", "depth")
    cycles = own.union(both).groupBy("root", "node").agg(F.min("depth").alias("depth")).withColumn("issue", F.lit("cycle"))
    return out.union(cycles)
