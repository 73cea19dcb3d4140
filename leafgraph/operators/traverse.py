"""Walks over the graph and its statistics.

Walks advance all starts together, one join per step; the rows of a step are made
durable before the next, and only nodes not seen before are carried on.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgraph.functions.durable import cut


def _walk(starts: DataFrame, links: DataFrame, depth: int) -> DataFrame:
    """``start, node, depth``: nodes reached over ``links`` (source, target), least depth."""
    frontier = cut(
        starts.select(F.col("start"), F.col("start").alias("node"), F.lit(0).alias("depth")).distinct()
    )
    visited = frontier
    for step in range(1, depth + 1):
        reached = (
            frontier.join(links, frontier["node"] == links["source"])
            .select("start", F.col("target").alias("node"))
            .distinct()
        )
        frontier = cut(
            reached.join(visited, ["start", "node"], "left_anti").withColumn("depth", F.lit(step))
        )
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


def outgoing_graph(
    starts: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 2, cut_at: int = 200
) -> tuple[DataFrame, DataFrame]:
    """Nodes reached along edges, with shortened content, and all edges leaving them."""
    seen = _walk(starts, edges.select("source", "target"), depth)
    known = seen.join(nodes.select(F.col("id").alias("node"), "path", "content"), "node")
    short = F.when(
        F.length("content") > cut_at, F.concat(F.left("content", F.lit(cut_at)), F.lit("..."))
    ).otherwise(F.col("content"))
    found_nodes = known.withColumn("content", short)
    found_edges = known.select("start", F.col("node").alias("source")).join(
        edges.select("id", "source", "target", "type", "strength"), "source"
    )
    return found_nodes, found_edges


def both_ways(edges: DataFrame) -> DataFrame:
    forward = edges.select("source", "target")
    return forward.unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target")))


def subgraph(starts: DataFrame, edges: DataFrame, depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """Nodes within ``depth`` steps in either direction and every edge at one of them."""
    seen = _walk(starts, both_ways(edges), depth)
    ids = seen.select("start", "node")
    edge = edges.select("id", "source", "target", "type")
    out = ids.withColumnRenamed("node", "source").join(edge, "source")
    back = ids.withColumnRenamed("node", "target").join(edge, "target")
    return seen, out.unionByName(back).distinct()


def shortest_path(pairs: DataFrame, edges: DataFrame, max_depth: int = 6) -> DataFrame:
    """``start, goal, hops, path`` over edges in either direction; of equal paths the least.

    Starts whose goals are all found leave the walk.
    """
    pairs = cut(pairs.select("start", "goal").distinct())
    links = both_ways(edges).distinct()
    frontier = cut(
        pairs.select("start", F.col("start").alias("node"), F.array("start").alias("path")).distinct()
    )
    visited = frontier.select("start", "node")
    found = frontier.join(pairs, "start").filter("node = goal").select("start", "goal", "path")
    open_pairs = pairs
    for _ in range(max_depth):
        open_pairs = cut(open_pairs.join(found, ["start", "goal"], "left_anti"))
        if open_pairs.isEmpty():
            break
        active = frontier.join(open_pairs.select("start"), "start", "left_semi")
        reached = active.join(links, active["node"] == links["source"]).select(
            "start", F.col("target").alias("node"), F.concat("path", F.array("target")).alias("path")
        )
        frontier = cut(
            reached.join(visited, ["start", "node"], "left_anti").groupBy("start", "node").agg(F.min("path").alias("path"))
        )
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier.select("start", "node"))
        hits = frontier.join(open_pairs, "start").filter("node = goal").select("start", "goal", "path")
        found = found.unionByName(hits)
    return found.withColumn("hops", F.size("path") - 1)


# --- statistics -------------------------------------------------------------------------


def type_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    def counted(df, kind):
        return df.groupBy("type").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "type", "n")

    return counted(nodes, "node").unionByName(counted(edges, "edge"))


def coverage(nodes: DataFrame) -> DataFrame:
    """Shares of tagged nodes and of pages with a summary; zero for an empty graph."""
    tagged = (F.size("ontology") > 0).cast("int")
    page = F.col("type") == "page"
    summarised = F.when(page, F.col("content_summary").isNotNull().cast("int"))
    zero = F.lit(0.0)
    return nodes.agg(
        F.count("*").alias("total_nodes"),
        F.coalesce(F.avg(tagged), zero).alias("ontology_coverage"),
        F.count(F.when(page, 1)).alias("total_pages"),
        F.coalesce(F.sum(summarised), F.lit(0)).alias("summary_count"),
        F.coalesce(F.avg(summarised), zero).alias("semantic_coverage"),
    )


def successors(nodes: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """``node, next`` over precedes between nodes of a type; of several the least."""
    ids = nodes.filter(F.col("type") == kind).select("id")
    links = edges.filter(F.col("type") == "precedes").select("source", "target")
    links = links.join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
    links = links.join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return links.groupBy(F.col("source").alias("node")).agg(F.min("target").alias("next"))


def chains(nodes: DataFrame, edges: DataFrame, kind: str = "page") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chains of ``precedes``: members (head, position, node), statistics, nodes in or before a cycle.

    Pointer doubling: after k rounds a pointer spans 2^k edges, so a chain of n nodes
    takes log2(n) joins.  A pointer that still exists after more steps than there are
    nodes ran into a cycle; such nodes are reported and have no chain.
    """
    ids = nodes.filter(F.col("type") == kind).select(F.col("id").alias("node"))
    total = ids.count()
    jumps = [cut(successors(nodes, edges, kind))]
    last = math.ceil(math.log2(total + 1)) if total else 0
    while len(jumps) <= last and not jumps[-1].isEmpty():
        j = jumps[-1]
        onward = j.select(F.col("node").alias("mid"), F.col("next").alias("far"))
        doubled = j.join(onward, j["next"] == onward["mid"]).select("node", F.col("far").alias("next"))
        jumps.append(cut(doubled))
    cyclic = jumps[-1].select("node")
    step = jumps[0]
    heads = ids.join(step.select(F.col("next").alias("node")), "node", "left_anti").join(cyclic, "node", "left_anti")
    members = heads.select(F.col("node").alias("head"), F.lit(0).cast("bigint").alias("position"), "node")
    for k, j in enumerate(jumps[:-1]):
        onward = members.join(j, "node").select(
            "head", (F.col("position") + (1 << k)).alias("position"), F.col("next").alias("node")
        )
        members = cut(members.unionByName(onward))
    longest = members.agg(F.coalesce(F.max("position") + 1, F.lit(0))).scalar()
    stats = (
        ids.join(step, "node", "left")
        .agg(
            F.count("*").alias("count"),
            F.count("next").alias("traversable_count"),
            F.coalesce(F.avg(F.col("next").isNotNull().cast("int")), F.lit(0.0)).alias("traversal_share"),
        )
        .withColumn("longest_chain", longest)
    )
    return members, stats, cyclic
