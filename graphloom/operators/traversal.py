"""Hop-bounded traversal by frontier joins.

A frontier row carries ``key``, the relation numbers along its path.  Keys of a
level have one length and compare lexicographically, so the smallest key per
node is the first in queue order, then relation order: the parent that a
sequential queue would choose, without a global sort.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import KnowledgeGraph
from graphloom.plans.shared import stage

#: Relations that the sequential depth-first walk may hold in one task.
DFS_EDGES = 2_000_000
_NODE = "entity_id long, depth int, parent_id long, rel_type string, weight double"


def _levels(graph: KnowledgeGraph, seeds: DataFrame, max_depth: int, until: Column | None = None) -> DataFrame:
    """Rows ``seed, node, depth, parent, rel_type, weight, cost, key, path`` of the search trees of all seeds."""
    start = seeds.select(F.col("seed"), F.col("seed").alias("node"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent"), F.lit(None).cast("string").alias("rel_type"), F.lit(0.0).alias("weight"), F.lit(0.0).alias("cost"), F.array().cast("array<long>").alias("key"))
    start = start.withColumn("path", F.array(F.struct(F.col("node").alias("entity_id"), F.lit("").alias("rel_type"), F.lit(0.0).alias("weight")))) if until is not None else start
    seen = frontier = stage(start, "level")
    for depth in range(1, max(0, max_depth) + 1):
        if until is not None and not frontier.where(until).isEmpty():
            break
        e = graph.edges.withColumnRenamed("src", "node")
        step = frontier.select("seed", "node", "key", F.col("cost").alias("so_far"), *(["path"] if until is not None else [])).join(e, "node")
        cost = F.col("so_far") + F.col("weight")
        row = F.struct(F.concat("key", F.array("seq")).alias("key"), F.col("node").alias("parent"), "rel_type", "weight", cost.alias("cost"), *([F.concat("path", F.array(F.struct(F.col("dst").alias("entity_id"), "rel_type", "weight"))).alias("path")] if until is not None else []))
        best = step.groupBy("seed", F.col("dst").alias("at")).agg(F.min(row).alias("r"))
        new = best.select("seed", F.col("at").alias("node"), F.lit(depth).alias("depth"), "r.*").join(seen.select("seed", "node"), ["seed", "node"], "left_anti")
        frontier = stage(new.select(*seen.columns), "level")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def _one(graph: KnowledgeGraph, start_id: int) -> DataFrame:
    return graph.spark.range(1).select(F.lit(start_id).cast("long").alias("seed"))


def bfs(graph: KnowledgeGraph, start_id: int, max_depth: int) -> DataFrame:
    """Directed search: ``entity_id, depth, parent_id, rel_type, weight``, in queue order.

    No relations at all: no rows.  Otherwise the start row is there even for an
    unknown id, and alone for ``max_depth <= 0``.
    """
    seeds = _one(graph, start_id)
    if graph.edges.isEmpty():
        seeds = seeds.where("false")
    out = _levels(graph, seeds, max_depth).orderBy("depth", "key")
    return out.select(F.col("node").alias("entity_id"), "depth", F.col("parent").alias("parent_id"), "rel_type", "weight")


def reach(graph: KnowledgeGraph, seeds: DataFrame, max_depth: int) -> DataFrame:
    """``seed, n``: nodes that each seed's search emits, itself included; one search for all seeds."""
    if graph.edges.isEmpty():
        return seeds.select("seed", F.lit(0).cast("long").alias("n"))
    return _levels(graph, seeds, max_depth).groupBy("seed").agg(F.count("*").alias("n"))


def shortest_path(graph: KnowledgeGraph, from_id: int, to_id: int, max_depth: int) -> DataFrame:
    """One row ``found, from_id, to_id, total_cost, hops, path``: fewest hops, not least cost."""
    hit = F.col("node") == F.lit(to_id).cast("long")
    tree = _levels(graph, _one(graph, from_id), max_depth, hit).where(hit)
    base = graph.spark.range(1).select(F.lit(from_id).cast("long").alias("from_id"), F.lit(to_id).cast("long").alias("to_id"))
    row = base.join(tree.select("cost", "depth", "path", F.lit(True).alias("hit")), how="left")
    empty = F.array().cast("array<struct<entity_id:bigint,rel_type:string,weight:double>>")
    return row.select(F.coalesce("hit", F.lit(False)).alias("found"), "from_id", "to_id", F.coalesce("cost", F.lit(0.0)).alias("total_cost"), F.coalesce("depth", F.lit(0)).alias("hops"), F.coalesce("path", empty).alias("path"))


def dfs(graph: KnowledgeGraph, start_id: int, max_depth: int, max_edges: int = DFS_EDGES) -> DataFrame:
    """Depth-first preorder with one visited set, so a node met at the depth limit is never expanded.

    The order is inherently sequential: the relations that the walk can use are
    found by joins, and one task walks them.  More than ``max_edges`` is an error.
    """
    if graph.edges.isEmpty():
        return graph.spark.createDataFrame([], _NODE)
    inner = _levels(graph, _one(graph, start_id), max_depth - 1).select(F.col("node").alias("src")) if max_depth > 0 else None
    near = stage(graph.edges.join(inner, "src", "left_semi") if inner is not None else graph.edges.where("false"), "walk")
    if near.count() > max_edges:
        raise ValueError(f"the walk needs more than {max_edges} relations in one task")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        following: dict[int, list[tuple[int, float, str]]] = {}
        frames = [b for b in batches if len(b)]
        if frames:
            for r in pd.concat(frames).sort_values("seq").itertuples():
                following.setdefault(r.src, []).append((r.dst, r.weight, r.rel_type))
        stack, visited, rows = [(start_id, 0, None, None, 0.0)], set(), []
        while stack:
            node, depth, parent, rel, weight = stack.pop()
            if node in visited:
                continue
            visited.add(node)
            rows.append((node, depth, parent, rel, weight))
            if depth < max_depth:
                stack.extend((d, depth + 1, node, t, w) for d, w, t in reversed(following.get(node, [])) if d not in visited)
        out = pd.DataFrame(rows, columns=["entity_id", "depth", "parent_id", "rel_type", "weight"])
        yield out.astype({"parent_id": "Int64"})

    one = near.select("seq", "src", "dst", "weight", "rel_type")
    return one.unionByName(graph.spark.range(0).select(*(F.lit(None).cast(t).alias(c) for c, t in one.dtypes))).coalesce(1).mapInPandas(walk, _NODE)


def context(graph: KnowledgeGraph, entity_id: int, depth: int = 2) -> DataFrame:
    """One row ``center_entity_id, depth, context_nodes, total_nodes``: the search tree as one document."""
    seeds = _one(graph, entity_id)
    nodes = _levels(graph, seeds.where("false") if graph.edges.isEmpty() else seeds, depth)
    # in queue order
    listed = F.sort_array(F.collect_list(F.struct("depth", "key", "node", "parent", "rel_type", "weight")))
    ordered = F.transform(listed, lambda n: F.struct(n["node"].alias("entity_id"), n["depth"].alias("depth"), n["parent"].alias("parent_id"), n["rel_type"].alias("rel_type"), n["weight"].alias("weight")))
    return nodes.agg(ordered.alias("context_nodes"), F.count("*").alias("total_nodes")).select(F.lit(entity_id).cast("long").alias("center_entity_id"), F.lit(depth).alias("depth"), "context_nodes", "total_nodes")
