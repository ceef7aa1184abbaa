"""Whole-graph analytics: PageRank, weak and strong components, communities."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.graph import KnowledgeGraph
from graphloom.operators.linkage import connected_components as _linked
from graphloom.plans.shared import drop_staged, stage

TOLERANCE = 1e-6
#: Rows that the sequential community sweep maps or gives out at a time.
LOUVAIN_BATCH = 100_000
#: Least share of vertices with one neighbour on a side for which a round of merging pays.
MERGE_SHARE = 0.1


def pagerank(graph: KnowledgeGraph, damping: float = 0.85, max_iter: int = 100) -> DataFrame:
    """``entity_id, score`` by score descending, then id.

    Weights are ignored, parallel relations count, dangling mass is spread
    evenly; stops at an L1 change below 1e-6.  Every iteration is one join on
    the source and one partially aggregated sum, and one action in which the
    change and the next dangling mass are read together.
    """
    links = graph.edges.groupBy("src", "dst").agg(F.count("*").alias("m"))
    out = links.groupBy("src").agg(F.sum("m").alias("out"))
    links = stage(links.join(out, "src").select(F.col("src").alias("id"), "dst", (F.col("m") / F.col("out")).alias("share")), "pagerank-links")
    nodes = stage(graph.vertices.join(out.select(F.col("src").alias("id"), F.lit(False).alias("dangling")), "id", "left").withColumn("dangling", F.coalesce("dangling", F.lit(True))), "pagerank-nodes")
    n = nodes.count()
    if not n:
        return nodes.select(F.col("id").alias("entity_id"), F.lit(0.0).alias("score"))
    score = nodes.withColumn("score", F.lit(1.0 / n))
    loose = nodes.where("dangling").count() / n
    for turn in range(max(0, max_iter)):
        given = score.join(links, "id").groupBy("dst").agg(F.sum(F.col("score") * F.col("share")).alias("given")).withColumnRenamed("dst", "id")
        last = score
        new = F.lit((1.0 - damping) / n) + F.lit(damping) * (F.coalesce("given", F.lit(0.0)) + F.lit(loose / n))
        score = stage(score.join(given, "id", "left").select("id", "dangling", new.alias("score"), F.col("score").alias("old")), "pagerank")
        change = score.agg(F.sum(F.abs(F.col("score") - F.col("old"))), F.sum(F.when(F.col("dangling"), F.col("score")).otherwise(0.0))).head()
        if turn:  # the table before this one is read no more
            drop_staged(graph.spark, last)
        score, loose = score.drop("old"), change[1]
        if change[0] < TOLERANCE:
            break
    return score.select(F.col("id").alias("entity_id"), "score").orderBy(F.desc("score"), "entity_id")


def _numbered(rows: DataFrame, root: str, order: list) -> DataFrame:  # noqa: ANN001
    """A dense number, from 0, for each value of ``root``.

    Numbers are ranks within ranges of the order plus the size of the ranges
    before, so that no task sorts all components.
    """
    ranged = stage(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    start = ranged.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return ranged.withColumn("_r", own).join(start, "_p").select(root, (F.col("_r") + F.col("_s")).cast("int").alias("number"))


def connected_components(graph: KnowledgeGraph) -> DataFrame:
    """``entity_id, component_id``: weak components, numbered by their smallest id."""
    linked = _linked(graph.edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))).withColumnRenamed("node", "id")
    rooted = stage(graph.vertices.join(linked, "id", "left").select("id", F.coalesce("component", "id").alias("root")), "weak")
    numbers = _numbered(rooted.select("root").distinct(), "root", ["root"])
    return rooted.join(numbers, "root").select(F.col("id").alias("entity_id"), F.col("number").alias("component_id"))


def strong_roots(graph: KnowledgeGraph) -> DataFrame:
    """``id, root``: the smallest id of each vertex's strong component.

    Vertices with one neighbour on one side are merged into it first, so that
    chains, rings and trees take rounds in proportion to the logarithm of their
    length.  Of what remains, vertices without relations in or out are trimmed
    round by round; the smallest id that reaches a vertex colours it, and what can
    get back to that id within its colour is its component.
    """
    left = stage(graph.edges.where("src != dst").select("src", "dst").distinct(), "strong")
    left, merged = _merged(left)
    done = None
    while True:
        while True:  # a vertex of a component has relations in and out
            inner = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
            n, inner = left.count(), stage(inner, "strong")
            trimmed, left = inner.count() < n, inner
            if not trimmed:
                break
        if left.isEmpty():
            break
        colour = _spread(left, left.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("colour", F.col("id")))
        c = lambda end: colour.select(F.col("id").alias(end), F.col("colour").alias(f"{end}_c"))
        same = stage(left.join(c("src"), "src").join(c("dst"), "dst").where("src_c = dst_c").select("src", "dst", F.col("src_c").alias("colour")), "strong")
        # backwards from each colour's own vertex
        found = frontier = stage(colour.where("id = colour"), "strong")
        while True:
            back = same.join(frontier.select(F.col("id").alias("dst"), "colour"), ["dst", "colour"]).select(F.col("src").alias("id"), "colour").distinct()
            frontier = stage(back.join(found, ["id", "colour"], "left_anti"), "strong")
            if frontier.isEmpty():
                break
            found = stage(found.unionByName(frontier), "strong")
        found = found.select("id", F.col("colour").alias("root"))
        done = found if done is None else done.unionByName(found)
        gone = found.select("id")
        left = stage(left.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"), "strong")
    if done is None:
        done = graph.spark.createDataFrame([], "id long, root long")
    for rows in reversed(merged):
        done = _unmerged(rows, done)
    least = done.groupBy("root").agg(F.min("id").alias("least"))
    done = done.join(least, "root").select("id", F.col("least").alias("root"))
    return graph.vertices.join(done, "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def _merged(edges: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Edges with mergeable vertices merged, and the rounds: ``id, into, other`` for :func:`_unmerged`."""
    rounds: list[DataFrame] = []
    while True:
        ends = edges.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
        degree = ends.groupBy("id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
        n, one_in, one_out = degree.agg(F.count("*"), F.count_if(F.col("i") == 1), F.count_if(F.col("o") == 1)).head()
        if max(one_in, one_out) < MERGE_SHARE * n or not n:
            return edges, rounds
        rows, smaller = _merge_round(edges, len(rounds), ("src", "dst") if one_in >= one_out else ("dst", "src"))
        drop_staged(edges.sparkSession, edges)
        rounds.append(rows)
        edges = smaller


def _merge_round(edges: DataFrame, turn: int, ends: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    """Merges a hashed half of the vertices with a single neighbour at their ``near`` side into those neighbours.

    A vertex is merged only into one of the other half, so no neighbour is merged
    in the same round.  Its edges of the other side go to the neighbour, which
    reaches their ends already through the vertex, so other components stay as
    they are.
    """
    near, far = ends
    coin = lambda c: F.pmod(F.xxhash64(c, F.lit(turn)), F.lit(2))
    single = edges.groupBy(F.col(far).alias("id")).agg(F.count("*").alias("n"), F.min(near).alias("into")).where("n = 1")
    chosen = stage(single.where((coin("id") == 1) & (coin("into") == 0)).select("id", "into"), "strong")
    kept = edges.join(chosen.select(F.col("id").alias(far)), far, "left_anti")
    moved = stage(kept.join(chosen.withColumnRenamed("id", near), near, "left").select(near, far, "into"), "strong")
    rows = moved.where("into IS NOT NULL").select(F.col(near).alias("id"), "into", F.col(far).alias("other"))
    smaller = moved.select(F.coalesce("into", near).alias(near), far).where("src != dst").distinct()
    return rows, stage(smaller.select("src", "dst"), "strong")


def _unmerged(rows: DataFrame, done: DataFrame) -> DataFrame:
    """Components with a round's vertices: one is in its neighbour's if that reaches, or is reached from, an end of its other edges."""
    of = lambda c: done.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root"))
    both = rows.join(of("into"), "into", "left").join(of("other"), "other", "left")
    root = F.coalesce("into_root", "into")
    back = both.where(root == F.coalesce("other_root", "other")).select(F.explode(F.array("id", "into")).alias("id"), root.alias("root"))
    return stage(done.unionByName(back).distinct(), "strong")


def _spread(edges: DataFrame, colour: DataFrame) -> DataFrame:
    """The smallest colour that reaches each vertex."""
    colour = stage(colour, "colour")
    while True:
        got = edges.join(colour.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("got"))
        new = stage(colour.join(got, "id", "left").select("id", F.least("colour", "got").alias("colour"), (F.col("got") < F.col("colour")).alias("changed")), "colour")
        if new.where("changed").isEmpty():
            return new.select("id", "colour")
        colour = new.select("id", "colour")


def strongly_connected_components(graph: KnowledgeGraph) -> DataFrame:
    """``entity_id, scc_id``: numbered by size descending, then by smallest id."""
    rooted = stage(strong_roots(graph), "strong")
    sizes = rooted.groupBy("root").agg(F.count("*").alias("n"))
    numbers = _numbered(sizes, "root", [F.desc("n"), "root"])
    return rooted.join(numbers, "root").select(F.col("id").alias("entity_id"), F.col("number").alias("scc_id"))


def edge_modularity(graph: KnowledgeGraph, communities: DataFrame) -> DataFrame:
    """One row ``modularity``: over relations inside a community, of (w - k_i k_j / 2m) / m; 0 without weight.

    ``communities`` holds ``entity_id, community_id``.  Only existing relations
    are summed, so this is not Newman's modularity.
    """
    e = graph.edges
    m = e.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("m"))
    degree = e.select("src", "weight").unionByName(e.select(F.col("dst").alias("src"), "weight")).groupBy("src").agg(F.sum("weight").alias("k"))
    node = degree.join(communities.select(F.col("entity_id").alias("src"), F.col("community_id").alias("c")), "src")
    there = node.select(F.col("src").alias("dst"), F.col("k").alias("kd"), F.col("c").alias("cd"))
    inside = e.join(node, "src").join(there, "dst").where(F.col("c") == F.col("cd"))
    sums = inside.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("w"), F.coalesce(F.sum(F.col("k") * F.col("kd")), F.lit(0.0)).alias("kk"))
    value = F.when(F.col("m") == 0, 0.0).otherwise((F.col("w") - F.try_divide(F.col("kk"), 2 * F.col("m"))) / F.expr("nullif(m, 0)"))
    return sums.join(m).select(value.alias("modularity"))


def louvain(graph: KnowledgeGraph, mode: str = "exact", standard_gain: bool = False, sweeps: int = 100) -> DataFrame:
    """``entity_id, community_id, modularity`` of one level of greedy moves; isolated entities are left out.

    ``exact`` visits vertices by ascending id and candidates by ascending
    community and applies moves at once, in one task.  Its links (16 bytes each)
    and its vertices' state (48 bytes each) are files of that task's temporary
    folder, so any number of links that fits its disk will do; a sweep reads them
    in order.  ``distributed`` moves all vertices of a hashed
    half of the graph at a time and is another algorithm with the same gain.
    ``standard_gain`` accepts by the change of modularity instead.
    """
    e = graph.edges
    links = stage(e.select("src", "dst", "weight").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("w")), "louvain")
    if links.isEmpty():
        return graph.spark.createDataFrame([], "entity_id long, community_id int, modularity double")
    m = e.agg(F.sum("weight")).head()[0]
    if mode == "distributed":
        label = _label_moves(links, m, sweeps)
    else:
        label = links.coalesce(1).sortWithinPartitions("src", "dst").mapInArrow(_sweep(m, sweeps, standard_gain), "entity_id long, community_id int")
    label = stage(label, "louvain")
    return label.join(F.broadcast(edge_modularity(graph, label)))  # one row


def _on_disk(kind: type, rows: np.ndarray | int) -> np.ndarray:
    """An array in an unnamed temporary file, zeros or a copy of ``rows``."""
    n = rows if isinstance(rows, int) else len(rows)
    with tempfile.TemporaryFile() as file:
        out = np.asarray(np.memmap(file, kind, "w+", shape=max(n, 1)))[:n]
    if not isinstance(rows, int):
        out[:] = rows
    return out


def _stored_links(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From links sorted by source: vertices, where each one's links begin (and the end), their ends as places among the vertices, weights."""
    with tempfile.TemporaryFile() as ends, tempfile.TemporaryFile() as weights, tempfile.TemporaryFile() as nodes, tempfile.TemporaryFile() as starts:
        n, last = 0, None
        for b in batches:
            src = b.column("src").to_numpy()
            if not len(src):
                continue
            new = np.concatenate([[last is None or src[0] != last], src[1:] != src[:-1]])
            nodes.write(src[new].astype(np.int64).tobytes())
            starts.write((n + np.flatnonzero(new)).astype(np.int64).tobytes())
            ends.write(b.column("dst").to_numpy().astype(np.int64).tobytes())
            weights.write(b.column("w").to_numpy().astype(np.float64).tobytes())
            n, last = n + len(src), src[-1]
        starts.write(np.int64(n).tobytes())
        for file in (ends, weights, nodes, starts):
            file.flush()
        near, weight, ids, first = (np.asarray(np.memmap(file, kind, "r+")) if n else np.zeros(0, kind) for file, kind in ((ends, np.int64), (weights, np.float64), (nodes, np.int64), (starts, np.int64)))
    for at in range(0, n, LOUVAIN_BATCH):  # every end is a source too
        near[at : at + LOUVAIN_BATCH] = np.searchsorted(ids, near[at : at + LOUVAIN_BATCH])
    return ids, first, near, weight


def _sweep(m: float, sweeps: int, standard: bool):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, first, near, weights = _stored_links(batches)
        n = len(ids)
        own = _on_disk(np.int64, n)
        for at in range(0, n, LOUVAIN_BATCH):
            own[at : at + LOUVAIN_BATCH] = np.arange(at, min(at + LOUVAIN_BATCH, n))
        degree = _on_disk(np.float64, n)
        for v in range(n):
            degree[v] = sum(weights[first[v] : first[v + 1]].tolist())
        # views whose items are plain numbers
        start, of, size, total = memoryview(first), memoryview(own), memoryview(degree), memoryview(_on_disk(np.float64, degree))
        for _ in range(sweeps if m else 0):
            moved = False
            for v in range(n):
                k, c, here = size[v], of[v], slice(start[v], start[v + 1])
                weight: dict[int, float] = {}
                for u, w in zip(own[near[here]].tolist(), weights[here].tolist(), strict=True):
                    weight[u] = weight.get(u, 0.0) + w
                leave = -weight.get(c, 0.0) / m + (total[c] - k) * k / (2 * m * m)
                best, to = (0.0 if standard else leave), c
                for other in sorted(weight):
                    if other != c:
                        join = weight[other] / m - total[other] * k / (2 * m * m)
                        gain = join + leave if standard else join - leave
                        if gain > best:
                            best, to = gain, other
                if to != c:
                    total[c] -= k
                    total[to] += k
                    of[v], moved = to, True
            if not moved:
                break
        # numbers in the order of each community's first vertex, one above them in `name`
        name, used = _on_disk(np.int64, n), 0
        for at in range(0, n, LOUVAIN_BATCH):
            mine = own[at : at + LOUVAIN_BATCH]
            fresh, seen = np.unique(mine, return_index=True)
            fresh = fresh[np.argsort(seen)]
            fresh = fresh[name[fresh] == 0]
            name[fresh] = np.arange(used + 1, used + 1 + len(fresh))
            used += len(fresh)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + LOUVAIN_BATCH]), pa.array((name[mine] - 1).astype(np.int32))], ["entity_id", "community_id"])

    return run


def _label_moves(links: DataFrame, m: float, sweeps: int) -> DataFrame:
    degree = links.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k"))
    label = stage(degree.select("id", F.col("id").alias("c"), "k"), "louvain")
    for turn in range(2 * sweeps if m else 0):
        total = label.groupBy("c").agg(F.sum("k").alias("total"))
        of = label.select(F.col("id").alias("dst"), "c")
        weight = links.where("src != dst").join(of, "dst").groupBy(F.col("src").alias("id"), "c").agg(F.sum("w").alias("w"))
        gain = F.col("w") / m - (F.col("total") - F.when(F.col("c") == F.col("mine"), F.col("k")).otherwise(0.0)) * F.col("k") / (2 * m * m)
        every = weight.join(total, "c").join(label.select("id", F.col("c").alias("mine"), "k"), "id").withColumn("gain", gain)
        best = every.groupBy("id").agg(F.max(F.struct("gain", (-F.col("c")).alias("c"))).alias("b"), F.max(F.when(F.col("c") == F.col("mine"), F.col("gain"))).alias("stay"))
        turn_of = F.pmod(F.xxhash64("id", F.lit(turn // 2)), F.lit(2)) == turn % 2
        move = best.where(turn_of & (F.col("b.gain") > F.coalesce("stay", F.lit(0.0)))).select("id", (-F.col("b.c")).alias("to"))
        new = stage(label.join(move, "id", "left").select("id", F.coalesce("to", "c").alias("c"), "k", F.coalesce(F.col("to") != F.col("c"), F.lit(False)).alias("moved")), "louvain")
        still, last, label = new.where("moved").isEmpty(), label, new.drop("moved")
        drop_staged(links.sparkSession, last)
        if still and turn % 2:
            break
    first = label.groupBy("c").agg(F.min("id").alias("root"))
    return label.join(first, "c").join(_numbered(first.select("root"), "root", ["root"]), "root").select(F.col("id").alias("entity_id"), F.col("number").alias("community_id"))
