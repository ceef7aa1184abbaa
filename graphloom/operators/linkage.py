"""Connected components of an undirected link table, by rounds of contraction.

Every round each node adopts the neighbour with the smallest hashed priority if
that is below its own, chains are shortened by one jump, and the links are
rewritten to the adopted names.  Priorities are re-hashed each round, so a
constant share of the nodes disappears in expectation whatever the shape (long
chains and large stars included).  A hub costs one partially aggregated row per
map task and an ordinary equi-join, which adaptive execution can split.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.shared import stage

#: A remainder of so many links (16 bytes each) is finished by one task.
FINISH_AT = 200_000


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.a.tolist(), batch.b.tolist(), strict=True):
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    rows = [(x, find(x)) for x in parent]
    yield pd.DataFrame([r for r in rows if r[0] != r[1]], columns=["node", "parent"], dtype="int64")


def connected_components(links: DataFrame, a: str = "a", b: str = "b", finish_at: int = FINISH_AT) -> DataFrame:
    """``(node, component)`` for every node of a link between different nodes.

    ``links`` holds two bigint columns; direction, repeats, self-links and rows
    with a null end do not matter.  ``component`` is the smallest node id
    reachable.  Nodes without links to other nodes are absent; no links, no rows.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    cur = stage(links.where(x != y).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct(), "links")
    maps: list[DataFrame] = []
    while (n := cur.count()) > 0:
        if n <= finish_at:
            maps.append(stage(cur.repartition(1).mapInPandas(_finish, "node long, parent long"), "adopt"))
            break
        both = cur.union(cur.select("b", "a"))
        rank = lambda c, k=len(maps): F.xxhash64(F.col(c), F.lit(k))
        best = both.groupBy("a").agg(F.min(F.struct(rank("b").alias("r"), F.col("b").alias("v"))).alias("m"))
        up = stage(best.where(F.col("m.r") < rank("a")).select(F.col("a").alias("node"), F.col("m.v").alias("parent")), "adopt")
        over = up.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        up = stage(up.join(over, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent")), "adopt")
        maps.append(up)
        for end in ("a", "b"):
            to = up.select(F.col("node").alias(end), "parent")
            cur = cur.join(to, end, "left").withColumn(end, F.coalesce("parent", end)).drop("parent")
        cur = stage(cur.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    if not maps:
        return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).where("false")
    done = maps[-1]
    for up in reversed(maps[:-1]):
        later = done.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        done = up.join(later, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent")).unionByName(done.join(up, "node", "left_anti"))
    done = stage(done, "roots") if len(maps) > 1 else done
    least = done.groupBy("parent").agg(F.least(F.min("node"), F.col("parent")).alias("component"))
    return done.join(least, "parent").select("node", "component").unionByName(least.select(F.col("parent").alias("node"), "component"))
