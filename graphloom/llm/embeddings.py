"""Embedding near-duplicates by an exact metric range join.

On unit vectors, cosine >= c is Euclidean distance <= eps = sqrt(2 - 2c).  A
bounded sample of vectors are the pivots; every vector's home is the cell of its
nearest pivot in its label.  By the triangle inequality a vector at distance d
of pivot p (and d' of its own) can lie within eps of a member of p's cell only if
``d - d' <= 2 eps``, and, as p's plane to its own pivot must be within reach,
``(d^2 - d'^2) <= 2 eps |p p'|``; it is replicated to exactly those cells.  Cells
join independently: a home member is compared with every vector of its cell, and
so its links are counted once and completely.  Of a full cell, each task holds
``HOME`` members and streams the others past them.

Equal vectors are one class with a weight, and only spanning links leave a cell.
The cosine is taken in double precision.  Rows with a null label, and vectors
that are null, zero, or hold null or non-finite components, link with nothing;
vectors of different lengths do not link.  Every row is a vector of its own
(repeated rows link with each other); an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.linkage import connected_components
from graphloom.plans.shared import stage

COSINE = 0.93
#: Members of a cell that one task holds, most pivots (documented bound of the sample), and vectors streamed at once.
HOME, PIVOTS, AT_ONCE = 2048, 256, 1024


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as doubles."""
    return np.array(column.to_pylist(), np.float64) if len(column) else np.zeros((0, 0))


def _assign(pivots: dict[int, np.ndarray], eps: float):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = np.array([len(v) for v in b.column(2).to_pylist()])
            for n in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == n)
                part = b.take(pa.array(rows))
                x = _unit(_matrix(part.column(2)))
                p = pivots.get(n)
                if p is None:
                    at, cell = np.arange(len(x)), np.zeros(len(x), np.int64)
                    home = np.ones(len(x), bool)
                else:
                    d2 = np.maximum(2 - 2 * x @ p.T, 0)
                    mine = d2.argmin(axis=1)
                    d, own = np.sqrt(d2), np.sqrt(d2[np.arange(len(x)), mine])
                    apart = np.sqrt(np.maximum(2 - 2 * p @ p.T, 0))[mine]
                    slack = 1e-9
                    reach = (d - own[:, None] <= 2 * eps + slack) & (d2 - (own**2)[:, None] <= 2 * eps * apart + slack)
                    reach[np.arange(len(x)), mine] = True
                    at, cell = np.nonzero(reach)
                    home = mine[at] == cell
                taken = part.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array(cell.astype(np.int64) * 65_536 + n), pa.array(home), taken.column(3), taken.column(2)], names=["id", "label", "cell", "home", "weight", "v"])

    return run


def _join(cosine: float):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by task key, home members first. Out: ``(a, n, null)`` counts and ``(a, null, b)`` links."""
        key, ids, held, count, parent = None, [], [], None, None
        matrix = None

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        def close() -> Iterator[pa.RecordBatch]:
            if matrix is not None:
                a = np.concatenate(ids)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(count), pa.nulls(len(a), pa.int64())], names=["a", "n", "b"])
                root = np.array([find(i) for i in range(len(a))])
                i = np.flatnonzero(root != np.arange(len(a)))
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(a[i]), pa.nulls(len(i), pa.int64()), pa.array(a[root[i]])], names=["a", "n", "b"])

        def seal() -> None:
            nonlocal matrix, count, parent
            if matrix is None:
                matrix = np.concatenate(held)
                count, parent = np.zeros(len(matrix), np.int64), list(range(len(matrix)))

        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi == lo:
                    continue
                if keys[lo] != key:
                    if held:
                        seal()
                    yield from close()
                    key, ids, held, matrix = keys[lo], [], [], None
                part = batch.slice(lo, hi - lo)
                other = part.column(1).to_numpy(zero_copy_only=False)
                own = part.column(2).to_numpy(zero_copy_only=False)
                weight = part.column(3).to_numpy(zero_copy_only=False)
                x = _unit(_matrix(part.column(4)))
                n_own = int(np.searchsorted(own, 1, "left"))  # 0: a member, 1: an other
                if n_own:
                    ids.append(other[:n_own])
                    held.append(x[:n_own])
                other, weight, x = other[n_own:], weight[n_own:], x[n_own:]
                if not len(other):
                    continue
                seal()
                a = np.concatenate(ids)
                for at in range(0, len(other), AT_ONCE):
                    i, j = np.nonzero(matrix @ x[at : at + AT_ONCE].T >= cosine)
                    j = j + at
                    differ = a[i] != other[j]
                    count += np.bincount(i, weights=np.where(differ, weight[j], weight[j] - 1), minlength=len(a)).astype(np.int64)
                    i, j = i[differ], j[differ]
                    if not len(i):
                        continue
                    order = np.lexsort((i, j))
                    i, j = i[order], j[order]
                    first = np.concatenate([[True], j[1:] != j[:-1]])
                    lead = i[np.maximum.accumulate(np.where(first, np.arange(len(i)), 0))]
                    yield pa.RecordBatch.from_arrays([pa.array(a[i[first]]), pa.nulls(int(first.sum()), pa.int64()), pa.array(other[j[first]])], names=["a", "n", "b"])
                    for u, v in np.unique(np.stack([lead[~first], i[~first]], 1), axis=0).tolist():
                        ru, rv = find(u), find(v)
                        if ru != rv:
                            parent[max(ru, rv)] = min(ru, rv)
        if held:
            seal()
        yield from close()

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE, home: int = HOME, pivots: int = PIVOTS) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row per row of ``vectors(vec_id, embedding, label)``."""
    eps = math.sqrt(2 - 2 * cosine)
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall(v, lambda x: x == 0)
    usable = F.coalesce(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad & ~zero, F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), v.alias("v"), usable.alias("ok"))
    rows = rows.withColumn("h", F.when(F.col("ok"), F.xxhash64("label", "v")))
    classes = stage(rows.where("ok").groupBy("label", "v").agg(F.min("h").alias("id"), F.count("*").alias("weight")), "vector-classes")
    # as many pivots as leave the largest label's cells about `home` members each
    largest = classes.groupBy("label").count().agg(F.max("count")).head()[0] or 0
    wanted = min(pivots, -(-largest // home))
    centres: dict[int, np.ndarray] = {}
    if wanted > 1:
        for r in classes.select("id", "v").orderBy("id").limit(wanted).collect():
            centres.setdefault(len(r["v"]), []).append(r["v"])
        centres = {n: _unit(np.array(p)) for n, p in centres.items()}
    spread = classes.select("id", "label", "v", "weight").mapInArrow(_assign(centres, eps), "id long, label string, cell long, home boolean, weight long, v array<double>")
    spread = spread.withColumn("cell", F.xxhash64("label", "cell"))
    members = spread.where("home").groupBy("cell").agg(F.ceil(F.count("*") / F.lit(home)).alias("k"))
    spread = spread.join(members, "cell")
    salt = F.pmod(F.xxhash64("id"), F.col("k"))
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))
    as_home = spread.where("home").select(F.xxhash64("cell", salt).alias("key"), "id", F.lit(0).alias("other"), "weight", "v")
    as_other = spread.withColumn("at", at).select(F.xxhash64("cell", "at").alias("key"), "id", F.lit(1).alias("other"), "weight", "v")
    tasks = as_home.unionByName(as_other).repartition("key").sortWithinPartitions("key", "other")
    found = stage(tasks.mapInArrow(_join(cosine), "a long, n long, b long"), "vector-links")
    counts = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("n_links"))
    of = connected_components(found.where("b IS NOT NULL").select("a", "b")).select(F.col("node").alias("h"), F.col("component").alias("class"))
    least = rows.where("ok").groupBy("h").agg(F.min("vec_id").alias("least"))
    classed = stage(least.join(of, "h", "left").withColumn("class", F.coalesce("class", "h")), "vector-roots")
    result = classed.join(classed.groupBy("class").agg(F.min("least").alias("component_id")), "class").join(counts.withColumnRenamed("a", "h"), "h").select("h", "component_id", "n_links")
    out = rows.select("vec_id", "h").join(result, "h", "left")
    component = F.when(F.col("h").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of ``embeddings`` at cosine 0.93."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS y FROM r GROUP BY x),
k AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT t.vec_id, coalesce(k.n, 0) AS n_links, least(t.vec_id, coalesce(c.y, t.vec_id)) AS component_id,
  t.vec_id = least(t.vec_id, coalesce(c.y, t.vec_id)) AS kept
FROM embeddings t LEFT JOIN c ON c.x = t.vec_id LEFT JOIN k ON k.x = t.vec_id
"""
