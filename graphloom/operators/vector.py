"""Vector retrieval: exact cosine top-k, graph re-ranking, exact kNN recall."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.graph import KnowledgeGraph
from graphloom.operators.traversal import reach

Vector = Sequence[float] | str


def as_vector(query: Vector) -> list[float]:
    """Numbers of a query given as a list, an array, ``"[1, 2]"`` or ``"1, 2"``."""
    if isinstance(query, str):
        query = [x for x in query.strip().lstrip("[").rstrip("]").split(",") if x.strip()]
    return [float(x) for x in query]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def literal(query: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in query))


def matrix(v: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Which lists have ``dims`` numbers, and those as rows of a matrix (null elements are NaN)."""
    ok = pc.fill_null(pc.list_value_length(v), -1).to_numpy(zero_copy_only=False) == dims
    rows = v.filter(pa.array(ok)).flatten().to_numpy(zero_copy_only=False)
    return ok, rows.reshape(int(ok.sum()), dims)


def cosine(v: Column, query: Sequence[float]) -> Column:
    """Double-precision cosine with a constant vector, one matrix product per Arrow batch.

    Null for a null or a vector of another length, 0.0 for a zero vector or one that is not finite.
    """
    q = np.asarray(query, np.float64)
    size = np.sqrt((q * q).sum())

    @F.arrow_udf("double")
    def run(v: pa.Array) -> pa.Array:
        ok, x = matrix(v, len(q))
        x = x.astype(np.float64)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            got = x @ q / (np.sqrt((x * x).sum(axis=1)) * size)
        out = np.zeros(len(ok))
        out[ok] = np.where(np.isfinite(got), got, 0.0)
        return pa.array(out, pa.float64(), mask=~ok)

    return run(v)


def vector_search(graph: KnowledgeGraph, query: Vector, k: int = 10) -> DataFrame:
    """``entity_id, entity_name, entity_type, similarity``: exact top-k, ties by id.

    An empty query or ``k <= 0`` gives no rows; missing embeddings are left out;
    a stored vector of another length is an error; zero vectors and those that are not finite score 0.0.
    """
    q = as_vector(query)
    rows = graph.entities.where(F.col("embedding").isNotNull())
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    v = F.when(F.size("embedding") == len(q), F.col("embedding")).otherwise(F.raise_error(F.lit("a stored vector has another length than the query")).cast("array<float>"))
    similarity = cosine(v, q) if q else F.lit(0.0)
    out = rows.select(F.col("id").alias("entity_id"), blank("name").alias("entity_name"), blank("entity_type").alias("entity_type"), similarity.alias("similarity"))
    if not q or k <= 0:
        return out.where("false")
    return out.orderBy(F.desc("similarity"), "entity_id").limit(k)


def hybrid_search(graph: KnowledgeGraph, query: Vector, k: int = 10, graph_depth: int = 2, alpha: float = 0.7, beta: float = 0.3) -> DataFrame:
    """Vector top-k, re-ordered by ``alpha * similarity + beta * graph_score``.

    The graph score is 1 / (1 + 0.1 n) for n nodes within ``graph_depth`` hops,
    0.5 for none; without any relation n is -1.  One search serves all hits.
    """
    hits = vector_search(graph, query, k)
    rank = F.row_number().over(Window.orderBy(F.desc("similarity"), "entity_id"))  # k rows
    hits = hits.withColumn("rank", rank)
    n = reach(graph, hits.select(F.col("entity_id").alias("seed")), graph_depth).select(F.col("seed").alias("entity_id"), (F.col("n") - 1).alias("neighbors_count"))
    score = F.when(F.col("neighbors_count") > 0, 1 / (1 + 0.1 * F.col("neighbors_count"))).otherwise(0.5)
    out = hits.join(n, "entity_id", "left").withColumn("neighbors_count", F.coalesce("neighbors_count", F.lit(-1).cast("long"))).withColumn("graph_score", score)
    out = out.withColumn("combined_score", alpha * F.col("similarity") + beta * F.col("graph_score")).orderBy(F.desc("combined_score"), "rank")
    return out.select("entity_id", "entity_name", "entity_type", F.col("similarity").alias("vector_score"), "graph_score", "combined_score", "neighbors_count")


def cosine_distance(a: Column, b: Column) -> Column:
    """``1 - dot / (|a||b| + 1e-10)`` in double precision."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-10)


def recall_at_k(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """One row ``recall``: the share of ``query_id, entity_id`` pairs of ``exact`` that ``approximate`` has."""
    hit = approximate.select("query_id", "entity_id", F.lit(1.0).alias("hit")).distinct()
    return exact.join(hit, ["query_id", "entity_id"], "left").agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0.0))), F.lit(0.0)).alias("recall"))
