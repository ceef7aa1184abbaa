"""Projections of stored tables to entities and relations.

``commerce`` (orders, parts, suppliers, nations: acyclic, heterogeneous; id =
key * 10 + tag), ``interaction`` (users' events over embedded entities),
``similarity`` (the same entities with scattered links, for re-ranking) and
``hierarchy`` (region, nation, customer: a tree).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.graph import KnowledgeGraph

#: The last digit of a commerce id.
TAGS = {"region": 0, "nation": 1, "customer": 2, "supplier": 3, "part": 4, "orders": 5}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(key: str, kind: str) -> Column:
    return F.col(key).cast("long") * 10 + TAGS[kind]


def _entities(spark: SparkSession, d: str, kinds: dict[str, tuple[str, str]]) -> DataFrame:
    out = None
    for kind, (key, name) in kinds.items():
        rows = table(spark, d, kind).select(_id(key, kind).alias("id"), F.lit(kind).alias("entity_type"), F.col(name).cast("string").alias("name"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _edges(rows: DataFrame, s: Column, t: Column, rel: str, weight: Column, seq: Column) -> DataFrame:
    return rows.select(seq.cast("long").alias("id"), s.alias("source_id"), t.alias("target_id"), F.lit(rel).alias("rel_type"), weight.cast("double").alias("weight"))


def commerce(spark: SparkSession, sf_dir: str) -> KnowledgeGraph:
    t = lambda n: table(spark, sf_dir, n)
    kinds = {"region": ("r_regionkey", "r_name"), "nation": ("n_nationkey", "n_name"), "customer": ("c_custkey", "c_name"), "supplier": ("s_suppkey", "s_name"), "part": ("p_partkey", "p_name"), "orders": ("o_orderkey", "o_orderstatus")}
    one, wide = F.lit(1.0), 1_000_000_000_000
    line = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long")
    parts = [
        _edges(t("orders"), _id("o_orderkey", "orders"), _id("o_custkey", "customer"), "placed_by", one, F.col("o_orderkey")),
        _edges(t("lineitem"), _id("l_orderkey", "orders"), _id("l_partkey", "part"), "contains", F.col("l_quantity"), line + wide),
        _edges(t("lineitem"), _id("l_partkey", "part"), _id("l_suppkey", "supplier"), "supplied_by", one, line + 2 * wide),
        _edges(t("supplier"), _id("s_suppkey", "supplier"), _id("s_nationkey", "nation"), "located_in", one, F.col("s_suppkey") + 3 * wide),
        _edges(t("customer"), _id("c_custkey", "customer"), _id("c_nationkey", "nation"), "located_in", one, F.col("c_custkey") + 4 * wide),
        _edges(t("nation"), _id("n_nationkey", "nation"), _id("n_regionkey", "region"), "part_of", one, F.col("n_nationkey") + 5 * wide),
    ]
    edges = parts[0]
    for p in parts[1:]:
        edges = edges.unionByName(p)
    return KnowledgeGraph(_entities(spark, sf_dir, kinds), edges)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedded entities: the label is their type."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("string").alias("entity_type"), F.concat(F.lit("vec_"), F.col("vec_id")).alias("name"), "embedding")


def interaction(spark: SparkSession, sf_dir: str) -> KnowledgeGraph:
    k = F.get_json_object("props", "$.k").cast("long")
    e = table(spark, sf_dir, "events")
    return KnowledgeGraph(vectors(spark, sf_dir), e.select(F.col("event_id").cast("long").alias("id"), F.col("user_id").cast("long").alias("source_id"), k.alias("target_id"), F.col("event_type").alias("rel_type"), F.col("value").cast("double").alias("weight")))


def similarity(spark: SparkSession, sf_dir: str) -> KnowledgeGraph:
    n = table(spark, sf_dir, "embeddings").count()
    k = F.get_json_object("props", "$.k").cast("long")
    e = table(spark, sf_dir, "events")
    n = F.lit(max(n, 1))
    return KnowledgeGraph(vectors(spark, sf_dir), e.select(F.col("event_id").cast("long").alias("id"), (F.col("event_id") % n).cast("long").alias("source_id"), ((F.col("user_id") * 31 + k * 7) % n).cast("long").alias("target_id"), F.col("event_type").alias("rel_type"), F.col("value").cast("double").alias("weight")))


def hierarchy(spark: SparkSession, sf_dir: str) -> KnowledgeGraph:
    """A tree below the synthetic root -1; siblings in order of their id."""
    t = lambda n: table(spark, sf_dir, n)
    kinds = {"region": ("r_regionkey", "r_name"), "nation": ("n_nationkey", "n_name"), "customer": ("c_custkey", "c_name")}
    one, wide = F.lit(1.0), 1_000_000_000_000
    edges = _edges(t("region"), F.lit(-1).cast("long"), _id("r_regionkey", "region"), "has", one, F.col("r_regionkey"))
    edges = edges.unionByName(_edges(t("nation"), _id("n_regionkey", "region"), _id("n_nationkey", "nation"), "has", one, F.col("n_nationkey") + wide))
    edges = edges.unionByName(_edges(t("customer"), _id("c_nationkey", "nation"), _id("c_custkey", "customer"), "has", one, F.col("c_custkey") + 2 * wide))
    return KnowledgeGraph(_entities(spark, sf_dir, kinds), edges)


def generate(spark: SparkSession, entities: int = 10_000, dims: int = 1536, relations: int = 50_000, seed: int = 42) -> KnowledgeGraph:
    """A random graph with random vectors, for benchmarks."""
    vector = F.transform(F.sequence(F.lit(1), F.lit(dims)), lambda i: (F.xxhash64(F.col("id"), i, F.lit(seed)) / F.lit(float(2**64)) + 0.5).cast("float"))
    rows = spark.range(1, entities + 1).select("id", F.lit("benchmark").alias("entity_type"), F.concat(F.lit("entity_"), F.col("id")).alias("name"), vector.alias("embedding"))
    i = F.col("id")
    edges = spark.range(1, relations + 1).select("id", (i % entities + 1).alias("source_id"), ((i + F.floor(F.rand(seed) * 100)) % entities + 1).alias("target_id"), F.lit("relates_to").alias("rel_type"), F.rand(seed + 1).alias("weight"))
    return KnowledgeGraph(rows, edges)


