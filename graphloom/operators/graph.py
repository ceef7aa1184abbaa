"""The knowledge graph: entities and typed, weighted, directed relations as DataFrames."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTITY_SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("entity_type", T.StringType()), T.StructField("name", T.StringType()), T.StructField("properties", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
RELATION_SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("source_id", T.LongType()), T.StructField("target_id", T.LongType()), T.StructField("rel_type", T.StringType()), T.StructField("weight", T.DoubleType()), T.StructField("properties", T.StringType())])


def _with_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    have = set(df.columns)
    default = {"properties": F.lit("{}"), "weight": F.lit(1.0)}
    return df.select(*((F.col(f.name) if f.name in have else default.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in schema))


class KnowledgeGraph:
    """Entities and relations; parallel relations and self-loops are legal.

    Either frame may be absent (no rows).  A text embedding ("[1,2]") is parsed;
    one that cannot be parsed counts as missing.  Null ends of a relation count
    as 0, a null weight as 1, a null type or name as "".
    """

    def __init__(self, entities: DataFrame | None, relations: DataFrame | None, spark: SparkSession | None = None) -> None:
        spark = spark or (entities if entities is not None else relations).sparkSession
        entities = entities if entities is not None else spark.createDataFrame([], ENTITY_SCHEMA)
        relations = relations if relations is not None else spark.createDataFrame([], RELATION_SCHEMA)
        if dict(entities.dtypes).get("embedding") == "string":
            # numbers between commas, with or without brackets; a bad one spoils the vector
            inner = F.regexp_replace(F.trim("embedding"), r"^\[+|\]+$", "")
            parts = F.transform(F.split(inner, ","), lambda x: F.trim(x).try_cast("float"))
            entities = entities.withColumn("embedding", F.when(~F.exists(parts, lambda x: x.isNull()), parts))
        self.spark = spark
        self.entities = _with_columns(entities, ENTITY_SCHEMA)
        self.relations = _with_columns(relations, RELATION_SCHEMA)

    @cached_property
    def edges(self) -> DataFrame:
        """``seq, src, dst, weight, rel_type``; ``seq`` orders parallel choices."""
        zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
        return self.relations.select(F.col("id").alias("seq"), zero("source_id").alias("src"), zero("target_id").alias("dst"), F.coalesce("weight", F.lit(1.0)).alias("weight"), F.coalesce("rel_type", F.lit("")).alias("rel_type"))

    @cached_property
    def vertices(self) -> DataFrame:
        """``id`` of all entities and all ends of relations."""
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("id"))
        return self.entities.select("id").where("id IS NOT NULL").unionByName(ends).distinct()

    def stats(self) -> DataFrame:
        """``entity_count, relation_count, density``; density is directed and not clipped."""
        n = self.entities.agg(F.count("*").alias("entity_count"))
        r = self.relations.agg(F.count("*").alias("relation_count"))
        e = F.col("entity_count")
        density = F.when(e > 1, F.col("relation_count") / (e.cast("double") * (e - 1))).otherwise(0.0)
        return n.join(F.broadcast(r)).withColumn("density", density)  # two frames of one row

    def validate(self) -> DataFrame:
        """``problem, id``: repeated or missing entity ids and relations with an unknown end."""
        ids = self.entities.select("id")
        repeated = ids.groupBy("id").count().where("count > 1 OR id IS NULL").select(F.lit("repeated or missing entity id").alias("problem"), "id")
        out = repeated
        for end in ("source_id", "target_id"):
            bad = self.relations.join(ids.withColumnRenamed("id", end), end, "left_anti")
            out = out.unionByName(bad.select(F.lit(f"unknown {end}").alias("problem"), "id"))
        return out
