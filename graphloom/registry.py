"""Registered graph, retrieval and quantization queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import graphloom
from graphloom.operators import analytics, quant, traversal, vector
from graphloom.sources import tables

#: Iterations of the registered PageRank, below convergence so that SQL can follow.
STEPS = 5


def _first(spark: SparkSession, d: str) -> list[float]:
    return [float(x) for x in tables.vectors(spark, d).where("id = 0").head()["embedding"]]


def _search(spark: SparkSession, d: str) -> DataFrame:
    out = vector.vector_search(tables.similarity(spark, d), _first(spark, d), 10)
    return out.withColumn("similarity", F.round("similarity", 6))


def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    out = vector.hybrid_search(tables.similarity(spark, d), _first(spark, d), 10)
    return out.withColumns({c: F.round(c, 6) for c in ("vector_score", "graph_score", "combined_score")})


def _quantized(level: str):  # noqa: ANN202
    """Codes of all vectors and their similarity to the first one, through the stored form."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        q = _first(spark, d)
        coded = quant.encode(tables.vectors(spark, d), len(q), level)
        out = quant.score(coded, q, level)
        return out.select(F.col("id").alias("entity_id"), F.hex("quantized.data").alias("data"), F.col("quantized.qjl_bit").cast("int").alias("qjl_bit"), F.round("similarity", 4).alias("similarity"))

    return run


def _quantized_search(spark: SparkSession, d: str) -> DataFrame:
    out = quant.quantized_search(tables.similarity(spark, d), _first(spark, d), 10, "int8")
    return out.withColumn("similarity", F.round("similarity", 6))


def _order(spark: SparkSession, d: str) -> int:
    return tables.table(spark, d, "orders").agg(F.min("o_orderkey")).head()[0] * 10 + tables.TAGS["orders"]


def _path(spark: SparkSession, d: str) -> DataFrame:
    region = tables.table(spark, d, "region").agg(F.min("r_regionkey")).head()[0] * 10 + tables.TAGS["region"]
    out = traversal.shortest_path(tables.commerce(spark, d), _order(spark, d), region, 6)
    steps = F.transform("path", lambda n: F.concat_ws(":", n["entity_id"], F.coalesce(n["rel_type"], F.lit("-")), n["weight"].cast("decimal(12,2)")))
    return out.select("found", "from_id", "to_id", "total_cost", "hops", F.array_join(steps, ";").alias("steps"))


def _context(spark: SparkSession, d: str) -> DataFrame:
    out = traversal.context(tables.commerce(spark, d), _order(spark, d), 2)
    listed = F.transform("context_nodes", lambda n: F.concat_ws(":", n["entity_id"], n["depth"], F.coalesce(n["parent_id"].cast("string"), F.lit("-")), F.coalesce(n["rel_type"], F.lit("-")), n["weight"].cast("decimal(12,2)")))
    return out.select("center_entity_id", "depth", "total_nodes", F.array_join(listed, ";").alias("listed"))


def _trained(spark: SparkSession, d: str) -> DataFrame:
    """Codes of the trained quantizer at every level, and their products with the first vector."""
    v, query, out = tables.vectors(spark, d), _first(spark, d), None
    for level in quant.BITS:
        q = quant.TrainedQuantizer(level).fit(v)
        rows = q.score(q.encode(v), query)
        rows = rows.select("id", F.lit(level).alias("level"), F.hex("quantized.data").alias("data"), "quantized.dims", F.round("score.dot_product", 4).alias("dot_product"), F.round("score.cosine_distance", 4).alias("cosine_distance"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _simple(spark: SparkSession, d: str) -> DataFrame:
    v = tables.vectors(spark, d)
    return quant.simple_int8(v, quant.train_ranges(v), _first(spark, d)).select("id", F.round("distance", 6).alias("distance"))


def _cosine_distance(spark: SparkSession, d: str) -> DataFrame:
    distance = vector.cosine_distance(F.col("embedding"), vector.literal(_first(spark, d)))
    return tables.vectors(spark, d).select("id", F.round(distance, 6).alias("distance"))


def _recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall at 10 of the codes of every level with every vector of an id divisible by 20 as a query."""
    v, out = tables.vectors(spark, d), None
    for level in quant.BITS:
        row = quant.search_recall(v, F.col("id") % 20 == 0, 10, level).select(F.lit(level).alias("level"), F.round("recall", 6).alias("recall"))
        out = row if out is None else out.unionByName(row)
    return out


def _labels(spark: SparkSession, d: str) -> DataFrame:
    of = tables.vectors(spark, d).select(F.col("id").alias("entity_id"), F.col("entity_type").cast("int").alias("community_id"))
    return analytics.edge_modularity(tables.interaction(spark, d), of).withColumn("modularity", F.round("modularity", 6))


QUERIES = {
    "kg_pagerank_converged": lambda s, d: analytics.pagerank(tables.interaction(s, d)).withColumn("score", F.round("score", 8)),
    "kg_version": lambda s, d: s.range(1).select(F.lit(graphloom.__version__).alias("version")),
    "kg_stats": lambda s, d: tables.commerce(s, d).stats().withColumn("density", F.round("density", 12)),
    "kg_bfs": lambda s, d: traversal.bfs(tables.commerce(s, d), _order(s, d), 4),
    "kg_dfs_tree": lambda s, d: traversal.dfs(tables.hierarchy(s, d), -1, 3),
    "kg_shortest_path": _path,
    "kg_context": _context,
    "kg_pagerank": lambda s, d: analytics.pagerank(tables.commerce(s, d), 0.85, STEPS).withColumn("score", F.round(F.col("score") * 1e6, 4)),
    "kg_louvain": lambda s, d: analytics.louvain(tables.interaction(s, d)),
    "kg_louvain_distributed": lambda s, d: analytics.louvain(tables.interaction(s, d), "distributed"),
    "kg_edge_modularity": _labels,
    "kg_connected_components": lambda s, d: analytics.connected_components(tables.interaction(s, d)),
    "kg_strongly_connected_components": lambda s, d: analytics.strongly_connected_components(tables.interaction(s, d)),
    "kg_vector_search": _search,
    "kg_hybrid_search": _hybrid,
    "kg_quantized_search": _quantized_search,
    "kg_quantized_int8": _quantized("int8"),
    "kg_quantized_int4": _quantized("int4"),
    "kg_quantized_binary": _quantized("binary"),
    "kg_quantize_info": lambda s, d: quant.quantize_info(s),
    "kg_sq_train": lambda s, d: quant.train_ranges(tables.vectors(s, d)),
    "kg_sq_encode": _trained,
    "kg_simple_int8": _simple,
    "kg_cosine_distance": _cosine_distance,
    "kg_recall_at_10": _recall,
}

_G1 = """
e AS (SELECT o_orderkey AS seq, o_orderkey * 10 + 5 AS s, o_custkey * 10 + 2 AS t, 'placed_by' AS rel, 1.0::DOUBLE AS w FROM orders
  UNION ALL SELECT l_orderkey * 10 + l_linenumber + 1000000000000, l_orderkey * 10 + 5, l_partkey * 10 + 4, 'contains', l_quantity FROM lineitem
  UNION ALL SELECT l_orderkey * 10 + l_linenumber + 2000000000000, l_partkey * 10 + 4, l_suppkey * 10 + 3, 'supplied_by', 1.0 FROM lineitem
  UNION ALL SELECT s_suppkey + 3000000000000, s_suppkey * 10 + 3, s_nationkey::BIGINT * 10 + 1, 'located_in', 1.0 FROM supplier
  UNION ALL SELECT c_custkey + 4000000000000, c_custkey * 10 + 2, c_nationkey::BIGINT * 10 + 1, 'located_in', 1.0 FROM customer
  UNION ALL SELECT n_nationkey + 5000000000000, n_nationkey::BIGINT * 10 + 1, n_regionkey::BIGINT * 10, 'part_of', 1.0 FROM nation),
v AS (SELECT o_orderkey * 10 + 5 AS v FROM orders UNION SELECT c_custkey * 10 + 2 FROM customer UNION SELECT p_partkey * 10 + 4 FROM part
  UNION SELECT s_suppkey * 10 + 3 FROM supplier UNION SELECT n_nationkey::BIGINT * 10 + 1 FROM nation UNION SELECT r_regionkey::BIGINT * 10 FROM region),
n AS (SELECT v FROM v UNION SELECT s FROM e UNION SELECT t FROM e),
o AS (SELECT min(o_orderkey) * 10 + 5 AS o FROM orders)"""
_BFS = """
b(v, d) AS (SELECT o, 0 FROM o UNION SELECT e.t, d + 1 FROM b JOIN e ON e.s = b.v WHERE d < {depth}),
l AS (SELECT v, min(d) AS d FROM b GROUP BY v),
p(v, d, k, parent, rel, w, c, path) AS (SELECT o, 0, []::BIGINT[], NULL::BIGINT, NULL::VARCHAR, 0.0::DOUBLE, 0.0::DOUBLE, o || '::0.00' FROM o UNION ALL
  SELECT e.t, p.d + 1, min(list_append(p.k, e.seq)), arg_min(p.v, list_append(p.k, e.seq)), arg_min(e.rel, list_append(p.k, e.seq)),
    arg_min(e.w, list_append(p.k, e.seq)), arg_min(p.c + e.w, list_append(p.k, e.seq)),
    arg_min(p.path || ';' || e.t || ':' || e.rel || ':' || e.w::DECIMAL(12,2), list_append(p.k, e.seq))
  FROM p JOIN e ON e.s = p.v JOIN l ON l.v = e.t AND l.d = p.d + 1 GROUP BY e.t, p.d)"""
_G2 = """e AS (SELECT user_id AS s, CAST(json_extract(props, '$.k') AS BIGINT) AS t, value AS w FROM events),
n AS (SELECT vec_id AS v FROM embeddings UNION SELECT s FROM e UNION SELECT t FROM e)"""
_Q = "q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"


def _pagerank_sql() -> str:
    out = f"""WITH {_G1}, m AS (SELECT count(*)::DOUBLE AS n FROM n), dg AS (SELECT s, count(*)::DOUBLE AS k FROM e GROUP BY s),
p0 AS MATERIALIZED (SELECT v, 1 / (SELECT n FROM m) AS x FROM n)"""
    for i in range(STEPS):
        out += f""", i{i} AS (SELECT e.t, sum(p.x / dg.k) AS x FROM p{i} p JOIN dg ON dg.s = p.v JOIN e ON e.s = p.v GROUP BY e.t),
y{i} AS (SELECT coalesce(sum(x), 0) AS y FROM p{i} WHERE v NOT IN (SELECT s FROM dg)),
p{i + 1} AS MATERIALIZED (SELECT n.v, 0.15 / m.n + 0.85 * (coalesce(i{i}.x, 0) + y{i}.y / m.n) AS x FROM n CROSS JOIN m CROSS JOIN y{i} LEFT JOIN i{i} ON i{i}.t = n.v)"""
    return out + f" SELECT v AS entity_id, round(x * 1e6, 4) AS score FROM p{STEPS}"


#: The seeds of the two sign sequences, the second shifted by a constant, and the levels.
_SEEDS = ("16045690984503098046::UBIGINT", "((16045690984503098046::HUGEINT + 11400714819323198485::HUGEINT) % 18446744073709551616::HUGEINT)::UBIGINT")
_FOUR = "[-2.7326, -2.0690, -1.6352, -1.2732, -0.9617, -0.6736, -0.3992, -0.1332, 0.1332, 0.3992, 0.6736, 0.9617, 1.2732, 1.6352, 2.0690, 2.7326]::DOUBLE[]"
_HEX = {
    "int8": "array_to_string([format('{:02X}', c::INT) for c in k], '')",
    "int4": "array_to_string([format('{:02X}', (k[2 * i - 1] + 16 * k[2 * i])::INT) for i in range(1, 33)], '')",
    "binary": "array_to_string([format('{:02X}', list_sum([k[8 * i + j + 1] * (1 << j) for j in range(0, 8)])::INT) for i in range(0, 8)], '')",
}


def _signs_sql(name: str, seed: str) -> str:
    """Signs of 64 dimensions by the low bit of a xorshift sequence; values are cut before they shift out."""
    return f"""{name}_x(i, x) AS (SELECT 0, {seed} UNION ALL SELECT i + 1, xor(b, (b & 140737488355327::UBIGINT) << 17::UBIGINT)
  FROM (SELECT i, xor(a, a >> 7::UBIGINT) AS b FROM (SELECT i, xor(x, (x & 2251799813685247::UBIGINT) << 13::UBIGINT) AS a FROM {name}_x WHERE i < 64))),
{name} AS (SELECT list(CASE WHEN x % 2 = 1 THEN -1 ELSE 1 END::DOUBLE ORDER BY i) AS {name} FROM {name}_x WHERE i > 0)"""


def _codes_sql(level: str, queries: str, stored: bool = False) -> str:
    """``WITH`` tables of the codes: last ``z`` with ``vec_id, k, bit, qid, x`` (the similarity to each query)."""
    code, value = {
        "int8": ("floor((least(greatest(a, -4.0::DOUBLE), 4.0) + 4.0) / 8.0 * 255.0 + 0.5)::INT", "c * (8.0::DOUBLE / 255.0) - 4.0"),
        "int4": ("len([i for i in range(1, 16) if a > (four[i] + four[i + 1]) / 2])::INT", "four[c + 1]"),
        "binary": ("(a >= 0)::INT", "CASE WHEN c = 1 THEN 0.7979::DOUBLE ELSE -0.7979::DOUBLE END"),
    }[level]
    kept = "::FLOAT::DOUBLE" if stored else ""
    fix = "0.0" if level == "binary" else "bit * rn * (list_dot_product(q, r) / 8.0 * 0.7978846::DOUBLE)"
    return f"""WITH RECURSIVE {_signs_sql("s", _SEEDS[0])}, {_signs_sql("r", _SEEDS[1])}, f AS (SELECT {_FOUR} AS four),
q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS q FROM embeddings WHERE {queries}),
v AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
t AS (SELECT vec_id, n, s, r, four, [v[i] * (8.0::DOUBLE / n) * s[i] for i in range(1, 65)] AS t FROM v, s, r, f),
k AS (SELECT *, [{code} for a in t] AS k FROM t), y AS (SELECT *, [{value} for c in k] AS y FROM k),
e AS (SELECT *, [t[i] - y[i] for i in range(1, 65)] AS e FROM y),
c AS (SELECT vec_id, k, y, s, r, n{kept} AS n, CASE WHEN list_dot_product(e, r) >= 0 THEN 1 ELSE -1 END AS bit, (sqrt(list_dot_product(e, e)) * n / 8.0){kept} AS rn FROM e),
z AS (SELECT vec_id, k, bit, qid, least(greatest((list_dot_product(y, [q[i] * s[i] for i in range(1, 65)]) * n / 8.0 + {fix}) / (n * sqrt(list_dot_product(q, q))), -1.0), 1.0) AS x FROM c, q)"""


def _quantized_sql(level: str) -> str:
    return f"{_codes_sql(level, 'vec_id = 0', True)} SELECT vec_id AS entity_id, {_HEX[level]} AS data, bit::INT AS qjl_bit, round(x, 4) AS similarity FROM z"


def _recall_sql() -> str:
    def one(level: str) -> str:
        return f"""SELECT '{level}' AS level, round(avg(hit), 6) AS recall FROM ({_codes_sql(level, 'vec_id % 20 = 0')},
a AS (SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY x DESC, vec_id) AS i FROM z),
b AS (SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY list_cosine_similarity(v, q) DESC, vec_id) AS i FROM v, q)
SELECT (a.i <= 10)::INT::DOUBLE AS hit FROM b JOIN a USING (qid, vec_id) WHERE b.i <= 10)"""

    return " UNION ALL ".join(one(level) for level in ("int8", "int4", "binary"))


def _trained_sql() -> str:
    pieces = " UNION ALL ".join(f"SELECT vec_id AS id, level, {_HEX[level]} AS data, 64 AS dims, n, y FROM y WHERE level = '{level}'" for level in ("int8", "int4", "binary"))
    return f"""WITH {_Q}, l(level, top) AS (VALUES ('int8', 255.0::DOUBLE), ('int4', 15.0::DOUBLE), ('binary', 1.0::DOUBLE)),
m AS (SELECT list(lo ORDER BY i) AS lo, list(hi ORDER BY i) AS hi FROM (SELECT i, min(embedding[i])::DOUBLE AS lo, max(embedding[i])::DOUBLE AS hi FROM embeddings, range(1, 65) r(i) GROUP BY i)),
k AS (SELECT vec_id, level, top, lo, hi, sqrt(list_dot_product(v, v))::FLOAT::DOUBLE AS n,
  [(CASE WHEN top = 1 THEN (v[i] >= (lo[i] + hi[i]) / 2)::INT ELSE floor((v[i] - lo[i]) / (hi[i] - lo[i]) * top + 0.5) END)::INT for i in range(1, 65)] AS k
  FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), l, m),
y AS (SELECT *, [CASE WHEN top > 1 THEN lo[i] + k[i] / top * (hi[i] - lo[i]) WHEN k[i] = 1 THEN ((lo[i] + hi[i]) / 2 + hi[i]) / 2 ELSE (lo[i] + (lo[i] + hi[i]) / 2) / 2 END for i in range(1, 65)] AS y FROM k),
h AS ({pieces})
SELECT id, level, data, dims::INT AS dims, round(list_dot_product(y, q), 4) AS dot_product, round(1 - least(greatest(list_dot_product(y, q) / (n * sqrt(list_dot_product(q, q))), -1.0), 1.0), 4) AS cosine_distance FROM h, q"""


_SIMPLE = f"""WITH {_Q}, m AS (SELECT list(lo ORDER BY i) AS lo, list(hi ORDER BY i) AS hi FROM (SELECT i, min(embedding[i])::DOUBLE AS lo, max(embedding[i])::DOUBLE AS hi FROM embeddings, range(1, 65) r(i) GROUP BY i)),
y AS (SELECT vec_id, [floor((embedding[i]::DOUBLE - lo[i]) / (hi[i] - lo[i]) * 255.0 + 0.5) / 255.0 * (hi[i] - lo[i]) + lo[i] for i in range(1, 65)] AS y FROM embeddings, m)
SELECT vec_id AS id, round(1 - list_dot_product(y, q) / (sqrt(list_dot_product(y, y)) * sqrt(list_dot_product(q, q)) + 1e-10), 6) AS distance FROM y, q"""


ORACLE_SQL = {
    "kg_version": f"SELECT '{graphloom.__version__}' AS version",
    "kg_stats": f"WITH {_G1}, c AS (SELECT (SELECT count(*) FROM v) AS a, (SELECT count(*) FROM e) AS b) SELECT a AS entity_count, b AS relation_count, round(b / (a::DOUBLE * (a - 1)), 12) AS density FROM c",
    "kg_bfs": f"WITH RECURSIVE {_G1}, {_BFS.format(depth=4)} SELECT v AS entity_id, d AS depth, parent AS parent_id, rel AS rel_type, w AS weight FROM p",
    "kg_dfs_tree": """WITH a AS (SELECT -1::BIGINT AS entity_id, 0 AS depth, NULL::BIGINT AS parent_id, NULL::VARCHAR AS rel_type, 0.0::DOUBLE AS weight
  UNION ALL SELECT r_regionkey * 10, 1, -1, 'has', 1.0 FROM region
  UNION ALL SELECT n_nationkey * 10 + 1, 2, n_regionkey * 10, 'has', 1.0 FROM nation
  UNION ALL SELECT c_custkey * 10 + 2, 3, c_nationkey * 10 + 1, 'has', 1.0 FROM customer) SELECT * FROM a""",
    "kg_shortest_path": f"WITH RECURSIVE {_G1}, {_BFS.format(depth=6)} SELECT v IS NOT NULL AS found, (SELECT o FROM o) AS from_id, g AS to_id, coalesce(c, 0.0) AS total_cost, coalesce(d, 0) AS hops, coalesce(path, '') AS steps FROM (SELECT min(r_regionkey)::BIGINT * 10 AS g FROM region) LEFT JOIN p ON v = g",
    "kg_context": f"WITH RECURSIVE {_G1}, {_BFS.format(depth=2)} SELECT (SELECT o FROM o) AS center_entity_id, 2 AS depth, count(*) AS total_nodes, string_agg(v || ':' || d || ':' || coalesce(parent::VARCHAR, '-') || ':' || coalesce(rel, '-') || ':' || w::DECIMAL(12,2), ';' ORDER BY d, k) AS listed FROM p",
    "kg_pagerank": _pagerank_sql(),
    "kg_edge_modularity": f"""WITH {_G2}, m AS (SELECT sum(w) AS m FROM e), k AS (SELECT v, sum(w) AS k FROM (SELECT s AS v, w FROM e UNION ALL SELECT t, w FROM e) GROUP BY v)
SELECT round(sum(e.w - a.k * b.k / (2 * m.m)) / any_value(m.m), 6) AS modularity FROM e JOIN embeddings x ON x.vec_id = e.s JOIN embeddings y ON y.vec_id = e.t AND y.label = x.label
JOIN k a ON a.v = e.s JOIN k b ON b.v = e.t CROSS JOIN m""",
    "kg_connected_components": f"""WITH RECURSIVE {_G2}, u AS (SELECT DISTINCT s, t FROM e UNION SELECT DISTINCT t, s FROM e), r(v, x) AS (SELECT s, s FROM u UNION SELECT r.v, u.t FROM r JOIN u ON u.s = r.x),
g AS (SELECT n.v, coalesce(min(r.x), n.v) AS root FROM n LEFT JOIN r ON r.v = n.v GROUP BY n.v)
SELECT v AS entity_id, (dense_rank() OVER (ORDER BY root) - 1)::INT AS component_id FROM g""",
    "kg_strongly_connected_components": f"""WITH RECURSIVE {_G2}, u AS (SELECT DISTINCT s, t FROM e), r(a, b) AS (SELECT s, t FROM u UNION SELECT r.a, u.t FROM r JOIN u ON u.s = r.b),
z AS (SELECT x.a, min(x.b) AS b FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY x.a),
g AS (SELECT n.v, least(n.v, coalesce(z.b, n.v)) AS root FROM n LEFT JOIN z ON z.a = n.v),
i AS (SELECT root, row_number() OVER (ORDER BY count(*) DESC, root) - 1 AS id FROM g GROUP BY root)
SELECT v AS entity_id, id::INT AS scc_id FROM g JOIN i USING (root)""",
    "kg_vector_search": f"WITH {_Q} SELECT vec_id AS entity_id, 'vec_' || vec_id AS entity_name, label::VARCHAR AS entity_type, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS similarity FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], q) DESC, vec_id LIMIT 10",
    "kg_hybrid_search": f"""WITH RECURSIVE {_Q}, m AS (SELECT count(*) AS n FROM embeddings),
e AS (SELECT event_id % n AS s, (user_id * 31 + CAST(json_extract(props, '$.k') AS BIGINT) * 7) % n AS t FROM events, m),
h AS (SELECT vec_id, 'vec_' || vec_id AS name, label::VARCHAR AS kind, list_cosine_similarity(embedding::DOUBLE[], q) AS x FROM embeddings, q ORDER BY x DESC, vec_id LIMIT 10),
r(v, x, d) AS (SELECT vec_id, vec_id, 0 FROM h UNION SELECT r.v, e.t, d + 1 FROM r JOIN e ON e.s = r.x WHERE d < 2),
c AS (SELECT v, count(DISTINCT x) - 1 AS n FROM r GROUP BY v),
g AS (SELECT *, CASE WHEN n > 0 THEN 1 / (1 + 0.1 * n::DOUBLE) ELSE 0.5 END AS y FROM h JOIN c ON c.v = h.vec_id)
SELECT vec_id AS entity_id, name AS entity_name, kind AS entity_type, round(x, 6) AS vector_score, round(y, 6)::DOUBLE AS graph_score, round(0.7::DOUBLE * x + 0.3::DOUBLE * y, 6) AS combined_score, n AS neighbors_count FROM g""",
    "kg_quantized_int8": _quantized_sql("int8"),
    "kg_quantized_int4": _quantized_sql("int4"),
    "kg_quantized_binary": _quantized_sql("binary"),
    "kg_quantized_search": f"""{_codes_sql("int8", "vec_id = 0")} SELECT vec_id AS entity_id, 'vec_' || vec_id AS entity_name, label::VARCHAR AS entity_type, round(x, 6) AS similarity, 'int8' AS quantization_level, 4.0::DOUBLE AS compression_ratio
FROM z JOIN embeddings USING (vec_id) ORDER BY x DESC, vec_id LIMIT 10""",
    "kg_sq_encode": _trained_sql(),
    "kg_recall_at_10": _recall_sql(),
    "kg_simple_int8": _SIMPLE,
    "kg_cosine_distance": f"WITH {_Q} SELECT vec_id AS id, round(1 - list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q)) + 1e-10), 6) AS distance FROM embeddings, q",
    "kg_quantize_info": "SELECT name, bits::INT AS bits_per_value, ratio::DOUBLE AS compression_ratio, loss::DOUBLE AS expected_recall_loss, speed AS expected_speedup, name = 'int8' AS is_default FROM (VALUES ('int8', 8, 4.0, 0.0, '2-3x'), ('int4', 4, 8.0, 0.02, '4-6x'), ('binary', 1, 32.0, 0.05, '8-10x')) t(name, bits, ratio, loss, speed)",
    "kg_sq_train": "SELECT (i - 1)::INT AS dim, min(embedding[i]) AS lo, max(embedding[i]) AS hi FROM embeddings, range(1, 65) r(i) GROUP BY i",
}
