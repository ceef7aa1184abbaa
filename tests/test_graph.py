"""Golden values on a small graph, edge cases, and a plain model of the search."""

from __future__ import annotations

import random

import numpy as np
import pytest

from graphloom import registry
from graphloom.operators import analytics, quant, traversal, vector
from graphloom.operators.graph import ENTITY_SCHEMA, RELATION_SCHEMA, KnowledgeGraph
from graphloom.operators.linkage import connected_components
from graphloom.plans import shared
from graphloom.sources import tables

REL = "id long, source_id long, target_id long, rel_type string, weight double"


def graph(spark, edges, entities=()):
    rows = [(i + 1, s, t, r, w) for i, (s, t, r, w) in enumerate(edges)]
    return KnowledgeGraph(spark.createDataFrame([(e, "t", f"n{e}") for e in entities], "id long, entity_type string, name string"), spark.createDataFrame(rows, REL))


@pytest.fixture(scope="module")
def seed(spark):
    return graph(spark, [(1, 2, "reports_to", 1.0), (3, 2, "reports_to", 1.0), (1, 4, "works_at", 1.0), (2, 4, "works_at", 1.0), (3, 5, "works_at", 1.0), (4, 5, "partners_with", 0.5)], range(1, 6))


def test_golden(seed):
    assert [tuple(r) for r in traversal.bfs(seed, 1, 3).collect()] == [(1, 0, None, None, 0.0), (2, 1, 1, "reports_to", 1.0), (4, 1, 1, "works_at", 1.0), (5, 2, 4, "partners_with", 0.5)]
    assert [tuple(r) for r in traversal.bfs(seed, 99, 3).collect()] == [(99, 0, None, None, 0.0)]
    assert [(r.entity_id, r.depth) for r in traversal.dfs(seed, 1, 3).collect()] == [(1, 0), (2, 1), (4, 2), (5, 3)]
    path = traversal.shortest_path(seed, 1, 5, 5).head()
    assert (path.found, path.hops, path.total_cost, [p.entity_id for p in path.path]) == (True, 2, 1.5, [1, 4, 5])
    assert not traversal.shortest_path(seed, 1, 3, 5).head().found
    score = {r.entity_id: r.score for r in analytics.pagerank(seed).collect()}
    assert score[5] == pytest.approx(0.367166, abs=1e-6) and sum(score.values()) == pytest.approx(1)
    assert {r.community_id for r in analytics.louvain(seed).collect()} == {0}
    assert analytics.louvain(seed).head().modularity == pytest.approx(0.483471, abs=1e-6)
    assert {r.component_id for r in analytics.connected_components(seed).collect()} == {0}
    assert sorted(tuple(r) for r in analytics.strongly_connected_components(seed).collect()) == [(i + 1, i) for i in range(5)]


def test_empty(spark):
    g = KnowledgeGraph(spark.createDataFrame([], ENTITY_SCHEMA), spark.createDataFrame([], RELATION_SCHEMA))
    for out in (traversal.bfs(g, 1, 3), traversal.dfs(g, 1, 3), analytics.pagerank(g), analytics.louvain(g), analytics.connected_components(g), analytics.strongly_connected_components(g), vector.vector_search(g, [1.0], 5), vector.vector_search(g, [], 5), quant.quantized_search(g, [0.1] * 4, 5), quant.quantized_search(g, [0.1], 0)):
        assert out.count() == 0
    assert traversal.context(g, 999, 2).head().total_nodes == 0
    assert traversal.shortest_path(g, 7, 7, 3).head().found
    assert g.stats().head().density == 0.0


def test_edge_cases(spark):
    g = graph(spark, [(1, 2, "a", 1.0), (1, 4, "a", 1.0), (2, 3, "a", 1.0), (3, 4, "a", 1.0), (4, 5, "a", 1.0), (1, 2, "b", 2.0), (1, 1, "c", 1.0)], [9])
    assert [r.entity_id for r in traversal.dfs(g, 1, 3).collect()] == [1, 2, 3, 4]
    assert [r.entity_id for r in traversal.dfs(g, 1, 2).collect()] == [1, 2, 3, 4, 5]
    assert [r.rel_type for r in traversal.bfs(g, 1, 1).collect()] == [None, "a", "a"]
    assert traversal.bfs(g, 1, -1).count() == traversal.bfs(g, 1, 0).count() == 1
    assert analytics.connected_components(g).where("entity_id = 9").head().component_id == 1
    assert analytics.louvain(g).where("entity_id = 9").isEmpty()
    cycle = graph(spark, [(1, 2, "a", 1.0), (2, 1, "a", 1.0), (2, 3, "a", 1.0)])
    assert sorted(tuple(r) for r in analytics.strongly_connected_components(cycle).collect()) == [(1, 0), (2, 0), (3, 1)]


def test_contraction(spark):
    random.seed(3)
    pairs = [(random.randrange(400), random.randrange(400)) for _ in range(350)] + [(1000, k) for k in range(1001, 1100)] + [(2000 + k, 2001 + k) for k in range(60)]
    parent = {x: x for p in pairs for x in p}
    for _ in range(100):
        for a, b in pairs:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = connected_components(spark.createDataFrame(pairs, "a long, b long"), finish_at=10)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert {r.node: r.component for r in got.collect()} == {x: parent[x] for x in linked}


def test_long_chains_and_rings(spark, monkeypatch):
    rounds = []
    one = analytics._merge_round
    monkeypatch.setattr(analytics, "_merge_round", lambda *a: rounds.append(1) or one(*a))
    ring = [(i, (i + 1) % 600, "a", 1.0) for i in range(600)]
    chain = [(i, i + 1, "a", 1.0) for i in range(600, 1200)]  # from the ring's tail on, without a way back
    tree = [(2000 + i // 2, 2000 + i, "a", 1.0) for i in range(1, 400)]
    g = graph(spark, [*ring, (7, 600, "a", 1.0), *chain, *tree, (2399, 2350, "a", 1.0)], range(3000))
    got = {r.id: r.root for r in analytics.strong_roots(g).collect()}
    assert len(got) == 3000 and {got[i] for i in range(600)} == {0}
    assert all(got[i] == i for i in range(600, 3000))
    assert len(rounds) <= 40


@pytest.mark.parametrize("seed", range(4))
def test_strong_components_of_sparse_graphs(spark, seed):
    random.seed(seed)
    pairs = {(random.randrange(40), random.randrange(40)) for _ in range(38 + 6 * seed)}
    reach = {v: {v} for v in range(40)}
    for _ in range(40):
        for a, b in pairs:
            reach[a] |= reach[b]
    want = {v: min(u for u in reach[v] if v in reach[u]) for v in range(40)}
    got = {r.id: r.root for r in analytics.strong_roots(graph(spark, [(a, b, "a", 1.0) for a, b in sorted(pairs)], range(40))).collect()}
    assert got == want


def test_quantizers(spark):
    v = (np.arange(16) + 1) / 16
    for level, least in (("int8", 0.99), ("int4", 0.95), ("binary", 0.6)):
        q = quant.FreeQuantizer(16, level, 42)
        assert q.cosine_similarity(q.quantize(v), v) > least
        assert len(q.quantize(v)["data"]) == 16 * quant.BITS[level] // 8
    with pytest.raises(quant.QuantizationError, match="ConstantVector"):
        quant.FreeQuantizer(4).quantize([0, 0, 0, 0])
    assert quant.parse_level("8BIT") == "int8" and quant.parse_level("unknown") == "int8"
    rows = [([(10 * i + j) / 1000 for j in range(10)],) for i in range(100)]
    t = quant.TrainedQuantizer("int8").fit(spark.createDataFrame(rows, "embedding array<float>"))
    got = t.decode(t.quantize(rows[42][0]))
    assert np.abs(got - rows[42][0]).max() <= 1.5 * 0.99 / 255
    for bad, kind in (([], "EmptyInput"), ([([1.0],), ([1.0, 2.0],)], "DimensionMismatch"), ([([float("nan")],)], "InvalidVector")):
        with pytest.raises(quant.QuantizationError, match=kind):
            quant.TrainedQuantizer("int8").fit(spark.createDataFrame(bad, "embedding array<float>"))
    with pytest.raises(quant.QuantizationError, match="NotTrained"):
        quant.TrainedQuantizer("int8").quantize([1.0])


def test_codes_of_odd_vectors(spark):
    rows = [(0, None), (1, []), (2, [1.0, 2.0, None]), (3, [0.0, 0.0, 0.0]), (4, [float("inf"), 1.0, 1.0]), (5, [1.0, 2.0]), (6, [1.0, 2.0, 3.0]), (6, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "id int, embedding array<float>")
    for level, width in (("int8", 3), ("int4", 2), ("binary", 1)):
        q = quant.FreeQuantizer(3, level)
        got = quant.score(quant.encode(df, 3, level), [1, 2, 3], level).collect()
        assert [r.id for r in got if r.quantized] == [6, 6] == [r.id for r in got if r.similarity is not None]
        assert all(len(r.quantized.data) == width and bytes(r.quantized.data) == q.quantize([1, 2, 3])["data"] for r in got if r.quantized)
        assert all(abs(r.similarity - q.cosine_similarity(q.quantize([1, 2, 3]), [1, 2, 3])) < 1e-6 for r in got if r.quantized)
        t = quant.TrainedQuantizer(level).fit(df.where("id > 5").unionByName(spark.createDataFrame([(7, [0.0, 5.0, 4.0])], df.schema)))
        assert t.size_bytes(3) == width
        got = t.score(t.encode(df), [1, 2, 3]).collect()
        assert [r.id for r in got if r.quantized] == [3, 6, 6] == [r.id for r in got if r.score]
        one = t.quantize([1, 2, 3])
        assert all(bytes(r.quantized.data) == one["data"] and abs(r.score.dot_product - t.dot_product(one, [1, 2, 3])) < 1e-9 and abs(r.score.cosine_distance - t.cosine_distance(one, [1, 2, 3])) < 1e-6 for r in got[-2:])
        assert got[3].score.cosine_distance == 1.0
    assert [r.similarity for r in quant.score(quant.encode(df, 3), [1, 2]).collect() if r.similarity] == []
    found = vector.vector_search(KnowledgeGraph(df.where("size(embedding) = 3").selectExpr("id", "'a' entity_type", "'b' name", "embedding"), None), [1, 2, 3], 9).collect()
    assert [(r.entity_id, round(r.similarity, 9)) for r in found] == [(6, 1), (6, 1), (2, 0), (3, 0), (4, 0)]


def test_recall_of_all_queries(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=64).tolist(), 1) for i in range(15, 81)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    v = tables.vectors(spark, str(tmp_path))
    graph, want = KnowledgeGraph(v, None), []
    for r in v.where("id % 20 = 0").collect():
        exact, codes = ({x.entity_id for x in run(graph, r.embedding, 10).collect()} for run in (vector.vector_search, quant.quantized_search))
        want.append(len(exact & codes) / 10)
    assert len(want) == 4
    got = {r.level: r.recall for r in registry.QUERIES["kg_recall_at_10"](spark, str(tmp_path)).collect()}
    assert set(got) == set(quant.BITS) and got["int8"] == round(sum(want) / 4, 6)
    assert abs(quant.search_recall(v, v.id % 20 == 0, 10, block=3).head()[0] - sum(want) / 4) < 1e-9


def test_equal_codes_tie():
    rng = np.random.default_rng(6)
    q = quant.FreeQuantizer(64, "binary")
    for n in (1, 2, 3, 5, 7, 4099):
        x = np.repeat(rng.normal(size=(1, 64)), n, axis=0)
        y, query = q.codebook[quant.unpack(q.encode(x)[0], 1, 64)[0]], rng.normal(size=64).astype(np.float32).astype(float)
        one = 0.0
        for a, b in zip(y, q.signs * query, strict=True):
            one += a * b
        norm = q.encode(x)[1][0]
        size = np.sqrt(np.cumsum(query * query)[-1])
        assert set(q.similarity(*q.encode(x), query.tolist())) == {one * (norm / 8) / (size * norm)}


def test_recall_of_blocks_in_many_partitions(spark):
    rng = np.random.default_rng(4)
    v = spark.createDataFrame([(i, rng.normal(size=16).tolist()) for i in range(200)], "id long, embedding array<float>")
    recall = lambda block: quant.search_recall(v, v.id % 20 == 0, 10, "binary", block=block).head()[0]
    whole = recall(4096)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # which puts small blocks into one partition
    try:
        assert 0 < whole == pytest.approx(recall(4096)) == pytest.approx(recall(30)) == pytest.approx(recall(3))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_pagerank_against_a_matrix(spark):
    random.seed(8)
    edges = [(random.randrange(60), random.randrange(60), "a", 1.0) for _ in range(150)]
    g = graph(spark, edges, range(70))
    m = np.zeros((70, 70))
    for a, b, *_ in edges:
        m[b, a] += 1
    out = m.sum(axis=0)
    p = np.full(70, 1 / 70)
    for _ in range(100):
        new = 0.15 / 70 + 0.85 * (m @ np.where(out > 0, p / np.maximum(out, 1), 0) + p[out == 0].sum() / 70)
        done = np.abs(new - p).sum() < analytics.TOLERANCE
        p = new
        if done:
            break
    got = {r.entity_id: r.score for r in analytics.pagerank(g).collect()}
    assert np.allclose([got[i] for i in range(70)], p, atol=1e-12)


def test_communities_of_millions_of_links(spark):
    edges = spark.range(1_050_000).selectExpr("id", "id div 1000 source_id", "5000 + id % 1000 target_id", "'a' rel_type", "1.0D weight")
    got = analytics.louvain(KnowledgeGraph(None, edges), sweeps=1).agg({"entity_id": "count", "community_id": "max"}).head()
    assert got["count(entity_id)"] == 2050 and got["max(community_id)"] is not None


@pytest.mark.parametrize("standard", [False, True])
def test_communities_against_a_plain_sweep(spark, monkeypatch, standard):
    monkeypatch.setattr(analytics, "LOUVAIN_BATCH", 7)
    random.seed(5)
    edges = [(random.randrange(0, 90, 3), random.randrange(0, 90, 3), "a", float(random.randrange(1, 9))) for _ in range(120)]
    near, m = {}, sum(w for *_, w in edges)
    for a, b, _, w in edges:
        for s, t in ((a, b), (b, a)):
            near.setdefault(s, {})[t] = near.setdefault(s, {}).get(t, 0.0) + w
    own, size = {v: v for v in near}, {v: sum(near[v].values()) for v in near}
    for _ in range(100):
        before = dict(own)
        for v in sorted(near):
            total = lambda c: sum(size[u] for u in near if own[u] == c)
            to = lambda c: sum(w for u, w in near[v].items() if own[u] == c)
            k, c = size[v], own[v]
            leave = -to(c) / m + (total(c) - k) * k / (2 * m * m)
            best, best_c = (0.0 if standard else leave), c
            for o in sorted({own[u] for u in near[v]} - {c}):
                gain = to(o) / m - total(o) * k / (2 * m * m) + (leave if standard else -leave)
                if gain > best:
                    best, best_c = gain, o
            own[v] = best_c
        if own == before:
            break
    names = {}
    want = {v: names.setdefault(own[v], len(names)) for v in sorted(near)}
    got = analytics.louvain(graph(spark, edges), standard_gain=standard)
    assert {r.entity_id: r.community_id for r in got.collect()} == want and len(names) > 1


def test_text_vectors(spark):
    rows = [(1, "[1, 2]"), (2, "1,2"), (3, " [0.5 , 1e1] "), (4, "1,x"), (5, ""), (6, None), (7, "[]")]
    g = KnowledgeGraph(spark.createDataFrame(rows, "id long, embedding string"), None)
    assert {r.id: r.embedding for r in g.entities.collect()} == {1: [1, 2], 2: [1, 2], 3: [0.5, 10], 4: None, 5: None, 6: None, 7: None}
    assert vector.as_vector("1,2") == vector.as_vector("[1, 2]") == [1.0, 2.0] and vector.as_vector("[]") == []


def test_shared_folder_of_a_cluster():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: default)

        class sparkContext:  # noqa: N801
            master, applicationId = "spark://host:7077", "x"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session)
