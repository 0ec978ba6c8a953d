"""Paths between pairs against plain versions, on graphs with cycles."""

import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import lineage, netmetrics, paths, skillpaths, traverse


def simple_paths(links, start, goal, most):
    out, stack = [], [[start]]
    while stack:
        path = stack.pop()
        if path[-1] == goal and len(path) > 1:
            out.append(path)
        elif len(path) <= most:
            stack += [[*path, b] for a, b in links if a == path[-1] and b not in path]
    return sorted(out, key=lambda p: (len(p), p))


@pytest.mark.parametrize(("seed", "nodes", "edges", "k", "most"), [(1, 9, 30, 3, 5), (3, 7, 25, 5, 4)])
def test_k_shortest_on_graphs_with_cycles(spark, seed, nodes, edges, k, most):
    rng = random.Random(seed)
    links = sorted({(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(edges)})
    pairs = sorted({(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(8)})
    found = paths.k_shortest(spark.createDataFrame(links, "src long, dst long"), spark.createDataFrame([*pairs, pairs[0], (None, 1)], "start long, goal long"), k, most)
    got = {(r.start, r.goal, r.rank): (r.steps, r.path) for r in found.collect()}
    want = {(s, g, i): (len(p) - 1, p) for s, g in pairs if s != g for i, p in enumerate(simple_paths([x for x in links if x[0] != x[1]], s, g, most)[:k], 1)}
    assert got == want


def test_a_way_round_that_prefixes_hide(spark):
    """All short ways to 50 come through 3; the way from 50 to 3 must not be lost for that."""
    links = [(1, 2), (2, 3), (3, 4), (3, 5), (3, 6), (4, 50), (5, 50), (6, 50), (1, 7), (7, 8), (8, 9), (9, 50), (50, 3)]
    one = lambda n: spark.createDataFrame([(n,)], "id long")
    found = skillpaths.learning_paths(spark.createDataFrame(links, "src long, dst long"), one(1), one(3)).collect()
    assert [(r.rank, r.steps, r.path) for r in sorted(found, key=lambda r: r.rank)] == [(1, 2, [1, 2, 3]), (2, 5, [1, 7, 8, 9, 50, 3])]


def test_paths_from_many_starts_and_none(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (4, 3), (3, 1)], "src long, dst long")
    ids = lambda *n: spark.createDataFrame([(i,) for i in n], "id long")
    found = skillpaths.learning_paths(links, ids(1, 4), ids(3, 1, 9), shown=2)
    assert sorted((r.goal, r.rank, r.path) for r in found.collect()) == [(1, 1, [4, 3, 1]), (3, 1, [4, 3]), (3, 2, [1, 2, 3])]
    assert skillpaths.learning_paths(links.limit(0), ids(1), ids(3)).count() == 0
    assert skillpaths.learning_paths(links, ids(), ids(3)).count() == 0


def dijkstra(links, start):
    far, heap = {}, [(0.0, start)]
    while heap:
        d, n = heapq.heappop(heap)
        if n not in far:
            far[n] = d
            for a, b, c in links:
                if n in (a, b):
                    heapq.heappush(heap, (d + c, b if n == a else a))
    return far


@pytest.mark.parametrize(("seed", "landmarks"), [(1, 4), (2, 1)])
def test_pair_distances(spark, seed, landmarks):
    rng = random.Random(seed)
    side = 5
    at = lambda x, y: x * side + y
    links = [(at(x, y), at(*n), round(rng.uniform(0.5, 2), 3)) for x in range(side) for y in range(side) for n in ((x + 1, y), (x, y + 1)) if max(n) < side]
    links += [(500, 501, 1.0), (501, 502, 0.0), (0, 1, 99.0), (7, 7, 1.0)]
    pairs = [(rng.randrange(side * side), rng.randrange(side * side)) for _ in range(12)] + [(500, 502), (500, 3), (7, 7), (0, 1), (888, 1), (None, 1)]
    edges, asked = spark.createDataFrame(links, "a long, b long, cost double"), spark.createDataFrame(pairs, "a long, b long")
    distances, settled = paths.search_pairs(edges, asked, landmarks)
    got = {(r.a, r.b): round(r.distance, 9) for r in distances.collect()}
    want = {}
    for a, b in pairs:
        if a is not None and (a == b or b in dijkstra(links, a)):
            want[a, b] = round(0.0 if a == b else dijkstra(links, a)[b], 9)
    assert got == want
    # fewer rows are settled than by distances from every source to all nodes
    whole = netmetrics.shortest_distances(edges, asked.where("a IS NOT NULL").select("a"))
    assert settled.count() < 0.7 * whole.count()


def test_pairs_are_searched_without_distances_to_all_nodes(spark, monkeypatch):
    """No node's distances to the whole graph are made first, and the sides go little further than half way."""

    def whole(*_):
        raise AssertionError("distances to all nodes")

    monkeypatch.setattr(netmetrics, "shortest_distances", whole)
    links = [(n, n + 1, 1.0) for n in range(300)]
    distances, settled = paths.search_pairs(spark.createDataFrame(links, "a long, b long, cost double"), spark.createDataFrame([(100, 104), (5, 999)], "a long, b long"))
    assert [tuple(r) for r in distances.collect()] == [(100, 104, 4.0)]
    assert settled.count() <= 2 * 7 + 1


def test_learning_paths_broadcast_nothing(spark, monkeypatch):
    """Links taken to be small by their files, or tables of a few rows, are not sent to the driver in each round."""
    plans = []

    def written(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return lineage.cut_lineage(df)

    for module in (paths, traverse):
        monkeypatch.setattr(module, "cut_lineage", written)
    links = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4)], "src long, dst long")
    one = lambda n: spark.createDataFrame([(n,)], "id long")
    assert [r.path for r in skillpaths.learning_paths(links, one(1), one(4)).orderBy("rank").collect()] == [[1, 3, 4], [1, 2, 3, 4]]
    assert len(plans) > 10 and not any("Broadcast" in p for p in plans)


def test_progressions_equal_all_simple_paths(spark):
    rng = random.Random(9)
    steps = [(a, b, round(rng.random(), 2), rng.randrange(1, 6), rng.randrange(10) / 10) for a in range(8) for b in range(8) if a != b and rng.random() < 0.6]
    found = skillpaths.progressions(spark.createDataFrame(steps, "src long, dst long, frequency double, months long, difficulty double"), spark.createDataFrame([(0,), (1,)], "id long"), shown=7)
    best, now = [], [([s], 0, 0.0) for s in (0, 1)]
    for _ in range(3):
        now = [([*p, b], m + w, h + d) for p, m, h in now for a, b, f, w, d in steps if a == p[-1] and f > 0.2 and b not in p]
        best += now
    want = sorted((m, h / (len(p) - 1), p) for p, m, h in best)[:7]
    assert [(r.months, round(r.difficulty, 9), r.path) for r in found.collect()] == [(m, round(h, 9), p) for m, h, p in want]
    none = skillpaths.progressions(spark.createDataFrame(steps, "src long, dst long, frequency double, months long, difficulty double"), spark.createDataFrame([(99,)], "id long"))
    assert none.count() == 0


def test_substitutes_are_dealt_by_the_number_of_pairs(spark, monkeypatch):
    from graphloom.plans import path_queries

    monkeypatch.setattr(path_queries, "_TASK_PAIRS", 10)
    df = path_queries.substitutes(spark, "/root/testdata/sf0.001")
    assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()
    assert [r.score for r in df.where("src = 0").select("score").distinct().collect()] == [round(r.score, 6) for r in df.where("src = 0").select("score").distinct().collect()]


def test_closeness_looks_up_asked_pairs_only(spark, monkeypatch):
    """Parts 0, 7, 25 and 32 of one name: asked pairs get their substitution, and no others are made."""
    from graphloom.plans import registry
    from graphloom.sources.domain import Graph

    path_queries = registry.path_queries
    v = lambda k: [1.0, k / 100.0]
    tables = {
        "embeddings": spark.createDataFrame([(k, v(k)) for k in (0, 7, 25, 32, 50)], "vec_id long, embedding array<float>"),
        "part": spark.createDataFrame([(0, "x", "T", 1), (7, "x", "T", 4), (25, "x", "T", 1), (32, "x", "U", 1), (99, "x", "T", 1), (50, None, "T", 1)], "p_partkey long, p_name string, p_type string, p_size int").withColumn("p_brand", F.lit("b")),
    }
    monkeypatch.setattr(Graph, "table", lambda self, name: tables[name])
    monkeypatch.setattr(path_queries, "_substitutes", lambda g: pytest.fail("all pairs"))
    found = {(r.a, r.b): r.closeness for r in path_queries.closeness_blended(spark, "").collect()}
    cos = lambda a, b: float(np.dot(v(a), v(b)) / np.linalg.norm(v(a)) / np.linalg.norm(v(b)))
    # all are linked, as their vectors are alike; only 0 and 7 stand for each other, three levels apart
    assert found == {(a, b): pytest.approx(0.6 / (1 + round(1 - min(1.0, cos(a, b)), 6)) + 0.3 * cos(a, b) + more, abs=2e-6) for a, b, more in ((0, 7, 0.1 / 4), (25, 32, 0.0))}


def test_blocks_of_vectors_are_as_large_as_their_numbers_allow(spark, monkeypatch):
    from graphloom.operators import vector_search

    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(k, x[k].tolist()) for k in range(60)] + [(99, None)], "id long, v array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = unit @ unit.T
    want = {(a, b) for a in range(60) for b in sorted((b for b in range(60) if b != a and cos[a, b] > 0.3), key=lambda b: (-cos[a, b], b))[:3]}
    for numbers, blocks in ((1 << 22, 1), (8 * 20, 3)):
        monkeypatch.setattr(vector_search, "BLOCK_NUMBERS", numbers)
        found = vector_search.nearest(df, df, 0.3, 3, others=True)
        assert f"sequence(0, {blocks - 1}" in found._jdf.queryExecution().analyzed().toString()
        assert {(r.src, r.dst) for r in found.collect()} == want
