"""Network metrics that go on until they are done, against numpy."""

from datetime import datetime

import numpy as np
import pytest

from graphloom.operators import netmetrics


def leading(edges):
    nodes = sorted({n for e in edges for n in e})
    matrix = np.zeros((len(nodes), len(nodes)))
    for a, b in edges:
        matrix[nodes.index(a), nodes.index(b)] = matrix[nodes.index(b), nodes.index(a)] = 1
    vector = np.abs(np.linalg.eigh(matrix)[1][:, -1])
    return dict(zip(nodes, vector.tolist(), strict=True))


#: A hub with a tail, and a star, which has two sides.
GRAPHS = [[(1, 2), (1, 3), (1, 4), (2, 3), (4, 5), (5, 6), (6, 7)], [(0, 1), (0, 2), (0, 3), (0, 4)]]


@pytest.mark.parametrize("edges", GRAPHS)
def test_centrality_converges(spark, edges):
    got = {r.node: r.centrality for r in netmetrics.eigenvector_centrality(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == pytest.approx(leading(edges), abs=2e-3)
    assert netmetrics.eigenvector_centrality(spark.createDataFrame([], "a long, b long")).collect() == []


def test_centrality_tells_whether_it_converged(spark):
    edges = spark.createDataFrame(GRAPHS[0], "a long, b long")
    assert {r.converged for r in netmetrics.eigenvector_centrality(edges, most_rounds=3).collect()} == {False}
    assert {r.converged for r in netmetrics.eigenvector_centrality(edges).collect()} == {True}


def test_distances_over_a_path_of_ten_edges(spark):
    edges = [(k, k + 1, 1.0) for k in range(10)] + [(0, 10, 11.0), (20, 21, 1.0)]
    got = {r.node: (r.distance, r.path) for r in netmetrics.shortest_distances(spark.createDataFrame(edges, "a long, b long, cost double"), spark.createDataFrame([(0,)], "s long")).collect()}
    assert got == {k: (float(k), list(range(k + 1))) for k in range(11)}
    # a cheaper way of more edges takes the place of a dear one, and repeated edges count once
    edges = [("a", "c", 5.0), ("a", "b", 1.0), ("b", "c", 1.0), ("b", "c", 9.0)]
    got = {r.node: (r.distance, r.path) for r in netmetrics.shortest_distances(spark.createDataFrame(edges, "a string, b string, cost double"), spark.createDataFrame([("a",)], "s string")).collect()}
    assert got == {"a": (0.0, ["a"]), "b": (1.0, ["a", "b"]), "c": (2.0, ["a", "b", "c"])}
    assert netmetrics.shortest_distances(spark.createDataFrame([], "a long, b long, cost double"), spark.createDataFrame([], "s long")).collect() == []


def test_history_of_five_years(spark):
    rows = [(1, "x", "a", "b", datetime(2015, 1, 1)), (2, "x", "a", "b", datetime(2019, 12, 31)), (3, "x", "a", "b", datetime(2025, 1, 1)), (4, "y", "a", "b", datetime(2020, 1, 2)), (5, "x", "a", "b", datetime(2025, 1, 1))]
    dated = spark.createDataFrame(rows, "job_id long, industry string, c1 string, c2 string, posted_at timestamp")
    assert {r.job_id: r.creation for r in netmetrics.creation_vs_history(dated).collect()} == {1: 1.0, 2: 0.0, 3: 1.0, 4: 1.0, 5: 1.0}
    assert {r.job_id: r.creation for r in netmetrics.creation_vs_history(dated, "INTERVAL 60 DAYS").collect()} == {k: 1.0 for k in range(1, 6)}
