"""Cases of the operators whose results are known."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions.text import split_list
from graphloom.functions.vectors import clipped_cosine
from graphloom.operators import ingest, linkage, monitor, traverse, vector_search


@pytest.mark.parametrize(("a", "b", "want"), [([1.0, 2.0], [1.0, 2.0], 1), ([1.0, 0.0], [0.0, 1.0], 0), ([1.0, 0.0], [-1.0, 0.0], 0), ([0.0, 0.0], [1.0, 0.0], 0)])
def test_cosine(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    assert df.select(clipped_cosine(F.col("a"), F.col("b"))).first()[0] == pytest.approx(want)


def test_knn_graph_leaves_out_self_and_weak_pairs(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "id long, v array<double>")
    assert sorted((r.src, r.dst) for r in vector_search.knn_graph(vectors, 0.7, 5).collect()) == [(1, 2), (2, 1)]


def test_nearest_is_exact_over_tiles_blocks_ties_and_odd_vectors(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(vector_search, "TILE_ROWS", 7)
    monkeypatch.setattr(vector_search, "TILE_COLUMNS", 11)
    x = np.random.default_rng(3).integers(-2, 3, (120, 4)).astype(float)
    x[5] = 0
    x[7, 1] = np.nan
    length = np.linalg.norm(x, axis=1, keepdims=True)
    unit = np.divide(x, length, out=np.zeros_like(x), where=length > 0)
    vectors = spark.createDataFrame([(k, [float(c) for c in row]) for k, row in enumerate(x)] + [(200, None)], "id long, v array<double>")
    for threshold, clipped, others in ((0.3, True, True), (None, True, True), (None, False, True), (-0.2, False, False), (0.99, True, False)):
        score = unit @ unit.T
        score = np.clip(score, 0, 1) if clipped else score
        want = {}
        for k, row in enumerate(score):
            ok = [(round(-s, 9), j) for j, s in enumerate(row) if s > (-np.inf if threshold is None else threshold) and not (others and j == k)]
            want |= {(k, n): s for n, (s, j) in enumerate(sorted(ok)[:4])}
        for block_rows in (None, 30):
            found = vector_search.nearest(vectors, vectors, threshold, 4, block_rows, others, clipped).collect()
            lists = {k: sorted(round(-r.score, 9) for r in found if r.src == k) for k in range(120)}
            assert {(k, n): s for k, row in lists.items() for n, s in enumerate(row)} == want
            assert len({(r.src, r.dst) for r in found}) == len(found) == len(want)
    plan = vector_search.knn_graph(vectors.where("v IS NOT NULL"), 0.3)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan


def test_khop_grows_with_depth(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 1)], "src long, dst long")
    seeds = spark.createDataFrame([(1,)], "id long")
    sizes = [traverse.khop(edges, seeds, depth).count() for depth in (1, 2, 3)]
    assert sizes == sorted(sizes) and sizes[0] < sizes[2]


@pytest.mark.parametrize(
    ("name", "taxonomy", "want"),
    [
        ("Python", ["Python"], ("exact", "python", 1.0, None)), ("pyton", ["Python", "React"], ("fuzzy", "python", 0.9, None)), ("pythn3", ["Python"], ("fuzzy", "python", 0.8, None)),
        ("pyton", ["Python", "Cython"], ("orphan", None, None, "ambiguous_fuzzy_match")), ("NewFramework2025", ["Python"], ("orphan", None, None, "no_match")), ("c", ["c"], ("orphan", None, None, "too_short")),
        ("Reactjs", ["React", "ReactJS"], ("exact", "reactjs", 1.0, None)),
    ],
)
def test_linkage(spark, name, taxonomy, want):
    names, known = spark.createDataFrame([(name,)], "name string"), spark.createDataFrame([(t,) for t in taxonomy], "name string")
    row = linkage.link(names, known).first()
    assert (row.match_type, row.matched, row.confidence and round(row.confidence, 6), row.reason) == want


def test_second_upsert_changes_nothing(spark):
    old = spark.createDataFrame([("a", 1, 1, 1), ("b", 2, 1, 1)], "id string, x int, created_at int, updated_at int")
    new = spark.createDataFrame([("a", 5), ("c", 3)], "id string, x int")
    assert {r.id: r.action for r in ingest.actions(old, new, "id", ["x"]).collect()} == {"a": "updated", "c": "created"}
    once = ingest.upsert(old, new, "id", ["x"], F.lit(2))
    assert sorted(map(tuple, once.collect())) == [("a", 5, 1, 2), ("b", 2, 1, 1), ("c", 3, 2, 2)]
    assert {r.action for r in ingest.actions(once, new, "id", ["x"]).collect()} == {"unchanged"}
    assert sorted(map(tuple, ingest.upsert(once, new, "id", ["x"], F.lit(3)).collect())) == sorted(map(tuple, once.collect()))


def test_list_cells(spark):
    cells = ["Python, FastAPI", '["a","b"]', "NULL", "", None]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cells], "c string").select(split_list(F.col("c"))).collect()]
    assert got == [["Python", "FastAPI"], ["a", "b"], [], [], []]


def test_moving_average(spark):
    values, ema = [10.0, 20.0, 5.0, 7.0], 10.0
    for v in values[1:]:
        ema = 0.3 * v + 0.7 * ema
    df = spark.createDataFrame([("u", v, k, k) for k, v in enumerate(values)], "u string, v double, t int, k int")
    assert monitor.moving_average(df, "u", "v", "t", "k").first().ema == pytest.approx(ema)


def test_full_load_needs_its_confirmation(spark):
    df = spark.range(1)
    with pytest.raises(ValueError, match="CONFIRM DELETE"):
        ingest.replace_all(df, df, "yes")
