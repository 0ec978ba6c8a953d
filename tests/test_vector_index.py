"""The inverted-list index and text vectors against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.operators import text_vectors, vector_index, vector_search
from graphloom.plans import registry
from graphloom.sources.domain import Graph

SF = "/root/testdata/sf0.1"


def test_knn_graph_by_lists_has_the_recall_it_is_tuned_to(spark):
    exact = vector_search.knn_graph(Graph(spark, SF).vectors(), 0.3).withColumn("score", F.round("score", 6)).cache()
    found = registry.QUERIES["knn_graph_indexed"](spark, SF).cache()
    assert vector_index.recall(found, exact) >= 0.9
    # what is found has exact scores: where both have a pair, they agree
    both = exact.join(found.withColumnRenamed("score", "other"), ["src", "dst"])
    assert both.where(F.abs(F.col("score") - F.col("other")) > 1.1e-6).count() == 0
    assert found.groupBy("src").count().agg(F.max("count")).first()[0] <= 5 and found.where("score <= 0.3 OR src = dst").count() == 0


def test_topk_by_lists_for_a_table_of_queries(spark):
    vectors = Graph(spark, SF).vectors()
    exact = vector_search.nearest(vectors.where("id % 100 = 0"), vectors, None, 25, clipped=False)
    found = registry.QUERIES["vector_topk_indexed"](spark, SF)
    assert vector_index.recall(found, exact) >= 0.9
    assert found.count() == 25 * vectors.where("id % 100 = 0").count()


def test_rows_moved_grow_with_the_table_and_the_probes(spark):
    """Clustered vectors: few lists are enough, and a query is copied to those only."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + 0.1 * rng.normal(size=16)).tolist()) for i in range(4000)]
    vectors = spark.createDataFrame(rows, "id long, v array<double>")
    index = vector_index.build(vectors)
    probes = vector_index.tune(index, 5)
    assert probes <= len(index.centroids) / 8
    found = vector_index.search(index, vectors, 5, probes, 0.5, others=True)
    exact = vector_search.nearest(vectors, vectors, 0.5, 5, others=True, clipped=False)
    assert vector_index.recall(found, exact) >= 0.9


def test_all_lists_give_the_exact_result_in_small_cells(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "LIST_ROWS", 7)
    monkeypatch.setattr(vector_index, "QUERY_ROWS", 5)
    vectors = Graph(spark, "/root/testdata/sf0.001").vectors()
    index = vector_index.build(vectors, 6)
    found = vector_index.search(index, vectors, 5, 99, 0.3, others=True, clipped=True)
    pairs = lambda df: {(r.src, r.dst, round(r.score, 9)) for r in df.collect()}
    assert pairs(found) == pairs(vector_search.knn_graph(vectors, 0.3))


def test_a_query_is_moved_once_for_a_cell_of_lists(spark):
    """Vectors without clusters: most lists are needed, and a query is copied to the cells that hold them, not to each list."""
    rows = [(i, row.tolist()) for i, row in enumerate(np.random.default_rng(4).normal(size=(3000, 16)))]
    index = vector_index.build(spark.createDataFrame(rows, "id long, v array<double>"))
    sizes = dict(index.rows.groupBy("list").count().collect())
    cell_of = vector_index.cells_of(sizes, index.centroids, 512)
    held = np.bincount(cell_of, [sizes.get(k, 0) for k in range(len(cell_of))])
    assert held.sum() == 3000 and held.max() <= 512 and len(held) <= 3 * 3000 / 512 < len(index.centroids) / 2
    found = vector_index.search(index, index.rows.select("id", "v"), 5, len(index.centroids), others=True)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "list" not in plan[: plan.index("FlatMapGroupsInArrow") + 60] and "cell" in plan
    exact = vector_search.nearest(index.rows.select("id", "v"), index.rows.select("id", "v"), None, 5, others=True, clipped=False)
    assert vector_index.recall(found, exact) == 1.0


def test_odd_vectors_saved_and_loaded(spark, tmp_path):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [None, 1.0]), (9, [1e300, 1e300]), (2, [3.0, 0.0])]
    vectors = spark.createDataFrame(rows, "id long, v array<double>")
    index = vector_index.build(vectors, 2)
    assert sorted(r.id for r in index.rows.collect()) == [1, 2, 2, 3, 9]
    vector_index.save(index, str(tmp_path / "index"))
    again = vector_index.load(spark, str(tmp_path / "index"))
    for one in (index, again):
        found = vector_index.search(one, vectors.where("id IN (1, 4, 7)"), 3, 2)
        assert [(r.src, r.dst, round(r.score, 9)) for r in found.orderBy("src", F.desc("score"), "dst").collect()][:2] == [(1, 1, 1.0), (1, 2, 1.0)]
        assert {r.src for r in found.collect()} == {1}
    empty = vector_index.build(vectors.limit(0))
    assert vector_index.search(empty, vectors, 3, 2).count() == 0 and vector_index.tune(empty, 5) == 1


# --- text vectors ---


def plain_features(text):
    counts, half = Counter(), text_vectors.BUCKETS // 2
    mask = (1 << 64) - 1

    def mix(x):
        x = ((x ^ (x >> 33)) * 0xFF51AFD7ED558CCD) & mask
        return x ^ (x >> 29)

    for word in re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").lower().encode()):
        h = 0
        for k, b in enumerate(word, 1):
            h = (h + (b + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64)) & mask
        counts[mix(h) % half] += 1
        padded = b" " + word + b" "
        for k in range(len(word)):
            a, b, c = padded[k : k + 3]
            counts[half + mix((((a << 16) | (b << 8) | c) * 0xC2B2AE3D27D4EB4F) & mask) % half] += 1
    return counts


TEXTS = ["Data scientists know Python, SQL and R2-D2.", "", None, " \t...", "Ärzte & Pflegekräfte", "data data DATA", "x", "word " * 3000]


def test_features_equal_a_plain_version():
    rows, buckets, counts = text_vectors.features(pa.array(TEXTS))
    found = [Counter() for _ in TEXTS]
    for r, b, n in zip(rows.tolist(), buckets.tolist(), counts.tolist(), strict=True):
        found[r][b] = n
    assert found == [plain_features(t) for t in TEXTS]


@pytest.mark.parametrize("size", [1, 40, 1 << 20])
def test_vectors_are_the_same_however_texts_are_cut(spark, monkeypatch, size):
    monkeypatch.setattr(text_vectors, "SLICE", size)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").repartition(3)
    rows = {r.id: r.v for r in text_vectors.embed_texts(df).collect()}
    df_of = Counter(b for t in TEXTS for b in plain_features(t))
    weight = lambda b: math.log(1 + len(TEXTS) / (1 + df_of[b]))
    for i, text in enumerate(TEXTS):
        assert len(rows[i]) == 384
        length = math.sqrt(sum(x * x for x in rows[i]))
        assert math.isclose(length, 1.0) if plain_features(text) else length == 0
        counts = plain_features(text)
        b = np.array(sorted(counts), np.int64)
        value = text_vectors.project(np.zeros(len(b), np.int64), b, np.array([counts[k] for k in b]), np.array([weight(k) for k in range(text_vectors.BUCKETS)]), 1)
        assert np.allclose(value[0], rows[i], atol=1e-12)


def test_like_texts_have_high_cosines(spark):
    texts = ["python developer with sql", "senior python developers and SQL", "pastry chef in a hotel", "hotel pastry chefs"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    v = {r.id: np.array(r.v) for r in text_vectors.embed_texts(df).collect()}
    assert v[0] @ v[1] > 0.4 and v[2] @ v[3] > 0.4 and max(abs(v[a] @ v[b]) for a in (0, 1) for b in (2, 3)) < 0.25


def test_intents_and_entities_of_all_questions(spark):
    small = "/root/testdata/sf0.001"
    asked = registry.index_queries.asked(spark, small)
    turns = {r.id for r in asked.where("id LIKE 'turn-%'").collect()}
    intents = registry.QUERIES["refined_intents_text"](spark, small).collect()
    first = {r.id: r.intent for r in intents if r.rank == 1}
    # the forms that are made from parts: "... similar to ..." and "How to become a data scientist ..."
    assert all(first[f"part-{k}"] == "skill_relationship" for k in range(8, 200, 8)) and all(first[f"part-{k}"] == "career_path" for k in range(2, 200, 8))
    entities = registry.QUERIES["ranked_entities_text"](spark, small).collect()
    assert {r.origin for r in entities} == {"semantic", "pattern"}
    names = {f"part-{r.p_partkey}": r.p_name for r in spark.read.parquet(f"{small}/part.parquet").collect()}
    # a question that is a part's name and nothing else finds that part
    assert all(any(r.id == f"part-{k}" and r.value == names[f"part-{k}"].lower() and r.confidence == 0.95 for r in entities) for k in range(6, 200, 8))
    assert not {r.id for r in entities if r.origin == "semantic" and r.id in turns and r.confidence > 0.9}
    scores = [r.score for r in registry.QUERIES["semantic_intents_text"](spark, small).collect()]
    assert scores and min(scores) >= 0.65
