"""The same rows whether a list is small enough for the short way or not."""

import pytest
from pyspark.sql import functions as F

from graphloom.llm import frames, graph, licenses


@pytest.mark.parametrize("most", [8 << 20, 0])
def test_dropped_rows_broadcast_and_joined(spark, monkeypatch, most):
    monkeypatch.setattr(frames, "BROADCAST_NAMES", most)
    rows = [(1, "a"), (1, "b"), (1, "a"), (None, "c"), (2, None), (3, ""), (None, None), (4, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gone = df.where("doc_id = 1 AND text = 'a' OR doc_id IS NULL OR doc_id = 2").select("doc_id", F.xxhash64("text").alias("text_key"))
    assert sorted(map(tuple, frames.drop_rows(df, gone, "doc_id", "text").collect())) == [(1, "b"), (3, ""), (4, "a")]
    assert frames.drop_rows(df, gone.limit(0), "doc_id", "text").count() == len(rows)


@pytest.mark.parametrize("most", [50_000, 7])
def test_components_in_one_task_and_many(spark, monkeypatch, most):
    monkeypatch.setattr(graph, "TASK_EDGES", most)
    edges = [(k, k + 3) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (100, 101)]
    found = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert found == {k: k % 3 for k in range(63)} | {k: 100 for k in range(100, 160)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).isEmpty()


@pytest.mark.parametrize("most", [8 << 20, 0])
def test_license_spans_broadcast_and_joined(spark, monkeypatch, most):
    monkeypatch.setattr(frames, "BROADCAST_NAMES", most)
    text = f"x {licenses.TEMPLATES['mit']} y"
    rows = [(1, text), (1, "plain"), (1, text), (None, text), (2, None), (3, ""), (4, "under the mit license")]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, [s.label for s in r.spans], r.base_labels) for r in found) == [(0, ["mit"], []), (1, [], []), (1, ["mit"], []), (1, ["mit"], []), (2, [], []), (3, [], []), (4, ["mit"], ["mit"])]


def test_large_rows_are_written_few_together(spark):
    import pyarrow.parquet as pq

    from graphloom.llm import phrases

    table = frames.write_shared(spark.range(50).repartition(2), phrases.TOGETHER)
    groups = [g for f in table.inputFiles() for m in [pq.ParquetFile(f.removeprefix("file:")).metadata] for g in (m.row_group(k).num_rows for k in range(m.num_row_groups))]
    assert sum(groups) == 50 and max(groups) <= phrases.TOGETHER
