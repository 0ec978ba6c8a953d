"""A stored graph: which buckets a load writes, and that a failed one changes nothing."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.sources.graph_store import Edges, Nodes, row_digest

SCHEMA = "id long, name string, level int"
AT = lambda day: F.lit(f"2024-03-{day:02}").cast("timestamp")


def nodes(spark, tmp_path, buckets=8):
    return Nodes(spark, str(tmp_path / "nodes"), "id", spark.createDataFrame([], SCHEMA).schema, buckets)


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_a_second_load_of_the_same_rows_writes_nothing(spark, tmp_path):
    store, rows = nodes(spark, tmp_path), [(i, f"n{i}", i) for i in range(100)]
    assert store.version() == 0 and store.rows().count() == 0
    assert store.load(table(spark, rows), AT(1)) == {"created": 100, "updated": 0, "unchanged": 0, "buckets": 8, "version": 1}
    before, at = row_digest(store), store.manifest()
    assert store.load(table(spark, rows), AT(2)) == {"created": 0, "updated": 0, "unchanged": 100, "buckets": 0, "version": 1}
    assert row_digest(store) == before and store.manifest() == at


def test_only_buckets_with_changes_are_written(spark, tmp_path):
    store, rows = nodes(spark, tmp_path), [(i, f"n{i}", i) for i in range(100)]
    store.load(table(spark, rows), AT(1))
    at = store.manifest()
    assert store.load(table(spark, [(5, "n5", 77), (6, "n6", 6), (None, "x", 1)]), AT(2)) == {"created": 0, "updated": 1, "unchanged": 1, "buckets": 1, "version": 2}
    after = store.manifest()
    assert sum(after[b] != at[b] for b in at) == 1
    found = {r.id: (r.name, r.level, r.created_at, r.updated_at) for r in store.rows().collect()}
    assert len(found) == 100 and found[5] == ("n5", 77, datetime(2024, 3, 1), datetime(2024, 3, 2)) and found[6][3] == datetime(2024, 3, 1)
    # the older version of that bucket can go
    assert store.vacuum() == 1 and store.rows().count() == 100 and store.vacuum() == 0


def test_a_load_that_fails_changes_nothing(spark, tmp_path):
    store = nodes(spark, tmp_path)
    store.load(table(spark, [(i, "a", i) for i in range(50)]), AT(1))
    before = row_digest(store)

    @F.udf(T.IntegerType())
    def broken(x):
        raise ValueError("no more")

    # it fails while the buckets are written: the new values are only computed there
    write = store._write
    store._write = lambda changed, touched: write(changed.withColumn("level", broken("level")), touched)
    with pytest.raises(Exception, match="no more"):
        store.load(table(spark, [(i, "b", i) for i in range(50)]), AT(2))
    again = nodes(spark, tmp_path)
    assert again.version() == 1 and row_digest(again) == before
    # and the next load is whole
    assert again.load(table(spark, [(i, "c", i) for i in range(50)]), AT(3))["updated"] == 50
    assert {r.name for r in again.rows().collect()} == {"c"}


def test_nodes_are_removed_and_a_bucket_may_become_empty(spark, tmp_path):
    store = nodes(spark, tmp_path, 3)
    store.load(table(spark, [(i, "a", i) for i in range(6)]), AT(1))
    assert store.remove(spark.createDataFrame([(i,) for i in (0, 1, 2, 3, 4, 5, 99, None)], "id long"))["removed"] == 6
    assert store.rows().count() == 0
    assert store.load(table(spark, [(1, "b", 1)]), AT(2))["created"] == 1 and [r.name for r in store.rows().collect()] == ["b"]


def test_repeated_keys_in_a_load_count_once(spark, tmp_path):
    store = nodes(spark, tmp_path)
    assert store.load(table(spark, [(1, "a", 1), (1, "b", 0), (1, "a", 2)]), AT(1))["created"] == 1
    assert [(r.name, r.level) for r in store.rows().collect()] == [("b", 0)]
    assert store.load(table(spark, []), AT(2)) == {"created": 0, "updated": 0, "unchanged": 0, "buckets": 0, "version": 1}


def test_edges_keep_the_properties_they_were_made_with(spark, tmp_path):
    kind = "src long, dst long, weight double"
    store = Edges(spark, str(tmp_path / "edges"), spark.createDataFrame([], kind).schema, buckets=4)
    frame = lambda rows: spark.createDataFrame(rows, kind)
    assert store.load(frame([(1, 2, 0.5), (1, 3, 0.1), (None, 3, 1.0)]))["created"] == 2
    assert store.load(frame([(1, 2, 0.9)])) == {"created": 0, "buckets": 0, "version": 1}
    assert store.load(frame([(1, 2, 0.9), (2, 1, 0.3)]))["created"] == 1
    assert sorted(tuple(r) for r in store.rows().collect()) == [(1, 2, 0.5), (1, 3, 0.1), (2, 1, 0.3)]
