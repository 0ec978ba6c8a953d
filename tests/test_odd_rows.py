"""Nulls, ties, repeated keys and empty tables in operators of the core, with checked results."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions.text import and_others, lakhs, row_hash, truncated
from graphloom.operators import context, ingest, linkage, monitor, questions, skillpaths, traverse, vector_search
from graphloom.sources import csv_files
from graphloom.sources.tables import Records


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_repeated_keys_do_not_multiply_rows(spark):
    old = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "id int, x string")
    new = spark.createDataFrame([(1, "b"), (2, None), (3, "c")], "id int, x string")
    assert rows(ingest.actions(old, new, "id", ["x"]), "id", "action") == [(1, "unchanged"), (2, "unchanged"), (3, "created")]
    assert ingest.actions(old.limit(0), new.limit(0), "id", ["x"]).collect() == []


def test_row_hash_tells_values_apart(spark):
    df = spark.createDataFrame([("a\u001fvb", "c"), ("a", "b\u001fvc"), (None, ""), ("", None)], "x string, y string")
    assert len({r[0] for r in df.select(row_hash("x", "y")).collect()}) == 4
    assert [r[0] for r in df.select(row_hash("x", "y") == row_hash("y", "x")).collect()] == [True] * 4


def test_typed_rows_and_their_errors(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", "5"), (2, " ", "5"), (3, "y", "five"), (4, "z", None), (5, "z", " ")], "n int, name string, level string")
    good, errors = ingest.split_typed(df, ["name"], {"level": "int"}, "n")
    assert rows(good, "n", "level") == [(1, 5), (4, None), (5, None)]
    assert rows(errors, "row_number", "error_message") == [(2, "Missing required field: name"), (3, "Invalid data type: level must be int")]
    csv_files.write_errors(errors, str(tmp_path / "e"))
    text = "".join(p.read_text() for p in (tmp_path / "e").glob("*.csv"))
    assert text.startswith('"row_number","error_message","raw_data"\n"2","Missing required field: name","{""n"":2')


def test_csv_encodings_and_headers(spark, tmp_path):
    (tmp_path / "utf8.csv").write_bytes('id,name\n1,"Zoë, ""the"" one\nof two"\n2,\n'.encode())
    (tmp_path / "latin1.csv").write_bytes("id,name\n1,Zoë\n".encode("latin-1"))
    (tmp_path / "header.csv").write_bytes(b"ID , name\n")
    assert rows(csv_files.scan(spark, str(tmp_path / "utf8.csv")), "id", "name") == [("1", 'Zoë, "the" one\nof two'), ("2", None)]
    assert rows(csv_files.scan(spark, str(tmp_path / "latin1.csv")), "id", "name") == [("1", "Zoë")]
    empty = csv_files.scan(spark, str(tmp_path / "header.csv"))
    assert csv_files.header_errors(empty, ["id"]) == ["CSV has header row but no data"]
    found = csv_files.scan(spark, str(tmp_path / "utf8.csv"))
    assert csv_files.header_errors(found, ["ID", "Name"]) == [] and csv_files.header_errors(found, ["LEVEL"])[1] == "Missing columns: LEVEL"
    seen = csv_files.preview(found, 1)
    assert (seen.rows.count(), seen.total, seen.has_more) == (1, 2, True) and not csv_files.preview(found, 2).has_more


def test_records_with_null_conditions(spark, tmp_path):
    table = Records(spark, str(tmp_path / "t")).append(spark.createDataFrame([(1, None), (2, "a"), (3, "b")], "id int, s string"))
    assert rows(table.update(F.col("s") == "a", {"s": F.lit("c")}).delete(F.col("s") == "b").rows(), "id", "s") == [(1, None), (2, "c")]


def test_mentions_and_scores_of_unequal_length(spark):
    df = spark.createDataFrame([(1, ["Python", "Pyton", "React"], ["0.9", "x"]), (2, None, ["1"]), (3, [], None)], "id int, names array<string>, scores array<string>")
    said = linkage.mentions(df, "id", F.col("names"), F.col("scores"))
    assert rows(said, "job_id", "position", "name", "score") == [(1, 1, "Python", 0.9), (1, 2, "Pyton", None), (1, 3, "React", None)]
    links = linkage.link(said, spark.createDataFrame([("Python",), ("React",)], "name string"))
    # the misspelt name adds to the count, not to the edges
    assert rows(linkage.match_counts(said, links), "match_type", "mentions") == [("exact", 2), ("fuzzy", 1)]
    assert rows(linkage.requires_edges(said, links), "matched", "score", "confidence") == [("python", 0.9, 1.0), ("react", None, 1.0)]


def test_states_and_progress(spark):
    df = spark.createDataFrame([(0, 0, 0, 1.0), (10, 5, 0, 2.0), (10, 5, 0, 0.0), (10, 0, 10, 1.0), (10, 9, 1, 1.0), (10, 10, 0, 1.0), (2001, 7, 0, None)], "total int, done int, failed int, speed double")
    state = ingest.job_state(F.col("done"), F.col("failed"), F.col("total"))
    pct, eta, batches = ingest.progress(F.col("total"), F.col("done"), F.col("speed"), state)
    got = [tuple(r) for r in df.select(state, pct, eta, batches).collect()]
    assert got == [("failed", 0.0, None, None), ("processing", 50.0, 2, 1), ("processing", 50.0, None, 1), ("failed", 0.0, None, 1), ("completed_with_errors", 90.0, None, 1), ("completed", 100.0, None, 1), ("processing", 0.35, None, 3)]


def test_last_rows_with_ties_and_a_busy_user(spark):
    log = spark.range(3000).select(F.when(F.col("id") < 2990, 1).otherwise(2).alias("user"), F.timestamp_seconds(F.col("id") % 2990).alias("t"), "id", F.col("id").cast("double").alias("v"))
    assert rows(monitor.last_of_each(log, "user", "t", "id", 2, 24), "user", "id", "rank") == [(1, 2988, 2), (1, 2989, 1), (2, 2998, 2), (2, 2999, 1)]
    ema = 0.0
    for v in range(1, 2990):
        ema = 0.3 * v + 0.7 * ema
    assert {r.user: r.ema for r in monitor.moving_average(log, "user", "v", "t", "id").collect()}[1] == pytest.approx(ema)
    assert monitor.moving_average(log.limit(0), "user", "v", "t", "id").collect() == []


def test_log_types_search_and_eviction(spark):
    texts = ["call DB.index", "x db.index.vector.queryNodes y", "MATCH (a)-[:R]->(b)", "match (a)-[:R]->(b)-[:S]->(c)", "delete x", "OFFSET 5", "return 1", "", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    assert [r[0] for r in df.orderBy("k").select(monitor.query_type(F.col("t"))).collect()] == ["OTHER", "VECTOR_SEARCH", "READ", "GRAPH_TRAVERSAL", "WRITE", "WRITE", "READ", "OTHER", "OTHER"]
    assert rows(monitor.search(df, "k", "k", 2, 1, t=None), "k") == [(6,), (7,)] and monitor.by_id(df, "k", 99).collect() == []
    assert monitor.evict(df, "k", "k", 9).count() == 9 and rows(monitor.evict(df, "k", "k", 8, 7), "k") == [(7,), (8,)]
    kept, old = monitor.split_by_age(spark.createDataFrame([(1,), (5,), (None,)], "t int"), "t", F.lit(5))
    assert rows(kept, "t") == [(5,), (None,)] and rows(old, "t") == [(1,)]


def test_display_forms(spark):
    df = spark.createDataFrame([(100_000.0, "abc"), (100_001.0, "abcdef"), (None, None), (1_550_000.0, "abcde")], "pay double, s string")
    assert [tuple(r) for r in df.select(lakhs(F.col("pay")), truncated(F.col("s"), 5)).collect()] == [("100,000", "abc"), ("1.0 LPA", "abcde..."), (None, None), ("15.5 LPA", "abcde")]
    names = spark.createDataFrame([(["b", "a", "b"],), ([],), (list("fedcba"),)], "n array<string>")
    assert [r[0] for r in names.select(and_others(F.col("n"), 5)).collect()] == ["a, b", "", "a, b, c, d, e and 1 others"]


def test_lakhs_take_halves_as_their_sql_does(spark):
    import duckdb

    values = [float(5_000 * k) for k in range(1, 400)] + [115_000.01, 114_999.99, 99_999.5, 2.5, 225_000.0]
    want = duckdb.sql(f"SELECT CASE WHEN v > 100000 THEN format('{{:,.1f}} LPA', round(v / 100000, 1)) ELSE format('{{:,.0f}}', v) END FROM (SELECT unnest({values}::DOUBLE[]) AS v)").fetchall()
    got = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").orderBy("k").select(lakhs(F.col("v"))).collect()
    assert [tuple(r) for r in got] == want


def test_skill_gap_advice(spark):
    for n, advice in ((0, "on the right track"), (5, "focus on 5"), (6, "first 5 of 6"), (10, "first 5 of 10"), (11, "3 to 5 of 11")):
        top = spark.createDataFrame([("Known",), (None,), ("",)] + [(f"s{k:02}",) for k in range(n)] * 2, "name string")
        row = context.skill_gap(top, spark.createDataFrame([("KNOWN",), (None,)], "name string")).first()
        assert (row.missing, row.advice, len([s for s in row.skills.split(", ") if s])) == (n, advice, min(n, 10))


def test_reach_merge_and_skip(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (2, 3), (None, 4)], "src int, dst int")
    seeds = spark.createDataFrame([(1,), (1,), (9,), (None,)], "id int")
    assert rows(traverse.khop(edges, seeds, 5), "seed", "node", "hops") == [(1, 2, 1), (1, 3, 2)]
    assert traverse.khop(edges.limit(0), seeds, 2).collect() == []
    parts = {"a": traverse.as_graph(spark.createDataFrame([(1, 5), (2, 5)], "job_id int, skill_id int")), "b": traverse.as_graph(spark.createDataFrame([(1, 5)], "job_id int, skill_id int"))}
    assert rows(traverse.multi_intent(parts, 2, 0), "kind", "type", "id", "dst", "intents") == [("node", "Job", "1", None, "a,b"), ("node", "Job", "2", None, "a"), ("relationship", "REQUIRES", "1", "5", "a,b"), ("relationship", "REQUIRES", "2", "5", "a")]
    assert traverse.skipped(True, []) and not traverse.skipped(True, ["general", "career_path"])


def test_intents_alike_and_refined(spark):
    examples = spark.createDataFrame([("salary_analysis", [1.0, 0.0]), ("salary_analysis", [0.0, 1.0]), ("career_path", [0.0, -1.0])], "intent string, v array<double>")
    asked = spark.createDataFrame([(1, [1.0, 1.0]), (2, [0.0, 0.0]), (3, [0.0, -2.0])], "id int, v array<double>")
    found = questions.alike(asked, questions.archetypes(examples), "id")
    assert rows(found.withColumn("score", F.round("score", 6)), "id", "intent", "score") == [(1, "salary_analysis", 1.0), (3, "career_path", 1.0)]
    weak = found.withColumn("score", F.lit(0.7))
    ranked = questions.refined(weak, spark.createDataFrame([(1, "salary_analysis"), (2, "company_query")], "id int, intent string"), spark.createDataFrame([(1, "job"), (1, "job")], "id int, kind string"), "id")
    assert rows(ranked.withColumn("score", F.round("score", 6)), "id", "intent", "score", "rank") == [(1, "salary_analysis", 0.75, 1), (2, "company_query", 0.6, 1), (3, "career_path", 0.7, 1)]
    assert questions.alike(asked, questions.archetypes(examples.limit(0)), "id").collect() == []


def test_paths_over_cycles(spark):
    steps = spark.createDataFrame([(1, 2, 0.5, 3, 0.5), (2, 1, 0.5, 1, 0.1), (2, 3, 0.5, 1, 0.1), (1, 3, 0.1, 1, 0.1)], "src int, dst int, frequency double, months int, difficulty double")
    start = spark.createDataFrame([(1,)], "id int")
    assert [tuple(r) for r in skillpaths.progressions(steps, start).collect()] == [([1, 2], 3, 0.5), ([1, 2, 3], 4, 0.3)]
    assert rows(skillpaths.learning_paths(steps, start, spark.createDataFrame([(3,), (7,)], "id int")), "goal", "rank", "path") == [(3, 1, [1, 3]), (3, 2, [1, 2, 3])]
    assert rows(skillpaths.learning_order(steps, start.toDF("skill_id"), spark.createDataFrame([(1,), (3,), (8,)], "skill_id int")), "skill_id", "steps") == [(3, 1), (8, 999)]


def test_nearest_of_two_sides(spark):
    left = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "id long, v array<double>")
    right = spark.createDataFrame([(1, [2.0, 0.0]), (3, [1.0, 1.0]), (4, [-1.0, 0.0]), (5, [2.0, 0.0])], "id long, v array<double>")
    assert rows(vector_search.nearest(left, right, 0.5, 2, clipped=False), "src", "dst") == [(1, 1), (1, 5)]
    assert vector_search.nearest(left.limit(0), right, None, 2).collect() == []


def test_cosines_of_odd_vectors(spark):
    from graphloom.operators import questions

    odd = [[1.0, 1.0], None, [1.0], [0.0, 0.0], [float("nan"), 1.0], [None, 1.0], [3.0, 4.0]]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(odd)], "k int, v array<double>").coalesce(1).orderBy("k")
    got = [r[0] and [round(x, 6) for x in r[0]] for r in df.select(questions.cosines(F.col("v"), [[1.0, 0.0], [0.0, 2.0]])).collect()]
    assert got == [[0.707107, 0.707107], None, None, [0.0, 0.0], None, None, [0.6, 0.8]]
