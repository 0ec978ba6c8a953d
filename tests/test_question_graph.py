"""Traversal of a table of questions on a small graph."""

import pytest

from graphloom.operators import question_graph


@pytest.fixture(scope="module")
def market(spark):
    make = spark.createDataFrame
    return question_graph.Market(
        make([(1, 10), (1, 11), (2, 11), (2, 12), (3, 12), (4, 13), (4, 13)], "job_id long, skill_id long"),
        make([(10, 12), (12, 13), (11, 14)], "src long, dst long"),
        make([(1, 100), (2, 100), (3, 101), (4, None)], "job_id long, company_id long"),
        make([(100, 7), (101, None)], "company_id long, location_id long"),
    )


def run(spark, market, intents, found, **how):
    questions = spark.createDataFrame([(q, i) for q, i in intents.items()], "question string, intents array<string>")
    rows = question_graph.traverse(questions, spark.createDataFrame(found, "question string, place int, node_type string, node long"), market, **how).collect()
    out = {}
    for r in rows:
        out.setdefault(r.question, set()).add((r.type, r.id, r.dst, r.intents))
    return out


def names(rows, *types):
    return sorted((t, i, d) if d else (t, i) for t, i, d, _ in rows if t in types)


def test_each_intent_follows_its_pattern(spark, market):
    job = lambda q, *ids: [(q, k, "Job", i) for k, i in enumerate(ids)]
    skill = lambda q, *ids: [(q, k, "Skill", i) for k, i in enumerate(ids)]
    intents = {"need": ["skill_requirement"], "pay": ["salary_analysis"], "who": ["company_query"], "alike": ["skill_relationship"], "career": ["career_path"], "onward": ["career_path"]}
    found = run(spark, market, intents, job("need", 1) + job("pay", 2, 3) + job("who", 1) + skill("alike", 10, 15) + skill("career", 10) + job("onward", 3), depth=1)
    assert names(found["need"], "REQUIRES", "Job", "Skill") == [("Job", "1"), ("REQUIRES", "1", "10"), ("REQUIRES", "1", "11"), ("Skill", "10"), ("Skill", "11")]
    assert names(found["pay"], "POSTED_BY", "LOCATED_IN", "Location") == [("LOCATED_IN", "2", "7"), ("Location", "7"), ("POSTED_BY", "2", "100"), ("POSTED_BY", "3", "101")]
    # the company's other job, and what all its jobs require
    assert names(found["who"], "Job", "Company", "Skill") == [("Company", "100"), ("Job", "1"), ("Job", "2"), ("Skill", "10"), ("Skill", "11"), ("Skill", "12")]
    # a skill without similar ones is shown alone
    assert names(found["alike"], "Skill", "SIMILAR_TO") == [("SIMILAR_TO", "10", "12"), ("Skill", "10"), ("Skill", "12"), ("Skill", "15")]
    assert names(found["career"], "Job", "SIMILAR_TO", "REQUIRES") == [("Job", "1"), ("REQUIRES", "1", "10"), ("SIMILAR_TO", "10", "12")]
    # job 3 wants 12, to which 10 and 13 are similar, which jobs 1 and 4 want
    assert names(found["onward"], "Job") == [("Job", "1"), ("Job", "3"), ("Job", "4")]


def test_two_intents_are_named_where_both_find_a_row(spark, market):
    found = run(spark, market, {"q": ["salary_analysis", "skill_requirement", "skill_requirement"]}, [("q", 0, "Job", 3), ("q", 0, "Job", 3)])
    assert {(t, i): who for t, i, _, who in found["q"]} == {
        ("Job", "3"): "salary_analysis,skill_requirement", ("Skill", "12"): "salary_analysis,skill_requirement", ("REQUIRES", "3"): "salary_analysis,skill_requirement",
        ("Company", "101"): "salary_analysis", ("POSTED_BY", "3"): "salary_analysis",
    }


def test_questions_that_are_skipped_are_absent(spark, market):
    intents = {"general": ["general"], "none": [], "null": None, "no rows": ["skill_requirement"], "other type": ["skill_requirement"]}
    found = [(q, 0, "Job", 1) for q in ("general", "none", "null")] + [("other type", 0, "Skill", 10), ("other type", 1, "Job", 1), (None, 0, "Job", 1), ("no rows", 0, "Job", None)]
    # seeds are those of the first row's type: a skill, for which this intent has no pattern
    assert run(spark, market, intents, found) == {}


def test_caps_are_those_of_each_question(spark, market):
    many = spark.createDataFrame([(j, 50) for j in range(1000, 1400)], "job_id long, skill_id long")
    wide = question_graph.Market(market.requires.unionByName(many), market.similar.unionByName(spark.createDataFrame([(50, 10)], "src long, dst long")), market.jobs, market.companies)
    intents, found = {"a": ["career_path"], "b": ["career_path"]}, [("a", 0, "Skill", 50), ("b", 0, "Skill", 10)]
    whole = run(spark, wide, intents, found, nodes=0, relationships=0)
    capped = run(spark, wide, intents, found, nodes=30, relationships=20)
    for q in ("a", "b"):
        for nodes, most in ((True, 30), (False, 20)):
            of = lambda rows: sorted((t, i, d or "") for t, i, d, _ in rows[q] if (d is None) == nodes)  # noqa: B023, E731
            assert of(capped) == of(whole)[:most]
    assert len(whole["a"]) > 800
    # so many seeds of a question, and no more
    seeds = spark.createDataFrame([("q", k, "Job", k) for k in range(70)], "question string, place int, node_type string, node long")
    assert sorted(r.node for r in question_graph.seeds_of(seeds).collect()) == list(range(50))


def test_jobs_that_caps_cannot_show_are_not_joined(spark):
    """Of 4,000 pairs of a question few are made, and the caps' first ones are among them; a question with few pairs keeps all."""
    want = spark.createDataFrame([(10_000 + j * 100 + k, k) for k in range(100) for j in range(40)] + [(10_000 + k, k + 1) for k in range(99)], "job_id long, skill_id long")
    rows = spark.createDataFrame([("q", i, k) for k in range(100) for i in ("career_path", "skill_relationship")] + [("r", "career_path", 5), ("q", "career_path", 777)], "question string, intent string, skill_id long")
    made = question_graph._wanting(rows, want, 30, 50).collect()
    whole = question_graph._wanting(rows, want, 0, 0).collect()
    pair = lambda r: (str(r.job_id), str(r.skill_id), r.intent)
    of = lambda found, q: sorted({pair(r) for r in found if r.question == q})
    assert len(of(made, "q")) < 0.1 * len(of(whole, "q")) and of(made, "r") == of(whole, "r")
    assert of(made, "q")[: 2 * 50] == of(whole, "q")[: 2 * 50]
    assert sorted({j for j, _, _ in of(made, "q")})[:30] == sorted({j for j, _, _ in of(whole, "q")})[:30]


@pytest.mark.parametrize("caps", [{}, {"nodes": 3, "relationships": 2}, {"nodes": 0, "relationships": 0}])
def test_lists_are_moved_and_counted_where_they_are_spelt(spark, market, monkeypatch, caps):
    monkeypatch.setattr(question_graph, "QUESTIONS", 2)
    every = ["skill_requirement", "salary_analysis", "company_query", "career_path", "skill_relationship"]
    asked = [(f"q{k}", every[k % 5 :] if k % 2 else [every[k % 5]]) for k in range(12)]
    rows = [(f"q{k}", p, "Skill" if k % 3 == 0 else "Job", (10 if k % 3 == 0 else 1) + (k + p) % 4) for k in range(12) for p in range(3)]
    questions = spark.createDataFrame(asked, "question string, intents array<string>")
    found = spark.createDataFrame(rows, "question string, place int, node_type string, node long")
    made = question_graph.traverse(questions, found, market, **caps)
    assert "dst" not in "".join(line for line in made._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line)
    groups = {}
    for r in made.collect():
        groups.setdefault((r.question, r.kind, r.type, r.intents), []).append(r.id if r.dst is None else f"{r.id}>{r.dst}")
    counted = question_graph.summary(questions, found, market, **caps).collect()
    assert {tuple(r)[:4]: tuple(r)[4:] for r in counted} == {k: (len(x), min(x), max(x)) for k, x in groups.items()}
    assert len(counted) == len(groups) > 20
