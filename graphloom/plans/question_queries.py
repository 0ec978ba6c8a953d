"""Queries of question understanding, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import token_count
from graphloom.operators import questions
from graphloom.plans.registry import query

#: Questions about parts, and every turn of the conversations.
_ASKED = """CASE p_partkey % 8 WHEN 0 THEN concat('What skills are similar to ', p_name, ' or Java vs Python?') WHEN 1 THEN concat('Which companies hire ', p_name, ' and React at Google, IBM?')
 WHEN 2 THEN concat('How to become a data scientist with ', p_name) WHEN 3 THEN concat('What do they pay a software engineer for SQL, ', p_name) WHEN 4 THEN concat('Should I learn Go and AWS for ', p_name)
 WHEN 5 THEN concat('Best tools for Docker, docker and K8s: ', p_name) WHEN 6 THEN p_name ELSE NULL END"""
_ROWS = f"SELECT concat('part-', p_partkey) AS id, {_ASKED} AS text FROM part UNION ALL SELECT concat('turn-', conv_id, '-', turn), text FROM conversations"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("part-"), "p_partkey").alias("id"), F.expr(_ASKED).alias("text"))
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.concat(F.lit("turn-"), "conv_id", F.lit("-"), "turn").alias("id"), "text")
    return parts.unionByName(turns)


#: DuckDB's word boundaries know ASCII letters only, so that other letters and digits are spelt as underscores there.
_ASCII = rf"asked AS (SELECT id, regexp_replace(lower(coalesce(text, '')), '[^\x00-\x7F\p{{P}}\p{{Z}}\p{{S}}]', '_', 'g') AS t FROM ({_ROWS}))"
_MATCHED = ", ".join(f"CASE WHEN {' OR '.join(f"regexp_matches(t, '{p}')" for p in patterns)} THEN '{name}' END" for name, patterns in questions.INTENTS.items())
_FOUND = " UNION ".join(
    f"SELECT id, '{kind}' AS kind, unnest(regexp_extract_all(t, '{p}')) AS value, {confidence}::DOUBLE AS confidence FROM asked" for kind, (confidence, patterns) in questions.ENTITIES.items() for p in patterns
)


@query(
    f"""WITH {_ASCII}, found AS (SELECT id, string_split(nullif(concat_ws(',', {_MATCHED}), ''), ',') AS i FROM asked)
SELECT id, coalesce(i[1], 'general') AS primary_intent, coalesce(array_to_string(i[2:4], ','), '') AS secondary, CASE WHEN len(i) > 0 THEN 0.6::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM found"""
)
def question_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each question asks for."""
    found = questions.classify(asked(spark, sf_dir))
    return found.select("id", F.col("primary").alias("primary_intent"), F.concat_ws(",", "secondary").alias("secondary"), "confidence")


@query(f"WITH {_ASCII} SELECT * FROM ({_FOUND})")
def question_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that each question names."""
    return questions.entities(asked(spark, sf_dir), "id")


@query(
    f"""WITH {_ASCII}, ranked AS (SELECT *, row_number() OVER (PARTITION BY id, kind ORDER BY value) AS rank FROM ({_FOUND}))
SELECT id, kind, string_agg(value, ', ' ORDER BY value) AS named FROM ranked WHERE rank <= CASE kind WHEN 'skill' THEN 5 ELSE 3 END GROUP BY id, kind"""
)
def question_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question section of a context: the entities named, a few of each kind."""
    named = questions.named(questions.entities(asked(spark, sf_dir), "id"), "id")
    return named.groupBy("id", "kind").agg(F.concat_ws(", ", F.array_sort(F.collect_list("value"))).alias("named"))


@query("SELECT doc_id, length(coalesce(text, '')) // 4 AS tokens, length(coalesce(text, '')) // 4 > 4000 AS exceeds FROM documents")
def context_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated tokens of each text, and whether a context of 4000 would overflow."""
    tokens = token_count(F.col("text"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", tokens.alias("tokens"), (tokens > 4000).alias("exceeds"))


#: Questions with a vector: parts that have one. An intent's examples are the vectors of a label.
_LABELS = {0: "career_path", 1: "company_query", 2: "salary_analysis", 3: "skill_relationship", 4: "skill_requirement"}
_NAMED = " ".join(f"WHEN {k} THEN '{v}'" for k, v in _LABELS.items())
#: The vectors are never as alike as those of a text model, so both thresholds are scaled down.
_SCALE = 0.2


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def _alike(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    examples = rows.where(F.col("label").isin(*_LABELS)).select(F.expr(f"CASE label {_NAMED} END").alias("intent"), "v")
    asked = rows.select(F.concat(F.lit("part-"), "vec_id").alias("id"), "v")
    return questions.alike(asked, questions.archetypes(examples), "id", _SCALE)


_ALIKE_SQL = f"""vec AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
archetype AS (SELECT intent, list(m ORDER BY k) AS v FROM (SELECT CASE label {_NAMED} END AS intent, k, avg(v[k]) AS m FROM vec, range(1, 65) t(k) WHERE label < 5 GROUP BY 1, 2) GROUP BY intent),
alike AS (SELECT concat('part-', vec_id) AS id, intent, list_cosine_similarity(vec.v, archetype.v) AS score FROM vec, archetype WHERE list_cosine_similarity(vec.v, archetype.v) >= CASE intent WHEN 'skill_relationship' THEN 0.2 * 0.7 ELSE 0.2 * 0.65 END)"""


@query(f"WITH {_ALIKE_SQL} SELECT id, intent, round(score, 6) AS score FROM alike")
def semantic_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intents whose examples' mean vector a question's vector is near to."""
    return _alike(spark, sf_dir).withColumn("score", F.round("score", 6))


#: Written out by hand for the questions that are made here ("learn" holds "earn", so that form 4 asks for pay as well).
_BY_HAND = """by_hand AS (SELECT concat('part-', p_partkey) AS id, p_partkey % 8 AS form FROM part),
syntactic AS (SELECT id, unnest(CASE form WHEN 0 THEN ['skill_relationship', 'skill_requirement'] WHEN 1 THEN ['company_query'] WHEN 2 THEN ['career_path'] WHEN 3 THEN ['salary_analysis'] WHEN 4 THEN ['skill_requirement', 'salary_analysis'] WHEN 5 THEN ['skill_requirement'] ELSE [] END) AS intent FROM by_hand),
kinds AS (SELECT id, CASE form WHEN 0 THEN ['skill'] WHEN 1 THEN ['skill', 'company'] WHEN 2 THEN ['job'] WHEN 3 THEN ['skill', 'job'] WHEN 4 THEN ['skill'] WHEN 5 THEN ['skill'] ELSE [] END AS kinds FROM by_hand)"""


@query(
    f"""WITH {_ALIKE_SQL}, {_BY_HAND}, raised AS (SELECT id, intent, least(1.0, score + CASE WHEN intent = 'skill_relationship' AND list_contains(kinds, 'skill') THEN 0.10 WHEN intent = 'skill_requirement' AND (list_contains(kinds, 'job') OR list_contains(kinds, 'skill')) THEN 0.08
  WHEN intent = 'career_path' AND list_contains(kinds, 'job') THEN 0.08 WHEN intent = 'company_query' AND list_contains(kinds, 'company') THEN 0.12 WHEN intent = 'salary_analysis' AND list_contains(kinds, 'job') THEN 0.05 ELSE 0 END) AS score FROM alike LEFT JOIN kinds USING (id)),
every AS (SELECT * FROM raised UNION ALL SELECT id, intent, 0.6 FROM syntactic ANTI JOIN alike USING (id, intent))
SELECT id, intent, round(score, 6) AS score, row_number() OVER (PARTITION BY id ORDER BY every.score DESC, intent)::INTEGER AS rank FROM every"""
)
def refined_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intents of vectors and patterns together, raised by the entities that a question names."""
    parts = asked(spark, sf_dir).where("id LIKE 'part-%'")
    syntactic = parts.select("id", F.explode(questions.intents(F.col("text"))).alias("intent"))
    ranked = questions.refined(_alike(spark, sf_dir), syntactic, questions.entities(parts, "id"), "id")
    return ranked.withColumn("score", F.round("score", 6))


def _patterns(known: dict[str, list[str]]) -> str:
    """SQL: the names whose patterns occur in ``t``, as a list."""
    cases = [f"CASE WHEN {' OR '.join(f"regexp_matches(t, '{p}')" for p in patterns)} THEN '{name}' END" for name, patterns in known.items()]
    return f"concat_ws(',', {', '.join(cases)})"


#: The turns, whose words nobody has written a result for by hand.
_TURNS = "turns AS (SELECT id, t FROM asked WHERE id LIKE 'turn-%')"
_OLDER = """CASE form WHEN 0 THEN 'skill_relationship,skill_requirement' WHEN 1 THEN 'company_query' WHEN 2 THEN 'career_path' WHEN 3 THEN 'salary_analysis' WHEN 4 THEN 'skill_requirement,salary_analysis' WHEN 5 THEN 'skill_requirement' ELSE 'general' END"""


@query(
    f"""WITH {_ASCII}, {_TURNS}, {_BY_HAND} SELECT id, {_OLDER} AS intents FROM by_hand
UNION ALL SELECT id, coalesce(nullif({_patterns(questions.OLDER_INTENTS)}, ''), 'general') FROM turns"""
)
def older_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the older detector makes of the questions."""
    return asked(spark, sf_dir).select("id", F.array_join(questions.older_intents(F.col("text")), ",").alias("intents"))


@query(
    f"""WITH {_ASCII}, {_TURNS}, {_BY_HAND} SELECT id, CASE form WHEN 0 THEN 'skill_relationship,skill_requirement' WHEN 6 THEN '' WHEN 7 THEN '' ELSE {_OLDER} END AS all_intents FROM by_hand
UNION ALL SELECT id, {_patterns(questions.INTENTS)} FROM turns"""
)
def all_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every intent of a question's record; a general one has none."""
    return questions.classify(asked(spark, sf_dir)).select("id", F.array_join("all_intents", ",").alias("all_intents"))


_OLDER_NAMED = """SELECT id, unnest(CASE form WHEN 0 THEN ['skill:java:0.8', 'skill:python:0.8'] WHEN 1 THEN ['skill:react:0.8', 'company:google:0.9', 'company:ibm:0.9'] WHEN 2 THEN ['job:data scientist:0.7'] WHEN 3 THEN ['skill:sql:0.8', 'job:software engineer:0.7']
 WHEN 4 THEN ['skill:go:0.8', 'skill:aws:0.8'] WHEN 5 THEN ['skill:docker:0.8'] ELSE [] END) AS entity FROM by_hand"""


_OLDER_TURNS = " UNION ".join(
    f"SELECT id, '{kind}:' || unnest(regexp_extract_all(t, '{p}')) || ':{confidence}' AS entity FROM turns" for kind, (confidence, patterns) in questions.OLDER_ENTITIES.items() for p in patterns
)


@query(f"WITH {_ASCII}, {_TURNS}, {_BY_HAND} {_OLDER_NAMED} UNION ALL SELECT * FROM ({_OLDER_TURNS})")
def older_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that the older patterns find, each once."""
    found = questions.entities(asked(spark, sf_dir), "id", known=questions.OLDER_ENTITIES)
    return found.select("id", F.concat_ws(":", "kind", "value", F.col("confidence").cast("string")).alias("entity"))


#: The rows nearest to a question's vector: skills of labels 0 to 2, jobs of 3 to 5, companies above, with scores raised to what a text model gives.
_KIND = "CASE WHEN label <= 2 THEN 'skill' WHEN label <= 5 THEN 'job' ELSE 'company' END"
_NEAR_SQL = f"""near AS (SELECT 'part-7' AS id, {_KIND.replace('label', 'b.label')} AS kind, 'Item ' || b.vec_id AS name, (1 + list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) / 2 + 0.2 AS score,
  row_number() OVER (PARTITION BY {_KIND.replace('label', 'b.label')} ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id = 7),
semantic AS (SELECT id, kind, lower(name) AS value, CASE kind WHEN 'skill' THEN least(0.95, score + 0.05) ELSE least(0.92, score + 0.05) END AS confidence FROM near WHERE (kind = 'skill' AND rank <= 10 AND score >= 0.75) OR (kind = 'job' AND rank <= 5 AND score >= 0.75) OR (kind = 'company' AND rank <= 5 AND score >= 0.85))"""


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    from graphloom.functions.vectors import cosine, normalized_score

    rows = _vectors(spark, sf_dir)
    probe = rows.where("vec_id = 7").first()["v"]
    score = normalized_score(cosine(F.col("v"), F.array(*[F.lit(x) for x in probe]))) + 0.2
    kinds = rows.select(F.lit("part-7").alias("id"), F.expr(_KIND).alias("kind"), F.concat(F.lit("Item "), "vec_id").alias("name"), score.alias("score"), "vec_id")
    return kinds.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("score"), "vec_id"))).where("rank <= 10")


@query(f"WITH {_NEAR_SQL} SELECT id, kind, value, round(confidence, 6) AS confidence FROM semantic")
def semantic_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills, jobs and companies whose vectors are near a question's."""
    return questions.near_entities(_near(spark, sf_dir), "id").withColumn("confidence", F.round("confidence", 6))


@query(
    f"""WITH {_NEAR_SQL}, every AS (SELECT *, 0 AS place, 'semantic' AS origin FROM semantic UNION ALL SELECT 'part-7', 'skill', 'item 7', 0.75, 1, 'pattern' UNION ALL SELECT 'part-7', 'skill', 'python', 0.75, 1, 'pattern' UNION ALL SELECT 'part-7', 'skill', 'python', 0.75, 0, 'semantic'),
best AS (SELECT id, kind, value, confidence, origin FROM every QUALIFY row_number() OVER (PARTITION BY id, kind, value ORDER BY confidence DESC, place) = 1)
SELECT id, kind, value, round(confidence, 6) AS confidence, origin, row_number() OVER (ORDER BY best.confidence DESC, kind, value)::INTEGER AS rank FROM best"""
)
def ranked_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of vectors and patterns: of equal ones the most confident, of equal confidence the vectors', best first."""
    schema = "id string, kind string, value string, confidence double"
    vectors = questions.near_entities(_near(spark, sf_dir), "id").unionByName(spark.createDataFrame([("part-7", "skill", "python", 0.75)], schema))
    patterns = spark.createDataFrame([("part-7", "skill", "item 7", 0.75), ("part-7", "skill", "python", 0.75)], schema)
    return questions.best_entities({"semantic": vectors, "pattern": patterns}, "id").withColumn("confidence", F.round("confidence", 6))
