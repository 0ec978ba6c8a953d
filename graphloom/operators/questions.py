"""What a question asks for: intents and named entities by fixed patterns, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns of each intent over the lower-cased question, in order of precedence.
INTENTS = {
    "skill_relationship": [
        r"similar to", r"related (to|skills)", r"alternatives to", r"comparable to", r"versus|vs\b", r"compared to", r"difference between", r"substitute for",
    ],
    "skill_requirement": [
        r"what skills", r"skills for", r"skills needed", r"skills required", r"need to know", r"must know", r"should.*learn", r"skills do i need", r"technical requirements", r"prerequisites",
        r"what (framework|library|libraries|technology|technologies|tool|tools|language|languages)",
        r"(framework|library|technology|tool|language)s? (for|in|needed|required|used)",
        r"(most|best|top|popular|famous|in-demand|trending) (framework|library|technology|tool|language|skill)s?",
        r"which (framework|library|technology|tool|language)s?",
        r"demand for|in demand|market demand",
    ],
    "career_path": [
        r"transition", r"career path", r"how to become", r"switch to", r"move into", r"get into", r"roadmap to", r"become.*developer", r"become.*engineer", r"career progression",
    ],
    "salary_analysis": [
        r"\bsalar(y|ies)", r"\bpay\b", r"compensation", r"wage", r"earn(ing)?", r"income", r"high-paying", r"well-paid", r"how much.*make", r"expect.*salary", r"what.*pay", r"pay range", r"pay scale",
    ],
    "company_query": [
        r"companies", r"employers", r"who hires", r"which companies", r"organizations", r"firms hiring", r"companies use", r"where.*work", r"which.*company",
    ],
}

# Patterns and confidence of each kind of entity.
ENTITIES = {
    "skill": (0.75, [
        r"\b(python|java|javascript|typescript|c\+\+|c#|ruby|go|rust|php|swift|kotlin)\b",
        r"\b(react|vue|angular|django|flask|spring|express|fastapi|rails|nextjs|nuxt)\b",
        r"\b(sql|nosql|mongodb|postgresql|mysql|redis|elasticsearch|neo4j)\b",
        r"\b(aws|azure|gcp|google cloud|docker|kubernetes|k8s|git|jenkins|terraform)\b",
        r"\b(machine learning|deep learning|ai|ml|data science|nlp|computer vision)\b",
        r"\b(devops|frontend|backend|full stack|fullstack|mobile|ios|android)\b",
    ]),
    "job": (0.70, [
        r"\b(software engineer|developer|programmer|coder)\b",
        r"\b(data scientist|data analyst|data engineer|ml engineer)\b",
        r"\b(product manager|project manager|scrum master)\b",
        r"\b(devops engineer|sre|site reliability|cloud engineer)\b",
        r"\b(frontend developer|backend developer|full stack developer)\b",
        r"\b(mobile developer|ios developer|android developer)\b",
        r"\b(machine learning engineer|ai engineer|research scientist)\b",
    ]),
    "company": (0.90, [
        r"\b(google|amazon|microsoft|apple|meta|facebook|netflix|tesla)\b",
        r"\b(ibm|oracle|salesforce|adobe|nvidia|intel|amd|twitter|x)\b",
        r"\b(uber|lyft|airbnb|stripe|shopify|spotify|snapchat|tiktok)\b",
    ]),
}

# The older detector's patterns of each intent, where they differ from the above, and its patterns of entities.
OLDER_INTENTS = {
    "skill_relationship": [r"similar to", r"related (to|skills)", r"alternatives to", r"comparable to", r"versus", r"vs\b", r"compared to"],
    "skill_requirement": INTENTS["skill_requirement"][:8] + INTENTS["skill_requirement"][10:],
    "career_path": [r"transition", r"career path", r"how to become", r"switch to", r"move into", r"get into", r"roadmap to", r"become.*developer", r"become.*engineer"],
    "salary_analysis": [
        r"\bsalar(y|ies)", r"pay\b", r"compensation", r"wage", r"earn(ing)?", r"income", r"high-paying", r"well-paid", r"how much.*make", r"expect.*salary", r"what.*pay", r"pay range", r"pay scale",
    ],
    "company_query": [r"companies", r"employers", r"who hires", r"which companies", r"organizations", r"firms hiring", r"companies use", r"where.*shift", r"where.*work"],
}
OLDER_ENTITIES = {
    "skill": (0.8, [
        r"\b(python|java|javascript|typescript|c\+\+|c#|ruby|go|rust|php|swift|kotlin)\b",
        r"\b(react|vue|angular|django|flask|spring|express|fastapi|rails)\b",
        r"\b(sql|nosql|mongodb|postgresql|mysql|redis|elasticsearch)\b",
        r"\b(aws|azure|gcp|docker|kubernetes|git|jenkins|terraform)\b",
        r"\b(machine learning|deep learning|ai|data science|devops|frontend|backend)\b",
    ]),
    "job": (0.7, [
        r"\b(software engineer|developer|data scientist|data analyst|product manager)\b",
        r"\b(devops engineer|frontend developer|backend developer|full stack)\b",
        r"\b(machine learning engineer|ai engineer|cloud engineer)\b",
    ]),
    "company": (0.9, [
        r"\b(google|amazon|microsoft|apple|meta|facebook|netflix|tesla)\b",
        r"\b(ibm|oracle|salesforce|adobe|nvidia|intel|amd|twitter|x)\b",
    ]),
}

#: Least cosine of a question and an intent's mean vector.
ALIKE = {"skill_relationship": 0.70}
ALIKE_OTHERS = 0.65
#: What an entity of a type adds to an intent that the vectors found.
BOOSTS = (("skill_relationship", ("skill",), 0.10), ("skill_requirement", ("job", "skill"), 0.08), ("career_path", ("job",), 0.08), ("company_query", ("company",), 0.12), ("salary_analysis", ("job",), 0.05))
#: Entities of a type that vectors find: nearest rows, least score, what is added to it, and the most that it becomes.
NEAREST = {"skill": (10, 0.75, 0.05, 0.95), "job": (5, 0.75, 0.05, 0.92), "company": (5, 0.85, 0.05, 0.92)}
#: Confidence of an intent that patterns found, and of the general one.
FOUND, GENERAL = 0.6, 0.5
#: Entities of each kind that a question's context names.
NAMED = {"skill": 5, "job": 3, "company": 3}


def intents(question: Column, known: Mapping[str, list[str]] = INTENTS) -> Column:
    """Names of the intents whose patterns occur, in order; null has none."""
    text = F.lower(F.coalesce(question, F.lit("")))
    return F.array_compact(F.array(*[F.when(text.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(name)) for name, patterns in known.items()]))


def older_intents(question: Column) -> Column:
    """The older detector: the intents found, or general alone."""
    found = intents(question, OLDER_INTENTS)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("general")))


def classify(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The table with ``primary``, up to three ``secondary`` intents, ``all_intents`` (none for a general question) and ``confidence``."""
    found = intents(F.col(text_col))
    some = F.size(found) > 0
    return df.select(
        "*", F.when(some, F.element_at(found, 1)).otherwise("general").alias("primary"), F.slice(found, 2, 3).alias("secondary"), found.alias("all_intents"), F.when(some, FOUND).otherwise(GENERAL).alias("confidence")
    )


def _of_kind(kind: str, text: Column, known: Mapping[str, tuple[float, list[str]]]) -> Column:
    confidence, patterns = known[kind]
    values = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in patterns]))
    return F.transform(F.array_distinct(values), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"), F.lit(confidence).alias("confidence")))


def entities(df: DataFrame, id_col: str, text_col: str = "text", known: Mapping[str, tuple[float, list[str]]] = ENTITIES) -> DataFrame:
    """``(id, kind, value, confidence)``: each entity of a question once."""
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    every = reduce(lambda a, b: F.concat(a, b), [_of_kind(kind, text, known) for kind in known])
    return df.select(id_col, F.explode(every).alias("e")).select(id_col, "e.*")


def named(found: DataFrame, id_col: str) -> DataFrame:
    """The entities that a question's context names: the first of each kind by value."""
    order = Window.partitionBy(id_col, "kind").orderBy("value")
    most = reduce(lambda a, kind: a.when(F.col("kind") == kind, NAMED[kind]), list(NAMED)[1:], F.when(F.col("kind") == "skill", NAMED["skill"]))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def archetypes(examples: DataFrame) -> DataFrame:
    """``(intent, v)``: the mean vector of each intent's ``examples(intent, v)``; there are few intents and few examples."""
    means = examples.select("intent", F.posexplode("v").alias("k", "x")).groupBy("intent", "k").agg(F.avg("x").alias("x"))
    return means.groupBy("intent").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("r")).select("intent", F.transform("r", lambda r: r["x"]).alias("v"))


def alike(asked: DataFrame, means: DataFrame, id_col: str, scale: float = 1.0) -> DataFrame:
    """``(id, intent, score)``: intents whose mean vector is near enough to a question's vector ``v``.

    Each question is compared with each intent: ``means`` has a row for each of a handful of intents, which is collected.
    ``scale`` lowers both thresholds for vectors that are never as alike as those of a text model.
    """
    rows = means.select("intent", "v").collect()
    if not rows:
        return asked.select(id_col, F.lit("").alias("intent"), F.lit(0.0).alias("score")).limit(0)
    scores = cosines(F.col("v"), [r.v for r in rows])
    named = [F.struct(F.lit(r.intent).alias("intent"), F.col("_scores")[k].alias("score"), F.lit(scale * ALIKE.get(r.intent, ALIKE_OTHERS)).alias("least")) for k, r in enumerate(rows)]
    scored = asked.select(id_col, scores.alias("_scores")).select(id_col, F.explode(F.array(*named)).alias("s"))
    return scored.where("s.score >= s.least").select(id_col, "s.intent", "s.score")


def cosines(v: Column, others: list[list[float]]) -> Column:
    """Raw cosines of a vector with each of a few others, a batch in one product; null for a vector that is null, of another length or not finite, 0 without length."""
    means = np.array(others, np.float64)
    size = means.shape[1]
    length = np.linalg.norm(means, axis=1, keepdims=True)
    unit = np.divide(means, length, out=np.zeros_like(means), where=length > 0)

    def score(vectors: pa.Array) -> pa.Array:
        good = pa.compute.equal(pa.compute.fill_null(pa.compute.list_value_length(vectors), -1), size)
        x = vectors.filter(good).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        cos = np.divide(x @ unit.T, norm, out=np.zeros((len(x), len(unit))), where=norm != 0)
        at = np.flatnonzero(good.to_numpy(zero_copy_only=False))[np.isfinite(cos).all(axis=1)]
        sizes = np.zeros(len(vectors), np.int64)
        sizes[at] = len(unit)
        missing = np.append(sizes == 0, False)
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=missing)
        return pa.ListArray.from_arrays(offsets, pa.array(cos[np.isfinite(cos).all(axis=1)].ravel()))

    return F.arrow_udf(score, T.ArrayType(T.DoubleType()))(v)


def refined(found: DataFrame, syntactic: DataFrame, named: DataFrame, id_col: str) -> DataFrame:
    """``(id, intent, score, rank)``: intents that vectors found, raised by the entities named, and those of patterns alone at 0.6.

    ``found(id, intent, score)``, ``syntactic(id, intent)`` and ``named(id, kind)``. Equal scores are ranked by the intent's name.
    """
    kinds = named.groupBy(id_col).agg(F.collect_set("kind").alias("kinds"))
    boost = F.lit(0.0)
    for intent, wanted, more in BOOSTS:
        boost = F.when((F.col("intent") == intent) & F.coalesce(F.arrays_overlap("kinds", F.array(*[F.lit(w) for w in wanted])), F.lit(False)), F.lit(more)).otherwise(boost)
    raised = found.join(kinds, id_col, "left").select(id_col, "intent", F.when(boost > 0, F.least(F.lit(1.0), F.col("score") + boost)).otherwise(F.col("score")).alias("score"))
    alone = syntactic.select(id_col, "intent").distinct().join(found, [id_col, "intent"], "left_anti").withColumn("score", F.lit(FOUND))
    order = Window.partitionBy(id_col).orderBy(F.desc("score"), "intent")
    return raised.unionByName(alone).withColumn("rank", F.row_number().over(order))


def near_entities(near: DataFrame, id_col: str) -> DataFrame:
    """``(id, kind, value, confidence)`` of ``near(id, kind, name, score, rank)``: the nearest rows of each type that score enough."""
    keep, confidence = F.lit(False), F.lit(None).cast("double")
    for kind, (most, least, more, top) in NEAREST.items():
        own = F.col("kind") == kind
        keep = keep | (own & (F.col("rank") <= most) & (F.col("score") >= least))
        confidence = F.when(own, F.least(F.lit(top), F.col("score") + more)).otherwise(confidence)
    return near.where(keep).select(id_col, "kind", F.lower("name").alias("value"), confidence.alias("confidence"))


def best_entities(parts: Mapping[str, DataFrame], id_col: str) -> DataFrame:
    """``(id, kind, value, confidence, origin, rank)``: of equal entities the most confident, of equal confidence the first origin's, best first."""
    every = reduce(DataFrame.unionByName, [df.select(id_col, "kind", "value", "confidence", F.lit(k).alias("place"), F.lit(name).alias("origin")) for k, (name, df) in enumerate(parts.items())])
    one = every.groupBy(id_col, "kind", "value").agg(F.max(F.struct("confidence", (-F.col("place")).alias("first"), "origin")).alias("b")).select(id_col, "kind", "value", "b.confidence", "b.origin")
    return one.withColumn("rank", F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("confidence"), "kind", "value")))
