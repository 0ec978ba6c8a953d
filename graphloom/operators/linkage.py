"""Record linkage of free-text names to a taxonomy: exact, then edit distance, else orphan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import match_key, stable_id

MAX_DISTANCE, MIN_LENGTH = 2, 2
#: Candidates that an ambiguous name lists for its review.
MOST_SHOWN = 1000


#: Names up to this length are compared by what is left of them when letters are left out, longer ones by equal pieces.
SHORT = 8


def left_out(name: Column, most: int) -> Column:
    """The name and what is left of it with up to ``most`` letters left out, each once."""
    every = now = F.array(name)
    for _ in range(most):
        # sequences run backwards where there is nothing, so they are cut to the length
        one = lambda x: F.transform(F.slice(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), 1, F.length(x)), lambda i: F.concat(F.substr(x, F.lit(1), i - 1), F.substr(x, i + 1)))
        now = F.array_distinct(F.flatten(F.transform(now, one)))
        every = F.array_union(every, now)
    return every


def _short_pairs(names: DataFrame, taxonomy: DataFrame, distance: int) -> DataFrame:
    """``(name, candidate)``: pairs that are equal when up to ``distance`` letters are left out of each, as all within that edit distance are."""
    key = lambda df, c: df.select(c, F.explode(left_out(F.col(c), distance)).alias("rest"))
    known = taxonomy.where(F.length("candidate") <= SHORT + distance)
    return key(names, "name").join(key(known, "candidate"), "rest").select("name", "candidate")


def fuzzy_pairs(names: DataFrame, taxonomy: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """``(name, candidate, d)``: pairs of ``names(name)`` and ``taxonomy(candidate)`` within an edit distance.

    Names of up to ``SHORT`` letters share what is left of them when some are left out. Of longer ones, strings within
    distance d differ in length by at most d, and one of d + 1 equal cuts of
    the taxonomy string stands unchanged in the other, at most d places away. Names are
    expanded to these keys, so the join is an equi-join on (length, cut, text).
    """
    short = _short_pairs(names.where(F.length("name") <= SHORT), taxonomy, distance)
    names = names.where(F.length("name") > SHORT)
    cuts = distance + 1
    start = lambda size, k: F.floor(size * k / cuts).cast("int")
    known = taxonomy.withColumn("size", F.length("candidate")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(cuts - 1))))
    known = known.withColumn("at", start(F.col("size"), F.col("k"))).withColumn("piece", F.substring("candidate", F.col("at") + 1, start(F.col("size"), F.col("k") + 1) - F.col("at")))
    probe = names.withColumn("size", F.explode(F.sequence(F.greatest(F.length("name") - distance, F.lit(0)), F.length("name") + distance)))
    probe = probe.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(cuts - 1)))).withColumn("shift", F.explode(F.sequence(F.lit(-distance), F.lit(distance))))
    begin = start(F.col("size"), F.col("k"))
    probe = probe.withColumn("begin", begin + F.col("shift")).withColumn("wide", start(F.col("size"), F.col("k") + 1) - begin)
    probe = probe.where((F.col("begin") >= 0) & (F.col("begin") + F.col("wide") <= F.length("name"))).withColumn("piece", F.substring("name", F.col("begin") + 1, F.col("wide")))
    near = probe.select("name", "size", "k", "piece").join(known.select("candidate", "size", "k", "piece"), ["size", "k", "piece"]).select("name", "candidate").unionByName(short).distinct()
    # the bounded form gives -1 beyond the distance
    return near.withColumn("d", F.levenshtein("name", "candidate", distance)).where("d >= 0")


def link(names: DataFrame, taxonomy: DataFrame, name_col: str = "name", taxonomy_col: str = "name") -> DataFrame:
    """``(name, match_type, matched, confidence, reason, candidates)`` for each distinct name, against the taxonomy as it is.

    One character or less: orphan ``too_short``. An equal name: ``exact``, confidence 1.
    Exactly one name within distance 2: ``fuzzy``, confidence 1 - d / 10. More: orphan
    ``ambiguous_fuzzy_match``; none: orphan ``no_match``.
    """
    asked = names.select(match_key(F.col(name_col)).alias("name")).where("name is not null").distinct()
    known = taxonomy.select(match_key(F.col(taxonomy_col)).alias("candidate")).where("candidate is not null").distinct()
    long_enough = asked.where(F.length("name") >= MIN_LENGTH)
    exact = long_enough.join(known, asked["name"] == known["candidate"], "left_semi").withColumn("exact", F.lit(True))
    rest = long_enough.join(exact.select("name"), "name", "left_anti")
    # candidates are shown to a reviewer, so the list of a name is cut to what a person reads; their number is whole
    first = F.row_number().over(Window.partitionBy("name").orderBy("candidate"))
    listed = F.collect_list(F.when(F.col("place") <= MOST_SHOWN, F.col("candidate")))
    near = fuzzy_pairs(rest, known).withColumn("place", first).groupBy("name").agg(F.count("*").alias("n"), F.min("d").alias("d"), F.array_sort(listed).alias("candidates"))
    found = asked.join(exact, "name", "left").join(near, "name", "left")
    kind = F.when(F.length("name") < MIN_LENGTH, "orphan").when(F.col("exact"), "exact").when(F.col("n") == 1, "fuzzy").otherwise("orphan")
    reason = F.when(F.length("name") < MIN_LENGTH, "too_short").when(F.col("exact") | (F.col("n") == 1), None).when(F.col("n") > 1, "ambiguous_fuzzy_match").otherwise("no_match")
    return found.select(
        "name",
        kind.alias("match_type"),
        F.when(F.col("exact"), F.col("name")).when(F.col("n") == 1, F.col("candidates")[0]).alias("matched"),
        F.when(F.col("exact"), F.lit(1.0)).when(F.col("n") == 1, F.lit(1.0) - F.col("d") / 10).alias("confidence"),
        reason.alias("reason"),
        F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates"),
    )


def mentions(rows: DataFrame, id_col: str, names: Column, scores: Column) -> DataFrame:
    """``(job_id, position, name, score)``: the names of a list cell with the scores at the same places; null where there are fewer."""
    zipped = F.transform(names, lambda name, k: F.struct((k + 1).alias("position"), name.alias("name"), F.try_element_at(scores, k + 1).try_cast("double").alias("score")))
    return rows.select(F.col(id_col).alias("job_id"), F.explode(zipped).alias("m")).select("job_id", "m.*")


def match_counts(mentions: DataFrame, links: DataFrame) -> DataFrame:
    """``(match_type, mentions, names)``: how often each kind of match came up, and for how many names."""
    said = mentions.groupBy(match_key(F.col("name")).alias("name")).agg(F.count("*").alias("n"))
    return said.join(links.select("name", "match_type"), "name").groupBy("match_type").agg(F.sum("n").alias("mentions"), F.count("*").alias("names"))


def requires_edges(mentions: DataFrame, links: DataFrame) -> DataFrame:
    """``(job_id, matched, score, confidence)``: one edge for each job and matched name, the first mention's score."""
    keyed = mentions.withColumn("name", match_key(F.col("name")))
    rows = keyed.join(links.where("matched is not null").select("name", "matched", "confidence"), "name")
    first = F.min_by(F.struct("score", "confidence"), F.col("position"))
    return rows.groupBy("job_id", "matched").agg(first.alias("f")).select("job_id", "matched", "f.score", "f.confidence")


def review_queue(mentions: DataFrame, links: DataFrame) -> DataFrame:
    """Orphans with their suggestions and the number of jobs that mention them, most wanted first."""
    keyed = mentions.select("job_id", match_key(F.col("name")).alias("name"))
    orphans = links.where("match_type = 'orphan'").select("name", "reason", "candidates")
    rows = keyed.join(orphans, "name").groupBy("name", "reason", "candidates").agg(F.count_distinct("job_id").alias("jobs_requiring_skill"))
    return rows.withColumn("skill_id", stable_id(F.col("name"))).orderBy(F.desc("jobs_requiring_skill"), "name")
