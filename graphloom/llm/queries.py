"""The numbered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, caps, decontaminate, html, langid, licenses, minhash, passages, phrases, resample, secrets, toxicity, urls
from graphloom.llm.frames import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register a query under its function's name."""
    QUERIES[run.__name__] = run
    return run


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


@query
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.spelled(base), 256).alias("base_sha256"), secrets.spelled(F.col("spans")).alias("spans")
    )


@query
def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    every = F.array_sort(F.array_union("base_labels", F.transform("spans", lambda s: s["label"])))
    return found.select(
        "doc_id",
        "n_words",
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").alias("first_word"),
        F.array_max("starts").alias("last_word"),
        F.concat_ws(",", "base_labels").alias("base_labels"),
        F.concat_ws(",", every).alias("labels"),
        "score",
    )


#: Rules of the page filter: verdict, then host and path.
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


@query
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES).drop("bad_rate")


_TWO = ", ".join(f"'{s}'" for s in urls.TWO_LABEL_SUFFIXES)
_LAST = lambda n: f"array_to_string(list_slice(string_split(host, '.'), -{n}, -1), '.')"
_RHO = "least(0.99, greatest(0.001, coalesce((sum((k - n * m) * (k - n * m)) - sum(n * m * (1 - m))) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0)))"
ORACLE["op9_url_filter"] = f"""
WITH parsed AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
fits AS (
  SELECT *, (host = 'org' OR host LIKE '%.org') AS org, (host = 'example.org' OR host LIKE '%.example.org') AS ex, (host = 'com' OR host LIKE '%.com') AS com FROM parsed),
ruled AS (
  SELECT page_id, host, path,
         CASE WHEN ex AND starts_with(path, '/en/1') THEN 'example.org/en/1' WHEN ex AND starts_with(path, '/es/') THEN 'example.org/es/'
              WHEN com AND starts_with(path, '/de/') THEN 'com/de/' WHEN com AND starts_with(path, '/fr/') THEN 'com/fr/'
              WHEN org AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM fits),
outcome AS (
  SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS verdict FROM ruled),
hosts AS (
  SELECT host, CASE WHEN {_LAST(2)} IN ({_TWO}) THEN {_LAST(3)} ELSE {_LAST(2)} END AS domain,
         CASE WHEN {_LAST(2)} IN ({_TWO}) THEN {_LAST(2)} ELSE {_LAST(1)} END AS suffix,
         count(verdict) AS n, count(*) FILTER (verdict = 'block') AS k
  FROM outcome GROUP BY host),
domains AS (SELECT domain, suffix, sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY suffix),
top AS (SELECT (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2) AS m FROM suffixes),
s1 AS (SELECT suffix, n, k, m FROM suffixes, top),
r1 AS (SELECT 1 / {_RHO} - 1 AS s FROM s1),
s2 AS (SELECT domain, d.n, d.k, (s1.k + r1.s * s1.m) / (s1.n + r1.s) AS m FROM domains d JOIN s1 USING (suffix), r1),
r2 AS (SELECT 1 / {_RHO} - 1 AS s FROM s2),
s3 AS (SELECT host, h.n::DOUBLE AS n, h.k::DOUBLE AS k, (s2.k + r2.s * s2.m) / (s2.n + r2.s) AS m FROM hosts h JOIN s2 USING (domain), r2),
r3 AS (SELECT 1 / {_RHO} - 1 AS s FROM s3),
post AS (SELECT host, k + s * m AS a, n - k + s * (1 - m) AS b, (k + s * m) / (n + s) AS rate FROM s3, r3),
bound AS (SELECT host, rate - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS lower FROM post)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN lower > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM outcome JOIN bound USING (host)
"""


@query
def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents")).select("doc_id", "declared", "lang", F.round("posterior", 6).alias("posterior"), "kept")


@query
def page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator of op8 over whole pages with all its evidence: main text, ``lang`` attribute, address suffix and host."""
    pages = html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    found = langid.identify(pages, "page_id", "text", None, None, "url", "html")
    return found.select("page_id", "declared", "lang", F.round("posterior", 6).alias("posterior"), "kept")


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op3_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents"))


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = passages.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op2_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.classes(table(spark, sf_dir, "embeddings"))


@query
def op11_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format
_WORDS = f"regexp_extract_all({_LOWER('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')".replace("\\\\", "\\")
# the table of CRC-32 by its polynomial, then one step for each byte of a distinct word
ORACLE["op12_resampling"] = f"""
WITH RECURSIVE steps AS (
  SELECT range AS byte, range::BIGINT AS c, 0 AS k FROM range(256)
  UNION ALL
  SELECT byte, CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY byte) AS crc FROM steps WHERE k = 8),
tokens AS (SELECT doc_id, unnest({_WORDS}) AS word FROM documents),
wanted AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
vocabulary AS (SELECT word, hex(encode(word)) AS spelled FROM (SELECT word FROM tokens UNION SELECT word FROM wanted)),
spelled AS (
  SELECT word, [4294967295::BIGINT] || [('0x' || spelled[2 * i - 1 : 2 * i])::BIGINT FOR i IN range(1, len(spelled) // 2 + 1)] AS bytes
  FROM vocabulary),
hashed AS (
  SELECT word, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM spelled, crc_table),
corpus AS (SELECT bucket, count(*) AS n FROM tokens JOIN hashed USING (word) GROUP BY bucket),
target AS (SELECT bucket, count(*) AS n FROM wanted JOIN hashed USING (word) GROUP BY bucket),
gain AS (
  SELECT c.bucket,
         floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM corpus)::DOUBLE + 10000)
                         / ((c.n + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM target), 0)::DOUBLE + 10000))))::BIGINT AS gain
  FROM corpus c LEFT JOIN target t USING (bucket)),
features AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS total FROM tokens JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
weighed AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(floor(total::DOUBLE / n_features), 0)::BIGINT AS weight,
         ('0x' || left(sha256('2024:' || doc_id), 8))::BIGINT AS h
  FROM (SELECT doc_id FROM documents) LEFT JOIN features USING (doc_id)),
scored AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM weighed),
ranked AS (
  SELECT *, n_features >= 20 AS fit, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
         count(*) FILTER (n_features >= 20) OVER () AS n
  FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= 10 * n // 100 THEN place END AS rank FROM ranked
"""


@query
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


ORACLE["op13_phrases"] = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM split GROUP BY lang),
runs AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS pos FROM split),
grams AS (SELECT lang, size, w[pos : pos + size - 1] AS g FROM runs, (SELECT unnest([1, 2, 3]) AS size) WHERE pos + size - 1 <= len(w)),
f AS (SELECT lang, size, g, count(*)::HUGEINT AS f FROM grams GROUP BY lang, size, g HAVING count(*) >= 10),
cuts AS (
  SELECT c.lang, c.size, c.g, c.f AS a, k, l.f AS l, r.f AS r, (1000000 * c.f * c.f) // (l.f * r.f) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM f WHERE size > 1) c
  JOIN f l ON l.lang = c.lang AND l.g = c.g[1:k] JOIN f r ON r.lang = c.lang AND r.g = c.g[k + 1:]),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inner_pairs AS (
  SELECT lang, g[1:2] AS g, f FROM f WHERE size = 3 UNION ALL SELECT lang, g[2:3], f FROM f WHERE size = 3),
held AS (SELECT lang, g, max(f) AS most FROM inner_pairs GROUP BY lang, g),
kept AS (
  SELECT s.lang, array_to_string(s.g, ' ') AS phrase, s.a, s.l, s.r, s.score
  FROM scored s LEFT JOIN held h ON h.lang = s.lang AND h.g = s.g WHERE h.most IS NULL OR 100 * h.most < 50 * s.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
