"""Language identification by Bayesian evidence fusion.

Four sources of evidence are added as logarithms: byte-trigram likelihoods of the text
(with a uniform background model that stands for "no known language"), the declared
language (a column, or the ``lang`` attribute of a page's markup), the language that an
address suffix suggests, and a prior of the host, smoothed from host to registered domain
to the whole corpus. Host priors are counts by grouped aggregation over all rows; the
trigram model is fitted on a bounded sample of rows with a declared language
(``SAMPLE_ROWS``, the rows with the lowest hashes of id and text, each text once).

Trigrams of one text are not independent, so n of them count as ``WEIGHT`` times
``TEMPER * log(1 + n / TEMPER)`` independent ones: evidence grows with every trigram of a
text, the more slowly the longer it is.

Defined results: a null or empty text, or one without letters, is rejected and has no
language; a single letter is judged like any other text; an unknown or null declaration,
address or host is no evidence; very long texts are read whole; equal posteriors give the
first language in alphabetical order; rows that repeat an id are judged each by itself;
other columns are kept by :func:`keep` and ignored by :func:`identify`; an empty table
gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.frames import cut_lineage, drop_rows, join_spread
from graphloom.llm.urls import domain_of, host_of, suffix_of

LANGUAGES = ("de", "en", "es", "fr")
#: Rows that the trigram model is fitted on, at most; the rest of the work covers all rows.
SAMPLE_ROWS = 8_000
BUCKETS = 1 << 14
#: Share of a language's trigrams that come from names and other words that no sample holds; they may be any.
FOREIGN = 0.05
#: How the evidence of a text's trigrams grows with their number, see above.
TEMPER, WEIGHT = 200.0, 0.25
#: Chances that a declaration or an address suffix names the language of the text.
DECLARED_RIGHT, SUFFIX_RIGHT = 0.9, 0.7
#: Rows' worth of the parent's rates in a host's or domain's prior.
HOST_STRENGTH = 20.0
#: Least posterior of the best language, against the others and the background.
POSTERIOR = 0.5
#: Share of texts in no known language, beforehand.
BACKGROUND = 0.01
#: Address suffixes of countries and the language they suggest.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en"}


def trigrams(text: str | None) -> np.ndarray:
    """Buckets of the byte trigrams of a text's lower-case words, one space between words."""
    raw = np.frombuffer((" " + (text or "").lower() + " ").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    letter = (raw >= 0x80) | ((raw >= 0x61) & (raw <= 0x7A))
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # the one byte after a word is its space
    if not letter.any():
        return np.zeros(0, np.int64)
    x = np.where(letter, raw, 0x20)[kept].astype(np.uint32)
    x = np.concatenate([np.array([0x20], np.uint32), x])
    code = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(18)).astype(np.int64)


#: The declaration of a page: the attribute of its first element that has one.
_LANG = r"""(?is)^[^<]*(?:<[!?][^>]*>[^<]*)*<html\b(?:[^>"']|"[^"]*"|'[^']*')*?\slang\s*=\s*["']?([a-z]{2})"""


def declared_in(markup: Column) -> Column:
    """The language that a page's ``html`` element declares, of two letters; null if none."""
    found = F.lower(F.regexp_extract(F.coalesce(markup, F.lit("")), _LANG, 1))
    return F.when(found != "", found)


def fit(df: DataFrame, id_col: str, text_col: str, declared: Column) -> np.ndarray:
    """Log rates of the buckets, by language: counted on a bounded sample of declared rows.

    A text that is repeated, whatever how often, is taken once. The number of distinct texts
    sets a threshold for the hash of id and text a little above the bound's share; of the
    rows below it, those with the lowest hashes are taken.
    """
    labelled = df.where(declared.isin(*LANGUAGES)).select(declared.alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key"))
    firsts = labelled.groupBy("key").agg(F.min(F.xxhash64("id", "key")).alias("at"))
    firsts = cut_lineage(firsts)
    texts = firsts.count()
    chosen = firsts if texts <= SAMPLE_ROWS else firsts.where(F.col("at") <= F.lit(_threshold(texts))).orderBy("at", "key").limit(SAMPLE_ROWS)
    # as many rows as the bound says at most
    sample = labelled.withColumn("at", F.xxhash64("id", "key")).join(F.broadcast(chosen), ["key", "at"]).dropDuplicates(["key"]).select("lang", "text")

    def count(batches):
        total = np.zeros((len(LANGUAGES), BUCKETS), dtype=np.int64)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[LANGUAGES.index(lang)] += np.bincount(trigrams(text), minlength=BUCKETS)
        for i in range(len(LANGUAGES)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total[i]], pa.list_(pa.int64()))], names=["lang", "counts"])

    counts = np.zeros((len(LANGUAGES), BUCKETS))
    parts = sample.mapInArrow(count, "lang int, counts array<long>").select("lang", F.posexplode("counts").alias("bucket", "n")).where("n > 0")
    # one row for each language and bucket at most
    for lang, bucket, n in parts.groupBy("lang", "bucket").agg(F.sum("n")).toLocalIterator():
        counts[lang, bucket] = n
    rates = (counts + 0.05) / (counts.sum(axis=1, keepdims=True) + 0.05 * BUCKETS)
    return np.log((1 - FOREIGN) * rates + FOREIGN / BUCKETS).astype(np.float32)


def _threshold(texts: int) -> int:
    """A bound on signed 64-bit hashes that about a fifth more than the sample's share stay below; in whole numbers."""
    wanted = SAMPLE_ROWS + SAMPLE_ROWS // 5 + 10
    return (1 << 63) - 1 if wanted >= texts else (wanted << 64) // texts - (1 << 63)


def likelihoods(text: Column, model: np.ndarray, context) -> Column:
    """``array<double>``: log likelihood of the text for each language less that of the background; null without letters."""
    shared = context.broadcast(model)

    def score(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            grams = trigrams(t)
            if not len(grams):
                out.append(None)
                continue
            mean = shared.value[:, grams].mean(axis=1, dtype=np.float64) + np.log(BUCKETS)
            out.append((mean * (WEIGHT * TEMPER * np.log1p(len(grams) / TEMPER))).tolist())
        return pa.array(out, pa.list_(pa.float64()))

    return F.arrow_udf(score, T.ArrayType(T.DoubleType()))(text)


def _log_right(named: Column, lang: str, right: float) -> Column:
    wrong = (1 - right) / (len(LANGUAGES) - 1)
    return F.when(named == lang, F.lit(float(np.log(right)))).when(named.isin(*LANGUAGES), F.lit(float(np.log(wrong)))).otherwise(F.lit(0.0))


def identify(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str | None = "lang", host_col: str | None = "source", url_col: str | None = None, html_col: str | None = None, model: np.ndarray | None = None
) -> DataFrame:
    """``(id, text_key, declared, lang, posterior, kept)`` for each row.

    The declaration comes from ``html_col`` if there is one, else from ``declared_col``; the
    host from ``url_col`` if there is one, else from ``host_col``; the suffix from the URL.
    ``model`` takes the place of one fitted on these rows.
    """
    spark = df.sparkSession
    nothing = F.lit(None).cast("string")
    declared = declared_in(F.col(html_col)) if html_col else F.col(declared_col) if declared_col else nothing
    model = fit(df, id_col, text_col, declared) if model is None else model
    host = host_of(F.col(url_col)) if url_col else F.col(host_col) if host_col else nothing
    suffix = suffix_of(host) if url_col else nothing
    suggested = reduce(lambda rest, item: F.when(suffix == item[0], F.lit(item[1])).otherwise(rest), SUFFIXES.items(), nothing)
    scored = df.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), declared.alias("declared"), F.coalesce(host, F.lit("")).alias("host"),
        suggested.alias("suggested"), likelihoods(F.col(text_col), model, spark.sparkContext).alias("text"),
    )
    rows = cut_lineage(scored)

    best = F.array_position(F.col("text"), F.array_max("text")) - 1
    sums = [F.sum((F.col("best") == i).cast("long")).alias(f"c{i}") for i in range(len(LANGUAGES))]
    hosts = rows.where(F.col("text").isNotNull()).select("host", domain_of(F.col("host")).alias("domain"), best.alias("best")).groupBy("host", "domain").agg(*sums)
    hosts = cut_lineage(hosts)
    counts = [f"c{i}" for i in range(len(LANGUAGES))]
    domains = hosts.groupBy("domain").agg(*[F.sum(c).alias(f"d{c}") for c in counts])
    total = domains.agg(*[F.coalesce(F.sum(f"d{c}"), F.lit(0)).alias(c) for c in counts]).first()
    corpus = np.array([total[c] + 1.0 for c in counts])
    corpus /= corpus.sum()
    s = HOST_STRENGTH
    in_domain = sum((F.col(f"d{c}") for c in counts), F.lit(0))
    rated = domains.select("domain", *[((F.col(f"d{c}") + s * corpus[i]) / (in_domain + s)).alias(f"r{i}") for i, c in enumerate(counts)])
    of_host = sum((F.col(c) for c in counts), F.lit(0))
    priors = join_spread(hosts, rated, ["domain"], how="inner").select("host", *[F.log((F.col(c) + s * F.col(f"r{i}")) / (of_host + s)).alias(f"p{i}") for i, c in enumerate(counts)])

    joined = join_spread(rows, priors, ["host"])
    evidence = [
        F.element_at("text", i + 1) + F.coalesce(f"p{i}", F.lit(float(np.log(corpus[i])))) + _log_right(F.col("declared"), lang, DECLARED_RIGHT) + _log_right(F.col("suggested"), lang, SUFFIX_RIGHT)
        for i, lang in enumerate(LANGUAGES)
    ]
    fused = joined.select("id", "text_key", "declared", F.array(*[e + float(np.log(1 - BACKGROUND)) for e in evidence], F.lit(float(np.log(BACKGROUND)))).alias("e"), F.col("text").isNotNull().alias("read"))
    top = F.array_max("e")
    whole = F.aggregate("e", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("top")))
    names = F.array(*[F.lit(lang) for lang in LANGUAGES], F.lit(None).cast("string"))
    judged = fused.withColumn("top", top).select(
        "id", "text_key", "declared",
        F.when(F.col("read"), F.element_at(names, F.array_position("e", F.col("top")).cast("int"))).alias("lang"),
        F.when(F.col("read"), 1 / whole).alias("posterior"),
    )
    return judged.withColumn("kept", F.col("lang").isNotNull() & (F.col("posterior") >= POSTERIOR)).withColumnRenamed("id", id_col)


def keep(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang", host_col: str | None = "source", url_col: str | None = None) -> DataFrame:
    """The rows whose language is known, with all their columns unchanged."""
    rejected = identify(df, id_col, text_col, declared_col, host_col, url_col).where(~F.col("kept")).select(id_col, "text_key")
    return drop_rows(df, rejected, id_col, text_col)
