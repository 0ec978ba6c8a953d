"""Language samples at every size, toxicity on held-out rows, resampling and phrases against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from graphloom.llm import frames, langid, phrases, queries, resample, toxicity
from graphloom.llm.frames import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- op8 at the bound of its sample ---


@pytest.mark.parametrize("texts", [1, 50, 60, 61, 69, 70, 71, 72, 73, 500, 10**6, 10**12])
def test_threshold_is_a_long_and_takes_enough(monkeypatch, texts):
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 50)
    bound = langid._threshold(texts)
    assert -(1 << 63) <= bound < 1 << 63
    share = (bound + (1 << 63) + 1) / (1 << 64)
    assert share * texts >= min(texts, 60) - 1e-6


@pytest.mark.parametrize("rows", [40, 41, 48, 400])
def test_language_sample_at_once_the_bound_one_more_and_ten_times(spark, monkeypatch, rows):
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 40)
    words = {"en": "the thing is here and now", "de": "der Baum steht schief und krumm"}
    docs = spark.createDataFrame([(i, f"{words[lang]} {chr(97 + i % 26)}{chr(97 + i // 26)}", lang, f"s{i % 3}", 9) for i in range(rows) for lang in [("en", "de")[i % 2]]], "doc_id long, text string, lang string, source string, n_chars long")
    found = langid.identify(docs).collect()
    assert len(found) == rows and all(r.kept and r.lang == r.declared for r in found)


# --- op11 ---


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = table(spark, sf, "labels").select("doc_id", "toxic")
    rows = queries.op11_ftrl_toxicity(spark, sf).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    toxic, clean = [r for r in held if r.toxic], [r for r in held if not r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.9 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= toxicity.THRESHOLD) for r in rows)


def test_toxicity_never_sees_held_out_labels(spark):
    docs = table(spark, SF, "documents")
    labels = table(spark, SF, "labels")
    other = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = ({(r.doc_id, round(r.score, 12)) for r in toxicity.judge(docs, given).collect()} for given in (labels, other))
    assert one == two


def test_toxicity_odd_rows(spark):
    kind = "doc_id long, text string, label string, score string"
    plain, bad = "we went out to see the garden", "we went out you rotten thing"
    rows = [(i, (bad if i % 2 else plain) + f" again {'xyz'[i % 3]}{i}", None, "s") for i in range(40)]
    odd = [(None, bad, None, None), (50, None, "x", "y"), (51, "", None, None), (52, "!!! ...", None, None), (53, bad * 5000, None, None), (53, plain, None, None)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 0), (None, 1), (51, None)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows + odd, kind)
    found = toxicity.judge(docs, labels).collect()
    assert len(found) == len(rows) + len(odd)
    score = defaultdict(list)
    for r in found:
        score[r.doc_id].append(r)
    assert score[50][0].score == score[51][0].score == score[52][0].score
    assert score[None][0].predicted == 1 and not score[None][0].held_out
    assert sorted(r.predicted for r in score[53]) == [0, 1]
    # an id with two labels counts as toxic; it teaches, so it is told as such
    assert score[1][0].predicted == 1
    assert toxicity.judge(docs.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.judge(docs, labels.limit(0)).collect()} == {0.5}


def test_toxicity_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 500)
    sf = "/root/testdata/sf0.1"
    rows = queries.op11_ftrl_toxicity(spark, sf).join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    assert sum(r.predicted for r in rows if r.toxic) >= 0.6 * sum(r.toxic for r in rows)
    assert sum(r.predicted for r in rows if not r.toxic) <= 0.01 * len(rows)


# --- op12 ---


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def plain_resample(docs, target, longest, buckets, percent, least):
    def features(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    of = [features(t) for _, t in docs]
    s, t = Counter(b for f in of for b in f), Counter(b for x in target for b in features(x))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in s}
    out, fit = [], []
    for (i, text), f in zip(docs, of, strict=True):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None])
        if len(words(text)) >= least and i is not None:
            fit.append(out[-1])
    fit.sort(key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(fit[: len(fit) * percent // 100], 1):
        r[4] = k
    return sorted(map(tuple, out), key=repr)


def test_resampling_equals_sql(spark, duck):
    got = duck.execute(queries.ORACLE["op12_resampling"]).fetchall()
    found = queries.op12_resampling(spark, SF).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, found), key=repr) == sorted(got, key=repr)


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_equals_plain(spark, monkeypatch, longest):
    monkeypatch.setattr(frames, "NUMBERED_ROWS", 20)
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    docs += [(None, "a b c"), (None, None), (900, None), (901, ""), (902, "..."), (903, "Ärger Écoute straße " * 3000), (903, "twice the same id")]
    target = [r.text for r in table(spark, SF, "benchmark").collect()] + [None, ""]
    found = resample.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string"), longest=longest, buckets=997, percent=30, least_words=10)
    assert sorted(map(tuple, found.collect()), key=repr) == plain_resample(docs, target, longest, 997, 30, 10)


def test_resampling_of_nothing(spark):
    docs = spark.createDataFrame([(1, "x", "some words here", 5)], "doc_id long, id string, text string, rank int")
    none = docs.limit(0)
    assert resample.resample(none, docs).count() == 0
    assert [tuple(r) for r in resample.resample(docs, none).collect()] == plain_resample([(1, "some words here")], [], 1, 10_000, 10, 20)


# --- op13 ---


def plain_phrases(docs, longest, least, covered, first):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        rows, most = [], Counter()
        for p, a in counts.items():
            if len(p) > 1 and a >= least:
                score, k = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]], p))
                for size in range(2, len(p)):
                    for i in range(len(p) - size + 1):
                        most[p[i : i + size]] = max(most[p[i : i + size]], a)
        rows = sorted(r for r in rows if not most[r[5]] or 100 * most[r[5]] < covered * -r[1])[:first]
        out += [(lang, k, r[2].decode(), -r[1], r[3], r[4], n[lang], -r[0]) for k, r in enumerate(rows, 1)]
    return sorted(out)


def test_phrases_equal_sql(spark, duck):
    got = duck.execute(queries.ORACLE["op13_phrases"]).fetchall()
    assert got and sorted(map(tuple, queries.op13_phrases(spark, SF).collect())) == sorted(got)


@pytest.mark.parametrize(("longest", "keys"), [(3, 0), (4, 4_000_000), (4, 30), (2, 4_000_000)])
def test_phrases_equal_plain(spark, monkeypatch, longest, keys):
    """On both sides of the bound of broadcast keys, in small segments, with few first rows of many parts."""
    monkeypatch.setattr(phrases, "SEGMENT_BYTES", 4000)
    monkeypatch.setattr(frames, "NUMBERED_ROWS", 40)
    monkeypatch.setattr(phrases, "PART_KEYS", 3000)
    docs = [(r.lang, r.text) for r in table(spark, SF, "documents").limit(120).collect()]
    docs += [(None, "New York, new york\tnew york new\nyork " * 9), (None, None), ("de", ""), ("", "a b c a b c " * 30), ("x y", " \t..!? "), ("x y", "x\x0by z\xa0w x " * 12), (None, "same same same same same same")]
    df = spark.createDataFrame(docs, "lang string, text string").withColumn("phrase", F.lit(1)).withColumn("key", F.lit(2))
    found = phrases.collocations(df, longest=longest, least=4, first=50, broadcast_keys=keys)
    assert sorted(map(tuple, found.collect())) == plain_phrases(docs, longest, 4, 50, 50)


def test_phrases_of_nothing(spark):
    docs = spark.createDataFrame([("en", None)], "lang string, text string")
    assert phrases.collocations(docs).count() == phrases.collocations(docs.limit(0)).count() == 0
