"""Each numbered query against a plain version over a whole small table."""

import base64
import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from graphloom.llm import bpe, caps, langid, minhash, passages, queries
from graphloom.llm.frames import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]


def grams(text, k=5):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or Counter([tuple(w)] if w else [])


def roots(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_links(docs, similar=0.8):
    bags = {i: grams(t) for i, t in docs if grams(t)}
    size = {i: sum(c.values()) for i, c in bags.items()}
    held, links = defaultdict(list), []
    for i, bag in sorted(bags.items()):
        common = Counter()
        for gram, n in bag.items():
            for k, m in held[gram]:
                common[k] += min(n, m)
            held[gram].append((i, n))
        links += [(i, k) for k, c in common.items() if c >= similar * (size[i] + size[k] - c) - 1e-9]
    return links


def ranks():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def test_byte_bpe_equals_tiktoken(spark, docs):
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(), special_tokens={})
    want = {}
    for i, t in docs:
        ids = plain.encode_ordinary(t or "")
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op1_byte_bpe(spark, SF).collect()} == want


def test_byte_bpe_on_odd_texts():
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(), special_tokens={})
    codec = bpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    random = np.random.default_rng(1)
    texts = ["", " ", "aaaaaaaaaaaa", "a b c\x1cd\x1fe", "\U0001f600\U0001f9d1‍\U0001f680", "<|endoftext|>", "don't  WON'T\r\n\n x", "1234567 ½ ́e"]
    texts += ["".join(map(chr, random.integers(1, 0x2000, 60).tolist())) for _ in range(200)]
    for text in texts:
        ids = codec.encode(text)
        assert ids == plain.encode_ordinary(text)
        assert codec.decode_text(ids) == text
        starts, ends = codec.offsets(text, ids)
        assert all(e > s for s, e in zip(starts.tolist(), ends.tolist(), strict=True)) and (not ids or (starts[0] == 0 and ends[-1] == len(text)))


def test_cap_filters_find_all_links(spark):
    rows = table(spark, "/root/testdata/sf0.01", "embeddings").collect()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.op2_cap_filters(spark, "/root/testdata/sf0.01").collect()}
    assert got == cap_links(rows)


def cap_links(rows):
    usable = [r for r in rows if r.label is not None and r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)]
    links, count = [], Counter()
    for label in {r.label for r in usable}:
        own = [r for r in usable if r.label == label]
        v = np.array([r.embedding for r in own], dtype=np.float64)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        for a, b in np.argwhere(np.triu(v @ v.T >= caps.COSINE, 1)).tolist():
            links.append((own[a].vec_id, own[b].vec_id))
            count.update(links[-1])
    root = roots([r.vec_id for r in rows], links)
    return {r.vec_id: (count[r.vec_id], root[r.vec_id], root[r.vec_id] == r.vec_id) for r in rows}


def test_cap_filters_on_dense_groups(spark):
    random = np.random.default_rng(5)
    centers = random.standard_normal((3, 32))
    rows = [(i, (centers[i % 3] + 0.13 * random.standard_normal(32)).tolist(), i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in caps.classes(df).collect()}
    want = cap_links(df.collect())
    missed = sum(w[0] - got[i][0] for i, w in want.items())
    assert all(got[i][0] <= w[0] for i, w in want.items()) and missed <= 0.01 * sum(w[0] for w in want.values())


def test_bag_minhash_classes(spark, docs):
    want = roots([i for i, _ in docs], near_links(docs))
    assert {r.doc_id: r.component for r in queries.op3_bag_minhash(spark, SF).collect()} == want


def test_bag_minhash_on_a_group_of_graded_copies(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 40)
    random = np.random.default_rng(3)
    base, rows = random.integers(0, 10**6, 150), []
    for i in range(300):
        words = base.copy()
        words[random.integers(0, 150, random.choice([0, 1, 3, 6, 9, 12]))] = random.integers(0, 10**6)
        rows.append((i * 7 % 311, " ".join(map(str, words))))
    want = roots([i for i, _ in rows], near_links(rows))
    assert {r.doc_id: r.component for r in minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_bag_minhash_estimates_weighted_jaccard():
    a, b = "x y z w v " * 30 + "p q r s t u", "x y z w v " * 20 + "p q r s t m"
    rows, codes, weights = minhash.multisets(minhash.Words([a, b], minhash.LETTERS))
    registers = minhash.signatures(rows, codes, weights, 2)
    assert abs((registers[0] == registers[1]).mean() - minhash.similarity(a, b)) < 0.12


def test_license_phrases(spark, docs):
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    want = {}
    for i, t in docs:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        found = sorted((k, label) for p, label in phrases.items() for n in [len(p.split())] for k in range(len(w) - n + 1) if w[k : k + n] == p.split())
        starts = [k for k, _ in found]
        want[i] = (len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found})))
    rows = queries.op4_licenses(spark, SF).collect()
    assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows} == want
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in rows)


def removed(docs, window=13):
    first, words = {}, {}
    for i, t in docs:
        words[i] = w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in words.items():
        gone = {j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i for j in range(k, k + window)}
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest())
    return out


@pytest.mark.parametrize(("occurrences", "windows"), [(25_000, 50_000), (20, 60)])
def test_substring_dedup(spark, docs, monkeypatch, occurrences, windows):
    monkeypatch.setattr(passages, "SHARD_OCCURRENCES", occurrences)
    monkeypatch.setattr(passages, "SHARD_WINDOWS", windows)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op5_substring_dedup(spark, SF).collect()} == removed(docs)


def test_secret_patterns(spark, docs):
    kinds = {
        "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
        "access": re.compile(r"AKIA[A-Z0-9]+"),
        "hex": re.compile(r"[0-9a-f]+"),
    }
    long = {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}
    want = {}
    for i, t in docs:
        found = sorted((m.start(), n, kind, m.end()) for n, (kind, p) in enumerate(kinds.items()) for m in p.finditer(t or "") if long[kind](m))
        spelled = ",".join(f"{kind}:{s}:{e}" for s, _, kind, e in found)
        count = Counter(f[2] for f in found)
        want[i] = (count["assign"], count["access"], count["hex"], hashlib.sha256(spelled.encode()).hexdigest())
    rows = queries.op6_secrets(spark, SF).collect()
    assert {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in rows} == want


def test_language_id_keeps_declared_texts(spark):
    rows = queries.op8_language_id(spark, SF).collect()
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    told = [r for r in rows if r.declared in langid.LANGUAGES and len(texts[r.doc_id] or "") >= 100]
    assert sum(r.lang == r.declared for r in told) >= 0.97 * len(told)
    assert sum(r.kept for r in told) >= 0.97 * len(told)


def test_language_id_on_held_out_texts_without_declarations(spark):
    df = table(spark, "/root/testdata/sf0.01", "documents").where("length(text) >= 200")
    model = langid.fit(df.where("doc_id % 2 = 0"), "doc_id", "text", F.col("lang"))
    held = df.where("doc_id % 2 = 1").select("lang", langid.likelihoods(df.text, model, spark.sparkContext).alias("l")).collect()
    told = [r for r in held if r.l is not None and r.lang in langid.LANGUAGES]
    assert sum(langid.LANGUAGES[int(np.argmax(r.l))] == r.lang for r in told) >= 0.97 * len(told)


def test_decontamination(spark, docs):
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    pairs = {}
    keys = lambda text: {g for g in grams(text) if len(g) == 5}
    bags = {i: keys(t) for i, t in docs}
    for item, text in items:
        own = keys(text)
        for i, bag in bags.items():
            if own and len(own & bag) >= 0.8 * len(own):
                pairs[i, item] = (len(own), len(own & bag))
    got = {(r.doc_id, r.item_id): (r.n_shingles, r.n_found) for r in queries.op10_decontamination(spark, SF).collect()}
    assert got == pairs and pairs
