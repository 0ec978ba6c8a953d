"""Significance, quantiles, centrality over mixed edges and short names against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import significance as s
from graphloom.operators import centrality, linkage, quantiles


def t_tail(t, df):
    """Two-sided p-value of Student's t in closed form, for whole degrees of freedom."""
    theta = math.atan(abs(t) / math.sqrt(df))
    c, sn = math.cos(theta), math.sin(theta)
    if df % 2:
        total, term = 0.0, c
        for k in range(1, (df - 1) // 2 + 1):
            total += term
            term *= c * c * 2 * k / (2 * k + 1)
        inside = 2 / math.pi * (theta + sn * total)
    else:
        total, term = 0.0, 1.0
        for k in range(1, df // 2 + 1):
            total += term
            term *= c * c * (2 * k - 1) / (2 * k)
        inside = sn * total
    return 1 - inside


def test_p_values_of_t(spark):
    cases = [(t, df) for t in (0.0, 0.3, 1.0, 2.5, -4.0, 9.0, 0.001) for df in (1, 2, 3, 4, 7, 30, 101, 1000)]
    rows = spark.createDataFrame([(*c, k) for k, c in enumerate(cases)], "t double, df int, k int").select("k", s.t_p_value(F.col("t"), F.col("df")).alias("p")).collect()
    for r in rows:
        assert math.isclose(r.p, t_tail(*cases[r.k]), abs_tol=1e-9), cases[r.k]
    odd = spark.createDataFrame([(None, 3), (1.0, 0), (float("nan"), 3), (1.0, None)], "t double, df int").select(s.t_p_value(F.col("t"), F.col("df")).alias("p"))
    assert [r.p for r in odd.collect()] == [None] * 4


def test_log_gamma_and_beta(spark):
    xs = [0.5, 1.0, 1.5, 2.0, 3.7, 10.0, 250.5, 1e6]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", s.log_gamma(F.col("x")).alias("g")).collect()
    assert all(math.isclose(r.g, math.lgamma(r.x), rel_tol=1e-12, abs_tol=1e-12) for r in rows)
    # I_x(a, b) for whole a and b is a binomial tail
    cases = [(a, b, x) for a in (1, 2, 5, 40) for b in (1, 3, 17) for x in (0.0, 0.01, 0.3, 0.77, 1.0)]
    rows = spark.createDataFrame(cases, "a int, b int, x double").select("a", "b", "x", s.beta_share(F.col("a"), F.col("b"), F.col("x")).alias("i")).collect()
    for r in rows:
        n = r.a + r.b - 1
        assert math.isclose(r.i, sum(math.comb(n, j) * r.x**j * (1 - r.x) ** (n - j) for j in range(r.a, n + 1)), abs_tol=1e-10)


def test_correlation_welch_and_alpha(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 3))
    x[:, 1] += 0.5 * x[:, 0]
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in x] + [(1.0, None, 2.0)], "a double, b double, c double")
    r = np.corrcoef(x[:, 0], x[:, 1])[0, 1]
    found = df.where("b IS NOT NULL").agg(s.pearson_p_value(F.corr("a", "b"), F.count("b")).alias("p"), F.corr("a", "b").alias("r")).first()
    assert math.isclose(found.p, t_tail(r * math.sqrt(38 / (1 - r * r)), 38), abs_tol=1e-9) and math.isclose(found.r, r, abs_tol=1e-9)
    stats = [df.agg(F.avg(c).alias("m"), F.var_samp(c).alias("v"), F.count(c).alias("n")).first() for c in ("a", "c")]
    one = spark.range(1).select(*[F.lit(v).alias(n) for n, v in zip(("ma", "va", "na", "mb", "vb", "nb"), [*stats[0], *stats[1]], strict=True)])
    t, dfree, p = s.welch(*[F.col(c) for c in ("ma", "va", "na", "mb", "vb", "nb")])
    w = one.select(t.alias("t"), dfree.alias("df"), p.alias("p")).first()
    assert 70 < w.df < 82 and min(t_tail(w.t, math.floor(w.df)), t_tail(w.t, math.ceil(w.df))) <= w.p <= max(t_tail(w.t, math.floor(w.df)), t_tail(w.t, math.ceil(w.df)))
    alpha = df.agg(s.cronbach_alpha(["a", "b", "c"]).alias("x")).first().x
    assert math.isclose(alpha, 1.5 * (1 - x.var(axis=0, ddof=1).sum() / x.sum(axis=1).var(ddof=1)), abs_tol=1e-9)


@pytest.mark.parametrize("bins", [2, 5, 1024])
def test_quantiles(spark, monkeypatch, bins):
    monkeypatch.setattr(quantiles, "BINS", bins)
    rng = random.Random(bins)
    groups = {"even": list(range(100)), "ties": [1.0] * 50 + [2.0] * 50, "one": [7.5], "wild": [10.0 ** rng.uniform(-12, 12) * rng.choice([1, -1]) for _ in range(60)], None: [rng.random() for _ in range(31)], "huge": [-1.7e308, 1.7e308, 0.0]}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("even", None), ("even", float("nan")), ("empty", None)]
    rng.shuffle(rows)
    shares = (0.0, 0.25, 0.5, 0.9, 1.0)
    found = {(r.g, r.share): r.quantile for r in quantiles.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", shares).collect()}
    assert len(found) == len(groups) * len(shares)
    for g, vs in groups.items():
        for share in shares:
            want = np.quantile(np.array(vs, float), share) if g != "huge" else sorted(vs)[int(share * 2)] if share in (0.0, 0.5, 1.0) else found[g, share]
            assert math.isclose(found[g, share], want, rel_tol=1e-9, abs_tol=1e-15), (g, share)


def dense(links):
    nodes = sorted({x for e in links for x in e})
    at = {n: i for i, n in enumerate(nodes)}
    m = np.zeros((len(nodes), len(nodes)))
    for a, b in links:
        m[at[b], at[a]] = 1
    return nodes, m


def test_centrality_of_mixed_edges_and_pagerank(spark):
    rng = random.Random(11)
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    # two groups with few edges between them: the second eigenvalue is near the first
    near = [(rng.randrange(30) + 100 * g, rng.randrange(30) + 100 * g) for g in (0, 1) for _ in range(90)] + [(0, 100)]
    ahead = [(rng.randrange(30), 100 + rng.randrange(30)) for _ in range(3)] + [(5, 500), (None, 3), (7, 7)]
    links = centrality.mixed([frame(near)], [frame(ahead)])
    pairs = [(r.src, r.dst) for r in links.collect()]
    assert set(pairs) == {p for a, b in near if a != b for p in ((a, b), (b, a))} | {(a, b) for a, b in ahead if a is not None and a != b}
    nodes, m = dense(pairs)
    x = np.ones(len(nodes))
    for _ in range(20_000):
        x = m @ x + x
        x /= np.linalg.norm(x)
    found = centrality.eigenvector(links, 1e-5).collect()
    assert all(r.converged for r in found) and max(abs(r.centrality - x[nodes.index(r.node)]) for r in found) < 1e-3
    out = m.sum(axis=0)
    p = np.ones(len(nodes)) / len(nodes)
    for _ in range(500):
        p = 0.15 / len(nodes) + 0.85 * (m @ np.divide(p, out, out=np.zeros_like(p), where=out > 0) + p[out == 0].sum() / len(nodes))
    ranked = centrality.pagerank(links).collect()
    assert all(r.converged for r in ranked) and max(abs(r.rank - p[nodes.index(r.node)]) for r in ranked) < 1e-8
    assert math.isclose(sum(r.rank for r in ranked), 1.0)
    none = links.limit(0)
    assert centrality.eigenvector(none).count() == centrality.pagerank(none).count() == 0


def shuffled_rows(spark):
    """Rows that all stages so far have written to shuffles."""
    context, gateway = spark.sparkContext, spark.sparkContext._gateway
    store = context._jsc.sc().statusStore()
    context._jsc.sc().listenerBus().waitUntilEmpty()
    stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


@pytest.mark.parametrize("blocks", [1, 3])
def test_rounds_do_not_shuffle_the_links(spark, monkeypatch, blocks):
    rng = random.Random(5)
    ring = [(k, (k + 1) % 600) for k in range(600)] + [(rng.randrange(600), rng.randrange(600)) for _ in range(2400)]
    pairs = sorted({(f"n{a}", f"n{b}") for a, b in ring if a != b})
    links = spark.createDataFrame(pairs, "src string, dst string")
    monkeypatch.setattr(centrality, "BLOCK_LINKS", len(pairs) // blocks + 1, raising=False)
    for found in (centrality.pagerank, centrality.eigenvector):
        before = shuffled_rows(spark)
        rows = found(links).collect()
        assert len(rows) == 600 and all(r.converged for r in rows)
        assert shuffled_rows(spark) - before < 5 * len(pairs)
    nodes, m = dense(pairs)
    x = np.ones(len(nodes))
    for _ in range(2000):
        x = m @ x + x
        x /= np.linalg.norm(x)
    assert max(abs(r.centrality - x[nodes.index(r.node)]) for r in rows) < 1e-3


def test_short_names_have_few_candidates(spark):
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(5, 9))) for _ in range(100_000)})
    asked = spark.createDataFrame([(n[:-1] + "q",) for n in names[::1000]] + [("ab",), ("",)], "name string").distinct()
    known = spark.createDataFrame([(n,) for n in names], "candidate string")
    pairs = linkage._short_pairs(asked, known, 2).distinct()
    most = pairs.groupBy("name").count().agg(F.max("count")).first()[0]
    assert most < len(names) / 50
    got = {(r.name, r.candidate, r.d) for r in linkage.fuzzy_pairs(asked, known).collect()}
    want = asked.crossJoin(known).select("name", "candidate", F.levenshtein("name", "candidate").alias("d")).where("d <= 2").collect()
    assert got == {tuple(r) for r in want}
