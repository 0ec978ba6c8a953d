import random
import re

import numpy as np
import pyarrow as pa
import pytest

from graphloom.operators import text_search, text_vectors
from graphloom.plans import registry


def texts_and_names():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    common = [word() for _ in range(12)]
    names = sorted({f"Firm#{k:06d}" for k in range(300)} | {" ".join(rng.sample(common, 2)) for _ in range(60)} | {word() for _ in range(40)} | {"", "..."})
    texts = [" ".join([*rng.sample(common, rng.randint(1, 6)), *[word() for _ in range(rng.randint(0, 3))], *rng.sample(names, rng.randint(0, 1))]) for _ in range(400)]
    return [*texts, *names[:30], "", "?", None], names


@pytest.mark.parametrize("least", [0.3, 0.5, 0.7, -1.0])
@pytest.mark.parametrize("block", [1 << 14, 23])
def test_names_are_those_of_all_pairs(spark, monkeypatch, least, block):
    texts, names = texts_and_names()
    for size in ("BLOCK_TEXTS", "BLOCK_NAMES", "TILE_TEXTS", "TILE_NAMES"):
        monkeypatch.setattr(text_search, size, block)
    monkeypatch.setattr(text_vectors, "SLICE", 4000)
    asked = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    known = spark.createDataFrame([(n,) for n in names], "text string")
    weight = text_vectors.weights(asked.select("text").unionByName(known), "text")
    vectors = lambda rows: np.concatenate([x for _, x in text_vectors.in_slices(pa.array(rows, pa.string()), weight)])
    q, r = vectors(texts), vectors(names)
    if least == 0.5:
        lists = text_search.name_lists(r[r.any(axis=1)], least)[1]
        assert (lists == text_search.ALL).any() and (lists != text_search.ALL).any()
    expected = {}
    for i, row in enumerate(q @ r.T):
        some = [(-s, names[k], i) for k, s in enumerate(row) if s >= least and q[i].any() and r[k].any()]
        for rank, (s, name, _) in enumerate(sorted(some, key=lambda x: (round(x[0], 9), x[1]))[:5]):
            expected[i, rank + 1] = (name, -s)
    found = {(x.src, x["rank"]): (x.name, x.score) for x in text_search.nearest_names(asked, known, weight, least, 5).collect()}
    assert found.keys() == expected.keys()
    assert all(abs(found[k][1] - expected[k][1]) < 1e-9 for k in found)
    assert sum(found[k][0] != expected[k][0] for k in found) <= len(found) // 50  # ties that rounding orders


@pytest.mark.parametrize("name", ["semantic_entities_text", "ranked_entities_text"])
def test_texts_are_moved_and_not_their_vectors(spark, name):
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and not re.search(r"\bv#\d+", plan)
