"""The index of blocks against all products, and retrieval by both recalls."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.operators import retrieval, vector_index


def brute(asked, items, k):
    out = {}
    for q, v in asked:
        if not usable(v):
            continue
        scores = sorted((-float(np.dot(v, w)), i) for i, w in items if usable(w) and len(w) == len(v))[:k]
        out[q] = [(i, round(-s, 9)) for s, i in scores]
    return {q: r for q, r in out.items() if r}


def usable(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v)


def test_index_equals_all_products_and_prunes(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK", 16)
    monkeypatch.setattr(vector_index, "CENTROIDS", 12)
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 4, (12, 6))
    items = [(i, (centres[i % 12] + rng.normal(0, 0.1, 6)).tolist()) for i in range(600)]
    items += [(600 + i, items[i][1]) for i in range(30)] + [(700, None), (701, []), (702, [1.0, float("nan")]), (703, [None] * 6), (704, [1.0, 2.0]), (705, [0.5, 0.5])]
    asked = [(i, items[i][1]) for i in range(0, 60, 7)] + [(90, None), (91, [3.0, 1.0]), (92, [0.0] * 6), (93, [float("inf"), 1.0])]
    a, b = (spark.createDataFrame(rows, f"{n} long, embedding array<double>") for rows, n in ((asked, "query_id"), (items, "item_id")))
    index = vector_index.build_index(b)
    for k in (1, 5):
        trace, got = {}, {}
        for r in vector_index.index_search(a, index, k, trace).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["item_id"], round(r["score"], 9)))
        assert got == brute(asked, items, k)
        assert trace["read"] < 0.6 * trace["all"]
    assert vector_index.index_search(a, vector_index.build_index(b.limit(0)), 3).count() == 0
    assert vector_index.index_search(a.limit(0), index, 3).count() == 0


def test_recalls_and_tags(spark):
    items = spark.createDataFrame([(i, ["w", f"t{i % 5}"], [float(i % 7), 1.0], {"lang": "en" if i % 2 else "de", "kind": "a"}) for i in range(60)], "item_id long, terms array<string>, embedding array<double>, tags map<string,string>")
    asked = spark.createDataFrame([(1, ["t3"], [1.0, 0.0])], "query_id long, terms array<string>, embedding array<double>")
    get = lambda method, k=5, **f: [r["item_id"] for r in vector_index.retrieve(asked, items, k, f, F.col("tags"), method).orderBy("rank").collect()]
    assert get("vector", lang="en") == [13, 27, 41, 55, 5]
    assert set(get("fulltext", lang="en", kind="a")) == {3, 13, 23, 33, 43} and get("fulltext", lang="xx") == []
    both = get("hybrid", lang="en")
    assert both[0] == 13 and len(both) == 5  # in both lists
    assert len(get("vector", 99, lang="en")) == 20 and len(get("vector", 0, lang="en")) == 1
    with pytest.raises(ValueError):
        get("other")


def test_bm25_in_blocks_matches_brute_force(spark, monkeypatch):
    """Several blocks of items and of queries, items alike, an item and a query without terms."""
    monkeypatch.setattr(retrieval, "ITEMS", 16)
    monkeypatch.setattr(retrieval, "ASKED", 4)
    rng = random.Random(6)
    texts = {i: [rng.choice("aaaabbbcdefghij") for _ in range(rng.randint(0, 12))] for i in range(60)} | {60 + i: list("abca") for i in range(9)}
    asked = {i: [rng.choice("abcdefghijz") for _ in range(rng.randint(0, 4))] for i in range(10)}
    n, mean = len(texts), sum(map(len, texts.values())) / len(texts)
    df = {t: sum(t in x for x in texts.values()) for t in "abcdefghijz"}
    part = lambda t, x: math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * x.count(t) * 2.2 / (x.count(t) + 1.2 * (0.25 + 0.75 * len(x) / mean))
    want = set()
    for q, terms in asked.items():
        met = sorted((-round(sum(part(t, x) for t in set(terms) & set(x)), 9), i) for i, x in texts.items() if set(terms) & set(x))
        want |= {(q, i, r, round(-s, 6)) for r, (s, i) in enumerate(met[:5], 1)}
    frame = lambda rows, name: spark.createDataFrame(list(rows.items()), f"{name} long, terms array<string>")
    got = retrieval.bm25(frame(asked, "query_id"), frame(texts, "item_id"), 5).collect()
    assert {(r["query_id"], r["item_id"], r["rank"], round(r["score"], 6)) for r in got} == want and len(got) == len(want)
    assert retrieval.bm25(frame(asked, "query_id"), frame(texts, "item_id").limit(0), 5).count() == 0
