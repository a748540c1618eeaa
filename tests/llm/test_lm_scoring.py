"""Language-model scores against counts and a slow reader of the model's tables."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.llm import lm_scoring as L
from lodestream.llm import words as W
from lodestream.llm.quality_classifier import bucket

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def out():
    return bucket("doc_id", 5) == 1


def lower(text):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")


def split(text):
    return [*WORD.findall(lower(text)), None]


def texts(n=150, seed=3):
    rng = random.Random(seed)
    tongues = [[f"{c}{rng.randrange(40)}{e}" for _ in range(60)] for c, e in (("wa", "ing"), ("ré", "eux"), ("日", "本"))]
    out = [None, "", " \n\t", "one", "One ONE oNE Éa", "x " * 3000, "a" * 5000]
    for _ in range(n):
        words, w = rng.choice(tongues), 0
        line = []
        for _ in range(rng.randint(1, 120)):
            w = (w * 7 + rng.randrange(4)) % 60
            line.append(words[w] if rng.random() < 0.95 else f"new{rng.randrange(10**6)}")
        out.append(" ".join(line))
    return out + out[5:9]


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(3, "again one"), (None, "no number")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"Score": F.lit(1), "n_tokens": F.lit("x"), "ids": F.lit(0), "row": F.lit(2)})
    df, model = L.lm_scores(docs.repartition(5), out())
    return rows, df.collect(), model


def test_counts_and_base(scored):
    rows, got, _ = scored
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    c = Counter(t for d, x in rows if not held(d) for t in split(x))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for d, x in rows:
        ts = split(x)
        want[d, held(d), len(ts), sum(t in c for t in ts), n, round(sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts), 6)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want


def test_probabilities_sum_to_one(scored):
    _, _, m = scored
    assert np.any(m.weights)
    rng = np.random.default_rng(1)
    outcomes = np.concatenate([np.arange(min(L.HEAD, len(m.known.keys))), L.OWN + np.arange(L.TAIL)])
    for _ in range(3):
        before = rng.choice(outcomes, 3)
        ids = np.concatenate([np.append(before, o) for o in outcomes])
        p = np.exp(m.logs(ids, np.arange(0, len(ids) + 1, 4))[3::4])
        assert abs(p.sum() - 1) < 1e-4
    # within a tail class: each token's half and one for what is unseen
    outside = (m.id_of >= L.HEAD) & (m.known.more[0] == 5)
    assert abs((m.known.counts[outside] + 0.5).sum() + 0.5 - m.masses[5]) < 1e-9


def test_scores_by_a_slow_reader(scored):
    rows, got, m = scored
    outer, inner = (t.astype(float) for t in m.tables)
    place = {int(k): i for i, k in enumerate(m.known.keys)}
    for d, x in [r for r in rows if r[0] in (1, 3, 4, 20, 40, 77)]:
        h, tail, _ = L.tokens(np.frombuffer((x or "").encode(), np.uint8), np.array([0, len((x or "").encode())]))
        ids, total = [], 0.0
        for key, t in zip(h.view(np.int64).tolist(), tail.tolist(), strict=True):
            i = place.get(key, -1)
            ids.append(int(m.id_of[i]) if i >= 0 else L.OWN + t)
            if ids[-1] >= L.HEAD:
                total += math.log10(((m.known.counts[i] if i >= 0 else 0) + 0.5) / m.masses[t])
        for at, now in enumerate(ids):
            a, b, c = (ids[at - k] if at >= k else L.OWN for k in (1, 2, 3))
            pair = int(W.mix(np.array([b * L.IDS + a], np.uint64))[0]) % L.PAIRS
            feats = [a, L.IDS + b, 2 * L.IDS + c, 3 * L.IDS + pair]
            kind = int(m.class_of[now])
            z = m.bias + sum(outer[f] for f in feats)
            total += (z[kind] - math.log(np.exp(z).sum())) / math.log(10)
            if now < L.HEAD:
                z = m.inner_bias[kind] + sum(inner[int(W.mix(np.array([f * L.CLASSES + kind], np.uint64))[0]) % L.INNER] for f in feats)
                total += (z[now % L.WORDS] - math.log(np.exp(z).sum())) / math.log(10)
        assert any(r["doc_id"] == d and abs(r["score"] - total) < 1e-3 * max(1, abs(total)) for r in got), d


def test_rare_tokens_meet_their_counts_by_a_join(spark, monkeypatch):
    """With few common keys most tokens go the other way, and nothing changes but the weights of context."""
    from lodestream.llm import tally

    rows = [(i, t) for i, t in enumerate(texts(60, 9))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    full = {r["doc_id"]: r for r in L.lm_scores(docs, out())[0].collect()}
    small = tally.common
    monkeypatch.setattr(L, "common", lambda counts, total, more=(): small(counts, total, more=more, share=40))
    for r in L.lm_scores(docs, out())[0].collect():
        w = full[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (w["n_tokens"], w["n_known"], w["train_tokens"]) and abs(r["base_score"] - w["base_score"]) < 1e-6
        assert math.isfinite(r["score"]) and r["score"] < 0


def test_context_helps_on_held_out_texts(scored):
    _, got, _ = scored
    held = [r for r in got if r["held_out"] and r["n_tokens"] > 20]
    assert len(held) > 10 and sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 0.1 * sum(r["n_tokens"] for r in held)


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert L.lm_scores(empty, out())[0].collect() == []
    only = spark.createDataFrame([(i, "a b") for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1], "doc_id long, text string")
    for r in L.lm_scores(only, out())[0].collect():
        assert r["held_out"] and (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0) and math.isfinite(r["score"])
