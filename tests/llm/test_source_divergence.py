"""The divergence audit against plain Python, and skybands against their definition."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.llm import source_divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, ranks=200):
    rows = [(x or "", s or "", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) for x, s, t in rows]
    held, n, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for x, s, t in rows:
        words = TERM.findall(t)
        held[x].update(set(words))
        n[x, s].update(words)
        groups[x].add(s)
    out = set()
    for x, sources in groups.items():
        kept = [w for w, k in held[x].items() if k >= 3]
        v, whole = len(kept), Counter()
        for s in sources:
            whole.update({w: n[x, s][w] for w in kept})

        def share(c, kept=kept, v=v):
            total = sum(c[w] for w in kept)
            return {w: 1 + 10**9 * (c[w] + 1) // (total + v) for w in kept}

        p, q = {s: share(n[x, s]) for s in sources}, share(whole)
        for s in sources:
            f = lambda w, o: (p[s][w] - o[w]) ** 2 // o[w]
            pairs = [(-sum(f(w, p[o]) for w in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-f(w, q), w.encode(), w) for w in kept if n[x, s][w] and p[s][w] > q[w]]
            for part, found, most in (("pair", pairs, 10**9), ("term", terms, ranks)):
                out |= {(x, s, part, item, -value, i + 1) for i, (value, _, item) in enumerate(sorted(found)[:most])}
    return out


def result(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def corpus(seed, n=250):
    rng = random.Random(seed)
    words = ["the", "THE", "straße", "É", "é", "日本", "a1b", "x_y", "don't", "z" * 300] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = [(None, None, None), ("", "s", ""), ("en", "only blank", " 12 \n"), ("xx", "a", "once"), ("xx", "b", "twice"), ("xx", None, "")]
    for _ in range(n):
        s = rng.choice(["hot", "hot", "hot", "b", "c", None])
        rows.append((rng.choice(["en", "en", "de", None]), s, " ".join(rng.choice(words[: 40 if s == "b" else 310]) for _ in range(rng.randint(0, 60)))))
    return rows + rows[20:30]


@pytest.mark.parametrize("ranks,cells", [(200, D.CELLS), (5, 400)])
def test_against_plain_python(spark, monkeypatch, ranks, cells):
    """Also in many small blocks and parts, with few ranks, so that skybands cut."""
    monkeypatch.setattr(D, "CELLS", cells)
    monkeypatch.setattr(D, "BLOCK", min(cells, D.BLOCK))
    monkeypatch.setattr(D, "FAN", 2)
    rows = corpus(ranks)
    docs = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({"Item": F.lit(1), "n": F.lit("x"), "term": F.lit(0)})
    assert result(D.divergence(docs.repartition(5), ranks=ranks)) == brute(rows, ranks)


def test_empty_table(spark):
    assert D.divergence(spark.createDataFrame([], "lang string, source string, text string")).collect() == []


def test_skyband_is_what_fewer_than_k_dominate():
    rng = np.random.default_rng(4)
    for n, k, block in ((0, 3, 4), (1, 1, 4), (200, 1, 16), (400, 7, 32), (600, 40, 512)):
        high, low, place = rng.integers(0, 12, n), rng.integers(0, 30, n), rng.permutation(n)
        over = (high[None] >= high[:, None]) & (low[None] <= low[:, None]) & (place[None] < place[:, None])
        assert np.array_equal(D.skyband(high, low, place, k, block), over.sum(1) < k)


def test_shares_are_exact():
    rng = random.Random(2)
    for _ in range(500):
        total = rng.choice([1, 7, 10**6, 10**12, 9 * 10**14 - 1]) + rng.randrange(10)
        count = rng.randrange(total)
        assert D.shares(np.array([count]), total)[0] == 1 + 10**9 * (count + 1) // total
