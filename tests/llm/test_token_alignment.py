"""Cross-tokenizer alignment against both libraries on whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestream.llm import tally
from lodestream.llm import token_alignment as A
from lodestream.llm.tokens import PRINTABLE

PATHS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
BACK = {c: n for n, c in PRINTABLE.items()}


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def tokens(tools, text):
    """[(id, bytes)] of both, or two empty lists."""
    a, b = tools
    if not text:
        return [], []
    one = [(t, bytes(BACK[c] for c in a.id_to_token(t))) for t in a.encode(" " + text, add_special_tokens=False).ids]
    two = [(t, bytes([int(b.id_to_piece(t)[3:5], 16)]) if b.is_byte(t) else b.id_to_piece(t).replace("▁", " ").encode()) for t in b.encode(text)]
    whole = (" " + text).encode()
    return (one, two) if b"".join(x for _, x in one) == whole == b"".join(x for _, x in two) else ([], [])


def spans(toks):
    out, at = [], 0
    for t, x in toks:
        out.append((t, at, at + len(x)))
        at += len(x)
    return out


def brute(tools, rows):
    docs = []
    for d, text in rows:
        a, b = map(spans, tokens(tools, text))
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, at = [], 0
        for e in ends:
            groups.append(",".join(str(t) for t, s, x in a if at <= s and x <= e) + "|" + ",".join(str(t) for t, s, x in b if at <= s and x <= e))
            at = e
        links = [(t, u) for t, s, e in a for u, x, y in b if s < y and x < e] if len(a) < 2000 else []
        docs.append((d, a, b, groups, links))
    count = Counter(p for *_, links in docs for p in links)
    top = Counter()
    for (_, u), n in count.items():
        top[u] = max(top[u], n)
    return Counter((d, len(a), len(b), len(groups), len(links), sum(count[p] == top[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "") for d, a, b, groups, links in docs)


def texts(seed, n=80):
    rng = random.Random(seed)
    parts = ["the", "ing", "über", "日本", "🎉", "é", "\n", "  ", " ", "\t", "can't", "1999", "…", " ", "　", "\x00", "<|endoftext|>", "</s>", "<0x41>", "ﬁ", "é", "...", "antidis", "Ωmega"]
    out = [None, "", " ", "   ", "a", " a", "a ", "a  b", "x▁y", "▁", "\n", "word " * 60, "<|endoftext|>", "abc" * 150, "a  b", "a ▁ b"]
    out += ["".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 60))) for _ in range(n)]
    return out + out[10:16]


def result(df):
    return Counter((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in df.collect())


@pytest.mark.parametrize("share", [None, 50])
def test_against_whole_texts(spark, tools, monkeypatch, share):
    """Also with so few pairs held that most meet their counts by a join."""
    if share:
        monkeypatch.setattr(A, "common", lambda counts, total: tally.common(counts, total, share=share))
    rows = [*enumerate(texts(5)), (3, "again"), (3, "again"), (None, "no number")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"N_A": F.lit(1), "h": F.lit("x"), "row": F.lit(2)})
    assert result(A.align(docs.repartition(3), *PATHS)) == brute(tools, rows)


def test_contract_query_on_a_given_table(spark, tools):
    """Whole rows of the smallest documents table with short texts, through the query's operator."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").filter("length(text) < 900")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert result(A.align(docs, *PATHS)) == brute(tools, rows)


def test_groups_of_a_hand_made_case():
    """Tokens [0,3) [3,5) against [0,2) [2,3) [3,4) [4,5): two groups."""
    both = A.Aligner.of(*PATHS)
    size_a, size_b = both.bytes_a.size, both.bytes_b.size
    pick = lambda size, n: int(np.flatnonzero(size == n)[400])
    a, b = [pick(size_a, 3), pick(size_a, 2)], [pick(size_b, 2), pick(size_b, 1) if (size_b == 1).sum() > 400 else int(np.flatnonzero(size_b == 1)[0])] * 1
    one = b[1]
    p = both._align(np.array(a), np.zeros(2, np.int64), np.array([b[0], one, one, one]), np.zeros(4, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64), np.ones(1, bool))
    assert (p.n_groups[0], p.n_links[0]) == (2, 4) and p.shown == [f"{a[0]}|{b[0]},{one};{a[1]}|{one},{one};".encode()]


def test_empty_table(spark):
    assert A.align(spark.createDataFrame([], "doc_id long, text string"), *PATHS).collect() == []
    none = A.align(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), *PATHS)
    assert result(none) == Counter({(1, 0, 0, 0, 0, 0, 0, ""): 1, (2, 0, 0, 0, 0, 0, 0, ""): 1})
