"""The training-data operators against brute force, round trips and held-out labels, with awkward rows."""

import base64
import hashlib
import json
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestream.llm import best_fit_packing, chat_format, embedding_dedup, near_dedup, quality_classifier, quality_rules, secret_scan, source_mixing, token_files, toxicity
from lodestream.llm.store import shared_dir, stored
from lodestream.llm.tokens import Encoder, default_path
from lodestream.operators import components as components_module
from lodestream.operators.components import components
from lodestream.sources.store import written

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VOCAB = ["the", "über", "né", "日本", "a", "b#", "x|y", "word", "Other", "fin.", "…"]


def docs_of(spark, texts, ids=None):
    rows = [((ids or range(len(texts)))[i], t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def awkward(seed=1, n=60):
    rng = random.Random(seed)
    texts = [None, "", "   \n\t", "one", "a b c", "same line\nsame line\nsame line", "x " * 30000, "\n".join(["q w e r t y"] * 40)]
    for _ in range(n):
        texts.append(" ".join(rng.choice(VOCAB) + rng.choice(["", "", "\n", "  "]) for _ in range(rng.randint(1, 160))))
    return texts + texts[5:12]


# ---- quality rules


def rules(text):
    text = text or ""
    spans = [m.span() for m in WORD.finditer(text)]
    w = [text[a:b] for a, b in spans]

    def covered(n, most):
        """Places of words in n-grams that occur more than ``most`` times up to there, or, with 0, at all in the text."""
        c, seen, out = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)), Counter(), set()
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            seen[g] += 1
            if (seen[g] > most) if most else (c[g] > 1):
                out |= set(range(i, i + n))
        return out

    seen, dup, dup_chars, dup_words = set(), 0, 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            if line in seen:
                dup, dup_chars, dup_words = dup + 1, dup_chars + sum(map(len, WORD.findall(line))), dup_words + len(WORD.findall(line))
            seen.add(line)
    chars = sum(map(len, w))
    failed = len(w) < 50 or 100 * len(covered(3, 0)) > 50 * len(w)
    over = dup_chars > 0.20 * chars and dup_words > 20
    for n, share in ((5, 0.15), (7, 0.13), (10, 0.10)):
        again = covered(n, 1)
        over |= sum(len(w[k]) for k in again) > share * chars and len(again) > 20
    return len(w), chars, sum(c in "#*$%&|<>" for c in text), dup, len(covered(3, 0)), failed, not (failed or over)


def said(rng, n):
    return [rng.choice("abcdefg") + str(rng.randrange(10**6)) for _ in range(n)]


def test_quality_rules(spark):
    rng, texts = random.Random(21), awkward()
    long, short, passage = said(rng, 800), said(rng, 50), said(rng, 200)
    twice = [" ".join([*long[:300], *passage, *long[300:500], *passage, *long[500:]]), " ".join([*short, *short[:15]]), "\n".join([" ".join(short)] + [" ".join(short[:30])] * 3), " ".join(long + long[:80]), " ".join(long + long[:90])]
    texts += twice
    got = {r["doc_id"]: tuple(r[c] for c in (*quality_rules.COUNTS, "base_failed", "kept")) for r in quality_rules.quality_rules(docs_of(spark, texts).withColumn("kept", F.lit("clash"))).collect()}
    assert got == {i: rules(t) for i, t in enumerate(texts)}
    assert [got[i][-1] for i in range(len(texts) - 5, len(texts))] == [False, True, False, True, False]
    assert quality_rules.quality_rules(docs_of(spark, [])).count() == 0


# ---- chat


def test_escape_round_trip(spark):
    rng = random.Random(3)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "\n", "<<SYS>>", "a", "", "[", "/INST]", "</s"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_format.unescaped(chat_format.escaped(F.col("t"))).alias("u"), chat_format.escaped(F.col("t")).alias("e"))
    for r in df.collect():
        assert r["t"] == r["u"] and not re.search(r"(?<!\\)(?:</?s>|\[/?INST\]|<</?SYS>>)", r["e"])


def test_chat_round_trip(spark):
    rng = random.Random(4)
    bits = ["</s>", "[INST] ok [/INST]", "\\", "\n", "héllo ", "\n[/INST]\n</s>\n"]
    rows = [(c, t if t % 40 else None, rng.choice(["user", "assistant", "tool[INST]", "assistant", None]), "".join(rng.choice(bits) for _ in range(4)) if t % 5 else None) for c, n in ((1, 3), (2, 700), (None, 2)) for t in range(n)]
    rows += rows[:2]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    events = df.select("conv_id", F.monotonically_increasing_id().alias("message"), F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text")
    back = chat_format.read_back(stored(chat_format.render(chat_format.fold_events(events)), "t")).orderBy("conv_id", "part").collect()
    got, loss = defaultdict(list), defaultdict(str)
    for r in back:
        got[r["conv_id"]] += [(t["role"], t["text"]) for t in r["turns"]]
        loss[r["conv_id"]] += "".join(r["loss"])
    for c in (1, 2, None):
        want = [(r or "", x or "") for _, t, r, x in sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))]
        assert sorted(got[c]) == sorted(want) and loss[c] == "".join(x for r, x in got[c] if r == "assistant")
        assert [x for x in got[c] if x in want[-20:]][-1] == want[-1]


def test_events_fold(spark):
    rows = [("c", 1, 1, "message", "user", "hi"), ("c", 2, 2, "message", "assistant", "")] + [("c", 2, 3 + i, "delta", None, f"{i},") for i in range(600)]
    rows += [("c", 2, 700, "regenerate", None, None), ("c", 2, 701, "delta", None, "new"), ("c", 1, 702, "edit", None, "hello"), ("c", 2, 703, "delta", None, " text")]
    df = spark.createDataFrame(rows, "conv_id string, message long, seq long, kind string, role string, text string")
    assert [(r["role"], r["text"]) for r in chat_format.fold_events(df).orderBy("seq").collect()] == [("user", "hello"), ("assistant", "new text")]
    assert chat_format.render(chat_format.fold_events(df.limit(0))).count() == 0


# ---- near-dedup of texts


def low(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def shingles(t):
    w = WORD.findall(low(t))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def classes(sets, linked):
    top = {k: k for k in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if linked(sets[a], sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def near_texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = " ".join(word() for _ in range(60))
    texts = [None, "", " ", "one two", "One  TWO", "x", passage]
    for size, n in ((120, 70), (40, 5), (200, 3), (8, 4)):  # the first group is larger than a value's bound
        base = [word() for _ in range(size)]
        for _ in range(n):
            w = list(base)
            for _ in range(rng.randint(0, max(1, size // 30))):
                w[rng.randrange(size)] = word()
            texts.append(" ".join(w))
    for _ in range(80):  # a passage that many share
        texts.append(" ".join([*(word() for _ in range(rng.randint(5, 90))), passage, *(word() for _ in range(rng.randint(0, 30)))]))
    return texts + texts[5:9] + [texts[10].upper(), texts[11] + "\n"]


def test_near_dedup(spark):
    texts = near_texts(7)
    ids = [i * 3 + 1 for i in range(len(texts))]
    random.Random(1).shuffle(ids)
    sets = {i: shingles(t) for i, t in zip(ids, texts, strict=True)}
    want = classes(sets, lambda a, b: len(a) > 0 and len(b) > 0 and 100 * len(a & b) >= 75 * len(a | b))
    got = {r["doc_id"]: r for r in near_dedup.near_dedup(docs_of(spark, texts, ids).withColumn("name", F.lit("clash"))).collect()}
    assert {k: (r["n_shingles"], r["component_id"], r["kept"]) for k, r in got.items()} == {k: (len(sets[k]), want[k], want[k] == k) for k in sets}
    kept = near_dedup.deduplicated(docs_of(spark, [*texts, texts[8]], [*ids, ids[8]]))
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(k for k in sets if want[k] == k)


def test_near_dedup_of_a_large_group_with_text_appended(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(404)]
    group = [" ".join(base[:i] + [word()] + base[i + 1 :]) for i in range(0, 400, 5)] + [" ".join(base)]

    def sketch(t):
        data = np.frombuffer(t.encode(), np.uint8)
        return near_dedup.shingle_sets(data, np.array([0, len(data)]))[0][: near_dedup.SKETCH].tolist()

    held = Counter(v for t in group for v in sketch(t))
    while True:  # three quarters are shared, but many of the smallest hashes are its own
        longer = " ".join(base + [word() for _ in range(130)])
        if sum(held[v] + 1 <= near_dedup.COMMON for v in sketch(longer)) >= near_dedup.PREFIX:
            break
    a, b = shingles(longer), shingles(group[-1])
    assert 100 * len(a & b) >= near_dedup.THRESHOLD * len(a | b)
    got = near_dedup.near_dedup(docs_of(spark, [*group, longer])).collect()
    assert {r["component_id"] for r in got} == {0}


def test_near_dedup_of_texts_around_one_passage(spark, monkeypatch):
    """Blocks that meet are copied in rounds, and texts that hold little of the passage meet few others."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "ROUND_BYTES", 1, raising=False)
    tasks, links = [], near_dedup._links

    def counted(t):
        tasks.append(t.filter("items2 IS NOT NULL").count())
        return links(t)

    monkeypatch.setattr(near_dedup, "_links", counted)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(120)]

    def run(owns):
        tasks.clear()
        texts = [" ".join(passage + [word() for _ in range(n)]) for n in owns]
        want = classes({i: shingles(t) for i, t in enumerate(texts)}, lambda a, b: 100 * len(a & b) >= 75 * len(a | b))
        assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(docs_of(spark, texts)).collect()} == want
        return len(set(want.values()))

    assert 1 < run([rng.choice((2, 10, 25, 45, 60, 200)) for _ in range(96)]) < 96
    assert run([60] * 96) == 96
    assert 0 < max(tasks) < 24 and sum(tasks) > 48  # 12 blocks and some 66 pairs, of which a round copies 12 by the mean
    assert run([200] * 96) == 96
    assert sum(tasks) <= 10


def test_near_dedup_of_nothing(spark):
    assert near_dedup.near_dedup(docs_of(spark, [])).count() == 0
    assert [r["kept"] for r in near_dedup.near_dedup(docs_of(spark, [None, ""])).collect()] == [True, True]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 99), (99, 101), (5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {99: 99, 100: 99, 101: 99}


def test_components_of_long_chains(spark):
    want, links = {}, []
    for seed in (1, 2):
        names = [hashlib.blake2b(f"{seed} {i}".encode(), digest_size=16).digest() for i in range(1000)]
        links += [(names[i], names[i + 1]) if i % 2 else (names[i + 1], names[i]) for i in range(999)]
        want |= dict.fromkeys(names, min(names))
    got = components(spark.createDataFrame(links, "a binary, b binary")).collect()
    assert len(got) == 2000 and {bytes(r["node"]): bytes(r["root"]) for r in got} == want


def test_components_leave_tables_of_few_links_to_tasks(spark, monkeypatch):
    """Links of several partitions meet without rounds of joins; what is left after the levels goes by rounds."""
    made = []
    monkeypatch.setattr(components_module, "written", lambda df, name: made.append(name) or written(df, name))
    rng = random.Random(4)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(999, i) for i in range(100, 160)]
    top = {i: i for x in links for i in x}
    while any(top[a] != top[b] for a, b in links):
        for a, b in links:
            top[a] = top[b] = min(top[a], top[b])
    want = {i: t for i, t in top.items() if any(i in x and x[0] != x[1] for x in links)}
    df = spark.createDataFrame(links, "a long, b long").repartition(7)
    assert {r["node"]: r["root"] for r in components(df).collect()} == want and len(made) < 8
    assert {r["node"]: r["root"] for r in components(df, 1).collect()} == want


def test_written_tables_leave_no_shuffle_files(spark):
    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before = files()
    table = written(spark.range(1000).groupBy(F.col("id") % 7).count(), "counts")
    for _ in range(50):  # files go in the background
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left and table.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None


# ---- vectors


def test_vectors(spark):
    rng = np.random.default_rng(5)
    rows, i = [], 0
    for label in (1, 2):
        for _ in range(6):
            centre = rng.normal(size=16)
            for _ in range(int(rng.integers(1, 40))):
                rows.append((i, (centre + rng.normal(size=16) * rng.choice([0.05, 0.25])).astype(np.float32).tolist(), label))
                i += 1
    dense = rng.normal(size=16)
    for _ in range(700):  # more than a block
        rows.append((i, (dense + rng.normal(size=16) * 0.2).astype(np.float32).tolist(), 3))
        i += 1
    same = rows[-1][1]
    odd = [same, same, [2 * x for x in same], None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0] * 8, [1.0] * 8]
    rows += [(i + k, v, 3) for k, v in enumerate(odd)] + [(i + 50, same, None)]
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])
    ok = {r[0]: (r[2], np.array(r[1], float)) for r in rows if r[2] is not None and r[1] and np.isfinite(r[1]).all() and any(r[1])}
    unit = {k: (lab, v / np.linalg.norm(v)) for k, (lab, v) in ok.items()}
    near = lambda a, b: a[0] == b[0] and len(a[1]) == len(b[1]) and float(a[1] @ b[1]) >= 0.93
    want, links = classes(unit, near), {k: sum(near(a, b) for j, b in unit.items() if j != k) for k, a in unit.items()}
    got = embedding_dedup.link_vectors(spark.createDataFrame(rows, schema).withColumn("unit", F.lit(1))).collect()
    assert len(got) == len(rows)
    for r in got:
        k = r["vec_id"]
        assert (r["n_links"], r["component_id"], r["kept"]) == (links.get(k, 0), want.get(k, k), want.get(k, k) == k)
    assert embedding_dedup.link_vectors(spark.createDataFrame([], schema)).count() == 0


def test_vectors_by_many_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 4)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(150, 8))
    x = centres[rng.integers(0, 150, 1500)] + rng.normal(size=(1500, 8)) * 0.2
    label = rng.choice([1, 1, 1, 2], 1500)
    df = spark.createDataFrame([(i, x[i].tolist(), int(label[i])) for i in range(1500)], "vec_id long, embedding array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :]) & ~np.eye(1500, dtype=bool)
    root = np.arange(1500)
    while True:
        least = np.minimum(root, np.where(near, root[None, :], 1500).min(1))
        if (least == root).all():
            break
        root = least
    got = {r["vec_id"]: r for r in embedding_dedup.link_vectors(df).collect()}
    assert [got[i]["n_links"] for i in range(1500)] == near.sum(1).tolist() and [got[i]["component_id"] for i in range(1500)] == root.tolist()


# ---- tokens


@pytest.fixture(scope="module")
def plain():
    """The library as it comes."""
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(default_path())
    return lambda t: made.encode(t or "", add_special_tokens=False).ids


def test_tokens(plain):
    rng = random.Random(8)
    odd = ["", " ", "a  b", " lead", "trail ", "x\n y", "a\x1cb", "a\x85 b", "<|endoftext|>", "a<|endoftext|> b", "<|endof", "text|>", "it's 12 ½ é", "日本 語", "\t \t", "ª º. Ⅷ,", "x" * 300, "né" * 40]
    near = " \n\tab.,'é1!日s\x1f×÷  ß̀²&$\r\u3000 \x85\u1680\u180e\u200b"
    texts = odd + ["".join(rng.choice(near) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    texts += ["".join(chr(rng.choice([rng.randrange(1, 128), rng.randrange(1, 0x400), rng.randrange(1, 0x3100), 32, 10])) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    coder, raw = Encoder(default_path()), [t.encode() for t in texts]
    for again in range(2):  # from the library, then from the table
        ids, at = coder.rows(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), 0)
        for k, t in enumerate(texts):
            assert ids[at[k] : at[k + 1]].tolist() == [*plain(t), 0], (again, t)


def test_token_table_begun_anew(plain, monkeypatch):
    from lodestream.llm import tokens

    monkeypatch.setattr(tokens, "MOST", 50)
    monkeypatch.setattr(tokens, "SLOTS", 256)
    coder, rng = Encoder(default_path()), random.Random(5)
    for _ in range(40):
        t = " ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 20))) for _ in range(60))
        assert np.frombuffer(coder.ids(t), "<u4").tolist() == plain(t)


def test_elias_fano():
    rng = random.Random(9)
    for n in (0, 1, 2, 63, 64, 65, 1000):
        values = sorted(rng.choices(range(rng.choice([1, 50, 10**7])), k=n))
        e = token_files.EliasFano.encode(np.array(values, np.int64), values[-1] if values else 0)
        e, _ = token_files.EliasFano.frombytes(memoryview(e.tobytes()), e.n, e.low_bits)
        assert e.all().tolist() == values == [e.select(i) for i in range(n)]


def test_token_files(spark, plain):
    texts = awkward(2)
    ids = [5 * i - 20 for i in range(len(texts) - 3)] + [None, -(2**63), 2**63 - 1]
    random.Random(2).shuffle(ids)
    path = f"{shared_dir(spark)}/tokens-test-{random.random()}"
    token_files.write_token_files(docs_of(spark, texts, ids).withColumns({"key": F.lit("clash"), "body": F.lit(0), "part": F.lit(0)}), path, default_path())
    at = 0
    got = token_files.read_token_files(spark, path).orderBy("start").collect()
    assert len(got) == len(texts)
    for r, (k, t) in zip(got, sorted(zip(ids, texts, strict=True), key=lambda x: (x[0] is not None, x[0] or 0)), strict=True):
        raw = np.array([*plain(t), 0], "<u4").tobytes()
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (k, at, len(raw) // 4, zlib.crc32(raw))
        at += len(raw) // 4
    segment = token_files.Segment(spark.read.parquet(path).first()["image"])
    assert segment.document(0)[-1] == 0
    token_files.write_token_files(docs_of(spark, []).withColumn("key", F.lit(1)), path + "-empty", default_path())
    assert token_files.read_token_files(spark, path + "-empty").count() == 0


def test_packing(spark, plain):
    texts = awkward(3) + ["w " * 5000]
    got = best_fit_packing.pack_documents(docs_of(spark, texts), default_path(), 64, with_ids=True).collect()
    per, bins = defaultdict(list), defaultdict(list)
    for r in got:
        per[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
    for k, t in enumerate(texts):
        p = sorted(per[k], key=lambda r: r["piece"])
        assert b"".join(bytes(r["ids"]) for r in p) == np.array([*plain(t), 0], "<u4").tobytes() and all(r["length"] == 64 for r in p[1:])
        assert [r["start"] for r in p] == [sum(x["length"] for x in p[:i]) for i in range(len(p))]
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 64
    assert best_fit_packing.pack_documents(docs_of(spark, []), default_path()).count() == 0


def test_fullest_combination():
    rng = random.Random(6)
    for _ in range(200):
        counts = np.zeros(41, np.int64)
        for _ in range(rng.randint(0, 8)):
            counts[rng.randint(1, 40)] += rng.randint(1, 3)
        room = rng.randint(0, 40)
        chosen = best_fit_packing.fullest(counts, room)
        reach = {0}
        for size in range(1, 41):
            for _ in range(counts[size]):
                reach |= {r + size for r in reach if r + size <= room}
        assert sum(chosen) == max(reach) and all(chosen.count(s) <= counts[s] for s in set(chosen))


# ---- mixing


def test_mixing(spark):
    rng = random.Random(10)
    texts = ["w " * rng.randint(0, 9) for _ in range(900)] + [None, ""]
    sources = [rng.choice(["b", "b", "b", "a", "c", "", None]) for _ in texts]
    df = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(zip(texts, sources, strict=True))], "doc_id long, text string, source string")
    got = source_mixing.mix_sources(df).collect()
    size = Counter()
    for t, s in zip(texts, sources, strict=True):
        size[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, goal, target = set(size), 1.5 * sum(size.values()), {}
    while True:  # share, stop at twice, share the excess again
        rest = goal - sum(target.values())
        over = [s for s in left if rest * weight[s] / sum(weight[x] for x in left) > 2 * size[s]]
        if not over:
            break
        target |= {s: 2.0 * size[s] for s in over}
        left -= set(over)
    target |= {s: (goal - sum(v for k, v in target.items() if k not in left)) * weight[s] / sum(weight[x] for x in left) for s in left}
    taken = Counter()
    for r in got:
        assert r["source_size"] == size[r["source"]] and math.isclose(r["target"], target[r["source"]], rel_tol=1e-9) and 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
    assert all(abs(taken[s] - target[s]) <= 2 for s in size)
    again = source_mixing.mix_sources(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    rows = source_mixing.mixed(df).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in rows} == {r["doc_id"]: r["copies"] for r in got if r["copies"]}
    assert source_mixing.mix_sources(df.limit(0)).count() == 0


def test_mixing_of_very_unequal_sizes(spark):
    rng = random.Random(17)
    rows = [(i, "w " * (9_000 if i < 7 else int(min(2_000, rng.paretovariate(0.9) * 60))), f"s{i % 7}") for i in range(700)]
    got = source_mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    target, taken = {r["source"]: r["target"] for r in got}, Counter()
    for r in got:
        taken[r["source"]] += r["copies"] * r["size"]
    assert max(r["size"] for r in got) == 9_000 and all(abs(taken[s] - t) <= 0.01 * t for s, t in target.items())
    # one source with documents of one size: half a document is as near as it gets
    got = source_mixing.mix_sources(spark.createDataFrame([(i, "w " * 1000, "s" if i else "t") for i in range(40)], "doc_id long, text string, source string")).collect()
    assert abs(sum(r["copies"] * r["size"] for r in got if r["source"] == "s") - next(r["target"] for r in got if r["source"] == "s")) <= 500


def test_mixing_is_fair(spark):
    """Over many sources, a document is taken as often as its fraction says, whatever its size."""
    sizes = [400, 350, 300, 300, 200, 200, 100, 100, 50, 50, 20, 10, 10, 5, 2, 1]
    rows = [(s * 16 + k, "w " * n, f"s{s:03}") for s in range(300) for k, n in enumerate(sizes)]
    got = source_mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1,)).collect()
    extra = [np.mean([r["copies"] - 1 for r in got if r["doc_id"] % 16 == k]) for k in range(16)]
    assert all(abs(x - 0.5) < 0.1 for x in extra[:8]), extra  # the smallest even out the rest


def test_mixed_keeps_clashing_columns(spark):
    df = docs_of(spark, ["a b", "c", "d e f", None]).withColumns({n: F.lit(n) for n in ("copies", "copy", "_copy", "key", "from", "words", "size", "target")})
    out = source_mixing.mixed(df)
    assert out.columns == df.columns and all(r["copies"] == "copies" and r["_copy"] == "_copy" for r in out.collect())


# ---- secrets


def der(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 | len(b := n.to_bytes((n.bit_length() + 7) // 8, "big"))]) + b
    return bytes([tag]) + size + body


def base_spans(t):
    kw = re.compile("(?:" + "|".join("".join(f"[{c}{c.upper()}]" for c in k) for k in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    out = [(*m.span(), "assign") for m in kw.finditer(t) if len(m[1]) >= 6]
    out += [(*m.span(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return out + [(*m.span(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]


def test_secrets(spark):
    rng = random.Random(11)
    key = der(0x30, der(0x02, b"\0") + der(0x30, der(0x06, b"\x2a\x86\x48") + der(0x05, b"")) + der(0x04, bytes(rng.randrange(256) for _ in range(200))))
    b64 = base64.b64encode(key).decode()
    url = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    jwt = f"{url({'alg': 'HS256', 'typ': 'JWT'})}.{url({'sub': 'x'})}.c2lnbmF0dXJl"
    fake = f"{url({'typ': 'no'})}.{url({'sub': 'x'})}.sig"
    texts = [None, "", f"é {jwt} ü", fake, f"日 {b64} end", "M" + "A" * 60, f"-----BEGIN PRIVATE KEY-----\n{b64[:64]}\n{b64[64:]}\n-----END PRIVATE KEY-----", key.hex(), "ſecret=abcdefgh ToKen=abcdefgh token=token:abcdef"]
    bits = ["password", "Token", '"', "'", " ", "=", ":", "api_KEY", "APIKEY", "abc", "12", "AKIA", "AKIA" + "Z" * 16, "deadbeef" * 3, "é", "SECRET"]
    texts += ["".join(rng.choice(bits) for _ in range(12)) for _ in range(400)]
    got = {r["doc_id"]: r for r in secret_scan.secret_scan(docs_of(spark, texts).withColumn("secrets", F.lit(0))).collect()}
    kinds = secret_scan.KINDS
    for i, t in enumerate(texts):
        found = [(s["start"], s["end"], s["kind"]) for s in got[i]["secrets"]]
        assert [s for s in found if s[2] in kinds[:3]] == sorted(base_spans(t or ""), key=lambda s: (s[0], kinds.index(s[2])))
        assert not t or not base_spans(got[i]["redacted"]) or "[SECRET]" in got[i]["redacted"]
    more = {i: [(t["kind"], texts[i][t["start"] : t["end"]]) for t in got[i]["secrets"] if t["kind"] in kinds[3:]] for i in range(9)}
    assert more[2] == [("jwt", jwt)] and more[4] == [("der", b64)] and [k for k, _ in more[6]] == ["pem"] and ("der", key.hex()) in more[7] and not more[3] and not more[5]
    assert got[2]["redacted"] == "é [SECRET] ü" and got[0]["redacted"] is None


def _spans(text, kind):
    return [text[a:b] for a, b, k in secret_scan.scan(text) if k == kind]


def test_structures_anywhere():
    rng = random.Random(12)
    body = lambda n: bytes(rng.randrange(256) for _ in range(n))
    algorithm = der(0x30, der(0x06, b"\x2a\x86\x48") + der(0x05, b""))
    url = lambda raw: base64.urlsafe_b64encode(raw).decode().rstrip("=")
    for n in (40, 130, 1200, 12_269, 21_747, 300_000):
        key = der(0x30, der(0x02, b"\0") + algorithm + der(0x04, body(n)))
        b64 = base64.b64encode(key).decode()
        lines = "\n".join(b64[i : i + 64] for i in range(0, len(b64), 64))
        block = f"-----BEGIN PRIVATE KEY-----\n{lines}\n-----END PRIVATE KEY-----"
        assert _spans(f"ä {block} z", "pem") == [block] and not _spans(block, "der")
        for front in ("KEY=", "KEY=Mxxx", "Mxxx", "MIIB", "abc", "M"):
            assert _spans(f"é {front}{b64} z", "der") == [b64], front
        assert _spans(f"x\n{lines}\nend", "der") == [lines]
        assert _spans(f"x\r\n{lines}\r\nend".replace("\n", "\r\n").replace("\r\r", "\r"), "der") == [lines.replace("\n", "\r\n")]
        for front in ("30", "303", "a30", "7"):
            assert _spans(f"{front}{key.hex().upper()} z", "der") == [key.hex().upper()], front
        assert not _spans(b64[:-8], "der") and not _spans(key.hex()[:-2], "der")
        assert _spans(f"{b64}{b64}".replace("=", ""), "der")[:1] == [b64.replace("=", "")]
    legacy = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00FF\n\n" + base64.b64encode(body(600)).decode() + "\n-----END RSA PRIVATE KEY-----"
    assert _spans(f"a {legacy} b", "pem") == [legacy] and not _spans(legacy.replace(",ENCRYPTED", ""), "pem")
    for head in ('{"alg":"HS256"}', '{ "alg": "none" }', ' {"alg":"HS256"}', '\n\t {\n"typ":"JWT","alg":"RS256"}'):
        for payload in ('{"sub":1}', ' { "a": {} }'):
            jwt = f"{url(head.encode())}.{url(payload.encode())}.sig-_x"
            for front in ("", "Bearer-", "Bearer ", "x.y.", "ab_eyJ", "é"):
                assert _spans(f"{front}{jwt}, end", "jwt") == [jwt], (front, head)
    assert not _spans(f"{url(b'{"alg":1}')}.{url(b'{}')}.x", "jwt") and not _spans(f"{url(b'{"alg":"x"}')}.{url(b'[1]')}.x", "jwt")


def test_keys_of_many_items():
    item = lambda tag, body: bytes([tag]) + (bytes([len(body)]) if len(body) < 128 else b"\x82" + len(body).to_bytes(2, "big")) + body
    for n in (2, 32, 33, 500):
        key = item(0x30, b"".join(item(0x02, bytes([1 + i % 100] * 20)) for i in range(n)))
        assert _spans(f"x {base64.b64encode(key).decode()} y", "der") == [base64.b64encode(key).decode()], n
        nested = item(0x30, item(0x02, b"\x00") + item(0x30, item(0x06, b"\x2a\x03") * n) + item(0x04, bytes(range(1, 40))))
        assert _spans(nested.hex(), "der") == [nested.hex()], n
        broken = item(0x30, item(0x02, b"\x00") + item(0x30, item(0x06, b"\x2a\x03") * n + b"\x06") + item(0x04, bytes(range(1, 40))))
        assert not _spans(broken.hex(), "der"), n


def test_keys_by_a_slow_reader():
    """Random short encodings, right and wrong, against a reader that walks every item anew."""
    rng = random.Random(12)

    def items(data):
        out, at = [], 0
        while at < len(data):
            found = secret_scan._der_size(data, at)
            if found is None or found[1] > len(data):
                return None
            out.append((data[at], data[found[0] : found[1]]))
            at = found[1]
        return out

    def slow(data):
        outer = items(data)
        if not data or data[0] != 0x30 or outer is None or len(outer) != 1 or not outer[0][1] or outer[0][1][0] not in (2, 0x30):
            return False
        inner = items(outer[0][1])
        return bool(inner) and len(inner) >= 2 and all(items(b) for t, b in inner if t == 0x30) and any(t in (2, 3, 4) for t, _ in inner)

    def make(depth):
        body = b"".join(make(depth - 1) if depth and rng.random() < 0.4 else bytes([rng.choice([2, 3, 4, 5, 6, 0x30, 0x31])]) + (b := bytes(rng.choice([2, 0, 1, 0x30, 5]) for _ in range(rng.randint(0, 5))), bytes([len(b) + (rng.random() < 0.03)]) + b)[1] for _ in range(rng.randint(0, 5)))
        return b"\x30" + bytes([len(body)]) + body if len(body) < 128 else body[:100]

    kinds = set()
    for _ in range(4000):
        data = make(3)
        kinds.add(slow(data))
        assert secret_scan.is_der(data) == slow(data), data.hex()
        # places inside share their chains
        held = secret_scan.Items(memoryview(data))
        for at in range(len(data)):
            size = secret_scan._der_size(data, at)
            want = at + size[1] - at if size and size[1] <= len(data) and slow(data[at : size[1]]) else None
            assert secret_scan._key_end(held, at) == want
    assert kinds == {True, False}


def test_tokens_of_all_shapes():
    url = lambda b: base64.urlsafe_b64encode(b).rstrip(b"=").decode()
    head, sealed, payload = url(b'{"alg":"RS256"}'), url(b'{"alg":"dir","enc":"A128GCM","x":{"y":["}\\"{"]}}'), url(b'{"sub":1}')
    for token in (f"{head}.{payload}.c2ln", f"{head}.{payload}.", f"{head}..c2ln", f"{sealed}.a2V5.aXY.Y3Q.dGFn", f"{sealed}..aXY.Y3Q.dGFn"):
        for front in ("", "Bearer ", "x.y.", "ab_eyJ", "é"):
            assert _spans(f"{front}{token} end", "jwt") == [token], (token, front)
    for other in (f"{head}.a2V5.aXY.Y3Q.dGFn", f"{sealed}.a2V5.aXY..dGFn", f"{head}..", f"{head}.x", f"{payload}..c2ln"):
        assert not _spans(f"{other} end", "jwt"), other
    assert _spans(f"{head}.{payload}.c2ln.{sealed}..aXY.Y3Q.dGFn", "jwt") == [f"{head}.{payload}.c2ln", f"{sealed}..aXY.Y3Q.dGFn"]


def test_scan_is_linear():
    import time

    n = 1 << 18
    for unit in ("M", "30", "-----BEGIN A KEY-----\n", "MIIB", "e", "ew", "eyJ", "a.", "eyJh.", "{", "ICAg", "-", "AKIA", "token=", "M\n", "Proc-Type: 4,ENCRYPTED\n", "-----BEGIN A-----\n-----END B-----\n", "300202003003020100", "a..", "3080"):
        began = time.time()
        secret_scan.scan(unit * (n // len(unit)))
        secret_scan.scan(unit * (n // len(unit)) + ".e30.x")
        assert time.time() - began < 10, unit
    url = lambda b: base64.urlsafe_b64encode(b).rstrip(b"=").decode()
    for unit in (b'{"a":[', b'{"a":', b'"', b'\\"', b"}", b'{"alg":"x"}', b'{"a":{"alg":"'):
        for tail in (b"", b"}", b'"}]}'):
            began = time.time()
            secret_scan.scan(url(unit * ((1 << 20) // len(unit)) + tail) + ".e30.x")
            assert time.time() - began < 5, (unit, tail)
    # candidates that each claim a long tail of items which a wrong one ends
    tail = bytes.fromhex("020100") * 20_000 + b"\x30\x01\x05"
    heads, size = b"", 10 * 3000
    for i in range(3000):
        left = size - 10 * i
        heads += b"\x30\x83" + (left - 5 + len(tail)).to_bytes(3, "big") + b"\x30\x83" + (left - 10).to_bytes(3, "big")
    began = time.time()
    secret_scan.scan((heads + tail).hex())
    secret_scan.scan(base64.b64encode(heads + tail).decode())
    assert time.time() - began < 10


# ---- learnt scores


def auc(pairs):
    s = sorted(pairs)
    ranks = defaultdict(list)
    for i, (x, _) in enumerate(s):
        ranks[x].append(i + 1)
    good = [np.mean(ranks[x]) for x, y in s if y]
    return (sum(good) - len(good) * (len(good) + 1) / 2) / (len(good) * (len(s) - len(good)))


# the smallest table with labels enough: toxic ones are a tenth
@pytest.mark.parametrize(("op", "label", "sf", "least"), [(quality_classifier.op4, "quality", "/root/testdata/sf0.01", 0.97), (toxicity.op10, "toxic", "/root/testdata/sf0.1", 0.94)])
def test_held_out(spark, op, label, sf, least):
    rows = op(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "left").collect()
    of, rest = (4, 2) if label == "quality" else (5, 0)
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % of == rest) and 0 <= r["score"] <= 1 for r in rows)
    assert auc([(r["score"], r[label]) for r in rows if r["held_out"] and r[label] is not None]) >= least


def test_scores_of_awkward_rows(spark):
    texts = awkward(5)
    docs = docs_of(spark, texts)
    none = spark.createDataFrame([], "doc_id long, quality int")
    half = quality_classifier.classify(docs, none)
    assert half.count() == len(texts) and {r["score"] for r in half.collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1) for i in range(20)] + [(None, 1), (3, None), (10**6, 0)], "doc_id long, quality int")
    assert len({r["score"] for r in quality_classifier.classify(docs, ones).collect()}) == 1
    given = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    assert all(0 <= r["score"] <= 1 for r in quality_classifier.classify(docs, given).collect())
    assert quality_classifier.classify(docs_of(spark, []), given).count() == 0


def test_fit_against_dense_least_squares(spark):
    rng = random.Random(31)
    texts = [" ".join(rng.choice(VOCAB) + rng.choice(["", "", "\n"]) for _ in range(rng.randint(1, 80))) for _ in range(300)]
    label = [int(len(t) > 150) ^ int(rng.random() < 0.1) for t in texts]
    stats = stored(quality_classifier.measured(docs_of(spark, texts).withColumn("x", F.lit("clash"))), "stats")
    model = quality_classifier.fit(stats, spark.createDataFrame(list(enumerate(label)), "doc_id long, label int"))
    x = np.array([r["x"] for r in stats.orderBy("doc_id").collect()])
    y, n = np.array(label, float), len(texts)
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, np.sqrt(np.maximum(1e-6, x.var(0))))
    z = np.hstack([np.ones((n, 1)), np.cos(np.clip((x - model.mean) / model.scale, -6, 6) @ model.turn + model.phase) * math.sqrt(2 / quality_classifier.FEATURES)])
    ridge = quality_classifier.RIDGE * n / quality_classifier.FEATURES * np.diag([0.0] + [1.0] * quality_classifier.FEATURES)
    top, low = np.vstack([z, np.sqrt(ridge)]), np.concatenate([y, np.zeros(len(ridge))])
    assert np.allclose(z @ np.linalg.lstsq(top, low, rcond=None)[0], model.raw(x), atol=1e-6)
    # isotonic means by their definition: the least of the means upward of the greatest of the means downward
    steps = np.clip(np.round(model.raw(x) * quality_classifier.STEPS), -quality_classifier.STEPS, 2 * quality_classifier.STEPS)
    level, at = np.unique(steps, return_inverse=True)
    rows, good = np.bincount(at), np.bincount(at, y)
    r, g = np.concatenate([[0], np.cumsum(rows)]), np.concatenate([[0], np.cumsum(good)])
    best = np.array([max(min((g[j] - g[i]) / (r[j] - r[i]) for j in range(k + 1, len(r))) for i in range(k + 1)) for k in range(len(level))])
    for s, rate in zip(model.at, model.rate, strict=True):
        mine = np.isclose(best, best[np.argmin(abs(level / quality_classifier.STEPS - s))])
        assert math.isclose(rate, (good[mine].sum() + 0.5) / (rows[mine].sum() + 1))


def test_markers_and_weights_against_brute_force(spark):
    rng = random.Random(32)
    words = ["alpha", "beta", "gammas", "gammaray", "delta", "omega", "Vile", "viler", "vilest"]
    rows = [(" ".join(rng.choice(words[:6] + words[6:] * (y * 2)) for _ in range(12)), y) for y in [rng.random() < 0.4 for _ in range(400)]]
    texts = stored(spark.createDataFrame([(t, int(y)) for t, y in rows], "text string, label int").repartition(3), "texts")
    g = toxicity.markers(texts)
    total = Counter(int(y) for _, y in rows)

    def odds(has):
        yes, no = (sum(has(t) for t, y in rows if y == k) for k in (True, False))
        return yes, (yes + 0.5) / (total[1] + 1.0) / ((no + 0.5) / (total[0] + 1.0))

    want = {w.lower() for w in words if (o := odds(lambda t, w=w: w.lower() in t.lower().split()))[0] >= toxicity.MARKER_LEAST and o[1] >= toxicity.MARKER_ODDS}
    assert sorted(g.markers.tolist()) == sorted(toxicity._hash_words(sorted(want)).tolist()) and want == {"vile", "viler", "vilest"}
    counts = spark.createDataFrame([(i, [float(rng.randint(0, 3)) for _ in toxicity.CONTEXTS]) for i in range(200)], "doc_id long, x array<double>")
    label = spark.createDataFrame([(i, int(rng.random() < 0.3)) for i in range(150)], "doc_id long, label int")
    w = toxicity.weigh(counts, label)
    z = toxicity.terms(np.array([r["x"] for r in counts.orderBy("doc_id").limit(150).collect()]))
    y = np.array([r["label"] for r in label.orderBy("doc_id").collect()], float)
    pull, start = np.array([0.01] + [toxicity.PRIOR_ROWS] * len(toxicity.PRIOR)), np.concatenate([[toxicity.BIAS], toxicity.PRIOR])
    assert np.abs(z.T @ (y - 1 / (1 + np.exp(-z @ w))) - pull * (w - start)).max() < 1e-2


def test_isotonic():
    at, rate = quality_classifier.pool([(0.0, 10, 1), (0.2, 10, 0), (0.5, 10, 9), (0.7, 10, 8), (0.9, 10, 10)])
    assert (np.diff(at) > 0).all() and (np.diff(rate) > 0).all() and len(at) == 3


def contexts(texts):
    g = toxicity.Grammar(np.zeros(0, np.uint64), {})
    data = [t.encode() for t in texts]
    x = g.matches(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    return [Counter({toxicity.CONTEXTS[k]: int(r[k]) for k in np.flatnonzero(r)}) for r in x]


def read_clauses(text):
    """The grammar again, clause by clause and word by word."""
    words = {w: k for k, held in ((toxicity.NEGATION, toxicity.NEGATIONS), (toxicity.REPORT, toxicity.REPORTS), (toxicity.TARGET, toxicity.TARGETS), (toxicity.THREAT, toxicity.THREATS), (toxicity.INSULT, toxicity.INSULTS)) for w in held}
    out = Counter()
    for clause in re.split(r"[.!?;\n]", text.lower()):
        seen, since = defaultdict(list), 99
        for token in re.findall(r"[a-z'\u0080-\uffff]+|[,:\"()]", re.sub("[“”„‟«»]", '"', clause)):
            if token in ',:"()':
                since = 99
                continue
            kind = words.get(token)
            seen[kind].append(since < toxicity.REACH)
            since = 0 if kind == toxicity.NEGATION else since + 1
        for kind in (toxicity.INSULT, toxicity.THREAT):
            if seen[kind]:
                out[kind, int(bool(seen[toxicity.TARGET])), int(all(seen[kind])), int(bool(seen[toxicity.REPORT]))] += len(seen[kind])
    return out


def test_grammar(spark):
    i, t = toxicity.INSULT, toxicity.THREAT
    says = {
        "You are an idiot": [(i, 1, 0, 0)], "he is not an idiot": [(i, 1, 1, 0)], "they said you idiot": [(i, 1, 0, 1)], "fine words. Idiot": [(i, 0, 0, 0)], "": [], "I will kill you": [(t, 1, 0, 0)],
        "idiot, you are": [(i, 1, 0, 0)], 'They said: "you idiot"': [(i, 1, 0, 1)], "do not say you are an idiot": [(i, 1, 1, 1)], "“you idiot”, they wrote": [(i, 1, 0, 1)], "no, you idiot": [(i, 1, 0, 0)],
        "never a fool. what a fool": [(i, 0, 1, 0), (i, 0, 0, 0)], "you idiot, I will beat you": [(i, 1, 0, 0), (t, 1, 0, 0)], "not a fool, a moron": [(i, 0, 0, 0)] * 2, "we don't destroy them": [(t, 1, 1, 0)],
    }
    assert contexts(list(says)) == [Counter(v) for v in says.values()]
    rng = random.Random(13)
    pick = [*(w for held in (toxicity.INSULTS, toxicity.THREATS, toxicity.TARGETS, toxicity.NEGATIONS, toxicity.REPORTS) for w in held[:4]), *"a b c d the über né".split()]
    texts = ["".join(rng.choice(pick) + rng.choice([" ", " ", " ", ", ", ". ", '"', ": ", "“", "\n", " (", "! "]) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    assert contexts(texts) == [read_clauses(t) for t in texts]
    none = spark.createDataFrame([], "doc_id long, label int")
    docs = docs_of(spark, [*says, None]).withColumns({"label": F.lit("clash"), "x": F.lit(0), "least": F.lit(0)})
    s = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, none).collect()}
    assert s[0] > s[1] and s[0] > s[2] and s[4] == s[len(says)] < s[3]
    assert toxicity.score_toxicity(docs_of(spark, []), none).count() == 0


# ---- pipeline


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(stored(stage(spark, tables[-1], sf), "stage"))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert tables[-1].dtypes == docs.dtypes
    text = [{r["doc_id"]: r["text"] for r in t.collect()} for t in tables[:5]]
    scores = {r["doc_id"]: r["score"] for r in quality_classifier.classify(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert set(text[1]) == {k for k, s in scores.items() if s >= 0.7}
    want = classes({k: shingles(t) for k, t in text[1].items()}, lambda a, b: len(a) > 0 and len(b) > 0 and 100 * len(a & b) >= 75 * len(a | b))
    assert set(text[2]) == {k for k in text[1] if want[k] == k}
    assert text[3] == {k: secret_scan.redact(t, secret_scan.scan(t)) for k, t in text[2].items()}
    copies = Counter(r["doc_id"] for r in tables[4].select("doc_id").collect())
    plan = {r["doc_id"]: r["copies"] for r in source_mixing.mix_sources(tables[3]).collect()}
    assert copies == {k: n for k, n in plan.items() if n}
    tokens = {k: len(Encoder.of(default_path()).ids(text[3][k])) // 4 + 1 for k in copies}
    assert tables[5].agg(F.sum("length")).first()[0] == sum(tokens[k] * n for k, n in copies.items())
    digest = hashlib.sha256(str(sorted(map(str, corpus_pipeline.run(spark, sf).drop("sequence_id", "offset").collect()))).encode()).hexdigest()
    assert digest == hashlib.sha256(str(sorted(map(str, tables[5].drop("sequence_id", "offset").collect()))).encode()).hexdigest()


def test_stages_with_awkward_rows(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    texts = awkward(41, 25)
    docs = docs_of(spark, texts + texts[:12], [*range(len(texts)), *range(6), *range(100, 106)])
    docs = docs.unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    for rows in (docs, docs.limit(0)):
        table = rows
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            extra = table.withColumns({c: F.lit(c) for c in ("x", "copies", "copy", "key", "head", "secrets", "part", "name")})
            kept = stored(stage(spark, extra, sf), "stage")
            if k < 4:
                assert kept.columns == corpus_pipeline.COLUMNS
                before = Counter(map(str, table.select("doc_id", "source").collect()))
                assert not Counter(map(str, kept.select("doc_id", "source").distinct().collect())) - before
            else:
                assert kept.count() == 0 if rows is not docs else kept.agg(F.sum("length")).first()[0] > 0
            table = kept if k else table  # the classifier rejects nearly all of these
    one = corpus_pipeline.drop_near_copies(spark, docs, sf).collect()
    assert len({(r["doc_id"], r["text"]) for r in one}) == len(one) and {r["doc_id"] for r in one if r["doc_id"] is not None} <= {r["doc_id"] for r in docs.collect()}
