"""Exact nearest vectors by dot product over an inverted file of blocks that bounds prune, and retrieval by several recalls.

Vectors near the same centroid are packed into blocks, each with the centre and
radius of a ball around its own vectors. No vector of a block has a larger product
with a query than q . centre + |q| radius. So once some block has given k
scores, blocks whose bound is below the k-th of them can't hold anything better and aren't read.
Centroids only make blocks tight: they come from a bounded sample, and results
don't depend on them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.operators import retrieval
from lodestream.sources.store import written

#: Vectors in a block, summaries of blocks and queries in a row, centroids and the vectors they are chosen from.
BLOCK, SUMMARIES, QUERIES, CENTROIDS, SAMPLE = 1024, 1024, 256, 64, 4096
#: Queries in a bucket, and buckets at most.
BUCKET, BUCKETS = 1024, 64
#: Slack for rounding in bounds.
SLACK = 1e-9
INDEX = "block long, dim int, centre binary, radius double, ids array<long>, vectors binary"


def _centroids(sample: np.ndarray, many: int, rounds: int = 5) -> np.ndarray:
    centres = sample[:many].copy()
    for _ in range(rounds):
        at = np.argmin(((sample[:, None, :] - centres[None]) ** 2).sum(2), 1) if len(sample) * len(centres) < 1 << 16 else np.argmin((centres**2).sum(1)[None] - 2 * sample @ centres.T, 1)
        for c in range(len(centres)):
            if (at == c).any():
                centres[c] = sample[at == c].mean(0)
    return centres


def build_index(items: DataFrame) -> DataFrame:
    """A stored table of blocks from ``items`` (item_id, embedding). Null and empty vectors and such with a null or non-finite value are left out; lengths may differ."""
    some = items.select("item_id", "embedding").orderBy(F.xxhash64("item_id")).limit(SAMPLE).toPandas()  # a bounded sample
    by: dict[int, list] = {}
    for v in some["embedding"]:
        if v is not None and len(v):
            w = np.array([np.nan if x is None else x for x in v], np.float64)
            if np.isfinite(w).all():
                by.setdefault(len(w), []).append(w)
    centres = {d: _centroids(np.stack(vs), CENTROIDS) for d, vs in by.items()}

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, v in zip(f["item_id"], f["embedding"], strict=True):
                w = np.array([] if v is None else [np.nan if x is None else x for x in v], np.float64)
                if len(w) and np.isfinite(w).all():
                    c = centres.get(len(w))
                    out.append((k, len(w), 0 if c is None else int(np.argmin((c**2).sum(1) - 2 * c @ w)), w.tobytes()))
            yield pd.DataFrame(out, columns=["item_id", "dim", "cluster", "v"])

    placed = items.select("item_id", "embedding").mapInPandas(near, "item_id long, dim int, cluster int, v binary")

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 32, {}

        def block(key: tuple, rows: list) -> pd.DataFrame:
            nonlocal number
            m = np.stack([np.frombuffer(v) for _, v in rows])
            c = m.mean(0)
            number += 1
            return pd.DataFrame({"block": [number - 1], "dim": [key[0]], "centre": [c.tobytes()], "radius": [float(np.sqrt(((m - c) ** 2).sum(1).max()))], "ids": [[k for k, _ in rows]], "vectors": [m.tobytes()]})

        for f in frames:
            for k, d, c, v in zip(f["item_id"], f["dim"], f["cluster"], f["v"], strict=True):
                rows = held.setdefault((d, c), [])
                rows.append((k, v))
                if len(rows) == BLOCK:
                    yield block((d, c), held.pop((d, c)))
        for key, rows in held.items():
            yield block(key, rows)

    # a large cluster is dealt to several tasks by the hash of its items
    dealt = placed.repartition(F.col("dim"), F.col("cluster"), F.pmod(F.xxhash64("item_id"), F.lit(8)))
    return written(dealt.mapInPandas(pack, INDEX), "index")


def _rows(df: DataFrame, names: list[str], size: int, schema: str) -> DataFrame:
    """Rows of one ``dim`` side by side: lists of up to ``size`` values."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for dim, part in f.groupby("dim"):
                for i in range(0, len(part), size):
                    yield pd.DataFrame({"dim": [dim], **{n: [part[n].iloc[i : i + size].tolist()] for n in names}})

    return df.select("dim", *names).mapInPandas(each, schema)


def index_search(queries: DataFrame, index: DataFrame, k: int, trace: dict | None = None) -> DataFrame:
    """``queries`` (query_id, embedding) against ``build_index``: (query_id, item_id, score, rank) of the k best, ties by item_id.

    ``trace`` gets the pairs of query and block that were read, and all there are.
    """
    q = queries.filter("embedding IS NOT NULL AND size(embedding) > 0").select("query_id", F.size("embedding").alias("dim"), F.col("embedding").cast("array<double>").alias("v"))
    q = written(q.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))), "queries")
    asked = written(_rows(q, ["query_id", "v"], QUERIES, "dim int, query_id array<long>, v array<array<double>>"), "asked")
    short = written(_rows(index, ["block", "centre", "radius"], SUMMARIES, "dim int, block array<long>, centre array<binary>, radius array<double>"), "summaries")

    def bounds(r) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v, c = np.array([list(x) for x in r.v]), np.stack([np.frombuffer(x) for x in r.centre])
        return np.asarray(r.query_id), np.asarray(r.block), v @ c.T + np.sqrt((v**2).sum(1))[:, None] * np.asarray(r.radius)[None] + SLACK

    def likely(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                ids, blocks, u = bounds(r)
                best = u.argmax(1)
                yield pd.DataFrame({"query_id": ids, "block": blocks[best], "bound": u[np.arange(len(ids)), best]})

    met = asked.join(short.hint("shuffle_hash"), "dim")
    buckets = min(BUCKETS, 1 + q.count() // BUCKET)
    first = met.mapInPandas(likely, "query_id long, block long, bound double").groupBy("query_id").agg(F.max_by("block", "bound").alias("block"))
    start = written(_products(q.join(first.hint("merge"), "query_id").select("query_id", "v", "block"), index, k, buckets), "start")
    floor = start.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    limited = _rows(q.join(floor.hint("merge"), "query_id", "left").select("dim", "query_id", "v", F.coalesce("floor", F.lit(float("-inf"))).alias("floor")), ["query_id", "v", "floor"], QUERIES, "dim int, query_id array<long>, v array<array<double>>, floor array<double>")

    def open_(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                ids, blocks, u = bounds(r)
                i, j = np.nonzero(u >= np.asarray(r.floor)[:, None])
                yield pd.DataFrame({"query_id": ids[i], "block": blocks[j]})

    pairs = written(written(limited, "limited").join(short.hint("shuffle_hash"), "dim").mapInPandas(open_, "query_id long, block long"), "pairs")
    if trace is not None:
        trace["read"], trace["all"] = pairs.count(), q.count() * index.count()
    return retrieval.ranked(_products(pairs.join(q.select("query_id", "v").hint("merge"), "query_id"), index, k, buckets), k)


def _products(pairs: DataFrame, index: DataFrame, k: int, buckets: int) -> DataFrame:
    """(query_id, item_id, score): the k best of each query in each block of ``pairs`` (query_id, v, block). A block meets its queries in buckets, and is sent to each."""
    left = pairs.withColumn("bucket", F.pmod(F.xxhash64("query_id"), F.lit(buckets)))
    wanted = left.select(F.col("block").alias("_block"), F.col("bucket").alias("_bucket")).distinct()
    right = index.join(wanted.hint("merge"), F.col("block") == F.col("_block")).select("_block", "_bucket", "ids", "vectors")

    def each(asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(block):
            return pd.DataFrame({"query_id": [], "item_id": [], "score": []})
        ids, v = np.asarray(block["ids"].iloc[0]), np.array([list(x) for x in asked["v"]])
        s = v @ np.frombuffer(block["vectors"].iloc[0]).reshape(len(ids), -1).T
        top = np.stack([np.lexsort((ids, -row))[:k] for row in s])
        rows = np.repeat(np.arange(len(v)), top.shape[1])
        return pd.DataFrame({"query_id": asked["query_id"].to_numpy()[rows], "item_id": ids[top.ravel()], "score": s[rows, top.ravel()]})

    return left.groupBy("block", "bucket").cogroup(right.groupBy("_block", "_bucket")).applyInPandas(each, "query_id long, item_id long, score double")


def retrieve(queries: DataFrame, items: DataFrame, k: int, filters: dict[str, str] | None = None, tags: Column | None = None, method: str = "hybrid", depth: int = 20) -> DataFrame:
    """(query_id, item_id, score, rank): by ``vector``, ``fulltext`` or ``hybrid``, among items whose tags hold all ``filters``. k is held to 1..20.

    Both sides have an id, ``terms`` and ``embedding``. Hybrid fuses the first
    ``depth`` of each recall by reciprocal ranks.
    """
    k = max(1, min(20, k))
    held = items.filter(retrieval.tags_match(tags, filters)) if filters else items
    words = lambda n: retrieval.bm25(queries.select("query_id", "terms"), held.select("item_id", "terms"), n)
    near = lambda n: index_search(queries.select("query_id", "embedding"), build_index(held.select("item_id", "embedding")), n)
    if method == "vector":
        return near(k)
    if method == "fulltext":
        return words(k)
    if method != "hybrid":
        raise ValueError("method is vector, fulltext or hybrid")
    lists = [written(one(max(depth, k)).select("query_id", "item_id", "rank"), "recall") for one in (near, words)]
    return retrieval.fuse(lists, k)
