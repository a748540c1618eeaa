"""Chunking and retrieval: vectors, BM25, reciprocal-rank fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.operators.filters import small
from lodestream.operators.star import numbered
from lodestream.sources.store import written

#: Vectors compared in one block.
QUERY_BLOCK, ITEM_BLOCK = 1024, 4096
K1, B = 1.2, 0.75
#: Items and queries that BM25 compares in one block.
ITEMS, ASKED = 2048, 4096


def chunk(df: DataFrame, key: str, text: str, size: int = 2000) -> DataFrame:
    """(key, chunk_no, chunk): paragraphs are packed up to ``size`` characters, longer ones sliced.

    Paragraphs get running totals by a fold that keeps the open chunk and the
    closed ones; a text's chunks are a row each.
    """
    paragraphs = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), lambda p: F.trim(p)), lambda p: p != "")
    slices = F.flatten(F.transform(paragraphs, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / size).cast("int")), lambda i: F.substring(p, i * size + 1, F.lit(size)))))

    def add(acc: Column, p: Column) -> Column:
        fits = (acc["open"] != "") & (F.length(acc["open"]) + 2 + F.length(p) <= size)
        joined = F.when(fits, F.concat(acc["open"], F.lit("\n\n"), p)).otherwise(p)
        closed = F.when(fits | (acc["open"] == ""), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))
        return F.struct(joined.alias("open"), closed.alias("done"))

    packed = F.aggregate(slices, F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("done")), add, lambda a: F.when(a["open"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))))
    return df.select(key, F.posexplode(packed).alias("chunk_no", "chunk"))


def tags_match(tags: Column, wanted: dict[str, str]) -> Column:
    out = F.lit(True)
    for k, v in wanted.items():
        out = out & F.coalesce(F.try_element_at(tags, F.lit(k)) == v, F.lit(False))
    return out


def _blocks(df: DataFrame, key: str, size: int) -> DataFrame:
    """(ids, dim, vectors): up to ``size`` vectors of one length in a row; null and empty ones are left out."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            vectors = [None if v is None else np.asarray(v, np.float64) for v in f["embedding"]]
            for dim in sorted({len(v) for v in vectors if v is not None and len(v)}):
                at = [i for i, v in enumerate(vectors) if v is not None and len(v) == dim]
                for lo in range(0, len(at), size):
                    part = at[lo : lo + size]
                    yield pd.DataFrame({"ids": [f[key].to_numpy()[part]], "dim": [dim], "vectors": [np.stack([vectors[i] for i in part]).tobytes()]})

    return df.select(key, "embedding").mapInPandas(each, "ids array<long>, dim int, vectors binary")


def vector_search(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """``queries`` (query_id, embedding), ``items`` (item_id, embedding): the k best of each query by dot product.

    A stated set of queries meets all items block by block; a pair of blocks sends
    on k rows for each query, and nothing passes through the driver.
    """
    asked = _blocks(queries, "query_id", QUERY_BLOCK).withColumnsRenamed({"ids": "q_ids", "dim": "q_dim", "vectors": "q_vectors"})
    pairs = _blocks(items, "item_id", ITEM_BLOCK).crossJoin(asked)

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                if r.dim != r.q_dim:
                    continue
                names, ids = np.asarray(r.q_ids), np.asarray(r.ids)
                s = np.frombuffer(r.q_vectors).reshape(-1, r.dim) @ np.frombuffer(r.vectors).reshape(-1, r.dim).T
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                rows = np.repeat(np.arange(len(names)), top.shape[1])
                yield pd.DataFrame({"query_id": names[rows], "item_id": ids[top.ravel()], "score": s[rows, top.ravel()]})

    return ranked(pairs.mapInPandas(each, "query_id long, item_id long, score double"), k)


def ranked(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("item_id"))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def bm25(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """``queries`` and ``items``: (id, terms as array). Scores by term frequency, length and rarity over all items.

    Pairs of query and item are never rows: blocks of items meet blocks of queries in a task,
    which sends on k rows for each query.
    """
    lengths = items.select("item_id", F.size("terms").alias("n"))
    total = lengths.agg(F.count(F.lit(1)).alias("items"), F.avg("n").alias("mean"))
    asked = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))
    wanted = written(numbered(asked.select("term").distinct(), [F.col("term")], "w"), "terms")
    # only terms that some query has are counted; a term that most items have is summed within each task first
    posts = items.select("item_id", F.size("terms").alias("n"), F.explode("terms").alias("term")).join(small(wanted), "term").groupBy("item_id", "n", "w").agg(F.count(F.lit(1)).alias("tf"))
    posts = written(posts, "postings")
    found = posts.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log1p((F.col("items") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    rare = written(asked.join(small(wanted), "term").join(found.hint("merge"), "w").join(F.broadcast(total)).select("query_id", "w", idf.alias("idf")), "asked")  # total is one row
    many, groups = (1 + df.count() // size for df, size in ((lengths, ITEMS), (queries, ASKED)))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    held = posts.join(F.broadcast(total)).select("item_id", "w", "tf", (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.col("mean"))).alias("norm"), block("item_id", many).alias("i"), every(groups).alias("q"))
    rare = rare.select("query_id", "w", "idf", every(many).alias("i"), block("query_id", groups).alias("q"))

    def each(ask: pd.DataFrame, post: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "item_id": [], "score": []}
        post = post.sort_values("w", kind="stable")
        names, at = np.unique(post["item_id"].to_numpy(), return_inverse=True)
        terms, tf, norm = (post[c].to_numpy() for c in ("w", "tf", "norm"))
        for query, part in ask.sort_values(["query_id", "w"]).groupby("query_id"):
            bounds = np.searchsorted(terms, part["w"].to_numpy()), np.searchsorted(terms, part["w"].to_numpy(), "right")
            spans = [(slice(lo, hi), idf) for lo, hi, idf in zip(*bounds, part["idf"], strict=True) if lo < hi]
            if not spans:
                continue
            scores = np.bincount(np.concatenate([at[s] for s, _ in spans]), np.concatenate([idf * tf[s] * (K1 + 1) / norm[s] for s, idf in spans]))
            met = np.flatnonzero(scores)
            rounded = np.floor(scores[met] * 1e9 + 0.5) / 1e9
            if len(met) > k:
                best = rounded >= np.partition(rounded, -k)[-k]
                met, rounded = met[best], rounded[best]
            best = np.lexsort((met, -rounded))[:k]
            out["query_id"] += [query] * len(best)
            out["item_id"] += names[met[best]].tolist()
            out["score"] += rounded[best].tolist()
        return pd.DataFrame(out)

    parts = max(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), many * groups)
    left, right = rare.repartition(parts, "i", "q"), held.repartition(parts, "i", "q")
    kinds = ", ".join(f"{c} {d.schema[c].dataType.simpleString()}" for d, c in ((queries, "query_id"), (items, "item_id")))
    return ranked(left.groupBy("i", "q").cogroup(right.groupBy("i", "q")).applyInPandas(each, f"{kinds}, score double"), k)


def fuse(lists: list[DataFrame], k: int, c: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (query_id, item_id, rank)."""
    out = None
    for one in lists:
        part = one.select("query_id", "item_id", (1.0 / (c + F.col("rank"))).alias("score"))
        out = part if out is None else out.unionByName(part)
    return ranked(out.groupBy("query_id", "item_id").agg(F.round(F.sum("score"), 12).alias("score")), k)


def shape_results(results: DataFrame, title: str, answer: str, most: int = 20) -> DataFrame:
    """No hit: a notice; hits without an answer: the list of the first ``most`` sources."""
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("rank").asc_nulls_last()))
    said = results.groupBy("query_id").agg(F.max(answer).alias("a"))
    results = results.select("query_id", "rank", title).withColumn("_n", best).filter(F.col("_n") <= most).drop("_n")
    hits = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.coalesce(title, F.lit("untitled")).alias("title")))).alias("h")).join(said.hint("merge"), "query_id")
    names = F.array_join(F.transform(F.filter("h", lambda x: x["rank"].isNotNull()), lambda x: x["title"]), "; ")
    return hits.select("query_id", F.when(F.coalesce("a", F.lit("")) != "", F.col("a")).when(names == "", "no result").otherwise(F.concat(F.lit("sources: "), names)).alias("shown"))


@F.udtf(returnType="chunk_no: int, chunk: string")
class TextChunks:
    """Table function: the chunks of one text, as ``chunk`` cuts them, for use in SQL once registered."""

    def eval(self, text: str, size: int = 2000):
        parts = [p.strip(" ") for p in (text or "").split("\n\n")]
        slices = [p[i : i + size] for p in parts for i in range(0, len(p), size)]
        number, held = 0, ""
        for s in slices:
            if held and len(held) + 2 + len(s) > size:
                yield number, held
                number, held = number + 1, s
            else:
                held = f"{held}\n\n{s}" if held else s
        if held:
            yield number, held
