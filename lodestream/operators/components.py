"""Connected components of a link table, by tasks that put their links together, then by rounds of joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.sources.store import discard, written

#: Links that a task holds at once, and how often tasks put links together before the rounds of joins.
HELD, LEVELS = 1 << 19, 4


def _tops(links: Iterator[tuple]) -> dict:
    """The smallest node that each node of ``links`` reaches by them."""
    top: dict = {}

    def find(x: object) -> object:
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    for a, b in links:
        top.setdefault(a, a)
        top.setdefault(b, b)
        a, b = find(a), find(b)
        if a != b:
            top[max(a, b)] = min(a, b)
    return {x: find(x) for x in top}


def _put_together(links: DataFrame) -> DataFrame:
    """(node, top) for each run of HELD links of a partition: the smallest node reached by the links of the run, also of that node itself."""
    kind = links.schema["a"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, held, count = None, [], 0

        def found() -> pa.RecordBatch:
            tops = _tops((a, b) for batch in held for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(list(tops), schema), pa.array(list(tops.values()), schema)], ["node", "top"])

        for batch in batches:
            schema = batch.schema.field(0).type
            held.append(batch)
            count += batch.num_rows
            if count >= HELD:
                yield found()
                held, count = [], 0
        if held:
            yield found()

    return links.select("a", "b").mapInArrow(each, f"node {kind}, top {kind}")


def components(links: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``links``: (a, b), one way each. Returns (node, root): the smallest node that can be reached.

    Each task puts the links of its partition together first, so that a node has one
    top in each run of links at most. Two nodes reach each other if their tops do, by
    the nodes that tops share: each node's tops are linked with the smallest of them,
    and the tops, fewer than the nodes, are the next level. A node with very many links is at the top of them
    or has as many tops as there are runs, so it is no hot spot. After ``levels`` of them, ``by_rounds`` does what is left. Nodes without links don't appear.
    """
    links = links.filter("a <> b")
    if not levels:
        return by_rounds(links)
    tops = written(_put_together(links).groupBy("node").agg(F.array_sort(F.collect_set("top")).alias("tops")), "tops")
    more = tops.filter("size(tops) > 1").select(F.col("tops")[0].alias("b"), F.explode(F.slice("tops", F.lit(2), F.size("tops") - 1)).alias("a")).select("a", "b")
    up = tops.select("node", F.col("tops")[0].alias("top"))
    if not more.take(1):
        return up.withColumnRenamed("top", "root")
    # read back, so their sizes are known: a small level needs no shuffle
    roots = written(components(more, levels - 1).withColumnRenamed("node", "top"), "roots")
    return up.join(roots, "top", "left").select("node", F.coalesce("root", "top").alias("root"))


def by_rounds(links: DataFrame) -> DataFrame:
    """As ``components``, by joins alone.

    A round takes the smallest root among a node and its neighbours, offers it
    to the node's old root too, so that whole trees move, and then takes the root
    of that root. Rounds go on until no root changes; the tables of a round are
    deleted when the next has its own. Joins are left to split skewed keys, and
    the smallest is taken before and after each shuffle, so a node with very many
    links is no hot spot.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "links")
    if not both.take(1):
        return both.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "roots")
    none = F.lit(None).cast(roots.schema["root"].dataType)
    while True:
        near = both.join(roots.withColumnRenamed("node", "b").hint("merge"), "b").groupBy("a").agg(F.min("root").alias("near"))
        one = roots.join(near.withColumnRenamed("a", "node").hint("merge"), "node", "left").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        offers = one.select(F.explode(F.array(F.struct("node", "old", "root"), F.struct(F.col("old").alias("node"), none.alias("old"), "root"))).alias("x")).select("x.*")
        one = written(offers.groupBy("node").agg(F.max("old").alias("old"), F.min("root").alias("root")), "roots")
        jump = one.select(F.col("node").alias("root"), F.col("root").alias("further"))
        two = written(one.join(jump.hint("merge"), "root").select("node", "old", F.least("root", "further").alias("root")), "roots")
        discard(one)
        discard(roots)
        roots = two.select("node", "root")
        if not two.filter("old <> root").take(1):
            discard(both)
            return roots
