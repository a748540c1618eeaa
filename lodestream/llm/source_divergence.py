"""Source divergence audit: how far the words of each source of a language are from its other sources, and which words it overuses.

A term is a run of letters: ASCII letters, A-Z lower-cased, and all characters
beyond ASCII. A language keeps the terms that at least LEAST of its documents
hold. With V kept terms, count occurrences of one and N of all of them in a group
(lang, source) or in a whole language, its share is

    p = 1 + floor(1000000000 * (count + 1) / (N + V))

and the distance of p from another share q is floor((p - q) * (p - q) / q). All
arithmetic is exact. Part ``pair`` sums the distances of a group from each other
source of its language over all kept terms. Part ``term`` ranks the terms whose
share in the group is above that in the language, up to a rank.

More in the group, less in the language, earlier in UTF-8: a term that comes
before another in all three (or is its equal in the first two) ranks before it.
So of each part of a group only the terms that fewer than k others dominate are
kept (a skyband); the skybands of all parts are merged in the same way, and what
is left is ranked exactly.

Counts are summed in tasks, before the shuffle and after it, so no language,
source or term is a hot spot. Terms meet the shares of their language's sources in
blocks of bounded size; what a block gives has one row for each two sources, as
the report has.

Null texts, languages and sources are empty ones. A group without terms, or a
language that keeps none, has distances of its equal shares (0 without kept
terms). Rows alike count as often as they occur; doc_id isn't read; an empty table
gives no row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.llm import words as W
from lodestream.llm.store import stored
from lodestream.operators.filters import small

#: Documents of a language that must hold a term.
LEAST = 3
#: Ranks of the term part.
RANKS = 200
UNIT = 1_000_000_000
#: Cells (terms times sources) of one block of the pair part; counts of one part of a skyband; skybands merged at a time.
BLOCK, CELLS, FAN = 1 << 18, 500_000, 16
#: Bytes of text counted at once.
RUN = 4 << 20
LETTER = np.zeros(256, bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = LETTER[0x80:] = True


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]]:
    """Bytes, offsets, languages and sources of about RUN bytes of whole texts."""
    held, size = [], 0

    def joined() -> tuple:
        table = pa.Table.from_batches(held).combine_chunks()
        data, off = W.buffers(table.column("text").chunk(0))
        return data, off, table.column("lang").chunk(0), table.column("source").chunk(0)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
            if size >= RUN:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold the term; a null term for each group, so that none is lost."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, off, langs, sources in _runs(batches):
            low = W.LOWER[data]
            s, e, row = W.spans(LETTER[low], off)
            groups = pa.StructArray.from_arrays([langs, sources], ["l", "s"])
            names = {}
            of = np.array([names.setdefault((g["l"], g["s"]), len(names)) for g in groups.to_pylist()], np.int64)
            h = W.span_hashes(low, s, e)
            # first the distinct terms of each row, then those of each group
            order = np.argsort(W.row_keys(h, row), kind="stable")
            key = W.row_keys(h, row)[order]
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            n, one = np.diff(np.append(begin, len(key))), order[begin]
            key = W.row_keys(h[one], of[row[one]])
            order = np.argsort(key, kind="stable")
            key = key[order]
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else begin
            total = np.add.reduceat(n[order], begin) if len(begin) else begin
            among = np.diff(np.append(begin, len(key)))
            one = one[order[begin]]
            size = e[one] - s[one]
            at = np.concatenate([[0], np.cumsum(size)])
            flat = low[np.repeat(s[one] - at[:-1], size) + np.arange(at[-1])]
            terms = pa.StringArray.from_buffers(len(one), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(flat.tobytes()))
            keys = list(names)
            group = of[row[one]]
            pick = lambda i: pa.array([k[i] for k in keys], pa.string())
            columns = ["lang", "source", "term", "n", "docs"]
            yield pa.RecordBatch.from_arrays([pick(0).take(pa.array(group)), pick(1).take(pa.array(group)), terms, pa.array(total.astype(np.int64)), pa.array(among.astype(np.int64))], columns)
            none = np.zeros(len(keys), np.int64)
            yield pa.RecordBatch.from_arrays([pick(0), pick(1), pa.nulls(len(keys), pa.string()), pa.array(none), pa.array(none)], columns)

    plain = lambda c: F.coalesce(F.col(c), F.lit(""))
    slim = docs.select(plain(lang).alias("lang"), plain(source).alias("source"), plain(text).alias("text"))
    rows = slim.mapInArrow(each, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / (n + v)), in decimals of no fraction."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * wide(count + 1), wide(n + v)) + 1


def shares(count: np.ndarray, total: int) -> np.ndarray:
    """The same in 64-bit integers, three digits at a time; ``total`` (n + v) may have up to 15 digits."""
    done, left = np.divmod(count + 1, total)
    for _ in range(3):
        digit, left = np.divmod(left * 1000, total)
        done = done * 1000 + digit
    return done + 1


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def skyband(high: np.ndarray, low: np.ndarray, place: np.ndarray, k: int, block: int = 512) -> np.ndarray:
    """Which rows fewer than k others dominate: others with ``high`` not less, ``low`` not more, and an earlier ``place`` (all differ).

    In the order (high down, low up, place up) a row comes after all that
    dominate it. Those are counted among the rows kept so far and the block; of k
    dominators or more, the first k in that order are kept ones, so no row
    is judged wrongly.
    """
    order = np.lexsort((place, low, -high))
    a, b = low[order], place[order]
    keep = np.zeros(len(order), bool)
    held_a, held_b = a[:0], b[:0]
    for i in range(0, len(order), block):
        x, y = a[i : i + block], b[i : i + block]
        n = np.zeros(len(x), np.int64)
        for j in range(0, len(held_a), 4096):
            open_ = np.flatnonzero(n < k)
            if not len(open_):
                break
            n[open_] += ((held_a[None, j : j + 4096] <= x[open_, None]) & (held_b[None, j : j + 4096] < y[open_, None])).sum(1)
        open_ = np.flatnonzero(n < k)
        before = np.tri(len(x), len(x), -1, dtype=bool)[open_]
        n[open_] += (before & (x[None, :] <= x[open_, None]) & (y[None, :] < y[open_, None])).sum(1)
        good = n < k
        keep[order[i : i + len(x)][good]] = True
        held_a, held_b = np.append(held_a, x[good]), np.append(held_b, y[good])
        # those that dominate most come first
        by = np.argsort(held_b, kind="stable")
        held_a, held_b = held_a[by], held_b[by]
    return keep


def _best(term: pa.Array, n: np.ndarray, total: np.ndarray, k: int) -> np.ndarray:
    """The rows of a group's skyband."""
    names = np.array([t.encode() for t in term.to_pylist()], object)
    place = np.empty(len(names), np.int64)
    place[np.argsort(names, kind="stable")] = np.arange(len(names))
    return np.flatnonzero(skyband(n, total, place, k))


def skybands(kept: DataFrame, k: int) -> DataFrame:
    """(part, lang, source, term, n, total): of each part of each task (about CELLS counts), the skyband of every group in it. ``kept``: see ``vocabulary``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()

        def part(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            lists = table.column("sources").chunk(0)
            of = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            source, n = lists.flatten().field("source"), lists.flatten().field("n").to_numpy()
            total, lang = table.column("total").to_numpy()[of], table.column("lang").chunk(0).take(pa.array(of))
            code = lambda c: c.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            group = code(lang) * (len(n) + 1) + code(source)
            order = np.argsort(group, kind="stable")
            edges = np.flatnonzero(np.concatenate([[True], np.diff(group[order]) > 0, [True]])) if len(n) else [0]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                rows = order[i:j]
                rows = rows[_best(table.column("term").chunk(0).take(pa.array(of[rows])), n[rows], total[rows], k)]
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(task, pa.int32()), len(rows)), lang.take(at), source.take(at), table.column("term").chunk(0).take(pa.array(of[rows])), pa.array(n[rows]), pa.array(total[rows])], NAMES)

        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += len(batch.column(2).flatten())
                if size >= CELLS:
                    yield from part(held)
                    held, size = [], 0
        if held:
            yield from part(held)

    return kept.select("lang", "term", "sources", "total").mapInArrow(each, BAND)


NAMES = ["part", "lang", "source", "term", "n", "total"]
BAND = "part int, lang string, source string, term string, n long, total long"


def merged(bands: DataFrame, k: int, parts: int) -> DataFrame:
    """One skyband of each group from those of parts 0 to ``parts`` - 1: FAN parts at a time, until one is left."""

    def one(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        return table.take(pa.array(_best(table.column("term").combine_chunks(), table.column("n").to_numpy(), table.column("total").to_numpy(), k)))

    while True:
        parts = -(-parts // FAN)
        bands = bands.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("part", "lang", "source").applyInArrow(one, BAND)
        if parts <= 1:
            return bands.drop("part")


def vocabulary(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, term, sources, total): kept terms with their count in each source that has them; the row of the null term has all sources of the language."""
    counts = term_counts(docs, lang, source, text)
    held = counts.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("sources"), F.sum("n").alias("total"), F.sum("docs").alias("docs"))
    return held.filter(F.col("term").isNull() | (F.col("docs") >= LEAST)).drop("docs")


def pair_sums(kept: DataFrame, groups: DataFrame, langs: DataFrame) -> DataFrame:
    """(lang, source, item, value): distances of each source from each other one of its language, over all kept terms.

    ``groups``: (lang, source, n); ``langs``: (lang, v, sources). A language is cut into blocks of about BLOCK cells.
    """
    blocks = F.greatest(F.ceil(F.col("v") * F.col("n_sources") / BLOCK), F.lit(1)).cast("int")
    langs = langs.select("lang", "v", blocks.alias("blocks"))
    left = kept.join(small(langs.select("lang", "blocks")), "lang").select("lang", "sources", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"))
    right = groups.join(small(langs), "lang").select("lang", "source", "n", "v", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def block(terms: pa.Table, sources: pa.Table) -> pa.Table:
        names, v = sources.column("source").combine_chunks(), sources.column("v")[0].as_py()
        total, many = sources.column("n").to_numpy() + v, sources.num_rows
        sums = np.zeros((many, many), np.int64)
        if terms.num_rows:
            lists = terms.column("sources").combine_chunks()
            p = np.repeat(shares(np.zeros(many, np.int64), total)[None], len(lists), axis=0)
            of, who = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), pc.index_in(lists.flatten().field("source"), names).to_numpy()
            p[of, who] = shares(lists.flatten().field("n").to_numpy(), total[who])
            for g in range(many):
                sums[g] = distances(p[:, g : g + 1], p).sum(0)
        one, other = np.nonzero(~np.eye(many, dtype=bool))
        first = pa.repeat(sources.column("lang")[0], len(one))
        return pa.Table.from_arrays([first, names.take(pa.array(one)), names.take(pa.array(other)), pa.array(sums[one, other])], ["lang", "source", "item", "value"])

    both = left.groupBy("lang", "block").cogroup(right.groupBy("lang", "block")).applyInArrow(block, "lang string, source string, item string, value long")
    return both.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank)."""
    held = stored(vocabulary(docs, lang, source, text), "terms")
    kept = held.filter("term is not null")
    counts = kept.select("lang", F.explode("sources").alias("x")).groupBy("lang", "x.source").agg(F.sum("x.n").alias("n"))
    every = held.filter("term is null").select("lang", F.explode("sources.source").alias("source"))
    groups = stored(every.join(counts.hint("merge"), ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n")), "groups")
    size = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    langs = groups.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count(F.lit(1)).alias("n_sources")).join(size.hint("merge"), "lang", "left")
    langs = stored(langs.select("lang", "lang_n", "n_sources", F.coalesce("v", F.lit(0)).alias("v")), "langs")
    pairs = pair_sums(kept, groups, langs)
    bands = stored(skybands(kept, ranks), "bands")
    parts = (bands.agg(F.max("part")).first()[0] or 0) + 1
    band = merged(bands, ranks, parts).join(groups.withColumnRenamed("n", "group_n").hint("merge"), ["lang", "source"]).join(small(langs), "lang")
    p, q = share(F.col("n"), F.col("group_n"), F.col("v")), share(F.col("total"), F.col("lang_n"), F.col("v"))
    over = band.withColumns({"p": p, "q": q}).filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order).cast("int"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return ranked(pairs.withColumn("part", F.lit("pair"))).select(columns).unionByName(ranked(over).filter(F.col("rank") <= ranks).select(columns))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
w AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS total FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST}),
groups AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT g.lang, count(k.term)::HUGEINT AS v, coalesce(sum(k.total), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang FROM groups) g LEFT JOIN kept k USING (lang) GROUP BY g.lang),
gn AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS n FROM groups g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
p AS (SELECT g.lang, g.source, k.term, 1 + ({UNIT}::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.n + v.v) AS p
      FROM gn g JOIN v USING (lang) JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
allpairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
      FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
q AS (SELECT k.lang, k.term, 1 + ({UNIT}::HUGEINT * (k.total + 1)) // (v.n + v.v) AS q FROM kept k JOIN v USING (lang)),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, ((p.p - q.q) * (p.p - q.q)) // q.q AS value
      FROM p JOIN q USING (lang, term) JOIN c ON c.lang = p.lang AND c.source = p.source AND c.term = p.term WHERE p.p > q.q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (SELECT * FROM allpairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {RANKS}
"""
