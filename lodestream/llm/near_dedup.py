"""MinHash near-dedup over bottom-k sketches from one hash function.

A document's set is that of its distinct shingles of five words, in lower case
(A-Z). Its sketch holds the SKETCH smallest of their hashes.

1. Documents with the same set are joined first, by a digest of the set.
2. Inverted lists of the retained values give the pairs that overlap. A value
   that more than COMMON sets retain (a passage that many share, or a large
   group of near copies) is common. Each set is listed under its PREFIX smallest
   values that are not common, so lists are bounded.
3. The union sketch of a pair, the smallest values of both, estimates their
   similarity; pairs under FLOOR, some five deviations below the threshold, go
   (1.4 in a million of those at the threshold, by the binomial of the sketch).
4. A set with common values is also listed under its PREFIX smallest of them,
   unless more than OWN of its values are uncommon. At the threshold a quarter of
   the values is unshared, so two sets share no list of either kind with a chance
   of under one in a hundred million. These lists aren't paired. The smallest set
   of a list, what its members have in common and little else, leads it; each
   member is compared, on full sets, with the leader that its sketch is closest
   to. A large group of near copies is joined by that, one comparison each.
5. What can still join classes is left: pairs and lists whose sets are of several
   classes. The lists are fewer here: sets at the threshold that share no listed
   uncommon value share MET common ones at least (all but some eight in a billion), so
   of its common values a set is listed under the largest alone, all but MET - 1 of
   them. A set that mostly holds other things than what many share is under few
   lists or none. The sets are dealt to blocks, in order of the classes and then
   of the smallest value that many share, so that most blocks hold one class or one
   passage. Blocks that share a pair or a list are compared by exact counts,
   unless both hold the same one class, and a spanning forest of the links leaves
   each comparison. Copies of blocks that meet are made in rounds, each of about
   as many bytes as two copies of all blocks, so disk doesn't grow with the number of comparisons.
6. Connected components of all links give each document its class.

Sets hold 64-bit hashes of the shingles (of 64-bit hashes of the words), and a
set is named by 128 bits, so equal names mean equal texts but for collisions of
such hashes. Texts with fewer than five words are one shingle; texts without
words and nulls have the empty set and link with nothing. Rows with the same
doc_id are judged by their own texts; further columns are ignored, and kept by ``deduplicated``, whatever their names. A set without any doc_id links with
nothing; a row without one belongs to the class of its set. An empty table gives
no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.llm import words as W
from lodestream.llm.store import discard, fresh, stored
from lodestream.operators.components import components

SHINGLE = 5
THRESHOLD = 75  # per hundred
SKETCH = 64
PREFIX = 24
OWN = 40
COMMON = 32
MET = 26
FLOOR = 0.48
#: Sets, and bytes of sets, in a block.
BLOCK, BLOCK_BYTES = 256, 2 << 20
#: Columns of a comparison at once.
COLUMNS = 4096
#: Bytes of blocks that a round copies at least.
ROUND_BYTES = 256 << 20


def shingle_sets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending, and offsets."""
    rows = len(off) - 1
    data = W.LOWER[data]
    starts, ends, row = W.words(data, off)
    hashes = W.span_hashes(data, starts, ends)
    grams, first = W.gram_hashes(hashes, row, SHINGLE)
    owner = row[first]
    n = np.bincount(row, minlength=rows)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        at = np.concatenate([[0], np.cumsum(n)])
        more = np.array([W.gram_hashes(hashes[at[r] : at[r + 1]], row[at[r] : at[r + 1]], int(n[r]))[0][0] for r in short], W.U64)
        grams, owner = np.concatenate([grams, W.mix(more + n[short].astype(W.U64))]), np.concatenate([owner, short])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[new], owner[new]
    return grams, np.searchsorted(owner, np.arange(rows + 1))


def _names(sets: np.ndarray, at: np.ndarray) -> list[bytes]:
    """128 bits for each set."""
    halves = []
    for k in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
        total = np.zeros(len(sets) + 1, W.U64)
        np.cumsum(W.mix(sets + W.U64(k)), out=total[1:])
        halves.append(W.mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(W.U64)))
    return [x.tobytes() for x in np.stack(halves, 1)]


def sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, name, n_shingles, sketch (ascending as unsigned, stored as long)."""
    kind = docs.schema[key].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in W.runs(batch, text):
                sets, at = shingle_sets(data, off)
                take = np.minimum(np.diff(at), SKETCH)
                bounds = np.concatenate([[0], np.cumsum(take)])
                pick = np.repeat(at[:-1] - bounds[:-1], take) + np.arange(bounds[-1])
                out = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(sets[pick].view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(_names(sets, at), pa.binary()), pa.array(np.diff(at), pa.int64()), out], [key, "name", "n_shingles", "sketch"])

    return docs.select(key, text).mapInArrow(each, f"`{key}` {kind}, name binary, n_shingles long, sketch array<bigint>")


def _estimated(pairs: DataFrame, listed: DataFrame) -> DataFrame:
    """``pairs`` (name, other) with the sizes of the shared sketch and of the union sketch."""
    own = listed.select("name", "sketch")
    pairs = pairs.join(own.hint("merge"), "name").join(own.select(F.col("name").alias("other"), F.col("sketch").alias("sketch2")).hint("merge"), "other")
    # hashes in the order of unsigned numbers: the sign bit is turned
    turn = lambda a: F.transform(a, lambda x: x.bitwiseXOR(F.lit(-(2**63)).cast("long")))
    union = F.slice(F.array_sort(turn(F.array_union("sketch", "sketch2"))), 1, SKETCH)
    shared = F.size(F.array_intersect(turn(F.array_intersect("sketch", "sketch2")), union))
    return pairs.select("name", "other", shared.alias("shared"), F.size(union).alias("union")).filter(F.col("shared") >= FLOOR * F.col("union"))


def _alike(n: str, m: str) -> F.Column:
    return 100 * F.least(n, m) >= THRESHOLD * F.greatest(n, m)


def _pairs(listed: DataFrame) -> DataFrame:
    """(name, other) of sets that share a listed value and may be similar by size and union sketch."""
    left = listed.select("name", "n", F.explode("prefix").alias("value"))
    right = left.select(F.col("name").alias("other"), F.col("n").alias("m"), "value")
    pairs = left.join(right.hint("merge"), "value").filter((F.col("name") < F.col("other")) & _alike("n", "m")).select("name", "other").distinct()
    return _estimated(pairs, listed).select("name", "other")


def _stars(listed: DataFrame, lists: DataFrame) -> DataFrame:
    """(name, other): for each set under common values, of the leaders of its lists the one that its sketch is closest to."""
    leaders = stored(lists.groupBy("value").agg(F.min(F.struct("n", "name")).alias("l")).select("value", F.col("l.n").alias("m"), F.col("l.name").alias("other")), "leaders")
    stars = lists.join(leaders.hint("merge"), "value").filter((F.col("name") != F.col("other")) & _alike("n", "m")).select("name", "other").distinct()
    best = F.max(F.struct((F.col("shared") / F.col("union")).alias("near"), "other")).alias("b")
    return _estimated(stars, listed).groupBy("name").agg(best).select("name", F.col("b.other").alias("other"))


def _compare(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """Linked rows (i, j) of the sets of one block, or of two."""
    values, at = a if b is None else (np.concatenate([a[0], b[0]]), np.concatenate([a[1], a[1][-1] + b[1][1:]]))
    size = np.diff(at)
    n, cut = len(size), len(a[1]) - 1
    row = np.repeat(np.arange(n), size)
    order = np.argsort(values, kind="stable")
    values, row = values[order], row[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    column = np.cumsum(new) - 1
    common = np.bincount(column) > 1 if len(column) else np.zeros(0, bool)
    held = common[column] if len(column) else common
    row, column = row[held], (np.cumsum(common) - 1)[column[held]]
    if b is None:
        both = np.zeros((n, n), np.float32)
    else:
        both = np.zeros((cut, n - cut), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        s, e = np.searchsorted(column, (lo, lo + COLUMNS))
        part = np.zeros((n, COLUMNS), np.float32)
        part[row[s:e], column[s:e] - lo] = 1
        both += part @ part.T if b is None else part[:cut] @ part[cut:].T
    count = both.astype(np.int64)
    x, y = (size, size) if b is None else (size[:cut], size[cut:])
    linked = 100 * count >= THRESHOLD * (x[:, None] + y[None, :] - count)
    if b is None:
        return np.argwhere(np.triu(linked, 1))
    found = np.argwhere(linked)
    found[:, 1] += cut
    return found


def _forest(pairs: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Links that join the same nodes, one for each node but one."""
    top = list(range(n))

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    out = []
    for i, j in pairs.tolist():
        a, b = find(i), find(j)
        if a != b:
            top[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def _placed(slim: DataFrame) -> DataFrame:
    """(name, block) from (name, n, near, root, first): sets in order of neighbourhood, class and smallest hash, cut by number and size.

    Each partition adds up the weights of its sets, then the partitions' totals; a block is a whole number of that sum.
    """
    parts = int(slim.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["near", "root", "first", "name"]
    ranged = slim.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("name", "n")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0.0
        for batch in batches:
            weight = np.maximum(1 / BLOCK, batch.column(1).to_numpy() * 8 / BLOCK_BYTES)
            upto = total + np.cumsum(weight)
            total = float(upto[-1]) if len(upto) else total
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.repeat(pa.scalar(part, pa.int32()), len(upto)), pa.array(upto)], ["name", "part", "upto"])

    placed = stored(ranged.mapInArrow(each, "name binary, part int, upto double"), "placed")
    # one row for each partition
    before = placed.groupBy("part").agg(F.max("upto").alias("sum")).select("part", F.coalesce(F.sum("sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"))
    return placed.join(before.hint("merge"), "part").select("name", F.floor(F.col("before") + F.col("upto")).alias("block"))


def _wanted_sets(texts: DataFrame) -> DataFrame:
    """(name, set) from (wanted, text), of those texts that have the wanted set."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in W.runs(batch, "text"):
                sets, at = shingle_sets(data, off)
                names = _names(sets, at)
                hit = [k for k in range(j - i) if names[k] == batch.column(0)[i + k].as_py()]
                yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in hit], pa.binary()), pa.array([sets[at[k] : at[k + 1]].tobytes() for k in hit], pa.binary())], ["name", "set"])

    return texts.select("wanted", "text").mapInArrow(each, "name binary, set binary")


def _similar(rows: DataFrame) -> DataFrame:
    """(a, b) of the rows (a, b, set, set2) whose full sets are at the threshold."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for one, two in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), W.U64) for v in (one, two))
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                near.append(100 * shared >= THRESHOLD * (len(x) + len(y) - shared))
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))

    return rows.select("a", "b", "set", "set2").mapInArrow(each, "a binary, b binary")


def _links(tasks: DataFrame) -> DataFrame:
    """Spanning links of each pair of blocks (items, items2), or within one where items2 is null."""

    def block(items: pa.Scalar) -> tuple[list[bytes], tuple[np.ndarray, np.ndarray]]:
        held = {x["name"]: x["set"] for x in items.as_py()}  # rows alike came more than once
        return list(held), (np.frombuffer(b"".join(held.values()), W.U64), np.concatenate([[0], np.cumsum([len(v) // 8 for v in held.values()])]).astype(np.int64))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                names, a = block(batch.column(0)[i])
                b = None
                if batch.column(1)[i].is_valid:
                    more, b = block(batch.column(1)[i])
                    names = names + more
                links = _forest(_compare(a, b), len(names))
                yield pa.RecordBatch.from_arrays([pa.array([names[x] for x, _ in links], pa.binary()), pa.array([names[y] for _, y in links], pa.binary())], ["a", "b"])

    return tasks.select("items", "items2").mapInArrow(each, "a binary, b binary")


def similar_links(docs: DataFrame, found: DataFrame, text: str) -> DataFrame:
    """Links (a, b) between sets, enough to join every class. ``found``: the stored sketches of ``docs``."""
    one = found.filter("n_shingles > 0").groupBy("name").agg(F.min(F.struct(F.col("n_shingles").alias("n"), "sketch")).alias("s")).select("name", "s.n", "s.sketch")
    one = stored(one, "sets")
    entries = one.select("name", F.explode("sketch").alias("value"))
    common = stored(entries.groupBy("value").count().filter(F.col("count") > COMMON).select("value"), "common")
    # each value is common once, so a set keeps each of its entries at most once; the table is read back, so where it is small the entries aren't shuffled again
    held = entries.join(common, "value", "left_semi").groupBy("name").agg(F.collect_set("value").alias("common"))
    listed = one.join(held.hint("merge"), "name", "left").withColumn("common", F.coalesce("common", F.array().cast("array<bigint>")))
    own = F.array_except("sketch", "common")
    most, none = F.array_intersect("sketch", "common"), F.array().cast("array<bigint>")
    met = F.least(F.lit(MET), F.ceil(F.size("sketch") * THRESHOLD / 100).cast("int"))
    listed = listed.select("name", "n", "sketch", F.slice(own, 1, PREFIX).alias("prefix"), F.when(F.size(own) <= OWN, F.slice(most, 1, PREFIX)).otherwise(none).alias("shared"), F.when(F.size(most) >= met, F.slice(most, met, F.size(most) - met + 1)).otherwise(none).alias("rest"))
    listed = stored(listed, "listed")
    for table in (one, common):
        discard(table)
    lists = listed.select("name", "n", F.explode("shared").alias("value"))
    pairs, stars = stored(_pairs(listed), "pairs"), stored(_stars(listed, lists), "stars")
    # full sets of all that has a partner or stands under a common value
    some = pairs.select("name").unionByName(pairs.select(F.col("other").alias("name"))).unionByName(listed.filter(F.size("shared") > 0).select("name")).distinct()
    least = found.filter("n_shingles > 0 and doc_id is not null").groupBy("name").agg(F.min("doc_id").alias("doc_id"))
    wanted = least.join(some.hint("merge"), "name").select("doc_id", F.col("name").alias("wanted"))
    sets = stored(_wanted_sets(docs.select("doc_id", "text").join(wanted.hint("merge"), "doc_id")), "full")  # rows alike come more than once
    other = sets.select(F.col("name").alias("other"), F.col("set").alias("set2"))
    near = stars.join(sets.hint("merge"), "name").join(other.hint("merge"), "other").select(F.col("name").alias("a"), F.col("other").alias("b"), "set", "set2")
    first = stored(_similar(near), "links")
    more = _rest(listed.join(sets.select("name").hint("merge"), "name", "left_semi"), pairs, components(first), sets)
    for table in (listed, pairs, stars, sets):
        discard(table)
    return first.unionByName(more)


def _rounds(cross: DataFrame, blocks: DataFrame) -> int:
    """So many that a round copies no more than about twice all blocks, or ROUND_BYTES."""
    size = blocks.select("block", "bytes")
    held = size.agg(F.sum("bytes")).first()[0] or 0
    copied = cross.join(size.hint("merge"), "block").join(size.select(F.col("block").alias("block2"), F.col("bytes").alias("bytes2")).hint("merge"), "block2").agg(F.sum(F.col("bytes") + F.col("bytes2"))).first()[0] or 0
    return math.ceil(copied / max(2 * held, ROUND_BYTES))


def _copies(cross: DataFrame, blocks: DataFrame) -> DataFrame:
    """(items, items2) of each pair of blocks."""
    items = blocks.select("block", "items")
    return cross.join(items.hint("merge"), "block").join(items.select(F.col("block").alias("block2"), F.col("items").alias("items2")).hint("merge"), "block2")


def _rest(listed: DataFrame, pairs: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between sets that ``roots`` don't join yet: what their pairs and the lists of ``rest`` can still add."""
    classes = listed.join(roots.withColumnRenamed("node", "name").hint("merge"), "name", "left").select("name", "n", F.coalesce("root", "name").alias("root"), F.coalesce(F.get("shared", F.lit(0)), F.get("sketch", F.lit(0))).alias("first"), "rest")
    classes = stored(classes, "classes")
    root = classes.select("name", "root")
    apart = pairs.join(root.hint("merge"), "name").join(root.select(F.col("name").alias("other"), F.col("root").alias("root2")).hint("merge"), "other")
    pairs = stored(apart.filter("root <> root2").select("name", "other"), "pairs")
    lists = classes.select("name", "root", F.explode("rest").alias("value"))
    ends = lists.groupBy("value").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("name").alias("leader"))
    open_ = stored(ends.filter("lo <> hi").select("value", "leader"), "open")
    if not pairs.take(1) and not open_.take(1):
        return pairs.select(F.col("name").alias("a"), F.col("other").alias("b"))
    lists = stored(lists.join(open_.hint("merge"), "value"), "lists")
    # sets that a pair or a list joins follow each other
    near = pairs.select(F.col("name").alias("a"), F.col("other").alias("b")).unionByName(lists.filter("name <> leader").select(F.col("name").alias("a"), F.col("leader").alias("b")).distinct())
    slim = classes.join(components(near).select(F.col("node").alias("name"), F.col("root").alias("near")).hint("merge"), "name").select("name", "n", "near", "root", "first")
    member = stored(_placed(slim), "members")
    blocks = stored(member.join(sets.hint("merge"), "name").groupBy("block").agg(F.sum(F.length("set")).alias("bytes"), F.collect_list(F.struct("name", "set")).alias("items")), "blocks")
    one, two = member.select("name", "block"), member.select(F.col("name").alias("other"), F.col("block").alias("block2"))
    cross = pairs.join(one.hint("merge"), "name").join(two.hint("merge"), "other").select("block", "block2")
    # blocks of one class stand together under a list: only different classes, or blocks of several, meet
    held = lists.join(one.hint("merge"), "name").groupBy("value", "block").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    held = stored(held.select("value", "block", F.when(F.col("lo") == F.col("hi"), F.hex("lo")).otherwise(F.col("block").cast("string")).alias("kind")), "held")
    kinds = stored(held.select("value", "kind").distinct(), "kinds")
    meet = kinds.join(kinds.select("value", F.col("kind").alias("kind2")).hint("merge"), "value").filter("kind < kind2")
    meet = meet.join(held.hint("merge"), ["value", "kind"]).join(held.select("value", F.col("kind").alias("kind2"), F.col("block").alias("block2")).hint("merge"), ["value", "kind2"])
    cross = cross.unionByName(meet.select("block", "block2"))
    cross = cross.filter("block <> block2").select(F.least("block", "block2").alias("block"), F.greatest("block", "block2").alias("block2")).distinct()
    cross = stored(cross, "cross")
    links = stored(_links(blocks.withColumn("items2", F.lit(None).cast(blocks.schema["items"].dataType))), "links")
    rounds = _rounds(cross, blocks)
    for i in range(rounds):
        links = links.unionByName(stored(_links(_copies(cross.filter(F.pmod(F.xxhash64("block", "block2"), F.lit(rounds)) == i), blocks)), "links"))
    for table in (classes, pairs, open_, lists, member, blocks, held, kinds, cross):
        discard(table)
    return links


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) for each row of ``docs``."""
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = stored(sketches(docs, "doc_id", "text"), "sketches")
    roots = components(similar_links(docs, found, "text"))
    smallest = found.filter("n_shingles > 0").groupBy("name").agg(F.min("doc_id").alias("least"))
    named = smallest.join(roots.withColumnRenamed("node", "name").hint("merge"), "name", "left").select("name", F.coalesce("root", "name").alias("root"), "least")
    named = stored(named, "classes")
    heads = stored(named.groupBy("root").agg(F.min("least").alias("component")), "heads")
    classes = stored(named.join(heads.hint("merge"), "root").select("name", "component"), "components")
    out = found.select("doc_id", "n_shingles", "name").join(classes.hint("merge"), "name", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select(F.col("doc_id").alias(key), "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, rows alike in key and text once; rows that share a key with a kept one stay if their text differs."""
    head, copy = fresh(docs, "head", "copy")
    heads = stored(near_dedup(docs, key, text).filter("kept").select(F.col(key).alias(head)).distinct(), "kept")
    rows = docs.join(heads.hint("merge"), F.col(key).eqNullSafe(F.col(head)), "left_semi")
    first = Window.partitionBy(key, F.xxhash64(text)).orderBy(F.lit(0))
    return rows.withColumn(copy, F.row_number().over(first)).filter(F.col(copy) == 1).drop(copy)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
