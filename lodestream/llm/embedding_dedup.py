"""Embedding near-dedup by an epsilon grid order join.

Vectors with the same label link when their cosine, in double precision, is at
least the threshold. On unit vectors that is a distance of at most EPS =
sqrt(2 - 2 threshold). Vectors are sorted by their grid cells (side EPS) on the
leading principal dimensions and cut into blocks. Neighbours in that sequence
make a tree of intervals, FAN to a node, each with its box. From each label's
root down, two intervals whose boxes are farther apart than EPS are provably
distant and skipped; the others are joined with their parts, down to blocks,
within them down to short intervals, which are compared. So pairs of distant
blocks never exist. A task reports how many links each vector has and a spanning
forest of them, never all pairs; components join the forests.

Vectors alike in label and all components are compared once and counted as often as they
occur. Vectors that are null, empty, zero, or hold null or non-finite
components, and those with a null label, link with nothing; so do vectors of
different lengths. Rows that share a vec_id are vectors of their own. An empty
table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.near_dedup import _forest
from lodestream.llm.store import discard, stored
from lodestream.operators.components import components

THRESHOLD = 0.93
#: Principal dimensions of the grid, vectors in a block, and in an interval that isn't halved again.
AXES, BLOCK, LEAF = 6, 512, 64
#: Intervals that make one of the next level: 2 to this power.
FAN_BITS = 4
#: Longer vectors get their axes from their first so many components.
AXES_FROM = 128


def _units(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) of those that can link, by length of the vectors."""
    labels, vectors = batch.column(1), batch.column(2)
    values = vectors.values.to_numpy(zero_copy_only=False)  # null components as nan
    at = vectors.offsets.to_numpy()
    size = np.where(np.asarray(vectors.is_valid()) & np.asarray(labels.is_valid()), np.diff(at), 0)
    for d in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == d)
        x = values[at[rows][:, None] + np.arange(d)].astype(np.float64)
        top = np.abs(x).max(1)
        good = np.isfinite(top) & (top > 0)
        x = x[good] / top[good][:, None]
        yield rows[good], x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _named(vectors: DataFrame) -> DataFrame:
    """vec_id, name (null: links with nothing), label, dim, unit."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            name, dim, unit = [None] * n, [None] * n, [None] * n
            labels = batch.column(1).to_pylist()
            for rows, x in _units(batch):
                for i, v in zip(rows.tolist(), x, strict=True):
                    unit[i], dim[i] = v.tobytes(), len(v)
                    name[i] = hashlib.blake2b(repr((labels[i], len(v))).encode() + unit[i], digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(name, pa.binary()), pa.array(labels, pa.int64()), pa.array(dim, pa.int32()), pa.array(unit, pa.binary())], ["vec_id", "name", "label", "dim", "unit"])

    return vectors.mapInArrow(each, "vec_id long, name binary, label long, dim int, unit binary")


def _vectors(units: pa.Array, rows: np.ndarray, dim: int) -> np.ndarray:
    """The rows of a binary column as a matrix."""
    _, offsets, data = units.buffers()
    at = np.frombuffer(offsets, np.int32)[units.offset : units.offset + len(units) + 1][rows]
    return np.frombuffer(data, np.uint8)[at[:, None] + np.arange(8 * dim)].view(np.float64)


def _axes(reps: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each dimension: the mean and the leading principal axes, from sums over all vectors."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            dims, units = np.asarray(batch.column(0)), batch.column(1)
            for d in np.unique(dims):
                k = min(int(d), AXES_FROM)
                x = _vectors(units, np.flatnonzero(dims == d), int(d))[:, :k]
                x = np.hstack([np.ones((len(x), 1)), x])
                sums[int(d)] = sums.get(int(d), 0) + x.T @ x
        for d, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(d, pa.int32()), s.size), pa.array(np.arange(s.size)), pa.array(s.ravel())], ["dim", "at", "value"])

    found: dict[int, dict[int, float]] = {}
    for r in reps.select("dim", "unit").mapInArrow(each, "dim int, at long, value double").groupBy("dim", "at").agg(F.sum("value").alias("value")).collect():
        found.setdefault(r["dim"], {})[r["at"]] = r["value"]
    out = {}
    for d, cells in found.items():
        k = min(d, AXES_FROM) + 1
        s = np.array([cells[i] for i in range(k * k)]).reshape(k, k)
        mean = s[0, 1:] / s[0, 0]
        _, axes = np.linalg.eigh(s[1:, 1:] / s[0, 0] - np.outer(mean, mean))
        out[d] = mean, axes[:, ::-1][:, :AXES]
    return out


def _placed(x: np.ndarray, axes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Coordinates on the grid's axes; distances there are no longer than between the vectors."""
    mean, a = axes
    p = (x[:, : len(mean)] - mean) @ a
    return np.hstack([p, np.zeros((len(x), AXES - p.shape[1]))]) if p.shape[1] < AXES else p


def _gap(lo: np.ndarray, hi: np.ndarray, lo2: np.ndarray, hi2: np.ndarray) -> float:
    d = np.maximum(0, np.maximum(lo2 - hi, lo - hi2))
    return float(d @ d)


def _join(x: np.ndarray, p: np.ndarray, y: np.ndarray, q: np.ndarray, same: bool, threshold: float) -> np.ndarray:
    """Pairs (row of x, row of y) that link; each once where both are the same block."""
    reach = 2 - 2 * threshold + 1e-9
    out, todo = [], [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if same and d <= a:
            continue
        if _gap(p[a:b].min(0), p[a:b].max(0), q[c:d].min(0), q[c:d].max(0)) > reach:
            continue
        if max(b - a, d - c) <= LEAF:
            found = np.argwhere(x[a:b] @ y[c:d].T >= threshold) + (a, c)
            out.append(found[found[:, 0] < found[:, 1]] if same else found)
        elif b - a >= d - c:
            m = (a + b) // 2
            todo += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            todo += [(a, b, c, m), (a, b, m, d)]
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def _near_blocks(made: DataFrame, reach: float) -> DataFrame:
    """(block, block2) with block <= block2, of a label and length, whose boxes are within reach, by descent from the roots of the trees.

    ``made``: block (its task in the upper 32 bits, its number there in the lower), label, dim, lo, hi.
    """
    most = made.agg(F.max(F.shiftright("block", 32)).alias("part"), F.max(F.col("block").bitwiseAND(2**32 - 1)).alias("number")).first()
    levels = lambda n: -(-int(n or 0).bit_length() // FAN_BITS)
    inner, outer = levels(most["number"]), levels(most["part"])

    def node(level: int) -> F.Column:
        """The interval of that level that a block is in: first the numbers of a task are gathered, then tasks."""
        if level <= inner:
            low = F.shiftright(F.col("block").bitwiseAND(2**32 - 1), FAN_BITS * level)
            return F.shiftleft(F.shiftright("block", 32), 32).bitwiseOR(low)
        return F.shiftleft(F.shiftright("block", 32 + FAN_BITS * (level - inner)), 32)

    keys = ["label", "dim"]
    boxes = made.select(*keys, "block", *(F.col(side)[k].alias(f"{side}{k}") for side in ("lo", "hi") for k in range(AXES)))
    sides = [f"{side}{k}" for side in ("lo", "hi") for k in range(AXES)]
    apart = None
    for k in range(AXES):
        gap = F.greatest(F.col(f"b_lo{k}") - F.col(f"hi{k}"), F.col(f"lo{k}") - F.col(f"b_hi{k}"), F.lit(0.0))
        apart = gap * gap if apart is None else apart + gap * gap
    pairs = made.select(*keys, node(inner + outer).alias("a")).distinct().withColumn("b", F.col("a"))
    for level in range(inner + outer - 1, -1, -1):
        kids = boxes.select(*keys, node(level).alias("kid"), node(level + 1).alias("a"), *sides)
        ends = [(F.min if c.startswith("lo") else F.max)(c).alias(c) for c in sides]
        kids = kids.groupBy(*keys, "a", "kid").agg(*ends)
        others = kids.select(*keys, F.col("a").alias("b"), F.col("kid").alias("kid2"), *(F.col(c).alias(f"b_{c}") for c in sides))
        met = pairs.join(kids.hint("merge"), [*keys, "a"]).join(others.hint("merge"), [*keys, "b"])
        pairs = met.filter((F.col("kid") <= F.col("kid2")) & (apart <= reach)).select(*keys, F.col("kid").alias("a"), F.col("kid2").alias("b"))
    return pairs.select(F.col("a").alias("block"), F.col("b").alias("block2"))


def link_vectors(vectors: DataFrame, key: str = "vec_id", label: str = "label", embedding: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    spark = vectors.sparkSession
    eps = math.sqrt(2 - 2 * threshold)
    rows = stored(_named(vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(embedding).cast("array<double>").alias("e"))), "vectors")
    reps = rows.filter("name is not null").groupBy("name").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("times"), F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("unit").alias("unit"))
    reps = stored(reps, "reps")
    axes = spark.sparkContext.broadcast(_axes(reps))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, units = np.asarray(batch.column(3)), batch.column(4)
            cell = np.zeros((batch.num_rows, AXES), np.int32)
            for d in np.unique(dims):
                mine = np.flatnonzero(dims == d)
                x = _vectors(units, mine, int(d))
                cell[mine] = np.floor(_placed(x, axes.value[int(d)]) / eps)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(cell[:, k]) for k in range(AXES))], [*batch.schema.names, *(f"c{k}" for k in range(AXES))])

    order = ["label", "dim", *(f"c{k}" for k in range(AXES)), "name"]
    grid = stored(reps.select("name", "times", "label", "dim", "unit").mapInArrow(cells, "name binary, times long, label long, dim int, unit binary, " + ", ".join(f"c{k} int" for k in range(AXES))), "grid")
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    sorted_ = grid.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held, of = TaskContext.get().partitionId(), 0, [], None

        def row() -> pa.RecordBatch:
            names, times, x = (list(v) for v in zip(*held, strict=True))
            x = np.concatenate(x)
            p = _placed(x, axes.value[of[1]])
            box = lambda v: pa.array([v.tolist()], pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + number], pa.int64()), pa.array([of[0]], pa.int64()), pa.array([of[1]], pa.int32()), box(p.min(0)), box(p.max(0)), pa.array([sum(names, [])], pa.list_(pa.binary())), pa.array([sum(times, [])], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary())], ["block", "label", "dim", "lo", "hi", "names", "times", "units"])

        for batch in batches:
            label, dim = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            begin, n = 0, batch.num_rows
            while begin < n:  # a run of one label and length that the open block has room for
                mine = (int(label[begin]), int(dim[begin]))
                full = sum(len(h[0]) for h in held)
                if held and (full == BLOCK or of != mine):
                    yield row()
                    number, held, full = number + 1, [], 0
                of = mine
                end = min(n, begin + BLOCK - full)
                other = np.flatnonzero((label[begin:end] != mine[0]) | (dim[begin:end] != mine[1]))
                end = begin + int(other[0]) if len(other) else end
                part_of = batch.slice(begin, end - begin)
                held.append((part_of.column(0).to_pylist(), part_of.column(1).to_pylist(), _vectors(part_of.column(4), np.arange(end - begin), mine[1])))
                begin = end
        if held:
            yield row()

    made = stored(sorted_.select("name", "times", "label", "dim", "unit").mapInArrow(blocks, "block long, label long, dim int, lo array<double>, hi array<double>, names array<binary>, times array<long>, units binary"), "blocks")
    near = _near_blocks(made.select("block", "label", "dim", "lo", "hi"), 2 - 2 * threshold + 1e-9)
    payload = ["dim", "names", "times", "units"]
    tasks = near.join(made.select("block", *payload).hint("merge"), "block").join(made.select(F.col("block").alias("block2"), *(F.col(c).alias(f"{c}2") for c in payload[1:])).hint("merge"), "block2")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same, dim, names, times, units, names2, times2, units2 in zip(*(batch.column(i) for i in range(8)), strict=True):
                names, times, dim, same = names.as_py(), np.array(times.as_py()), dim.as_py(), same.as_py()
                x = np.frombuffer(units.as_py(), np.float64).reshape(-1, dim)
                p = _placed(x, axes.value[dim])
                y, q = x, p
                if not same:
                    y = np.frombuffer(units2.as_py(), np.float64).reshape(-1, dim)
                    q = _placed(y, axes.value[dim])
                pairs = _join(x, p, y, q, same, threshold)
                if not same:
                    pairs = pairs + (0, len(names))
                    names, times = names + names2.as_py(), np.concatenate([times, times2.as_py()])
                more = np.zeros(len(names), np.int64)
                np.add.at(more, pairs[:, 0], times[pairs[:, 1]])
                np.add.at(more, pairs[:, 1], times[pairs[:, 0]])
                links = _forest(pairs, len(names))
                hit = np.flatnonzero(more).tolist()
                a = [names[i] for i in hit] + [names[i] for i, _ in links]
                b = [None] * len(hit) + [names[j] for _, j in links]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array([int(more[i]) for i in hit] + [0] * len(links), pa.int64())], ["a", "b", "more"])

    found = stored(tasks.select((F.col("block") == F.col("block2")).alias("same"), *payload, *(f"{c}2" for c in payload[1:])).mapInArrow(link, "a binary, b binary, more long"), "links")
    for table in (grid, made):
        discard(table)
    roots = components(found.filter("b is not null").select("a", "b"))
    counts = found.filter("b is null").groupBy(F.col("a").alias("name")).agg(F.sum("more").alias("more"))
    known = reps.select("name", "vec_id", "times").join(roots.withColumnRenamed("node", "name").hint("merge"), "name", "left").join(counts.hint("merge"), "name", "left")
    known = stored(known.select("name", "vec_id", F.coalesce("root", "name").alias("root"), (F.coalesce("more", F.lit(0)) + F.col("times") - 1).alias("n_links")), "classes")
    heads = stored(known.groupBy("root").agg(F.min("vec_id").alias("head")), "heads")
    classes = stored(known.join(heads.hint("merge"), "root").select("name", "n_links", "head"), "components")
    out = rows.select("vec_id", "name").join(classes.hint("merge"), "name", "left")
    component = F.when(F.col("name").isNull(), F.col("vec_id")).otherwise(F.col("head"))
    return out.select(F.col("vec_id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND list_count(embedding) = len(embedding)),
     p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
     r(vec_id, root) AS (SELECT a, b FROM p UNION SELECT r.vec_id, p.b FROM r JOIN p ON r.root = p.a),
     c AS (SELECT vec_id, min(root) AS root FROM r GROUP BY vec_id),
     n AS (SELECT a AS vec_id, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(root, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(root, vec_id)) AS kept
FROM embeddings LEFT JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
