"""Quality classifier: random Fourier features over document statistics, ridge, isotonic calibration.

Statistics of the whole text are standardised and mapped by random cosines,
which approximate a Gaussian kernel. Partitions sum their normal equations; the
ridge solution scores each document, and an isotonic step function, fitted on
counts by score, turns scores into probabilities. Labels beyond TRAIN_ROWS are
thinned by a hash. Null and empty texts have the statistics of a text without
words and get a score like any other. With no labelled row the score is a half,
with labels of one kind the rate of that kind. Labels without a document and
null labels are ignored; repeated rows count as often as they occur; an empty
table gives no row. ``classify`` ignores columns other than doc_id and text,
``filtered`` keeps them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestream.llm import words as W
from lodestream.llm.store import fresh, stored

TRAIN_ROWS = 1_000_000
FEATURES, WIDTH, RIDGE, SEED = 256, 4.0, 1e-3, 11
#: Sums are made by so many tasks; score counts by so many steps.
SUMS, STEPS = 16, 512
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:?"]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>@^~=+_{}[]\\/"]] = True
STATISTICS = 16


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    rows = len(off) - 1
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
    length = (chars[off[1:]] - chars[off[:-1]]).astype(float)
    owner = np.repeat(np.arange(rows), np.diff(off))
    share = lambda flags: np.bincount(owner[flags[data]], minlength=rows) / np.maximum(1, length)
    starts, ends, row = W.words(data, off)
    size = (chars[ends] - chars[starts]).astype(float)
    n = np.bincount(row, minlength=rows).astype(float)
    some = np.maximum(1, n)
    hashes = W.span_hashes(data, starts, ends)
    keys = W.row_keys(hashes, row)
    _, later = W.repeated(keys)
    grams, first = W.gram_hashes(hashes, row, 3)
    many, _ = W.repeated(W.row_keys(grams, row[first]))
    near = np.flatnonzero((hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])) if len(row) else np.zeros(0, int)
    line_start, line_end, line_row = W.spans(data != 10, off)
    _, again = W.repeated(W.row_keys(W.span_hashes(data, line_start, line_end), line_row))
    lines = np.bincount(line_row, minlength=rows).astype(float)
    mean = np.bincount(row, size, minlength=rows) / some
    spread = np.sqrt(np.maximum(0, np.bincount(row, size * size, minlength=rows) / some - mean * mean))
    letters = np.maximum(1, np.bincount(owner[_ALPHA[data]], minlength=rows))
    exclaim = np.zeros(256, bool)
    exclaim[33] = True
    shorter = np.bincount(row[size <= 3], minlength=rows) / some
    longer = np.bincount(row[size >= 12], minlength=rows) / some
    return np.stack([
        np.log1p(n), mean, spread, np.sqrt(share(_SYMBOL)), np.sqrt(share(exclaim)), np.bincount(owner[_UPPER[data]], minlength=rows) / letters,
        np.sqrt(share(_DIGIT)), np.bincount(row[later], minlength=rows) / some / np.maximum(1, np.log1p(n)), np.bincount(row[first][many], minlength=rows) / some,
        np.bincount(row[near], minlength=rows) / some, np.bincount(line_row[again], minlength=rows) / np.maximum(1, lines), np.log1p(n / np.maximum(1, lines)),
        share(_STOP), shorter, longer, np.log1p(length) - np.log1p(n),
    ], 1)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    turn: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    at: np.ndarray
    rate: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.cos(np.clip((x - self.mean) / self.scale, -6, 6) @ self.turn + self.phase)
        return np.hstack([np.ones((len(z), 1)), z * np.sqrt(2 / FEATURES)])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.at, self.rate)


def _matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, x): statistics of each row."""
    kind = docs.schema[key].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in W.runs(batch, text):
                x = statistics(data, off)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, STATISTICS), pa.int32()), pa.array(x.ravel()))], [key, "x"])

    return docs.select(key, text).mapInArrow(each, f"`{key}` {kind}, x array<double>")


def _sum_rows(train: DataFrame, part) -> np.ndarray:
    """Sum over SUMS tasks of part(x, y), an array of fixed size."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                found = part(_matrix(batch, 0), batch.column(1).to_numpy())
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

    got = [np.frombuffer(r["s"]) for r in train.select("x", "y").mapInArrow(each, "s binary").collect()]
    return sum(got) if got else np.zeros(0)


def pool(counts: list[tuple[float, float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent violators: (score, rows, positives), ascending, to (score, rate)."""
    blocks: list[list[float]] = []
    for s, n, y in counts:
        blocks.append([s * n, n, y])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            b = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], b, strict=True)]
    return np.array([b[0] / b[1] for b in blocks]), np.array([(b[2] + 0.5) / (b[1] + 1) for b in blocks])


def fit(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "label") -> Model:
    """``stats`` of documents, and (key, label 0 or 1) of those to learn from."""
    labels = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key), F.col(label).cast("double").alias("y"))
    n = labels.count()
    if n > TRAIN_ROWS:
        labels = labels.filter(F.pmod(F.xxhash64(key), F.lit(1_000_003)) < 1_000_003 * TRAIN_ROWS / n)
    train = stored(stats.join(labels.hint("merge"), key).select("x", "y").repartition(SUMS), "train")
    rng = np.random.default_rng(SEED)
    turn, phase = rng.normal(0, 1 / WIDTH, (STATISTICS, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
    s = _sum_rows(train, lambda x, y: np.concatenate([[len(x), y.sum()], x.sum(0), (x * x).sum(0)]))
    if not len(s):
        return Model(np.zeros(STATISTICS), np.ones(STATISTICS), turn, phase, np.zeros(FEATURES + 1), np.zeros(1), np.full(1, 0.5))
    mean = s[2 : 2 + STATISTICS] / s[0]
    scale = np.sqrt(np.maximum(1e-6, s[2 + STATISTICS :] / s[0] - mean * mean))
    model = Model(mean, scale, turn, phase, np.zeros(FEATURES + 1), np.zeros(1), np.full(1, s[1] / s[0]))
    if not 0 < s[1] < s[0]:
        return model

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.features(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    sums, d = _sum_rows(train, normal), FEATURES + 1
    model.weights = np.linalg.solve(sums[: d * d].reshape(d, d) + RIDGE * s[0] / FEATURES * np.diag([0.0] + [1.0] * FEATURES), sums[d * d :])

    def count(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        step = np.clip(np.round(model.raw(x) * STEPS), -STEPS, 2 * STEPS).astype(int) + STEPS
        return np.concatenate([np.bincount(step, minlength=3 * STEPS + 1), np.bincount(step, y, minlength=3 * STEPS + 1)])

    rows, good = _sum_rows(train, count).reshape(2, -1)
    model.at, model.rate = pool([((i - STEPS) / STEPS, rows[i], good[i]) for i in np.flatnonzero(rows)])
    return model


def scored(stats: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    kind = stats.schema[key].dataType.simpleString()
    held = stats.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held.value.score(_matrix(batch, 1)))], [key, "score"])

    return stats.select(key, "x").mapInArrow(each, f"`{key}` {kind}, score double")


def bucket(key: str, of: int) -> F.Column:
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(of))


def filtered(docs: DataFrame, labels: DataFrame, least: float, text: str = "text") -> DataFrame:
    """The rows whose text scores ``least`` or more, with all their columns, by a model learnt as ``learn`` does. Each text is measured once."""
    (x,) = fresh(docs, "x")
    schema = T.StructType([*docs.schema.fields, T.StructField(x, T.ArrayType(T.DoubleType()))])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in W.runs(batch, text):
                found = statistics(data, off)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, STATISTICS), pa.int32()), pa.array(found.ravel()))], schema.names)

    rows = stored(docs.mapInArrow(measure, schema), "measured")
    held = docs.sparkSession.sparkContext.broadcast(fit(rows.select("doc_id", F.col(x).alias("x")), _known(labels)))

    def verdict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = held.value.score(_matrix(batch, batch.num_columns - 1)) >= least
                yield batch.select(batch.schema.names[:-1]).filter(pa.array(keep))

    return rows.mapInArrow(verdict, docs.schema)


HELD_OUT = (4, 2)
ACCEPT = 0.7


def _known(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", F.col("quality").alias("label")).filter(bucket("doc_id", HELD_OUT[0]) != HELD_OUT[1])


def learn(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Model]:
    """Stored statistics of every row, and a model learnt from (doc_id, quality) outside of the held-out rows."""
    stats = stored(measured(docs.select("doc_id", "text")), "statistics")
    return stats, fit(stats, _known(labels))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score) of every row."""
    return scored(*learn(docs, labels))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(bucket("doc_id", HELD_OUT[0]) == HELD_OUT[1], F.lit(False))
    return done.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
