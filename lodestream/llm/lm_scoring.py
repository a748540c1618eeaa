"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

Tokens are words with A-Z lower-cased, and an end for each text. The HEAD most
frequent ones stand in CLASSES classes of WORDS each, by frequency; every other
token is in one of TAIL classes by its last two bytes. The probability of a token
is that of its class given what stands before, times that of the token within
the class: for head classes a second softmax, for tail classes the share of its
count, in which one half counts for each token and once for all unseen ones of
the class. So the probabilities of all training tokens and of an unseen one of
each tail class sum to one.

Both softmaxes take the same features, hashed into tables of fixed size: the
token before, those two and three before (skips), and the pair before. They are
trained by iterative scaling: in each round all tasks go over a slice of the
training texts and sum what was seen and what the model expects of each weight;
the driver moves the weights by a part of the log of their ratio. Each training
text is in one slice. Counts cover all training texts: common tokens (one in
``tally.SHARE`` or more) are held by every worker, others meet their counts by a
join. Tokens go by hashes of 64 bits.

Null texts are empty ones: an end alone. Every row is scored for itself, also
rows alike and those with a null or repeated key. Without training texts nothing
is known, and an unseen token has the share of its class. An empty table gives
no row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm import words as W
from lodestream.llm.quality_classifier import bucket
from lodestream.llm.store import stored, stored_by
from lodestream.llm.tally import Common, Tally, common, lists

CLASSES, WORDS, TAIL = 16, 32, 32
HEAD, OUT = CLASSES * WORDS, CLASSES + TAIL
#: Ids of tokens as context: common ones have their own, others the one of their tail class.
IDS = 4096
OWN = IDS - TAIL
#: Rows of the feature tables: three single tokens, pairs, and those of tokens within a class. Both tables have at most 65,536.
PAIRS, INNER = 4096, 1 << 14
OUTER = 3 * IDS + PAIRS
TEMPLATES = 4
ROUNDS = 8
#: Part of the log ratio that a round moves, and what is added to both counts.
STEP, SMOOTH = 0.35, 3.0
#: Tokens in one pass through the tables, and weights in one row of the gradients.
RUN, BLOCK = 1 << 14, 1 << 16
#: Logits are held to this, so that no exponential overflows.
LOGIT = np.float32(80)
END = W.mix(np.array([0x5EED], np.uint64))[0]
HELD_OUT = (5, 1)


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, tail class, offsets of rows) of all tokens of all rows."""
    low = W.LOWER[data]
    s, e, row = W.words(low, off)
    at = np.zeros(len(off), np.int64)
    np.cumsum(np.bincount(row, minlength=len(off) - 1) + 1, out=at[1:])
    h, tail = np.full(int(at[-1]), END), np.zeros(int(at[-1]), np.int8)
    place = np.arange(len(s)) + row  # each row before has an end
    h[place] = W.span_hashes(low, s, e)
    last = low[e - 1].astype(np.uint64) + np.uint64(256) * np.where(e - s > 1, low[np.maximum(e - 2, 0)], 0).astype(np.uint64)
    tail[place] = (W.mix(last) % np.uint64(TAIL)).astype(np.int8)
    return h, tail, at


class Model:
    """Ids below HEAD are the head; OWN and above stand for the tail classes."""

    def __init__(self, known: Common, head: np.ndarray, tail_of: np.ndarray, masses: np.ndarray, total: int, kinds: int):
        """``head``: places of ``known`` from the most frequent on; ``tail_of`` of each; ``masses``: per tail class, (count, kinds) outside of the head."""
        self.known, self.total, self.kinds = known, total, kinds
        n = len(known.keys)
        self.id_of = OWN + tail_of.astype(np.int64)
        self.id_of[head[:OWN]] = np.arange(min(OWN, len(head)))
        self.class_of = np.concatenate([np.repeat(np.arange(CLASSES), WORDS), np.zeros(OWN - HEAD, np.int64), CLASSES + np.arange(TAIL)])
        later = head[HEAD:OWN]
        self.class_of[HEAD : HEAD + len(later)] = CLASSES + tail_of[later]
        self.masses = masses[:, 0] + 0.5 * (masses[:, 1] + 1)
        count = np.zeros(HEAD)
        count[: min(HEAD, n)] = known.counts[head[:HEAD]]
        with np.errstate(divide="ignore"):
            self.inner_bias = np.log(count).reshape(CLASSES, WORDS).astype(np.float32)
            self.bias = np.log(np.concatenate([count.reshape(CLASSES, WORDS).sum(1), self.masses])).astype(np.float32)
        self.inner_bias[count.reshape(CLASSES, WORDS).sum(1) == 0] = 0
        self.weights = np.zeros(OUTER * OUT + INNER * WORDS, np.float32)

    @property
    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        return self.weights[: OUTER * OUT].reshape(OUTER, OUT), self.weights[OUTER * OUT :].reshape(INNER, WORDS)

    def light(self) -> Model:
        """What the softmaxes take."""
        other = copy(self)
        other.known = other.id_of = None
        return other

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.total + 0.5 * (self.kinds + 1)))

    def runs(self, ids: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first token, ids, feature rows, classes) run by run; features don't cross rows."""
        place = np.arange(len(ids)) - np.repeat(at[:-1], np.diff(at))
        for i in range(0, len(ids), RUN):
            now, deep = ids[i : i + RUN], place[i : i + RUN]
            back = [np.where(deep >= k, ids[np.maximum(np.arange(i, i + len(now)) - k, 0)], OWN) for k in (1, 2, 3)]
            pair = W.mix((back[1] * IDS + back[0]).astype(np.uint64)) % np.uint64(PAIRS)
            yield i, now, np.stack([back[0], IDS + back[1], 2 * IDS + back[2], 3 * IDS + pair.astype(np.int64)]), self.class_of[now]

    @staticmethod
    def inner_rows(rows: np.ndarray, kind: np.ndarray) -> np.ndarray:
        return (W.mix((rows * CLASSES + kind).astype(np.uint64)) % np.uint64(INNER)).astype(np.int64)

    @staticmethod
    def softmax(bias: np.ndarray, table: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(logits, their exponentials, sums of those)."""
        z = table.take(rows[0], axis=0)
        for r in rows[1:]:
            z += table.take(r, axis=0)
        z += bias
        np.minimum(z, LOGIT, out=z)
        p = np.exp(z)
        return z, p, p @ np.ones(p.shape[1], np.float32)

    def parts(self, ids: np.ndarray, at: np.ndarray) -> Iterator[tuple]:
        """(tokens, first weight, bias, table, feature rows, outcomes) of both softmaxes, run by run."""
        outer, inner = self.tables
        for i, now, rows, kind in self.runs(ids, at):
            yield np.arange(i, i + len(now)), 0, self.bias, outer, rows, kind
            head = np.flatnonzero(now < HEAD)
            if len(head):
                kind = kind.take(head)
                yield i + head, OUTER * OUT, self.inner_bias.take(kind, axis=0), inner, self.inner_rows(rows.take(head, axis=1), kind), now.take(head) % WORDS

    def logs(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each token's class, and of head tokens within it."""
        out = np.zeros(len(ids))
        for where, _, bias, table, rows, hit in self.parts(ids, at):
            z, _, total = self.softmax(bias, table, rows)
            out[where] += z[np.arange(len(hit)), hit] - np.log(total)
        return out

    def expect(self, ids: np.ndarray, at: np.ndarray, seen: np.ndarray, mean: np.ndarray) -> None:
        """Adds to the counts of each weight what was seen and what the model expects."""
        for _, first, bias, table, rows, hit in self.parts(ids, at):
            _, p, total = self.softmax(bias, table, rows)
            p /= total[:, None]
            across, width = np.ascontiguousarray(p.T), table.shape[1]
            to = mean[first : first + table.size].reshape(table.shape)
            for r in rows:
                np.add.at(seen, first + r * width + hit, np.float32(1))
                order = np.argsort(r.astype(np.uint16), kind="stable")
                r = r.take(order)
                begins = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
                to[r[begins]] += np.add.reduceat(across.take(order, axis=1), begins, axis=1).T


def _train_counts(docs: DataFrame, text: str) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(["h", "n", "tail"])
        for batch in batches:
            for _, _, data, off in W.runs(batch, text, 4 * W.CHUNK):
                h, tail, _ = tokens(data, off)
                yield from tally.add(h.view(np.int64), np.ones(len(h), np.int64), tail)
        yield from tally.rest()

    return docs.select(text).mapInArrow(each, "h long, n long, tail byte").groupBy("h").agg(F.sum("n").alias("n"), F.first("tail").alias("tail"))


def _start(counts: DataFrame) -> Model:
    """The model without weights, from a stored (h, n, tail) table."""
    by_tail = counts.groupBy("tail").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).collect()  # TAIL rows
    total, kinds = sum(r["n"] for r in by_tail), sum(r["kinds"] for r in by_tail)
    masses = np.zeros((TAIL, 2))
    for r in by_tail:
        masses[r["tail"]] = r["n"], r["kinds"]
    known = common(counts, total, more=("tail",))
    tail_of = known.more[0].astype(np.int64)
    head = np.lexsort((known.keys, -known.counts))
    first = head[:HEAD]
    np.subtract.at(masses, (tail_of[first], 0), known.counts[first])
    np.subtract.at(masses, (tail_of[first], 1), 1)
    return Model(known, head, tail_of, masses, total, kinds)


def _read(docs: DataFrame, model: Model, text: str) -> DataFrame:
    """A row for each of ``docs`` (columns doc, held, slice, text): ids, what common tokens add to the scores, and the other tokens with their counts."""
    kind = docs.schema["doc"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        m, row = held.value, TaskContext.get().partitionId() << 40
        share = np.log10((m.known.counts + 0.5) / m.masses[m.known.more[0]])
        share[m.id_of < HEAD] = 0
        base = m.base(m.known.counts)
        for batch in batches:
            for i, j, data, off in W.runs(batch, text, 2 * W.CHUNK):
                h, tail, at = tokens(data, off)
                place = m.known.find(h.view(np.int64))
                of, sure = np.repeat(np.arange(j - i), np.diff(at)), place >= 0
                ids = OWN + tail.astype(np.int64)
                ids[sure] = m.id_of[place[sure]]
                add = lambda v: np.bincount(of[sure], v[place[sure]], minlength=j - i).astype(float)
                rare = np.flatnonzero(~sure)
                order = rare[np.lexsort((h[rare], of[rare]))]
                new = np.flatnonzero(np.concatenate([[True], (np.diff(of[order]) > 0) | (h[order][1:] != h[order][:-1])])) if len(order) else order
                times = np.diff(np.append(new, len(order))).astype(np.int32)
                order = order[new]
                whole = ids.astype("<u2").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + j - i)), *(batch.column(c).slice(i, j - i) for c in range(3)), pa.array(np.diff(at)),
                        pa.array(np.bincount(of[sure], minlength=j - i)), pa.array(add(base)), pa.array(add(share)),
                        pa.array([whole[2 * a : 2 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary()),
                        *lists([h[order].view(np.int64), tail[order], times], of[order], j - i),
                    ],
                    NAMES,
                )
                row += j - i

    return docs.select("doc", "held", "slice", text).mapInArrow(each, f"row long, doc {kind}, held boolean, slice int, n_tokens long, sure long, base double, share double, ids binary, h array<long>, tail array<byte>, times array<int>")


NAMES = ["row", "doc", "held", "slice", "n_tokens", "sure", "base", "share", "ids", "h", "tail", "times"]


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of little-endian pairs of bytes, and the offsets of rows."""
    column = batch.column(0).cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, "<u2")[off[0] // 2 : off[-1] // 2].astype(np.int64), (off - off[0]) // 2


def _round(train: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(seen, expected) of all weights over ``train``. Tasks send blocks of fixed size, which other tasks add up one after the other."""
    held = train.sparkSession.sparkContext.broadcast(model.light())
    size = len(model.weights)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, mean = np.zeros(size, np.float32), np.zeros(size, np.float32)
        for batch in batches:
            if batch.num_rows:
                held.value.expect(*_ids(batch), seen, mean)
        for b in range(0, size, BLOCK):
            if seen[b : b + BLOCK].any() or mean[b : b + BLOCK].any():
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([seen[b : b + BLOCK].tobytes()], pa.binary()), pa.array([mean[b : b + BLOCK].tobytes()], pa.binary())], ["b", "seen", "mean"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, *both in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                both = np.stack([np.frombuffer(x, np.float32) for x in both]).astype(float)
                sums[b] = sums[b] + both if b in sums else both
        for b, (x, y) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([x.astype(np.float32).tobytes()], pa.binary()), pa.array([y.astype(np.float32).tobytes()], pa.binary())], ["b", "seen", "mean"])

    kind = "b int, seen binary, mean binary"
    rows = train.select("ids").mapInArrow(part, kind).repartition("b").mapInArrow(total, kind).collect()  # the size of the model
    seen, mean = np.zeros(size, np.float32), np.zeros(size, np.float32)
    for r in rows:
        seen[r["b"] : r["b"] + BLOCK], mean[r["b"] : r["b"] + BLOCK] = np.frombuffer(r["seen"], np.float32), np.frombuffer(r["mean"], np.float32)
    held.unpersist()
    return seen, mean


def lm_scores(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, Model]:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row, log10, and the model, learnt from rows where ``held_out`` is false."""
    spark = docs.sparkSession
    slim = docs.select(F.col(key).alias("doc"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text).alias("text"))
    counts = stored(_train_counts(slim.filter("not held"), "text"), "counts")
    model = _start(counts)
    slice_ = F.when(F.col("held"), ROUNDS).otherwise(F.pmod(F.xxhash64("doc", "text"), F.lit(ROUNDS))).cast("int")
    rows = stored_by(_read(slim.select("doc", "held", slice_.alias("slice"), "text"), model, "text"), "ids", "slice")
    for r in range(ROUNDS):
        seen, mean = _round(rows.filter(F.col("slice") == r), model)
        model.weights += np.float32(STEP) * np.log((seen + np.float32(SMOOTH)) / (mean + np.float32(SMOOTH)))
    held = spark.sparkContext.broadcast(model.light())
    masses = F.array(*(F.lit(float(x)) for x in model.masses))
    flat = rows.filter(F.size("h") > 0).select("row", F.explode(F.arrays_zip("h", "tail", "times")).alias("x")).select("row", "x.*")
    met = flat.join(counts.select("h", "n").hint("merge"), "h", "left").withColumn("c", F.coalesce("n", F.lit(0)) + F.lit(0.5))
    rare = met.groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more"),
        F.sum(F.col("times") * F.log10(F.col("c") / (model.total + 0.5 * (model.kinds + 1)))).alias("rare_base"),
        F.sum(F.col("times") * F.log10(F.col("c") / F.get(masses, F.col("tail")))).alias("rare_share"),
    )
    kind = docs.schema[key].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, at = _ids(batch)
                logs = np.add.reduceat(held.value.logs(ids, at), at[:-1]) / np.log(10)  # no row is without an end
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(logs)], ["row", "doc", "held", "n_tokens", "sure", "base", "share", "logs"])

    done = rows.select("ids", "row", "doc", "held", "n_tokens", "sure", "base", "share").mapInArrow(each, f"row long, doc {kind}, held boolean, n_tokens long, sure long, base double, share double, logs double")
    nil = lambda c: F.coalesce(c, F.lit(0))
    return done.join(rare.hint("merge"), "row", "left").select(
        F.col("doc").alias(key), F.col("held").alias("held_out"), "n_tokens", (F.col("sure") + nil("more")).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + nil("rare_base")).alias("base_score"), (F.col("logs") + F.col("share") + nil("rare_share")).alias("score"),
    ), model


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return lm_scores(docs, bucket("doc_id", HELD_OUT[0]) == HELD_OUT[1])[0]
