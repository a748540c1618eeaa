"""Best-fit packing by minimum bin slack.

Documents become token pieces of at most the sequence length: a longer one is
cut, the first piece taking the remainder. How pieces pack depends on their
lengths alone, so the packing runs on the counts of the lengths (at most as
many as a sequence has tokens). For each bin, with the longest piece left in
it, a subset-sum dynamic programme over bitsets finds the fullest feasible
combination of what is left; that combination is used as often as its pieces
last. Pieces then take the places of their length in order. Null counts as
empty text; an empty document is its end id; an empty table gives no row;
repeated rows are packed each for itself; columns other than key and text are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.llm import words as W
from lodestream.llm.store import stored
from lodestream.llm.tokens import Encoder, default_path

LENGTH = 2048


def fullest(counts: np.ndarray, room: int) -> list[int]:
    """Lengths of a fullest combination within ``room``; of equals, the one with the longest pieces."""
    reach, steps, full, goal = 1, [], (1 << (room + 1)) - 1, 1 << room
    for size in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        if not size:
            continue
        left, times = min(int(counts[size]), room // size), 1
        while left > 0:  # powers of two reach every multiple
            n = min(times, left)
            steps.append((size, n, reach))
            reach |= (reach << (size * n)) & full
            left, times = left - n, times * 2
        if reach & goal:
            break
    at, out = reach.bit_length() - 1, []
    for size, n, before in reversed(steps):
        if not (before >> at) & 1:
            out += [size] * n
            at -= size * n
    return out


def patterns(counts: np.ndarray, length: int) -> list[tuple[int, list[int]]]:
    """(times, lengths) so that all pieces counted in ``counts`` are placed."""
    left = counts.astype(np.int64).copy()
    out = []
    for size in range(length, 0, -1):
        while left[size]:
            left[size] -= 1
            chosen = [size, *fullest(left, length - size)]
            left[size] += 1
            used, need = np.unique(chosen, return_counts=True)
            times = int((left[used] // need).min())
            left[used] -= need * times
            out.append((times, sorted(chosen, reverse=True)))
    return out


def places(found: list[tuple[int, list[int]]], length: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: where the ranks of its pieces begin, the first sequence, the pieces in a sequence, their first offset."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    taken, sequence = [0] * (length + 1), 0
    for times, chosen in found:
        offset = 0
        for size in dict.fromkeys(chosen):
            n = chosen.count(size)
            rows.setdefault(size, []).append((taken[size], sequence, n, offset))
            taken[size] += n * times
            offset += n * size
        sequence += times
    return {size: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for size, r in rows.items()}


def cut(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces: key, piece, start, length, ids_crc32, ids, and the task and the rank among its pieces of that length."""
    names = [key, "piece", "start", "length", "ids_crc32", "ids", "task", "rank"]
    kind = docs.schema[key].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, task, seen = Encoder.of(tokenizer), TaskContext.get().partitionId(), np.zeros(length + 1, np.int64)
        for batch in batches:
            for i, j, data, off in W.runs(batch, text):
                ids, at = coder.rows(data, off, end_id)
                n = np.diff(at)
                count = -(-n // length)
                row = np.repeat(np.arange(j - i), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                first = (n - 1) % length + 1  # the first piece may be shorter
                begin = np.where(piece > 0, first[row] + (piece - 1) * length, 0)
                size = np.where(piece > 0, length, first[row])
                begins = (at[row] + begin).tolist()
                parts = [ids[b : b + s].astype("<u4").tobytes() for b, s in zip(begins, size.tolist(), strict=True)]
                crc = [zlib.crc32(x) for x in parts]
                order = np.argsort(size, kind="stable")
                held = np.bincount(size, minlength=length + 1)
                rank = np.empty(len(size), np.int64)
                rank[order] = np.arange(len(size)) - np.repeat(np.cumsum(held) - held, held) + np.repeat(seen, held)
                seen += held
                out = [piece.astype(np.int32), begin, size, np.array(crc, np.int64)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(row)), *map(pa.array, out), pa.array(parts, pa.binary()), pa.repeat(pa.scalar(task, pa.int32()), len(row)), pa.array(rank)], names)

    return docs.select(key, text).mapInArrow(each, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, ids binary, task int, rank long")


def pack(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """Add sequence_id and offset. ``pieces`` is a stored table with length, task, and rank within task and length."""
    counts = stored(pieces.groupBy("task", "length").count(), "lengths")
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("task", "length", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    # one row for each length: no more than a sequence has tokens
    total = np.zeros(length + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect():
        total[r["length"]] = r["n"]
    table = pieces.sparkSession.sparkContext.broadcast(places(patterns(total, length), length))
    ranked = pieces.join(before.hint("merge"), ["task", "length"]).withColumn("rank", F.col("rank") + F.col("before")).drop("task", "before")
    names = ranked.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema), "sequence_id long, offset long"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (batch.column(names.index(c)).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size):
                mine = size == s
                first, begin, many, at = table.value[int(s)]
                k = np.searchsorted(first, rank[mine], "right") - 1
                copy, which = np.divmod(rank[mine] - first[k], many[k])
                sequence[mine], offset[mine] = begin[k] + copy, at[k] + which * s
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(each, schema).drop("rank")


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH, with_ids: bool = False, **kw) -> DataFrame:
    """Cut and pack. ``with_ids`` keeps the ids of each piece, to be laid at its offset."""
    pieces = cut(docs, tokenizer, length, **kw)
    return pack(stored(pieces if with_ids else pieces.drop("ids"), "pieces"), length)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs, default_path()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
