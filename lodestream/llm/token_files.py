"""Token-id output: shards of concatenated ids with Elias-Fano document boundaries.

A segment is one file image: a header, the document numbers and the ends of
documents, both Elias-Fano coded (low bits packed, high bits unary, with a
sample of select positions), then the ids at two bytes each where the vocabulary
allows, else four. Spark's writer stores the images, so any store that Spark
writes can hold them. Rows are in ascending doc_id order, null first; rows that
share a doc_id follow the hash of their text. That hash is a range key too, so
that a doc_id with very many rows is dealt to many tasks; for it, the sample of
the ranges reads the texts. Null and empty texts give a document of the end id
alone; an empty table gives no segment; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.llm import words as W
from lodestream.llm.store import shared_dir
from lodestream.llm.tokens import Encoder, default_path

MAGIC = b"LSTK0002"
HEADER = struct.Struct("<8sQQQqBBBxxxxx")  # magic, documents, those without a number, ids, first number, width of an id, low bits of numbers and ends
SAMPLE = 64
#: A segment is closed at so many bytes of ids; a longer document has one of its own.
SEGMENT_BYTES = 4 << 20
#: And where its document numbers would span more than this.
SPAN = 1 << 62


class EliasFano:
    """A non-descending sequence in about 2 + log2(universe / n) bits each; select finds any element."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @staticmethod
    def width(n: int, universe: int) -> int:
        return max(0, (universe // max(1, n)).bit_length() - 1)

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = np.asarray(values, np.int64)
        n, bits = len(values), cls.width(len(values), universe)
        low = np.packbits(((values[:, None] >> np.arange(bits)) & 1).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> bits) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        unary[ones] = 1
        return cls(n, bits, low, np.packbits(unary, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def tobytes(self) -> bytes:
        return struct.pack("<QQ", len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def frombytes(cls, data: memoryview, n: int, bits: int) -> tuple[EliasFano, int]:
        a, b = struct.unpack_from("<QQ", data)
        at, count = 16 + a + b, -(-n // SAMPLE)
        return cls(n, bits, np.frombuffer(data, np.uint8, a, 16), np.frombuffer(data, np.uint8, b, 16 + a), np.frombuffer(data, "<u4", count, at)), at + 4 * count

    def select(self, i: int) -> int:
        """Element i, from the nearest sample."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // SAMPLE])
        left, byte = i % SAMPLE, at // 8
        bits = np.unpackbits(self.high[byte : byte + 1], bitorder="little")
        bits[: at % 8] = 0
        while (count := int(bits.sum())) <= left:
            left, byte = left - count, byte + 1
            bits = np.unpackbits(self.high[byte : byte + 1], bitorder="little")
        one = byte * 8 + int(np.flatnonzero(bits)[left])
        return ((one - i) << self.low_bits) | self._low(i, 1)[0]

    def _low(self, i: int, count: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(count, np.int64)
        first = i * self.low_bits
        bits = np.unpackbits(self.low[first // 8 : (first + count * self.low_bits + 7) // 8], bitorder="little")[first % 8 :]
        return bits[: count * self.low_bits].reshape(count, self.low_bits).astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        return ((ones - np.arange(self.n)) << self.low_bits) | self._low(0, self.n)


def pack_segment(doc_ids: list[int | None], ids: list[np.ndarray], width: int) -> bytes:
    """``doc_ids`` ascend, those without a number first; ``ids`` of each document."""
    ends = np.cumsum([len(x) for x in ids], dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    known = [d for d in doc_ids if d is not None]
    first = known[0] if known else 0
    numbers = EliasFano.encode(np.array([d - first for d in known], np.int64), known[-1] - first if known else 0)
    bounds = EliasFano.encode(ends, total)
    body = np.concatenate(ids).astype("<u2" if width == 2 else "<u4") if ids else np.zeros(0, "<u2")
    return b"".join([HEADER.pack(MAGIC, len(ids), len(ids) - len(known), total, first, width, numbers.low_bits, bounds.low_bits), numbers.tobytes(), bounds.tobytes(), body.tobytes()])


class Segment:
    def __init__(self, data: bytes):
        view = memoryview(data)
        magic, self.n, self.unknown, self.total, self.first, width, number_bits, bits = HEADER.unpack_from(view)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        at = HEADER.size
        self.numbers, used = EliasFano.frombytes(view[at:], self.n - self.unknown, number_bits)
        at += used
        self.bounds, used = EliasFano.frombytes(view[at:], self.n, bits)
        self.ids = np.frombuffer(view, "<u2" if width == 2 else "<u4", self.total, at + used)

    @property
    def doc_ids(self) -> list[int | None]:
        return [None] * self.unknown + [self.first + d for d in self.numbers.all().tolist()]

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.bounds.select(i - 1) if i else 0 : self.bounds.select(i)]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, key: str = "doc_id", text: str = "text", partitions: int | None = None) -> None:
    """Write the segments of all of ``docs`` under ``path``, in ascending order of ``key``."""
    encode = Encoder.of(tokenizer)
    width = 2 if encode.tokenizer.get_vocab_size(with_added_tokens=True) <= 65536 else 4
    spark = docs.sparkSession
    partitions = partitions or max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("key").asc_nulls_first(), F.col("tie"), F.col("body")]
    rows = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("tie"), F.col(text).alias("body"))
    rows = rows.repartitionByRange(partitions, *order[:2]).sortWithinPartitions(*order).select("key", "body")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, part, number = Encoder.of(tokenizer), TaskContext.get().partitionId(), 0
        names, held, size, first = [], [], 0, None

        def image() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([size], pa.int64()), pa.array([pack_segment(names, held, width)], pa.binary())], ["part", "segment", "n_ids", "image"])

        for batch in batches:
            for i, j, data, off in W.runs(batch, "body"):
                ids, at = coder.rows(data, off, end_id)
                for k, doc in enumerate(batch.column(0).slice(i, j - i).to_pylist()):
                    got = ids[at[k] : at[k + 1]]
                    far = doc is not None and first is not None and doc - first > SPAN
                    if held and (far or 4 * (size + len(got)) > SEGMENT_BYTES):
                        yield image()
                        number, names, held, size, first = number + 1, [], [], 0, None
                    first = doc if first is None else first
                    names.append(doc)
                    held.append(got)
                    size += len(got)
        if held:
            yield image()

    rows.mapInArrow(each, "part int, segment int, n_ids long, image binary").write.mode("overwrite").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document, read back from the files: doc_id, start, n_tokens, ids_crc32."""
    files = spark.read.parquet(path)
    earlier = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row for each partition of the writer, then those of its segments
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", earlier(Window.orderBy("part")).alias("before"))
    at = files.select("part", "segment", "n_ids").withColumn("within", earlier(Window.partitionBy("part").orderBy("segment")))
    at = at.join(parts.hint("merge"), "part").select("part", "segment", (F.col("before") + F.col("within")).alias("base"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, image in zip(*(batch.column(i) for i in range(3)), strict=True):
                segment = Segment(image.as_py())
                ends = segment.bounds.all()
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                crc = [zlib.crc32(segment.ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts, ends, strict=True)]
                n = segment.n
                yield pa.RecordBatch.from_arrays([pa.repeat(part, n), pa.repeat(number, n), pa.array(segment.doc_ids, pa.int64()), pa.array(starts), pa.array(ends - starts), pa.array(crc, pa.int64())], ["part", "segment", "doc_id", "within", "n_tokens", "ids_crc32"])

    rows = files.select("part", "segment", "image").mapInArrow(each, "part int, segment int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return rows.join(at.hint("merge"), ["part", "segment"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path, default_path())
    return read_token_files(spark, path)
