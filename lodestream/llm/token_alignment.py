"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text, and how often ids meet.

Tokenizer A is a byte-level BPE, which reads a space and the text; B is a piece
model, which puts that space there itself. Byte offsets where tokens of both end
cut a text into groups; within a group, each A token is linked with each B token
whose bytes overlap its own. The count of two ids is how many links of the whole
table hold them.

Method: interval coalescing. All tokens of A and B are sorted by start, the running
maximum of their ends is taken, and a group begins where a start reaches that
maximum; overlaps are expanded within.

Neither tokenizer merges across a space that follows another character, so texts
are cut there, and each distinct piece of a run of texts is encoded and aligned
once; its links count as often as it occurs (the vocabulary of B is checked for
pieces that would forbid this). Counts are summed in tasks, before the shuffle
and after it. Pairs that make up one in ``tally.SHARE`` of all links are held by
every worker, as is the highest count of each B id (one number for each id of
its vocabulary); other pairs meet their counts by a join.

Texts that are null or empty, or whose joined token bytes differ from space and
text (such as those with U+2581, which B writes for a space), have no tokens:
zeros, and '' for the digest. Rows are aligned each for itself, also rows
alike and those with null or repeated keys; an empty table gives no row; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm import words as W
from lodestream.llm.store import stored
from lodestream.llm.tally import Tally, common, lists
from lodestream.llm.tokens import PRINTABLE, Encoder, cut_points, default_path

RUN = 1 << 20
#: Pieces that a worker remembers the B ids of, and pairs at which it hands its counts on.
KEPT, PAIRS = 60_000, 1 << 18
SHIFT = 32
_made: dict[tuple[str, str], Aligner] = {}


class PlainEncoder(Encoder):
    """Special tokens inside texts are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        self.added = []


@dataclass
class Bytes:
    """The bytes of each id of a vocabulary: joined, where they start, and how many."""

    flat: np.ndarray
    start: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, tokens: list[bytes]) -> Bytes:
        size = np.array([len(t) for t in tokens], np.int64)
        return cls(np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size, size)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        first = np.cumsum(size) - size
        return self.flat[np.repeat(self.start[ids] - first, size) + np.arange(int(size.sum()))]


@dataclass
class Pieces:
    """The distinct pieces of a run of rows, aligned, and where they occur."""

    of: np.ndarray  # piece of each occurrence, in the order of the text
    row: np.ndarray  # its row
    good: np.ndarray  # by piece: both tokenizers give its bytes back
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    keys: np.ndarray  # by link: A id and B id
    link_piece: np.ndarray
    shown: list[bytes]  # by piece: its groups as text, each with an end mark


def _decimals(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Digits of 0 to ``most`` - 1 and how many there are."""
    text = [str(i).encode() for i in range(most)]
    size = np.array([len(t) for t in text], np.int64)
    return np.array(text).view(np.uint8).reshape(most, -1), size


class Aligner:
    def __init__(self, a: str, b: str):
        import sentencepiece

        self.a, self.b = PlainEncoder(a), sentencepiece.SentencePieceProcessor(model_file=b)
        back = {c: n for n, c in PRINTABLE.items()}
        tok = self.a.tokenizer
        names = [tok.id_to_token(i) or "" for i in range(tok.get_vocab_size(with_added_tokens=True))]
        self.bytes_a = Bytes.of([bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t in names])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = Bytes.of([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        self.cuts = self.a.cuts and not any("▁" in p.lstrip("▁") for p in pieces)
        self.space = self.b.piece_to_id("▁")
        self.digits, self.n_digits = _decimals(max(len(names), len(pieces)))
        self.held: dict[bytes, list[int]] = {b" ": [self.space]}

    @classmethod
    def of(cls, a: str, b: str) -> Aligner:
        """One for each worker process."""
        if (a, b) not in _made:
            _made[a, b] = cls(a, b)
        return _made[a, b]

    def _b_ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each piece). The tokenizer puts the space that each piece begins with there itself."""
        if len(self.held) > KEPT:
            self.held = {b" ": [self.space]}
        if new := [p for p in pieces if p not in self.held]:
            self.held.update(zip(new, self.b.encode([p[1:].decode() for p in new], num_threads=1), strict=True))
        got = [self.held[p] for p in pieces]
        return np.array([i for g in got for i in g], np.int64), np.array([len(g) for g in got], np.int64)

    def read(self, data: np.ndarray, off: np.ndarray) -> Pieces:
        """``data``: rows that begin with a space, or are empty."""
        starts = cut_points(data, off)
        starts = starts[data[starts] == 32] if self.cuts else np.unique(off[:-1][np.diff(off) > 0])
        ends = np.append(starts[1:], len(data))
        row = np.searchsorted(off, starts, "right") - 1
        _, first, of = np.unique(W.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        raw = data.tobytes()
        pieces = [raw[i:j] for i, j in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        size = (ends - starts)[first]
        bounds = np.concatenate([[0], np.cumsum(size)])
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        ids_a, at_a = self.a.rows(flat, bounds)
        ids_a, count_a = ids_a.astype(np.int64), np.diff(at_a)
        ids_b, count_b = self._b_ids(pieces)
        good = self._same(self.bytes_a, ids_a, count_a, flat, bounds) & self._same(self.bytes_b, ids_b, count_b, flat, bounds)
        of_a, of_b = np.repeat(np.arange(len(pieces)), count_a), np.repeat(np.arange(len(pieces)), count_b)
        keep_a, keep_b = good[of_a], good[of_b]
        return self._align(ids_a[keep_a], of_a[keep_a], ids_b[keep_b], of_b[keep_b], of, row, good)

    @staticmethod
    def _same(table: Bytes, ids: np.ndarray, count: np.ndarray, flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Which pieces their tokens' bytes give back."""
        piece = np.repeat(np.arange(len(count)), count)
        size = np.bincount(piece, table.size[ids], minlength=len(count)).astype(np.int64)
        good = size == np.diff(bounds)
        kept = good[piece]
        joined = table.joined(ids[kept])
        byte_piece = np.repeat(np.arange(len(count)), np.diff(bounds))
        inside = good[byte_piece]
        good[byte_piece[inside][joined != flat[inside]]] = False
        return good

    def _align(self, ids_a, of_a, ids_b, of_b, of, row, good) -> Pieces:
        many, n_a = len(good), len(ids_a)
        # both cover the same bytes, so tokens of good pieces lie end to end
        end_a, end_b = np.cumsum(self.bytes_a.size[ids_a]), np.cumsum(self.bytes_b.size[ids_b])
        start_a, start_b = end_a - self.bytes_a.size[ids_a], end_b - self.bytes_b.size[ids_b]
        start, end, kind = np.concatenate([start_a, start_b]), np.concatenate([end_a, end_b]), np.repeat([0, 1], [n_a, len(ids_b)])
        order = np.lexsort((kind, start))
        reach = np.maximum.accumulate(end[order])
        new = np.ones(len(order), bool)
        new[1:] = start[order][1:] >= reach[:-1]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        n_groups = int(new.sum())
        # within its group: from the first B token that ends after the A token's start to the last that starts before its end
        low, high = np.searchsorted(end_b, start_a, "right"), np.searchsorted(start_b, end_a, "left")
        count = high - low
        first = np.cumsum(count) - count
        other = np.repeat(low - first, count) + np.arange(int(count.sum()))
        keys = (np.repeat(ids_a, count) << SHIFT) | ids_b[other]
        piece_of_group = np.zeros(n_groups, np.int64)
        piece_of_group[group] = np.concatenate([of_a, of_b])
        tally = lambda x: np.bincount(x, minlength=many)
        return Pieces(of, row, good, tally(of_a), tally(of_b), tally(piece_of_group), tally(np.repeat(of_a, count)), keys, np.repeat(of_a, count), self._show(np.concatenate([ids_a, ids_b]), group, kind, start, piece_of_group, many))

    def _show(self, ids, group, kind, start, piece_of_group, many) -> list[bytes]:
        order = np.lexsort((start, kind, group))
        ids, group, kind = ids[order], group[order], kind[order]
        mark = np.full(len(ids), ord(","), np.uint8)
        last = np.ones(len(ids), bool)
        last[:-1] = (group[1:] != group[:-1]) | (kind[1:] != kind[:-1])
        mark[last] = np.where(kind[last] == 0, ord("|"), ord(";"))
        size = self.n_digits[ids] + 1
        end = np.cumsum(size)
        out = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
        for k in range(self.digits.shape[1]):
            some = np.flatnonzero(self.n_digits[ids] > k)
            out[(end - size)[some] + k] = self.digits[ids[some], k]
        out[end - 1] = mark
        # groups of a piece follow each other
        cut = np.concatenate([[0], np.cumsum(np.bincount(piece_of_group[group], size, minlength=many).astype(np.int64))]).tolist()
        raw = out.tobytes()
        return [raw[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)]


def _spaced(batch: pa.RecordBatch, text: str) -> pa.RecordBatch:
    """Texts with a space before them; null and empty ones are empty."""
    column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string())
    some = pc.greater(pc.binary_length(pc.fill_null(column, "")), 0)
    return pa.RecordBatch.from_arrays([pc.if_else(some, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), pc.fill_null(column, ""), pa.scalar("", pa.large_string())), "")], ["text"])


def _bad(p: Pieces, rows: int) -> np.ndarray:
    """Rows with a piece that isn't given back."""
    bad = np.zeros(rows, bool)
    bad[p.row[~p.good[p.of]]] = True
    return bad


def pair_counts(docs: DataFrame, a: str, b: str, text: str = "text") -> DataFrame:
    """(h, n): links of each pair of ids over all texts; h holds the A id above SHIFT and the B id below."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, tally = Aligner.of(a, b), Tally(["h", "n"], PAIRS)
        for batch in batches:
            for i, j, data, off in W.runs(_spaced(batch, text), "text", RUN):
                p = both.read(data, off)
                times = np.bincount(p.of[~_bad(p, j - i)[p.row]], minlength=len(p.good))
                yield from tally.add(p.keys, times[p.link_piece])
        yield from tally.rest()

    return docs.select(text).mapInArrow(each, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, a: str, b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    spark = docs.sparkSession
    counts = stored(pair_counts(docs, a, b, text).filter("n > 0"), "pairs").withColumn("b", F.col("h").bitwiseAND(F.lit((1 << SHIFT) - 1)))
    top = counts.groupBy("b").agg(F.max("n").alias("top"))
    tops = top.toArrow()  # a row for each B id
    best = np.zeros(int(pc.max(tops.column(0)).as_py() or 0) + 1 if tops.num_rows else 1, np.int64)
    best[tops.column(0).to_numpy()] = tops.column(1).to_numpy()
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    held = spark.sparkContext.broadcast((common(counts, total), best))
    kind = docs.schema[key].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        both, (known, tops), number = Aligner.of(a, b), held.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            for i, j, data, off in W.runs(_spaced(batch, text), "text", RUN):
                n = j - i
                p = both.read(data, off)
                bad, many = _bad(p, n), len(p.good)
                fine = ~bad[p.row]
                of, row = p.of[fine], p.row[fine]
                place = known.find(p.keys)
                sure = place >= 0
                count = known.counts[place[sure]] if len(known.keys) else np.zeros(0, np.int64)
                sums, bests = np.zeros(many, np.int64), np.zeros(many, np.int64)
                np.add.at(sums, p.link_piece[sure], count)
                np.add.at(bests, p.link_piece[sure], (count == tops[p.keys[sure] & ((1 << SHIFT) - 1)]).astype(np.int64))
                # links of pairs that aren't held: those of each occurrence of their piece
                rare = np.flatnonzero(~sure)
                rare = rare[np.argsort(p.link_piece[rare], kind="stable")]
                per = np.bincount(p.link_piece[rare], minlength=many)
                begin = np.cumsum(per) - per
                size = per[of]
                where = np.repeat(begin[of] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                keys, at = p.keys[rare][where], np.repeat(row, size)
                order = np.lexsort((keys, at))
                keys, at = keys[order], at[order]
                first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (at[1:] != at[:-1])])) if len(keys) else np.zeros(0, np.int64)
                times = np.diff(np.append(first, len(keys)))

                def add(v: np.ndarray, of: np.ndarray = of, row: np.ndarray = row, n: int = n) -> pa.Array:
                    out = np.zeros(n, np.int64)
                    np.add.at(out, row, v[of])
                    return pa.array(out)

                cut = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).tolist()
                seq, digests = of.tolist(), []
                for x, y in zip(cut[:-1], cut[1:], strict=True):
                    digests.append(hashlib.sha256(b"".join(map(p.shown.__getitem__, seq[x:y]))[:-1]).hexdigest() if y > x else "")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(number, number + n)), batch.column(0).slice(i, n), *(add(v) for v in (p.n_a, p.n_b, p.n_groups, p.n_links, bests, sums)),
                        pa.array(digests, pa.string()), *lists([keys[first], times], at[first], n),
                    ],
                    ["row", "doc", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "h", "times"],
                )
                number += n

    slim = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    rows = stored(slim.select("doc", "text").mapInArrow(each, f"row long, doc {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, h array<long>, times array<long>"), "aligned")
    flat = rows.filter(F.size("h") > 0).select("row", F.explode(F.arrays_zip("h", "times")).alias("x")).select("row", "x.*")
    marked = counts.join(top.hint("merge"), "b").select("h", "n", (F.col("n") == F.col("top")).alias("best"))
    more = flat.join(marked.hint("merge"), "h").groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("more_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    done = rows.join(more.hint("merge"), "row", "left")
    return done.select(F.col("doc").alias(key), "n_a", "n_b", "n_groups", "n_links", plus("n_best", "more_best"), plus("count_sum", "more_sum"), "groups_sha256")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return align(docs, default_path(), public_tokenizers.path("piece_bpe_32k.model"))
