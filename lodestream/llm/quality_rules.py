"""Quality rules: repetition coverage by rolling hashes of several n-gram lengths.

A document with too many of its characters inside word n-grams that occurred
before in it, or inside lines that repeat an earlier line, is rejected, unless
they are only a few words: a sentence said twice is no fault. Counts cover whole
texts. Null and empty texts have no words and fail the length rule; repeated
rows are judged each for itself; an empty table gives no row; other columns are
kept as they are unless a new column has the same name, which then replaces them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm import words as W

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
#: Largest share of word characters inside n-grams that occurred before, by n.
MAX_COVER = {5: 0.15, 7: 0.13, 10: 0.10}
#: Largest share of word characters in lines that repeat an earlier line.
MAX_LINES = 0.20
#: So many repeated words are no fault, whatever their share.
SPARED = 20
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _covered(n: int, many: np.ndarray, first: np.ndarray, total: int) -> np.ndarray:
    step = np.zeros(total + 1, np.int64)
    hit = first[many]
    np.add.at(step, hit, 1)
    np.add.at(step, hit + n, -1)
    return np.cumsum(step)[:-1] > 0


def measure(data: np.ndarray, off: np.ndarray, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    rows = len(off) - 1
    starts, ends, row = W.words(data, off)
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
    size = chars[ends] - chars[starts]
    per = lambda at, weight=None: np.bincount(at, weight, minlength=rows).astype(np.int64)
    out = {"n_words": per(row), "word_chars": per(row, size), "n_symbols": per(np.searchsorted(off, np.flatnonzero(SYMBOL[data]), "right") - 1)}
    hashes = W.span_hashes(data, starts, ends)
    for n in (3, *lengths):
        grams, first = W.gram_hashes(hashes, row, n)
        many, later = W.repeated(W.row_keys(grams, row[first]))
        if n == 3:
            out["n_repeat_words"] = per(row[_covered(n, many, first, len(row))])
        if n in lengths:
            cover = _covered(n, later, first, len(row))
            out[f"cover_{n}"], out[f"words_{n}"] = per(row[cover], size[cover]), per(row[cover])
    # words at line starts tell the lines that have a word
    line_start, line_end, line_row = W.spans(data != 10, off)
    held = np.searchsorted(starts, line_end) - np.searchsorted(starts, line_start)
    has = held > 0
    line_start, line_end, line_row, held = line_start[has], line_end[has], line_row[has], held[has]
    _, later = W.repeated(W.row_keys(W.span_hashes(data, line_start, line_end), line_row))
    out["n_dup_lines"] = per(line_row[later])
    inside = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=inside[1:])
    letters = inside[np.searchsorted(starts, line_end)] - inside[np.searchsorted(starts, line_start)]
    out["dup_line_chars"], out["dup_line_words"] = per(line_row[later], letters[later]), per(line_row[later], held[later])
    return out


def _new(lengths: Iterable[int]) -> list[str]:
    return [*(f"{c}_{n}" for n in lengths for c in ("cover", "words")), "dup_line_chars", "dup_line_words"]


def quality_rules(docs: DataFrame, text: str = "text", max_cover: dict[int, float] | None = None, max_lines: float = MAX_LINES, spared: int = SPARED) -> DataFrame:
    """``docs`` with counts, ``base_failed`` and ``kept``."""
    limits = dict(MAX_COVER if max_cover is None else max_cover)
    lengths = tuple(sorted(limits))
    new = [*COUNTS, *_new(lengths)]
    keep = [c for c in docs.columns if c.lower() not in {*new, "base_failed", "kept"}]
    docs = docs.select(*keep)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"{c} long" for c in new)])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in W.runs(batch, text):
                found = measure(data, off, lengths)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(found[c], pa.int64()) for c in new)], [*keep, *new])

    out = docs.mapInArrow(each, schema)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    over = (F.col("dup_line_chars") > max_lines * F.col("word_chars")) & (F.col("dup_line_words") > spared)
    for n, share in limits.items():
        over = over | ((F.col(f"cover_{n}") > share * F.col("word_chars")) & (F.col(f"words_{n}") > spared))
    return out.withColumn("base_failed", failed).withColumn("kept", ~(F.col("base_failed") | over))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = quality_rules(docs)
    return done.select("doc_id", *COUNTS, "base_failed", "kept", *_new(MAX_COVER))


def _cover_sql(n: int) -> str:
    gram = " || ' ' || ".join("w" if k == 0 else f"lead(w, {k}) OVER d" for k in range(n))
    return f"""g{n} AS (SELECT doc_id, i, {gram} AS g FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
        r{n} AS (SELECT doc_id, i FROM (SELECT doc_id, i, {'count(*)' if n == 3 else 'row_number()'} OVER (PARTITION BY doc_id, g{'' if n == 3 else ' ORDER BY i'}) AS c FROM g{n} WHERE g IS NOT NULL) WHERE c > 1),
        c{n} AS (SELECT w.doc_id, count(*) AS n, sum(length(w.w)) AS chars FROM w SEMI JOIN (SELECT doc_id, i + k AS i FROM r{n}, range({n}) t(k)) x USING (doc_id, i) GROUP BY ALL)"""


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
     w AS (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1)::BIGINT AS i FROM (SELECT doc_id, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS l FROM d)),
     b AS (SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars FROM w GROUP BY ALL),
     {", ".join(_cover_sql(n) for n in (3, *MAX_COVER))},
     l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
     u AS (SELECT doc_id, line, count(*) - 1 AS again, length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g')) AS chars, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id, line),
     m AS (SELECT doc_id, sum(again) AS n_dup_lines, sum(again * chars) AS dup_line_chars, sum(again * n) AS dup_line_words FROM u GROUP BY doc_id),
     f AS (SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
            length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(c3.n, 0)::BIGINT AS n_repeat_words,
            {", ".join(f"coalesce(c{n}.chars, 0)::BIGINT AS cover_{n}, coalesce(c{n}.n, 0)::BIGINT AS words_{n}" for n in MAX_COVER)}, coalesce(dup_line_chars, 0)::BIGINT AS dup_line_chars, coalesce(dup_line_words, 0)::BIGINT AS dup_line_words
           FROM d LEFT JOIN b USING (doc_id) LEFT JOIN m USING (doc_id) {" ".join(f"LEFT JOIN c{n} ON c{n}.doc_id = d.doc_id" for n in (3, *MAX_COVER))}),
     g AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT *, NOT (base_failed OR (dup_line_chars::DOUBLE > {MAX_LINES}::DOUBLE * word_chars AND dup_line_words > {SPARED}) OR {" OR ".join(f"(cover_{n}::DOUBLE > {s}::DOUBLE * word_chars AND words_{n} > {SPARED})" for n, s in MAX_COVER.items())}) AS kept FROM g
"""
